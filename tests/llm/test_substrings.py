"""Windows whose hashes collide, repeated ids and long words: the same words go as by brute force."""

import hashlib
import random

import pytest

from driftline.llm import substrings


def repeats(rows):
    """(id, text) of each row to its counts and digest; earlier is a smaller id, then a smaller place in the list."""
    seen, out = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - 19):
            if seen.setdefault(tuple(w[s : s + 20]), (i, s)) != (i, s):
                gone |= set(range(s, s + 20))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def texts(seed, n=40):
    rng = random.Random(seed)
    words = lambda n, k=300: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    shared = [words(k) for k in (20, 30, 90, 200)]
    return [" ".join([words(rng.randrange(60)), rng.choice(shared), words(rng.randrange(40)), rng.choice(shared)]) for _ in range(n)]


@pytest.mark.parametrize("bits", [64, 12, 4])
def test_collisions_are_found_and_grouped_anew(spark, bits):
    rows = list(enumerate([*texts(bits), None, "", "a " * 70]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in substrings.remove_repeats(df, bits=bits).collect())
    assert got == sorted(repeats(rows))


def test_long_words_that_collide_in_polynomial_hashes(spark):
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    same = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{same} {thue}"), (2, f"{same} {thue.translate(str.maketrans('ab', 'ba'))}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in substrings.remove_repeats(df).collect()) == repeats(rows)


def test_rows_without_ids_are_documents_of_their_own(spark):
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(None, "x " + shared), (None, " ".join(f"u{i}" for i in range(50))), (3, shared), (3, shared), (4, shared + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(df).collect())
    assert got == [(0, 31, 0), (0, 50, 0), (3, 30, 30), (3, 30, 30), (4, 31, 30)]


def test_kept_words_come_as_text(spark):
    rows = [(1, " ".join(f"s{i}" for i in range(40))), (2, "new " + " ".join(f"s{i}" for i in range(25)) + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in substrings.remove_repeats(df, with_text=True).collect()} == {1: rows[0][1], 2: "new end"}
