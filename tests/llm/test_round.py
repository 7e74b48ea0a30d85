"""Vector codes, license scans and source divergence against plain Python, on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from driftline.llm import codes, divergence, language, licenses, pii, secrets, toxicity
from tests.llm.test_ops import DATA, ODD, frame, run

VECTORS = "vec_id long, embedding array<double>, label int, code string, error string, v string, id string, _label string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], VECTORS)


def plain_codes(rows):
    """The contract in plain integers: full search of every codebook."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=1) // 8) * 8
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    d = width // 8
    part = lambda v, p: v[p * d : (p + 1) * d]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books = [[part(v, p) for _, v, _ in first] for p in range(8)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(6):
        found = [[near(v, p)[1] for p in range(8)] for _, v, _ in kept]
        for p in range(8):
            for k in range(len(books[p])):
                mine = [part(v, p) for (_, v, _), f in zip(kept, found, strict=True) if f[p] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
        books = [list(b) for b in books]
    out, by_label = [], Counter()
    for i, v, label in kept:
        got = [near(v, p) for p in range(8)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(e for e, _ in got), label))
        by_label[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], sha) for i, c, e, label in out), key=str)


@pytest.mark.parametrize("case", ["clusters", "ties", "few", "odd", "wide", "large"])
def test_codes_equal_plain_search(spark, case):
    rng = random.Random(case)
    if case == "clusters":
        centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(9)]
        rows = [(i, [c + rng.gauss(0, 0.1) for c in centres[i % 9]], i % 3 or None) for i in range(400)]
    elif case == "ties":
        rows = [(i // 2, [rng.choice([-0.25, 0.0, 0.25]) for _ in range(8)], 1) for i in range(300)]
    elif case == "few":
        rows = [(i, [rng.random() for _ in range(8)], None) for i in range(5)]
    elif case == "odd":
        bad = [None, [], [None] * 8, [math.nan] * 8, [1.0] * 7 + [math.inf]]
        rows = [(i, bad[i % 7] if i % 7 < 5 else [rng.random() for _ in range(rng.choice([3, 8, 11]))], 2) for i in range(140)] + [(None, [0.5] * 8, 2), (3, [0.1] * 8, 3), (3, [0.1] * 8, 3)]
    elif case == "wide":
        rows = [(i, [rng.gauss(0, 1) for _ in range(72)], i % 2) for i in range(60)]
    else:
        rows = [(i, [rng.uniform(-6e4, 6e4) for _ in range(16)], 0) for i in range(80)]
    got = run(codes.op11_codes, spark, embeddings=vectors(spark, rows))
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got), key=str) == plain_codes(rows)


def test_codes_of_nothing(spark):
    assert run(codes.op11_codes, spark, embeddings=vectors(spark, [])) == []


def test_cells_refine_few_entries():
    import numpy as np

    rng = np.random.default_rng(1)
    entries = rng.integers(-4096, 4096, (16, 8))
    parts = entries[rng.integers(0, 16, 500)] + rng.integers(-300, 300, (500, 8))
    exact = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    best, gap = codes.Cells(entries).nearest(parts)
    assert (best == exact.argmin(axis=1)).all() and (gap == exact.min(axis=1)).all()
    big = codes.Cells(entries.astype(object) * 10**12).nearest(parts.astype(object) * 10**12)
    assert (big[0] == best).all() and all(int(a) == int(b) * 10**24 for a, b in zip(big[1], gap, strict=True))


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


LICENSES = [
    "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "CC-BY cc, by CC by", "mit mit license license mit-license",
    "This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC\n * LICENSE gnu general public licence", "Licensed under the Apache License, Version 2.0", "apache\x00license\x7f apache_license apacheélicense é apache license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "permission is hereby granted free of charge", "The mitigation license. general public. by cc", "cc by " * 3000, "gnu " * 2000 + "general public license", "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met",
]


def test_licenses_equal_plain_search(spark):
    texts = ODD + LICENSES + LICENSES[:2]
    rows = run(licenses.op12_licenses, spark, documents=frame(spark, texts))
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_licenses(texts[r["doc_id"]]), texts[r["doc_id"]][:80]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    labels = {texts[r["doc_id"]]: r["labels"] for r in rows}
    n = len(ODD)
    assert [labels[t] for t in texts[n : n + 14]] == ["mit", "cc-by,cc-by-nc", "cc-by", "mit", "gpl,gpl-3", "gpl", "apache,apache-2.0", "apache", "mit", "", "", "cc-by", "gpl", "bsd"]
    assert run(licenses.op12_licenses, spark, documents=frame(spark, [])) == []


def test_licenses_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = run(licenses.op12_licenses, spark, documents=docs)
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows} == {i: plain_licenses(t) for i, t in texts.items()}
    assert any(r["n_base"] for r in rows) and all(r["labels"] == "" for r in rows if not re.search("(?i)licen[cs]e|cc|permission|redistrib", texts[r["doc_id"]] or ""))


def plain_divergence(rows, least):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    lists = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))) for text, lang, source in rows]
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in lists:
        held[lang].update(set(words))
        counts[lang, source].update(words)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        v = len(kept)

        def share(get, v=v, kept=kept):
            total = sum(map(get, kept))
            return {t: 1 + (10**9 * (get(t) + 2)) // (total + 2 * v) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        q = share(lambda t, lang=lang, sources=sources: sum(counts[lang, s][t] for s in sources))
        p = {s: share(lambda t, s=s, lang=lang: counts[lang, s][t]) for s in sources}
        for s in sources:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources - {s})
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])[:10]
            out += [(lang, s, part, i.decode(), -x, k + 1) for part, found in (("pair", pair), ("term", term)) for k, (x, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("terms, strip", [(4096, 128), (7, 3)])
def test_divergence_equals_plain_python(spark, terms, strip):
    rng = random.Random(4)
    words = ["Alpha", "beta", "ünï", "日本", "zz", "the", "a", *(f"w{c}{d}" for c in "abcdef" for d in "ghijk")]
    rows = []
    for i in range(160):
        bias = words[i % 8 : i % 8 + 6] * 3
        text = " ".join(rng.choice(words + bias) for _ in range(rng.randrange(30)))
        rows.append((text, rng.choice(["en", "de", None]), rng.choice([f"s{k}" for k in range(8)] + [None, "", "é"])))
    rows += [(t, "en", "s1") for t in ODD] + [(None, "xx", "a"), ("rare words only", "xx", "b"), (None, "xx", "c"), ("", None, None)] + [("123 456", "de", "numbers")]
    schema = "text string, lang string, source string, n long, docs string, term string, kinds string, block string"
    docs = spark.createDataFrame([(*r, 0, "x", "x", "x", "x") for r in rows], schema)
    got = divergence.divergence(docs, terms=terms, strip=strip).collect()
    assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got) == plain_divergence(rows, 10)
    assert divergence.divergence(docs.limit(0)).collect() == []


def test_counts_sent_early(spark):
    docs = spark.createDataFrame([(f"a b c d{i} b", "en", f"s{i % 2}") for i in range(40)], "text string, lang string, source string").coalesce(1)
    order = ["lang", "source", "term", "n", "docs"]
    few, many = (sorted(map(tuple, divergence.term_counts(docs, h).select(*order).collect()), key=str) for h in (3, 400_000))
    assert few == many and ("en", "s0", "b", 40, 20) in many


def test_proportions_do_not_overflow():
    import numpy as np

    counts, total, kinds = np.array([0, 7, 10**15]), np.array([4 * 10**15]), 3
    assert divergence.proportions(counts, total, kinds).tolist() == [1 + 10**9 * (c + 2) // (4 * 10**15 + 6) for c in counts.tolist()]
    assert divergence.proportions(np.array([9]), np.array([9]), 1).tolist() == [10**9 + 1]


def test_toxicity_with_six_labels_and_nothing_induced(spark):
    rng = random.Random(7)
    plain = ["river", "stone", "market", "window", "garden", "letter", "winter", "bridge", "music", "paper"]
    insults = ["you idiot and moron", "stupid worthless scum", "pathetic vermin, you clown", "you are such a loser", "disgusting trash, i hate you", "what an 1d10t you fool"]
    rows = [(i, " ".join(rng.choices(plain, k=25)) + (" " + insults[i // 20 % 6] if i % 20 == 0 else "")) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {r["doc_id"] for r in docs.filter(toxicity.held_out(docs["doc_id"])).collect()}
    toxic = [i for i in range(0, 240, 20) if i not in held][:6]
    marks = spark.createDataFrame([(i, int(i in toxic)) for i in range(240) if i not in held and (i in toxic or i % 20)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in run(toxicity.op10_toxicity, spark, documents=docs, labels=marks)}
    assert len(set(got.values())) > 1
    assert all((got[i] >= 0.7) == (i % 20 == 0) for i in range(240)), sorted((i, s) for i, s in got.items() if i % 20 == 0 or s > 0.5)


def plain_toxicity(features, weights, text):
    """The score of one text: words looked up one by one, counted, weighed."""
    words = toxicity.WORD.findall((text or "").lower())
    counts = Counter(f for w in words for f in toxicity.features_of(w) if f in features)
    z = weights[-1]
    if counts:
        total = sum(counts.values())
        z += sum(weights[features.index(f)] * math.log1p(n) for f, n in counts.items()) + weights[-3] * math.log1p(total) + weights[-2] * min(1, 20 * total / max(1, len(words)))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_toxicity_query_equals_plain_scores(spark):
    docs, marks = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    features, weights = toxicity.fit(docs, marks)
    got = {r["doc_id"]: r for r in run(toxicity.op10_toxicity, spark, documents=docs, labels=marks)}
    assert len({r["score"] for r in got.values()}) > 1
    for r in docs.collect():
        want = plain_toxicity(features, weights, r["text"])
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-9 and got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.7)


def test_label_model_discounts_correlated_voters():
    import numpy as np

    rng = np.random.default_rng(3)
    truth = rng.random(30_000) < 0.15
    lead = rng.random(30_000) < np.where(truth, 0.7, 0.05)
    follow = lambda: np.where(rng.random(30_000) < 0.9, lead, rng.random(30_000) < 0.5)
    alone = [rng.random(30_000) < np.where(truth, hit, false) for hit, false in ((0.8, 0.03), (0.75, 0.02))]
    loud = [rng.random(30_000) < 0.1 for _ in range(2)]
    votes = np.column_stack([follow(), follow(), follow(), *alone, *loud]).astype(int)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    known = np.zeros((len(counts), 2))
    np.add.at(known, (where.ravel()[:15_000], truth[:15_000].astype(int)), 1)
    post = toxicity.label_model(patterns, counts, 0.2, known)[where.ravel()]
    only_followers = (votes[:, :3].sum(axis=1) == 3) & (votes[:, 3:5].sum(axis=1) == 0)
    assert ((post > 0.5) == truth).mean() > 0.95 and post[only_followers].mean() < 0.6


def test_a_text_alone_is_as_in_a_batch(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, logs = language.fit(docs)
    texts = [r["text"] for r in docs.collect() if r["text"] and language.has_letter(r["text"])][:150]
    together = language.mixtures(texts, logs)
    assert all((language.mixtures([t], logs)[0] == together[i]).all() for i, t in enumerate(texts)) and len(names) > 1


def test_account_numbers_before_capitals(spark):
    texts = ["GB82 WEST 1234 5698 7654 32 IS MY ACCOUNT", "pay GB82WEST12345698765432 NOW", "iban DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432X", "GB83 WEST 1234 5698 7654 32 bank", "bank NO9386011117947"]
    rows = pii.find_pii(frame(spark, texts)).collect()
    got = {r["doc_id"]: [texts[r["doc_id"]][s["s"] : s["e"]] for s in r["spans"] if s["k"] == "iban"] for r in rows}
    assert got == {0: ["GB82 WEST 1234 5698 7654 32"], 1: ["GB82WEST12345698765432"], 2: ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"], 3: [], 4: [], 5: ["NO9386011117947"]}


def test_spans_free_of_others(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    spans = lambda n: [tuple(sorted(p)) for p in zip(*[iter(sorted(rng.sample(range(900), 2 * n)))] * 2, strict=True)]
    rows = [(i, spans(rng.randrange(30)), spans(rng.randrange(12)), spans(rng.randrange(12))) for i in range(80)]
    kind = "array<struct<s:bigint,e:bigint>>"
    df = spark.createDataFrame(rows, f"i int, x {kind}, a {kind}, b {kind}")
    for r in df.select("*", secrets.clear_of(F.col("x"), [F.col("a"), F.col("b")]).alias("free")).collect():
        want = [x for x in r["x"] if not any(x["s"] < y["e"] and y["s"] < x["e"] for y in (*r["a"], *r["b"]))]
        assert r["free"] == want


def test_many_hashes_in_one_text(spark):
    import time

    rng = random.Random(1)
    token = lambda k, letters: "".join(rng.choices(letters, k=k))
    text = "\n".join(f"{token(40, '0123456789abcdef')} {token(30, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789')}" for _ in range(50_000))
    start = time.time()
    row = secrets.find_secrets(frame(spark, [text])).collect()[0]
    kinds = Counter(s["k"] for s in row["spans"])
    assert kinds["hex"] == 50_000 and kinds["random"] > 40_000 and time.time() - start < 240
