"""Substring dedup on a De Bruijn graph of words: 20-word windows are its edges, repeated paths are compacted and verified.

An edge is a window of 20 words. Each window has an anchor, the 6-word run in it with the least hash; consecutive windows
with the same anchor are one path from the start, so equal windows always lie at the same place of paths with the same
anchor. A path that equals an earlier one points to its coordinates (document, word) as a whole. Where an anchor branches,
that is where different paths share it, the paths are taken apart to single edges, which point to the equal one before.
Neighbours that point to neighbours are compacted to one long path, and every long path is then joined with the text at
its source coordinates and compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Kept, cut, table

WINDOW, ANCHOR = 20, 6
#: Words hashed at once, rows gathered in a task before equal ones are combined, words to a block of verified source text.
SLICE, COMBINE, BLOCK = 500_000, 1_000_000, 64
#: Stands for a null doc_id, before all others; no other row may have it.
NO_ID = -(1 << 63)
#: More than the windows that can share an anchor.
PLACES = 16
AT = ["doc", "copy"]
SOURCE = ["sdoc", "scopy", "spos"]


def mix(x):
    """A fixed permutation of 64-bit numbers that spreads every bit."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(words, n: int):
    """Hash of each run of n words, from the hashes of the words."""
    import numpy as np

    size = max(0, len(words) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        out = (out ^ words[j : j + size]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def hashed(batches: Iterator, extra: bool = False) -> Iterator:
    """(doc, copy, runs, word hashes, bounds) of runs of rows of about SLICE words. Columns: doc, copy, text, and runs."""
    import numpy as np
    from xxhash import xxh3_64_intdigest as digest

    def joined():
        return np.array(docs, dtype=np.int64), np.array(copies, dtype=np.int64), runs, np.concatenate(hashes), np.cumsum([0, *map(len, hashes)])

    docs, copies, runs, hashes, size = [], [], [], [], 0
    for batch in batches:
        ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for row, text in enumerate(batch.column(2)):
            words = words_of(text.as_py())
            hashes.append(np.fromiter(map(digest, words), dtype=np.uint64, count=len(words)))
            docs.append(ids[row])
            copies.append(marks[row])
            if extra:
                runs.append(batch.column(3)[row])
            size += len(words)
            if size >= SLICE:
                yield joined()
                docs, copies, runs, hashes, size = [], [], [], [], 0
    if docs:
        yield joined()


def anchored(words, bounds):
    """Runs of windows with the same anchor: (anchor hash, row, first, last window), words counted over all rows."""
    import numpy as np

    size, counts = len(words) - WINDOW + 1, np.diff(bounds)
    none = np.zeros(0, dtype=np.int64)
    long = counts >= WINDOW
    if not long.any():
        return none.astype(np.uint64), none, none, none
    hashes = rolled(words, ANCHOR)
    # the lowest bits give way to the place in the window, so the least value names the leftmost of equal runs
    order = hashes & ~np.uint64(15)
    best = order[:size].copy()
    for j in range(1, WINDOW - ANCHOR + 1):
        np.minimum(best, order[j : j + size] | np.uint64(j), out=best)
    row = np.repeat(np.flatnonzero(long), counts[long] - WINDOW + 1)
    starts = np.arange(len(row)) - np.repeat(np.cumsum(counts[long] - WINDOW + 1) - (counts[long] - WINDOW + 1), counts[long] - WINDOW + 1) + bounds[row]
    least = starts + (best[starts] & np.uint64(15)).astype(np.int64)
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]
    return hashes[least[new]], row[new], first, last


def gathered(parts: Iterator, emit) -> Iterator:
    """Emits the columns of parts combined, whenever there are COMBINE rows."""
    import numpy as np

    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= COMBINE:
            yield emit(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield emit(*map(np.concatenate, zip(*held, strict=True)))


def paths(batches: Iterator) -> Iterator:
    """Rows (key, h, at, doc, copy, salt, branch, source): runs of windows with the anchor `key`, all their words hashed to h.

    `at` is the first window and the number of windows. What a task meets twice is settled at once: such runs point to the
    equal one before (spos, which is -1 in others). An anchor with different runs branches; of those one has salt 0, the
    others their own hash. So neither a frequent run nor a frequent anchor makes a large group.
    """
    import numpy as np
    import pyarrow as pa

    def emit(key, h, doc, copy, pos, n):
        order = np.lexsort((pos, copy, doc, h, key))
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        run = new | np.concatenate([[True], h[order][1:] != h[order][:-1]])
        group = np.cumsum(new) - 1
        branch = np.bincount(group, weights=run)[group] > 1
        salt = np.where(h[order] == h[order][np.flatnonzero(new)][group], np.uint64(0), h[order] | np.uint64(1))
        salt = np.where(~run, np.uint64(2) * np.arange(len(order), dtype=np.uint64) + np.uint64(2), salt)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        known, source = ~run[back], order[back - 1]
        columns = {"key": key.view(np.int64), "h": h.view(np.int64), "at": pos * PLACES + n, "doc": doc, "copy": copy, "salt": salt[back].view(np.int64), "branch": branch[back]}
        columns |= {c: np.where(known, x[source], none) for c, x, none in zip(SOURCE, (doc, copy, pos), (0, 0, -1), strict=True)}
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    def parts():
        for docs, copies, _, words, bounds in hashed(batches):
            key, row, first, last = anchored(words, bounds)
            n = last - first + 1
            yield key, spans_hashed(words, first, n + WINDOW - 1), docs[row], copies[row], first - bounds[row], n

    yield from gathered(parts(), emit)


def spans_hashed(words, first, n):
    """Hash of the n words from each first, n being at most the words of all windows with an anchor."""
    import numpy as np

    out = n.astype(np.uint64)
    for j in range(int(n.max(initial=0))):
        more = j < n
        out[more] = (out[more] ^ words[first[more] + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def edges(batches: Iterator) -> Iterator:
    """Rows of (key, pos, doc, copy, salt, source) of the single windows in runs, with known sources as in paths."""
    import numpy as np
    import pyarrow as pa

    def emit(key, doc, copy, pos):
        order = np.lexsort((pos, copy, doc, key))
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        known, source = ~new[back], order[back - 1]
        columns = {"key": key.view(np.int64), "pos": pos, "doc": doc, "copy": copy, "salt": np.where(known, back, 0)}
        columns |= {c: np.where(known, x[source], none) for c, x, none in zip(SOURCE, (doc, copy, pos), (0, 0, -1), strict=True)}
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    def parts():
        for docs, copies, runs, words, bounds in hashed(batches, extra=True):
            flat = [np.array([(x["pos"], x["n"]) for x in r.as_py()], dtype=np.int64).reshape(-1, 2) for r in runs]
            row = np.repeat(np.arange(len(flat)), list(map(len, flat)))
            first, n = np.concatenate(flat).T
            at = np.repeat(first + bounds[row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(row, n)
            yield rolled(words, WINDOW)[at], docs[row], copies[row], at - bounds[row]

    yield from gathered(parts(), emit)


QUOTE = "sdoc long, scopy long, block long, source string, doc long, copy long, path long, windows long, skip long, n long, text string"


def quotes(batches: Iterator) -> Iterator:
    """Words of each row: the blocks that others point to (source), and the pieces of its own paths (text) with where they point to."""
    import pyarrow as pa

    fields = [x.split() for x in QUOTE.split(", ")]
    for batch in batches:
        rows = []
        for doc, copy, text, own, blocks in zip(*(batch.column(i) for i in range(5)), strict=True):
            at, words = (doc.as_py(), copy.as_py()), words_of(text.as_py())
            for b in blocks.as_py():
                rows.append((*at, b, b" ".join(words[b * BLOCK : (b + 1) * BLOCK]).decode(), None, None, None, None, None, None, None))
            for p in own.as_py():
                piece = b" ".join(words[p["pos"] : p["pos"] + p["n"]]).decode()
                rows.append((p["sdoc"], p["scopy"], p["block"], None, *at, p["path"], p["windows"], p["skip"], p["n"], piece))
        columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if t == "string" else pa.int64()) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def compacted(repeats: DataFrame) -> DataFrame:
    """(doc, copy, pos, n, source): repeats joined to maximal paths, as long as neighbours point to neighbours.

    Both sides of the join of a run with the one before it are the same rows in the same order, so it is a lag.
    """
    order = Window.partitionBy(*AT).orderBy("pos", "n")
    before = lambda c: F.lag(c).over(order)
    goes_on = (before("pos") + before("n") == F.col("pos")) & (before("sdoc") == F.col("sdoc")) & (before("scopy") == F.col("scopy")) & (before("spos") + before("n") == F.col("spos"))
    rows = repeats.withColumn("head", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("pos")))
    rows = rows.withColumn("head", F.max("head").over(order))
    longest = [whole(F.max(c)).alias(c) for c in ("sdoc", "scopy")]
    return rows.groupBy(*AT, "head").agg(whole(F.max(F.col("pos") + F.col("n"))).alias("end"), *longest, whole(F.min("spos")).alias("spos")).select(*AT, whole(F.col("head")).alias("pos"), (F.col("end") - whole(F.col("head"))).alias("n"), *SOURCE)


def whole(x):
    """The column, known to have no nulls: so the joins add no filters of their own, and equal shuffles are shared."""
    return F.coalesce(x, F.lit(0))


def verified(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """The paths with ok: whether all words equal those at the source coordinates.

    A path is cut where its source passes from one block of BLOCK words to the next. As what equals something points to
    the one before it, and not all to the first, no block is asked for by many.
    """
    begin, end = F.col("spos"), F.col("spos") + F.col("n") + (WINDOW - 1)

    def piece(b):
        a = F.greatest(begin, b * BLOCK)
        fields = {"path": F.col("pos"), "windows": F.col("n"), "pos": F.col("pos") + a - begin, "n": F.least(end, (b + 1) * BLOCK) - a, "sdoc": F.col("sdoc"), "scopy": F.col("scopy"), "block": b, "skip": a - b * BLOCK}
        return F.struct(*[c.cast("long").alias(k) for k, c in fields.items()])

    blocks = F.sequence(F.floor(begin / BLOCK), F.floor((end - 1) / BLOCK))
    own = F.struct(*AT, F.transform(blocks, piece).alias("own"), F.lit(None).cast("array<long>").alias("blocks"))
    theirs = F.struct(F.col("sdoc").alias("doc"), F.col("scopy").alias("copy"), F.lit(None).alias("own"), blocks.alias("blocks"))
    wanted = repeats.select(F.explode(F.array(own, theirs)).alias("x")).select(*[whole(F.col(f"x.{c}")).alias(c) for c in AT], "x.own", "x.blocks")
    wanted = wanted.groupBy(*AT).agg(F.flatten(F.collect_list("own")).alias("own"), F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
    texts = docs.join(wanted, AT).select(*AT, "text", "own", "blocks").mapInArrow(quotes, QUOTE)
    source = F.first("source").over(Window.partitionBy("sdoc", "scopy", "block").orderBy(F.col("source").isNull()))
    same = F.array_join(F.slice(F.split(source, " "), (F.col("skip") + 1).cast("int"), F.col("n").cast("int")), " ") == F.col("text")
    judged = texts.withColumn("same", F.coalesce(same, F.lit(False))).filter("text IS NOT NULL").groupBy(*AT, "path", "windows").agg(F.min("same").alias("ok"))
    return judged.select(*AT, F.col("path").alias("pos"), F.col("windows").alias("n"), "ok")


def required(columns: str) -> str:
    return columns.replace(",", " not null,") + " not null"


def candidates(docs: DataFrame, bits: int) -> DataFrame:
    """Runs of windows by anchor, each with the coordinates of the equal run before it, and whether its anchor branches."""
    rows = docs.select(*AT, "text").mapInArrow(paths, required("key long, h long, at long, doc long, copy long, salt long, branch boolean, sdoc long, scopy long, spos long"))
    rows = rows.withColumn("h", F.shiftrightunsigned("h", 64 - bits))
    order = Window.partitionBy("key", "salt", "h").orderBy(*AT, "at")
    known, lag = F.col("spos") >= 0, lambda c: F.coalesce(F.lag(c).over(order), F.col(c))
    rows = rows.select("key", "h", *AT, "at", "salt", "branch", *SOURCE, *[lag(c).alias(f"before_{c}") for c in (*AT, "at")])
    before = [F.col("before_doc"), F.col("before_copy"), F.shiftright("before_at", 4)]
    before = [whole(F.when(known, F.col(s)).otherwise(c)).alias(s) for s, c in zip(SOURCE, before, strict=True)]
    rows = rows.select("key", "h", *AT, F.shiftright("at", 4).alias("pos"), (F.col("at") % PLACES).alias("n"), "salt", "branch", *before)
    # sorted for the window before, the rows need no other sort for this one
    group = Window.partitionBy("key", "salt")
    return rows.withColumn("open", F.max("branch").over(group) | (F.min("h").over(group) != F.max("h").over(group))).drop("h", "salt", "branch")


def itself():
    """True for what points to itself: a first occurrence."""
    return (F.col("doc") == F.col("sdoc")) & (F.col("copy") == F.col("scopy")) & (F.col("pos") == F.col("spos"))


def judged_paths(docs: DataFrame, bits: int) -> DataFrame:
    """(doc, copy, pos, n, ok): the repeated paths. bits: how many of a hash's count, fewer in tests of collisions."""
    runs = cut(candidates(docs, bits).filter(~itself() | F.col("open")).drop("key"))
    runs = runs.select(*[whole(F.col(c)).alias(c) for c in (*AT, "pos", "n", *SOURCE)], "open")
    single = runs.filter(itself()).groupBy(*AT).agg(F.collect_set(F.struct("pos", "n")).alias("p"))
    found = docs.join(single, AT).select(*AT, "text", "p").mapInArrow(edges, required("key long, pos long, doc long, copy long, salt long, sdoc long, scopy long, spos long"))
    order = Window.partitionBy(F.shiftrightunsigned("key", 64 - bits), "salt").orderBy(*AT, "pos")
    before = [whole(F.when(F.col("spos") >= 0, F.col(s)).otherwise(F.coalesce(F.lag(c).over(order), c))).alias(s) for s, c in zip(SOURCE, (*AT, "pos"), strict=True)]
    windows = found.select(*AT, "pos", F.lit(1).cast("long").alias("n"), *before)
    repeats = runs.select(*AT, "pos", "n", *SOURCE).unionByName(windows).filter(~itself())
    return verified(docs, compacted(repeats))


def regrouped(docs: DataFrame, judged: DataFrame, bits: int) -> DataFrame:
    """(doc, copy, pos, n) to remove where hashes collide: paths that are sound, and of the anchors in the others every
    window, grouped anew by its words."""

    def texts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc, copy, text, wanted in zip(*(batch.column(i) for i in range(4)), strict=True):
                words = words_of(text.as_py())
                places = {p for x in wanted.as_py() for p in range(x["pos"], x["pos"] + x["n"])}
                out += [(doc.as_py(), copy.as_py(), p, b" ".join(words[p : p + WINDOW]).decode()) for p in sorted(places)]
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc", "copy", "pos", "words"])

    runs = Kept(candidates(docs, bits).select("key", *AT, "pos", "n")).df
    wrong = judged.filter("NOT ok").select(*AT, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("at"))
    places = runs.select("key", *AT, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("at"))
    keys = places.join(wrong, [*AT, "at"], "left_semi").select("key").distinct()
    again = runs.join(keys, "key", "left_semi").groupBy(*AT).agg(F.collect_set(F.struct("pos", "n")).alias("p"))
    rows = docs.join(again, AT).select(*AT, "text", "p").mapInArrow(texts, "doc long, copy long, pos long, words string").distinct()
    first = rows.groupBy("words").agg(F.min(F.struct(*AT, "pos")).alias("f"))
    later = rows.join(first, "words").filter(F.struct(*AT, "pos") != F.col("f"))
    return later.select(*AT, "pos", F.lit(1).cast("long").alias("n")).unionByName(judged.filter("ok").select(*AT, "pos", "n"))


def remove_repeats(docs: DataFrame, with_text: bool = False, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row, with the kept words as text if asked for.

    A word goes if a 20-word window over it stands earlier too: in a smaller doc_id, or earlier in the same document.
    Null and empty texts have no words. A null doc_id counts as the smallest. Rows that share doc_id and text are one
    document: they don't repeat each other, and each is answered. Of rows that share a doc_id only, the one with the
    smaller hash of the text is the earlier. Other columns are not read; an empty table gives an empty result.
    """
    ids = docs.groupBy("doc_id").count().filter("count > 1")
    copy = F.lit(0).cast("long") if ids.isEmpty() else F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), copy.alias("copy"), "text")
    judged = judged_paths(rows, bits)
    result = Kept(without(rows, judged.groupBy(*AT).agg(F.collect_list(F.struct("pos", "n", "ok")).alias("p")), with_text)).df
    if not result.filter("NOT sure").isEmpty():
        gone = regrouped(rows, Kept(judged).df, bits).withColumn("ok", F.lit(True))
        result = without(rows, gone.groupBy(*AT).agg(F.collect_list(F.struct("pos", "n", "ok")).alias("p")), with_text)
    return result.drop("sure")


def without(rows: DataFrame, gone: DataFrame, with_text: bool) -> DataFrame:
    """The rows without the words of the windows that are gone, and whether all of those are verified (sure)."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, sure boolean" + ", text string" * with_text

    def kept(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n_words, n_removed, digests, sure, texts = [], [], [], [], []
            for text, wanted in zip(batch.column(1), batch.column(2), strict=True):
                words, marks = words_of(text.as_py()), wanted.as_py() or ()
                n_words.append(len(words))
                sure.append(all(x["ok"] for x in marks))
                if marks:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    first, n = np.array([(x["pos"], x["n"]) for x in marks]).T
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + n + (WINDOW - 1), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                n_removed.append(n_words[-1] - len(words))
                line = b" ".join(words)
                digests.append(hashlib.sha256(line).hexdigest())
                if with_text:
                    texts.append(line.decode())
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(sure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(texts, pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256", "sure"] + ["text"] * with_text)

    rows = rows.join(gone, AT, "left").select("doc", "text", "p").mapInArrow(kept, schema)
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM k),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM r WHERE n > 1),
l AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
      CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, generate_series(1, len(w))), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM f
"""
