"""How far the sources of a language differ in their terms: dense group-by-term tiles, pair matrices summed over term blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Terms that fewer documents of a language hold are left out; the unit of a proportion; ranks of part `term`.
LEAST, UNIT, K = 10, 1_000_000_000, 10
#: Terms to a block and sources to a strip, about; cells of a pair tile that are worked out at once.
TERMS, SOURCES, ROOM = 4096, 128, 1 << 21
#: Distinct (group, term) counts that a task holds before it sends them on.
HELD = 400_000
#: Terms of lower-cased UTF-8: letters, and all beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed in a task before they are shuffled.

    Every occurring group has a row of a null term, so that none without terms is lost.
    """

    def count(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        groups: dict = {}
        size = 0

        def sent():
            for (lang, source), (n, d) in groups.items():
                terms = pa.array([None, *n], pa.binary()).cast(pa.string())
                same = lambda x, k: pa.array([x], pa.string()).take(pa.array([0] * k, pa.int8()))
                yield pa.RecordBatch.from_arrays([same(lang, len(terms)), same(source, len(terms)), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(d.__getitem__, n)], pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            lists = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()]
            for lang, source, text in zip(*lists, strict=True):
                n, d = groups.setdefault((lang, source), (Counter(), Counter()))
                words = TERM.findall((text or b"").lower())
                size -= len(n)
                n.update(words)
                d.update(set(words))
                size += len(n)
                if size > held:
                    yield from sent()
                    groups, size = {}, 0
        yield from sent()

    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = texts.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def proportions(counts, totals, kinds):
    """1 + floor(UNIT (count + 2) / (N + 2 V)) as 64-bit integers, three digits at a time so that nothing overflows."""
    below = totals + 2 * kinds
    left, out = counts + 2, 0
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // below
        left = left % below
    return out + 1


def spread(p, q):
    """floor((p - q)^2 / (p + q)); both are UNIT + 1 at most, so the square fits."""
    gap = p - q
    return gap * gap // (p + q)


def pair_sums(left, right):
    """Sums of `spread` over the terms for every pair of a row of each: all pairs of a stretch of terms at once."""
    import numpy as np

    out = np.zeros((len(left), len(right)), dtype=np.int64)
    rows = max(1, ROOM // max(1, len(right) * min(left.shape[1], 512)))
    for a in range(0, len(left), rows):
        for t in range(0, left.shape[1], 512):
            out[a : a + rows] += spread(left[a : a + rows, None, t : t + 512], right[None, :, t : t + 512]).sum(axis=2)
    return out


def tile(rows):
    """One tile: partial pair sums of two strips of sources over a block of terms, and each source's best terms in it.

    Rows of a null term are the sources with their total, and with the terms of the block as n; the others are counts.
    Terms of the block that neither strip has count 0 in both, which all have the same spread. A tile of a strip with
    itself finds the best terms; each pair of sources is met in one tile, and told in both orders.
    """
    import numpy as np
    import pyarrow as pa

    get = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("kinds", "lang_total", "strip", "total", "n", "lang_n")}
    lang, a, b = rows.column("lang")[0], rows.column("a")[0].as_py(), rows.column("b")[0].as_py()
    terms, sources = rows.column("term").combine_chunks(), rows.column("source").combine_chunks()
    head = terms.is_null().to_numpy(zero_copy_only=False)
    names = sources.filter(pa.array(head)).to_pylist()
    at = {s: i for i, s in enumerate(names)}
    coded = terms.filter(pa.array(~head)).dictionary_encode()
    column, kinds = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    row = np.array([at[s] for s in sources.filter(pa.array(~head)).to_pylist()], dtype=np.int64)
    v, total = get["kinds"][0], get["total"][head]
    counts = np.zeros((len(names), len(kinds)), dtype=np.int64)
    counts[row, column] = get["n"][~head]
    whole = np.zeros(len(kinds), dtype=np.int64)
    whole[column] = get["lang_n"][~head]
    p = proportions(counts, total[:, None], v) if len(kinds) else counts
    strips = get["strip"][head]
    left, right = np.flatnonzero(strips == a), np.flatnonzero(strips == b)
    none = proportions(np.zeros(len(names), dtype=np.int64), total, v) if v else total
    sums = pair_sums(p[left], p[right])
    if v:
        sums += spread(none[left][:, None], none[right][None, :]) * (get["n"][head][0] - len(kinds))
    i, j = np.nonzero(np.ones_like(sums, dtype=bool)) if a != b else np.nonzero(~np.eye(len(left), dtype=bool))
    source, item, value = left[i], right[j], sums[i, j]
    if a != b:
        source, item, value = np.concatenate([source, item]), np.concatenate([item, source]), np.concatenate([value, value])
    labels = pa.array(names, pa.string())
    parts, out = pa.array(["pair", "term"]), []

    def found(part, source, item, value):
        same = pa.array([lang.as_py()], pa.string()).take(pa.array(np.zeros(len(value), dtype=np.int8)))
        out.append(pa.Table.from_arrays([same, labels.take(pa.array(source)), parts.take(pa.array(np.full(len(value), part, dtype=np.int8))), item, pa.array(value)], names=["lang", "source", "part", "item", "value"]))

    found(0, source, labels.take(pa.array(item)), value)
    if a == b and len(kinds):
        q = proportions(whole, get["lang_total"][0], v)
        place = np.empty(len(kinds), dtype=np.int64)
        place[sorted(range(len(kinds)), key=lambda k: kinds[k].encode())] = np.arange(len(kinds))
        for s in range(len(names)):
            mine = np.flatnonzero((counts[s] > 0) & (p[s] > q))
            values = spread(p[s, mine], q[mine])
            best = np.lexsort((place[mine], -values))[:K]
            found(1, np.full(len(best), s), coded.dictionary.take(pa.array(mine[best])).cast(pa.string()), values[best])
    return pa.concat_tables(out)


def strips_of(source: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(source, F.lit(3)), F.lit(n)).cast("int")


def divergence(docs: DataFrame, least: int = LEAST, terms: int = TERMS, strip: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank) for every source of every language.

    Null text, lang and source are empty strings; every row is a document. Counts of all documents are summed by
    (lang, source, term), which is as far as anything is grouped by a language's own size: the terms of a language are
    dealt to blocks of about `terms`, its sources to strips of about `strip`, and a tile holds a block of two strips. A
    language without kept terms has one tile, whose sums are zero; a group without terms has counts of zero throughout.
    Other columns are not read; an empty table gives an empty result. Proportions are exact up to 9 x 10^15 occurrences.
    """
    counted = cut(term_counts(docs))
    words = counted.filter(F.col("term").isNotNull())
    by_term = Window.partitionBy("lang", "term")
    kept = words.select("*", F.sum("n").over(by_term).alias("lang_n"), F.sum("docs").over(by_term).alias("held")).filter(F.col("held") >= least)
    kept = cut(kept.select("lang", "source", "term", "n", "lang_n"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    once = cut(kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")))
    langs = once.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("lang_n").alias("lang_total"))
    groups = counted.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kinds", "lang_total"])
    groups = cut(groups.select("lang", "source", "total", "kinds", "lang_total"))
    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s"), F.max("kinds").alias("v")).agg(F.max("s").alias("s"), F.max("v").alias("v")).first()
    n_strips, n_blocks = max(1, -(-(most["s"] or 1) // strip)), max(1, -(-(most["v"] or 1) // terms))
    blocks = F.greatest(F.lit(1), F.least(F.lit(n_blocks), F.ceil(F.col("kinds") / terms))).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(n_strips - 1)), lambda x: F.struct(F.least(x, F.col("strip")).alias("a"), F.greatest(x, F.col("strip")).alias("b")))
    block = F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block")
    sizes = groups.select("lang", "kinds").distinct()
    held = once.join(sizes, "lang").groupBy("lang", block).agg(F.count(F.lit(1)).alias("n"))
    heads = groups.select("*", strips_of(F.col("source"), n_strips).alias("strip"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")).join(held, ["lang", "block"], "left").fillna(0, ["n"])
    heads = heads.select("lang", "source", F.lit(None).cast("string").alias("term"), "kinds", "lang_total", "strip", "block", "total", "n", F.lit(0).cast("long").alias("lang_n"))
    cells = kept.join(sizes, "lang").select("lang", "source", "term", "kinds", F.lit(0).cast("long").alias("lang_total"), strips_of(F.col("source"), n_strips).alias("strip"), block, F.lit(0).cast("long").alias("total"), "n", "lang_n")
    tiles = heads.unionByName(cells).withColumn("ab", F.explode(pairs)).select("*", "ab.a", "ab.b").drop("ab")

    def work(rows):
        import pyarrow.compute as pc

        # the head rows come first, so that the first of them tells the language's totals
        return tile(rows.take(pc.sort_indices(rows, sort_keys=[("term", "ascending"), ("source", "ascending")], null_placement="at_start")))

    partial = tiles.groupBy("lang", "block", "a", "b").applyInArrow(work, "lang string, source string, part string, item string, value long")
    merged = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = merged.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= K))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
k AS (SELECT lang, t AS term FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(s.n), 0) AS total FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source) GROUP BY lang, source),
q AS (SELECT lang, term, 1 + 1000000000 * (CAST(sum(c.n) AS HUGEINT) + 2) // (any_value(t.n) + 2 * any_value(v.v)) AS q FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS n FROM c GROUP BY lang) t USING (lang) GROUP BY lang, term),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 2) // (g.total + 2 * v.v) AS p
      FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
