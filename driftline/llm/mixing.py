"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK_CHARS, BLANKS, numbered, numbers, table, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
#: Documents of a source that are dealt to one sampling bucket, on average.
BUCKET_DOCS = 2048
#: Parts a source is dealt to when its documents meet its target.
SALTS = 64


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """Water-filling over one row per source (source, source_size, docs): adds the target and the sampling buckets.

    All sources fill to one level in proportion to their weights; those that would exceed their cap (epochs x size) are
    clamped, and what they leave is reshared among the rest, until no more are clamped. A round is one aggregation over
    the sources, which may be many: two numbers of it come to the driver.
    """
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(epochs)))
    budget = (ranked.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, open_ = 0.0, -1
    while True:
        clamped = F.col("_cap") < F.lit(level) * F.col("_w")
        left, rest, n = ranked.agg(F.sum(F.when(clamped, F.col("_cap")).otherwise(0.0)), F.sum(F.when(clamped, 0.0).otherwise(F.col("_w"))), F.count_if(~clamped)).first()
        if n == open_ or not n:
            break
        level, open_ = (budget - left) / rest, n
    target = F.least(F.col("_cap"), F.lit(level) * F.col("_w"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"), F.ceil(F.col("docs") / F.lit(BUCKET_DOCS)).cast("long").alias("_buckets"))


def draw(doc_id: Column, text: Column, seed: int, salt: str) -> Column:
    """32 seeded random bits of a document; its text tells those without an id apart."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}{seed}:"), name)), 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, seed: int = 17, carry: tuple = (), **params) -> DataFrame:
    """How often the mix takes each document: (doc_id, size, source_size, target, taken), and the columns to carry, by number.

    A source with target t and size s takes every document floor(t / s) times whole. The rest of its target is drawn
    in seeded order, within buckets of about BUCKET_DOCS documents that each take their share, the last document of a
    bucket in part: so a hot source is dealt over many tasks and the sum is within a word a bucket of the target.
    Null sources are a source of their own, the last. Null texts have size 0 and are never taken. Repeated rows count
    each. An empty table gives an empty result.
    """
    text = F.col("text")
    draws = [draw(F.col("doc_id"), text, seed, k).alias(n) for k, n in (("b", "_draw"), ("o", "_order"), ("s", "_salt"))]
    rows = docs.select("doc_id", "source", *numbers(list(carry)), word_count(text).alias("size"), *draws)
    sizes = docs.select("source", word_count(text).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    rows = _with_targets(rows, targets(sizes, **params))
    rows = rows.withColumn("_bucket", F.col("_draw") % F.col("_buckets"))
    bucket = Window.partitionBy("_key", "_bucket")
    ordered = bucket.orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_whole", F.floor(rate)).withColumn("_want", F.round((rate - F.floor(rate)) * F.sum("size").over(bucket)).cast("long"))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_want") - F.coalesce(F.sum("size").over(ordered), F.lit(0))))
    taken = (F.col("_whole") * F.col("size") + extra).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *[f"_c_{i}" for i in range(len(carry))])


def _with_targets(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Joins each document with its source's row, which is repeated for every salt so that a hot source is spread."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    rows = rows.withColumn("_key", key).withColumn("_salt", F.col("_salt") % SALTS).drop("source")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return rows.join(by_source.withColumn("_key", key).withColumn("_salt", salts).drop("source"), ["_key", "_salt"]).drop("_salt")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: whole repetitions as repeated rows, a part of one as the first words of the text; what isn't taken goes.

    Null and wordless texts are never taken. Rows without an id, repeated rows and null sources are mixed like others;
    n_chars, if there, follows the text, further columns of any name come back unchanged; an empty table gives an empty one.
    """
    rows = mix(docs, carry=tuple(docs.columns))
    at = {c: F.col(f"_c_{i}") for i, c in enumerate(docs.columns)}
    whole, part = F.expr("taken div greatest(size, 1)"), F.expr("taken % greatest(size, 1)")
    pieces = F.filter(F.concat(F.array_repeat(F.col("size"), whole.cast("int")), F.array(part)), lambda n: n > 0)
    rows = rows.filter("taken > 0").withColumn("_piece", F.explode(pieces))
    words = F.split(F.btrim(at["text"], F.lit(BLANK_CHARS)), f"[{BLANKS}]+", -1)
    text = F.when(F.col("_piece") == F.col("size"), at["text"]).otherwise(F.array_join(F.slice(words, 1, F.col("_piece").cast("int")), " "))
    rows = rows.withColumn("_text", text)
    out = at | {"text": F.col("_text")}
    if "n_chars" in at:
        out["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[c.alias(n) for n, c in out.items()])


SQL = r"""
WITH d AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM d GROUP BY source),
r AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT *, max(CASE WHEN level <= cap / w THEN level END) OVER () AS water FROM l),
g AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * w) END AS target, CAST(ceil(docs / 2048.0) AS BIGINT) AS buckets FROM t),
b AS (SELECT d.*, g.source_size, g.target, CAST('0x' || substr(md5('b17:' || coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, '')))), 1, 8) AS BIGINT) % buckets AS bucket,
      CAST('0x' || substr(md5('o17:' || coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, '')))), 1, 8) AS BIGINT) AS ord,
      CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, CAST(round((rate - floor(rate)) * sum(size) OVER (PARTITION BY source, bucket)) AS BIGINT) AS want,
      coalesce(sum(size) OVER (PARTITION BY source, bucket ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT doc_id, size, source_size, target, CAST(floor(rate) * size + greatest(0, least(size, want - before)) AS BIGINT) AS taken FROM q
"""
