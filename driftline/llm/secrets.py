"""Secrets: patterns, and a battery of randomness tests over the other long tokens with a corpus-wide error control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbers, table
from .spans import BLOCK, between, found, gaps, joined, pieces, placed

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
    "random": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
}
BASE = ("assign", "access", "hex")
#: The encodings a token may be in, the narrowest first, and their alphabets in the order of their values.
ENCODINGS = (
    ("0123456789abcdef", "^[0-9a-f]+$"),
    ("0123456789ABCDEF", "^[0-9A-F]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "^[A-Z2-7]+$"),
    ("0123456789abcdefghijklmnopqrstuvwxyz", "^[0-9a-z]+$"),
    ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "^[0-9A-Za-z]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "^[0-9A-Za-z+/]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "^[0-9A-Za-z_-]+$"),
    ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_", "."),
)
#: Chance that two letters of a natural text are the same; how far, as a share of a random token's spread and the root of the
#: length, runs and correlations of natural text stray; the false discovery rate; the least fit to randomness.
TEXT_COLLISION, TEXT_ORDER, FDR, FIT = 0.066, 0.15, 0.01, 0.001
#: Tokens are put in classes of doubling length (from 20 up to what a text can hold), p-values in bins of half a power of two.
SHORTEST, CLASSES, BINS = 20, 28, 120


def normal_cdf(z: Column) -> Column:
    """The normal distribution function: a logistic approximation in the middle, the asymptotic series in the tails."""
    z = F.greatest(F.lit(-37.0), F.least(F.lit(37.0), z))
    middle = 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))
    tail = F.exp(-z * z / 2) / (2.5066282746 * F.abs(z)) * (1 - 1 / (z * z) + 3 / F.pow(z, F.lit(4.0)))
    return F.when(z < -3, tail).when(z > 3, 1 - tail).otherwise(middle)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, y: a + y)


def battery(token: Column) -> Column:
    """struct(fit, class, bin): how well a token fits randomness, and how seldom natural text looks as random.

    Chi-squared over the inferred alphabet (does it use all symbols alike?), runs above and below the middle of the
    alphabet, and the correlation of neighbours each give a normal score. fit is the tail of the summed squares. As to
    natural text, each test gives the chance that text of this length comes as near to randomness, and Fisher's method
    makes one p-value of the three; its bin is that of the false-discovery control. Every step is one pass over the
    token, whatever its length: symbols are counted by removing them, moments come from the counts.
    """
    alphabet = F.lit(ENCODINGS[-1][0])
    for letters, shape in reversed(ENCODINGS[:-1]):
        alphabet = F.when(token.rlike(shape), F.lit(letters)).otherwise(alphabet)

    def counted(x: Column) -> Column:
        m, a = x["m"], x["a"]
        n = F.length(m)
        symbols = F.filter(F.split(a, ""), lambda c: c != "")
        counts = F.transform(symbols, lambda c, i: F.struct(i.cast("double").alias("v"), (n - F.length(F.replace(m, c, F.lit("")))).cast("double").alias("c")))
        values = F.transform(F.filter(F.split(m, ""), lambda c: c != ""), lambda c: (F.position(c, a) - 1).cast("double"))
        return F.struct(n.cast("double").alias("n"), F.length(a).cast("double").alias("k"), counts.alias("c"), values.alias("v"))

    def paired(x: Column) -> Column:
        k, v, last = x["k"], x["v"], F.size(x["v"]) - 1
        left, right = F.slice(v, F.lit(1), last), F.slice(v, F.lit(2), last)
        sum_ = total(F.transform(x["c"], lambda y: y["v"] * y["c"]))
        return F.struct(
            x["n"].alias("n"),
            k.alias("k"),
            total(F.transform(x["c"], lambda y: y["c"] * y["c"])).alias("squares"),
            total(F.transform(x["c"], lambda y: F.when(y["v"] >= k / 2, y["c"]).otherwise(0.0))).alias("h"),
            (sum_ / x["n"]).alias("mean"),
            total(F.transform(x["c"], lambda y: y["v"] * y["v"] * y["c"])).alias("second"),
            total(F.zip_with(left, right, lambda a, b: a * b)).alias("product"),
            (2 * sum_ - v[0] - F.element_at(v, -1)).alias("inner"),
            (1 + total(F.zip_with(left, right, lambda a, b: F.when((a >= k / 2) != (b >= k / 2), 1.0).otherwise(0.0)))).alias("r"),
        )

    def scored(x: Column) -> Column:
        n, k, mean = x["n"], x["k"], x["mean"]
        low = n - x["h"]
        both = x["h"] * low
        chi = x["squares"] * k / n - n
        spread = x["second"] - n * mean * mean
        together = x["product"] - mean * x["inner"] + (n - 1) * mean * mean
        expected = 2 * both / n + 1
        variance = F.greatest(F.lit(1e-9), 2 * both * (2 * both - n) / (n * n * (n - 1)))
        z_runs = F.when(both > 0, (x["r"] - expected) / F.sqrt(variance)).otherwise(F.lit(9.0))
        z_next = (F.when(spread > 1e-9, together / spread).otherwise(1.0) + 1 / n) * F.sqrt(n)
        return F.struct(n.alias("n"), k.alias("k"), chi.alias("chi"), z_runs.alias("r"), z_next.alias("s"))

    def judged(x: Column) -> Column:
        n, k = x["n"], x["k"]
        z_chi = F.greatest(F.lit(0.0), (x["chi"] - (k - 1)) / F.sqrt(2 * (k - 1)))
        summed = z_chi * z_chi + x["r"] * x["r"] + x["s"] * x["s"]
        # the Wilson-Hilferty cube root makes a chi-squared of three degrees nearly normal
        fit = 1 - normal_cdf((F.cbrt(summed / 3) - (1 - 2 / 27)) / F.sqrt(F.lit(2 / 27)))
        shift = (n - 1) * F.greatest(F.lit(0.25), k * TEXT_COLLISION - 1)
        uniform = normal_cdf((x["chi"] - (k - 1) - shift) / F.sqrt(2 * (k - 1) + 4 * shift))
        stray = 1 + TEXT_ORDER * F.sqrt(n)
        near = [2 * normal_cdf(F.abs(z) / stray) - 1 for z in (x["r"], x["s"])]
        return F.struct(fit.alias("fit"), n.alias("n"), (-total(F.transform(F.array(uniform, *near), lambda p: F.log(F.greatest(p, F.lit(1e-300)))))).alias("f"))

    def binned(x: Column) -> Column:
        # Fisher: twice f is chi-squared of six degrees
        text = F.exp(-x["f"]) * (1 + x["f"] + x["f"] * x["f"] / 2)
        length_class = F.least(F.lit(CLASSES - 1), F.floor(F.log2(x["n"] / SHORTEST))).cast("int")
        bin_ = F.least(F.lit(BINS - 1), F.floor(-2 * F.log2(F.greatest(text, F.lit(1e-300))))).cast("int")
        return F.struct(x["fit"].alias("fit"), length_class.alias("c"), F.greatest(bin_, F.lit(0)).alias("b"))

    out = F.array(F.struct(token.alias("m"), alphabet.alias("a")))
    for step in (counted, paired, scored, judged, binned):
        out = F.transform(out, step)
    return out[0]


def clear_of(spans: Column, base: list[Column]) -> Column:
    """The spans that no base span overlaps; spans are in order and don't overlap each other.

    A span is free if as many base spans begin before its end as end by its start. Both counts are places in sorted
    lists, where the i-th span has i others before it, so that many spans of both kinds take no time pair by pair.
    """

    def places(own: Column, theirs: list[Column], mine: int) -> Column:
        """The places of the spans' own positions, which sort before equal ones of the others if mine is 0."""
        both = F.concat(F.transform(spans, lambda x: own(x) * 2 + mine), *theirs)
        return F.filter(F.transform(F.sort_array(both), lambda x, i: F.when(x % 2 == mine, i).otherwise(-1)), lambda i: i >= 0)

    starts = places(lambda x: x["e"], [F.transform(b, lambda y: y["s"] * 2 + 1) for b in base], 0)
    ends = places(lambda x: x["s"], [F.transform(b, lambda y: y["e"] * 2) for b in base], 1)
    free = F.zip_with(starts, ends, lambda a, b: a == b)
    kept = F.filter(F.zip_with(spans, free, lambda x, f: F.struct(x.alias("x"), f.alias("f"))), lambda z: z["f"])
    return F.when(F.size(spans) > 0, F.transform(kept, lambda z: z["x"])).otherwise(spans)


def candidates(docs: DataFrame, carry: list[str]) -> DataFrame:
    """(doc_id, base spans, clear spans and tests of the other long tokens, carried columns by number, _t if they hold text)."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t"), *numbers(carry))
    rows = rows.select("*", *[found(F.col("_t"), p).alias(f"_m_{k}") for k, p in PATTERNS.items()])
    rows = rows.select("*", *[gaps(F.col("_t"), p, F.col(f"_m_{k}")).alias(f"_g_{k}") for k, p in PATTERNS.items()])
    spans = {k: placed(F.col(f"_m_{k}"), F.col(f"_g_{k}")) for k in PATTERNS}
    spans["assign"] = F.filter(spans["assign"], lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 8)
    kept = [c for c in rows.columns if c[:3] not in ("_m_", "_g_")]
    rows = rows.select(*kept, *[s.alias(f"_s_{k}") for k, s in spans.items()])
    rows = rows.withColumn("_clear", clear_of(F.col("_s_random"), [F.col(f"_s_{k}") for k in BASE]))
    tests = F.transform("_clear", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), battery(x["m"]).alias("t")))
    rows = rows.withColumn("_tests", F.when(F.size("_clear") > 0, tests))
    ends = [F.transform(f"_s_{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(f"_s_{k}") for k in BASE]
    return rows.select("doc_id", "_tests", *ends, *[f"_c_{i}" for i in range(len(carry))])


def thresholds(rows: DataFrame) -> dict[int, int]:
    """Benjamini and Hochberg's step over all tokens of the corpus, by length class: the least bin that passes.

    Only counts per class and bin leave the executors, CLASSES x BINS at most.
    """
    counts = rows.select(F.explode("_tests").alias("x")).groupBy(F.col("x.t.c").alias("c"), F.col("x.t.b").alias("b")).count().collect()
    least = {}
    for c in range(CLASSES):
        bins = {r["b"]: r["count"] for r in counts if r["c"] == c}
        total_, passed = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            passed += bins[b]
            if 2.0 ** (-b / 2) <= FDR * passed / total_:
                least[c] = b
    return least


def find_secrets(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """(doc_id, spans): (s, e, k) by start, then kind, the base kinds and "random"; then the columns to carry, by number.

    A token is random if natural text of its length would look as random too seldom (thresholds) and the battery
    doesn't reject randomness (FIT). Texts are read once: spans and test results are written to the shared folder, then
    counted, then judged. Null and empty texts have none; texts and tokens of any length take time in proportion to it;
    repeated rows are answered each; an empty table gives an empty result. Other columns are not read.
    """
    rows = cut(candidates(docs, list(carry)))
    least = thresholds(rows)
    levels = F.array(*[F.lit(least.get(c, BINS)) for c in range(CLASSES)])
    random = F.filter("_tests", lambda x: (x["t"]["fit"] >= FIT) & (x["t"]["b"] >= F.element_at(levels, x["t"]["c"] + 1)))
    parts = [F.transform(f"_s_{k}", of(i)) for i, k in enumerate(BASE)]
    parts.append(F.transform(F.coalesce(random, F.array().cast("array<struct<s:bigint,e:bigint,t:struct<fit:double,c:int,b:int>>>")), of(len(BASE))))
    names = F.array(*[F.lit(k) for k in PATTERNS])
    ordered = F.transform(F.array_sort(F.concat(*parts)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(names, x["o"] + 1).alias("k")))
    return rows.select("doc_id", ordered.alias("spans"), *[f"_c_{i}" for i in range(len(carry))])


def of(order: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"))


def of_kind(kind: str):
    return lambda x: x["k"] == kind


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["k"].isin(*BASE))
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in (*BASE, "random")]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


MASK = "[SECRET]"


def redact(text: Column, spans: Column) -> Column:
    """The text with every run of overlapping spans replaced by MASK.

    A span goes if it begins where an earlier one has ended by then; the text between those that stay is what remains.
    Both are gathered in blocks, as a fold copies what it has gathered.
    """
    spot = "array<struct<p:bigint,s:bigint>>"

    def step(acc: Column, x: Column) -> Column:
        kept = F.when(x["s"] >= acc["p"], F.array(F.struct(acc["p"].alias("p"), x["s"].alias("s")))).otherwise(F.array().cast(spot))
        return F.struct(F.greatest(acc["p"], x["e"]).alias("p"), F.concat(acc["out"], kept).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(b, F.struct(acc["p"].alias("p"), F.array().cast(spot).alias("out")), step)
        return F.transform(F.array(inner), lambda r: F.struct(r["p"].alias("p"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]

    starts = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int"))
    blocks = F.transform(F.array(spans), lambda all_: F.transform(starts, lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))))[0]
    start = F.struct(F.lit(0).cast("long").alias("p"), F.array().cast(f"array<{spot}>").alias("out"))
    gaps_ = F.aggregate(blocks, start, block, lambda acc: F.struct(F.flatten(acc["out"]).alias("out"), acc["p"].alias("p")))

    def masked(cut: Column, g: Column) -> Column:
        parts = F.transform(g["out"], lambda x: F.concat(between(cut, x["p"], x["s"]), F.lit(MASK)))
        return F.concat(F.array_join(parts, ""), between(cut, g["p"], F.length(text).cast("long")))

    return F.transform(F.arrays_zip(F.array(pieces(text)).alias("c"), F.array(gaps_).alias("g")), lambda z: masked(z["c"], z["g"]))[0]


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays; its secrets are masked in the text, and n_chars, if there, follows.

    Null and empty texts stay as they are, as do repeated rows and rows without an id; further columns of any name come
    back unchanged; an empty table gives an empty one.
    """
    rows = find_secrets(docs, docs.columns)
    at = {c: F.col(f"_c_{i}") for i, c in enumerate(docs.columns)}
    masked = F.size("spans") > 0
    out = at | {"text": F.when(masked, redact(at["text"], F.col("spans"))).otherwise(at["text"])}
    if "n_chars" in at:
        out["n_chars"] = F.when(masked, F.length(out["text"])).otherwise(at["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[c.alias(n) for n, c in out.items()])
