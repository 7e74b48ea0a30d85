"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .spans import between, found, gaps, joined, pieces, placed

# The patterns are anchored so that no start inside a run is tried again: every one takes time in proportion to the text.
LOCAL = "A-Za-z0-9._%+-"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# fixed values: characters of an international account number by its country
IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:"
    + "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN.items())
    + r")(?![A-Za-z0-9])",
    "pan": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed span, what a word nearby adds, and those words.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.9, "pan": 0.4, "ssn": 0.3}
CONTEXT = {
    "email": "e-?mail|mail|contact|write|reach",
    "ip": "address|host|server|login|client",
    "card": "card|visa|mastercard|credit|debit|payment",
    "phone": "phone|telephone|call|tel|mobile|fax|contact",
    "iban": "iban|bank|account|transfer|konto|cuenta|compte",
    "pan": "card|amex|credit|debit|payment",
    "ssn": "ssn|social security|tax id",
}
RAISE, LEAST, REACH = 0.3, 0.5, 48


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Luhn's checksum over the digits of m."""
    d = F.reverse(digits(m))
    values = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substr(d, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def mod97(m: Column) -> Column:
    """ISO 7064 mod 97-10 over an account number: the first four characters go last, letters count from 10."""
    bare = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind in ("card", "pan"):
        return luhn(m)
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return mod97(m) if kind == "iban" else F.lit(True)


def confirms(kind: str):
    return lambda x: confirmed(kind, x["m"])


def of_kind(kind: str):
    return lambda x: x["k"] == kind


def scored(kind: str, spans: Column, text: Column) -> Column:
    """Adds the kind and the score, raised where a word of the kind's context stands within REACH code points."""

    def one(x: Column, cut: Column) -> Column:
        start = F.greatest(x["s"] - REACH, F.lit(0))
        near = F.concat(between(cut, start, x["s"]), F.lit(" "), between(cut, x["e"], x["e"] + REACH))
        score = F.lit(SCORES[kind]) + F.when(F.lower(near).rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})s?(?![a-z])"), RAISE).otherwise(0.0)
        return F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.least(F.lit(1.0), F.round(score, 2)).alias("score"))

    judged = F.transform(F.array(pieces(text)), lambda cut: F.transform(spans, lambda x: one(x, cut)))[0]
    return F.when(F.size(spans) > 0, judged).otherwise(F.array().cast("array<struct<k:string,s:bigint,e:bigint,score:double>>"))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, base counts by kind): spans are (k, s, e, score) by kind, then start.

    The spans of BASE stay whatever their score; those of the other kinds need LEAST, so an unlisted checksum-less
    number counts only beside words that name it. Null and empty texts have no spans; repeated rows are answered each.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    worth = {"email": F.contains("_t", F.lit("@")), "phone": F.contains("_t", F.lit("+"))}
    digit = F.col("_t").rlike("[0-9]")
    rows = rows.select("*", *[found(F.col("_t"), p, worth.get(k, digit)).alias(f"_m_{k}") for k, p in PATTERNS.items()])
    rows = rows.select("*", *[gaps(F.col("_t"), p, F.col(f"_m_{k}")).alias(f"_g_{k}") for k, p in PATTERNS.items()])
    rows = rows.select("doc_id", "_t", *[F.filter(placed(F.col(f"_m_{k}"), F.col(f"_g_{k}")), confirms(k)).alias(f"_s_{k}") for k in PATTERNS])
    spans = [scored(k, F.col(f"_s_{k}"), F.col("_t")) for k in PATTERNS]
    spans = [s if k in BASE else F.filter(s, lambda x: x["score"] >= LEAST) for k, s in zip(PATTERNS, spans, strict=True)]
    return rows.select("doc_id", F.concat(*spans).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["k"].isin(*BASE))
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    scores = F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",")
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))
