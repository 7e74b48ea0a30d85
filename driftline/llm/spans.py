"""Where a regular expression matches, in code points, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<s:bigint,e:bigint,m:string>>"
#: Spans gathered by one inner fold. A fold copies what it has gathered, so blocks are gathered apart and flattened at the end.
BLOCK = 256


def found(text: Column, pattern: str, worth: Column | None = None) -> Column:
    """All matches, leftmost and non-overlapping; none is looked for where worth is false."""
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return every if worth is None else F.when(worth, every).otherwise(F.array().cast("array<string>"))


def gaps(text: Column, pattern: str, matches: Column) -> Column:
    """The code points before each match since the one before."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    return F.when(F.size(matches) > 0, between).otherwise(F.array().cast("array<int>"))


def placed(matches: Column, before: Column) -> Column:
    """Matches and their gaps as spans: start, end (exclusive), matched text."""
    both = F.zip_with(matches, F.slice(before, 1, F.greatest(F.size(matches), F.lit(0))), lambda m, g: F.struct(m.alias("m"), g.cast("long").alias("g")))
    none = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["p"] + x["g"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("p"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(b, F.struct(acc["p"].alias("p"), none.alias("out")), step)
        return F.transform(F.array(inner), lambda r: F.struct(r["p"].alias("p"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]

    starts = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int"))
    blocks = F.transform(F.array(both), lambda all_: F.transform(starts, lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))))[0]
    whole = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("p"), F.array().cast(f"array<{SPANS}>").alias("out")), block, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(matches) > 0, whole).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end of spans that have k, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


#: Code points to a piece of a text that is cut up so that places in it are found without counting from its start.
PIECE = 256


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(cut: Column, start: Column, end: Column) -> Column:
    """The code points of a text that was cut into pieces, from start to end (exclusive), in time in proportion to their number."""
    first = F.floor(start / PIECE)
    near = F.array_join(F.slice(cut, (first + 1).cast("int"), (F.floor(end / PIECE) - first + 1).cast("int")), "")
    return F.substr(near, (start - first * PIECE + 1).cast("int"), F.greatest(F.lit(0), end - start).cast("int"))
