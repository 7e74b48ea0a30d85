"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import Table as Kept
from ..operators.state import cut, numbered

__all__ = ["Kept", "cut", "numbered"]

#: The blanks between words, as the inside of a character class and as a list.
BLANKS = r"\x20\x09-\x0D"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, f"[{BLANKS}]+", -1))).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents whose labels no model may see. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbers(columns: list[str]) -> list[Column]:
    """The columns under the names _c_0, _c_1 and so on, with which none of an operator's own can clash."""
    return [F.col(f"`{c}`").alias(f"_c_{i}") for i, c in enumerate(columns)]
