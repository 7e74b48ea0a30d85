"""From raw documents to packed sequences: language, near-duplicates, secrets, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm.common import Kept, table
from driftline.llm.language import language_stage
from driftline.llm.mixing import mix_stage
from driftline.llm.packing import pack_stage
from driftline.llm.secrets import redact_stage
from driftline.llm.simhash import dedup_stage

#: Each takes (spark, docs, sf_dir); its result is written, and read as the next one's docs.
STAGES = [
    ("language", language_stage),
    ("near_duplicates", dedup_stage),
    ("secrets", redact_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: Fingerprints, the language model and the tokenizer are beyond SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote goes when the next one has been written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = Kept(stage(spark, docs, sf_dir))
        if last:
            last.drop()
        docs, last = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)
