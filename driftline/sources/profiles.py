"""What classes can notice: profiles that extend one another, as a dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merged(parent: dict, child: dict) -> dict:
    """Mappings within mappings; the child's values win, lists and scalars as a whole."""
    both = {k: merged(parent[k], v) if isinstance(v, dict) and isinstance(parent.get(k), dict) else v for k, v in child.items()}
    return parent | both


def resolved(profiles: dict[str, dict], name: str, seen: tuple = ()) -> dict:
    """A profile with what it extends; an error for an unknown one and for a cycle."""
    if name in seen:
        raise ValueError(f"profiles extend each other: {' -> '.join((*seen, name))}")
    if name not in profiles:
        raise KeyError(name)
    own = profiles[name]
    return merged(resolved(profiles, own["extends"], (*seen, name)), own) if own.get("extends") else own


def ranges(spark: SparkSession, profile: dict) -> tuple[DataFrame, float]:
    """(dino_class, aware) of the classes that a profile names, and the range of all others: the larger of sight and scent."""
    far = lambda senses: float(max(senses["sight_m"], senses["scent_m"]))
    rows = [(c, far(profile["defaults"] | {k: v for k, v in s.items() if v is not None})) for c, s in sorted(profile.get("classes", {}).items())]
    return spark.createDataFrame(rows, "dino_class string, aware double"), far(profile["defaults"])


def with_awareness(rows: DataFrame, profile: dict) -> DataFrame:
    """Adds the range of each row's class; unknown and missing classes have the default. A profile has a row a class at most."""
    table, default = ranges(rows.sparkSession, profile)
    return rows.join(F.broadcast(table), "dino_class", "left").withColumn("aware", F.coalesce("aware", F.lit(default)))
