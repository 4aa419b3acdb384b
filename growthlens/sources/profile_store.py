"""Stored profiles (S5-S7) and company metadata lookups.

Profiles live in a Parquet table keyed by permalink.  Lookups are joins, so
Parquet column pruning and filter push-down apply; an upsert is a union of
the stored and the new rows reduced to the latest ``fetched_at`` per key,
written to a fresh version folder (old versions stay readable, a failed
write never leaves a half-replaced table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import top_k


def save_profiles(profiles: DataFrame, path: str) -> str:
    profiles.write.mode("overwrite").parquet(path)
    return path


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def has_profile(lookups: DataFrame, profiles: DataFrame) -> DataFrame:
    """P, has_profile for every looked-up permalink."""
    known = profiles.select("p").distinct().withColumn("_hit", F.lit(True))
    return (lookups.select("p").join(known, "p", "left")
            .select("p", F.coalesce(F.col("_hit"), F.lit(False)).alias("has_profile")))


def profile_lookup(lookups: DataFrame, profiles: DataFrame, cols: list[str]) -> DataFrame:
    """The stored profile of each looked-up permalink (nulls when none)."""
    return lookups.select("p").join(profiles.select("p", *cols), "p", "left")


def upsert(stored: DataFrame, updates: DataFrame, key: str = "p", version_col: str = "fetched_at") -> DataFrame:
    """Latest version per key across stored and new rows; of equal versions the row of the greatest JSON text, so
    that reruns agree.

    ``row_number() = 1`` per key is a top-1 window; Catalyst plans it with a
    partial ``WindowGroupLimit`` before the shuffle on the key."""
    both = stored.unionByName(updates, allowMissingColumns=True)
    return top_k(both, [key], [F.col(version_col).desc(), F.to_json(F.struct(*both.columns)).desc()], 1, "_rn").drop("_rn")


def meta_lookup(lookups: DataFrame, index: DataFrame) -> DataFrame:
    """Index metadata of each looked-up permalink; unknown -> nulls."""
    return lookups.select("p").join(index.select("p", "n", "i", "s"), "p", "left")
