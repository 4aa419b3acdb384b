"""Trend lists and index-wide counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classes as CL
from .ranking import positions


def flags(profiles: DataFrame) -> DataFrame:
    """p, success_all, allstar, hot for every profiled company."""
    return profiles.select(
        "p", "success_all",
        CL.is_allstar(F.col("is_acquired"), F.col("num_acquisitions"), F.col("success_all")).alias("allstar"),
        CL.is_hot(F.col("is_acquired"), F.col("num_acquisitions"), F.col("age"), F.col("success_all"),
                  F.col("rate")).alias("hot"))


def trend_list(profiles: DataFrame, index: DataFrame, which: str) -> DataFrame:
    """J1 + T5: index metadata of the flagged companies, s replaced by the
    profile's success, ordered by s desc (permalink asc on ties).

    The order is a global one; ``positions`` range-partitions it so no task
    receives the whole list."""
    f = flags(profiles).where(F.col(which)).select("p", "success_all")
    rows = index.select("p", "n", "i").join(f, "p").select("p", "n", "i", F.col("success_all").alias("s"))
    return positions(rows, [], [F.col("s").desc(), F.col("p").asc()], "pos")


def index_counts(index: DataFrame, baselines: DataFrame) -> DataFrame:
    """A1: number of indexed companies and of categories with a baseline.
    The second count is a scalar subquery, so no join is needed."""
    cat_count = baselines.select(F.count(F.lit(1))).scalar()
    return index.agg(F.count(F.lit(1)).alias("indexed_count")).select("indexed_count",
                                                                      cat_count.alias("cat_count"))


def refresh_scores(index: DataFrame, profiles: DataFrame) -> DataFrame:
    """The index with s replaced by success_all for profiled companies,
    as a new frame (no in-place mutation)."""
    succ = profiles.select("p", "success_all")
    return (index.join(succ, "p", "left")
            .select("p", "n", "i", F.coalesce(F.col("success_all"), F.col("s")).alias("s"), "c"))
