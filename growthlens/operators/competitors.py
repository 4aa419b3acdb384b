"""Competitors of a profiled company.

The competitor list is an edge table (p, pos, competitor); unknown
permalinks drop out through an inner join with the index and duplicates
stay.  The own rank is an aggregate -- 1 + number of competitors with a
strictly greater index score -- so no per-company list is materialised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from .ranking import top_k


def known_competitors(edges: DataFrame, index: DataFrame) -> DataFrame:
    """P, competitor, n, i, s for competitors present in the index."""
    meta = index.select(F.col("p").alias("competitor"), "n", "i", "s")
    return edges.join(meta, "competitor").select("p", "competitor", "n", "i", "s")


def competitor_list(edges: DataFrame, index: DataFrame) -> DataFrame:
    """J2 + sort: competitors ordered by s desc (permalink asc on ties).  A
    group is the competitor list of one document, so a plain row number does."""
    order = Window.partitionBy("p").orderBy(F.col("s").desc(), F.col("competitor").asc())
    return known_competitors(edges, index).withColumn("pos", F.row_number().over(order).cast("bigint"))


def competitor_rank(profiled: DataFrame, edges: DataFrame, index: DataFrame) -> DataFrame:
    """rank = 1 + competitors with greater s; total = competitors + 1.

    ``profiled`` lists the companies that have a profile (column p)."""
    own = index.select("p", F.col("s").alias("own_s"))
    comp = known_competitors(edges, index).join(own, "p")
    agg = comp.groupBy("p").agg(F.count_if(F.col("s") > F.col("own_s")).alias("_gt"),
                                F.count(F.lit(1)).alias("_n"))
    return (profiled.select("p").join(agg, "p", "left")
            .select("p", (F.coalesce(F.col("_gt"), F.lit(0)) + 1).cast("bigint").alias("rank"),
                    (F.coalesce(F.col("_n"), F.lit(0)) + 1).cast("bigint").alias("total")))


def competitors_top(edges: DataFrame, index: DataFrame, n: int = config.COMPETITORS_SHOWN) -> DataFrame:
    """The first n competitors shown on a profile."""
    return top_k(known_competitors(edges, index), ["p"],
                 [F.col("s").desc(), F.col("competitor").asc()], n, "pos")
