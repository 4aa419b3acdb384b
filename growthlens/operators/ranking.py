"""Ordering operators: positions inside (possibly huge) groups, top-k per
category (T1-T3) and its incremental/persisted forms live in other modules.

``positions`` numbers rows inside each group without sending a group to one
task: the frame is range-partitioned on (group, order), so a hot group is
split across many partitions; each partition numbers its rows locally and a
small per-(partition, group) count table supplies the offsets.

Top-k with a small k uses ``row_number() <= k``: Catalyst inserts a
``WindowGroupLimit`` before the shuffle, so each map task forwards at most k
rows per group even when one group holds a third of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..session import materialize


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def positions(df: DataFrame, group_cols: list[str], order_cols: list, name: str = "pos",
              num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based ``name`` column: position of the row inside its group
    under ``order_cols`` (which must be a total order within the group)."""
    keys = [_as_col(c) for c in group_cols] + [_as_col(c) for c in order_cols]
    # Partition ids and local row ids are only meaningful for one concrete
    # range partitioning, and range bounds are sampled.  Materialise the
    # tagged rows once (a Parquet table in the shared checkpoint folder) so
    # the count branch and the join branch see identical rows.
    # without an explicit count the range partitioning follows the session's
    # shuffle sizing (and AQE may coalesce small partitions)
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    tagged = materialize(ranged.sortWithinPartitions(*keys)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()), "positions")
    counts = tagged.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_cnt"),
                                                     F.min("_mid").alias("_first"))
    w = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()).orderBy("_pid")
    offs = counts.withColumn("_off", F.sum("_cnt").over(w) - F.col("_cnt")).drop("_cnt")
    # ``offs`` has at most (#groups + #partitions) rows; AQE broadcasts it at
    # runtime when its materialised size is small, else it sort-merge joins.
    out = tagged.join(offs, ["_pid", *group_cols])
    return out.withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("bigint")) \
        .drop("_pid", "_mid", "_first", "_off")


def top_k(df: DataFrame, group_cols: list[str], order_cols: list, k: int, name: str = "rank") -> DataFrame:
    """Rows ranked 1..k per group (row_number; becomes WindowGroupLimit)."""
    w = Window.partitionBy(*group_cols).orderBy(*[_as_col(c) for c in order_cols])
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k) \
        .withColumn(name, F.col(name).cast("bigint"))


def effective_category_scores(index: DataFrame, success: DataFrame) -> DataFrame:
    """J6 for rankings: a profiled company uses its score for that category
    (null if it has none); others use the index score ``s``.

    One join of the index (p, k, s, c) with the companies' scores, held as a
    map in their rows; the categories are exploded after it."""
    scores = success.select("k", F.col("success").alias("_scores"))
    return (index.select("p", "k", "s", "c").join(scores, "k", "left")
            .select("p", "k", "s", "_scores", F.explode("c").alias("category"))
            .select("category", "p", "k", F.when(F.col("_scores").isNotNull(), F.try_element_at("_scores", F.col("category")))
                    .otherwise(F.col("s")).alias("s")))


def category_topk(effective: DataFrame, k: int = config.TOP_K, categories: list[str] | None = None) -> DataFrame:
    """Top-k per category by score desc (nulls last), permalink asc."""
    if categories is not None:
        effective = effective.where(F.col("category").isin(categories))
    return top_k(effective.select("category", "p", "s"), ["category"],
                 [F.col("s").desc_nulls_last(), F.col("p").asc()], k)


def nlargest(topk: DataFrame, n: int) -> DataFrame:
    """The n best of each stored top-k (n <= k)."""
    return topk.where(F.col("rank") <= n)
