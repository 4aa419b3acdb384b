"""Category baselines as maintained state (A2, J5): changed profiles are added to and taken from stored sums.

The table ``rows`` (``sources.bucketed_store``) holds what each company adds: its categories and its monthly funding. A
batch reads the earlier rows of the companies that it changes, upserts them, and reduces old rows (sign -1) and new rows
(sign +1) to one line a category: companies, values, sum and sum of squares. Sums are decimals, so taking a value back
leaves no remainder. A greatest value cannot be taken back: only for categories whose greatest value was taken and not
replaced by one at least as great are the stored rows read again.

The state is one row a category, written whole for each batch; a batch that runs again starts from the state before it.
A null or repeated category counts like any other entry, as in ``scoring.category_baselines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources import bucketed_store as BS
from .scoring import monthly_funding

SUM = "decimal(38,6)"
SQUARES = "decimal(38,4)"
STATE = ["category", "t", "n", "total", "squares", "r"]


def contributions(index: DataFrame, features: DataFrame) -> DataFrame:
    """p, categories, mf: what each company of the index adds; mf is null without a profile or a rate."""
    mf = features.select("p", monthly_funding(F.col("total_funding"), F.col("age")).alias("mf"))
    return index.select("p", F.col("c").alias("categories")).join(mf, "p", "left")


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(F.explode("categories").alias("category"), "mf", F.lit(sign).alias("sign"))


def _change(signed: DataFrame) -> DataFrame:
    """One row a category: what a batch adds, and the greatest value added (up) and taken (down)."""
    mf, sign = F.col("mf"), F.col("sign")
    return signed.groupBy("category").agg(
        F.sum(sign).alias("dt"), F.sum(F.when(mf.isNotNull(), sign).otherwise(0)).alias("dn"),
        F.coalesce(F.sum(mf.cast("decimal(24,6)") * sign), F.lit(0)).cast(SUM).alias("dtotal"),
        F.coalesce(F.sum((mf * mf).cast("decimal(34,4)") * sign), F.lit(0)).cast(SQUARES).alias("dsquares"),
        F.max(F.when(sign > 0, mf)).alias("up"), F.max(F.when(sign < 0, mf)).alias("down"))


def _save(state: DataFrame, path: str, batch: int) -> None:
    state.select(*STATE).write.mode("overwrite").parquet(f"{path}/state/batch={batch}")


def start(path: str, rows: DataFrame, buckets: int = BS.BUCKETS) -> str:
    """State over all ``rows`` (p, categories, mf, fetched_at), in the fresh folder ``path``, as batch 0."""
    spark = rows.sparkSession
    BS.create(f"{path}/rows", rows.select("p", "categories", "mf", "fetched_at"), buckets=buckets)
    change = _change(_signed(BS.read(spark, f"{path}/rows"), 1))
    _save(change.select("category", F.col("dt").alias("t"), F.col("dn").alias("n"), F.col("dtotal").alias("total"),
                        F.col("dsquares").alias("squares"), F.col("up").alias("r")), path, 0)
    return path


def _state(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    every = spark.read.parquet(f"{path}/state")
    if below is not None:
        every = every.where(F.col("batch") < below)
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == last).select(*STATE)


def update(path: str, changes: DataFrame, batch: int) -> int:
    """Apply changed companies (p, categories, mf, fetched_at) as ``batch`` > 0; returns for how many categories the
    greatest value was read again."""
    spark, table = changes.sparkSession, f"{path}/rows"
    new = materialize(changes.select("p", "categories", "mf", "fetched_at"), "baseline-changes")
    keys = new.select("p").distinct()

    def held(below: int | None) -> DataFrame:
        return BS.rows_of(keys, table, below=below).join(keys, "p", "left_semi").select("categories", "mf")

    before = held(batch)
    BS.upsert(table, new, batch)
    delta = _change(_signed(before, -1).unionByName(_signed(held(None), 1)))
    zero = F.lit(0)
    # a null category is a group of its own, so both sides are added up rather than joined
    old = _state(spark, path, batch).select("category", "t", "n", "total", "squares", "r",
                                            F.lit(None).cast("double").alias("up"),
                                            F.lit(None).cast("double").alias("down"))
    step = delta.select("category", F.col("dt").alias("t"), F.col("dn").alias("n"), F.col("dtotal").alias("total"),
                        F.col("dsquares").alias("squares"), F.lit(None).cast("double").alias("r"), "up", "down")
    both = old.unionByName(step).groupBy("category").agg(
        F.sum("t").alias("t"), F.sum("n").alias("n"), F.sum("total").cast(SUM).alias("total"),
        F.sum("squares").cast(SQUARES).alias("squares"), F.max("r").alias("was"), F.max("up").alias("up"),
        F.max("down").alias("down"))
    lost = (F.col("down") >= F.col("was")) & ~F.coalesce(F.col("up") >= F.col("was"), F.lit(False))
    merged = materialize(both.where(F.col("t") > zero).select(
        "category", "t", "n", "total", "squares", F.greatest("was", "up").alias("r"),
        F.coalesce(lost, F.lit(False)).alias("lost")), "baseline-state")
    again = merged.where("lost").count()
    if again:
        rows = _signed(BS.read(spark, table), 1)
        flagged = merged.where("lost").select(F.col("category").alias("_c"))
        top = rows.join(flagged, F.col("category").eqNullSafe(F.col("_c")), "left_semi").groupBy("category").agg(
            F.max("mf").alias("_top")).withColumnRenamed("category", "_c")
        merged = merged.join(top, F.col("category").eqNullSafe(F.col("_c")), "left").withColumn(
            "r", F.when(F.col("lost"), F.col("_top")).otherwise(F.col("r")))
    _save(merged, path, batch)
    return again


def baselines(spark: SparkSession, path: str, min_companies: int = 300) -> DataFrame:
    """A2 from the state: category, t, r, m, d as ``scoring.category_baselines`` computes them from all rows."""
    n, total = F.col("n"), F.col("total").cast("double")
    spread = F.greatest(F.lit(0.0), F.col("squares").cast("double") - F.try_divide(total * total, n))
    return _state(spark, path).where(F.col("t") > min_companies).select(
        "category", "t", "r", F.try_divide(total, n).alias("m"),
        F.when(n > 1, F.sqrt(spread / F.greatest(n - 1, F.lit(1)))).alias("d"))
