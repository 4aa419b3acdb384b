"""A stored profile table with incremental upserts and point lookups.

Rows live in hash buckets of their key. A batch rewrites only the buckets that its updates touch, into a folder of its
own; the manifest written after it says for each bucket which batch's folder holds it. Readers of an earlier manifest keep
what they see, a batch that fails leaves no manifest, and a batch that runs again gives the same table, for it starts
from the manifest before it. Folders that no wanted manifest names can be removed by the owner of the table.

Inside a bucket, files are in range order of the key and carry a Bloom filter on it, so a lookup opens the buckets of its
keys only, and a lookup of few keys (``POINT_KEYS``) also skips row groups. The number of buckets is chosen at creation
and stored in the manifest; a good choice is table bytes / 256 MB or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import profile_store as PS
from ..session import materialize

BUCKETS = 16
#: An IN list of more values reaches Parquet as a range only (spark.sql.parquet.pushdown.inFilterThreshold).
POINT_KEYS = 10


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _numbers(df: DataFrame) -> list[int]:
    """Distinct bucket numbers of a frame: at most the table's number of buckets."""
    return sorted(r.bucket for r in df.select("bucket").distinct().collect())


def manifest(spark: SparkSession, path: str, below: int | None = None) -> tuple[int, int, dict[int, int]]:
    """(batch, number of buckets, bucket -> batch that holds it) of the latest manifest, or the latest one ``below``."""
    every = spark.read.parquet(f"{path}/manifest")
    if below is not None:
        every = every.where(F.col("batch") < below)
    last = every.agg(F.max("batch")).first()[0]
    if last is None:
        raise ValueError("the table has no earlier batch")
    rows = every.where(F.col("batch") == last).select("buckets", "bucket", "held_by").collect()  # a row a bucket
    return last, rows[0].buckets, {r.bucket: r.held_by for r in rows if r.bucket is not None}


def _paths(path: str, held: dict[int, int], buckets: list[int] | None) -> list[str]:
    return [f"{path}/batch={at}/bucket={b}" for b, at in sorted(held.items()) if buckets is None or b in buckets]


def _open(spark: SparkSession, path: str, held: dict[int, int], buckets: list[int] | None = None) -> DataFrame:
    paths = _paths(path, held, buckets)
    if paths:
        return spark.read.parquet(*paths)
    return spark.read.parquet(f"{path}/schema")


def _write(path: str, batch: int, rows: DataFrame, key: str, buckets: int, held: dict[int, int],
           touched: list[int]) -> None:
    spark = rows.sparkSession
    (rows.repartitionByRange("bucket", key).sortWithinPartitions("bucket", key).write.mode("overwrite")
     .option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy("bucket").parquet(f"{path}/batch={batch}"))
    now = {**held, **{b: batch for b in touched}}
    entries = [(batch, buckets, b, at) for b, at in sorted(now.items())] or [(batch, buckets, None, None)]
    spark.createDataFrame(entries, "batch int, buckets int, bucket int, held_by int").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/manifest/written={batch}")


def create(path: str, rows: DataFrame, key: str = "p", buckets: int = BUCKETS, version_col: str = "fetched_at") -> str:
    """Start a table in the fresh folder ``path`` as batch 0. Of several rows of a key the latest stays (as in
    ``profile_store.upsert``); rows without a key are a key of their own, null."""
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    first = materialize(_bucketed(PS.upsert(rows, rows.limit(0), key, version_col), key, buckets), "store-rows")
    _write(path, 0, first, key, buckets, {}, _numbers(first))
    return path


def upsert(path: str, updates: DataFrame, batch: int, key: str = "p", version_col: str = "fetched_at") -> list[int]:
    """Merge ``updates`` as ``batch`` > 0, the latest version a key; returns the rewritten buckets. The updates have
    the table's columns."""
    spark = updates.sparkSession
    _, buckets, held = manifest(spark, path, below=batch)
    new = materialize(_bucketed(updates, key, buckets), "store-updates")
    touched = _numbers(new)
    stored = _bucketed(_open(spark, path, held, touched), key, buckets)
    _write(path, batch, PS.upsert(stored, new, key, version_col), key, buckets, held, touched)
    return touched


def read(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """The whole table as of the latest batch, or of the latest one ``below``."""
    return _open(spark, path, manifest(spark, path, below)[2])


def rows_of(keys: DataFrame, path: str, key: str = "p", below: int | None = None) -> DataFrame:
    """The part of the table that can hold ``keys``: their buckets, and for few keys only the row groups that may hold
    them."""
    spark = keys.sparkSession
    _, buckets, held = manifest(spark, path, below)
    wanted = _bucketed(keys.select(key), key, buckets)
    part = _open(spark, path, held, _numbers(wanted))
    few = keys.select(key).distinct().limit(POINT_KEYS + 1).collect()
    return part.where(F.col(key).isin([r[0] for r in few if r[0] is not None])) if len(few) <= POINT_KEYS else part


def has_profile(lookups: DataFrame, path: str) -> DataFrame:
    """S5 on the stored table."""
    return PS.has_profile(lookups, rows_of(lookups, path))


def profile_lookup(lookups: DataFrame, path: str, cols: list[str]) -> DataFrame:
    """S6 on the stored table."""
    return PS.profile_lookup(lookups, rows_of(lookups, path), cols)
