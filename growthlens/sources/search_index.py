"""A maintained search index (J8, T8): trigram postings and document frequencies, kept in segments.

A batch of changed companies adds one segment beside the earlier ones, which are never rewritten:

* ``postings`` (bucket, tri, p): the distinct trigrams of each changed name, linear in the names' length. Written in range
  order of (bucket, tri, p), so a frequent trigram spans many files and a file's row groups hold few trigrams;
* ``names`` (p, n): the changed names, null for a company that is gone;
* ``counts`` (bucket, tri, delta): how many companies more or fewer hold each trigram than before the batch, so that the
  sum over all segments is the document frequency.

A row of ``commits`` is written last; a segment without one is not read, and a batch that runs again replaces its own
segment, computed from the commits before it. A posting counts only if its segment holds the latest name of its company.
A search reads the postings of the buckets that its keys' rarest trigrams fall in, and no name is cut into trigrams again.
``create`` over ``current_names`` merges the segments into one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators.search import confirmed_matches, key_blocks, trigrams
from ..session import materialize

BUCKETS = 64
PARTS = {"names": "p string, n string", "postings": "p string, tri string, bucket int",
         "counts": "bucket int, tri string, delta bigint"}


def _bucket(tri):
    return F.pmod(F.crc32(F.encode(tri, "UTF-8")), F.lit(BUCKETS)).cast("int")


def _name_trigrams(names: DataFrame) -> DataFrame:
    """p, tri, bucket: the distinct trigrams of each name (none for null and for fewer than three characters)."""
    tri = names.where(F.col("n").isNotNull()).select("p", F.explode(trigrams(F.lower("n"))).alias("tri"))
    return tri.withColumn("bucket", _bucket(F.col("tri")))


def commits(spark: SparkSession, path: str) -> list[int]:
    """Batches of the segments to read, ascending: one small row for each batch since the last merge."""
    return sorted(r.batch for r in spark.read.parquet(f"{path}/commits").select("batch").distinct().collect())


def _read(spark: SparkSession, path: str, kind: str, batches: list[int]) -> DataFrame:
    parts = [spark.read.schema(PARTS[kind]).parquet(f"{path}/segment-{b}/{kind}").withColumn("segment", F.lit(b))
             for b in batches]
    return reduce(DataFrame.unionByName, parts)


def _current(spark: SparkSession, path: str, batches: list[int]) -> DataFrame:
    """p, n, segment: the latest name of each company, null if it is gone."""
    names = _read(spark, path, "names", batches)
    if len(batches) == 1:
        return names
    latest = names.groupBy("p").agg(F.max(F.struct("segment", "n")).alias("v"))
    return latest.select("p", F.col("v.n").alias("n"), F.col("v.segment").alias("segment"))


def current_names(spark: SparkSession, path: str) -> DataFrame:
    """p, n of every indexed company."""
    return _current(spark, path, commits(spark, path)).where(F.col("n").isNotNull()).select("p", "n")


def _write_segment(path: str, batch: int, names: DataFrame, replaced: DataFrame | None) -> None:
    spark, at = names.sparkSession, f"{path}/segment-{batch}"
    names.write.mode("overwrite").parquet(f"{at}/names")
    new = _name_trigrams(spark.read.parquet(f"{at}/names"))
    (new.repartitionByRange("bucket", "tri", "p").sortWithinPartitions("bucket", "tri", "p")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/postings"))
    change = new.select("bucket", "tri", F.lit(1).alias("d"))
    if replaced is not None:
        change = change.unionByName(_name_trigrams(replaced).select("bucket", "tri", F.lit(-1).alias("d")))
    counts = change.groupBy("bucket", "tri").agg(F.sum("d").alias("delta")).where(F.col("delta") != 0)
    counts.write.mode("overwrite").parquet(f"{at}/counts")
    spark.range(1).select(F.lit(batch).alias("batch")).write.mode("overwrite").parquet(f"{path}/commits/at={batch}")


def _one_name(changes: DataFrame) -> DataFrame:
    """One row a company; of several names the greatest, and a name before a removal, so that reruns agree."""
    return changes.where(F.col("p").isNotNull()).groupBy("p").agg(F.max("n").alias("n"))


def create(path: str, names: DataFrame) -> str:
    """Start an index in the fresh folder ``path`` with all companies ``names`` (p, n) as batch 0."""
    _write_segment(path, 0, _one_name(names), None)
    return path


def update(path: str, changes: DataFrame, batch: int) -> str:
    """Apply changed, new and removed (null n) companies (p, n) as ``batch`` > 0."""
    spark = changes.sparkSession
    earlier = [b for b in commits(spark, path) if b < batch]
    if batch <= 0 or not earlier:
        raise ValueError("an update needs a created index and a batch number above 0")
    changed = materialize(_one_name(changes), "index-changes")
    before = _current(spark, path, earlier).join(changed.select("p"), "p", "left_semi").select("p", "n")
    _write_segment(path, batch, changed, before)
    return path


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """bucket, tri, freq: how many companies hold each trigram now."""
    counts = _read(spark, path, "counts", commits(spark, path))
    return counts.groupBy("bucket", "tri").agg(F.sum("delta").alias("freq")).where(F.col("freq") > 0)


def matches(spark: SparkSession, path: str, queries: DataFrame, min_key: int = config.SEARCH_MIN_KEY_LEN) -> DataFrame:
    """J8 on the index: (query_id, p, kpos) as ``operators.search.search_matches`` gives it from the names themselves.

    ``min_key`` is at least 3: a shorter key has no trigram. Null and empty queries match nothing."""
    if min_key < 3:
        raise ValueError("keys need three characters")
    batches = commits(spark, path)
    block = key_blocks(queries, frequencies(spark, path), min_key)
    bucket = _bucket(F.col("tri")).alias("bucket")
    wanted = [r.bucket for r in block.select(bucket).distinct().collect()]  # at most BUCKETS numbers
    postings = (_read(spark, path, "postings", batches).where(F.col("bucket").isin(wanted)).drop("bucket")
                .join(block.select("tri").distinct(), "tri", "left_semi"))
    names = _current(spark, path, batches).select("p", "segment", F.lower("n").alias("ln"))
    return confirmed_matches(postings.join(names, ["p", "segment"]), F.col("tri"), block)
