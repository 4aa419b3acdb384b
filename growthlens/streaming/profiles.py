"""Document arrival -> profile -> store -> category top-k.

Documents (or document pages) land as JSON lines; ``readStream.json`` with the explicit D4 schema picks them up.  Each
page is reduced row-locally to a statistics row, and keyed state (``keyed.CompanyPages``) holds one such row per
(company, page): a batch reads its own pages alone, and pages of one company spread over several batches, in any order
and sent again, still give exact features.  Each batch scores the companies that it touched with the batch operators
(trees and baselines are small inputs) and writes them to the profile store.

The store's change feed holds a company's new score in each of its categories.  ``run_profile_topk`` seeds the feed with
the index scores and follows it with retractable local top-k's (``keyed.BucketTop``).

Every batch writes ``batch_id=<n>`` folders with overwrite, idempotent on replay; the profile table is read as the latest
version per permalink.  Quarantine is a stateless stream of its own over the same landing folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, schemas
from ..operators import scoring as SC
from ..operators.ranking import top_k
from ..session import scratch_path
from ..sources import documents as DOC
from . import keyed

FEED = "category string, p string, s double, seq bigint"


def _landed(spark: SparkSession, landing: str, max_files: int | None) -> DataFrame:
    r = (spark.readStream.schema(schemas.ORG_DOCUMENT_WITH_CORRUPT)
         .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", schemas.CORRUPT))
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(landing)


def _run(df: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def run_profile_stream(spark: SparkSession, landing: str, index: DataFrame, packed_trees: DataFrame,
                       baselines: DataFrame, as_of=config.WORLD_AS_OF, out: str | None = None,
                       max_files: int | None = None) -> DataFrame:
    """Process every document present in ``landing``; return the profiles as read back from the store.  The change feed
    (category, p, s, seq) lies in ``<out>/feed``."""
    out = out or scratch_path(spark, "profile_stream")
    keyed.use_keyed_state(spark)
    stats = DOC.page_stats(DOC.split_documents(_landed(spark, landing, max_files))[0])
    rows = DOC.page_rows(stats).withColumn("at", F.unix_millis(F.current_timestamp()))
    merged = keyed.merged_companies(rows)

    def score_batch(bdf: DataFrame, batch_id: int):
        feats = DOC.with_index(DOC.merged_rows(bdf, stats, as_of), index)
        prof = SC.build_profiles(feats, packed_trees, baselines)
        at = f"{out}/profiles/batch_id={batch_id}"
        prof.select("p", "age", "success_all", "rate", "c", "success", F.lit(batch_id).alias("fetched_at")) \
            .write.mode("overwrite").parquet(at)
        feed = spark.read.parquet(at).select("p", "success", F.explode(F.array_distinct("c")).alias("category"))
        feed.select("category", "p", F.col("success")[F.col("category")].cast("double").alias("s"),
                    F.lit(batch_id).cast("bigint").alias("seq")).write.mode("overwrite").parquet(
            f"{out}/feed/batch_id={batch_id}")

    _run(merged, score_batch, out + "/_checkpoint", "update")
    stored = spark.read.parquet(f"{out}/profiles")
    return top_k(stored, ["p"], [F.col("fetched_at").desc()], 1, "_v").drop("_v", "batch_id")


def run_quarantine_stream(spark: SparkSession, landing: str, index: DataFrame, out: str | None = None,
                          max_files: int | None = None) -> DataFrame:
    """The lines of ``landing`` that give no profile: reason, raw."""
    out = out or scratch_path(spark, "quarantine_stream")

    def split_batch(bdf: DataFrame, batch_id: int):
        good, bad = DOC.split_documents(bdf)
        bad.unionByName(DOC.not_in_index(good, index)).write.mode("overwrite").parquet(
            f"{out}/quarantine/batch_id={batch_id}")

    _run(_landed(spark, landing, max_files), split_batch, out + "/_checkpoint")
    return spark.read.parquet(f"{out}/quarantine").drop("batch_id")


def run_topk_stream(spark: SparkSession, feed: str, k: int = config.TOP_K, out: str | None = None,
                    max_files: int | None = None) -> DataFrame:
    """Follow a change feed folder (category, p, s, seq); return the top-k (category, rank, p, s) of the latest scores.
    May be called again with the same ``out`` when the feed has grown."""
    out = out or scratch_path(spark, "profile_topk")
    keyed.use_keyed_state(spark)
    r = spark.readStream.schema(FEED).option("recursiveFileLookup", "true")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)

    def save(bdf: DataFrame, batch_id: int):
        bdf.write.mode("overwrite").parquet(f"{out}/local/batch_id={batch_id}")

    _run(keyed.bucket_tops(r.parquet(feed), k), save, out + "/_checkpoint", "update")
    return keyed.merged_top(spark.read.parquet(f"{out}/local"), k).select("category", "rank", "p", "s")


def seed_feed(index_scores: DataFrame, out: str) -> None:
    """Start the feed in ``<out>/feed`` with the index scores (category, p, s), older than any profile's."""
    index_scores.select("category", "p", F.col("s").cast("double").alias("s"), F.lit(-1).cast("bigint").alias("seq")) \
        .write.mode("overwrite").parquet(f"{out}/feed/batch_id=-1")


def run_profile_topk(spark: SparkSession, landing: str, index: DataFrame, index_scores: DataFrame,
                     packed_trees: DataFrame, baselines: DataFrame, as_of=config.WORLD_AS_OF, k: int = config.TOP_K,
                     out: str | None = None, max_files: int | None = None) -> DataFrame:
    """X2 -> X1: score the documents of ``landing`` and follow the store's change feed to the top-k of each category."""
    out = out or scratch_path(spark, "profile_stream")
    seed_feed(index_scores, out)
    run_profile_stream(spark, landing, index, packed_trees, baselines, as_of, out, max_files)
    return run_topk_stream(spark, f"{out}/feed", k, f"{out}/topk", max_files)
