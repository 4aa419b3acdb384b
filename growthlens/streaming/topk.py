"""Incremental per-category top-k (X1) with Structured Streaming.

Two modes:

``reference`` -- the service's update rule, applied in event order
(ts, event_id) per category: a known member's score is overwritten; a new
company enters while the heap holds fewer than k; otherwise it replaces the
minimum only when strictly greater.  The rule is order dependent (not
associative), so each category is a sequential fold.  Every micro-batch is
processed in ``foreachBatch``: its events and the previous heaps (state
rows first) are hash-partitioned by category and sorted by
(category, state-first, ts, event_id), and ``mapInPandas`` streams through
the sorted Arrow batches holding only the current heap -- O(k) memory per
task, no group is ever gathered, categories run in parallel.  The new heaps
are the next version of a small state table (k rows per category).

``exact`` -- the latest score of every (category, p) is kept by a streaming
aggregate (``max_by`` over (ts, event_id), partial aggregation, state per
key); the top-k is computed when read.  This one scales with no sequential
step and equals the batch top-k of the latest scores.

Sinks write ``batch_id=<n>`` folders with overwrite, so a re-run batch
replaces its own output (idempotent), and a batch reads the state version of
the latest *earlier* batch; stream checkpoints live in the shared
checkpoint folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators.ranking import top_k
from ..session import scratch_path

OUT_SCHEMA = "category string, rank bigint, p string, s double"


def events_as_scores(events: DataFrame) -> DataFrame:
    """Rank-update stream: category = event_type, p = 'u' || user_id, s = value."""
    return events.select(F.col("event_type").alias("category"),
                         F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("p"),
                         F.col("value").alias("s"), "ts", "event_id")


def apply_updates(ps: list, ss: list, updates, k: int) -> tuple[list, list]:
    """The service's rule over (p, s) updates already in event order."""
    ps, ss = list(ps), list(ss)
    for p, s in updates:
        if p in ps:
            ss[ps.index(p)] = s
        elif len(ps) < k:
            ps.append(p)
            ss.append(s)
        else:
            # minimum = lowest s, then greatest p
            j = min(range(len(ps)), key=lambda i: (ss[i], _neg(ps[i])))
            if s > ss[j]:
                ps[j], ss[j] = p, s
    return ps, ss


def _neg(p: str):
    return tuple(-ord(ch) for ch in p) + (1,)


def _ranked_rows(category: str, ps: list, ss: list) -> list[tuple]:
    order = sorted(range(len(ps)), key=lambda i: (-ss[i], ps[i]))
    return [(category, r + 1, ps[i], ss[i]) for r, i in enumerate(order)]


def _make_fold(k: int):
    """mapInPandas body over rows sorted by (category, prio, ts, event_id):
    prio 0 rows seed the heap (previous state), prio 1 rows are updates."""
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cat, ps, ss = None, [], []
        for pdf in batches:
            out: list[tuple] = []
            for c, prio, p, s in zip(pdf["category"], pdf["prio"], pdf["p"], pdf["s"]):
                if c != cat:
                    if cat is not None:
                        out.extend(_ranked_rows(cat, ps, ss))
                    cat, ps, ss = c, [], []
                if prio == 0:
                    ps.append(p)
                    ss.append(s)
                else:
                    ps, ss = apply_updates(ps, ss, [(p, s)], k)
            if out:
                yield pd.DataFrame(out, columns=["category", "rank", "p", "s"])
        if cat is not None:
            yield pd.DataFrame(_ranked_rows(cat, ps, ss), columns=["category", "rank", "p", "s"])
    return fold


def reference_topk_step(scores: DataFrame, state: DataFrame | None, k: int = config.TOP_K) -> DataFrame:
    """New heaps (category, rank, p, s) after applying ``scores`` (category,
    p, s, ts, event_id) in event order to the heaps in ``state``."""
    ev = scores.select("category", F.lit(1).alias("prio"), "ts", "event_id", "p", "s")
    if state is not None:
        ts_type = ev.schema["ts"].dataType.simpleString()
        seed = state.select("category", F.lit(0).alias("prio"), F.lit(None).cast(ts_type).alias("ts"),
                            F.lit(None).cast("bigint").alias("event_id"), "p", "s")
        ev = seed.unionByName(ev)
    ordered = (ev.repartition("category")
               .sortWithinPartitions("category", "prio", "ts", "event_id")
               .select("category", "prio", "p", "s"))
    return ordered.mapInPandas(_make_fold(k), OUT_SCHEMA)


def reference_topk(events: DataFrame, k: int = config.TOP_K) -> DataFrame:
    """Batch form: the heaps after replaying the whole event history."""
    return reference_topk_step(events_as_scores(events), None, k)


def _latest_version(spark: SparkSession, root: str, below: int | None = None) -> str | None:
    """Path of the highest ``batch_id=<n>`` folder under ``root`` (n < below),
    from the file listing -- no Spark job."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    best = None
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("batch_id="):
            n = int(name.split("=", 1)[1])
            if (below is None or n < below) and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                best = n if best is None or n > best else best
    return None if best is None else f"{root}/batch_id={best}"


def _events_stream(spark: SparkSession, events_dir: str, pattern: str, max_files: int | None):
    schema = spark.read.parquet(f"{events_dir.rstrip('/')}/{pattern}").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(events_dir)


def _write_batches(df: DataFrame, out: str, ckpt: str, on_progress: Callable[[dict], None] | None = None):
    def sink(bdf: DataFrame, batch_id: int):
        bdf.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .parquet(f"{out}/batch_id={batch_id}")
    q = (df.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
         .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    for progress in q.recentProgress if on_progress else ():
        on_progress(json.loads(progress.json))
    return out


def run_reference_topk(spark: SparkSession, events_dir: str, k: int = config.TOP_K,
                       pattern: str = "events.parquet", max_files: int | None = None,
                       out: str | None = None) -> DataFrame:
    """Reference-mode stream; returns the final heaps (category, rank, p, s)."""
    out = out or scratch_path(spark, "topk_reference")
    state_root = out + "/state"

    def step(bdf: DataFrame, batch_id: int):
        prev = _latest_version(spark, state_root, below=batch_id)
        state = spark.read.parquet(prev) if prev else None
        new = reference_topk_step(events_as_scores(bdf), state, k)
        new.write.mode("overwrite").parquet(f"{state_root}/batch_id={batch_id}")

    q = (_events_stream(spark, events_dir, pattern, max_files).writeStream.foreachBatch(step)
         .option("checkpointLocation", out + "/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    latest = _latest_version(spark, state_root)
    if latest is None:
        return spark.createDataFrame([], OUT_SCHEMA)
    return spark.read.parquet(latest).select("category", "rank", "p", "s")


def run_exact_topk(spark: SparkSession, events_dir: str, k: int = config.TOP_K,
                   pattern: str = "events.parquet", max_files: int | None = None,
                   out: str | None = None, dedup_within: str | None = None,
                   on_progress: Callable[[dict], None] | None = None) -> DataFrame:
    """Exact-mode stream; returns the top-k of the latest scores.

    ``dedup_within`` (a duration, off by default) drops an event whose id was seen within that much event time of it
    before it reaches the aggregate; ids are forgotten once the watermark has passed them. An event that comes in later
    than the watermark is dropped too, a first one included, so the duration must cover the lateness of the feed.
    ``on_progress`` is handed Spark's report of each batch."""
    out = out or scratch_path(spark, "topk_exact")
    ckpt = out + "_checkpoint"
    events = _events_stream(spark, events_dir, pattern, max_files)
    if dedup_within:
        timed = events.withColumn("at", F.col("ts").cast("timestamp"))
        events = timed.withWatermark("at", dedup_within).dropDuplicatesWithinWatermark(["event_id"])
    scores = events_as_scores(events)
    latest = scores.groupBy("category", "p").agg(
        F.max_by("s", F.struct("ts", "event_id")).alias("s"),
        F.max(F.struct("ts", "event_id")).alias("at"))
    _write_batches(latest, out, ckpt, on_progress)
    upd = spark.read.parquet(out)
    # latest version of each key over all batches, then the top-k
    cur = top_k(upd, ["category", "p"], [F.col("batch_id").desc()], 1, "_v").select("category", "p", "s")
    return top_k(cur, ["category"], [F.col("s").desc_nulls_last(), F.col("p").asc()], k)


def batch_exact_topk(events: DataFrame, k: int = config.TOP_K) -> DataFrame:
    """Batch equivalent of the exact mode (for tests and comparisons)."""
    latest = events_as_scores(events).groupBy("category", "p").agg(
        F.max_by("s", F.struct("ts", "event_id")).alias("s"))
    return top_k(latest, ["category"], [F.col("s").desc_nulls_last(), F.col("p").asc()], k)
