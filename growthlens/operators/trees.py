"""Decision-tree models: flatten (M1), classify (M2), summarise (M7).

A model file is a recursive JSON object ``{col, value, tb, fb}`` with leaves
``{col: -1, results: {"0"|"1": count}}``.  A recursive type has no Spark
schema, so each tree is flattened once -- one row per tree, a small Python
helper inside ``mapInPandas`` -- into *parallel primitive arrays* indexed by
node number (root = 0, breadth-first).  Leaves point to themselves, so the
walk is a fixed-length ``aggregate`` fold that needs no leaf test and stays
JVM-side for every scored row.

Split rule: ``tb`` when ``x >= value`` (numbers); for the employees slot
``tb`` when the label equals the value.  Missing numbers go ``fb``.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .. import config
from ..session import materialize

# a packed model whose size is proven below this is broadcast to the scorer
MAX_BROADCAST_MODEL_BYTES = 64 * 1024 * 1024
# generous per-node size of the packed arrays (id path, 6 numbers, a label)
PACKED_NODE_BYTES = 256
# model files beyond this are not carried along with each scored row, which copies its tree
MAX_ROW_MODEL_BYTES = 64 * 1024
# rows of one category that meet their tree in one task
WALK_ROWS = 262_144

PACKED_SCHEMA = ("category string, ids array<string>, cols array<int>, nums array<double>, "
                 "strs array<string>, tb array<int>, fb array<int>, n0 array<bigint>, n1 array<bigint>, "
                 "depth int, n_nodes int, json_chars int")
PACKED = [c.split()[0] for c in PACKED_SCHEMA.split(", ")]


def _to_float(v):
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def flatten_tree(category: str, text: str) -> dict:
    """One tree's JSON text -> parallel arrays (breadth-first numbering).

    Node ids are paths: ``r`` for the root, then ``t``/``f`` per branch.
    """
    root = json.loads(text)
    ids, nodes = [], []
    queue = deque([("r", root, 1)])
    depth = 0
    while queue:
        path, node, d = queue.popleft()
        ids.append(path)
        nodes.append(node)
        depth = max(depth, d)
        if node.get("results") is None and node.get("col", -1) != -1:
            queue.append((path + "t", node["tb"], d + 1))
            queue.append((path + "f", node["fb"], d + 1))
    index = {p: i for i, p in enumerate(ids)}
    cols, nums, strs, tb, fb, n0, n1 = [], [], [], [], [], [], []
    for i, (path, node) in enumerate(zip(ids, nodes)):
        results = node.get("results")
        if results is not None or node.get("col", -1) == -1:
            cols.append(-1)
            nums.append(None)
            strs.append(None)
            tb.append(i)
            fb.append(i)
            results = results or {}
            n0.append(int(results["0"]) if "0" in results else None)
            n1.append(int(results["1"]) if "1" in results else None)
        else:
            col = int(node["col"])
            val = node.get("value")
            cols.append(col)
            nums.append(None if col == config.EMPLOYEES_SLOT else _to_float(val))
            strs.append(None if val is None else str(val))
            tb.append(index[path + "t"])
            fb.append(index[path + "f"])
            n0.append(None)
            n1.append(None)
    return {"category": category, "ids": ids, "cols": cols, "nums": nums, "strs": strs,
            "tb": tb, "fb": fb, "n0": n0, "n1": n1, "depth": depth, "n_nodes": len(ids), "json_chars": len(text)}


def _flatten_batches(batches):
    for pdf in batches:
        rows = [flatten_tree(c, t) for c, t in zip(pdf["category"], pdf["json"])]
        yield pd.DataFrame(rows, columns=PACKED)


def pack_trees(tree_texts: DataFrame, source_bytes: int | None = None) -> DataFrame:
    """(category, json) rows -> one packed row per tree (M1).

    ``source_bytes`` is the total size of the model files when known from
    the file listing; packed arrays are smaller than the JSON text, so below
    the bound the result is marked for broadcast without running a job."""
    packed = tree_texts.select("category", "json").mapInPandas(_flatten_batches, PACKED_SCHEMA)
    if source_bytes is not None and source_bytes <= MAX_BROADCAST_MODEL_BYTES:
        return F.broadcast(packed)
    return packed


def tree_nodes(packed: DataFrame) -> DataFrame:
    """Node table: category, node, col, value, tb, fb, n0, n1 (ids as paths)."""
    # a child's id is its parent's path and the branch, so that no exploded node carries all ids
    z = packed.select("category", F.explode(F.arrays_zip("ids", "cols", "strs", "n0", "n1")).alias("z"))
    return z.select(
        "category",
        F.col("z.ids").alias("node"),
        F.col("z.cols").alias("col"),
        F.col("z.strs").alias("value"),
        F.when(F.col("z.cols") >= 0, F.concat(F.col("z.ids"), F.lit("t"))).alias("tb"),
        F.when(F.col("z.cols") >= 0, F.concat(F.col("z.ids"), F.lit("f"))).alias("fb"),
        F.col("z.n0").alias("n0"),
        F.col("z.n1").alias("n1"))


def tree_summary(packed: DataFrame) -> DataFrame:
    """M7: per tree node/leaf counts, depth and class totals over leaves."""
    nodes = tree_nodes(packed)
    leaf = F.col("col") < 0
    return (nodes.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(leaf).alias("n_leaves"),
        F.count_if(~leaf).alias("n_splits"),
        F.max(F.length("node")).cast("bigint").alias("depth"),
        F.coalesce(F.sum(F.when(leaf, F.col("n0"))), F.lit(0)).cast("bigint").alias("total_0"),
        F.coalesce(F.sum(F.when(leaf, F.col("n1"))), F.lit(0)).cast("bigint").alias("total_1"),
        F.count_if(leaf & F.col("n0").isNotNull() & F.col("n1").isNotNull()).alias("mixed_leaves")))


def walk(vec: Column, emp: Column, cols: Column, nums: Column, strs: Column,
         tb: Column, fb: Column, depth: Column) -> Column:
    """Index of the leaf reached by one feature vector (JVM-side fold)."""
    def step(a, _):
        c = F.get(cols, a)
        test = (F.when(c < 0, F.lit(True))
                .when(c == config.EMPLOYEES_SLOT, F.coalesce(emp, F.lit("")) == F.get(strs, a))
                .otherwise(F.coalesce(F.get(vec, c) >= F.get(nums, a), F.lit(False))))
        return F.when(test, F.get(tb, a)).otherwise(F.get(fb, a))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), F.lit(0), step)


def predict(rows: DataFrame, packed: DataFrame, source_bytes: int | None = None) -> DataFrame:
    """Classify (p, category, vec, emp, ...) rows with their category's
    tree.  Rows without a tree keep null counts and reason ``no_model``.

    The packed side is one row per model.  When its size is proven small
    (node counts of an in-code model, or the byte size of the model files
    from the listing) it arrives marked for broadcast, so the scored rows are
    never shuffled by category and a hot category stays spread over all
    tasks.  Otherwise it is a shuffle join; AQE still broadcasts it at
    runtime when the materialised side is small, and splits skewed
    partitions when it is not.

    Either way each row is copied with its category's tree.  Model files of
    more than ``MAX_ROW_MODEL_BYTES`` together (``source_bytes``) are walked
    in parts instead (``_predict_parts``)."""
    if source_bytes is not None and source_bytes > MAX_ROW_MODEL_BYTES:
        return _predict_parts(rows, packed)
    j = rows.join(packed, "category", "left")
    leaf = walk(F.col("vec"), F.col("emp"), F.col("cols"), F.col("nums"), F.col("strs"),
                F.col("tb"), F.col("fb"), F.col("depth"))
    j = j.withColumn("_leaf", F.when(F.col("cols").isNotNull(), leaf))
    keep = [c for c in rows.columns]
    return j.select(*keep,
                    F.get(F.col("ids"), F.col("_leaf")).alias("leaf"),
                    F.get(F.col("n0"), F.col("_leaf")).alias("n0"),
                    F.get(F.col("n1"), F.col("_leaf")).alias("n1"),
                    F.when(F.col("cols").isNull(), F.lit("no_model")).otherwise(F.lit("ok")).alias("reason"))


def _numbers(vec: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers, some null or of other lengths -> a matrix, and which of its places hold a number."""
    size = pc.fill_null(pc.list_value_length(vec), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vec.flatten()
    x = np.zeros((len(size), int(size.max(initial=0))))
    have = np.zeros(x.shape, bool)
    at = np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(size.cumsum() - size, size)
    x[at] = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)
    have[at] = values.is_valid().to_numpy(zero_copy_only=False)
    return x, have


def _leaves(rows: pa.Table, tree: dict[str, pa.Array], depth: int) -> np.ndarray:
    """As ``walk``, for all rows together."""
    x, have = _numbers(rows["vec"].combine_chunks())
    emp = pc.fill_null(rows["emp"].combine_chunks(), "").dictionary_encode()
    code = emp.indices.to_numpy()
    label = pc.fill_null(pc.index_in(tree["strs"], value_set=emp.dictionary), -1).to_numpy(zero_copy_only=False)
    number = pc.fill_null(tree["nums"], 0.0).to_numpy(zero_copy_only=False)
    split = tree["nums"].is_valid().to_numpy(zero_copy_only=False)
    cols, tb, fb = (tree[c].to_numpy(zero_copy_only=False) for c in ("cols", "tb", "fb"))
    at, live = np.zeros(len(code), np.int64), np.arange(len(code))
    for _ in range(max(depth, 1)):
        live = live[cols[at[live]] >= 0]
        if not len(live):
            break
        here = at[live]
        slot = cols[here]
        go = slot == config.EMPLOYEES_SLOT
        go[go] = code[live[go]] == label[here[go]]
        num = np.flatnonzero((slot != config.EMPLOYEES_SLOT) & (slot < x.shape[1]) & split[here])
        row, k = live[num], slot[num]
        # NaN is the greatest number, as in Spark
        go[num] = have[row, k] & ((x[row, k] >= number[here[num]]) | np.isnan(x[row, k]))
        at[live] = np.where(go, tb[here], fb[here])
    return at


def _walker(columns: list[str]):
    def walked(left: pa.Table, right: pa.Table) -> pa.Table:
        """Some rows of a category, and its tree if it has one -> the rows with their leaves."""
        rows, n = left.select(columns), left.num_rows
        if right.num_rows == 0 or n == 0:
            found = {"leaf": pa.nulls(n, pa.string()), "n0": pa.nulls(n, pa.int64()), "n1": pa.nulls(n, pa.int64())}
        else:
            tree = {c: right[c].combine_chunks()[0].values for c in ("ids", "cols", "nums", "strs", "tb", "fb", "n0", "n1")}
            at = pa.array(_leaves(left, tree, right["depth"][0].as_py()))
            found = {"leaf": tree["ids"].take(at), "n0": tree["n0"].take(at), "n1": tree["n1"].take(at)}
        for name, values in found.items():
            rows = rows.append_column(name, values)
        return rows.append_column("reason", pa.array(["no_model" if right.num_rows == 0 else "ok"] * n, pa.string()))
    return walked


def _predict_parts(rows: DataFrame, packed: DataFrame) -> DataFrame:
    """``predict`` for large trees: at most about ``WALK_ROWS`` rows of a category meet its tree in one task, which walks
    them together.  So a tree is sent once for so many rows, and a hot category is many tasks."""
    parts = F.ceil(F.count(F.lit(1)) / F.lit(WALK_ROWS)).cast("int").alias("_parts")
    sizes = materialize(rows.groupBy("category").agg(parts), "walk_parts").withColumnRenamed("category", "_category")
    right = packed.join(sizes, F.col("category") == F.col("_category")).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_category", "_parts")
    left = (rows.withColumn("_id", F.monotonically_increasing_id())
            .join(sizes, F.col("category").eqNullSafe(F.col("_category")))
            .withColumn("_part", F.pmod("_id", "_parts").cast("int")).drop("_category", "_parts", "_id"))
    schema = StructType([*rows.schema.fields, StructField("leaf", StringType()), StructField("n0", LongType()),
                         StructField("n1", LongType()), StructField("reason", StringType())])
    return (left.groupBy("category", "_part").cogroup(right.groupBy("category", "_part"))
            .applyInArrow(_walker(rows.columns), schema))


def model_bytes(packed: DataFrame) -> int:
    """Size of all packed trees together, from their node counts (one small aggregate)."""
    return (packed.agg(F.sum("n_nodes")).first()[0] or 0) * PACKED_NODE_BYTES


def models(packed: DataFrame) -> DataFrame:
    """All packed trees as one value: a map from category to arrays."""
    parts = F.struct("cols", "nums", "strs", "tb", "fb", "n0", "n1", "depth")
    return packed.agg(F.map_from_entries(F.collect_list(F.struct(F.col("category"), parts.alias("m")))).alias("models"))


def tree_texts_from_constants(spark, trees: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(trees.items()), "category string, json string")


def pack_constant_trees(spark, trees: dict[str, str]) -> DataFrame:
    """Packed rows of a model defined in code: flattened where it is
    defined (a handful of small trees), no Python worker needed."""
    rows = [flatten_tree(c, t) for c, t in sorted(trees.items())]
    df = spark.createDataFrame([tuple(r[c] for c in PACKED) for r in rows], PACKED_SCHEMA)
    size = sum(r["n_nodes"] for r in rows) * PACKED_NODE_BYTES
    return F.broadcast(df) if size <= MAX_BROADCAST_MODEL_BYTES else df
