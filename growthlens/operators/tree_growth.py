"""Growing decision trees for all categories together (the training half of M8).

Input rows are (category, label 0/1, vec array<double>, emp string); the
result is a node table (category, node, col, value, n0, n1) with path ids as
in ``trees.tree_nodes`` (``r``, then ``t``/``f`` per branch).  Tests are those
of the model files: ``vec[col] >= value``, a missing number going to ``f``;
on the employees slot ``emp == value``.

* A node of more than ``task_rows`` rows is split by Spark, one level of all
  categories at a time: cut points per (category, node, slot) are a quantile
  sketch; the rows at or above each are counted with numpy in parts of at most
  about ``PART_ROWS`` rows of one node, whose counts are summed.  No task sees
  a node's rows together, so a hot category is no hot task.  A split's counts
  are the sizes of its children, so a level reads its rows three times (cut
  points, counts, move to the children), spread over all tasks.
* A node of at most ``WHOLE_PARTS`` such parts comes together in one task,
  which splits it by the same rule (cut points are exact quantiles there) down
  to nodes of at most ``task_rows`` rows; all such nodes take one job, however
  deep they go.
* A smaller node is finished where it is: its rows, at most ``task_rows``,
  come together in one task, which splits at exact values with numpy.  The
  small nodes of all levels are finished in one job.

Every node that is not pure is split while some test parts it, so a leaf
holds both labels only if its rows cannot be told apart, or at ``max_depth``
or below ``min_rows`` rows.  Of equal Gini costs the lowest slot wins, then the lowest
value.  An empty table gives no nodes; a null category is a category; rows
with a null label are left out; a null or NaN number is missing; a null
employees label is ``""``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..session import materialize, scratch_path

TASK_ROWS = 8192
BINS = 64
PART_ROWS = 65536
WHOLE_PARTS = 8
MAX_DEPTH = 200
# tables of one row a node are broadcast only if they are proven below this
BROADCAST_BYTES = 64 * 1024 * 1024
KEYS = ["category", "node"]
SIDES = "category string, node string, n bigint, n1 bigint, col int, num double, value string, tn bigint, t1 bigint"
NODES = "category string, node string, col int, value string, n0 bigint, n1 bigint"
PARTED = ("category string, node string, kind string, label int, vec array<double>, emp string, "
          "col int, num double, value string, n0 bigint, n1 bigint")
EMP = config.EMPLOYEES_SLOT


def grow(rows: DataFrame, max_depth: int = MAX_DEPTH, min_rows: int = 2,
         task_rows: int = TASK_ROWS, bins: int = BINS) -> DataFrame:
    """Node table of one tree per category."""
    clean = rows.where(F.col("label").isNotNull()).select(
        "category", F.lit("r").alias("node"), F.col("label").cast("int").alias("label"),
        F.transform("vec", lambda x: F.when(~F.isnan(x), x)).alias("vec"),
        F.coalesce("emp", F.lit("")).alias("emp"))
    spark = rows.sparkSession
    clean = materialize(clean, "tree_rows")
    state = _state(max_depth, min_rows, task_rows)
    nodes = materialize(clean.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n1"))
                        .withColumn("state", state), "tree_sizes")
    n, size = _how_many(nodes)
    done = _leaves(nodes.where("state = 'leaf'"))
    small = []
    if "small" in n:
        small.append(_of(clean, nodes.where("state = 'small'").select(*KEYS), n["small"], 128))
    if "big" in n or "mid" in n:
        rows = size.get("big", 0) + size.get("mid", 0)
        parts = max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))
        active = _of(clean, nodes.where("state IN ('big', 'mid')").select(*KEYS, "n", "state"),
                     n.get("big", 0) + n.get("mid", 0), 128).repartition(parts)
        active = materialize(active.withColumn("row", F.monotonically_increasing_id()), "tree_big")
        mid, mids = [active.where("state = 'mid'").select(*clean.columns)], n.get("mid", 0)
        active = active.where("state = 'big'").drop("state")
        tested, levels = [], []
        big = nodes.where("state = 'big'")
        while "big" in n:
            splits = _splits(active, big.select(*KEYS, "n", "n1"), n["big"], bins)
            tested.append(_written(splits, "tree_splits"))
            splits = spark.read.parquet(tested[-1])
            nodes = _children(splits.where("col IS NOT NULL")).withColumn("state", state)
            split = n["big"]
            n, _ = _how_many(nodes)
            if n.keys() & {"small", "mid", "big"}:
                levels.append(_written(_descend(active, splits, split, state), "tree_rows", "state"))
                here = spark.read.schema(active.schema.add("state", "string")).parquet(levels[-1])
                if "big" in n:
                    active, big = here.where("state = 'big'").drop("state"), nodes.where("state = 'big'")
                if "mid" in n:
                    mid.append(here.where("state = 'mid'").select(*clean.columns))
                    mids += n["mid"]
                if "small" in n:
                    small.append(here.where("state = 'small'").select(*clean.columns))
        if tested:
            tests = spark.read.parquet(*tested)
            done = (done.unionByName(_leaves(tests.where("col IS NULL")))
                    .unionByName(tests.where("col IS NOT NULL").select(
                        *KEYS, "col", "value", F.lit(None).cast("bigint").alias("n0"),
                        F.lit(None).cast("bigint").alias("n1")))
                    .unionByName(_leaves(_children(tests.where("col IS NOT NULL")).where(state == "leaf"))))
        if mids:
            parted = (reduce(DataFrame.unionByName, mid).repartition(max(parts, 8 * mids), *KEYS).groupBy(*KEYS)
                      .applyInArrow(_parter(max_depth, min_rows, task_rows, bins), PARTED))
            parted = materialize(parted, "tree_parted")
            done = done.unionByName(parted.where("kind = 'node'").select(
                *KEYS, "col", F.coalesce("value", F.col("num").cast("string")).alias("value"), "n0", "n1"))
            small.append(parted.where("kind = 'row'").select(*clean.columns))
    if small:
        some = reduce(DataFrame.unionByName, small)
        done = done.unionByName(some.groupBy(*KEYS).applyInPandas(_finisher(max_depth, min_rows), NODES))
    return materialize(done, "tree_nodes")


def _state(max_depth: int, min_rows: int, task_rows: int) -> Column:
    """What becomes of a node (node, n, n1)."""
    whole = ((F.col("n1") == 0) | (F.col("n1") == F.col("n")) | (F.length("node") > max_depth)
             | (F.col("n") < min_rows))
    return (F.when(whole, "leaf").when(F.col("n") <= task_rows, "small")
            .when(F.col("n") <= WHOLE_PARTS * PART_ROWS, "mid").otherwise("big"))


def _how_many(nodes: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """Nodes and rows of each state."""
    got = nodes.groupBy("state").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("rows")).collect()
    return {r["state"]: r["nodes"] for r in got}, {r["state"]: r["rows"] for r in got}


def _written(df: DataFrame, name: str, *by: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return path


def _leaves(sizes: DataFrame) -> DataFrame:
    return sizes.select(*KEYS, F.lit(-1).alias("col"), F.lit(None).cast("string").alias("value"),
                        (F.col("n") - F.col("n1")).alias("n0"), F.col("n1"))


def _keyed(nodes: DataFrame) -> tuple[DataFrame, Column]:
    """The nodes with their keys renamed, and the condition that joins them; null categories are equal."""
    on = F.col("category").eqNullSafe(F.col("_category")) & (F.col("node") == F.col("_node"))
    return nodes.withColumnsRenamed({"category": "_category", "node": "_node"}), on


def _of(active: DataFrame, nodes: DataFrame, n: int, row_bytes: int) -> DataFrame:
    """Rows of the given nodes with their further columns; ``n`` nodes of ``row_bytes`` are broadcast if that is small."""
    right, on = _keyed(nodes)
    if n * row_bytes <= BROADCAST_BYTES:
        right = F.broadcast(right)
    return active.join(right, on).drop("_category", "_node")


def _counter(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Some rows of a node, and its cut points -> for each test, how many of the rows pass it and their labels' sum."""
    y = left["label"].to_numpy().astype(np.int64)
    vec = left["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
    out: dict[str, list] = {c: [] for c in ("col", "num", "value", "tn", "t1")}
    for slot in range(vec.shape[1]):
        cuts = None if slot == EMP else right[f"c{slot}"][0].as_py()
        if not cuts:
            continue
        have = ~np.isnan(vec[:, slot])
        at = np.searchsorted(cuts, vec[have, slot], side="right")  # cut points at or below the value
        for name, w in (("tn", None), ("t1", y[have])):
            passed = np.bincount(at, weights=w, minlength=len(cuts) + 1)[::-1].cumsum()[-2::-1]
            out[name] += passed.astype(np.int64).tolist()
        out["col"] += [slot] * len(cuts)
        out["num"] += cuts
        out["value"] += [None] * len(cuts)
    emp = left.select(["emp", "label"]).group_by("emp").aggregate([("label", "count"), ("label", "sum")])
    out["col"] += [EMP] * len(emp)
    out["num"] += [None] * len(emp)
    out["value"] += emp["emp"].to_pylist()
    out["tn"] += emp["label_count"].to_pylist()
    out["t1"] += emp["label_sum"].to_pylist()
    m = len(out["col"])
    same = {"category": [key[0].as_py()] * m, "node": [key[1].as_py()] * m,
            "n": right["n"].to_pylist() * m, "n1": right["n1"].to_pylist() * m}
    types = {"category": pa.string(), "node": pa.string(), "col": pa.int32(), "num": pa.float64(), "value": pa.string()}
    return pa.table({c: pa.array(v, types.get(c, pa.int64())) for c, v in (same | out).items()})


def _splits(active: DataFrame, big: DataFrame, n: int, bins: int) -> DataFrame:
    """(category, node, n, n1, col, value, num, tn, t1) -- the best test of every big node, with null ``col`` where none
    parts its rows; ``tn`` rows pass it, and ``t1`` is the sum of their labels."""
    at = [i / bins for i in range(bins + 1)]
    cuts = active.groupBy(*KEYS).agg(*[
        F.array_distinct(F.percentile_approx(F.get("vec", F.lit(i)), at, 10000)).alias(f"c{i}")
        for i in range(len(config.VECTOR_SLOTS)) if i != EMP])
    parts = F.ceil(F.col("n") / F.lit(PART_ROWS)).cast("bigint")
    tests = materialize(_of(cuts, big, n, 128), "tree_cuts").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    mine = active.select(*KEYS, F.pmod("row", parts).alias("part"), "label", "vec", "emp")
    sides = (mine.groupBy(*KEYS, "part").cogroup(tests.groupBy(*KEYS, "part")).applyInArrow(_counter, SIDES)
             .groupBy(*KEYS, "n", "n1", "col", "num", "value").agg(F.sum("tn").alias("tn"), F.sum("t1").alias("t1"))
             .where("tn < n AND tn > 0"))
    fn, f1 = F.col("n") - F.col("tn"), F.col("n1") - F.col("t1")
    cost = ((F.col("tn") - F.col("t1")) * F.col("t1") / F.col("tn").cast("double")
            + (fn - f1) * f1 / fn.cast("double"))
    value = F.coalesce("value", F.col("num").cast("string")).alias("value")
    best = sides.groupBy(*KEYS).agg(F.min(F.struct(cost.alias("cost"), "col", "num", value, "tn", "t1")).alias("b"))
    right, on = _keyed(best)
    if n * 256 <= BROADCAST_BYTES:
        right = F.broadcast(right)
    return big.join(right, on, "left").select(*KEYS, "n", "n1", "b.col", "b.value", "b.num", "b.tn", "b.t1")


def _children(splits: DataFrame) -> DataFrame:
    """(category, node, n, n1) of both children of the split nodes."""
    def side(name, n, n1):
        return F.struct(F.concat("node", F.lit(name)).alias("node"), n.alias("n"), n1.alias("n1"))
    both = F.array(side("t", F.col("tn"), F.col("t1")),
                   side("f", F.col("n") - F.col("tn"), F.col("n1") - F.col("t1")))
    return splits.select("category", F.inline(both))


def _descend(active: DataFrame, splits: DataFrame, n: int, state: Column) -> DataFrame:
    """Rows of the split nodes, each moved to the child that its test takes it to, with the child's state; none of leaves."""
    rows = _of(active.drop("n"), splits.where("col IS NOT NULL"), n, 256)
    go = (F.when(F.col("col") == EMP, F.col("emp") == F.col("value"))
          .otherwise(F.coalesce(F.get("vec", F.col("col")) >= F.col("num"), F.lit(False))))
    rows = rows.withColumn("go", go).select(
        "category", F.concat("node", F.when(F.col("go"), "t").otherwise("f")).alias("node"), "label", "vec", "emp",
        F.when(F.col("go"), F.col("tn")).otherwise(F.col("n") - F.col("tn")).alias("n"),
        F.when(F.col("go"), F.col("t1")).otherwise(F.col("n1") - F.col("t1")).alias("n1"), "row")
    rows = rows.withColumn("state", state).where("state <> 'leaf'")
    return rows.select(*active.columns, "state")


def _best(vec: np.ndarray, emp: np.ndarray, y: np.ndarray):
    """(slot, threshold or employees code, mask of the rows that pass) of the least Gini cost, or None."""
    n, n1 = len(y), int(y.sum())
    found, least = None, np.inf

    def cost(tn, t1):
        fn, f1 = n - tn, n1 - t1
        return (tn - t1) * t1 / tn + (fn - f1) * f1 / fn

    for slot in range(vec.shape[1]):
        if slot == EMP:
            codes, tn = np.unique(emp, return_counts=True)
            if len(codes) < 2:
                continue
            c = cost(tn, np.array([y[emp == code].sum() for code in codes]))
            at = int(c.argmin())
            value = codes[at]
        else:
            have = np.flatnonzero(~np.isnan(vec[:, slot]))
            if not len(have):
                continue
            order = have[np.argsort(-vec[have, slot], kind="stable")]
            x = vec[order, slot]
            ends = np.append(np.flatnonzero(x[1:] != x[:-1]), len(x) - 1) + 1  # rows at or above each value
            ends = ends[ends < n]
            if not len(ends):
                continue
            c = cost(ends, np.cumsum(y[order])[ends - 1])
            at = len(c) - 1 - int(c[::-1].argmin())  # values fall, so the last of equals is the lowest
            value = x[ends[at] - 1]
        if c[at] < least:
            least, found = c[at], (slot, value)
    if found is None:
        return None
    slot, value = found
    return slot, value, emp == value if slot == EMP else np.nan_to_num(vec[:, slot], nan=-np.inf) >= value


def _best_cut(vec: np.ndarray, emp: np.ndarray, y: np.ndarray, bins: int):
    """As ``_best``, with numbers cut at their quantiles only."""
    n, n1 = len(y), int(y.sum())
    found, least = None, np.inf
    for slot in range(vec.shape[1]):
        if slot == EMP:
            cuts = np.unique(emp)
            tn, t1 = np.bincount(emp)[cuts], np.bincount(emp, weights=y)[cuts].astype(np.int64)
        else:
            x = vec[:, slot]
            have = np.flatnonzero(~np.isnan(x))
            if not len(have):
                continue
            order = have[np.argsort(x[have], kind="stable")]
            x = x[order]
            at = np.maximum(np.ceil(np.arange(bins + 1) / bins * len(x)).astype(np.int64), 1) - 1
            cuts = np.unique(x[at])
            below = np.searchsorted(x, cuts, side="left")
            ones = np.concatenate([[0], np.cumsum(y[order])])
            tn, t1 = len(x) - below, ones[-1] - ones[below]
        some = (tn > 0) & (tn < n)
        cuts, tn, t1 = cuts[some], tn[some], t1[some]
        if not len(cuts):
            continue
        fn, f1 = n - tn, n1 - t1
        c = (tn - t1) * t1 / tn + (fn - f1) * f1 / fn
        at = int(c.argmin())
        if c[at] < least:
            least, found = c[at], (slot, cuts[at])
    if found is None:
        return None
    slot, value = found
    return slot, value, emp == value if slot == EMP else np.nan_to_num(vec[:, slot], nan=-np.inf) >= value


def _parter(max_depth: int, min_rows: int, task_rows: int, bins: int):
    def part(key: tuple, rows: pa.Table) -> pa.Table:
        """Rows of a node -> its tests and leaves down to small nodes, and the rows of those."""
        y = rows["label"].to_numpy().astype(np.int64)
        vec = rows["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        coded = rows["emp"].combine_chunks().dictionary_encode()
        names, emp = np.unique(np.array(coded.dictionary.to_pylist(), dtype=object), return_inverse=True)
        emp = emp[coded.indices.to_numpy()]
        nodes: list[tuple] = []
        kept: list[tuple[str, np.ndarray]] = []
        stack = [(key[1].as_py(), np.arange(len(y)))]
        while stack:
            path, mine = stack.pop()
            n, n1 = len(mine), int(y[mine].sum())
            best = None
            if 0 < n1 < n and len(path) <= max_depth and n >= min_rows:
                if n <= task_rows:
                    kept.append((path, mine))
                    continue
                best = _best_cut(vec[mine], emp[mine], y[mine], bins)
            if best is None:
                nodes.append((path, -1, None, None, n - n1, n1))
                continue
            slot, value, passed = best
            nodes.append((path, slot, None if slot == EMP else float(value),
                          str(names[value]) if slot == EMP else None, None, None))
            stack += [(path + "t", mine[passed]), (path + "f", mine[~passed])]
        m = len(nodes)
        made = dict(zip(("node", "col", "num", "value", "n0", "n1"), zip(*nodes, strict=True), strict=True))
        some = rows.take(np.concatenate([np.zeros(0, np.int64), *[mine for _, mine in kept]]))
        paths = pa.array([path for path, _ in kept], pa.string())
        at = np.repeat(np.arange(len(kept)), np.array([len(mine) for _, mine in kept], np.int64))
        schema = pa.schema([("category", pa.string()), ("node", pa.string()), ("kind", pa.string()), ("label", pa.int32()),
                            ("vec", pa.list_(pa.float64())), ("emp", pa.string()), ("col", pa.int32()),
                            ("num", pa.float64()), ("value", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())])
        held = {"node": paths.take(pa.array(at)), "label": some["label"], "vec": some["vec"], "emp": some["emp"]}
        tables = []
        for kind, count, cols in (("node", m, made), ("row", len(at), held)):
            cols |= {"category": [key[0].as_py()] * count, "kind": [kind] * count}
            tables.append(pa.table([cols[f.name].cast(f.type) if isinstance(cols.get(f.name), pa.ChunkedArray)
                                    else pa.array(cols.get(f.name, [None] * count), f.type) for f in schema], schema=schema))
        return pa.concat_tables(tables).combine_chunks()
    return part


def _finisher(max_depth: int, min_rows: int):
    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        category = pdf["category"].iloc[0]
        vec = np.array([np.asarray(v, dtype=float) for v in pdf["vec"]])
        names, emp = np.unique(pdf["emp"].to_numpy(dtype=str), return_inverse=True)
        y = pdf["label"].to_numpy(dtype=np.int64)
        out, stack = [], [(pdf["node"].iloc[0], np.arange(len(y)))]
        while stack:
            path, rows = stack.pop()
            n, n1 = len(rows), int(y[rows].sum())
            best = None
            if 0 < n1 < n and len(path) <= max_depth and n >= min_rows:
                best = _best(vec[rows], emp[rows], y[rows])
            if best is None:
                out.append((category, path, -1, None, n - n1, n1))
                continue
            slot, value, passed = best
            out.append((category, path, slot, str(names[value]) if slot == EMP else repr(float(value)), None, None))
            stack += [(path + "t", rows[passed]), (path + "f", rows[~passed])]
        table = pd.DataFrame(out, columns=["category", "node", "col", "value", "n0", "n1"])
        return table.astype({"n0": "Int64", "n1": "Int64"})
    return finish
