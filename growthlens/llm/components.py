"""Connected components of an undirected graph given as a table of edges, with joins only.

A round hooks each node to the least of itself and its neighbours, follows the hooks to their ends by doubling, and
contracts the edges: both ends become their nodes' ends, and edges inside one end and repeated ones drop out.  Every node
that still has an edge is hooked or hooked to, so each round at least halves their number, and an edge is joined only as
long as it connects two parts.  Tables lie in the shared folder; only whether a table has rows comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BLOCK = 500


def connected(edges: DataFrame, name: str) -> DataFrame:
    """edges (a, b) -> (node, label) for each node that has an edge; label is the least node of its component."""
    tidy = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(tidy(edges), f"{name}-edges")
    labels, step = None, 0
    while labels is None or edges.limit(1).count():
        step += 1
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
        ends = materialize(both.groupBy("node").agg(F.min("other").alias("least")).select(
            "node", F.least("node", "least").alias("label")), f"{name}-hooks{step}")
        moved = True
        while moved:
            far = ends.select(F.col("node").alias("label"), F.col("label").alias("far"))
            ends = materialize(ends.join(far, "label"), f"{name}-ends{step}")
            moved = ends.where("far <> label").limit(1).count()
            ends = ends.select("node", F.col("far").alias("label"))
        if labels is None:
            labels = ends
        else:
            on = ends.select(F.col("node").alias("label"), F.col("label").alias("far"))
            labels = materialize(labels.join(on, "label", "left").select("node", F.coalesce("far", "label").alias("label")),
                                 f"{name}-labels{step}")
        to = lambda x: ends.select(F.col("node").alias(x), F.col("label").alias(f"{x}_end"))  # noqa: B023, E731
        edges = materialize(tidy(edges.join(to("a"), "a").join(to("b"), "b").select(
            F.col("a_end").alias("a"), F.col("b_end").alias("b"))), f"{name}-edges{step}")
    return labels


def across(rest: DataFrame, data: DataFrame, links: Callable[[pa.Table], pa.Table], schema: str, name: str) -> DataFrame:
    """Confirmed links between different labels among the bucket members ``rest`` (bucket, cid, label).

    Families are the components of the buckets, so every pair in question lies inside one.  A family is cut into blocks
    of about ``BLOCK`` members; members of a label that fills blocks by itself get blocks of their own.  Each pair of
    blocks (but two of the same label) is one bounded group, which ``links`` compares inside a task: it gets the rows
    (cid, label and the columns of ``data``) and gives the links that join two labels for the first time.
    """
    heads = rest.groupBy("bucket").agg(F.min("cid").alias("a"))
    families = connected(rest.join(heads, "bucket").select("a", F.col("cid").alias("b")), f"{name}-families")
    nodes = rest.select("cid", "label").distinct().join(families.select(
        F.col("node").alias("cid"), F.col("label").alias("family")), "cid")
    nodes = materialize(nodes, f"{name}-members")
    of_label = nodes.groupBy("family", "label").agg(F.count(F.lit(1)).alias("members"))
    part = F.when(F.col("members") >= BLOCK, F.col("label")).otherwise(F.lit(-1))
    of_part = of_label.groupBy("family", part.alias("part")).agg(F.sum("members").alias("in_part"))
    nodes = nodes.join(of_label, ["family", "label"]).withColumn("part", part).join(of_part, ["family", "part"])
    nodes = nodes.select("cid", "label", "family", "part", F.pmod(
        F.xxhash64("cid"), F.ceil(F.col("in_part") / BLOCK)).alias("block"))
    nodes = materialize(nodes, f"{name}-blocks")
    blocks = nodes.select("family", "part", "block").distinct()
    x, y = (blocks.select("family", F.struct("part", "block").alias(c)) for c in "xy")
    groups = x.join(y, "family").where("x <= y and (x = y or x.part <> y.part or x.part = -1)")
    groups = groups.where("not (x = y and x.part <> -1)").select("family", F.struct("family", "x", "y").alias("task"),
                                                                 F.explode(F.array_distinct(F.array("x", "y"))).alias("at"))
    held = nodes.join(groups.select("task", "family", "at.part", "at.block"), ["family", "part", "block"])
    held = held.select("task", "cid", "label").join(data, "cid")
    return held.groupBy("task").applyInArrow(links, schema)
