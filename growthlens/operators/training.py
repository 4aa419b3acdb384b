"""Per-category decision trees (M8) in the model-file shape the scorer reads
(``{col, value, tb, fb}`` / ``{col: -1, results}``).

Training data: every profiled company in each of its index categories; label
1 for acquired companies and acquirers.  The vector is the scorer's own,
with the employees label as an equality test (``tree_growth``), so a trained
tree classifies every training row as it was grown.
"""

from __future__ import annotations

import json
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classes import acquired_or_acquirer
from . import tree_growth
from . import trees as T
from .features import vector_columns

# paths of nodes with the true branch before the false one
BRANCHES = str.maketrans("tf", "ab")


def training_rows(features: DataFrame, company_category: DataFrame) -> DataFrame:
    """(category, label, vec, emp): one row per profiled company and index category."""
    lab = acquired_or_acquirer(F.col("is_acquired"), F.col("num_acquisitions")).cast("int").alias("label")
    mine = features.select("k", lab, *[c.alias(n) for n, c in vector_columns().items()])
    return mine.join(company_category.select("k", "category"), "k").select("category", "label", "vec", "emp")


def _nest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Node rows of one tree -> its model-file JSON text: the nodes' pieces in the order of their paths."""
    text = []
    rows = zip(pdf["node"], pdf["col"], pdf["value"], pdf["n0"], pdf["n1"], strict=True)
    for node, col, value, n0, n1 in sorted(rows, key=lambda r: r[0].translate(BRANCHES)):
        if col >= 0:
            text.append(f'{{"col":{int(col)},"value":{json.dumps(value)},"tb":')
            continue
        results = {c: int(n) for c, n in (("0", n0), ("1", n1)) if n > 0}
        ended = node.rstrip("f")  # a last false branch ends the node above it
        text += [json.dumps({"col": -1, "results": results}, separators=(",", ":")), "}" * (len(node) - len(ended)),
                 ',"fb":' if ended.endswith("t") else ""]
    return pd.DataFrame({"category": [pdf["category"].iloc[0]], "json": ["".join(text)]})


def tree_texts(rows: DataFrame, **growth) -> DataFrame:
    """One tree per category as (category, json), its model-file text.

    ``growth`` goes to ``tree_growth.grow``.  A model file is one object, so
    a tree's text is made in one task; trees of all sizes are written."""
    return tree_growth.grow(rows, **growth).groupBy("category").applyInPandas(_nest, "category string, json string")


def train_trees(rows: DataFrame, **growth) -> dict[str, str]:
    """The texts of ``tree_texts`` by category, gathered: for small models only."""
    return {r["category"]: r["json"] for r in tree_texts(rows, **growth).collect()}


def reproduced(predicted: DataFrame) -> DataFrame:
    """Per category of labelled, classified rows: labels, rows whose leaf holds only their label, and rows in leaves of both."""
    own = F.when(F.col("label") == 1, F.col("n1")).otherwise(F.col("n0"))
    other = F.when(F.col("label") == 1, F.col("n0")).otherwise(F.col("n1"))
    return predicted.groupBy("category").agg(
        F.count_if(F.col("label") == 0).alias("total_0"),
        F.count_if(F.col("label") == 1).alias("total_1"),
        F.count_if(own.isNotNull() & other.isNull()).alias("n_reproduced"),
        F.count_if(own.isNotNull() & other.isNotNull()).alias("n_mixed"))


def write_tree_files(spark: SparkSession, trees: dict[str, str], folder: str) -> str:
    """Write ``<category>.json`` files through the Hadoop FileSystem API, so
    the folder may live on any shared file system."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(conf)
    for cat, text in trees.items():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(base, cat + ".json"), True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
    return folder


def write_tree_texts(texts: DataFrame, folder: str) -> str:
    """Write the texts of (category, json) as ``<category>.json`` files: tasks write them, so that no text reaches the
    driver, which then gives each file its name."""
    spark = texts.sparkSession
    at = folder.rstrip("/") + "-texts"
    # the writer ends each text by a separator: here its own last brace
    texts.select(F.substring("json", F.lit(1), F.length("json") - 1).alias("value"),
                 F.concat(F.lit("="), "category").alias("name")).write.partitionBy("name").option(
        "lineSep", "}").text(at)
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(base)
    for made in fs.listStatus(jvm.org.apache.hadoop.fs.Path(at)):
        if not made.isDirectory():
            continue
        name = unquote(made.getPath().getName().removeprefix("name="))
        if not name.startswith("="):
            raise ValueError("a tree of the null category has no file name")
        texts_of = [f.getPath() for f in fs.listStatus(made.getPath()) if f.getPath().getName().startswith("part-")]
        if len(texts_of) != 1:
            raise ValueError(f"{len(texts_of)} trees of one category")
        if not fs.rename(texts_of[0], jvm.org.apache.hadoop.fs.Path(base, name[1:] + ".json")):
            raise OSError(f"no file {name[1:]}.json was made in {folder}")
    return folder


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Total size of the files under ``folder`` from the file system's
    metadata (no Spark job)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(path).getLength())


def load_tree_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The reading half of S3: (category, json) for every ``<category>.json`` in ``folder``.

    The category is the file name without ``.json``; the metadata file name
    is percent-encoded while a literal ``+`` stays as is, so ``+`` is
    protected before decoding."""
    raw = (spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(folder)
           .select(F.col("_metadata.file_name").alias("fname"), F.col("value").alias("json")))
    name = F.regexp_replace(F.col("fname"), r"\.json$", "")
    return raw.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("category"), "json")


def load_trees(spark: SparkSession, folder: str) -> DataFrame:
    """S3: every model file of ``folder`` read and parsed into its tree, as ``trees.PACKED_SCHEMA``.  A file that holds no
    tree stops the run."""
    return T.pack_trees(load_tree_texts(spark, folder), folder_bytes(spark, folder))
