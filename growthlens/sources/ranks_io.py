"""Export / import of the per-category rankings.

The exported form is the service's ``{category: [{p, s}, ...]}`` object,
sharded one category per line.  Each category holds at most k entries, so
``collect_list`` per category is bounded by k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def export_ranks(topk: DataFrame, path: str) -> str:
    """Write (category, rank, p, s) rows as keyed JSON lines, best first."""
    per_cat = (topk.groupBy("category")
               .agg(F.sort_array(F.collect_list(F.struct("rank", "p", "s"))).alias("_l"))
               .select("category", F.transform("_l", lambda x: F.struct(x["p"].alias("p"), x["s"].alias("s")))
                       .alias("entries")))
    per_cat.select(F.to_json(F.create_map("category", "entries")).alias("value")).write.mode("overwrite").text(path)
    return path


def import_ranks(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Read rankings back as (category, rank, p, s); rank = 1 + position,
    re-derived from the scores so heap-ordered input also ranks right."""
    reader = spark.read.option("wholetext", "true") if whole_file else spark.read
    m = reader.text(path).select(
        F.from_json("value", T.MapType(T.StringType(), T.ArrayType(schemas.RANK_ENTRY))).alias("m"))
    rows = (m.select(F.explode("m").alias("category", "entries"))
            .select("category", F.array_sort(
                "entries", lambda a, b: F.when(a["s"].isNull() & b["s"].isNotNull(), 1)
                .when(a["s"].isNotNull() & b["s"].isNull(), -1)
                .when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1)
                .when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0)).alias("entries")))
    return (rows.select("category", F.posexplode("entries").alias("pos", "e"))
            .select("category", (F.col("pos") + 1).cast("bigint").alias("rank"),
                    F.col("e.p").alias("p"), F.col("e.s").alias("s")))
