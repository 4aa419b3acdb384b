"""Keyed JSON objects (S1 company index, S2 category baselines, S8 ranks).

The service keeps each of these as one JSON object ``{key: value, ...}``.
One giant object cannot be split across tasks, so the writer shards it: every
line is a small keyed object, and the reader parses each line with
``from_json(map<string, value>)`` + ``explode``.  A classic single-object
file reads the same way with ``whole_file=True`` (meant for small files);
``read_keyed_object`` reads one of any size with many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize


def write_keyed(df: DataFrame, key: str, value_cols: list[str], path: str) -> str:
    """One ``{"<key>": {<value_cols>}}`` object per line."""
    line = F.to_json(F.create_map(F.col(key), F.struct(*value_cols)))
    df.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def read_keyed(spark: SparkSession, path: str, value_schema: T.DataType, key_name: str = "key",
               whole_file: bool = False) -> DataFrame:
    """Rows ``(key, value.*)`` of keyed JSON objects (one per line, or one
    per file with ``whole_file``)."""
    reader = spark.read.option("wholetext", "true") if whole_file else spark.read
    text = reader.text(path)
    parsed = text.select(F.from_json("value", T.MapType(T.StringType(), value_schema)).alias("m"))
    return (parsed.select(F.explode("m").alias(key_name, "v"))
            .select(key_name, "v.*"))


def read_keyed_object(spark: SparkSession, path: str, value_schema: T.DataType, key_name: str = "key",
                      close: str = "}") -> DataFrame:
    """Rows ``(key, value)`` of files that each hold one keyed object of any size, read by many tasks.

    ``close`` is the character that ends a value: ``}`` for objects (S1, S2), ``]`` for arrays (S8). The text source cuts
    at that character, wherever a split begins, so what it returns are pieces of entries. Whether a piece starts inside a
    string, and how deep, follows from the pieces before it: quotes and brackets are added up piece by piece inside each
    block of a file, and block by block in one row each. A value ends where the depth falls back to one outside a string;
    the pieces of an entry, of which a block boundary may lie between any two, are then put together and parsed.

    White space between entries is allowed; an empty object and an empty file give no rows, and a null value and values
    of another type than ``value_schema`` give what ``from_json`` makes of them together with the entry that they stand
    before."""
    opens, closes = r"[\[{]", r"[\]}]"
    plain = F.split(F.regexp_replace("value", r"\\.", ""), '"')

    def depth(odd: int) -> Column:
        """Brackets opened less closed in the parts of a piece with even (0) or odd (1) number."""
        parts = F.filter(plain, lambda _, i: i % 2 == odd)
        text = F.array_join(parts, "")
        return F.regexp_count(text, F.lit(opens)) - F.regexp_count(text, F.lit(closes))

    pieces = (spark.read.option("lineSep", close).text(path)
              .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("at"), "value", (F.size(plain) - 1).alias("quotes"),
                      depth(0).alias("even"), depth(1).alias("odd")))
    block = Window.partitionBy("file", "block").orderBy("at")
    upto, before = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(Window.unboundedPreceding, -1)
    blocks_before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    # what a piece does if its block starts outside (0) or inside (1) a string; its closing character counts outside only
    seen = pieces.withColumn("q", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    for start in (0, 1):
        inside = (F.col("q") + start) % 2 == 1
        ends_inside = (F.col("q") + start + F.col("quotes")) % 2 == 1
        step = F.when(inside, F.col("odd")).otherwise(F.col("even")) - F.when(ends_inside, 0).otherwise(1)
        seen = seen.withColumn(f"depth{start}", F.sum(step).over(upto)).withColumn(f"closed{start}", ~ends_inside)
    seen = materialize(seen.drop("even", "odd", "q"), "keyed-pieces")

    totals = seen.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.max_by("depth0", "at").alias("depth0"), F.max_by("depth1", "at").alias("depth1"))
    starts = totals.withColumn("inside", F.coalesce(F.sum("quotes").over(blocks_before), F.lit(0)) % 2 == 1)
    starts = starts.withColumn("down", F.coalesce(F.sum(
        F.when(F.col("inside"), F.col("depth1")).otherwise(F.col("depth0"))).over(blocks_before), F.lit(0)))
    here = seen.join(starts.select("file", "block", "inside", "down"), ["file", "block"])
    last = F.when(F.col("inside"), F.col("closed1") & (F.col("depth1") + F.col("down") == 1)) \
        .otherwise(F.col("closed0") & (F.col("depth0") + F.col("down") == 1))
    marked = here.select("file", "block", "at", "value", last.alias("last"))
    marked = materialize(marked.withColumn("n", F.coalesce(F.sum(F.col("last").cast("int")).over(before), F.lit(0))),
                         "keyed-marked")

    ended = marked.groupBy("file", "block").agg(F.sum(F.col("last").cast("bigint")).alias("ended"))
    first = ended.select("file", "block", F.coalesce(F.sum("ended").over(blocks_before), F.lit(0)).alias("first"))
    entries = (marked.join(first, ["file", "block"]).groupBy("file", (F.col("first") + F.col("n")).alias("entry"))
               .agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("parts"),
                    F.max("last").alias("whole")).where("whole"))
    text = F.concat(F.array_join(F.col("parts.value"), close), F.lit(close))
    one = F.concat(F.lit("{"), F.regexp_replace(text, r"^\s*[{,]\s*", ""), F.lit("}"))
    parsed = entries.select(F.from_json(one, T.MapType(T.StringType(), value_schema)).alias("m"))
    return parsed.select(F.explode("m").alias(key_name, "value"))
