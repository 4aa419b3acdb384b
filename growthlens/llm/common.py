"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(docs: DataFrame, col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(docs[col].cast("string"), F.lit(""))


def numbered(df: DataFrame, name: str, rid: str = "rid") -> DataFrame:
    """``df`` written once with a unique number for each row, and read back: the numbers are stable from there on."""
    return materialize(df.withColumn(rid, F.monotonically_increasing_id()), name)


def row_key(doc_id: Column, sha: Column) -> Column:
    """Names a row by its id and its whole text; repeated rows share it."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), sha)


def take_rows(docs: DataFrame, kept: DataFrame, copies: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text_sha256) is in ``kept``; of repeated rows the least one.

    Rows go through one shuffle by that key.  ``copies`` names a column of ``kept`` with the number of times that the
    row comes out.  All columns of ``docs`` pass unchanged, whatever their names.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        row_key(docs["doc_id"], F.sha2(text_of(docs), 256)).alias("key"))
    keys = kept.groupBy(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key")).agg(
        F.sum(copies if copies else F.lit(1)).alias("copies"))
    if copies:
        hits = keyed.join(keys, "key").groupBy("key").agg(F.min("row").alias("row"), F.max("copies").alias("copies"))
        hits = hits.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    else:
        hits = keyed.join(keys, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row"))
    return hits.select("row.*")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of mapInArrow, which returns freed memory to the system when its partition ends: Spark keeps the Python
    workers, and what one stage has freed would add to the needs of the stages after it."""
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
            if trim:
                trim(0)
    return wrapped
