"""The corpus pipeline: language ID, exact and near deduplication, mixing, packing.

``STAGES`` lists the stages in order.  Each takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet in the shared folder and reread as the next stage's docs.  All but the last return the columns of documents.
Nulls, empty and very long texts, ties, repeated rows, empty tables and further columns are handled as the operators
define; a stage that keeps one of several equal rows keeps exactly one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from growthlens.llm import exact_dedup, langid, minhash, mixing, packing
from growthlens.llm.common import documents, tokenizer_file
from growthlens.session import materialize

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
TOKENIZER = "byte_bpe_50k.json"
#: Smaller than the operator's own: the executors' heaps have grown in the stages before.
MEMO_PIECES = 120_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go (operator 4)."""
    return langid.drop_rejected(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays (operator 1)."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least doc_id stays (operator 3)."""
    return minhash.drop_near_copies(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the sources' targets takes it (operator 10)."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in packed sequences (operator 7)."""
    return packing.digest(packing.pack(docs, tokenizer_file(TOKENIZER), memo=MEMO_PIECES))


STAGES = [("language_id", language_id), ("exact_copies", exact_copies), ("near_copies", near_copies),
          ("mixture", mixture), ("sequences", sequences)]

#: Language ID, signatures and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
