"""Exact duplicates by deterministic block naming (operator 1).

A text is cut into blocks of ``block_bytes`` bytes of UTF-8.  The distinct blocks are sorted and each gets an integer
name.  Then adjacent names are paired, the distinct pairs are sorted and named in turn, and so on until one name is left
for each text: two texts of as many levels have the same last name exactly if they are the same bytes.  Names are given
to compared contents, not to hashes, so they cannot collide; the SHA-256 of a block only carries its name back to the
rows, and a run in which one digest had two blocks would stop with an error.

Cost: one shuffle of the text (the distinct blocks, combined on the map side, so a text that a third of the rows share
goes through once per task), then integers only; the number of rounds is the logarithm of the longest text's blocks.

Defined cases: a null text counts as empty; empty texts are one group; of equal texts the row with the largest doc_id
stays (a null doc_id is the smallest); of repeated rows with that doc_id exactly one stays; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import numbered, take_rows, text_of

BLOCK_BYTES = 4096


def _named(parts: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Distinct rows of ``parts``, sorted within their partition, each with an integer name; written once."""
    return parts.distinct().sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id())


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    cut = docs.select(docs["doc_id"], text_of(docs).cast("binary").alias("raw"))
    cut = cut.withColumn("n", F.greatest(F.lit(1), F.ceil(F.length("raw") / block_bytes)).cast("int"))
    last = F.col("n") - 1
    blocks = F.transform(F.sequence(F.lit(0), last),
                         lambda i: F.substring(F.col("raw"), i * block_bytes + 1, F.lit(block_bytes)))
    sha = F.sha2("raw", 256)
    digests = F.when(F.col("n") == 1, F.array(F.unhex(sha))).otherwise(
        F.transform(blocks, lambda b: F.unhex(F.sha2(b, 256))))
    rows = numbered(cut.select("doc_id", sha.alias("text_sha256"), "n", digests.alias("digests")), "op1-rows")

    first = _named(cut.select(F.explode(blocks).alias("block")), ["block"], "op1-blocks")
    names = materialize(first.select(F.unhex(F.sha2("block", 256)).alias("digest"), "name"), "op1-names")
    if names.groupBy("digest").count().where("count > 1").limit(1).count():
        raise RuntimeError("two different blocks share a SHA-256 digest")

    slots = rows.select("rid", "n", F.posexplode("digests").alias("pos", "digest")).join(names, "digest")
    here = materialize(slots.select("rid", "n", "pos", "name"), "op1-level0")
    ready = [here.where("n = 1").select("rid", F.lit(0).alias("level"), "name")]
    longest = rows.agg(F.max("n")).first()[0] or 1
    level = 0
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = here.where("n > 1").groupBy("rid", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max("n").alias("n"), F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = materialize(pairs, f"op1-pairs{level}")
        names = materialize(_named(pairs.select("a", "b"), ["a", "b"], "op1"), f"op1-names{level}")
        here = pairs.join(names, ["a", "b"]).select(
            "rid", ((F.col("n") + 1) / 2).cast("int").alias("n"), "pos", "name")
        ready.append(here.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
    final = ready[0]
    for more in ready[1:]:
        final = final.unionByName(more)
    final = materialize(rows.select("rid", "doc_id", "text_sha256").join(final, "rid"), "op1-final")
    groups = materialize(final.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "rid")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "op1-groups")
    return final.join(groups, ["level", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"),
        "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns pass unchanged."""
    return take_rows(docs, exact_dedup(docs).where("kept"))
