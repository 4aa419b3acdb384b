"""Near duplicates by a multi-index Hamming join over MinHash signatures (operator 3).

Documents with equal shingle sets form one class, and only classes are compared.  A class has ``SYMBOLS`` MinHash values
of 16 bits, packed into ``CHUNKS`` chunks of four.  Two signatures that differ in at most ``MAX_DISTANCE`` =
2 * CHUNKS - 1 symbols have, by the pigeonhole principle, a chunk with at most one differing symbol.  So each chunk is
indexed four times, each time with another symbol masked out (the allowed errors, enumerated), and every pair within
that distance shares a bucket.  At a similarity of 0.8 a symbol differs with probability 0.2: the distance has mean 12.8
and passes 31 with a probability below 1e-6.  A second, 1-bit signature of ``SKETCH`` hashes (kept if at most
``MAX_BITS`` differ; mean 25.6, deviation 4.8 at 0.8) tests bucket members cheaply.  Links are confirmed on full sets.

Only the connectivity of links is asked for, so no group is expanded into pairs:

1. classes without any bucket partner within the sketch distance drop out (a left-semi join: one row a class and bucket);
   the texts of the others are fetched once and their sets written;
2. each bucket links its members to its least member, confirmed on the sets; components of these links;
3. the exact way for the rest: members that still have a bucket partner in another component are compared on full sets,
   in pairs of blocks of bounded size inside tasks; pairs inside one component need no comparison.

Nothing is capped; skewed buckets are split by the adaptive skew join.  Shingles are represented by 64-bit hashes.

Defined cases: null or empty texts and texts without words have no shingles, are linked with nothing and are kept; fewer
words than a shingle make one shingle; repeated rows are one class; among rows the least doc_id of a component names it
(null only if all its ids are null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import shingles
from .common import giving_back, numbered, take_rows, text_of
from .components import across, connected

SYMBOLS = 64
CHUNKS = 16
MAX_DISTANCE = 2 * CHUNKS - 1
SKETCH = 256
MAX_BITS = 52
SEED = 11
_MASKS = np.array([2**64 - 1 - (0xFFFF << (16 * j)) for j in range(4)], np.uint64).view(np.int64).tolist()
_SIG = [f"s{i}" for i in range(CHUNKS)]
_BITS = [f"b{i}" for i in range(SKETCH // 64)]
_SCHEMA = "doc_id bigint, text_sha256 string, n bigint, h1 bigint, h2 bigint, " + ", ".join(
    f"{c} bigint" for c in _SIG + _BITS)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = shingles.multipliers32(SKETCH, SEED)
        for batch in batches:
            texts = batch.column("text")
            n = len(texts)
            count, key = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
            least = np.zeros((n, SKETCH), np.uint32)
            for k in range(n):
                s = shingles.shingle_set(texts[k].as_py(), size)
                count[k] = len(s)
                if len(s):
                    key[k] = shingles.set_key(s)
                    least[k] = shingles.least(s, mult)
            sig = np.ascontiguousarray((least[:, :SYMBOLS] >> 8).astype(np.uint16)).view(np.int64)
            bits = np.packbits((least >> 7) & 1, axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_sha256"), pa.array(count), pa.array(key[:, 0]),
                 pa.array(key[:, 1]), *[pa.array(sig[:, i]) for i in range(CHUNKS)],
                 *[pa.array(bits[:, i]) for i in range(bits.shape[1])]],
                names=["doc_id", "text_sha256", "n", "h1", "h2", *_SIG, *_BITS])
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            got = [shingles.shingle_set(texts[k].as_py(), size) for k in range(len(texts))]
            keys = [shingles.set_key(s) for s in got]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([s.tobytes() for s in got], pa.binary())], names=["h1", "h2", "grams"])
    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size of the intersection of two sorted sets."""
    for batch in batches:
        a, b = batch.column("grams_a"), batch.column("grams_b")
        both = [len(np.intersect1d(np.frombuffer(a[k].as_buffer(), np.uint64), np.frombuffer(b[k].as_buffer(), np.uint64),
                                   assume_unique=True)) for k in range(len(a))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), batch.column("n_a"), batch.column("n_b"), pa.array(both, pa.int64())],
            names=["a", "b", "n_a", "n_b", "both"])


def _distance(a: str, b: str) -> Column:
    """Number of differing 16-bit symbols of two signatures."""
    total = F.lit(0)
    for c in _SIG:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        for k in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
    return total


def _bits(a: str, b: str) -> Column:
    total = F.lit(0)
    for c in _BITS:
        total = total + F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return total


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    one = lambda x: sets.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("grams").alias(f"grams_{x}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    both = both.where(F.least("n_a", "n_b") * 100 >= percent * F.greatest("n_a", "n_b"))
    got = both.mapInArrow(giving_back(_common), "a bigint, b bigint, n_a bigint, n_b bigint, both bigint")
    return got.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, text_sha256 and label, which is of one component
    only and null for rows without shingles."""
    if percent < 80:
        raise ValueError("the signature distances are proven for a similarity of 0.8 or more")
    text = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    shas = text.withColumn("text_sha256", F.sha2("text", 256))
    rows = materialize(shas.mapInArrow(giving_back(_signatures(size)), _SCHEMA), "op3-rows")
    classes = rows.where("n > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("doc_id"), *[F.max(c).alias(c) for c in ["n", *_SIG, *_BITS]])
    classes = numbered(classes, "op3-classes", "cid")

    # the index: a bucket for each chunk and masked symbol
    index = F.array(*[F.xxhash64(F.lit(4 * i + j), F.col(c).bitwiseAND(F.lit(m)))
                      for i, c in enumerate(_SIG) for j, m in enumerate(_MASKS)])
    entries = classes.select("cid", *_BITS, F.explode(index).alias("bucket"))
    shared = classes.select("cid", F.explode(index).alias("bucket")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"), F.min("cid").alias("least")).where("members > 1").select("bucket", "least")
    entries = materialize(entries.join(shared, "bucket"), "op3-entries")
    near = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.cid") != F.col("y.cid")) & (_bits("x", "y") <= MAX_BITS)
    entries = materialize(entries.alias("x").join(entries.alias("y"), near, "left_semi"), "op3-near")

    # the shingle sets of the classes that are left
    wanted = classes.join(entries.select("cid").distinct(), "cid", "left_semi")
    ids = wanted.select(F.col("doc_id").alias("wanted")).distinct()
    texts = text.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    sets = texts.mapInArrow(giving_back(_sets(size)), "h1 bigint, h2 bigint, grams binary")
    sets = materialize(wanted.select("cid", "n", "h1", "h2").join(sets, ["h1", "h2"]).groupBy("cid").agg(
        F.max("n").alias("n"), F.max("grams").alias("grams")), "op3-sets")

    # each bucket's members against its least member
    star = entries.where("cid <> least").select(F.col("least").alias("a"), F.col("cid").alias("b")).distinct()
    sig = classes.select("cid", *_SIG)
    star = star.join(sig.alias("p"), F.col("a") == F.col("p.cid")).join(sig.alias("q"), F.col("b") == F.col("q.cid")) \
        .where(_distance("p", "q") <= MAX_DISTANCE).select("a", "b")
    links = materialize(_confirmed(star, sets, percent), "op3-star")
    labels = connected(links, "op3-star")

    # the rest: bucket partners in other components, by their rarest shingles
    named = entries.select("cid", "bucket", *_BITS).join(labels.withColumnRenamed("node", "cid"), "cid", "left") \
        .withColumn("label", F.coalesce("label", "cid"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    named = materialize(named.join(mixed.select("bucket"), "bucket"), "op3-mixed")
    apart = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") != F.col("y.label")) & (
        _bits("x", "y") <= MAX_BITS)
    rest = materialize(named.alias("x").join(named.alias("y"), apart, "left_semi").select("bucket", "cid", "label"),
                       "op3-rest")
    more = materialize(_across(rest, sets, percent), "op3-more")
    if more.limit(1).count():
        labels = connected(links.union(more), "op3-all")

    known = classes.select("cid", "h1", "h2", F.col("doc_id").alias("first")).join(
        labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    names = known.groupBy("label").agg(F.min("first").alias("component_id"))
    known = materialize(known.select("h1", "h2", "label").join(names, "label").select("h1", "h2", "component_id", "label"),
                        "op3-known")
    out = rows.where("n > 0").select("doc_id", "n", "text_sha256", "h1", "h2").join(known, ["h1", "h2"]).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "text_sha256", "label")
    lone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                                      "text_sha256", F.lit(None).cast("bigint").alias("label"))
    return out.unionByName(lone)


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, text_sha256."""
    return _components(docs, size, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(
        F.col("component_id")).alias("kept"), "text_sha256")


def _across(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different labels among the bucket members ``rest`` (bucket, cid, label), confirmed on full sets."""
    def links(table: pa.Table) -> pa.Table:
        labels, cids = table.column("label").to_pylist(), table.column("cid").to_pylist()
        got = [np.frombuffer(g.as_buffer(), np.uint64) for g in table.column("grams")]
        pairs = shingles.joined(got, labels, percent)
        return pa.table({"a": pa.array([cids[i] for i, _ in pairs], pa.int64()),
                         "b": pa.array([cids[j] for _, j in pairs], pa.int64())})

    return across(rest, sets, links, "a bigint, b bigint", "op3")


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component of near duplicates, that of the least doc_id (null last), then of the least
    text hash; all columns pass unchanged."""
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"),
                           F.col("text_sha256").alias("text_sha256"))).alias("least")
    lone = F.when(F.col("label").isNull(), F.struct("doc_id", "text_sha256")).alias("lone")
    kept = _components(docs, size, percent).groupBy("label", lone).agg(least)
    return take_rows(docs, kept.select("least.doc_id", "least.text_sha256"))
