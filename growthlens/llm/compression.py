"""Vector codes by product quantisation with member-resident Lloyd rounds (operator 11).

A vector's components become integers floor(``SCALE`` * x) and are cut into ``parts`` equal consecutive parts; each part
position has a codebook of at most ``entries`` entries, which starts as the parts of the smallest kept vec_ids.  A part
lives with the owner of its entry: the rows of a round are a table laid out by (position, entry, salt).  A round

1. assigns every resident part in place, without a shuffle, and writes those that keep their entry apart from those that
   change it;
2. moves only the changing ones to their new owners, in one shuffle by (position, entry, salt);
3. sums the residents inside their owners' tasks, so that a task gives one partial sum for each entry that it holds, and
   adds up the partial sums into the next codebooks.

The first placement moves every part.  The number of salts of an entry follows its count, so an owner has about
``OWNER_ROWS`` members however hot the entry is.  Only codebooks and counts (parts * entries * width numbers, whatever the
number of rows) come to the driver and go into the tasks.

All arithmetic is exact: distances are float64 sums of integers below 2^53, else 64-bit integers; components whose
squared distances do not fit those stop the run with an error, as ``error`` is a long.

Defined cases: rows whose vector is null or holds null, NaN or infinite components are dropped; a null vec_id comes after
all others; equal vec_ids are ordered by their vectors; repeated rows are each coded; fewer than ``entries`` kept rows
give fewer entries; the width is that of the first kept vector (by vec_id) whose length ``parts`` divides, and rows of
another length stay with null code and error, which no sum counts; empty vectors have parts of width 0 and error 0; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import numbered

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
OWNER_ROWS = 100_000
CELLS = 1 << 21
_PART = "rid bigint, position int, entry int, part array<bigint>"


def _integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as 64-bit integers."""
    y = np.floor(x.astype(np.float64) * SCALE)
    if y.size and np.abs(y).max() >= 2.0**62:
        raise ValueError("vector components are too large for exact distances")
    return y.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance) of each row; ties to the lower index."""
    most = max((int(np.abs(a).max()) for a in (x, book) if a.size), default=0)
    bound = max(1, x.shape[1]) * (2 * most) ** 2
    if bound >= 2**63:
        raise ValueError("vector components are too large for exact distances")
    best, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if bound < 2**53:
        step, b = max(1, CELLS // len(book)), book.astype(np.float64)
        for a in range(0, len(x), step):
            y = x[a:a + step].astype(np.float64)
            d = (y * y).sum(1)[:, None] - 2 * (y @ b.T) + (b * b).sum(1)
            best[a:a + step] = d.argmin(1)
            least[a:a + step] = d.min(1).astype(np.int64)
    else:
        for k in range(len(x)):
            d = ((book - x[k]) ** 2).sum(1)
            best[k], least[k] = d.argmin(), d.min()
    return best, least


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _parts_frame(rid: np.ndarray, position: int, entry: np.ndarray, x: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    width = x.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.reshape(-1)))
    cols = {"rid": pa.array(rid), "position": pa.array(np.full(len(x), position, np.int32)),
            "entry": pa.array(entry.astype(np.int32)), "part": lists, **{k: pa.array(v) for k, v in more.items()}}
    return pa.RecordBatch.from_pydict(cols)


def _place(books: list[np.ndarray]):
    """Vectors into parts with their first entries."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(_rows(batch.column("embedding"), width * len(books)))
            for p, book in enumerate(books):
                mine = np.ascontiguousarray(x[:, p * width:(p + 1) * width])
                yield _parts_frame(batch.column("rid").to_numpy(), p, nearest(mine, book)[0], mine)
    return run


def _by_position(batch: pa.RecordBatch, books: list[np.ndarray]):
    """(position, rows of the batch, their parts) for each position in the batch."""
    positions, x = batch.column("position").to_numpy(), _rows(batch.column("part"), books[0].shape[1])
    for p in np.unique(positions).tolist():
        spot = np.flatnonzero(positions == p)
        yield p, spot, x[spot]


def _reassign(books: list[np.ndarray]):
    """Each part's entry under new codebooks, and whether it changed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, was = batch.column("rid").to_numpy(), batch.column("entry").to_numpy()
            for p, spot, x in _by_position(batch, books):
                entry = nearest(x, books[p])[0]
                yield _parts_frame(rid[spot], p, entry, x, moved=entry != was[spot])
    return run


def _final(books: list[np.ndarray]):
    """Each part's last entry and its squared distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for p, spot, x in _by_position(batch, books):
                entry, error = nearest(x, books[p])
                yield pa.RecordBatch.from_pydict({"rid": rid[spot], "position": np.full(len(spot), p, np.int32),
                                                  "entry": entry.astype(np.int32), "error": error})
    return run


def _owner_sums(books: list[np.ndarray]):
    """One row for each entry with members in the task: their count and componentwise sum."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            entries = batch.column("entry").to_numpy()
            for p, spot, x in _by_position(batch, books):
                for e in np.unique(entries[spot]).tolist():
                    mine = x[entries[spot] == e]
                    got = held.setdefault((p, e), [0, np.zeros(width, np.int64)])
                    got[0] += len(mine)
                    got[1] += mine.sum(0)
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()),
                 pa.array([v[0] for v in held.values()], pa.int64()),
                 pa.array([v[1].tolist() for v in held.values()], pa.list_(pa.int64()))],
                names=["position", "entry", "n", "sums"])
    return run


def _updated(books: list[np.ndarray], residents: DataFrame) -> list[np.ndarray]:
    """The codebooks after a round: floor(sum / count) of the members, unused entries as they were."""
    partial = residents.select("position", "entry", "part").mapInArrow(
        _owner_sums(books), "position int, entry int, n bigint, sums array<bigint>")
    sums = partial.select("position", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy(
        "position", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toArrow()  # entries of codebooks only
    new = [b.copy() for b in books]
    for p, e, k, n, x in zip(*(sums.column(c).to_pylist() for c in ("position", "entry", "at", "n", "x")), strict=True):
        new[p][e, k] = x // n
    return new


def _moved(parts: DataFrame, name: str) -> DataFrame:
    """The parts at their new owners: (position, entry, salt) with as many salts as the entry's members need."""
    owners = parts.groupBy("position", "entry").agg(F.ceil(F.count(F.lit(1)) / OWNER_ROWS).alias("owners"))
    dealt = parts.join(F.broadcast(owners), ["position", "entry"])  # a row an entry of the codebooks, no more
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("rid"), "owners")).repartition("position", "entry", "salt")
    return materialize(dealt.select("rid", "position", "entry", "part"), name)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
          ) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks): rid, vec_id, label, code and error of each kept row, and each position's entries."""
    spark = vectors.sparkSession
    x = vectors["embedding"].cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    kept = numbered(vectors.where(x.isNotNull() & fine).select(
        vectors["vec_id"].cast("bigint").alias("vec_id"), vectors["label"].alias("label"), x.alias("embedding")),
        "op11-vectors")
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = kept.where(F.size("embedding") % parts == 0).orderBy(*order).select("embedding").first()
    if first is None:
        none = F.lit(None)
        return kept.select("rid", "vec_id", "label", none.cast("string").alias("code"), none.cast("bigint").alias("error")), []
    width = len(first.embedding) // parts
    vecs = kept.where(F.size("embedding") == width * parts)
    seeds = vecs.orderBy(*order).select("embedding").limit(entries).collect()
    seeds = _integers(np.array([r.embedding for r in seeds], np.float64).reshape(len(seeds), width * parts))
    books = [seeds[:, p * width:(p + 1) * width].copy() for p in range(parts)]

    placed = materialize(vecs.select("rid", "embedding").mapInArrow(_place(books), _PART), "op11-placed")
    residents = _moved(placed, "op11-round1")
    for r in range(rounds):
        books = _updated(books, residents)
        if r + 1 < rounds:
            folder = scratch_path(spark, f"op11-assigned{r + 2}")
            residents.mapInArrow(_reassign(books), _PART + ", moved boolean").write.partitionBy("moved").parquet(folder)
            got = spark.read.schema(_PART + ", moved boolean").parquet(folder)
            movers = _moved(got.where("moved"), f"op11-round{r + 2}")
            residents = got.where("not moved").drop("moved").unionByName(movers)

    last = residents.mapInArrow(_final(books), "rid bigint, position int, entry int, error bigint")
    digits = F.lower(F.lpad(F.hex("entry"), 2, "0"))
    codes = last.groupBy("rid").agg(
        F.concat(*[F.max(F.when(F.col("position") == p, digits)) for p in range(parts)]).alias("code"),
        F.sum("error").alias("error"))
    return materialize(kept.select("rid", "vec_id", "label").join(codes, "rid", "left"), "op11-coded"), books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def approximate(code: str, books: list[np.ndarray]) -> list[float]:
    """The vector that a code stands for."""
    picked = [b[int(code[2 * p:2 * p + 2], 16)] for p, b in enumerate(books)]
    return [float(v) / SCALE for v in np.concatenate(picked)]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept row of ``vectors`` (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = train(vectors, parts, entries, rounds)
    of_label = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "op11-labels")
    of_label = of_label.withColumnRenamed("label", "of")
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
