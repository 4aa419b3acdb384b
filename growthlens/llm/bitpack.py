"""Token ids as fixed-width bit-packed files (operator 5).

Documents are range-partitioned by ascending doc_id; every partition encodes its texts, appends the end id to each and
writes one shard file to a shared folder:

    magic "GLBITS1\\n", then blocks of ``BLOCK_IDS`` ids, each id in ``width`` bits, least significant bit first, the
    last block padded to whole bytes; then a footer: offsets of the blocks (int64), for each document its id (int64),
    whether the id is present (uint8) and the number of ids before it in the shard (int64); then width, BLOCK_IDS,
    blocks, documents and ids (int64 each) and the magic again.

``width`` is the least number of bits that holds every id of the vocabulary.  A block has a multiple of eight ids, so it
starts on a byte; ``Shard.read`` unpacks any range of ids from the blocks that hold it, with numpy, without reading the
rest.  A shard is written under a temporary name of the task attempt and renamed when complete, so a lost executor or a
second attempt leaves no half file; only the shards that the manifest (the tasks' output) names are read.

Files are opened through pyarrow's file systems by URI, so the folder may be on any store that pyarrow knows.

Defined cases: null text counts as empty and has the end id alone; null ids come last; equal ids are ordered by the
text's hash; repeated rows are each written; an empty table gives no shard and an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from . import pieces
from .common import text_of

MAGIC = b"GLBITS1\n"
BLOCK_IDS = 1 << 16


def open_folder(uri: str):
    """(file system, path) of a folder given as a path or URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, least significant bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class ShardWriter:
    """Writes a shard block by block; memory is one block and the document index."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.at = out.write(MAGIC) and len(MAGIC)
        self.offsets, self.docs, self.present, self.starts = [], [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.present.append(doc_id is not None)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK_IDS:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // BLOCK_IDS * BLOCK_IDS
            for a in range(0, whole, BLOCK_IDS):
                self._block(ids[a:a + BLOCK_IDS])
            self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.out.write(data)
        self.offsets.append(self.at)
        self.at += len(data)

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        for values, kind in ((self.offsets, "<i8"), (self.docs, "<i8"), (self.present, "u1"), (self.starts, "<i8"),
                             ([self.width, BLOCK_IDS, len(self.offsets), len(self.docs), self.n_ids], "<i8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(MAGIC)


class Shard:
    """Random access to a shard file."""

    def __init__(self, source, size: int):
        self.source = source
        tail = 5 * 8 + len(MAGIC)
        source.seek(size - tail)
        end = source.read(tail)
        if end[-len(MAGIC):] != MAGIC:
            raise ValueError("not a complete shard")
        self.width, self.block_ids, blocks, docs, self.n_ids = (int(x) for x in np.frombuffer(end, "<i8", 5))
        at = size - tail - blocks * 8 - docs * 17
        source.seek(at)
        foot = source.read(size - tail - at)
        self.offsets = np.append(np.frombuffer(foot, "<i8", blocks), at)
        self.docs = np.frombuffer(foot, "<i8", docs, blocks * 8)
        self.present = np.frombuffer(foot, "u1", docs, blocks * 8 + docs * 8).astype(bool)
        self.starts = np.append(np.frombuffer(foot, "<i8", docs, blocks * 8 + docs * 9), self.n_ids)

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n, from the blocks that hold them."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (start + n - 1) // self.block_ids
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        held = min(self.n_ids, (last + 1) * self.block_ids) - first * self.block_ids
        at = start - first * self.block_ids
        return unpack(data, held, self.width)[at:at + n]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, its and the following documents' starts, their ids), about ``most`` ids at a time."""
        a = 0
        while a < len(self.docs):
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + most, "right")) - 1)
            b = min(b, len(self.docs))
            yield a, self.starts[a:b + 1], self.read(int(self.starts[a]), int(self.starts[b] - self.starts[a]))
            a = b


def write_shards(docs: DataFrame, folder: str, path: str, kind: str, end_id: int) -> DataFrame:
    """Encode ``docs`` and write the shards; returns the manifest: part, file, n_docs, n_ids (one row a shard)."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    # equal or null ids are dealt by the text's hash, so that they need not meet in one task
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.load(path, kind)
        width = width_of(max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1))
        part = TaskContext.get().partitionId()
        store, base = open_folder(folder)
        writer = None
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for a, ids, at in encoder.slices(batch.column("text")):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    temp = f"{base}/_{part}-{uuid.uuid4().hex}"
                    writer = ShardWriter(store.open_output_stream(temp), width)
                ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
                for k in range(len(at) - 1):
                    writer.add(names[a + k], ids[at[k]:at[k + 1]])
        if writer is not None:
            writer.close()
            writer.out.close()
            name = f"shard-{part:06d}-{uuid.uuid4().hex}.bits"
            store.move(temp, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [len(writer.docs)],
                                              "n_ids": [writer.n_ids]})

    return materialize(rows.mapInArrow(run, "part bigint, file string, n_docs bigint, n_ids bigint"), "op5-manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """The documents of all shards from the files: doc_id, start, n_tokens, ids (little-endian 32-bit integers)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    shards = shards.repartition(max(1, manifest.count()), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{base}/{row['file']}"
                with store.open_input_file(name) as source:
                    shard = Shard(source, store.get_file_info(name).size)
                    for a, starts, ids in shard.documents():
                        n = len(starts) - 1
                        data = ids.astype("<u4").tobytes()
                        cuts = ((starts - starts[0]) * 4).tolist()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard.docs[a:a + n], pa.int64(), mask=~shard.present[a:a + n]),
                             pa.array(starts[:-1] + row["base"]), pa.array(np.diff(starts)),
                             pa.array([data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"])

    return shards.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def stored_tokens(docs: DataFrame, path: str, kind: str = "words", end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as shards (to ``folder``, or one below the shared folder) and read them back."""
    folder = folder or scratch_path(docs.sparkSession, "op5-shards")
    return read_shards(write_shards(docs, folder, path, kind, end_id), folder)


def digest(stored: DataFrame) -> DataFrame:
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
