"""Hierarchical packing of token sequences into windows of several lengths (operator 7).

A document's ids (with its end id) are routed by their number to the tier of the smallest length of ``TIERS`` that holds
them.  Each tier is packed into windows of its own length, the longest tier first: a window opens with the largest waiting
document of its tier (for the shortest tier, the largest that waits) and its gap is filled with the largest waiting
documents of shorter tiers that fit.  What no document fits is filled exactly by cutting: from a document longer than the
longest window, which has to be cut anyway, or else from the largest waiting document, whose rest waits on in the tier of
its new length.  So documents that fit a window stay whole but for these cuts, and no window has padding: every length is
a power of two.  What short tiers keep after the gaps of longer windows are filled becomes windows of their own length.

A task packs ``WAITING_IDS`` ids at a time, so its memory is bounded; what is left at the very end, less than one window,
is cut into windows of powers of two.

Step groups balance the load: windows of equal length are dealt into groups of ``STEP`` windows, sorted by their attention
cost (the sum of the squared piece lengths) and dealt back and forth, so the groups of a tier cost about the same.

Each task packs its own documents: no shuffle, and no task sees more than its share of the input.

Defined cases: null text counts as empty and has the end id alone; repeated rows are packed each on its own; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import giving_back, text_of

TIERS = (256, 512, 1024, 2048)
WINDOW = TIERS[-1]
WAITING_IDS = 1 << 21
STEP = 8
Piece = tuple[int, int, int]  # length, number of the document, start in it


class Packer:
    """Packs pieces into windows, lists of pieces whose total length is that of a tier or another power of two."""

    def __init__(self) -> None:
        self.tiers: list[list[Piece]] = [[] for _ in TIERS]  # sorted by length
        self.long: deque[Piece] = deque()  # rests of documents longer than any window
        self.waiting = 0

    def add(self, doc: int, n: int) -> Iterator[list[Piece]]:
        """Takes a document; a long one gives whole windows, but for its last ids."""
        whole = max(0, n // WINDOW - 1) * WINDOW if n > WINDOW else 0
        for a in range(0, whole, WINDOW):
            yield [(WINDOW, doc, a)]
        self._wait((n - whole, doc, whole))

    def _wait(self, piece: Piece) -> None:
        self.waiting += piece[0]
        if piece[0] > WINDOW:
            self.long.append(piece)
        else:
            insort(self.tiers[self._tier(piece[0])], piece)

    @staticmethod
    def _tier(n: int) -> int:
        return next(k for k, most in enumerate(TIERS) if n <= most)

    def _take(self, most: int, tiers: int) -> Piece | None:
        """The largest waiting piece of at most ``most`` ids in the first ``tiers`` tiers."""
        for tier in reversed(self.tiers[:min(self._tier(most) + 1, tiers)]):
            k = bisect_right(tier, most, key=lambda p: p[0])
            if k:
                self.waiting -= tier[k - 1][0]
                return tier.pop(k - 1)
        return None

    def _cut(self, n: int) -> Piece:
        """The first ``n`` ids of a long document, or else of the largest waiting piece; its rest waits on."""
        length, doc, start = self.long.popleft() if self.long else next(t for t in reversed(self.tiers) if t).pop()
        self.waiting -= length
        if length > n:
            self._wait((length - n, doc, start + n))
        return min(n, length), doc, start

    def window(self, size: int, tier: int) -> list[Piece]:
        """A full window of ``size`` ids, opened by a piece of ``tier``; at least ``size`` ids must wait."""
        held, gap = [], size
        while gap:
            if held or not self.tiers[tier]:
                piece = self._take(gap, max(1, tier)) or self._cut(gap)
            else:
                piece = self._take(gap, tier + 1) or self._cut(gap)
            held.append(piece)
            gap -= piece[0]
        return held

    def drain(self, last: bool) -> Iterator[list[Piece]]:
        """The windows that waiting ids fill; with ``last`` all of them."""
        while self.waiting >= TIERS[0]:
            made = False
            for k in reversed(range(len(TIERS))):
                while self.tiers[k] and self.waiting >= TIERS[k]:
                    made = True
                    yield self.window(TIERS[k], k)
            if self.long and self.waiting >= WINDOW:
                made = True
                yield [self._cut(WINDOW)]
            if not made:
                break
        while last and self.waiting:
            yield self.window(1 << (self.waiting.bit_length() - 1), 0)


def _step_groups(windows: list[list[Piece]], first: int) -> list[int]:
    """A group number for each window: equal lengths, ``STEP`` windows, alike costs."""
    out = [0] * len(windows)
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(windows):
        by_length.setdefault(sum(p[0] for p in w), []).append(k)
    for _, ks in sorted(by_length.items()):
        ks.sort(key=lambda k: (-sum(p[0] ** 2 for p in windows[k]), k))
        groups = -(-len(ks) // STEP)
        for i, k in enumerate(ks):
            lap, at = divmod(i, groups)
            out[k] = first + (at if lap % 2 == 0 else groups - 1 - at)
        first += groups
    return out


_SCHEMA = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
           "offset bigint, tier bigint, step_group bigint")


def pack(docs: DataFrame, path: str, kind: str = "spaces", end_id: int = 1, memo: int = pieces.MEMO_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, tier (the
    window's length) and step_group.  ``memo`` bounds the pieces whose ids a Python worker remembers."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.load(path, kind, memo)
        base = TaskContext.get().partitionId() << 33
        packer = Packer()
        held: dict[int, tuple[int | None, np.ndarray]] = {}  # documents with ids that wait or are due
        due: list[list[Piece]] = []
        made = groups = number = due_ids = 0

        def emit() -> pa.RecordBatch:
            nonlocal made, groups, due, due_ids
            numbers = _step_groups(due, groups)
            out = [(held[d][0], start, n, held[d][1][start:start + n].tobytes(), len(held[d][1]), base + made + k, at,
                    sum(p[0] for p in w), base + numbers[k])
                   for k, w in enumerate(due) for at, (n, d, start) in _placed(w)]
            made += len(due)
            groups = max(numbers, default=groups - 1) + 1
            due, due_ids = [], 0
            used = {p[1] for t in (*packer.tiers, packer.long) for p in t}
            for d in list(held):
                if d in used:  # the rest of its slice is not kept with it
                    held[d] = held[d][0], held[d][1].copy()
                else:
                    del held[d]
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(cols)],
                names=[c.split()[0] for c in _SCHEMA.split(", ")])

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for a, ids, at in encoder.slices(batch.column("text")):
                ids, at = np.insert(ids, at[1:], end_id).astype("<u4", copy=False), at + np.arange(len(at))
                for k in range(len(at) - 1):
                    number += 1
                    held[number] = names[a + k], ids[at[k]:at[k + 1]]
                    due += packer.add(number, len(held[number][1]))
                    due_ids += len(held[number][1])
                    if due_ids >= WAITING_IDS:
                        due += packer.drain(last=False)
                        yield emit()
        due += packer.drain(last=True)
        if due:
            yield emit()

    return rows.mapInArrow(giving_back(run), _SCHEMA)


def _placed(window: list[Piece]) -> Iterator[tuple[int, Piece]]:
    at = 0
    for piece in window:
        yield at, piece
        at += piece[0]


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "tier", "step_group")
