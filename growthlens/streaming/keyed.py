"""Keyed state of the streams (transformWithState over RocksDB).

``CompanyPages`` keeps one mergeable statistics row per (company, page): a batch reads its own pages and the state of the
companies that they belong to, never earlier files.  Its keys are ``COMPANY_BUCKETS`` groups of companies, since a key
costs far more than an entry.  ``BucketTop`` keeps the latest score of every company of one (category, bucket) and its
best k, and takes scores back: only when a member falls behind what non-members may have is the bucket read again.  A hot
category is split over ``BUCKETS`` keys, whose best k are merged when read.  The streams use ``SlottedTop``, which does the
same with many scores an entry.

State is read and written entry by entry, since each entry costs a call to the JVM: some ``COMPANIES_AN_ENTRY`` companies
with up to ``PAGES_AN_ENTRY`` pages each, or ``SCORES_AN_ENTRY`` scores, whatever their numbers and names.  What outgrows one entry is hashed over several,
one more at a time (linear hashing), so that a row is found without a directory.  ``CHUNK`` input rows are taken at a time,
and what no earlier batch can have written is not looked up.  So a task holds, beside one chunk and one entry, the running
sums of the companies of one bucket that a batch touches, or one bucket's k best, however many pages or companies the key
has.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from decimal import Decimal
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config
from ..operators.ranking import top_k

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 16
COMPANY_BUCKETS = 4096
CHUNK = 65536
PAGES_AN_ENTRY = 32
COMPANIES_AN_ENTRY = 8
PARSED = 1024
SCORES_AN_ENTRY = 128
KNOWN = 100_000
COUNTS = ("n_acquired_by", "n_offices", "n_products", "n_competitors", "n_acquisitions", "n_inv_org", "n_inv_person",
          "n_rounds", "n_rounds_dated", "nz_n")
SUMS = ("inv_sum", "nz_sum")
COMBINED = ("p string, hdr string, last_office string, acq_max string, " + ", ".join(f"{c} bigint" for c in COUNTS)
            + ", " + ", ".join(f"{c} string" for c in SUMS))
LOCAL_TOP = "category string, bucket int, rank bigint, p string, s double"


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB provider, whatever the session was built with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _hash(name: str | None) -> int:
    return zlib.crc32((name or "").encode())


def _slots(n: int, an_entry: int) -> int:
    """How many slots hold n rows."""
    return max(1, -(-n // an_entry))


def _slot(name: str | None, slots: int) -> int:
    """The slot of a row: of the hash's last bits, one bit less where that slot is not there yet."""
    size = 1 << (slots - 1).bit_length()
    at = _hash(name) & (size - 1)
    return at if at < slots else at - size // 2


def _by_slot(rows: dict, slots: int) -> dict[int, dict]:
    if slots == 1:
        return {0: rows}
    out: dict[int, dict] = {}
    for name, row in rows.items():
        out.setdefault(_slot(name, slots), {})[name] = row
    return out


def _grow(slots: int, to: int, read: Callable[[int], dict], write: Callable[[int, dict], None]) -> None:
    """Add slots one by one; each takes its rows from one earlier slot."""
    while slots < to:
        parent = slots - (1 << (slots.bit_length() - 1))
        held, slots = read(parent), slots + 1
        moved = {name: held.pop(name) for name in list(held) if _slot(name, slots) != parent}
        if moved:
            write(parent, held)
            write(slots - 1, moved)


def _merged(pages: Iterator[tuple[int, str, str | None, str | None]]) -> dict:
    """The statistics of a company from those of its pages (page, body, hdr, office)."""
    out: dict = dict.fromkeys(COUNTS, 0) | dict.fromkeys(SUMS, Decimal(0))
    hdr = office = acquired = None
    last = -1
    while some := list(islice(pages, PARSED)):
        parsed = json.loads(f"[{','.join(body for _page, body, _head, _place in some)}]")
        for (page, _body, head, place), stats in zip(some, parsed, strict=True):
            for c, v in stats.items():
                if v is None:
                    continue
                if c == "acq_max":
                    acquired = v if acquired is None else max(acquired, v)
                else:
                    out[c] += Decimal(v) if c in SUMS else v
            if head is not None:
                hdr = head
            if place is not None and page > last:
                office, last = place, page
    return out | {"hdr": hdr, "last_office": office, "acq_max": acquired} | {c: str(out[c]) for c in SUMS}


def _fields(pages: dict[str, tuple]) -> Iterator[tuple[int, str, str | None, str | None]]:
    return ((int(page), row[2], row[3], row[4]) for page, row in pages.items())


def _rank(row: tuple) -> tuple:
    """Order of one page's rows (version, at, body, hdr, office): the highest version stays, then the latest batch's, then
    the greatest text."""
    return row[0], row[1], row[2], row[3] or "", row[4] or ""


class CompanyPages(StatefulProcessor):
    """Rows (bucket, p, page, version, at, body, hdr, office) -> the merged statistics of each company that they touch;
    ``at`` is the batch's time, which Spark logs with the batch, so that a replayed batch has the same.

    Of one page's rows that of the highest ``_rank`` stays; pages of a company without its header (page 0) wait for it.  An
    entry holds the number of pages and the first slot of them of some companies, entry -1 the number of companies; further
    slots of a company's pages are entries of their own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.companies = handle.getMapState("companies", "slot long", "held string")
        self.blocks = handle.getMapState("blocks", "p string, slot long", "pages string")

    def _held(self, slot: int) -> dict[str, list]:
        held = self.companies.getValue((slot,))
        return {} if held is None else json.loads(held[0])

    def _hold(self, slot: int, held: dict[str, list]) -> None:
        self.companies.updateValue((slot,), (json.dumps(held),))

    def _block(self, p: str, slot: int) -> dict[str, tuple]:
        held = self.blocks.getValue((p, slot))
        return {} if held is None else json.loads(held[0])

    def _start(self, p: str, pages: dict[str, tuple]) -> list:
        held = _by_slot(pages, _slots(len(pages), PAGES_AN_ENTRY))
        for slot, some in held.items():
            if slot:
                self.blocks.updateValue((p, slot), (json.dumps(some),))
        return [len(pages), held.get(0, {})]

    def _add(self, p: str, n: int, first: dict[str, tuple], pages: dict[str, tuple]) -> list:
        def read(slot: int) -> dict[str, tuple]:
            return self._block(p, slot) if slot else first

        def write(slot: int, held: dict[str, tuple]) -> None:
            if slot:  # the first is written with its company
                self.blocks.updateValue((p, slot), (json.dumps(held),))

        slots = _slots(n, PAGES_AN_ENTRY)
        for slot, some in _by_slot(pages, slots).items():
            held = read(slot)
            for page, row in some.items():
                n += page not in held
                held[page] = max(held.get(page, row), row, key=_rank)
            write(slot, held)
        _grow(slots, _slots(n, PAGES_AN_ENTRY), read, write)
        return [n, first]

    def _stored(self, p: str, slot: int) -> Iterator[dict[str, tuple]]:
        n, first = self._held(slot)[p]
        yield first
        for block in range(1, _slots(n, PAGES_AN_ENTRY)):
            yield self._block(p, block)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        count = int(self.companies.getValue((-1,))[0]) if self.companies.exists() else 0
        columns = ("p", "page", "version", "at", "body", "hdr", "office")
        sent_rows = chain.from_iterable(zip(*(pdf[c].tolist() for c in columns), strict=True) for pdf in rows)
        touched: dict[str, dict | None] = {}  # merged statistics, or None: to be read when all rows are stored
        while True:
            sent: dict[str, dict[str, tuple]] = {}
            for p, page, version, at, body, hdr, office in islice(sent_rows, CHUNK):
                row = (version, at, body, hdr if isinstance(hdr, str) else None, office if isinstance(office, str) else None)
                pages, page = sent.setdefault(p, {}), str(page)
                pages[page] = max(pages[page], row, key=_rank) if page in pages else row
            if not sent:
                break
            new, slots = count == 0, _slots(count or len(sent), COMPANIES_AN_ENTRY)
            for slot, some in _by_slot(sent, slots).items():
                held = {} if new else self._held(slot)
                for p, pages in some.items():
                    if p in held:
                        held[p] = self._add(p, *held[p], pages)
                        pages = held[p][1] if held[p][0] <= PAGES_AN_ENTRY else None
                    else:
                        held[p] = self._start(p, pages)
                        count += 1
                    touched[p] = None if pages is None else _merged(_fields(pages))
                self._hold(slot, held)
            _grow(slots, _slots(count, COMPANIES_AN_ENTRY), self._held, self._hold)
        if touched:
            self.companies.updateValue((-1,), (str(count),))
        names = ["hdr", "last_office", "acq_max", *COUNTS, *SUMS]
        out = []
        for p, merged in touched.items():
            if merged is None:
                blocks = self._stored(p, _slot(p, _slots(count, COMPANIES_AN_ENTRY)))
                merged = _merged(chain.from_iterable(map(_fields, blocks)))
            if merged["hdr"] is not None:
                out.append((p, *(merged[c] for c in names)))
        if out:
            yield pd.DataFrame(out, columns=["p", *names])

    def close(self) -> None:
        pass


def merged_companies(rows: DataFrame) -> DataFrame:
    """The stream of merged statistics of the companies that a stream of page rows touches."""
    bucket = F.pmod(F.xxhash64("p"), F.lit(COMPANY_BUCKETS)).cast("int")
    return rows.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        CompanyPages(), COMBINED, "Update", "None")


def _order(p: str, s: float | None) -> tuple:
    """Rank order: the greatest score first, nulls last, then the permalink."""
    return (s is None, -(s or 0.0), p)


class BucketTop(StatefulProcessor):
    """Rows (category, bucket, p, s, seq) -> the best k (category, bucket, rank, p, s) of each bucket that they touch.

    Of one company's scores that of the greatest seq counts, in whatever order they come."""

    def __init__(self, k: int = config.TOP_K) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scores = handle.getMapState("scores", "p string", "seq long, s double")
        self.top = handle.getValueState("top", "entries string")

    def _placed(self, top: list[tuple], p: str, s: float | None) -> tuple[list[tuple], bool]:
        """The best k with a company's new score, and whether others of the bucket may be better now."""
        behind = len(top) >= self.k and _order(p, s) > _order(*top[-1])
        member = any(e[0] == p for e in top)
        if behind and not member:
            return top, False
        others = [e for e in top if e[0] != p]
        return sorted([*others, (p, s)], key=lambda e: _order(*e))[:self.k], behind

    def _all(self) -> Iterator[tuple[str, float | None]]:
        for (p,), (_, s) in self.scores.iterator():
            yield p, s

    def _reread(self) -> list[tuple[str, float | None]]:
        """The best k of the whole bucket, with k entries in memory."""
        best: list[tuple[str, float | None]] = []
        for p, s in self._all():
            best.append((p, s))
            if len(best) >= 4 * self.k:
                best = sorted(best, key=lambda e: _order(*e))[:self.k]
        return sorted(best, key=lambda e: _order(*e))[:self.k]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        top = [tuple(e) for e in json.loads(self.top.get()[0])] if self.top.exists() else []
        stale = False
        known: set[str] | None = None if self.top.exists() else set()  # all companies of the bucket, while they are few
        while True:
            latest: dict[str, tuple[int, float | None]] = {}
            for r in islice(rows, CHUNK):
                if r.p not in latest or r.seq > latest[r.p][0]:
                    latest[r.p] = r.seq, r.s
            if not latest:
                break
            for p, (seq, s) in latest.items():
                old = None if known is not None and p not in known else self.scores.getValue((p,))
                if old is not None and old[0] >= seq:
                    continue
                self.scores.updateValue((p,), (seq, s))
                if known is not None:
                    known.add(p)
                top, fell = self._placed(top, p, s)
                stale = stale or fell
            if known is not None and len(known) > KNOWN:
                known = None
        if stale:
            top = self._reread()
        self.top.update((json.dumps(top),))
        for k, (p, s) in enumerate(top):
            yield Row(category=key[0], bucket=key[1], rank=k + 1, p=p, s=s)

    def close(self) -> None:
        pass


class SlottedTop(BucketTop):
    """``BucketTop`` on frames (category, bucket, p, s, none, seq), ``none`` for a null s, with up to about
    ``SCORES_AN_ENTRY`` scores an entry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scores = handle.getMapState("scores", "slot long", "held string")
        self.top = handle.getValueState("top", "entries string, n long")

    def _held(self, slot: int) -> dict[str, tuple[int, float | None]]:
        held = self.scores.getValue((slot,))
        return {} if held is None else {p: (seq, s) for p, seq, s in json.loads(held[0])}

    def _hold(self, slot: int, held: dict[str, tuple[int, float | None]]) -> None:
        self.scores.updateValue((slot,), (json.dumps([(p, *row) for p, row in held.items()]),))

    def _all(self) -> Iterator[tuple[str, float | None]]:
        for _, (held,) in self.scores.iterator():
            for p, _seq, s in json.loads(held):
                yield p, s

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        top, n = [], 0
        if self.top.exists():
            entries, n = self.top.get()
            top = [tuple(e) for e in json.loads(entries)]
        stale = False
        sent = chain.from_iterable(zip(*(pdf[c].tolist() for c in ("p", "seq", "s", "none")), strict=True) for pdf in rows)
        while True:
            latest: dict[str, tuple[int, float | None]] = {}
            for p, seq, s, none in islice(sent, CHUNK):
                if p not in latest or seq > latest[p][0]:
                    latest[p] = seq, None if none else s
            if not latest:
                break
            new = n == 0
            slots = _slots(n or len(latest), SCORES_AN_ENTRY)
            for slot, some in _by_slot(latest, slots).items():
                held = {} if new else self._held(slot)
                for p, (seq, s) in some.items():
                    if p not in held:
                        n += 1
                    elif held[p][0] >= seq:
                        continue
                    held[p] = seq, s
                    top, fell = self._placed(top, p, s)
                    stale = stale or fell
                self._hold(slot, held)
            _grow(slots, _slots(n, SCORES_AN_ENTRY), self._held, self._hold)
        if stale:
            top = self._reread()
        self.top.update((json.dumps(top), n))
        yield pd.DataFrame([(key[0], key[1], k + 1, p, s, s is not None and s != s) for k, (p, s) in enumerate(top)],
                           columns=["category", "bucket", "rank", "p", "s", "nan"])


def bucketed(scores: DataFrame) -> DataFrame:
    """(category, p, s, seq) with the bucket of the company."""
    return scores.select("category", F.pmod(F.xxhash64("p"), F.lit(BUCKETS)).cast("int").alias("bucket"), "p",
                         F.col("s").cast("double").alias("s"), F.col("seq").cast("bigint").alias("seq"))


def bucket_tops(scores: DataFrame, k: int = config.TOP_K) -> DataFrame:
    """The stream of changed local best k of a stream of scores (category, p, s, seq)."""
    # frames take a null number for NaN and back, so a column beside it tells them apart
    rows = bucketed(scores).withColumn("none", F.col("s").isNull())
    tops = rows.groupBy("category", "bucket").transformWithStateInPandas(
        SlottedTop(k), LOCAL_TOP + ", nan boolean", "Update", "None")
    return tops.withColumn("s", F.when(F.col("nan"), F.lit(float("nan"))).otherwise(F.col("s"))).drop("nan")


def merged_top(local: DataFrame, k: int = config.TOP_K) -> DataFrame:
    """The top-k of each category from the latest local ones (with batch_id): at most BUCKETS * k rows a category."""
    newest = local.groupBy("category", "bucket").agg(F.max("batch_id").alias("batch_id"))
    now = local.join(newest, ["category", "bucket", "batch_id"]).select("category", "p", "s")
    return top_k(now, ["category"], [F.col("s").desc_nulls_last(), F.col("p").asc()], k)
