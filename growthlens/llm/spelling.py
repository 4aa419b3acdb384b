"""Spelling variants by dense prefix-suffix tiling (operator 12).

Words are counted with one shuffle of counts combined inside the tasks.  Two words, the shorter of n code points, differ by
one edit if and only if the lengths of their common prefix and common suffix reach the longer length minus one.  An edit
lies in one of ``PIECES`` pieces of the shorter word, and all around that piece agrees; so words are grouped by (n, piece,
the text before it, the text after it), once as the shorter and once as the longer of a pair.  Groups of more than
``GROUP`` words are grouped again by halves of their piece, until it has a single code point: then a group is bounded by
the alphabet.  No group is capped.

The groups of a task lie one after the other in padded matrices of code points, left-aligned and right-aligned (the
alphabet lies below 256, so a code point is a byte); numpy compares block pairs of rows of bounded size.  A pair is taken
only in the piece that holds its first differing place, so that it is found exactly once, without a ``distinct``.  What
leaves a task are the near pairs themselves: a word of L letters has at most about 90 * (2 L + 1) of them, whatever the
number of words.

Forms are chains with counts that grow at least tenfold, so at most 18 steps long: roots come by doubling in at most five
joins of the words that have a form.

Defined cases: null and empty texts have no words; a null doc_id is written as an empty string before the colon; repeated
rows count again; ties go to the smaller word in code-point order; an empty table gives an empty result; words of any
length are compared whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import giving_back

LEAST_LETTERS = 7
LEAST_COUNT = 2
DELETED = 31
RATIO = 10
PIECES = 4
GROUP = 4096
HELD_WORDS = 200_000
CELLS = 1 << 22
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}")
_LOWER = {c: c + 32 for c in range(65, 91)}


def typed(doc_id: int | None, run: str) -> str:
    """The run as it counts: every ``DELETED``-th (doc_id, run) loses one code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DELETED:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        got = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
        held.clear()
        return got

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            for run, n in Counter(_RUN.findall(text.as_py() or "")).items():
                word = typed(doc_id, run if run.islower() else run.translate(_LOWER))
                if len(word) >= LEAST_LETTERS:
                    held[word] += n
            if len(held) >= HELD_WORDS:
                yield flush()
    if held:
        yield flush()


def words(docs: DataFrame) -> DataFrame:
    """word, n of the words that occur often enough."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(giving_back(_counts), "word string, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keyed(members: DataFrame) -> DataFrame:
    """With the key of the group: what stands before place ``a`` and after the piece of ``m`` places of the shorter word."""
    after = F.col("short") - F.col("a") - F.col("m")
    return members.withColumn("key", F.xxhash64("short", "a", "m", F.expr("left(word, a)"),
                                                F.when(after > 0, F.expr("right(word, short - a - m)")).otherwise("")))


def _members(known: DataFrame) -> DataFrame:
    """Each word in the groups of all pieces, as the shorter (short = its length) and as the longer word of a pair."""
    cuts = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.struct(
        F.floor(F.col("short") * i / PIECES).cast("int").alias("a"),
        (F.floor(F.col("short") * (i + 1) / PIECES) - F.floor(F.col("short") * i / PIECES)).cast("int").alias("m")))
    size = F.length("word")
    roles = known.select("word", "n", F.explode(F.array(size, size - 1)).alias("short")).where(
        F.col("short") >= LEAST_LETTERS)
    return _keyed(roles.select("word", "n", "short", F.inline(cuts)))


def _halves(members: DataFrame) -> DataFrame:
    """The members in the groups of the two halves of their piece."""
    h = F.floor(F.col("m") / 2).cast("int")
    both = F.array(F.struct(F.col("a").alias("a"), h.alias("m")), F.struct((F.col("a") + h).alias("a"),
                                                                         (F.col("m") - h).alias("m")))
    return _keyed(members.select("word", "n", "short", F.inline(both)))


def _matrices(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left-aligned code points, right-aligned ones, lengths), padded with zeros."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    width = int(size.max())
    left = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(-1, width)
    right = np.frombuffer(b"".join(t.rjust(width, b"\0") for t in texts), np.uint8).reshape(-1, width)
    return left, right, size


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the first places agree, row by row."""
    differ = x != y
    return np.where(differ.any(1), differ.argmax(1), x.shape[1])


def near_pairs(texts: list[bytes], short: np.ndarray, a: np.ndarray, m: np.ndarray, end: np.ndarray
               ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the near words among rows in group order: row i belongs to a group that ends before row ``end[i]``,
    with all shorter words first."""
    left, right, size = _matrices(texts)
    partners = np.where(size == short, end - np.arange(len(texts)) - 1, 0)
    most = max(1, CELLS // left.shape[1])
    total = np.cumsum(partners)
    for at in range(0, int(total[-1]), most):
        flat = np.arange(at, min(at + most, int(total[-1])))
        i = np.searchsorted(total, flat, "right")
        j = i + 1 + flat - (total[i] - partners[i])
        same = (short[i] == short[j]) & (a[i] == a[j]) & (m[i] == m[j])  # else two groups share a key
        i, j = i[same], j[same]
        lead = np.minimum(_agree(left[i], left[j]), size[i])
        spot = np.minimum(lead, size[i] - 1)
        own = (a[i] <= spot) & (spot < a[i] + m[i])
        i, j, lead = i[own], j[own], lead[own]
        tail = np.minimum(_agree(right[i][:, ::-1], right[j][:, ::-1]), size[i])
        near = lead + tail >= np.maximum(size[i], size[j]) - 1
        yield i[near], j[near]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, in both directions, of rows sorted by group and length; a group may lie in several batches."""
    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = table.column("key").to_numpy()
        change = np.flatnonzero(np.diff(key)) + 1
        starts = np.concatenate([[0], change])
        ends = np.concatenate([change, [len(key)]])
        several = np.repeat(ends - starts > 1, ends - starts)
        if not several.any():
            return
        table = table.filter(pa.array(several))
        key = key[several]
        end = np.searchsorted(key, key, "right")
        names = np.array(table.column("word").to_pylist(), object)
        n, short, a, m = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "short", "a", "m"))
        lengths = np.frexp(short)[1]  # matrices are padded to less than twice their words' lengths
        for length in np.unique(lengths):
            mine = np.flatnonzero(lengths == length)
            # rows of a key lie together in ``mine`` too
            ends = np.searchsorted(mine, end[mine], "left")
            for i, j in near_pairs([w.encode("latin-1") for w in names[mine]], short[mine], a[mine], m[mine], ends):
                if len(i):
                    x, y = mine[np.concatenate([i, j])], mine[np.concatenate([j, i])]
                    yield pa.RecordBatch.from_pydict({"word": pa.array(names[x], pa.string()),
                                                      "near": pa.array(names[y], pa.string()), "near_n": pa.array(n[y])})

    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        key = rest.column("key").to_numpy()
        whole = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0  # the last group may go on
        if whole:
            yield from compared(rest.slice(0, whole))
            rest = rest.slice(whole)
    if rest is not None and len(rest):
        yield from compared(rest)


def near_words(known: DataFrame) -> DataFrame:
    """word, near, near_n: each pair of words (word, n of ``known``) that differ by one edit, in both directions."""
    groups, step = _members(known), 0
    done: list[DataFrame] = []
    while True:
        large = groups.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max("m").alias("most")).where(
            (F.col("members") > GROUP) & (F.col("most") > 1)).select("key")
        large = materialize(large, f"op12-large{step}")
        if not large.limit(1).count():
            break
        split = F.col("m") > 1
        done.append(groups.join(large, "key", "left_anti"))
        done.append(groups.join(large, "key", "left_semi").where(~split))
        groups = materialize(_halves(groups.join(large, "key", "left_semi").where(split)), f"op12-halves{step}")
        step += 1
    for more in done:
        groups = groups.unionByName(more)
    dealt = groups.select("key", "word", "n", "short", "a", "m", F.length("word").alias("size")).repartition("key")
    return dealt.sortWithinPartitions("key", "size").mapInArrow(
        giving_back(_compare), "word string, near string, near_n bigint")


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form (word, form)."""
    known = materialize(forms.select("word", F.col("form").alias("root")), "op12-roots0")
    for step in range(1, 6):  # 2^5 steps; counts grow tenfold, so no chain of longs has more than 18
        far = known.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = materialize(known.join(far, "root", "left").select("word", "root", "far"), f"op12-roots{step}")
        known = new.select("word", F.coalesce("far", "root").alias("root"))
        if not new.where("far is not null").limit(1).count():
            break
    return known


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    known = materialize(words(docs), "op12-words")
    best = near_words(known).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    far = F.col("n_near").isNotNull() & (-F.col("best.less") >= RATIO * F.col("n"))
    found = materialize(known.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("best.near")).alias("form"),
        F.when(far, -F.col("best.less")).alias("form_n")), "op12-forms")
    roots = _rooted(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
