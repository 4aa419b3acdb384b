"""Document fingerprints by a randomised edit embedding (operator 6).

A shared random walk reads the characters of a text: at step t it stands on a character c, emits it, and moves on if the
random bit (t, c) says so.  Two texts read with the same bits meet again soon after an edit, so the edit distance of the
texts becomes a Hamming distance of what is emitted.  The fingerprint samples what is emitted: ``SAMPLES`` fixed steps of
each octave of time (0 to 16, 16 to 32, 32 to 64, ...), one hex digit each, ``-`` after the end of the text; so texts of
any length share their samples.  The likeness of two fingerprints weighs the samples by the steps that they stand for
and takes off the agreement expected by chance.

``neighbours`` finds close documents: equal fingerprints form classes, bands of sampled digits are the classes' buckets,
and the likeness verifies.  A bucket's members are compared with its least member; those that are then still in different
components are compared with one another in bounded blocks.  So any two bucket partners that are alike end up connected,
without a group being expanded into pairs.  No registered query calls it: op6_fingerprints only makes fingerprints.

For a text and the next in descending order of doc_id the walk over the edited text (its second half replaced by the
start of the next) goes on from where the walk over the text stood.  Texts are range-partitioned by doc_id once; a task
reads its texts in order and needs no other text but the first of the next task, which a second, small pass supplies.
Many texts are walked in step by numpy.

Defined cases: null text counts as empty; an empty text's fingerprint is all ``-`` and two such are alike (1.0); null ids
come after all others; equal ids are ordered by the text's hash; of repeated rows each is the other's next; a single
document is its own next; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import numbered, text_of
from .components import across, connected

PERIOD = 1 << 12
SYMBOLS = 256
SAMPLES = 32
FIRST = 16
SEED = 17
WALKED_CHARS = 4 << 20
IN_STEP = 48
BAND = 8
_HEX = np.frombuffer(b"0123456789abcdef-", np.uint8)


def _advance() -> np.ndarray:
    """advance[c, t]: steps until the walk that stands on c at time t (modulo PERIOD) moves on; 1 to 255."""
    bits = np.random.default_rng(SEED).random((SYMBOLS, PERIOD)) < 0.5
    out = np.full((SYMBOLS, 2 * PERIOD), 255, np.int64)
    twice = np.concatenate([bits, bits], axis=1)
    for t in range(2 * PERIOD - 1, -1, -1):
        later = out[:, t + 1] + 1 if t + 1 < 2 * PERIOD else 255
        out[:, t] = np.where(twice[:, t], 1, np.minimum(later, 255))
    return out[:, :PERIOD].astype(np.uint8)


ADVANCE = _advance()
_ROWS = [row.tobytes() for row in ADVANCE]


def _octave(k: int) -> tuple[int, int]:
    return (0, FIRST) if k == 0 else (FIRST << (k - 1), FIRST << k)


def _steps(k: int) -> np.ndarray:
    """The sampled steps of octave k."""
    a, b = _octave(k)
    return np.sort(a + (np.random.default_rng([SEED, k]).random(SAMPLES) * (b - a)).astype(np.int64))


def symbols(text: str) -> np.ndarray:
    """A symbol below SYMBOLS for each code point."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((c * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def walk(codes: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
    """For each sequence, the step at which the walk leaves each of its symbols, from step ``begin`` on."""
    n = np.array([len(c) for c in codes])
    order = np.argsort(-n, kind="stable")
    flat = np.concatenate([codes[k] for k in order]) if len(codes) else np.zeros(0, np.uint8)
    starts = np.cumsum(n[order]) - n[order]
    left = np.zeros(len(flat), np.int64)
    t = begin[order].astype(np.int64)
    table, mask = ADVANCE.reshape(-1), PERIOD - 1
    longest = int(n[order[IN_STEP - 1]]) if len(codes) >= IN_STEP else 0
    active = np.searchsorted(-n[order], -np.arange(longest), "left") if longest else []
    for i in range(longest):  # while at least IN_STEP texts go on, all of them move by one symbol
        m = int(active[i])
        spot = starts[:m] + i
        t[:m] += table[flat[spot].astype(np.int64) * PERIOD + (t[:m] & mask)]
        left[spot] = t[:m]
    for k in np.flatnonzero(n[order] > longest):  # the longer ones one by one
        a, b = int(starts[k]) + longest, int(starts[k] + n[order[k]])
        got = accumulate(flat[a:b].tobytes(), lambda now, c: now + _ROWS[c][now & mask], initial=int(t[k]))
        left[a:b] = np.fromiter(got, np.int64, b - a + 1)[1:]
    out: list[np.ndarray] = [left[:0]] * len(codes)
    for k, o in enumerate(order):
        out[o] = left[starts[k]:starts[k] + n[o]]
    return out


def sampled(codes: np.ndarray, left: np.ndarray) -> str:
    """The fingerprint of a walked text."""
    end = int(left[-1]) if len(left) else 0
    octaves = 1
    while _octave(octaves)[0] < end:
        octaves += 1
    steps = np.concatenate([_steps(k) for k in range(octaves)])
    at = np.searchsorted(left, steps, "right")
    inside = at < len(codes)
    digit = np.full(len(steps), 16)
    mixed = (codes[at[inside]].astype(np.uint32) + np.uint32(1)) * (steps[inside].astype(np.uint32) * np.uint32(2)
                                                                     + np.uint32(0x85EBCA6B))
    digit[inside] = (mixed * np.uint32(0x9E3779B1)) >> np.uint32(28)
    return _HEX[digit].tobytes().decode()


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of the walk over which two texts agree, less what chance gives."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    x, y = (np.frombuffer(s.ljust(n, "-").encode(), np.uint8) for s in (a, b))
    pad = ord("-")
    spans = np.array([_octave(k)[1] - _octave(k)[0] for k in range(n // SAMPLES)])
    weight = np.repeat(spans, SAMPLES) * ((x != pad) | (y != pad))
    if not weight.any():
        return 1.0
    same = float((weight * (x == y)).sum() / weight.sum())
    return min(1.0, max(0.0, (same - 1 / 16) / (1 - 1 / 16)))


def pair(texts: list[str], nexts: list[str]) -> list[tuple]:
    """For each text and its next: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  The
    texts and nexts hold WALKED_CHARS characters, or one text, at most."""
    codes = [symbols(t) for t in texts]
    known = {t: k for k, t in enumerate(texts)}
    other = [t for t in dict.fromkeys(nexts) if t not in known]
    zero = np.zeros(len(texts) + len(other), np.int64)
    left = walk(codes + [symbols(t) for t in other], zero)
    marks = [sampled(c, x) for c, x in zip(codes, left, strict=False)]
    marked = dict(zip(texts, marks, strict=True)) | {
        t: sampled(symbols(t), x) for t, x in zip(other, left[len(texts):], strict=True)}
    keep = [len(t) - len(t) // 2 for t in texts]
    heads = [nx[:len(t) // 2] for t, nx in zip(texts, nexts, strict=True)]
    tails = [symbols(h) for h in heads]
    begin = np.array([int(x[k - 1]) if k else 0 for x, k in zip(left, keep, strict=False)], np.int64)
    ends = walk(tails, begin)
    out = []
    for k, t in enumerate(texts):
        edited = t[:keep[k]] + heads[k]
        mark = sampled(np.concatenate([codes[k][:keep[k]], tails[k]]), np.concatenate([left[k][:keep[k]], ends[k]]))
        out.append((len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), marks[k], mark,
                    likeness(marks[k], mark), likeness(marks[k], marked[nexts[k]])))
    return out


_COLS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_SCHEMA = ("part bigint, place string, doc_id bigint, text string, n_chars bigint, edited_sha256 string, "
           "fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _batch(part: int | None, rows: list[tuple]) -> pa.RecordBatch:
    """rows: (place, doc_id, text, results or Nones)."""
    cols = list(zip(*rows, strict=True))
    arrays = [pa.array([part] * len(rows), pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
              pa.array(cols[2], pa.string()), *[pa.array(c, t) for c, t in zip(cols[3:], _TYPES, strict=True)]]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "place", "doc_id", "text", *_COLS])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text with the next of the same task; the first and the last text of a task come out as they are."""
    part = TaskContext.get().partitionId()
    none = (None,) * len(_COLS)
    first, waiting, chars = True, [], 0  # waiting: (doc_id, text), each but the last with its next behind it

    def done() -> pa.RecordBatch:
        texts = [t for _, t in waiting]
        got = pair(texts[:-1], texts[1:])
        return _batch(part, [(None, d, None, *g) for (d, _), g in zip(waiting, got, strict=False)])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if first:
                yield _batch(part, [("first", doc_id, text, *none)])
                first = False
            waiting.append((doc_id, text))
            chars += len(text)
            if chars >= WALKED_CHARS and len(waiting) > 1:
                yield done()
                waiting = waiting[-1:]
                chars = len(text)
    if len(waiting) > 1:
        yield done()
    if waiting:
        yield _batch(part, [("last", *waiting[-1], *none)])


def _at_seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _batch(None, [(None, row["doc_id"], None, *pair([row["text"]], [row["next"]])[0])])


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id and the columns of ``pair``."""
    down = F.col("doc_id").desc_nulls_last()
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.repartitionByRange(down).sortWithinPartitions(down, F.xxhash64("text"), "text")
    made = materialize(rows.mapInArrow(_in_order, _SCHEMA), "op6-rows")
    # the seams: the next text of a task's last is the first of the next task that has any, and of the last task's the
    # very first; one row a task
    parts = made.where("place = 'last'").select("part")
    order = Window.orderBy("part")
    follow = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy()))
                          .alias("follow"))
    last = made.where("place = 'last'").select("part", "doc_id", "text")
    heads = made.where("place = 'first'").select(F.col("part").alias("follow"), F.col("text").alias("next"))
    seams = last.join(follow, "part").join(heads, "follow").select("doc_id", "text", "next")
    seams = materialize(seams.mapInArrow(_at_seams, _SCHEMA), "op6-seams")
    cols = ["doc_id", *_COLS]
    return made.where("place is null").select(*cols).unionByName(seams.select(*cols))


def _filled(fingerprint: str = "fingerprint") -> Column:
    """Digits of a fingerprint before its end."""
    return F.length(F.regexp_replace(fingerprint, "-", ""))


def _alike(least: float, short: int):
    def links(table: pa.Table) -> pa.Table:
        """Links of bucket partners that join two labels for the first time."""
        cids, marks = table.column("cid").to_pylist(), table.column("fingerprint").to_pylist()
        label = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
        n, pad = max(map(len, marks)), ord("-")
        x = np.frombuffer("".join(m.ljust(n, "-") for m in marks).encode(), np.uint8).reshape(len(marks), n)
        bands = x.reshape(len(x), -1, BAND)
        whole, bands = (bands != pad).all(axis=2), np.ascontiguousarray(x).view(np.uint64)
        few = (x != pad).sum(axis=1) <= short
        spans = np.repeat([_octave(k)[1] - _octave(k)[0] for k in range(n // SAMPLES)], SAMPLES)
        out = []
        for i in range(len(x)):
            partner = ((bands == bands[i]) & whole & whole[i]).any(axis=1)
            if few[i]:
                partner |= few & ((x[:, :BAND - 1] == x[i, :BAND - 1]) & (x[:, :BAND - 1] != pad)).any(axis=1)
            js = np.flatnonzero(partner & (label != label[i]))
            weight = spans * ((x[js] != pad) | (x[i] != pad))
            same = (weight * (x[js] == x[i])).sum(axis=1) / weight.sum(axis=1)
            for j, v in zip(js, np.clip((same - 1 / 16) / (1 - 1 / 16), 0, 1), strict=True):
                if v >= least and label[j] != label[i]:
                    out.append((cids[i], cids[j], float(v)))
                    label[label == label[j]] = label[i]
        a, b, v = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "likeness": pa.array(v, pa.float64())})
    return links


def neighbours(marked: DataFrame, least: float = 0.5) -> DataFrame:
    """Verified links (a, b, likeness), a < b, that connect all documents (doc_id, fingerprint) which are alike and share
    a band of ``BAND`` sampled digits; not every such pair is given, but its two documents are always connected.

    Texts that end before their first band does have no band.  A partner of one, alike by ``least``, has at most ``short``
    digits and shares one of the first digits with it, so these digits are buckets of texts as short as that.  Equal
    fingerprints are linked to the least doc_id, whatever their bands.  Rows with a null id take no part.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    short = int((BAND - 1) / (least * 15 / 16 + 1 / 16))
    marked = marked.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "fingerprint")
    classes = numbered(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "op6-classes", "cid")
    equal = marked.join(classes, "fingerprint").where("first <> doc_id").select(
        F.col("first").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("likeness")).distinct()

    def buckets(size: int, count: Column) -> Column:
        all_of = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat_ws(
            ":", F.lit(size), i, F.substring("fingerprint", i * size + 1, F.lit(size))))
        return F.filter(all_of, lambda b: ~F.contains(b, F.lit("-")))

    of_short = F.when(_filled() <= short, buckets(1, F.lit(BAND - 1))).otherwise(F.array().cast("array<string>"))
    index = F.concat(buckets(BAND, F.floor(F.length("fingerprint") / BAND).cast("int")), of_short)
    entries = materialize(classes.select("cid", F.explode(index).alias("bucket")), "op6-entries")
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("cid").alias("a")).where(
        "members > 1").select("bucket", "a")
    pairs = entries.join(shared, "bucket").where("a <> cid").select("a", F.col("cid").alias("b")).distinct()

    @F.pandas_udf("double")
    def alike(x, y):
        return x.combine(y, likeness).astype("float64")

    one = lambda c: classes.select(F.col("cid").alias(c), F.col("fingerprint").alias(f"f{c}"))
    star = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", alike("fa", "fb").alias("likeness"))
    star = materialize(star.where(F.col("likeness") >= least), "op6-star")

    labels = connected(star.select("a", "b"), "op6-star").withColumnRenamed("node", "cid")
    named = entries.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    rest = materialize(named.join(mixed.select("bucket"), "bucket"), "op6-rest")
    more = across(rest, classes.select("cid", "fingerprint"), _alike(least, short),
                  "a bigint, b bigint, likeness double", "op6")

    name = lambda c: classes.select(F.col("cid").alias(c), F.col("first").alias(f"id_{c}"))
    found = star.unionByName(more).join(name("a"), "a").join(name("b"), "b").select(
        F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "likeness").where("a <> b")
    return found.unionByName(equal).groupBy("a", "b").agg(F.max("likeness").alias("likeness"))
