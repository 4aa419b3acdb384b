"""Token counts of whole texts, huge ones by overlap resynchronisation (operator 8).

Texts of up to ``CHUNK`` characters are encoded whole.  A longer text is encoded in chunks that overlap by ``OVERLAP``
characters, with offsets.  Two chunks are spliced at a proven stable boundary in their overlap: a position where a
non-space character is followed by white space, which the tokenizer's pattern always makes a token boundary, where both
encodings have one, and from which ``AGREE`` tokens are the same in both.  Tokens of the earlier chunk count up to there,
those of the later one from there.  The earlier chunk began at a boundary proven in the same way, so by induction every
counted token is one of the whole text's.  If the overlap holds no such position the next chunk starts further left and
the overlap doubles, up to the whole earlier chunk; if that too fails (a long text without white space) the earlier
chunk itself grows.  A special-token string holds no white space, so a boundary never lies inside one.

Row-local, no shuffle; memory is one text's chunks.

Defined cases: null text counts as empty and has 0 bytes and 0 tokens; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import text_of

CHUNK = 1 << 15
OVERLAP = 512
AGREE = 4


def _ends(encoding) -> np.ndarray:
    return np.array([e for _, e in encoding.offsets], np.int64)


def _splice(text: str, left, a: int, right, b: int, proven: int) -> int | None:
    """The last stable boundary in the overlap of the encodings ``left`` (which starts at a and is proven right from
    ``proven`` on) and ``right`` (which starts at b)."""
    le, re = _ends(left) + a, _ends(right) + b
    lids, rids = left.ids, right.ids
    common = np.intersect1d(le[:-AGREE], re[:-AGREE])
    for p in common[::-1].tolist():
        if max(b, proven) < p < len(text) and text[p] in " \t\n\r" and not text[p - 1].isspace():
            i, j = int(np.searchsorted(le, p, "right")), int(np.searchsorted(re, p, "right"))
            if lids[i:i + AGREE] == rids[j:j + AGREE] and (le[i:i + AGREE] == re[j:j + AGREE]).all():
                return p
    return None


def count_huge(text: str, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of a text, encoded in overlapping chunks."""
    encode = lambda a, b: tokenizer.encode(text[a:b], add_special_tokens=False)
    total, begin, end, proven = 0, 0, min(len(text), chunk), 0
    left, counted = encode(begin, end), 0  # counted: tokens of ``left`` before its first own one
    while end < len(text):
        wide, at = overlap, None
        while True:
            start = max(begin, end - wide)
            stop = min(len(text), start + max(chunk, 2 * wide))
            right = encode(start, stop)
            at = _splice(text, left, begin, right, start, proven)
            if at is not None or start == begin:
                break
            wide *= 2
        if at is None:  # no boundary in the whole chunk: it has to grow
            end = min(len(text), begin + 2 * (end - begin))
            left = encode(begin, end)
            continue
        total += int(np.searchsorted(_ends(left) + begin, at, "right")) - counted
        counted = int(np.searchsorted(_ends(right) + start, at, "right"))
        left, begin, end, proven = right, start, stop, at
    return total + len(left.ids) - counted


def count_tokens(docs: DataFrame, path: str, kind: str = "spaces", limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit."""
    rows = docs.select(docs["doc_id"], text_of(docs).alias("text"))

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = pieces.load(path, kind)
        for texts in batches:
            n = np.zeros(len(texts), np.int64)
            small = np.flatnonzero(texts.str.len().to_numpy() <= CHUNK)
            for a, _, at in encoder.slices(pa.array(texts.iloc[small], pa.large_string())):
                n[small[a:a + len(at) - 1]] = np.diff(at)
            for k in np.flatnonzero(texts.str.len().to_numpy() > CHUNK):
                n[k] = count_huge(texts.iloc[k], encoder.tokenizer)
            yield pd.Series(n)

    got = rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), tokens("text").alias("n_tokens"))
    return got.withColumn("over_limit", F.col("n_tokens") > limit)
