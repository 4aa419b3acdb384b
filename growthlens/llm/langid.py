"""Language identification: averaged hashed subword embeddings under a linear softmax (operator 4).

Subwords are the runs of ``SIZES`` bytes of the lower-cased UTF-8 text that lie inside a word (white space, digits and
ASCII punctuation count as the word's boundary, which may stand at either end of a run).  Each is hashed to one of
``BUCKETS`` rows of an embedding table; a document is the mean of its rows, and a linear softmax over it gives the
languages' probabilities, and that of ``noise``.  Both tables are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows (``MAX_TRAIN`` documents, as many of each language, and an excerpt of each), collected as hashed counts (at most
BUCKETS numbers a document), never as text.  Noise is made from the sample: documents with their letters shuffled,
random letters, and letters of other scripts.  A sixth of the documents, with all that is made of them, is held back: on
it the temperature of the softmax is fitted, and the rejection score is the one at which the share of its language rows
that are rejected plus the share of its noise that is kept is least (``Model.lost``, ``Model.kept``).  A document is
rejected if noise is its top class or its score is below that.  A language is always predicted.

Prediction is a map over whole texts: embedding and softmax are folded into one table of BUCKETS x languages floats,
which is all that the tasks receive.  lang, source and doc_id are no inputs of a prediction.

Defined cases: null text, empty text and text without a letter give ``und`` with score 0; without any labelled row
everything is ``und``; null languages are not learned; repeated rows give repeated results; an empty table gives an empty result; other columns pass or are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

BUCKETS = 1 << 14
SIZES = (1, 2, 3, 4)
DIM = 16
MAX_TRAIN = 1200
EPOCHS = 15
LEAST_STEPS = 700
RATE = 0.5
NOISE_CHARS = 4000
PIECE = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_BOUNDARY = np.zeros(256, bool)
_BOUNDARY[:0x80] = [not chr(c).isalpha() for c in range(0x80)]


def _buckets(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket numbers of all subwords of a piece of lower-cased bytes that begins and ends with a boundary."""
    edge = _BOUNDARY[raw]
    code = np.where(edge, 0x20, raw).astype(np.uint32)
    inner = np.cumsum(edge)
    for n in SIZES:
        if len(code) < n + 1:
            continue
        h = np.full(len(code) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ code[k:len(code) - n + 1 + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(13)
        last = inner[n - 1:] - edge[n - 1:]  # boundaries before the last byte of the run
        ok = last - inner[:len(h)] <= 0 if n > 1 else ~edge
        if n > 1:
            ok &= ~(edge[:len(h)] & edge[n - 1:]) | (n > 2)
        yield (h[ok] * np.uint32(0x9E3779B1) >> np.uint32(18)).astype(np.int64)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """The whole text in pieces of bounded size; a piece ends at a boundary, or inside a word longer than it."""
    raw = b" " + text.lower().encode("utf-8", "ignore") + b" "
    at = 0
    while at < len(raw) - 1:
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            space = raw.rfind(b" ", at + 1, end)
            end = space + 1 if space > 0 else end
        yield np.frombuffer(raw, np.uint8, end - at, at)
        at = end - 1


def counts(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for piece in _pieces(text):
        for b in _buckets(piece):
            total += np.bincount(b, minlength=BUCKETS)
    return total


@dataclass(frozen=True)
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x (languages and noise)
    bias: np.ndarray
    temperature: float
    reject: float
    lost: float = 0.0  # share of the held-back language rows that are rejected
    kept: float = 0.0  # share of the held-back noise that is not

    def scores(self, text: str | None) -> np.ndarray | None:
        """Probabilities of the languages and of noise; None if the text has no letter or no language is known."""
        if not text or not self.langs or not _LETTER.search(text):
            return None
        total, n = np.zeros(len(self.langs) + 1), 0
        for piece in _pieces(text):
            for b in _buckets(piece):
                total += self.table[b].sum(axis=0, dtype=np.float64)
                n += len(b)
        return _softmax((total / max(n, 1) + self.bias) / self.temperature)

    def rejects(self, p: np.ndarray) -> np.ndarray:
        """Whether rows of probabilities are rejected: noise is the top class, or no language has enough."""
        best = p[..., :-1].max(axis=-1)
        return (p[..., -1] >= best) | (best < self.reject)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str], back: np.ndarray,
          seed: int = 5) -> Model:
    """rows: the buckets and counts of each document; y: the language's number, len(langs) for noise; back: whether it
    is held back.  Rows become vectors of BUCKETS floats a few at a time."""
    k = len(langs) + 1
    if not langs:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)

    def dense(ks: np.ndarray) -> np.ndarray:
        x = np.zeros((len(ks), BUCKETS), np.float32)
        for i, k in enumerate(ks):
            at, n = rows[k]
            x[i, at] = n / np.float32(max(n.sum(), 1))
        return x

    if back.all():  # a few rows
        back = ~back
    held = np.flatnonzero(back)
    used = rng.permutation(np.flatnonzero(~back))
    emb = rng.normal(0, 1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    seen = np.zeros(BUCKETS, bool)
    epochs = max(EPOCHS, -(-LEAST_STEPS * 32 // len(used)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for a in range(0, len(used), 32):
            some = rng.permutation(used)[:32] if len(used) < 32 else used[a:a + 32]
            xs = dense(some)
            h = xs @ emb
            p = _softmax(h @ out + bias)
            p[np.arange(len(some)), y[some]] -= 1
            g = p / len(some)
            spot = np.flatnonzero(xs.any(axis=0))
            seen[spot] = True
            emb[spot] -= 60 * rate * (xs[:, spot].T @ (g @ out.T))
            out -= rate * (h.T @ g)
            bias -= rate * g.sum(axis=0)
        rng.shuffle(used)
    emb[~seen] = 0  # says nothing
    z = np.zeros((len(rows), k))
    for a in range(0, len(held), 32):
        z[held[a:a + 32]] = dense(held[a:a + 32]) @ emb @ out + bias
    model = Model(langs, (emb @ out).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    if not len(held):
        return model
    loss = lambda t: -np.log(_softmax(z[held] / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.2, 5, 60), key=loss))
    return replace(model, temperature=temperature, **rejection(_softmax(z[held] / temperature), y[held] == len(langs)))


def rejection(p: np.ndarray, made: np.ndarray) -> dict[str, float]:
    """reject, lost and kept for the probabilities of held-back rows, of which ``made`` are noise: the score of least
    lost + kept; of several the highest of those that lose least, since what held-back languages never score is unsure."""
    best = p[:, :-1].max(axis=1)
    top = p[:, -1] >= best
    ends = np.unique(np.concatenate([[0.0], best, [1.0]]))

    def errors(reject: float) -> tuple[float, float]:
        gone = top | (best < reject)
        return (float(gone[~made].mean()) if (~made).any() else 0.0, float((~gone[made]).mean()) if made.any() else 0.0)

    reject = min(((ends[1:] + ends[:-1]) / 2).tolist(), key=lambda t: (round(sum(errors(t)), 9), errors(t)[0], -t))
    lost, kept = errors(reject)
    return {"reject": reject, "lost": lost, "kept": kept}


def noise(text: str, kind: int) -> str:
    """Text of no language, made from a document: letters shuffled, random letters, or another script."""
    rng = np.random.default_rng([kind, zlib.crc32(text.encode("utf-8", "ignore"))])
    at = int(rng.integers(0, max(1, len(text) - NOISE_CHARS + 1)))
    text = text[at:at + NOISE_CHARS]
    letters = [i for i, c in enumerate(text) if c.isalpha()]
    if kind == 0:
        made = [text[i] for i in rng.permutation(letters)]
    elif kind == 1:
        made = [chr(97 + i) for i in rng.integers(0, 26, len(letters))]
    else:
        low, high = ((0x391, 0x3C9), (0x410, 0x44F), (0x5D0, 0x5EA), (0x621, 0x64A), (0x4E00, 0x9FA5))[rng.integers(0, 5)]
        made = [chr(i) for i in rng.integers(low, high + 1, len(letters))]
    out = list(text)
    for i, c in zip(letters, made, strict=True):
        out[i] = c
    return "".join(out)


def excerpt(text: str) -> str:
    """Two to thirteen words in a row: languages are also learned from short texts."""
    words = text.split()
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "ignore")))
    n = int(rng.integers(2, 14))
    at = int(rng.integers(0, max(1, len(words) - n + 1)))
    return " ".join(words[at:at + n])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Train on at most about ``max_train`` distinct labelled rows that are not held out (at least one a language)."""
    rows = docs.select(docs["doc_id"], docs["lang"].cast("string").alias("lang"), text_of(docs).alias("text"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # the mark is of the id and the text: rows that share an id are drawn one by one, and copies of a row once
    rows = rows.withColumn("mark", F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id", "text"), 1))
    sizes = {r["lang"]: r for r in rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.min("mark").alias("least")).orderBy("lang").collect()}
    if not sizes:
        return train([], np.zeros(0, int), [], np.zeros(0, bool))
    langs = sorted(sizes)
    top = (1 << 63) - 1
    limits = {lang: max(r["least"], min(top, top * max_train // (len(langs) * r["n"]))) for lang, r in sizes.items()}
    limit = F.element_at(F.create_map(*[F.lit(v) for item in limits.items() for v in item]), F.col("lang"))
    picked = rows.where(F.col("mark") <= limit).dropDuplicates(["lang", "mark"]).select("lang", "text")

    def features(batches):
        for pdf in batches:
            both = [*zip(pdf["lang"], pdf["text"], strict=True)]
            back = [zlib.crc32(t.encode("utf-8", "ignore")) % 6 == 0 for _, t in both]
            texts = [(lang, t, b) for (lang, t), b in zip(both, back, strict=True)]
            texts += [(lang, excerpt(t), b) for (lang, t), b in zip(both, back, strict=True)]
            for k, ((_, t), b) in enumerate(zip(both, back, strict=True)):
                if b or k % 4 == 0:
                    texts.append((None, noise(t, k % 3), b))
                if b or k % 4 == 2:
                    texts.append((None, noise(excerpt(t), k % 3), b))
            got = [counts(t) for _, t, _ in texts]
            spots = [np.flatnonzero(c) for c in got]
            yield pd.DataFrame({"lang": [lang for lang, _, _ in texts], "back": [b for _, _, b in texts],
                                "at": [s.astype(np.int32).tobytes() for s in spots],
                                "n": [c[s].astype(np.int32).tobytes() for c, s in zip(got, spots, strict=True)]})

    made = picked.mapInPandas(features, "lang string, back boolean, at binary, n binary")
    sample = sorted(((r[0] is None, r[0] or "", r[1], r[2], r[3]) for r in made.collect()))
    y = np.array([len(langs) if none else langs.index(lang) for none, lang, _, _, _ in sample], int)
    return train([(np.frombuffer(at, np.int32), np.frombuffer(n, np.int32).astype(np.float32))
                  for _, _, _, at, n in sample], y, langs, np.array([r[2] for r in sample], bool))


def predicted(model: Model, text: Column) -> Column:
    """struct<lang_pred, score, rejected> of a text."""
    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def guess(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            p = model.scores(t)
            best = 0 if p is None else int(p[:-1].argmax())
            out.append(("und", 0.0, True) if p is None else (
                model.langs[best], float(p[best]), bool(model.rejects(p))))
        return pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])
    return guess(text)


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs)
    rows = docs.select(docs["doc_id"], text_of(docs).alias("text"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                       predicted(model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose language is rejected; all columns pass unchanged."""
    model = fit(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of(docs).alias("text"))
    kept = rows.withColumn("p", predicted(model, F.col("text"))).where(~F.col("p.rejected"))
    return kept.select("row.*")
