"""Whole-text encoding with a tokenizers vocabulary through a memo of its parts.

A tokenizer cuts a text into parts by its own pattern and encodes each part on its own; so a text's ids are its parts'
ids one after the other, and a part that is remembered need not be encoded again.  The parts of a slice of texts are cut
with ``re`` and looked up in a memo kept by the Python worker, whose slots numpy expands into ids; the library encodes the
parts not yet seen, ``LIBRARY_PARTS`` at a time.  The memo holds at most ``memo`` parts in two generations, so its memory
is bounded; its size changes the speed alone.

Two kinds of tokenizer are supported:

``words``   NFC, lower case; white space is dropped; words, digits and other signs are parts.
``spaces``  byte-level BPE with the usual pattern: a space belongs to the word after it, and runs of white space form
            parts of their own.

The patterns here and the tokenizer's agree on ``_SAFE`` characters: ASCII and precomposed Latin letters, which neither
NFC nor lower-casing splits.  A text with other characters is cut at its spaces instead, and pieces with such characters
are encoded whole: for ``words`` every space is a boundary; for ``spaces`` one is, unless white space (or the end) stands
on both of its sides, and texts with such a space are encoded whole by the library.  Special-token strings hold no space,
so no cut falls inside one; texts that may hold one are treated as those with other characters.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_PIECES = 600_000
LIBRARY_PARTS = 8192
LONG_PART = 64
WORDS_A_LINE = 64
SLICE_BYTES = 1 << 20
LONG_TEXT = 1 << 20
PARTS_AT_ONCE = 1 << 17
_WS = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\x1c-\\x1f]"
#: Parts that begin with a space before a sign that is none.
_LED = re.compile(" \\S+").fullmatch
_UNSURE_SPACE = re.compile(f"(?:^|{_WS}) (?:{_WS}|$)")
_LATIN = "À-ÖØ-öø-įı-ſ"
_SAFE = re.compile(f"[\\x00-\\x7f{_LATIN}]*")
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The tokenizers' own patterns, on safe characters.
_PARTS = {"words": re.compile(f"[a-z{_LATIN}]+|{_ENDINGS}|[0-9]|[^\\sa-z0-9{_LATIN}]+", re.ASCII),
          "spaces": re.compile(f" ?[A-Za-z{_LATIN}]+|{_ENDINGS}| ?[0-9]+| ?[^\\sA-Za-z0-9{_LATIN}]+|\\s+(?!\\S)|\\s+",
                               re.ASCII)}

_loaded: dict[tuple[str, str], PieceEncoder] = {}


def load(path: str, kind: str, memo: int = MEMO_PIECES) -> PieceEncoder:
    """The worker's encoder for a tokenizer file, with a memo of at most ``memo`` parts; kept between tasks."""
    if (path, kind) not in _loaded:
        _loaded[path, kind] = PieceEncoder(path, kind)
    _loaded[path, kind].memo = memo
    return _loaded[path, kind]


def _plain(text: str) -> bool:
    """Whether the patterns here cut the text as the tokenizer does."""
    return "<|" not in text and _SAFE.fullmatch(text) is not None


class Memo:
    """Ids of parts: a slot for each part, and its ids in one pool."""

    def __init__(self) -> None:
        self.slots: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def add(self, names: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n, m = len(self.slots), len(names)
        while n + m > len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.size[n:n + m] = size
        self.begin[n:n + m] = self.used + np.cumsum(size) - size
        self.pool[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.slots.update(zip(names, range(n, n + m), strict=True))

    def drop(self, names: list[str]) -> None:
        """Forget the parts added last."""
        for name in reversed(names):
            self.used = int(self.begin[self.slots.pop(name)])

    def ids(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all slots, the number of ids of each)."""
        size = self.size[index]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.begin[index] - ends + size, size) + np.arange(total)], size


class PieceEncoder:
    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        if kind not in _PARTS:
            raise ValueError(f"unknown kind of tokenizer: {kind}")
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind
        self.memo = MEMO_PIECES
        self._young, self._old = Memo(), Memo()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self._last[[k for name, k in vocabulary.items() if name.endswith("</w>")]] = True
        self._first = np.zeros(len(self._last), bool)  # ids that begin with a space
        self._first[[k for name, k in vocabulary.items() if name.startswith("Ġ")]] = True

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, the number of ids of each) by the library."""
        out, size = array("I"), []
        for a in range(0, len(texts), LIBRARY_PARTS):
            for e in self.tokenizer.encode_batch_fast(texts[a:a + LIBRARY_PARTS], add_special_tokens=False):
                ids = e.ids
                out.extend(ids)
                size.append(len(ids))
        return np.frombuffer(out, np.uint32) if out else np.zeros(0, np.uint32), np.array(size, np.int64)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_one_by_one``; plain parts are encoded some in a line: of ``words`` each ends with an id for word ends, of
        ``spaces`` each must begin with the only space in it, and so its ids with one for a space."""
        if len(texts) > 1 and (self.kind == "words" or all(map(_LED, texts))):
            lines = [("" if self.kind == "spaces" else " ").join(texts[a:a + WORDS_A_LINE])
                     for a in range(0, len(texts), WORDS_A_LINE)]
            if all(map(_plain, lines)):
                ids, _ = self._one_by_one(lines)
                cuts = (np.flatnonzero(self._last[ids]) + 1 if self.kind == "words"
                        else np.append(np.flatnonzero(self._first[ids]), len(ids))[1:])
                if len(cuts) == len(texts) and cuts[-1] == len(ids) and (self.kind == "words" or self._first[ids[0]]):
                    return ids, np.diff(cuts, prepend=0)
        return self._one_by_one(texts)

    def _parts(self, text: str) -> list[str]:
        """Parts of a text whose ids, one after the other, are those of the text."""
        if _plain(text):
            return _PARTS[self.kind].findall(text.lower() if self.kind == "words" else text)
        if self.kind == "spaces" and _UNSURE_SPACE.search(text):
            return [text]
        first, *others = text.split(" ")
        lead = "" if self.kind == "words" else " "
        out = []
        for piece in [first, *[lead + p for p in others]]:
            if _plain(piece):
                out += _PARTS[self.kind].findall(piece.lower() if self.kind == "words" else piece)
            else:
                out.append(piece)
        return out

    def _learn(self, names: list[str]) -> None:
        """Take parts into the young memo, from the old one or else by the library."""
        old = self._old.slots
        known = [p for p in names if p in old]
        self._young.add(known, *self._old.ids(np.array([old[p] for p in known], np.int64)))
        new = [p for p in names if p not in old]
        if _plain("".join(new)):
            led, safe, other = new, [], []
        else:
            led, safe, other = [], [], []
            for p in new:
                (led if _plain(p) else other).append(p)
        if self.kind == "spaces":
            safe = [p for p in led if not _LED(p)]
            led = [p for p in led if _LED(p)]
        for some in (led, safe, other):
            self._young.add(some, *self._library(some))

    def _ids_of(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all parts, the number of ids of each)."""
        slots, long = self._young.slots, []
        found = np.fromiter(map(slots.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            names = [parts[k] for k in missing.tolist()]
            new = list(dict.fromkeys(names))
            long = [p for p in new if len(p) > LONG_PART]
            self._learn([p for p in new if len(p) <= LONG_PART])
            self._young.add(long, *self._one_by_one(long))
            found[missing] = np.fromiter(map(slots.__getitem__, names), np.int64, len(names))
        out = self._young.ids(found)
        self._young.drop(long)
        if len(slots) > self.memo // 2:
            self._old, self._young = self._young, Memo()
        return out

    def _long(self, text: str) -> np.ndarray:
        """The ids of a long text, some of its parts at a time."""
        if not _plain(text):
            return self._ids_of(self._parts(text))[0]
        cut = _PARTS[self.kind].finditer(text.lower() if self.kind == "words" else text)
        out = [np.zeros(0, np.uint32)]
        while some := [m.group() for m in islice(cut, PARTS_AT_ONCE)]:
            out.append(self._ids_of(some)[0])
        return np.concatenate(out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)``: the ids of text k are ids[offsets[k]:offsets[k + 1]].  Null counts as empty."""
        blocks: list[np.ndarray] = [np.zeros(0, np.uint32)]
        sizes: list[np.ndarray] = []
        parts: list[str] = []
        ends: list[int] = []  # of the texts that wait, in parts

        def flush() -> None:
            ids, size = self._ids_of(parts)
            blocks.append(ids)
            sizes.append(np.diff(np.concatenate([[0], np.cumsum(size)])[ends], prepend=0))
            parts.clear()
            ends.clear()

        for text in texts.to_pylist():
            if text and len(text) > LONG_TEXT:
                flush()
                blocks.append(self._long(text))
                sizes.append(np.array([len(blocks[-1])]))
                continue
            if text:
                parts += self._parts(text)
            ends.append(len(parts))
        flush()
        return np.concatenate(blocks), np.concatenate([[0], *sizes]).cumsum().astype(np.int64)

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``encode`` over slices of about SLICE_BYTES: (number of the first text, ids, offsets)."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield a, *self.encode(texts.slice(a, b - a))
