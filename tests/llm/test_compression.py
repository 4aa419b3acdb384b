"""Vector codes against plain integer Lloyd rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from growthlens.llm import compression as C

SCHEMA = "vec_id long, embedding array<float>, label int, rid int, entry string, part double, salt int"


def plain(rows, parts=4, entries=256, rounds=4):
    """rows (vec_id, vector, label) -> (vec_id, code, error, label) per kept row, and the codebooks, with Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    first = next((r for r in kept if len(r[1]) % parts == 0), None)
    if first is None:
        return [(r[0], None, None, r[2]) for r in kept], []
    w = len(first[1]) // parts
    vecs = [([[math.floor(1024 * x) for x in r[1][p * w:(p + 1) * w]] for p in range(parts)]
             if len(r[1]) == w * parts else None) for r in kept]
    full = [v for v in vecs if v is not None]
    books = [[v[p] for v in full[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((dist(x, b), e) for e, b in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for v in full:
                got.setdefault(near(p, v[p])[1], []).append(v[p])
            for e, members in got.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for r, v in zip(kept, vecs, strict=True):
        best = v and [near(p, v[p]) for p in range(parts)]
        out.append((r[0], best and "".join(f"{e:02x}" for _, e in best), best and sum(d for d, _ in best), r[2]))
    return out, books


def expected(rows, **how):
    out, books = plain(rows, **how)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    of = {}
    for _, _, error, label in out:
        if error is not None:
            of[label] = of.get(label, 0) + error
    return sorted(((v, c, e, of.get(label), sha) for v, c, e, label in out), key=str)


def made(n, width, seed):
    """Clusters of vectors with copies, ties and odd rows."""
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-1, 1) for _ in range(width)] for _ in range(5)]
    rows = []
    for k in range(n):
        v = rnd.choice(centres) if k % 3 == 0 else [c + rnd.gauss(0, 0.2) for c in rnd.choice(centres)]
        rows.append((k * 7 % n, [float(np.float32(x)) for x in v], rnd.choice([None, 1, 2])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "e", 0.5, 1) for r in rows], SCHEMA).repartition(3)


def test_codes_equal_plain_rounds(spark):
    rows = made(120, 8, 1)
    rows += [rows[5], rows[5], (None, rows[6][1], 2), (500, None, 1), (501, [1.0, None] * 4, 1),
             (502, [float("nan")] * 8, 1), (503, [float("inf")] * 8, None), (504, [0.5] * 12, 2), (505, [], None)]
    got = C.compress(frame(spark, rows), entries=16).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, entries=16)


def test_owners_are_split_and_only_changing_parts_move(spark, monkeypatch):
    rows = [(k, [1.0, 2.0, 3.0, 4.0], 1) for k in range(60)] + made(60, 4, 2)  # a hot group of equal vectors
    monkeypatch.setattr(C, "OWNER_ROWS", 7)
    moves = {}
    monkeypatch.setattr(C, "_moved", lambda parts, name, f=C._moved: moves.setdefault(name, f(parts, name)))
    got = C.compress(frame(spark, rows), entries=8).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, entries=8)
    counts = [moves[k].count() for k in sorted(moves)]
    assert counts[0] == 4 * len(rows) and 0 < sum(counts[1:]) < counts[0]


def test_codes_stand_for_near_vectors(spark):
    rows = made(80, 8, 3)
    coded, books = C.train(frame(spark, rows), entries=64)
    of = {r[0]: r[1] for r in rows}
    for r in coded.collect():
        far = sum((x - math.floor(1024 * y) / 1024) ** 2 for x, y in zip(C.approximate(r.code, books), of[r.vec_id],
                                                                          strict=True))
        assert round(far * 1024 ** 2) == r.error


def test_few_rows_none_and_empty_vectors(spark):
    for rows in ([(1, [0.25, -0.25, 0.75, 1.5], None)], [], [(1, None, 1)], [(1, [], 2), (2, [], 2)], [(3, [1.0], 1)]):
        got = C.compress(frame(spark, rows)).collect()
        assert sorted(map(tuple, got), key=str) == expected(rows)


def test_exact_distances():
    rnd = np.random.default_rng(4)
    for scale in (1 << 10, 1 << 27, 1 << 29):  # float64 sums, then 64-bit integers
        x, b = (rnd.integers(-scale, scale, (n, 3)) for n in (40, 9))
        b[5] = b[2]
        best, least = C.nearest(x, b)
        for k in range(len(x)):
            d = [sum((int(u) - int(v)) ** 2 for u, v in zip(x[k], e, strict=True)) for e in b]
            assert least[k] == min(d) and best[k] == d.index(min(d))
    with pytest.raises(ValueError, match="too large"):
        C.nearest(np.array([[1 << 40]]), np.array([[0]]))
