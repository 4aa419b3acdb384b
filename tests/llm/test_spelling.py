"""Spelling variants against plain comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

from llm_cases import SF_SMALL, edges, empty  # noqa: F401
from growthlens.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_near(a, b):
    """Exactly one inserted, deleted or replaced code point, by trying each place."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    form, count = {}, {}
    for w in n:
        near = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, ()) if v != w and is_near(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w], count[w] = (best if best and n[best] >= 10 * n[w] else None), len(near)
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out)


def made(spark):
    """Chains of forms, all kinds of edits at all places, repeated letters, long words and a hot group."""
    rnd = random.Random(5)
    words = Counter({"Governmênt": 2000, "governmént": 150, "governént": 12, "aaaaaaaa": 40, "aaaaaaa": 3,
                     "aaaaaaaaa": 400, "x" * 5000: 3, "x" * 4000 + "y" + "x" * 999: 30, "x" * 4999: 2, "abcabca": 2,
                     "bcabcab": 2, "abcabcab": 2, "×÷×÷×÷×": 2})
    for base in ("settlement", "séparations", "zzzzzzzzzz"):
        words[base] += 60
        for _ in range(40):
            w, k = list(base), rnd.randrange(len(base))
            w[k:k + rnd.randint(0, 1)] = rnd.choice(["", "a", "é", "z"])
            words["".join(w)] += rnd.randint(1, 6)
    for _ in range(300):  # a third of the words around one middle
        words["hotpre" + "".join(rnd.choice("abc") for _ in range(rnd.randint(4, 5))) + "hotend"] += 2
    return spark.createDataFrame([(10**6 + k, f"{w} " * c) for k, (w, c) in enumerate(words.items())],
                                 "doc_id long, text string")


def test_words_forms_and_roots(spark, edges):  # noqa: F811
    small = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    for docs in (edges, small.unionByName(made(spark)).repartition(5)):
        got = S.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
        want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert sorted(map(tuple, got)) == want
    assert any(form and root != form for _, form, root, *_ in want)


def test_large_groups_are_halved(spark, monkeypatch):
    docs = made(spark)
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    for group, cells in ((20, 1 << 22), (2, 64)):
        monkeypatch.setattr(S, "GROUP", group)
        monkeypatch.setattr(S, "CELLS", cells)
        assert sorted(map(tuple, S.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())) == want


def test_pairs_are_found_once(spark):
    known = spark.createDataFrame([(w, 2) for w in ("aaaaaaa", "aaaaaaaa", "aaaaaaab", "baaaaaaa", "aaaabaaa")],
                                  "word string, n long")
    got = sorted((r.word, r.near) for r in S.near_words(known).collect())
    words = [r.word for r in known.collect()]
    assert got == sorted((a, b) for a in words for b in words if a != b and is_near(a, b))


def test_no_words(spark, empty):  # noqa: F811
    assert S.variants(empty).collect() == []
    assert S.variants(spark.createDataFrame([(1, None), (2, ""), (3, "short one")], "doc_id long, text string")).collect() == []
