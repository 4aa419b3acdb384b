"""The pipeline's stages on odd documents, empty tables and the smallest scale."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

from tokenizers import Tokenizer

import corpus_pipeline
from llm_cases import SF_SMALL, edges, empty  # noqa: F401
from test_native import plain_targets
from growthlens.llm import langid
from growthlens.llm.common import tokenizer_file
from growthlens.session import materialize


def test_stages_on_odd_documents(spark, edges, empty):
    for docs in (edges, empty):
        first = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF_SMALL), name)
            assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == first
            if name == "near_copies" and first and docs.count():
                texts = [r.text for r in docs.collect()]
                assert len(texts) == len(set(texts))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_SMALL).count() > 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_language(docs, model):
    out = []
    for d, t, _ in docs:
        p = model.scores(t)
        if p is not None and max(p[:-1]) >= model.reject and max(p[:-1]) > p[-1]:
            out.append((d, t))
    return out


def plain_exact(docs):
    best = {}
    for d, t, _ in docs:
        best[t] = max(best.get(t, -1), -1 if d is None else d)
    return [(None if d < 0 else d, t) for t, d in best.items()]


def plain_near(docs, size=5):
    sets = []
    for _, t, _ in docs:
        w = t.encode().lower().split()
        n = min(size, len(w))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set())
    group = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, (d, t, _) in zip(group, docs, strict=True):
        least[g] = min(least.get(g, (2,)), (d is None, -1 if d is None else d, sha(t), t))
    return [(None if none else d, t) for none, d, _, t in least.values()]


def plain_mixture(docs):
    rows, sizes = defaultdict(list), defaultdict(int)
    for d, t, source in docs:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        sizes[source] += size
        name = "null" if d is None else d
        u = (int(hashlib.md5(f"7:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        weight = 1 / (1 + abs(len(t) / max(size, 1) - 6) / 6)
        rows[source].append((-math.log(u) / max(weight, 1e-6), size, sha(t), d, t))
    out = []
    for source, target in plain_targets(sizes).items():
        epochs = int(target // sizes[source]) if sizes[source] else 0
        before, budget = 0, target - epochs * sizes[source]
        for _, size, _, d, t in sorted(rows[source]):
            out += [(d, t)] * ((epochs + (before + size / 2 <= budget)) if size else 0)
            before += size
    return out


def test_run_against_plain_python(spark, edges, monkeypatch):
    small = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    w = " ".join(r.text for r in small.where("lang = 'en' and doc_id < 40").collect()).split()[:200]
    near = [" ".join(w[:40 * k] + ["new"] + w[40 * k:]) for k in range(5)]
    more = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in zip((None, None, None, 900, 901), near, strict=True)
                                  ], "doc_id long, text string, lang string, source string, n_chars long")
    names = more.columns
    docs = materialize(small.withColumn("doc_id", small["doc_id"] + 1000).select(names).unionByName(
        edges.where("doc_id is not null").select(names)).unionByName(more), "whole")
    frames = [docs]

    def kept(df, name):
        frames.append(materialize(df, name))
        return frames[-1]

    monkeypatch.setattr(corpus_pipeline, "documents", lambda spark, sf_dir: docs)
    monkeypatch.setattr(corpus_pipeline, "materialize", kept)
    corpus_pipeline.run(spark, SF_SMALL)
    assert len(frames) == 6
    model = langid.fit(docs)
    plain = [lambda d: plain_language(d, model), plain_exact, plain_near, plain_mixture]
    tables = [[(r.doc_id, r.text or "", r.source) for r in f.collect()] for f in frames[:5]]
    for (name, _), stage, before, after in zip(corpus_pipeline.STAGES, plain, tables, tables[1:]):
        assert after and Counter((d, t) for d, t, _ in after) == Counter(stage(before)), name
    assert len(tables[0]) > len(tables[1]) > len(tables[2]) > len(tables[3])

    tokenizer = Tokenizer.from_file(tokenizer_file(corpus_pipeline.TOKENIZER))
    ids = {(d, t): tokenizer.encode(t, add_special_tokens=False).ids + [1] for d, t, _ in tables[4]}
    by_id = {d: v for (d, _), v in ids.items()}
    assert len(by_id) == len(ids)  # one text an id, so that pieces name their text
    times = Counter(d for d, _, _ in tables[4])
    packed = {d: [0] * len(v) for d, v in by_id.items()}
    for r in frames[5].collect():
        part = by_id[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(by_id[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        for k in range(r.start, r.start + r.length):
            packed[r.doc_id][k] += 1
    assert all(set(n) == {times[d]} for d, n in packed.items())
