"""Near duplicates, language ID, files, fingerprints, packing and counting against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from llm_cases import SF_SMALL, edges, empty  # noqa: F401
from growthlens.llm import bitpack, components, counting, fingerprints, langid, minhash, packing, pieces
from growthlens.llm.common import tokenizer_file

WORDS, BYTES = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")
ODD = [" ", "  ", "\n", "\t", "\xa0", "\x1c", "a", "The", "'s", "1", "é", "é", "<|endoftext|>", "!", "...", "́", "中",
       "\U0001F600", "Σ", "İ", "\x85"]


def plain_components(docs, size):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[find(i)].append(d)
    return [(docs[i][0], len(sets[i]), min((d for d in least[find(i)] if d is not None), default=None))
            for i in range(len(docs))]


def test_near_duplicates(spark, edges):
    rnd = random.Random(2)
    family = [f"w{rnd.randint(0, 10**6)}" for _ in range(120)]
    texts = []
    for k in range(60):  # edits of one text: some linked, some only near
        w = list(family)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
        texts.append(" ".join(w))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    small = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    for df in (edges, small.unionByName(made.selectExpr("doc_id + 100000 as doc_id", "text"))):
        docs = [(r.doc_id, r.text) for r in df.collect()]
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()), key=str)
        assert got == sorted(plain_components(docs, 4), key=str)


def test_connected(spark):
    rnd = random.Random(9)
    path = [(k, k + 1) for k in range(100, 400)] + [(1000 - k, 999 - k) for k in range(200)]
    star = [(5000, 5001 + k) for k in range(100)] + [(6000 - k, 6001) for k in range(100)]
    some = [(rnd.randint(7000, 7300), rnd.randint(7000, 7300)) for _ in range(200)]
    edges = path + star + some + star[:20] + [(9, 9), (8, 3), (3, 8)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = components.connected(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)
    assert components.connected(spark.createDataFrame([], "a long, b long"), "test").collect() == []


def test_one_row_of_each_component_stays(spark):
    def copies(name, n):
        w = [f"{name}{k}" for k in range(200)]
        return [" ".join(w[:40 * k] + ["new"] + w[40 * k:]) for k in range(n)]

    nameless, again, other = copies("a", 4), copies("b", 4), copies("c", 3)
    rows = [(None, t) for t in nameless] + list(zip((5, 5, 7, None), again, strict=True)) + [(5, t) for t in other]
    rows += [(None, ""), (8, "")]
    got = minhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    first = lambda texts: min(texts, key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    want = [(None, first(nameless)), (5, first(again[:2])), (5, first(other)), (None, ""), (8, "")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_language(spark, edges):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98 and sum(r.rejected for r in got) < 5
    model = langid.fit(docs)
    assert model.scores("12 34") is None and model.scores(None) is None
    assert model.scores("zxq wvk pqr ghtk mnbv lkjh qqzx vvkp")[:-1].max() < model.reject
    odd = langid.identify(edges).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in odd if r.doc_id in (3, 4, 5, 6))


def test_rejection_is_fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    assert len(model.langs) == 4 and model.reject > 0.25 and model.lost < 0.05 and model.kept < 0.05
    assert model.rejects(np.array([[0.25, 0.25, 0.25, 0.25, 0], [0, 0.21, 0, 0, 0.79], [0, 0.97, 0, 0, 0.03]])).tolist() \
        == [True, True, False]
    texts = [r.text for r in docs.where("doc_id % 4 = 0").collect() if r.text]
    made = spark.createDataFrame([(k, langid.noise(t, k % 3)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = made.select(langid.predicted(model, made["text"]).alias("p")).select("p.*").collect()
    assert np.mean([r.rejected for r in got if r.lang_pred != "und"]) > 0.97
    # scores of held-back rows: languages at 0.6 and more, noise up to 0.4; the threshold lies where both end
    p = np.array([[0.9, 0, 0.1], [0, 0.7, 0.3], [0.6, 0.3, 0.1], [0.4, 0.3, 0.3], [0.1, 0.3, 0.6]])
    fitted = langid.rejection(p, np.array([False, False, False, True, True]))
    assert 0.4 < fitted["reject"] < 0.6 and fitted["lost"] == fitted["kept"] == 0


def test_language_of_rows_that_share_an_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").limit(400)
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    for ids in ([0] * len(rows), [None] * len(rows)):
        same = spark.createDataFrame([(i, *r) for i, r in zip(ids, rows * 3, strict=False)],
                                     "doc_id long, text string, lang string")
        got = langid.identify(same.withColumn("told", same.lang)).count()
        assert got == len(rows)
        model = langid.fit(same, max_train=40)
        assert len(model.langs) == len({lang for _, lang in rows})
    copies = spark.createDataFrame([(1, "one text of words alone", "en")] * 3000, "doc_id long, text string, lang string")
    assert langid.fit(copies, max_train=10).langs == ["en"]
    one = langid.identify(copies.limit(1)).collect()
    assert one[0].lang_pred == "en" and 0 <= one[0].score <= 1


def test_noise_is_made_of_any_place():
    text = "a" * 9000 + "b" * 9000
    made = {c for k in range(30) for c in langid.noise(f"{k}" + text, 0)}
    assert {"a", "b"} <= made and len(langid.noise(text, 0)) == langid.NOISE_CHARS


@pytest.mark.parametrize("path,kind", [(WORDS, "words"), (BYTES, "spaces")])
def test_pieces_equal_the_library(path, kind):
    rnd = random.Random(3)
    encoder = pieces.PieceEncoder(path, kind)
    for _ in range(20):
        texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 14))) for _ in range(100)]
        ids, at = encoder.encode(pa.array(texts))
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[at[k]:at[k + 1]].tolist() for k in range(len(texts))] == want


def test_unseen_parts_go_to_the_library_in_lines():
    """Plain parts led by a space share a line; the library gets far fewer texts than there are parts, with the same ids."""
    encoder, rnd = pieces.PieceEncoder(BYTES, "spaces"), random.Random(4)
    texts = [" ".join("".join(rnd.choices("abcdefgh", k=9)) for _ in range(60)) + ", (3) don't  \n\ttab\x1cend" for _ in range(9)]
    texts += [" caf\u00e9 \u4e2d\u6587 <|endoftext|> x", " ", "", "a", " \x1c b", "\u3000 \u3000z y"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    asked = []
    encoder._one_by_one = lambda some, real=encoder._one_by_one: asked.append(len(some)) or real(some)
    ids, at = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want
    assert sum(asked) < 0.2 * len(encoder._young.slots)


@pytest.mark.parametrize("path,kind", [(WORDS, "words"), (BYTES, "spaces")])
def test_slices_equal_the_library(path, kind, monkeypatch):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{SF_SMALL}/documents.parquet", columns=["text"])["text"].combine_chunks()
    monkeypatch.setattr(pieces, "SLICE_BYTES", 30_000)
    monkeypatch.setattr(pieces, "MEMO_PIECES", 2_000)
    encoder = pieces.PieceEncoder(path, kind)
    got = [ids[at[k]:at[k + 1]].tolist() for _, ids, at in encoder.slices(texts) for k in range(len(at) - 1)]
    assert got == [e.ids for e in encoder.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 31, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1000, dtype=np.uint64).astype(np.uint32)
    data = bitpack.pack(ids, width)
    assert len(data) == -(-1000 * width // 8) and (bitpack.unpack(data, 1000, width) == ids).all()


def test_stored_tokens(edges, tmp_path):
    t = Tokenizer.from_file(WORDS)
    rows = bitpack.stored_tokens(edges, WORDS, folder=str(tmp_path / "shards")).collect()
    assert len(rows) == edges.count()
    want = defaultdict(list)
    for r in edges.collect():
        want[r.doc_id].append(t.encode(r.text or "", add_special_tokens=False).ids + [2])
    at, last = 0, -1
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and (r.doc_id is None or r.doc_id >= last)
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in want[r.doc_id] and r.n_tokens == len(ids)
        at, last = at + len(ids), 10**9 if r.doc_id is None else r.doc_id
    name = sorted((tmp_path / "shards").iterdir())[0]
    with open(name, "rb") as f:
        shard = bitpack.Shard(f, name.stat().st_size)
        whole = shard.read(0, shard.n_ids)
        assert (shard.read(1, shard.n_ids - 1) == whole[1:]).all() and len(shard.read(0, 0)) == 0


def test_fingerprints(edges):
    df = edges.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    text = {r.doc_id: r.text or "" for r in df.collect()}
    order = sorted(text, reverse=True)
    for k, i in enumerate(order):
        t, nx = text[i], text[order[(k + 1) % len(order)]]
        edited = t[:len(t) - len(t) // 2] + nx[:len(t) // 2]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        alone = fingerprints.pair([t], [edited])[0]
        assert (r.fingerprint, r.edited_fingerprint) == (alone[2], fingerprints.pair([edited], [t])[0][2])
    assert rows[0].fingerprint == rows[1].fingerprint
    one = fingerprints.fingerprints(edges.where("doc_id = 15")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.fingerprints(edges).count() == edges.count()


def test_edit_likeness_and_bands(spark):
    rnd = random.Random(4)
    a = "".join(rnd.choice("abcdefghij ") for _ in range(4000))
    b = a[:2000] + "Z" + a[2001:]
    c = "".join(rnd.choice("abcdefghij ") for _ in range(4000))
    mark = {t: fingerprints.pair([t], [t])[0][2] for t in (a, b, c)}
    assert fingerprints.likeness(mark[a], mark[b]) > 0.8 > 0.3 > fingerprints.likeness(mark[a], mark[c])
    df = spark.createDataFrame([(1, mark[a]), (2, mark[b]), (3, mark[c])], "doc_id long, fingerprint string")
    assert [(r.a, r.b) for r in fingerprints.neighbours(df).collect()] == [(1, 2)]


def connected_sets(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    out = defaultdict(set)
    for n in nodes:
        out[find(n)].add(n)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("block", [3, 500])
def test_neighbours_connect_what_brute_force_does(spark, block, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", block)
    rnd = random.Random(6)
    make = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    opening, texts = make(300), []
    for _ in range(12):  # pairs of alike texts behind an opening that all of them share
        t = make(3000)
        texts += [opening + t, opening + t[:1500] + "Z" + t[1501:]]
    texts = [opening + make(3000)] + texts + ["", "", "a", "a", "b", "ab", "abc", "abd", "ba", "hello", "hello!", texts[0]]
    mark = [fingerprints.pair([t], [t])[0][2] for t in texts]
    digits = [m.rstrip("-") for m in mark]

    def partners(i, j):
        bands = [{(k, m[k:k + 8]) for k in range(0, len(m) - 7, 8)} for m in (digits[i], digits[j])]
        short = max(len(digits[i]), len(digits[j])) <= 13 and any(x == y for x, y in zip(digits[i][:7], digits[j][:7]))
        return mark[i] == mark[j] or bands[0] & bands[1] or short

    n = len(texts)
    close = [(i, j) for i in range(n) for j in range(i) if fingerprints.likeness(mark[i], mark[j]) >= 0.5]
    df = spark.createDataFrame(list(enumerate(mark)), "doc_id long, fingerprint string")
    got = fingerprints.neighbours(df).collect()
    assert connected_sets(range(n), [(r.a, r.b) for r in got]) == connected_sets(range(n), [p for p in close if partners(*p)])
    # very short texts miss no partner at all
    assert all(partners(i, j) for i, j in close if min(len(digits[i]), len(digits[j])) < 8)
    assert all(r.a < r.b and r.likeness == fingerprints.likeness(mark[r.a], mark[r.b]) for r in got)
    assert fingerprints.neighbours(df.limit(0)).collect() == []


def test_neighbours_behind_a_shared_band(spark):
    rnd = random.Random(7)
    b = [rnd.choice("0123456789abcdef") for _ in range(64)]
    c = [("0" if d != "0" else "1") if k >= 8 and k % 8 == 3 else d for k, d in enumerate(b)]  # shares the first band only
    a = b[:8] + [("0" if d != "0" else "1") for d in b[8:]]
    df = spark.createDataFrame([(k, "".join(m)) for k, m in enumerate((a, b, c))], "doc_id long, fingerprint string")
    assert [(r.a, r.b) for r in fingerprints.neighbours(df).collect()] == [(1, 2)]


def test_packing(edges):
    t = Tokenizer.from_file(BYTES)
    df = edges.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(df, BYTES).collect()
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in df.collect()}
    windows, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id][r.start:r.start + r.length] and r.length > 0
        assert r.doc_tokens == len(want[r.doc_id])
        windows[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length))
    for parts, sizes in ((windows, None), (docs, want)):
        for key, got in parts.items():
            at = 0
            for start, n in sorted(got):
                assert start == at
                at += n
            assert at == len(sizes[key]) if sizes else at <= 2048 and at & (at - 1) == 0
    assert set(docs) == set(want)
    assert packing.pack(edges, BYTES).select("sequence_id", "offset").distinct().count() >= len(rows)


def test_packing_makes_windows_of_every_tier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    rows = packing.pack(docs, BYTES).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "tier", "step_group").collect()
    held, parts, groups = defaultdict(int), defaultdict(list), defaultdict(lambda: defaultdict(int))
    for r in rows:
        held[r.sequence_id, r.tier] += r.length
        parts[r.doc_id, r.doc_tokens].append((r.start, r.length))
        groups[r.tier, r.step_group][r.sequence_id] += r.length ** 2
    windows = [tier for _, tier in held]
    assert all(n == tier for (_, tier), n in held.items())  # no padding
    assert all(windows.count(tier) >= 20 for tier in packing.TIERS)
    assert sum(tier not in packing.TIERS for tier in windows) <= 8  # the last remainder alone
    fit = [len(p) for (_, n), p in parts.items() if n <= packing.WINDOW]
    assert sum(k > 1 for k in fit) <= 0.05 * len(fit)
    for (_, n), p in parts.items():
        assert sum(k for _, k in p) == n
    for tier in packing.TIERS:
        cost = [sum(w.values()) for (t, _), w in groups.items() if t == tier and len(w) == packing.STEP]
        assert max(cost) <= 1.5 * min(cost)


def test_packer_places_each_id_once():
    rnd = random.Random(8)
    for _ in range(50):
        packer, windows = packing.Packer(), []
        sizes = [rnd.choice([1, rnd.randint(1, 300), rnd.randint(1, 3000), rnd.randint(1, 20000), 2048, 4096])
                 for _ in range(rnd.randint(0, 40))]
        for d, n in enumerate(sizes):
            windows += packer.add(d, n)
            if rnd.random() < 0.1:
                windows += packer.drain(last=False)
        windows += packer.drain(last=True)
        assert packer.waiting == 0 and all(sum(p[0] for p in w) in {1 << k for k in range(12)} for w in windows)
        for d, n in enumerate(sizes):
            at = 0
            for length, _, start in sorted((p for w in windows for p in w if p[1] == d), key=lambda p: p[2]):
                assert start == at and length > 0
                at += length
            assert at == n


def test_counting(edges):
    t = Tokenizer.from_file(BYTES)
    n = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) for r in edges.collect()}
    for r in counting.count_tokens(edges, BYTES).where("doc_id is not null").collect():
        assert r.n_tokens == n[r.doc_id] and r.over_limit == (r.n_tokens > 1024)
    rnd = random.Random(5)
    for k in range(600):
        text = "".join(rnd.choice(ODD[5 * (k % 7 == 0):]) for _ in range(rnd.randint(0, 200)))
        assert counting.count_huge(text, t, rnd.choice([16, 40]), rnd.choice([4, 12])) == len(
            t.encode(text, add_special_tokens=False).ids)


def test_empty_tables(empty, tmp_path):
    assert minhash.near_duplicates(empty).collect() == []
    assert langid.identify(empty).collect() == []
    assert bitpack.stored_tokens(empty, WORDS, folder=str(tmp_path / "none")).collect() == []
    assert fingerprints.fingerprints(empty).collect() == []
    assert packing.pack(empty, BYTES).collect() == []
    assert counting.count_tokens(empty, BYTES).collect() == []
