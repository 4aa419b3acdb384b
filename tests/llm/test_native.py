"""Exact dedup, personal data, secrets and mixing against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest

import __spark_entry__ as E
from llm_cases import SF_SMALL, edges, empty  # noqa: F401
from growthlens.llm import credentials, exact_dedup, mixing, pii
from growthlens.plans.check import compare


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("block", [4, 4096])
def test_exact_dedup(edges, block):
    got = exact_dedup.exact_dedup(edges, block).collect()
    rows = edges.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[sha(r.text or "")].append(r.doc_id)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    for key in groups:
        assert sum(r.kept for r in got if r.text_sha256 == key) == 1
    kept = exact_dedup.drop_exact_copies(edges)
    assert kept.columns == edges.columns and kept.count() == len(groups)


def test_op1_matches_oracle(spark, duck_small):
    r = compare(E.queries()["op1_exact_dedup"](spark, SF_SMALL), E.oracle_sql()["op1_exact_dedup"], duck_small)
    assert r["ok"], r


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    ok = {"email": lambda h, d: True, "ip": lambda h, d: all(int(x) <= 255 for x in h.split(".")),
          "card": lambda h, d: 14 <= len(d) <= 19 and luhn(d), "phone": lambda h, d: 10 <= len(d) <= 15}
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    return sorted((m.start(), no, k, m.end()) for no, (k, p) in enumerate(pats.items()) for m in re.finditer(p, text)
                  if ok[k](m[0], re.sub("[^0-9]", "", m[0])))


def secret(text):
    pats = {"assign": r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    least = {"assign": 6, "access": 20, "hex": 24}
    return sorted((m.start(), no, k, m.end()) for no, (k, p) in enumerate(pats.items()) for m in re.finditer(p, text)
                  if len(m[2] if k == "assign" else m[0]) >= least[k])


def base_of(found):
    return sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in found))


NOISE = ["a@b.c", "_", "@", "..", "1.2.3.4", "255", ".", " ", "-", "4111111111111111", "+", "(", "AKIA", "Z9", "token", "=",
         ":", "'", "beef", "0a", "PassWord", "x" * 30, "f" * 25, "é", "\U0001F600", "\n", "12345678901234"]


def test_spans_against_python(spark, edges):
    import random
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(NOISE) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rnd.choice(NOISE) for _ in range(4000)) for _ in range(3)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for df in (docs, edges):
        text = {r.doc_id: r.text or "" for r in df.where("doc_id is not null").collect()}
        for fn, plain in ((lambda d: pii.digest(pii.find_personal_data(d)), personal),
                          (lambda d: credentials.digest(credentials.find_secrets(d)), secret)):
            rows = [r for r in fn(df).collect() if r.doc_id is not None]
            assert rows and all(r.base_sha256 == base_of(plain(text[r.doc_id])) for r in rows)


def test_added_spans_and_scores(edges):
    by = {r.doc_id: r for r in pii.digest(pii.find_personal_data(edges)).collect()}
    assert by[10].spans.split(",")[0].startswith("iban:5:") and "ssn:" in by[10].spans
    assert by[9].n_card == 1 and by[9].n_ip == 1 and by[9].n_email == 2


def test_ownership_separates_examples(spark):
    rows = [(i, f"token = shared{0:08d}", f"s{i % 4}") for i in range(8)] + [(9, "token = onlyhere99", "s1")]
    got = {r.doc_id: r for r in credentials.digest(credentials.find_secrets(
        spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert got[0].n_example == 1 and got[9].n_live == 1


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, fixed, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 2 * sizes[s] for s in over}
        free -= set(over)
    return fixed


def test_mixing(spark, edges):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for df in (docs, edges):
        rows = df.select("source", "text").collect()
        sizes = defaultdict(int)
        for r in rows:
            sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        want = plain_targets(sizes)
        got = mixing.mix(df).collect()
        taken, most = defaultdict(int), defaultdict(int)
        assert len(got) == len(rows)
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken <= 2 * r.size
            taken[r.source] += r.taken
            most[r.source] = max(most[r.source], r.size)
        assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1 for s in sizes)
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns


def test_cut_bins_are_narrowed(spark, monkeypatch):
    ids = [*range(300), *[None] * 150, *[7] * 150]
    rows = [(i, "x" * 400 + f"{k} y" * (k % 3), "long" if k % 5 else "more") for k, i in enumerate(ids)]  # low weights
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = sorted(map(str, mixing.mix(docs).collect()))
    most, ordered = [], mixing._ordered

    def watched(inside):
        most.append(max((r["count"] for r in inside.groupBy("source").count().collect()), default=0))
        return ordered(inside)

    monkeypatch.setattr(mixing, "_ordered", watched)
    monkeypatch.setattr(mixing, "ORDERED", 5)
    monkeypatch.setattr(mixing, "BINS", 8)
    got = mixing.mix(docs)
    assert sorted(map(str, got.collect())) == want and got.count() == len(rows)
    assert len(most) > 1 and 0 < max(most) <= 5


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).collect() == []
    assert pii.digest(pii.find_personal_data(empty)).collect() == []
    assert credentials.digest(credentials.find_secrets(empty)).collect() == []
    assert mixing.mix(empty).collect() == []
