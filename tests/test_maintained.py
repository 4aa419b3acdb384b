"""Search index, bucketed profile table and baselines kept up over batches, against recomputation from all rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from growthlens.operators import maintained as MB
from growthlens.operators import search as SE
from growthlens.operators.scoring import category_baselines
from growthlens.sources import bucketed_store as BS
from growthlens.sources import search_index as SI

WORDS = ["inc", "solar", "Data", "lab", "ab", "x", "Ünïcode", "banana", "aaaa", ""]


def _name(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 4)))


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """An index after four batches, and the names as a dict kept beside it."""
    rng, path = random.Random(5), str(tmp_path_factory.mktemp("index") / "i")
    truth = {f"p{i}": _name(rng) for i in range(60)}
    df = lambda rows: spark.createDataFrame(list(rows), "p string, n string")
    SI.create(path, df(truth.items()))
    for batch in (1, 2, 3):
        change = {p: None if rng.random() < .3 else _name(rng) for p in rng.sample([f"p{i}" for i in range(80)], 25)}
        SI.update(path, df(change.items()), batch)
        truth.update(change)
    SI.update(path, df(change.items()), 3)  # the last batch runs again
    return path, {p: n for p, n in truth.items() if n is not None}


def test_index_matches_a_loop_over_the_names(spark, grown):
    path, truth = grown
    asked = [(i, q) for i, q in enumerate(["solar", "INC data", "aaa", "nan banana", "ünï", "zzz", "ab x", "", None])]
    got = {(r.query_id, r.p): r.kpos for r in
           SI.matches(spark, path, spark.createDataFrame(asked, "query_id int, q string")).collect()}
    want = {}
    for i, q in asked:
        for pos, key in enumerate((q or "").lower().split(" ")):
            for p, n in truth.items():
                if len(key) >= 3 and key in n.lower():
                    want.setdefault((i, p), pos)
    assert got == want


def test_frequencies_count_current_names(spark, grown):
    path, truth = grown
    want = {}
    for n in truth.values():
        for t in {n.lower()[i:i + 3] for i in range(len(n) - 2)}:
            want[t] = want.get(t, 0) + 1
    assert {r.tri: r.freq for r in SI.frequencies(spark, path).collect()} == want
    assert {r.p: r.n for r in SI.current_names(spark, path).collect()} == truth


def test_merged_index_gives_the_same(spark, grown, tmp_path):
    path, _ = grown
    queries = spark.createDataFrame([(1, "inc solar")], "query_id int, q string")
    merged = SI.create(str(tmp_path / "m"), SI.current_names(spark, path))
    rows = lambda at: sorted(map(tuple, SI.matches(spark, at, queries).collect()))
    assert rows(merged) == rows(path) and len(SI.commits(spark, merged)) == 1


def test_uncommitted_segment_is_not_read(spark, tmp_path):
    path = SI.create(str(tmp_path / "i"), spark.createDataFrame([("a", "solar")], "p string, n string"))
    spark.createDataFrame([("a", "lunar")], "p string, n string").write.parquet(f"{path}/segment-1/names")
    assert [r.n for r in SI.current_names(spark, path).collect()] == ["solar"]
    with pytest.raises(ValueError):
        SI.update(path, spark.createDataFrame([("a", "x")], "p string, n string"), 0)


def test_index_and_names_give_one_search(spark, tmp_path):
    index = spark.createDataFrame([("a", "Solar Inc", None, .5), ("b", "inc lab", "i", .2), ("c", "moon", None, .9)],
                                  "p string, n string, i string, s double")
    queries = spark.createDataFrame([(1, "inc"), (2, "solar inc"), (3, "x")], "query_id int, q string")
    path = SI.create(str(tmp_path / "i"), index.select("p", "n"))
    found = SI.matches(spark, path, SE.accepted_queries(queries))
    assert sorted(map(tuple, SE.search(index, queries, found).collect())) == \
        sorted(map(tuple, SE.search(index, queries).collect()))


def test_empty_index(spark, tmp_path):
    path = SI.create(str(tmp_path / "i"), spark.createDataFrame([], "p string, n string"))
    queries = spark.createDataFrame([(1, "inc")], "query_id int, q string")
    assert SI.matches(spark, path, queries).count() == 0


# ------------------------------------------------------------------ profile table
ROWS = "p string, fetched_at int, v string"


def _rows(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def _dict(df):
    return {r.p: (r.fetched_at, r.v) for r in df.collect()}


def _buckets(path, batch):
    return sorted(int(d.split("=")[1]) for d in os.listdir(f"{path}/batch={batch}") if d.startswith("bucket="))


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = BS.create(str(tmp_path / "t"), _rows(spark, [(f"p{i}", 1, "a") for i in range(300)]), buckets=16)
    touched = BS.upsert(path, _rows(spark, [("p7", 2, "b"), ("p8", 0, "older"), ("new", 1, "n")]), 1)
    assert _buckets(path, 1) == touched and len(touched) <= 3 and len(_buckets(path, 0)) == 16
    got = _dict(BS.read(spark, path))
    assert got.pop("new") == (1, "n") and got.pop("p7") == (2, "b")
    assert got == {f"p{i}": (1, "a") for i in range(300) if i != 7}
    assert _dict(BS.read(spark, path, below=1))["p7"] == (1, "a")


def test_batch_that_runs_again_gives_the_same_table(spark, tmp_path):
    path = BS.create(str(tmp_path / "t"), _rows(spark, [("a", 1, "x"), ("a", 1, "y"), ("b", 1, None), (None, 1, "n")]))
    update = _rows(spark, [("a", 1, "z"), ("a", 1, "w"), (None, 2, "m")])
    BS.upsert(path, update, 1)
    first = _dict(BS.read(spark, path))
    BS.upsert(path, update, 1)
    assert first == _dict(BS.read(spark, path)) == {"a": (1, "z"), "b": (1, None), None: (2, "m")}


def test_lookup_opens_the_buckets_of_its_keys(spark, tmp_path):
    path = BS.create(str(tmp_path / "t"), _rows(spark, [(f"p{i}", 1, "a") for i in range(300)]), buckets=16)
    keys = spark.createDataFrame([("p5",), ("p6",), ("none",), (None,)], "p string")
    part = BS.rows_of(keys, path)
    assert len({os.path.dirname(f) for f in part.inputFiles()}) <= 4 and part.count() == 2
    assert {r.p: r.v for r in BS.profile_lookup(keys, path, ["v"]).collect()} == {"p5": "a", "p6": "a", "none": None, None: None}
    assert {r.p: r.has_profile for r in BS.has_profile(keys, path).collect()} == \
        {"p5": True, "p6": True, "none": False, None: False}
    many = spark.range(40).select(F.concat(F.lit("p"), "id").alias("p"))
    assert BS.profile_lookup(many, path, ["v"]).where("v = 'a'").count() == 40


def test_files_carry_a_bloom_filter_on_the_key(spark, tmp_path):
    rows = [(f"p{i}", 1, "a") for i in range(2000)]
    sizes = []
    for name, create in (("t", lambda at: BS.create(at, _rows(spark, rows), buckets=1)),
                         ("plain", lambda at: _rows(spark, rows).coalesce(1).write.parquet(f"{at}/batch=0/bucket=0"))):
        create(str(tmp_path / name))
        folder = f"{tmp_path}/{name}/batch=0/bucket=0"
        sizes.append(sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".parquet")))
    assert sizes[0] > sizes[1] + 1024


def test_empty_table_grows(spark, tmp_path):
    path = BS.create(str(tmp_path / "t"), _rows(spark, []))
    assert BS.read(spark, path).count() == 0 and BS.upsert(path, _rows(spark, []), 1) == []
    BS.upsert(path, _rows(spark, [("a", 1, "x")]), 2)
    assert _dict(BS.read(spark, path)) == {"a": (1, "x")}


# ---------------------------------------------------------------------- baselines
def test_baselines_after_batches_equal_recomputation(spark, tmp_path):
    rng, path = random.Random(9), str(tmp_path / "b")
    schema = "p string, categories array<string>, mf double, fetched_at int"

    def row(i, batch):
        cats = rng.sample(["u", "v", "w", None], rng.randint(0, 2)) + (["v", "v"] if i % 9 == 0 else [])
        return (f"p{i}", cats, None if rng.random() < .2 else round(rng.uniform(0, 1e6), 3), batch)

    truth = {r[0]: r for r in (row(i, 0) for i in range(120))}
    MB.start(path, spark.createDataFrame(list(truth.values()), schema), buckets=4)
    reread = 0
    for batch in (1, 2, 3):
        best = max((r for r in truth.values() if r[2] is not None and r[1]), key=lambda r: r[2])
        changed = [row(i, batch) for i in rng.sample(range(140), 30)] + [(best[0], [], None, batch)]
        changed = list({r[0]: r for r in changed}.values())
        reread += MB.update(path, spark.createDataFrame(changed, schema), batch)
        truth.update({r[0]: r for r in changed})
    MB.update(path, spark.createDataFrame(changed, schema), 3)  # the last batch runs again
    assert reread > 0
    every = spark.createDataFrame([(i, *r[1:3]) for i, r in enumerate(truth.values())], "k int, categories array<string>, mf double")
    # age 7 gives one month, so the funding is the monthly funding
    features = every.select("k", F.col("mf").alias("total_funding"), F.lit(7).cast("bigint").alias("age"))
    zero = every.where("mf = 0").count()
    want = category_baselines(every.select("k", F.explode("categories").alias("category")), features, 0).collect()
    got = {r.category: r for r in MB.baselines(spark, path, 0).collect()}
    assert zero == 0 and set(got) == {r.category for r in want}
    for r in want:
        assert (got[r.category].t, got[r.category].r) == (r.t, r.r)
        assert got[r.category].m == pytest.approx(r.m, abs=1e-5) and got[r.category].d == pytest.approx(r.d, abs=1e-4)
