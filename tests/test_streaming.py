"""Streaming top-k: the reference-rule stream equals a sequential replay; the
exact stream equals the batch top-k of the latest scores."""

import os
import random
import time

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from growthlens.operators import scoring as SC
from growthlens.plans.context import Ctx
from growthlens.session import scratch_path
from growthlens.sources import documents as DOC
from growthlens.sources.tables import read_table
from growthlens.streaming import keyed
from growthlens.streaming import profiles as SP
from growthlens.streaming import topk as ST

from conftest import SF_SMALL


def _replay(events: pd.DataFrame, k: int):
    """The service's rule event by event, on a plain dict of members."""
    out = {}
    for cat, g in events.sort_values(["ts", "event_id"], kind="stable").groupby("event_type", sort=True):
        held = {}
        for user, s in zip(g["user_id"], g["value"]):
            p = f"u{user}"
            if p in held or len(held) < k:
                held[p] = s
                continue
            low = min(held.values())
            worst = max(q for q, v in held.items() if v == low)
            if s > low:
                del held[worst]
                held[p] = s
        out[cat] = sorted(held.items(), key=lambda t: (-t[1], t[0]))
    return out


def test_reference_stream_equals_replay(spark):
    k = 5
    got = ST.run_reference_topk(spark, SF_SMALL, k).toPandas()
    events = read_table(spark, SF_SMALL, "events").toPandas()
    want = _replay(events, k)
    for cat, entries in want.items():
        g = got[got.category == cat].sort_values("rank")
        assert list(zip(g.p, g.s)) == entries


def test_exact_stream_equals_batch(spark):
    got = sorted(tuple(r) for r in ST.run_exact_topk(spark, SF_SMALL, 10).select("category", "rank", "p", "s").collect())
    batch = ST.batch_exact_topk(read_table(spark, SF_SMALL, "events"), 10)
    want = sorted(tuple(r) for r in batch.select("category", "rank", "p", "s").collect())
    assert got == want


def test_batch_reference_topk_equals_replay(spark):
    k = 3
    events = read_table(spark, SF_SMALL, "events")
    got = ST.reference_topk(events, k).toPandas()
    want = _replay(events.toPandas(), k)
    for cat, entries in want.items():
        g = got[got.category == cat].sort_values("rank")
        assert list(zip(g.p, g.s)) == entries


def test_reference_stream_in_several_batches(spark):
    """Two landing files, one per trigger: state carries across batches."""
    events = read_table(spark, SF_SMALL, "events")
    land = scratch_path(spark, "events_landing")
    cut = events.approxQuantile("event_id", [0.5], 0.0)[0]
    events.where(events.event_id <= cut).coalesce(1).write.mode("append").parquet(land)
    events.where(events.event_id > cut).coalesce(1).write.mode("append").parquet(land)
    # one file per trigger; the file source takes the older file first
    out = scratch_path(spark, "topk_two_batches")
    got = ST.run_reference_topk(spark, land, 4, pattern="*.parquet", max_files=1, out=out)
    assert ST._latest_version(spark, out + "/state", below=1) is not None      # batch 0 state
    assert ST._latest_version(spark, out + "/state").endswith("batch_id=1")    # batch 1 built on it
    got_pd = got.toPandas()
    want = _replay(events.toPandas(), 4)
    for cat, entries in want.items():
        g = got_pd[got_pd.category == cat].sort_values("rank")
        assert list(zip(g.p, g.s)) == entries


def _profiles(spark, c, landing):
    """The profiles of all landed documents, scored at once."""
    good, _ = DOC.split_documents(DOC.read_documents(spark, landing))
    return SC.build_profiles(DOC.with_index(DOC.document_features(good), c.world.index), c.packed_trees, c.baselines)


def test_profile_stream_in_three_batches(spark):
    """Header and even pages, then odd pages, then pages sent again with changes: the profiles are those of all pages at
    once, the third batch touches the companies sent again alone, and the top-k follows each of them."""
    c = Ctx(spark, SF_SMALL)
    pages = DOC.build_document_pages(c.world).withColumn("page", F.col("doc.data.page"))
    pages = pages.withColumn("p", F.col("doc.data.properties.permalink"))
    again = [r.p for r in pages.select("p").distinct().orderBy("p").limit(7).collect()]
    sent = pages.where(F.col("p").isin(again)).withColumn("doc", F.col("doc").withField("data.version", F.lit(4)))
    funded = F.col("doc.data.properties.total_funding_usd") * 50 + 1000000
    changed = sent.withColumn("doc", F.when(F.col("page") == 0, F.col("doc").withField(
        "data.properties.total_funding_usd", funded.cast(pages.schema["doc"].dataType["data"].dataType["properties"]
                                                         .dataType["total_funding_usd"].dataType))).otherwise(F.col("doc")))
    land = scratch_path(spark, "pages_landing")
    for part in (pages.where("page % 2 = 0"), pages.where("page % 2 = 1"), changed):
        part.select(F.to_json("doc").alias("value")).coalesce(1).write.mode("append").text(land)
        time.sleep(1.1)  # the file source goes by modification time
    out = scratch_path(spark, "pages_stream")
    scores = c.world.company_category.select("category", "p", "s")
    top = SP.run_profile_topk(spark, land, c.world.index, scores, c.packed_trees, c.baselines, k=4, out=out, max_files=1)
    stored = spark.read.parquet(out + "/profiles")
    counts = {r.batch_id: r["count"] for r in stored.groupBy("batch_id").count().collect()}
    assert sorted(counts) == [0, 1, 2] and counts[2] == len(again)
    assert not os.path.exists(out.removeprefix("file:") + "/pages")
    batch = _profiles(spark, c, land)
    cols = ["p", "age", "success_all", "rate"]
    prof = SP.top_k(stored, ["p"], [F.col("fetched_at").desc()], 1)
    got = sorted(tuple(r) for r in prof.select(*cols).collect())
    assert got == sorted(tuple(r) for r in batch.select(*cols).collect()) and len(got) > 0
    of = {r.p: r.success for r in batch.select("p", "success").collect()}
    want = {}
    for r in scores.collect():
        want.setdefault(r.category, []).append((of[r.p].get(r.category) if r.p in of else r.s, r.p))
    for category, entries in want.items():
        entries.sort(key=lambda e: (e[0] is None, -(e[0] or 0), e[1]))
        mine = top.where(F.col("category") == category).orderBy("rank").collect() if category in list(want)[:3] else None
        assert mine is None or [(r.s, r.p) for r in mine] == entries[:4]


def test_top_k_takes_scores_back(spark):
    """Scores that rise, fall, go null and come late, over several batches and buckets."""
    rnd = random.Random(4)
    feed, out = scratch_path(spark, "feed"), scratch_path(spark, "feed_topk")
    latest, schema = {}, "category string, p string, s double, seq long"
    for batch in range(4):
        rows = [(rnd.choice("ab"), f"p{rnd.randint(0, 60):02d}", rnd.choice([None, 0.0, float(rnd.randint(-5, 5))]),
                 rnd.choice([batch, batch, max(0, batch - 2)])) for _ in range(90)]
        rows = list({(c, p, q): (c, p, s, q) for c, p, s, q in rows}.values())
        rows = [r for r in rows if (r[0], r[1]) not in latest or latest[r[0], r[1]][0] != r[3]]  # one score a seq
        for c, p, s, q in sorted(rows, key=lambda r: r[3]):
            if (c, p) not in latest or q > latest[c, p][0]:
                latest[c, p] = q, s
        spark.createDataFrame(rows, schema).write.mode("append").parquet(feed)
        got = SP.run_topk_stream(spark, feed, 3, out).collect()
        for category in "ab":
            want = sorted(((s is None, -(s or 0.0), p) for (c, p), (_, s) in latest.items() if c == category))[:3]
            mine = sorted((r.rank, r.s is None, -(r.s or 0.0), r.p) for r in got if r.category == category)
            assert [m[1:] for m in mine] == want


def test_bucket_top_rereads_only_when_needed():
    class Entries(dict):
        reads = 0
        containsKey, getValue = dict.__contains__, dict.get  # noqa: N815
        updateValue = dict.__setitem__  # noqa: N815

        def iterator(self):
            self.reads += 1
            return iter(self.items())

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, value):
            self.held = value

    top = keyed.BucketTop(2)
    top.scores, top.top = Entries(), Value()
    send = lambda *rows: [(r.p, r.s) for r in top.handleInputRows(("c", 0), iter([Row(p=p, s=s, seq=q) for p, s, q in rows]), None)]  # noqa: E731,E501
    assert send(("a", 5.0, 1), ("b", 4.0, 1), ("c", 3.0, 1)) == [("a", 5.0), ("b", 4.0)]
    assert send(("c", 4.5, 2)) == [("a", 5.0), ("c", 4.5)] and top.scores.reads == 0
    assert send(("a", 4.6, 2)) == [("a", 4.6), ("c", 4.5)] and top.scores.reads == 0  # falls, but stays ahead
    assert send(("a", 1.0, 3)) == [("c", 4.5), ("b", 4.0)] and top.scores.reads == 1  # a non-member is better now
    assert send(("a", 9.0, 2)) == [("c", 4.5), ("b", 4.0)] and top.scores.reads == 1  # late


def test_company_pages_of_one_bucket(monkeypatch):
    """Many companies a key: new ones are written without a look-up, pages sent again or over several chunks replace and
    add, and each company comes out once."""
    import json

    class Entries(dict):
        reads = 0
        exists = dict.__len__
        updateValue = dict.__setitem__  # noqa: N815

        def getValue(self, key):  # noqa: N802
            self.reads += 1
            return self.get(key)

    monkeypatch.setattr(keyed, "PAGES_AN_ENTRY", 2)
    pages = keyed.CompanyPages()
    pages.companies, pages.blocks = Entries(), Entries()

    def send(*rows):
        sent = [dict(p=p, page=page, version=v, at=0, body=json.dumps({"n_offices": n}), hdr="{}" if page == 0 else None,
                     office=f"o{page}") for p, page, v, n in rows]
        parts = iter([pd.DataFrame(sent[:3]), pd.DataFrame(sent[3:], columns=list(sent[0]))])
        got = [(r.p, r.n_offices, r.last_office) for out in pages.handleInputRows((7,), parts, None)
               for r in out.itertuples()]
        assert len({p for p, *_ in got}) == len(got)
        return got

    assert send(("a", 0, 1, 3), ("b", 1, 1, 1), ("a", 2, 1, 2), ("a", 2, 0, 9)) == [("a", 5, "o2")]
    assert pages.companies.reads + pages.blocks.reads == 0
    assert send(("b", 0, 1, 4), ("c", 0, 1, 6)) == [("b", 5, "o1"), ("c", 6, "o0")]
    assert send(("a", 0, 2, 1), ("a", 2, 0, 8)) == [("a", 3, "o2")]
    monkeypatch.setattr(keyed, "CHUNK", 2)
    assert send(("d", 0, 1, 1), *[("d", k, 1, k) for k in range(1, 6)], ("a", 5, 1, 7)) == [("d", 16, "o5"), ("a", 10, "o5")]


def test_bucket_top_looks_up_only_what_it_may_hold(monkeypatch):
    class Entries(dict):
        reads = 0
        updateValue = dict.__setitem__  # noqa: N815

        def getValue(self, key):  # noqa: N802
            self.reads += 1
            return self.get(key)

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, value):
            self.held = value

    for known, reads in ((keyed.KNOWN, 1), (0, 4)):
        monkeypatch.setattr(keyed, "KNOWN", known)
        monkeypatch.setattr(keyed, "CHUNK", 3)
        top = keyed.BucketTop(2)
        top.scores, top.top = Entries(), Value()
        sent = [("a", 5.0, -1), ("b", 4.0, -1), ("a", 1.0, 0), ("c", 3.0, -1), ("d", 2.0, 0), ("d", 9.0, -1), ("b", 0.5, 0),
                ("e", None, 0)]
        rows = iter([Row(p=p, s=s, seq=q) for p, s, q in sent])
        top._reread = lambda: sorted(((p, s) for (p,), (_, s) in top.scores.items()), key=lambda e: keyed._order(*e))[:2]
        assert [(r.p, r.s) for r in top.handleInputRows(("c", 0), rows, None)] == [("c", 3.0), ("d", 2.0)]
        assert top.scores.reads == reads


def test_replayed_events_are_dropped_and_their_ids_forgotten(spark, tmp_path):
    events = read_table(spark, SF_SMALL, "events")
    want = sorted(tuple(r) for r in ST.batch_exact_topk(events, 10).select("category", "rank", "p", "s").collect())
    pdf = events.toPandas().sort_values(["ts", "event_id"])
    half = len(pdf) // 2
    land = tmp_path / "land"
    land.mkdir()
    parts = [pdf[:half], pdf[:half], pdf[half:], pdf[half:]]  # every event twice, in the order of time
    for i, part in enumerate(parts):
        part.to_parquet(land / f"events-{i}.parquet", coerce_timestamps="us", index=False)
        os.utime(land / f"events-{i}.parquet", (1_700_000_000 + i * 60,) * 2)
    seen = []
    out = str(tmp_path / "out")
    span = (pdf.ts.max() - pdf.ts.min()).total_seconds()
    got = ST.run_exact_topk(spark, str(land), 10, "events-*.parquet", 1, out, dedup_within=f"{int(span // 4) + 1} seconds",
                            on_progress=seen.append)
    assert sorted(tuple(r) for r in got.select("category", "rank", "p", "s").collect()) == want
    held = [op["numRowsTotal"] for p in seen for op in p["stateOperators"] if "edup" in op["operatorName"]]
    dropped = sum(op["customMetrics"].get("numDroppedDuplicateRows", 0) for p in seen for op in p["stateOperators"]
                  if "edup" in op["operatorName"])
    # the watermark moves after a batch: the batch after the last new events forgets the ids before it
    assert max(held) <= len(pdf) and held[-1] < max(held) and dropped > 0
