"""Edge documents: absent / null / empty relationships, bad lines, no key."""

import json

from growthlens.session import scratch_path
from growthlens.sources import documents as DOC


def _write(spark, lines):
    path = scratch_path(spark, "docs_test")
    spark.createDataFrame([(ln,) for ln in lines], "value string").coalesce(1).write.text(path)
    return path


def test_edge_documents(spark):
    full = {"data": {"properties": {"permalink": "full", "founded_on": "2010-01-15", "num_employees_min": 1,
                                    "num_employees_max": 10, "total_funding_usd": 100.0},
                     "relationships": {
                         "offices": {"items": [{"properties": {"city": "A", "region": "R", "country": "X"}},
                                               {"properties": {"city": "B", "region": "R", "country": "X"}}]},
                         "funding_rounds": {"items": [
                             {"properties": {"money_raised_usd": None, "announced_on": "2011-01-01"}},
                             {"properties": {"money_raised_usd": 0, "announced_on": "2011-02-01"}},
                             {"properties": {"money_raised_usd": 10.0, "announced_on": None}},
                             {"properties": {"money_raised_usd": 20.0, "announced_on": "2012-01-01"}}]},
                         "investors": {"items": [{"type": "Organization"}, {"type": "Person"}, {"type": "Person"}]},
                         "investments": {"items": [{"relationships": {"funding_round": {"properties": {
                             "money_raised_usd": 5.5}}}}, {"relationships": {}}]},
                         "acquired_by": {"items": [{"type": {"announced_on": "2012-01-15"}}]}}}}
    lines = [json.dumps(full),
             json.dumps({"data": {"properties": {"permalink": "bare"}}}),
             json.dumps({"data": {"properties": {"permalink": "nulls"},
                                  "relationships": {"offices": None, "competitors": None, "funding_rounds": None}}}),
             json.dumps({"data": {"properties": {"permalink": "empty"},
                                  "relationships": {"offices": {"items": []}, "competitors": {"items": []},
                                                    "funding_rounds": {"items": []}}}}),
             "not json",
             "{}"]
    good, bad = DOC.split_documents(DOC.read_documents(spark, _write(spark, lines)))
    assert sorted(r.reason for r in bad.collect()) == ["malformed_json", "missing_permalink"]
    f = {r.p: r for r in DOC.document_features(good, "2015-04-14").collect()}
    assert set(f) == {"full", "bare", "nulls", "empty"}
    a = f["full"]
    assert a.loc_city == "B" and a.num_offices == 2 and a.num_employees == "1-10"
    assert a.age == 24 and a.is_acquired
    assert a.num_funding_rounds == 4 and a.num_rounds_dated == 2
    assert a.funding_per_round == 15.0
    assert (a.num_investors_orgs, a.num_investors_persons) == (1, 2)
    assert a.total_funding_investments == 5.5
    for p in ("bare", "nulls", "empty"):
        r = f[p]
        assert r.loc_city is None and r.num_offices == 0 and r.num_competitors == 0
        assert r.competitors == [] and r.num_rounds_dated == 0 and r.funding_per_round == 0.0
        assert r.age is None and r.is_acquired is False and r.num_employees is None


def test_single_object_files(spark):
    """The service's own file shapes: one JSON object per file."""
    from growthlens import schemas
    from growthlens.sources import keyed_json as KJ
    from growthlens.sources import ranks_io as RIO
    idx = _write(spark, [json.dumps({"acme": {"n": "Acme", "i": None, "s": 0.5, "c": ["A", "B"]},
                                     "zeta": {"n": "Zeta", "i": "x", "s": 0.1, "c": ["B"]}})])
    rows = {r.p: r for r in KJ.read_keyed(spark, idx, schemas.INDEX_ENTRY, "p", whole_file=True).collect()}
    assert rows["acme"].c == ["A", "B"] and rows["zeta"].s == 0.1
    # heap-ordered export (not sorted) is re-ranked by score on import
    ranks = _write(spark, [json.dumps({"K": [{"p": "b", "s": 0.2}, {"p": "a", "s": 0.9}, {"p": "c", "s": 0.2}]})])
    got = [(r.rank, r.p) for r in RIO.import_ranks(spark, ranks, whole_file=True).orderBy("rank").collect()]
    assert got == [(1, "a"), (2, "b"), (3, "c")]


def test_paged_document_equals_whole_document(spark):
    """The same organisation as one document or as three pages."""
    whole = {"data": {"properties": {"permalink": "x", "founded_on": "2010-01-15", "num_employees_min": 5,
                                     "num_employees_max": 5},
                      "relationships": {
                          "headquarters": None,
                          "competitors": {"items": [{"properties": {"permalink": "a"}},
                                                    {"properties": {"permalink": "b"}}]},
                          "offices": {"items": [{"properties": {"city": "A", "region": "R", "country": "X"}},
                                                {"properties": {"city": "B", "region": "R", "country": "X"}}]},
                          "funding_rounds": {"items": [
                              {"properties": {"money_raised_usd": 10.0, "announced_on": "2011-01-01"}},
                              {"properties": {"money_raised_usd": 0, "announced_on": "2012-01-01"}},
                              {"properties": {"money_raised_usd": 30.0, "announced_on": "2013-01-01"}}]},
                          "acquired_by": {"items": [{"type": {"announced_on": "2009-01-01"}},
                                                    {"type": {"announced_on": "2013-06-15"}}]}}}}
    rel = whole["data"]["relationships"]
    pages = [
        {"data": {"page": 0, "properties": whole["data"]["properties"],
                  "relationships": {"competitors": rel["competitors"]}}},
        {"data": {"page": 1, "properties": {"permalink": "x"},
                  "relationships": {"offices": {"items": rel["offices"]["items"][:1]},
                                    "funding_rounds": {"items": rel["funding_rounds"]["items"][:2]},
                                    "acquired_by": {"items": rel["acquired_by"]["items"][:1]}}}},
        {"data": {"page": 2, "properties": {"permalink": "x"},
                  "relationships": {"offices": {"items": rel["offices"]["items"][1:]},
                                    "funding_rounds": {"items": rel["funding_rounds"]["items"][2:]},
                                    "acquired_by": {"items": rel["acquired_by"]["items"][1:]}}}},
    ]
    one, _ = DOC.split_documents(DOC.read_documents(spark, _write(spark, [json.dumps(whole)])))
    many, _ = DOC.split_documents(DOC.read_documents(spark, _write(spark, [json.dumps(p) for p in pages])))
    a = DOC.document_features(one, "2020-01-01").first().asDict()
    b = DOC.document_features(many, "2020-01-01").first().asDict()
    assert a == b
    assert a["loc_city"] == "B" and a["age"] == 41 and a["funding_per_round"] == 20.0
