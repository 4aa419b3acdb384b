"""Re-sent documents, shared scratch folders and leaves without counts."""

import json

import pytest
from pyspark.sql import functions as F

from growthlens import config, session
from growthlens.operators import scoring as SC
from growthlens.operators import trees as T
from growthlens.operators.scoring import category_score
from growthlens.sources import documents as DOC


def _page(p, page, version, offices):
    return json.dumps({"data": {"page": page, "version": version, "properties": {"permalink": p, "name": f"{p}{version}"},
                                "relationships": {"offices": {"items": [{"properties": {"city": f"v{version}"}}] * offices}}}})


def test_latest_version_of_a_page_wins(spark, tmp_path):
    path = str(tmp_path / "docs")
    lines = [_page("a", 0, 1, 1), _page("a", 0, 2, 3), _page("a", 1, 1, 2), _page("b", 0, 0, 1), _page("b", 0, 0, 1)]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    good, bad = DOC.split_documents(DOC.read_documents(spark, path))
    got = {r.p: (r.name, r.num_offices) for r in DOC.document_features(good).collect()}
    assert got == {"a": ("a2", 5), "b": ("b0", 1)} and bad.count() == 0


def test_later_batch_wins_where_versions_are_equal(spark):
    rows = spark.createDataFrame([("a", 0, 0, 0, 1), ("a", 0, 0, 1, 7)], "p string, page long, version long, batch_id int, n int")
    assert [r.n for r in DOC.latest_pages(rows).collect()] == [7]


def test_unindexed_documents_are_quarantined(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(_page("z", 0, 0, 1),)], "value string").write.text(path)
    good, _ = DOC.split_documents(DOC.read_documents(spark, path))
    got = DOC.not_in_index(good, spark.createDataFrame([("a",)], "p string")).collect()
    assert [(r.p, r.reason) for r in got] == [("z", "not_in_index")]


def test_every_reason_of_quarantine(spark, tmp_path):
    path, known = str(tmp_path / "docs"), sorted(config.WORLD_TREES)[0]
    doc = json.loads(_page("a", 0, 0, 1))
    doc["data"]["relationships"]["categories"] = {"items": [{"properties": {"name": x}} for x in
                                                            (known, "untaught", "untaught", "elsewhere")]}
    lines = [json.dumps(doc), _page("z", 0, 0, 1), _page(None, 0, 0, 1), "not json"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    index = spark.createDataFrame([("a", 0.5, [known, "untaught"])], "p string, s double, c array<string>")
    good, bad = DOC.split_documents(DOC.read_documents(spark, path))
    scores = SC.score_categories(DOC.with_index(DOC.document_features(good), index),
                                 T.pack_constant_trees(spark, config.WORLD_TREES))
    rows = bad.unionByName(DOC.not_in_index(good, index)).unionByName(DOC.without_model(scores)).collect()
    assert sorted((r.reason, r.p) for r in rows) == [("malformed_json", None), ("missing_permalink", None),
                                                     ("no_model", "a"), ("not_in_index", "z")]
    assert [r.raw for r in rows if r.reason == "no_model"] == ["untaught"]
    assert [r.category for r in scores.where("reason = 'ok'").collect()] == [known]


def test_leaf_without_counts_has_no_score(spark):
    df = spark.createDataFrame([(0.5, 0, 0)], "s double, n0 long, n1 long")
    assert df.select(category_score(F.col("s"), F.col("n0"), F.col("n1")).alias("x")).first().x is None


@pytest.mark.parametrize("master,cluster", [("local", False), ("local[8]", False), ("local-cluster[1,1,512]", True),
                                            ("yarn", True), ("spark://h:7077", True)])
def test_cluster_masters(master, cluster):
    assert session.is_cluster(master) == cluster
