"""Model files of any size: written by tasks, parsed when loaded, and walked in parts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from growthlens import config
from growthlens.operators import training as TRN
from growthlens.operators import trees as T
from growthlens.session import scratch_path

EMPS = ["", "1-10", "11-50", "25", None]


def _vec(rnd):
    return [None if i == config.EMPLOYEES_SLOT or rnd.random() < 0.1 else rnd.choice([float(rnd.randint(0, 9)), rnd.random()])
            for i in range(len(config.VECTOR_SLOTS))]


def _nested(node, nodes):
    """The model-file object of a node table, branch by branch."""
    r = nodes[node]
    if r.col < 0:
        return {"col": -1, "results": {c: n for c, n in (("0", r.n0), ("1", r.n1)) if n}}
    return {"col": r.col, "value": r.value, "tb": _nested(node + "t", nodes), "fb": _nested(node + "f", nodes)}


def test_trees_of_any_size_are_written_by_tasks(spark, monkeypatch):
    """No bound on the nodes, and no text in the driver: files of trees hold what the node table holds."""
    from growthlens.operators import tree_growth as TG
    rnd = random.Random(2)
    names = ["Hardware + Software", "Big Data", "50% \u00e9t\u00e9 #1", "pure"]
    rows = [(c, 1 if c == "pure" else int(rnd.random() < 0.4), _vec(rnd), rnd.choice([*EMPS, 'a "b"']))
            for c in names for _ in range(150)]
    df = spark.createDataFrame(rows, "category string, label int, vec array<double>, emp string")
    grown = {}
    for r in TG.grow(df).collect():
        grown.setdefault(r.category, {})[r.node] = r
    want = {c: json.dumps(_nested("r", nodes), separators=(",", ":")) for c, nodes in grown.items()}
    assert max(len(nodes) for nodes in grown.values()) > 20
    monkeypatch.setattr(TRN, "MAX_FILE_NODES", 5, raising=False)  # the bound of former rounds
    monkeypatch.setattr(TRN, "train_trees", None)
    folder = TRN.write_tree_texts(TRN.tree_texts(df), scratch_path(spark, "tree_files"))
    assert {r.category: r.json for r in TRN.load_tree_texts(spark, folder).collect()} == want
    loaded = {r.category: r for r in TRN.load_trees(spark, folder).collect()}
    assert {c: (r.json_chars, r.n_nodes) for c, r in loaded.items()} == {c: (len(want[c]), len(grown[c])) for c in names}
    nodes = sorted((r.category, r.node, r.tb, r.fb) for r in T.tree_nodes(TRN.load_trees(spark, folder)).collect())
    assert nodes == sorted((c, node, *((node + "t", node + "f") if r.col >= 0 else (None, None)))
                           for c, of in grown.items() for node, r in of.items())


def test_no_trees_and_trees_without_a_name(spark):
    none = spark.createDataFrame([], "category string, label int, vec array<double>, emp string")
    folder = TRN.write_tree_texts(TRN.tree_texts(none), scratch_path(spark, "tree_files"))
    assert TRN.load_trees(spark, folder).count() == 0
    unnamed = spark.createDataFrame([(None, '{"col":-1,"results":{}}')], "category string, json string")
    with pytest.raises(ValueError):
        TRN.write_tree_texts(unnamed, scratch_path(spark, "tree_files"))


def test_load_trees_parses_each_file(spark, monkeypatch):
    """S3 reads and parses: the query gives the trees' sizes, and a file that holds no tree stops the run."""
    import __spark_entry__ as E
    from growthlens.plans import catalog
    folder = TRN.write_tree_files(spark, config.WORLD_TREES, scratch_path(spark, "tree_files"))
    monkeypatch.setattr(catalog, "_trained_tree_folder", lambda spark, sf: folder)
    got = {r.category: r.asDict() for r in E.queries()["load_trees"](spark, "").collect()}
    for category, text in config.WORLD_TREES.items():
        tree = T.flatten_tree(category, text)
        assert got[category] == {"category": category, "json_chars": len(text), "n_nodes": len(tree["ids"]), "depth": 4}
    TRN.write_tree_files(spark, {"cut": config.WORLD_TREES["BUILDING"][:-1]}, folder)
    with pytest.raises(Exception, match="JSONDecodeError"):
        E.queries()["load_trees"](spark, "").collect()


def test_walk_in_parts_equals_the_walk_row_by_row(spark, monkeypatch):
    """Nulls, NaN, short and missing vectors, categories without a tree, several parts of a category."""
    rnd = random.Random(3)
    rows = []
    for i in range(500):
        vec = [rnd.choice([None, float("nan"), float(rnd.randint(0, 120))]), None, *[float(rnd.randint(0, 15)) for _ in range(8)],
               rnd.choice([0.0, 270000.0, 500000.0, float("nan")]), rnd.random()]
        vec = rnd.choice([vec, vec, vec, vec[:rnd.randint(0, 11)], None])
        rows.append((f"c{i}", rnd.choice([*sorted(config.WORLD_TREES), "MACHINERY", None]), vec, rnd.choice(EMPS)))
    df = spark.createDataFrame(rows, "p string, category string, vec array<double>, emp string").repartition(3)
    unnumbered = '{"col":0,"value":"x","tb":{"col":-1,"results":{}},"fb":{"col":1,"value":null,"tb":{"col":-1},"fb":{"col":-1,"results":{"0":7}}}}'  # noqa: E501
    trees = config.WORLD_TREES | {"HOUSEHOLD": unnumbered, "of no row": unnumbered}
    packed = T.pack_trees(T.tree_texts_from_constants(spark, trees))
    want = sorted(map(str, T.predict(df, packed).collect()))
    monkeypatch.setattr(T, "WALK_ROWS", 30)
    assert sorted(map(str, T.predict(df, packed, T.MAX_ROW_MODEL_BYTES + 1).collect())) == want
    assert sorted(map(str, T.predict(df.limit(0), packed, T.MAX_ROW_MODEL_BYTES + 1).collect())) == []
    plan = T.predict(df, packed, T.MAX_ROW_MODEL_BYTES + 1)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    most = T.predict(df.groupBy("category").agg(F.count("p").alias("n"), F.first("vec").alias("vec"), F.first("emp").alias("emp")),
                     packed, T.MAX_ROW_MODEL_BYTES + 1).agg(F.max("n")).first()[0]
    assert most > 30
