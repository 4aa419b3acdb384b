"""Tree flattening / walking: the packed-array fold equals a nested-CASE
evaluation of the same tree, and model files load by category name."""

import json
import random

from pyspark.sql import functions as F

from growthlens import config
from growthlens.operators import trees as T
from growthlens.operators import training as TRN
from growthlens.session import scratch_path


def _python_walk(node, vec, emp):
    path = "r"
    while node.get("results") is None and node.get("col", -1) != -1:
        col, val = node["col"], node["value"]
        if col == config.EMPLOYEES_SLOT:
            go = (emp or "") == val
        else:
            x = vec[col]
            go = x is not None and x >= float(val)
        node, path = (node["tb"], path + "t") if go else (node["fb"], path + "f")
    r = node.get("results") or {}
    return path, r.get("0"), r.get("1")


def test_flatten_counts():
    for cat, text in config.WORLD_TREES.items():
        f = T.flatten_tree(cat, text)
        leaves = sum(1 for c in f["cols"] if c < 0)
        assert f["n_nodes"] == 2 * leaves - 1
        assert f["ids"][0] == "r" and f["depth"] == 4


def test_walk_matches_reference_walk(spark):
    rnd = random.Random(3)
    emps = ["", "1-10", "11-50", "25", None]
    rows = []
    for i in range(400):
        vec = [rnd.choice([None, rnd.randint(0, 120)])] + [None] + [float(rnd.randint(0, 15)) for _ in range(8)] \
            + [rnd.choice([0.0, 100000.0, 270000.0, 500000.0]), rnd.random()]
        vec = [None if v is None else float(v) for v in vec]
        rows.append((f"c{i}", rnd.choice(sorted(config.WORLD_TREES) + ["MACHINERY"]), vec, rnd.choice(emps)))
    df = spark.createDataFrame(rows, "p string, category string, vec array<double>, emp string")
    packed = T.pack_trees(T.tree_texts_from_constants(spark, config.WORLD_TREES))
    got = {r.p: (r.leaf, r.n0, r.n1, r.reason) for r in T.predict(df, packed).collect()}
    for p, cat, vec, emp in rows:
        if cat not in config.WORLD_TREES:
            assert got[p] == (None, None, None, "no_model")
            continue
        want = _python_walk(json.loads(config.WORLD_TREES[cat]), vec, emp if emp is not None else "")
        assert got[p] == (*want, "ok"), (p, cat, vec, emp)


def test_tree_files_round_trip_names(spark):
    trees = {"Hardware + Software": config.WORLD_TREES["AUTOMOBILE"], "Big Data": config.WORLD_TREES["FURNITURE"],
             "EdTech": config.WORLD_TREES["BUILDING"]}
    folder = TRN.write_tree_files(spark, trees, scratch_path(spark, "trees_test"))
    loaded = {r.category: r.json for r in TRN.load_tree_texts(spark, folder).collect()}
    assert loaded == trees
    nodes = T.tree_nodes(T.pack_trees(TRN.load_tree_texts(spark, folder)))
    assert nodes.where(F.col("category") == "Hardware + Software").count() == 9
    summ = {r.category: r for r in T.tree_summary(T.pack_trees(TRN.load_tree_texts(spark, folder))).collect()}
    assert summ["Big Data"].n_leaves == 5 and summ["Big Data"].mixed_leaves == 1


def _grown(spark, rows, **how):
    """(rows as given, {category: tree}) of trees grown from (category, label, vec, emp) rows."""
    df = spark.createDataFrame(rows, "category string, label int, vec array<double>, emp string")
    return {c: json.loads(t) for c, t in TRN.train_trees(df, **how).items()}


def _check_grown(rows, trees):
    """Every leaf counts the rows that reach it, and holds both labels only if its rows are alike."""
    leaves = {}
    for cat, label, vec, emp in rows:
        leaves.setdefault((cat, _python_walk(trees[cat], vec, emp)), []).append((label, tuple(vec), emp or ""))
    for (_cat, (_path, n0, n1)), got in leaves.items():
        ones = sum(label for label, _v, _e in got)
        assert (n0 or 0, n1 or 0) == (len(got) - ones, ones)
        assert ones in (0, len(got)) or len({row[1:] for row in got}) == 1
    return max(len(path) for _cat, (path, _n0, _n1) in leaves)


def _vec(**slots):
    return [None if i == config.EMPLOYEES_SLOT else float(slots.get(f"x{i}", 0)) if slots.get(f"x{i}", 0) is not None
            else None for i in range(len(config.VECTOR_SLOTS))]


def test_grown_trees_reproduce_every_row(spark):
    """Few and many rows a task, coarse cut points, a hot category, missing numbers, alike rows of both labels."""
    rnd = random.Random(5)
    rows = []
    for i in range(900):
        cat = "hot + one" if i % 3 else rnd.choice(["a", "b"])
        rows.append((cat, int(rnd.random() < 0.3), _vec(x0=rnd.choice([None, rnd.randint(0, 40)]), x6=rnd.randint(0, 2),
                                                        x11=rnd.choice([0.0, rnd.random()])),
                     rnd.choice([None, "", "1-10", "11-50", "25"])))
    rows += [("b", label, _vec(x0=7), "1-10") for label in (0, 1, 1)]
    rows += [("pure", 1, _vec(x0=i), "") for i in range(20)]
    for how in ({"task_rows": 400, "bins": 4}, {}):
        trees = _grown(spark, rows, **how)
        assert set(trees) == {"hot + one", "a", "b", "pure"} and trees["pure"] == {"col": -1, "results": {"1": 20}}
        _check_grown(rows, trees)


def test_grown_trees_go_deep(spark):
    """Labels that alternate along one slot need a level for nearly every value."""
    rows = [("c", i % 2, _vec(x0=i), "") for i in range(60)]
    trees = _grown(spark, rows)
    assert _check_grown(rows, trees) > 20
    assert _grown(spark, rows, task_rows=58, bins=240) == trees


def test_grown_trees_split_on_the_employees_label(spark):
    rows = [("c", int(e == "11-50"), _vec(x0=i % 3), e) for i, e in enumerate(["1-10", "11-50", None, "25"] * 10)]
    want = {"col": config.EMPLOYEES_SLOT, "value": "11-50", "tb": {"col": -1, "results": {"1": 10}},
            "fb": {"col": -1, "results": {"0": 30}}}
    assert _grown(spark, rows) == _grown(spark, rows, task_rows=5) == {"c": want}


def test_big_nodes_are_counted_in_parts_by_all_tasks(spark, monkeypatch):
    """Rows that come in one piece are spread before the levels, and a node's parts count as the whole node does."""
    from growthlens.operators import tree_growth as TG
    written = {}

    def materialize(df, name, real=TG.materialize):
        written[name] = real(df, name)
        return written[name]

    monkeypatch.setattr(TG, "materialize", materialize)
    rnd = random.Random(8)
    rows = [(rnd.choice([None, "a"]), int(rnd.random() < 0.4), _vec(x0=rnd.choice([None, rnd.randint(0, 30)]),
             x11=rnd.random()), rnd.choice(["", "25", None])) for _ in range(1200)]
    df = spark.createDataFrame(rows, "category string, label int, vec array<double>, emp string").coalesce(1)

    def grown():
        return sorted(map(str, TG.grow(df, task_rows=150, bins=8).collect()))

    whole = grown()
    assert len(written["tree_big"].inputFiles()) >= spark.sparkContext.defaultParallelism > 1
    monkeypatch.setattr(TG, "PART_ROWS", 40)
    assert grown() == whole
    leaves = [r for r in written["tree_nodes"].collect() if r.col < 0]
    for cat in (None, "a"):
        assert sum(r.n0 + r.n1 for r in leaves if r.category == cat) == sum(r[0] == cat for r in rows)


def test_middling_nodes_take_no_level_of_their_own(spark, monkeypatch):
    """Nodes of a few parts are split in one task, however deep, into the same tree as level by level."""
    from growthlens.operators import tree_growth as TG
    rows = [(cat, int(i % 3 == 0), _vec(x0=i * 1e6 if i % 7 else None, x11=i % 5), ["", "25", None][i % 3 * (i % 2)])
            for i in range(90) for cat in ("a", None)]
    rows += [("alike", i % 2, _vec(x0=3), "") for i in range(50)]
    df = spark.createDataFrame(rows, "category string, label int, vec array<double>, emp string")
    levels = []
    monkeypatch.setattr(TG, "_splits", lambda *a, real=TG._splits: levels.append(1) or real(*a))
    whole = sorted(map(str, TG.grow(df, max_depth=3, task_rows=40, bins=8).collect()))
    assert not levels and any("E7" in row for row in whole) and sum("alike" in row for row in whole) == 1
    monkeypatch.setattr(TG, "WHOLE_PARTS", 0)
    assert sorted(map(str, TG.grow(df, max_depth=3, task_rows=40, bins=8).collect())) == whole and levels


def test_grown_trees_of_nothing_and_of_cuts(spark):
    assert _grown(spark, []) == {}
    rows = [("c", i % 2, _vec(x0=i), "") for i in range(40)] + [("c", None, _vec(x0=3), "")]
    for how in ({"max_depth": 2}, {"max_depth": 2, "task_rows": 5}):
        tree = _grown(spark, rows, **how)["c"]  # a first value is cut off, then one of the rest
        assert json.dumps(tree).count('"tb"') == 2
        assert max(len(_python_walk(tree, vec, emp)[0]) for _c, _label, vec, emp in rows) == 3
    assert json.dumps(_grown(spark, rows, min_rows=41)["c"]).count('"tb"') == 0


def test_deep_models_are_deep_and_reached(spark):
    """The rule-made files: 26 splits in a chain, names with spaces and +, leaves reached far down, and each prediction
    equal to a walk over the JSON."""
    from conftest import SF_CHECK
    from growthlens.operators import scoring as SC
    from growthlens.plans.context import Ctx
    from growthlens.sources import rule_models as RM
    c = Ctx(spark, SF_CHECK)
    texts = {r.category: r.json for r in RM.tree_texts(c.world.company_category).collect()}
    assert texts and all(name.endswith(" + deep model") for name in texts)
    folder = TRN.write_tree_files(spark, texts, scratch_path(spark, "deep_test"))
    assert {r.category: r.json for r in TRN.load_tree_texts(spark, folder).collect()} == texts
    packed = T.pack_trees(TRN.load_tree_texts(spark, folder))
    assert all(r.depth >= 26 and r.n_nodes >= 53 for r in packed.select("depth", "n_nodes").collect())
    vec = SC.vector_array(c.features)
    names = F.array(*[F.lit(n) for n in sorted(texts)])
    rows = vec.select("p", "vec", "emp", F.explode(names).alias("category"))
    values = {r.p: (r.vec, r.emp) for r in vec.select("p", "vec", "emp").collect()}
    got = T.predict(rows, packed).collect()
    assert len(got) == len(values) * len(texts)
    roots = {name: json.loads(text) for name, text in texts.items()}
    for r in got:
        assert (r.leaf, r.n0, r.n1) == _python_walk(roots[r.category], *values[r.p])
    assert max(len(r.leaf) for r in got) >= 8 and len({r.leaf for r in got}) >= 10


def test_upsert_of_equal_versions_is_stable(spark):
    from growthlens.sources import profile_store as PS
    rows = [("a", 1, 5), ("a", 9, 5), ("b", 2, 1), ("b", 3, 7)]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "p string, x int, fetched_at int")
        got = PS.upsert(df.limit(2), df.subtract(df.limit(2))).collect()
        assert sorted((r.p, r.x) for r in got) == [("a", 9), ("b", 3)]


def test_models_beyond_the_bound_score_alike(spark, monkeypatch):
    """The model is gathered into one value only below the bound; both forms give the same rows."""
    from conftest import SF_SMALL
    from growthlens.operators import scoring as SC
    from growthlens.plans.context import Ctx
    c = Ctx(spark, SF_SMALL)
    assert T.model_bytes(c.packed_trees) == 256 * c.packed_trees.agg(F.sum("n_nodes")).first()[0] > 0

    def rows():
        got = SC.with_success(c.features, c.packed_trees).select("k", "success_all", "success")
        return sorted((r.k, r.success_all, sorted(r.success.items())) for r in got.collect())

    monkeypatch.setattr(T, "models", lambda packed, real=T.models: calls.append(1) or real(packed))
    calls = []
    small = rows()
    assert calls and any(r[2] for r in small)
    monkeypatch.setattr(T, "MAX_BROADCAST_MODEL_BYTES", 0)
    calls.clear()
    assert rows() == small and not calls
