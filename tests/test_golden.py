"""Golden rows worked out by hand from the service's rules (FIXTURES.md §5)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from growthlens.functions import classes as CL
from growthlens.functions import display as DS
from growthlens.functions.dates import whole_months
from growthlens.functions.text import keyword_score, query_keys
from growthlens.operators import competitors as CO
from growthlens.operators import related as RE
from growthlens.operators import scoring as SC
from growthlens.operators import search as SE
from growthlens.operators import timeline as TL
from growthlens.operators.features import age_months, employees_label
from growthlens.streaming.topk import apply_updates


def test_keyword_scores(spark):
    rows = [("Red Bolt, Inc.", "red", 7), ("Red Bolt, Inc.", "bolt red", 10), ("red widget", "wid", 1),
            ("WIDGETS", "wid", 5), ("red", " red", 13), ("Yahoo!", "yahoo", 11), ("red ring", "red ring", 24),
            ("red ring", "re", 3)]
    df = spark.createDataFrame(rows, "n string, q string, want int")
    got = df.select("want", keyword_score(F.col("n"), query_keys(F.col("q"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_short_key_is_scored_but_not_matched(spark):
    idx = spark.createDataFrame([("c1", "red ring", None, 0.1)], "p string, n string, i string, s double")
    q = spark.createDataFrame([(1, "re")], "query_id bigint, q string")
    assert SE.search_matches(idx, q).count() == 0


def test_age_months(spark):
    d = dt.date.fromisoformat
    rows = [(d("2010-01-15"), None, None, d("2015-04-14"), 62),
            (d("2010-01-15"), d("2012-01-15"), d("2013-06-01"), d("2015-04-14"), 24),
            (d("2015-01-31"), None, None, d("2015-02-28"), 0),
            (d("2015-01-31"), None, d("2015-03-31"), d("2020-01-01"), 2),
            (None, None, None, d("2015-02-28"), None)]
    df = spark.createDataFrame(rows, "f date, acq date, closed date, asof date, want bigint")
    got = df.select("want", age_months(F.col("f"), F.col("acq"), F.col("closed"), F.col("asof")).alias("g"))
    assert [(r.g) for r in got.collect()] == [r[4] for r in rows]


def test_whole_months_negative_truncates_toward_zero(spark):
    df = spark.createDataFrame([(dt.date(2015, 3, 31), dt.date(2015, 2, 28))], "a date, b date")
    assert df.select(whole_months(F.col("a"), F.col("b"))).first()[0] == -1


def test_acquisition_before_founding_is_ignored(spark):
    df = spark.createDataFrame([(dt.date(2010, 1, 1), dt.date(2009, 1, 1))], "f date, a date")
    # the feature code only passes acquisitions after founding; none -> as_of
    acq = F.when(F.col("a") > F.col("f"), F.col("a"))
    got = df.select(age_months(F.col("f"), acq, F.lit(None).cast("date"), F.lit("2011-01-01").cast("date"))).first()
    assert got[0] == 12


def test_employees(spark):
    df = spark.createDataFrame([(1, 10), (None, 10), (25, 25), (None, None)], "a int, b int")
    assert [r[0] for r in df.select(employees_label(F.col("a"), F.col("b"))).collect()] == ["1-10", "0-10", "25", None]


def test_rate(spark):
    feats = spark.createDataFrame(
        [("a", 1, "X", 1200000.0, 30), ("b", 2, "X", 9000000.0, 6), ("c", 3, "X", 0.0, 30), ("d", 4, "X", 5.0, None)],
        "p string, k int, cat2 string, total_funding double, age bigint")
    base = spark.createDataFrame([("X", 3000000.0, 188771.05401021644, 412932.77057038696)],
                                 "category string, r double, m double, d double")
    r = {x.p: x.rate for x in SC.funding_rate(feats, base, "r").collect()}
    assert r == {"a": -7, "b": 15, "c": None, "d": None}
    m = {x.p: x.rate for x in SC.funding_rate(feats, base, "m").collect()}
    assert m["a"] == 0
    # a category without a baseline gives a null rate (no error)
    other = spark.createDataFrame([("e", 5, "NOBASE", 1200000.0, 30)],
                                  "p string, k int, cat2 string, total_funding double, age bigint")
    assert SC.funding_rate(other, base, "r").first().rate is None


def test_category_score(spark):
    df = spark.createDataFrame([(0.4, None, 17), (0.4, 3, None), (0.4, 1, 3)], "s double, n0 bigint, n1 bigint")
    got = [r[0] for r in df.select(SC.category_score(F.col("s"), F.col("n0"), F.col("n1"))).collect()]
    assert got == pytest.approx([0.7, 0.2, 0.65])
    disp = spark.createDataFrame([(0.7,), (0.2,), (0.0,)], "x double").select(DS.display_score(F.col("x")))
    assert [r[0] for r in disp.collect()] == [1575, 450, None]


CLASS_ROWS = [(30, .1, -4, "ok", "incubated"), (30, .1, 0, "rising", None), (30, .1, 3, "hot", None),
              (30, .2, -4, "rising", "needs-funding"), (30, .2, -3, "hot", None), (30, .2, 3, "very-hot", None),
              (42, .1, 3, "rising", None), (42, .2, 0, "rising", None), (42, .2, 3, "hot", None),
              (42, .5, -4, "rising", None), (42, .5, 0, "hot", None), (42, .5, 3, "very-hot", None),
              (None, .1, None, "hot", None), (50, .1, None, "rising", None)]


def test_success_class(spark):
    df = spark.createDataFrame([(a, s, r) for a, s, r, _, _ in CLASS_ROWS], "age bigint, x double, rate bigint")
    k = CL.success_class(F.lit(False), F.lit(0), F.col("age"), F.col("x"), F.col("rate"))
    got = [(r.k.s, r.k.c) for r in df.select(k.alias("k")).collect()]
    assert got == [(s, c) for *_, s, c in CLASS_ROWS]
    acq = spark.createDataFrame([(.09,), (.1,), (.5,), (.75,), (.85,)], "x double")
    k2 = CL.success_class(F.lit(True), F.lit(0), F.lit(10), F.col("x"), F.lit(None))
    assert [r[0].s for r in acq.select(k2).collect()] == ["bad", "ok", "good", "great", "awesome"]


def test_hot(spark):
    rows = [(30, .1, 3, False, True), (30, .1, 2, False, False), (30, .2, -3, False, True), (50, .1, 9, False, False),
            (50, .2, 3, False, True), (50, .5, -3, False, True), (30, .2, None, False, False), (30, .2, 0, True, False)]
    df = spark.createDataFrame(rows, "age bigint, x double, rate bigint, acq boolean, want boolean")
    h = CL.is_hot(F.col("acq"), F.lit(0), F.col("age"), F.col("x"), F.col("rate"))
    assert [r[0] for r in df.select(h).collect()] == [r[4] for r in rows]


def test_competitor_rank(spark):
    index = spark.createDataFrame([(p, p, None, s) for p, s in [("a", .3), ("b", .5), ("c", .3), ("d", .1), ("e", .2)]],
                                  "p string, n string, i string, s double")
    edges = spark.createDataFrame([("a", 1, "b"), ("a", 2, "c"), ("a", 3, "d"), ("a", 4, "zz")],
                                  "p string, pos int, competitor string")
    prof = spark.createDataFrame([("a",), ("e",)], "p string")
    got = {r.p: (r.rank, r.total) for r in CO.competitor_rank(prof, edges, index).collect()}
    assert got == {"a": (2, 4), "e": (1, 1)}


def test_pages(spark):
    df = spark.createDataFrame([(1,), (10,), (11,)], "pos bigint")
    assert [r[0] for r in df.select(SE.page_of(F.col("pos"))).collect()] == [1, 1, 2]
    q = spark.createDataFrame([(1, "aaa"), (2, "bbb"), (3, "ccc")], "query_id bigint, q string")
    res = spark.createDataFrame([(2, i) for i in range(10)] + [(3, i) for i in range(11)], "query_id bigint, p int")
    got = {r.query_id: r.n_pages for r in SE.page_counts(res, q).collect()}
    assert got == {1: 0, 2: 1, 3: 2}


def test_min_pow10(spark):
    df = spark.createDataFrame([(2e6,), (1e6,), (999999.0,), (9.0,), (0.0,), (0.5,)], "x double")
    assert [r[0] for r in df.select(TL.min_pow10(F.col("x"))).collect()] == [6, 6, 5, 0, 0, 0]


def test_timeline(spark):
    d = dt.date.fromisoformat
    rounds = spark.createDataFrame([("a", d("2010-03-01"), 1.5e6), ("a", d("2010-09-01"), 0.5e6),
                                    ("a", d("2012-02-01"), 4e6)], "p string, d date, a double")
    founded = spark.createDataFrame([("a", d("2009-06-01"))], "p string, founded_on date")
    pts = sorted((r.d, r.a) for r in TL.funding_timeline(rounds, founded).collect())
    assert pts == [(d("2009-06-01"), 0.0), (d("2010-01-01"), 200.0), (d("2012-01-01"), 400.0)]
    dom = TL.funding_domain(rounds, founded, "2020-01-01").first()
    assert (dom.x_from, dom.x_to, dom.y_from, dom.y_to) == (d("2008-01-01"), d("2016-01-01"), 0.0, 400.0)
    dom2 = TL.funding_domain(rounds, founded, "2013-05-05").first()
    assert dom2.x_to == d("2013-05-05")


def test_incremental_topk_rule():
    ps, ss = apply_updates(["a", "b"], [5.0, 3.0], [("c", 4.0)], 2)
    assert dict(zip(ps, ss)) == {"a": 5.0, "c": 4.0}
    ps, ss = apply_updates(ps, ss, [("a", 1.0)], 2)
    assert dict(zip(ps, ss)) == {"a": 1.0, "c": 4.0}
    ps, ss = apply_updates(ps, ss, [("b", 3.0)], 2)
    assert dict(zip(ps, ss)) == {"b": 3.0, "c": 4.0}
    ps, ss = apply_updates(ps, ss, [("d", 3.0)], 2)
    assert dict(zip(ps, ss)) == {"b": 3.0, "c": 4.0}


def _related_counts(spark, n_comp, n_cat):
    lists = spark.createDataFrame([(1, 0, "m")], "list_id bigint, pos int, p string")
    comps = [f"x{i}" for i in range(n_comp)]
    cats = [f"y{i}" for i in range(n_cat)]
    index = spark.createDataFrame([("m", "m", None, 0.5)] + [(c, c, None, 0.1) for c in comps + cats],
                                  "p string, n string, i string, s double")
    edges = spark.createDataFrame([("m", j, c) for j, c in enumerate(comps)] or [("m", 0, "none")],
                                  "p string, pos int, competitor string")
    cc = spark.createDataFrame([("m", 0, "K")], "p string, ord int, category string")
    topk = spark.createDataFrame([("K", r + 1, c, 0.1) for r, c in enumerate(cats)] or [("Z", 1, "q", 0.1)],
                                 "category string, rank bigint, p string, s double")
    prof = spark.createDataFrame([("m", 0.5)], "p string, success_all double")
    out = RE.related(lists, edges, index, cc, topk, prof).collect()
    return sum(r.side == "competitor" for r in out), sum(r.side == "category" for r in out)


def test_related_caps(spark):
    assert _related_counts(spark, 7, 9) == (5, 6)
    assert _related_counts(spark, 2, 20) == (2, 9)
    assert _related_counts(spark, 0, 4) == (0, 4)


def test_related_first_discovery_keeps_category_side(spark):
    # b is found through the category of list item 1 (pos 0) and as competitor of item 2 (pos 1)
    lists = spark.createDataFrame([(1, 0, "m1"), (1, 1, "m2")], "list_id bigint, pos int, p string")
    index = spark.createDataFrame([("m1", "m1", None, .1), ("m2", "m2", None, .1), ("b", "b", None, .9)],
                                  "p string, n string, i string, s double")
    edges = spark.createDataFrame([("m2", 1, "b")], "p string, pos int, competitor string")
    cc = spark.createDataFrame([("m1", 0, "K"), ("m2", 0, "L")], "p string, ord int, category string")
    topk = spark.createDataFrame([("K", 1, "b", .9)], "category string, rank bigint, p string, s double")
    prof = spark.createDataFrame([("m2", .2)], "p string, success_all double")
    out = RE.related(lists, edges, index, cc, topk, prof).collect()
    assert [(r.p, r.side) for r in out] == [("b", "category")]


def test_money_and_commas(spark):
    df = spark.createDataFrame([(1234567.0,), (999.0,), (0.0,), (-2500.0,), (999999.0,)], "x double")
    got = [r[0] for r in df.select(DS.money_short(F.col("x"))).collect()]
    assert got == ["$ 1.23m", "$ 999.00", "$ 0.00", "($ 2.50k)", "$ 1000.00k"]
    e = spark.createDataFrame([("1-10",), ("1000-5000",), ("25",), (None,)], "e string")
    assert [r[0] for r in e.select(DS.employees_display(F.col("e"))).collect()] == \
        ["1 - 10", "1,000 - 5,000", "25", None]


def test_query_guard_trims(spark):
    q = spark.createDataFrame([(1, "  red  "), (2, "  co "), (3, "   "), (4, "bolt")], "query_id bigint, q string")
    acc = {r.query_id: r.q for r in SE.accepted_queries(q).collect()}
    assert acc == {1: "red", 4: "bolt"}
    rej = {r.query_id: r.reason for r in SE.search_rejects(q).collect()}
    assert rej == {2: "too_short", 3: "empty"}
