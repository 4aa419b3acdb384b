"""Property checks of the delicate scalars against straightforward Python
comparators on many random cases (one Spark job per property)."""

import calendar
import datetime as dt
import math
import random
import re

from pyspark.sql import functions as F

from growthlens.functions.dates import whole_months
from growthlens.functions.text import keyword_score, query_keys


def _add_months(d: dt.date, n: int) -> dt.date:
    """Calendar month addition clamped to the month's last day."""
    y, m = divmod(d.month - 1 + n, 12)
    y += d.year
    m += 1
    return dt.date(y, m, min(d.day, calendar.monthrange(y, m)[1]))


def _anchored_month_diff(to: dt.date, frm: dt.date) -> int:
    """Month difference anchored on ``to`` with linear adjustment inside the
    month, truncated toward zero (the date library's published algorithm)."""
    whole = (frm.year - to.year) * 12 + (frm.month - to.month)
    anchor = _add_months(to, whole)
    if (frm - anchor).days < 0:
        anchor2 = _add_months(to, whole - 1)
        adjust = (frm - anchor).days / (anchor - anchor2).days
    else:
        anchor2 = _add_months(to, whole + 1)
        adjust = (frm - anchor).days / (anchor2 - anchor).days
    out = -(whole + adjust)
    return math.ceil(out) if out < 0 else math.floor(out)


def test_whole_months_matches_anchored_algorithm(spark):
    rnd = random.Random(11)
    base = dt.date(1990, 1, 1)
    pairs = []
    for _ in range(4000):
        a = base + dt.timedelta(days=rnd.randint(0, 12000))
        if rnd.random() < 0.4:  # month ends and leap days
            last = calendar.monthrange(a.year, a.month)[1]
            a = a.replace(day=rnd.choice([last, max(1, last - 1), 28, 29 if last >= 29 else 28]))
        b = a + dt.timedelta(days=rnd.randint(-900, 3000))
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a date, b date")
    got = [r[0] for r in df.select(whole_months(F.col("a"), F.col("b"))).collect()]
    want = [_anchored_month_diff(b, a) for a, b in pairs]
    bad = [(p, g, w) for p, g, w in zip(pairs, got, want) if g != w]
    assert not bad, bad[:10]


def _score(name: str, q: str) -> int:
    keys = q.lower().split(" ")
    toks = re.sub(r"[^A-Za-z0-9_]+", " ", name.lower()).split(" ")
    s = 0
    for i, k in enumerate(keys):
        for j, b in enumerate(toks):
            if b == k:
                s += 13 if i == j else 9
            elif k in b:
                s += 5 if i == j else 3
            else:
                s -= 1
    return s - abs(len(toks) - len(keys))


def test_keyword_score_matches_direct_loop(spark):
    rnd = random.Random(5)
    words = ["red", "bolt", "ring", "inc", "co", "gear", "small", "widget", "re", ""]
    seps = [" ", "  ", ", ", "!", "-", ".", " & "]
    cases = []
    for _ in range(3000):
        name = "".join(rnd.choice(words) + rnd.choice(seps) for _ in range(rnd.randint(1, 4)))
        name = name if rnd.random() < 0.5 else name.upper()
        q = "".join(rnd.choice(words) + rnd.choice([" ", "  "]) for _ in range(rnd.randint(1, 3))).rstrip(" ")
        cases.append((name, q))
    df = spark.createDataFrame(cases, "n string, q string")
    got = [r[0] for r in df.select(keyword_score(F.col("n"), query_keys(F.col("q")))).collect()]
    want = [_score(n, q) for n, q in cases]
    bad = [(c, g, w) for c, g, w in zip(cases, got, want) if g != w]
    assert not bad, bad[:10]


def test_blocked_search_equals_the_filter(spark):
    """The plain predicate, the blocked join and a loop over all pairs keep the same companies, on either side of the bound."""
    from growthlens.operators import search as SE
    rnd = random.Random(8)
    words = ["Red", "bolt", "ring", "INC", "co", "gear", "\u00c9tude", "wid", "", None]

    def text(most):
        parts = [rnd.choice(words) for _ in range(rnd.randint(1, most))]
        return None if None in parts else " ".join(parts)

    names = [(f"c{i}", text(4)) for i in range(150)]
    asked = [(i, text(3)) for i in range(60)] + [(60, "   "), (61, "ing"), (62, "nc co")]
    index = spark.createDataFrame(names, "p string, n string")
    queries = spark.createDataFrame(asked, "query_id int, q string")
    want = sorted((q, p) for q, text in asked if text is not None for p, name in names if name is not None
                  and any(len(k) >= 3 and k in name.lower() for k in text.lower().split(" ")))
    loop, blocked = SE.search_filter(index, queries), SE.search_filter(index, queries, max_loop_bytes=0)
    assert want and sorted(map(tuple, loop.collect())) == want
    assert sorted(map(tuple, blocked.collect())) == want
    assert "BroadcastNestedLoopJoin" in loop._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in blocked._jdf.queryExecution().executedPlan().toString()
    assert SE.search_filter(index, queries.limit(0)).count() == 0 == SE.search_filter(index.limit(0), queries).count()


def test_blocked_search_spreads_its_matches(spark):
    """Tasks are as many as the candidates need, and none groups many more matches than it is meant to, on either side
    of the bound on the keys; names and queries may repeat and be null."""
    from growthlens.operators import search as SE
    colours = ["red", "blue", "green", "Rosy", None]
    names = [(f"c{i}", f"{colours[i % 4]} ring {i % 7}") for i in range(3000)]
    names += [("c1", "red gear"), (None, "a ring"), (None, "blue"), ("c9000", None), ("c9001", "ri")]
    asked = [(i, f"{colours[i % 5] or 'no'} ring") for i in range(40)] + [(40, "ringo"), (41, None), (None, "RED"), (42, "ge re")]
    asked += asked[:3] + [(0, "gear red")]
    index = spark.createDataFrame(names, "p string, n string")
    queries = spark.createDataFrame(asked, "query_id int, q string")
    want = {}
    for q, text in asked:
        keys = [] if text is None else text.lower().split(" ")
        for p, name in names:
            hit = [i for i, k in enumerate(keys) if len(k) >= 3 and name is not None and k in name.lower()]
            if hit:
                want[q, p] = min(want.get((q, p), 99), hit[0])
    candidates, each = 40 * 3000, 5000
    for most in (SE.MAX_BLOCK_BYTES, 0):
        found = SE.search_matches(index, queries, per_task=each, max_block_bytes=most)
        parts = found.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(parts) >= candidates // each and max(r.n for r in parts) <= 2 * each
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(want) and {(q, p): k for q, p, k in got} == want
