"""DuckDB oracle texts, one per registered plan.

They compute the same answers from the flat world views with plain SQL
(aggregates, CASE, windows), independently of the Spark code paths.  The
decision trees become nested CASE expressions generated from the model text.
"""

from __future__ import annotations

import json

from .. import config
from ..sources import rule_models as RM
from .oracle_world import AS_OF, WORLD_CTES


def _months(a: str, b: str) -> str:
    fwd = (f"(12 * (year({b}) - year({a})) + (month({b}) - month({a})) "
           f"- CASE WHEN day({b}) < day({a}) THEN 1 ELSE 0 END)")
    bwd = (f"(12 * (year({a}) - year({b})) + (month({a}) - month({b})) "
           f"- CASE WHEN day({a}) < day({b}) THEN 1 ELSE 0 END)")
    return f"CAST(CASE WHEN {b} >= {a} THEN {fwd} ELSE -{bwd} END AS BIGINT)"


def _sig5(x: str, digits: int = config.SCORE_SIGNIFICANT_DIGITS) -> str:
    parts = []
    for e in range(12, -13, -1):
        k = digits - 1 - e
        if k >= 0:
            val = f"floor({x} * {10.0 ** k!r} + 0.5) / {10.0 ** k!r}"
        else:
            val = f"floor({x} / {10.0 ** (-k)!r} + 0.5) * {10.0 ** (-k)!r}"
        parts.append(f"WHEN {x} >= {10.0 ** e!r} THEN {val}")
    return "CASE " + " ".join(parts) + f" ELSE {x} END"


def _truthy(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} <> 0 AND NOT isnan(CAST({x} AS DOUBLE)))"


def _tree_case(node: dict, path: str) -> str:
    if node.get("results") is not None or node.get("col", -1) == -1:
        return f"'{path}'"
    col = int(node["col"])
    val = str(node["value"])
    if col == config.EMPLOYEES_SLOT:
        test = f"emp = '{val}'"
    else:
        test = f"coalesce(CAST(v{col} AS DOUBLE) >= {float(val)!r}, false)"
    return (f"CASE WHEN {test} THEN {_tree_case(node['tb'], path + 't')} "
            f"ELSE {_tree_case(node['fb'], path + 'f')} END")


def _tree_leaves(node: dict, path: str, out: list):
    if node.get("results") is not None or node.get("col", -1) == -1:
        r = node.get("results") or {}
        out.append((path, r.get("0"), r.get("1")))
        return
    _tree_leaves(node["tb"], path + "t", out)
    _tree_leaves(node["fb"], path + "f", out)


def _tree_ctes() -> dict[str, str]:
    leaf_rows, cases = [], []
    for cat, text in sorted(config.WORLD_TREES.items()):
        tree = json.loads(text)
        leaves: list = []
        _tree_leaves(tree, "r", leaves)
        for path, n0, n1 in leaves:
            leaf_rows.append(f"('{cat}', '{path}', {n0 if n0 is not None else 'NULL'}, "
                             f"{n1 if n1 is not None else 'NULL'})")
        cases.append(f"WHEN category = '{cat}' THEN {_tree_case(tree, 'r')}")
    return {
        "w_tree_leaf": "SELECT * FROM (VALUES " + ", ".join(leaf_rows)
                       + ") AS v(category, leaf, n0, n1)",
        "w_pred0": "SELECT e.p, e.k, e.category, CASE " + " ".join(cases) + " END AS leaf, "
                   "EXISTS (SELECT 1 FROM w_tree_leaf t WHERE t.category = e.category) AS has_model "
                   "FROM w_eligible e JOIN w_vec v ON v.p = e.p",
        "w_pred": "SELECT a.p, a.k, a.category, a.leaf, CAST(l.n0 AS BIGINT) AS n0, CAST(l.n1 AS BIGINT) AS n1, "
                  "CASE WHEN a.has_model THEN 'ok' ELSE 'no_model' END AS reason "
                  "FROM w_pred0 a LEFT JOIN w_tree_leaf l ON l.category = a.category AND l.leaf = a.leaf",
    }


FEATURE_CTES = {
    "w_items": f"""
  SELECT k,
    count(*) FILTER (WHERE kind = 1 AND investor_type = '{config.INVESTOR_ORGANIZATION}') AS num_investors_orgs,
    count(*) FILTER (WHERE kind = 1 AND investor_type = '{config.INVESTOR_PERSON}') AS num_investors_persons,
    count(*) FILTER (WHERE kind = 2) AS num_offices,
    count(*) FILTER (WHERE kind = 3) AS num_products,
    sum(CAST(money AS DECIMAL(18,2))) FILTER (WHERE kind = 4) AS investments_sum,
    arg_max('S' || CAST(l_suppkey AS VARCHAR), struct_pack(a := seq, b := l_suppkey, c := l_partkey))
      FILTER (WHERE kind = 2) AS last_office_city
  FROM w_item GROUP BY k""",
    "w_rounds": """
  SELECT k, count(*) AS num_funding_rounds,
    sum(CAST(money AS DECIMAL(18,2))) FILTER (WHERE money <> 0) AS fpr_sum,
    count(*) FILTER (WHERE money <> 0) AS fpr_n
  FROM w_round GROUP BY k""",
    "w_acq": """
  SELECT a.k, count(*) AS n_acquired_by,
    max(CASE WHEN a.announced_on > o.founded_on THEN a.announced_on END) AS acquired_after
  FROM w_acquired a JOIN w_org o ON o.k = a.k GROUP BY a.k""",
    "w_acqs": "SELECT k, count(*) AS num_acquisitions FROM w_acquisition GROUP BY k",
    "w_comps": "SELECT k, count(*) AS num_competitors FROM w_competitor GROUP BY k",
    "w_feat": f"""
  SELECT o.p, o.k, c.s, c.cat1, c.cat2, c.n AS name, c.n AS description,
    coalesce(q.n_acquired_by, 0) > 0 AS is_acquired,
    o.total_funding_usd AS total_funding,
    'http://www.' || o.p || '.example/x' AS homepage_url,
    CASE WHEN o.k % 2 = 0 THEN c.hq_city ELSE it.last_office_city END AS loc_city,
    CASE WHEN o.k % 2 = 0 OR it.last_office_city IS NOT NULL THEN c.hq_region END AS loc_region,
    CASE WHEN o.k % 2 = 0 OR it.last_office_city IS NOT NULL THEN 'X' END AS loc_country,
    CASE WHEN coalesce(o.emp_min, 0) = coalesce(o.emp_max, 0)
         THEN CASE WHEN coalesce(o.emp_min, 0) = 0 THEN NULL ELSE CAST(coalesce(o.emp_min, 0) AS VARCHAR) END
         ELSE CAST(coalesce(o.emp_min, 0) AS VARCHAR) || '-' || CAST(coalesce(o.emp_max, 0) AS VARCHAR) END
      AS num_employees,
    o.founded_on, o.closed_on,
    CASE WHEN o.founded_on IS NULL THEN NULL
         ELSE {_months('o.founded_on', f'coalesce(q.acquired_after, o.closed_on, {AS_OF})')} END AS age,
    CAST(coalesce(cp.num_competitors, 0) AS BIGINT) AS num_competitors,
    CAST(coalesce(it.num_offices, 0) AS BIGINT) AS num_offices,
    CAST(coalesce(it.num_products, 0) AS BIGINT) AS num_products,
    coalesce(CAST(it.investments_sum AS DOUBLE), 0.0) AS total_funding_investments,
    CAST(coalesce(o.number_of_investments, 0) AS BIGINT) AS num_investments,
    CAST(coalesce(aq.num_acquisitions, 0) AS BIGINT) AS num_acquisitions,
    CAST(coalesce(it.num_investors_orgs, 0) AS BIGINT) AS num_investors_orgs,
    CAST(coalesce(it.num_investors_persons, 0) AS BIGINT) AS num_investors_persons,
    CAST(coalesce(r.num_funding_rounds, 0) AS BIGINT) AS num_funding_rounds,
    CASE WHEN coalesce(r.fpr_n, 0) = 0 THEN 0.0
         ELSE floor(CAST(r.fpr_sum AS DOUBLE) / r.fpr_n * 1000.0 + 0.5) / 1000.0 END AS funding_per_round
  FROM w_org o JOIN w_company c ON c.k = o.k
  LEFT JOIN w_items it ON it.k = o.k LEFT JOIN w_rounds r ON r.k = o.k
  LEFT JOIN w_acq q ON q.k = o.k LEFT JOIN w_acqs aq ON aq.k = o.k
  LEFT JOIN w_comps cp ON cp.k = o.k""",
    "w_edges": "SELECT o.p, w.pos, w.competitor FROM w_competitor w JOIN w_org o ON o.k = w.k",
    "w_vec": """
  SELECT p, CAST(age AS DOUBLE) AS v0, coalesce(num_employees, '') AS emp,
    CAST(num_competitors AS DOUBLE) AS v2, CAST(num_offices AS DOUBLE) AS v3, CAST(num_products AS DOUBLE) AS v4,
    CAST(num_investments AS DOUBLE) AS v5, CAST(num_acquisitions AS DOUBLE) AS v6,
    CAST(num_investors_orgs AS DOUBLE) AS v7, CAST(num_investors_persons AS DOUBLE) AS v8,
    CAST(num_funding_rounds AS DOUBLE) AS v9, CAST(funding_per_round AS DOUBLE) AS v10, CAST(s AS DOUBLE) AS v11
  FROM w_feat""",
    "w_doccat": f"""
  SELECT p, 0 AS pos, cat2 AS category, k, cat1, cat2 FROM w_feat UNION ALL
  SELECT p, 1 AS pos, '{config.WORLD_EXTRA_CATEGORY}' AS category, k, cat1, cat2 FROM w_feat""",
    "w_eligible": """
  SELECT p, k, pos, category FROM w_doccat WHERE category = cat1 OR category = cat2""",
}
FEATURE_CTES.update(_tree_ctes())
FEATURE_CTES.update({
    "w_score": f"""
  SELECT p, k, category, leaf, n0, n1, reason,
    CASE WHEN reason = 'ok' THEN
      CASE WHEN n1 IS NOT NULL
           THEN 0.5 + s * 0.5 * n1 / CAST(coalesce(n0, 0) + coalesce(n1, 0) AS DOUBLE)
           ELSE s * 0.5 * n0 / CAST(coalesce(n0, 0) + coalesce(n1, 0) AS DOUBLE) END END AS score
  FROM w_pred JOIN (SELECT k AS kk, s FROM w_company) c ON c.kk = w_pred.k""",
    "w_score5": f"SELECT *, {_sig5('score')} AS score5 FROM w_score WHERE reason = 'ok'",
    "w_success": """
  SELECT f.p, f.k, coalesce(greatest(m.mx, 0.0), 0.0) AS success_all
  FROM w_feat f LEFT JOIN (SELECT k, max(score) AS mx FROM w_score5 GROUP BY k) m ON m.k = f.k""",
})

ALL_CTES = {**WORLD_CTES, **FEATURE_CTES}


def with_world(select: str) -> str:
    ctes = ",\n".join(f"{name} AS ({body}\n)" for name, body in ALL_CTES.items())
    return f"WITH {ctes}\n{select}"


SELECTS: dict[str, str] = {
    "features_basic": "SELECT p, name, description, is_acquired, total_funding, homepage_url, founded_on FROM w_feat",
    "feature_location": "SELECT p, loc_city, loc_region, loc_country FROM w_feat",
    "feature_employees": "SELECT p, num_employees FROM w_feat",
    "feature_age": "SELECT p, age FROM w_feat",
    "feature_competitors": "SELECT p, pos, competitor FROM w_edges",
    "features_counts": """SELECT p, num_competitors, num_offices, num_products, num_investments, num_acquisitions,
        num_investors_orgs, num_investors_persons, num_funding_rounds FROM w_feat""",
    "feature_investments": "SELECT p, total_funding_investments FROM w_feat",
    "feature_rounds": """SELECT o.p, r.seq, r.announced_on AS d, r.money AS a FROM w_round r JOIN w_org o ON o.k = r.k
        WHERE r.money IS NOT NULL AND r.announced_on IS NOT NULL""",
    "feature_per_round": "SELECT p, funding_per_round FROM w_feat",
    "doc_categories": "SELECT p, pos, category FROM w_doccat",
    "feature_vector": "SELECT * FROM w_vec",
    "eligible_categories": "SELECT p, pos, category FROM w_eligible",
    # a tree grown to the end parts all rows that differ, so only rows alike in every input share a leaf of both labels
    "train_trees": """
  SELECT category, CAST(sum(n - n1) AS BIGINT) AS total_0, CAST(sum(n1) AS BIGINT) AS total_1,
    CAST(sum(CASE WHEN n1 IN (0, n) THEN n ELSE 0 END) AS BIGINT) AS n_reproduced,
    CAST(sum(CASE WHEN n1 IN (0, n) THEN 0 ELSE n END) AS BIGINT) AS n_mixed
  FROM (SELECT cc.category, count(*) AS n, sum(CAST(f.is_acquired OR f.num_acquisitions > 0 AS INT)) AS n1
        FROM w_feat f JOIN w_vec v ON v.p = f.p JOIN w_company_category cc ON cc.k = f.k
        GROUP BY cc.category, v0, emp, v2, v3, v4, v5, v6, v7, v8, v9, v10, v11) AS alike
  GROUP BY category""",
    "tree_predict": "SELECT p, category, leaf, n0, n1, reason FROM w_pred",
    "success_by_category": "SELECT p, category, score5 AS score FROM w_score5",
    "success_overall": "SELECT p, success_all FROM w_success",
    "competitor_rank": """
  SELECT f.p, CAST(1 + coalesce(g.gt, 0) AS BIGINT) AS rank, CAST(1 + coalesce(g.n, 0) AS BIGINT) AS total
  FROM w_feat f LEFT JOIN (
    SELECT e.p, count(*) FILTER (WHERE c.s > own.s) AS gt, count(*) AS n
    FROM w_edges e JOIN w_company c ON c.p = e.competitor JOIN w_company own ON own.p = e.p
    GROUP BY e.p) g ON g.p = f.p""",
    "competitors": """
  SELECT e.p, CAST(row_number() OVER (PARTITION BY e.p ORDER BY c.s DESC, e.competitor) AS BIGINT) AS pos,
    e.competitor, c.n, c.i, c.s
  FROM w_edges e JOIN w_company c ON c.p = e.competitor""",
    "competitors_top4": f"""
  SELECT * FROM (
    SELECT e.p, CAST(row_number() OVER (PARTITION BY e.p ORDER BY c.s DESC, e.competitor) AS BIGINT) AS pos,
      e.competitor, c.n, c.s
    FROM w_edges e JOIN w_company c ON c.p = e.competitor) WHERE pos <= {config.COMPETITORS_SHOWN}""",
}



def _commas(x: str) -> str:
    return (f"CASE WHEN TRY_CAST({x} AS BIGINT) IS NOT NULL THEN format('{{:,}}', TRY_CAST({x} AS BIGINT)) "
            f"ELSE {x} END")


def _money(x: str) -> str:
    a = f"abs({x})"
    scaled = f"{a}"
    suffix = "''"
    for thr, suf in config.MONEY_SUFFIXES:
        scaled = f"CASE WHEN {a} >= {thr!r} THEN {a} / {thr!r} ELSE {scaled} END"
        suffix = f"CASE WHEN {a} >= {thr!r} THEN '{suf}' ELSE {suffix} END"
    body = f"('$ ' || printf('%.2f', floor(({scaled}) * 100.0 + 0.5) / 100.0) || {suffix})"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 0 THEN '(' || {body} || ')' ELSE {body} END"


def _class_sql() -> str:
    def c(s, sub=None):
        return f"{{'s': '{s}', 'c': {repr(sub) if sub else 'NULL::VARCHAR'}}}"
    acq_parts = []
    for bound, name in config.ACQUIRED_CLASS_BANDS:
        acq_parts.append(f"WHEN success_all < {bound!r} THEN {c(name)}" if bound is not None else f"ELSE {c(name)}")
    acq = "CASE " + " ".join(acq_parts) + " END"

    def bands(l_, m_, h_):
        return (f"CASE WHEN coalesce(rate < -3, false) THEN {l_} "
                f"WHEN coalesce(rate >= -3 AND rate < 3, false) THEN {m_} ELSE {h_} END")
    young = "coalesce(age, 0) < 42"
    other = (f"CASE WHEN {young} AND success_all < 0.15 THEN {bands(c('ok', 'incubated'), c('rising'), c('hot'))} "
             f"WHEN {young} THEN {bands(c('rising', 'needs-funding'), c('hot'), c('very-hot'))} "
             f"WHEN success_all < 0.15 THEN {bands(c('ok'), c('ok'), c('rising'))} "
             f"WHEN success_all < 0.5 THEN {bands(c('ok'), c('rising'), c('hot'))} "
             f"ELSE {bands(c('rising'), c('hot'), c('very-hot'))} END")
    return f"CASE WHEN is_acquired OR num_acquisitions > 0 THEN {acq} ELSE {other} END"


_KEYS = "string_split(lower(q), ' ')"
_TOKENS = "string_split(regexp_replace(lower(n), '\\W+', ' ', 'g'), ' ')"

MORE_CTES = {
    "w_mf": f"""
  SELECT k, CASE WHEN {_truthy('total_funding')} AND {_truthy('age')}
                 THEN total_funding / CAST(greatest(age - 6, 1) AS DOUBLE) END AS mf FROM w_feat""",
    "w_baseline": f"""
  SELECT category, count(*) AS t, max(mf) AS r, avg(mf) AS m, stddev_samp(mf) AS d
  FROM w_company_category cc LEFT JOIN w_mf ON w_mf.k = cc.k
  GROUP BY category HAVING count(*) > {config.WORLD_MIN_CATEGORY_SIZE}""",
    "w_rate": """
  SELECT f.p, f.k, CASE WHEN b.d IS NULL OR b.d = 0 THEN NULL
                        ELSE CAST(floor((m.mf - b.{base}) / b.d + 0.5) AS BIGINT) END AS rate
  FROM w_feat f LEFT JOIN w_mf m ON m.k = f.k LEFT JOIN w_baseline b ON b.category = f.cat2""",
    "w_prof": """
  SELECT f.*, s.success_all, r.rate FROM w_feat f JOIN w_success s ON s.k = f.k JOIN w_rate r ON r.k = f.k""",
    "w_flags": f"""
  SELECT p, (is_acquired OR num_acquisitions > 0) AND success_all >= {config.ALLSTAR_MIN_SUCCESS} AS allstar,
    NOT (is_acquired OR num_acquisitions > 0) AND coalesce(
      (coalesce(age, 0) < 42 AND success_all < 0.15 AND rate >= 3)
      OR (coalesce(age, 0) < 42 AND success_all >= 0.15 AND rate >= -3)
      OR (coalesce(age, 0) >= 42 AND success_all >= 0.15 AND success_all < 0.5 AND rate >= 3)
      OR (coalesce(age, 0) >= 42 AND success_all >= 0.5 AND rate >= -3), false) AS hot
  FROM w_prof""",
    "w_class": f"SELECT p, is_acquired, num_acquisitions, {_class_sql()} AS k FROM w_prof",
    "w_eff": """
  SELECT cc.category, cc.p, cc.k,
    CASE WHEN f.k IS NOT NULL THEN sc.score5 ELSE cc.s END AS s
  FROM w_company_category cc LEFT JOIN w_feat f ON f.k = cc.k
  LEFT JOIN w_score5 sc ON sc.k = cc.k AND sc.category = cc.category""",
    "w_topk": f"""
  SELECT * FROM (SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY s DESC NULLS LAST, p)
                                        AS BIGINT) AS rank, p, s FROM w_eff) WHERE rank <= {config.TOP_K}""",
    "w_q_acc": f"""SELECT query_id, q FROM (
      SELECT query_id, regexp_replace(q, '^\\s+|\\s+$', '', 'g') AS q FROM w_query)
      WHERE length(q) >= {config.SEARCH_MIN_QUERY_LEN}""",
    "w_keys_acc": f"""
  SELECT query_id, CAST(generate_subscripts(ks, 1) - 1 AS INT) AS pos, unnest(ks) AS key
  FROM (SELECT query_id, {_KEYS} AS ks FROM w_q_acc)""",
    "w_keys": f"""
  SELECT query_id, CAST(generate_subscripts(ks, 1) - 1 AS INT) AS pos, unnest(ks) AS key
  FROM (SELECT query_id, {_KEYS} AS ks FROM w_query)""",
    "w_tokens": f"""
  SELECT p, CAST(generate_subscripts(ts, 1) - 1 AS INT) AS pos, unnest(ts) AS token, len(ts) AS ntok
  FROM (SELECT p, {_TOKENS} AS ts FROM w_company)""",
    "w_match": f"""
  SELECT kk.query_id, c.p, CAST(min(kk.pos) AS INT) AS kpos
  FROM w_keys_acc kk
  JOIN w_company c ON length(kk.key) >= {config.SEARCH_MIN_KEY_LEN} AND contains(lower(c.n), kk.key)
  GROUP BY kk.query_id, c.p""",
    "w_kw": """
  SELECT m.query_id, m.p,
    CAST(sum(CASE WHEN t.token = kk.key THEN 10 + CASE WHEN kk.pos = t.pos THEN 3 ELSE -1 END
                  WHEN contains(t.token, kk.key) THEN 3 + CASE WHEN kk.pos = t.pos THEN 2 ELSE 0 END
                  ELSE -1 END)
         - abs(max(t.ntok) - (SELECT count(*) FROM w_keys_acc k2 WHERE k2.query_id = m.query_id)) AS BIGINT)
      AS kscore
  FROM w_match m JOIN w_keys_acc kk ON kk.query_id = m.query_id JOIN w_tokens t ON t.p = m.p
  GROUP BY m.query_id, m.p""",
    "w_search": """
  SELECT w.query_id, CAST(row_number() OVER (PARTITION BY w.query_id ORDER BY w.kscore + 10 * c.s DESC, w.p)
                          AS BIGINT) AS pos,
    w.p, c.n, c.i, c.s, w.kscore, w.kscore + 10 * c.s AS score
  FROM w_kw w JOIN w_company c ON c.p = w.p""",
    "w_rel_comp": """
  SELECT l.list_id, l.pos AS src_pos, 0 AS side, CAST(e.pos AS BIGINT) AS sub, CAST(0 AS BIGINT) AS rank,
    e.competitor AS p
  FROM w_list l JOIN w_edges e ON e.p = l.p
  WHERE e.competitor IN (SELECT p FROM w_company)
    AND NOT EXISTS (SELECT 1 FROM w_list l2 WHERE l2.list_id = l.list_id AND l2.p = e.competitor)""",
    "w_rel_cat": """
  SELECT l.list_id, l.pos AS src_pos, 1 AS side, CAST(cc.ord AS BIGINT) AS sub, t.rank, t.p
  FROM w_list l JOIN w_company_category cc ON cc.p = l.p JOIN w_topk t ON t.category = cc.category
  WHERE NOT EXISTS (SELECT 1 FROM w_list l2 WHERE l2.list_id = l.list_id AND l2.p = t.p)""",
    "w_rel_first": """
  SELECT list_id, p, src_pos, side, sub, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY list_id, p ORDER BY src_pos, side, sub, rank) AS rn
    FROM (SELECT * FROM w_rel_comp UNION ALL SELECT * FROM w_rel_cat)) WHERE rn = 1""",
    "w_rel_ranked": f"""
  SELECT f.list_id, f.side, c.p, c.n, c.i, c.s, coalesce(s.success_all, c.s) AS score,
    CAST(row_number() OVER (PARTITION BY f.list_id, f.side ORDER BY coalesce(s.success_all, c.s) DESC, c.p)
         AS BIGINT) AS rank
  FROM w_rel_first f JOIN w_company c ON c.p = f.p LEFT JOIN w_success s ON s.p = f.p""",
    "w_rel_ncomp": f"""
  SELECT list_id, least(count(*), {config.RELATED_MAX_COMPETITORS}) AS n_comp
  FROM w_rel_ranked WHERE side = 0 AND rank <= {config.RELATED_TOTAL} GROUP BY list_id""",
    "w_rounds_f": """
  SELECT o.p, r.seq, r.announced_on AS d, r.money AS a FROM w_round r JOIN w_org o ON o.k = r.k
  WHERE r.money IS NOT NULL AND r.announced_on IS NOT NULL""",
    "w_fy": """
  SELECT p, year(d) AS year, CAST(sum(CAST(a AS DECIMAL(18,2))) AS DOUBLE) AS amount
  FROM w_rounds_f GROUP BY p, year(d)""",
    "w_fb": """
  SELECT y.p, y.min_amount, y.max_amount, y.min_year, y.max_year, least(o.founded_on, r.first_round) AS min_date,
    CAST(CASE WHEN y.min_amount >= 1 THEN length(CAST(CAST(floor(y.min_amount) AS BIGINT) AS VARCHAR)) - 1
              ELSE 0 END AS INT) AS pow
  FROM (SELECT p, min(amount) AS min_amount, max(amount) AS max_amount, min(year) AS min_year,
               max(year) AS max_year FROM w_fy GROUP BY p) y
  JOIN (SELECT p, min(d) AS first_round FROM w_rounds_f GROUP BY p) r ON r.p = y.p
  LEFT JOIN w_org o ON o.p = y.p""",
}
ALL_CTES.update(MORE_CTES)

_KEEP_REL = (f"(side = 0 AND rank <= {config.RELATED_MAX_COMPETITORS}) OR "
             f"(side = 1 AND rank <= {config.RELATED_TOTAL} - coalesce(n_comp, 0))")

SELECTS.update({
    "category_baselines": "SELECT category, t, r, floor(m * 10000.0 + 0.5) / 10000.0 AS m, "
                          "floor(d * 10000.0 + 0.5) / 10000.0 AS d FROM w_baseline",
    "category_counts": "SELECT category, count(*) AS t FROM w_company_category GROUP BY category",
    "funding_rate": "SELECT p, rate FROM w_rate",
    "funding_rate_mean": "SELECT p, rate FROM w_rate_m",
    "index_counts": "SELECT (SELECT count(*) FROM w_company) AS indexed_count, "
                    "(SELECT count(*) FROM w_baseline) AS cat_count",
    "build_profiles": """SELECT p, name, is_acquired, total_funding, num_employees, age, num_competitors,
        num_offices, num_products, total_funding_investments, num_investments, num_acquisitions,
        num_investors_orgs, num_investors_persons, num_funding_rounds, funding_per_round, success_all, rate
        FROM w_prof""",
    "allstar": "SELECT p, allstar FROM w_flags",
    "hot": "SELECT p, hot FROM w_flags",
    "success_class": "SELECT p, k.s AS class, k.c AS subclass FROM w_class",
    "profile_tag": """SELECT p, CASE WHEN is_acquired THEN 'Acquired'
        WHEN num_acquisitions = 0 THEN replace(k.s, '-', ' ')
        WHEN k.c IS NOT NULL THEN replace(k.c, '-', ' ') END AS tag FROM w_class""",
    "profile_card": f"""SELECT p,
        CASE WHEN coalesce(homepage_url, '') <> '' THEN
          lower(regexp_extract(homepage_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)) END AS website,
        CASE WHEN founded_on IS NOT NULL THEN CAST(year(founded_on) AS VARCHAR) END AS founded_year,
        CASE WHEN {_truthy('age')} THEN age END AS exit_age,
        CASE WHEN loc_city IS NOT NULL OR loc_region IS NOT NULL
             THEN coalesce(loc_city, '') || ', ' || coalesce(loc_region, '') END AS location,
        CASE WHEN num_employees IS NULL OR num_employees = '' THEN NULL
             WHEN len(string_split(num_employees, '-')) > 1
             THEN {_commas("string_split(num_employees, '-')[1]")} || ' - ' ||
                  {_commas("string_split(num_employees, '-')[2]")}
             ELSE {_commas('num_employees')} END AS employees,
        CASE WHEN floor(success_all * {config.DISPLAY_SCORE_FACTOR} + 0.5) <> 0
             THEN CAST(floor(success_all * {config.DISPLAY_SCORE_FACTOR} + 0.5) AS BIGINT) END AS score_display,
        CASE WHEN NOT {_truthy('total_funding')} AND total_funding_investments = 0 THEN 'Total funding'
             WHEN NOT {_truthy('total_funding')} THEN 'Total investments' ELSE 'Total funding' END AS money_label,
        CASE WHEN NOT {_truthy('total_funding')} AND total_funding_investments = 0 THEN NULL
             WHEN NOT {_truthy('total_funding')} THEN {_money('total_funding_investments')}
             ELSE {_money('total_funding')} END AS money,
        CASE WHEN {_truthy('total_funding')} AND {_truthy('age')} AND age <> 6
             THEN {_money('CAST(floor(total_funding / CAST(age - 6 AS DOUBLE) + 0.5) AS DOUBLE)')} END
          AS monthly_rate
        FROM w_prof""",
    "trends_allstar": """SELECT c.p, c.n, c.i, pr.success_all AS s,
        CAST(row_number() OVER (ORDER BY pr.success_all DESC, c.p) AS BIGINT) AS pos
        FROM w_flags fl JOIN w_company c ON c.p = fl.p JOIN w_prof pr ON pr.p = fl.p WHERE fl.allstar""",
    "trends_hot": """SELECT c.p, c.n, c.i, pr.success_all AS s,
        CAST(row_number() OVER (ORDER BY pr.success_all DESC, c.p) AS BIGINT) AS pos
        FROM w_flags fl JOIN w_company c ON c.p = fl.p JOIN w_prof pr ON pr.p = fl.p WHERE fl.hot""",
    "refresh_scores": """SELECT c.p, coalesce(s.success_all, c.s) AS s
        FROM w_company c LEFT JOIN w_success s ON s.p = c.p""",
    "effective_score": "SELECT category, p, s FROM w_eff",
    "category_topk": "SELECT category, rank, p, s FROM w_topk",
    "nlargest": "SELECT category, rank, p, s FROM w_topk WHERE rank <= 3",
    "category_topk_subset": "SELECT category, rank, p, s FROM w_topk WHERE category IN ("
                            + ", ".join(f"'{c}'" for c in sorted(config.WORLD_TREES)) + ")",
    "search_keys": "SELECT query_id, pos, key FROM w_keys",
    "name_tokens": "SELECT p, pos, token FROM w_tokens",
    "search_filter": "SELECT query_id, p FROM w_match",
    "search_blocked": "SELECT query_id, p, kpos FROM w_match",
    "keyword_score": "SELECT query_id, p, kscore FROM w_kw",
    "search_rejects": f"""SELECT query_id, q,
        CASE WHEN length(regexp_replace(q, '^\\s+|\\s+$', '', 'g')) = 0 THEN 'empty' ELSE 'too_short' END AS reason
        FROM w_query WHERE length(regexp_replace(q, '^\\s+|\\s+$', '', 'g')) < {config.SEARCH_MIN_QUERY_LEN}""",
    "search": "SELECT query_id, pos, p, n, i, s, score FROM w_search",
    "search_page": f"SELECT query_id, CAST(ceil(pos / {config.PAGE_SIZE}) AS BIGINT) AS page, pos, p FROM w_search",
    "page_counts": f"""SELECT a.query_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_results,
        CAST(ceil(coalesce(m.n, 0) / {config.PAGE_SIZE}) AS BIGINT) AS n_pages
        FROM w_q_acc a LEFT JOIN (SELECT query_id, count(*) AS n FROM w_match GROUP BY query_id) m
        ON m.query_id = a.query_id""",
    "related_competitors": "SELECT list_id, src_pos, sub, p FROM w_rel_comp",
    "related_by_category": "SELECT list_id, src_pos, sub, rank, p FROM w_rel_cat",
    "related_dedup": "SELECT list_id, p, src_pos, side, sub, rank FROM w_rel_first",
    "related": f"""SELECT r.list_id, CASE WHEN r.side = 0 THEN 'competitor' ELSE 'category' END AS side,
        r.rank, r.p, r.n, r.i, r.s, r.score
        FROM w_rel_ranked r LEFT JOIN w_rel_ncomp nc ON nc.list_id = r.list_id
        WHERE {_KEEP_REL.replace('n_comp', 'nc.n_comp').replace('side', 'r.side').replace('rank', 'r.rank')}""",
    "funding_by_year": "SELECT p, year, amount FROM w_fy",
    "funding_bounds": "SELECT p, min_amount, min_date, max_year FROM w_fb",
    "funding_scale": "SELECT p, pow FROM w_fb",
    "funding_timeline": """
        SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY d) - 1 AS INT) AS pos, d, a FROM (
          SELECT y.p, make_date(CAST(y.year AS INT), 1, 1) AS d, y.amount / power(10.0, b.pow - 2) AS a
          FROM w_fy y JOIN w_fb b ON b.p = y.p
          UNION ALL
          SELECT p, min_date AS d, 0.0 AS a FROM w_fb WHERE min_date < make_date(CAST(min_year AS INT), 1, 1))""",
    "funding_domain": f"""
        SELECT p,
          make_date(CAST(year(CASE WHEN min_date < make_date(CAST(min_year AS INT), 1, 1) THEN min_date
                                   ELSE make_date(CAST(min_year AS INT), 1, 1) END) - 1 AS INT), 1, 1) AS x_from,
          least(make_date(CAST(max_year + 4 AS INT), 1, 1), {AS_OF}) AS x_to,
          CASE WHEN min_date < make_date(CAST(min_year AS INT), 1, 1) THEN 0.0
               ELSE min_amount / power(10.0, pow - 2) END AS y_from,
          max_amount / power(10.0, pow - 2) AS y_to
        FROM w_fb""",
})
ALL_CTES["w_rate_m"] = ALL_CTES["w_rate"].replace("{base}", "m")
ALL_CTES["w_rate"] = ALL_CTES["w_rate"].replace("{base}", "r")


SELECTS.update({
    "load_companies": "SELECT p, n, i, s, cat1 || '|' || cat2 AS categories FROM w_company",
    "load_category_stats": SELECTS["category_baselines"],
    "ingest_orgs": f"""SELECT p, founded_on, total_funding_usd, emp_min, emp_max FROM w_org""",
    "quarantine": f"""SELECT CAST(NULL AS VARCHAR) AS p, 'malformed_json' AS reason, 'not json' AS raw FROM w_org
        WHERE k % {config.WORLD_CORRUPT_EVERY} = 0
        UNION ALL
        SELECT NULL, 'malformed_json', 'not json' FROM w_round r JOIN w_org o ON o.k = r.k
        WHERE o.k % {config.WORLD_CORRUPT_EVERY} = 0
        UNION ALL
        SELECT DISTINCT p, reason, category FROM w_pred WHERE reason = 'no_model'""",
    "doc_features": f"""SELECT f.p, f.is_acquired, f.loc_city, f.num_employees, f.age, f.num_competitors,
        f.num_offices, f.num_products, f.total_funding_investments, f.num_investments, f.num_acquisitions,
        f.num_investors_orgs, f.num_investors_persons, f.num_funding_rounds, f.funding_per_round,
        coalesce((SELECT string_agg(e.competitor, ',' ORDER BY e.pos) FROM w_edges e WHERE e.p = f.p), '')
          AS competitors,
        (SELECT count(*) FROM w_rounds_f r WHERE r.p = f.p) AS n_rounds_dated,
        f.cat2 || '|{config.WORLD_EXTRA_CATEGORY}' AS doc_categories
        FROM w_feat f""",
    "doc_profiles": f"""SELECT p, age, success_all, rate FROM w_prof""",
    "has_profile": "SELECT c.p, o.p IS NOT NULL AS has_profile FROM w_company c LEFT JOIN w_org o ON o.p = c.p",
    "profile_lookup": """SELECT l.p, pr.age, pr.success_all, pr.rate
        FROM (SELECT DISTINCT competitor AS p FROM w_competitor) l LEFT JOIN w_prof pr ON pr.p = l.p""",
    "profile_upsert": f"""SELECT f.p,
        CASE WHEN ch.p IS NOT NULL THEN 2 ELSE 1 END AS fetched_at,
        CASE WHEN ch.p IS NULL THEN f.age WHEN f.founded_on IS NULL THEN NULL
             ELSE {_months('f.founded_on', "coalesce(q.acquired_after, f.closed_on, DATE '2002-09-01')")} END AS age
        FROM w_feat f LEFT JOIN w_acq q ON q.k = f.k
        LEFT JOIN (SELECT DISTINCT p FROM w_rounds_f WHERE year(d) = 2001) ch ON ch.p = f.p""",
    "ranks_import": "SELECT category, rank, p, s FROM w_topk",
    "meta_lookup": """SELECT l.p, c.n, c.i, c.s
        FROM (SELECT DISTINCT competitor AS p FROM w_competitor) l LEFT JOIN w_company c ON c.p = l.p""",
})


SELECTS.update({
    "topk_exact_latest": f"""SELECT category, rank, p, s FROM (
        SELECT category, p, s, CAST(row_number() OVER (PARTITION BY category ORDER BY s DESC NULLS LAST, p)
                                    AS BIGINT) AS rank
        FROM (SELECT event_type AS category, 'u' || CAST(user_id AS VARCHAR) AS p,
                     arg_max(value, struct_pack(a := ts, b := event_id)) AS s
              FROM events GROUP BY event_type, user_id)) WHERE rank <= {config.TOP_K}""",
    "stream_profiles": SELECTS["doc_profiles"],
    "stream_topk_profiles": SELECTS["category_topk"],
    "stream_quarantine": f"SELECT reason, raw FROM ({SELECTS['quarantine']}) WHERE reason <> 'no_model'",
})


SELECTS.update({
    "deep_load": f"SELECT category, json FROM ({RM.DUCK_TEXTS})",
    "deep_nodes": f"SELECT category, node, col, value, tb, fb, n0, n1 FROM ({RM.DUCK_NODES})",
    "deep_summary": f"""SELECT category, count(*) AS n_nodes, count(*) FILTER (WHERE col < 0) AS n_leaves,
        count(*) FILTER (WHERE col >= 0) AS n_splits, CAST(max(length(node)) AS BIGINT) AS depth,
        CAST(coalesce(sum(n0), 0) AS BIGINT) AS total_0, CAST(coalesce(sum(n1), 0) AS BIGINT) AS total_1,
        count(*) FILTER (WHERE n0 IS NOT NULL AND n1 IS NOT NULL) AS mixed_leaves
        FROM ({RM.DUCK_NODES}) GROUP BY category""",
    "deep_predict": f"SELECT p, category, leaf, n0, n1, reason FROM ({RM.DUCK_PREDICT})",
})


SELECTS["profile_attributes"] = f"""
    SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY o) - 1 AS INT) AS pos, label, value FROM (
      SELECT p, 0 AS o, 'Website' AS label, website AS value FROM ({SELECTS['profile_card']}) WHERE website IS NOT NULL
      UNION ALL SELECT p, 1, 'Founded', founded_year FROM ({SELECTS['profile_card']}) WHERE founded_year IS NOT NULL
      UNION ALL SELECT p, 2, 'Exit age (months)', CAST(exit_age AS VARCHAR) FROM ({SELECTS['profile_card']})
        WHERE exit_age IS NOT NULL
      UNION ALL SELECT p, 3, 'Location', location FROM ({SELECTS['profile_card']}) WHERE location IS NOT NULL)"""


SELECTS["ranks_export"] = """
    SELECT CAST(json_object(category, to_json(list(
             CASE WHEN s IS NULL THEN json_object('p', p) ELSE json_object('p', p, 's', s) END ORDER BY rank)))
           AS VARCHAR) AS value
    FROM w_topk GROUP BY category"""


SELECTS["search_indexed"] = SELECTS["search_blocked"]
SELECTS["baselines_maintained"] = SELECTS["category_baselines"]


def oracle_sql() -> dict[str, str]:
    return {name: with_world(sel) for name, sel in SELECTS.items()}
