"""Deep model files derived from the company index by fixed rules.

One model per category: a chain of up to ``LEVELS`` splits, one for each residue of the companies' keys, whose slots,
thresholds and class counts follow from the number and the sum of those keys; every other split carries a further split.
The rule is a pair of SQL expressions, so that DuckDB builds the same files from the same tables.  File names hold spaces
and ``+`` as the service's do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 26
SUFFIX = " + deep model"


def _text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _leaf(a: str, b: str) -> str:
    """A leaf with the counts ``a % 5`` and ``b % 4``; classes without rows are absent."""
    return (f"""'{{"col":-1,"results":{{' || CASE WHEN {a} % 5 > 0 AND {b} % 4 > 0 """
            f"""THEN '"0":' || {_text(f"{a} % 5")} || ',"1":' || {_text(f"{b} % 4")} """
            f"""WHEN {a} % 5 > 0 THEN '"0":' || {_text(f"{a} % 5")} """
            f"""ELSE '"1":' || {_text(f"{b} % 4 + 1")} END || '}}}}'""")


def _split(x: str) -> str:
    """The beginning of a split, up to its true branch: slot ``x % 12`` and a threshold in the slot's range."""
    value = (f"CASE WHEN {x} % 12 = 0 THEN {_text(f'{x} % 120')} "
             f"WHEN {x} % 12 = 1 THEN CASE WHEN {x} % 5 = 0 THEN '' ELSE '11-50' END "
             f"WHEN {x} % 12 = 10 THEN {_text(f'{x} % 500000')} || '.5' "
             f"WHEN {x} % 12 = 11 THEN '0.' || {_text(f'{x} % 10')} ELSE {_text(f'{x} % 6')} END")
    return f"""'{{"col":' || {_text(f"{x} % 12")} || ',"value":"' || {value} || '","tb":'"""


#: Of a level with n companies whose keys add up to sk: its split, up to the false branch.
HEAD = (f"""{_split("sk")} || CASE WHEN n % 2 = 1 THEN {_split("(sk + n)")} || {_leaf("n", "sk")} || ',"fb":' || """
        f"""{_leaf("(n + 1)", "(sk + 1)")} || '}}' ELSE {_leaf("n", "sk")} END || ',"fb":'""")
#: The last leaf, from the totals of all levels.
LAST = _leaf("n_all", "sk_all")


def tree_texts(company_category: DataFrame) -> DataFrame:
    """(category, json): one row per category; at most ``LEVELS`` rows meet in a group."""
    levels = company_category.groupBy("category", (F.col("k") % LEVELS).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").cast("bigint").alias("sk"))
    whole = levels.withColumn("head", F.expr(HEAD)).groupBy("category").agg(
        F.array_sort(F.collect_list(F.struct("level", "head"))).alias("heads"), F.sum("n").alias("n_all"),
        F.sum("sk").alias("sk_all"))
    text = F.concat(F.array_join(F.transform("heads", lambda h: h["head"]), ""), F.expr(LAST),
                    F.repeat(F.lit("}"), F.size("heads")))
    return whole.select(F.concat("category", F.lit(SUFFIX)).alias("category"), text.alias("json"))


#: DuckDB: the same files (category, json).
DUCK_TEXTS = f"""
  SELECT category || '{SUFFIX}' AS category,
    string_agg(head, '' ORDER BY level) || any_value(last) || repeat('}}', count(*)) AS json
  FROM (SELECT category, level, {HEAD} AS head, {LAST} AS last FROM (
    SELECT *, CAST(sum(n) OVER (PARTITION BY category) AS BIGINT) AS n_all,
      CAST(sum(sk) OVER (PARTITION BY category) AS BIGINT) AS sk_all FROM (
      SELECT category, k % {LEVELS} AS level, count(*) AS n, CAST(sum(k) AS BIGINT) AS sk
      FROM w_company_category GROUP BY category, k % {LEVELS})))
  GROUP BY category"""

#: DuckDB: the node table of those files, by a recursive query over their JSON.
DUCK_NODES = f"""
  WITH RECURSIVE walk AS (
    SELECT category, 'r' AS node, CAST(json AS JSON) AS j FROM ({DUCK_TEXTS})
    UNION ALL
    SELECT category, node || branch, json_extract(j, '$.' || branch || 'b')
    FROM walk, (VALUES ('t'), ('f')) AS b(branch) WHERE json_extract(j, '$.tb') IS NOT NULL)
  SELECT category, node, CAST(json_extract_string(j, '$.col') AS INTEGER) AS col, json_extract_string(j, '$.value') AS value,
    CASE WHEN json_extract(j, '$.tb') IS NOT NULL THEN node || 't' END AS tb,
    CASE WHEN json_extract(j, '$.fb') IS NOT NULL THEN node || 'f' END AS fb,
    CAST(json_extract_string(j, '$.results.0') AS BIGINT) AS n0, CAST(json_extract_string(j, '$.results.1') AS BIGINT) AS n1
  FROM walk"""

#: DuckDB: every profiled company through the deep model of each of its eligible categories, split by split.
DUCK_PREDICT = f"""
  WITH RECURSIVE nodes AS MATERIALIZED ({DUCK_NODES}),
  walk AS (
    SELECT e.p, e.category || '{SUFFIX}' AS category, 'r' AS node FROM w_eligible e
    UNION ALL
    SELECT w.p, w.category, CASE WHEN CASE n.col
        WHEN 1 THEN v.emp = n.value
        ELSE coalesce(CASE n.col {" ".join(f"WHEN {k} THEN v.v{k}" for k in (0, *range(2, 12)))} END
                      >= TRY_CAST(n.value AS DOUBLE), false) END THEN n.tb ELSE n.fb END
    FROM walk w JOIN nodes n ON n.category = w.category AND n.node = w.node JOIN w_vec v ON v.p = w.p WHERE n.col >= 0)
  SELECT w.p, w.category, w.node AS leaf, n.n0, n.n1, 'ok' AS reason
  FROM walk w JOIN nodes n ON n.category = w.category AND n.node = w.node WHERE n.col < 0"""
