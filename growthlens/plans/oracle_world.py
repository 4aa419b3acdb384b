"""DuckDB text of the company world (FIXTURES.md §2) used as the CTE prefix of
every oracle query.  It mirrors ``sources/world.py`` rule for rule."""

from __future__ import annotations

from .. import config

AS_OF = f"DATE '{config.WORLD_AS_OF}'"

WORLD_CTES = {
    "w_company": f"""
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS p, c_custkey AS k,
    CASE c_custkey % 4 WHEN 0 THEN p_name || ', Inc.' WHEN 1 THEN upper(p_name)
                       WHEN 2 THEN p_name || ' co!' ELSE p_name END AS n,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'http://img.example/' || CAST(c_custkey AS VARCHAR) END AS i,
    floor((c_acctbal + 1000) * 10 / 11) / 10000 AS s,
    r_name AS cat1, c_mktsegment AS cat2, n_name AS hq_city, r_name AS hq_region
  FROM customer JOIN part ON p_partkey = c_custkey % (SELECT count(*) FROM part)
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "w_company_category": """
  SELECT p, k, 0 AS ord, cat1 AS category, s FROM w_company UNION ALL
  SELECT p, k, 1 AS ord, cat2 AS category, s FROM w_company""",
    "w_round": """
  SELECT o_custkey AS k, o_orderkey AS seq,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS announced_on,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE o_totalprice END AS money
  FROM orders""",
    "w_acquired": """
  SELECT o_custkey AS k, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS announced_on
  FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 50 = 0""",
    "w_acquisition": """
  SELECT o_custkey AS k, o_orderkey AS seq FROM orders WHERE o_totalprice > 490000""",
    "w_item": f"""
  SELECT o_custkey AS k, l_orderkey AS seq, l_linenumber AS kind, l_suppkey, l_partkey, l_extendedprice AS money,
    CASE l_returnflag WHEN 'A' THEN '{config.INVESTOR_ORGANIZATION}' WHEN 'R' THEN '{config.INVESTOR_PERSON}'
    ELSE 'Other' END AS investor_type
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "w_competitor": """
  SELECT c_custkey AS k, CAST(j AS INT) AS pos,
    'c' || CAST((c_custkey * 7 + j * 13) % ((SELECT count(*) FROM customer) + 10) AS VARCHAR) AS competitor
  FROM customer, LATERAL (SELECT unnest(range(1, CAST(c_custkey % 9 AS BIGINT) + 1)) AS j) AS t""",
    "w_org": f"""
  SELECT c_custkey AS k, 'c' || CAST(c_custkey AS VARCHAR) AS p,
    CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE {AS_OF} - CAST((c_custkey * 37) % 4000 AS INT) END AS founded_on,
    CASE WHEN c_custkey % 19 = 0 AND c_custkey % 17 <> 0
         THEN {AS_OF} - CAST((c_custkey * 37) % 4000 AS INT) + 400 ELSE NULL END AS closed_on,
    CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE tf END AS total_funding_usd,
    CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 11 WHEN 2 THEN 51 WHEN 3 THEN NULL ELSE 25 END AS emp_min,
    CASE c_custkey % 5 WHEN 0 THEN 10 WHEN 1 THEN 50 WHEN 2 THEN 100 WHEN 3 THEN NULL ELSE 25 END AS emp_max,
    CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 4 END AS number_of_investments
  FROM customer LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS tf
                           FROM orders GROUP BY o_custkey) AS o ON o_custkey = c_custkey
  WHERE c_custkey % 3 <> 0""",
    "w_list": f"""
  SELECT CAST(k // {config.WORLD_LIST_SIZE} AS BIGINT) AS list_id, CAST(k % {config.WORLD_LIST_SIZE} AS INT) AS pos, p
  FROM w_company""",
    "w_query": "SELECT * FROM (VALUES " + ", ".join(
        f"({qid}, '{q}')" for qid, q in config.WORLD_QUERIES) + f""") AS v(query_id, q)
  UNION ALL
  SELECT {config.WORLD_DERIVED_QUERY_BASE} + min(p_partkey) AS query_id, p_name AS q FROM part GROUP BY p_name""",
}
