"""Related companies for a list of permalinks.

The service walks the list in order and appends every new find to it, so a
company found twice keeps the side of its *first* discovery.  Here that is
an order key ``(src_pos, side, sub, rank)`` -- member position, competitors
before categories, competitor position or category position, category rank
-- and the first discovery is the minimum key per (list, company): a partial
aggregate, not a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from .ranking import top_k

SIDE_COMPETITOR, SIDE_CATEGORY = 0, 1


def competitor_candidates(lists: DataFrame, edges: DataFrame, index: DataFrame) -> DataFrame:
    """Competitors of profiled list members that are in the index and not
    on the original list."""
    known = index.select(F.col("p").alias("cand"))
    e = edges.select(F.col("p").alias("member"), F.col("pos").cast("bigint").alias("sub"),
                     F.col("competitor").alias("cand"))
    c = (lists.select("list_id", F.col("pos").alias("src_pos"), F.col("p").alias("member"))
         .join(e, "member").drop("member"))
    c = c.join(known, "cand", "left_semi")
    return (c.join(lists.select("list_id", F.col("p").alias("cand")), ["list_id", "cand"], "left_anti")
            .select("list_id", "src_pos", F.lit(SIDE_COMPETITOR).alias("side"), "sub",
                    F.lit(0).cast("bigint").alias("rank"), "cand"))


def category_candidates(lists: DataFrame, company_category: DataFrame, topk: DataFrame) -> DataFrame:
    """Top-k companies of each list member's index categories, not on
    the original list.  The top-k side holds at most k rows per category;
    AQE broadcasts it once its runtime size is known to be small."""
    cats = list_categories(lists, company_category)
    return _of_categories(cats, lists, topk)


def list_categories(lists: DataFrame, company_category: DataFrame) -> DataFrame:
    """The index categories of the list members: list_id, src_pos, sub, category."""
    return (lists.select("list_id", F.col("pos").alias("src_pos"), "p")
            .join(company_category.select("p", F.col("ord").cast("bigint").alias("sub"), "category"), "p").drop("p"))


def first_category_candidates(lists: DataFrame, company_category: DataFrame, topk: DataFrame) -> DataFrame:
    """J4 with each category taken once per list, at its first occurrence,
    before the top-k join: what ``first_discovery`` needs of it, without the
    fan-out of categories that many members share."""
    first = list_categories(lists, company_category).groupBy("list_id", "category").agg(
        F.min(F.struct("src_pos", "sub")).alias("_at"))
    return _of_categories(first.select("list_id", "_at.src_pos", "_at.sub", "category"), lists, topk)


def _of_categories(cats: DataFrame, lists: DataFrame, topk: DataFrame) -> DataFrame:
    tk = topk.select("category", "rank", F.col("p").alias("cand"))
    c = cats.join(tk, "category").drop("category")
    return (c.join(lists.select("list_id", F.col("p").alias("cand")), ["list_id", "cand"], "left_anti")
            .select("list_id", "src_pos", F.lit(SIDE_CATEGORY).alias("side"), "sub", "rank", "cand"))


def first_discovery(cands: DataFrame) -> DataFrame:
    """Keep each candidate once per list, at its first discovery."""
    first = (cands.groupBy("list_id", "cand")
             .agg(F.min(F.struct("src_pos", "side", "sub", "rank")).alias("_k")))
    return first.select("list_id", F.col("cand").alias("p"), F.col("_k.src_pos").alias("src_pos"),
                        F.col("_k.side").alias("side"), F.col("_k.sub").alias("sub"),
                        F.col("_k.rank").alias("rank"))


def discoveries(lists: DataFrame, edges: DataFrame, index: DataFrame, company_category: DataFrame,
                topk: DataFrame) -> DataFrame:
    """Both sides of a list's candidates, each at its first discovery."""
    return first_discovery(competitor_candidates(lists, edges, index).unionByName(
        first_category_candidates(lists, company_category, topk)))


def effective_scores(index: DataFrame, profiles: DataFrame) -> DataFrame:
    """J6 for related: success_all of a profiled company, else index s."""
    return (index.select("p", "n", "i", "s").join(profiles.select("p", "success_all"), "p", "left")
            .select("p", "n", "i", "s", F.coalesce(F.col("success_all"), F.col("s")).alias("score")))


def related(lists: DataFrame, edges: DataFrame, index: DataFrame, company_category: DataFrame,
            topk: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per list, <= 5 best competitors then the best category finds
    up to 11 in total, each side ordered by effective score desc."""
    first = discoveries(lists, edges, index, company_category, topk)
    scored = first.join(effective_scores(index, profiles), "p")
    ranked = top_k(scored, ["list_id", "side"], [F.col("score").desc(), F.col("p").asc()],
                   config.RELATED_TOTAL, "side_rank")
    n_comp = (ranked.where(F.col("side") == SIDE_COMPETITOR).groupBy("list_id")
              .agg(F.least(F.count(F.lit(1)), F.lit(config.RELATED_MAX_COMPETITORS)).alias("n_comp")))
    out = ranked.join(n_comp, "list_id", "left").withColumn("n_comp", F.coalesce("n_comp", F.lit(0)))
    keep = (((F.col("side") == SIDE_COMPETITOR) & (F.col("side_rank") <= config.RELATED_MAX_COMPETITORS))
            | ((F.col("side") == SIDE_CATEGORY)
               & (F.col("side_rank") <= F.lit(config.RELATED_TOTAL) - F.col("n_comp"))))
    return out.where(keep).select(
        "list_id",
        F.when(F.col("side") == SIDE_COMPETITOR, F.lit("competitor")).otherwise(F.lit("category")).alias("side"),
        F.col("side_rank").alias("rank"), "p", "n", "i", "s", "score")
