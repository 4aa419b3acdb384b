"""Success scoring (M3-M6), funding baselines (A2) and rate.

Pipeline per profiled company: eligible categories are a row-local
``filter``/``array_contains`` over the document and index categories.  A
profile is scored inside its row (``with_success``); the long form, one row
per company and category, classifies each against its tree in a broadcast
join (the model's size is proven small), so the scored rows are never
shuffled by category.  Baselines are partial aggregates per category; the
rate is a column of the join with them on the company's last category, so a
profile is built without a join of the features with themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.numeric import half_up_long, significant, truthy_number
from . import trees as T
from .features import vector_array, vector_columns


def eligible_categories(features: DataFrame) -> DataFrame:
    """M3: document categories that are also index categories, long form
    (p, k, pos, category)."""
    doc, idx = F.col("doc_categories"), F.col("c")
    return (features.select("p", "k", F.posexplode(F.filter(doc, lambda c: F.array_contains(idx, c)))
                            .alias("pos", "category"))
            .select("p", "k", F.col("pos").cast("int").alias("pos"), "category"))


def category_score(s, n0, n1):
    """M4: class-1 count present -> 0.5 + s/2 * n1/total, else s/2 * n0/total."""
    total = (F.coalesce(n0, F.lit(0)) + F.coalesce(n1, F.lit(0))).cast("double")
    return (F.when(n1.isNotNull(), F.lit(0.5) + F.try_divide(s * F.lit(0.5) * n1, total))
            .otherwise(F.try_divide(s * F.lit(0.5) * n0, total)))


def score_categories(features: DataFrame, packed: DataFrame, source_bytes: int | None = None) -> DataFrame:
    """p, k, category, leaf, n0, n1, reason, score (unrounded), score5; ``source_bytes`` as in ``trees.predict``."""
    vec = vector_array(features)
    elig = (vec.select("p", "k", "s", "vec", "emp",
                       F.filter(F.col("doc_categories"), lambda c: F.array_contains(F.col("c"), c))
                       .alias("_cats"))
            .select("p", "k", "s", "vec", "emp", F.explode("_cats").alias("category")))
    pred = T.predict(elig, packed, source_bytes)
    sc = category_score(F.col("s"), F.col("n0"), F.col("n1"))
    return pred.select("p", "k", "category", "leaf", "n0", "n1", "reason",
                       F.when(F.col("reason") == "ok", sc).alias("score"),
                       F.when(F.col("reason") == "ok",
                              significant(sc, config.SCORE_SIGNIFICANT_DIGITS)).alias("score5"))


def success_overall(features: DataFrame, scores: DataFrame) -> DataFrame:
    """M5: per company max unrounded score (floor 0) and the category map."""
    agg = (scores.where(F.col("reason") == "ok").groupBy("k")
           .agg(F.max("score").alias("_max"),
                F.map_from_entries(F.collect_list(F.struct("category", "score5"))).alias("success")))
    return (features.select("k", "p").join(agg, "k", "left")
            .select("k", "p",
                    F.coalesce(F.greatest(F.col("_max"), F.lit(0.0)), F.lit(0.0)).alias("success_all"),
                    F.coalesce(F.col("success"), F.create_map().cast("map<string,double>")).alias("success")))


def with_success(features: DataFrame, packed: DataFrame, row_local: bool | None = None) -> DataFrame:
    """M5 beside the features: success_all and the category map ``success``.

    A company's eligible categories are scored inside its own row, so that no
    row is shuffled: the models arrive as one value (a scalar subquery), which
    is right for a model of a proven size (``trees.MAX_BROADCAST_MODEL_BYTES``).
    With ``row_local`` off, for larger models, the long form is joined back.
    Unless it is given, the packed trees are measured.
    """
    if row_local is None:
        row_local = T.model_bytes(packed) <= T.MAX_BROADCAST_MODEL_BYTES
    if not row_local:
        succ = success_overall(features, score_categories(features, packed))
        return features.join(succ.drop("p"), "k", "left")
    eligible = F.array_distinct(F.filter("doc_categories", lambda c: F.array_contains(F.col("c"), c)))
    rows = features.withColumns({**vector_columns(), "_models": T.models(packed).scalar()})
    of_model = F.filter(F.transform(eligible, lambda c: F.struct(
        c.alias("category"), F.try_element_at("_models", c).alias("m"))), lambda x: x["m"].isNotNull())
    leaves = F.transform(of_model, lambda x: F.struct(x["category"].alias("category"), x["m"].alias("m"), T.walk(
        F.col("vec"), F.col("emp"), *(x["m"][a] for a in ("cols", "nums", "strs", "tb", "fb", "depth"))).alias("leaf")))
    scored = F.transform(leaves, lambda x: F.struct(x["category"].alias("category"), category_score(
        F.col("s"), F.get(x["m"]["n0"], x["leaf"]), F.get(x["m"]["n1"], x["leaf"])).alias("score")))
    rows = rows.withColumn("_scored", scored)
    best = F.array_max(F.transform("_scored", lambda x: x["score"]))
    rounded = F.map_from_entries(F.transform("_scored", lambda x: F.struct(
        x["category"].alias("category"), significant(x["score"], config.SCORE_SIGNIFICANT_DIGITS).alias("score5"))))
    return rows.select(*features.columns, F.coalesce(F.greatest(best, F.lit(0.0)), F.lit(0.0)).alias("success_all"),
                       F.coalesce(rounded, F.create_map().cast("map<string,double>")).alias("success"))


def monthly_funding(total_funding, age):
    """total_funding / max(age - 6, 1) when both are truthy."""
    ok = truthy_number(total_funding) & truthy_number(age)
    return F.when(ok, total_funding / F.greatest(age - config.AGE_OFFSET_MONTHS, F.lit(1)).cast("double"))


def category_baselines(company_category: DataFrame, features: DataFrame,
                       min_companies: int = 300) -> DataFrame:
    """A2: per category t = companies in the index, and max / mean / stddev of
    the monthly funding of its profiled companies; kept when t > min.

    All four are partial aggregates, so a category holding a large share of
    companies is reduced map-side before the shuffle on category.
    """
    mf = features.select("k", monthly_funding(F.col("total_funding"), F.col("age")).alias("mf"))
    return (company_category.select("k", "category").join(mf, "k", "left")
            .groupBy("category")
            .agg(F.count(F.lit(1)).alias("t"), F.max("mf").alias("r"),
                 F.avg("mf").alias("m"), F.stddev_samp("mf").alias("d"))
            .where(F.col("t") > min_companies))


def with_rate(features: DataFrame, baselines: DataFrame, baseline: str = "r") -> DataFrame:
    """The features with ``rate`` = round((monthly funding - baseline)
    / d) against the company's last index category; null when a value or the
    baseline is missing."""
    # one row per category; AQE broadcasts it after checking its runtime size
    b = baselines.select(F.col("category").alias("cat2"), F.col(baseline).alias("_base"), F.col("d").alias("_d"))
    mf = monthly_funding(F.col("total_funding"), F.col("age"))
    rate = half_up_long(F.try_divide(mf - F.col("_base"), F.col("_d")))
    return features.join(b, "cat2", "left").withColumn("rate", rate).drop("_base", "_d")


def funding_rate(features: DataFrame, baselines: DataFrame, baseline: str = "r") -> DataFrame:
    """K, p, rate."""
    return with_rate(features.select("k", "p", "cat2", "total_funding", "age"), baselines, baseline).select(
        "k", "p", "rate")


def build_profiles(features: DataFrame, packed: DataFrame, baselines: DataFrame,
                   baseline: str = "r") -> DataFrame:
    """M6: features + success + rate, one row per profiled company."""
    return with_rate(with_success(features, packed), baselines, baseline)
