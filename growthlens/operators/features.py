"""Company features (F1-F23) from long-form relationship rows.

Each relationship is reduced per company with a partial (map-side) aggregate
-- count / sum / max_by -- so a company owning a huge share of the rows is
pre-aggregated inside every map task before the shuffle on ``k``.
Order-level relationships arrive pre-reduced with the organisation rows (one
aggregate over orders); line items are reduced per order, then per company.
All reductions are keyed by ``k`` and joined on ``k``.

The nested-document form of the same features lives in ``documents.py``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.dates import as_of_col, whole_months
from ..functions.numeric import half_up
from ..sources.world import World

MONEY = "decimal(18,2)"


def employees_label(mn, mx):
    """min/max default 0; equal -> that number (0 -> null); else "min-max"."""
    mn = F.coalesce(mn, F.lit(0))
    mx = F.coalesce(mx, F.lit(0))
    return (F.when(mn == mx, F.when(mn == 0, F.lit(None).cast("string")).otherwise(mn.cast("string")))
            .otherwise(F.concat(mn.cast("string"), F.lit("-"), mx.cast("string"))))


def funding_per_round(total, count):
    """Mean of the non-zero amounts, 3 decimals; none -> 0."""
    return (F.when(F.coalesce(count, F.lit(0)) == 0, F.lit(0.0))
            .otherwise(half_up(total.cast("double") / count, config.FUNDING_PER_ROUND_DECIMALS)))


def age_months(founded_on, acquired_after, closed_on, as_of):
    """Months from founding to the latest acquisition after founding, else
    closing, else the evaluation date; null without a founding date."""
    end = F.coalesce(acquired_after, closed_on, as_of)
    return F.when(founded_on.isNull(), F.lit(None).cast("bigint")).otherwise(whole_months(founded_on, end))


def relationship_summaries(world: World) -> dict[str, DataFrame]:
    """Per-company reductions of the line-item relationships (one row per k).

    Line items are first reduced per order -- the shuffle by order key the
    join with ``orders`` needs anyway, with map-side combining -- then joined
    to their company and reduced again per company.  Order-level
    relationships (rounds, acquired_by, acquisitions) come pre-reduced with
    ``world.org`` (one scan of orders)."""
    kind = F.col("kind")
    per_order = world.item_rows.groupBy("seq").agg(
        F.count_if((kind == 1) & (F.col("investor_type") == config.INVESTOR_ORGANIZATION)).alias("io"),
        F.count_if((kind == 1) & (F.col("investor_type") == config.INVESTOR_PERSON)).alias("ip"),
        F.count_if(kind == 2).alias("of"),
        F.count_if(kind == 3).alias("pr"),
        F.sum(F.when(kind == 4, F.col("money").cast(MONEY))).alias("inv"),
        # last office of the order in item order: greatest supplier (the
        # part number only breaks ties between rows naming the same city)
        F.max(F.when(kind == 2, F.col("l_suppkey"))).alias("lo"))
    items = per_order.join(world.order_owner, "seq").groupBy("k").agg(
        F.sum("io").alias("num_investors_orgs"),
        F.sum("ip").alias("num_investors_persons"),
        F.sum("of").alias("num_offices"),
        F.sum("pr").alias("num_products"),
        F.sum("inv").alias("investments_sum"),
        # last office over the company's orders (orders are unique here):
        # the latest order's office; max_by on fixed-width longs keeps this a
        # hash aggregate
        F.max_by("lo", F.when(F.col("lo").isNotNull(), F.col("seq"))).alias("_last"))
    items = items.select("*", F.concat(F.lit("S"), F.col("_last").cast("string"))
                         .alias("last_office_city")).drop("_last")
    competitors = world.competitor.groupBy("k").agg(F.count(F.lit(1)).alias("num_competitors"))
    return {"items": items, "competitors": competitors}


def profile_features(world: World, as_of: _dt.date | str | None = config.WORLD_AS_OF) -> DataFrame:
    """One row per profiled company with every feature as a scalar column."""
    red = relationship_summaries(world)
    comp = world.company.select("k", "n", "s", "cat1", "cat2", "hq_city", "hq_region")
    df = world.org.join(comp, "k")
    for name in ("items", "competitors"):
        df = df.join(red[name], "k", "left")
    has_hq = F.col("k") % 2 == 0
    cnt = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    loc_city = F.when(has_hq, F.col("hq_city")).otherwise(F.col("last_office_city"))
    has_loc = has_hq | F.col("last_office_city").isNotNull()
    return df.select(
        "p", "k", "s", "cat1", "cat2",
        F.array("cat1", "cat2").alias("c"),
        F.array(F.col("cat2"), F.lit(config.WORLD_EXTRA_CATEGORY)).alias("doc_categories"),
        F.col("n").alias("name"),
        F.col("n").alias("description"),
        (F.coalesce(F.col("n_acquired_by"), F.lit(0)) > 0).alias("is_acquired"),
        F.col("total_funding_usd").alias("total_funding"),
        F.concat(F.lit("http://www."), F.col("p"), F.lit(".example/x")).alias("homepage_url"),
        F.when(has_loc, loc_city).alias("loc_city"),
        F.when(has_loc, F.col("hq_region")).alias("loc_region"),
        F.when(has_loc, F.lit("X")).alias("loc_country"),
        employees_label(F.col("emp_min"), F.col("emp_max")).alias("num_employees"),
        "founded_on", "closed_on",
        age_months(F.col("founded_on"), F.col("acquired_after"), F.col("closed_on"), as_of_col(as_of)).alias("age"),
        cnt("num_competitors").alias("num_competitors"),
        cnt("num_offices").alias("num_offices"),
        cnt("num_products").alias("num_products"),
        F.coalesce(F.col("investments_sum").cast("double"), F.lit(0.0)).alias("total_funding_investments"),
        cnt("number_of_investments").alias("num_investments"),
        cnt("num_acquisitions").alias("num_acquisitions"),
        cnt("num_investors_orgs").alias("num_investors_orgs"),
        cnt("num_investors_persons").alias("num_investors_persons"),
        cnt("num_funding_rounds").alias("num_funding_rounds"),
        funding_per_round(F.col("fpr_sum"), F.col("fpr_n")).alias("funding_per_round"),
    )


def competitor_edges(world: World) -> DataFrame:
    """F10 in long form: p, pos, competitor of profiled companies (order and
    duplicates kept)."""
    return (world.competitor.join(world.org.select("k", "p"), "k")
            .select("p", "pos", "competitor"))


def funding_rounds(world: World) -> DataFrame:
    """F19 in long form: rounds of profiled companies with both a date and an
    amount (0 kept)."""
    return (world.round.where(F.col("money").isNotNull() & F.col("announced_on").isNotNull())
            .join(world.org.select("k", "p"), "k")
            .select("p", "seq", F.col("announced_on").alias("d"), F.col("money").alias("a")))


def document_categories(world: World) -> DataFrame:
    """F22 in long form: the document's categories (segment, then the extra
    tag) of profiled companies."""
    return (world.org.select("k", "p").join(world.company.select("k", "cat2"), "k")
            .select("p", F.posexplode(F.array(F.col("cat2"), F.lit(config.WORLD_EXTRA_CATEGORY)))
                    .alias("pos", "category"))
            .select("p", F.col("pos").cast("int").alias("pos"), "category"))


def feature_vector(features: DataFrame) -> DataFrame:
    """the 12 model inputs as scalar columns v0..v11 (v1 = emp string)."""
    cols = [F.col("p")]
    for i, name in enumerate(config.VECTOR_SLOTS):
        if i == config.EMPLOYEES_SLOT:
            cols.append(F.coalesce(F.col(name), F.lit("")).alias("emp"))
        else:
            cols.append(F.col(name).cast("double").alias(f"v{i}"))
    return features.select(*cols)


def vector_columns() -> dict:
    """Feature vector as one ``array<double>`` (slot 1 null) plus ``emp``."""
    slots = [F.lit(None).cast("double") if i == config.EMPLOYEES_SLOT else F.col(n).cast("double")
             for i, n in enumerate(config.VECTOR_SLOTS)]
    return {"vec": F.array(*slots), "emp": F.coalesce(F.col("num_employees"), F.lit(""))}


def vector_array(features: DataFrame) -> DataFrame:
    """The columns that scoring one category at a time reads."""
    return features.select("p", "k", "s", "c", "doc_categories",
                           *[c.alias(n) for n, c in vector_columns().items()])
