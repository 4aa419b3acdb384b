"""Organisation documents (D4): bulk ingest with a quarantine (S4) and the
feature projection over nested documents (F1-F22).

Documents land as JSON lines (``spark.read.json`` / ``readStream.json``
with an explicit schema, PERMISSIVE mode); malformed or key-less lines go to
a quarantine frame instead of failing the job.

A company's document may arrive as **pages**: page 0 carries the properties
and the header relationships (headquarters, competitors, categories), later
pages carry relationship items.  A classic whole document is simply page 0.
Features are computed in two steps so no company is ever gathered:

1. ``page_stats`` -- one row per page, row-local higher-order functions
   (sizes, filtered counts, decimal sums, latest dates, last office);
2. ``combine_pages`` -- a partial (map-side) aggregate of those rows per
   company, joined with the header row.

``build_document_pages`` writes the world's organisations in that shape:
one header page per company (row-local) and one page per order with the
order's round / acquisition items and its line items (bounded by the
order's line count).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, schemas
from ..functions.dates import as_of_col
from ..functions.numeric import half_up
from ..operators.features import age_months, employees_label
from .world import World

MONEY = "decimal(18,2)"


# ----------------------------------------------------------------- writing
def _items(arr: Column) -> Column:
    """{items: arr} or null when the array is null/empty (absent relationship)."""
    return F.when(F.size(F.coalesce(arr, F.array())) > 0, F.struct(arr.alias("items")))


def _address(city: Column, region: Column) -> Column:
    return F.struct(city.alias("city"), region.alias("region"), F.lit("X").alias("country"))


def build_document_pages(world: World) -> DataFrame:
    """k, p, doc for every page of every profiled company."""
    org = world.org
    comp = world.company.select("k", "n", "cat2", "hq_city", "hq_region")
    head = org.join(comp, "k").withColumn("_nn", world.customer_count())
    k = F.col("k")
    competitors = World.competitor_list(k, F.col("_nn"))
    header = head.select("k", "p", F.struct(F.struct(
        F.lit(0).cast("bigint").alias("page"),
        F.struct(F.col("p").alias("permalink"), F.col("n").alias("name"), F.col("n").alias("short_description"),
                 F.concat(F.lit("http://www."), F.col("p"), F.lit(".example/x")).alias("homepage_url"),
                 F.col("total_funding_usd"), F.col("emp_min").alias("num_employees_min"),
                 F.col("emp_max").alias("num_employees_max"), "founded_on", "closed_on",
                 "number_of_investments").alias("properties"),
        F.struct(
            F.when(k % 2 == 0, F.struct(F.struct(_address(F.col("hq_city"), F.col("hq_region"))
                                                 .alias("properties")).alias("item"))).alias("headquarters"),
            _items(F.transform(competitors, lambda c: F.struct(F.struct(c.alias("permalink")).alias("properties"))))
            .alias("competitors"),
            F.struct(F.array(
                F.struct(F.struct(F.col("cat2").alias("name")).alias("properties")),
                F.struct(F.struct(F.lit(config.WORLD_EXTRA_CATEGORY).alias("name")).alias("properties")))
                .alias("items")).alias("categories"),
        ).alias("relationships")).alias("data")).alias("doc"))

    # line items of one order, in item order (supplier, part); bounded by the
    # order's line count, so this collect never spans a company
    it = world.item_rows
    kind = F.col("kind")

    def per_order(cond: Column, item: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(cond, F.struct("l_suppkey", "l_partkey", item.alias("_it")))))

    lines = it.groupBy("seq").agg(
        per_order(kind == 2, F.struct(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("city"))
                  ).alias("_off"),
        per_order(kind == 3, F.struct(F.struct(F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
                                               .alias("name")).alias("properties"))).alias("_prod"),
        per_order(kind == 4, F.struct(F.struct(F.struct(F.struct(F.col("money").alias("money_raised_usd"))
                                                        .alias("properties")).alias("funding_round"))
                                      .alias("relationships"))).alias("_inv"),
        per_order(kind == 1, F.struct(F.col("investor_type").alias("type"))).alias("_invr"))
    facts = world.order_facts.join(head.select("k", "p", "hq_region"), "k").join(lines, "seq", "left")
    strip = lambda c: F.transform(F.col(c), lambda x: x["_it"])
    offices = F.transform(F.col("_off"), lambda x: F.struct(_address(x["_it"]["city"], F.col("hq_region"))
                                                              .alias("properties")))
    pages = facts.select("k", "p", F.struct(F.struct(
        (F.col("seq") + 1).cast("bigint").alias("page"),
        F.struct(F.col("p").alias("permalink")).alias("properties"),
        F.struct(
            _items(F.when(F.col("acquired"), F.array(F.struct(F.struct(F.col("acquired_on").alias("announced_on"))
                                                              .alias("type"))))).alias("acquired_by"),
            _items(offices).alias("offices"),
            _items(strip("_prod")).alias("products"),
            _items(strip("_inv")).alias("investments"),
            _items(F.when(F.col("is_acquisition"), F.array(F.struct(F.struct(
                F.concat(F.lit("A"), F.col("seq").cast("string")).alias("name")).alias("properties")))))
            .alias("acquisitions"),
            _items(strip("_invr")).alias("investors"),
            F.struct(F.array(F.struct(F.struct(F.col("money").alias("money_raised_usd"), "announced_on")
                                      .alias("properties"))).alias("items")).alias("funding_rounds"),
        ).alias("relationships")).alias("data")).alias("doc"))
    return header.unionByName(pages, allowMissingColumns=True)


def write_document_lines(docs: DataFrame, path: str, corrupt_every: int | None = None) -> str:
    """Write one JSON document (page) per line; with ``corrupt_every`` a junk
    line stands beside every line of companies with k % corrupt_every = 0."""
    lines = F.array(F.to_json("doc"))
    if corrupt_every:
        lines = F.when(F.col("k") % corrupt_every == 0, F.array(F.to_json("doc"), F.lit("not json"))).otherwise(lines)
    docs.select(F.explode(lines).alias("value")).write.mode("overwrite").text(path)
    return path


# ----------------------------------------------------------------- reading
def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """PERMISSIVE read with the explicit D4 schema; bad lines keep their
    text in ``_corrupt_record``."""
    return (spark.read.schema(schemas.ORG_DOCUMENT_WITH_CORRUPT)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", schemas.CORRUPT)
            .json(path))


def split_documents(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good documents (p, data), quarantine (p, reason, raw)); p is null, as these lines name no company."""
    bad_parse = F.col(schemas.CORRUPT).isNotNull()
    no_key = F.col("data.properties.permalink").isNull()
    good = raw.where(~bad_parse & ~no_key).select(F.col("data.properties.permalink").alias("p"), "data")
    quarantine = raw.where(bad_parse | no_key).select(
        F.lit(None).cast("string").alias("p"),
        F.when(bad_parse, F.lit("malformed_json")).otherwise(F.lit("missing_permalink")).alias("reason"),
        F.coalesce(F.col(schemas.CORRUPT), F.to_json(F.struct("data"))).alias("raw"))
    return good, quarantine


def not_in_index(good: DataFrame, index: DataFrame) -> DataFrame:
    """Quarantine rows (p, reason, raw) of documents whose company is not indexed."""
    lost = good.join(index.select("p"), "p", "left_anti")
    return lost.select("p", F.lit("not_in_index").alias("reason"), F.to_json(F.struct("data")).alias("raw"))


def without_model(scores: DataFrame) -> DataFrame:
    """Quarantine rows (p, reason, raw) of the eligible categories that no model scores; raw is the category. The company
    itself is scored on its other categories."""
    return scores.where(F.col("reason") == "no_model").select("p", "reason", F.col("category").alias("raw")).distinct()


# --------------------------------------------------------------- features
def _count(items: Column) -> Column:
    return F.when(items.isNull(), F.lit(0)).otherwise(F.size(items)).cast("bigint")


def page_stats(docs: DataFrame) -> DataFrame:
    """Step 1: one row per page (p, page, hdr, additive statistics)."""
    P = F.col("data.properties")
    R = F.col("data.relationships")
    page = F.coalesce(F.col("data.page"), F.lit(0)).cast("bigint")
    inv = R["investments"]["items"]
    investors = R["investors"]["items"]
    rounds = R["funding_rounds"]["items"]
    nz = F.filter(rounds, lambda r: F.coalesce(r["properties"]["money_raised_usd"] != 0, F.lit(False)))
    hdr = F.struct(
        P["name"].alias("name"), P["short_description"].alias("description"),
        P["total_funding_usd"].alias("total_funding"), P["homepage_url"].alias("homepage_url"),
        P["num_employees_min"].alias("emp_min"), P["num_employees_max"].alias("emp_max"),
        P["founded_on"].alias("founded_on"), P["closed_on"].alias("closed_on"),
        P["number_of_investments"].alias("number_of_investments"),
        R["headquarters"]["item"]["properties"].alias("hq"),
        F.coalesce(F.transform(R["competitors"]["items"], lambda x: x["properties"]["permalink"]),
                   F.array().cast("array<string>")).alias("competitors"),
        F.coalesce(F.transform(R["categories"]["items"], lambda x: x["properties"]["name"]),
                   F.array().cast("array<string>")).alias("doc_categories"))
    return docs.select(
        "p", page.alias("page"), F.coalesce(F.col("data.version"), F.lit(0)).cast("bigint").alias("version"),
        F.when(page == 0, hdr).alias("hdr"),
        _count(R["acquired_by"]["items"]).alias("n_acquired_by"),
        F.array_max(F.transform(R["acquired_by"]["items"], lambda x: x["type"]["announced_on"])).alias("acq_max"),
        F.try_element_at(R["offices"]["items"], F.lit(-1))["properties"].alias("last_office"),
        _count(R["offices"]["items"]).alias("n_offices"),
        _count(R["products"]["items"]).alias("n_products"),
        _count(R["competitors"]["items"]).alias("n_competitors"),
        _count(R["acquisitions"]["items"]).alias("n_acquisitions"),
        F.aggregate(inv, F.lit(0).cast(MONEY), lambda acc, x: (acc + F.coalesce(
            x["relationships"]["funding_round"]["properties"]["money_raised_usd"].cast(MONEY),
            F.lit(0).cast(MONEY))).cast(MONEY)).alias("inv_sum"),
        F.coalesce(F.size(F.filter(investors, lambda x: x["type"] == config.INVESTOR_ORGANIZATION)), F.lit(0))
        .cast("bigint").alias("n_inv_org"),
        F.coalesce(F.size(F.filter(investors, lambda x: x["type"] == config.INVESTOR_PERSON)), F.lit(0))
        .cast("bigint").alias("n_inv_person"),
        _count(rounds).alias("n_rounds"),
        F.coalesce(F.size(F.filter(rounds, lambda r: r["properties"]["money_raised_usd"].isNotNull()
                                   & r["properties"]["announced_on"].isNotNull())), F.lit(0))
        .cast("bigint").alias("n_rounds_dated"),
        F.aggregate(nz, F.lit(0).cast(MONEY),
                    lambda acc, r: (acc + r["properties"]["money_raised_usd"].cast(MONEY)).cast(MONEY)).alias("nz_sum"),
        F.coalesce(F.size(nz), F.lit(0)).cast("bigint").alias("nz_n"))


def latest_pages(stats: DataFrame) -> DataFrame:
    """The latest version of every (company, page): the highest version, then
    the latest micro-batch where known, then the greatest content, so that a
    re-sent document replaces the earlier one and reruns agree."""
    first = [c for c in ("version", "batch_id") if c in stats.columns]
    rest = [c for c in stats.columns if c not in ("p", "page", *first)]
    newest = F.max(F.struct(*first, *rest)).alias("_newest")
    return stats.groupBy("p", "page").agg(newest).select("p", "page", *[F.col(f"_newest.{c}") for c in rest])


def combine_pages(stats: DataFrame, as_of=config.WORLD_AS_OF) -> DataFrame:
    """Step 2: per company, a partial aggregate of the page statistics joined
    with the header row -> the same feature columns as the relational
    ``profile_features`` (without the index columns)."""
    stats = latest_pages(stats)
    agg = stats.groupBy("p").agg(
        F.sum("n_acquired_by").alias("n_acquired_by"), F.max("acq_max").alias("acq_max"),
        F.max_by("last_office", F.when(F.col("last_office").isNotNull(), F.col("page"))).alias("last_office"),
        *[F.sum(c).alias(c) for c in ("n_offices", "n_products", "n_competitors", "n_acquisitions",
                                      "n_inv_org", "n_inv_person", "n_rounds", "n_rounds_dated", "nz_n")],
        F.sum("inv_sum").cast(MONEY).alias("inv_sum"), F.sum("nz_sum").cast(MONEY).alias("nz_sum"))
    head = stats.where(F.col("hdr").isNotNull()).select("p", "hdr.*")
    return merged_features(head.join(agg, "p", "left"), as_of)


def page_rows(stats: DataFrame) -> DataFrame:
    """Page statistics as rows for keyed state: p, page, version, and as JSON the mergeable numbers other than 0 (body),
    the header and the last office."""
    from ..streaming.keyed import COUNTS, SUMS
    body = F.struct(*[F.nullif(F.col(c), F.lit(0)).alias(c) for c in COUNTS],
                    F.col("acq_max").cast("string").alias("acq_max"),
                    *[F.nullif(F.col(c), F.lit(0).cast(MONEY)).cast("string").alias(c) for c in SUMS])
    return stats.select("p", "page", "version", F.to_json(body).alias("body"), F.to_json("hdr").alias("hdr"),
                        F.to_json("last_office").alias("office"))


def merged_rows(merged: DataFrame, stats: DataFrame, as_of=config.WORLD_AS_OF) -> DataFrame:
    """The features of companies from their merged statistics (``streaming.keyed.COMBINED``); ``stats`` gives the types."""
    from ..streaming.keyed import COUNTS, SUMS
    kind = stats.schema
    one = lambda c: F.from_json(c, kind[c].dataType)
    typed = merged.select("p", one("hdr").alias("hdr"), one("last_office").alias("last_office"),
                          F.col("acq_max").cast(kind["acq_max"].dataType).alias("acq_max"), *COUNTS,
                          *[F.col(c).cast(MONEY).alias(c) for c in SUMS])
    return merged_features(typed.select("p", "hdr.*", *[c for c in typed.columns if c not in ("p", "hdr")]), as_of)


def merged_features(j: DataFrame, as_of=config.WORLD_AS_OF) -> DataFrame:
    """The feature columns from a company's header and merged statistics."""
    addr = F.coalesce(F.col("hq"), F.col("last_office"))
    founded = F.col("founded_on")
    acq_after = F.when(F.col("acq_max") > founded, F.col("acq_max"))
    nz_n = F.coalesce(F.col("nz_n"), F.lit(0))
    cnt = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return j.select(
        "p", "name", "description",
        (cnt("n_acquired_by") > 0).alias("is_acquired"),
        "total_funding", "homepage_url",
        addr["city"].alias("loc_city"), addr["region"].alias("loc_region"), addr["country"].alias("loc_country"),
        employees_label(F.col("emp_min"), F.col("emp_max")).alias("num_employees"),
        "founded_on", "closed_on",
        age_months(founded, acq_after, F.col("closed_on"), as_of_col(as_of)).alias("age"),
        "competitors",
        cnt("n_competitors").alias("num_competitors"),
        cnt("n_offices").alias("num_offices"),
        cnt("n_products").alias("num_products"),
        F.coalesce(F.col("inv_sum").cast("double"), F.lit(0.0)).alias("total_funding_investments"),
        F.coalesce(F.col("number_of_investments"), F.lit(0)).cast("bigint").alias("num_investments"),
        cnt("n_acquisitions").alias("num_acquisitions"),
        cnt("n_inv_org").alias("num_investors_orgs"),
        cnt("n_inv_person").alias("num_investors_persons"),
        cnt("n_rounds_dated").alias("num_rounds_dated"),
        cnt("n_rounds").alias("num_funding_rounds"),
        F.when(nz_n == 0, F.lit(0.0))
        .otherwise(half_up(F.col("nz_sum").cast("double") / nz_n, config.FUNDING_PER_ROUND_DECIMALS))
        .alias("funding_per_round"),
        "doc_categories")


def document_features(docs: DataFrame, as_of=config.WORLD_AS_OF) -> DataFrame:
    """F1-F22 over (p, data) documents or document pages."""
    return combine_pages(page_stats(docs), as_of)


def with_index(features: DataFrame, index: DataFrame) -> DataFrame:
    """Attach the index score and categories (k, s, cat1, cat2) to document
    features, so the scoring operators accept them."""
    idx = index.select("p", F.col("s"), "c", F.get(F.col("c"), 0).alias("cat1"),
                       F.try_element_at(F.col("c"), F.lit(-1)).alias("cat2"),
                       F.col("p").alias("k"))
    return features.join(idx, "p")
