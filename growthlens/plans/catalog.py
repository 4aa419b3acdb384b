"""Registered plans: name -> callable(spark, sf_dir) -> DataFrame.

Each plan reads the driver tables (through the company world) in full and
returns scalar columns named exactly like its oracle query's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, schemas
from ..functions.numeric import half_up
from ..sources import bucketed_store as BS
from ..sources import documents as DOC
from ..sources import keyed_json as KJ
from ..sources import profile_store as PS
from ..sources import ranks_io as RIO
from ..sources import search_index as SI
from ..operators import cards as CA
from ..operators import competitors as CO
from ..operators import features as FE
from ..operators import maintained as MB
from ..operators import ranking as RK
from ..operators import related as RE
from ..operators import scoring as SC
from ..operators import search as SE
from ..operators import timeline as TL
from ..operators import trends as TR
from .context import Ctx

Plan = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Plan] = {}


def plan(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


# ------------------------------------------------------------------ features
@plan("features_basic")
def features_basic(spark, sf):
    return Ctx(spark, sf).feature_plan.select("p", "name", "description", "is_acquired", "total_funding",
                                          "homepage_url", "founded_on")


@plan("feature_location")
def feature_location(spark, sf):
    return Ctx(spark, sf).feature_plan.select("p", "loc_city", "loc_region", "loc_country")


@plan("feature_employees")
def feature_employees(spark, sf):
    return Ctx(spark, sf).feature_plan.select("p", "num_employees")


@plan("feature_age")
def feature_age(spark, sf):
    return Ctx(spark, sf).feature_plan.select("p", "age")


@plan("feature_competitors")
def feature_competitors(spark, sf):
    return FE.competitor_edges(Ctx(spark, sf).world)


@plan("features_counts")
def features_counts(spark, sf):
    return Ctx(spark, sf).feature_plan.select(
        "p", "num_competitors", "num_offices", "num_products", "num_investments", "num_acquisitions",
        "num_investors_orgs", "num_investors_persons", "num_funding_rounds")


@plan("feature_investments")
def feature_investments(spark, sf):
    return Ctx(spark, sf).feature_plan.select("p", "total_funding_investments")


@plan("feature_rounds")
def feature_rounds(spark, sf):
    return FE.funding_rounds(Ctx(spark, sf).world)


@plan("feature_per_round")
def feature_per_round(spark, sf):
    return Ctx(spark, sf).feature_plan.select("p", "funding_per_round")


@plan("doc_categories")
def doc_categories(spark, sf):
    return FE.document_categories(Ctx(spark, sf).world)


@plan("feature_vector")
def feature_vector(spark, sf):
    return FE.feature_vector(Ctx(spark, sf).feature_plan)


# ------------------------------------------------------------------- scoring
@plan("eligible_categories")
def eligible_categories(spark, sf):
    return SC.eligible_categories(Ctx(spark, sf).feature_plan).drop("k")


@plan("tree_predict")
def tree_predict(spark, sf):
    return Ctx(spark, sf).scores.select("p", "category", "leaf", "n0", "n1", "reason")


@plan("success_by_category")
def success_by_category(spark, sf):
    return (Ctx(spark, sf).scores.where(F.col("reason") == "ok")
            .select("p", "category", F.col("score5").alias("score")))


@plan("success_overall")
def success_overall(spark, sf):
    return Ctx(spark, sf).success.select("p", "success_all")


# --------------------------------------------------------------- competitors
@plan("competitor_rank")
def competitor_rank(spark, sf):
    c = Ctx(spark, sf)
    return CO.competitor_rank(c.world.org, c.edges, c.world.index)


@plan("competitors")
def competitors(spark, sf):
    c = Ctx(spark, sf)
    return CO.competitor_list(c.edges, c.world.index).select("p", "pos", "competitor", "n", "i", "s")


@plan("competitors_top4")
def competitors_top4(spark, sf):
    c = Ctx(spark, sf)
    return CO.competitors_top(c.edges, c.world.index, config.COMPETITORS_SHOWN).select(
        "p", "pos", "competitor", "n", "s")


# ---------------------------------------------------- baselines, rate, counts
@plan("category_baselines")
def category_baselines(spark, sf):
    b = Ctx(spark, sf).baselines
    return b.select("category", "t", "r", half_up(F.col("m"), 4).alias("m"), half_up(F.col("d"), 4).alias("d"))


@plan("baselines_maintained")
def baselines_maintained(spark, sf):
    """A2 kept up over three batches: values that are doubled at first or not there yet, then put right."""
    from ..session import materialize
    c = Ctx(spark, sf)
    rows = materialize(MB.contributions(c.world.index, c.features).withColumn("at", _arrival(F.col("p"))), "contributions")
    at = F.col("at")
    first = F.when(at == 0, F.col("mf")).when(at == 1, F.col("mf") * 2)

    def as_of(batch, mf):
        return rows.select("p", "categories", mf.alias("mf"), F.lit(batch).alias("fetched_at"), "at")

    path = MB.start(_scratch(spark, "baselines"), as_of(0, first))
    MB.update(path, as_of(1, F.col("mf")).where(at == 1), 1)
    MB.update(path, as_of(2, F.col("mf")).where(at == 2), 2)
    return MB.baselines(spark, path, config.WORLD_MIN_CATEGORY_SIZE).select(
        "category", "t", "r", half_up(F.col("m"), 4).alias("m"), half_up(F.col("d"), 4).alias("d"))


@plan("category_counts")
def category_counts(spark, sf):
    return Ctx(spark, sf).world.company_category.groupBy("category").agg(F.count(F.lit(1)).alias("t"))


@plan("funding_rate")
def funding_rate(spark, sf):
    return Ctx(spark, sf).rate.select("p", "rate")


@plan("funding_rate_mean")
def funding_rate_mean(spark, sf):
    return Ctx(spark, sf, baseline="m").rate.select("p", "rate")


@plan("index_counts")
def index_counts(spark, sf):
    c = Ctx(spark, sf)
    return TR.index_counts(c.world.index, c.baselines)


@plan("build_profiles")
def build_profiles(spark, sf):
    c = Ctx(spark, sf)
    return c.profiles.select(
        "p", "name", "is_acquired", "total_funding", "num_employees", "age", "num_competitors",
        "num_offices", "num_products", "total_funding_investments", "num_investments", "num_acquisitions",
        "num_investors_orgs", "num_investors_persons", "num_funding_rounds", "funding_per_round",
        "success_all", "rate")


# ------------------------------------------------------- predicates, classes
@plan("allstar")
def allstar(spark, sf):
    return TR.flags(Ctx(spark, sf).profiles).select("p", "allstar")


@plan("hot")
def hot(spark, sf):
    return TR.flags(Ctx(spark, sf).profiles).select("p", "hot")


@plan("success_class")
def success_class(spark, sf):
    return CA.success_classes(Ctx(spark, sf).profiles).select("p", "class", "subclass")


@plan("profile_tag")
def profile_tag(spark, sf):
    return CA.success_classes(Ctx(spark, sf).profiles).select("p", "tag")


@plan("profile_card")
def profile_card(spark, sf):
    return CA.profile_card(Ctx(spark, sf).profiles)


@plan("profile_attributes")
def profile_attributes(spark, sf):
    return CA.profile_attributes(Ctx(spark, sf).profiles)


# --------------------------------------------------------------------- trends
@plan("trends_allstar")
def trends_allstar(spark, sf):
    c = Ctx(spark, sf)
    return TR.trend_list(c.profiles, c.world.index, "allstar")


@plan("trends_hot")
def trends_hot(spark, sf):
    c = Ctx(spark, sf)
    return TR.trend_list(c.profiles, c.world.index, "hot")


@plan("refresh_scores")
def refresh_scores(spark, sf):
    c = Ctx(spark, sf)
    return TR.refresh_scores(c.world.index, c.profiles).select("p", "s")


@plan("effective_score")
def effective_score(spark, sf):
    c = Ctx(spark, sf)
    return c.effective.select("category", "p", "s")


# -------------------------------------------------------------------- ranking
@plan("category_topk")
def category_topk(spark, sf):
    return Ctx(spark, sf).topk.select("category", "rank", "p", "s")


@plan("nlargest")
def nlargest(spark, sf):
    return RK.nlargest(Ctx(spark, sf).topk, 3).select("category", "rank", "p", "s")


@plan("category_topk_subset")
def category_topk_subset(spark, sf):
    c = Ctx(spark, sf)
    cats = c.world.company.select("cat2").distinct().where(F.col("cat2").isin(*sorted(config.WORLD_TREES)))
    eff = c.effective.join(cats.withColumnRenamed("cat2", "category"), "category", "left_semi")
    return RK.category_topk(eff, config.TOP_K).select("category", "rank", "p", "s")


# --------------------------------------------------------------------- search
@plan("search_keys")
def search_keys(spark, sf):
    return SE.search_keys(Ctx(spark, sf).world.queries)


@plan("name_tokens")
def name_tokens(spark, sf):
    return SE.name_tokens(Ctx(spark, sf).world.index)


@plan("search_filter")
def search_filter(spark, sf):
    c = Ctx(spark, sf)
    return SE.search_filter(c.world.index, SE.accepted_queries(c.world.queries))


@plan("search_blocked")
def search_blocked(spark, sf):
    c = Ctx(spark, sf)
    return SE.search_matches(c.world.index, SE.accepted_queries(c.world.queries))


@plan("keyword_score")
def keyword_score(spark, sf):
    c = Ctx(spark, sf)
    return SE.scored_matches(c.world.index, c.world.queries).select("query_id", "p", "kscore")


@plan("search_rejects")
def search_rejects(spark, sf):
    return SE.search_rejects(Ctx(spark, sf).world.queries)


@plan("search")
def search(spark, sf):
    c = Ctx(spark, sf)
    return SE.search(c.world.index, c.world.queries).select("query_id", "pos", "p", "n", "i", "s", "score")


@plan("search_page")
def search_page(spark, sf):
    c = Ctx(spark, sf)
    r = SE.search(c.world.index, c.world.queries)
    return r.select("query_id", SE.page_of(F.col("pos")).alias("page"), "pos", "p")


@plan("page_counts")
def page_counts(spark, sf):
    c = Ctx(spark, sf)
    return SE.page_counts(SE.search_matches(c.world.index, SE.accepted_queries(c.world.queries)),
                          c.world.queries)


def _arrival(p):
    """0, 1 or 2: the batch in which a company's final row arrives."""
    return F.pmod(F.crc32(F.encode(p, "UTF-8")), F.lit(3))


@plan("search_indexed")
def search_indexed(spark, sf):
    """J8 on an index that grew in three batches: companies that are renamed, new and gone again."""
    from ..session import materialize
    c = Ctx(spark, sf)
    names = materialize(c.world.index.select("p", "n"), "names")
    at, p, n = _arrival(F.col("p")), F.col("p"), F.col("n")
    gone = names.select(F.concat(F.lit("gone-"), p).alias("p"), "n")
    first = names.where(at < 2).select("p", F.when(at == 0, n).otherwise(F.reverse(n)).alias("n"))
    path = SI.create(_scratch(spark, "search_index"), first)
    SI.update(path, names.where(at == 2).unionByName(gone), 1)
    SI.update(path, names.where(at == 1).unionByName(gone.withColumn("n", F.lit(None).cast("string"))), 2)
    return SI.matches(spark, path, SE.accepted_queries(c.world.queries))


# -------------------------------------------------------------------- related
@plan("related_competitors")
def related_competitors(spark, sf):
    c = Ctx(spark, sf)
    return RE.competitor_candidates(c.world.lists, c.edges, c.world.index).select(
        "list_id", "src_pos", "sub", F.col("cand").alias("p"))


@plan("related_by_category")
def related_by_category(spark, sf):
    c = Ctx(spark, sf)
    return RE.category_candidates(c.world.lists, c.world.company_category, c.topk).select(
        "list_id", "src_pos", "sub", "rank", F.col("cand").alias("p"))


@plan("related_dedup")
def related_dedup(spark, sf):
    c = Ctx(spark, sf)
    return RE.discoveries(c.world.lists, c.edges, c.world.index, c.world.company_category, c.topk)


@plan("related")
def related(spark, sf):
    c = Ctx(spark, sf).stored()
    # the effective score needs success_all only (no baselines or rate)
    return RE.related(c.world.lists, c.edges, c.world.index, c.world.company_category, c.topk, c.success)


# ------------------------------------------------------------------- timeline
@plan("funding_by_year")
def funding_by_year(spark, sf):
    return TL.funding_by_year(Ctx(spark, sf).rounds)


@plan("funding_bounds")
def funding_bounds(spark, sf):
    c = Ctx(spark, sf)
    return TL.funding_bounds(c.rounds, c.world.org).select("p", "min_amount", "min_date", "max_year")


@plan("funding_scale")
def funding_scale(spark, sf):
    c = Ctx(spark, sf)
    return TL.funding_scale(TL.funding_bounds(c.rounds, c.world.org)).select("p", "pow")


@plan("funding_timeline")
def funding_timeline(spark, sf):
    c = Ctx(spark, sf)
    return TL.funding_timeline(c.rounds, c.world.org)


@plan("funding_domain")
def funding_domain(spark, sf):
    c = Ctx(spark, sf)
    return TL.funding_domain(c.rounds, c.world.org, config.WORLD_AS_OF)


# ------------------------------------------------------------ sources, sinks
def _scratch(spark, name):
    from ..session import scratch_path
    return scratch_path(spark, name)


@plan("load_companies")
def load_companies(spark, sf):
    c = Ctx(spark, sf)
    path = KJ.write_keyed(c.world.index, "p", ["n", "i", "s", "c"], _scratch(spark, "index"))
    df = KJ.read_keyed(spark, path, schemas.INDEX_ENTRY, "p")
    return df.select("p", "n", "i", "s", F.array_join("c", "|").alias("categories"))


@plan("load_category_stats")
def load_category_stats(spark, sf):
    c = Ctx(spark, sf)
    path = KJ.write_keyed(c.baselines, "category", ["t", "r", "m", "d"], _scratch(spark, "category_stats"))
    df = KJ.read_keyed(spark, path, schemas.CATEGORY_STATS, "category")
    return df.select("category", "t", "r", half_up(F.col("m"), 4).alias("m"), half_up(F.col("d"), 4).alias("d"))


def _ingested(spark, sf):
    c = Ctx(spark, sf)
    path = DOC.write_document_lines(DOC.build_document_pages(c.world), _scratch(spark, "orgs"),
                                    config.WORLD_CORRUPT_EVERY)
    return c, DOC.split_documents(DOC.read_documents(spark, path))


@plan("ingest_orgs")
def ingest_orgs(spark, sf):
    _, (good, _q) = _ingested(spark, sf)
    header = good.where(F.coalesce(F.col("data.page"), F.lit(0)) == 0)
    return header.select("p", F.col("data.properties.founded_on").alias("founded_on"),
                       F.col("data.properties.total_funding_usd").alias("total_funding_usd"),
                       F.col("data.properties.num_employees_min").alias("emp_min"),
                       F.col("data.properties.num_employees_max").alias("emp_max"))


@plan("quarantine")
def quarantine(spark, sf):
    c, (good, q) = _ingested(spark, sf)
    scores = SC.score_categories(DOC.with_index(DOC.document_features(good), c.world.index), c.packed_trees)
    return q.unionByName(DOC.not_in_index(good, c.world.index)).unionByName(DOC.without_model(scores))


@plan("doc_features")
def doc_features(spark, sf):
    _, (good, _q) = _ingested(spark, sf)
    f = DOC.document_features(good)
    return f.select("p", "is_acquired", "loc_city", "num_employees", "age", "num_competitors", "num_offices",
                    "num_products", "total_funding_investments", "num_investments", "num_acquisitions",
                    "num_investors_orgs", "num_investors_persons", "num_funding_rounds", "funding_per_round",
                    F.array_join("competitors", ",").alias("competitors"),
                    F.col("num_rounds_dated").alias("n_rounds_dated"),
                    F.array_join("doc_categories", "|").alias("doc_categories"))


@plan("doc_profiles")
def doc_profiles(spark, sf):
    """Profiles scored from ingested documents (S4 -> F -> M2..M6 -> R1)."""
    c, (good, _q) = _ingested(spark, sf)
    feats = DOC.with_index(DOC.document_features(good), c.world.index)
    prof = SC.build_profiles(feats, c.packed_trees, c.baselines)
    return prof.select("p", "age", "success_all", "rate")


def _stored_profiles(spark, c):
    return BS.create(_scratch(spark, "profiles"), c.profiles.select(
        "p", F.lit(1).alias("fetched_at"), "age", "success_all", "rate"))


@plan("has_profile")
def has_profile(spark, sf):
    c = Ctx(spark, sf)
    return BS.has_profile(c.world.index, _stored_profiles(spark, c))


@plan("profile_lookup")
def profile_lookup(spark, sf):
    c = Ctx(spark, sf)
    lookups = c.world.competitor.select(F.col("competitor").alias("p")).distinct()
    return BS.profile_lookup(lookups, _stored_profiles(spark, c), ["age", "success_all", "rate"])


UPSERT_AS_OF = "2002-09-01"


@plan("profile_upsert")
def profile_upsert(spark, sf):
    c = Ctx(spark, sf)
    table = BS.create(_scratch(spark, "profiles"), c.feature_plan.select("p", F.lit(1).alias("fetched_at"), "age"))
    later = Ctx(spark, sf, as_of=UPSERT_AS_OF)
    changed = c.rounds.where(F.year("d") == 2001).select("p").distinct()
    BS.upsert(table, later.feature_plan.join(changed, "p", "left_semi").select("p", F.lit(2).alias("fetched_at"), "age"), 1)
    return BS.read(spark, table).select("p", "fetched_at", "age")


@plan("ranks_export")
def ranks_export(spark, sf):
    c = Ctx(spark, sf)
    path = RIO.export_ranks(c.topk, _scratch(spark, "ranks"))
    return spark.read.text(path)


@plan("ranks_import")
def ranks_import(spark, sf):
    c = Ctx(spark, sf)
    path = RIO.export_ranks(c.topk, _scratch(spark, "ranks"))
    return RIO.import_ranks(spark, path)


@plan("meta_lookup")
def meta_lookup(spark, sf):
    c = Ctx(spark, sf)
    lookups = c.world.competitor.select(F.col("competitor").alias("p")).distinct()
    return PS.meta_lookup(lookups, c.world.index)


# ------------------------------------------------------------------ streaming
@plan("topk_incremental")
def topk_incremental(spark, sf):
    from ..streaming import topk as ST
    return ST.run_reference_topk(spark, sf, config.TOP_K)


@plan("topk_exact_latest")
def topk_exact_latest(spark, sf):
    from ..streaming import topk as ST
    return ST.run_exact_topk(spark, sf, config.TOP_K).select("category", "rank", "p", "s")


def _landing(spark, c):
    return DOC.write_document_lines(DOC.build_document_pages(c.world), _scratch(spark, "landing"),
                                    config.WORLD_CORRUPT_EVERY)


@plan("stream_profiles")
def stream_profiles(spark, sf):
    from ..streaming import profiles as SP
    c = Ctx(spark, sf)
    prof = SP.run_profile_stream(spark, _landing(spark, c), c.world.index, c.packed_trees, c.baselines)
    return prof.select("p", "age", "success_all", "rate")


@plan("stream_quarantine")
def stream_quarantine(spark, sf):
    from ..streaming import profiles as SP
    c = Ctx(spark, sf)
    return SP.run_quarantine_stream(spark, _landing(spark, c), c.world.index).select("reason", "raw")


@plan("stream_topk_profiles")
def stream_topk_profiles(spark, sf):
    from ..streaming import profiles as SP
    c = Ctx(spark, sf)
    return SP.run_profile_topk(spark, _landing(spark, c), c.world.index, c.world.company_category.select(
        "category", "p", "s"), c.packed_trees, c.baselines)


# ------------------------------------------------------- trees: train / load
def _trained_tree_folder(spark, sf):
    from ..operators import training as TRN
    c = Ctx(spark, sf)
    texts = TRN.tree_texts(TRN.training_rows(c.features, c.world.company_category))
    return TRN.write_tree_texts(texts, _scratch(spark, "trees"))


@plan("train_trees")
def train_trees(spark, sf):
    """M8: every training row walked through its category's trained, written and reloaded tree."""
    from ..operators import training as TRN
    from ..operators import trees as T
    from ..session import materialize
    c = Ctx(spark, sf)
    rows = materialize(TRN.training_rows(c.features, c.world.company_category), "train_rows")
    folder = TRN.write_tree_texts(TRN.tree_texts(rows), _scratch(spark, "trees"))
    return TRN.reproduced(T.predict(rows, TRN.load_trees(spark, folder), TRN.folder_bytes(spark, folder)))


@plan("load_trees")
def load_trees(spark, sf):
    """S3 on the trained trees: each file read and parsed, with its length and the tree's size."""
    from ..operators import training as TRN
    return TRN.load_trees(spark, _trained_tree_folder(spark, sf)).select("category", "json_chars", "n_nodes", "depth")


@plan("tree_nodes")
def tree_nodes(spark, sf):
    from ..operators import training as TRN
    from ..operators import trees as T
    return T.tree_nodes(TRN.load_trees(spark, _trained_tree_folder(spark, sf)))


@plan("tree_summary")
def tree_summary(spark, sf):
    from ..operators import training as TRN
    from ..operators import trees as T
    return T.tree_summary(TRN.load_trees(spark, _trained_tree_folder(spark, sf)))


def _deep_models(spark, sf):
    """Packed trees of the rule-made deep model files, written and loaded as files (S3 -> M1)."""
    from ..operators import training as TRN
    from ..operators import trees as T
    from ..sources import rule_models as RM
    c = Ctx(spark, sf)
    texts = {r.category: r.json for r in RM.tree_texts(c.world.company_category).collect()}  # one file a category
    folder = TRN.write_tree_files(spark, texts, _scratch(spark, "deep_models"))
    loaded = TRN.load_tree_texts(spark, folder)
    return c, loaded, T.pack_trees(loaded, TRN.folder_bytes(spark, folder))


@plan("deep_load")
def deep_load(spark, sf):
    _c, loaded, _packed = _deep_models(spark, sf)
    return loaded.select("category", "json")


@plan("deep_nodes")
def deep_nodes(spark, sf):
    from ..operators import trees as T
    return T.tree_nodes(_deep_models(spark, sf)[2])


@plan("deep_summary")
def deep_summary(spark, sf):
    from ..operators import trees as T
    return T.tree_summary(_deep_models(spark, sf)[2])


@plan("deep_predict")
def deep_predict(spark, sf):
    from ..operators import trees as T
    from ..sources import rule_models as RM
    c, _loaded, packed = _deep_models(spark, sf)
    eligible = SC.vector_array(c.features).select("p", "vec", "emp", F.explode(F.filter(
        "doc_categories", lambda x: F.array_contains(F.col("c"), x))).alias("category"))
    rows = eligible.withColumn("category", F.concat("category", F.lit(RM.SUFFIX)))
    return T.predict(rows, packed).select("p", "category", "leaf", "n0", "n1", "reason")


@plan("tree_predict_trained")
def tree_predict_trained(spark, sf):
    """Scoring with the trees trained on the world (S3 -> M1 -> M2 -> M4)."""
    from ..operators import training as TRN
    c = Ctx(spark, sf)
    folder = TRN.write_tree_texts(TRN.tree_texts(TRN.training_rows(c.features, c.world.company_category)),
                                  _scratch(spark, "trees"))
    scores = SC.score_categories(c.features, TRN.load_trees(spark, folder), TRN.folder_bytes(spark, folder))
    return scores.select("p", "category", "leaf", "n0", "n1", "reason", "score5")
