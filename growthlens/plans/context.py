"""Shared, lazily built frames of one plan invocation over one scale dir."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import features as FE
from ..operators import scoring as SC
from ..operators import trees as T
from ..sources.world import World


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str, as_of=config.WORLD_AS_OF, baseline: str = "r"):
        self.spark = spark
        self.sf_dir = sf_dir
        self.as_of = as_of
        self.baseline = baseline
        self.world = World(spark, sf_dir)

    def stored(self) -> Ctx:
        """This context with the frames that one plan reads several times written once: the index, the companies'
        scores, and the top-k, which has at most k rows a category."""
        from ..session import materialize
        self.world.company = materialize(self.world.company, "company")
        self.success = materialize(self.success, "success")
        self.topk = materialize(self.topk, "topk")
        return self

    @cached_property
    def features(self) -> DataFrame:
        """The feature table.  Scoring, baselines, rate and the rankings all
        read it, so it is written once as a Parquet table in the shared
        checkpoint folder and read back, instead of being recomputed for
        every branch of a plan."""
        from ..session import materialize
        return materialize(FE.profile_features(self.world, self.as_of), "features")

    @cached_property
    def feature_plan(self) -> DataFrame:
        """The same features as a lazy plan, for single-use projections."""
        return FE.profile_features(self.world, self.as_of)

    @cached_property
    def packed_trees(self) -> DataFrame:
        return T.pack_constant_trees(self.spark, config.WORLD_TREES)

    @cached_property
    def scores(self) -> DataFrame:
        return SC.score_categories(self.features, self.packed_trees)

    @cached_property
    def success(self) -> DataFrame:
        return SC.with_success(self.features, self.packed_trees).select("k", "p", "success_all", "success")

    @cached_property
    def baselines(self) -> DataFrame:
        return SC.category_baselines(self.world.company_category, self.features,
                                     config.WORLD_MIN_CATEGORY_SIZE)

    @cached_property
    def rate(self) -> DataFrame:
        return SC.funding_rate(self.features, self.baselines, self.baseline)

    @cached_property
    def profiles(self) -> DataFrame:
        """features + success_all + success map + rate."""
        return SC.build_profiles(self.features, self.packed_trees, self.baselines, self.baseline)

    @cached_property
    def edges(self) -> DataFrame:
        return FE.competitor_edges(self.world)

    @cached_property
    def effective(self) -> DataFrame:
        from ..operators import ranking as RK
        index = self.world.company.select("p", "k", "s", F.array("cat1", "cat2").alias("c"))
        return RK.effective_category_scores(index, self.success)

    @cached_property
    def topk(self) -> DataFrame:
        from ..operators import ranking as RK
        return RK.category_topk(self.effective, config.TOP_K)

    @cached_property
    def rounds(self) -> DataFrame:
        return FE.funding_rounds(self.world)
