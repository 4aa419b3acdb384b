"""The company world: index, organisation properties and relationship rows
derived from the driver's tables by deterministic rules (FIXTURES.md §2).

Every frame is long form (one row per company or per relationship item), so
the feature jobs downstream aggregate per company with map-side partial
aggregation instead of materialising nested arrays.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from .tables import read_table

# name variants by custkey % 4 and image presence by custkey % 5 are world rules
MONEY = "decimal(18,2)"


def _date(d) -> Column:
    return F.lit(str(d)).cast("date")


def _permalink(k: Column) -> Column:
    return F.concat(F.lit("c"), k.cast("string"))


def _competitor_of(k: Column, pos: Column, nn: Column) -> Column:
    """Competitor rule: some permalinks fall outside the index (nn + 10)."""
    return _permalink((k * 7 + pos * 13) % (nn + 10))


@dataclass
class World:
    spark: SparkSession
    sf_dir: str

    def _t(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # ---------------------------------------------------------------- index
    @cached_property
    def company(self) -> DataFrame:
        """p, k, n, i, s, cat1 (region), cat2 (segment), hq_city, hq_region."""
        cust = self._t("customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
        # names go round the whole part table (keys 0 to count - 1); part, nation
        # and region are dimension scans, broadcast from their Parquet size
        # statistics, and a larger input falls back to a shuffle join by itself.
        part = self._t("part").select("p_partkey", "p_name")
        cust = cust.withColumn("_name_key", F.col("c_custkey") % self.part_count())
        nation = self._t("nation").select("n_nationkey", "n_name", "n_regionkey")
        region = self._t("region").select("r_regionkey", "r_name")
        k = F.col("c_custkey")
        name = (F.when(k % 4 == 0, F.concat(F.col("p_name"), F.lit(", Inc.")))
                .when(k % 4 == 1, F.upper("p_name"))
                .when(k % 4 == 2, F.concat(F.col("p_name"), F.lit(" co!")))
                .otherwise(F.col("p_name")))
        return (cust
                .join(part, F.col("p_partkey") == F.col("_name_key"))
                .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
                .join(region, F.col("r_regionkey") == F.col("n_regionkey"))
                .select(_permalink(k).alias("p"), k.alias("k"), name.alias("n"),
                        F.when(k % 5 == 0, F.lit(None).cast("string"))
                        .otherwise(F.concat(F.lit("http://img.example/"), k.cast("string"))).alias("i"),
                        (F.floor((F.col("c_acctbal") + 1000) * 10 / 11) / 10000).alias("s"),
                        F.col("r_name").alias("cat1"), F.col("c_mktsegment").alias("cat2"),
                        F.col("n_name").alias("hq_city"), F.col("r_name").alias("hq_region")))

    @cached_property
    def company_category(self) -> DataFrame:
        """Long form of the index categories: p, k, ord, category, s."""
        return (self.company
                .select("p", "k", "s", F.posexplode(F.array("cat1", "cat2")).alias("ord", "category"))
                .select("p", "k", F.col("ord").cast("int").alias("ord"), "category", "s"))

    @cached_property
    def index(self) -> DataFrame:
        """The company index as the service holds it: p, n, i, s, c array."""
        return self.company.select("p", "n", "i", "s", F.array("cat1", "cat2").alias("c"))

    # ------------------------------------------------------------- documents
    @staticmethod
    def founded_on(k: Column) -> Column:
        """Founding date rule of company k (null for k % 17 = 0)."""
        founded = F.date_sub(_date(config.WORLD_AS_OF), ((k * 37) % 4000).cast("int"))
        return F.when(k % 17 == 0, F.lit(None).cast("date")).otherwise(founded)

    @cached_property
    def order_facts(self) -> DataFrame:
        """One row per order with every relationship rule applied:
        k, seq, announced_on / money (funding round), acquired (acquired_by
        item) with acquired_on, is_acquisition, price."""
        o = self._t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                                     "o_orderpriority", "o_totalprice")
        ok = F.col("o_orderkey")
        return o.select(
            F.col("o_custkey").alias("k"), ok.alias("seq"),
            F.when(ok % 11 == 0, F.lit(None).cast("date")).otherwise(F.col("o_orderdate").cast("date"))
            .alias("announced_on"),
            F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("double"))
            .when(ok % 7 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("money"),
            ((F.col("o_orderstatus") == "P") & (ok % 50 == 0)).alias("acquired"),
            F.col("o_orderdate").cast("date").alias("acquired_on"),
            (F.col("o_totalprice") > 490000).alias("is_acquisition"),
            F.col("o_totalprice").alias("price"))

    @cached_property
    def order_summary(self) -> DataFrame:
        """Per company, every order-derived reduction in ONE partial
        aggregate (one scan of orders, one shuffle of per-task partials):
        total funding, round counts and non-zero sums, acquired_by count and
        latest acquisition after founding, acquisitions count."""
        f = self.order_facts
        money = F.col("money")
        return f.groupBy("k").agg(
            F.sum(F.col("price").cast(MONEY)).cast("double").alias("tf"),
            F.count(F.lit(1)).alias("num_funding_rounds"),
            F.sum(F.when(money != 0, money.cast(MONEY))).alias("fpr_sum"),
            F.count_if(money != 0).alias("fpr_n"),
            F.count_if(F.col("acquired")).alias("n_acquired_by"),
            F.max(F.when(F.col("acquired") & (F.col("acquired_on") > World.founded_on(F.col("k"))),
                         F.col("acquired_on"))).alias("acquired_after"),
            F.count_if(F.col("is_acquisition")).alias("num_acquisitions"))

    @cached_property
    def org(self) -> DataFrame:
        """Organisation properties of profiled companies (k % 3 <> 0), with
        the per-company order summary attached."""
        cust = self._t("customer").select("c_custkey")
        k = F.col("c_custkey")
        founded = F.date_sub(_date(config.WORLD_AS_OF), ((k * 37) % 4000).cast("int"))
        return (cust.where(k % 3 != 0)
                .join(self.order_summary, F.col("k") == k, "left").drop("k")
                .select(k.alias("k"), _permalink(k).alias("p"),
                        World.founded_on(k).alias("founded_on"),
                        F.when((k % 19 == 0) & (k % 17 != 0), F.date_add(founded, 400))
                        .otherwise(F.lit(None).cast("date")).alias("closed_on"),
                        F.when(k % 13 == 0, F.lit(None).cast("double")).otherwise(F.col("tf")).alias("total_funding_usd"),
                        F.element_at(F.array(F.lit(1), F.lit(11), F.lit(51), F.lit(None), F.lit(25)),
                                     (k % 5 + 1).cast("int")).cast("int").alias("emp_min"),
                        F.element_at(F.array(F.lit(10), F.lit(50), F.lit(100), F.lit(None), F.lit(25)),
                                     (k % 5 + 1).cast("int")).cast("int").alias("emp_max"),
                        F.when(k % 6 == 0, F.lit(None)).otherwise(k % 4).cast("int").alias("number_of_investments"),
                        "num_funding_rounds", "fpr_sum", "fpr_n", "n_acquired_by", "acquired_after",
                        "num_acquisitions"))

    @cached_property
    def round(self) -> DataFrame:
        """Funding rounds: k, seq, announced_on, money."""
        return self.order_facts.select("k", "seq", "announced_on", "money")

    @cached_property
    def acquired(self) -> DataFrame:
        """acquired_by items: k, seq, announced_on."""
        return (self.order_facts.where(F.col("acquired"))
                .select("k", "seq", F.col("acquired_on").alias("announced_on")))

    @cached_property
    def acquisition(self) -> DataFrame:
        """acquisitions items: k, seq."""
        return self.order_facts.where(F.col("is_acquisition")).select("k", "seq")

    @cached_property
    def item_rows(self) -> DataFrame:
        """Line items with their rules applied, keyed by order (seq) only;
        kind 1 investors, 2 offices, 3 products, 4 investments."""
        li = self._t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
                                        "l_extendedprice", "l_returnflag")
        return li.select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("kind"),
                         "l_suppkey", "l_partkey", F.col("l_extendedprice").alias("money"),
                         F.when(F.col("l_returnflag") == "A", F.lit(config.INVESTOR_ORGANIZATION))
                         .when(F.col("l_returnflag") == "R", F.lit(config.INVESTOR_PERSON))
                         .otherwise(F.lit("Other")).alias("investor_type"))

    @cached_property
    def order_owner(self) -> DataFrame:
        """seq (order) -> k (company)."""
        return self._t("orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("k"))

    @cached_property
    def item(self) -> DataFrame:
        """Line items of a company's orders (long form with k)."""
        return self.item_rows.join(self.order_owner, "seq").select(
            "k", "seq", "kind", "l_suppkey", "l_partkey", "money", "investor_type")

    @cached_property
    def competitor(self) -> DataFrame:
        """competitors items: k, pos, competitor (some fall outside the index)."""
        cust = self._t("customer").select("c_custkey")
        k = F.col("c_custkey")
        return (cust.where(k % 9 >= 1)
                .select(k.alias("k"), F.explode(F.sequence(F.lit(1).cast("bigint"), k % 9)).alias("pos"))
                .select("k", F.col("pos").cast("int").alias("pos"),
                        _competitor_of(F.col("k"), F.col("pos"), self.customer_count()).alias("competitor")))

    def customer_count(self) -> Column:
        """Number of customers as a scalar subquery (no join)."""
        return self._t("customer").select(F.count(F.lit(1))).scalar()

    def part_count(self) -> Column:
        """Number of parts as a scalar subquery (no join)."""
        return self._t("part").select(F.count(F.lit(1))).scalar()

    @staticmethod
    def competitor_list(k: Column, nn: Column) -> Column:
        """The same competitors as an ordered array of one company's row
        (null when it has none) -- row-local, no grouping.  ``nn`` must be a
        plain column (subqueries are not allowed inside lambdas)."""
        return F.when(k % 9 >= 1, F.transform(F.sequence(F.lit(1).cast("bigint"), k % 9),
                                              lambda j: _competitor_of(k, j, nn)))

    # -------------------------------------------------------------- requests
    @cached_property
    def lists(self) -> DataFrame:
        """Related-request lists: every company is on one page of 10."""
        return self.company.select(
            (F.col("k") / config.WORLD_LIST_SIZE).cast("bigint").alias("list_id"),
            (F.col("k") % config.WORLD_LIST_SIZE).cast("int").alias("pos"), "p")

    @cached_property
    def queries(self) -> DataFrame:
        """Search queries: the fixed ones plus every distinct part name."""
        fixed = self.spark.createDataFrame(config.WORLD_QUERIES, "query_id bigint, q string")
        # id = offset + smallest partkey carrying the name: an aggregate, so
        # it needs no global ordering (no single-partition window).
        derived = (self._t("part").select("p_partkey", "p_name")
                   .groupBy(F.col("p_name").alias("q"))
                   .agg((F.lit(config.WORLD_DERIVED_QUERY_BASE) + F.min("p_partkey")).cast("bigint").alias("query_id")))
        return fixed.unionByName(derived)
