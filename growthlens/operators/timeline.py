"""Funding timeline (A4, A5, T11, R7-R10): yearly sums of the rounds, the
chart scale and the axis domains.

The rounds are read once: one aggregate per (company, year), partially
combined before its shuffle, carries the year's sum and earliest date, and
everything else is one further aggregate per company over those few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_of_col

MONEY = "decimal(18,2)"


def _yearly(rounds: DataFrame) -> DataFrame:
    """p, year, amount (sum of the year's rounds), first (its earliest date)."""
    return (rounds.groupBy("p", F.year("d").cast("bigint").alias("year"))
            .agg(F.sum(F.col("a").cast(MONEY)).cast("double").alias("amount"), F.min("d").alias("first")))


def funding_by_year(rounds: DataFrame) -> DataFrame:
    """A4: p, year, amount (sum of the year's rounds)."""
    return _yearly(rounds).select("p", "year", "amount")


def min_pow10(x):
    """floor(log10 x) for x >= 1, else 0 -- counted on the integer part
    so exact powers of ten cannot be off by one."""
    return F.when(x >= 1, F.length(F.floor(x).cast("bigint").cast("string")) - 1).otherwise(0).cast("int")


def _bounds(rounds: DataFrame, founded: DataFrame, *more) -> DataFrame:
    """Per company with rounds: extremes of its yearly rows, its earliest
    date, and the further aggregates ``more`` of the yearly rows."""
    names = ["p", "min_amount", "max_amount", "min_year", "max_year"]
    agg = _yearly(rounds).groupBy("p").agg(
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"),
        F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.min("first").alias("_first_round"), *more)
    out = agg.join(founded.select("p", "founded_on"), "p", "left").withColumn(
        "min_date", F.least(F.col("founded_on"), F.col("_first_round")))
    return out.select(*names, "min_date", *[c for c in agg.columns if c not in (*names, "_first_round")])


def funding_bounds(rounds: DataFrame, founded: DataFrame) -> DataFrame:
    """A5: smallest yearly amount, earliest date (founding or round) and the
    last year with rounds, per company with rounds."""
    return _bounds(rounds, founded)


def _with_scale(bounds: DataFrame) -> DataFrame:
    return (bounds.withColumn("pow", min_pow10(F.col("min_amount")))
            .withColumn("scale", F.pow(F.lit(10.0), F.col("pow") - 2)))


def funding_scale(bounds: DataFrame) -> DataFrame:
    """P, pow, scale = 10^(pow-2)."""
    return _with_scale(bounds).select("p", "pow", "scale")


def funding_timeline(rounds: DataFrame, founded: DataFrame) -> DataFrame:
    """Chart points (p, pos, d, a), pos from 0 by date; a founding
    point (date, 0) leads when it is earlier than the first year's Jan 1.

    A company's points are gathered in one row: at most one a calendar year
    and the founding point."""
    years = F.array_sort(F.collect_list(F.struct("year", "amount"))).alias("years")
    b = _with_scale(_bounds(rounds, founded, years))
    jan_1 = lambda y: F.make_date(y, F.lit(1), F.lit(1))
    points = F.transform("years", lambda y: F.struct(jan_1(y["year"]).alias("d"),
                                                     (y["amount"] / F.col("scale")).alias("a")))
    lead = F.array(F.struct(F.col("min_date").alias("d"), F.lit(0.0).alias("a")))
    series = F.when(F.col("min_date") < jan_1(F.col("min_year")), F.concat(lead, points)).otherwise(points)
    return b.select("p", F.posexplode(series).alias("pos", "pt")).select("p", "pos", "pt.d", "pt.a")


def funding_domain(rounds: DataFrame, founded: DataFrame, as_of=None) -> DataFrame:
    """x = [Jan 1 of first year - 1, min(Jan 1 of last year + 4, as_of)],
    y = [min amount / scale (0 with a founding point), max point]."""
    b = _with_scale(funding_bounds(rounds, founded))
    first_jan = F.make_date(F.col("min_year"), F.lit(1), F.lit(1))
    has_lead = F.col("min_date") < first_jan
    start = F.when(has_lead, F.col("min_date")).otherwise(first_jan)
    return b.select(
        "p",
        F.make_date(F.year(start) - 1, F.lit(1), F.lit(1)).alias("x_from"),
        F.least(F.make_date(F.col("max_year") + 4, F.lit(1), F.lit(1)), as_of_col(as_of)).alias("x_to"),
        F.when(has_lead, F.lit(0.0)).otherwise(F.col("min_amount") / F.col("scale")).alias("y_from"),
        (F.col("max_amount") / F.col("scale")).alias("y_to"))
