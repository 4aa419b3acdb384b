"""Display formatting (K5-K10, R4-R6) as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from .numeric import half_up, half_up_long, truthy_number


def with_commas(text: Column) -> Column:
    """Thousands separators on an integer given as text; other text as is."""
    n = F.try_cast(text, "bigint") if hasattr(F, "try_cast") else text.try_cast("bigint")
    return F.when(n.isNotNull(), F.format_number(n, 0)).otherwise(text)


def employees_display(num_employees: Column) -> Column:
    """K6: "min - max" with separators, or the single number."""
    parts = F.split(num_employees, "-", -1)
    two = F.size(parts) > 1
    return F.when(num_employees.isNull() | (num_employees == ""), F.lit(None).cast("string")).otherwise(
        F.when(two, F.concat(with_commas(F.get(parts, 0)), F.lit(" - "), with_commas(F.get(parts, 1))))
        .otherwise(with_commas(F.get(parts, 0))))


def money_short(x: Column) -> Column:
    """K10: "$ 1.23m" style -- 2 decimals, k/m/b/t suffix, negatives in
    parentheses."""
    a = F.abs(x)
    scaled, suffix = a, F.lit("")
    for thr, suf in config.MONEY_SUFFIXES:
        scaled = F.when(a >= thr, a / F.lit(thr)).otherwise(scaled)
        suffix = F.when(a >= thr, F.lit(suf)).otherwise(suffix)
    body = F.concat(F.lit("$ "), F.format_string("%.2f", half_up(scaled, 2)), suffix)
    return F.when(x.isNull(), F.lit(None).cast("string")).when(x < 0, F.concat(F.lit("("), body, F.lit(")"))) \
        .otherwise(body)


def display_score(success_all: Column) -> Column:
    """round(success * 2250); 0 shows as n/a (null)."""
    v = half_up_long(success_all * config.DISPLAY_SCORE_FACTOR)
    return F.when(v != 0, v)


def website_host(url: Column) -> Column:
    """K7: lower-cased host name of the homepage."""
    return F.when(F.coalesce(url, F.lit("")) != "", F.lower(F.try_parse_url(url, F.lit("HOST"))))


def monthly_rate(total_funding: Column, age: Column) -> Column:
    """round(total_funding / (age - 6)) when both are truthy; the
    divisor is not clamped, so age 6 gives null."""
    ok = truthy_number(total_funding) & truthy_number(age)
    return F.when(ok, half_up_long(F.try_divide(total_funding, (age - config.AGE_OFFSET_MONTHS).cast("double"))))
