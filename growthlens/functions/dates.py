"""Calendar helpers."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_col(as_of: _dt.date | str | None) -> Column:
    """The evaluation date: a parameter instead of the wall clock."""
    if as_of is None:
        return F.current_date()
    return F.lit(str(as_of)).cast("date")


def _forward_months(frm: Column, to: Column) -> Column:
    return (F.lit(12) * (F.year(to) - F.year(frm)) + (F.month(to) - F.month(frm))
            - F.when(F.dayofmonth(to) < F.dayofmonth(frm), 1).otherwise(0))


def whole_months(frm: Column, to: Column) -> Column:
    """Complete calendar months from ``frm`` to ``to``, truncated toward zero.

    Not ``months_between``: that treats month ends specially
    (Jan 31 -> Feb 28 would be a full month).
    """
    return (F.when(to >= frm, _forward_months(frm, to))
            .otherwise(-_forward_months(to, frm))).cast("bigint")
