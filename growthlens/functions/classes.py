"""Profile classification predicates (P1, P2, R2, R3) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

D = config.RATE_STD_DIVIDER


def acquired_or_acquirer(is_acquired: Column, num_acquisitions: Column) -> Column:
    return F.coalesce(is_acquired, F.lit(False)) | (F.coalesce(num_acquisitions, F.lit(0)) > 0)


def is_allstar(is_acquired, num_acquisitions, success_all) -> Column:
    """Acquired or acquirer, and success >= 0.85."""
    return acquired_or_acquirer(is_acquired, num_acquisitions) & (success_all >= config.ALLSTAR_MIN_SUCCESS)


def is_hot(is_acquired, num_acquisitions, age, success_all, rate) -> Column:
    """Neither acquired nor acquirer and momentum by age/score/rate.

    A missing age counts as 0; a missing rate makes every rate test false."""
    a = F.coalesce(age, F.lit(0))
    x = success_all
    young = a < config.HOT_AGE_MONTHS
    cond = ((young & (x < 0.15) & (rate >= D))
            | (young & (x >= 0.15) & (rate >= -D))
            | (~young & (x >= 0.15) & (x < 0.5) & (rate >= D))
            | (~young & (x >= 0.5) & (rate >= -D)))
    return ~acquired_or_acquirer(is_acquired, num_acquisitions) & F.coalesce(cond, F.lit(False))


def success_class(is_acquired, num_acquisitions, age, success_all, rate) -> Column:
    """R2: struct<s string, c string> -- class and optional sub-class."""
    x = success_all

    def cls(s, c=None):
        return F.struct(F.lit(s).alias("s"), F.lit(c).cast("string").alias("c"))

    acq = None
    for bound, name in config.ACQUIRED_CLASS_BANDS:
        if bound is None:
            acq = acq.otherwise(cls(name))
        else:
            acq = F.when(x < bound, cls(name)) if acq is None else acq.when(x < bound, cls(name))

    low = rate < -D                       # band L
    mid = (rate >= -D) & (rate < D)       # band M (a null rate falls in H)

    def bands(l_, m_, h_):
        return F.when(F.coalesce(low, F.lit(False)), l_).when(F.coalesce(mid, F.lit(False)), m_).otherwise(h_)

    young = F.coalesce(age, F.lit(0)) < config.HOT_AGE_MONTHS
    other = (F.when(young & (x < 0.15), bands(cls("ok", "incubated"), cls("rising"), cls("hot")))
             .when(young, bands(cls("rising", "needs-funding"), cls("hot"), cls("very-hot")))
             .when(x < 0.15, bands(cls("ok"), cls("ok"), cls("rising")))
             .when(x < 0.5, bands(cls("ok"), cls("rising"), cls("hot")))
             .otherwise(bands(cls("rising"), cls("hot"), cls("very-hot"))))
    return F.when(acquired_or_acquirer(is_acquired, num_acquisitions), acq).otherwise(other)


def profile_tag(is_acquired, num_acquisitions, klass: Column) -> Column:
    """Acquired; else the class when no acquisitions; else the
    sub-class; hyphens shown as spaces."""
    return (F.when(F.coalesce(is_acquired, F.lit(False)), F.lit(config.ACQUIRED_TAG))
            .when(num_acquisitions == 0, F.replace(klass.getField("s"), F.lit("-"), F.lit(" ")))
            .when(klass.getField("c").isNotNull(), F.replace(klass.getField("c"), F.lit("-"), F.lit(" "))))
