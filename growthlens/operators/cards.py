"""Profile card projections (P5, R2-R6, K4-K10): one row per profile with
the values a profile page shows; absent attributes stay null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import classes as CL
from ..functions import display as DS
from ..functions.numeric import truthy_number


def success_classes(profiles: DataFrame) -> DataFrame:
    """R2 + R3: p, class, subclass, tag."""
    k = CL.success_class(F.col("is_acquired"), F.col("num_acquisitions"), F.col("age"),
                         F.col("success_all"), F.col("rate"))
    return (profiles.select("p", "is_acquired", "num_acquisitions", k.alias("_k"))
            .select("p", F.col("_k.s").alias("class"), F.col("_k.c").alias("subclass"),
                    CL.profile_tag(F.col("is_acquired"), F.col("num_acquisitions"), F.col("_k")).alias("tag")))


def profile_card(profiles: DataFrame) -> DataFrame:
    """Displayed attributes of every profile."""
    tf = F.col("total_funding")
    no_funding = ~truthy_number(tf)
    inv = F.col("total_funding_investments")
    money_label = F.when(no_funding & (inv == 0), F.lit("Total funding")) \
        .when(no_funding, F.lit("Total investments")).otherwise(F.lit("Total funding"))
    money_value = F.when(no_funding & (inv == 0), F.lit(None).cast("string")) \
        .when(no_funding, DS.money_short(inv)).otherwise(DS.money_short(tf))
    return profiles.select(
        "p",
        DS.website_host(F.col("homepage_url")).alias("website"),
        F.when(F.col("founded_on").isNotNull(), F.year("founded_on").cast("string")).alias("founded_year"),
        F.when(truthy_number(F.col("age")), F.col("age")).alias("exit_age"),
        F.when(F.col("loc_city").isNotNull() | F.col("loc_region").isNotNull(),
               F.concat_ws(", ", F.coalesce(F.col("loc_city"), F.lit("")),
                           F.coalesce(F.col("loc_region"), F.lit("")))).alias("location"),
        DS.employees_display(F.col("num_employees")).alias("employees"),
        DS.display_score(F.col("success_all")).alias("score_display"),
        money_label.alias("money_label"),
        money_value.alias("money"),
        DS.money_short(DS.monthly_rate(tf, F.col("age")).cast("double")).alias("monthly_rate"),
    )


# attribute labels shown on a profile, in display order
ATTRIBUTE_LABELS = ["Website", "Founded", "Exit age (months)", "Location"]


def profile_attributes(profiles: DataFrame) -> DataFrame:
    """P5: (p, pos, label, value) for the attributes a profile has, in
    display order; absent ones are filtered out of the array row-locally."""
    card = profile_card(profiles)
    values = [F.col("website"), F.col("founded_year"), F.col("exit_age").cast("string"), F.col("location")]
    attrs = F.array(*[F.struct(F.lit(lbl).alias("label"), v.alias("value"))
                      for lbl, v in zip(ATTRIBUTE_LABELS, values)])
    present = F.filter(attrs, lambda a: a["value"].isNotNull())
    return (card.select("p", F.posexplode(present).alias("pos", "a"))
            .select("p", F.col("pos").cast("int").alias("pos"), F.col("a.label").alias("label"),
                    F.col("a.value").alias("value")))
