"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 10).

Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share ``share`` times all words; a source's target
stops at ``max_epochs`` times its size and the excess goes to the others by weight (water filling).  A source gives
whole epochs of all its documents first.  What its target asks beyond them is filled by sampling: document keys
-ln(u) / w, with u a hash of the document id and w its quality weight, in ascending order, while the words before a
document plus half of its own stay within the budget; so the words taken end within half a document of the target.

No source is sorted in one task: the keys are mapped monotonically to ``BINS`` bins, the words of each (source, bin) are
summed (combined on the map side), running sums over at most ``BINS`` rows a source find the one bin where the budget
ends, and only the documents of that bin are ordered.  While that bin holds more than ``ORDERED`` documents (low quality
weights, repeated ids), it is binned again between its own least and largest key, then size, then text hash.  The text
itself is not shuffled.

Defined cases: a null text has size 0; documents of size 0 are taken zero times; equal keys (repeated rows) are ordered
by size and text hash, so reruns agree; sources without words have target 0; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import numbered, take_rows, text_of

SHARE = 1.5
MAX_EPOCHS = 2
WEIGHTS = (3, 1, 2)
BINS = 1 << 16
ORDERED = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"


def quality(text: Column, size: Column) -> Column:
    """1 for prose with words of usual length, less the further the mean length of a word is from 6 characters."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.lit(1.0) / (F.lit(1.0) + F.abs(mean - 6.0) / 6.0)


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from the id, 52 bits of its MD5."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, share: float = SHARE) -> DataFrame:
    """(source, source_size) -> source, source_size, target.  One row a source: the windows stay small."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    s = s.withColumn("total", F.sum("source_size").over(everything) * share)
    fullest = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                     / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # in the order of cap / weight the sources below the level stop at their cap; the first that doesn't sets the level
    s = s.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("final", F.min(F.when(F.col("free"), F.struct(
        (F.col("cap") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, share: float = SHARE, seed: int = 7, weight: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_sha256, size, source, source_size, target, taken."""
    text = F.col("text")
    df = docs.select(docs["doc_id"], docs["source"].cast("string").alias("source"), text_of(docs).alias("text"))
    df = df.withColumn("size", F.regexp_count(text, F.lit(WORD)).cast("bigint"))
    w = quality(text, F.col("size")) if weight is None else weight
    df = df.select("doc_id", F.sha2(text, 256).alias("text_sha256"), "source", "size",
                   (-F.log(uniform(F.col("doc_id"), seed)) / F.greatest(w, F.lit(1e-6))).alias("key"))
    # 1 - exp(-key) rises with the key and stays below 1
    df = df.withColumn("bin", F.least(F.lit(BINS - 1), F.floor((1 - F.exp(-F.col("key"))) * BINS)).cast("int"))
    rows = numbered(df, "op10-rows")

    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(
        F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("bigint"))
    plan = plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))

    named = plan.withColumnRenamed("source", "plan_source")
    todo = rows.withColumn("hash", F.conv(F.substring("text_sha256", 1, 13), 16, 10).cast("bigint")).join(
        named, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source").withColumn("before", F.lit(0).cast("bigint"))
    parts = []
    while todo is not None:
        cuts = materialize(_cuts(todo), "op10-cuts")
        whole = todo.drop("before").join(cuts, F.col("source").eqNullSafe(F.col("cut_source")))
        parts.append(whole.where("bin <> cut_bin").withColumn("more", F.col("bin") < F.col("cut_bin")))
        inside = whole.where("bin = cut_bin").withColumnRenamed("cut_before", "before")
        parts.append(_ordered(inside.where(F.col("members") <= ORDERED)))
        todo = None
        if cuts.where(F.col("members") > ORDERED).limit(1).count():
            wide = inside.where(F.col("members") > ORDERED).drop("cut_source", "cut_bin", "members")
            todo = _narrower(materialize(wide, "op10-wide"))
    out = [p.select("doc_id", "text_sha256", "size", "source", "source_size", "target",
                    ((F.col("epochs") + F.col("more").cast("bigint")) * F.col("size")).alias("taken")) for p in parts]
    both = out[0]
    for p in out[1:]:
        both = both.unionByName(p)
    return both


def _cuts(rows: DataFrame) -> DataFrame:
    """cut_source, cut_bin, cut_before, members: the bin of each source in which the budget ends (``BINS``: none), the
    words before it and its number of documents."""
    per_bin = rows.groupBy("source", "budget", "before", "bin").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("members"))
    upto = Window.partitionBy("source").orderBy("bin")
    ends = per_bin.withColumn("end", F.col("before") + F.sum("words").over(upto))
    cut = F.min(F.when(F.col("end") > F.col("budget"), F.struct(
        "bin", (F.col("end") - F.col("words")).alias("before"), "members"))).alias("cut")
    return ends.groupBy(F.col("source").alias("cut_source")).agg(cut).select(
        "cut_source", F.coalesce("cut.bin", F.lit(BINS)).alias("cut_bin"),
        F.coalesce("cut.before", F.lit(0)).alias("cut_before"), F.coalesce("cut.members", F.lit(0)).alias("members"))


_ORDER = ["key", "size", "hash", "rid"]


def _ordered(inside: DataFrame) -> DataFrame:
    """Documents of the bins in which the budgets end, with ``more``."""
    in_order = Window.partitionBy("source").orderBy(*_ORDER)
    words = F.coalesce(F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return inside.withColumn("more", F.col("before") + words + F.col("size") / 2 <= F.col("budget"))


def _narrower(rows: DataFrame) -> DataFrame:
    """``rows`` with bins between the ends of the first column of the order that differs within the source."""
    ends = rows.groupBy(F.col("source").alias("end_source")).agg(
        *[f(c).alias(f"{c}_{n}") for c in _ORDER for n, f in (("lo", F.min), ("hi", F.max))])
    ends = materialize(ends, "op10-ends")
    place = F.coalesce(*[F.when(F.col(f"{c}_lo") < F.col(f"{c}_hi"), (F.col(c) - F.col(f"{c}_lo")).cast("double")
                                / (F.col(f"{c}_hi") - F.col(f"{c}_lo"))) for c in _ORDER])
    binned = rows.drop("bin").join(ends, F.col("source").eqNullSafe(F.col("end_source")))
    binned = binned.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(place * BINS)).cast("int"))
    return binned.drop("end_source", *[f"{c}_{n}" for c in _ORDER for n in ("lo", "hi")])


def mixed_documents(docs: DataFrame, share: float = SHARE, seed: int = 7) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, all columns unchanged."""
    taken = mix(docs, share, seed).where("taken > 0").select(
        "doc_id", "text_sha256", F.expr("taken div size").alias("copies"))
    return take_rows(docs, taken, "copies")
