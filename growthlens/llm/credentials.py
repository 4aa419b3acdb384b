"""Secrets: patterns propose, corpus-wide ownership separates examples from live-looking credentials (operator 9).

Every kind has a pattern; its leftmost non-overlapping matches, less those too short, are the candidates.  The value of
a candidate is hashed, and over the whole corpus each hash is counted by distinct repositories (documents) and distinct
owners (sources).  A value that ``EXAMPLE_OWNERS`` or more owners hold is a copied example; one that a single owner
holds is live-looking; what lies between is shared.

The counts are taken in two steps, first by (hash, owner, repository), then by (hash, owner), then by hash, each combined
on the map side, so a value that a third of the documents copy is no hot key; only hashes and numbers are shuffled,
never texts.

Defined cases: a null text counts as empty; a null source is an owner of its own; repeated rows are repositories of
their own; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, text_of
from .spans import add_spans, joined

BASE = ("assign", "access", "hex")
ADDED = ("github", "slack", "jwt", "pem")
EXAMPLE_OWNERS = 3
_TOKEN = "[A-Za-z0-9_-]"
PATTERN = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}+",  # a run is taken whole, so shorter runs need no match of their own
    "github": r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}+",
    "slack": r"(?<![A-Za-z0-9])xox[baprs]-[A-Za-z0-9-]{10,}+",
    "jwt": rf"(?<!{_TOKEN})eyJ{_TOKEN}{{8,}}+\.eyJ{_TOKEN}{{8,}}+\.{_TOKEN}{{8,}}+",
    "pem": r"-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----",
}
_LEAST = {"assign": 6, "access": 20}


def _value(kind: str, hit: Column) -> Column:
    return F.regexp_extract(hit, PATTERN["assign"], 1) if kind == "assign" else hit


def find_candidates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, owner and ``spans``, an array of struct<start, kind_no, end, kind, value>
    sorted by start and kind; value is the SHA-256 of the secret.  Row-local, no shuffle."""
    df = docs.select(docs["doc_id"], docs["source"].cast("string").alias("owner"), text_of(docs).alias("text"))
    text = F.col("text")
    need = {
        "assign": text.rlike("(?i)(?:password|passwd|secret|token|key)[\"']?\\x20*[:=]"),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike(PATTERN["hex"]),
        "github": F.contains(text, F.lit("gh")) & F.contains(text, F.lit("_")),
        "slack": F.contains(text, F.lit("xox")),
        "jwt": F.contains(text, F.lit("eyJ")),
        "pem": F.contains(text, F.lit("PRIVATE KEY-----")),
    }
    df = add_spans(df, "text", {k: (PATTERN[k], need[k]) for k in PATTERN})

    def spans(no: int, kind: str) -> Column:
        found = F.transform(F.col(kind), lambda s: F.struct(
            s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            _value(kind, s["hit"]).alias("value")))
        found = F.filter(found, lambda s: F.length(s["value"]) >= _LEAST.get(kind, 0))
        return F.transform(found, lambda s: F.struct(
            s["start"], s["kind_no"], s["end"], s["kind"], F.sha2(s["value"], 256).alias("value")))

    found = F.concat(*[spans(no, kind) for no, kind in enumerate(BASE + ADDED)])
    return df.select("doc_id", "owner", F.array_sort(found).alias("spans"))


def ownership(candidates: DataFrame) -> DataFrame:
    """value -> repositories, owners and class, from rows (rid, owner, value)."""
    per_owner = candidates.distinct().groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    per_value = per_owner.groupBy("value").agg(F.sum("repositories").alias("repositories"),
                                               F.count(F.lit(1)).alias("owners"))
    return per_value.withColumn("class", F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").when(
        F.col("owners") == 1, "live").otherwise("shared"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``find_candidates`` with, for each row, ``found``: a sorted array of struct<pos, class, owners, repositories>."""
    rows = numbered(find_candidates(docs), "op9-rows")
    each = rows.select("rid", "owner", F.posexplode("spans").alias("pos", "span")).select(
        "rid", "owner", "pos", F.col("span.value").alias("value"))
    known = ownership(each.select("rid", "owner", "value"))
    classes = each.join(known, "value").groupBy("rid").agg(F.array_sort(F.collect_list(
        F.struct("pos", "class", "owners", "repositories"))).alias("found"))
    return rows.join(classes, "rid", "left").withColumn("found", F.coalesce("found", F.expr(
        "cast(array() as array<struct<pos:int,class:string,owners:bigint,repositories:bigint>>)")))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans as text, and counts by class."""
    base = F.filter(F.col("spans"), lambda s: s["kind_no"] < len(BASE))
    count = lambda kind: F.size(F.filter(F.col("spans"), lambda s: s["kind"] == kind)).cast("bigint")
    classed = lambda c: F.size(F.filter(F.col("found"), lambda x: x["class"] == c)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), classed("live").alias("n_live"), classed("shared").alias("n_shared"),
        classed("example").alias("n_example"))
