"""Matches of a pattern with their code-point offsets, as one array column and built-in functions only.

``split`` gives the text between the matches and ``regexp_extract_all`` the matches; the start of match k is the summed
length of what stands before it.  The running sums are taken in blocks of ``BLOCK`` entries, so that a text with very
many matches stays linear in practice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def _running(a: Column) -> Column:
    """Running sums of an array of ints."""
    return F.aggregate(a, F.array().cast("array<int>"), lambda acc, x: F.concat(
        acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x)))


def add_spans(df: DataFrame, text: str, found: dict[str, tuple[str, Column]], context: int = 0) -> DataFrame:
    """For each name, an array column of struct<start, end, hit, near> of all leftmost matches of its pattern.

    found: name -> (pattern, condition).  Texts that don't meet the condition have no match; it only has to hold
    wherever the pattern matches.  near: up to ``context`` characters before and after the match, lower-cased, without
    other matches of the same kind.
    """
    kept = df.columns
    text_col = F.col(text)
    none = F.array().cast("array<string>")
    df = df.withColumns({f"_h_{k}": F.when(need, F.regexp_extract_all(text_col, F.lit(p), F.lit(0))).otherwise(none)
                         for k, (p, need) in found.items()})
    df = df.withColumns({f"_g_{k}": F.when(F.size(f"_h_{k}") > 0, F.split(text_col, p, -1)).otherwise(none)
                         for k, (p, _) in found.items()})

    def sizes(k: str) -> Column:
        """Length of gap and match, for each match."""
        return F.transform(F.col(f"_h_{k}"), lambda h, i: F.length(F.get(F.col(f"_g_{k}"), i)) + F.length(h))

    def blocks(k: str) -> Column:
        n = F.size(f"_h_{k}")
        return F.when(n == 0, F.array().cast("array<array<int>>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")),
            lambda b: _running(F.slice(F.col(f"_s_{k}"), b * BLOCK + 1, F.lit(BLOCK)))))

    df = df.withColumns({f"_s_{k}": sizes(k) for k in found})
    df = df.withColumns({f"_b_{k}": blocks(k) for k in found})
    df = df.withColumns({f"_o_{k}": _running(F.transform(F.col(f"_b_{k}"), lambda b: F.get(b, F.size(b) - 1)))
                         for k in found})

    def span(k: str) -> Column:
        ends = F.flatten(F.transform(F.col(f"_b_{k}"), lambda b, i: F.transform(
            b, lambda v: v + F.coalesce(F.get(F.col(f"_o_{k}"), i - 1), F.lit(0)))))
        near = lambda i: F.lower(F.concat(
            F.substring(F.get(F.col(f"_g_{k}"), i), -context, context), F.lit(" "),
            F.substring(F.get(F.col(f"_g_{k}"), i + 1), 1, context))) if context else F.lit("")
        return F.transform(F.arrays_zip(ends.alias("end"), F.col(f"_h_{k}").alias("hit")), lambda x, i: F.struct(
            (x["end"] - F.length(x["hit"])).alias("start"), x["end"].alias("end"), x["hit"].alias("hit"),
            near(i).alias("near")))

    df = df.withColumns({f"_e_{k}": span(k) for k in found})
    return df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"_e_{k}").alias(k) for k in found])


def joined(spans: Column) -> Column:
    """kind:start:end of each of the (sorted) spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
