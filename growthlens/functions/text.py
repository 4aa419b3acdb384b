"""Search-text expressions: query keys, name tokens, keyword match score.

All are built-in higher-order functions, so they stay inside whole-stage
codegen and need no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_keys(q: Column) -> Column:
    """Lower-case the query and split on single spaces (empty keys kept)."""
    return F.split(F.lower(q), " ", -1)


def name_tokens(name: Column) -> Column:
    """Lower-case, turn runs of non-word characters into one space, split.

    Leading/trailing separators give empty edge tokens, as in the service.
    """
    return F.split(F.regexp_replace(F.lower(name), r"\W+", " "), " ", -1)


def keyword_score(name: Column, keys: Column) -> Column:
    """Score of a company name against query keys.

    For every (key i, token j): equal -> +10, then +3 if i == j else -1;
    token contains key -> +3, then +2 if i == j; otherwise -1.
    Finally minus |#tokens - #keys|.
    """
    tokens = name_tokens(name)

    def pair(k: Column, i: Column, b: Column, j: Column) -> Column:
        same = i == j
        return (F.when(b == k, F.lit(10) + F.when(same, 3).otherwise(-1))
                .when(b.contains(k), F.lit(3) + F.when(same, 2).otherwise(0))
                .otherwise(-1))

    per_key = F.transform(
        keys,
        lambda k, i: F.aggregate(
            F.transform(tokens, lambda b, j: pair(k, i, b, j)),
            F.lit(0), lambda acc, x: acc + x))
    total = F.aggregate(per_key, F.lit(0), lambda acc, x: acc + x)
    return (total - F.abs(F.size(tokens) - F.size(keys))).cast("bigint")


def has_matching_key(name: Column, keys: Column, min_len: int) -> Column:
    """Some key of at least ``min_len`` chars is a substring of lower(name)."""
    low = F.lower(name)
    return F.exists(keys, lambda k: (F.length(k) >= min_len) & low.contains(k))
