"""Company search.

Matching is a theta join (name contains a key).  Instead of a nested loop,
every key of >= 3 characters is blocked on its *rarest* trigram: company
names are exploded into distinct trigrams, trigram frequencies come from a
partial aggregate, each key picks the least frequent of its trigrams, and
the equi-join on that trigram yields candidates that are then verified with
``contains``.  A key of >= 3 chars always contains that trigram, so no match
is lost; picking the rarest keeps hot trigrams ("inc") out of the join.

The trigram frequencies bound the candidates before they exist, so companies
are spread over as many tasks as their candidates need and each task groups
its own companies' matches: what a task holds does not grow with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as TX
from ..session import materialize
from .ranking import positions

# the plain filter compares every company with every query: only for queries of this many bytes together
MAX_LOOP_BYTES = 64 * 1024
LOOP_ROW_BYTES = 32
# candidates that one task tells apart in memory, and bytes of keys (text and row) that every task may hold beside them
CANDIDATES_PER_TASK = 256 * 1024
MAX_BLOCK_BYTES = 16 * 1024 * 1024
BLOCK_ROW_BYTES = 64


def sent_query(q):
    """The search box trims surrounding whitespace before checking and
    sending the query."""
    return F.regexp_replace(q, r"^\s+|\s+$", "")


def accepted_queries(queries: DataFrame, min_len: int = config.SEARCH_MIN_QUERY_LEN) -> DataFrame:
    """Queries that pass the guard, as sent (trimmed)."""
    sent = queries.select("query_id", sent_query(F.col("q")).alias("q"))
    return sent.where(F.length("q") >= min_len)


def search_rejects(queries: DataFrame, min_len: int = config.SEARCH_MIN_QUERY_LEN) -> DataFrame:
    """Queries refused before searching, with the reason."""
    sent = sent_query(F.col("q"))
    return (queries.where(F.length(sent) < min_len)
            .select("query_id", "q", F.when(F.length(sent) == 0, F.lit("empty"))
                    .otherwise(F.lit("too_short")).alias("reason")))


def search_keys(queries: DataFrame) -> DataFrame:
    """K1 long form: query_id, pos, key."""
    return (queries.select("query_id", F.posexplode(TX.query_keys(F.col("q"))).alias("pos", "key"))
            .select("query_id", F.col("pos").cast("int").alias("pos"), "key"))


def name_tokens(index: DataFrame) -> DataFrame:
    """K2 long form: p, pos, token."""
    return (index.select("p", F.posexplode(TX.name_tokens(F.col("n"))).alias("pos", "token"))
            .select("p", F.col("pos").cast("int").alias("pos"), "token"))


def trigrams(text):
    """Distinct runs of three characters (none of a shorter text)."""
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2),
                                                      lambda i: text.substr(i, F.lit(3))))) \
        .otherwise(F.array().cast("array<string>"))


def key_blocks(queries: DataFrame, freq: DataFrame, min_key: int = config.SEARCH_MIN_KEY_LEN) -> DataFrame:
    """query_id, kpos, key, tri, freq: each key with the rarest of its trigrams by ``freq`` (tri, freq), written once.

    A key with a trigram that no company holds matches nothing and has no row."""
    keys = (search_keys(queries).where(F.length("key") >= min_key)
            .select("query_id", F.col("pos").alias("kpos"), "key",
                    F.explode(trigrams(F.col("key"))).alias("tri")))
    held = F.coalesce(F.col("freq"), F.lit(0))
    return materialize(keys.join(freq.select("tri", "freq"), "tri", "left")
                       .groupBy("query_id", "kpos", "key")
                       .agg(F.min_by("tri", F.struct(held, F.col("tri"))).alias("tri"), F.min(held).alias("freq"))
                       .where(F.col("freq") > 0), "search-block")


def confirmed_matches(rows: DataFrame, tri, block: DataFrame, per_task: int = CANDIDATES_PER_TASK,
                      max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """(query_id, p, kpos) of the ``rows`` (p, ln) whose trigrams, the column ``tri``, meet ``block`` and whose name
    holds the key.

    The sum of the frequencies is the number of candidates, and sets the number of tasks. Up to ``max_block_bytes`` of
    keys, rows are dealt out by company before they meet their keys, so that matches are grouped where they arise and
    never shuffled; beyond it the trigrams are joined by a shuffle and the matches dealt out."""
    load = block.agg(F.sum("freq").alias("n"), F.sum(F.octet_length("key") + F.lit(BLOCK_ROW_BYTES)).alias("bytes")).first()
    tasks = max(block.sparkSession.sparkContext.defaultParallelism, -(-(load.n or 0) // per_task))
    small = (load.bytes or 0) <= max_block_bytes
    rows = rows.repartition(tasks, "p") if small else rows
    keys = block.drop("freq")
    cand = (rows.select("p", "ln", tri.alias("tri")).join(F.broadcast(keys) if small else keys, "tri")
            .where(F.col("ln").contains(F.col("key"))).select("query_id", "p", "kpos"))
    cand = cand if small else cand.repartition(tasks, "query_id", "p")
    return cand.groupBy("query_id", "p").agg(F.min("kpos").cast("int").alias("kpos"))


def search_matches(index: DataFrame, queries: DataFrame, min_key: int = config.SEARCH_MIN_KEY_LEN,
                   per_task: int = CANDIDATES_PER_TASK, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """(query_id, p, kpos) -- kpos = first key that matched."""
    names = materialize(index.select("p", F.lower("n").alias("ln")), "names")
    tri = F.explode(trigrams(F.col("ln")))
    freq = names.select(tri.alias("tri")).groupBy("tri").agg(F.count(F.lit(1)).alias("freq"))
    return confirmed_matches(names, tri, key_blocks(queries, freq, min_key), per_task, max_block_bytes)


def search_filter(index: DataFrame, queries: DataFrame, min_key: int = config.SEARCH_MIN_KEY_LEN,
                  max_loop_bytes: int = MAX_LOOP_BYTES) -> DataFrame:
    """(query_id, p) of every company that the plain filter keeps.

    The queries are written once and measured.  Up to ``max_loop_bytes`` of
    text they are broadcast and the predicate is evaluated beside each index
    row, which then meets no shuffle; beyond it the blocked join answers,
    whose work does not grow with companies times queries."""
    asked = materialize(queries.select("query_id", "q", TX.query_keys(F.col("q")).alias("keys")), "queries")
    size = asked.agg(F.sum(F.coalesce(F.octet_length("q"), F.lit(0)) + F.lit(LOOP_ROW_BYTES))).first()[0] or 0
    if size > max_loop_bytes:
        return search_matches(index, asked.select("query_id", "q"), min_key).select("query_id", "p")
    return (index.join(F.broadcast(asked), TX.has_matching_key(F.col("n"), F.col("keys"), min_key))
            .select("query_id", "p"))


def scored_matches(index: DataFrame, queries: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """K3: accepted matches with their keyword score, in no order; ``matches`` may come from a maintained index."""
    acc = accepted_queries(queries)
    m = search_matches(index, acc) if matches is None else matches
    q = acc.select("query_id", TX.query_keys(F.col("q")).alias("keys"))
    return (m.join(index.select("p", "n", "i", "s"), "p").join(q, "query_id")
            .select("query_id", "p", "n", "i", "s",
                    TX.keyword_score(F.col("n"), F.col("keys")).alias("kscore")))


def search(index: DataFrame, queries: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Matches ordered by keyword score + 10 * s (desc), permalink asc."""
    rows = scored_matches(index, queries, matches)
    rows = materialize(rows.withColumn("score", F.col("kscore") + F.lit(10) * F.col("s")), "matches")
    return positions(rows, ["query_id"], [F.col("score").desc(), F.col("p").asc()], "pos")


def page_of(pos):
    """1-based page of a 1-based position."""
    return F.ceil(pos / F.lit(config.PAGE_SIZE)).cast("bigint")


def page_counts(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Results and pages per accepted query (0 results -> 0 pages)."""
    n = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    return (accepted_queries(queries).select("query_id").join(n, "query_id", "left")
            .select("query_id", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("n_results"),
                    page_of(F.coalesce(F.col("_n"), F.lit(0))).alias("n_pages")))
