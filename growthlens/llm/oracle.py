"""DuckDB texts of the registered queries that SQL can express."""

from __future__ import annotations

from . import compression, licenses, spelling

OP1 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op11() -> str:
    """Every distance of a round in one join; codebooks as tables (p, entry, pos, x)."""
    def assigned(r: int) -> str:
        return f"""
near{r} AS MATERIALIZED (
  SELECT rid, p, arg_min(entry, dist * {compression.ENTRIES} + entry) AS entry, min(dist) AS dist
  FROM (SELECT c.rid, c.p, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS dist
        FROM comps c JOIN book{r} b ON c.p = b.p AND c.pos = b.pos GROUP BY c.rid, c.p, b.entry)
  GROUP BY rid, p)"""

    def updated(r: int) -> str:
        return f"""
book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (
    SELECT c.p, a.entry, c.pos, floor(sum(c.x) / count(*))::BIGINT AS x
    FROM comps c JOIN near{r} a ON c.rid = a.rid AND c.p = a.p GROUP BY c.p, a.entry, c.pos) m
  ON b.p = m.p AND b.entry = m.entry AND b.pos = m.pos)"""

    last = compression.ROUNDS
    rounds = ",".join(f"{assigned(r)},{updated(r)}" for r in range(last))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comps AS MATERIALIZED (
  SELECT rid, (k * {compression.PARTS}) // n AS p, k % (n // {compression.PARTS}) AS pos,
         floor({compression.SCALE} * e[k + 1]::DOUBLE)::BIGINT AS x
  FROM (SELECT rid, e, len(e) AS n, unnest(range(len(e))) AS k FROM kept)),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS entry, pos, x FROM comps WHERE rid <= {compression.ENTRIES}),{rounds},{assigned(last)},
coded AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error
  FROM near{last} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, entry, pos)) FROM book{last}) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
"""


def _crc_table() -> list[int]:
    """The step of CRC-32 for each low byte."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _op12() -> str:
    """CRC-32 byte by byte; near words by the texts that are left when one place is masked or deleted."""
    size = spelling.LEAST_LETTERS
    return f"""
WITH runs AS (
  SELECT doc_id, {_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents),
told AS (
  SELECT run, n, list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: ord(c)) AS points
  FROM (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {size} GROUP BY doc_id, run)),
step AS (SELECT {_crc_table()}::BIGINT[] AS t),
hashed AS (
  SELECT run, n, xor(list_reduce(flatten(list_transform(points, lambda c:
      CASE WHEN c < 128 THEN [c::BIGINT] ELSE [192 + (c >> 6), 128 + (c & 63)]::BIGINT[] END)),
    lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM told, step),
counted AS (
  SELECT CASE WHEN h % {spelling.DELETED} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2)
         ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM counted WHERE length(word) >= {size} GROUP BY word
  HAVING sum(n) >= {spelling.LEAST_COUNT}),
places AS MATERIALIZED (SELECT word, n, unnest(range(length(word))) AS i FROM words),
masked AS (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS rest FROM places),
less AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS rest FROM places),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM masked a JOIN masked b ON a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
  UNION ALL SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n
  FROM near GROUP BY word),
found AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.near_n >= {spelling.RATIO} * w.n THEN b.near END AS form,
         CASE WHEN b.near_n >= {spelling.RATIO} * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS MATERIALIZED (
  WITH RECURSIVE walk AS (
    SELECT word, word AS spot FROM found
    UNION ALL SELECT walk.word, found.form FROM walk JOIN found ON walk.spot = found.word WHERE found.form IS NOT NULL)
  SELECT walk.word, walk.spot AS root FROM walk JOIN found ON walk.spot = found.word WHERE found.form IS NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM found f JOIN chain c ON f.word = c.word
"""


def _op13() -> str:
    """Every block against every template, without filters."""
    quoted = lambda ws: "[" + ", ".join(f"'{w.decode()}'" for w in ws) + "]"
    templates = []
    for k, (label, text) in enumerate(licenses.TEMPLATES):
        words = licenses.words_of(text)
        known = sorted(set(words))
        templates.append(f"({k}, '{label}', {quoted(known)}, {licenses.block_words(len(words))}, "
                         f"{licenses.needed(len(known), licenses.CONTAINED)})")
    phrases = ", ".join(f"({quoted(p.encode().split())}, '{label}')" for p, label in licenses.PHRASES)
    lower = _LOWER.format("coalesce(text, '')")
    return f"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
phrases(phrase, label) AS (VALUES {phrases}),
templates(t, label, known, block, needed) AS (VALUES {", ".join(templates)}),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(len(words)),
         lambda i: words[i + 1:i + len(phrase)] = phrase)) AS pos
  FROM w, phrases WHERE list_contains(words, 'license')),
base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_distinct(list(label)) AS labels
  FROM places GROUP BY doc_id),
blocks AS (
  SELECT doc_id, block, words[pos + 1:pos + block] AS held FROM (
    SELECT doc_id, words, block, unnest(range(0, len(words), block // 2)) AS pos
    FROM w, (SELECT DISTINCT block FROM templates))),
found AS (
  SELECT doc_id, max(shared / len(known)) AS score, list_distinct(list(label)) AS labels FROM (
    SELECT doc_id, label, known, needed, len(list_filter(known, lambda x: list_contains(held, x))) AS shared
    FROM blocks JOIN templates USING (block))
  WHERE shared >= needed GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',')
         AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base ON w.doc_id = base.doc_id LEFT JOIN found ON w.doc_id = found.doc_id
"""


ORACLE = {"op1_exact_dedup": OP1, "op11_vector_codes": _op11(), "op12_spelling": _op12(), "op13_licenses": _op13()}
