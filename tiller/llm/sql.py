"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from tiller.llm.op4_secret_scan import (
    ACCESS,
    ASSIGN,
    BASE,
    HEX,
    MIN_DISTINCT,
    MIN_VALUE,
    MOST_OWNERS,
    MOST_REPOSITORIES,
    TOKEN,
)
from tiller.llm.op6_line_dedup import MIN_CHARS, MIN_DOCS
from tiller.llm.op7_decontamination import WINDOW
from tiller.llm.op11_embedding_dedup import COSINE
from tiller.llm.op12_vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _low(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (SELECT *, {_low(f"trim(line, {_BLANKS})")} AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {MIN_CHARS}
           GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
judged AS (SELECT keyed.*, coalesce(keeper <> doc_id, false) AS gone
           FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
         AS kept_sha256
FROM judged GROUP BY doc_id"""

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_low("coalesce(text, '')"))} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(_low("coalesce(text, '')"))} AS w FROM benchmark),
iw AS (SELECT item_id, w, least({WINDOW}, len(w)) AS width FROM i WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, width, array_to_string(w[s : s + width - 1], ' ') AS k
                 FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS s FROM iw) x),
widths AS (SELECT DISTINCT width FROM iw),
doc_windows AS (SELECT doc_id, width, s, array_to_string(w[s : s + width - 1], ' ') AS k
                FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS s
                      FROM d, widths) x),
hits AS (SELECT doc_id, item_id, doc_windows.width, s FROM doc_windows JOIN item_windows USING (width, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(s, s + width)) AS p FROM hits) x GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _found(no: int, kind: str, pattern: str, group: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
SELECT doc_id, source, lang, {no} AS no, '{kind}' AS kind,
       unnest(regexp_split_to_array(t, '{quoted}')[1 : len(regexp_extract_all(t, '{quoted}'))]) AS gap,
       unnest(regexp_extract_all(t, '{quoted}')) AS own,
       unnest(regexp_extract_all(t, '{quoted}', {group})) AS value,
       generate_subscripts(regexp_extract_all(t, '{quoted}'), 1) AS nth
FROM docs"""


SECRET_SCAN = f"""
WITH docs AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_found(no, *x) for no, x in enumerate((
    ("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("token", TOKEN, 0))))}),
placed AS (SELECT *, sum(length(gap) + length(own)) OVER (PARTITION BY doc_id, no ORDER BY nth) AS stop
           FROM found),
spans AS (SELECT doc_id, source, lang, no, kind, value, CAST(stop AS BIGINT) AS stop,
                 CAST(stop - length(own) AS BIGINT) AS start FROM placed
          WHERE CASE kind WHEN 'assign' THEN length(value) >= {MIN_VALUE}
                          WHEN 'token' THEN regexp_matches(value, '[0-9]')
                               AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
                          ELSE true END),
held AS (SELECT value, count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS owners,
                count(DISTINCT (coalesce(source, chr(1)), coalesce(lang, chr(1)))) AS repositories
         FROM spans GROUP BY value),
marked AS (SELECT spans.*, regexp_matches(value, '[0-9]')
             AND len(list_distinct(string_split(value, ''))) >= {MIN_DISTINCT}
             AND owners <= {MOST_OWNERS} AND repositories <= {MOST_REPOSITORIES} AS live
           FROM spans JOIN held USING (value)),
reported AS (SELECT *, kind || ':' || start || ':' || stop AS span FROM marked
             WHERE live OR kind IN ({', '.join(f"'{k}'" for k in BASE)})),
sums AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign,
                count(*) FILTER (WHERE kind = 'access') AS n_access,
                count(*) FILTER (WHERE kind = 'hex') AS n_hex,
                string_agg(span, ',' ORDER BY start, no) FILTER (WHERE kind <> 'token') AS base,
                string_agg(span, ',' ORDER BY start, no) AS spans,
                count(*) FILTER (WHERE live) AS n_live FROM reported GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM docs LEFT JOIN sums USING (doc_id)"""

_USABLE = """embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS e FROM embeddings
  WHERE {_USABLE} AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
          UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN lowest ON vec_id = lowest.a LEFT JOIN counted ON vec_id = counted.a"""


def _vector_codes() -> str:
    """All rounds, one after another; distance and entry share a number, so min keeps the order."""
    squared = ("CAST(list_sum(list_transform(range(1, len(x.v) + 1), "
               "lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS BIGINT)")

    def assigned(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (
  SELECT x.r, x.p, min({squared} * {ENTRIES} + b.e) AS k FROM part x JOIN b{i} b USING (p)
  GROUP BY x.r, x.p)"""

    steps = []
    for i in range(ROUNDS):
        steps += [assigned(i), f"""b{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM (
      SELECT p, e, j, sum(c) AS s, count(*) AS n FROM (
        SELECT p, k % {ENTRIES} AS e, generate_subscripts(v, 1) AS j, unnest(v) AS c
        FROM a{i} JOIN part USING (r, p)) y GROUP BY p, e, j) z GROUP BY p, e) m USING (p, e))"""]
    rounds = ",\n".join([*steps, assigned(ROUNDS)])
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
         list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE {_USABLE}),
part AS MATERIALIZED (
  SELECT r, p, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] AS v
  FROM (SELECT r, x, unnest(range({PARTS})) AS p FROM kept) y),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM part WHERE r <= {ENTRIES}),
{rounds},
coded AS (SELECT r, string_agg(printf('%02x', k % {ENTRIES}), '' ORDER BY p) AS code,
                 CAST(sum(k // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
book AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) AS digest FROM (
  SELECT p, e, generate_subscripts(v, 1) AS j, unnest(v) AS c FROM b{ROUNDS}) y)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT digest FROM book) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""


SQL = {
    "op4_secret_scan": SECRET_SCAN,
    "op6_line_dedup": LINE_DEDUP,
    "op7_decontamination": DECONTAMINATION,
    "op11_embedding_dedup": EMBEDDING_DEDUP,
    "op12_vector_codes": _vector_codes(),
}
