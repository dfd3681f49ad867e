"""SQL of DuckDB for the queries that it can express."""

from __future__ import annotations

from tessella.llm import quality
from tessella.llm.mixing import OP2_SQL
from tessella.llm.nearest import OP9_SQL

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "".join(map(chr, range(65, 91)))

OP1_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i : i + 3], ' ')) AS s FROM w, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS t(i) WHERE len(words) > 0
), sizes AS (
  SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN shingles USING (doc_id) GROUP BY w.doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * p.both >= 85 * (x.n + y.n - p.both)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), exact AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY CASE WHEN n > 0 THEN k ELSE doc_id::VARCHAR END) AS class_id FROM (SELECT z.doc_id, z.n, string_agg(s, '' ORDER BY s) AS k FROM sizes z LEFT JOIN shingles USING (doc_id) GROUP BY z.doc_id, z.n)
)
SELECT z.doc_id, z.n AS n_shingles, e.class_id, r.component_id FROM sizes z JOIN exact e USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""


def _windows(k: int) -> str:
    return f"""win{k} AS (
  SELECT doc_id, i, row_number() OVER same AS nth, count(*) OVER (PARTITION BY doc_id, h) AS n FROM (
    SELECT doc_id, i, md5(array_to_string(words[i : i + {k - 1}], ' ')) AS h FROM w, unnest(range(1, greatest(len(words) - {k - 2}, 1))) AS t(i)) WINDOW same AS (PARTITION BY doc_id, h ORDER BY i)
), later{k} AS (
  SELECT doc_id, sum(length(words[p])) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {k})) AS p FROM win{k} WHERE nth > 1) JOIN w USING (doc_id) GROUP BY doc_id
)"""


OP3_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
), lines AS (
  SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{_WORD}') GROUP BY ALL
), per AS (
  SELECT doc_id, sum(n - 1) AS n_dup_lines, sum((n - 1) * length(line)) AS dup_line_chars, sum(n * length(line)) AS line_chars FROM lines GROUP BY doc_id
), {", ".join(_windows(k) for k in quality.LENGTHS)}, every AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM win5 WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(every.n, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, coalesce(line_chars, 0)::BIGINT AS line_chars,
         {", ".join(f"coalesce(later{k}.chars, 0)::BIGINT AS repeat_chars_{k}" for k in quality.LENGTHS)}
  FROM w LEFT JOIN per USING (doc_id) LEFT JOIN every USING (doc_id) {" ".join(f"LEFT JOIN later{k} USING (doc_id)" for k in quality.LENGTHS)}
)
SELECT * EXCLUDE (line_chars), n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_IN_WINDOWS} * n_words AS base_failed,
       NOT (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_IN_WINDOWS} * n_words) AND 100 * dup_line_chars <= {quality.MOST_IN_LINES} * line_chars
       AND {" AND ".join(f"100 * repeat_chars_{k} <= {v} * word_chars" for k, v in quality.MOST_REPEATED.items())} AS kept
FROM m
"""

OP8_SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 12], ' ')) AS h FROM w, unnest(range(1, greatest(len(words) - 11, 1))) AS t(i)
), bad AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM win) WHERE least < doc_id
), gone AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (before IS DISTINCT FROM p - 1) AS spans FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM bad) GROUP BY doc_id
), left_over AS (
  SELECT a.doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w) a ANTI JOIN bad b ON a.doc_id = b.doc_id AND a.p = b.p GROUP BY a.doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(spans, 0)::BIGINT AS n_spans
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

OP7_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), n AS (
  SELECT doc_id, h, length(h) // 2 AS n_bytes FROM d
), piece AS (
  SELECT doc_id, n_bytes, p, substr(h, p * 2000 + 1, 2398) AS s FROM n, unnest(range(0, (n_bytes + 999) // 1000)) AS t(p)
), win AS (
  SELECT doc_id, p * 1000 + i AS place, md5(substr(s, 2 * i + 1, 400)) AS w FROM piece, unnest(range(0, least(1000, n_bytes - 199 - p * 1000))) AS t(i)
), twice AS (
  SELECT doc_id, place, lag(place) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM (SELECT *, count(*) OVER (PARTITION BY w) AS c FROM win) WHERE c > 1
), spans AS (
  SELECT doc_id, min(place) AS a, max(place) + 200 AS b FROM (SELECT *, sum((before IS NULL OR place > before + 200)::INT) OVER (PARTITION BY doc_id ORDER BY place) AS g FROM twice) GROUP BY doc_id, g
), held AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS after FROM spans
), gone AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM held JOIN n USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM n LEFT JOIN gone USING (doc_id)
"""

ORACLE_SQL = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op2_mixing_sources": OP2_SQL,
    "op3_quality_rules": OP3_SQL,
    "op7_suffix_array_dedup": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op9_nearest_neighbours": OP9_SQL,
}
