"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
_LOWER = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c + 32) for c in range(0xC0, 0xDF) if c != 0xD7)

NGRAM_JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
  FROM w WHERE len(w) > 0),
same AS (SELECT s, min(doc_id) AS rep, list(DISTINCT doc_id) AS ids FROM s GROUP BY s),
tokens AS (SELECT rep, len(s) AS m, unnest(s) AS t FROM same),
common AS (
  SELECT a.rep AS a, b.rep AS b, a.m AS ma, b.m AS mb, count(*) AS c
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.rep <> b.rep GROUP BY ALL),
link AS (SELECT a, b FROM common WHERE c / (ma + mb - c) >= 0.5),
reach AS (SELECT rep AS a, rep AS b FROM same UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
class AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a)
SELECT id AS doc_id, class_id, len(ids) - 1 AS copies, coalesce(links, 0) AS links
FROM (SELECT rep, ids, unnest(ids) AS id FROM same) JOIN class ON rep = class.a LEFT JOIN (SELECT a, count(*) AS links FROM link GROUP BY a) k ON rep = k.a
UNION ALL
SELECT doc_id, doc_id, 0, 0 FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM s))
"""

_COVER = """
n{n} AS (
  SELECT doc_id, i, array_to_string(w[i:i + {m}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {m} + 1)) AS i FROM w)),
d{n} AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1 AS hit FROM n{n}),
c{n} AS (
  SELECT doc_id, sum(CASE WHEN hit THEN size ELSE 0 END) AS part FROM (
    SELECT u.doc_id, u.size, coalesce(bool_or(d.hit) OVER (PARTITION BY u.doc_id ORDER BY u.i ROWS BETWEEN {m} PRECEDING AND CURRENT ROW), false) AS hit
    FROM u LEFT JOIN d{n} d ON u.doc_id = d.doc_id AND u.i = d.i) GROUP BY doc_id)"""

REPETITION_COVERAGE = (
    r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\v\f]+'), lambda x: x <> '') AS w,
    list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: array_to_string(list_filter(string_split_regex(l, '[ \t\n\r\v\f]+'), lambda x: x <> ''), ' ')), lambda l: l <> '') AS l
  FROM documents),
u AS (SELECT doc_id, i, length(w[i]) AS size FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
total AS (SELECT doc_id, sum(size) AS chars FROM u GROUP BY doc_id),
l AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM w)),
lines AS (
  SELECT doc_id, sum(CASE WHEN r > 1 THEN length(replace(line, ' ', '')) ELSE 0 END) AS part
  FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM l) GROUP BY doc_id),"""
    + ",".join(_COVER.format(n=n, m=n - 1) for n in range(5, 11))
    + """,
shares AS (
  SELECT w.doc_id, coalesce(chars, 0)::BIGINT AS chars, coalesce(lines.part / chars, 0.0) AS dup_line, """
    + ", ".join(f"coalesce(c{n}.part / chars, 0.0) AS dup_{n}" for n in range(5, 11))
    + """
  FROM w LEFT JOIN total USING (doc_id) LEFT JOIN lines USING (doc_id) """
    + " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in range(5, 11))
    + """)
SELECT doc_id, chars, round(dup_line, 6) AS dup_line, """
    + ", ".join(f"round(dup_{n}, 6) AS dup_{n}" for n in range(5, 11))
    + """,
  dup_line <= 0.30 AND dup_5 <= 0.15 AND dup_6 <= 0.14 AND dup_7 <= 0.13 AND dup_8 <= 0.12 AND dup_9 <= 0.11 AND dup_10 <= 0.10 AS keep
FROM shares
"""
)


IMPACT_SEARCH = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
q AS (
  SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> ''))) AS t
  FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d WHERE len(w) > 0),
p AS (
  SELECT doc_id, dl, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM d) SEMI JOIN q USING (t) GROUP BY ALL),
f AS (SELECT t, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, n GROUP BY t, n),
s AS (
  SELECT item_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score
  FROM q JOIN p USING (t) JOIN f USING (t), n GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""

WARC_TRANSACTIONS = r"""
SELECT
  'urn:page:response:' || page_id AS capture_id,
  url AS target_uri,
  'urn:page:request:' || page_id AS request_id,
  'GET ' || CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END || ' HTTP/1.1' AS request_line,
  'Host: ' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS request_headers,
  'HTTP/1.1 200 OK' AS status_line,
  200 AS status,
  'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) AS response_headers,
  html AS body,
  'urn:page:metadata:' || page_id AS metadata_ids,
  'outlinks: ' || ((length(html) - length(replace(html, '<a href="', ''))) // 9) || chr(13) || chr(10) AS metadata_text
FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS path FROM pages)
"""
