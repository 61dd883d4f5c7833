"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tessera.functions.embedder import QUERY_PREFIX
from tessera.functions.query import NEGATIVE_SHARE as NEG
from tessera.functions.query import POSITIVE_SHARE as POS

_MEMBERS = "members AS (SELECT source AS project_id, md5(text) AS sha512, '/in/' || doc_id || '.txt' AS source_path, doc_id AS added_at FROM documents)"
_REFS = _MEMBERS + ", refs AS (SELECT project_id, sha512, arg_min(source_path, added_at) AS source_path, min(added_at) AS added_at FROM members GROUP BY ALL)"


def _files(where: str) -> str:
    return f"""files AS (
      SELECT md5(text) AS sha512, arg_min(source, doc_id) || '-' || min(doc_id) || '.txt' AS basename, strlen(any_value(text)) AS byte_len,
        length(any_value(text)) AS char_len, len(regexp_extract_all(any_value(text), '\\S+')) AS word_count
      FROM documents WHERE {where} GROUP BY 1)"""


_FILES = _files("lang <> 'de'")
_JOBS = """jobs AS (
  SELECT source AS project_id, md5(text) AS sha512, CASE WHEN min(doc_id) % 2 = 1 THEN 'error' ELSE 'pending' END AS status,
    CASE WHEN min(doc_id) % 2 = 1 THEN 'unreadable' ELSE '' END AS error, min(doc_id) AS added_at
  FROM documents WHERE lang = 'de' GROUP BY ALL)"""
_PROJECTS = "projects AS (SELECT source AS project_id, upper(source) AS name, min(doc_id) AS created_at FROM documents GROUP BY 1)"
_CHUNKS = r"""
tok AS (SELECT doc_id, source, regexp_extract_all(text, '\s*\S+') AS tok FROM documents),
win AS (SELECT *, unnest(range(0, CASE WHEN len(tok) = 0 THEN 0 WHEN len(tok) <= 50 THEN 1 ELSE 1 + ceil((len(tok) - 50) / 40.0)::INTEGER END)) AS k FROM tok),
raw AS (SELECT doc_id, source, k::INTEGER AS k, array_to_string(tok[k * 40 + 1 : k * 40 + 50], '') AS raw, length(array_to_string(tok[1 : k * 40], '')) AS before FROM win),
bare AS (SELECT *, regexp_replace(raw, '^\s+', '') AS text FROM raw),
chunks AS (
  SELECT doc_id * 1000000 + k AS id, doc_id, source, k, text, (before + length(raw) - length(text))::BIGINT AS char_start, (before + length(raw))::BIGINT AS char_end
  FROM bare)"""
_V = "v AS (SELECT vec_id AS id, label::VARCHAR AS sha512, embedding::DOUBLE[] AS e FROM embeddings)"
_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


def _near(columns: str, query: str, limit: int, where: str = "true", more: str = "") -> str:
    """The nearest vectors to a query CTE q(e)."""
    return f"""
WITH {_V}, {query},
near AS (
  SELECT v.id, v.sha512, greatest(round(1 - {_COS.format(a="v.e", b="q.e")}, 9), 0) AS d FROM v, q WHERE {where}
  ORDER BY d, id LIMIT {limit}),
hits AS (SELECT id, sha512, round(d, 6) AS distance, round(greatest(0, least(1, 1 - d)), 6) AS score FROM near)
SELECT {columns} FROM hits {more}
"""


_Q0 = "q AS (SELECT e FROM v WHERE id = 0)"


def _weighted(weights: dict[int, float]) -> str:
    pos, neg = sum(w > 0 for w in weights.values()), sum(w < 0 for w in weights.values())
    scaled = [(k, w * POS / pos if w > 0 else w * NEG / neg) for k, w in weights.items()]
    cases = " ".join(f"WHEN {k} THEN {w!r}" for k, w in scaled)
    return f"""
parts AS (SELECT unnest(range(0, len(e))) AS pos, unnest(e) AS x, CASE id {cases} END AS w FROM v WHERE id IN ({", ".join(map(str, weights))})),
summed AS (SELECT pos, sum(x * w::DOUBLE) AS x FROM parts GROUP BY pos),
q AS (SELECT list(x ORDER BY pos) AS e FROM summed)"""


def _prefix(column: str, token: str) -> str:
    return f"regexp_matches(lower({column}), '(^|[^\\p{{L}}\\p{{N}}_]){token}')"


def _bm25(grams: list[str], tokens: str = "documents", extra: str = "true", tail: str = "") -> str:
    has = " AND ".join(f"contains(lower(text), '{g}')" for g in grams)
    df = ", ".join(f"count(*) FILTER (WHERE contains(lower(text), '{g}')) AS df_{k}" for k, g in enumerate(grams))
    term = " + ".join(
        f"ln(1 + (n - df_{k} + 0.5) / (df_{k} + 0.5)) * tf_{k} * 2.2 / (tf_{k} + 1.2 * (0.25 + 0.75 * size / mean))" for k in range(len(grams))
    )
    tf = ", ".join(f"(length(low) - length(replace(low, '{g}', ''))) // 3 AS tf_{k}" for k, g in enumerate(grams))
    return f"""
WITH s AS (SELECT count(*)::DOUBLE AS n, avg(greatest(length(lower(text)) - 2, 0)) AS mean, {df} FROM {tokens}),
c AS (SELECT doc_id AS id, text, low, greatest(length(low) - 2, 0) AS size, {tf} FROM (SELECT doc_id, text, lower(text) AS low FROM {tokens} WHERE {has})),
scored AS (SELECT id, text, round({term}, 9) AS score FROM c, s)
SELECT id{{columns}}, round(score, 6) AS score FROM scored WHERE {extra} {tail}
"""


def _place(token: str) -> str:
    return f"(('0x' || substr(md5({token}), 1, 4))::INTEGER % 256) AS p, CASE WHEN ('0x' || substr(md5({token}), 5, 1))::INTEGER < 8 THEN 1 ELSE -1 END AS sign"


def _query_vector(terms: list[tuple[str, float]]) -> str:
    """q(p, x): the unit vector of weighted terms under the hash embedder."""
    pos, neg = sum(w > 0 for _, w in terms), sum(w < 0 for _, w in terms)
    values = ", ".join(f"('{QUERY_PREFIX}{t}', {w * POS / pos if w > 0 else w * NEG / neg!r}::DOUBLE)" for t, w in terms)
    return f"""
terms AS (SELECT * FROM (VALUES {values}) AS t(term, w)),
qtok AS (SELECT term, w, unnest(list_filter(string_split_regex(lower(term), '\\s+'), lambda x: x <> '')) AS t FROM terms),
qsum AS (SELECT term, w, p, sum(sign)::DOUBLE AS x FROM (SELECT term, w, {_place("t")} FROM qtok) GROUP BY ALL),
qunit AS (SELECT p, sum(w * x / norm) AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY term)) AS norm FROM qsum) GROUP BY p),
q AS (SELECT p, x / sqrt(sum(x * x) OVER ()) AS x FROM qunit)"""


_DENSE = f"""
ctok AS (SELECT id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM chunks),
cplace AS (SELECT t, {_place("t")} FROM (SELECT DISTINCT t FROM ctok)),
csum AS (SELECT id, p, sum(sign)::DOUBLE AS x FROM ctok JOIN cplace USING (t) GROUP BY ALL),
cosine AS (SELECT id, coalesce(sum(c.x * q.x), 0) / nullif(sqrt(sum(c.x * c.x)), 0) AS cos FROM csum c LEFT JOIN q USING (p) GROUP BY id),
dense AS (SELECT id, greatest(round(1 - coalesce(cos, 0), 9), 0) AS d FROM chunks LEFT JOIN cosine USING (id))"""
_HYBRID_TERMS = [("the of and", 1.0), ("pour", -1.0)]
_LITERAL = f"{_prefix('text', 'erth')} AND {_prefix('text', 'and')}"
_SHOW = """
SELECT id, doc_id::VARCHAR AS sha512, source || '-' || doc_id AS basename, 'text' AS filetype, char_start, char_end, round(d, 6) AS distance, round(greatest(0, least(1, 1 - d)), 6) AS score
FROM """

_EXPLAIN = f"""
WITH {_CHUNKS}, {_query_vector([("the of", 1.0)])},
piece AS (SELECT id, unnest(range(1, len(w) + 1)) AS n, w FROM (SELECT id, regexp_extract_all(text, '\\s*\\S+') AS w FROM chunks)),
tokens AS (SELECT id, n - 1 AS place, ltrim(w[n], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS word, strlen(array_to_string(w[1:n], '')) AS stop FROM piece),
placed AS (SELECT id, place, stop - strlen(word) AS start, stop, lower(word) AS t FROM tokens),
signed AS (SELECT *, {_place("t")} FROM placed),
sums AS (SELECT id, sqrt(sum(x * x)) AS norm FROM (SELECT id, p, sum(sign)::DOUBLE AS x FROM signed GROUP BY ALL) GROUP BY id),
shares AS (SELECT id, place, start, stop, sign * coalesce(q.x, 0) / nullif(norm, 0) AS score FROM signed JOIN sums USING (id) LEFT JOIN q USING (p))
"""

_SEGMENTS = """
cells AS (
  SELECT 'region' AS f, row_number() OVER (ORDER BY r_regionkey) - 1 AS r, unnest([0, 1]) AS c, unnest(['r_regionkey', 'r_name']) AS h, unnest([r_regionkey::VARCHAR, r_name]) AS v FROM region
  UNION ALL SELECT 'nation', row_number() OVER (ORDER BY n_nationkey) - 1, unnest([0, 1, 2]), unnest(['n_nationkey', 'n_name', 'n_regionkey']), unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) FROM nation
  UNION ALL SELECT 'supplier', row_number() OVER (ORDER BY s_suppkey) - 1, unnest([0, 1, 2, 3]), unnest(['s_suppkey', 's_name', 's_nationkey', 's_acctbal']), unnest([s_suppkey::VARCHAR, s_name, s_nationkey::VARCHAR, s_acctbal::VARCHAR]) FROM supplier)"""

ORACLE_SQL: dict[str, str] = {
    "chunk_word_windows": f"WITH {_CHUNKS} SELECT doc_id, k, text, char_start, char_end FROM chunks",
    "chunk_stats": "SELECT doc_id, length(text) AS char_len, len(regexp_extract_all(text, '\\S+')) AS word_count, strlen(text) AS byte_len FROM documents",
    "chunk_plain_words": "SELECT doc_id, k::INTEGER AS k, array_to_string(w[k * 128 + 1 : k * 128 + 128], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, ceil(len(w) / 128.0)::INTEGER)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents))",
    "csv_cell_chunks": f"WITH {_SEGMENTS}, full_cells AS (SELECT *, h || ': ' || v AS text FROM cells WHERE v <> ''), placed AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY f ORDER BY r, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM full_cells) SELECT f AS sha512, text, o AS char_start, o + length(text) AS char_end, r AS row, c::BIGINT AS col FROM placed",
    "page_segments_offsets": "SELECT conv_id, turn AS page, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base_offset, length(text) AS n_chars FROM conversations",
    "document_full_text": "SELECT conv_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)",
    "file_identity": "WITH p AS (SELECT *, regexp_replace(url, '[?#].*$', '') AS path FROM pages), n AS (SELECT *, regexp_extract(path, '([^/]*)/*$', 1) AS basename, regexp_extract(path, '([^/\\\\]*)$', 1) AS last FROM p) SELECT page_id, basename, CASE WHEN starts_with(html, '%PDF-') OR ends_with(lower(basename), '.pdf') THEN 'pdf' WHEN ends_with(lower(basename), '.csv') THEN 'csv' ELSE 'text' END AS filetype, strlen(html) AS byte_len, CASE WHEN regexp_replace(last, '\\.[^.]+$', '') = '' THEN 'New project' ELSE regexp_replace(last, '\\.[^.]+$', '') END AS project_name FROM n",
    "decoded_text": "SELECT doc_id, md5(text) AS digest FROM documents",
    "exact_knn": _near("id, distance, score", _Q0, 10),
    "knn_scoped": _near("id, sha512, distance", _Q0, 10, "sha512 IN ('1', '3', '5')"),
    "knn_all_pairs": f"WITH {_V}, d AS (SELECT a.id, b.id AS other, greatest(round(1 - {_COS.format(a='a.e', b='b.e')}, 9), 0) AS d FROM v a, v b WHERE a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM d) SELECT id, rank, other, round(d, 6) AS distance FROM r WHERE rank <= 3",
    "mean_pool": f"WITH {_V} SELECT sha512 AS label, pos::INTEGER AS pos, round(avg(x), 6) AS x FROM (SELECT sha512, unnest(range(0, len(e))) AS pos, unnest(e) AS x FROM v) GROUP BY ALL",
    "similarity_matrix": f"WITH {_V}, m AS (SELECT sha512 AS label, pos, avg(x) AS x FROM (SELECT sha512, unnest(range(0, len(e))) AS pos, unnest(e) AS x FROM v) GROUP BY ALL) SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x), 6) AS similarity FROM m a JOIN m b USING (pos) GROUP BY ALL",
    "weighted_centroid_search": _near("id, distance, score", _weighted({0: 1.0, 1: 2.0, 2: -1.0}), 10),
    "relevance_feedback_search": _near("id, distance, score", _weighted({0: 1.0, 7: 0.5, 9: -2.0}), 30),
    "group_hits_by_file": _near("sha512, round(avg(score), 6) AS mean_score, count(*) AS n_hits, string_agg(id::VARCHAR, ',' ORDER BY score DESC, id) AS hit_ids", _Q0, 60, more="GROUP BY sha512"),
    "excerpt_view": _near("row_number() OVER (ORDER BY score DESC, id)::INTEGER AS place, id, score, floor(score * 100 + 0.5)::INTEGER || '%' AS percent", _Q0, 60, more="WHERE sha512 = '1'"),
    "load_more": _near("id, distance, (SELECT count(*) >= 60 FROM hits) AS has_more", _Q0, 60),
    "keyword_prefix_filter": f"SELECT doc_id, source FROM documents WHERE {_prefix('text', 'and')} AND {_prefix('text', 'thea')}",
    "multi_literal_and": f"SELECT doc_id, source FROM documents WHERE {_prefix('text', 'and')} AND {_prefix('text', 'thea')} AND {_prefix('text', 'erth')}",
    "keyword_substring": _bm25(["ert", "rth"]).format(columns=""),
    "bm25_trigram_rank": _bm25(["hen", "ent", "ors", "rst"], tail="ORDER BY scored.score DESC, id LIMIT 50").format(columns=""),
    "literals_only_rank": _bm25(["ert", "rth"], extra=_LITERAL.replace("{", "{{").replace("}", "}}"), tail="ORDER BY scored.score DESC, id LIMIT 30").format(columns=", 0.0::DOUBLE AS distance, 'bm25' AS score_kind"),
    "hybrid_overfetch": f"WITH {_CHUNKS}, {_query_vector(_HYBRID_TERMS)}, {_DENSE}, near AS (SELECT * FROM dense ORDER BY d, id LIMIT 400) {_SHOW} near JOIN chunks USING (id) WHERE {_LITERAL} ORDER BY d, id LIMIT 20",
    "hybrid_exact_filter": f"WITH {_CHUNKS}, {_query_vector(_HYBRID_TERMS)}, {_DENSE} {_SHOW} dense JOIN chunks USING (id) WHERE {_LITERAL} ORDER BY d, id LIMIT 20",
    "filename_filter": f"WITH {_files('true')} SELECT sha512, basename FROM files WHERE contains(lower(basename), 'src1-')",
    "normalized_quotes": "SELECT doc_id, md5('\"' || translate(text, '“”„‟‘’‚‛', '\"\"\"\"''''''''') || '\" ''''') AS digest FROM documents",
    "explain_tokens": _EXPLAIN + "SELECT id, place::INTEGER AS place, start::INTEGER AS start, stop::INTEGER AS \"end\", round(coalesce(score, 0), 6) AS score FROM shares",
    "explain_totals": _EXPLAIN + "SELECT id, count(*)::INTEGER AS tokens, 0.0::DOUBLE AS bias, round(sum(coalesce(score, 0)), 6) AS total FROM shares GROUP BY id",
    "dedup_by_content": f"WITH {_MEMBERS} SELECT sha512, arg_min(project_id, added_at) AS project_id, arg_min(source_path, added_at) AS source_path FROM members GROUP BY sha512",
    "ref_count": f"WITH {_MEMBERS} SELECT sha512, count(*) AS refs FROM members GROUP BY sha512",
    "orphan_files": f"WITH {_MEMBERS}, {_FILES} SELECT sha512, basename FROM files ANTI JOIN (SELECT sha512 FROM members WHERE project_id NOT IN ('src1', 'src2', 'src3')) USING (sha512)",
    "delete_project": f"""WITH {_MEMBERS}, {_FILES}, {_JOBS}, {_PROJECTS}, kept AS (SELECT * FROM members WHERE project_id <> 'src1'), kept_jobs AS (SELECT * FROM jobs WHERE project_id <> 'src1')
SELECT 'projects' AS "table", count(*) AS n FROM projects WHERE project_id <> 'src1'
UNION ALL SELECT 'project_files', count(*) FROM kept
UNION ALL SELECT 'index_jobs', count(*) FROM kept_jobs
UNION ALL SELECT 'files', count(*) FROM files SEMI JOIN kept USING (sha512)
UNION ALL SELECT 'orphans', count(*) FROM files ANTI JOIN kept USING (sha512)
UNION ALL SELECT 'unused_bytes', count(*) FROM (SELECT sha512 FROM members WHERE project_id = 'src1' UNION SELECT sha512 FROM jobs WHERE project_id = 'src1') ANTI JOIN (SELECT sha512 FROM kept UNION ALL SELECT sha512 FROM kept_jobs) USING (sha512)""",
    "remove_file_ref": f"WITH {_MEMBERS}, one AS (SELECT project_id, sha512 FROM members ORDER BY added_at LIMIT 1) SELECT project_id, sha512 FROM members ANTI JOIN one USING (project_id, sha512)",
    "add_file_refs": f"WITH {_REFS} SELECT project_id, sha512, source_path, added_at FROM refs",
    "list_project_files": f"WITH {_REFS}, {_FILES} SELECT project_id, sha512, added_at, basename, char_len FROM refs JOIN files USING (sha512)",
    "list_documents": f"WITH {_MEMBERS}, {_FILES} SELECT sha512, basename, 'text' AS filetype, char_len, word_count FROM members JOIN files USING (sha512) WHERE project_id = 'src1'",
    "known_and_new": f"WITH {_MEMBERS}, {_FILES} SELECT project_id, CASE WHEN f.sha512 IS NULL THEN 'new' ELSE 'known' END AS state, count(*) AS n FROM members LEFT JOIN files f USING (sha512) GROUP BY ALL",
    "project_listing": f"WITH {_MEMBERS}, {_PROJECTS}, {_JOBS}, m AS (SELECT project_id, count(*) AS n FROM members GROUP BY 1), j AS (SELECT project_id, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'error') AS error FROM jobs GROUP BY 1) SELECT project_id, name, created_at, coalesce(n, 0) AS doc_count, coalesce(pending, 0) AS pending, coalesce(error, 0) AS error FROM projects LEFT JOIN m USING (project_id) LEFT JOIN j USING (project_id)",
    "project_labels": f"WITH {_MEMBERS}, {_PROJECTS}, {_JOBS}, m AS (SELECT project_id, count(*) AS n FROM members GROUP BY 1), j AS (SELECT project_id, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'error') AS error FROM jobs GROUP BY 1) SELECT project_id, CASE project_id WHEN 'src2' THEN 'renamed' ELSE name END AS name, concat_ws(' · ', n || CASE n WHEN 1 THEN ' document' ELSE ' documents' END, CASE WHEN pending > 0 THEN pending || ' queued' END, CASE WHEN error > 0 THEN error || ' failed' END) AS label FROM projects LEFT JOIN m USING (project_id) LEFT JOIN j USING (project_id)",
    "job_counts": f"WITH {_JOBS} SELECT project_id, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'error') AS error FROM jobs GROUP BY 1",
    "next_pending_job": f"WITH {_JOBS} SELECT project_id, sha512, added_at FROM jobs WHERE status = 'pending' ORDER BY added_at, project_id, sha512 LIMIT 1",
    "project_status": f"WITH {_JOBS} SELECT sha512, status, error, coalesce(status = 'pending' AND added_at = (SELECT min(added_at) FROM jobs WHERE project_id = 'src0' AND status = 'pending'), false) AS active FROM jobs WHERE project_id = 'src0'",
    "retry_failed_jobs": f"WITH {_JOBS} SELECT project_id, sha512, CASE WHEN project_id = 'src0' THEN 'pending' ELSE status END AS status, CASE WHEN project_id = 'src0' THEN '' ELSE error END AS error FROM jobs",
    "manage_rows": f"""WITH {_FILES}, {_JOBS}, active AS (SELECT sha512 FROM jobs WHERE status = 'pending' ORDER BY added_at, project_id, sha512 LIMIT 1), sized AS (
  SELECT *, CASE WHEN byte_len < 1024 THEN byte_len || ' B' WHEN byte_len / 1024 >= 10 THEN floor(byte_len / 1024 + 0.5)::BIGINT || ' KB' ELSE printf('%.1f', floor(byte_len / 1024 * 10 + 0.5) / 10) || ' KB' END AS size FROM files)
SELECT sha512, basename, 'indexed' AS state, 'Indexed' AS label, size || ' · ' || word_count || CASE word_count WHEN 1 THEN ' word' ELSE ' words' END AS stats FROM sized
UNION ALL
SELECT sha512, added_at || '.txt', CASE WHEN status = 'error' THEN 'error' WHEN sha512 IN (FROM active) THEN 'indexing' ELSE 'queued' END, CASE WHEN status = 'error' THEN 'Failed: unreadable' WHEN sha512 IN (FROM active) THEN 'Indexing…' ELSE 'Queued' END, '' FROM jobs""",
    "indexing_state": f"WITH {_JOBS} SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'pending') > 0 AS indexing FROM jobs",
    "requeue_all": f"WITH {_REFS}, {_FILES}, {_JOBS} SELECT project_id, sha512, status, added_at FROM jobs UNION ALL SELECT project_id, sha512, 'pending', 1700000000000 FROM refs SEMI JOIN files USING (sha512) ANTI JOIN jobs USING (project_id, sha512)",
    "upsert_meta": "SELECT r_name AS key, CASE r_name WHEN 'ASIA' THEN 'changed' ELSE r_regionkey::VARCHAR END AS value FROM region UNION ALL SELECT 'active_pipeline', 'v1:hash:wordwindow:50-10'",
    "contiguous_ids": "SELECT 99 + row_number() OVER (ORDER BY source, doc_id) AS id, source, doc_id FROM documents",
    "delete_file": f"WITH {_CHUNKS} SELECT doc_id::VARCHAR AS sha512, count(*) AS chunks FROM chunks WHERE doc_id <> 11 GROUP BY 1",
    "chunk_counts": f"WITH {_CHUNKS} SELECT count(*) FILTER (WHERE source = 'src3') AS n, max(id) AS max_id FROM chunks",
    "sizes_and_labels": "WITH s AS (SELECT *, strlen(text)::DOUBLE * strlen(text) AS b FROM documents), u AS (SELECT *, least(4, floor(log2(greatest(b, 1)) / 10))::INTEGER AS p FROM s), v AS (SELECT *, b / pow(1024, p) AS x FROM u) SELECT doc_id, CASE WHEN p = 0 OR x >= 10 THEN floor(x + 0.5)::BIGINT::VARCHAR ELSE printf('%.1f', floor(x * 10 + 0.5) / 10) END || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][p + 1] AS size, (doc_id % 3) || CASE doc_id % 3 WHEN 1 THEN ' file' ELSE ' files' END AS files, greatest(0.04, (doc_id % 100) / 100.0)::DOUBLE AS progress, greatest(0.1, least(2.0, doc_id / 100.0))::DOUBLE AS strength FROM v",
    "embed_batch_stats": "WITH e AS (SELECT trunc(value * 100)::BIGINT AS ms FROM events) SELECT sum(ms)::DOUBLE AS total_ms, round(count(*) * 32 * 1000.0 / sum(ms), 6)::DOUBLE AS rows_per_second, round(avg(ms), 6) AS avg_ms, min(ms)::DOUBLE AS min_ms, max(ms)::DOUBLE AS max_ms FROM e",
    "padded_grid": "SELECT n_nationkey, coalesce(w[1], '') || '|' || coalesce(w[2], '') || '|' || coalesce(w[3], '') AS cells FROM (SELECT *, string_split(n_name, ' ') AS w FROM nation)",
    "line_boxes": """WITH b AS (SELECT item_id, unnest(range(0, length(text))) AS k FROM benchmark), u AS (SELECT item_id, k // 20 AS row, min(k % 20) * 6.0 AS l, max(k % 20) * 6.0 + 5 AS r FROM b WHERE k >= 3 AND k < 43 GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY row) - 1)::INTEGER AS line, l::DOUBLE AS "left", (700.0 - row * 12)::DOUBLE AS bottom, r::DOUBLE AS "right", (709.0 - row * 12)::DOUBLE AS top, (l * 2)::DOUBLE AS x, ((800 - (709.0 - row * 12)) * 2)::DOUBLE AS y, ((r - l) * 2)::DOUBLE AS w, 18.0::DOUBLE AS h FROM u""",
    "word_islands": """WITH p AS (SELECT item_id, text, unnest(range(0, length(text), 3)) AS s FROM benchmark), g AS (SELECT *, least(s + 3, length(text)) AS e FROM p)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY 1))::BIGINT AS word, min(s)::INTEGER AS start, max(e)::INTEGER AS "end", count(*)::DOUBLE AS score, count(*) AS tokens FROM g GROUP BY item_id""",
    "sentence_offsets": r"""
WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '[^.!?]*[.!?]+[ \t\n\r]*|[^.!?]+') AS p FROM documents),
e AS (SELECT doc_id, length(text) AS size, p[k] AS piece, sum(length(p[k])) OVER (PARTITION BY doc_id ORDER BY k) AS till, k FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM p)),
s AS (SELECT doc_id, till AS start FROM e WHERE till < size AND regexp_matches(piece, '[ \t\n\r]$') UNION ALL SELECT doc_id, 0 FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INTEGER AS place, start::INTEGER AS start FROM s""",
    "stream_ingest": f"""WITH {_CHUNKS.strip()}, f AS (SELECT text, min(doc_id) AS doc_id FROM documents WHERE text <> '' GROUP BY 1), n AS (SELECT doc_id, count(*) AS chunks, max(char_end) AS last_end FROM chunks GROUP BY 1)
SELECT strlen(text)::BIGINT AS byte_len, length(text) AS char_len, len(regexp_extract_all(text, '\\S+'))::BIGINT AS word_count, coalesce(chunks, 0) AS chunks, coalesce(last_end, 0) AS last_end FROM f LEFT JOIN n USING (doc_id)""",
    "keyword_prefix_rank": _bm25(["ert", "rth"], extra=_prefix("text", "erth").replace("{", "{{").replace("}", "}}")).format(columns=""),
}
