"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

WARC_REVISITS = """
WITH hashed AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), digested AS (
    SELECT page_id, payload_bytes, hex, max(page_id) OVER (PARTITION BY hex) AS origin,
        array_to_string([
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)
            FOR i IN range(32)], '') AS payload_digest
    FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = origin THEN NULL ELSE origin END AS refers_to
FROM digested
"""

PARITY_SKETCH_JOIN = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, unnest([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, greatest(len(words) - 3, 1) + 1)]) AS s FROM split WHERE len(words) > 0
), sized AS (
    SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
    SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id
FROM documents d LEFT JOIN sized USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_warc_revisits": WARC_REVISITS, "op7_parity_sketch_join": PARITY_SKETCH_JOIN}
