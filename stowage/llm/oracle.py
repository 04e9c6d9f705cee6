"""The queries that SQL can express, for DuckDB."""

from stowage.llm.licenses import TEMPLATES

_TEMPLATES = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
_WORDS = "string_split(trim(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
_SHINGLES = "unnest(range(len(w) - 4)) AS k"

ORACLE = {
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        ), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        g AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1),
        j AS (SELECT d.*, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM d LEFT JOIN g USING (payload_digest))
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j
    """,
    "op8_licenses": f"""
        WITH t AS (SELECT template, license, {_WORDS} AS w FROM (VALUES {_TEMPLATES}) v(template, license, text)),
        ts AS (SELECT DISTINCT template, license, w[k + 1:k + 5] AS s FROM (SELECT *, {_SHINGLES} FROM t)),
        n AS (SELECT template, count(*) AS total FROM ts GROUP BY 1),
        d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS} AS w FROM documents),
        ds AS (SELECT uid, doc_id, k, w[k + 1:k + 5] AS s FROM (SELECT *, {_SHINGLES} FROM d)),
        h AS (
            SELECT uid, doc_id, template, license, total, count(DISTINCT s) AS n_shingles, min(k)::INT AS first_word, (max(k) + 5)::INT AS last_word
            FROM ds JOIN ts USING (s) JOIN n USING (template) GROUP BY ALL
        ), r AS (
            SELECT *, n_shingles / total AS containment,
                row_number() OVER (PARTITION BY uid, license ORDER BY n_shingles / total DESC, n_shingles DESC, template) AS place
            FROM h WHERE n_shingles / total >= 0.8
        )
        SELECT doc_id, license, containment, n_shingles, first_word, last_word FROM r WHERE place = 1
    """,
    "op11_neighbours": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), p AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id,
                list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
            FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
        ), n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM p)
        SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 5
    """,
}
