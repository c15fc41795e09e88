"""The queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from .automaton import op8_substring_dedup
from .exact import op7_exact_dedup
from .mixing import op10_source_mixing
from .packing import op5_best_fit_packing
from .rules import op3_quality_classifier
from .simhash import op6_simhash_near_dedup
from .suffixes import op9_suffix_array_dedup
from .token_store import op2_token_store
from .topk import op4_exact_top_k
from .warc import op1_warc_bundles

QUERIES = {f.__name__: f for f in (
    op1_warc_bundles, op2_token_store, op3_quality_classifier, op4_exact_top_k, op5_best_fit_packing, op6_simhash_near_dedup,
    op7_exact_dedup, op8_substring_dedup, op9_suffix_array_dedup, op10_source_mixing)}

ORACLE_SQL = {
    "op1_warc_bundles": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS n, sha256(payload) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (digest)""",
    "op4_exact_top_k": """
WITH ok AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
      FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op7_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS digest FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY digest) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, digest AS text_sha256
FROM t WINDOW w AS (PARTITION BY digest ORDER BY n DESC, doc_id)""",
    "op8_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM g),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
gone AS (SELECT doc_id, i FROM k JOIN f USING (k) WHERE first < doc_id),
m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM gone),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM m),
s AS (SELECT doc_id, span, min(i) AS lo, max(i) + 49 AS hi FROM n GROUP BY doc_id, span),
c AS (SELECT doc_id, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his, sum(hi - lo + 1) AS n_removed FROM s GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN los IS NULL THEN ws ELSE flatten(list_transform(range(0, len(los) + 1), lambda j: ws[(CASE WHEN j = 0 THEN 1 ELSE his[j] + 1 END):(CASE WHEN j = len(los) THEN len(ws) ELSE los[j + 1] - 1 END)])) END, ' ')) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id)""",
    "op9_suffix_array_dedup": r"""
WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
b AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2098) AS h, least(n - o, 1049) AS n FROM (SELECT doc_id, h, n, unnest(range(0, n - 49, 1000)) AS o FROM w WHERE n >= 50)),
k AS (SELECT doc_id, o + i AS i, substr(h, 2 * i - 1, 100) AS k FROM (SELECT doc_id, o, h, unnest(range(1, n - 48)) AS i FROM b)),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
gone AS (SELECT doc_id, i FROM k JOIN f USING (k) WHERE first < doc_id),
m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM gone),
p AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM m),
s AS (SELECT doc_id, span, min(i) AS lo, max(i) + 49 AS hi FROM p GROUP BY doc_id, span),
c AS (SELECT doc_id, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT w.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN los IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(los) + 1), lambda j: h[(CASE WHEN j = 0 THEN 1 ELSE 2 * his[j] + 1 END):(CASE WHEN j = len(los) THEN 2 * n ELSE 2 * los[j + 1] - 2 END)]), '') END)) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id)""",
}
