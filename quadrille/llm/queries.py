"""Queries of the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op1_decontaminate
from .licenses import op6_licenses
from .neardup import op7_neardup
from .packing import op5_packing
from .quality import op3_quality
from .secrets import op9_secrets
from .sharding import op8_sharding
from .suffixdedup import op2_suffix_dedup
from .urlfilter import op10_urls
from .warc import op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_licenses": op6_licenses,
    "op7_neardup": op7_neardup,
    "op8_sharding": op8_sharding,
    "op9_secrets": op9_secrets,
    "op10_urls": op10_urls,
    "pipeline": corpus_pipeline.run,
}
#: Every 50-byte string of every text, as hex digits; the rest follows the contract word by word.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE m < doc_id),
b AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d)),
g AS (SELECT b.doc_id, i, x, max(p) OVER (PARTITION BY b.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM b LEFT JOIN hit ON hit.doc_id = b.doc_id AND hit.p = b.i),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS first FROM g),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE first) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

#: Base 32 takes five hex digits, 20 bits, as four characters.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, list_transform(range(0, 8), lambda g: ('0x' || substr(sha1(body), 5 * g + 1, 5))::BIGINT) AS v, min(page_id) OVER (PARTITION BY body) AS first FROM p),
c AS (SELECT *, array_to_string(list_transform(v, lambda n: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n >> 15 & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n >> 10 & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n >> 5 & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n & 31)::INT + 1, 1)), '') AS payload_digest FROM h)
SELECT page_id, strlen(body) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM c
"""

#: All pairs that share a shingle, then the smallest id reachable.
NEAR_DUPLICATES = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(min(reach.b), t.doc_id)) AS component_id, t.doc_id = least(t.doc_id, coalesce(min(reach.b), t.doc_id)) AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = t.doc_id GROUP BY t.doc_id, n.n
"""

ORACLES: dict[str, str] = {"op2_suffix_dedup": SUFFIX_DEDUP, "op4_warc": WARC, "op7_neardup": NEAR_DUPLICATES}
