"""Registered queries of the subpackage and their DuckDB SQL (where SQL can say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from txnclean.llm.byte_bpe import op13_byte_bpe
from txnclean.llm.decontamination import op3_decontamination
from txnclean.llm.edit_fingerprints import op2_edit_fingerprints
from txnclean.llm.html_extraction import op1_html_extraction
from txnclean.llm.jaccard_join import op5_jaccard_join
from txnclean.llm.packing import op6_best_fit_packing
from txnclean.llm.secrets import op10_secret_scans
from txnclean.llm.substring_dedup import op8_substring_dedup
from txnclean.llm.token_alignment import op12_token_alignment
from txnclean.llm.token_counts import op9_token_counts
from txnclean.llm.toxicity import op7_toxicity
from txnclean.llm.warc import op4_warc
from txnclean.llm.whitening import op11_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_edit_fingerprints": op2_edit_fingerprints,
    "op3_decontamination": op3_decontamination,
    "op4_warc": op4_warc,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_toxicity": op7_toxicity,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_secret_scans": op10_secret_scans,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_token_alignment": op12_token_alignment,
    "op13_byte_bpe": op13_byte_bpe,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[a-z0-9]|[^\x00-\x7f])+')"

ORACLES: dict[str, str] = {
    "op3_decontamination": f"""
WITH i AS (SELECT row_number() OVER () AS r, item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT DISTINCT r, item_id, least(len(w), 5) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2),
        lambda p: array_to_string(w[p:p + least(len(w), 5) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
d AS (SELECT row_number() OVER () AS q, doc_id, {_WORDS} AS w FROM documents),
k AS (SELECT DISTINCT k FROM s),
t AS (SELECT DISTINCT q, doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g
      FROM d, k WHERE len(w) >= k)
SELECT s.item_id, t.doc_id, max(n.n) AS n_shingles, count(*) AS n_common, CAST(count(*) AS DOUBLE) / max(n.n) AS containment
FROM s JOIN t ON s.k = t.k AND s.g = t.g JOIN n ON n.r = s.r
GROUP BY s.r, s.item_id, t.q, t.doc_id HAVING 5 * count(*) >= 4 * max(n.n)""",
    "op4_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_page FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_page IS NOT NULL AND page_id IS DISTINCT FROM first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_page THEN first_page END AS refers_to FROM f""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL),
h AS (SELECT r, doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM g),
m AS (SELECT g, min(doc_id) AS first_doc FROM h GROUP BY g),
c AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS p FROM h JOIN m USING (g) WHERE first_doc < doc_id),
x AS (SELECT r, list(p) AS gone FROM c GROUP BY r),
k AS (SELECT d.r, doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
             list_filter(w, lambda v, i: gone IS NULL OR NOT list_contains(gone, i)) AS kept FROM d LEFT JOIN x ON d.r = x.r)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
}
