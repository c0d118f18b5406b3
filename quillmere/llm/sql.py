"""DuckDB SQL of the queries that it can express: plain definitions over all windows, with none of the operators' methods."""

from __future__ import annotations

from quillmere.llm.licenses import LOWER, UPPER, WORD
from quillmere.llm.licenses import sql as licenses_sql

FOLDED = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"

#: Words of 35-word windows that start twice or more anywhere.
SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
win AS (SELECT doc_id, i, array_to_string(t[i : i + 34], ' ') AS s FROM w, unnest(range(1, len(t) - 33)) AS u(i)),
hit AS (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
cov AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM hit) GROUP BY doc_id),
place AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM place LEFT JOIN (SELECT doc_id, unnest(gone) AS p, true AS out FROM cov) USING (doc_id, p) WHERE out IS NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: Bytes of 50-byte strings that also start in a smaller document; texts as hexadecimal digits, two a byte.
SUFFIXES = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM h, unnest(range(1, len(h) // 2 - 48)) AS u(i)),
low AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS fresh FROM win JOIN low USING (s) WHERE doc_id > m),
run AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS b FROM (SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit) GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
cut AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS head FROM gap JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM h LEFT JOIN cut USING (doc_id)"""

#: Occurrences of the items' windows; containment of an item's text: its distinct windows that start within as many words as it has.
BENCHMARK = f"""
WITH dw AS (SELECT doc_id, {FOLDED} AS t FROM documents),
iw AS (SELECT row_number() OVER () AS no, CAST(item_id AS VARCHAR) AS item, {FOLDED} AS t FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT no, item, array_to_string(t[i : i + 7], ' ') AS s, least(len(t), 8) AS n, greatest(len(t) - 7, 1) AS span FROM iw, unnest(range(1, greatest(len(t) - 7, 1) + 1)) AS u(i) WHERE len(t) > 0),
occ AS (SELECT doc_id, i, n, array_to_string(t[i : i + n - 1], ' ') AS s FROM dw, (SELECT DISTINCT n FROM win), unnest(range(1, len(t) - n + 2)) AS u(i)),
hit AS (SELECT doc_id, i, n, s, item, no, span FROM occ JOIN win USING (s, n)),
total AS (SELECT no, count(*) AS total FROM win GROUP BY no),
best AS (SELECT doc_id, max(c / total) AS containment FROM (SELECT a.doc_id, a.no, a.i, count(DISTINCT b.s) AS c FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.no = b.no AND b.i >= a.i AND b.i < a.i + a.span GROUP BY ALL) JOIN total USING (no) GROUP BY doc_id),
cov AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
met AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= 2 AS contaminated, coalesce(containment, 0.0) AS containment FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN met USING (doc_id) LEFT JOIN best USING (doc_id)"""

SQL = {"op1_substring_dedup": SUBSTRINGS, "op4_suffix_dedup": SUFFIXES, "op7_license_scan": licenses_sql(), "op8_decontaminate": BENCHMARK}
