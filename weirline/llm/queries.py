"""The operators applied to their whole tables, by query name, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    alignment,
    bit_slices,
    decontaminate,
    language,
    near_join,
    packing,
    prefix_forest,
    recompression,
    secrets,
    spelling,
    suffix_arrays,
    surrogates,
    token_files,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_language_id": language.report,
    "op2_substring_dedup": recompression.report,
    "op3_ngram_jaccard_join": near_join.report,
    "op4_best_fit_packing": packing.report,
    "op5_token_files": token_files.report,
    "op6_secret_scans": secrets.report,
    "op7_nearest_neighbours": prefix_forest.report,
    "op8_pii_surrogates": surrogates.report,
    "op9_benchmark_decontamination": decontaminate.report,
    "op10_suffix_array_dedup": suffix_arrays.report,
    "op11_bit_sliced_top_k": bit_slices.report,
    "op12_spelling_variants": spelling.report,
    "op13_token_alignment": alignment.report,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP2 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
),
twice AS (SELECT k FROM windows GROUP BY k HAVING COUNT(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM windows JOIN twice USING (k), range(35) t(o)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT doc_id, COUNT(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN NULL ELSE list_sort(list_distinct(list_transform(
    range(1, greatest(1, len(ws) - 4) + 1), lambda i: array_to_string(ws[i : i + 4], ' ')))) END AS grams
  FROM w
),
named AS (SELECT doc_id, grams, coalesce(md5(array_to_string(grams, chr(10))), 'none' || doc_id) AS k FROM sets),
classes AS (
  SELECT k, MIN(doc_id) AS class_id, COUNT(*) AS n_copies, any_value(grams) AS grams FROM named GROUP BY k
),
grams AS (SELECT class_id, len(grams) AS n, unnest(grams) AS gram FROM classes),
links AS (
  SELECT a.class_id AS x, b.class_id AS y
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.class_id <> b.class_id
  GROUP BY a.class_id, b.class_id, a.n, b.n
  HAVING COUNT(*) * 5 >= 4 * (a.n + b.n - COUNT(*))
),
reached AS (
  SELECT class_id AS x, class_id AS y FROM classes
  UNION
  SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
),
groups AS (SELECT x AS class_id, MIN(y) AS group_id FROM reached GROUP BY x),
counted AS (SELECT x AS class_id, COUNT(*) AS n_links FROM links GROUP BY x)
SELECT doc_id, class_id, n_copies, coalesce(n_links, 0) AS n_links, group_id
FROM named JOIN classes USING (k) JOIN groups USING (class_id) LEFT JOIN counted USING (class_id)
"""

_ITEM_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_OP9 = f"""
WITH items AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
wanted AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM items WHERE len(ws) > 0)
),
w AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
found AS (
  SELECT doc_id, i, n, item_id
  FROM (
    SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS k
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM wanted))
  ) JOIN wanted USING (n, k)
),
hits AS (
  SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
),
listed AS (
  SELECT doc_id, COUNT(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

_OP11 = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER best)::INTEGER AS rank, vec_id, score
FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5
"""

ORACLE: dict[str, str] = {
    "op2_substring_dedup": _OP2,
    "op3_ngram_jaccard_join": _OP3,
    "op9_benchmark_decontamination": _OP9,
    "op11_bit_sliced_top_k": _OP11,
}
