"""Queries of the operators on text and vectors."""

from __future__ import annotations

from cairn.llm import common_form, hash_forest, leaks, near_duplicates, nearest, personal, tokenizer
from cairn.sources import table


def queries() -> dict:
    return {
        "p4_found": lambda s, d: near_duplicates.found(table(s, d, "memories")),
        "p4_classes": lambda s, d: near_duplicates.classes(table(s, d, "memories")),
        "p6_found": lambda s, d: hash_forest.found(table(s, d, "memories")),
        "p7_ids": lambda s, d: tokenizer.encode(table(s, d, "documents")),
        "p8_found": lambda s, d: leaks.found(table(s, d, "documents"), table(s, d, "eval_items")),
        "p9_found": lambda s, d: common_form.found(table(s, d, "documents")),
        "p2_found": lambda s, d: personal.found(table(s, d, "memories")),
        "p2_redacted": lambda s, d: personal.redact(table(s, d, "memories")),
        "p3_found": lambda s, d: nearest.found(table(s, d, "index_points"), table(s, d, "bootstrap_facts")),
        "p9_classes": lambda s, d: common_form.classes(table(s, d, "documents")),
        "p9_form": lambda s, d: common_form.forms(table(s, d, "documents")),
    }


P4_SQL = r"""
WITH w AS (SELECT DISTINCT mem_id, regexp_extract_all(lower(coalesce(description, '') || ' ' || body), '[\p{L}\p{N}]+') AS w FROM memories WHERE trim(body, E' \t\r\n') <> ''),
r AS (SELECT mem_id, list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS r FROM w WHERE len(w) >= 3),
f AS (SELECT mem_id, len(r) AS n, unnest(r) AS f FROM r),
c AS (SELECT a.mem_id AS mem_id_a, b.mem_id AS mem_id_b, a.n + b.n AS n, count(*) AS shared FROM f a JOIN f b ON a.f = b.f AND a.mem_id < b.mem_id GROUP BY ALL)
SELECT mem_id_a, mem_id_b FROM c WHERE 2 * shared >= n - shared
"""


P4_CLASSES_SQL = P4_SQL.replace("SELECT mem_id_a, mem_id_b FROM c WHERE 2 * shared >= n - shared", """, p AS (SELECT mem_id_a, mem_id_b FROM c WHERE 2 * shared >= n - shared),
k AS (SELECT mem_id, min(mem_id) OVER (PARTITION BY list_sort(r)) AS class_id, count(*) OVER (PARTITION BY list_sort(r)) AS size FROM r),
l AS (SELECT id, count(*) AS n FROM (SELECT mem_id_a AS id FROM p UNION ALL SELECT mem_id_b FROM p) GROUP BY id)
SELECT k.mem_id, class_id, size, coalesce(l.n, 0) AS links FROM k LEFT JOIN l ON l.id = k.mem_id""")
# judged one by one, in the order of ids: a state of one row holds the repeats so far
P6_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT DISTINCT mem_id, regexp_extract_all(lower(coalesce(name, '') || ' ' || body), '[\p{L}\p{N}]+') AS w FROM memories WHERE trim(body, E' \t\r\n') <> ''),
r AS MATERIALIZED (SELECT mem_id, list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS r FROM w WHERE len(w) >= 3),
f AS MATERIALIZED (SELECT mem_id, len(r) AS n, unnest(r) AS f FROM r),
c AS MATERIALIZED (SELECT a.mem_id AS a, b.mem_id AS b, a.n + b.n AS n, count(*) AS shared FROM f a JOIN f b ON a.f = b.f AND a.mem_id < b.mem_id GROUP BY ALL),
m AS MATERIALIZED (SELECT b, list(a ORDER BY a) AS near, row_number() OVER (ORDER BY b) AS i FROM c WHERE 2 * shared >= n - shared GROUP BY b),
j AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL
      SELECT m.i, CASE WHEN list_has_all(j.gone, m.near) THEN j.gone ELSE list_append(j.gone, m.b) END FROM j JOIN m ON m.i = j.i + 1),
l AS (SELECT gone FROM j ORDER BY i DESC LIMIT 1)
SELECT list_min(list_filter(near, lambda x: NOT list_contains(gone, x))) AS kept_id, b AS mem_id FROM m, l WHERE list_contains(gone, b)
"""


def oracle_sql() -> dict:
    return {"p4_found": P4_SQL, "p4_classes": P4_CLASSES_SQL, "p6_found": P6_SQL}
