"""Queries p1 (history) and p5 (orphans), with their SQL."""

from __future__ import annotations

from cairn.operators import history, orphans
from cairn.sources import table

P1_SQL = r"""
WITH t0 AS (
  SELECT slug, file, coalesce(lower(trim(subject, E' \t\r\n')),'') || '|' || coalesce(translate(lower(trim(relation, E' \t\r\n')), '- ', '__'),'') AS attr,
         source_mtime AS ts, update_id, lower(trim(object, E' \t\r\n')) AS o,
         coalesce(lower(trim(temporal, E' \t\r\n')),'') IN ('formerly','historical','past') AS c
  FROM triples WHERE object IS NOT NULL AND source_mtime IS NOT NULL),
t1 AS (SELECT slug, file, attr, ts, arg_max(CASE WHEN c THEN 'closed|' ELSE 'open|' END || o, update_id) AS state FROM t0 GROUP BY ALL),
t2 AS (SELECT *, lag(state) OVER w AS before FROM t1 WINDOW w AS (PARTITION BY slug, file, attr ORDER BY ts)),
t3 AS (SELECT slug, file, attr, ts AS valid_from, coalesce(lead(ts) OVER (PARTITION BY slug, file, attr ORDER BY ts), -1) AS valid_to
       FROM t2 WHERE before IS DISTINCT FROM state),
f0 AS (SELECT slug, file, text AS attr, epoch_us(snapshot_at)//1000000 AS ts,
         CASE WHEN valid_until IS NULL THEN '~live' ELSE CAST(epoch_us(CAST(CASE WHEN regexp_matches(valid_until,'(Z|[+-]\d\d:?\d\d)$') THEN valid_until ELSE valid_until || 'Z' END AS TIMESTAMPTZ)) AS VARCHAR) END AS s
       FROM legacy_facts),
f1 AS (SELECT slug, file, attr, ts, max(s) AS state FROM f0 WHERE attr IS NOT NULL GROUP BY ALL),
cal AS (SELECT slug, file, ts, row_number() OVER (PARTITION BY slug, file ORDER BY ts) AS pos, lead(ts) OVER (PARTITION BY slug, file ORDER BY ts) AS nxt
        FROM (SELECT DISTINCT slug, file, ts FROM f0)),
f2 AS (SELECT f1.*, cal.pos, cal.nxt FROM f1 JOIN cal ON f1.slug IS NOT DISTINCT FROM cal.slug AND f1.file IS NOT DISTINCT FROM cal.file AND f1.ts = cal.ts),
f3 AS (SELECT *, lag(state) OVER w AS before, lag(pos) OVER w AS bpos FROM f2 WINDOW w AS (PARTITION BY slug, file, attr ORDER BY pos)),
f4 AS (SELECT *, sum(CASE WHEN bpos = pos - 1 AND before IS NOT DISTINCT FROM state THEN 0 ELSE 1 END) OVER (PARTITION BY slug, file, attr ORDER BY pos) AS run FROM f3),
f5 AS (SELECT slug, file, attr, min(ts) AS valid_from, coalesce(arg_max(coalesce(nxt, -1), pos), -1) AS valid_to FROM f4 GROUP BY slug, file, attr, run)
SELECT 'triple' AS src, slug, file, attr, valid_from, valid_to FROM t3
UNION ALL SELECT 'fact', slug, file, attr, valid_from, valid_to FROM f5
"""

P5_SQL = r"""
WITH refs AS (
  SELECT DISTINCT 'recall_hits' AS ref_table, hit_id AS ref_id, slug,
         trim(regexp_replace(trim(file, E' \t\r\n'), '^\./', ''), E' \t\r\n') AS target, recalled_at AS ts
  FROM recall_hits
  UNION
  SELECT DISTINCT 'memories', mem_id, slug, CASE WHEN ends_with(x, '.md') THEN x ELSE x || '.md' END, synced_at FROM (
    SELECT mem_id, slug, synced_at, trim(unnest(regexp_extract_all(
      regexp_replace(regexp_replace(body, '(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\z)', ' ', 'g'), '`[^`]*`', ' ', 'g'),
      '\[\[([^\]\|#]+)(?:[\|#][^\]]*)?\]\]', 1)), E' \t\r\n') AS x
    FROM memories) WHERE x <> ''),
ev AS (SELECT slug, file, synced_at AS ts, 1 AS held FROM memories UNION ALL SELECT slug, file, deleted_at, 0 FROM trash),
st AS (SELECT r.ref_table, r.ref_id, r.target, r.ts,
         max(CASE WHEN e.ts <= r.ts THEN epoch_us(e.ts) * 2 + e.held END) AS last,
         min(CASE WHEN e.held = 1 THEN e.ts END) AS first
       FROM refs r LEFT JOIN ev e ON e.slug = r.slug AND e.file = r.target
       WHERE r.target <> '' AND r.ts IS NOT NULL GROUP BY ALL)
SELECT ref_table, ref_id, target, strftime(ts, '%Y-%m') AS period,
       CASE WHEN first IS NULL THEN 'missing' WHEN first > ts THEN 'late' ELSE 'deleted' END AS reason
FROM st WHERE coalesce(last, 0) % 2 = 0
"""


def queries() -> dict:
    return {
        "p1_found": lambda s, d: history.found(table(s, d, "triples"), table(s, d, "legacy_facts")),
        "p5_found": lambda s, d: orphans.found(table(s, d, "recall_hits"), table(s, d, "memories"), table(s, d, "trash")),
        "p5_report": lambda s, d: orphans.report(table(s, d, "recall_hits"), table(s, d, "memories"), table(s, d, "trash")),
    }


def oracle_sql() -> dict:
    return {"p1_found": P1_SQL, "p5_found": P5_SQL}
