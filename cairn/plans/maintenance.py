"""Freshness, pruning, repair, coverage and screening queries over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import curate, graph, maintain
from cairn.plans.curation import _ALL, _LATEST, _q, _whole
from cairn.plans.graph import _TRIPLES, _known
from cairn.sources import table
from cairn.sources.tables import epoch_us


def _mem(s, d):
    return table(s, d, "memories")


def _held(s, d):
    return curate.held(_mem(s, d), table(s, d, "trash"))


def _lines(s, d):
    lines = _mem(s, d).select("mem_id", F.posexplode(F.split(_whole(), "\n")).alias("pos", "line")).where(F.col("line").rlike(text.GUARD))
    return lines.groupBy("mem_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("pos") + 1)), ",").alias("lines"))


def _graph_tokens(s, d):
    return table(s, d, "eval_items").select("item_id", F.posexplode(text.graph_tokens(F.col("text"))).alias("pos", "token")).select("item_id", F.col("pos").cast("long").alias("pos"), "token")


def _inputs(s, d):
    """What would be embedded: name, description and the first 1,500 characters of the body, secrets masked."""
    body = F.substring(F.coalesce("body", F.lit("")), 1, 1500)
    whole = F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")), F.lit(" "), body)
    return curate.latest(_mem(s, d)).select("mem_id", F.sha1(text.redact(whole)).alias("input"))


def _idle(s, d):
    events = table(s, d, "events")
    now = events.agg(F.max(epoch_us("ts"))).first()[0] or 0
    return events.groupBy("user_id").agg(F.max(epoch_us("ts")).alias("last_us"), F.count("*").alias("n")).where(F.col("last_us") <= now - 30 * 60_000_000)


def queries() -> dict:
    return {
        "write_guard": _lines,
        "persist_patterns": lambda s, d: _mem(s, d).select("mem_id").where(text.matches("body", text.PERSIST)),
        "graph_tokens": _graph_tokens,
        "embedding_inputs": _inputs,
        "short_descriptions": lambda s, d: _mem(s, d).select("mem_id", text.shortened(F.col("description")).alias("short")),
        "reformat_candidates": lambda s, d: curate.latest(_mem(s, d)).select("mem_id", F.length("body").cast("long").alias("chars")).where((F.col("chars") >= 1_500)).join(curate.latest(_mem(s, d)).where(F.col("body").contains("## Summary") & F.col("body").contains("## Index")).select("mem_id"), "mem_id", "left_anti"),
        "content_freshness": lambda s, d: maintain.freshness(curate.latest(_mem(s, d)), table(s, d, "index_points")),
        "mtime_backfill": lambda s, d: maintain.mtime_changes(curate.latest(_mem(s, d)), _known(s, d)),
        "prune_stale": lambda s, d: maintain.orphaned_rows(_held(s, d), {"triples": table(s, d, "triples"), "bootstrap_facts": table(s, d, "bootstrap_facts").withColumnRenamed("memory_file", "file"), "index_points": table(s, d, "index_points")}),
        "live_edges": lambda s, d: graph.valid_wins(table(s, d, "legacy_facts")).where("open").select("slug", "file", "text"),
        "superseded_report": lambda s, d: graph.valid_wins(table(s, d, "legacy_facts")).where("not open").groupBy("slug", "file").agg(F.count("*").alias("superseded"), F.array_join(F.slice(F.array_sort(F.collect_set("text")), 1, 5), "; ").alias("first")),
        "edge_repair": lambda s, d: maintain.edge_repair(table(s, d, "legacy_facts").where("text is not null"), _held(s, d)),
        "isolated_entities": lambda s, d: maintain.isolated(_known(s, d)),
        "graph_stats": lambda s, d: _known(s, d).agg(F.count("*").alias("triples"), F.count_if(F.col("status") == "active").alias("active"), F.countDistinct("slug", "file").alias("files")),
        "project_inventory": lambda s, d: curate.latest(_mem(s, d)).groupBy("slug").agg(F.count("*").alias("files"), F.max("source_mtime").alias("last_mtime")),
        "sentence_coverage": lambda s, d: maintain.sentence_coverage(_mem(s, d)),
        "idle_sessions": _idle,
    }


def oracle_sql() -> dict:
    flat = r"trim(regexp_replace(coalesce({x}, ''), '[ \t\r\n]+', ' ', 'g'))"
    held = f"{_LATEST}, held AS (SELECT latest.* FROM latest LEFT JOIN (SELECT slug, file, max(deleted_at) AS gone FROM trash GROUP BY ALL) USING (slug, file) WHERE gone IS NULL OR gone <= synced_at)"
    wins = "wins AS (SELECT slug, file, text, bool_or(valid_until IS NULL) AS open FROM (SELECT *, max(snapshot_at) OVER (PARTITION BY slug, file) AS last FROM legacy_facts) WHERE snapshot_at = last GROUP BY slug, file, text)"
    secret = _q(text.SECRET.replace(r"\x22", '"'))
    return {
        "write_guard": f"SELECT mem_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS lines FROM (SELECT mem_id, unnest(string_split(x, E'\\n')) AS line, generate_subscripts(string_split(x, E'\\n'), 1) AS i FROM (SELECT mem_id, {_ALL} AS x FROM memories)) WHERE regexp_matches(line, {_q(text.GUARD)}) GROUP BY mem_id",
        "persist_patterns": f"SELECT mem_id FROM memories WHERE regexp_matches(coalesce(body, ''), {_q(text.PERSIST)})",
        "graph_tokens": r"SELECT item_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT item_id, list_slice(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i), 1, 32) AS t FROM (SELECT item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{N}_-]+'), lambda x: strlen(x) >= 4) AS w FROM eval_items))",
        "embedding_inputs": f"WITH {_LATEST} SELECT mem_id, sha1(regexp_replace(coalesce(name, '') || ' ' || coalesce(description, '') || ' ' || substring(coalesce(body, ''), 1, 1500), {secret}, '{text.MASK}', 'g')) AS input FROM latest",
        "short_descriptions": f"SELECT mem_id, CASE WHEN length(f) > 60 THEN rtrim(substring(f, 1, 59)) || '…' ELSE f END AS short FROM (SELECT mem_id, {flat.format(x='description')} AS f FROM memories)",
        "reformat_candidates": f"WITH {_LATEST} SELECT mem_id, length(body) AS chars FROM latest WHERE length(body) >= 1500 AND NOT (contains(body, '## Summary') AND contains(body, '## Index'))",
        "content_freshness": f"""WITH {_LATEST}, p AS (SELECT slug, file, unnest(r) FROM (SELECT slug, file, arg_max(struct_pack(sha := sha, space := space), (updated_at, point_id)) AS r FROM index_points GROUP BY slug, file)),
m AS (SELECT l.slug, l.file, p.space, p.sha, sha256(p.space || chr(1) || coalesce(name, '') || chr(1) || coalesce(description, '') || chr(1) || coalesce(body, '')) AS now FROM latest l LEFT JOIN p ON l.slug = p.slug AND l.file = p.file)
SELECT slug, file, CASE WHEN space IS NULL THEN 'missing' WHEN sha IS NULL THEN 'unknown' WHEN sha = now THEN 'current' ELSE 'stale' END AS state, now FROM m""",
        "mtime_backfill": f"WITH {_TRIPLES}, {_LATEST}, k AS (SELECT slug, file, max(source_mtime) AS old FROM known GROUP BY ALL) SELECT slug, file, old, source_mtime AS new FROM k JOIN latest USING (slug, file) WHERE source_mtime IS NOT NULL AND source_mtime <> old",
        "prune_stale": f"WITH {held}, x AS (SELECT 'triples' AS source, slug, file FROM triples UNION ALL SELECT 'bootstrap_facts', slug, memory_file FROM bootstrap_facts UNION ALL SELECT 'index_points', slug, file FROM index_points) SELECT source, slug, file, count(*) AS n FROM x WHERE slug IS NOT NULL AND file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held h WHERE h.slug = x.slug AND h.file = x.file) GROUP BY ALL",
        "live_edges": f"WITH {wins} SELECT slug, file, text FROM wins WHERE open",
        "superseded_report": f"WITH {wins} SELECT slug, file, count(*) AS superseded, array_to_string(list_slice(list_sort(list(DISTINCT text)), 1, 5), '; ') AS first FROM wins WHERE NOT open GROUP BY ALL",
        "edge_repair": f"""WITH {held}, e AS (SELECT DISTINCT f.slug, f.text, f.file, h.file IS NOT NULL AS alive FROM legacy_facts f LEFT JOIN held h ON h.slug = f.slug AND h.file = f.file WHERE f.text IS NOT NULL)
SELECT slug, text, CASE WHEN bool_or(alive) THEN 'trim' ELSE 'delete' END AS action, count(*) FILTER (WHERE NOT alive) AS dead, count(*) FILTER (WHERE alive) AS alive FROM e GROUP BY slug, text HAVING count(*) FILTER (WHERE NOT alive) > 0""",
        "isolated_entities": f"WITH {_TRIPLES}, n AS (SELECT DISTINCT slug, unnest([subject, object]) AS entity, status FROM known) SELECT slug, entity FROM n GROUP BY ALL HAVING NOT bool_or(status = 'active')",
        "graph_stats": f"WITH {_TRIPLES} SELECT count(*) AS triples, count(*) FILTER (WHERE status = 'active') AS active, count(DISTINCT (slug, file)) AS files FROM known",
        "project_inventory": f"WITH {_LATEST} SELECT slug, count(*) AS files, max(source_mtime) AS last_mtime FROM latest GROUP BY slug",
        "sentence_coverage": r"""WITH v AS (SELECT mem_id, body, lag(mem_id) OVER w AS before, lag(body) OVER w AS old FROM memories WINDOW w AS (PARTITION BY slug, file ORDER BY synced_at, mem_id)),
p AS (SELECT mem_id, body, trim(regexp_replace(unnest(regexp_split_to_array(coalesce(old, ''), '\n[ \t\r\n]*\n')), '[ \t\r\n]+', ' ', 'g')) AS x FROM v WHERE before IS NOT NULL),
t AS (SELECT mem_id, body, trim(regexp_replace(trim(unnest(string_split(regexp_replace(x, '([.!?]) +', E'\\1\n', 'g'), E'\n'))), '^[-*# ]+', '')) AS s FROM p),
c AS (SELECT mem_id, regexp_replace(lower(coalesce(body, '')), '[^a-z0-9]', '', 'g') AS hay, left(regexp_replace(lower(s), '[^a-z0-9]', '', 'g'), 60) AS probe FROM t WHERE length(s) >= 25)
SELECT mem_id, count(*) AS sentences, count(*) FILTER (WHERE probe <> '' AND contains(hay, probe)) AS covered, round(count(*) FILTER (WHERE probe <> '' AND contains(hay, probe)) / count(*), 4) AS coverage FROM c GROUP BY mem_id""",
        "idle_sessions": "SELECT user_id, epoch_us(max(ts)) AS last_us, count(*) AS n FROM events GROUP BY user_id HAVING max(ts) <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE",
    }
