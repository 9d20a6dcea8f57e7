"""Graph, score, incremental and streaming queries over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import curate, graph, score
from cairn.sources import table
from cairn.sources.tables import epoch_us, materialize
from cairn.streaming import events as streams

#: The time that ages are counted from (epoch seconds), so that results do not change from run to run.
NOW = 1_760_000_000


def _known(s, d):
    return graph.triples(table(s, d, "triples"))


def _store(s, d):
    return curate.latest(table(s, d, "memories"))


def _asked(s, d):
    names = table(s, d, "memories").where("mem_id % 20 = 0").select(F.col("mem_id").alias("query"), "slug", F.explode(F.split(F.lower(F.concat_ws(" ", "name", "description", "body")), r"[^a-z0-9-]+")).alias("token"))
    return names.where("length(token) >= 4")


def _frequency(s, d):
    rows = table(s, d, "memories").select(F.col("mem_id").alias("id"), score.keywords(F.col("file"), F.col("name"), F.col("description")).alias("words"))
    return score.distinctive_frequency(rows, table(s, d, "documents").select(score.session_tokens(F.col("text")).alias("tokens")))


def _fixation(s, d):
    freq = materialize(_frequency(s, d).withColumnRenamed("id", "mem_id"), "freq")
    came = table(s, d, "memories").groupBy("slug", "file").agg((F.count("*") - 1).alias("survival"))
    rows = _store(s, d).join(came, ["slug", "file"]).join(freq, "mem_id")
    age = F.when(F.col("source_mtime").isNull(), F.lit(0.0)).otherwise((F.lit(NOW) - F.col("source_mtime")) / 86_400.0)
    rows = rows.select("mem_id", age.alias("age_days"), "freq", "survival", _suspicion(age).alias("suspicion"))
    return score.fixation(rows, score.nearest_rank(freq, "freq", 90, 40.0)).select("mem_id", "freq", "survival", "confidence", "status", "review_days")


def _suspicion(age):
    """A young text that nothing bears out and that wants to stay; one that a graduation let in is exempt."""
    wants = text.matches("body", text.PERSIST) & ~F.lower(F.coalesce("body", F.lit(""))).contains("auto-graduated")
    return wants & (F.col("survival") == 0) & (F.col("freq") <= 1) & (age <= 7)


def _merge_points(s, d):
    """Upsert: of several points of a (slug, file), the last by updated_at, then point_id."""
    return table(s, d, "index_points").groupBy("slug", "file").agg(F.max_by(F.struct("point_id", "sha", "space"), F.struct(epoch_us("updated_at").alias("t"), "point_id")).alias("r")).select("slug", "file", "r.point_id", "r.sha", "r.space")


def _snapshot_actions(s, d):
    """Between the last two snapshots: texts added, removed, closed, reopened or kept, by file, for files that both read."""
    facts = table(s, d, "legacy_facts")
    last = facts.agg(F.max("snapshot_no")).first()[0]
    if last is None:
        last = 0
    one = lambda n, tag: facts.where(F.col("snapshot_no") == n).groupBy("slug", "file", "text").agg(F.bool_or(F.col("valid_until").isNull()).alias(tag))
    files = facts.where(F.col("snapshot_no") == last).select("slug", "file").distinct().intersect(facts.where(F.col("snapshot_no") == last - 1).select("slug", "file").distinct())
    both = one(last - 1, "was").join(one(last, "now"), ["slug", "file", "text"], "full_outer").join(files, ["slug", "file"], "left_semi")
    action = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") & ~F.col("now"), "closed").when(~F.col("was") & F.col("now"), "reopened").otherwise("kept")
    return both.groupBy("slug", action.alias("action")).agg(F.count("*").alias("n"))


def _sessions(s, d):
    out = streams.sessions(table(s, d, "events"), "ts", ["user_id"], "30 minutes")
    return out.select("user_id", epoch_us("start").alias("start_us"), epoch_us("end").alias("end_us"), "n")


def _salience(s, d):
    known = _known(s, d)
    return graph.salience(_store(s, d), known, graph.hits_by_file(table(s, d, "recall_hits")), graph.supersede(known), NOW)


def queries() -> dict:
    return {
        "triple_status": lambda s, d: _known(s, d).select("slug", "file", "key", "status"),
        "status_distribution": lambda s, d: _known(s, d).groupBy("relation", "status").agg(F.count("*").alias("n")),
        "supersession_apply": lambda s, d: graph.supersede(_known(s, d)),
        "neighbours": lambda s, d: graph.ends(_known(s, d)),
        "neighbour_counts": lambda s, d: graph.degrees(_known(s, d)),
        "valid_wins": lambda s, d: graph.valid_wins(table(s, d, "legacy_facts")),
        "facts_for_tokens": lambda s, d: graph.token_facts(_known(s, d), _asked(s, d)),
        "keyword_files": lambda s, d: graph.hits_by_file(table(s, d, "recall_hits")),
        "shared_entities": lambda s, d: graph.shared_entities(_known(s, d)),
        "salience": _salience,
        "distinct_frequency": lambda s, d: _frequency(s, d).withColumnRenamed("id", "mem_id"),
        "fixation_scores": _fixation,
        "merge_points": _merge_points,
        "snapshot_actions": _snapshot_actions,
        "first_recall": lambda s, d: graph.first_per_session(table(s, d, "recall_hits").where("file is not null").select("hit_id", "query_id", "slug", "file", "recalled_at"), ["query_id", "slug", "file"], ["recalled_at"], "hit_id").select("query_id", "slug", "file", "hit_id"),
        "session_windows": _sessions,
        "stream_event_counts": lambda s, d: streams.counts(streams.read_stream(s, d, "events"), ["event_type"], n=F.count("*"), users=F.approx_count_distinct("user_id", 0.01)).select("event_type", "n"),
        "stream_daily_windows": lambda s, d: streams.windows(streams.read_stream(s, d, "events"), "ts", ["event_type"], "1 day").select(epoch_us("start").alias("start_us"), "event_type", "n"),
        "once_only_events": lambda s, d: streams.once_only(streams.read_stream(s, d, "events"), "ts", ["user_id", "event_type"], "60 days"),
        "digest_last_7d": lambda s, d: table(s, d, "events").where(epoch_us("ts") >= (table(s, d, "events").agg(F.max(epoch_us("ts"))).first()[0] or 0) - 7 * 86_400_000_000).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")),
    }


_TRIPLES = r"""t0 AS (SELECT slug, file, update_id, lower(trim(coalesce(subject, ''), E' \t\r\n')) AS subject, translate(lower(trim(coalesce(relation, ''), E' \t\r\n')), '- ', '__') AS relation, lower(trim(coalesce(object, ''), E' \t\r\n')) AS object,
  greatest(0.0, least(1.0, coalesce(confidence, 0.0))) AS confidence, lower(trim(coalesce(temporal, ''), E' \t\r\n')) AS temporal, coalesce(source_mtime, 0) AS source_mtime FROM triples),
t1 AS (SELECT *, subject || '|' || relation || '|' || object AS key, row_number() OVER (PARTITION BY slug, file, subject || '|' || relation || '|' || object ORDER BY source_mtime DESC, update_id DESC) AS rn FROM t0
  WHERE relation IN ('belongs_to','conflicts_with','connects_to','depends_on','hosts','implements','owns','provides','runs_on','supersedes','uses') AND subject <> '' AND object <> ''),
known AS (SELECT slug, file, key, subject, relation, object, source_mtime, CASE WHEN confidence < 0.7 THEN 'quarantined' WHEN temporal IN ('formerly','historical','past') THEN 'historical' ELSE 'active' END AS status FROM t1 WHERE rn = 1),
live AS (SELECT * FROM known WHERE status = 'active'),
retired AS (SELECT DISTINCT p.slug, p.file, p.key FROM live p JOIN live q ON q.relation = 'supersedes' AND p.relation <> 'supersedes' AND p.slug = q.slug AND p.object = q.object AND p.file <> q.file AND (p.source_mtime < q.source_mtime OR (p.source_mtime = q.source_mtime AND p.file < q.file))),
ends AS (SELECT DISTINCT slug, subject AS entity, relation, object AS other FROM live UNION SELECT DISTINCT slug, object, '~' || relation, subject FROM live)"""
_HITS = r"""h0 AS (SELECT hit_id, query_id, slug, trim(regexp_replace(trim(file, E' \t\r\n'), '^\./', ''), E' \t\r\n') AS file, score, facts FROM recall_hits),
h1 AS (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY slug, file) AS rn FROM h0 WHERE file <> ''),
hits AS (SELECT slug, file, count(*) AS hits, count(DISTINCT query_id) AS queries, round(max(score), 6) AS best FROM h1 WHERE rn = 1 GROUP BY ALL),
hf AS (SELECT slug, file, count(DISTINCT fact) AS facts FROM (SELECT slug, file, unnest(facts) AS fact FROM h1 WHERE rn = 1) GROUP BY ALL)"""
_FREQ = r"""kw AS (SELECT mem_id, unnest(list_slice(w, 1, 16)) AS term FROM (SELECT mem_id, list_filter(list_transform(
   list_concat(list_concat(regexp_split_to_array(regexp_replace(file, '\.md$', ''), '[_-]'), regexp_extract_all(coalesce(name, ''), '[A-Za-z][A-Za-z0-9_.-]{4,}')), regexp_extract_all(coalesce(description, ''), '[A-Za-z][A-Za-z0-9_.-]{4,}')), lambda x: lower(x)), lambda x: length(x) >= 4 AND NOT list_contains({stop}, x)) AS w0,
   list_filter(w0, lambda x, i: list_position(w0, x) = i) AS w FROM memories)),
ses AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9_.-]{3,}'))) AS term FROM documents),
dfq AS (SELECT term, count(*) AS df FROM ses WHERE NOT list_contains({stop}, term) GROUP BY term HAVING count(*) <= greatest(1, floor(0.1 * (SELECT count(*) FROM documents)))),
freq AS (SELECT m.mem_id, coalesce(max(df), 0) AS freq FROM memories m LEFT JOIN kw USING (mem_id) LEFT JOIN dfq USING (term) GROUP BY m.mem_id)""".replace("{stop}", str(text.STOPWORDS))


def oracle_sql() -> dict:
    from cairn.plans import curation
    from cairn.plans.curation import _LATEST

    return {
        "triple_status": f"WITH {_TRIPLES} SELECT slug, file, key, status FROM known",
        "status_distribution": f"WITH {_TRIPLES} SELECT relation, status, count(*) AS n FROM known GROUP BY ALL",
        "supersession_apply": f"WITH {_TRIPLES} SELECT * FROM retired",
        "neighbours": f"WITH {_TRIPLES} SELECT * FROM ends",
        "neighbour_counts": f"WITH {_TRIPLES} SELECT slug, entity, count(*) AS n, count(DISTINCT other) AS others FROM ends GROUP BY ALL",
        "valid_wins": "SELECT slug, file, text, bool_or(valid_until IS NULL) AS open FROM (SELECT *, max(snapshot_at) OVER (PARTITION BY slug, file) AS last FROM legacy_facts) WHERE snapshot_at = last GROUP BY slug, file, text",
        "facts_for_tokens": rf"""WITH {_TRIPLES}, asked AS (SELECT DISTINCT query, slug, token FROM (SELECT mem_id AS query, slug, unnest(regexp_split_to_array(lower(concat_ws(' ', name, description, body)), '[^a-z0-9-]+')) AS token FROM memories WHERE mem_id % 20 = 0) WHERE length(token) >= 4)
SELECT DISTINCT query, a.slug, subject || ' ' || relation || ' ' || object AS fact FROM asked a JOIN live l ON a.slug = l.slug AND (a.token = l.subject OR a.token = l.object)""",
        "keyword_files": f"WITH {_HITS} SELECT slug, file, hits, queries, coalesce(facts, 0) AS facts, best FROM hits LEFT JOIN hf USING (slug, file)",
        "shared_entities": f"""WITH {_TRIPLES}, named AS (SELECT DISTINCT slug, file, unnest([subject, object]) AS entity FROM live), nf AS (SELECT slug, count(DISTINCT file) AS files FROM named GROUP BY slug),
useful AS (SELECT * FROM named JOIN (SELECT slug, entity FROM named JOIN nf USING (slug) GROUP BY slug, entity, files HAVING count(*) <= greatest(8, files // 50)) USING (slug, entity))
SELECT a.slug, a.file, b.file AS other, count(*) AS shared FROM useful a JOIN useful b ON a.slug = b.slug AND a.entity = b.entity AND a.file < b.file GROUP BY ALL""",
        "salience": f"""WITH {_TRIPLES}, {_HITS}, {_LATEST}, r AS (SELECT l.slug, l.file, l.source_mtime, coalesce(d.n, 0) AS deg, coalesce(h.hits, 0) AS rec, coalesce(x.n, 0) AS sup FROM latest l LEFT JOIN (SELECT slug, file, count(*) AS n FROM live GROUP BY ALL) d USING (slug, file)
LEFT JOIN hits h USING (slug, file) LEFT JOIN (SELECT slug, file, count(*) AS n FROM retired GROUP BY ALL) x USING (slug, file)), mx AS (SELECT max(deg) AS dm, max(rec) AS rm, count(*) AS n FROM r),
s AS (SELECT slug, file, greatest(0.0, round(0.4 * CASE WHEN dm > 0 THEN deg / dm ELSE 0.0 END + 0.3 * CASE WHEN rm > 0 THEN rec / rm ELSE 0.0 END + 0.2 * (1 - greatest(0.0, least(1.0, CASE WHEN source_mtime IS NULL THEN 3650 ELSE floor(({NOW} - source_mtime) / 86400) END / 365.0))) - 0.3 * least(1.0, sup / 5.0), 6)) AS salience FROM r, mx)
SELECT slug, file, salience, salience >= (SELECT min(salience) FROM (SELECT salience, row_number() OVER (ORDER BY salience DESC) AS rn FROM s) WHERE rn <= greatest(1, (SELECT n FROM mx) // 4)) AS fixed FROM s""",
        "distinct_frequency": f"WITH {_FREQ} SELECT * FROM freq",
        "fixation_scores": f"""WITH {_FREQ}, {_LATEST}, nz AS (SELECT freq, row_number() OVER (ORDER BY freq) - 1 AS i, count(*) OVER () AS n FROM freq WHERE freq > 0),
nrm AS (SELECT greatest(40.0, coalesce(max(freq), 0)) AS f FROM nz WHERE i = least(n - 1, round_even(0.9 * (n - 1), 0))),
a AS (SELECT mem_id, freq, (SELECT count(*) - 1 FROM memories m WHERE m.slug = latest.slug AND m.file = latest.file) AS survival, CASE WHEN source_mtime IS NULL THEN 0.0 ELSE ({NOW} - source_mtime) / 86400.0 END AS age, body FROM latest JOIN freq USING (mem_id)),
b AS (SELECT *, round(0.35 * least(1.0, ln(1 + greatest(age, 0.0)) / ln(366.0)) + 0.40 * least(1.0, ln(1 + freq) / ln(1 + f)) + 0.25 * least(1.0, survival / 5.0), 9) AS conf FROM a, nrm)
SELECT mem_id, freq, survival, round(conf, 6) AS confidence, CASE WHEN regexp_matches(coalesce(body, ''), {curation._q(text.PERSIST)}) AND NOT contains(lower(coalesce(body, '')), 'auto-graduated') AND survival = 0 AND freq <= 1 AND age <= 7 THEN 'suspect' WHEN conf >= 0.66 AND survival >= 3 THEN 'fixed' WHEN conf >= 0.33 AND (survival >= 1 OR age >= 7) THEN 'corroborated' ELSE 'provisional' END AS status,
CAST(greatest(1, least(180, round_even(7 * (1 + survival) * (0.5 + conf), 0))) AS BIGINT) AS review_days FROM b""",
        "merge_points": "SELECT slug, file, point_id, sha, space FROM (SELECT *, row_number() OVER (PARTITION BY slug, file ORDER BY updated_at DESC, point_id DESC) AS rn FROM index_points) WHERE rn = 1",
        "snapshot_actions": """WITH l AS (SELECT max(snapshot_no) AS n FROM legacy_facts), x AS (SELECT slug, file, text, bool_or(valid_until IS NULL) AS was FROM legacy_facts, l WHERE snapshot_no = n - 1 GROUP BY ALL), y AS (SELECT slug, file, text, bool_or(valid_until IS NULL) AS now FROM legacy_facts, l WHERE snapshot_no = n GROUP BY ALL),
f AS (SELECT slug, file FROM x INTERSECT SELECT slug, file FROM y)
SELECT slug, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN was AND NOT now THEN 'closed' WHEN now AND NOT was THEN 'reopened' ELSE 'kept' END AS action, count(*) AS n FROM x FULL JOIN y USING (slug, file, text) JOIN f USING (slug, file) GROUP BY ALL""",
        "first_recall": "SELECT query_id, slug, file, hit_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, slug, file ORDER BY recalled_at, hit_id) AS rn FROM recall_hits WHERE file IS NOT NULL) WHERE rn = 1",
        "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM i GROUP BY user_id, k""",
        "stream_event_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
        "stream_daily_windows": "SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL",
        "once_only_events": "SELECT DISTINCT user_id, event_type FROM events",
        "digest_last_7d": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type",
    }
