"""Screening and curation queries over the whole memories, documents and index tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import curate, vectors
from cairn.plans.recall import _vectors
from cairn.sources import table

_ALL = "coalesce(name, '') || ' ' || coalesce(description, '') || ' ' || coalesce(body, '')"


def _mem(s, d):
    return table(s, d, "memories")


def _doc(s, d):
    return table(s, d, "documents")


def _whole():
    return F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")), F.coalesce("body", F.lit("")))


def secret_scan(s, d):
    n = F.regexp_count("text", F.lit(text.SECRET)).cast("long")
    return _doc(s, d).select("doc_id", n.alias("n"), F.sha1(text.redact(F.col("text"))).alias("redacted")).where("n > 0")


def secret_lines(s, d):
    lines = _doc(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(text.SECRET))
    return lines.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("pos") + 1)), ",").alias("lines"))


def fact_classes(s, d):
    """Hard facts by class, in lower case and once for each document; those whose line looks like a secret fall out."""
    lines = _doc(s, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(~F.col("line").rlike(text.SECRET))

    def tokens(name, pattern):
        where, before = (F.concat(F.lit(" "), "line"), r"(?<![A-Za-z0-9_.])") if pattern.startswith(":") else (F.col("line"), "")
        return F.transform(F.regexp_extract_all(where, F.lit(before + text.ascii_border(pattern)), F.lit(0)), lambda x: F.struct(F.lit(name).alias("class"), x.alias("token")))

    found = [tokens(name, pattern) for name, pattern in text.FACTS]
    out = lines.select("doc_id", F.explode(F.concat(*found)).alias("f")).select("doc_id", "f.class", F.lower(F.regexp_replace(F.btrim("f.token"), r"[.,;:)]+$", "")).alias("token"))
    return out.where((F.length("token") >= 3) & ~F.col("token").isin(text.FACT_STOP)).groupBy("doc_id", "class", "token").agg(F.count("*").alias("n"))


def denied(s, d):
    return _mem(s, d).select("mem_id", text.deny_tag(_whole()).alias("tag")).where("tag is not null")


def transient(s, d):
    return _mem(s, d).select("mem_id").where(text.matches(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))), text.TRANSIENT))


def lost_lines(s, d):
    return curate.lost_lines(_mem(s, d).select("mem_id", "slug", "file", "synced_at", "body"))


def clusters(s, d):
    v = _vectors(s, d)
    return curate.cliques(vectors.duplicates(vectors.search(v, v, least=0.4)))


def index_budget(s, d):
    rows = curate.latest(_mem(s, d)).select("slug", F.col("mem_id").alias("id"), F.row_number().over(_by_age()).alias("pos"), (F.length(F.coalesce("name", F.lit(""))) + F.length(F.coalesce("description", F.lit(""))) + 8).alias("size"))
    return curate.budget_fill(rows, 4_000)


def _by_age():
    from pyspark.sql import Window

    return Window.partitionBy("slug").orderBy(F.desc("source_mtime"), "mem_id")


def queries() -> dict:
    return {
        "secret_scan": secret_scan,
        "secret_lines": secret_lines,
        "fact_classes": fact_classes,
        "injection_denylist": denied,
        "transient_filter": transient,
        "dup_text_exact": lambda s, d: curate.repeated(_doc(s, d), F.col("text"), "doc_id"),
        "dup_text_normalised": lambda s, d: curate.repeated(_doc(s, d), text.norm_text(F.col("text")), "doc_id"),
        "dup_descriptions": lambda s, d: curate.repeated(curate.latest(_mem(s, d)), text.norm_text(F.col("description")), "mem_id"),
        "supersede_bodies": lambda s, d: curate.repeated(curate.latest(_mem(s, d)), text.canonical_body(F.col("body")), "mem_id"),
        "dedupe_latest": lambda s, d: curate.latest(_mem(s, d)).select("slug", "file", "mem_id"),
        "held_files": lambda s, d: curate.held(_mem(s, d), table(s, d, "trash")).select("slug", "file", "mem_id"),
        "prefix_clusters": lambda s, d: curate.prefix_clusters(_mem(s, d).select("slug", "file").distinct()),
        "index_drift": lambda s, d: curate.drift(_mem(s, d), table(s, d, "index_points")),
        "atlas_coverage": lambda s, d: curate.drift(_mem(s, d), table(s, d, "index_points")).groupBy("slug", "state").agg(F.count("*").alias("n")),
        "wiki_links": lambda s, d: curate.resolve_links(curate.latest(_mem(s, d))).where("target is not null").select("slug", "file", "target_slug", "target"),
        "dangling_links": lambda s, d: curate.resolve_links(curate.latest(_mem(s, d))).where("target is null").select("slug", "file", "want"),
        "audit_findings": lambda s, d: curate.audit(curate.latest(_mem(s, d))),
        "line_containment": lost_lines,
        "clique_clusters": clusters,
        "index_budget": index_budget,
    }


_LATEST = "latest AS (SELECT slug, file, unnest(r) FROM (SELECT slug, file, arg_max(struct_pack(mem_id := mem_id, name := name, description := description, memory_type := memory_type, body := body, source_mtime := source_mtime, synced_at := synced_at), (coalesce(epoch_us(synced_at), -1), mem_id)) AS r FROM memories GROUP BY slug, file))"
_NORM = r"trim(regexp_replace(lower(coalesce({x}, '')), '[ \t\r\n]+', ' ', 'g'))"
_LINKS = rf"""WITH {_LATEST}, raw AS (SELECT slug, file, unnest(list_distinct(regexp_extract_all(coalesce(body, ''), '\[\[([^\]]+)\]\]', 1))) AS r FROM latest),
nm AS (SELECT slug, file, trim(regexp_replace(r, '[|#].*$', ''), E' \t\r\n') AS n FROM raw),
named AS (SELECT DISTINCT slug, file, CASE WHEN ends_with(n, '.md') THEN n ELSE n || '.md' END AS want FROM nm WHERE n NOT IN ('', '.md')),
own AS (SELECT DISTINCT slug, file AS want FROM latest), alone AS (SELECT want, min(slug) AS other FROM own GROUP BY want HAVING count(*) = 1),
res AS (SELECT n.slug, n.file, n.want, coalesce(o.slug, a.other) AS target_slug FROM named n LEFT JOIN own o ON o.slug = n.slug AND o.want = n.want LEFT JOIN alone a ON a.want = n.want),
ok AS (SELECT * FROM res WHERE NOT (target_slug IS NOT DISTINCT FROM slug AND want = file))"""


def _repeat(source: str, key: str, ident: str, pre: str = "") -> str:
    return f"{pre} SELECT sha1(k) AS key, count(*) AS n, min({ident}) AS first FROM (SELECT {ident}, {key} AS k FROM {source}) WHERE k <> '' GROUP BY k HAVING count(*) > 1"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle_sql() -> dict:
    secret = _q(text.SECRET.replace(r"\x22", '"'))
    # no look-behind here: a sign or none in front, as a group of its own
    facts = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS class, unnest(regexp_extract_all({_q(' ') + ' || line' if p[0] == ':' else 'line'}, {_q('[^A-Za-z0-9_.](' + p + ')' if p[0] == ':' else '(' + p + ')')}, 1)) AS t FROM ln" for n, p in text.FACTS)
    tags = " ".join(f"WHEN regexp_matches(x, {_q(p)}) THEN '{n}'" for n, p in text.DENIED)
    body = r"array_to_string(list_filter(list_transform(string_split(replace(regexp_replace(coalesce(body, ''), '\A---\n(?s:.*?)\n---\n', ''), E'\r', ''), E'\n'), lambda x: rtrim(x)), lambda x: x <> '' AND NOT starts_with(x, '> provenance:')), E'\n')"
    drift = "SELECT coalesce(m.slug, p.slug) AS slug, coalesce(m.file, p.file) AS file, CASE WHEN made IS NULL THEN 'missing' WHEN came IS NULL THEN 'orphan' WHEN made < came THEN 'stale' ELSE 'current' END AS state FROM (SELECT slug, file, max(synced_at) AS came FROM memories GROUP BY ALL) m FULL JOIN (SELECT slug, file, max(updated_at) AS made FROM index_points GROUP BY ALL) p ON m.slug = p.slug AND m.file = p.file"
    return {
        "secret_scan": f"SELECT doc_id, len(regexp_extract_all(text, {secret})) AS n, sha1(regexp_replace(text, {secret}, '{text.MASK}', 'g')) AS redacted FROM documents WHERE regexp_matches(text, {secret})",
        "secret_lines": f"SELECT doc_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS lines FROM (SELECT doc_id, unnest(string_split(text, E'\\n')) AS line, generate_subscripts(string_split(text, E'\\n'), 1) AS i FROM documents) WHERE regexp_matches(line, {secret}) GROUP BY doc_id",
        "fact_classes": f"WITH ln AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, E'\\n')) AS line FROM documents) WHERE NOT regexp_matches(line, {secret})), tk AS (SELECT doc_id, class, lower(regexp_replace(trim(t), '[.,;:)]+$', '')) AS token FROM ({facts})) SELECT doc_id, class, token, count(*) AS n FROM tk WHERE length(token) >= 3 AND token NOT IN ('0.0', '1.0', '2.0', '3.0') GROUP BY ALL",
        "injection_denylist": f"SELECT mem_id, tag FROM (SELECT mem_id, CASE {tags} END AS tag FROM (SELECT mem_id, {_ALL} AS x FROM memories)) WHERE tag IS NOT NULL",
        "transient_filter": f"SELECT mem_id FROM memories WHERE regexp_matches(coalesce(name, '') || ' ' || coalesce(description, ''), {_q(text.TRANSIENT)})",
        "dup_text_exact": _repeat("documents", "text", "doc_id"),
        "dup_text_normalised": _repeat("documents", _NORM.format(x="text"), "doc_id"),
        "dup_descriptions": _repeat("latest", _NORM.format(x="description"), "mem_id", f"WITH {_LATEST}"),
        "supersede_bodies": _repeat("latest", body, "mem_id", f"WITH {_LATEST}"),
        "dedupe_latest": f"WITH {_LATEST} SELECT slug, file, mem_id FROM latest",
        "held_files": f"WITH {_LATEST} SELECT slug, file, mem_id FROM latest LEFT JOIN (SELECT slug, file, max(deleted_at) AS gone FROM trash GROUP BY ALL) USING (slug, file) WHERE gone IS NULL OR gone <= synced_at",
        "prefix_clusters": "SELECT slug, regexp_extract(file, '^([^_]+_[^-_.]+)', 1) AS key, count(*) AS n FROM (SELECT DISTINCT slug, file FROM memories) GROUP BY ALL HAVING count(*) >= 3",
        "index_drift": drift,
        "atlas_coverage": f"SELECT slug, state, count(*) AS n FROM ({drift}) GROUP BY ALL",
        "wiki_links": f"{_LINKS} SELECT slug, file, target_slug, want AS target FROM ok WHERE target_slug IS NOT NULL",
        "dangling_links": f"{_LINKS} SELECT slug, file, want FROM ok WHERE target_slug IS NULL",
        "audit_findings": rf"""WITH {_LATEST} SELECT mem_id, unnest(list_filter([CASE WHEN strlen(coalesce(body, '')) < 200 THEN 'tiny' END, CASE WHEN regexp_matches(coalesce(body, ''), '(?i)\b(deprecated|obsolete|superseded|outdated)\b') THEN 'stale_marker' END,
CASE WHEN coalesce(trim(name), '') = '' THEN 'no_name' END, CASE WHEN coalesce(trim(description), '') = '' THEN 'no_description' END, CASE WHEN coalesce(memory_type NOT IN ('user', 'feedback', 'project', 'reference'), true) THEN 'bad_type' END,
CASE WHEN trim(coalesce(body, ''), E' \t\r\n') = '' THEN 'empty_body' END, CASE WHEN NOT regexp_matches(file, '^[A-Za-z0-9._-]+\.md$') OR contains(file, '..') THEN 'unsafe_file' END], lambda x: x IS NOT NULL)) AS finding FROM latest""",
        "line_containment": r"""WITH l AS (SELECT mem_id, rtrim(unnest(string_split(coalesce(body, ''), E'\n'))) AS line FROM memories), c AS (SELECT mem_id, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL),
p AS (SELECT mem_id, lag(mem_id) OVER (PARTITION BY slug, file ORDER BY synced_at, mem_id) AS before FROM memories)
SELECT p.mem_id, sum(greatest(o.n - coalesce(c.n, 0), 0)) AS lost, sum(least(o.n, coalesce(c.n, 0))) AS kept FROM p JOIN c o ON o.mem_id = p.before LEFT JOIN c ON c.mem_id = p.mem_id AND c.line = o.line GROUP BY p.mem_id""",
    }
