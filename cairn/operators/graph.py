"""Facts, triples and recall hits as a graph: status, supersession, neighbours, file scores, salience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import BLANKS
from cairn.sources.tables import epoch_us

# The relations a triple may have, and the tenses that close it.
RELATIONS = ["belongs_to", "conflicts_with", "connects_to", "depends_on", "hosts", "implements", "owns", "provides", "runs_on", "supersedes", "uses"]
CLOSED = ["formerly", "historical", "past"]
FLOOR = 0.7


def _clean(c: str) -> Column:
    return F.lower(F.btrim(F.coalesce(F.col(c), F.lit("")), F.lit(BLANKS)))


def triples(rows: DataFrame) -> DataFrame:
    """Normalised triples, one row for each (slug, file, key): the latest by source_mtime, then update_id.

    Off-taxonomy relations and empty subjects or objects fall out; confidence is clamped to 0..1, null reads as 0. Below the
    floor a triple is quarantined, with a closing tense historical, else active.
    """
    relation = F.translate(_clean("relation"), "- ", "__")
    named = rows.select("slug", "file", "update_id", _clean("subject").alias("subject"), relation.alias("relation"), _clean("object").alias("object"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))).alias("confidence"), _clean("temporal").alias("temporal"), F.coalesce("source_mtime", F.lit(0)).alias("source_mtime"))
    named = named.where(F.col("relation").isin(RELATIONS) & (F.col("subject") != "") & (F.col("object") != ""))
    key = F.concat_ws("|", "subject", "relation", "object")
    status = F.when(F.col("confidence") < FLOOR, "quarantined").when(F.col("temporal").isin(CLOSED), "historical").otherwise("active")
    kept = named.withColumn("key", key).groupBy("slug", "file", "key").agg(F.max_by(F.struct("subject", "relation", "object", "confidence", "temporal", "source_mtime"), F.struct("source_mtime", "update_id")).alias("r"))
    return kept.select("slug", "file", "key", "r.*").withColumn("status", status)


def supersede(known: DataFrame) -> DataFrame:
    """(slug, file, key) of active triples that another file's active ``supersedes`` with the same object retires.

    Its file must be older: a smaller source_mtime, or an equal one and a smaller name. By object only the greatest
    (source_mtime, file) of two different files matter, so the sides meet on an aggregate and never pair up.
    """
    live = known.where("status = 'active'")
    acts = live.where("relation = 'supersedes'").groupBy("slug", "object").agg(F.max(F.struct("source_mtime", "file")).alias("last"))
    prior = live.where("relation <> 'supersedes'").join(acts, ["slug", "object"])
    # the last act is by another file and later than the prior triple; an act of the own file alone retires nothing
    older = (F.col("source_mtime") < F.col("last.source_mtime")) | ((F.col("source_mtime") == F.col("last.source_mtime")) & (F.col("file") < F.col("last.file")))
    others = live.where("relation = 'supersedes'").select("slug", "object", F.col("source_mtime").alias("t"), F.col("file").alias("f")).distinct()
    second = others.join(acts, ["slug", "object"]).where("f <> last.file").groupBy("slug", "object").agg(F.max(F.struct(F.col("t").alias("source_mtime"), F.col("f").alias("file"))).alias("next"))
    prior = prior.join(second, ["slug", "object"], "left")
    by_next = (F.col("source_mtime") < F.col("next.source_mtime")) | ((F.col("source_mtime") == F.col("next.source_mtime")) & (F.col("file") < F.col("next.file")))
    hit = F.when(F.col("file") != F.col("last.file"), older).otherwise(F.coalesce(by_next, F.lit(False)))
    return prior.where(hit).select("slug", "file", "key")


def ends(known: DataFrame) -> DataFrame:
    """Both directions of active triples: (slug, entity, relation, other)."""
    live = known.where("status = 'active'")
    out = live.select("slug", F.col("subject").alias("entity"), "relation", F.col("object").alias("other"))
    return out.unionByName(live.select("slug", F.col("object").alias("entity"), F.concat(F.lit("~"), "relation").alias("relation"), F.col("subject").alias("other"))).distinct()


def degrees(known: DataFrame) -> DataFrame:
    """(slug, entity, n, others): edges and distinct neighbours of each entity."""
    return ends(known).groupBy("slug", "entity").agg(F.count("*").alias("n"), F.countDistinct("other").alias("others"))


def valid_wins(facts: DataFrame) -> DataFrame:
    """(slug, file, text, open): one row for each text of the last snapshot of its file; a live row beats closed ones."""
    at = epoch_us("snapshot_at")
    last = facts.groupBy("slug", "file").agg(F.max(at).alias("last"))
    return facts.join(last, ["slug", "file"]).where(at == F.col("last")).groupBy("slug", "file", "text").agg(F.bool_or(F.col("valid_until").isNull()).alias("open"))


def token_facts(known: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, slug, fact): distinct facts of active triples whose subject or object equals a token of the query (query, slug, token)."""
    live = known.where("status = 'active'").select("slug", "subject", "object", F.concat_ws(" ", "subject", "relation", "object").alias("fact"))
    both = live.select("slug", F.explode(F.array_distinct(F.array("subject", "object"))).alias("token"), "fact")
    return asked.distinct().join(both, ["slug", "token"]).select("query", "slug", "fact").distinct()


def hits_by_file(hits: DataFrame) -> DataFrame:
    """(slug, file, hits, queries, facts, best): recall hits of each file, a repeated hit counted once."""
    file = F.btrim(F.regexp_replace(F.btrim("file", F.lit(BLANKS)), r"^\./", ""), F.lit(BLANKS))
    once = hits.select("hit_id", "query_id", "slug", file.alias("file"), "score", F.col("facts")).where("file <> ''").groupBy("hit_id").agg(F.min_by(F.struct("query_id", "slug", "file", "score", "facts"), F.struct("slug", "file")).alias("h")).select("h.*")
    facts = once.select("slug", "file", F.explode("facts").alias("fact")).groupBy("slug", "file").agg(F.countDistinct("fact").alias("facts"))
    sums = once.groupBy("slug", "file").agg(F.count("*").alias("hits"), F.countDistinct("query_id").alias("queries"), F.max("score").alias("best"))
    return sums.join(facts, ["slug", "file"], "left").select("slug", "file", "hits", "queries", F.coalesce("facts", F.lit(0)).alias("facts"), F.round("best", 6).alias("best"))


def salience(store: DataFrame, known: DataFrame, hits: DataFrame, retired: DataFrame, now: int) -> DataFrame:
    """(slug, file, salience, fixed): 0.4 degree + 0.3 recall + 0.2 recency - 0.3 superseded, each scaled to 0..1.

    ``store``: slug, file, source_mtime. Files from the best quarter's last value on are fixed; ties stay.
    """
    deg = known.where("status = 'active'").groupBy("slug", "file").agg(F.count("*").alias("deg"))
    sup = retired.groupBy("slug", "file").agg(F.count("*").alias("sup"))
    rows = store.select("slug", "file", "source_mtime").join(deg, ["slug", "file"], "left").join(hits.select("slug", "file", "hits"), ["slug", "file"], "left").join(sup, ["slug", "file"], "left").fillna(0, ["deg", "hits", "sup"])
    top = rows.agg(F.max("deg"), F.max("hits")).first()
    dmax, rmax = float(top[0] or 0), float(top[1] or 0)
    age = F.when(F.col("source_mtime").isNull(), F.lit(3650)).otherwise(F.floor((F.lit(now) - F.col("source_mtime")) / 86_400))
    norm = lambda c, hi: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / hi)) if hi > 0 else F.lit(0.0)
    value = 0.4 * norm(F.col("deg"), dmax) + 0.3 * norm(F.col("hits"), rmax) + 0.2 * (1 - norm(age, 365.0)) - 0.3 * norm(F.col("sup"), 5.0)
    scored = rows.select("slug", "file", F.greatest(F.lit(0.0), F.round(value, 6)).alias("salience"))
    n = scored.count()
    place = max(1, n // 4)
    cut = scored.orderBy(F.desc("salience")).limit(place).agg(F.min("salience")).first()[0] if n else 0.0
    return scored.withColumn("fixed", F.col("salience") >= F.lit(cut))


def shared_entities(known: DataFrame, hub: int = 8) -> DataFrame:
    """(slug, file, other, shared): unordered pairs (file < other) of files of a slug that share entities.

    Entities in more than max(hub, files / 50) files of a slug say nothing and fall out, as hubs.
    """
    named = known.where("status = 'active'").select("slug", "file", F.explode(F.array("subject", "object")).alias("entity")).distinct()
    files = named.groupBy("slug").agg(F.countDistinct("file").alias("files"))
    spread = named.groupBy("slug", "entity").agg(F.count("*").alias("n")).join(files, "slug").where(F.col("n") <= F.greatest(F.lit(hub), F.floor(F.col("files") / 50))).select("slug", "entity")
    useful = named.join(spread, ["slug", "entity"])
    return useful.join(useful.withColumnRenamed("file", "other"), ["slug", "entity"]).where("file < other").groupBy("slug", "file", "other").agg(F.count("*").alias("shared"))


def first_per_session(rows: DataFrame, session: list[str], order: list[str], id_col: str) -> DataFrame:
    """Rows that are the first of their session key, by order and id."""
    w = Window.partitionBy(*session).orderBy(*order, id_col)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
