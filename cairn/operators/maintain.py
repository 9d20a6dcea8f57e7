"""Upkeep of the graph and index beside the store: what is stale, what hangs on nothing, what a rewrite lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.sources.tables import epoch_us

#: Stands between the parts of what is hashed.
SEPARATOR = "\u0001"


def freshness(store: DataFrame, points: DataFrame) -> DataFrame:
    """(slug, file, state, now): whether the last point of a file was made from the content that the store has.

    The hash is taken over space, name, description and body, null as empty. A point without a hash is ``unknown``, a file without a
    point ``missing`` (with a null hash).
    """
    last = points.groupBy("slug", "file").agg(F.max_by(F.struct("sha", "space"), F.struct(epoch_us("updated_at").alias("t"), "point_id")).alias("p")).select("slug", "file", "p.sha", "p.space")
    parts = [F.col("space"), *[F.coalesce(c, F.lit("")) for c in ("name", "description", "body")]]
    now = F.sha2(F.concat(parts[0], *[x for p in parts[1:] for x in (F.lit(SEPARATOR), p)]), 256)
    both = store.select("slug", "file", "name", "description", "body").join(last, ["slug", "file"], "left").withColumn("now", now)
    state = F.when(F.col("space").isNull(), "missing").when(F.col("sha").isNull(), "unknown").when(F.col("sha") == F.col("now"), "current").otherwise("stale")
    return both.select("slug", "file", state.alias("state"), "now")


def mtime_changes(store: DataFrame, known: DataFrame) -> DataFrame:
    """(slug, file, old, new): files whose time in the store differs from the greatest one of their triples; null times change nothing."""
    old = known.groupBy("slug", "file").agg(F.max("source_mtime").alias("old"))
    return old.join(store.select("slug", "file", F.col("source_mtime").alias("new")), ["slug", "file"]).where("new is not null and new <> old").select("slug", "file", "old", "new")


def orphaned_rows(held: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(source, slug, file, n): rows of derived tables whose file the store does not hold. Counted before the join, so a hot file is one row."""
    every = None
    for name, df in tables.items():
        part = df.where("slug is not null and file is not null").groupBy("slug", "file").agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "slug", "file", "n")
        every = part if every is None else every.unionByName(part)
    return every.join(held.select("slug", "file"), ["slug", "file"], "left_anti").select("source", "slug", "file", "n")


def edge_repair(facts: DataFrame, held: DataFrame) -> DataFrame:
    """(slug, text, action, dead, alive) of facts that some file no longer in the store states: ``delete`` when none is left, else ``trim``."""
    cited = facts.select("slug", "text", "file").distinct().join(held.select("slug", "file", F.lit(True).alias("here")), ["slug", "file"], "left")
    counts = cited.groupBy("slug", "text").agg(F.count_if(F.col("here").isNull()).alias("dead"), F.count_if(F.col("here")).alias("alive"))
    return counts.where("dead > 0").select("slug", "text", F.when(F.col("alive") > 0, "trim").otherwise("delete").alias("action"), "dead", "alive")


def isolated(known: DataFrame) -> DataFrame:
    """(slug, entity): entities of triples none of which is active."""
    ends = known.select("slug", "status", F.explode(F.array("subject", "object")).alias("entity"))
    return ends.groupBy("slug", "entity").agg(F.bool_or(F.col("status") == "active").alias("any")).where("not any").select("slug", "entity")


def sentence_coverage(versions: DataFrame) -> DataFrame:
    """(mem_id, sentences, covered, coverage) of later deliveries: sentences of the delivery before whose first 60 letters and digits still stand in it.

    Deliveries before without a sentence of 25 characters fall out. Null bodies read as empty.
    """
    w = Window.partitionBy("slug", "file").orderBy("synced_at", "mem_id")
    pairs = versions.select("mem_id", F.lag("mem_id").over(w).alias("before")).where("before is not null")
    old = versions.select(F.col("mem_id").alias("before"), F.transform(text.sentences(F.col("body")), lambda s: F.substring(text.letters_only(s), 1, 60)).alias("probes"))
    new = versions.select("mem_id", text.letters_only(F.col("body")).alias("hay"))
    both = pairs.join(old, "before").join(new, "mem_id").where(F.size("probes") > 0)
    covered = F.size(F.filter("probes", lambda p: (p != "") & F.col("hay").contains(p))).cast("long")
    total = F.size("probes").cast("long")
    return both.select("mem_id", total.alias("sentences"), covered.alias("covered"), F.round(covered / total, 4).alias("coverage"))
