"""References to records that do not exist (yet, or any more), and what hangs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.timeline import latest_state
from cairn.sources.tables import epoch_us, materialize

MONTH_US = 30 * 86_400 * 1_000_000
LINK = r"\[\[([^\]\|#]+)(?:[\|#][^\]]*)?\]\]"
BLANKS = " \t\r\n"


def hit_references(hits: DataFrame) -> DataFrame:
    """(ref_table, ref_id, slug, target, at) of recall hits; null and blank files refer to nothing."""
    target = F.btrim(F.regexp_replace(F.btrim(F.col("file"), F.lit(BLANKS)), r"^\./", ""), F.lit(BLANKS))
    out = hits.select(F.lit("recall_hits").alias("ref_table"), F.col("hit_id").alias("ref_id"), "slug", target.alias("target"), epoch_us("recalled_at").alias("at"))
    return out.where((F.col("target") != "") & F.col("at").isNotNull()).distinct()


def body_references(memories: DataFrame) -> DataFrame:
    """The same of ``[[links]]`` in bodies, outside of fenced code and back-ticks."""
    bare = F.regexp_replace(F.regexp_replace("body", r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\z)", " "), r"(`+)[^`]*?\1(?!`)", " ")
    links = F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit(LINK), F.lit(1))))
    rows = memories.where(F.col("body").contains("[[")).select(F.lit("memories").alias("ref_table"), F.col("mem_id").alias("ref_id"), "slug", links.alias("t"), epoch_us("synced_at").alias("at"))
    name = F.btrim(F.col("t"), F.lit(BLANKS))
    rows = rows.withColumn("target", F.when(name.endswith(".md"), name).otherwise(F.concat(name, F.lit(".md")))).where((name != "") & F.col("at").isNotNull())
    return rows.select("ref_table", "ref_id", "slug", "target", "at").distinct()


def orphan_references(refs: DataFrame, memories: DataFrame, trash: DataFrame) -> DataFrame:
    """References whose target the store does not hold at their time, with period and reason.

    ``missing``: never delivered; ``late``: delivered only afterwards; ``deleted``: otherwise.
    A delivery and a deletion of one instant count as held. Rows with a null slug match nothing.
    """
    came = memories.select("slug", F.col("file").alias("target"), epoch_us("synced_at").alias("at"), F.lit(1).alias("held"))
    gone = trash.select("slug", F.col("file").alias("target"), epoch_us("deleted_at").alias("at"), F.lit(0).alias("held"))
    state = latest_state(came.unionByName(gone), refs, ["slug", "target"], "at", "held", MONTH_US)
    first = came.groupBy("slug", "target").agg(F.min("at").alias("first"))
    lost = state.where(F.coalesce("held", F.lit(0)) == 0).join(first, ["slug", "target"], "left")
    reason = F.when(F.col("first").isNull(), "missing").when(F.col("first") > F.col("at"), "late").otherwise("deleted")
    return lost.select("ref_table", "ref_id", "slug", "target", "at", F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("period"), reason.alias("reason"))


def cascade(lost: DataFrame, children: DataFrame) -> DataFrame:
    """Direct orphans (depth 0) and, by semi-joins down ``children`` (parent, child), those that inherit it.

    ``lost``: record string; ``children``: parent, child strings. Each round joins only the
    records that the last one added; it ends when a round adds none. Every round is written to the
    shared folder. Cycles end, as a record is taken once; chains of any length are followed to their end.
    """
    seen = materialize(lost.select("record").where("record is not null").distinct().withColumn("depth", F.lit(0)), "orphans")
    edges = materialize(children.where("parent is not null and child is not null").distinct(), "edges")
    front, depth = seen, 0
    while True:
        depth += 1
        new = edges.join(front.select(F.col("record").alias("parent")), "parent", "left_semi").select(F.col("child").alias("record")).distinct()
        new = materialize(new.join(seen.select("record"), "record", "left_anti").withColumn("depth", F.lit(depth)), f"round{depth}")
        if new.isEmpty():
            return seen
        seen, front = seen.unionByName(new), new


def references(hits: DataFrame, memories: DataFrame) -> DataFrame:
    return hit_references(hits).unionByName(body_references(memories))


def found(hits: DataFrame, memories: DataFrame, trash: DataFrame) -> DataFrame:
    return orphan_references(references(hits, memories), memories, trash).select("ref_table", "ref_id", "target", "period", "reason")


def report(hits: DataFrame, memories: DataFrame, trash: DataFrame) -> DataFrame:
    """Direct and inherited orphans for each table and month.

    A record is a file (its deliveries) or a hit. A record with a reference to an absent target is a direct
    orphan; a record that refers to an orphaned file inherits, at any depth. A direct orphan counts once in each
    month of its lost references, an inherited one in each month of its references to other orphaned files.
    """
    refs = materialize(references(hits, memories), "refs")
    lost = orphan_references(refs, memories, trash)
    sep = F.lit("\u0001")
    own = memories.select(F.col("mem_id").alias("ref_id"), F.concat("slug", sep, "file").alias("owner"))
    named = refs.join(own.withColumn("ref_table", F.lit("memories")), ["ref_table", "ref_id"], "left")
    named = named.withColumn("record", F.coalesce("owner", F.concat(F.lit("hit"), sep, F.col("ref_id").cast("string"))))
    named = materialize(named.select("ref_table", "ref_id", "at", "record", F.concat("slug", sep, "target").alias("parent")), "named")
    direct = materialize(named.join(lost.select("ref_table", "ref_id", "at"), ["ref_table", "ref_id", "at"], "left_semi").select("ref_table", "record", "at"), "direct")
    reach = cascade(direct.select("record"), named.select("parent", F.col("record").alias("child")))
    heirs = named.where("parent <> record").join(reach.where("depth > 0"), "record").join(reach.select(F.col("record").alias("parent")), "parent", "left_semi")
    each = direct.withColumn("depth", F.lit(0)).unionByName(heirs.select("ref_table", "record", "at", "depth"))
    period = F.date_format(F.timestamp_micros("at"), "yyyy-MM")
    return each.select("ref_table", period.alias("period"), "record", "depth").distinct().groupBy("ref_table", "period").agg(
        F.count_if(F.col("depth") == 0).alias("direct"), F.count_if(F.col("depth") > 0).alias("inherited"), F.max("depth").cast("long").alias("deepest")
    )
