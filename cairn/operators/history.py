"""Version history of changing attributes, from snapshots or from updates.

Two consecutive states of a key are compared by one null-safe full outer join of the
state table with itself, shifted by one step: right only is an insert, left only a
delete, unequal states a change. The change events, ordered by time, give each version
its period (``lead``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.timeline import hashed, next_at, time_cuts
from cairn.sources.tables import epoch_us, materialize

BLANKS = " \t\r\n"
CLOSED = ["formerly", "historical", "past"]
KEYS = ["slug", "file", "attr"]
LIVE = (1 << 63) - 1


def change_events(states: DataFrame, more: list[str]) -> DataFrame:
    """Events (k1, k2, at, kind, more) between consecutive states (k1, k2, at, step, state, more).

    ``step`` is the time of the key's next observation, null after the last one. A key absent at that time was deleted then;
    a key that has no earlier observation was inserted. ``state`` is compared null-safe. A deletion has no ``more``.
    """
    left = states.where("step is not null").select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), "step", F.col("state").alias("l_state"), F.lit(True).alias("l_in"))
    right = states.select("k1", "k2", "at", "state", F.lit(True).alias("r_in"), *more)
    on = F.col("l1").eqNullSafe(F.col("k1")) & F.col("l2").eqNullSafe(F.col("k2")) & (F.col("step") == F.col("at"))
    kind = F.when(F.col("l_in").isNull(), "inserted").when(F.col("r_in").isNull(), "deleted").when(~F.col("l_state").eqNullSafe(F.col("state")), "changed")
    both = left.join(right, on, "full_outer").withColumn("kind", kind).where(F.col("kind").isNotNull())
    return both.select(F.coalesce("k1", "l1").alias("k1"), F.coalesce("k2", "l2").alias("k2"), F.coalesce("at", "step").alias("at"), "kind", *more)


def versions(states: DataFrame, cuts: list[float], more: list[str]) -> DataFrame:
    """Periods (k1, k2, more, valid_from, valid_to) out of the change events of states; valid_to is -1 while open."""
    spans = next_at(change_events(materialize(states, "states"), more), ["k1", "k2"], "at", "valid_to", cuts)
    return spans.where(F.col("kind") != "deleted").select("k1", "k2", *more, F.col("at").alias("valid_from"), F.coalesce("valid_to", F.lit(-1).cast("long")).alias("valid_to"))


def _norm(c: str) -> Column:
    return F.lower(F.btrim(F.col(c), F.lit(BLANKS)))


def triple_states(triples: DataFrame, cuts: list[float]) -> DataFrame:
    """State and next instant (step) of each (slug, file, subject|relation) at each source_mtime.

    The greatest update_id of an instant holds. Rows with a null object or source_mtime do not
    count; a null subject or relation reads as empty. Repeated rows change nothing.
    """
    relation = F.translate(_norm("relation"), "- ", "__")
    attr = F.concat(F.coalesce(_norm("subject"), F.lit("")), F.lit("|"), F.coalesce(relation, F.lit("")))
    closed = F.coalesce(_norm("temporal"), F.lit("")).isin(CLOSED)
    rows = triples.where(F.col("object").isNotNull() & F.col("source_mtime").isNotNull()).select(
        "slug", "file", attr.alias("attr"), F.col("source_mtime").alias("at"), "update_id", F.xxhash64(closed, _norm("object")).alias("state")
    )
    return next_at(hashed(rows, KEYS), ["k1", "k2"], "at", "step", cuts, then=["update_id", "state"]).drop("update_id")


def fact_states(facts: DataFrame, cuts: list[float]) -> DataFrame:
    """State and next snapshot that counts (step) of each fact (slug, file, text) in each snapshot.

    A live row wins over closed ones of its snapshot; of several closed ones the latest instant.
    A valid_until that is no time counts as closed, told apart by its text. Null texts are no facts.
    """
    zoned = F.when(F.col("valid_until").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.col("valid_until")).otherwise(F.concat("valid_until", F.lit("Z")))
    instant = F.unix_micros(zoned.try_cast("timestamp"))
    # an instant is a number of microseconds far above the numbers that stand for other texts
    state = F.when(F.col("valid_until").isNull(), F.lit(LIVE)).otherwise(F.coalesce(instant, F.shiftrightunsigned(F.xxhash64("valid_until"), 2) - F.lit(LIVE)))
    rows = facts.select("slug", "file", F.col("text").alias("attr"), F.floor(epoch_us("snapshot_at") / 1_000_000).alias("at"), state.alias("state")).where(F.col("at").isNotNull())
    rows = hashed(hashed(rows, KEYS), ["slug", "file"], ("f1", "f2"))
    seen = next_at(rows.select("f1", "f2", "at").distinct(), ["f1", "f2"], "at", "step", cuts)
    held = rows.where(F.col("attr").isNotNull()).groupBy("k1", "k2", "at").agg(F.max("state").alias("state"), F.first("f1").alias("f1"), F.first("f2").alias("f2"))
    return held.join(seen, ["f1", "f2", "at"]).select("k1", "k2", "at", "step", "state")


def attribute_history(triples: DataFrame, facts: DataFrame) -> DataFrame:
    """Every version of triple attributes and of facts: src, slug, file, attr, valid_from, valid_to."""
    cuts = time_cuts(triples, "source_mtime")
    t = versions(triple_states(triples, cuts).select("k1", "k2", "at", "step", "state", *KEYS), cuts, KEYS)
    cuts = time_cuts(facts.select(F.floor(epoch_us("snapshot_at") / 1_000_000).alias("at")), "at")
    f = versions(fact_states(facts, cuts), cuts, [])
    names = hashed(facts.where("text is not null").select("slug", "file", F.col("text").alias("attr")).distinct(), KEYS)
    f = f.join(names, ["k1", "k2"])
    out = ["valid_from", "valid_to"]
    return t.select(F.lit("triple").alias("src"), *KEYS, *out).unionByName(f.select(F.lit("fact").alias("src"), *KEYS, *out))


def found(triples: DataFrame, facts: DataFrame) -> DataFrame:
    return attribute_history(triples, facts).select("src", "slug", "file", "attr", "valid_from", "valid_to")
