"""Sets of runs of consecutive words, folded by equal sets, and their exact comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.sources.tables import materialize

WORD = r"[\p{L}\p{N}]+"


def word_sets(records: DataFrame, id_col: str, title: str, body: str, words: int, more: dict[str, str] | None = None) -> DataFrame:
    """(id, runs, k1, k2) of records with a body that is neither null nor blank and at least one run.

    The text is title (null as empty), a blank, body. k1 and k2 are equal for equal sets; a row that is repeated stays repeated.
    ``more``: further columns to keep, by the name to give them.
    """
    kept = more or {}
    text = records.where(F.col(id_col).isNotNull() & (F.btrim(F.col(body), F.lit(" \t\r\n\f\v")) != "")).select(
        F.col(id_col).cast("long").alias("id"), F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.col(body)).alias("text"), *[F.col(c).alias(n) for n, c in kept.items()]
    )
    w = text.select("id", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("w"), *kept).where(F.size("w") >= words)
    # the planner may look at the runs before it drops texts without one, so short texts must not fail here
    hashed = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, words)))
    out = w.select("id", F.array_sort(F.array_distinct(hashed)).alias("runs"), *kept)
    return out.select("id", "runs", F.xxhash64(F.lit(1), "runs").alias("k1"), F.xxhash64(F.lit(2), "runs").alias("k2"), *kept)


def similar(a: str, b: str, threshold: float) -> Column:
    """Whether two columns of sets share at least ``threshold`` of their union."""
    shared = F.size(F.array_intersect(a, b))
    return shared >= F.lit(threshold) * (F.size(a) + F.size(b) - shared)


#: Pairs (at most 17 bytes each) up to which they are sent to the sets instead of shuffling the sets.
FEW_PAIRS = 500_000


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, count: int | None = None) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose sets are similar; a is looked up in ``left`` (id, runs), b in ``right``.

    Without a known ``count`` the candidates are written and counted first. Where they are few, they are broadcast and only the
    sets they name are shuffled; otherwise the sets are joined by shuffle. Ids are unique in each of the sides.
    """
    if count is None:
        pairs = materialize(pairs, "candidates")
        count = pairs.count()
    ra = left.select(F.col("id").alias("a"), F.col("runs").alias("ra"))
    rb = right.select(F.col("id").alias("b"), F.col("runs").alias("rb"))
    if count > FEW_PAIRS:
        return pairs.join(rb, "b").join(ra, "a").where(similar("ra", "rb", threshold)).select(*pairs.columns)
    with_a, with_b = F.broadcast(pairs).join(ra, "a"), F.broadcast(pairs.select("a", "b")).join(rb, "b")
    return with_a.join(with_b, ["a", "b"]).where(similar("ra", "rb", threshold)).select(*pairs.columns)
