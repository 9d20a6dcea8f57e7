"""Ordered look-ups that survive a hot key.

A plain window puts all rows of one key into one task. Here time is cut into buckets:
the window runs inside (key, bucket), and only one summary row for each (key, bucket)
is ordered by key. A key that holds a third of all rows then spreads over its buckets.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows aimed at between two cuts of time, over all keys, and the most cuts.
BETWEEN, CUTS = 2_000_000, 4_096


def time_cuts(df: DataFrame, at: str) -> list[float]:
    """Quantiles of ``at`` with about BETWEEN rows between two of them, so that no key has more in one bucket; none for fewer rows."""
    n = df.where(F.col(at).isNotNull()).count()
    parts = min(CUTS, n // BETWEEN + 1)
    if parts < 2:
        return []
    found = df.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)], 10 * parts)).first()[0]
    return sorted({float(x) for x in found})


def next_at(df: DataFrame, keys: list[str], at: str, out: str, cuts: list[float], then: list[str] | None = None) -> DataFrame:
    """Add ``out``: the next greater ``at`` of the same keys, null for the last. Of rows with equal keys and ``at`` one stays.

    ``at`` is a non-null long; of equal ones the row that is last by the columns ``then`` stays. ``cuts``: see ``time_cuts``.
    Keys are not null (see ``hashed``). An empty input gives an empty result.
    """
    order = [at, *(then or [])]
    if not cuts:
        one = df.withColumn(out, F.lead(at).over(Window.partitionBy(*keys).orderBy(*order)))
        if not then:
            return one
        return _last_of_instant(one, at, out)
    spread = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_at", outputCol="_b").transform(df.withColumn("_at", F.col(at).cast("double"))).drop("_at")
    inner = Window.partitionBy(*keys, "_b").orderBy(*order)
    rows = spread.withColumn("_in", F.lead(at).over(inner))
    if then:
        rows = _last_of_instant(rows, at, "_in")
    firsts = spread.groupBy(*keys, "_b").agg(F.min(at).alias("_first"))
    firsts = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_b"))).drop("_first")
    return rows.join(firsts, [*keys, "_b"], "left").select(*df.columns, F.coalesce("_in", "_after").alias(out))


def _last_of_instant(rows: DataFrame, at: str, out: str) -> DataFrame:
    """The last row of each instant: the next row, if any, is of a later one, so its time is the next time."""
    return rows.where(F.col(out).isNull() | (F.col(out) != F.col(at)))


def hashed(df: DataFrame, keys: list[str], names: tuple[str, str] = ("k1", "k2")) -> DataFrame:
    """``df`` with two 64-bit hashes of ``keys``, null told apart from every value: sorts and joins on them stay on longs."""
    parts = [x for k in keys for x in (F.coalesce(F.col(k).cast("string"), F.lit("")), F.col(k).isNull())]
    return df.withColumns({names[0]: F.xxhash64(F.lit(1), *parts), names[1]: F.xxhash64(F.lit(2), *parts)})


def latest_state(events: DataFrame, probes: DataFrame, keys: list[str], at: str, value: str, width: int) -> DataFrame:
    """As-of join: ``probes`` plus ``value`` of the last event of the same keys with ``at`` not after the probe's.

    ``value`` is null where no event comes before. On one instant the greater value holds.
    ``events`` need keys, at, value; ``probes`` keys, at and any more columns. Null keys or times match nothing.
    """
    more = [c for c in probes.columns if c not in keys and c != at]
    ev = events.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.max(value).alias("_v"))
    rows = ev.select(*keys, at, "_v", F.lit(0).alias("_p"), F.lit(None).cast(probes.select(F.struct(*more) if more else F.lit(1)).schema[0].dataType).alias("_row"))
    rows = rows.unionByName(probes.select(*keys, at, F.lit(None).cast(ev.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_p"), (F.struct(*more) if more else F.lit(1)).alias("_row")))
    rows = rows.withColumn("_b", F.floor(F.col(at) / F.lit(width)))
    own = Window.partitionBy(*keys, "_b").orderBy(at, "_p").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.last("_v", ignorenulls=True).over(own))
    summary = rows.groupBy(*keys, "_b").agg(F.max(F.when(F.col("_p") == 0, F.struct(at, "_v")))["_v"].alias("_lastv"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("_prev", F.last("_lastv", ignorenulls=True).over(before)).drop("_lastv")
    out = rows.where(F.col("_p") == 1).join(summary, [*keys, "_b"], "left")
    cols = [F.col(f"_row.{c}").alias(c) for c in more]
    return out.select(*keys, at, *cols, F.coalesce("_in", "_prev").alias(value))
