"""Trust scores from document frequency, age and survival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import STOPWORDS


def keywords(file: Column, name: Column, description: Column) -> Column:
    """Up to 16 lower-case terms of at least 4 letters: parts of the file's stem, then words of name and description, in order."""
    stem = F.split(F.regexp_replace(file, r"\.md$", ""), "[_-]")
    words = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9_.-]{4,}"), F.lit(0))
    every = F.transform(F.concat(stem, words(name), words(description)), lambda x: F.lower(x))
    return F.slice(F.array_distinct(F.filter(every, lambda x: (F.length(x) >= 4) & ~x.isin(STOPWORDS))), 1, 16)


def session_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z][a-z0-9_.-]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOPWORDS]))


def distinctive_frequency(memories: DataFrame, sessions: DataFrame, share: float = 0.10) -> DataFrame:
    """(id, freq): the greatest session count of the record's keywords that are not generic, else 0.

    ``memories``: id, words; ``sessions``: tokens (distinct). Generic is more than max(1, share of the sessions).
    """
    ceiling = max(1, int(share * sessions.count()))
    wanted = memories.select("id", F.explode("words").alias("term"))
    df = sessions.select(F.explode("tokens").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") <= ceiling)
    freq = wanted.join(df, "term").groupBy("id").agg(F.max("df").alias("freq"))
    return memories.select("id").join(freq, "id", "left").select("id", F.coalesce("freq", F.lit(0)).alias("freq"))


def nearest_rank(values: DataFrame, column: str, percent: float, floor: float) -> float:
    """The value at the rounded rank of the positive values, at least ``floor``. Counted by value, so only distinct values are ordered."""
    counts = values.where(F.col(column) > 0).groupBy(column).count().orderBy(column)
    total = counts.agg(F.sum("count")).first()[0] or 0
    if not total:
        return floor
    place, seen = min(total - 1, round(percent / 100 * (total - 1))), 0
    for row in counts.toLocalIterator():
        seen += row["count"]
        if seen > place:
            return max(float(row[0]), floor)
    return floor


def fixation(rows: DataFrame, freq_norm: float) -> DataFrame:
    """Adds confidence, status and review days to rows with age_days, freq, survival and suspicion."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    age = unit(F.log1p(F.greatest(F.col("age_days"), F.lit(0.0))) / F.log1p(F.lit(365.0)))
    freq = unit(F.log1p(F.greatest(F.col("freq"), F.lit(0))) / F.log1p(F.lit(max(freq_norm, 1.0))))
    conf = 0.35 * age + 0.40 * freq + 0.25 * unit(F.col("survival") / 5.0)
    conf = F.round(conf, 9)
    grown = (F.col("survival") >= 1) | (F.col("age_days") >= 7)
    status = F.when(F.col("suspicion"), "suspect").when((conf >= 0.66) & (F.col("survival") >= 3), "fixed").when((conf >= 0.33) & grown, "corroborated").otherwise("provisional")
    review = F.greatest(F.lit(1.0), F.least(F.lit(180.0), F.bround(7 * (1 + F.col("survival")) * (0.5 + conf)))).cast("long")
    return rows.select("*", F.round(conf, 6).alias("confidence"), status.alias("status"), review.alias("review_days"))
