"""Exact cosine search of a stated query set against all vectors, in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries sent to the executors at once.
BLOCK = 4_096


def search(vectors: DataFrame, queries: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """(query, vec, score): cosine of every query with every vector of the same scope but itself.

    Both sides: id long, scope string, vector. ``k`` keeps the best k of each query (ties to the smaller id), ``least``
    scores of at least that. Vectors of zero length or of another length than their query score 0; null vectors are left out.
    Each partition keeps only its own best before anything is shuffled.
    """
    spark = vectors.sparkSession
    rows = queries.where("vector is not null").select("id", "scope", "vector").orderBy("id").toLocalIterator()
    out = None
    block: list = []

    def part_of(block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids = np.array([r[0] for r in sent.value])
            scopes = np.array([r[1] or "" for r in sent.value], object)
            groups = {n: np.flatnonzero([len(r[2]) == n for r in sent.value]) for n in {len(r[2]) for r in sent.value}}
            unit = {n: _unit(np.array([sent.value[i][2] for i in g], float)) for n, g in groups.items()}
            for part in parts:
                sizes = part["vector"].map(len).to_numpy()
                for n, g in groups.items():
                    some = part[sizes == n]
                    if not len(some):
                        continue
                    score = np.round(unit[n] @ _unit(np.stack(some["vector"].to_numpy()).astype(float)).T, 6)
                    vec = some["id"].to_numpy()
                    keep = (ids[g][:, None] != vec[None, :]) & (scopes[g][:, None] == some["scope"].fillna("").to_numpy()[None, :])
                    if least is not None:
                        keep &= score >= least
                    if k is not None and len(vec) > k:
                        ranked = np.lexsort((np.broadcast_to(vec, score.shape), -np.where(keep, score, -9)), axis=1)[:, :k]
                        best = np.zeros_like(keep)
                        np.put_along_axis(best, ranked, True, 1)
                        keep &= best
                    q, v = np.nonzero(keep)
                    yield pd.DataFrame({"query": ids[g][q], "vec": vec[v], "score": score[q, v]})

        return vectors.where("vector is not null").select("id", "scope", "vector").mapInPandas(run, "query long, vec long, score double")

    for row in rows:
        block.append((row.id, row.scope, row.vector))
        if len(block) == BLOCK:
            out = part_of(block) if out is None else out.unionByName(part_of(block))
            block = []
    if block or out is None:
        out = part_of(block) if out is None else out.unionByName(part_of(block))
    if k is None:
        return out
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def duplicates(found: DataFrame) -> DataFrame:
    """Unordered pairs (a < b) of a search result, with the greater score."""
    return found.groupBy(F.least("query", "vec").alias("a"), F.greatest("query", "vec").alias("b")).agg(F.max("score").alias("score"))


def stats(vectors: DataFrame, dim: int) -> DataFrame:
    """By scope: vectors, and how many lack the dimension."""
    bad = F.coalesce(F.size("vector") != dim, F.lit(True))
    return vectors.groupBy("scope").agg(F.count("*").alias("n"), F.count_if(bad).alias("unusable"))
