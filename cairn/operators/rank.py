"""Keyword ranking, rank fusion and hybrid recall for many queries at once.

Ranks are taken on rounded scores, then on the id,
so they are the same on every run.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Queries that are sent to the executors at once; further ones make further passes.
BLOCK = 512


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, query_set: bool = True) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query by BM25, scores above zero, ties to the smaller doc.

    ``docs``: doc, tokens; ``queries``: query, tokens. Every document is scored against every query. A document is scored in
    one place from its own tokens, and each partition keeps only its k best of each query, so what is shuffled does not grow with
    the documents that match. ``query_set``: each distinct term of a query counts once; otherwise repeats add up. Null tokens read as
    empty; an empty query or document matches nothing.
    """
    size = F.size(F.coalesce("tokens", F.array().cast("array<string>")))
    wanted = queries.select(F.explode("tokens").alias("term")).distinct()
    n, mean = docs.agg(F.count("*"), F.avg(size)).first()
    frequency = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    found = None
    block: list = []

    def part_of(block: list) -> DataFrame:
        terms = sorted({t for _, ts in block for t in ts})
        known = docs.sparkSession.createDataFrame([(t,) for t in terms], "term string")
        df = {r.term: r.df for r in frequency.join(known, "term", "left_semi").collect()}  # at most the terms of one block
        place = {t: i for i, t in enumerate(t for t in terms if t in df)}
        uses = np.zeros((len(place) + 1, len(block)))
        for q, (_, ts) in enumerate(block):
            for t in set(ts) if query_set else ts:
                if t in place:
                    uses[place[t], q] += max(0.0, math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)))
        sent = docs.sparkSession.sparkContext.broadcast((place, uses, [q for q, _ in block]))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            place, uses, names = sent.value
            names = np.array(names)
            best: list[pd.DataFrame] = []
            for part in parts:
                for at in range(0, len(part), 256):
                    some = part.iloc[at : at + 256]
                    index, weight, owner, ids = [], [], [], some["doc"].to_numpy()
                    for d, tokens in enumerate(some["tokens"]):
                        if tokens is None or not len(tokens):
                            continue
                        for t, tf in Counter(tokens).items():
                            if (i := place.get(t)) is not None:
                                index.append(i)
                                weight.append(tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(tokens) / mean)))
                                owner.append(d)
                    if not index:
                        continue
                    rows = uses[index] * np.array(weight)[:, None]
                    heads = np.flatnonzero(np.r_[True, np.diff(owner) != 0])
                    score = np.round(np.add.reduceat(rows, heads, axis=0), 9)
                    who = ids[np.array(owner)[heads]]
                    order = np.lexsort((np.broadcast_to(who[:, None], score.shape), -score), axis=0)[:k]
                    q = np.broadcast_to(np.arange(len(names)), order.shape)
                    frame = pd.DataFrame({"query": names[q.ravel()], "doc": who[order.ravel()], "score": score[order.ravel(), q.ravel()]})
                    best.append(frame[frame["score"] > 0])
                    if len(best) >= 16:
                        best = [_best(best, k)]
            if best:
                yield _best(best, k)

        kinds = docs.schema["doc"].dataType.simpleString(), queries.schema["query"].dataType.simpleString()
        return docs.select("doc", "tokens").mapInPandas(run, f"query {kinds[1]}, doc {kinds[0]}, score double")

    for row in queries.select("query", "tokens").where("size(tokens) > 0").toLocalIterator():
        block.append((row.query, row.tokens))
        if len(block) == BLOCK:
            found = part_of(block) if found is None else found.unionByName(part_of(block))
            block = []
    if block or found is None:
        found = part_of(block) if found is None else found.unionByName(part_of(block))
    return top(found, k)


def _best(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    every = pd.concat(parts).sort_values(["query", "score", "doc"], ascending=[True, False, True], kind="stable")
    return every[every.groupby("query").cumcount() < k]


def top(scores: DataFrame, k: int, by: str = "query") -> DataFrame:
    """The k best of each query with their rank; ties go to the smaller doc."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "doc")
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def sparse_cosine(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, doc, score): cosine of tf * ln(1 + N / df) vectors; queries use the documents' df, unknown terms fall out."""
    n = docs.count()
    counted = docs.select("doc", F.explode("tokens").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + F.lit(n) / F.col("df"))
    weighted = counted.join(df, "term").select("doc", "term", (F.col("tf") * idf).alias("w"))
    norms = weighted.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = queries.select("query", F.explode("tokens").alias("term")).groupBy("query", "term").agg(F.count("*").alias("tf")).join(df, "term").select("query", "term", (F.col("tf") * idf).alias("q"))
    lengths = asked.groupBy("query").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("length"))
    dots = weighted.join(asked, "term").groupBy("query", "doc").agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
    return dots.join(norms, "doc").join(lengths, "query").select("query", "doc", F.round(F.col("dot") / (F.col("norm") * F.col("length")), 9).alias("score"))


def fuse(legs: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query, leg, doc, rank): (query, doc, score, sources).

    A document that a leg names twice counts with its first rank; a missing leg adds nothing.
    """
    first = legs.groupBy("query", "leg", "doc").agg(F.min("rank").alias("rank"))
    weight: Column = F.lit(1.0)
    for leg, w in (weights or {}).items():
        weight = F.when(F.col("leg") == leg, F.lit(float(w))).otherwise(weight)
    return first.groupBy("query", "doc").agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("leg")), ",").alias("sources"))


def agreement(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """(query, agreement): length of the common prefix of two rankings over the length of the first; both empty is 1."""
    a = reference.select("query", "rank", F.col("doc").alias("a"))
    b = candidate.select("query", "rank", F.col("doc").alias("b"))
    both = a.join(b, ["query", "rank"], "full_outer")
    first = F.min(F.when(F.col("a").isNull() | F.col("b").isNull() | (F.col("a") != F.col("b")), F.col("rank")))
    sums = both.groupBy("query").agg(first.alias("first"), F.count("a").alias("n"))
    same = F.when(F.col("first").isNull(), F.col("n")).otherwise(F.col("first") - 1)
    return sums.select("query", F.round(F.when(F.col("n") == 0, F.lit(0.0)).otherwise(same / F.col("n")), 6).alias("agreement"))
