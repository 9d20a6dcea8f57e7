"""The k most similar vectors of every vector: inverted file, product-quantised residuals, exact rerank.

Coarse centroids (spherical k-means) and the codebooks of the residuals are fitted on the driver on a
bounded sample; every vector is indexed and is a query. A vector goes to its home cell as member and
query, and as a query to further cells that are nearly as close. In a cell, tables of inner products between
query parts and codewords rank the members; the best of them are scored again with the full vectors.
A cell that the sample shows to be large is cut into chunks, in members and in queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About as many vectors fit centroids and codebooks, whatever the size of the collection.
SAMPLE = 40_000
#: Members aimed at in a cell, and the most before it is cut. Centroids number at most SAMPLE / 20.
CELL, CHUNK = 800, 8_000
#: Cells a query visits at most, and how far below the home centroid's cosine a further one may be.
PROBES, MARGIN = 3, 0.3
PARTS, CODEWORDS, RERANK = 8, 256, 64


def kmeans(x: np.ndarray, k: int, rounds: int, unit: bool, rng: np.random.Generator) -> np.ndarray:
    """k-means by blocks; ``unit`` keeps centroids on the sphere. Empty clusters keep their centroid."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        sums, sizes = np.zeros((k, x.shape[1])), np.zeros(k)
        half = (c * c).sum(1) / 2
        for at in range(0, len(x), 4096):
            block = x[at : at + 4096]
            near = (block @ c.T - half).argmax(1)
            order = np.argsort(near, kind="stable")
            heads = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
            sums[near[order][heads]] += np.add.reduceat(block[order], heads, axis=0)
            sizes += np.bincount(near, minlength=k)
        full = sizes > 0
        c[full] = sums[full] / sizes[full, None]
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class InvertedFile:
    def __init__(self, sample: np.ndarray, total: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        cells = max(1, min(round(total / CELL), len(sample) // 20 or 1))
        self.centroids = kmeans(sample, cells, 8, True, rng).astype(np.float32)
        home = self.route(sample)[0][:, 0]
        residual = sample - self.centroids[home]
        width = sample.shape[1] // PARTS
        self.cuts = [slice(m * width, (m + 1) * width if m < PARTS - 1 else sample.shape[1]) for m in range(PARTS)]
        some = residual[rng.permutation(len(residual))[:20_000]]
        self.codebooks = [kmeans(some[:, cut], min(CODEWORDS, len(some)), 6, False, rng).astype(np.float32) for cut in self.cuts]
        share = np.bincount(home, minlength=cells) / len(sample)
        self.chunks = np.maximum(1, np.ceil(share * total / CHUNK)).astype(int)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest cells of each row, best first, and which of them a query visits."""
        score = x @ self.centroids.T
        n = min(PROBES, score.shape[1])
        top = np.argpartition(-score, n - 1, axis=1)[:, :n]
        values = np.take_along_axis(score, top, 1)
        order = np.argsort(-values, axis=1, kind="stable")
        values = np.take_along_axis(values, order, 1)
        return np.take_along_axis(top, order, 1), values >= values[:, :1] - MARGIN

    def quantise(self, residual: np.ndarray) -> list[np.ndarray]:
        return [(residual[:, cut] @ book.T - (book * book).sum(1) / 2).argmax(1) for cut, book in zip(self.cuts, self.codebooks)]

    def search(self, cell: int, members: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (query ids, neighbour ids, cosines); a missing neighbour has cosine -2."""
        codes = self.quantise(members - self.centroids[cell])
        keep = min(max(RERANK, k + 1), len(members))
        for at in range(0, len(queries), 256):
            q = queries[at : at + 256]
            close = np.zeros((len(q), len(members)), np.float32)
            for cut, book, code in zip(self.cuts, self.codebooks, codes):
                close += np.take(q[:, cut] @ book.T, code, axis=1)
            best = np.argpartition(-close, keep - 1, axis=1)[:, :keep] if keep < len(members) else np.broadcast_to(np.arange(len(members)), close.shape)
            exact = np.einsum("qd,qkd->qk", q.astype(np.float64), members[best].astype(np.float64))
            exact[ids[best] == query_ids[at : at + 256, None]] = -2
            order = np.lexsort((ids[best], -exact), axis=1)[:, :k]
            yield query_ids[at : at + 256], np.take_along_axis(ids[best], order, 1), np.take_along_axis(exact, order, 1)


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` finite values, not all zero, and whose id is not null."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("id").isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0))


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def nearest(vectors: DataFrame, k: int = 5, dim: int = 64) -> DataFrame:
    """(id, neighbour_id, cosine): up to k others of highest cosine for every usable vector.

    ``vectors``: id long, space string, vector array of float. Only vectors of one space meet (a null space
    is a space of its own). Equal cosines go by the smaller id; repeated rows of an id count once;
    unusable rows take no part; a space with fewer than k others gives what it has.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col("id").cast("long").alias("id"), F.coalesce("space", F.lit("\0")).alias("space"), "vector"), dim)
    out = "id long, neighbour_id long, cosine double"
    total = rows.count()
    if not total:
        return spark.createDataFrame([], out)
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / total))).select("vector").toPandas()
    if len(picked) < 2:
        picked = rows.select("vector").limit(SAMPLE).toPandas()
    model = InvertedFile(unit_rows(picked["vector"]), total)
    sent = spark.sparkContext.broadcast(model)

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for part in parts:
            if not len(part):
                continue
            x, ids = unit_rows(part["vector"]), part["id"].to_numpy()
            cells, visit = model.route(x)
            who, cell, split, role = [], [], [], []
            chunks = model.chunks[cells]
            mine = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            for rank in range(cells.shape[1]):
                simple = np.flatnonzero(visit[:, rank] & (chunks[:, rank] == 1))
                who.append(simple)
                cell.append(cells[simple, rank])
                split.append(np.zeros(len(simple), int))
                role.append(np.full(len(simple), 2 + (rank == 0)))
                for i in np.flatnonzero(visit[:, rank] & (chunks[:, rank] > 1)):
                    n = chunks[i, rank]
                    member, query = mine[i] % n, (mine[i] >> 8) % n
                    grid = [(m, q, 2 * (q == query) + (rank == 0) * (m == member)) for m in range(n) for q in range(n)]
                    grid = [g for g in grid if g[2]]
                    who.append(np.full(len(grid), i))
                    cell.append(np.full(len(grid), cells[i, rank]))
                    split.append(np.array([m * n + q for m, q, _ in grid]))
                    role.append(np.array([r for _, _, r in grid]))
            w = np.concatenate(who)
            raw = [r.tobytes() for r in x]
            yield pd.DataFrame({"space": part["space"].to_numpy()[w], "cell": np.concatenate(cell), "split": np.concatenate(split), "role": np.concatenate(role), "id": ids[w], "v": [raw[i] for i in w]})

    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        model = sent.value
        x, ids, role = np.frombuffer(b"".join(group["v"]), np.float32).reshape(len(group), -1), group["id"].to_numpy(), group["role"].to_numpy()
        m = np.flatnonzero(role & 1)
        m = m[np.unique(ids[m], return_index=True)[1]]
        q = np.flatnonzero(role & 2)
        q = q[np.unique(ids[q], return_index=True)[1]]
        found = list(model.search(int(key[1]), x[m], ids[m], x[q], ids[q], k)) if len(m) and len(q) else []
        lists = {"near": pd.Series([n for f in found for n in f[1]], dtype=object), "cos": pd.Series([c for f in found for c in f[2]], dtype=object)}
        return pd.DataFrame({"id": np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64), **lists})

    routed = rows.mapInPandas(route, "space string, cell int, split int, role int, id long, v binary")
    partial = routed.groupBy("space", "cell", "split").applyInPandas(search, "id long, near array<long>, cos array<double>")
    pairs = F.flatten(F.collect_list(F.arrays_zip("cos", "near")))
    best = F.slice(F.array_sort(F.array_distinct(F.filter(pairs, lambda p: p["cos"] > -1.5)), lambda a, b: F.when(a["cos"] != b["cos"], F.when(a["cos"] > b["cos"], -1).otherwise(1)).when(a["near"] < b["near"], -1).otherwise(1)), 1, k)
    merged = partial.groupBy("id").agg(best.alias("best")).select("id", F.explode("best").alias("b"))
    return merged.select("id", F.col("b.near").alias("neighbour_id"), F.col("b.cos").alias("cosine"))


def found(points: DataFrame, facts: DataFrame) -> DataFrame:
    """(src, vec_id, neighbour_id) for both tables."""
    p = nearest(points.select(F.col("point_id").alias("id"), "space", "vector"))
    f = nearest(facts.select(F.col("fact_id").alias("id"), F.lit("fact").alias("space"), F.col("embedding").alias("vector")))
    return p.select(F.lit("point").alias("src"), F.col("id").alias("vec_id"), "neighbour_id").unionByName(f.select(F.lit("fact").alias("src"), F.col("id").alias("vec_id"), "neighbour_id"))
