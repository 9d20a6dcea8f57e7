"""Near-duplicates by PartEnum: partition the domain of features, enumerate subsets inside a partition.

If two sets share at least half of their union, then so they do in one of any partitions of the domain, and
not emptily (the whole is a weighted mean of its parts). There sets of a and b features share c >= (a + b) / 3,
so c >= 2 unless a + b <= 3, and two shared ones stand among the first a // 2 + 2 of either, in one global order with
the features of a single record first and frequent ones last. The signatures of a partition are these subsets: each rare feature
alone, each two frequent ones together, and where a <= 2 any feature alone; similar records always have one in common. A feature
that no other record has makes no signature, as nothing can share it. How many records have a feature is counted over all
of them at one of 2^BITS places; features that fall on one place count together, which makes some signatures more and loses none.

A record in which partitions of at most TINY features weigh little does not sign for them. With X the features
and T the number of its tiny partitions and N the number of its others, 2 (X + T) < N suffices: were all partitions
that are large in both records dissimilar, they would outweigh what the tiny ones can share.

The number of partitions goes by bands of the set size (a band's top is twice the last one's); a record signs for its
own band and the next, as similar sets differ at most twofold in size. Each signature carries the sizes and a parity
bitmap of its partition: pairs that differ too much in the partition or in size fall out in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shingles import verified, word_sets
from cairn.sources.tables import materialize

#: Features in a partition at the top of a band, on average; the top of the first band.
AIM, FIRST_TOP, TINY = 20, 20, 2
#: A feature is frequent in more than one of so many records. There are at most FREQUENT x (mean set size) of them.
FREQUENT = 5_000
#: Places of the count of features, as a power of two: one bit each is sent to the workers (8 MB, whatever the size of the collection).
BITS = 26
CHUNK = 16
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def signatures(features: np.ndarray, owner: np.ndarray, sizes: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, record, parity bitmap, size) of all partitions that sign.

    ``features``: all features, ``owner``: their record's position, ``sizes``: by record, ``rank``: -1 for features of a
    single record, 0, or higher for more frequent features.
    """
    out: list[tuple[np.ndarray, ...]] = []

    def emit(sig: np.ndarray, which: np.ndarray) -> None:
        out.append((sig.view(np.int64), o[heads[which]], bitmap[which].view(np.int64), size[which].astype(np.int32)))

    own = np.full(len(sizes), FIRST_TOP)
    while (grow := own < sizes).any():
        own[grow] *= 2
    spread = mix(features)
    bits = np.uint64(1) << (spread >> np.uint64(58))
    for tops in (own, own * 2):
        count = (tops // AIM).astype(np.uint64)[owner]
        part = ((spread & np.uint64(0xFFFFFFFF)) % count).astype(np.int64)
        order = np.lexsort((features, rank, part, owner))
        f, o, part, bit, frequent, single = features[order], owner[order], part[order], bits[order], rank[order] > 0, rank[order] < 0
        heads = np.flatnonzero(np.r_[True, (np.diff(o) != 0) | (np.diff(part) != 0)])
        size = np.diff(np.r_[heads, len(f)])
        bitmap = np.bitwise_xor.reduceat(bit, heads)
        record, small = o[heads], size <= TINY
        weight = np.bincount(record, np.where(small, 2 * (size + 1), -1), len(sizes))
        signs = ~(small & (weight[record] < 0))
        with np.errstate(over="ignore"):
            place = mix((part[heads].astype(np.uint64) + np.uint64(1)) * MIX + tops[record].astype(np.uint64))
            for a in np.unique(size):
                g = np.flatnonzero((size == a) & signs)
                at = heads[g][:, None] + np.arange(min(a, a // 2 + 2))
                e, often = mix(f[at] ^ place[g][:, None]), frequent[at]
                alone = ~often & ~single[at] if a > 2 else ~single[at]
                alone[:, a // 2 + 1 :] = False
                emit(e[alone], g[np.nonzero(alone)[0]])
                for i in range(e.shape[1] - 1):
                    for j in range(i + 1, e.shape[1]):
                        both = np.flatnonzero(often[:, i] & often[:, j])
                        if len(both):
                            emit(mix(e[both, i] * np.uint64(3) + e[both, j]), g[both])
    if not out:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.int32),)
    return tuple(np.concatenate(x) for x in zip(*out))


def counted(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits of the places with two features or more, places of frequent features in order, their ranks from 1 on).

    Counts are taken by place over all features. What comes to the driver is 2^BITS bits and the frequent places.
    """
    least = max(16, sets.count() // FREQUENT)
    place = F.col("f").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    counts = sets.select(F.explode("runs").alias("f")).select(place.alias("place")).groupBy("place").agg(F.count("*").alias("n")).where("n > 1")
    rows = counts.select(F.shiftright("place", CHUNK).alias("chunk"), "place", "n").repartition("chunk").sortWithinPartitions("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, place, n = (batch.column(k).to_numpy() for k in range(3))
            for c in np.unique(chunk):
                mine = chunk == c
                bits = np.zeros(1 << CHUNK, bool)
                bits[place[mine] & ((1 << CHUNK) - 1)] = True
                often = mine & (n > least)
                lists = [pa.array([place[often].tolist()], pa.list_(pa.int32())), pa.array([n[often].tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), *lists], ["chunk", "bits", "place", "n"])

    width = 1 << (CHUNK - 3)
    bits, places, sizes = np.zeros(1 << (BITS - 3), np.uint8), [], []
    for row in rows.mapInArrow(run, "chunk int, bits binary, place array<int>, n array<long>").toLocalIterator():
        bits[row.chunk * width : (row.chunk + 1) * width] |= np.frombuffer(row.bits, np.uint8)
        places += row.place
        sizes += row.n
    places, sizes = np.array(places, np.int64), np.array(sizes, np.int64)
    ranks = np.empty(len(places), np.int64)
    ranks[np.lexsort((places, sizes))] = np.arange(1, len(places) + 1)
    order = np.argsort(places)
    return bits, places[order], ranks[order]


def candidates(sets: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of ids in ``sets`` (id, runs) that share a signature and are similar in its partition."""
    sent = sets.sparkSession.sparkContext.broadcast(counted(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known, ranks = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = part.column(0).to_numpy()
                lists = part.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                values = lists.flatten().to_numpy()
                place = values & ((1 << BITS) - 1)
                rank = ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(np.int64) - 1
                if len(known):
                    where = np.minimum(np.searchsorted(known, place), len(known) - 1)
                    rank = np.where(known[where] == place, ranks[where], rank)
                sig, record, bitmap, size = signatures(values.view(np.uint64), np.repeat(np.arange(len(ids)), sizes), sizes, rank)
                arrays = [pa.array(sig), pa.array(ids[record]), pa.array(bitmap), pa.array(size), pa.array(sizes[record].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, ["sig", "id", "bits", "n", "total"])

    signed = sets.select("id", "runs").mapInArrow(run, "sig long, id long, bits long, n int, total int")
    # both sides are the same projection, so that they are made and shuffled once
    side = lambda k: signed.select("sig", *[F.col(c).alias(f"{c}{k}") for c in ("id", "bits", "n", "total")])
    near = (F.col("id1") < F.col("id2")) & (F.col("total1") <= 2 * F.col("total2")) & (F.col("total2") <= 2 * F.col("total1"))
    near &= F.bit_count(F.col("bits1").bitwiseXOR(F.col("bits2"))) * 3 <= F.col("n1") + F.col("n2")
    return side(1).join(side(2), "sig").where(near).select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct()


def links(records: DataFrame, id_col: str = "mem_id", title: str = "description", body: str = "body", words: int = 3, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (id, class) with class the least id of equal sets, and pairs (a < b) of similar classes.

    ``threshold`` is 0.5 or more, for which the signatures are complete.
    """
    if threshold < 0.5:
        raise ValueError("signatures are complete from a threshold of 0.5")
    sets = materialize(word_sets(records, id_col, title, body, words), "sets")
    firsts = sets.groupBy("k1", "k2").agg(F.min("id").alias("class"))
    members = materialize(sets.select("id", "k1", "k2").distinct().join(firsts, ["k1", "k2"]).select("id", "class"), "members")
    folded = sets.join(members.where("id = class"), "id", "left_semi").select("id", "runs")
    return members, verified(candidates(folded), folded, folded, threshold)


def found(records: DataFrame, id_col: str = "mem_id", title: str = "description", body: str = "body", words: int = 3, threshold: float = 0.5) -> DataFrame:
    """(mem_id_a < mem_id_b): all pairs of records of which the word runs are similar.

    Null or blank bodies and texts without a run are in no pair. Groups of copies come out as all their pairs; ``classes`` is
    the form for collections in which they are large.
    """
    members, pairs = links(records, id_col, title, body, words, threshold)
    other = members.withColumnRenamed("id", "id2")
    same = members.join(other, "class").where("id < id2").select(F.col("id").alias("x"), F.col("id2").alias("y"))
    across = pairs.join(members.select(F.col("class").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("class").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    return same.unionByName(across).select(F.least("x", "y").alias("mem_id_a"), F.greatest("x", "y").alias("mem_id_b")).distinct()


def classes(records: DataFrame, id_col: str = "mem_id", title: str = "description", body: str = "body", words: int = 3, threshold: float = 0.5) -> DataFrame:
    """(mem_id, class_id, size, links): a row for each record with a set, however many copies there are.

    class_id is the least id with an equal set, size the records of the class, links the other records that are similar to this
    one, copies included. Only classes are joined, so a group of copies costs one row each.
    """
    members, pairs = links(records, id_col, title, body, words, threshold)
    sizes = materialize(members.groupBy("class").agg(F.count("*").alias("size")), "sizes")
    pairs = materialize(pairs, "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    linked = both.join(sizes.withColumnRenamed("class", "b"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("size").alias("more"))
    each = sizes.join(linked, "class", "left").select("class", "size", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    return members.join(each, "class").select(F.col("id").alias("mem_id"), F.col("class").alias("class_id"), "size", "links")
