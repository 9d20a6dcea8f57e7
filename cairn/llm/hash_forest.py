"""New batches against all accepted history: a forest of prefix trees over min-hash signatures.

A record has a label in each of TREES trees: LEVELS min-hashes of 16 bits, the first ones most significant. The labels of a
tree in sorted order are the leaves of its prefix tree, and the records below an inner node are a range of them. The forest
keeps each tree as sorted runs: rows (cell, run, first, last, labels, ids) hold up to BLOCK labels in order as packed arrays, a cell
being a quarter of a tree. The tables are bucketed by cell, so a batch, packed in the same way, meets the history bucket by
bucket without shuffling it, and a block is opened only where the batch asks for a label between its first and last.

Look-up is by binary search for the two ends of a prefix's range, per entry and tree. Records of similarity s share a prefix
of d levels in one tree with probability s^d, so an entry that was looked up at depths d1, d2 ... finds them with a recall of
1 - (1 - s^d1)(1 - s^d2)... Each entry begins at a deep prefix in every tree. Its prefixes are widened by a level
wherever that adds at most CROWD records; an entry that is still below the recall wanted is widened further, tree by tree in the
order of what it adds, until the recall at the threshold is reached. What is found is verified on the whole word sets.

Repeats are left out as soon as they are known, as they never have to be found again. A merge makes one run of many in a pass over
their sorted blocks and takes the repeats out, as blocks of their own labels that cancel the others.
"""

from __future__ import annotations

import gc
import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import shingles
from cairn.llm.near_duplicates import mix
from cairn.llm.shingles import verified, word_sets
from cairn.sources.tables import delete, materialize, read_text, shared_dir, write_text

TREES, LEVELS, RECALL = 64, 4, 0.9995
#: Labels in one block, about; records that a wider prefix may add in one block before it is put off.
BLOCK, CROWD = 8_192, 16
#: So many runs are merged into one when they hold a quarter of it, or eight times as many in any case.
RUNS = 8
CUTS = 4
PACKED = "cell int, first long, last long, labels binary, ids binary"


def mask(depth: int, levels: int = LEVELS) -> int:
    """The bits of a label below a prefix of so many levels."""
    return (1 << 16 * (levels - depth)) - 1


def depth(similarity: float, recall: float, trees: int = TREES, levels: int = LEVELS) -> int:
    """The deepest prefix at which records of that similarity meet with the recall wanted, taken in all trees."""
    d = levels
    while d > 1 and 1 - (1 - similarity**d) ** trees < recall:
        d -= 1
    return d


def wide_trees(similarity: float, recall: float, wide: int, deep: int, trees: int = TREES) -> int:
    """The least number of trees at the wider prefix, the others at the deeper one, that reach the recall."""
    n = 0
    while n < trees and 1 - (1 - similarity**wide) ** n * (1 - similarity**deep) ** (trees - n) < recall:
        n += 1
    return n


def labels(values: np.ndarray, offsets: np.ndarray, trees: int = TREES, levels: int = LEVELS) -> np.ndarray:
    """Labels (records x trees) of the sets values[offsets[i]:offsets[i + 1]], none of them empty."""
    features = mix(values.view(np.uint64))
    seeds = mix(np.arange(1, trees * levels * 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros((len(offsets) - 1, trees), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(trees * levels):
            least = np.minimum.reduceat(features * (seeds[2 * k] | np.uint64(1)) + seeds[2 * k + 1], offsets[:-1])
            out[:, k // levels] |= (mix(least) >> np.uint64(48)) << np.uint64(16 * (levels - 1 - k % levels))
    return out


def leaves(sets: DataFrame) -> DataFrame:
    """(run, id, tree, label) of ``sets`` (id, runs, run): the label of each record in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column(2)
                offsets = lists.offsets.to_numpy()
                found = labels(lists.flatten().to_numpy(), offsets - offsets[0])
                who = np.repeat(np.arange(len(found)), TREES)
                columns = [part.column(0).take(pa.array(who)), part.column(1).take(pa.array(who)), pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(found))), pa.array(found.ravel().view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["run", "id", "tree", "label"])

    return sets.select(F.col("run").cast("int").alias("run"), "id", "runs").mapInArrow(run, "run int, id long, tree int, label long")


def packed(rows: DataFrame, buckets: int) -> DataFrame:
    """PACKED blocks, with their run, of rows (run, tree, label, id)."""
    cell = (F.col("tree") * CUTS + F.shiftrightunsigned("label", 62)).cast("int")
    ordered = rows.select(cell.alias("cell"), "label", "id", "run").repartition(buckets, "cell").sortWithinPartitions("cell", "run", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            c, keys, ids, runs = (batch.column(k).to_numpy() for k in range(4))
            cuts = [0, *(np.flatnonzero((np.diff(c) != 0) | (np.diff(runs) != 0)) + 1).tolist(), len(c)]
            for a, b in zip(cuts, cuts[1:]):
                if held and ((c[a], runs[a]) != now or sum(len(x[0]) for x in held) + b - a > BLOCK):
                    yield block(*now, *(np.concatenate(x) for x in zip(*held)))
                    held = []
                now = (c[a], runs[a])
                held.append((keys[a:b], ids[a:b]))
        if held:
            yield block(*now, *(np.concatenate(x) for x in zip(*held)))

    return ordered.mapInArrow(run, f"{PACKED}, run int")


def block(cell: int, run: int, keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([cell], pa.int32()), pa.array(keys[:1]), pa.array(keys[-1:]), pa.array([keys.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary()), pa.array([run], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["cell", "first", "last", "labels", "ids", "run"])


def merged(blocks: DataFrame, buckets: int) -> DataFrame:
    """PACKED blocks of one run, out of the blocks (cell, first, labels, ids, keep) of many, read in the order of their first labels.

    A label in a block without ``keep`` cancels the same label of the same id. Labels below the first one of the next block
    are final, so no more is held than blocks that overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, keys, ids, keep = None, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

        def cut(upto: int) -> Iterator[pa.RecordBatch]:
            stays = keep[:upto] & ~np.isin(ids[:upto], ids[:upto][~keep[:upto]])
            k, i = keys[:upto][stays], ids[:upto][stays]
            for at in range(0, len(k), BLOCK):
                yield block(cell, 0, k[at : at + BLOCK], i[at : at + BLOCK])

        for batch in batches:
            for c, a, b, good in zip(*(batch.column(x).to_pylist() for x in range(4))):
                more, whose = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                final = len(keys) if c != cell else int(np.searchsorted(keys, more[0]))
                if c != cell or final >= BLOCK:
                    yield from cut(final)
                    keys, ids, keep, cell = keys[final:], ids[final:], keep[final:], c
                keys, ids, keep = np.concatenate([keys, more]), np.concatenate([ids, whose]), np.concatenate([keep, np.full(len(more), good)])
                order = np.argsort(keys, kind="stable")
                keys, ids, keep = keys[order], ids[order], keep[order]
        yield from cut(len(keys))

    return blocks.repartition(buckets, "cell").sortWithinPartitions("cell", "first").select("cell", "labels", "ids", "keep").mapInArrow(run, f"{PACKED}, run int")


def ranges(keys: np.ndarray, asked: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the range of sorted ``keys`` below the prefix of each label asked for."""
    low = np.int64(mask(depth))
    return np.searchsorted(keys, asked & ~low, "left"), np.searchsorted(keys, asked | low, "right")


def search(asked: DataFrame, held: list[DataFrame], number: int, wide: int, deep: int, crowd: int | None) -> DataFrame:
    """(a, b, old, tree, n) of PACKED blocks asked for, against those ``held``: of their batch, which is run ``number``, and of the history.

    A row with a null tree is a candidate: a is a record below a prefix that b shares; ``old`` says that a is of an earlier
    batch, else a < b. A row with a tree says that the wider prefix of b there was put off, as it adds n records, more than ``crowd``.
    """
    low = mask(wide)
    q = asked.select("cell", *[F.col(c).alias(f"q_{c}") for c in ("first", "last", "labels", "ids")])
    meet = (F.col("last") >= F.col("q_first").bitwiseAND(F.lit(~low))) & (F.col("first") <= F.col("q_last").bitwiseOR(F.lit(low)))
    # both sides lie in buckets of cells: hashing the batch's share of a bucket takes no job of its own, as sending it to all would
    met = [part.join(q.hint("shuffle_hash"), "cell").where(meet).select("cell", (F.col("run") == number).alias("mine"), "labels", "ids", "q_labels", "q_ids") for part in held]
    rows = met[0]
    for part in met[1:]:
        rows = rows.unionByName(part)
    names = ["a", "b", "old", "tree", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cell, mine, *blobs = (batch.column(c)[k].as_py() for c in range(6))
                keys, ids, asked, whose = (np.frombuffer(x, np.int64) for x in blobs)
                low, high = ranges(keys, asked, wide)
                late = np.empty(0, np.int64)
                if deep != wide and crowd is not None:
                    near, far = ranges(keys, asked, deep)
                    late = np.flatnonzero(high - low - (far - near) > crowd)
                    added = (high - low - (far - near))[late]
                    low[late], high[late] = near[late], far[late]
                sizes = high - low
                who = np.repeat(np.arange(len(asked)), sizes)
                a = ids[np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)]
                b = whose[who]
                if mine:
                    a, b = a[a < b], b[a < b]
                pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
                n, m = len(pairs), len(late)
                if n or m:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.r_[pairs[:, 0], np.zeros(m, np.int64)], mask=np.arange(n + m) >= n), pa.array(np.r_[pairs[:, 1], whose[late]]), pa.array(np.full(n + m, not mine)),
                            pa.array(np.full(n + m, cell // CUTS, np.int32), mask=np.arange(n + m) < n), pa.array(np.r_[np.zeros(n, np.int64), added] if m else np.zeros(n, np.int64)),
                        ],
                        names,
                    )

    return rows.mapInArrow(run, "a long, b long, old boolean, tree int, n long").distinct()


class HashForest:
    """Accepted history, batch by batch, in a folder that a later session can open again.

    ``stage`` writes one or more batches into an area of the folder, ``ingest`` judges the next one of them. What was judged is
    committed by rewriting one small file last: after a failure, open the forest again and go on.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, threshold: float = 0.5, recall: float = RECALL):
        """A new, empty forest; use ``open`` for one that is there."""
        buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self._set(spark, folder or shared_dir(spark), {"threshold": threshold, "recall": recall, "buckets": buckets, "next": 1, "areas": {}, "waiting": [], "held": 0, "added": {}, "done": []})
        self._commit()

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> HashForest:
        text = read_text(spark, f"{folder}/forest.json")
        if text is None:
            raise ValueError(f"no forest in {folder}")
        self = cls.__new__(cls)
        self._set(spark, folder, json.loads(text))
        return self

    def _set(self, spark: SparkSession, folder: str, state: dict) -> None:
        self.spark, self.folder, self.state = spark, folder, state
        self.name = f"cairn_forest_{uuid.uuid4().hex}"
        s, r = state["threshold"], state["recall"]
        self.wide = depth(s, r)
        self.deep = min(LEVELS, self.wide + 1)
        self.needed = wide_trees(s, r, self.wide, self.deep) if self.deep > self.wide else TREES
        for area in state["areas"]:
            self._table(area, known=True)

    def _table(self, area: str, known: bool = False) -> str:
        name = f"{self.name}_{area}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({PACKED}, run INT) USING parquet PARTITIONED BY (run) CLUSTERED BY (cell) INTO {self.state['buckets']} BUCKETS LOCATION '{self.folder}/{area}/labels'")
        if known:
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return name

    def _commit(self) -> None:
        write_text(self.spark, f"{self.folder}/forest.json", json.dumps(self.state))

    def _new_area(self) -> str:
        area = f"a{self.state['next']}_{uuid.uuid4().hex[:8]}"
        self.state["next"] += 1
        return area

    def _blocks(self, area: str, runs: list[int]) -> DataFrame:
        return self.spark.table(f"{self.name}_{area}").where(F.col("run").isin(runs))

    def _held(self, area: str, number: int) -> list[DataFrame]:
        """Blocks of the history and of the run ``number`` of ``area``."""
        held = {a: [*runs, number] if a == area else runs for a, runs in self.state["areas"].items()}
        return [self._blocks(a, runs) for a, runs in held.items() if runs]

    def _sets(self, area: str, runs: list[int]) -> DataFrame:
        return self.spark.read.schema("id long, runs array<long>").parquet(*[f"{self.folder}/{area}/sets/run={r}" for r in runs])

    def _gone(self) -> DataFrame:
        """Ids of the repeats in runs that are not merged yet."""
        schema = "kept_id long, mem_id long"
        paths = [f"{self.folder}/repeats/run={r}" for r in self.state["added"]]
        return (self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)).select("mem_id")

    def stage(self, sets: DataFrame, batches: list[int]) -> None:
        """Writes the rows (id, runs, k1, k2, batch) of ``batches``, in this order, as runs that wait to be ingested.

        Equal sets of a batch are folded: the first one by id stands for them, and its copies follow its judgement. Every row is
        read once.
        """
        area, first = self._new_area(), self.state["next"]
        number = {b: first + k for k, b in enumerate(batches)}
        self.state["next"] += len(batches)
        run = F.col("batch")
        if number:
            run = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])[F.col("batch")]
        rows = materialize(sets.withColumn("run", run.cast("int")).where("run is not null").select("id", "runs", "k1", "k2", "run"), "rows")
        names = rows.select("run", "id", "k1", "k2")
        firsts = names.groupBy("run", "k1", "k2").agg(F.min("id").alias("first"))
        names.join(firsts, ["run", "k1", "k2"]).where("id <> first").select("run", "id", "first").distinct().write.partitionBy("run").parquet(f"{self.folder}/{area}/copies")
        rows.select("run", "id", "runs").join(firsts.select("run", F.col("first").alias("id")), ["run", "id"], "left_semi").write.partitionBy("run").parquet(f"{self.folder}/{area}/sets")
        kept = self.spark.read.schema("id long, runs array<long>, run int").parquet(f"{self.folder}/{area}/sets")
        packed(leaves(kept), self.state["buckets"]).write.mode("append").insertInto(self._table(area))
        sizes = {r[0]: r[1] for r in kept.groupBy("run").count().toLocalIterator()}  # a row for each batch
        copies = {r[0]: r[1] for r in self.spark.read.schema("id long, first long, run int").parquet(f"{self.folder}/{area}/copies").groupBy("run").count().toLocalIterator()}
        self.state["areas"][area] = []
        self.state["waiting"] += [[area, r, sizes.get(r, 0), copies.get(r, 0)] for r in number.values()]
        self._commit()

    def ingest(self) -> DataFrame:
        """(kept_id, mem_id) of the records in the next waiting batch that repeat an accepted one; the others are accepted.

        Records are judged in the order of their ids, against what earlier batches left accepted and their own batch;
        kept_id is the least accepted match. Ids must be new, but need not be greater than those of earlier batches.
        """
        area, number, size, n_copies = self.state["waiting"][0]
        path, schema = f"{self.folder}/repeats/run={number}", "kept_id long, mem_id long"
        none = self.spark.createDataFrame([], schema)
        candidates, n = self._candidates(area, number) if size else (None, 0)
        copies = self.spark.read.schema("id long, first long").parquet(f"{self.folder}/{area}/copies/run={number}") if n_copies else None

        def write(judged: DataFrame) -> None:
            out = judged
            if copies is not None:
                follow = copies.join(judged.select(F.col("mem_id").alias("first"), "kept_id"), "first", "left")
                out = judged.unionByName(follow.select(F.coalesce("kept_id", "first").alias("kept_id"), F.col("id").alias("mem_id")))
            out.write.mode("overwrite").parquet(path)

        if not n:
            write(none)
        elif n + n_copies <= shingles.FEW_PAIRS:
            rows = self._similar(area, number, candidates, n)
            if copies is not None:
                rows = rows.unionByName(copies.select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(None).cast("boolean").alias("old")))
            with planned_once(self.spark):
                judge_few(rows).write.mode("overwrite").parquet(path)
        else:
            pairs = materialize(self._similar(area, number, candidates, n), "pairs")
            # where no first record of a pair in the batch repeats anything itself, all of them are accepted
            marked = pairs.join(pairs.select(F.col("b").alias("a"), F.lit(True).alias("again")).distinct(), "a", "left")
            marked, chains = watched(marked, n=F.count_if(F.col("again") & ~F.col("old")))
            write(least(marked))
            if chains()["n"]:
                write(judge(pairs))
        self.state["waiting"].pop(0)
        self.state["added"][str(number)] = size
        self.state["done"].append(number)
        if size:
            self.state["areas"][area].append(number)
        runs, added = sum(map(len, self.state["areas"].values())), sum(self.state["added"].values())
        old = self._merge() if runs >= RUNS and (4 * added >= self.state["held"] or runs >= 8 * RUNS) else []
        self._commit()
        for gone in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{gone}")
            delete(self.spark, f"{self.folder}/{gone}")
        return self.spark.read.schema(schema).parquet(path)

    def _candidates(self, area: str, number: int) -> tuple[DataFrame, int]:
        """(a, b, old) below common prefixes, b of the batch, a of the batch or accepted before; and their number."""
        found = self._alive(search(self._blocks(area, [number]), self._held(area, number), number, self.wide, self.deep, CROWD))
        found, seen = watched(found, pairs=F.count("a"), late=F.count("tree"))
        with planned_once(self.spark):
            found = materialize(found, "candidates")
        counts = seen()
        n, pairs = counts["pairs"], found.where("tree is null").select("a", "b", "old")
        if counts["late"]:
            trees = found.where("tree is not null").groupBy("b", "tree").agg(F.sum("n").alias("n"))
            whole = Window.partitionBy("b")
            trees = trees.withColumn("more", F.lit(self.needed - TREES) + F.count("*").over(whole)).withColumn("place", F.row_number().over(whole.orderBy("n", "tree")))
            pairs = pairs.unionByName(self._widened(area, number, trees.where("place <= more").select(F.col("b").alias("id"), "tree"))).distinct()
            pairs, seen = watched(pairs, pairs=F.count("a"))
            pairs = materialize(pairs, "candidates")
            n = seen()["pairs"]
        return pairs, n

    def _similar(self, area: str, number: int, pairs: DataFrame, n: int) -> DataFrame:
        """Those of the ``n`` candidates whose sets are similar."""
        own = self._sets(area, [number])
        every = own
        for a, runs in self.state["areas"].items():
            every = every.unionByName(self._sets(a, runs)) if runs else every
        return verified(pairs, every, own, self.state["threshold"], n)

    def _alive(self, found: DataFrame) -> DataFrame:
        """Without what was found as a repeat since the last merge."""
        return found.join(self._gone(), F.col("a") == F.col("mem_id"), "left_anti") if self.state["added"] else found

    def _widened(self, area: str, number: int, chosen: DataFrame) -> DataFrame:
        """Candidates (a, b, old) below the wider prefixes of the (id, tree) in ``chosen``."""
        entries = self._sets(area, [number]).join(chosen.select("id").distinct(), "id", "left_semi").withColumn("run", F.lit(number))
        few = packed(leaves(entries).join(chosen, ["id", "tree"]), self.state["buckets"])
        return self._alive(search(few, self._held(area, number), number, self.wide, self.deep, None)).select("a", "b", "old")

    def _merge(self) -> list[str]:
        """Merges the ingested runs of all areas into one, without repeats; gives the areas that are no longer needed."""
        area, buckets = self._new_area(), self.state["buckets"]
        gone = self._gone()
        fresh = None
        blocks = every = None
        for a, runs in self.state["areas"].items():
            if runs:
                part, sets = self._blocks(a, runs).withColumn("keep", F.lit(True)), self._sets(a, runs)
                blocks, every = (part, sets) if blocks is None else (blocks.unionByName(part), every.unionByName(sets))
                late = [r for r in runs if str(r) in self.state["added"]]
                if late:
                    fresh = self._sets(a, late) if fresh is None else fresh.unionByName(self._sets(a, late))
        dead = fresh.join(gone, F.col("id") == F.col("mem_id"), "left_semi").withColumn("run", F.lit(0))
        kept = ["cell", "first", "labels", "ids", "keep"]
        every.join(gone, F.col("id") == F.col("mem_id"), "left_anti").write.parquet(f"{self.folder}/{area}/sets/run=0")
        merged(blocks.select(*kept).unionByName(packed(leaves(dead), buckets).withColumn("keep", F.lit(False)).select(*kept)), buckets).write.mode("append").insertInto(self._table(area))
        waiting = {w[0] for w in self.state["waiting"]}
        old = [a for a in self.state["areas"] if a not in waiting]
        self.state["held"] += sum(self.state["added"].values())
        self.state["added"] = {}
        self.state["areas"] = {a: [] for a in self.state["areas"] if a in waiting} | {area: [0]}
        return old

    def repeats(self) -> DataFrame:
        """(kept_id, mem_id) of all batches ingested so far."""
        schema = "kept_id long, mem_id long"
        paths = [f"{self.folder}/repeats/run={r}" for r in self.state["done"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def close(self) -> None:
        """Forgets the tables' names; the folder stays and can be opened."""
        for area in self.state["areas"]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{area}")


@contextmanager
def planned_once(spark: SparkSession) -> Iterator[None]:
    """Plans that are not adapted at run time: each is one job, besides what it broadcasts.

    Adapting takes a job, threads and a new plan in the driver for every shuffle, of which a batch has no use where sizes are known.
    """
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def watched(rows: DataFrame, **counts: Column) -> tuple[DataFrame, Callable[[], dict]]:
    """``rows`` and, for after they were written, aggregates of them that were taken on the way.

    Where adaptive planning finds that there are no rows it takes the observation out of the plan; then they are asked for.
    """
    seen, wanted = Observation(), [c.alias(n) for n, c in counts.items()]

    def get() -> dict:
        try:
            return seen.get
        except Py4JJavaError:
            return rows.agg(*wanted).first().asDict()

    return rows.observe(seen, *wanted), get


def least(pairs: DataFrame) -> DataFrame:
    """(kept_id, mem_id): the least match of each b."""
    return pairs.groupBy(F.col("b").alias("mem_id")).agg(F.min("a").alias("kept_id")).select("kept_id", "mem_id")


def judge_few(pairs: DataFrame) -> DataFrame:
    """What ``judge`` gives, in one task, which takes a job where the rounds take several; for pairs that fit into its memory.

    Rows without ``old`` are copies b of a, which follow its judgement.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            t = pa.Table.from_batches(parts).sort_by([("b", "ascending"), ("a", "ascending")])
            kept, copies = {}, []
            for a, b, old in zip(*(t.column(c).to_pylist() for c in ("a", "b", "old"))):
                if old is None:
                    copies.append((a, b))
                elif b not in kept and (old or a not in kept):  # in the batch a < b, so a is judged already
                    kept[b] = a
            out = [(a, b) for b, a in kept.items()] + [(kept.get(a, a), b) for a, b in copies]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], ["kept_id", "mem_id"])

    return pairs.select("a", "b", "old").repartition(1).mapInArrow(run, "kept_id long, mem_id long")


def judge(pairs: DataFrame) -> DataFrame:
    """Acceptance of one batch in the order of ids, by rounds: what has no open smaller match is accepted, and its matches are repeats.

    ``pairs``: (a, b, old); an old a is accepted. Each round settles at least the least open record, most rounds nearly all.
    """
    inside = pairs.where("not old").select("a", "b")
    repeats = pairs.where("old").select(F.col("b").alias("r")).distinct()
    drop = lambda open_, gone: open_.join(gone, F.col("a") == F.col("r"), "left_anti").join(gone, F.col("b") == F.col("r"), "left_anti")
    open_ = materialize(drop(inside, repeats), "open")
    while True:
        waiting = open_.select(F.col("b").alias("w")).distinct()
        if open_.join(waiting, F.col("a") == F.col("w"), "left_semi").isEmpty():
            repeats = repeats.unionByName(waiting.withColumnRenamed("w", "r"))
            break
        gone = materialize(open_.join(waiting, F.col("a") == F.col("w"), "left_anti").select(F.col("b").alias("r")).distinct(), "gone")
        repeats = repeats.unionByName(gone)
        open_ = materialize(drop(open_, gone), "open")
    accepted = pairs.where("not old").join(repeats.distinct(), F.col("a") == F.col("r"), "left_anti").select("a", "b")
    return least(pairs.where("old").select("a", "b").unionByName(accepted))


def found(records: DataFrame, id_col: str = "mem_id", batch_col: str = "batch_no", title: str = "name", body: str = "body", words: int = 3, threshold: float = 0.5) -> DataFrame:
    """(kept_id, mem_id): every record that repeats an accepted one. Each batch is ingested on its own, in the order of batch_no.

    Null and blank bodies and texts without a run are in no case; rows with a null batch come first. A row repeated under one id
    with equal text counts once. Records of one batch go by id.
    """
    batched = records.withColumn("_batch", F.coalesce(F.col(batch_col).cast("long"), F.lit(-1)))
    forest = HashForest(records.sparkSession, threshold=threshold)
    batches = [r[0] for r in batched.select("_batch").distinct().orderBy("_batch").toLocalIterator()]  # a row for each batch
    forest.stage(word_sets(batched, id_col, title, body, words, more={"batch": "_batch"}), batches)
    for _ in batches:
        forest.ingest()
        # the driver lets go of a batch's plans, broadcast blocks and generated classes, which otherwise pile up from batch to batch
        gc.collect()
        records.sparkSession._jvm.System.gc()
    forest.close()
    return forest.repeats()
