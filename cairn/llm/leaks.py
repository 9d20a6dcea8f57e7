"""Held-out texts inside training texts: a BM25 inverted index with block-max WAND, then exact overlap.

The test items are the index: a postings list for each term, in the order of items, cut into blocks of BLOCK postings with the
greatest weight and the last item of each. Passages of the documents are the queries: of each stretch of words that the items know,
the 23 words that start at each 12th word, so any run of 12 words of an item lies in a passage. A passage that shares 12
consecutive words with an item scores at least the item's weakest run of 12, so an item's weights are divided by that and the
threshold is 1 for every item: all above it are retrieved and nothing that counts can be lost.

Search is document-at-a-time: the cursors of a passage's words stand on items; in the order of items the bounds of the words are added
up until they reach the threshold, which gives the pivot, and no item before it can reach it. If the bounds of the blocks that
would hold the pivot do not reach it either, the cursors skip past the first of these blocks to end; else the pivot is scored. Many
passages take these steps together in numpy. What is retrieved is held word by word against the item.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common_form import LookAlikes, fit

WORD = re.compile(r"[^\W_]+")
RUN = 12
PASSAGE = 2 * RUN - 1
#: Postings in a block.
BLOCK = 16
K1, B = 1.2, 0.75
#: Bytes of one index that is sent to the executors; more items make more indexes.
INDEX_BYTES = 64_000_000
#: Passages that are searched together.
TOGETHER = 4_096
EPS = 1e-6


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bytes_of(ws: list[str]) -> int:
    """What an item takes in an index: 24 bytes a posting, 20 a word, and its terms (at most, as items share them)."""
    return 24 * len(set(ws)) + 20 * len(ws) + sum(len(w) + 120 for w in set(ws))


class Index:
    """Block-max inverted index of items [(item_id, words)]. Its size is in proportion to the postings and words."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        items = [x for x in items if len(x[1]) >= RUN]
        self.ids = [i for i, _ in items]
        df = Counter(w for _, ws in items for w in set(ws))
        self.vocabulary = {w: k for k, w in enumerate(sorted(df))}
        self.none = len(self.vocabulary)  # a term for words that no item has
        n, average = len(items), sum(len(ws) for _, ws in items) / max(1, len(items))
        self.end = n
        idf = np.array([math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in self.vocabulary])
        flat = [np.array([self.vocabulary[w] for w in ws]) for _, ws in items]
        terms, whose, weights = [], [], []
        for k, tids in enumerate(flat):
            t, back, tf = np.unique(tids, return_inverse=True, return_counts=True)
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(tids) / average))
            weakest = np.convolve(w[back], np.ones(RUN), "valid").min()
            terms.append(t)
            whose.append(np.full(len(t), k))
            weights.append(w / max(weakest, 1e-9))
        # each list ends with a posting of no item, so that a cursor always stands on something of its own list
        self.step = n + 1
        keys = np.concatenate([*[t * self.step + k for t, k in zip(terms, whose)], np.arange(self.none + 1) * self.step + n])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.weight = np.concatenate([*weights, np.zeros(self.none + 1)])[order].astype(np.float32)
        self.item = (self.keys % self.step).astype(np.int32)
        term = self.keys // self.step
        heads = np.searchsorted(self.keys, np.arange(self.none + 1) * self.step)
        block = (np.arange(len(self.keys)) - heads[term]) // BLOCK
        starts = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(block) != 0)])
        sizes = np.diff(np.r_[starts, len(self.keys)])
        self.block_best = np.repeat(np.maximum.reduceat(self.weight, starts), sizes)
        self.block_last = np.repeat(self.item[starts + sizes - 1], sizes)
        self.best = np.maximum.reduceat(self.weight, heads)
        self.head = heads
        # the runs of 12 words of all items, by their hash
        self.words = np.concatenate([*flat, np.empty(0, int)]).astype(np.int32)
        self.mix = np.array([pow(6364136223846793005, k + 1, 1 << 64) for k in range(RUN)], np.uint64)
        hashes, at, owner, base = [np.empty(0, np.uint64)], [np.empty(0, int)], [np.empty(0, int)], 0
        for k, tids in enumerate(flat):
            h = self.hashes(tids)
            hashes.append(h)
            at.append(base + np.arange(len(h)))
            owner.append(np.full(len(h), k))
            base += len(tids)
        hashes, at, owner = (np.concatenate(x) for x in (hashes, at, owner))
        order = np.argsort(hashes, kind="stable")
        self.run_hash, self.run_at, self.run_item = hashes[order], at[order], owner[order]

    def hashes(self, tids: np.ndarray) -> np.ndarray:
        """A number for each run of 12 term ids."""
        n = len(tids) - RUN + 1
        with np.errstate(over="ignore"):
            return sum((tids[k : k + n].astype(np.uint64) + np.uint64(7)) * self.mix[k] for k in range(RUN))

    def wand(self, passages: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of ``passages``, items) that reach the threshold. ``passages``: term ids, a row each, filled up with ``none``."""
        row, terms = np.arange(len(passages)), passages.astype(np.int64)
        at = self.head[terms]
        while len(row):
            items = self.item[at]
            order = np.argsort(items, axis=1, kind="stable")
            items, terms, at = (np.take_along_axis(x, order, 1) for x in (items, terms, at))
            bound = np.cumsum(np.where(items < self.end, self.best[terms], 0), axis=1, dtype=np.float64)
            live = bound[:, -1] >= 1 - EPS
            row, items, terms, at, bound = row[live], items[live], terms[live], at[live], bound[live]
            if not len(row):
                return
            pivot = np.take_along_axis(items, (bound >= 1 - EPS).argmax(1)[:, None], 1)
            within = items <= pivot
            there = np.where(within, np.searchsorted(self.keys, terms * self.step + pivot), at)
            blocks = np.where(within, self.block_best[there], 0).sum(1, dtype=np.float64)
            score = np.where(self.item[there] == pivot, self.weight[there], 0).sum(1, dtype=np.float64)
            hit = (blocks >= 1 - EPS) & (score >= 1 - EPS)
            if hit.any():
                yield row[hit], pivot[hit, 0]
            # past the pivot, or past the first block to end, but not past the next cursor
            last = np.where(within, self.block_last[there], self.end).min(1)
            ahead = np.where(within, self.end, items).min(1)
            target = np.where(blocks >= 1 - EPS, pivot[:, 0] + 1, np.maximum(np.minimum(last + 1, ahead), pivot[:, 0] + 1))
            at = np.where(within, np.searchsorted(self.keys, terms * self.step + np.minimum(target, self.end)[:, None]), at)

    def overlap(self, passage: np.ndarray, item: int) -> bool:
        tids = passage[passage != self.none]
        for s, h in enumerate(self.hashes(tids)):
            a, b = np.searchsorted(self.run_hash, h, "left"), np.searchsorted(self.run_hash, h, "right")
            for k in range(a, b):
                if self.run_item[k] == item and (self.words[self.run_at[k] : self.run_at[k] + RUN] == tids[s : s + RUN]).all():
                    return True
        return False


def search_texts(index: Index, ids: list, texts: list[str | None], model: LookAlikes) -> set[tuple]:
    """Distinct (id, item_id) of one batch."""
    flat: list[int] = []
    begins, owner = [], []
    for i, text in zip(ids, texts):
        if text:
            begins.append(len(flat))
            owner.append(i)
            flat += [index.vocabulary.get(w, index.none) for w in words(model.form(text))]
            flat.append(index.none)
    if not flat or not index.ids:
        return set()
    tids = np.array(flat)
    edge = np.diff(np.r_[False, tids != index.none, False].astype(np.int8))
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = after - first >= RUN
    first, after = first[long], after[long]
    count = (after - first - RUN) // RUN + 1
    starts = np.repeat(first, count) + RUN * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    spots = starts[:, None] + np.arange(PASSAGE)
    passages = np.where(spots < np.repeat(after, count)[:, None], tids[np.minimum(spots, len(tids) - 1)], index.none).astype(np.int32)
    of = np.searchsorted(begins, starts, "right") - 1
    passages, back = np.unique(passages, axis=0, return_inverse=True)
    order = np.argsort(back.ravel(), kind="stable")
    cuts = np.searchsorted(back.ravel()[order], np.arange(len(passages) + 1))
    out: set[tuple] = set()
    for at in range(0, len(passages), TOGETHER):
        for rows, items in index.wand(passages[at : at + TOGETHER]):
            for r, k in zip((rows + at).tolist(), items.tolist()):
                if index.overlap(passages[r], k):
                    out |= {(owner[of[p]], index.ids[k]) for p in order[cuts[r] : cuts[r + 1]]}
    return out


def found(documents: DataFrame, items: DataFrame, model: LookAlikes | None = None) -> DataFrame:
    """(doc_id, item_id), distinct: the document shares 12 consecutive words with the item, both in common form.

    Null, empty and short texts are in no case. Items pass the driver one by one, which makes the indexes; an index holds
    up to INDEX_BYTES, and further items make further indexes, each of which all documents are held against.
    """
    model = model or fit(documents)
    context = documents.sparkSession.sparkContext
    letters = context.broadcast(model.counts)
    kind = documents.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()

    def against(shard: list[tuple[int, list[str]]]) -> DataFrame:
        sent = context.broadcast(Index(shard))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index, model = sent.value, LookAlikes(letters.value)
            for part in parts:
                for at in range(0, len(part), 1_000):
                    some = part.iloc[at : at + 1_000]
                    yield pd.DataFrame(sorted(search_texts(index, some.iloc[:, 0].tolist(), some.iloc[:, 1].tolist(), model)), columns=["doc_id", "item_id"])

        return documents.select("doc_id", "text").where(F.length("text") > 0).mapInPandas(run, f"doc_id {kind}, item_id {item_kind}")

    out, shard, room = None, [], INDEX_BYTES
    for row in items.select("item_id", "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        ws = words(model.form(row.text))
        if shard and room < bytes_of(ws):
            out = against(shard) if out is None else out.unionByName(against(shard))
            shard, room = [], INDEX_BYTES
        room -= bytes_of(ws)
        shard.append((row.item_id, ws))
    out = against(shard) if out is None else out.unionByName(against(shard))
    return out.distinct()
