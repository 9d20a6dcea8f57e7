"""Corpus encoding with a public byte-level BPE: speculate, verify, merge only what fails.

Greedy longest match proposes tokens for the distinct words of a batch. A proposal is the
true encoding exactly when every token encodes to itself and every adjacent pair is what the
merges make of the two tokens' bytes; the pairs of a whole batch are checked at once against
a sorted table of pairs already judged. Only words with a failing pair are merged by rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words kept with their ids in one worker; beyond it the memory is emptied (speed only).
REMEMBERED = 200_000


class SpeculativeBpe:
    def __init__(self, lines: bytes):
        pairs = (line.split() for line in lines.splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.words = {i: w for w, i in self.ranks.items()}
        self.size = max(self.words) + 1
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, np.ndarray] = {}
        self.judged = np.empty(0, np.int64)  # sorted codes of pairs (and of single tokens)
        self.verdict = np.empty(0, bool)
        self.merged = 0  # words that needed exact merging

    def merge(self, word: bytes) -> list[int]:
        """Exact byte-pair merging: always the adjacent pair of least rank, leftmost first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], self.size))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def propose(self, word: bytes) -> list[int]:
        out, at, n = [], 0, len(word)
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                if (token := self.ranks.get(word[at:end])) is not None:
                    out.append(token)
                    at = end
                    break
        return out

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """Verdicts for codes a * size + b of pairs, or size * size + a of single tokens."""
        ask = np.unique(codes)
        where = np.searchsorted(self.judged, ask)
        new = ask[(where >= len(self.judged)) | (self.judged[np.minimum(where, max(len(self.judged) - 1, 0))] != ask)] if len(self.judged) else ask
        if len(new):
            square = self.size * self.size
            fresh = np.empty(len(new), bool)
            for i, code in enumerate(new.tolist()):
                tokens = [code - square] if code >= square else list(divmod(code, self.size))
                fresh[i] = self.merge(b"".join(self.words[t] for t in tokens)) == tokens
            every = np.concatenate([self.judged, new])
            order = np.argsort(every)
            self.judged, self.verdict = every[order], np.concatenate([self.verdict, fresh])[order]
        return self.verdict[np.searchsorted(self.judged, codes)]

    def learn(self, words: list[str]) -> None:
        """Encode distinct new words into ``known``."""
        raw = [w.encode() for w in words]
        proposals = [self.propose(w) for w in raw]
        lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = owner[1:] == owner[:-1]
        codes = np.concatenate([flat[:-1][inside] * self.size + flat[1:][inside], self.size * self.size + flat])
        whose = np.concatenate([owner[1:][inside], owner])
        bad = np.zeros(len(words), bool)
        bad[whose[~self.compatible(codes)]] = True
        self.merged += int(bad.sum())
        for word, b, proposal, failed in zip(words, raw, proposals, bad.tolist()):
            self.known[word] = np.array(self.merge(b) if failed else proposal, np.int32)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; an empty array for null and empty texts."""
        pieces = [self.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for p in pieces for w in p if w not in self.known})
        if new:
            self.learn(new)
        none = np.empty(0, np.int32)
        return [np.concatenate([self.known[w] for w in p]) if p else none for p in pieces]


_ENCODERS: dict[int, SpeculativeBpe] = {}


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids) of every row, ids an array of int without special tokens.

    Null and empty texts have an empty array; repeated rows stay; other columns are ignored. The
    vocabulary file (a fixed size, under 1 MB) is read on the driver and sent with the task.
    """
    with open(vocabulary, "rb") as f:
        lines = f.read()
    key = hash(lines)
    sent = documents.sparkSession.sparkContext.broadcast(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _ENCODERS.get(key) or _ENCODERS.setdefault(key, SpeculativeBpe(sent.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = bpe.encode_batch(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], [id_col, "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")
