"""Personal information in free text: a linear-chain conditional random field over word shapes.

The model is trained on the driver from a small labelled table (a bounded number of rows, see
``personal_examples.table``) and kept in the shared folder, from where later sessions load it. Tokens are runs of letters, runs of
digits and single signs. Their features are the shapes of the token, of its neighbours and of the pieces between blanks; words
and affixes count only of the token and the ones right beside it, and only where the table has them more than once, so that whole
sentences cannot be learnt by heart. As every feature belongs to one token at one distance, the scores of a token at each distance are
summed once for each distinct token, and a text is scored by adding rows of tables. Viterbi decodes batches of lines in numpy.
"""

from __future__ import annotations

import base64
import hashlib
import inspect
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.personal_examples import table
from cairn.sources.tables import read_text, shared_base, write_text

KINDS = ["name", "email", "phone", "address", "id_number"]
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*|\d+|[^\s]")
CHUNK = re.compile(r"\S+")
LINE = re.compile(r"[^\n\r]+")
NEAR, FAR = range(-8, 9), range(-2, 3)
#: Words that tell what stands near them, by what they tell; their class counts at a distance, where words themselves do not.
CUES = {
    "thing": "release releases version versions product products service services project projects build builds codename codenames edition milestone sprint sprints label labels module package packages tool tools brand brands feature features branch branches cluster clusters chapter team group board inc ltd gmbh corp company vendor dienst dienste produkt produkte projekt équipe projet produit equipo proyecto servicio producto",
    "person": "said says asked asks wrote writes called phoned reported signed approved reviewed drafted owns lives works joined left met hired thinks knows wants contact ask tell thank thanks dear hi hello regards author owner manager engineer customer colleague reporter applicant witness sagt sagte fragt fragte wohnt arbeitet schrieb dit habite travaille écrit dice dijo vive trabaja escribió",
    "phone": "phone telephone tel call dial ring mobile cell fax hotline pager text voicemail téléphone appeler rappeler teléfono llamar telefon anrufen rückruf handy",
    "id": "ssn passport license licence id dni nif tax tin social security insurance identity card citizen personalausweis ausweis reisepass führerschein permis passeport pasaporte national",
}
CUE = {w: k for k, ws in CUES.items() for w in ws.split()}
#: Blanks between the lines of a batch, so that no neighbour is seen across.
GAP = 8
#: Distinct pieces of text whose scores one worker keeps; then they are made anew (speed only).
REMEMBERED = 60_000
#: Tokens decoded in one block of lines.
BLOCK_TOKENS = 16_000


AT = re.compile(r"@|(?:^|[\s\[({<])at(?=$|[\s\])}>])", re.IGNORECASE)


def possible(kind: str, text: str) -> bool:
    """What any mention of its kind has: a check of what was decoded."""
    numbers = sum(c.isdigit() for c in text)
    if kind == "email":
        return bool(AT.search(text)) and ("." in text or "dot" in text.lower())
    if kind == "phone":
        return 7 <= numbers <= 15
    if kind == "id_number":
        return numbers >= 5
    if kind == "address":
        return numbers > 0 and any(len(w) > 2 and w[0].isalpha() for w in text.split())
    return not numbers and text[:1].isalpha() and any(c.isupper() for c in text)


class _Signs(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        return out


SIGNS = _Signs()
RUNS = {n: re.compile(r"(.)\1{%d,}" % n) for n in (1, 4, 8)}


@lru_cache(maxsize=4096)
def shape(text: str, longest: int) -> str:
    """Letters as X and x, digits as 9, runs of more than ``longest`` cut."""
    return RUNS[longest].sub(lambda m: m[1] * longest + "+", text.translate(SIGNS))


def token_features(token: str, first: bool, distance: int) -> list[str]:
    """Features of a token seen from ``distance`` tokens away; ``first``: a blank or nothing stands before it."""
    low, form = token.lower(), shape(token, 4)
    out = [f"k{distance}|{CUE[low]}", f"k{'+' if distance > 0 else '-'}|{CUE[low]}"] if distance and low in CUE else []
    if abs(distance) > 4:
        return out
    out.append(f"s{distance}|{form}{int(first)}")
    if abs(distance) <= 1:
        out += [f"w{distance}|{low}", f"e{distance}|{low[-3:]}", f"f{distance}|{low[-2:]}|{form[:1]}"]
    if distance == 0:
        out += [f"p|{low[:3]}", f"n|{len(token)}|{form}", "bias"]
    return out


def chunk_features(chunk: str, distance: int) -> list[str]:
    short, low = shape(chunk, 1), chunk.lower()
    out = [f"C{distance}|{short[:24]}", f"L{distance}|{shape(chunk.strip('.,;:()<>'), 8)[:24]}"]
    if abs(distance) == 1:
        out.append(f"W{distance}|{low}")
    if "@" in chunk:
        out.append(f"@{distance}|{short.count('@')}{'.' in chunk.partition('@')[2]}{':' in chunk}")
    return out


def allowed() -> np.ndarray:
    """Zero for a possible step between labels, a great loss for an inside without its beginning."""
    out = np.zeros((len(LABELS), len(LABELS)), np.float32)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            out[[i for i, a in enumerate(LABELS) if a[2:] != b[2:] or a == "O"], j] = -1e4
    return out


class Tagger:
    def __init__(self, weights: dict[str, np.ndarray], steps: np.ndarray):
        self.weights, self.steps = weights, steps.astype(np.float32)
        self.start = np.array([-1e4 if x[0] == "I" else 0 for x in LABELS], np.float32)
        self.reset()

    def packed(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """For sending: names, their weights as one table, steps."""
        return list(self.weights), np.stack(list(self.weights.values())), self.steps

    @classmethod
    def unpacked(cls, names: list[str], rows: np.ndarray, steps: np.ndarray) -> Tagger:
        return cls(dict(zip(names, rows)), steps)

    def reset(self) -> None:
        self.tokens: dict[tuple[str, bool], int] = {}
        self.chunks: dict[str, tuple[int, list[int], list[int], list[int]]] = {}
        self.near = np.zeros((len(NEAR), 1024, len(LABELS)), np.float32)  # by token, of which 0 is a blank; grows
        self.far = np.zeros((len(FAR), 1024, len(LABELS)), np.float32)  # by piece

    def total(self, features: list[str]) -> np.ndarray:
        out = np.zeros(len(LABELS), np.float32)
        for f in features:
            if (w := self.weights.get(f)) is not None:
                out += w
        return out

    def chunk(self, text: str) -> tuple[int, list[int], list[int], list[int]]:
        """(number of the piece, its tokens' numbers, starts, ends)."""
        if (known := self.chunks.get(text)) is None:
            numbers, starts, ends = [], [], []
            for m in TOKEN.finditer(text):
                key = (m.group(), m.start() == 0)
                if key not in self.tokens:
                    self.tokens[key] = t = len(self.tokens) + 1
                    if t == self.near.shape[1]:
                        self.near = np.concatenate([self.near, np.zeros_like(self.near)], axis=1)
                    for k, d in enumerate(NEAR):
                        self.near[k, t] = self.total(token_features(*key, d))
                numbers.append(self.tokens[key])
                starts.append(m.start())
                ends.append(m.end())
            known = (len(self.chunks) + 1, numbers, starts, ends)
            self.chunks[text] = known
            if known[0] == self.far.shape[1]:
                self.far = np.concatenate([self.far, np.zeros_like(self.far)], axis=1)
            for k, d in enumerate(FAR):
                self.far[k, known[0]] = self.total(chunk_features(text, d))
        return known

    def emissions(self, numbers: np.ndarray, pieces: np.ndarray, piece_of: np.ndarray) -> np.ndarray:
        """Scores (tokens x labels) of all lines of a batch; GAP blanks stand around each line, in tokens and in pieces."""
        out = np.zeros((len(numbers), len(LABELS)), np.float32)
        for k, d in enumerate(NEAR):
            out[GAP:-GAP] += self.near[k][numbers[GAP + d : len(numbers) - GAP + d]]
        across = np.zeros((len(pieces), len(LABELS)), np.float32)
        for k, d in enumerate(FAR):
            across[GAP:-GAP] += self.far[k][pieces[GAP + d : len(pieces) - GAP + d]]
        return out + across[piece_of]

    def viterbi(self, lines: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each line of scores."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(lines)
        order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
        at = 0
        while at < len(order):
            size = 1
            while at + size < len(order) and (size + 1) * len(lines[order[at + size]]) <= BLOCK_TOKENS:
                size += 1
            block = order[at : at + size]
            at += size
            longest = len(lines[block[-1]])
            if not longest:
                continue
            scores = np.zeros((longest, len(block), len(LABELS)), np.float32)
            for k, i in enumerate(block):
                scores[: len(lines[i]), k] = lines[i]
            best = scores[0] + self.start
            back = np.zeros((longest, len(block), len(LABELS)), np.int8)
            lengths = np.array([len(lines[i]) for i in block])
            for t in range(1, longest):
                step = best[:, :, None] + self.steps
                back[t] = step.argmax(1)
                now = step.max(1) + scores[t]
                best = np.where((lengths > t)[:, None], now, best)
            last = best.argmax(1)
            labels = np.zeros((longest, len(block)), np.int8)
            rows = np.arange(len(block))
            for t in range(longest - 1, -1, -1):
                labels[t] = last
                last = np.where(lengths > t, back[t][rows, last], last) if t else last
            for k, i in enumerate(block):
                out[i] = labels[: len(lines[i]), k]
        return out

    def mentions(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the mentions in each text, in order; none in null and empty texts."""
        if len(self.chunks) > REMEMBERED:
            self.reset()
        gap = [0] * GAP
        numbers, pieces, piece_of, where, bounds = list(gap), list(gap), list(gap), [], []
        for i, text in enumerate(texts):
            for line in LINE.finditer(text or ""):
                starts, ends, begin = [], [], len(numbers)
                for m in CHUNK.finditer(line.group()):
                    number, n, s, e = self.chunk(m.group())
                    base = line.start() + m.start()
                    piece_of += [len(pieces)] * len(n)
                    pieces.append(number)
                    numbers += n
                    starts += [base + x for x in s]
                    ends += [base + x for x in e]
                if starts:
                    where.append((i, starts, ends))
                    bounds.append((begin, len(numbers)))
                    numbers += gap
                    pieces += gap
                    piece_of += gap
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not where:
            return out
        scores = self.emissions(np.array(numbers), np.array(pieces), np.array(piece_of))
        for (i, starts, ends), labels in zip(where, self.viterbi([scores[a:b] for a, b in bounds])):
            for t in np.flatnonzero(labels).tolist():
                label = LABELS[labels[t]]
                if label[0] == "B" or not out[i] or out[i][-1][2] != label[2:]:
                    out[i].append((starts[t], ends[t], label[2:]))
                else:
                    out[i][-1] = (out[i][-1][0], ends[t], label[2:])
        return [[x for x in found if possible(x[2], text[x[0] : x[1]])] if found else found for found, text in zip(out, texts)]


def train(examples: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 9, rate: float = 0.3, seed: int = 3, least: int = 2) -> Tagger:
    """Maximum likelihood by AdaGrad on mini-batches, with forward and backward sums in numpy. Features seen less than ``least`` times fall out."""
    names: dict[str, int] = {}
    known: dict[tuple, list[int]] = {}

    def numbers(make, *key) -> list[int]:
        if (key := (make, *key)) not in known:
            known[key] = [names.setdefault(f, len(names)) for f in make(*key[1:])]
        return known[key]

    lines = []
    for text, spans in examples:
        chunks = list(CHUNK.finditer(text))
        tokens = [(m.group(), m.start() == 0, c.start() + m.start(), c.start() + m.end(), k) for k, c in enumerate(chunks) for m in TOKEN.finditer(c.group())]
        gold = np.zeros(len(tokens), int)
        for a, b, kind in spans:
            inside = [t for t, x in enumerate(tokens) if x[2] >= a and x[3] <= b]
            for t in inside:
                gold[t] = LABELS.index(("B-" if t == inside[0] else "I-") + kind)
        rows = []
        for t, x in enumerate(tokens):
            found: list[int] = []
            for d in NEAR:
                if 0 <= t + d < len(tokens):
                    found += numbers(token_features, tokens[t + d][0], tokens[t + d][1], d)
            for d in FAR:
                if 0 <= x[4] + d < len(chunks):
                    found += numbers(chunk_features, chunks[x[4] + d].group(), d)
            rows.append(np.array(found, np.int32))
        lines.append((rows, gold))
    seen = np.bincount(np.concatenate([r for rows, _ in lines for r in rows]), minlength=len(names))
    place = np.where(seen >= least, np.cumsum(seen >= least) - 1, -1)
    names = {f: int(place[i]) for f, i in names.items() if place[i] >= 0}
    k = len(LABELS)
    w, g2 = np.zeros((len(names), k), np.float32), np.full((len(names), k), 1e-6, np.float32)
    s, s2 = np.zeros((k, k)), np.full((k, k), 1e-6)
    hard = allowed().astype(float)
    start = np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS])
    rng = np.random.default_rng(seed)
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    batches = []
    mixed = rng.permutation(len(lines))
    for at in range(0, len(mixed), 512):  # lines of about one length go together
        near = sorted(mixed[at : at + 512].tolist(), key=lambda i: len(lines[i][1]))
        for b in range(0, len(near), 32):
            batch = [lines[i] for i in near[b : b + 32]]
            flat = [place[r][place[r] >= 0] for rows, _ in batch for r in rows]
            index, counts = np.concatenate(flat), np.array([len(r) for r in flat])
            order = np.argsort(index, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(index[order]) > 0])
            batches.append((np.array([len(x[1]) for x in batch]), np.concatenate([x[1] for x in batch]), index, np.r_[0, np.cumsum(counts)[:-1]], np.repeat(np.arange(len(counts)), counts)[order], starts, index[order][starts]))
    mean_w, mean_s, kept = np.zeros_like(w), np.zeros_like(s), 0
    for turn in range(rounds):
        for at in rng.permutation(len(batches)):
            lengths, right, index, heads, owner, starts, used = batches[at]
            longest, n = lengths.max(), len(lengths)
            mask = np.arange(longest) < lengths[:, None]
            e = np.zeros((n, longest, k))
            e[mask] = np.add.reduceat(w[index], heads, axis=0)
            gold = np.zeros((n, longest), int)
            gold[mask] = right
            move = s + hard
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0] + start
            for t in range(1, longest):
                now = lse(alpha[:, t - 1, :, None] + move, 1) + e[:, t]
                alpha[:, t] = np.where(mask[:, t, None], now, alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                now = lse(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(mask[:, t + 1, None], now, 0)
            z = lse(alpha[:, -1], 1)
            delta = np.exp(alpha + beta - z[:, None, None])[mask]
            delta[np.arange(len(delta)), right] -= 1
            live = mask[:, 1:]
            after = (e + beta)[:, 1:]
            grad_s = np.zeros((k, k))
            for t in range(longest - 1):
                grad_s += np.exp(alpha[:, t, :, None] + move + after[:, t, None, :] - z[:, None, None])[live[:, t]].sum(0)
            np.add.at(grad_s, (gold[:, :-1][live], gold[:, 1:][live]), -1)
            grad = np.add.reduceat(delta.astype(np.float32)[owner], starts, axis=0) / n + 1e-4 * w[used]
            g2[used] += grad * grad
            w[used] -= rate * grad / np.sqrt(g2[used])
            grad_s /= n
            s2 += grad_s * grad_s
            s -= rate * grad_s / np.sqrt(s2)
        if turn >= 2:  # the mean over rounds generalises better than the last one
            mean_w, mean_s, kept = mean_w + w, mean_s + s, kept + 1
    mean_w, mean_s = mean_w / max(1, kept), mean_s / max(1, kept)
    return Tagger({f: mean_w[i].astype(np.float32) for f, i in names.items() if np.abs(mean_w[i]).max() > 0.02}, mean_s + hard)


_MODEL: dict[str, Tagger] = {}


def sources() -> str:
    """The code and table that a model comes from."""
    return "\0".join(inspect.getsource(inspect.getmodule(f)) for f in (train, table))


def model(spark: SparkSession | None = None) -> Tagger:
    """The model trained from the labelled table. With a session it is kept in the shared folder, under a hash of the code and
    table it came from, and read from there by later sessions; in one process it is made or read once."""
    key = hashlib.sha256(sources().encode()).hexdigest()[:16]
    if key not in _MODEL:
        path = f"{shared_base(spark)}/cairn-models/personal-{key}.json" if spark else None
        text = read_text(spark, path) if path else None
        if text is None:
            _MODEL[key] = train(table())
            if path:
                names, rows, steps = _MODEL[key].packed()
                write_text(spark, path, json.dumps({"names": names, "rows": base64.b64encode(rows.tobytes()).decode(), "steps": base64.b64encode(steps.tobytes()).decode()}))
        else:
            kept, k = json.loads(text), len(LABELS)
            rows, steps = (np.frombuffer(base64.b64decode(kept[x]), np.float32).reshape(-1, k) for x in ("rows", "steps"))
            _MODEL[key] = Tagger.unpacked(kept["names"], rows, steps)
    return _MODEL[key]


def found(records: DataFrame, id_col: str = "mem_id", fields: tuple[str, ...] = ("body", "description"), tagger: Tagger | None = None) -> DataFrame:
    """(id, field, kind, start_at, end_at) of all mentions, offsets in code points, end exclusive; distinct rows.

    Null, empty and blank fields have none. Rows with a null id are left out.
    """
    trained = tagger or model(records.sparkSession)
    sent = records.sparkSession.sparkContext.broadcast(trained.packed())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger.unpacked(*sent.value)
        for part in parts:
            for at in range(0, len(part), 400):
                some = part.iloc[at : at + 400]
                rows = []
                for k, field in enumerate(fields):
                    for i, spans in zip(some.iloc[:, 0], tagger.mentions(some.iloc[:, k + 1].tolist())):
                        rows += [(i, field, kind, a, b) for a, b, kind in spans]
                yield pd.DataFrame(rows, columns=[id_col, "field", "kind", "start_at", "end_at"])

    schema = f"{id_col} {records.schema[id_col].dataType.simpleString()}, field string, kind string, start_at long, end_at long"
    return records.where(f"{id_col} is not null").select(id_col, *fields).mapInPandas(run, schema).distinct()


def redact(records: DataFrame, id_col: str = "mem_id", fields: tuple[str, ...] = ("body", "description"), tagger: Tagger | None = None) -> DataFrame:
    """(id, fields) with each mention replaced by its kind in brackets, as [EMAIL], and the rest unchanged; null stays null."""
    trained = tagger or model(records.sparkSession)
    sent = records.sparkSession.sparkContext.broadcast(trained.packed())

    def clean(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
        for a, b, kind in reversed(spans):
            text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
        return text

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger.unpacked(*sent.value)
        for part in parts:
            for at in range(0, len(part), 400):
                some = part.iloc[at : at + 400]
                texts = [some.iloc[:, k + 1].tolist() for k in range(len(fields))]
                yield pd.DataFrame({id_col: some.iloc[:, 0].tolist()} | {f: [clean(t, s) for t, s in zip(x, tagger.mentions(x))] for f, x in zip(fields, texts)})

    schema = f"{id_col} {records.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{f} string" for f in fields)
    return records.select(id_col, *fields).mapInPandas(run, schema)
