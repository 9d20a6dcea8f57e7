"""One common form for texts that look alike.

Compatibility decomposition, deletion of ignorable characters and one kind of blank come
first. Every letter that has look-alikes then stands for its whole class of letters, so that two
words that look the same give the same lattice of readings. Viterbi takes the best path under
letter bigrams, in which a change of script costs much; the scores come from all words of the corpus
that are written in one script. The result depends on the lattice only, not on the letters stored.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata as ud
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.sources.tables import materialize

# Letters of other scripts that print like a Latin letter (which stands first).
LOOK_ALIKES = """
aаα cсϲ dԁ eе gց hһհ iіι jјϳ kкκ lӏ nո oоοօ pрρ qԛ sѕ
uսυ vѵν wԝѡ xхχ yуγ
AАΑ BВΒ CСϹ EЕΕ FϜ GԌ HНΗ IІΙӀ JЈͿ KКΚ MМΜ NΝ OОΟՕ
PРΡ QԚ SЅՏ TТΤ VѴ WԜ XХΧ YҮΥ ZΖ
"""
CLASS = {letter: group for group in LOOK_ALIKES.split() for letter in group}
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")
#: Log score of two neighbouring letters of unequal script.
SWITCH = -18.0
#: Invisible characters that are not of category Cf: grapheme joiner, fillers, variation selectors.
IGNORED = re.compile("[͏ᅟᅠ឴឵᠋-᠍ㅤﾠ︀-️\U000e0100-\U000e01ef]")
LETTERS = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
MARK = re.compile("[̀-ͯ]")


def script(letter: str) -> str:
    """LATIN, CYRILLIC, GREEK, ARMENIAN or an empty string."""
    name = ud.name(letter, "").split(" ", 1)[0]
    return name if name in SCRIPTS else ""


def decompose(text: str) -> str:
    """Compatibility decomposition without ignorable characters and with one kind of blank."""
    if text.isascii():
        return text
    out = IGNORED.sub("", ud.normalize("NFKD", text))
    if out.isascii():
        return out
    drop = {ord(c): (None if ud.category(c) == "Cf" else " ") for c in set(out) if ud.category(c) in ("Cf", "Zs")}
    # a dropped character may have stood between a letter and its marks, so order them again
    return ud.normalize("NFKD", out.translate(drop))


class LookAlikes:
    """Reads words under letter bigram counts: {(before, letter): n}, "" at the border of a word."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.total: Counter = Counter()
        for (a, _), n in counts.items():
            self.total[a] += n
        self.counts = counts
        self.known: dict[str, str] = {}
        self.scripts: dict[str, str] = {"": ""}

    def score(self, a: str, b: str) -> float:
        for c in (a, b):
            if c not in self.scripts:
                self.scripts[c] = script(c)
        s = math.log((self.counts.get((a, b), 0) + 0.1) / (self.total.get(a, 0) + 100.0))
        if a and b and self.scripts[a] != self.scripts[b]:
            s += SWITCH
        return s

    def viterbi(self, letters: str) -> str:
        """Best reading of a word without marks. Ties go to the reading that stands first, Latin before others."""
        best: list[tuple[float, str, str]] = [(0.0, "", "")]
        for c in letters:
            step = []
            for x in CLASS.get(c, c):
                step.append(max(((s + self.score(last, x), path + x, x) for s, path, last in best), key=lambda t: t[0]))
            best = step
        return max(((s + self.score(last, ""), path) for s, path, last in best), key=lambda t: t[0])[1]

    def word(self, w: str) -> str:
        if (out := self.known.get(w)) is None:
            bare = MARK.sub("", w)
            read = self.viterbi(bare) if any(c in CLASS for c in bare) else bare
            if len(bare) == len(w):
                out = read
            else:
                it = iter(read)
                out = "".join(c if MARK.match(c) else next(it) for c in w)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[w] = out
        return out

    def form(self, text: str) -> str:
        """The common form of a text."""
        out = LETTERS.sub(lambda m: self.word(m.group()), decompose(text))
        return out if out.isascii() else ud.normalize("NFC", out)


def count_bigrams(words: Counter) -> Counter:
    """Letter bigrams of the words that are written in one of SCRIPTS."""
    out: Counter = Counter()
    for w, n in words.items():
        bare = MARK.sub("", w)
        kinds = {script(c) for c in bare}
        if len(kinds) == 1 and "" not in kinds:
            for a, b in zip(["", *bare], [*bare, ""]):
                out[a, b] += n
    return out


def fit(documents: DataFrame, text_col: str = "text") -> LookAlikes:
    """Counts letter bigrams over all texts. The table that comes to the driver is bounded by the square of the letters of four scripts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for part in parts:
            words: Counter = Counter()
            for text in part.iloc[:, 0]:
                if text:
                    words.update(LETTERS.findall(decompose(text)))
            total.update(count_bigrams(words))
        yield pd.DataFrame([(a, b, n) for (a, b), n in total.items()], columns=["a", "b", "n"])

    rows = documents.select(text_col).mapInPandas(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return LookAlikes({(r.a, r.b): r.n for r in sorted(rows, key=lambda r: (r.a, r.b))})


def forms(documents: DataFrame, model: LookAlikes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text) of every row with the text in its common form; null stays null, empty stays empty."""
    sent = documents.sparkSession.sparkContext.broadcast((model or fit(documents, text_col)).counts)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = LookAlikes(sent.value)
        for part in parts:
            yield pd.DataFrame({id_col: part.iloc[:, 0], text_col: [None if t is None else model.form(t) for t in part.iloc[:, 1]]})

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, {text_col} string")


def keyed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form, stored): hashes of the common form and of the stored text, of texts that are not blank; written."""
    sent = documents.sparkSession.sparkContext.broadcast(fit(documents, text_col).counts)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = LookAlikes(sent.value)
        digest = lambda t: hashlib.blake2b(t.encode(), digest_size=16).digest()
        for part in parts:
            rows = []
            for i, text in zip(part.iloc[:, 0], part.iloc[:, 1]):
                if text and (form := model.form(text)).strip():
                    rows.append((i, digest(form), digest(text)))
            yield pd.DataFrame(rows, columns=["id", "form", "stored"])

    kind = documents.schema[id_col].dataType.simpleString()
    return materialize(documents.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInPandas(run, f"id {kind}, form binary, stored binary"), "forms")


def found(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (doc_id_a < doc_id_b) whose stored texts differ and whose common forms agree.

    Exact copies are folded first: pairs are made between distinct texts of one form and then
    given back to the documents, so a group of copies costs only the pairs it really has. ``classes`` is the form for
    collections with many copies of several variants.
    """
    rows = keyed(documents, id_col, text_col)
    texts = rows.select("form", "stored").distinct()
    several = texts.groupBy("form").count().where("count > 1").select("form")
    texts = texts.join(several, "form", "left_semi")
    pairs = texts.join(texts.withColumnRenamed("stored", "other"), "form").where("stored < other").select("stored", "other")
    docs = rows.select("id", "stored").distinct()
    both = pairs.join(docs.withColumnRenamed("id", "x"), "stored").join(docs.select(F.col("id").alias("y"), F.col("stored").alias("other")), "other")
    return both.where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, size, links): a row for each document with a text that is not blank.

    class_id is the least id with the same common form, size the documents of the class, links those of them that are stored
    with other characters. Nothing is paired, so it costs the same however many copies there are.
    """
    rows = keyed(documents, id_col, text_col).distinct()
    forms_ = rows.groupBy("form").agg(F.min("id").alias("class_id"), F.countDistinct("id").alias("size"))
    texts = rows.groupBy("form", "stored").agg(F.countDistinct("id").alias("same"))
    each = texts.join(forms_, "form").select("form", "stored", "class_id", "size", (F.col("size") - F.col("same")).alias("links"))
    return rows.join(each, ["form", "stored"]).select(F.col("id").alias("doc_id"), "class_id", "size", "links")
