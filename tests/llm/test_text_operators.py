import random
import re

import numpy as np
import pytest
import tiktoken
from held_out import lines

from cairn.llm import common_form, leaks, personal, personal_examples, tokenizer

DOC = "doc_id long, text string, ids string, item_id long, form string"
ITEM = "item_id long, text string, id long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 5, "f") for i, t in enumerate(texts)], DOC)


# -- p7
def test_tokenizer_equals_reference(spark):
    r = random.Random(1)
    letters = "abcdefghij ABC  äöüß éñ 日本語 прив 0123456789 .,;:-_/\\'\"\n\t\r\x07​😀👩‍🔧"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(300)] + [None, "", "   ", "<|endoftext|>", "x" * 5000, "don't we'll  \n\n x", "supercalifragilistic " * 50]
    with open(tokenizer.VOCABULARY, "rb") as f:
        bpe = tokenizer.SpeculativeBpe(f.read())
    ref = tiktoken.Encoding("ref", pat_str=tokenizer.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    got = {x.doc_id: x.ids for x in tokenizer.encode(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [ref.encode_ordinary(t or "") for t in texts]
    for t in texts:
        assert b"".join(bpe.words[x] for x in bpe.encode_batch([t])[0].tolist()) == (t or "").encode()
    assert 0 < bpe.merged < len(bpe.known)


def test_tokenizer_empty_and_repeated(spark):
    assert tokenizer.encode(docs(spark, [])).collect() == []
    assert [list(x) for x in tokenizer.encode(spark.createDataFrame([(1, None), (1, None), (None, "a")], "doc_id long, text string")).collect()] == [[1, []], [1, []], [None, [64]]]


# -- p9
def test_common_form_pairs(spark):
    base = "The café opens at ten, copy the scope file"
    same = [base, base.replace("e", "е"), "Ｔhe" + base[3:], base.replace("é", "é"), base.replace("é", "е́"), base.replace(" ", " "), base.replace("op", "o​p"), base.replace("fi", "ﬁ"), base]
    other = [base.lower(), base.replace("é", "e"), base.replace(" ", "\n"), base.replace(" ", "  "), None, "", "  ", "​"]
    got = {tuple(x) for x in common_form.found(docs(spark, same + other)).collect()}
    want = {(a, b) for a in range(len(same)) for b in range(a + 1, len(same)) if same[a] != same[b]}
    assert got == want


def test_common_form_is_idempotent_and_keeps_scripts(spark):
    model = common_form.LookAlikes(common_form.count_bigrams({"заметка": 9, "перезапущен": 9, "сорок": 5, "note": 50, "scope": 40, "copy": 40}))
    assert model.form("заметка scope ѕсоре") == "заметка scope scope"
    for t in ["x", "Ｆull", "пере scope", "½ µs é"]:
        assert model.form(model.form(t)) == model.form(t)
    for w in ("cop", "сор", "сoр"):
        assert model.form(w) == model.form("cop")


def test_common_form_copies_and_empty(spark):
    texts = ["abc"] * 40 + ["аbc", "abc​"]
    assert common_form.found(docs(spark, texts)).count() == 81
    assert {tuple(x)[:1] + tuple(x)[2:] for x in common_form.classes(docs(spark, texts + ["b", None, " "])).collect()} == {(i, 42, 2) for i in range(40)} | {(40, 42, 41), (41, 42, 41), (42, 1, 0)}
    assert common_form.found(docs(spark, [])).collect() == [] == common_form.classes(docs(spark, [])).collect()
    assert {x.doc_id: x.text for x in common_form.forms(docs(spark, [None, "", "a b"])).collect()} == {0: None, 1: "", 2: "a b"}


# -- p8
def brute(items, texts, model):
    out = set()
    for k, item in items:
        w = leaks.words(model.form(item)) if item else []
        runs = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for d, t in enumerate(texts):
            v = leaks.words(model.form(t)) if t else []
            if any(tuple(v[i : i + 12]) in runs for i in range(len(v) - 11)):
                out.add((d, k))
    return out


@pytest.mark.parametrize("per_index", [10**9, 9_000])
def test_leaks(spark, monkeypatch, per_index):
    monkeypatch.setattr(leaks, "INDEX_BYTES", per_index)
    monkeypatch.setattr(leaks, "BLOCK", 3 if per_index < 10**9 else 16)
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 60)))) for k in range(40)] + [(90, None), (91, ""), (92, "the " * 30)]
    texts = []
    for _ in range(120):
        w = " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 80))).split()
        source = r.choice(items[:40])[1].split()
        n = r.choice([5, 11, 12, 13, 30])
        at, start = r.randint(0, len(w)), r.randint(0, max(0, len(source) - n))
        texts.append(" ".join(w[:at] + source[start : start + n] + w[at:]).upper())
    texts += [None, "", "the " * 12, "the " * 11, "ｗ1 " + items[0][1].replace(" ", " "), items[1][1] + " " + "x " * 20_000]
    frame = docs(spark, texts)
    model = common_form.fit(frame)
    got = [tuple(x) for x in leaks.found(frame, spark.createDataFrame([(i, t, 7) for i, t in items], ITEM)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(items, texts, model) and len(got) > 20


def test_wand_retrieves_all_above_the_threshold_and_skips():
    """Against scores of all items, with 5,000 items; the index takes memory in proportion to its postings."""
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(6_000)]
    rare = [min(int(r.paretovariate(0.7)), 6_000) - 1 for _ in range(300_000)]
    draw = iter(rare * 2)
    items = [(k, [vocabulary[next(draw)] for _ in range(r.randint(12, 60))]) for k in range(5_000)]
    index = leaks.Index(items)
    size = sum(x.nbytes for x in (index.keys, index.weight, index.item, index.block_best, index.block_last, index.words, index.run_hash, index.run_at, index.run_item))
    assert size < 60 * sum(len(ws) for _, ws in items)
    passages = np.array([[index.vocabulary[w] for w in ([vocabulary[next(draw)] for _ in range(8)] + r.choice(items)[1][:12] + [vocabulary[next(draw)] for _ in range(3)])] for _ in range(40)])
    dense = np.zeros((index.none + 1, 5_000))
    real = index.item < index.end
    dense[index.keys[real] // index.step, index.item[real]] = index.weight[real]
    want = {(p, k) for p, terms in enumerate(passages) for k in np.flatnonzero(dense[terms].sum(0) >= 1 - leaks.EPS).tolist()}
    got = [(p, k) for rows, ks in index.wand(passages) for p, k in zip(rows.tolist(), ks.tolist())]
    assert len(got) == len(set(got)) and {(p, k) for p, k in want if dense[passages[p], k].sum() > 1 + leaks.EPS} <= set(got) <= want and len(got) >= 40


def test_leaks_empty(spark):
    assert leaks.found(docs(spark, []), spark.createDataFrame([], ITEM)).collect() == []
    assert leaks.found(docs(spark, ["a"]), spark.createDataFrame([], ITEM)).collect() == []


# -- p2
MEM = "mem_id long, body string, description string, name string, field string, kind string"


def accuracy(found, gold):
    right = sum(len(set(a) & set(b)) for a, b in zip(found, gold))
    return right / sum(map(len, found)), right / sum(map(len, gold))


def test_personal_held_out_accuracy(spark):
    """On hand-written lines with other sentences, names and streets, and on another draw of the table."""
    tagger = personal.model(spark)
    held = lines()
    fixed = [max(re.split(r"\{\w+\}", c), key=len) for c in personal_examples.PERSON + personal_examples.TITLED + personal_examples.PLAIN]
    assert not [f for f in fixed if len(f) >= 12 and any(f in t for t, _ in held)]
    precision, recall = accuracy(tagger.mentions([t for t, _ in held]), [s for _, s in held])
    assert precision >= 0.9 and recall >= 0.85
    drawn = personal_examples.table(400, seed=77)
    precision, recall = accuracy(tagger.mentions([t for t, _ in drawn]), [s for _, s in drawn])
    assert precision >= 0.95 and recall >= 0.94


def test_personal_model_is_read_again(spark, monkeypatch):
    first = personal.model(spark)
    monkeypatch.setattr(personal, "_MODEL", {})
    monkeypatch.setattr(personal, "train", None)
    monkeypatch.setattr(personal, "sources", lambda: personal_sources)
    again = personal.model(spark)
    text = ["Owner: Ottilie Krasnova (212) 555-0134"]
    assert again is not first and again.mentions(text) == first.mentions(text)


personal_sources = personal.sources()


def test_personal_offsets_and_redaction(spark):
    text = "😀 Contact: Frau Holkova <ana.holkova@mail.example.org>.\nCall (213) 555-0174 before touching relay-7.\n" + "Version 1.2.3 is fine. " * 2000
    rows = [(1, text, None, "n", "f", "k"), (1, text, None, "n", "f", "k"), (2, None, "", "n", None, None), (3, "  ", "Deploy as root@relay-7:/srv/x.", None, None, None), (None, text, text, None, None, None)]
    frame = spark.createDataFrame(rows, MEM)
    got = [tuple(x) for x in personal.found(frame).collect()]
    assert sorted((k, text[a:b]) for i, f, k, a, b in got) == [("email", "ana.holkova@mail.example.org"), ("name", "Holkova"), ("phone", "(213) 555-0174")]
    assert {(i, f) for i, f, *_ in got} == {(1, "body")}
    clean = {x.mem_id: x for x in personal.redact(frame.where("mem_id is not null")).collect()}
    assert clean[1].body.startswith("😀 Contact: Frau [NAME] <[EMAIL]>.\nCall [PHONE] before touching relay-7.\n") and clean[1].body.endswith("is fine. ")
    assert (clean[2].body, clean[2].description, clean[1].description) == (None, "", None)


def test_personal_empty(spark):
    assert personal.found(spark.createDataFrame([], MEM)).collect() == []
