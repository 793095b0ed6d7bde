import math
import re

import numpy as np
from pyspark.sql import functions as F

from quietgate.llm import lexical

from . import rows as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    found = [(d, tokens(t)) for d, t, *_ in docs]
    n, total = sum(1 for _, t in found if t), sum(len(t) for _, t in found)
    df = {}
    for _, t in found:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(tokens(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, t in found:
            m = 100 - 90 + ((90 * len(t) * n) // total if total else 0)
            score = 0
            for x in wanted:
                tf = t.count(x)
                if tf:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1)))
                    score += w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=10):
    df = lexical.search(R.frame(spark, docs), spark.createDataFrame(items, ITEMS), k)
    return sorted([tuple(r) for r in df.collect()], key=str)


def corpus(n=400, seed=5):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    share /= share.sum()
    out = []
    for i in range(n):
        size = int(rng.integers(1, 60))
        out.append((i, " ".join(rng.choice(vocabulary, size, p=share)), "en", "a", 1))
    return out


def test_against_brute_force(spark):
    docs = corpus()
    docs += [(1000 + i, docs[3][1], "en", "a", 1) for i in range(40)]  # ties
    rng = np.random.default_rng(6)
    items = [(i, docs[int(rng.integers(0, 400))][1] + " w0 w1 w2 unseen") for i in range(25)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, 3) == brute(docs, items, 3)


def test_blocks_of_documents_and_items_change_nothing(spark, monkeypatch):
    docs = corpus(200)
    items = [(i, docs[i][1]) for i in range(30)]
    whole = run(spark, docs, items)
    monkeypatch.setattr(lexical, "ITEM_TERMS", 64)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 50)
    assert run(spark, docs, items) == whole == brute(docs, items)


def test_awkward_rows(spark):
    items = [(1, R.words(1, 120)), (1, "the token"), (2, None), (3, ""), (4, "!! .."), (None, "ONE é字😀 x"), (5, "zzzzzz"),
             (6, "the THE The")]
    assert run(spark, R.awkward(), items) == brute(R.awkward(), items)
    assert run(spark, [], items) == []
    assert run(spark, R.awkward(), []) == []
    assert run(spark, [(1, None, None, None, None)], items) == []


def test_long_text_is_split_at_any_place(spark, monkeypatch):
    monkeypatch.setattr(lexical, "_SLICE", 50)
    text = "Ab1 é字,x" * 40 + " " + "y" * 200 + " end"
    assert [t.decode() for run in lexical.terms(text.encode()) for t in run] == tokens(text)
    assert len(list(lexical.terms(text.encode()))) > 3
    assert list(lexical.terms(b"")) == [[]]


def test_accumulators_stop_and_survivors_stay_exact():
    rng = np.random.default_rng(2)
    n = 3000
    ids = list(range(n))
    doc, term, tf = [], [], []
    for t in range(40):
        at = np.sort(rng.choice(n, max(1, n // (40 - t)), replace=False))
        doc += at.tolist()
        term += [t] * len(at)
        tf += rng.integers(1, 5, len(at)).tolist()
    part = lexical.Coded(ids, rng.integers(5, 50, n), np.array(doc), np.array(term), np.array(tf))
    weights = np.array([lexical.weight(n, n // (40 - t)) for t in range(40)])
    index = lexical.Index([part], weights, n, int(part.length.sum()))
    full = np.zeros(n, np.int64)
    np.add.at(full, index.doc, index.adds)
    found, score = index.search(np.arange(40), 1, 10)
    assert len(found) < n // 10  # the rest had no accumulator or was dropped
    assert (full[found] == score).all()
    best = np.lexsort((np.arange(n), -full))[:10]
    assert set(best) <= set(found.tolist())


def test_clashing_columns(spark):
    docs = R.frame(spark, R.awkward(), clash=True).withColumn("part", F.lit(1)).withColumn("item", F.lit("x"))
    items = spark.createDataFrame([(1, "the token", "own")], ITEMS + ", id string")
    found = sorted([tuple(r) for r in lexical.search(docs, items).collect()], key=str)
    assert found == brute(R.awkward(), [(1, "the token")])
