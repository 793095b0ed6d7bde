import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quietgate.llm import toxicity
from quietgate.llm.queries import op10_toxicity

from .rows import awkward, frame, words

LEXICON = {"fool": 2.0, "lowei*": 3.0}


def read(text):
    """The grammar spelt out by looking around each word: a sorted list of what it counts as."""
    tags = toxicity.Tagger(LEXICON)
    kinds = [tags[token][0] for token in toxicity._TOKEN.findall(text.lower())]
    ends = (toxicity.LINE, toxicity.STOP)

    def quotes(i):
        """Marks of quotation before ``i`` in its line; a mark after an odd number closes."""
        line = next((p for p in range(i - 1, -1, -1) if kinds[p] == toxicity.LINE), -1)
        return [p for p in range(line + 1, i) if kinds[p] == toxicity.QUOTE]

    def words(places, reach, until):
        """The next ``reach`` words at these places, up to a mark that ends the search."""
        found = []
        for p in places:
            closes = kinds[p] == toxicity.QUOTE and len(quotes(p)) % 2
            if kinds[p] in until or closes or len(found) == reach:
                break
            if kinds[p] > toxicity.QUOTE:
                found.append(kinds[p])
        return found

    def told(i):
        """Whether a report stands before ``i`` in its sentence, outside other quotations."""
        for p in range(i - 1, -1, -1):
            if kinds[p] in (*ends, toxicity.QUOTE):
                return False
            if kinds[p] == toxicity.REPORT:
                return True
        return False

    def reported(i):
        marks = quotes(i)
        return told(i) or (len(marks) % 2 == 1 and told(marks[-1]))

    def waits(i, reach, other):
        after = words(range(i + 1, len(kinds)), reach, (*ends, toxicity.PAUSE))
        if toxicity.TARGET not in after:
            return False
        return other not in after[: after.index(toxicity.TARGET)]

    out = []
    for i, kind in enumerate(kinds):
        negated = toxicity.NEGATION in words(range(i - 1, -1, -1), 3, (*ends, toxicity.PAUSE))
        aimed = toxicity.TARGET in words(range(i - 1, -1, -1), 5, ends)
        if kind == toxicity.INSULT:
            plain = "aimed" if aimed or waits(i, 5, toxicity.INSULT) else "plain"
            out.append("reported" if reported(i) else "negated" if negated else plain)
        elif kind == toxicity.THREAT and not reported(i) and not negated:
            if aimed or waits(i, 3, toxicity.THREAT):
                out.append("threat")
    return sorted(out)


def run(text):
    """What the composed automaton counts."""
    state, got = 0, []
    tags = toxicity.Tagger(LEXICON)
    names = {1: "plain", 2: "aimed", 3: "negated", 4: "reported"}
    for token in toxicity._TOKEN.findall(text.lower()):
        out = toxicity.OUTS[state][tags[token][0]]
        state = toxicity.MOVES[state][tags[token][0]]
        if out & 7 == 5:
            got.remove("plain")
            got.append("aimed")
        elif out & 7:
            got.append(names[out & 7])
        if out & 8:
            got.append("threat")
    return sorted(got)


@pytest.mark.parametrize(
    "text, meant",
    [
        ("I will kill you", ["threat"]), ("I'll burn all of them.", ["threat"]), ("You will be shot, kill time", ["threat"]),
        ("I won't kill you", []), ("can't hurt you", []), ("I will kill time. You see", []), ("kill, you", []),
        ("He said: you fool", ["reported"]), ('he said, "You fool. Fool!" You fool', ["aimed", "reported", "reported"]),
        ("She wrote “they kill you”, loweix", ["plain"]), ('"You fool", fool', ["aimed", "plain"]),
        ("he isn't a fool", ["negated"]), ("not now, fool", ["plain"]), ("fool that you are", ["aimed"]), ("fool, you win", ["plain"]),
        ("you, fool", ["aimed"]), ("fool fool you", ["aimed", "plain"]), ("he said nothing\nyou fool", ["aimed"]), ("", []),
    ],
)
def test_meanings(text, meant):
    assert run(text) == read(text) == meant


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(
    ["fool", "loweix", "you", "them", "kill", "not", "can't", "said", "tree", "red", ",", ":", ".", "!", "\n", "|", '"', "“", "”"]
), max_size=24))
def test_automaton_against_the_grammar(parts):
    text = " ".join(parts)
    assert run(text) == read(text)


def test_held_out_rows_are_told_apart(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = op10_toxicity(spark, folder).filter("held_out").join(labels, "doc_id").select("toxic", "score", "predicted").collect()
    toxic = [r for r in rows if r.toxic == 1]
    other = [r for r in rows if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) > 0.8
    assert np.mean([r.predicted for r in other]) < 0.02


@pytest.mark.parametrize("clash", [False, True])
def test_awkward_rows(spark, clash):
    docs = frame(spark, awkward() + [(50 + i, f"you {words(i, 9)} {('vile', 'mild')[i % 2]} thing", "en", "a", 0) for i in range(40)], clash)
    labels = spark.createDataFrame(
        [(50 + i, 1 - i % 2) for i in range(40)] + [(50, 0), (1, None), (None, 1), (4, 0), (999, 1)], "doc_id long, toxic int"
    )
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert by[52].predicted == 1 and by[53].predicted == 0 and by[1].score == by[2].score


def test_fit_where_whole_newton_steps_run_away():
    """Few toxic rows, told from the others with a wide gap: undamped, the weights reach millions."""
    rng = np.random.default_rng(20)
    n, toxic = 30000, 40
    rng.choice(3), rng.choice(3)
    others, own = rng.integers(0, 2, n) * rng.integers(0, 4, n), rng.integers(1, 12, toxic)
    low, high = others * rng.uniform(2.5, 8, n), own * rng.uniform(8, 10, toxic)
    aimed = rng.random(toxic) * (rng.random(toxic) < 0.5)
    rows = [np.stack([low, 0 * low, others], 1), np.stack([high * (1 - aimed), high * aimed, own], 1)]
    x = np.hstack([np.log1p(np.concatenate(rows)), np.ones((n + toxic, 1))])
    y = np.repeat([0.0, 1.0], [n, toxic])
    w = toxicity._newton(x, y)
    assert np.abs(w).max() < 1000
    assert (x @ w >= 0)[y == 1].mean() > 0.6 and (x @ w >= 0)[y == 0].mean() < 0.001
    assert np.abs(x.T @ (1 / (1 + np.exp(-x @ w)) - y) + 1e-2 * w).max() < 1e-4


def test_no_labels_and_empty_table(spark):
    docs = frame(spark, awkward())
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {0.0}
    none = frame(spark, [])
    assert toxicity.score(none, toxicity.fit(none, labels)).collect() == []
