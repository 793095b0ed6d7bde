import numpy as np
import pytest
from pyspark.sql import functions as F

from quietgate.llm import language
from quietgate.llm.queries import op9_language_id

from .rows import awkward, frame, words


def test_grams_of_a_text():
    found, whole, starts = language.grams(["Ab", "", "a-é"])
    decode = lambda g: int(g).to_bytes(4, "big")
    kept = [decode(g) for g, w in zip(found, whole) if w]
    assert kept == [b" ab ", b"ab \xff", b" a \xc3", b"a \xc3\xa9", b" \xc3\xa9 ", b"\xc3\xa9 \xff"][: len(kept)]
    assert len(starts) == 3


def test_popcounts_against_exact_sets(spark):
    """The filter's decisions equal those of exact n-gram sets on clear texts."""
    train = [(f"{words(i, 40, letters)}", lang) for i, (lang, letters) in enumerate([("aa", "abcde"), ("bb", "fghij"), ("cc", "klmnoé")] * 10)]
    model = language.fit(spark.createDataFrame(train, "text string, lang string"))
    sets = {}
    for text, lang in train:
        found, whole, _ = language.grams([text])
        sets.setdefault(lang, []).extend(found[whole].tolist())
    kept = {l: {g for g in set(s) if s.count(g) >= language.LEAST_SEEN} for l, s in sets.items()}
    tests = [words(900 + i, 30, l) for i, l in enumerate(["abcde", "fghij", "klmnoé"] * 5)]
    for text, (lang, score, coverage) in zip(tests, model.score(tests)):
        found, whole, _ = language.grams([text])
        counts = {l: sum(g in k for g in found[whole].tolist()) for l, k in kept.items()}
        assert lang == max(counts, key=counts.get)
        assert 0 <= score <= 1 and 0 <= coverage <= 1


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = op9_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rate = got.filter("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert rate > 0.97


@pytest.mark.parametrize("clash", [False, True])
def test_awkward_rows(spark, clash):
    docs = frame(spark, awkward(), clash)
    model = language.fit(docs)
    got = language.predict(docs.select("doc_id", "text"), model).collect()
    assert len(got) == len(awkward())
    for r in got:
        lettered = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred != "und") == lettered and 0 <= r.score <= 1
    kept = language.known_language(docs, model, 0.0)
    assert kept.columns == docs.columns
    assert kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in awkward())


def test_nothing_learned_and_empty_table(spark):
    none = frame(spark, [])
    model = language.fit(none)
    assert model.languages == []
    assert language.predict(none, model).collect() == []
    assert {r.lang_pred for r in language.predict(frame(spark, awkward()), model).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """More languages than a word has bits: each is told, the least frequent too."""
    rng = np.random.default_rng(5)
    alphabet = list("abcdefghijklmnopqrstuvwxyz")
    speech = [["".join(rng.choice(alphabet, 7)) for _ in range(12)] for _ in range(130)]
    rows = [(" ".join(w), f"l{i:03d}") for i, w in enumerate(speech) for _ in range(2 if i > 70 else 3)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(model.languages) == sorted({x for _, x in rows}) and len(model.masks) == 3
    told = model.score([" ".join(w[3:9]) for w in speech])
    assert [x for x, _, _ in told] == [f"l{i:03d}" for i in range(130)]
    docs = spark.createDataFrame([(129, " ".join(speech[129]))], "doc_id long, text string")
    assert [r.lang_pred for r in language.predict(docs, model).collect()] == ["l129"]


def test_the_filter_grows_with_the_grams_and_leaves_rare_ones_out(spark, monkeypatch):
    monkeypatch.setattr(language, "POSITIONS_BITS", 6)
    rng = np.random.default_rng(6)
    text = " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(2000))
    docs = spark.createDataFrame([(text + " zzzzz", "a")] * 2, "text string, lang string")
    model = language.fit(docs)
    assert model.false_rates().max() < 0.05 and len(model.masks[0]) > 1 << 13
    assert model.score(["zzzzz"])[0][2] > 0.5
    monkeypatch.setattr(language, "LEAST_SHARE", 3e-4)
    assert language.fit(docs).score(["zzzzz"])[0][2] == 0


@pytest.mark.parametrize("text, told", [("²½①", False), ("3 ² x", True), ("", False), ("字", True), ("_ 12", False), ("é", True)])
def test_numbers_that_are_no_digits_are_no_letters(text, told):
    assert language.has_letter(text) == told == any(c.isalpha() for c in text)
