import random

import pytest
from pyspark.sql import functions as F

from quietgate.operators import aggregates, corpus, joins, scorer, sets, sorts, windows

POLICIES = list(corpus.CROSS)


def seeds(spark):
    rows = []
    for d in POLICIES:
        for s in corpus.REPETITIONS:
            for n, g in enumerate(("match", "no_match", "insufficient")):
                rows.append((f"{d}-{s}-{n}", d, s, g, f"{g} {{person}} {{qty}} {d}", f"{g} {{person}} owes {{money}} {d}"))
    return spark.createDataFrame(rows, "family string, domain string, split string, gold string, ko string, en string")


def pools(spark, field, both=("ko", "en")):
    rows = [(s, lang, field, [f"{s}-{lang}-{k}" for k in range(3)]) for s in corpus.REPETITIONS for lang in both]
    return spark.createDataFrame(rows, "split string, language string, field string, choices array<string>")


def questions(spark):
    rows = [(p, lang, f"Q {p}", ["", "Check: "], {"match": "y", "no_match": "n", "insufficient": "?"}) for p in POLICIES for lang in ("ko", "en")]
    return spark.createDataFrame(
        rows, "policy_id string, policy_language string, question string, prefixes array<string>, choices map<string,string>"
    )


def build(spark):
    benchmark = spark.createDataFrame([("elsewhere",)], "text string")
    return corpus.build_corpus(seeds(spark), pools(spark, "person"), benchmark, questions(spark), pools(spark, "attack"))


def test_build_corpus(spark):
    built = build(spark)
    rows = built["corpus"].cache()
    assert built["leaked"].isEmpty() and built["crossing"].isEmpty()
    found = corpus.corpus_checks(rows, manifest=built["manifest"])
    assert found.collect() == []
    texts = rows.select("text").collect()
    assert not any("{" in r.text and "}" in r.text and "{person" in r.text for r in texts)
    tags = {t for r in rows.select("tags").collect() for t in r.tags}
    assert tags == {"embedded_instruction", "distractor_prefix", "counterfactual_policy"}
    crossed = rows.filter(F.array_contains("tags", "counterfactual_policy"))
    assert {r.gold for r in crossed.select("gold").distinct().collect()} == {"no_match"}
    assert crossed.filter(F.col("id").endswith("-cross")).count() == crossed.count()
    manifest = {r.split: r for r in built["manifest"].collect()}
    assert sum(m.rows for m in manifest.values()) == rows.count()
    assert {s: m.families for s, m in manifest.items()} == {s: 18 for s in corpus.REPETITIONS}


def test_build_corpus_tells_leaks_and_crossings_without_texts(spark):
    same = [(f"f{k}", "hr_records", split, "match", "같은 글", "one text") for k, split in enumerate(("train", "train", "test"))]
    few = spark.createDataFrame(same, "family string, domain string, split string, gold string, ko string, en string")
    benchmark = spark.createDataFrame([("one text",)], "text string")
    built = corpus.build_corpus(few, pools(spark, "person"), benchmark, questions(spark))
    rows, index = built["corpus"].cache(), built["index"]
    assert "text" not in index.columns
    named = sorted(map(tuple, rows.select(*index.columns).collect()))
    assert sorted(map(tuple, index.collect())) == named
    leaked = [r.id for r in rows.collect() if r.text == "one text"]
    assert leaked and sorted(r.id for r in built["leaked"].collect()) == sorted(leaked)
    assert not built["crossing"].isEmpty()
    manifest = {r.split: r for r in built["manifest"].collect()}
    asked = {"train": 2 * 2 * (12 + 4), "test": 2 * (6 + 2)}
    for split, n in asked.items():
        kept = rows.filter(F.col("split") == split).count()
        assert (manifest[split].rows, manifest[split].duplicates_removed) == (kept, n - kept)


def test_ask_leaves_texts_where_they_lie(spark):
    rows = spark.createDataFrame(
        [("hr_records", i, "ko", "f", f"text {i}") for i in range(4)],
        "policy_id string, i int, language string, source_family string, text string",
    )
    asked = corpus.ask(rows, questions(spark))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert {(r.i, r.policy_language) for r in asked.collect()} == {(0, "ko"), (1, "en"), (2, "ko"), (3, "en")}
    with pytest.raises(Exception, match="no question"):
        corpus.ask(rows, questions(spark).filter("policy_language = 'ko'")).collect()


def test_train_scorer_reads_its_corpus_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    labels = ("match", "no_match", "insufficient")
    rows = [(f"{s}{k}", s, labels[k % 3], f"word{k % 3} text {k}", "f") for s in corpus.REPETITIONS for k in range(9)]
    df = spark.createDataFrame(rows, "id string, split string, gold string, text string, source_family string")
    out = scorer.train_scorer(df.mapInArrow(count, df.schema), regs=(0.01, 0.1), features=64, iterations=2)
    assert out["test"].count() == 9
    assert seen.value == len(rows)


def test_manifest_hash_ignores_partitioning_but_not_content(spark):
    rows = build(spark)["corpus"].cache()
    hashes = lambda df: {r.split: r.content_hash for r in aggregates.split_manifest(df).collect()}
    first = hashes(rows)
    assert first == hashes(rows.repartition(7).select(*reversed(rows.columns)).select(*rows.columns))
    changed = rows.withColumn("gold", F.when(F.col("id") == rows.first().id, "other").otherwise(F.col("gold")))
    assert sum(first[s] != h for s, h in hashes(changed).items()) == 1


def test_corpus_checks_find_violations(spark):
    rows = build(spark)["corpus"].cache()
    broken = (
        rows.filter("not (split = 'dev' and gold = 'match')")
        .withColumn("split", F.when(F.col("source_family") == "hr_records-test-0", "train").otherwise(F.col("split")))
    )
    some = broken.filter("source_family = 'hr_records-test-0'").withColumn("split", F.lit("test")).limit(1)
    checks = {r.check for r in corpus.corpus_checks(broken.unionByName(some)).collect()}
    assert {"label_missing", "family_crosses_split", "document_crosses_split"} <= checks


def test_family_split_isolates_families(spark):
    df = spark.range(1000).select(F.concat(F.lit("f"), F.col("id") % 50).alias("family"))
    split = corpus.family_split(df, "family")
    assert split.groupBy("family").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    assert split.filter("split is null").isEmpty()


def test_first_duplicate_and_probe(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 5), (None, 4)], "k string, n int")
    assert {(r.k, r.n) for r in windows.first_duplicate_wins(df, ["k"], "n").collect()} == {("a", 1), ("b", 2), (None, 4)}
    rows = build(spark)["corpus"].filter("split = 'test'")
    probe = corpus.stratified_probe(rows).collect()
    assert len(probe) == 18
    for r in probe:
        assert r.language == ("ko" if sorted(POLICIES).index(r.policy_id) % 2 else "en")


def test_sets_and_joins(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (3, "z")], "id int, v string")
    assert sorted(r.side for r in sets.set_equal(a, b).collect()) == ["left", "left", "right"]
    assert [r.id for r in sets.disjoint(a, b, "id").collect()] == [1]
    assert sets.union_splits(a, b).count() == 5
    cover = joins.id_coverage(a, b).first()
    assert (cover.missing, cover.unexpected, cover.repeated, cover.covered) == (1, 1, 1, False)
    assert joins.id_coverage(b, b).first().covered


def test_sorts(spark):
    df = spark.range(500).withColumn("len", (F.col("id") * 7919) % 977)
    one = [r.id for r in sorts.deterministic_shuffle(df, "id", 1).collect()]
    again = [r.id for r in sorts.deterministic_shuffle(df.repartition(5), "id", 1).collect()]
    assert one == again != sorted(one) and sorted(one) == list(range(500))
    assert one != [r.id for r in sorts.deterministic_shuffle(df, "id", 2).collect()]
    buckets = {}
    for r in sorts.length_buckets(df, "len", "id", 16).collect():
        buckets.setdefault(r.batch, []).append(r.len)
    assert sum(map(len, buckets.values())) == 500 and max(map(len, buckets.values())) <= 16
    spans = sorted((min(v), max(v)) for v in buckets.values())
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert sorts.clamped_limit(df, 9999).count() == 500 and sorts.clamped_limit(df, 0).count() == 1


def test_scorer_learns_and_scores_each_content_once(spark):
    from quietgate.operators import scorer

    rng = random.Random(1)
    words = {"match": "salary contract secret", "no_match": "public catalogue weather", "insufficient": "missing unreadable blank"}
    rows = [
        (i, f"fam{i % 15}", s, g, " ".join(rng.choices(words[g].split(), k=6)))
        for i, (s, g) in enumerate((s, g) for s in ("train", "dev", "calibration", "test") for g in words for _ in range(20))
    ]
    df = spark.createDataFrame(rows, "id int, source_family string, split string, gold string, text string")
    out = scorer.train_scorer(df, regs=(0.01,), features=256, iterations=10)
    assert out["dev_accuracy"] > 0.9
    test = out["test"].cache()
    assert test.count() == 60
    assert test.filter("abs(p_match + p_no_match + p_insufficient - 1) > 1e-9").isEmpty()
    assert set(out["gates"].columns) == {"allow", "block"}


@pytest.mark.parametrize("chars", [1 << 20, 6])
def test_passages_of_any_length_are_found(spark, monkeypatch, chars):
    monkeypatch.setattr(joins, "PASSAGE_CHARS", chars)
    docs = [(1, "one two three"), (2, "a b c d e f g h i j k"), (3, None), (4, ""), (5, "xone twox"), (6, "é字😀!"), (1, "again two")]
    items = [("one two",), ("d e f",), ("字😀",), (None,), ("",), ("not there",), ("one two",)]
    got = joins.passage_leak(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "text string"), "doc_id")
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 5, 6]
    assert joins.passage_leak(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([], "text string"), "doc_id").collect() == []
