"""The pipeline's stages, each against what it must do to its own input."""

from collections import Counter

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quietgate.llm import near, secrets
from quietgate.llm.common import stored

from . import test_near, test_suffixes
from .rows import awkward, frame

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER))
        out.append(docs)
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_order_and_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "suffix_dedup", "secret_scan", "best_fit_packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_keeps_clean_documents(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert set(after) <= set(before)
    assert len(after) >= 0.97 * sum(any(c.isalpha() for c in r[1]) for r in before)


def test_one_of_each_class(stages):
    before, after = rows(stages[1]), rows(stages[2])
    assert Counter(r[0] for r in after) == Counter(min(g) for g in test_near.classes(before).values())


def test_repeats_go(stages):
    before, after = rows(stages[2]), {r[0]: r for r in rows(stages[3])}
    raws, gone = test_suffixes.brute(before)
    for (doc, *_), raw, mask in zip(before, raws, gone):
        rest = bytes(b for b, g in zip(raw, mask) if not g).decode("utf-8", "ignore")
        assert (after[doc][1], after[doc][4]) == (rest, len(rest))


def test_secrets_go(stages):
    before, after = {r[0]: r for r in rows(stages[3])}, {r[0]: r for r in rows(stages[4])}
    assert before.keys() == after.keys()
    for doc, r in after.items():
        assert r[1] == secrets.redact(before[doc][1])


def test_everything_is_packed(stages):
    packed = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows(stages[4])}
    assert stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_awkward_documents(spark, tmp_path):
    folder = str(tmp_path)
    frame(spark, awkward(), clash=True).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 0
    empty = str(tmp_path / "none")
    frame(spark, []).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_batches_for_python_end_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    session = spark.newSession()
    docs = session.range(0, 2000, 1, 1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10_000).alias("text"), F.lit("en").alias("lang"),
        F.lit("a").alias("source"), F.lit(10_000).cast("long").alias("n_chars"),
    )

    def most_rows():
        return docs.select("text").mapInArrow(
            lambda batches: (b.select(["text"]).from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long"
        ).agg(F.max("n")).first()[0]

    assert most_rows() == 2000
    corpus_pipeline.secret_scan(session, docs, FOLDER)
    assert most_rows() <= 500
    session.conf.set(key, "1m")
    corpus_pipeline.secret_scan(session, docs, FOLDER)
    assert session.conf.get(key) == "1m" and most_rows() <= 120
