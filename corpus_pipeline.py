"""Training-data pipeline over ``documents``: five stages, each written and read again.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``documents``. Nulls may stand in any column and rows may repeat, in id, text or both;
an empty table stays empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietgate.llm import language, near, packing, secrets, suffixes
from quietgate.llm.common import bounded_batches, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage with batches for Python that are bounded in bytes, whatever the texts' length."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language learned from the rows that are not held out.

    A null or empty text, or one without a letter, goes; so does one few of whose n-grams belong
    to its language. Rows that repeat meet the same fate each, ties of languages go to the more
    frequent one, and a null ``lang`` teaches nothing but is no reason to go.
    """
    held_out = F.coalesce(language.fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return language.known_language(docs, language.fit(docs.filter(~held_out)))


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: that of the least id (null lowest).

    Equal texts are one class, null and empty ones too; of rows that repeat in id and text one
    stays. Its columns and values are unchanged.
    """
    return near.one_of_each(docs)


@in_small_batches
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes byte strings of 400 or more that stand twice, in one text or several, every copy.

    The first copy goes too, as removal is judged on the input: a passage that many documents
    share is boilerplate here and leaves the corpus whole. Every row stays, one of which nothing
    is left with an empty text; a null text stays null.
    """
    return suffixes.deduplicated(docs)


@in_small_batches
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; every row stays, null and empty texts as they are."""
    return secrets.redacted(docs)


@in_small_batches
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document in a training sequence.

    A null or empty text is one piece of one id; repeated rows are packed each. Returns pieces,
    not documents.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Learned filters, signatures and tokenizers are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
