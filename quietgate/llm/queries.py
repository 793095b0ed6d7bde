"""The registered queries of this package and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    language, lexical, near, packing, pieces, secrets, simhash, spotsigs, suffixes, topk, toxicity, urls, whitening,
)
from .common import table


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets(table(spark, folder, "documents"))


def op2_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.edited(table(spark, folder, "documents"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op4_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"))


def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.summary(table(spark, folder, "documents"))


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoded_digest(table(spark, folder, "documents"))


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return urls.judge(pages, urls.listed_pages(pages))


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "documents"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(language.fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    model = language.fit(docs.filter(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language.predict(rows, model).drop("text")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.coalesce(toxicity.fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    grammar = toxicity.fit(docs, labels.filter(~held_out))
    return toxicity.score(docs.withColumn("held_out", held_out), grammar, "held_out")


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_spotsigs, op3_best_fit_packing, op4_exact_top_k, op5_suffix_array_dedup,
        op6_sentencepiece, op7_url_filter, op8_near_duplicates, op9_language_id, op10_toxicity,
        op11_lexical_search, op12_simhash, op13_whitening,
    )
}
ORACLES: dict[str, str] = {
    "op4_exact_top_k": topk.SQL,
    "op5_suffix_array_dedup": suffixes.SQL,
    "op7_url_filter": urls.SQL,
    "op11_lexical_search": lexical.SQL,
}
