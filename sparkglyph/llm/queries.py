"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import hamming, htmltext, langid, minhash, mixing, packing, quality, secret_scan, toxicity, word_contexts

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(C.table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(C.table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(C.table(spark, sf_dir, "documents"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.embedding_search(C.table(spark, sf_dir, "embeddings"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_contexts.score(C.table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(C.table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(C.table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(C.table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.host_quality(C.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    made = (op1_mixing, op2_minhash, op3_secret_scans, op4_topk_search, op5_lm_scoring, op6_packing, op7_language_id, op8_toxicity, op9_html_extraction, op10_quality_rules)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op4_topk_search": hamming.oracle_sql(), "op10_quality_rules": quality.oracle_sql()}
