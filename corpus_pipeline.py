"""Corpus pipeline: language ID, near-dedup, secret redaction, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkglyph.llm import common, langid, minhash, mixing, packing, secret_scan

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Folders that earlier stages of a session have written on their way, not yet deleted.
_LEFT: dict[str, list[str]] = {}


def _stage(f: Stage) -> Stage:
    """Deletes what earlier stages have written on their way, once ``docs`` no longer reads from it."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
        files = docs.inputFiles()
        name = lambda path: path.rstrip("/").rsplit("/", 1)[-1]
        read = {name(file.rsplit("/", 1)[0]) for file in files}
        for path in [p for p in left if name(p) not in read]:
            common.delete(spark, path)
            left.remove(path)
        with common.written_folders() as folders:
            out = f(spark, docs, sf_dir)
        left += folders
        return out

    return run


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; `und` ones go. A null language gets the predicted one.

    Null, empty and letterless texts are `und`. Null ids and sources pass
    through; repeated rows are judged each; columns of any other name pass
    through. An empty table, or one without a language to learn, comes back as it is.
    """
    cols = docs.columns
    held = common.crc_mod(F.col("doc_id"), langid.FOLDS) == langid.HELD_OUT
    model = langid.train(docs, ~held)
    if model is None:
        return docs  # nothing to judge by
    own = {c: f"in_{i}" for i, c in enumerate(cols)}  # other columns may bear any name
    inner = docs.withColumnsRenamed(own)
    known = langid.predict(inner, model, list(own.values()), own["text"]).where(F.col("lang_pred") != "und")
    return known.withColumn(own["lang"], F.coalesce(own["lang"], "lang_pred")).select(*(F.col(v).alias(c) for c, v in own.items()))


@_stage
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Null, empty and blank texts and rows with a null id have no copies and stay;
    repeated rows are one document, whose rows all stay or all go; an empty table
    gives an empty result; columns of any other name pass through.
    """
    return minhash.keep_one(docs, width=5, percent=80)


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars follows the text.

    Null, empty and other texts without secrets stay as they are; repeated rows
    are masked each; an empty table gives an empty result; columns of any other
    name pass through.
    """
    return secret_scan.redact(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row of a document for each pass in which its source's target takes it, the last pass cut at the target.

    Null, empty and blank texts have no words to take and go; null sources are
    one source; null ids pass through; repeated rows are separate documents; an
    empty table gives an empty result; columns of any other name pass through.
    """
    return mixing.mixed_documents(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens.

    Null and empty texts hold the end id alone; null ids stay null; repeated rows
    are packed each; an empty table gives an empty result; other columns are ignored.
    """
    return packing.pack(docs)


STAGES = [("language_id", language), ("near_dedup", dedup), ("secret_scan", secrets), ("mixing", mix), ("packing", pack)]

#: Networks, hashes and tokenizers have no form in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialize(docs, name)
    return docs
