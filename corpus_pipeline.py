"""Corpus pipeline: five stages, each over all that the one before it kept.  Part of the training-data operators.

Edge cases, in any stage: a null or empty text, or one without a letter, goes in the first; a document whose key is null
or repeats is judged by its own text, like any other; of equal rows one stays after the second; nulls in other columns
pass through; texts of any length are read whole; an empty table gives an empty result; among near copies the smallest
key stays, of equal keys the text that sorts first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, jaccard, langid, secrets
from tessera.llm.common import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text shows a language; texts that are null, have no letter or bear no evidence go."""
    return langid.shows(docs, langid.fit(docs.where(~langid.is_held_out())))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard.keep_first(docs, Scratch(spark, "near"), words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "decontam"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return bpe.round_trip_digests(docs, bpe.default_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("secrets", mask_secrets),
    ("tokenize", tokenize),
]

#: Learned models decide in the first and fourth stage, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep_only(scratch.save(stage(spark, docs, sf_dir), name))
    return docs
