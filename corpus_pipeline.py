"""A corpus from raw documents to token ids: each stage works on what the one before it wrote.

Stages take documents with any columns besides doc_id, text, lang and source, and keep them up to the last one; an empty
table stays empty at each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import bpe, jaccard, mixing, pii, quality
from rivulet.llm.common import cut, drop, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts are scored as texts without words, rows with null or repeated ids each by their own text; equal
    texts have equal scores. Without labels to learn from all have the same score.
    """
    return quality.good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id.

    Null, empty and blank texts are in no group and stay, as do rows with null id. Of rows that repeat an id and its
    text one stays; where an id has several texts, each counts by itself.
    """
    return jaccard.one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal values; n_chars, where there is such a column, follows the text.

    Null and empty texts stay as they are, and all rows stay, repeated ones too; equal values have equal pseudonyms.
    """
    out = pii.pseudonymised(docs, pii.key_of(spark), n_found="__found")
    return out.select(*(F.when(F.col("__found") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each document and pass.

    Texts without words, null and empty ones, are in no mix and go. A null source is one of its own, the last. Repeated
    rows are rows of their own; which of them comes first changes nothing.
    """
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of each row; a null text has the ids of an empty one: none."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("pii", pii_stage),
    ("mix_sources", mixing_stage),
    ("byte_bpe", token_stage),
]
#: Trees, pseudorandom draws and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage read goes as soon as its own rows are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
