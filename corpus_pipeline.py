"""The corpus pipeline: stages over documents, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as
Parquet in the shared folder and reads it again for the next stage.  All stages but
the last return the columns of documents.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm import jaccard_join, language_id, line_dedup, packing, toxicity
from vicinity.llm.shared import fold, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = ("text", "lang", "source", "n_chars")
TOXIC = 0.7


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told (`und`: no text or no letter); a
    missing lang is filled with the prediction.  Learns as op10 does; without a labelled
    text every document is `und` and goes.  Repeated rows are judged each."""
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    found = language_id.predict(docs, language_id.learn(docs, ~held), carry=REST)
    told = found.where(F.col("lang_pred") != language_id.UND)
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic.  Learns as op6 does, from the labels of
    documents that are left; without labels of both kinds all score alike, so that all
    or none go.  Repeated rows score each; a null id is scored but never learned from."""
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held))
    return toxicity.score(docs, model, carry=REST).where(F.col("score") < TOXIC).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; a document that held nothing else goes.
    n_chars follows the text.  Null and empty texts and rows with a null id stay as they
    are; rows that repeat id and text are one place and are cleaned alike."""
    clean = line_dedup.dedup_lines(docs).where("n_removed = 0 OR n_removed < n_lines")
    return clean.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near copies.
    Documents without words, and with a null id, all stay; rows that repeat a kept id
    stay as well."""
    return jaccard_join.distinct_documents(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; one row per piece.  Null or empty
    text: the end id alone.  Repeated rows are packed each; no rows, no pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_duplicates),
    ("packing", pack),
]

#: SQL can't express the learned stages nor the tokenizer; tests/llm holds run()
#: against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
