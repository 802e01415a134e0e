"""The corpus pipeline: quality rules, near-duplicates, repeated substrings, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns of documents, but for
the last, which returns the tokens. Every document that is dropped or cut is named by a stage's rule:

* quality: documents that fail the base rules or that the trees reject go; a document without text goes.
* near duplicates: documents are linked whose sets of five-word shingles have a similarity of 0.8 or more; of each group
  the document with the smallest doc_id stays, of its repeated rows one.
* suffix dedup: bytes under a string of PASSAGE bytes that starts twice or more go, characters stay whole; a document
  of which nothing but white space is left goes.
* decontamination: documents that hold a benchmark item go; the text alone tells, so others of the same or no doc_id stay.
* tokens: ids of the rest, with the digest of their round trip.

Nulls: a null text counts as empty; lang, source and n_chars may be null and are carried. Repeated rows are duplicates
of each other. Empty input gives empty output. Further columns of the input are dropped by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import bpe, decontaminate, quality, simhash, suffix_dedup
from turnwise.llm.common import scratch, small, table, written
from turnwise.plans.ship import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of a repeated passage: under fifty words of any of the languages served.
PASSAGE = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge(docs.select(*COLUMNS), trees, keep=COLUMNS[1:])
    return judged.where("kept").select("doc_id", *(F.col(f"__{c}").alias(c) for c in COLUMNS[1:]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))  # no id has letters
    stays = simhash.similar_documents(docs.select("doc_id", "text")).where("stays").select(name.alias("__id"), F.col("key").alias("__key")).distinct()
    keyed = docs.select(*COLUMNS).withColumn("__id", name).withColumn("__key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    # rows that repeat the one that stays are its copies: one of them is kept
    first = F.min_by(F.struct(*COLUMNS), F.xxhash64("lang", "source", "n_chars")).alias("d")
    return keyed.join(stays, ["__id", "__key"], "left_semi").groupBy("__id", "__key").agg(first).select("d.*")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(docs.select(*COLUMNS), PASSAGE, whole=True)
    cut = found.select("row.*", F.decode("kept", "UTF-8").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
    return cut.where(F.col("text").rlike(r"\S")).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # documents may share an id or have none, so leaks are named by the text's hash
    keyed = docs.select(*COLUMNS).withColumn("__key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    found = decontaminate.leaks(keyed.select(F.col("__key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__key")).distinct()
    found = small(written(found, "leaks"))
    return keyed.join(found, "__key", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("suffix_dedup", passages), ("decontamination", decontaminated), ("byte_bpe", tokens)]

#: Fitted trees and tokenizer ids have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
