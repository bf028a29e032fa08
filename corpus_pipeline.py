"""A corpus pipeline: toxicity, near-duplicates, personal data, mixing to target weights, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; stages are written and read again in
between. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm import mixing, near_dup, pii, sentencepiece_codec, toxicity
from quire.llm.common import Stored, table


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half."""
    fitted = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = _free(docs, "toxicity_score")
    return toxicity.score(docs, fitted, docs.columns, out_col=name).where(F.col(name) < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingles alike by 0.8 or more: the one of the smallest id.

    Of rows that repeat that id within a group, the one of the least text hash stays; an id whose texts are in different
    groups can stay once in each. Documents without a word, or without an id, are in no group and stay.
    """
    found = Stored(near_dup.groups(docs, near_dup.Params(words=5, percent=80), detail=True), "groups")
    key, digest, at = (_free(docs, c) for c in ("kept_id", "kept_hash", "nth"))
    kept = found.df.where("kept and label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("m"), F.count("*").alias("n"))
    kept = Stored(kept.select(F.col("m.doc_id").alias(key), F.col("m.text_hash").alias(digest), "n"), "kept").df
    empty = found.df.where("label is null").select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest)).distinct()
    here = (F.col("doc_id") == F.col(key)) & (F.xxhash64("text") == F.col(digest))
    out = docs.join(kept.where("n = 1").select(key, digest).unionByName(empty), here, "left_semi")
    same = W.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    again = docs.join(kept.where("n > 1").select(key, digest), here, "left_semi")
    again = again.withColumn(at, F.row_number().over(same)).where(F.col(at) == 1).drop(at)
    return out.unionByName(again).unionByName(docs.where("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind; n_chars counts the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at rates for which 95 % of expected tokens are of the domain labelled good, 5 % of the other."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("domain"))
    return mixing.Mix(docs, labels).apply()


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded of every document (and of every copy)."""
    small = sentencepiece_codec.Params(block_chunks=200_000, block_chars=8_000_000)  # a task returns a block's ids and texts, not digests
    return sentencepiece_codec.encode(docs, sentencepiece_codec.model_path(), params=small)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_to_weights),
    ("sentencepiece", encode),
]
#: A trained network, a similarity join and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Stored(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
