"""The corpus pipeline: documents to packed training sequences in named stages.

Each stage works on all that the one before kept, and is written as Parquet before the next reads it.  All stages but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwarden.llm import jaccard, langid, packing, toxicity
from postwarden.llm.common import read
from postwarden.session import materialise, shared_dir, working_tables

#: A text is rejected as of no language below this share of the best one.  The share is practically 1 for texts of more
#: than a few words, so in effect only texts of unknown language are rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: A text is rejected as toxic from this probability on.
TOXIC_FROM = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a recognised language.  Their lang column stays as given; rows without a language teach nothing."""
    found = langid.identified(docs, docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), carry=True)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't toxic."""
    found = toxicity.scored(docs, docs, read(spark, sf_dir, "labels"), carry=True)
    return found.filter(F.col("score") < TOXIC_FROM).select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one text of each group of near copies: one with the smallest id.

    Different texts under one id are judged apart; of rows with the same id and text one stays.
    """
    # Rows travel as one column, so that no name of theirs clashes with the stage's own.
    rows = docs.select(
        F.col("doc_id").alias("id"), F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    )
    repeated = materialise(
        rows.filter("id is not null").groupBy("id").count().filter("count > 1").select("id"), "repeated"
    )
    single, keyed = rows, rows.select(F.col("id").alias("key"), "text")
    if not repeated.isEmpty():
        single = rows.join(repeated, "id", "left_anti")
        digest = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit(""))
        again = materialise(
            rows.join(repeated, "id", "left_semi").withColumn("digest", digest).dropDuplicates(["id", "digest"]), "again"
        )
        least = again.groupBy("id").agg(F.min("digest").alias("least"))
        # The first text of an id goes by the id, each other one by a hash.
        again = materialise(again.join(least, "id").withColumn(
            "key", F.when(F.col("digest") == F.col("least"), F.col("id")).otherwise(F.xxhash64("id", "digest"))
        ), "again-keyed")
        keyed = single.select(F.col("id").alias("key"), "text").union(again.select("key", "text"))
    groups = jaccard.joined(keyed, "key")
    gone = groups.filter("key <> component_id").select("key").distinct()
    if repeated.isEmpty():
        return rows.join(gone.withColumnRenamed("key", "id"), "id", "left_anti").select("row.*")
    groups = materialise(groups.filter("key is not null"), "groups")
    named = groups.join(again.select("key", "id", "digest"), "key", "left")
    first = F.min(F.struct(F.coalesce("id", "key").alias("id"), F.coalesce("digest", F.lit("")).alias("text"), "key"))
    # Where a hash is the smallest number of its group, the text with the smallest id stays instead.
    other = materialise(
        named.groupBy("component_id").agg(first.alias("first")).select("component_id", F.col("first.key").alias("key"))
        .filter("key <> component_id"), "other"
    )
    gone = materialise(
        groups.filter("key <> component_id").select("key").distinct().join(other.select("key"), "key", "left_anti")
        .union(other.select("component_id")), "gone"
    )
    kept = single.join(gone.withColumnRenamed("key", "id"), "id", "left_anti").select("row.*")
    return kept.union(again.join(gone, "key", "left_anti").select("row.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of at most 4096 tokens that hold the documents."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", distinct), ("packing", pack)]

#: No stage has an SQL form; the pipeline is tested against its operators' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, name)
        with working_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
