"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from postwarden.llm import (
    attention_lm, bytebpe, jaccard, kmeanstree, langid, lattice, lexical, negatives, packing, syncmers, toxicity, urltrie, warc,
)
from postwarden.llm.common import read, remainder

QUERIES: dict = {}

RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _held_out(divisor: int, left: int):
    return F.coalesce(remainder("doc_id", divisor) == left, F.lit(False)).alias("held_out")


@query
def op1_language_id(spark, d):
    docs = read(spark, d, "documents")
    out = langid.identified(
        docs, docs.filter(remainder("doc_id", 4) != 2), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    )
    return out.select("doc_id", _held_out(4, 2), "lang_pred", "score")


@query
def op2_byte_bpe(spark, d):
    return bytebpe.round_trips(
        read(spark, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query
def op5_warc(spark, d):
    return warc.archived(read(spark, d, "pages"), least_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op8_url_filter(spark, d):
    return urltrie.judged(read(spark, d, "pages"), RULES)


@query
def op6_best_fit_packing(spark, d):
    return packing.packed(read(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_toxicity(spark, d):
    docs = read(spark, d, "documents")
    return toxicity.scored(docs, docs.filter(remainder("doc_id", 4) != 2), read(spark, d, "labels")).select(
        "doc_id", _held_out(4, 2), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


@query
def op3_closed_syncmers(spark, d):
    return syncmers.compared_with_edited(read(spark, d, "documents"))


@query
def op7_lattice_neighbours(spark, d):
    return lattice.linked(read(spark, d, "embeddings"))


@query
def op9_jaccard_join(spark, d):
    return jaccard.joined(read(spark, d, "documents"))


@query
def op4_attention_scores(spark, d):
    return attention_lm.scored(
        read(spark, d, "documents"), remainder("doc_id", 5) == 1, public_tokenizers.path("piece_bpe_32k.model")
    )


@query
def op11_lexical_search(spark, d):
    return lexical.ranked(read(spark, d, "documents"), read(spark, d, "benchmark"))


@query
def op12_hard_negatives(spark, d):
    rows = read(spark, d, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query
def op13_nearest_vectors(spark, d):
    return kmeanstree.nearest(read(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)
