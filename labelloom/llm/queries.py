"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.llm import hard_negatives, id_files, jaccard_join, licenses, lm_scores, merge_automaton, mixing, neighbours, packing, quality_gam, quality_rules, token_alignment, token_counts
from labelloom.llm.common import documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark, d):
    return quality_rules.quality_rules(documents(spark, d))


@query
def op2_token_counts(spark, d):
    return token_counts.token_counts(documents(spark, d), BYTE_BPE, limit=512)


@query
def op3_packing(spark, d):
    return packing.pack(documents(spark, d), BYTE_BPE, end_id=0, window=1024)


@query
def op4_quality_classifier(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return quality_gam.quality_scores(documents(spark, d), labels)


@query
def op5_token_ids(spark, d):
    return id_files.encode_corpus(documents(spark, d), WORD_BPE, end_id=1)


@query
def op6_license_scan(spark, d):
    return licenses.license_scan(documents(spark, d))


@query
def op7_source_mixing(spark, d):
    mixed = mixing.mix(documents(spark, d).select("doc_id", "source"))
    return mixed.select("doc_id", "source", "mix.*")


ORACLE["op7_source_mixing"] = mixing.ORACLE_SQL


@query
def op8_lm_scores(spark, d):
    return lm_scores.lm_scores(documents(spark, d))


@query
def op9_jaccard_join(spark, d):
    return jaccard_join.linked_documents(documents(spark, d), size=3, percent=90)


@query
def op10_nearest_neighbours(spark, d):
    embeddings = spark.read.parquet(f"{d}/embeddings.parquet")
    return neighbours.nearest(embeddings, F.col("vec_id") % 100 == 0, k=10)


@query
def op11_bpe_round_trip(spark, d):
    return merge_automaton.encoding_digests(documents(spark, d), BYTE_BPE)


@query
def op12_token_alignment(spark, d):
    return token_alignment.alignment_digests(documents(spark, d), BYTE_BPE, PIECES)


@query
def op13_hard_negatives(spark, d):
    vectors = hard_negatives.whole_numbers(spark.read.parquet(f"{d}/embeddings.parquet"), 256, "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0, percent=80)


ORACLE["op13_hard_negatives"] = hard_negatives.ORACLE_SQL
