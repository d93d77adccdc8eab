"""A corpus pipeline in stages, each of them one of the operators in labelloom/llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared
folder and the next stage reads it as its docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.llm import jaccard_join, mixing, packing, quality_gam, quality_rules
from labelloom.llm.common import documents
from labelloom.operators.scale import materialize

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model accepts; it learns from the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_gam.accepted(docs, labels, accept=0.3)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted votes of the quality rules keep."""
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard similarity 0.8 of five-word shingles."""
    return jaccard_join.one_per_group(docs, size=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files in the order of the mixture: sources at their target weights throughout."""
    return mixing.in_mixed_order(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, which follow the order of the mixture.

    Stages hand on the columns of documents. The order that the mixing stage wrote is read off the files and the
    rows' numbers in them; documents that no mixing stage has written are mixed here, without their texts.
    """
    if mixing.is_ordered(docs):
        placed = mixing.with_file_places(docs, "_file", "_row")
        rows = packing.measured(placed, TOKENIZER, end_id=0, window=1024, keep=("_file", "_row"))
        return packing.pack_ranges(mixing.file_positions(rows, "_file", "_row", "position"), "position", window=1024)
    rows = packing.measured(docs, TOKENIZER, end_id=0, window=1024, keep=("source",))
    name = ["part", "tail", "tail_rank"]
    mixed = mixing.mix(rows.select(*name, "doc_id", "source")).select(*name, F.col("mix.position").alias("position"))
    return packing.pack_ranges(rows.join(mixed, name), "position", window=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("packing", sequence_packing),
]

# The learned stages cannot be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
