"""Article sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.functions.numeric import parse_revision_date
from labelloom.operators.scale import lookup_join

ARTICLE_SCHEMA = """
pmid BIGINT, title STRING, abstract_text STRING, year STRING, date_completed DATE, date_revised DATE,
golden ARRAY<STRING>
"""

# Field names of the envelope files.
ENVELOPE_SCHEMA = """
pmid BIGINT, title STRING, abstractText STRING, year STRING, Date_revised STRING,
Descriptor_names ARRAY<STRING>, Descriptor_UIs ARRAY<STRING>, newFGDescriptors ARRAY<STRING>,
weakLabel ARRAY<STRING>
"""
ENVELOPE_HEADER = '{"documents":['
ID_LINE = "PMID Version"


def read_articles(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Articles from Parquet, or from JSON lines when the path ends in json."""
    reader = spark.read.schema(ARTICLE_SCHEMA)
    rows = reader.json(path) if path.endswith("json") else reader.parquet(path)
    return rows.select(*columns) if columns else rows


def read_envelope_json(spark: SparkSession, path: str, schema: str = ENVELOPE_SCHEMA) -> DataFrame:
    """Articles of a ``{"documents":[`` file with one object per line.

    Lines are read as text, so one large file is split over many tasks; the separators at the line ends
    are dropped before parsing. A line that is no object with an id stops the job and is named.
    """
    lines = spark.read.text(path).where(~F.startswith(F.trim("value"), F.lit(ENVELOPE_HEADER)))
    bare = F.trim(F.regexp_replace("value", r"(,|\]\})\s*$", ""))
    objects = lines.where(bare != "").select("value", F.from_json(bare, schema).alias("_d"))
    unreadable = F.raise_error(F.concat(F.lit("unreadable line: "), F.left("value", F.lit(200))))
    checked = F.when(F.col("_d.pmid").isNull(), unreadable).otherwise(F.col("_d.pmid"))
    return objects.select("_d.*", checked.cast("long").alias("_checked")).withColumn("pmid", F.col("_checked")).drop("_checked")


def envelope_articles(documents: DataFrame) -> DataFrame:
    """Envelope rows under the column names of the engine."""
    return documents.select(
        "pmid",
        "title",
        F.col("abstractText").alias("abstract_text"),
        "year",
        parse_revision_date(F.col("Date_revised")).alias("date_revised"),
        F.coalesce("Descriptor_UIs", F.array().cast("array<string>")).alias("golden"),
        F.coalesce("newFGDescriptors", F.array().cast("array<string>")).alias("golden_in_scope"),
        F.coalesce("weakLabel", F.array().cast("array<string>")).alias("weak"),
    )


def scan_ids_by_file(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(pmid, file) for each line of the XML files that holds the id of one of the given articles."""
    lines = spark.read.text(path).where(F.contains("value", F.lit(ID_LINE)))
    found = lines.select(
        F.regexp_extract("value", rf"<{ID_LINE}[^>]*>(\d+)<", 1).cast("long").alias("pmid"),
        F.col("_metadata.file_name").alias("file"),
    )
    return lookup_join(found, ids.select(F.col("pmid").cast("long")).distinct(), "pmid", "left_semi")
