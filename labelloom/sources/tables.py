"""Occurrence, crosswalk, label, split and prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.functions.text import split_list
from labelloom.operators.scale import lookup_join
from labelloom.sources.writers import SUM_UP_COLUMNS

OCCURRENCE_SCHEMA = "pmid BIGINT, cui STRING, entity_id BIGINT"
CROSSWALK_SCHEMA = "cui STRING, source_code STRING, source STRING"
DATASET_SCHEMA = "label STRING, pmid BIGINT, text STRING, target INT, split STRING"


def read_occurrences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OCCURRENCE_SCHEMA).parquet(path)


def read_occurrences_jdbc(
    spark: SparkSession, url: str, table: str, lower: int, upper: int, partitions: int, **options
) -> DataFrame:
    """Occurrences from a database, read in parallel ranges of article ids."""
    rows = (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn="PMID", lowerBound=lower, upperBound=upper,
                 numPartitions=partitions, **options)
        .load()
    )
    return rows.select(
        F.col("PMID").cast("long").alias("pmid"), F.col("CUI").alias("cui"), F.col("ENTITY_ID").cast("long").alias("entity_id")
    )


def read_crosswalk(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Crosswalk rows of one source vocabulary; the filter is pushed into the scan."""
    return spark.read.schema(CROSSWALK_SCHEMA).parquet(path).where(F.col("source") == source)


def read_label_table(
    spark: SparkSession,
    path: str,
    schema: str,
    sep: str = ",",
    list_columns: list[str] | None = None,
    only_leaves: bool = False,
) -> DataFrame:
    """Label CSV with a header; ``list_columns`` hold ``~``-joined lists.

    ``only_leaves`` keeps the labels without descendants (column ``#Descendant Ds``).
    """
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).option("escape", '"').csv(path)
    if only_leaves:
        rows = rows.where(F.col("`#Descendant Ds`").cast("int") == 0)
    for name in list_columns or []:
        rows = rows.withColumn(name, split_list(F.col(f"`{name}`")))
    return rows


def read_scopes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(label, scope) and (scope, member) as ``writers.write_scopes`` left them."""
    return (
        spark.read.schema("label STRING, scope STRING").parquet(f"{path}/label_scope"),
        spark.read.schema("scope STRING, member STRING").parquet(f"{path}/members"),
    )


def read_split_tables(
    spark: SparkSession, root: str, label_names: DataFrame, split: str, labels: list[str] | None = None
) -> DataFrame:
    """Rows of one split for all labels, with the label's name; only the needed folders are read."""
    rows = spark.read.schema(DATASET_SCHEMA).parquet(root).where(F.col("split") == split)
    if labels is not None:
        rows = rows.where(F.col("label").isin(labels))
    return stack_labels(rows, label_names)


def read_wide_split(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """(pmid, split, label, target, text) of the wide tables of a group, as ``writers.write_wide_split`` left them.

    An article has a row for each label that it is valid for; a label without a column gives a null target.
    """
    columns = "".join(f", `{x}` INT" for x in labels)
    options = {"header": True, "escape": '"', "multiLine": True}
    rows = spark.read.schema(f"pmid LONG, text STRING, valid_SCL STRING{columns}, split STRING").options(**options).csv(path)
    value = F.create_map(*[c for x in labels for c in (F.lit(x), F.col(f"`{x}`"))])
    valid = rows.withColumn("label", F.explode(split_list(F.col("valid_SCL"))))
    return valid.select("pmid", "split", "label", value[F.col("label")].alias("target"), "text")


def read_sum_up(spark: SparkSession, path: str) -> DataFrame:
    """The sum-up table of yearly datasets (``writers.write_sum_up``) with the names of ``stats.sum_up_statistics``."""
    kinds = {"year": "INT", "split": "STRING"}
    schema = ", ".join(f"`{title}` {kinds.get(name, 'LONG')}" for name, title in SUM_UP_COLUMNS.items())
    rows = spark.read.schema(f"{schema}, Level STRING").option("header", True).option("escape", '"').csv(path)
    return rows.toDF(*SUM_UP_COLUMNS, "level").withColumn("level", F.coalesce("level", F.lit("")))


def stack_labels(rows: DataFrame, label_names: DataFrame) -> DataFrame:
    """Dataset rows with the ``label_name`` of ``label_names`` (label, label_name); null for an unknown label."""
    return lookup_join(rows, label_names, "label", "left")


def clean_input(rows: DataFrame) -> DataFrame:
    """Id, text and label name as strings, without rows that miss one of them."""
    kept = rows.dropna(subset=["pmid", "text", "label_name"])
    return kept.withColumns({c: F.col(c).cast("string") for c in ("pmid", "text", "label_name")})


def matrix_to_long(matrix: DataFrame, label_order: DataFrame) -> DataFrame:
    """(pmid, values array) with values in label order -> (pmid, label, value).

    ``label_order`` is (pos, label), positions from 0. Values at other positions keep a null label.
    """
    cells = matrix.select("pmid", F.posexplode("values").alias("pos", "value"))
    return lookup_join(cells, label_order, "pos", "left").select("pmid", "label", "value")


def batches_to_rows(batches: DataFrame, batch_size: int, row_order: DataFrame) -> DataFrame:
    """Probabilities stored in batches -> (pmid, value).

    ``batches`` is (batch, values) with all but the last of ``batch_size`` values; ``row_order`` is
    (pos, pmid), positions from 0. Values beyond them keep a null id.
    """
    cells = batches.select("batch", F.posexplode("values").alias("_i", "value"))
    placed = cells.select((F.col("batch") * batch_size + F.col("_i")).alias("pos"), "value")
    return placed.join(row_order, "pos", "left").select("pmid", "value")
