"""Helpers of the operators here: whole texts in Arrow batches, hashes of ids."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Bytes of text that one call of a function on texts gets at most (one longer text is one call).
SLICE_BYTES = 4_000_000


def reachable(spark: SparkSession) -> None:
    """Let Python workers that share this path import the package from where the driver has it.

    On a cluster the package is installed or sent with ``--py-files``.
    """
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def bounded_batches(spark: SparkSession) -> None:
    """Send Python workers at most SLICE_BYTES at a time (or one row): whole texts make rows of any size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > SLICE_BYTES:
        spark.conf.set(name, str(SLICE_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_hash(key: Column) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(key.cast("string").cast("binary"))


def held_out(key: Column, folds: int) -> Column:
    """Whether a row lies in fold 0 of its id's hash; a null id lies in none."""
    return F.coalesce(id_hash(key) % folds == 0, F.lit(False))


def _slices(batch, column: str) -> Iterator:
    """Cuts of a batch whose texts have SLICE_BYTES together, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_arrays(
    df: DataFrame,
    text: str,
    keep: list[str],
    make: Callable[[], Callable[[object], dict]],
    fields: list[T.StructField],
) -> DataFrame:
    """The kept columns of every row, with new columns computed from whole texts, batch by batch.

    ``make`` runs once per task and gives the function that turns an Arrow array of texts into one list or
    array per new field. Rows keep their order and number.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    reachable(df.sparkSession)
    bounded_batches(df.sparkSession)
    clashes = {f.name for f in fields} & set(keep)
    if clashes:
        raise ValueError(f"columns {sorted(clashes)} would appear twice")
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    # A kept text travels once.
    kept = text in keep and isinstance(df.schema[text].dataType, T.StringType)
    source = text if kept else "_text"

    def run(batches):
        import pyarrow as pa

        arrow = to_arrow_schema(T.StructType(fields))
        function = make()
        for batch in batches:
            for part in _slices(batch, source):
                new = function(part.column(source))
                columns = [part.column(i) for i in range(len(keep))]
                columns += [pa.array(new[f.name], type=f.type, from_pandas=False) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *arrow.names])

    extra = [] if kept else [F.col(text).cast("string").alias("_text")]
    return df.select(*keep, *extra).mapInArrow(run, schema)


def map_texts(
    df: DataFrame,
    text: str,
    keep: list[str],
    make: Callable[[], Callable[[list], dict]],
    fields: list[T.StructField],
) -> DataFrame:
    """As ``map_arrays``, for functions of a list of texts (null: None)."""

    def listed():
        function = make()
        return lambda texts: function(texts.to_pylist())

    return map_arrays(df, text, keep, listed, fields)


def text_column(
    df: DataFrame, text: str, function: Callable[[list], object], kind: T.DataType
) -> Column:
    """What ``function`` gives for a list of whole texts (null: None), as a column of ``df``.

    Only texts go to Python; the other columns of a row wait in the JVM.
    """
    from pyspark.sql.functions import arrow_udf
    from pyspark.sql.pandas.types import to_arrow_type

    reachable(df.sparkSession)
    bounded_batches(df.sparkSession)

    @arrow_udf(kind)
    def column(texts):
        import pyarrow as pa

        found = function(texts.to_pylist())
        if isinstance(kind, T.StructType):
            arrow = [to_arrow_type(f.dataType) for f in kind.fields]
            parts = [pa.array(found[f.name], type=t) for f, t in zip(kind.fields, arrow, strict=True)]
            return pa.StructArray.from_arrays(parts, names=kind.names)
        return pa.array(found, type=to_arrow_type(kind))

    return column(F.col(text).cast("string"))
