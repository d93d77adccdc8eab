"""Building blocks that keep a hot key from landing in one task.

One article, label, concept or host may hold a large part of all rows. Grouped counts are safe
because Spark combines them before the shuffle; the helpers here cover the other cases: joining
with a vocabulary table, keeping the first n rows of a group, and numbering rows.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from labelloom.functions.numeric import draw_bits

BUCKET_ROWS = 2_000
# Tasks that rows with a null key are dealt out to, at most.
NULL_PARTS = 4_096


def lookup_join(rows: DataFrame, table: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join many rows, possibly with hot keys, to a vocabulary table.

    One plan at every size, and no job while it is built: Spark broadcasts the table when its own size
    figures allow it, and otherwise shuffles both sides. It then splits the partition of a hot key where the
    partition is large (``spark.sql.adaptive.skewJoin.*``) and no aggregate on the same key follows.
    """
    return rows.join(table, on, how)


def left_lookup(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` left-joined to a table on a key that is null in many rows.

    Null keys match nothing, yet would all meet in one task: they are dealt out by the hash of column ``by``.
    """
    dealt = F.when(F.col(key).isNull(), 1 + F.pmod(F.xxhash64(by), F.lit(NULL_PARTS))).otherwise(0).cast("int")
    # One key of two fields: Spark would turn a separate field, the same in all rows of the table, into a filter.
    keyed = rows.withColumn("_own", F.struct(F.col(key).alias("key"), dealt.alias("part")))
    other = table.withColumn("_own", F.struct(F.col(key).alias("key"), F.lit(0).alias("part"))).drop(key)
    return keyed.join(other, "_own", "left").drop("_own")


def group_cuts(rows: DataFrame, keys: list[str], order_bits: str, tie: str, limits: DataFrame) -> DataFrame:
    """(keys, cut_bits, cut_tie): the last row to keep when each group keeps its first ``group_limit`` rows.

    Rows are ordered by (``order_bits``, ``tie``); ``limits`` is (keys, group_rows, group_limit).
    ``order_bits`` is an evenly spread 32-bit number: its range is cut into buckets, more of them for
    larger groups, and counted. Only the bucket in which the limit falls, of bounded size, is ranked, so
    no group is sorted as a whole. ``cut_bits`` is -1 to keep nothing and above all bits to keep all.
    """
    limits = materialize(limits, "group-limits")
    partial = limits.where((F.col("group_limit") > 0) & (F.col("group_limit") < F.col("group_rows")))
    n_buckets = F.least(F.ceil(F.col("group_rows") / BUCKET_ROWS), F.lit(1 << 20))
    bucket = F.floor(F.col(order_bits) * n_buckets / F.lit(1 << 32)).cast("int")
    narrow = rows.select(*keys, order_bits, tie)
    sizes = (
        lookup_join(narrow.drop(tie), partial, keys)
        .groupBy(*keys, "group_rows", "group_limit", bucket.alias("_bucket"))
        .agg(F.count("*").alias("_n"))
    )
    below = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("group_limit") - F.coalesce(F.sum("_n").over(below), F.lit(0))
    edges = (
        sizes.withColumn("_left", left)
        .where((F.col("_left") > 0) & (F.col("_left") <= F.col("_n")))
        .select(*keys, "group_rows", F.col("_bucket").alias("_edge"), "_left")
    )
    in_edge = lookup_join(narrow, materialize(edges, "group-edges"), keys).where(bucket == F.col("_edge"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order_bits, tie))
    found = in_edge.withColumn("_rank", rank).where(F.col("_rank") == F.col("_left"))
    plain = limits.join(partial, keys, "left_anti").select(
        *keys,
        F.when(F.col("group_limit") > 0, F.lit(1 << 32)).otherwise(F.lit(-1)).cast("long").alias("cut_bits"),
        F.lit(None).cast(rows.schema[tie].dataType).alias("cut_tie"),
    )
    cuts = found.select(*keys, F.col(order_bits).alias("cut_bits"), F.col(tie).alias("cut_tie"))
    return materialize(cuts.unionByName(plain), "group-cuts")


def number_rows(df: DataFrame, key: str, name: str = "position", parts: int = 64) -> DataFrame:
    """Number the rows of a table with a unique string ``key`` from 0 in key order, in parallel.

    A few keys cut the order into ranges; counting the ranges gives each one its offset. The cut keys
    are a fixed-size sample, and any sample gives the same numbers.
    """
    sample = (
        df.select(F.col(key).alias("_k"))
        .orderBy(draw_bits(F.col(key)), key)
        .limit(parts)
        .collect()
    )
    cuts = sorted(r["_k"] for r in sample)
    part = F.lit(0)
    for cut in cuts:
        part = part + (F.col(key) >= F.lit(cut)).cast("int")
    ranged = df.withColumn("_part", part)
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .drop("_n")
    )
    within = Window.partitionBy("_part").orderBy(key)
    return (
        ranged.withColumn("_row", F.row_number().over(within))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_row") - 1)
        .drop("_part", "_row", "_offset")
    )


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="labelloom-")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only for a local session without any."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder(context.applicationId)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a table that is small but costly to work on, spread over as many tasks as a shuffle has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# A writer of files looks at its pages and row groups every few rows, since a hundred rows, as usual, may be hundreds of
# megabytes. Pages are large enough to hold several rows, so that lists which recur in them are written once.
WIDE_PAGE = 32 << 20
WIDE_ROWS = {
    **{f"parquet.{unit}.size.row.check.min": 1 for unit in ("page", "block")},
    **{f"parquet.{unit}.size.row.check.max": 8 for unit in ("page", "block")},
    "parquet.page.size": WIDE_PAGE,
    "parquet.dictionary.page.size": WIDE_PAGE,
}


def write_wide_rows(spark: SparkSession) -> None:
    """From now on files of rows with megabytes each are written in bounded memory."""
    for name, value in WIDE_ROWS.items():
        spark.conf.set(name, str(value))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read, and read it back with its lineage cut."""
    path = new_folder(df.sparkSession, name)
    if _scratch:
        _scratch[-1].append(path)
    return _written(df, path)


# Tables written in each open scope, the innermost last.
_scratch: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are written inside are deleted at the end.

    Gives a ``materialize`` for those that stay: what is handed on must be one of them, or not read the others.
    """
    paths: list[str] = []
    _scratch.append(paths)

    try:
        yield lambda df, name: _written(df, new_folder(spark, name))
    finally:
        _scratch.pop()
        context = spark.sparkContext
        for path in paths:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def materialize_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write a table that meets others of as many buckets on ``key``: they are joined and grouped without a shuffle.

    The files lie in the shared folder; the table is known to this session's catalog.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    table = f"{name}_{path.rsplit('-', 1)[1]}".replace("-", "_")
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)
