"""The helpers for hot keys against plain definitions, with one key holding most rows."""

import os
import random

import pytest
from pyspark.sql import Window, functions as F

from labelloom.functions.numeric import draw_bits
from labelloom.operators import scale


@pytest.fixture(scope="module")
def rows(spark):
    hot = spark.range(9000).select(F.lit("hot").alias("label"), F.col("id").alias("pmid"))
    cold = spark.range(3000).select(F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("label"), F.col("id").alias("pmid"))
    return hot.unionByName(cold)


@pytest.mark.parametrize("how", ["inner", "left_semi", "left", "left_anti"])
def test_lookup_is_the_same_broadcast_or_shuffled(spark, rows, how):
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("c3", 3)], "label string, v int")
    carrying = rows.withColumn("m", F.create_map(F.lit("k"), F.col("pmid")))
    direct = sorted(map(repr, scale.lookup_join(carrying, table, "label", how).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = sorted(map(repr, scale.lookup_join(carrying, table, "label", how).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert direct == shuffled


def test_lookup_starts_no_job(spark, rows):
    table = spark.createDataFrame([("hot", 1)], "label string, v int")
    spark.sparkContext.setJobGroup("lookup", "plan only")
    try:
        scale.lookup_join(rows, table, "label")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lookup")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("limit", [0, 1, 100, 1999, 4500, 9000, 20000])
def test_group_cuts_keep_exactly_the_first_rows(spark, rows, limit, monkeypatch):
    monkeypatch.setattr(scale, "BUCKET_ROWS", 300)
    drawn = rows.withColumn("bits", draw_bits(F.col("pmid"), F.col("label")))
    limits = rows.groupBy("label").agg(F.count("*").alias("group_rows")).withColumn("group_limit", F.lit(limit).cast("long"))
    cuts = scale.group_cuts(drawn, ["label"], "bits", "pmid", limits)
    same = F.coalesce((F.col("bits") == F.col("cut_bits")) & (F.col("pmid") <= F.col("cut_tie")), F.lit(False))
    got = drawn.join(cuts, "label").where((F.col("bits") < F.col("cut_bits")) | same).select("label", "pmid")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("bits", "pmid"))
    expected = drawn.withColumn("r", rank).where(F.col("r") <= limit).select("label", "pmid")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_number_rows(spark):
    rng = random.Random(1)
    keys = sorted({f"k{rng.randrange(10**6)}" for _ in range(2000)})
    df = spark.createDataFrame([(k,) for k in rng.sample(keys, len(keys))], "label string").repartition(5)
    got = {r["label"]: r["position"] for r in scale.number_rows(df, "label").collect()}
    assert got == {k: i for i, k in enumerate(keys)}


def test_materialize_uses_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    table = scale.materialize(spark.range(3), "numbers")
    assert folder in table.inputFiles()[0] and table.count() == 3


def test_null_keys_are_spread_over_tasks(spark):
    rows = spark.range(20_000).select(F.col("id").alias("pmid"), F.when(F.col("id") % 50 == 0, F.col("id").cast("string")).alias("ui"))
    table = spark.createDataFrame([(str(i), i) for i in range(0, 20_000, 100)], "ui string, v long")
    want = sorted(map(repr, rows.join(table, "ui", "left").select("pmid", "ui", "v").collect()))
    assert sorted(map(repr, scale.left_lookup(rows, table, "ui", "pmid").collect())) == want
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "20"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        sizes = {}
        for name, joined in (("plain", rows.join(table, "ui", "left")), ("spread", scale.left_lookup(rows, table, "ui", "pmid"))):
            parts = joined.groupBy(F.spark_partition_id()).count().collect()
            sizes[name] = max(r["count"] for r in parts)
        assert sizes["plain"] > 19_000 and sizes["spread"] < 2_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_scratch_tables_are_deleted(spark):
    with scale.scratch_tables(spark) as keep:
        gone = scale.materialize(spark.range(5), "gone").inputFiles()[0]
        with scale.scratch_tables(spark) as inner:
            stays = inner(spark.range(3), "stays")
            nested = scale.materialize(spark.range(2), "nested").inputFiles()[0]
        assert not os.path.exists(nested.removeprefix("file://")) and os.path.exists(gone.removeprefix("file://"))
        last = keep(stays.withColumn("x", stays["id"] + 1), "last")
    assert not os.path.exists(gone.removeprefix("file://"))
    assert last.count() == 3 and stays.count() == 3
    with pytest.raises(ZeroDivisionError), scale.scratch_tables(spark):
        scale.materialize(spark.range(2), "failed")
        1 / 0
    assert not scale._scratch
