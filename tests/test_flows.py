"""Properties of whole flows, and queries against their SQL, at the smallest scale."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from labelloom.operators import articles as art
from labelloom.operators import evaluate, model, sampling
from labelloom.testbed import views
from tools.check import TABLES, rows_of

D = "/root/testdata/sf0.001"

CHECKED = [
    "label_frequencies", "compare_labels", "relabel_dataset", "dataset_counters", "balance_negatives", "apply_sweep",
    "provenance_category", "latest_revision", "harvest_weak_labelled_articles", "parents_plus",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    mine = queries()[name](spark, D)
    cursor = duck.execute(oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(mine.columns) == sorted(names)
    assert rows_of(mine.columns, mine.collect()) == rows_of(names, cursor.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_counts_add_up(spark):
    bad = views.label_stats(spark, D).where("total_weak < fp OR total_gold < fn OR total_weak - fp <> total_gold - fn OR tn < 0")
    assert bad.count() == 0


def test_splits_are_disjoint_and_complete(spark):
    rows = views.dataset(spark, D)
    per_pmid = rows.groupBy("pmid").agg(F.countDistinct("split").alias("n"))
    assert per_pmid.where("n <> 1").count() == 0
    assert sampling.split_rows(rows.drop("split"), test=1).where("split <> 'test'").count() == 0


def test_relabelling_never_lowers_recall_and_higher_thresholds_flip_less(spark):
    scored = views.scored(spark, D).withColumn("model", F.lit("m"))
    swept = evaluate.with_scores(evaluate.apply_sweep(views.base_predictions(spark, D), scored, views.BASES, ["m"]))
    before = evaluate.with_scores(evaluate.confusion(views.base_predictions(spark, D), ["label"], views.BASES))
    joined = swept.join(before.select("label", "base", F.col("recall").alias("was")), ["label", "base"])
    assert joined.where("recall < was").count() == 0
    totals = swept.groupBy("threshold").agg(F.sum(F.col("tp") + F.col("fp")).alias("n")).orderBy("threshold").collect()
    assert all(a["n"] >= b["n"] for a, b in zip(totals, totals[1:]))


def test_sweep_over_two_models(spark):
    scored = views.scored(spark, D)
    both = scored.withColumn("model", F.lit("m")).unionByName(scored.withColumn("prob", F.lit(0.0)).withColumn("model", F.lit("zero")))
    swept = evaluate.apply_sweep(views.base_predictions(spark, D), both, views.BASES, ["m", "zero"], [0.5])
    before = evaluate.confusion(views.base_predictions(spark, D), ["label"], views.BASES)
    counts = ["label", "base", "tn", "fp", "fn", "tp"]
    zero = swept.where("model = 'zero'").select(*counts)
    assert sorted(map(tuple, zero.collect())) == sorted(map(tuple, before.select(*counts).collect()))
    single = evaluate.apply_sweep(views.base_predictions(spark, D), scored.withColumn("model", F.lit("m")), views.BASES, ["m"], [0.5])
    assert sorted(map(tuple, swept.where("model = 'm'").select(*counts).collect())) == sorted(map(tuple, single.select(*counts).collect()))


def _moved_pairs(df):
    return "Exchange hashpartitioning(pmid" in df._jdf.queryExecution().executedPlan().toString()


def test_relabelling_moves_no_pair_of_bucketed_articles(spark):
    base, scored = views.base_and_scored(spark, D)
    plain, plain_scored = views.base_predictions(spark, D), views.scored(spark, D)
    columns = ["label", "pmid", "gold", *views.BASES]
    new = evaluate.relabel(base, scored, 0.8, views.BASES)
    flips = {(r["label"], r["pmid"]) for r in plain_scored.where("prob > 0.8").collect()}
    wanted = [tuple(r[:3]) + tuple(max(x, (r[0], r[1]) in flips) for x in r[3:]) for r in plain.select(*columns).collect()]
    assert flips and sorted(map(tuple, new.select(*columns).collect())) == sorted(wanted)
    assert not _moved_pairs(new)


def test_sweep_moves_no_pair_of_bucketed_articles(spark):
    base, scored = views.base_and_scored(spark, D)
    swept = evaluate.apply_sweep(base, scored.withColumn("model", F.lit("m")), views.BASES, ["m"])
    pair_by_pair = evaluate.apply_sweep(
        views.base_predictions(spark, D), views.scored(spark, D).withColumn("model", F.lit("m")), views.BASES, ["m"],
        label_rows=views.base_predictions(spark, D).groupBy("label").agg(F.count("*").alias("rows")),
    )
    assert sorted(map(tuple, swept.collect())) == sorted(map(tuple, pair_by_pair.collect()))
    assert not _moved_pairs(swept)


def test_relabelling_and_sweep_keep_runs_apart(spark):
    pairs = [(run, f"L{i}", pmid, int(i == 0), int(pmid == 1)) for run in "ab" for i in range(2) for pmid in range(3)]
    base = spark.createDataFrame(pairs, "run string, label string, pmid long, gold int, weak int")
    scored = spark.createDataFrame(
        [("a", "m", "L0", 0, 0.9), ("a", "m", "L1", 2, 0.6), ("b", "m", "L0", 2, 0.5), ("b", "n", "L1", 0, 0.95)],
        "run string, model string, label string, pmid long, prob double",
    )
    new = evaluate.relabel(base, scored.where("model = 'm'"), 0.5, ["weak"], ["run"])
    flipped = {(r["run"], r["label"], r["pmid"]) for r in new.where("weak = 1 AND pmid <> 1").collect()}
    assert flipped == {("a", "L0", 0), ("a", "L1", 2)} and new.count() == 12
    swept = evaluate.apply_sweep(base, scored, ["weak"], ["m", "n"], [0.5, 0.9], ["run"])
    counts = {(r["run"], r["label"], r["model"], r["threshold"]): (r["tn"], r["fp"], r["fn"], r["tp"]) for r in swept.collect()}
    assert len(counts) == 16
    assert counts["a", "L0", "m", 0.5] == (0, 0, 1, 2) and counts["a", "L0", "m", 0.9] == (0, 0, 2, 1)
    assert counts["a", "L1", "m", 0.5] == (1, 2, 0, 0) and counts["b", "L1", "n", 0.9] == (1, 2, 0, 0)
    assert counts["b", "L0", "m", 0.5] == (0, 0, 2, 1) and counts["b", "L0", "n", 0.5] == (0, 0, 2, 1)


def test_statistics_hold_no_pairs_of_articles_and_labels(spark):
    from labelloom.operators import stats

    articles = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 3)], "k string, pmid long")
    golden = spark.createDataFrame(
        [("a", 1, "L1"), ("a", 1, "L1"), ("a", 1, "out"), ("a", 2, "L1"), ("a", 2, "L3"), ("a", 2, "L2"), ("b", 1, "L2"), ("b", 1, "L1")],
        "k string, pmid long, label string",
    )
    weak = spark.createDataFrame([("a", 1, "L2"), ("a", 1, "L3"), ("b", 9, "L1")], "k string, pmid long, label string")
    labels = spark.createDataFrame([("a", "L1"), ("a", "L2"), ("a", "L3"), ("a", "L3"), ("b", "L2")], "k string, label string")
    found = stats.article_statistics(articles, golden, weak, labels, labels.where("label = 'L2'"), ["k"])
    assert sorted(map(tuple, found.collect())) == [("a", 3, 1, 2, 1, 1, 3, 1), ("b", 2, 0, 1, 0, 1, 1, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[[^]]*pmid#\d+L, label#", plan)


def test_buckets_grow_with_articles(spark, monkeypatch):
    monkeypatch.setattr(views, "BUCKET_ARTICLES", 20)
    articles = views.dated_articles(spark, D)
    written = views.in_article_buckets(spark, D, articles, "some-articles")
    assert written.select(F.input_file_name()).distinct().count() == -(-articles.count() // 20) > 8
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, articles.collect()))


def test_retro_dataset_reads_golden_labels_once(spark):
    from labelloom.plans import curation

    ui = "descriptor_ui string, tree_numbers array<string>"
    now = spark.createDataFrame([("H", ["A01"]), ("N", ["A01.1"]), ("O", ["B01"])], ui)
    hosts = spark.createDataFrame([("N", "H")], "descriptor_ui string, host_ui string")
    rows = [(1, 10, "1999-05-05", "1999-06-01", "x"), (1, 11, "1999-05-05", "1999-07-01", "x"), (2, 20, "1999-05-05", "1999-06-01", "x"),
            (2, 21, "1999-05-05", "1999-07-01", ""), (3, 30, "1999-05-05", "1999-06-01", "x"), (4, 40, "1990-05-05", "1999-06-01", "x")]
    articles = spark.createDataFrame(rows, "pmid long, row_id long, date_completed string, date_revised string, abstract_text string")
    articles = articles.withColumns({c: F.to_date(c) for c in ("date_completed", "date_revised")})
    golden = [(10, "H"), (10, "N"), (11, "H"), (20, "N"), (20, "N"), (21, "O"), (30, "O"), (40, "N"), (20, None)]
    read = spark.sparkContext.accumulator(0)

    def counted(row):
        read.add(1)
        return row

    golden = spark.createDataFrame(spark.sparkContext.parallelize(golden, 2).map(counted), "row_id long, label string")
    occurrence = spark.createDataFrame([(1, "C"), (1, "C"), (3, "C")], "pmid long, cui string")
    cuis = spark.createDataFrame([("N", "C")], "label string, cui string")
    found = curation.build_retro_dataset(articles, golden, now.where("descriptor_ui = 'N'"), hosts, now, occurrence, cuis, 1999, 2001)
    assert sorted(map(tuple, found.collect())) == [(1, "N", 0, 1), (2, "N", 1, 0)]
    assert read.value == 9


def test_period_of_one_year(spark):
    dated = views.dated_articles(spark, D)
    found = art.completed_between(dated, 1998, 1998)
    months = {r[0] for r in found.select(F.month("date_completed")).distinct().collect()}
    assert months <= set(range(1, 12)) and found.where("year(date_completed) <> 1998").count() == 0
    assert art.completed_between(dated, None, 1998).count() == dated.count()


def test_balance_without_ratio_keeps_all(spark):
    rows = views.dataset(spark, D)
    assert sampling.balance_negatives(rows, None).count() == rows.count()


def test_model_learns_and_repeats(spark):
    rng = [("A", "alpha", f"alpha word{i % 7} x", 1, "train") for i in range(40)] + [
        ("A", "alpha", f"other word{i % 7} y", 0, "train") for i in range(80)
    ]
    rows = spark.createDataFrame(rng, "label string, label_name string, text string, target int, split string")
    features = model.featurise(model.with_class_weight(rows), 1 << 12)
    first = model.fit_pair_model(features, epochs=10)
    scored = model.score(first, features)
    assert scored.where("prob < 0 OR prob > 1").count() == 0
    assert scored.where("pred <> target").count() == 0
    again = model.fit_pair_model(features, epochs=10)
    assert (first.coefficients.toArray() == again.coefficients.toArray()).all()


def test_scorer_hook(spark):
    rows = spark.createDataFrame([("a", 0.2), ("b", 0.7)], "label string, x double")
    got = model.score_with(rows, lambda frame: frame["x"] * 1.0, threshold=0.5)
    assert sorted((r["label"], r["prob"], r["pred"]) for r in got.collect()) == [("a", 0.2, 0), ("b", 0.7, 1)]


def test_best_epoch_prefers_the_earliest(spark):
    metrics = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.3), ("r", 3, 0.3), ("s", 1, 0.1), ("s", 2, 0.2)], "run string, epoch int, val_loss double")
    assert sorted(map(tuple, sampling.best_epoch(metrics).collect())) == [("r", 2, 1), ("s", 1, 1)]


def test_harvest_over_buckets_moves_no_article(spark):
    from labelloom.operators.scale import materialize_bucketed
    from labelloom.plans import curation

    some = spark.range(6000).select(
        F.col("id").alias("pmid"), F.concat(F.lit("abstract "), F.md5(F.col("id").cast("string"))).alias("abstract_text"),
        F.array(F.concat(F.lit("L"), F.col("id") % 7), F.lit("L1")).alias("golden"), F.to_date(F.lit("1999-05-05")).alias("date_completed"),
    )
    hits = spark.range(9000).select((F.col("id") % 6500).alias("pmid"), F.concat(F.lit("C"), F.col("id") % 9).alias("cui"), F.col("id").alias("entity_id"))
    labels = spark.createDataFrame([(f"L{i}", f"M{i}") for i in range(5)], "label string, concept_ui string")
    crosswalk = spark.createDataFrame([(f"C{i}", f"M{i}", "S") for i in range(5)], "cui string, source_code string, source string")

    def harvested(articles, occurrence):
        return curation.harvest_weak_labelled_articles(articles, labels, occurrence, crosswalk, "S", 1998, 2000)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        plain = harvested(some, hits)
        bucketed = harvested(materialize_bucketed(some, "some_articles", "pmid", 4), materialize_bucketed(hits, "some_hits", "pmid", 4))
        assert sorted(map(repr, bucketed.collect())) == sorted(map(repr, plain.collect()))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (plain, bucketed)]
        assert ["Exchange hashpartitioning(pmid" in p for p in plans] == [True, False]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
