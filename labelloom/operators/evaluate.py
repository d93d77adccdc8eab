"""Predictions against golden labels, and the effect of relabelling at many thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from labelloom.functions.numeric import ratio_or_zero, threshold_grid


def confusion(predictions: DataFrame, keys: list[str], bases: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp per key from a 0/1 column gold and one 0/1 column per prediction method.

    With ``bases`` the result has one row per method, named in column base; otherwise the method is the
    column pred. All methods are counted in one pass.
    """
    gold = F.col("gold") == 1

    def cells(method):
        no, yes = F.col(method) == 0, F.col(method) == 1
        return [
            F.count_if(~gold & no).alias("tn"),
            F.count_if(~gold & yes).alias("fp"),
            F.count_if(gold & no).alias("fn"),
            F.count_if(gold & yes).alias("tp"),
        ]

    if bases is None:
        return predictions.groupBy(*keys).agg(*cells("pred"))
    counts = predictions.groupBy(*keys).agg(
        *[F.struct(F.lit(b).alias("base"), *cells(b)).alias(f"_{b}") for b in bases]
    )
    return counts.select(*keys, F.inline(F.array(*[F.col(f"_{b}") for b in bases])))


def with_scores(counts: DataFrame) -> DataFrame:
    """Confusion counts plus precision, recall and f1 of the positive class; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.withColumn("precision", ratio_or_zero(tp, tp + fp))
        .withColumn("recall", ratio_or_zero(tp, tp + fn))
        .withColumn("f1", ratio_or_zero(2 * tp, 2 * tp + fp + fn))
    )


def classification_report(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Long report per key: rows 0, 1, accuracy, macro avg and weighted avg.

    The accuracy row carries its value in f1, its support is the number of rows. Rows 0 and 1 keep the
    confusion counts on row 1 only.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    p1, r1, f1 = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn), ratio_or_zero(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = ratio_or_zero(tn, tn + fn), ratio_or_zero(tn, tn + fp), ratio_or_zero(2 * tn, 2 * tn + fp + fn)
    s0, s1 = tn + fp, tp + fn
    total = s0 + s1
    null = F.lit(None).cast("double")

    def row(name, precision, recall, score, support):
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            score.alias("f1"),
            support.alias("support"),
        )

    def macro(a, b):
        return (a + b) / 2

    def weighted(a, b):
        return ratio_or_zero(a * s0 + b * s1, total)

    rows = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("accuracy", null, null, ratio_or_zero(tp + tn, total), total),
        row("macro avg", macro(p0, p1), macro(r0, r1), macro(f0, f1), total),
        row("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), total),
    )
    exploded = counts.select(*keys, "tn", "fp", "fn", "tp", F.explode(rows).alias("_r"))
    one = F.col("_r.class") == "1"
    return exploded.select(
        *keys, "_r.*", *[F.when(one, F.col(c)).alias(c) for c in ("tn", "fp", "fn", "tp")]
    )


def micro_macro_f1(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Micro F1 (summed counts) and macro F1 (mean over labels) per key."""
    scored = with_scores(counts)
    sums = scored.groupBy(*keys).agg(
        F.sum("tp").alias("_tp"), F.sum("fp").alias("_fp"), F.sum("fn").alias("_fn"), F.avg("f1").alias("macro_f1")
    )
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    return sums.select(*keys, ratio_or_zero(2 * tp, 2 * tp + fp + fn).alias("micro_f1"), "macro_f1")


def weighted_log_loss(
    scored: DataFrame, keys: list[str], pos_weight: str = "pos_weight", weight_mode: str | list[str] = "positive"
) -> DataFrame:
    """Mean binary cross-entropy per key; positives, or all rows, count ``pos_weight`` times.

    Several modes are computed in one pass and give a row each, named in column mode.
    """
    tiny = 1e-12
    p = F.least(F.greatest(F.col("prob"), F.lit(tiny)), F.lit(1 - tiny))
    y, w = F.col("target").cast("double"), F.col(pos_weight).cast("double")
    loss = {
        "positive": -(w * y * F.log(p) + (1 - y) * F.log(1 - p)),
        "all": -w * (y * F.log(p) + (1 - y) * F.log(1 - p)),
    }
    modes = [weight_mode] if isinstance(weight_mode, str) else weight_mode
    if not set(modes) <= set(loss):
        raise ValueError("weight_mode must be 'positive' or 'all'")
    means = scored.groupBy(*keys).agg(*[F.avg(loss[m]).alias(f"_{m}") for m in modes])
    if isinstance(weight_mode, str):
        return means.withColumnRenamed(f"_{weight_mode}", "log_loss")
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"_{m}").alias("log_loss")) for m in modes])
    return means.select(*keys, F.inline(rows))


def validation_summary(counts: DataFrame, keys: list[str], digits: int = 3) -> DataFrame:
    """Rounded macro averages per run over the two classes."""
    report = classification_report(counts, keys).where(F.col("class") == "macro avg")
    return report.select(
        *keys,
        *[F.round(c, digits).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        F.col("support"),
    )


def support_columns(base: DataFrame, dataset: DataFrame, keys: list[str], bases: list[str]) -> DataFrame:
    """Per label: valid_docs of the relabelling dataset, positives of each base method, golden support.

    ``base`` is (keys, label, pmid, gold, one column per base method).
    """
    counts = base.groupBy(*keys, "label").agg(
        *[F.sum(b).alias(f"{b}_docs") for b in bases], F.sum("gold").alias("support")
    )
    valid = dataset.groupBy(*keys, "label").agg(F.count("*").alias("valid_docs"))
    return counts.join(valid, [*keys, "label"], "left").withColumn(
        "valid_docs", F.coalesce("valid_docs", F.lit(0).cast("long"))
    )


def relabel(
    base: DataFrame, scored: DataFrame, threshold: float, bases: list[str], keys: list[str] | None = None
) -> DataFrame:
    """Base predictions with 1 where a scored article of the label lies above the threshold.

    ``base`` is (keys, label, pmid, gold, one 0/1 column per base method), ``scored`` holds valid articles
    only; the comparison is strict.
    """
    article = ["pmid", *(keys or [])]
    # Scores that flip nothing are not shuffled. Pairs meet by article alone: those of a table that is bucketed or
    # partitioned by article stay where they are, and the many rows of ``base`` are not sorted.
    flips = scored.where(F.col("prob") > F.lit(threshold)).groupBy(*article).agg(F.collect_set("label").alias("_flips"))
    flip = F.coalesce(F.array_contains("_flips", F.col("label")), F.lit(False)).cast("int")
    met = base.join(flips.hint("shuffle_hash"), article, "left")
    return met.withColumns({b: F.greatest(F.col(b), flip) for b in bases}).drop("_flips")


def _levels_of_articles(base: DataFrame, levels: DataFrame, article: list[str], names: list[str]) -> DataFrame:
    """``base`` with the columns ``names`` of its pairs in ``levels``; an article's labels meet it as one list."""
    listed = levels.groupBy(*article).agg(F.collect_list(F.struct("label", *names)).alias("_s"))
    lists = listed.select(*article, F.col("_s.label").alias("_labels"), *[F.col(f"_s.{n}").alias(n) for n in names])
    place = F.array_position("_labels", F.col("label")).cast("int") - 1
    met = base.join(lists.hint("shuffle_hash"), article, "left")
    return met.withColumns({n: F.get(F.col(n), place) for n in names})


def apply_sweep(
    base: DataFrame,
    scored: DataFrame,
    bases: list[str],
    models: list[str],
    thresholds: list[float] | None = None,
    keys: list[str] | None = None,
    label_rows: DataFrame | None = None,
) -> DataFrame:
    """Confusion counts after relabelling, for every key, label, base method, model and threshold.

    ``base`` is (keys, label, pmid, gold, one 0/1 column per base method), ``scored`` (keys, model, label,
    pmid, prob) of articles that ``base`` has too, one row per pair and model.

    A row's level is the number of thresholds below its probability; rows are counted per level, and the at most
    ``len(thresholds) + 1`` counts of a key are then summed up per threshold. Scores that pass no threshold are not
    shuffled. The rows of ``base`` meet the others by article, in one pass for all models and without a sort; where
    both are bucketed by article, nothing is shuffled before the counts.

    With ``label_rows`` (keys, label, rows) ``base`` needs no rows that are neither golden nor positive: the marked
    ones meet the scores by pair, and true negatives are what remains of a label's rows.
    """
    grid = threshold_grid(thresholds)
    keys = keys or []
    # the article first: sorting by a label compares long equal prefixes
    pair = ["pmid", "label", *keys]
    passed = sum(((F.col("prob") > F.lit(t)).cast("int") for t in grid), F.lit(0))
    names = [f"_level{i}" for i in range(len(models))]
    high = scored.where(F.col("model").isin(models) & (F.col("prob") > F.lit(min(grid))))
    if len(models) == 1:
        levels = high.select(*pair, passed.alias(names[0]))
    else:
        levels = high.groupBy(*pair).agg(
            *[F.max(F.when(F.col("model") == m, passed)).alias(n) for m, n in zip(models, names)]
        )
    if label_rows is None:
        met = _levels_of_articles(base, levels, ["pmid", *keys], names)
    else:
        marked = reduce(lambda a, b: a | b, [F.col(c) == 1 for c in ("gold", *bases)])
        met = base.where(marked).select(*pair, "gold", *bases).join(levels, pair, "full")
    per_model = F.array(
        *[F.struct(F.lit(m).alias("model"), F.coalesce(n, F.lit(0)).alias("_level")) for m, n in zip(models, names)]
    )
    rows = met.select(
        *keys, "label", (F.coalesce("gold", F.lit(0)) == 1).alias("_gold"),
        *[F.coalesce(b, F.lit(0)).alias(b) for b in bases], F.inline(per_model),
    )
    gold = F.col("_gold")
    cells = rows.groupBy(*keys, "label", "model", "_level").agg(
        *[
            F.struct(
                F.lit(b).alias("base"),
                F.count_if(gold & (F.col(b) == 1)).alias("_tp"),
                F.count_if(~gold & (F.col(b) == 1)).alias("_fp"),
                F.count_if(gold & (F.col(b) == 0)).alias("_open_gold"),
                F.count_if(~gold & (F.col(b) == 0)).alias("_open_other"),
            ).alias(f"_{b}")
            for b in bases
        ]
    )
    by_base = cells.select(*keys, "label", "model", "_level", F.inline(F.array(*[F.col(f"_{b}") for b in bases])))
    steps = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    flipped = F.col("_level") > F.col("_i")
    zero = F.lit(0).cast("long")
    cell = [*keys, "label", "base", "model", "threshold"]
    counts = by_base.select("*", F.inline(steps)).groupBy(*cell).agg(
        F.sum(F.col("_fp") + F.when(flipped, F.col("_open_other")).otherwise(zero)).alias("_fp"),
        F.sum(F.when(~flipped, F.col("_open_gold")).otherwise(zero)).alias("_fn"),
        F.sum(F.col("_tp") + F.when(flipped, F.col("_open_gold")).otherwise(zero)).alias("_tp"),
        F.sum(F.when(~flipped, F.col("_open_other")).otherwise(zero)).alias("_tn"),
    )
    if label_rows is None:
        return counts.select(*cell, *[F.col(f"_{c}").alias(c) for c in ("tn", "fp", "fn", "tp")])
    # One row per label from here on; a label without any marked row has true negatives only.
    whole = label_rows.toDF(*keys, "label", "_rows")
    for name, values in (("base", bases), ("model", models), ("threshold", grid)):
        whole = whole.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    fp, fn, tp = (F.coalesce(c, zero) for c in ("_fp", "_fn", "_tp"))
    return whole.join(counts, cell, "left").select(
        *cell, (F.col("_rows") - fp - fn - tp).alias("tn"), fp.alias("fp"), fn.alias("fn"), tp.alias("tp")
    )
