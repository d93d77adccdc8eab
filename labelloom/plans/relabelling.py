"""From weakly labelled articles to relabelled predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelloom.functions.numeric import remap_unknown
from labelloom.operators import evaluate, hierarchy, labels, sampling, training
from labelloom.operators.scale import materialize, spread
from labelloom.sources.tables import clean_input, stack_labels
from labelloom.sources.writers import attach_text


def build_relabel_datasets(
    golden: DataFrame,
    weak: DataFrame,
    label_scope: DataFrame,
    members: DataFrame,
    kind: str = "NWL",
    test: float = 0.2,
    dev: float = 0.2,
    ratio_kept: float = 1.0,
    seed: int = 10,
) -> DataFrame:
    """(label, pmid, target, split) of every label from one pass over the articles."""
    split = lambda articles: sampling.split_rows(articles, test, dev, seed)
    rows = labels.relabel_dataset(golden, weak, label_scope, members, kind, split)
    if kind == "NWL" and ratio_kept < 1:
        rows = sampling.undersample_negatives(rows, ratio_kept, seed)
    return rows


def select_noisy_labels(
    stats: DataFrame,
    records: DataFrame,
    metric: str,
    low: float = 0.4,
    high: float = 0.6,
    min_errors: int = 50,
    excluded_category: str = "V",
) -> DataFrame:
    """Labels worth relabelling: with a tree position, outside one category, noisy enough."""
    known = labels.attach_label_info(stats, records)
    placed = hierarchy.drop_category(hierarchy.drop_check_tags(known), excluded_category)
    return labels.select_by_noise(labels.noise_ratios(placed), metric, low, high, min_errors)


def training_rows(dataset: DataFrame, articles: DataFrame, label_names: DataFrame) -> DataFrame:
    """Dataset rows with text and label name, ready for the classifier; unknown targets become class 2."""
    named = stack_labels(dataset, label_names)
    return clean_input(attach_text(named, articles)).withColumn("target", remap_unknown(F.col("target")))


def train_and_score(
    dataset: DataFrame,
    articles: DataFrame,
    label_names: DataFrame,
    runs: list[dict],
    epochs: list[int],
    threshold: float = 0.5,
) -> tuple[DataFrame, DataFrame]:
    """Scored test rows and the chosen epoch of every run of a parameter grid.

    Sampling covers all runs in one job; the balanced rows are written once, and all runs learn from them in the
    same passes, as many as the longest candidate has epochs (see ``training.fit_runs``).
    """
    fitted = sampling.grid_rows(dataset.where("split <> 'test'"), runs)
    rows = training.with_run_weights(training_rows(fitted, articles, label_names))
    ready = spread(materialize(training.numbered_rows(rows), "training-rows"), "label", "pmid")
    models, choices = training.fit_runs(ready, [r["name"] for r in runs], epochs)
    test_rows = training.numbered_rows(training_rows(dataset.where("split = 'test'"), articles, label_names))
    best = {name: found["best"] for name, found in models.items()}
    return training.score_runs(test_rows, best, threshold), choices


def evaluate_scored(scored: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Report per key and label, and micro and macro F1 per key, of scored rows (target, pred)."""
    marked = scored.withColumn("gold", F.col("target"))
    counts = evaluate.confusion(marked, [*keys, "label"])
    return (
        evaluate.classification_report(counts, [*keys, "label"]),
        evaluate.micro_macro_f1(counts, keys),
    )


def apply_relabelling(
    base: DataFrame,
    scored: DataFrame,
    bases: list[str],
    models: list[str],
    thresholds: list[float] | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """The whole threshold sweep with the scores of the positive class before and after relabelling."""
    keys = keys or []
    after = evaluate.with_scores(evaluate.apply_sweep(base, scored, bases, models, thresholds, keys))
    before = evaluate.with_scores(evaluate.confusion(base, [*keys, "label"], bases))
    original = before.select(
        *keys, "label", "base", *[F.col(c).alias(f"base_{c}") for c in ("precision", "recall", "f1")]
    )
    return after.join(original, [*keys, "label", "base"])


def relabelling_gain(
    base: DataFrame, scored: DataFrame, bases: list[str], models: list[str], thresholds: list[float] | None = None
) -> DataFrame:
    """(base, model, threshold, micro_f1, macro_f1, base_micro_f1, base_macro_f1, micro_gain, macro_gain).

    F1 over all labels with the base predictions as they are and after relabelling, for every base method,
    model and threshold.
    """
    after = evaluate.micro_macro_f1(
        evaluate.apply_sweep(base, scored, bases, models, thresholds), ["base", "model", "threshold"]
    )
    before = evaluate.micro_macro_f1(evaluate.confusion(base, ["label"], bases), ["base"])
    before = before.withColumnsRenamed({"micro_f1": "base_micro_f1", "macro_f1": "base_macro_f1"})
    return (
        after.join(before, "base")
        .withColumn("micro_gain", F.col("micro_f1") - F.col("base_micro_f1"))
        .withColumn("macro_gain", F.col("macro_f1") - F.col("base_macro_f1"))
    )
