"""Splits, sampling and class balance. All draws are hashes of ids, so reruns give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.functions.numeric import digits_of, draw, draw_bits, draw_digits, drawn_within, made_once, ratio
from labelloom.operators.scale import lookup_join, materialize, number_rows

# Standard deviations of the number of draws below a bound that the range with the last draw to keep reaches to.
DEVIATIONS = 6.0


def split_rows(rows: DataFrame, test: float = 0.2, dev: float = 0.2, seed: int = 10) -> DataFrame:
    """Rows plus ``split`` by article: test, dev or train. ``test = 1`` puts everything into test."""
    if test == 1:
        return rows.withColumn("split", F.lit("test"))
    r = draw(F.lit(f"{seed}|"), F.col("pmid"))
    split = F.when(r <= F.lit(test), "test").when(r <= F.lit(test + dev), "dev").otherwise("train")
    return rows.withColumn("split", split)


def undersample_negatives(rows: DataFrame, ratio_kept: float, seed: int = 10) -> DataFrame:
    """Keep each true negative (target 0) with probability ``ratio_kept`` and every other row."""
    drawn = drawn_within(ratio_kept, F.lit(f"u{seed}|"), F.col("label"), F.lit("|"), F.col("pmid"))
    return rows.where((F.col("target") != 0) | drawn)


def target_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, negatives, positives): rows of either known target per group."""
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("target") == 0).alias("negatives"), F.count_if(F.col("target") == 1).alias("positives")
    )


def balance_negatives(
    rows: DataFrame, per_positive: int | Column | None, seed: int | Column = 0, keys: list[str] | None = None
) -> DataFrame:
    """All positives and at most ``per_positive`` times as many random negatives per label and split.

    Rows of unknown target (neither 0 nor 1) stay.
    A group without positives keeps no negatives. The number to keep is exact for any group size.
    ``per_positive`` and ``seed`` may be columns that are part of ``keys``; a negative ratio keeps all.

    Counts give each group its limit. Groups that keep all or no negatives need no draws. In the others the last
    draw to keep lies near the limit's share of all draws: rows before that range are written as they
    are, and only those in it are ranked.
    """
    if per_positive is None:
        return rows
    keys = keys or ["label", "split"]
    return _balanced(rows, target_counts(rows, keys), keys, keys, per_positive, seed)


def _balanced(
    rows: DataFrame, counts: DataFrame, on: list[str], keys: list[str], per_positive: int | Column, seed: int | Column
) -> DataFrame:
    """Balanced ``rows`` of the groups in ``counts`` (keys, negatives, positives), which they meet on the columns ``on``.

    Keys besides ``on`` come from ``counts``: a row is copied for each of its groups.
    """
    per_positive = per_positive if isinstance(per_positive, Column) else F.lit(per_positive)
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    columns = [*rows.columns, *[k for k in keys if k not in on]]
    negative = F.coalesce(F.col("target") == 0, F.lit(False))
    limit = F.when(per_positive < 0, F.col("negatives")).otherwise(F.col("positives") * per_positive).cast("long")
    groups = materialize(counts.select(*keys, "negatives", limit.alias("_limit")), "group-limits")
    whole = lookup_join(rows, groups, on).where(~negative | (F.col("_limit") >= F.col("negatives"))).select(*columns)
    draws = draw_digits(F.lit("b"), seed, F.lit("|"), F.col("label"), F.lit("|"), F.col("pmid"))
    found = _first_draws(rows.where(negative), groups.where("_limit > 0 AND _limit < negatives"), on, keys, draws, columns)
    return reduce(DataFrame.unionByName, found, whole)


def _first_draws(
    rows: DataFrame, groups: DataFrame, on: list[str], keys: list[str], draws: Column, columns: list[str]
) -> list[DataFrame]:
    """The first ``_limit`` of the ``negatives`` rows of each group by draw and pmid, in parts.

    The range of draws that should hold the last one is DEVIATIONS wide on either side. Repeated rows share a draw and
    may put it elsewhere: the counts show that, and such groups are taken again with a wider range.
    """
    n, parts, deviations = F.col("negatives"), [], DEVIATIONS
    share = F.col("_limit") / n
    while not groups.isEmpty():
        wide = F.lit(deviations) * F.sqrt(F.col("_limit") * (1 - share) + 1) / n
        low, high = (digits_of(F.floor((share + sign * wide) * F.lit(1 << 32))) for sign in (-1, 1))
        ranged = materialize(groups.select(*keys, low.alias("_low"), high.alias("_high")), "draw-ranges")
        drawn = lookup_join(rows, ranged, on).select(*columns, "_low", "_high", made_once(draws).alias("_draw"))
        # Draws before the range are not needed again.
        at_range = F.when(F.col("_draw") >= F.col("_low"), F.col("_draw")).alias("_draw")
        found = materialize(drawn.where("_draw <= _high").select(*columns, at_range), "first-draws")
        seen = found.groupBy(*keys).agg(F.count_if(F.col("_draw").isNull()).alias("_before"), F.count("_draw").alias("_within"))
        zero = F.lit(0).cast("long")
        before, within = F.coalesce("_before", zero), F.coalesce("_within", zero)
        left = F.when(F.col("_limit").between(before, before + within), F.col("_limit") - before)
        placed = materialize(groups.join(seen, keys, "left").select(*keys, "negatives", "_limit", left.alias("_left")), "draws-left")
        groups = placed.where("_left IS NULL").drop("_left")
        met = lookup_join(found, placed.where("_left IS NOT NULL").select(*keys, "_left"), keys)
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_draw", "pmid"))
        ranked = met.where("_draw IS NOT NULL").withColumn("_rank", rank).where("_rank <= _left")
        parts += [x.select(*columns) for x in (met.where("_draw IS NULL"), ranked)]
        deviations *= 16
    return parts


def runs_per_label(labels: DataFrame, runs: list[dict]) -> DataFrame:
    """(label, run, seed, per_positive): the runs whose rows a label's rows are part of.

    A run has name, seed, per_positive (None keeps all negatives) and labels (None for all). A run none
    of whose labels occurs uses all labels.
    """
    table = F.array(
        *[
            F.struct(
                F.lit(r["name"]).alias("run"),
                F.lit(r["seed"]).cast("int").alias("seed"),
                F.lit(-1 if r["per_positive"] is None else r["per_positive"]).alias("per_positive"),
                (F.array(*[F.lit(x) for x in r["labels"]]) if r.get("labels") else F.lit(None))
                .cast("array<string>")
                .alias("focus"),
            )
            for r in runs
        ]
    )
    every = labels.select("label").distinct().select("label", F.inline(table))
    in_focus = F.coalesce(F.array_contains("focus", F.col("label")), F.lit(False))
    found = F.bool_or(in_focus).over(Window.partitionBy("run"))
    return every.withColumn("_found", found).where(~F.col("_found") | in_focus).drop("focus", "_found")


def grid_rows(rows: DataFrame, runs: list[dict], keys: list[str] | None = None) -> DataFrame:
    """Balanced rows of every run of a parameter grid, with the run's name in column ``run``.

    Runs are as in ``runs_per_label``; a row is copied only for the runs that its label is part of, and rows
    are counted before they are copied.
    """
    keys = keys or ["label", "split"]
    counts = materialize(target_counts(rows, keys), "target-counts")
    of_label = materialize(runs_per_label(counts, runs), "runs-per-label")
    of_run = ["run", "seed", "per_positive"]
    return _balanced(rows, counts.join(of_label, "label"), keys, [*of_run, *keys], F.col("per_positive"), F.col("seed"))


def chunk_labels(labels: DataFrame, size: int) -> DataFrame:
    """(label, grp): consecutive groups of ``size`` labels in label order."""
    numbered = number_rows(labels.select("label").distinct(), "label")
    return numbered.select("label", F.floor(F.col("position") / size).cast("int").alias("grp"))


def shuffle_rows(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Random order, for writing to a trainer."""
    return rows.orderBy(draw_bits(F.lit(f"s{seed}|"), F.col("label"), F.lit("|"), F.col("pmid")), "label", "pmid")


def focus_labels(rows: DataFrame, focus: DataFrame) -> DataFrame:
    """Rows of the focus labels that occur; all rows when none of them does."""
    wanted = focus.select("label").distinct().withColumn("_hit", F.lit(True))
    marked = lookup_join(rows, wanted, "label", "left")
    # One row tells whether any occurs.
    hits = lookup_join(rows.select("label"), wanted, "label", "left_semi").limit(1).agg(F.count("*")).scalar()
    return marked.where(F.col("_hit") | (hits == 0)).drop("_hit")


def label_sums(rows: DataFrame) -> DataFrame:
    """Per label: size of its dataset and number of positives."""
    return rows.groupBy("label").agg(F.count("*").alias("n_rows"), F.count_if(F.col("target") == 1).alias("n_positive"))


def class_balance(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """class_freq (positives), train_num (rows) and pos_weight = negatives per positive.

    Rows of unknown target (neither 0 nor 1) do not count.
    """
    keys = ["label"] if keys is None else keys
    counts = rows.groupBy(*keys).agg(
        F.count_if(F.col("target") == 1).alias("class_freq"), F.count_if(F.col("target").isin(0, 1)).alias("train_num")
    )
    return counts.withColumn("pos_weight", ratio(F.col("train_num") - F.col("class_freq"), F.col("class_freq")))


def class_weights(balance: DataFrame, mode: str = "inv", beta: float = 0.9, by_max: bool = False) -> DataFrame:
    """Class balance plus ``weight``: inverse frequency, its root, or by effective number of samples."""
    freq, total = F.col("class_freq").cast("double"), F.col("train_num").cast("double")
    positive = F.nullif(freq, F.lit(0.0))
    weights = {
        "inv": total / positive,
        "sqrt_inv": F.sqrt(total / positive),
        "CB": F.lit(1 - beta) / (1 - F.pow(F.lit(beta), positive)),
    }
    weighted = balance.withColumn("weight", weights[mode])
    if by_max:
        largest = weighted.agg(F.max("weight")).scalar()
        weighted = weighted.withColumn("weight", F.col("weight") / largest)
    return weighted


def best_epoch(metrics: DataFrame) -> DataFrame:
    """(run, best, previous): epoch with the lowest validation loss and the one before it.

    The earliest of equal losses wins; the first epoch is its own predecessor.
    """
    best = metrics.groupBy("run").agg(F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best"))
    earlier = metrics.select("run", F.col("epoch").alias("_epoch"))
    return (
        best.join(earlier, "run")
        .groupBy("run", "best")
        .agg(F.max(F.when(F.col("_epoch") < F.col("best"), F.col("_epoch"))).alias("_previous"))
        .select("run", "best", F.coalesce("_previous", "best").alias("previous"))
    )
