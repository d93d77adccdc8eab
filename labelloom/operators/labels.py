"""Golden labels against weak labels.

Inputs are long tables: ``golden`` and ``weak`` (pmid, label), repeated rows allowed; ``label_scope``
(label, scope) and ``members`` (scope, member) from the hierarchy. An article is valid for a label when
one of its golden labels is a member of the label's scope.

The labels of a scope are numbered, and an article's labels in a scope are bits of 64-bit words: rows of fixed
width that fold with bit_or before and after one shuffle. A word goes back to labels by a join with the
numbered labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.functions.numeric import draw, drawn_within, ratio
from labelloom.operators.scale import lookup_join, materialize

WORD_BITS = 64
WORD = ["scope", "word"]


def numbered_labels(label_scope: DataFrame) -> DataFrame:
    """(label, scope, word, mask): each label's bit among the labels of its scope, in label order."""
    place = F.row_number().over(Window.partitionBy("scope").orderBy("label")) - 1
    rows = label_scope.select("label", "scope").distinct().withColumn("_place", place)
    word, bit = F.floor(F.col("_place") / WORD_BITS).cast("int"), F.col("_place") % WORD_BITS
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return rows.select("label", "scope", word.alias("word"), mask.alias("mask"))


def article_scopes(golden: DataFrame, weak: DataFrame, numbered: DataFrame, members: DataFrame) -> DataFrame:
    """(pmid, scope, word, valid, golden, weak): an article's labels within each scope it touches, as bits.

    All comparisons of golden and weak labels start here, after a single shuffle by article, scope and word.
    A scope of more than 64 labels has several words; a golden member makes the article valid in each.
    """
    none = F.lit(0).cast("long")
    own = numbered.select("label", *WORD, "mask", F.lit(False).alias("member"))
    words = numbered.select(*WORD).distinct()
    member = members.join(words, "scope").select(F.col("member").alias("label"), *WORD, none.alias("mask"), F.lit(True).alias("member"))
    roles = own.unionByName(member).groupBy("label", *WORD).agg(F.bit_or("mask").alias("mask"), F.bool_or("member").alias("member"))
    marked = golden.select("pmid", "label", F.lit(True).alias("gold")).unionByName(
        weak.select("pmid", "label", F.lit(False).alias("gold"))
    )
    rows = lookup_join(marked, roles, "label").where("gold OR mask <> 0")
    return rows.groupBy("pmid", *WORD).agg(
        F.bool_or(F.col("gold") & F.col("member")).alias("valid"),
        F.bit_or(F.when(F.col("gold"), F.col("mask")).otherwise(none)).alias("golden"),
        F.bit_or(F.when(F.col("gold"), none).otherwise(F.col("mask"))).alias("weak"),
    )


def has(bits: str | Column, mask: str | Column = "mask") -> Column:
    """Whether a word has any bit of the mask."""
    bits, mask = (F.col(c) if isinstance(c, str) else c for c in (bits, mask))
    return bits.bitwiseAND(mask) != 0


def assigned(scopes: DataFrame) -> DataFrame:
    """``scopes`` in which weak labels of invalid articles count as not assigned."""
    return scopes.withColumn("weak", F.when(F.col("valid"), F.col("weak")).otherwise(F.lit(0).cast("long")))


def judged_pairs(scopes: DataFrame, numbered: DataFrame) -> DataFrame:
    """(pmid, label, scope, gold, weak, valid) for every pair that is golden or weak in a valid article."""
    marked = lookup_join(assigned(scopes).where("golden <> 0 OR weak <> 0"), numbered, WORD)
    pairs = marked.where(has(F.col("golden").bitwiseOR(F.col("weak"))))
    return pairs.select("pmid", "label", "scope", has("golden").alias("gold"), has("weak").alias("weak"), "valid")


def valid_scopes(golden: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct (pmid, scope) where a golden label of the article is a member of the scope."""
    wanted = members.withColumnRenamed("member", "label")
    return lookup_join(golden.select("pmid", "label"), wanted, "label").select("pmid", "scope").distinct()


def valid_labels(golden: DataFrame, label_scope: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct (pmid, label) of the labels valid for each article."""
    return lookup_join(valid_scopes(golden, members), label_scope, "scope").select("pmid", "label")


def filter_weak(golden: DataFrame, weak: DataFrame, label_scope: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct weak pairs of the articles valid for the label."""
    numbered = numbered_labels(label_scope)
    return judged_pairs(article_scopes(golden, weak, numbered, members), numbered).where("weak").select("pmid", "label")


def compare_labels(golden: DataFrame, weak: DataFrame, label_scope: DataFrame, members: DataFrame) -> DataFrame:
    """(pmid, label, outcome) with outcome TP, FP or FN."""
    numbered = numbered_labels(label_scope)
    pairs = judged_pairs(article_scopes(golden, weak, numbered, members), numbered)
    outcome = F.when(F.col("gold") & F.col("weak"), "TP").when(F.col("weak"), "FP").otherwise("FN")
    return pairs.select("pmid", "label", outcome.alias("outcome"))


def label_frequencies(golden: DataFrame, weak: DataFrame, label_scope: DataFrame, members: DataFrame) -> DataFrame:
    """label, total_weak, fp, fn, total_gold, tn for every label.

    True negatives are the valid articles of the label minus those of them that are golden or weak, so
    no article x label table is built. The valid articles of a scope are counted in the same pass, as
    rows without a label.
    """
    numbered = numbered_labels(label_scope)
    scopes = assigned(article_scopes(golden, weak, numbered, members))
    whole = numbered.select(*WORD).distinct().select(F.lit(None).cast("string").alias("label"), *WORD, F.lit(None).cast("long").alias("mask"))
    gold, weak_now, of_label = has("golden"), has("weak"), F.col("label").isNotNull()
    rows = lookup_join(scopes, numbered.unionByName(whole), WORD).where((~of_label & F.col("valid")) | gold | weak_now)
    counts = rows.groupBy(*WORD, "label").agg(
        F.count_if(weak_now).alias("total_weak"),
        F.count_if(weak_now & ~gold).alias("fp"),
        F.count_if(gold & ~weak_now).alias("fn"),
        F.count_if(gold).alias("total_gold"),
        F.count_if(F.col("valid")).alias("_valid"),
    )
    # one row per label and scope from here on
    per_word = counts.where(~of_label).select(*WORD, "_valid")
    per_label = counts.where(of_label).withColumnRenamed("_valid", "_marked")
    zero = F.lit(0).cast("long")
    return (
        numbered.join(per_word, WORD, "left")
        .join(per_label, [*WORD, "label"], "left")
        .select(
            "label",
            *[F.coalesce(F.col(c), zero).alias(c) for c in ("total_weak", "fp", "fn", "total_gold")],
            (F.coalesce(F.col("_valid"), zero) - F.coalesce(F.col("_marked"), zero)).alias("tn"),
        )
    )


def noise_ratios(stats: DataFrame) -> DataFrame:
    """Error ratios, precision, recall and F1 of the weak labels; null where undefined."""
    return (
        stats.withColumn("fp_ratio", ratio(F.col("fp"), F.col("total_weak")))
        .withColumn("precision", 1 - F.col("fp_ratio"))
        .withColumn("fn_ratio", ratio(F.col("fn"), F.col("total_gold")))
        .withColumn("recall", 1 - F.col("fn_ratio"))
        .withColumn("precise", F.bround("precision"))
        .withColumn("low_recall", 1 - F.bround("recall"))
        .withColumn("tp", F.col("total_weak") - F.col("fp"))
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )


def select_by_noise(
    ratios: DataFrame, metric: str, low: float = 0.4, high: float = 0.6, min_errors: int = 50
) -> DataFrame:
    """Labels whose ``metric`` (precision or recall) lies in the window with enough errors."""
    errors = {"precision": "fp", "recall": "fn"}[metric]
    return ratios.where(F.col(metric).between(low, high) & (F.col(errors) >= min_errors))


def attach_label_info(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics with the label's record; statistics of unknown labels are kept."""
    info = labels.withColumnRenamed("descriptor_ui", "label")
    return stats.join(info, "label", "left")


def selection_funnel(ratios: DataFrame, threshold: int = 50, low: float = 0.4, high: float = 0.6) -> DataFrame:
    """One row of counts: labels passing each selection criterion."""
    p, r = F.col("precision").between(low, high), F.col("recall").between(low, high)
    return ratios.agg(
        F.count("*").alias("labels"),
        *[F.count_if(F.col(c) >= 1).alias(f"{c}_any") for c in ("total_weak", "total_gold", "fp", "fn")],
        *[F.count_if(F.col(c) >= threshold).alias(f"{c}_many") for c in ("total_weak", "total_gold", "fp", "fn")],
        F.count_if((F.col("fp") >= threshold) & (F.col("fn") >= threshold)).alias("fp_and_fn_many"),
        F.count_if(p).alias("precision_window"),
        F.count_if(r).alias("recall_window"),
        F.count_if(p & r).alias("both_windows"),
    )


def labels_per_document(pairs: DataFrame) -> DataFrame:
    """Histogram: how many articles carry how many distinct labels."""
    distinct = pairs.select("pmid", "label").distinct()
    per_doc = distinct.groupBy("pmid").agg(F.count("*").alias("n_labels"))
    return per_doc.groupBy("n_labels").agg(F.count("*").alias("n_docs"))


def label_combinations(pairs: DataFrame) -> DataFrame:
    """How often each set of two or more labels occurs together.

    Pairs are deduplicated first, so an article's list is bounded by the label vocabulary.
    """
    distinct = pairs.select("pmid", "label").distinct()
    per_doc = distinct.groupBy("pmid").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    return (
        per_doc.where(F.size("labels") > 1)
        .groupBy(F.array_join("labels", " ").alias("combination"))
        .agg(F.count("*").alias("n_docs"))
    )


def common_labels(first: DataFrame, second: DataFrame) -> DataFrame:
    """(pmid, labels): the sorted labels that both tables (pmid, label) give an article, where there are any."""
    both = first.select("pmid", "label").join(second.select("pmid", "label"), ["pmid", "label"], "left_semi")
    return both.groupBy("pmid").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def valid_pairs(
    golden: DataFrame,
    weak: DataFrame,
    label_scope: DataFrame,
    members: DataFrame,
    of_articles: Callable[[DataFrame], DataFrame] = lambda articles: articles,
) -> DataFrame:
    """(label, pmid, gold, weak) as 0/1 for every label valid for an article.

    Articles and labels meet last, through the label table, so the many rows are never shuffled. ``of_articles`` may
    add columns to the few rows of articles before that, or write them for several readings.
    """
    numbered = materialize(numbered_labels(label_scope), "numbered-labels")
    compared = article_scopes(golden, weak, numbered, members)
    scopes = of_articles(compared.where("valid"))
    added = [c for c in scopes.columns if c not in compared.columns]
    return lookup_join(scopes, numbered, WORD).select(
        "label", "pmid", has("golden").cast("int").alias("gold"), has("weak").cast("int").alias("weak"), *added
    )


def relabel_dataset(
    golden: DataFrame,
    weak: DataFrame,
    label_scope: DataFrame,
    members: DataFrame,
    kind: str = "NWL",
    of_articles: Callable[[DataFrame], DataFrame] = lambda articles: articles,
) -> DataFrame:
    """(label, pmid, target): the relabelling rows of every label at once, plus the columns that ``of_articles`` adds.

    NWL: valid articles without the weak label, target 1 for a golden one (false negative).
    PWL: valid articles with the weak label, target 1 for one that is not golden (false positive).
    """
    if kind == "PWL":
        numbered = numbered_labels(label_scope)
        pairs = judged_pairs(article_scopes(golden, weak, numbered, members), numbered)
        return of_articles(pairs.where("weak").select("label", "pmid", (~F.col("gold")).cast("int").alias("target")))
    if kind != "NWL":
        raise ValueError("kind must be 'NWL' or 'PWL'")
    pairs = valid_pairs(golden, weak, label_scope, members, of_articles)
    added = [c for c in pairs.columns if c not in ("label", "pmid", "gold", "weak")]
    return pairs.where("weak = 0").select("label", "pmid", F.col("gold").alias("target"), *added)


def group_documents(
    golden: DataFrame, weak: DataFrame, label_scope: DataFrame, members: DataFrame, groups: DataFrame
) -> DataFrame:
    """(grp, pmid, valid, gold, weak, fp, fn, n_weak_valid): article flags per label group.

    ``groups`` is (label, grp). One row for each article with a golden or weak label of the group, or
    valid for one; articles in no row are invalid and negative for the group.
    """
    numbered = numbered_labels(label_scope)
    scopes = assigned(article_scopes(golden, weak, numbered, members))
    in_group = numbered.join(groups, "label").groupBy(*WORD, "grp").agg(F.bit_or("mask").alias("mask"))
    rows = lookup_join(scopes, in_group, WORD)
    missed, extra = (F.col(x).bitwiseAND(F.bitwise_not(F.col(y))) for x, y in (("golden", "weak"), ("weak", "golden")))
    return rows.groupBy("grp", "pmid").agg(
        F.bool_or("valid").alias("valid"),
        F.bool_or(has("golden")).alias("gold"),
        F.bool_or(has("weak")).alias("weak"),
        F.bool_or(has(extra)).alias("fp"),
        F.bool_or(has(missed)).alias("fn"),
        F.sum(F.bit_count(F.col("weak").bitwiseAND(F.col("mask")))).alias("n_weak_valid"),
    )


def group_selection(kind: str = "NWL", ratio_kept: float = 1.0, seed: int = 10):
    """(selected, kept) conditions over ``group_documents`` rows.

    Articles whose group is wholly negative are kept with probability ``ratio_kept``; those with a
    false negative always stay.
    """
    if kind == "PWL":
        return F.col("valid") & F.col("weak"), F.lit(True)
    drawn = draw(F.lit(f"u{seed}|"), F.col("grp"), F.lit("|"), F.col("pmid"))
    return F.col("valid") & ~F.col("weak"), F.col("fn") | (drawn <= F.lit(ratio_kept))


def group_dataset(
    golden: DataFrame,
    weak: DataFrame,
    label_scope: DataFrame,
    members: DataFrame,
    groups: DataFrame,
    kind: str = "NWL",
    ratio_kept: float = 1.0,
    seed: int = 10,
) -> DataFrame:
    """(grp, pmid, valid_labels, positive, negative): the articles that a group's dataset holds.

    NWL: articles valid for any label of the group without a weak label of the group; positive are the
    golden labels (missed), negative the group's other labels. PWL: articles valid for any and with
    some weak label; positive are weak labels that are not golden, negative those that are. Lists are
    sorted and bounded by the labels of a group (``groups`` is (label, grp)). Wholly negative articles are
    kept with probability ``ratio_kept``; the rows are those that ``dataset_counters`` counts as selected.
    """
    numbered = numbered_labels(label_scope)
    scopes = assigned(article_scopes(golden, weak, numbered, members))
    entry = F.struct("label", "mask")
    words = numbered.join(groups, "label").groupBy(*WORD, "grp").agg(F.collect_list(entry).alias("labels"), F.bit_or("mask").alias("mask"))
    slot = F.row_number().over(Window.partitionBy("grp").orderBy(*WORD))
    words = materialize(words.withColumn("slot", slot), "words-of-groups")
    everyone = groups.groupBy("grp").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    of_slot = F.transform(F.array_sort(F.collect_list(F.struct("slot", "labels"))), lambda x: x["labels"])
    of_group = everyone.join(words.groupBy("grp").agg(of_slot.alias("_slots")), "grp")

    # Articles meet as bits; the labels come up for the chosen ones.
    gold, weak_now = (F.col(c).bitwiseAND(F.col("mask")) for c in ("golden", "weak"))
    part = F.struct("slot", "valid", gold.alias("golden"), weak_now.alias("weak"))
    documents = lookup_join(scopes, words.drop("labels"), WORD).groupBy("grp", "pmid").agg(
        F.collect_list(part).alias("_parts"),
        F.bool_or("valid").alias("_valid"),
        F.bool_or(gold != 0).alias("_missed"),
        F.bool_or(weak_now != 0).alias("_found"),
    )

    def among(test):
        def of_part(p):
            known = F.filter(F.element_at("_slots", p["slot"]), lambda x: test(p, x["mask"]))
            return F.transform(known, lambda x: x["label"])

        return F.array_sort(F.array_distinct(F.flatten(F.transform("_parts", of_part))))

    if kind == "PWL":
        chosen = F.col("_valid") & F.col("_found")
        positive, negative = F.array_except("_weak", "_gold"), F.array_intersect("_weak", "_gold")
    elif kind == "NWL":
        chosen = F.col("_valid") & ~F.col("_found") & (F.col("_missed") | drawn_within(ratio_kept, F.lit(f"u{seed}|"), F.col("grp"), F.lit("|"), F.col("pmid")))
        positive, negative = F.col("_gold"), F.array_except("labels", "_gold")
    else:
        raise ValueError("kind must be 'NWL' or 'PWL'")
    listed = lookup_join(documents.where(chosen), of_group, "grp").select(
        "grp", "pmid", "labels",
        among(lambda p, mask: p["valid"]).alias("valid_labels"),
        among(lambda p, mask: p["golden"].bitwiseAND(mask) != 0).alias("_gold"),
        among(lambda p, mask: p["weak"].bitwiseAND(mask) != 0).alias("_weak"),
    )
    return listed.select("grp", "pmid", "valid_labels", positive.alias("positive"), negative.alias("negative"))


def dataset_counters(
    articles: DataFrame,
    golden: DataFrame,
    weak: DataFrame,
    label_scope: DataFrame,
    members: DataFrame,
    groups: DataFrame,
    kind: str = "NWL",
    ratio_kept: float = 1.0,
    seed: int = 10,
) -> DataFrame:
    """One row of dataset statistics per label group.

    ``articles`` has one row per article; counts of articles without any mark come by subtraction.
    """
    documents = group_documents(golden, weak, label_scope, members, groups)
    all_weak = weak.select("pmid", "label").distinct().groupBy("pmid").agg(F.count("*").alias("_n_weak"))
    selected, kept = group_selection(kind, ratio_kept, seed)
    with_weak = documents.join(all_weak, "pmid", "left")
    per_group = with_weak.groupBy("grp").agg(
        F.count_if(selected & kept).alias("selected"),
        F.count_if(selected & ~kept).alias("skipped"),
        F.count_if(F.col("valid")).alias("_valid"),
        F.count_if(F.col("gold")).alias("golden_positive"),
        F.count_if(F.col("weak")).alias("weak_positive"),
        F.count_if(F.col("fp")).alias("fp_docs"),
        F.count_if(F.col("fn")).alias("fn_docs"),
        F.count_if(F.col("_n_weak") == F.col("n_weak_valid")).alias("_weak_intact"),
    )
    totals = articles.agg(F.count("*").alias("considered")).withColumn("_one", F.lit(1))
    weak_docs = all_weak.agg(F.count("*").alias("_weak_docs")).withColumn("_one", F.lit(1))
    considered = F.col("considered")
    return (
        per_group.withColumn("_one", F.lit(1))
        .join(F.broadcast(totals), "_one")
        .join(F.broadcast(weak_docs), "_one")
        .select(
            "grp",
            "considered",
            "selected",
            "skipped",
            (F.col("_weak_docs") - F.col("_weak_intact")).alias("weak_filtered"),
            (considered - F.col("_valid")).alias("invalid"),
            "golden_positive",
            (considered - F.col("golden_positive")).alias("golden_negative"),
            "weak_positive",
            (considered - F.col("weak_positive")).alias("weak_negative"),
            "fp_docs",
            "fn_docs",
        )
    )
