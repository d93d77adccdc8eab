"""Statistics of yearly datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.operators.scale import lookup_join


def article_statistics(
    articles: DataFrame, golden: DataFrame, weak: DataFrame, labels: DataFrame, leaves: DataFrame, keys: list[str]
) -> DataFrame:
    """One row per dataset (``keys``): article and label counts.

    ``articles`` (keys, pmid) holds one row per record, so repeated ids show as duplicates; ``golden``
    and ``weak`` are (keys, pmid, label); ``labels`` and ``leaves`` are (keys, label) for the labels in
    scope and those of them that are leaves.
    """
    return sum_up_statistics(articles, golden, weak, labels, leaves, keys, [keys]).drop("level")


def sum_up_statistics(
    articles: DataFrame, golden: DataFrame, weak: DataFrame, labels: DataFrame, leaves: DataFrame, keys: list[str], levels: list[list[str]]
) -> DataFrame:
    """(level, keys, counts): ``article_statistics`` per dataset and summed up over all datasets of each level.

    A level is a list of the keys that it keeps, its name those keys joined by ``,``; the other keys are null. Sums
    count an article once per dataset that holds it, and a label once. Records, golden and weak labels meet in
    one shuffle by dataset and article, where the numbers of an article's first and last label tell whether it has one
    or several: no task holds pairs. All levels come from grouping sets over one row per article.
    """
    none, one, unnumbered = F.lit(0), F.lit(1), F.lit(None).cast("int")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("label"))
    numbered = labels.select(*keys, "label").distinct().withColumn("_number", place)
    in_scope = lookup_join(golden, numbered, [*keys, "label"])
    marks = [
        articles.select(*keys, "pmid", unnumbered.alias("_number"), one.alias("_record"), none.alias("_weak")),
        in_scope.select(*keys, "pmid", "_number", none.alias("_record"), none.alias("_weak")),
        weak.select(*keys, "pmid", unnumbered.alias("_number"), none.alias("_record"), one.alias("_weak")),
    ]
    per_article = reduce(DataFrame.unionByName, marks).groupBy(*keys, "pmid").agg(
        F.sum("_record").alias("_n"), F.max("_weak").alias("_weak"), F.min("_number").alias("_first"), F.max("_number").alias("_last")
    )
    sets = [[F.col(k) for k in level] for level in levels]
    counts = per_article.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("_id"),
        F.sum("_n").alias("n_articles"),
        F.count_if(F.col("_n") > 1).alias("n_duplicated_ids"),
        F.count_if(F.col("_first").isNotNull()).alias("n_labelled"),
        F.count_if(F.col("_first") < F.col("_last")).alias("n_multi_labelled"),
        F.count_if(F.col("_weak") > 0).alias("n_weak_labelled"),
    )
    listed = labels.select(*keys, "label", none.alias("_leaf")).unionByName(leaves.select(*keys, "label", one.alias("_leaf")))
    listed = listed.groupBy(*keys, "label").agg(F.max("_leaf").alias("_leaf"), F.min("_leaf").alias("_only"))
    vocabulary = listed.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("_id"),
        F.count_distinct(F.when(F.col("_only") == 0, F.col("label"))).alias("n_labels"),
        F.count_distinct(F.when(F.col("_leaf") == 1, F.col("label"))).alias("n_leaves"),
    )
    same = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ["_id", *keys]])
    stats = counts.where("n_articles > 0").alias("a").join(vocabulary.alias("b"), same, "left")
    # A bit of the grouping id is set for each key that is summed over, the last key's bit being the lowest.
    names = {sum(1 << i for i, k in enumerate(reversed(keys)) if k not in level): ",".join(k for k in keys if k in level) for level in levels}
    level = F.coalesce(*[F.when(F.col("a._id") == number, F.lit(name)) for number, name in names.items()])
    figures = [*counts.columns[len(keys) + 1 :], "n_labels", "n_leaves"]
    return stats.select(level.alias("level"), *[F.col(f"a.{k}").alias(k) for k in keys], *[F.coalesce(F.col(c), none).cast("long").alias(c) for c in figures])


def articles_per_label(golden: DataFrame, weak: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, n_golden, n_weak): articles of each label in scope."""
    marked = golden.select(*keys, "pmid", "label", F.lit(1).alias("_flag")).unionByName(
        weak.select(*keys, "pmid", "label", F.lit(2).alias("_flag"))
    )
    counts = (
        marked.groupBy(*keys, "label", "pmid")
        .agg(F.bit_or("_flag").alias("_flags"))
        .groupBy(*keys, "label")
        .agg(
            F.count_if(F.col("_flags").bitwiseAND(1) != 0).alias("n_golden"),
            F.count_if(F.col("_flags").bitwiseAND(2) != 0).alias("n_weak"),
        )
    )
    zero = F.lit(0).cast("long")
    return labels.join(counts, [*keys, "label"], "left").select(
        *keys, "label", F.coalesce("n_golden", zero).alias("n_golden"), F.coalesce("n_weak", zero).alias("n_weak")
    )


def articles_with_many_labels(golden: DataFrame, labels: DataFrame) -> DataFrame:
    """(pmid, n_labels) of articles with more than one label in scope."""
    in_scope = lookup_join(golden, labels.select("label"), "label", "left_semi").select("pmid", "label").distinct()
    return in_scope.groupBy("pmid").agg(F.count("*").alias("n_labels")).where("n_labels > 1")


def update_counts(use_cases: DataFrame, counts: DataFrame, column: str) -> DataFrame:
    """Use cases with ``column`` replaced by the count of their label; labels without one are dropped."""
    fresh = counts.select("descriptor_ui", F.col("n").alias("_n"))
    columns = [F.col("_n").alias(c) if c == column else F.col(c) for c in use_cases.columns]
    return use_cases.join(fresh, "descriptor_ui").select(*columns)


def duplicate_report(occurrences: DataFrame) -> DataFrame:
    """(pmid, file, times_in_file, times_found) for each id and source file.

    One row per file, so an id repeated in many files needs no list built in one task.
    """
    per_file = occurrences.groupBy("pmid", "file").agg(F.count("*").alias("times_in_file"))
    totals = per_file.groupBy("pmid").agg(F.sum("times_in_file").alias("times_found"))
    return per_file.join(totals, "pmid").select("pmid", "file", "times_in_file", "times_found")


def label_scope_info(new_labels: DataFrame, hosts: DataFrame, members: DataFrame) -> DataFrame:
    """(year, role, label): new labels, their former hosts and the hosts' descendants, one row each.

    Inputs are (year, label), (year, host) and (host, member) with each host among its own members.
    """
    host_rows = hosts.select("year", "host").distinct()
    below = host_rows.join(members.where("host <> member"), "host").select("year", F.col("member").alias("label"))
    return (
        new_labels.select("year", F.lit("new label").alias("role"), "label")
        .unionByName(host_rows.select("year", F.lit("previous host").alias("role"), F.col("host").alias("label")))
        .unionByName(below.select("year", F.lit("host descendant").alias("role"), "label"))
        .distinct()
    )
