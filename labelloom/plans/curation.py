"""From thesaurus versions and articles to weakly labelled articles and use cases."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.operators import articles as art
from labelloom.operators import hierarchy, stats, versions
from labelloom.operators.scale import lookup_join, materialize


@dataclass
class FineGrainedLabels:
    """Selected labels with the factored hierarchy that decides validity."""

    labels: DataFrame
    parents: DataFrame
    label_scope: DataFrame
    members: DataFrame


def select_fine_grained_labels(now: DataFrame, old: DataFrame) -> FineGrainedLabels:
    """Single-concept leaves of ``now`` that existed in ``old`` and have a parent."""
    existing = versions.existing_in(now, old)
    leaves = hierarchy.leaves(now).select("descriptor_ui")
    fine = existing.where(F.size("concepts") == 1).join(leaves, "descriptor_ui", "left_semi")
    parents = hierarchy.label_parents(now).join(
        fine.select(F.col("descriptor_ui").alias("label")), "label", "left_semi"
    )
    selected = fine.join(parents.select(F.col("label").alias("descriptor_ui")), "descriptor_ui", "left_semi")
    label_scope, scope_parents = hierarchy.label_scopes(parents)
    members = hierarchy.scope_members(scope_parents, hierarchy.ancestors(now))
    return FineGrainedLabels(selected, parents, label_scope, members)


def fine_grained_counts(now: DataFrame, old: DataFrame) -> DataFrame:
    """One row with the number of labels after each selection step."""
    existing = versions.existing_in(now, old).select("descriptor_ui", F.size("concepts").alias("_n"))
    leaf = hierarchy.leaves(now).select("descriptor_ui", F.lit(True).alias("_leaf"))
    single, is_leaf = F.col("_n") == 1, F.coalesce("_leaf", F.lit(False))
    counted = existing.join(leaf, "descriptor_ui", "left").agg(
        F.count("*").alias("existing"),
        F.count_if(single).alias("single_concept"),
        F.count_if(is_leaf).alias("leaf"),
        F.count_if(single & is_leaf).alias("fine_grained"),
    )
    return counted.withColumn("all_labels", now.agg(F.count("*")).scalar())


def harvest_weak_labelled_articles(
    articles: DataFrame,
    labels: DataFrame,
    occurrence: DataFrame,
    crosswalk: DataFrame,
    source: str,
    start: int | None,
    end: int | None,
    search_labels: DataFrame | None = None,
    closure: DataFrame | None = None,
) -> DataFrame:
    """Articles of the period with ``golden_in_scope`` and ``weak`` label arrays.

    ``labels`` is (label, concept_ui). Labels fold into sets per article, bounded by the selected labels, on
    either side of one shuffle by article; articles and occurrences that are bucketed by ``pmid`` need none.
    """
    found = art.search_articles(articles, search_labels, start, end, closure)
    # Written first: Spark broadcasts vocabularies whose size it knows, and the articles stay where they are.
    cuis = materialize(art.label_cui(labels, crosswalk, source).select("label", "cui"), "label-cuis")
    chosen = materialize(labels.select("label").distinct(), "chosen-labels")
    in_scope = lookup_join(art.golden_pairs(found), chosen, "label", "left_semi")
    sets = {"golden_in_scope": in_scope, "weak": art.weak_rows(occurrence, cuis)}
    for name, pairs in sets.items():
        found = found.join(pairs.groupBy("pmid").agg(F.array_sort(F.collect_set("label")).alias(name)), "pmid", "left")
    return found.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in sets})


def diff_versions(
    old: DataFrame, new: DataFrame, now: DataFrame, scrs: DataFrame, exceptions: DataFrame | None = None
) -> DataFrame:
    """New labels with their previous concept host, relation and supplementary record."""
    added = versions.new_descriptors(old, new, now)
    hosts = versions.previous_concept_host(added, old)
    scr = versions.previous_scr(added, scrs, exceptions)
    kept = F.col("host_ui").isNull()
    return (
        added.select("descriptor_ui", "descriptor_name")
        .join(hosts, "descriptor_ui")
        .join(scr, "descriptor_ui")
        .withColumns({c: F.when(kept, F.col(c)) for c in ("scr_ui", "found_by")})
    )


def describe_introductions(added: DataFrame, hosts: DataFrame, now: DataFrame) -> DataFrame:
    """Use cases: one row per new label with its origin, hosts and position in the hierarchy.

    ``hosts`` are the rows of ``versions.provenance_hosts`` for the labels ``added``. The labels below the
    hosts and below the new label are counted and listed. The lists below the hosts come last, when the rows
    have everything else (see ``versions.with_extended_hosts``).
    """
    types = versions.provenance_codes(versions.provenance_types(hosts, now))
    relations = versions.host_relations(hosts, now)
    host_lists = hosts.where("host_name IS NOT NULL").groupBy("descriptor_ui").agg(
        F.array_join(F.array_sort(F.collect_list("host_name")), "~").alias("hosts"),
        F.array_join(F.array_sort(F.collect_list("host_ui")), "~").alias("host_uis"),
    )
    label_scope, members, sizes = versions.host_members(hosts, now)
    extended = label_scope.withColumnRenamed("label", "descriptor_ui").join(sizes.drop("slices"), "scope")
    parents = hierarchy.label_parents(now).groupBy(F.col("label").alias("descriptor_ui")).agg(
        F.count("*").alias("n_parents"), F.array_join(F.array_sort(F.collect_set("parent")), "~").alias("parents")
    )
    mine = hierarchy.descendants_of(now, added.select(F.col("descriptor_ui").alias("head")))
    below = mine.groupBy(F.col("head").alias("descriptor_ui")).agg(
        F.count("*").alias("n_descendants"),
        F.array_join(F.array_sort(F.collect_set("member")), "~").alias("descendants"),
    )
    zero = F.lit(0).cast("long")
    facts = added.select(
        "descriptor_ui",
        "descriptor_name",
        F.size("concepts").cast("long").alias("n_concepts"),
        F.array_join(F.array_distinct(F.transform("tree_numbers", lambda t: F.left(t, F.lit(1)))), "~").alias("categories"),
        "public_note",
        F.array_join(F.transform("previous_indexing", lambda e: e["name"]), "~").alias("previous_indexing_text"),
        "scope_note",
    )
    cases = facts
    for part in (types, host_lists, extended, relations, parents, below):
        cases = cases.join(part, "descriptor_ui", "left")
    counts = ("n_hosts", "n_extended_hosts", "n_multi", "n_parents", "n_descendants")
    cases = cases.withColumns({c: F.coalesce(F.col(c), zero) for c in counts})
    return versions.with_extended_hosts(cases, members, sizes).drop("scope")


def select_use_cases(
    cases: DataFrame,
    hosts: DataFrame,
    now: DataFrame,
    annotated: DataFrame,
    occurrence: DataFrame,
    label_cuis: DataFrame,
    old_year: int,
    new_year: int,
    now_year: int,
    first_year: int,
    upper: int,
    weak_threshold: int,
) -> DataFrame:
    """Use cases with article counts and the selection rule they fail, or OK.

    ``annotated`` is (pmid, label, date_completed) of the golden labels of articles with an abstract.
    Training articles are those of the hosts in the years up to ``old_year``, golden test articles those
    of the label itself in the year after ``new_year``. ``annotated`` is read once: an article carries a bit per
    period, and the articles of all hosts and labels are counted per period together.
    """
    periods = {
        "test_gold": (new_year, new_year + 1),
        "train": (old_year - 1, old_year),
        "train_gold": (first_year, old_year),
        "test": (new_year, now_year),
    }
    bit = {name: 1 << i for i, name in enumerate(periods)}
    tags = [F.when(art.in_period(*periods[name]), F.lit(bit[name])).otherwise(F.lit(0)) for name in periods]
    tagged = annotated.withColumn("periods", reduce(Column.bitwiseOR, [F.coalesce(t, F.lit(0)) for t in tags])).where("periods <> 0")

    label_scope, scope_hosts, branches = versions.extended_hosts(hosts, now)
    own = cases.select(F.col("descriptor_ui").alias("label"), F.concat(F.lit("own|"), "descriptor_ui").alias("scope"))
    own = materialize(own, "own-scopes")
    own_branches = hierarchy.branches_of(now, own.select(F.col("label").alias("head"))).toDF("parent", "member")
    scope = F.concat(F.lit("hosts|"), "scope").alias("scope")
    label_scope = label_scope.select("label", scope)
    all_hosts = scope_hosts.select(scope, "parent").unionByName(own.select("scope", F.col("label").alias("parent")))
    pairs = materialize(art.periods_by_host(tagged, branches.unionByName(own_branches).distinct()), "articles-of-hosts")
    counts = materialize(art.period_counts_of_scopes(pairs, all_hosts, bit), "counts-of-scopes")
    of_label = own.join(counts, "scope").select(F.col("label").alias("descriptor_ui"), "test_gold", "train_gold")
    of_hosts = label_scope.join(counts, "scope").select(F.col("label").alias("descriptor_ui"), "train", "test")
    weak = art.weak_counts_by_hosts(
        pairs.where(F.col("periods").bitwiseAND(bit["train"]) != 0), label_scope, all_hosts, occurrence,
        label_cuis.join(own.select("label"), "label", "left_semi"),
    ).toDF("descriptor_ui", "cui", "train_weak")
    counted = cases
    for part in (of_label, of_hosts, weak):
        counted = counted.join(part, "descriptor_ui", "left")
    zero = F.lit(0).cast("long")
    counted = counted.withColumns({c: F.coalesce(F.col(c), zero) for c in periods})
    return versions.restriction_level(counted, upper, weak_threshold)


def build_retro_dataset(
    articles: DataFrame,
    golden: DataFrame,
    use_cases: DataFrame,
    hosts: DataFrame,
    now: DataFrame,
    occurrence: DataFrame,
    label_cuis: DataFrame,
    start: int,
    end: int,
    with_weak: bool = True,
) -> DataFrame:
    """Newest revision of each article of the use cases' hosts in a period, as (pmid, label, gold, weak).

    ``articles`` has one row per revision, numbered by row_id; ``golden`` is (row_id, label). Labels are
    the leaf use cases; an article without any of them has one row with a null label. ``golden`` is read once: its
    rows take the roles of their label, searched or a use case or both, to the revisions of the period.
    """
    leaf_cases = hierarchy.keep_leaves(use_cases.select("descriptor_ui"), now)
    labels = materialize(leaf_cases.select(F.col("descriptor_ui").alias("label")), "leaf-labels")
    of_labels = hosts.join(labels.withColumnRenamed("label", "descriptor_ui"), "descriptor_ui", "left_semi")
    host_uis = of_labels.where("host_ui IS NOT NULL").select(F.col("host_ui").alias("label")).distinct()
    wanted = hierarchy.branches_of(now, host_uis.withColumnRenamed("label", "head")).select(F.col("member").alias("label")).distinct()
    no, yes = F.lit(False), F.lit(True)
    roles = wanted.select("label", yes.alias("_wanted"), no.alias("_case")).unionByName(labels.select("label", no.alias("_wanted"), yes.alias("_case")))
    roles = materialize(roles.groupBy("label").agg(F.bool_or("_wanted").alias("_wanted"), F.bool_or("_case").alias("_case")), "label-roles")
    marked = lookup_join(golden, roles, "label").select("row_id", F.when(F.col("_case"), F.col("label")).alias("label"), "_wanted")
    found = art.search_articles(articles, None, start, end).select("pmid", "date_revised", "row_id")
    annotated = materialize(found.join(marked, "row_id"), "annotated-revisions")
    newest = materialize(
        art.latest_revision(annotated.where("_wanted").select("pmid", "date_revised", "row_id"), "date_revised", "row_id"), "newest-revisions"
    )
    in_scope = annotated.where("label IS NOT NULL").select("row_id", "label").join(newest.select("row_id", "pmid"), "row_id")
    marks = in_scope.select("pmid", "label", F.lit(1).alias("_flag"))
    if with_weak:
        cuis = label_cuis.join(labels, "label", "left_semi")
        weak = art.weak_labels(occurrence, cuis).join(newest.select("pmid"), "pmid", "left_semi")
        marks = marks.unionByName(weak.select("pmid", "label", F.lit(2).alias("_flag")))
    marked = marks.groupBy("pmid", "label").agg(F.bit_or("_flag").alias("_flags"))
    flags = F.coalesce("_flags", F.lit(0))
    return newest.join(marked, "pmid", "left").select(
        "pmid",
        "label",
        flags.bitwiseAND(1).alias("gold"),
        (flags.bitwiseAND(2) / 2).cast("int").alias("weak"),
    )


def dataset_statistics(
    articles: DataFrame, golden: DataFrame, weak: DataFrame, labels: DataFrame, leaf_labels: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Per (year, split): article statistics, and articles per label."""
    keys = ["year", "split"]
    leaves = labels.join(leaf_labels.select("label"), "label", "left_semi").select(*keys, "label")
    return (
        stats.article_statistics(articles, golden, weak, labels, leaves, keys),
        stats.articles_per_label(golden, weak, labels, keys),
    )


def sum_up_datasets(
    articles: DataFrame, golden: DataFrame, weak: DataFrame, labels: DataFrame, leaf_labels: DataFrame
) -> DataFrame:
    """``dataset_statistics`` with sums: per (year, split), per split over all years, and overall."""
    keys = ["year", "split"]
    leaves = labels.join(leaf_labels.select("label"), "label", "left_semi").select(*keys, "label")
    return stats.sum_up_statistics(articles, golden, weak, labels, leaves, keys, [keys, ["split"], []])
