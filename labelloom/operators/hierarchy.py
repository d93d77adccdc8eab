"""The label hierarchy: a label has one or more dotted tree numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.functions import records
from labelloom.operators.scale import lookup_join


def tree(descriptors: DataFrame) -> DataFrame:
    """(tree_number, descriptor_ui), one row per tree position."""
    return descriptors.select(F.explode("tree_numbers").alias("tree_number"), "descriptor_ui")


def term_index(descriptors: DataFrame) -> DataFrame:
    """(term, descriptor_ui); a term of several records belongs to the smallest ui."""
    return (
        descriptors.select(F.explode("terms").alias("term"), "descriptor_ui")
        .groupBy("term")
        .agg(F.min("descriptor_ui").alias("descriptor_ui"))
    )


def label_parents(descriptors: DataFrame) -> DataFrame:
    """(label, parent): descriptors one tree position above."""
    positions = tree(descriptors)
    children = positions.select(
        F.col("descriptor_ui").alias("label"),
        records.parent_tree_number(F.col("tree_number")).alias("tree_number"),
    ).where("tree_number IS NOT NULL")
    parents = positions.withColumnRenamed("descriptor_ui", "parent")
    return lookup_join(children, parents, "tree_number").select("label", "parent").distinct()


def ancestors(descriptors: DataFrame) -> DataFrame:
    """(ancestor, descendant) closure.

    A tree number starts with each of its ancestors' numbers, so all its proper prefixes are joined by
    equality: one row per position and level instead of a comparison of every pair.
    """
    positions = tree(descriptors)
    prefixes = positions.select(
        F.col("descriptor_ui").alias("descendant"),
        F.explode(records.proper_prefixes(F.col("tree_number"))).alias("tree_number"),
    )
    holders = positions.withColumnRenamed("descriptor_ui", "ancestor")
    return lookup_join(prefixes, holders, "tree_number").select("ancestor", "descendant").distinct()


def descendants_of(descriptors: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, member): the descendants of some descriptors (column ``head``), without the closure of all others.

    The prefixes of tree numbers meet the positions of the heads alone, which Spark can broadcast.
    """
    positions = tree(descriptors)
    own = positions.join(heads.select(F.col("head").alias("descriptor_ui")), "descriptor_ui", "left_semi")
    prefixes = positions.select(
        F.col("descriptor_ui").alias("member"), F.explode(records.proper_prefixes(F.col("tree_number"))).alias("tree_number")
    )
    return lookup_join(prefixes, own.withColumnRenamed("descriptor_ui", "head"), "tree_number").select("head", "member").distinct()


def branches_of(descriptors: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, member): each head descriptor itself and all its descendants; heads may repeat."""
    heads = heads.select("head").distinct()
    return descendants_of(descriptors, heads).unionByName(heads.select("head", F.col("head").alias("member"))).distinct()


def branches(closure: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, member): each head descriptor itself and all its descendants.

    ``heads`` has one column ``head`` without duplicates.
    """
    below = closure.select(F.col("ancestor").alias("head"), F.col("descendant").alias("member"))
    return below.join(heads, "head", "left_semi").unionByName(
        heads.select("head", F.col("head").alias("member"))
    ).distinct()


def leaves(descriptors: DataFrame) -> DataFrame:
    """Descriptors none of whose tree numbers is extended by another one."""
    positions = tree(descriptors)
    extended = positions.select(
        F.explode(records.proper_prefixes(F.col("tree_number"))).alias("tree_number")
    ).distinct()
    inner = positions.join(extended, "tree_number", "left_semi").select("descriptor_ui").distinct()
    return descriptors.join(inner, "descriptor_ui", "left_anti")


def keep_leaves(labels: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Rows of ``labels`` (column descriptor_ui) whose descriptor exists and is a leaf."""
    return labels.join(leaves(descriptors).select("descriptor_ui"), "descriptor_ui", "left_semi")


def single_concept_leaves(descriptors: DataFrame) -> DataFrame:
    """Fine-grained descriptors: one concept and no descendants."""
    return leaves(descriptors).where(F.size("concepts") == 1)


def label_scopes(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, scope) and (scope, parent): siblings with the same parents share one scope.

    A label's parents, and everything below them, decide for which articles the label is valid. That
    set is the same for all siblings, so it is kept once per scope and never written out per label.
    The number of parents of a label is bounded by its tree positions.
    """
    scoped = parents.groupBy("label").agg(
        F.array_join(F.array_sort(F.collect_set("parent")), "~").alias("scope"),
        F.collect_set("parent").alias("members"),
    )
    scope_parents = (
        scoped.groupBy("scope")
        .agg(F.first("members").alias("members"))
        .select("scope", F.explode("members").alias("parent"))
    )
    return scoped.select("label", "scope"), scope_parents


def scope_members(scope_parents: DataFrame, closure: DataFrame) -> DataFrame:
    """(scope, member): the parents of a scope and all their descendants.

    This is the set of labels that make an article valid; it contains the label itself.
    """
    heads = scope_parents.select(F.col("parent").alias("head")).distinct()
    members = branches(closure, heads).withColumnRenamed("head", "parent")
    return scope_parents.join(members, "parent").select("scope", "member").distinct()


def parents_plus(descriptors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and all their descendants, factored as (label, scope) and (scope, member)."""
    label_scope, scope_parents = label_scopes(label_parents(descriptors))
    return label_scope, scope_members(scope_parents, ancestors(descriptors))


def relation_kinds(label_numbers, host_numbers):
    """Kinds of relation over all pairs of tree positions of a label and its host.

    ``anc``: the host is above the label, ``des``: below, ``unr``: neither. Both arguments are the
    tree-number arrays of one record each.
    """
    def kind(mine, other):
        return (
            F.when(F.startswith(F.concat(mine, F.lit(".")), F.concat(other, F.lit("."))), "anc")
            .when(F.startswith(F.concat(other, F.lit(".")), F.concat(mine, F.lit("."))), "des")
            .otherwise("unr")
        )

    pairs = F.flatten(F.transform(host_numbers, lambda h: F.transform(label_numbers, lambda m: kind(m, h))))
    return F.array_sort(F.array_distinct(pairs))


def is_above(upper: Column, lower: Column) -> Column:
    """Whether a position of one record is above a position of another; arguments are arrays of tree numbers."""
    return F.coalesce(F.exists(lower, lambda m: F.exists(upper, lambda h: F.startswith(m, F.concat(h, F.lit("."))))), F.lit(False))


def is_parent(upper: Column, lower: Column) -> Column:
    """Whether a position of one record is directly above a position of another."""
    return F.coalesce(F.exists(lower, lambda m: F.array_contains(upper, records.parent_tree_number(m))), F.lit(False))


def hierarchical_relations(pairs: DataFrame, descriptors: DataFrame) -> DataFrame:
    """``pairs`` (descriptor_ui, host_ui) plus ``relations``; ``und`` for a host that is gone."""
    numbers = descriptors.select("descriptor_ui", F.col("tree_numbers").alias("_mine"))
    hosts = descriptors.select(
        F.col("descriptor_ui").alias("host_ui"), F.col("tree_numbers").alias("_theirs")
    )
    return (
        pairs.join(numbers, "descriptor_ui", "left")
        .join(hosts, "host_ui", "left")
        .withColumn(
            "relations",
            F.when(F.col("_theirs").isNull(), F.array(F.lit("und"))).otherwise(
                relation_kinds(F.col("_mine"), F.col("_theirs"))
            ),
        )
        .drop("_mine", "_theirs")
    )


def lookup_labels(queries: DataFrame, descriptors: DataFrame, by: str = "ui") -> DataFrame:
    """``queries`` (query) plus the descriptor_ui it names, by ui or by term; null when unknown."""
    if by == "ui":
        index = descriptors.select(F.col("descriptor_ui").alias("query"), "descriptor_ui")
    elif by == "term":
        index = term_index(descriptors).withColumnRenamed("term", "query")
    else:
        raise ValueError("by must be 'ui' or 'term'")
    return queries.join(index, "query", "left").withColumn("exists", F.col("descriptor_ui").isNotNull())


def drop_check_tags(labels: DataFrame) -> DataFrame:
    """Drop labels without a tree position."""
    return labels.where(F.col("tree_numbers").isNotNull() & (F.size("tree_numbers") > 0))


def drop_category(labels: DataFrame, letter: str) -> DataFrame:
    """Drop labels one of whose tree numbers starts with ``letter``."""
    return labels.where(~F.array_contains(records.categories(F.col("tree_numbers")), letter))
