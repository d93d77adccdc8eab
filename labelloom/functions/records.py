"""Columns of thesaurus records (arrays of structs, tree numbers)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import StructType


def preferred_concept(concepts: Column) -> Column:
    """The concept flagged as preferred; the last one if several are."""
    return F.try_element_at(F.filter(concepts, lambda x: x["preferred"] == "Y"), F.lit(-1))


def categories(tree_numbers: Column) -> Column:
    """Distinct first letters in order of appearance."""
    return F.array_distinct(F.transform(tree_numbers, lambda x: F.left(x, F.lit(1))))


def concept_relations(concepts: Column, related: Column) -> Column:
    """``related`` array<struct<ui, relation>> -> map(ui -> relation); the first entry of a ui wins.

    A record with a single concept has no relations.
    """
    uis = F.transform(related, lambda r: r["ui"])
    first_only = F.filter(related, lambda r, i: F.array_position(uis, r["ui"]) == i + 1)
    return F.when(
        F.size(concepts) > 1,
        F.map_from_entries(F.transform(first_only, lambda r: F.struct(r["ui"], r["relation"]))),
    ).otherwise(F.create_map().cast("map<string,string>"))


def parent_tree_number(tn: Column) -> Column:
    """Tree number without its last component; null for a root."""
    return F.when(F.contains(tn, F.lit(".")), F.regexp_replace(tn, "[.][^.]*$", ""))


def parent_tree_numbers(tree_numbers: Column) -> Column:
    """Distinct parent tree numbers of a record."""
    return F.array_distinct(
        F.filter(F.transform(tree_numbers, parent_tree_number), lambda x: x.isNotNull())
    )


def proper_prefixes(tn: Column) -> Column:
    """All ancestors of a tree number: ``A.1.2`` -> ``[A, A.1]``."""
    parts = F.split(tn, "[.]")
    depth = F.size(parts)
    lengths = F.when(depth > 1, F.sequence(F.lit(1), depth - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(lengths, lambda n: F.array_join(F.slice(parts, 1, n), "."))


def provenance_strings(category: Column, counts: Column) -> Column:
    """``category.type`` for each struct(type, n) with n > 0, sorted and joined."""
    kept = F.filter(counts, lambda x: x["n"] > 0)
    return F.array_join(F.array_sort(F.transform(kept, lambda x: F.concat(category, F.lit("."), x["type"]))), "~")


def json_fields(c: Column, schema: StructType) -> Column:
    """Typed fields of a JSON object; null where absent or of another type."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})
