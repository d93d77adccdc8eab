"""Thesaurus XML: descriptor and supplementary records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelloom.functions import notes, records
from labelloom.functions.text import strip_star

# Element and attribute names of the XML files.
_CONCEPTS = """
ConceptList STRUCT<Concept: ARRAY<STRUCT<
    _PreferredConceptYN: STRING,
    ConceptUI: STRING,
    ConceptName: STRUCT<String: STRING>,
    ScopeNote: STRING,
    ConceptRelationList: STRUCT<ConceptRelation: ARRAY<STRUCT<_RelationName: STRING, Concept2UI: STRING>>>,
    TermList: STRUCT<Term: ARRAY<STRUCT<String: STRING>>>>>>
"""
DESCRIPTOR_XML = f"""
DescriptorUI STRING,
DescriptorName STRUCT<String: STRING>,
PublicMeSHNote STRING,
PreviousIndexingList STRUCT<PreviousIndexing: ARRAY<STRING>>,
TreeNumberList STRUCT<TreeNumber: ARRAY<STRING>>,
{_CONCEPTS}
"""
SCR_XML = f"""
SupplementalRecordUI STRING,
SupplementalRecordName STRUCT<String: STRING>,
HeadingMappedToList STRUCT<HeadingMappedTo: ARRAY<STRUCT<
    DescriptorReferredTo: STRUCT<DescriptorUI: STRING, DescriptorName: STRUCT<String: STRING>>,
    QualifierReferredTo: STRUCT<QualifierUI: STRING>>>>,
{_CONCEPTS}
"""


def _or_empty(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _concept_columns() -> dict[str, Column]:
    raw = F.col("ConceptList.Concept")
    terms = "array<string>"

    def concept(x: Column) -> Column:
        return F.struct(
            x["ConceptUI"].alias("ui"),
            x["ConceptName"]["String"].alias("name"),
            x["_PreferredConceptYN"].alias("preferred"),
            _or_empty(F.transform(x["TermList"]["Term"], lambda t: t["String"]), terms).alias("terms"),
        )

    related_type = "array<struct<ui:string,relation:string>>"
    related = F.flatten(
        F.transform(
            raw,
            lambda x: _or_empty(
                F.transform(
                    x["ConceptRelationList"]["ConceptRelation"],
                    lambda r: F.struct(r["Concept2UI"].alias("ui"), r["_RelationName"].alias("relation")),
                ),
                related_type,
            ),
        )
    )
    concepts = F.transform(raw, concept)
    return {
        "concepts": concepts,
        "relations": records.concept_relations(raw, related),
        "terms": F.flatten(F.transform(concepts, lambda x: x["terms"])),
    }


def read_descriptors(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Descriptor records of one thesaurus version; ``path`` may name many files."""
    raw = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(DESCRIPTOR_XML).load(path)
    columns = _concept_columns()
    scope_notes = F.filter(F.transform("ConceptList.Concept", lambda x: x["ScopeNote"]), lambda n: n.isNotNull())
    return raw.select(
        F.col("DescriptorUI").alias("descriptor_ui"),
        F.col("DescriptorName.String").alias("descriptor_name"),
        F.col("PublicMeSHNote").alias("public_note"),
        F.trim(F.try_element_at(scope_notes, F.lit(-1))).alias("scope_note"),
        _or_empty(F.col("TreeNumberList.TreeNumber"), "array<string>").alias("tree_numbers"),
        F.transform(
            _or_empty(F.col("PreviousIndexingList.PreviousIndexing"), "array<string>"),
            notes.parse_previous_indexing,
        ).alias("previous_indexing"),
        *[c.alias(name) for name, c in columns.items()],
        F.lit(version).alias("version"),
    )


def read_scrs(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Supplementary records of one thesaurus version with the descriptors they map to."""
    raw = spark.read.format("xml").option("rowTag", "SupplementalRecord").schema(SCR_XML).load(path)
    columns = _concept_columns()
    mapped_to = F.col("HeadingMappedToList.HeadingMappedTo")
    mapped = F.transform(
        mapped_to,
        lambda h: F.struct(
            h["DescriptorReferredTo"]["DescriptorName"]["String"].alias("name"),
            strip_star(h["DescriptorReferredTo"]["DescriptorUI"]).alias("ui"),
        ),
    )
    qualifiers = F.filter(
        F.transform(mapped_to, lambda h: strip_star(h["QualifierReferredTo"]["QualifierUI"])),
        lambda q: q.isNotNull(),
    )
    return raw.select(
        F.col("SupplementalRecordUI").alias("scr_ui"),
        F.col("SupplementalRecordName.String").alias("scr_name"),
        _or_empty(mapped, "array<struct<name:string,ui:string>>").alias("mapped"),
        _or_empty(qualifiers, "array<string>").alias("qualifiers"),
        *[c.alias(name) for name, c in columns.items()],
        F.lit(version).alias("version"),
    )
