"""Differences between versions of the thesaurus and the origin of new labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.functions import notes, records
from labelloom.functions.text import normalize_term
from labelloom.operators import hierarchy
from labelloom.operators.scale import left_lookup, materialize, write_wide_rows

# Names of the provenance types and categories in reports.
PROVENANCE_TYPES = {
    "emersion": "0: Emersion",
    "succession": "1: Succession",
    "subdivision": "2: Subdivision",
    "submersion": "3: Submersion",
    "overtopping": "4: Overtopping",
    "detachment": "5: Detachment",
}
PROVENANCE_CATEGORIES = {
    "1": "1: Old concept",
    "2": "2: Old SRC",
    "3": "3: New PI concept",
    "4": "4: New Emerging concept",
}
# The lists of the rows of a slice have about so many letters together.
SLICE_LETTERS = 1 << 28
# Slices of the rows that have no hosts.
NO_SCOPE_SLICES = 4_096


def new_descriptors(old: DataFrame, new: DataFrame, now: DataFrame) -> DataFrame:
    """Records of ``now`` that are in ``new`` but were not in ``old``."""
    added = new.select("descriptor_ui").join(old.select("descriptor_ui"), "descriptor_ui", "left_anti")
    return now.join(added, "descriptor_ui", "left_semi")


def existing_in(now: DataFrame, old: DataFrame) -> DataFrame:
    """Records of ``now`` that already existed in ``old``."""
    return now.join(old.select("descriptor_ui"), "descriptor_ui", "left_semi")


def preferred_ui(concepts: Column) -> Column:
    return records.preferred_concept(concepts)["ui"]


def previous_concept_host(new: DataFrame, old: DataFrame) -> DataFrame:
    """(descriptor_ui, host_ui, host_name, relation): the old record holding my preferred concept.

    Null host when there is none; a concept held by several records belongs to the smallest ui.
    """
    held = old.select(
        F.explode("concepts.ui").alias("concept_ui"),
        F.struct("descriptor_ui", "descriptor_name", "relations").alias("_host"),
    )
    hosts = held.groupBy("concept_ui").agg(F.min_by("_host", F.col("_host.descriptor_ui")).alias("_host"))
    mine = new.select("descriptor_ui", preferred_ui(F.col("concepts")).alias("concept_ui"))
    return mine.join(hosts, "concept_ui", "left").select(
        "descriptor_ui",
        F.col("_host.descriptor_ui").alias("host_ui"),
        F.col("_host.descriptor_name").alias("host_name"),
        F.try_element_at(F.col("_host.relations"), F.col("concept_ui")).alias("relation"),
    )


def scr_terms(scrs: DataFrame) -> DataFrame:
    """(term, scr_ui) for every term of every supplementary record."""
    return scrs.select(F.explode("terms").alias("term"), "scr_ui")


def previous_scr(new: DataFrame, scrs: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(descriptor_ui, scr_ui, found_by): the supplementary record a new label comes from.

    A record with the same preferred concept wins. Otherwise, when the history note names former
    hosts: the reviewed ``exceptions`` (descriptor_ui, scr_ui) win over a term equal to the label's
    name, and that over the term of the note. Terms are compared normalised.
    """
    by_concept = (
        scrs.select(preferred_ui(F.col("concepts")).alias("_concept"), "scr_ui")
        .groupBy("_concept")
        .agg(F.min("scr_ui").alias("_by_concept"))
    )
    by_term = (
        scr_terms(scrs)
        .groupBy(normalize_term(F.col("term")).alias("_term"))
        .agg(F.min("scr_ui").alias("_ui"))
    )
    note = notes.parse_history_note(F.col("public_note"))
    mine = new.select(
        "descriptor_ui",
        preferred_ui(F.col("concepts")).alias("_concept"),
        note["amenable"].alias("_amenable"),
        normalize_term(F.col("descriptor_name")).alias("_name_term"),
        normalize_term(note["term"]).alias("_note_term"),
    )
    found = (
        mine.transform(left_lookup, by_concept, "_concept", "descriptor_ui")
        .transform(left_lookup, by_term.toDF("_name_term", "_by_name"), "_name_term", "descriptor_ui")
        .transform(left_lookup, by_term.toDF("_note_term", "_by_note"), "_note_term", "descriptor_ui")
    )
    if exceptions is None:
        found = found.withColumn("_by_exception", F.lit(None).cast("string"))
    else:
        known = exceptions.join(scrs.select("scr_ui").distinct(), "scr_ui", "left_semi")
        known = known.groupBy("descriptor_ui").agg(F.min("scr_ui").alias("_by_exception"))
        found = found.join(known, "descriptor_ui", "left")

    def if_amenable(name):
        return F.when(F.col("_amenable"), F.col(name))

    steps = {
        "concept": F.col("_by_concept"),
        "exception": if_amenable("_by_exception"),
        "name": if_amenable("_by_name"),
        "note": if_amenable("_by_note"),
    }
    found_by = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in steps.items()])
    return found.select("descriptor_ui", F.coalesce(*steps.values()).alias("scr_ui"), found_by.alias("found_by"))


def newest_entries(previous_indexing: Column) -> Column:
    """Previous-indexing entries with the latest final year; all of them if none is dated."""
    last = F.array_max(F.transform(previous_indexing, lambda e: e["year_to"]))
    return F.when(last.isNull(), previous_indexing).otherwise(
        F.filter(previous_indexing, lambda e: e["year_to"] == last)
    )


def provenance_hosts(new: DataFrame, old: DataFrame, scrs: DataFrame, now: DataFrame, exceptions=None) -> DataFrame:
    """One row per new label and former host: descriptor_ui, category, host_name, host_ui, relation.

    Category 1: subordinate concept of an old label; 2: supplementary record; 3: previous indexing;
    4: no former host (host_name null). ``host_ui`` is null for a host that is gone from ``now``. The
    hosts of a label come from the arrays of one record, repeated entries stay repeated.
    """
    old_host = previous_concept_host(new, old).withColumnRenamed("host_ui", "_old_ui").withColumnRenamed(
        "host_name", "_old_name"
    )
    scr = previous_scr(new, scrs, exceptions).select("descriptor_ui", "scr_ui")
    mapped = scrs.groupBy("scr_ui").agg(F.first("mapped").alias("_mapped"))
    entries = newest_entries(F.col("previous_indexing"))
    host_type = "array<struct<name:string,ui:string>>"
    labelled = (
        new.select("descriptor_ui", entries.alias("_entries"))
        .join(old_host, "descriptor_ui", "left")
        .join(scr, "descriptor_ui", "left")
        .transform(left_lookup, mapped, "scr_ui", "descriptor_ui")
        .withColumn(
            "category",
            F.when(F.col("_old_ui").isNotNull(), "1")
            .when(F.col("scr_ui").isNotNull(), "2")
            .when(F.size("_entries") > 0, "3")
            .otherwise("4"),
        )
        .withColumn(
            "_hosts",
            F.when(F.col("category") == "1", F.array(F.struct(F.col("_old_name").alias("name"), F.col("_old_ui").alias("ui"))))
            .when(F.col("category") == "2", F.transform("_mapped", lambda m: F.struct(m["name"].alias("name"), m["ui"].alias("ui"))))
            .otherwise(F.transform("_entries", lambda e: F.struct(e["name"].alias("name"), F.lit(None).cast("string").alias("ui"))))
            .cast(host_type),
        )
        .select("descriptor_ui", "category", "relation", F.explode_outer("_hosts").alias("_h"))
        .select("descriptor_ui", "category", "relation", F.col("_h.name").alias("host_name"), F.col("_h.ui").alias("_ui"))
    )
    by_ui = now.select(F.col("descriptor_ui").alias("_ui"), F.col("descriptor_ui").alias("_alive"))
    by_name = hierarchy.term_index(now).toDF("host_name", "_named")
    return (
        labelled.transform(left_lookup, by_ui, "_ui", "descriptor_ui")
        .transform(left_lookup, by_name, "host_name", "descriptor_ui")
        .select(
            "descriptor_ui",
            "category",
            "host_name",
            F.when(F.col("category") == "3", F.col("_named")).otherwise(F.col("_alive")).alias("host_ui"),
            "relation",
        )
    )


def provenance_types(hosts: DataFrame, now: DataFrame) -> DataFrame:
    """Per new label: number of former hosts of each provenance type, hosts counted with repetition.

    A host is looked up once and its positions are compared with the label's; no table of ancestors is built.
    """
    numbers = now.select("descriptor_ui", F.col("tree_numbers").alias("_mine"))
    others = now.select(F.col("descriptor_ui").alias("host_ui"), F.col("tree_numbers").alias("_theirs"))
    both = left_lookup(hosts.join(numbers, "descriptor_ui", "left"), others, "host_ui", by="descriptor_ui")
    mine, theirs = F.col("_mine"), F.col("_theirs")
    flagged = both.withColumns(
        {
            "_parent": hierarchy.is_parent(theirs, mine),
            "_above": hierarchy.is_above(theirs, mine),
            "_below": hierarchy.is_above(mine, theirs),
        }
    )
    alive = F.col("host_ui").isNotNull()
    named = F.col("host_name").isNotNull()
    ancestor = F.col("_above") & ~F.col("_parent")
    counted = flagged.groupBy("descriptor_ui").agg(
        F.first("category").alias("category"),
        F.first("relation").alias("relation"),
        F.count_if(named).alias("n_hosts"),
        F.count_if(alive).alias("n_alive"),
        F.count_if(alive & F.col("_parent")).alias("subdivision"),
        F.count_if(alive & ancestor).alias("submersion"),
        F.count_if(alive & F.col("_below")).alias("overtopping"),
        F.count_if(alive & ~F.col("_parent") & ~ancestor & ~F.col("_below")).alias("detachment"),
    )
    gone = F.col("n_hosts") - F.col("n_alive")
    zero = F.lit(0).cast("long")
    return counted.select(
        "descriptor_ui",
        "category",
        "relation",
        "n_hosts",
        (F.col("n_hosts") == 0).cast("long").alias("emersion"),
        F.greatest(gone, zero).alias("succession"),
        "subdivision",
        "submersion",
        "overtopping",
        "detachment",
    )


def provenance_codes(types: DataFrame) -> DataFrame:
    """Types plus ``prov_code``, ``prov_category`` and ``prov_type`` strings."""
    counts = F.array(
        *[F.struct(F.lit(name).alias("type"), F.col(c).alias("n")) for c, name in PROVENANCE_TYPES.items()]
    )
    kinds = F.array_join(F.array_sort(F.transform(F.filter(counts, lambda x: x["n"] > 0), lambda x: x["type"])), "~")
    names = F.create_map(*[F.lit(v) for pair in PROVENANCE_CATEGORIES.items() for v in pair])
    return types.select(
        "*",
        records.provenance_strings(F.col("category"), counts).alias("prov_code"),
        names[F.col("category")].alias("prov_category"),
        kinds.alias("prov_type"),
    )


def host_relations(hosts: DataFrame, now: DataFrame) -> DataFrame:
    """Per new label: living hosts with several relation kinds, and the relations of every host.

    One string per host with its kinds joined by dots; ``und`` for each host that is gone.
    """
    named = hosts.where("host_name IS NOT NULL")
    related = hierarchy.hierarchical_relations(named.select("descriptor_ui", "host_ui"), now)
    several = F.col("host_ui").isNotNull() & (F.size("relations") > 1)
    return related.groupBy("descriptor_ui").agg(
        F.count_if(several).alias("n_multi"),
        F.array_join(F.array_sort(F.collect_list(F.when(several, F.col("host_ui")))), "~").alias("multi_hosts"),
        F.array_join(F.array_sort(F.collect_list(F.array_join("relations", "."))), "~").alias("host_relations"),
    )


def extended_hosts(hosts: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Living hosts of new labels with all their descendants.

    Factored as (label, scope), (scope, parent) and (parent, member): labels with the same hosts share a
    scope, and each host's branch is listed once. All are written, since several counts look them up.
    """
    living = hosts.where("host_ui IS NOT NULL").select(
        F.col("descriptor_ui").alias("label"), F.col("host_ui").alias("parent")
    )
    label_scope, scope_hosts = hierarchy.label_scopes(materialize(living.distinct(), "living-hosts"))
    branches = hierarchy.branches_of(now, living.select(F.col("parent").alias("head"))).withColumnRenamed("head", "parent")
    return (
        materialize(label_scope, "host-scopes"),
        materialize(scope_hosts, "scope-hosts"),
        materialize(branches, "host-branches"),
    )


def host_members(hosts: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(label, scope), (scope, member) and (scope, n_extended_hosts, slices): the labels in the branches of the hosts.

    Branches of several hosts are united once per scope. ``slices`` is the number of parts that the labels of a
    scope are dealt out to when each gets the list of the members (see ``with_extended_hosts``).
    """
    label_scope, scope_hosts, branches = extended_hosts(hosts, now)
    members = materialize(scope_hosts.join(branches, "parent").select("scope", "member").distinct(), "host-members")
    sizes = members.groupBy("scope").agg(
        F.count("*").alias("n_extended_hosts"), F.sum(F.length("member") + 1).alias("_list")
    )
    written = F.col("_list") * F.col("_labels")
    sizes = sizes.join(label_scope.groupBy("scope").agg(F.count("*").alias("_labels")), "scope").select(
        "scope", "n_extended_hosts", F.greatest(F.lit(1), F.ceil(written / SLICE_LETTERS)).cast("int").alias("slices")
    )
    return label_scope, members, materialize(sizes, "host-sizes")


def with_extended_hosts(rows: DataFrame, members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (descriptor_ui, scope) plus ``extended_hosts``: the sorted members of the scope joined by ``~``.

    A list is made once per scope and bounded by the labels of the thesaurus, but the lists of all rows together
    grow with the labels times the members. So this comes last: the rows are dealt out by scope and slice while
    they are narrow, each slice meets one copy of the list, and rows with their lists are never moved or sorted.
    Files of them are written as ``scale.write_wide_rows`` says.
    """
    write_wide_rows(rows.sparkSession)
    lists = members.groupBy("scope").agg(F.array_join(F.array_sort(F.collect_list("member")), "~").alias("extended_hosts"))
    slices = sizes.select("scope", "slices")
    copies = lists.join(slices, "scope").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    copies = copies.select(F.struct("scope", F.col("_slice").alias("slice")).alias("_place"), "extended_hosts")
    slice_of = F.pmod(F.xxhash64("descriptor_ui"), F.coalesce("slices", F.lit(NO_SCOPE_SLICES))).cast("int")
    dealt = rows.join(slices, "scope", "left").withColumn("_place", F.struct("scope", slice_of.alias("slice")))
    return dealt.join(copies, "_place", "left").drop("_place", "slices")


def extended_host_counts(hosts: DataFrame, now: DataFrame) -> DataFrame:
    """(descriptor_ui, scope, n_extended_hosts, extended_hosts): distinct labels in the branches of the hosts.

    Their number, and their sorted list joined by ``~``.
    """
    label_scope, members, sizes = host_members(hosts, now)
    counted = label_scope.withColumnRenamed("label", "descriptor_ui").join(sizes.drop("slices"), "scope")
    listed = with_extended_hosts(counted, members, sizes)
    return listed.select("descriptor_ui", "scope", "n_extended_hosts", "extended_hosts")


def concepts_per_record(recs: DataFrame) -> DataFrame:
    """Average number of concepts of a record, 0 for no records."""
    return recs.agg(F.coalesce(F.avg(F.size("concepts")), F.lit(0.0)).alias("avg_concepts"))


def restriction_level(
    cases: DataFrame, upper: int, weak_threshold: int, lower: int = 10, gold_threshold: int = 10
) -> DataFrame:
    """Use cases plus ``level``: the first selection rule they fail, or OK.

    Needs prov_code, n_concepts, n_descendants, test_gold, train, train_weak. A label without a concept
    id has a null train_weak and fails the last rule.
    """
    level = (
        F.when(F.col("prov_code") != "1.2: Subdivision", "0: No (old concept) subdivision")
        .when(F.col("n_concepts") > 1, "2: Cs > 1")
        .when(F.col("n_descendants") > 0, "3: not a leaf")
        .when(F.col("test_gold") < gold_threshold, f"4: testGold < {gold_threshold}")
        .when(F.col("train") < lower, f"5: train < {lower}")
        .when(F.col("train") > upper, f"6: train > {upper}")
        .when(F.coalesce(F.col("train_weak") < weak_threshold, F.lit(True)), f"7: trainWS < {weak_threshold}")
        .otherwise("OK")
    )
    return cases.withColumn("level", level)
