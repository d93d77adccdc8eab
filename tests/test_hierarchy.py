"""Hierarchy and version operators on a small thesaurus with several parents per label."""

import pytest
from pyspark.sql import functions as F

from labelloom.operators import articles as art, hierarchy, labels, scale, versions
from labelloom.plans import curation

SCHEMA = """descriptor_ui string, descriptor_name string, public_note string, scope_note string,
concepts array<struct<ui:string,name:string,preferred:string,terms:array<string>>>, relations map<string,string>,
tree_numbers array<string>, previous_indexing array<struct<name:string,qualifier:string,year_from:int,year_to:int>>,
terms array<string>, version int"""


def record(ui, numbers, concepts=1, indexing=(), note=None):
    held = [(f"M{ui}{i}", ui, "Y" if i == 0 else "N", [ui]) for i in range(concepts)]
    return (ui, f"name {ui}", note, None, held, {}, list(numbers), list(indexing), [f"name {ui}", ui], 2000)


NOW = [
    record("A", ["A01"]),
    record("B", ["B01"]),
    record("AB", ["A01.1", "B01.1"]),
    record("L1", ["A01.1.1", "B01.1.1"]),
    record("L2", ["A01.1.2"]),
    record("L10", ["A01.10"]),
    record("TAG", []),
    record("N1", ["A01.2"], indexing=[("name AB", None, 1990, 1999), ("gone", None, 1990, 1999), ("A", None, 1980, 1989)]),
    record("N2", ["A01.2.1"], indexing=[("name A", None, None, None), ("name N1", None, None, None)]),
    record("N3", ["A01.3"], indexing=[("L4", None, 1990, 1995)]),
    record("L4", ["A01.3.1"]),
    record("N4", ["B01.7"]),
]


@pytest.fixture(scope="module")
def now(spark):
    return spark.createDataFrame(NOW, SCHEMA)


def positions():
    return [(tn, r[0]) for r in NOW for tn in r[6]]


def brute_closure():
    return {(a, d) for ta, a in positions() for td, d in positions() if td.startswith(ta + ".")}


def test_closure(now):
    assert {tuple(r) for r in hierarchy.ancestors(now).collect()} == brute_closure()


def test_parents_and_leaves(now):
    parents = {tuple(r) for r in hierarchy.label_parents(now).collect()}
    assert ("L1", "AB") in parents and ("AB", "A") in parents and ("AB", "B") in parents and ("L1", "A") not in parents
    leaves = {r["descriptor_ui"] for r in hierarchy.leaves(now).collect()}
    # a number that merely starts with the same digits is no descendant
    assert leaves == {"L1", "L2", "L10", "TAG", "N2", "L4", "N4"}


def test_parents_plus_contains_siblings_and_itself(now):
    label_scope, members = hierarchy.parents_plus(now)
    full = {tuple(r) for r in label_scope.join(members, "scope").select("label", "member").collect()}
    closure = brute_closure()
    parents = {tuple(r) for r in hierarchy.label_parents(now).collect()}
    expected = {(x, p) for x, p in parents} | {(x, d) for x, p in parents for a, d in closure if a == p}
    assert full == expected and ("L1", "L1") in full and ("L1", "L2") in full


def test_label_comparison_with_several_parents(spark, now):
    label_scope, members = hierarchy.parents_plus(now)
    full = {tuple(r) for r in label_scope.join(members, "scope").select("label", "member").collect()}
    all_labels = {r["label"] for r in label_scope.collect()}
    golden = {(1, "L1"), (1, "A"), (2, "AB"), (3, "N4"), (3, "N4"), (4, "TAG"), (5, "L10"), (6, "L2")}
    weak = {(1, "L1"), (1, "L2"), (2, "L1"), (3, "L1"), (4, "L2"), (5, "L2"), (6, "L1"), (6, "L2")}
    valid = {(p, x) for p, g in golden for x, m in full if m == g}
    kept = {(p, x) for p, x in weak if (p, x) in valid}
    g = spark.createDataFrame(sorted(golden) * 2, "pmid long, label string")
    w = spark.createDataFrame(sorted(weak) * 3, "pmid long, label string")
    stats = {r["label"]: r for r in labels.label_frequencies(g, w, label_scope, members).collect()}
    assert set(stats) == all_labels
    for x in all_labels:
        gold, found, able = ({p for p, y in s if y == x} for s in (golden, kept, valid))
        expected = (len(found), len(found - gold), len(gold - found), len(gold), len(able - gold - found))
        assert tuple(stats[x][c] for c in ("total_weak", "fp", "fn", "total_gold", "tn")) == expected, x
    rows = {(r["pmid"], r["label"], r["target"]) for r in labels.relabel_dataset(g, w, label_scope, members).collect()}
    assert rows == {(p, x, int((p, x) in golden)) for p, x in valid if (p, x) not in kept}
    positive = {(r["pmid"], r["label"], r["target"]) for r in labels.relabel_dataset(g, w, label_scope, members, "PWL").collect()}
    assert positive == {(p, x, int((p, x) not in golden)) for p, x in kept}


def test_relations(spark, now):
    pairs = spark.createDataFrame([("L1", "A"), ("L1", "B"), ("A", "L1"), ("L1", "L2"), ("L1", None), ("L10", "AB")], "descriptor_ui string, host_ui string")
    got = {(r["descriptor_ui"], r["host_ui"]): r["relations"] for r in hierarchy.hierarchical_relations(pairs, now).collect()}
    assert got[("L1", "A")] == ["anc", "unr"]
    assert got[("A", "L1")] == ["des", "unr"]
    assert got[("L1", "L2")] == ["unr"]
    assert got[("L1", None)] == ["und"]
    # the number A01.10 only looks like an extension of A01.1
    assert got[("L10", "AB")] == ["unr"]


def test_provenance(spark, now):
    old = now.where(~F.col("descriptor_ui").startswith("N"))
    scrs = spark.createDataFrame(
        [], "scr_ui string, scr_name string, concepts array<struct<ui:string,name:string,preferred:string,terms:array<string>>>, mapped array<struct<name:string,ui:string>>, terms array<string>"
    )
    added = versions.new_descriptors(old, now, now)
    hosts = versions.provenance_hosts(added, old, scrs, now)
    codes = {r["descriptor_ui"]: r["prov_code"] for r in versions.provenance_codes(versions.provenance_types(hosts, now)).collect()}
    assert codes == {
        "N1": "3.1: Succession~3.5: Detachment",
        "N2": "3.2: Subdivision~3.3: Submersion",
        "N3": "3.4: Overtopping",
        "N4": "4.0: Emersion",
    }
    cases = {r["descriptor_ui"]: r for r in curation.describe_introductions(added, hosts, now).collect()}
    assert cases["N1"]["host_relations"] == "und~unr" and cases["N1"]["hosts"] == "gone~name AB"
    # AB and its two children
    assert cases["N1"]["n_extended_hosts"] == 3 and cases["N4"]["n_extended_hosts"] == 0
    assert cases["N3"]["n_descendants"] == 1


@pytest.mark.parametrize("letters", [1, 1 << 28])
def test_lists_of_hosts_are_joined_last(spark, now, monkeypatch, letters):
    """Rows with the lists of their hosts' branches are not shuffled again; slices of a scope get the same list."""
    monkeypatch.setattr(versions, "SLICE_LETTERS", letters, raising=False)
    rows = [("N1", "name AB", "AB"), ("N2", "name A", "A"), ("N2", "name AB", "AB"), ("N3", "name AB", "AB"), ("N4", None, None)]
    hosts = spark.createDataFrame([(x, "3", n, u, None) for x, n, u in rows], "descriptor_ui string, category string, host_name string, host_ui string, relation string")
    added = now.where(F.col("descriptor_ui").startswith("N"))
    cases = curation.describe_introductions(added, hosts, now)
    plan = cases._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last = next(line for line in plan if "Join" in line)
    assert "descriptor_ui" not in last
    closure = brute_closure()
    for r in cases.collect():
        heads = {u for x, _, u in rows if x == r["descriptor_ui"] and u}
        below = sorted(heads | {d for a, d in closure if a in heads})
        assert (r["extended_hosts"], r["n_extended_hosts"]) == ("~".join(below) or None, len(below))


def test_counts_of_scopes_never_shuffle_articles_by_scope(spark):
    pairs = {(a, h): 1 + (a + len(h)) % 3 for a in range(60) for i, h in enumerate(["A", "B", "CC", "D"]) if (a >> i) % 3 == 0}
    scopes = {"a": "A", "ab": "AB", "abd": "ABD", "d": "D", "none": "EF"}
    table = spark.createDataFrame([(a, h, p) for (a, h), p in pairs.items()], "pmid long, parent string, periods int")
    heads = spark.createDataFrame([(s, h) for s, hosts in scopes.items() for h in hosts], "scope string, parent string")
    counted = art.period_counts_of_scopes(table, heads, {"old": 1, "new": 2})
    got = {r["scope"]: (r["old"], r["new"]) for r in counted.collect()}
    expected = {
        s: tuple(len({a for (a, h), p in pairs.items() if h in hosts and p & bit}) for bit in (1, 2)) for s, hosts in scopes.items()
    }
    assert got == {s: n for s, n in expected.items() if s != "none"}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "scope#" in line and "pmid#" in line]


def test_previous_scr_order(spark):
    concept = [("M1", "x", "Y", ["x"])]
    new = spark.createDataFrame(
        [
            ("D1", "Alpha", "1999; Beta was indexed under H", concept),
            ("D2", "Alpha", "1999; Beta was indexed under H", [("M9", "x", "Y", ["x"])]),
            ("D3", "Gamma", "1999; Be-ta was indexed under H", [("M9", "x", "Y", ["x"])]),
            ("D4", "Gamma", "1999; Beta was indexed under H", [("M9", "x", "Y", ["x"])]),
            ("D5", "Alpha", "1999", [("M9", "x", "Y", ["x"])]),
        ],
        "descriptor_ui string, descriptor_name string, public_note string, concepts array<struct<ui:string,name:string,preferred:string,terms:array<string>>>",
    )
    scrs = spark.createDataFrame(
        [("S1", concept, ["other"]), ("S2", [("M2", "x", "Y", ["x"])], ["ALPHA"]), ("S3", [("M3", "x", "Y", ["x"])], ["beta"])],
        "scr_ui string, concepts array<struct<ui:string,name:string,preferred:string,terms:array<string>>>, terms array<string>",
    )
    exceptions = spark.createDataFrame([("D4", "S1"), ("D3", "S77"), ("D5", "S1")], "descriptor_ui string, scr_ui string")
    got = {r["descriptor_ui"]: (r["scr_ui"], r["found_by"]) for r in versions.previous_scr(new, scrs, exceptions).collect()}
    assert got == {
        "D1": ("S1", "concept"), "D2": ("S2", "name"), "D3": ("S3", "note"), "D4": ("S1", "exception"), "D5": (None, None),
    }


def test_restriction_levels(spark):
    rows = [
        ("a", "1.3: Submersion", 1, 0, 50, 50, 5), ("b", "1.2: Subdivision", 2, 0, 50, 50, 5),
        ("c", "1.2: Subdivision", 1, 1, 50, 50, 5), ("d", "1.2: Subdivision", 1, 0, 9, 50, 5),
        ("e", "1.2: Subdivision", 1, 0, 10, 9, 5), ("f", "1.2: Subdivision", 1, 0, 10, 101, 5),
        ("g", "1.2: Subdivision", 1, 0, 10, 100, 4), ("h", "1.2: Subdivision", 1, 0, 10, 100, None),
        ("i", "1.2: Subdivision", 1, 0, 10, 100, 5),
    ]
    cases = spark.createDataFrame(rows, "k string, prov_code string, n_concepts int, n_descendants int, test_gold int, train int, train_weak int")
    got = [r["level"][:2] for r in versions.restriction_level(cases, 100, 5).orderBy("k").collect()]
    assert got == ["0:", "2:", "3:", "4:", "5:", "6:", "7:", "7:", "OK"]


def test_hot_article_and_hot_label(spark, now):
    """One article and one label hold most rows; the counts are those of the distinct pairs."""
    label_scope, members = hierarchy.parents_plus(now)
    hot = spark.range(20000).select((F.col("id") % 2 * F.col("id")).alias("pmid"), F.lit("L1").alias("label"))
    others = spark.createDataFrame([(0, "L2"), (0, "L10"), (1, "L2")], "pmid long, label string")
    golden, weak = hot.unionByName(others), hot.where("pmid < 101").unionByName(others)
    stats = {r["label"]: r for r in labels.label_frequencies(golden, weak, label_scope, members).collect()}
    assert (stats["L1"]["total_gold"], stats["L1"]["total_weak"], stats["L1"]["fn"]) == (10001, 51, 9950)
    assert (stats["L2"]["total_gold"], stats["L2"]["tn"]) == (2, 9999)


def test_lists_of_megabytes_are_written_in_bounded_pages(spark, tmp_path):
    """A list that all labels of a scope share, larger than a usual page, is not in a file once per label."""
    import pyarrow.parquet as pq

    members = spark.range(70_000).select(F.lit("s").alias("scope"), F.format_string("P%015d", "id").alias("member"))
    sizes = spark.createDataFrame([("s", 70_000, 1)], "scope string, n_extended_hosts long, slices int")
    rows = spark.range(90).select(F.format_string("N%d", "id").alias("descriptor_ui"), F.lit("s").alias("scope"))
    before = {name: spark.conf.get(name, None) for name in scale.WIDE_ROWS}
    try:
        listed = versions.with_extended_hosts(rows, members, sizes)
        listed.write.parquet(f"{tmp_path}/same")
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)

    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "same").glob("*.parquet")]
    lists = [m.row_group(i).column(2).total_uncompressed_size for m in files for i in range(m.num_row_groups)]
    want = "~".join(f"P{i:015d}" for i in range(70_000))
    assert [r.n for r in listed.groupBy(F.col("extended_hosts") == want).agg(F.count("*").alias("n")).collect()] == [90]
    assert sum(lists) < 10 * len(want)
