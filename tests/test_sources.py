import datetime as dt

import pytest
from pyspark.sql import functions as F

from labelloom.operators import stats
from labelloom.sources import articles, tables, thesaurus, writers

DESCRIPTORS = """<?xml version="1.0"?>
<!DOCTYPE DescriptorRecordSet SYSTEM "desc.dtd">
<DescriptorRecordSet LanguageCode="eng">
<DescriptorRecord DescriptorClass="1"><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Alpha</String></DescriptorName>
<PreviousIndexingList><PreviousIndexing>Host (1968-2010)</PreviousIndexing></PreviousIndexingList>
<PublicMeSHNote>2011</PublicMeSHNote><TreeNumberList><TreeNumber>C04.1</TreeNumber><TreeNumber>A01.2</TreeNumber></TreeNumberList>
<ConceptList><Concept PreferredConceptYN="Y"><ConceptUI>M1</ConceptUI><ConceptName><String>Alpha</String></ConceptName><ScopeNote>About alpha.</ScopeNote>
<ConceptRelationList><ConceptRelation RelationName="NRW"><Concept1UI>M1</Concept1UI><Concept2UI>M2</Concept2UI></ConceptRelation></ConceptRelationList>
<TermList><Term><TermUI>T1</TermUI><String>Alpha</String></Term><Term><TermUI>T2</TermUI><String>Alphas</String></Term></TermList></Concept>
<Concept PreferredConceptYN="N"><ConceptUI>M2</ConceptUI><ConceptName><String>Alpha two</String></ConceptName>
<TermList><Term><TermUI>T3</TermUI><String>Alpha two</String></Term></TermList></Concept></ConceptList></DescriptorRecord>
<DescriptorRecord DescriptorClass="2"><DescriptorUI>D2</DescriptorUI><DescriptorName><String>Tag</String></DescriptorName>
<ConceptList><Concept PreferredConceptYN="Y"><ConceptUI>M3</ConceptUI><ConceptName><String>Tag</String></ConceptName>
<TermList><Term><TermUI>T4</TermUI><String>Tag</String></Term></TermList></Concept></ConceptList></DescriptorRecord>
</DescriptorRecordSet>
"""

SCRS = """<?xml version="1.0"?>
<SupplementalRecordSet><SupplementalRecord SCRClass="1"><SupplementalRecordUI>S1</SupplementalRecordUI>
<SupplementalRecordName><String>Sub</String></SupplementalRecordName>
<HeadingMappedToList><HeadingMappedTo><DescriptorReferredTo><DescriptorUI>*D1</DescriptorUI><DescriptorName><String>Alpha</String></DescriptorName></DescriptorReferredTo>
<QualifierReferredTo><QualifierUI>*Q1</QualifierUI></QualifierReferredTo></HeadingMappedTo>
<HeadingMappedTo><DescriptorReferredTo><DescriptorUI>D9</DescriptorUI><DescriptorName><String>Other</String></DescriptorName></DescriptorReferredTo></HeadingMappedTo></HeadingMappedToList>
<ConceptList><Concept PreferredConceptYN="Y"><ConceptUI>M7</ConceptUI><ConceptName><String>Sub</String></ConceptName>
<TermList><Term><TermUI>T9</TermUI><String>Sub</String></Term></TermList></Concept></ConceptList></SupplementalRecord></SupplementalRecordSet>
"""


def test_descriptors(spark, tmp_path):
    (tmp_path / "desc.xml").write_text(DESCRIPTORS)
    rows = {r["descriptor_ui"]: r for r in thesaurus.read_descriptors(spark, str(tmp_path / "desc.xml"), 2011).collect()}
    first, tag = rows["D1"], rows["D2"]
    assert first["descriptor_name"] == "Alpha" and first["public_note"] == "2011" and first["scope_note"] == "About alpha."
    assert first["tree_numbers"] == ["C04.1", "A01.2"] and first["terms"] == ["Alpha", "Alphas", "Alpha two"]
    assert [(c["ui"], c["preferred"]) for c in first["concepts"]] == [("M1", "Y"), ("M2", "N")]
    assert first["relations"] == {"M2": "NRW"}
    assert tuple(first["previous_indexing"][0]) == ("Host", None, 1968, 2010)
    assert tag["tree_numbers"] == [] and tag["previous_indexing"] == [] and tag["version"] == 2011


def test_scrs(spark, tmp_path):
    (tmp_path / "supp.xml").write_text(SCRS)
    row = thesaurus.read_scrs(spark, str(tmp_path / "supp.xml"), 2010).first()
    assert row["scr_ui"] == "S1" and [tuple(m) for m in row["mapped"]] == [("Alpha", "D1"), ("Other", "D9")]
    assert row["qualifiers"] == ["Q1"] and row["terms"] == ["Sub"] and row["concepts"][0]["ui"] == "M7"


def test_envelope(spark, tmp_path):
    lines = ['{"documents":[', '{"pmid":1,"title":"a","abstractText":"x, y","year":"2001","Date_revised":"3-2-2004","Descriptor_UIs":["D1","D2"],"newFGDescriptors":[],"weakLabel":["D3"]},',
             '{"pmid":2,"title":"b","abstractText":"","year":"2002","Date_revised":"9-9-2009","Descriptor_UIs":["D2"]}]}']
    (tmp_path / "docs.json").write_text("\n".join(lines) + "\n")
    rows = articles.envelope_articles(articles.read_envelope_json(spark, str(tmp_path / "docs.json"))).orderBy("pmid").collect()
    assert [(r["pmid"], r["golden"], r["golden_in_scope"], r["weak"]) for r in rows] == [(1, ["D1", "D2"], [], ["D3"]), (2, ["D2"], [], [])]
    assert rows[0]["abstract_text"] == "x, y" and rows[0]["date_revised"] == dt.date(2004, 2, 3)


def test_unreadable_envelope_line_stops_the_job(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"documents":[\n{"pmid":1,"title":"a"},\n{"pmid":2,"tit\n]}\n')
    with pytest.raises(Exception, match="unreadable line"):
        articles.read_envelope_json(spark, str(tmp_path / "bad.json")).collect()


def test_ids_by_file(spark, tmp_path):
    (tmp_path / "n1.xml").write_text('<a>\n<PMID Version="1">11</PMID>\n<PMID Version="1">12</PMID>\n</a>\n')
    (tmp_path / "n2.xml").write_text('<a>\n  <PMID Version="2">11</PMID>\n<Other>12</Other></a>\n')
    ids = spark.createDataFrame([(11,), (13,)], "pmid long")
    found = articles.scan_ids_by_file(spark, str(tmp_path / "*.xml"), ids)
    assert sorted(map(tuple, found.collect())) == [(11, "n1.xml"), (11, "n2.xml")]
    from labelloom.operators.stats import duplicate_report

    report = writers.duplicate_table(duplicate_report(found)).first()
    assert tuple(report) == (11, 2, "n1.xml-n2.xml")


def test_label_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "labels")
    rows = spark.createDataFrame(
        [("D1", 'Alpha, "one"', None, ["A01.1", "B01.2"], ["Alpha", "first"], None), ("D2", "Root", None, ["A01"], ["Root"], None)],
        "descriptor_ui string, descriptor_name string, public_note string, tree_numbers array<string>, terms array<string>, scope_note string",
    )
    parents = spark.createDataFrame([("D1", "P2"), ("D1", "P1")], "label string, parent string")
    writers.write_label_table(rows, parents, path)
    schema = "`Descr. UI` string, `Descr. Name` string, PublicMeSHNote string, Categories string, TreeNumbers string, Terms string, ScopeNote string, DirectParents string"
    back = tables.read_label_table(spark, path, schema, list_columns=["TreeNumbers", "Terms", "DirectParents", "Categories"]).collect()
    assert len(back) == 1 and back[0]["Descr. Name"] == 'Alpha, "one"'
    assert back[0]["DirectParents"] == ["P1", "P2"] and back[0]["Categories"] == ["A", "B"]


def test_label_table_of_leaves(spark, tmp_path):
    (tmp_path / "cases.csv").write_text("Descr. UI;#Descendant Ds\nD1;0\nD2;3\n")
    kept = tables.read_label_table(spark, str(tmp_path / "cases.csv"), "`Descr. UI` string, `#Descendant Ds` string", sep=";", only_leaves=True)
    assert [r[0] for r in kept.collect()] == ["D1"]


def test_split_tables_read_only_their_folder(spark, tmp_path):
    rows = spark.createDataFrame(
        [("A", 1, "x", 1, "train"), ("A", 2, "y", 0, "test"), ("B", 1, "x", 0, "train")],
        "label string, pmid long, text string, target int, split string",
    )
    path = str(tmp_path / "dataset")
    writers.write_split_tables(rows, path)
    names = spark.createDataFrame([("A", "Alpha"), ("B", "Beta")], "label string, label_name string")
    got = tables.read_split_tables(spark, path, names, "train", ["A"])
    assert [(r["label"], r["pmid"], r["label_name"]) for r in got.collect()] == [("A", 1, "Alpha")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_text_sinks(spark, tmp_path):
    rows = spark.createDataFrame(
        [(0, 1, "train", "x\ny", ["A", "B"], ["B"], ["A"]), (0, 2, "train", "z", ["A"], [], ["A", "B"])],
        "grp int, pmid long, split string, text string, valid_labels array<string>, positive array<string>, negative array<string>",
    )
    writers.write_fasttext(rows, str(tmp_path / "ft"))
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "ft/grp=0/split=train")).collect())
    assert lines == [" z", "__label__B x y"]
    marked = sorted(r["value"] for r in writers.fasttext_lines(rows, add_negative_labels=True).collect())
    assert marked == ["__label__notA __label__B x y", "__label__notA __label__notB z"]
    pwl = sorted(r["value"] for r in writers.fasttext_lines(rows, "PWL", True).collect())
    assert pwl == ["__label__A __label__B z", "__label__A __label__notB x y"]
    writers.write_wide_split(rows, ["A", "B"], str(tmp_path / "wide"))
    wide = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "wide/split=train"))
    assert sorted(map(tuple, wide.collect())) == [("1", "x\ny", "A~B", "0", "1"), ("2", "z", "A", "0", "0")]
    arts = spark.createDataFrame([(1, "t;1", 'say "x"')], "pmid long, title string, abstract_text string")
    writers.write_abstracts(arts, str(tmp_path / "abs"))
    back = spark.read.option("header", True).option("sep", ";").option("escape", '"').csv(str(tmp_path / "abs")).first()
    assert tuple(back) == ("1", 'say "x"', "t;1")
    writers.write_articles(arts, str(tmp_path / "arts"))
    assert spark.read.json(str(tmp_path / "arts")).count() == 1


def test_batches(spark):
    batches = spark.createDataFrame([(0, [0.1, 0.2]), (1, [0.3])], "batch int, values array<double>")
    order = spark.createDataFrame([(0, 7), (1, 8), (2, 9)], "pos int, pmid long")
    got = tables.batches_to_rows(batches, 2, order)
    assert sorted(map(tuple, got.collect())) == [(7, 0.1), (8, 0.2), (9, 0.3)]


def test_occurrences_and_crosswalk(spark, tmp_path):
    spark.createDataFrame([(1, "C1", 5)], tables.OCCURRENCE_SCHEMA).write.parquet(str(tmp_path / "occ"))
    spark.createDataFrame([("C1", "M1", "X"), ("C2", "M1", "Y")], tables.CROSSWALK_SCHEMA).write.parquet(str(tmp_path / "cw"))
    assert tables.read_occurrences(spark, str(tmp_path / "occ")).count() == 1
    cw = tables.read_crosswalk(spark, str(tmp_path / "cw"), "Y")
    assert [r["cui"] for r in cw.collect()] == ["C2"]
    assert "EqualTo(source,Y)" in cw._jdf.queryExecution().executedPlan().toString()


def test_articles_from_parquet_and_json(spark, tmp_path):
    row = (1, "t", "a", "2001", dt.date(2001, 2, 3), dt.date(2004, 5, 6), ["D1"])
    rows = spark.createDataFrame([row], articles.ARTICLE_SCHEMA)
    rows.write.parquet(str(tmp_path / "articles"))
    rows.write.json(str(tmp_path / "articles.json"))
    assert tuple(articles.read_articles(spark, str(tmp_path / "articles")).first()) == row
    assert tuple(articles.read_articles(spark, str(tmp_path / "articles.json")).first()) == row
    narrow = articles.read_articles(spark, str(tmp_path / "articles"), ["pmid", "golden"])
    assert "ReadSchema: struct<pmid:bigint,golden:array<string>>" in narrow._jdf.queryExecution().executedPlan().toString()


def test_wide_tables_come_back(spark, tmp_path):
    rows = [(1, "train", ' a "quoted"\nline ', ["x", "y"], ["x"]), (2, "dev", "", ["y"], []), (3, "train", None, [], ["x"]), (4, "dev", "t", ["z"], ["z"])]
    docs = spark.createDataFrame(rows, "pmid long, split string, text string, valid_labels array<string>, positive array<string>")
    writers.write_wide_split(docs, ["x", "y"], str(tmp_path / "wide"))
    got = {tuple(r) for r in tables.read_wide_split(spark, str(tmp_path / "wide"), ["x", "y"]).collect()}
    want = {(1, "train", "x", 1, rows[0][2]), (1, "train", "y", 0, rows[0][2]), (4, "dev", "z", None, "t")}
    assert {r for r in got if r[0] != 2} == want
    assert [(r[2], r[3], r[4] or "") for r in got if r[0] == 2] == [("y", 0, "")]


def test_report_columns_must_be_there(spark):
    cases = spark.createDataFrame([("D1", "name")], "descriptor_ui string, descriptor_name string")
    with pytest.raises(ValueError, match="prov_code"):
        writers.use_case_table(cases)
    rest = tuple(c for c in writers.USE_CASE_COLUMNS if c not in cases.columns)
    assert writers.use_case_table(cases, without=rest).count() == 1


def test_sums_over_datasets(spark):
    articles = spark.createDataFrame([(1999, "a", 1), (1999, "a", 1), (1999, "a", 2), (2000, "a", 1), (2000, "b", 3)], "year int, split string, pmid long")
    golden = spark.createDataFrame([(1999, "a", 1, "x"), (1999, "a", 1, "y"), (1999, "a", 1, "y"), (2000, "b", 3, "other"), (2000, "a", 1, "x")], "year int, split string, pmid long, label string")
    weak = spark.createDataFrame([(1999, "a", 2, "x"), (2001, "a", 9, "x")], "year int, split string, pmid long, label string")
    labels = spark.createDataFrame([(1999, "a", "x"), (1999, "a", "y"), (2000, "a", "x")], "year int, split string, label string")
    leaves = labels.where("label = 'x'")
    rows = stats.sum_up_statistics(articles, golden, weak, labels, leaves, ["year", "split"], [["year", "split"], ["split"], []]).collect()
    got = {tuple(r)[:3]: tuple(r)[3:] for r in rows}
    assert got == {
        ("year,split", 1999, "a"): (3, 1, 1, 1, 1, 2, 1),
        ("year,split", 2000, "a"): (1, 0, 1, 0, 0, 1, 1),
        ("year,split", 2000, "b"): (1, 0, 0, 0, 0, 0, 0),
        ("split", None, "a"): (4, 1, 2, 1, 2, 2, 1),
        ("split", None, "b"): (1, 0, 0, 0, 0, 0, 0),
        ("", None, None): (5, 1, 2, 1, 2, 2, 1),
    }
