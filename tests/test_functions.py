import datetime as dt

import pytest
from pyspark.sql import functions as F

from labelloom.functions import notes, numeric, records, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()
    return row["x"]


@pytest.mark.parametrize(
    "entry,expected",
    [
        ("specific muscles/surgery (1968-2010)", ("specific muscles", "surgery", 1968, 2010)),
        ("Dapsone/analogs & derivatives (1975)", ("Dapsone", "analogs & derivatives", 1975, None)),
        ("specific artery", ("specific artery", None, None, None)),
        ("Utilization Review (1968-Jul 1977)", ("Utilization Review", None, 1968, 1977)),
        ("Endorphins (Jul 1977-1984)", ("Endorphins", None, 1977, 1984)),
        ("Food Services (Jan-Jul 1977)", ("Food Services", None, None, 1977)),
        ("X (1979-82,89-1992)", ("X", None, None, 1992)),
    ],
)
def test_previous_indexing(spark, entry, expected):
    assert tuple(one(spark, notes.parse_previous_indexing(F.col("e")), e=entry)) == expected


@pytest.mark.parametrize(
    "note,expected",
    [
        ("2006; A was indexed under B 1993-2005", (True, "A", "B 1993-2005")),
        ("2009; A (now C) was indexed under B", (True, "A", "B")),
        ("2009; A now C was indexed under B", (True, "A", "B")),
        ("2009; now C was indexed under B", (True, None, "B")),
        ("2001", (False, None, None)),
    ],
)
def test_history_note(spark, note, expected):
    assert tuple(one(spark, notes.parse_history_note(F.col("n")), n=note)) == expected


def test_missing_note(spark):
    rows = spark.createDataFrame([(None,)], "n string")
    parsed = rows.select(notes.parse_history_note(F.col("n")).alias("p"), notes.note_pattern_count(F.col("n")).alias("k")).first()
    assert tuple(parsed["p"]) == (False, None, None) and parsed["k"] == 0


def test_pattern_count(spark):
    assert one(spark, notes.note_pattern_count(F.col("n")), n="A was indexed under B, C was indexed under D") == 2


def test_terms(spark):
    assert one(spark, text.normalize_term(F.col("t")), t=" Heat-Shock Protein, 47 ") == "heatshockprotein47"
    assert one(spark, text.term_parts(F.col("t")), t=" Heat-Shock Protein, 47 ") == ["heat", "shock", "protein", "47"]


def test_lists(spark):
    assert one(spark, text.split_list(F.col("t")), t="a~b") == ["a", "b"]
    assert one(spark, text.split_list(F.col("t")), t="") == []
    assert one(spark, text.split_list(F.col("t"), "|"), t="a|b") == ["a", "b"]
    assert one(spark, text.strip_count(F.col("t")), t="C001:3") == "C001"
    assert one(spark, text.strip_star(F.col("t")), t="*D001") == "D001"


def test_pair_text_keeps_whole_text_unless_limited(spark):
    words = " ".join(str(i) for i in range(600))
    assert one(spark, text.pair_text(F.lit("name"), F.col("t")), t=words)["text"] == words
    assert one(spark, text.pair_text(F.lit("name"), F.col("t"), 512), t=words)["text"].split()[-1] == "511"


def test_dates(spark):
    assert one(spark, numeric.parse_revision_date(F.col("t")), t="3-11-2019") == dt.date(2019, 11, 3)
    assert one(spark, numeric.parse_revision_date(F.col("t")), t="null-null-null") is None


def test_tree_numbers(spark):
    numbers = spark.createDataFrame([(["C04.557.337", "C04.100", "A01"],)], "t array<string>")
    row = numbers.select(
        records.categories(F.col("t")).alias("c"),
        records.parent_tree_numbers(F.col("t")).alias("p"),
        records.proper_prefixes(F.col("t")[0]).alias("q"),
        records.proper_prefixes(F.col("t")[2]).alias("r"),
    ).first()
    assert tuple(row) == (["C", "A"], ["C04.557", "C04"], ["C04", "C04.557"], [])


def test_concept_relations_first_entry_wins(spark):
    rows = spark.createDataFrame(
        [([1, 2], [("M2", "NRW"), ("M2", "BRD"), ("M3", "REL")]), ([1], [("M2", "NRW")])],
        "c array<int>, r array<struct<ui:string,relation:string>>",
    )
    got = [r["m"] for r in rows.select(records.concept_relations(F.col("c"), F.col("r")).alias("m")).collect()]
    assert got == [{"M2": "NRW", "M3": "REL"}, {}]


def test_json_fields_of_wrong_type_are_null(spark):
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    schema = StructType(
        [StructField("a", LongType()), StructField("b", StringType()), StructField("c", ArrayType(StringType()))]
    )
    got = one(spark, records.json_fields(F.col("j"), schema), j='{"a":"x","b":"y"}')
    assert tuple(got) == (None, "y", None)


def test_threshold_grid():
    grid = numeric.threshold_grid()
    assert len(grid) == 29 and grid[0] == 0.5 and grid[7] == 0.85 and grid[8] == 0.9 and grid[-1] == 1.0
    assert numeric.threshold_grid([0.9, 0.5]) == [0.5, 0.9]


def test_draw_is_the_published_number(spark):
    assert one(spark, numeric.draw_bits(F.lit("10|"), F.lit(42))) == 3257717089


def test_remap_and_threshold(spark):
    assert one(spark, numeric.remap_unknown(F.col("t")), t=-1) == 2
    assert one(spark, numeric.remap_unknown(F.col("t")), t=1) == 1
    assert one(spark, numeric.at_threshold(F.col("p"), 0.5), p=0.5) == 1
