"""Parsing of free-text history fields of a thesaurus record."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The shapes of a previous-indexing entry, "Name/qualifier (from-to)", and of its years.
INDEXING_ENTRY = r"([^\(\)/]+?)(/([^\(\)/]*))?( *\(.*?\))?$"
INDEXING_YEARS = r"\((\w{3} )?(\d*)(-(\w{3} )?(\d*))?\)$"

# Year brackets outside that shape and the last year they stand for.
IRREGULAR_YEARS = {
    "(Jan-Jul 1977)": 1977,
    '"( 66-1974)"': 1974,
    "(1979-82,89-1992)": 1992,
}

# The sentence of a history note that names the former hosts.
INDEXED_UNDER = "was indexed under"
INDEXED_UNDER_SENTENCE = r";?([^;]*) was indexed under ([^;]*);?"


def _group(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, pattern, group)), F.lit(""))


def parse_previous_indexing(c: Column) -> Column:
    """Entry -> struct(name, qualifier, year_from, year_to); a missing part is null."""
    years = F.regexp_extract(c, INDEXING_ENTRY, 4)
    regular = F.regexp_like(years, F.lit(INDEXING_YEARS))
    irregular_to = F.lit(None).cast("int")
    for text, year in IRREGULAR_YEARS.items():
        irregular_to = F.when(F.contains(years, F.lit(text)), F.lit(year)).otherwise(irregular_to)
    return F.struct(
        _group(c, INDEXING_ENTRY, 1).alias("name"),
        _group(c, INDEXING_ENTRY, 3).alias("qualifier"),
        F.when(regular, _group(years, INDEXING_YEARS, 2).cast("int")).alias("year_from"),
        F.when(regular, _group(years, INDEXING_YEARS, 5).cast("int"))
        .otherwise(irregular_to)
        .alias("year_to"),
    )


def parse_history_note(c: Column) -> Column:
    """Note -> struct(amenable, term, hosts) read from its first "X was indexed under Y"."""
    amenable = F.coalesce(F.contains(c, F.lit(INDEXED_UNDER)), F.lit(False))
    raw = F.regexp_extract(c, INDEXED_UNDER_SENTENCE, 1)
    cut = F.when(F.contains(raw, F.lit("(now")), F.substring_index(raw, "(now", 1)).otherwise(
        F.substring_index(raw, "now", 1)
    )
    return F.struct(
        amenable.alias("amenable"),
        F.nullif(F.trim(cut), F.lit("")).alias("term"),
        F.nullif(F.regexp_extract(c, INDEXED_UNDER_SENTENCE, 2), F.lit("")).alias("hosts"),
    )


def note_pattern_count(c: Column) -> Column:
    """How often a note says "was indexed under"."""
    return F.coalesce(F.size(F.split(c, INDEXED_UNDER)) - 1, F.lit(0))
