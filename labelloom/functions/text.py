"""Text and list columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: characters that do not count when two terms are compared.
NON_TERM = "[^a-zA-Z0-9]"

LIST_SEPARATOR = "~"


def normalize_term(c: Column) -> Column:
    """Lower-cased term without punctuation or blanks."""
    return F.lower(F.regexp_replace(c, NON_TERM, ""))


def term_parts(c: Column) -> Column:
    """Lower-cased non-empty parts of a term."""
    return F.filter(F.split(F.lower(F.trim(c)), NON_TERM), lambda x: x != "")


def concat_sections(arr: Column) -> Column:
    """Sections of an abstract, joined without a separator."""
    return F.array_join(arr, "")


def strip_count(c: Column) -> Column:
    """``C001:3`` -> ``C001``."""
    return F.split_part(c, F.lit(":"), F.lit(1))


def strip_star(c: Column) -> Column:
    """``*D001`` -> ``D001``."""
    return F.replace(c, F.lit("*"), F.lit(""))


def article_text(title: Column, abstract: Column) -> Column:
    """Title and abstract with one blank between; a missing part counts as empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit("")))


def split_list(c: Column, sep: str = LIST_SEPARATOR) -> Column:
    """Delimited cell -> array; an empty or missing cell gives an empty array."""
    quoted = "\\Q" + sep + "\\E"
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.split(c, quoted)
    )


def join_list(arr: Column, sep: str = LIST_SEPARATOR) -> Column:
    return F.array_join(arr, sep)


def pair_text(label_name: Column, text: Column, max_words: int | None = None) -> Column:
    """(label name, text) pair for a pair classifier.

    The whole text is kept unless the caller's model has an input limit, in words.
    """
    if max_words is not None:
        text = F.array_join(F.slice(F.split(F.trim(text), "\\s+"), 1, max_words), " ")
    return F.struct(label_name.alias("label_name"), text.alias("text"))


def word_count(c: Column) -> Column:
    """Number of blank-separated words."""
    return F.size(F.filter(F.split(c, "\\s+"), lambda x: x != ""))


def single_line(c: Column) -> Column:
    return F.translate(c, "\n", " ")


def levenshtein_at_most(a: Column, b: Column, limit: int) -> Column:
    """Edit distance where it is at most ``limit``, otherwise null."""
    d = F.levenshtein(a, b, limit)
    return F.when(d >= 0, d)
