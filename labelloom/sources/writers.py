"""Sinks. Tables stay in long form; columns are only joined to text where a file format asks for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.functions.text import article_text, join_list, single_line

# Blanks around a text are part of it.
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_articles(articles: DataFrame, path: str) -> None:
    """One JSON object per line."""
    articles.write.json(path)


def write_abstracts(articles: DataFrame, path: str) -> None:
    articles.select("pmid", F.col("abstract_text").alias("abstract"), "title").write.option("sep", ";").option(
        "escape", '"'
    ).option("header", True).csv(path)


def label_table(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """Label rows with their direct parents, lists joined by ``~``; labels without parents are dropped.

    ``parents`` is (label, parent). The labels that decide validity, the parents and all below them, are
    written by ``write_scopes``, where siblings share them.
    """
    per_label = parents.groupBy(F.col("label").alias("descriptor_ui")).agg(
        F.array_sort(F.collect_set("parent")).alias("parents")
    )
    return labels.join(per_label, "descriptor_ui").where(F.size("parents") > 0).select(
        F.col("descriptor_ui").alias("Descr. UI"),
        F.col("descriptor_name").alias("Descr. Name"),
        F.col("public_note").alias("PublicMeSHNote"),
        join_list(F.array_distinct(F.transform("tree_numbers", lambda t: F.left(t, F.lit(1))))).alias("Categories"),
        join_list(F.col("tree_numbers")).alias("TreeNumbers"),
        join_list(F.col("terms")).alias("Terms"),
        F.col("scope_note").alias("ScopeNote"),
        join_list(F.col("parents")).alias("DirectParents"),
    )


def write_label_table(labels: DataFrame, parents: DataFrame, path: str) -> None:
    write_report(label_table(labels, parents), path)


def write_scopes(label_scope: DataFrame, members: DataFrame, path: str) -> None:
    """The tables (label, scope) and (scope, member) that decide which articles are valid for a label."""
    label_scope.select("label", "scope").write.parquet(f"{path}/label_scope")
    members.select("scope", "member").write.parquet(f"{path}/members")


# Column titles of a use-case report. The first seven are only in the full form.
USE_CASE_COUNTS = {
    "level": "Rest. Level",
    "train": "#Train",
    "train_weak": "#Train WL",
    "train_gold": "#Train gold",
    "test": "#Test",
    "test_weak": "#Test WL",
    "test_gold": "#Test gold",
}
USE_CASE_COLUMNS = {
    "prov_code": "Prov. Code",
    "prov_category": "Prov. Category",
    "prov_type": "Prov. Type",
    "relation": "Conc. Rel.",
    "descriptor_ui": "Descr. UI",
    "descriptor_name": "Descr. Name",
    "n_hosts": "PH count",
    "n_concepts": "#Ct",
    "n_parents": "#Parent Ds",
    "parents": "Parent Ds",
    "hosts": "PHs",
    "host_uis": "PHs UIs",
    "n_extended_hosts": "#PHex",
    "extended_hosts": "PHex UIs",
    "n_multi": "#PHs multirelated",
    "multi_hosts": "PHs multirelated",
    "host_relations": "PH relations",
    "n_descendants": "#Descendant Ds",
    "descendants": "Descendant Ds",
    "categories": "MeSH Categories",
    "cui": "CUI",
    "public_note": "MeSH note",
    "previous_indexing_text": "Prev. Indexing",
    "scope_note": "Scope Note",
}


def use_case_table(cases: DataFrame, full: bool = False, without: tuple[str, ...] = ()) -> DataFrame:
    """Use cases under their report titles. Columns named in ``without`` may be missing and stay empty; no others."""
    titles = {**USE_CASE_COUNTS, **USE_CASE_COLUMNS} if full else USE_CASE_COLUMNS
    missing = [c for c in titles if c not in cases.columns and c not in without]
    if missing:
        raise ValueError(f"no columns {missing}; name those that may stay empty")

    def column(name: str) -> Column:
        return F.col(name) if name in cases.columns else F.lit(None).cast("string")

    return cases.select(*[column(name).alias(title) for name, title in titles.items()])


def write_use_cases(cases: DataFrame, path: str, full: bool = False, without: tuple[str, ...] = ()) -> None:
    write_report(use_case_table(cases, full, without), path)


# Titles of the sum-up table of yearly datasets.
SUM_UP_COLUMNS = {
    "year": "Year",
    "split": "Dataset type",
    "n_articles": "# Total Articles",
    "n_labelled": "# Articles with new FG Descr.",
    "n_multi_labelled": "# 1+ FG Descr",
    "n_labels": "# New FG Descr",
    "n_leaves": "# Leaves",
    "n_weak_labelled": "# Articles with WL",
    "n_duplicated_ids": "Duplicates",
}


def write_sum_up(statistics: DataFrame, path: str) -> None:
    """Rows of ``stats.sum_up_statistics`` under their report titles; the level stays as a last column."""
    titled = statistics.select(*[F.col(c).alias(t) for c, t in SUM_UP_COLUMNS.items()], F.col("level").alias("Level"))
    write_report(titled, path)


def attach_text(dataset: DataFrame, articles: DataFrame) -> DataFrame:
    """Dataset rows with the article's text (null for a missing article), joined only when a dataset is written or scored."""
    texts = articles.select("pmid", article_text(F.col("title"), F.col("abstract_text")).alias("text"))
    return dataset.join(texts, "pmid", "left")


def write_split_tables(dataset: DataFrame, path: str) -> None:
    """One folder per label and split."""
    dataset.write.partitionBy("label", "split").parquet(path)


def wide_dataset(documents: DataFrame, labels: list[str]) -> DataFrame:
    """(pmid, split, text, valid_SCL, one 0/1 column per label) of the articles of one group.

    ``documents`` are rows of ``labels.group_dataset`` with split and text.
    """
    return documents.select(
        "pmid",
        "split",
        "text",
        join_list(F.col("valid_labels")).alias("valid_SCL"),
        *[F.array_contains("positive", x).cast("int").alias(x) for x in labels],
    )


def write_wide_split(documents: DataFrame, labels: list[str], path: str) -> None:
    wide_dataset(documents, labels).write.partitionBy("split").options(**CSV_OPTIONS).csv(path)


def fasttext_lines(documents: DataFrame, kind: str = "NWL", add_negative_labels: bool = False) -> DataFrame:
    """(grp, split, value): one line per article with the marks of its labels and its text.

    ``documents`` are rows of ``labels.group_dataset`` with split and text. The mark is ``__label__X`` for a
    golden label and ``__label__notX`` for one that is not: of the positive rows (NWL: missed, PWL: wrongly
    assigned), and with ``add_negative_labels`` of the other ones as well.
    """
    golden = kind == "NWL"

    def mark(positive: bool):
        return "__label__" if positive == golden else "__label__not"

    positive = F.transform("positive", lambda x: F.struct(x.alias("label"), F.concat(F.lit(mark(True)), x).alias("mark")))
    negative = F.transform("negative", lambda x: F.struct(x.alias("label"), F.concat(F.lit(mark(False)), x).alias("mark")))
    marks = F.array_sort(F.concat(positive, negative) if add_negative_labels else positive)
    line = F.concat(F.array_join(F.transform(marks, lambda m: m["mark"]), " "), F.lit(" "), single_line(F.col("text")))
    return documents.select("grp", "split", line.alias("value"))


def write_fasttext(documents: DataFrame, path: str, kind: str = "NWL", add_negative_labels: bool = False) -> None:
    fasttext_lines(documents, kind, add_negative_labels).write.partitionBy("grp", "split").text(path)


def write_triples(triples: DataFrame, path: str) -> None:
    triples.write.json(path)


def write_scope_info(info: DataFrame, path: str) -> None:
    """New labels, hosts and host descendants, one folder per year and role."""
    info.write.partitionBy("year", "role").json(path)


def duplicate_table(per_file: DataFrame) -> DataFrame:
    """``PMID, # Found in XML, Files`` with each file named once; files of an id are bounded by the files read."""
    return per_file.groupBy("pmid").agg(
        F.max("times_found").alias("# Found in XML"),
        F.array_join(F.array_sort(F.collect_set("file")), "-").alias("Files"),
    ).withColumnRenamed("pmid", "PMID")


def write_report(table: DataFrame, path: str) -> None:
    """CSV with a header; used for statistics, reports, selections and sweep results."""
    table.write.options(**CSV_OPTIONS).csv(path)
