"""Selecting articles and attaching labels to them.

Articles have pmid, title, abstract_text, year, date_completed, date_revised and golden (array of
label uis). Concept occurrences are (pmid, cui, entity_id); ``label_cui`` is (label, cui).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.functions.text import word_count
from labelloom.operators.scale import lookup_join

# Fixed value: the predicate of an article's label statements.
LABEL_PREDICATE = "HAS_MESH"


def has_abstract(articles: DataFrame) -> DataFrame:
    return articles.where(F.length("abstract_text") > 0)


def in_period(start: int, end: int) -> Column:
    """Whether ``date_completed`` lies between January of ``start`` and November of ``end``.

    December of the last year is left out.
    """
    first = start if end - start >= 1 else end
    date = F.col("date_completed")
    return (date >= F.lit(dt.date(first, 1, 1))) & (date < F.lit(dt.date(end, 12, 1)))


def completed_between(articles: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Articles of a period (see ``in_period``). Without one of the bounds nothing is filtered."""
    return articles if start is None or end is None else articles.where(in_period(start, end))


def golden_pairs(articles: DataFrame) -> DataFrame:
    """(pmid, label) per golden label."""
    return articles.select("pmid", F.explode("golden").alias("label"))


def with_descendants(labels: DataFrame, closure: DataFrame) -> DataFrame:
    """Distinct labels (column label) and all their descendants."""
    below = closure.join(labels.select(F.col("label").alias("ancestor")), "ancestor", "left_semi")
    return labels.select("label").unionByName(below.select(F.col("descendant").alias("label"))).distinct()


def annotated_pmids(golden: DataFrame, labels: DataFrame | None, closure: DataFrame | None = None) -> DataFrame:
    """Distinct pmid of articles with any of the labels, or of a descendant when ``closure`` is given.

    Without labels there is no restriction.
    """
    if labels is None:
        return golden.select("pmid").distinct()
    wanted = labels.select("label") if closure is None else with_descendants(labels, closure)
    return lookup_join(golden, wanted, "label", "left_semi").select("pmid").distinct()


def annotated_with_any(articles: DataFrame, labels: DataFrame | None, closure: DataFrame | None = None) -> DataFrame:
    """Articles with any of the labels."""
    if labels is None:
        return articles
    return articles.join(annotated_pmids(golden_pairs(articles), labels, closure), "pmid", "left_semi")


def search_articles(
    articles: DataFrame,
    labels: DataFrame | None = None,
    start: int | None = None,
    end: int | None = None,
    closure: DataFrame | None = None,
) -> DataFrame:
    """Articles with an abstract, completed in the period and annotated with any of the labels."""
    return annotated_with_any(completed_between(has_abstract(articles), start, end), labels, closure)


def search_count(articles: DataFrame, **criteria) -> DataFrame:
    return search_articles(articles, **criteria).agg(F.count("*").alias("n_articles"))


def label_cui(labels: DataFrame, crosswalk: DataFrame, source: str) -> DataFrame:
    """(label, cui): the concept id of each label's preferred concept in one source vocabulary.

    ``labels`` is (label, concept_ui). The smallest id wins; null for a label without one.
    """
    ids = (
        crosswalk.where(F.col("source") == source)
        .groupBy(F.col("source_code").alias("concept_ui"))
        .agg(F.min("cui").alias("cui"))
    )
    return labels.join(ids, "concept_ui", "left").select("label", "cui")


def golden_in_scope(golden: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct golden pairs whose label is in the selected set."""
    return lookup_join(golden, labels.select("label"), "label", "left_semi").select("pmid", "label").distinct()


def weak_rows(occurrence: DataFrame, label_cuis: DataFrame, one_label_per_cui: bool = False) -> DataFrame:
    """(pmid, label) of each occurrence of a label's concept, as often as it occurs."""
    table = label_cuis.where("cui IS NOT NULL").select("label", "cui")
    if one_label_per_cui:
        table = table.groupBy("cui").agg(F.min("label").alias("label"))
    return lookup_join(occurrence.select("pmid", "cui"), table, "cui").select("pmid", "label")


def weak_labels(occurrence: DataFrame, label_cuis: DataFrame, one_label_per_cui: bool = False) -> DataFrame:
    """Distinct (pmid, label): labels whose concept occurs in the article.

    All labels of a shared concept are assigned unless ``one_label_per_cui`` asks for the smallest.
    """
    return weak_rows(occurrence, label_cuis, one_label_per_cui).distinct()


def cui_counts(occurrence: DataFrame) -> DataFrame:
    """Occurrences of each concept in each article."""
    return occurrence.groupBy("pmid", "cui").agg(F.count("entity_id").alias("n_occurrences"))


def articles_with_cui(occurrence: DataFrame, pmids: DataFrame) -> DataFrame:
    """Distinct (cui, pmid) for the articles of a set."""
    pairs = occurrence.select("cui", "pmid").distinct()
    return pairs.join(pmids.select("pmid").distinct(), "pmid", "left_semi").select("cui", "pmid")


def article_counts_by_cui(occurrence: DataFrame, pmids: DataFrame) -> DataFrame:
    return articles_with_cui(occurrence, pmids).groupBy("cui").agg(F.count("*").alias("n_articles"))


def cui_list_in_article(articles: DataFrame, occurrence: DataFrame, cuis: DataFrame) -> DataFrame:
    """(pmid, found): 1 when any concept of the list occurs in the article."""
    hits = lookup_join(occurrence.select("pmid", "cui"), cuis.select("cui").distinct(), "cui", "left_semi")
    found = hits.select("pmid").distinct().withColumn("_found", F.lit(1))
    return articles.select("pmid").distinct().join(found, "pmid", "left").select(
        "pmid", F.coalesce("_found", F.lit(0)).alias("found")
    )


def articles_of_hosts(golden: DataFrame, scope_hosts: DataFrame, branches: DataFrame) -> DataFrame:
    """Distinct (scope, pmid): articles annotated with a host of the scope or a descendant of one.

    ``scope_hosts`` is (scope, parent), ``branches`` (parent, member). Labels with the same hosts share a
    scope. An article is first reduced to its hosts, then each host leads to its scopes.
    """
    of_host = lookup_join(golden.select("pmid", "label"), branches.withColumnRenamed("member", "label"), "label")
    pairs = of_host.select("pmid", "parent").distinct()
    return lookup_join(pairs, scope_hosts, "parent").select("scope", "pmid").distinct()


def periods_by_host(tagged: DataFrame, branches: DataFrame) -> DataFrame:
    """(pmid, parent, periods): the hosts that an article is annotated with, itself or a descendant of it.

    ``tagged`` is (pmid, label, periods) with a bit per period that the article lies in.
    """
    of_host = lookup_join(tagged.select("pmid", "label", "periods"), branches.withColumnRenamed("member", "label"), "label")
    return of_host.groupBy("pmid", "parent").agg(F.bit_or("periods").alias("periods"))


def periods_of_hosts(tagged: DataFrame, scope_hosts: DataFrame, branches: DataFrame) -> DataFrame:
    """(scope, pmid, periods): as ``articles_of_hosts``, for several periods at once."""
    pairs = periods_by_host(tagged, branches)
    return lookup_join(pairs, scope_hosts, "parent").groupBy("scope", "pmid").agg(F.bit_or("periods").alias("periods"))


def period_counts_of_scopes(pairs: DataFrame, scope_hosts: DataFrame, bits: dict[str, int]) -> DataFrame:
    """(scope, a count per name in ``bits``): distinct articles of the hosts of each scope, by period.

    ``pairs`` are rows of ``periods_by_host``. A scope of one host has the host's counts. For the others an article
    carries its hosts and counts with the first of them in a scope, so articles and scopes are never paired in a
    shuffle.
    """
    scopes = scope_hosts.groupBy("scope").agg(F.array_sort(F.collect_set("parent")).alias("_heads"))
    counts = [F.count_if(F.col("periods").bitwiseAND(b) != 0).alias(n) for n, b in bits.items()]
    alone = scopes.where(F.size("_heads") == 1).select("scope", F.col("_heads")[0].alias("parent"))
    single = alone.join(pairs.groupBy("parent").agg(*counts), "parent").drop("parent")

    several = scopes.where(F.size("_heads") > 1).select("scope", "_heads", F.explode("_heads").alias("parent"))
    of_several = lookup_join(pairs, several.select("parent").distinct(), "parent", "left_semi")
    articles = of_several.groupBy("pmid").agg(F.collect_list(F.struct("parent", "periods")).alias("_hosts"))
    met = lookup_join(articles.select("_hosts", F.explode("_hosts.parent").alias("parent")), several, "parent")
    own = F.filter("_hosts", lambda h: F.array_contains("_heads", h["parent"]))
    first = met.withColumn("_own", own).where(F.array_min(F.col("_own.parent")) == F.col("parent"))
    periods = F.aggregate("_own", F.lit(0), lambda bits, h: bits.bitwiseOR(h["periods"])).alias("periods")
    return single.unionByName(first.select("scope", periods).groupBy("scope").agg(*counts))


def article_counts_of_hosts(
    golden: DataFrame, label_scope: DataFrame, scope_hosts: DataFrame, branches: DataFrame
) -> DataFrame:
    """(label, n_articles): number of articles of each label's hosts."""
    counts = articles_of_hosts(golden, scope_hosts, branches).groupBy("scope").agg(F.count("*").alias("n_articles"))
    return label_scope.join(counts, "scope", "left").select(
        "label", F.coalesce("n_articles", F.lit(0).cast("long")).alias("n_articles")
    )


def weak_counts_of_hosts(
    golden: DataFrame,
    label_scope: DataFrame,
    scope_hosts: DataFrame,
    branches: DataFrame,
    occurrence: DataFrame,
    label_cuis: DataFrame,
) -> DataFrame:
    """(label, cui, n_weak): articles of the label's hosts in which its concept occurs.

    Starts from the weak pairs, which are few, and keeps those whose article is in the label's scope.
    ``n_weak`` is null for a label without a concept id.
    """
    return weak_counts_in_scopes(articles_of_hosts(golden, scope_hosts, branches), label_scope, occurrence, label_cuis)


def weak_counts_in_scopes(scoped: DataFrame, label_scope: DataFrame, occurrence: DataFrame, label_cuis: DataFrame) -> DataFrame:
    """``weak_counts_of_hosts`` for the articles (scope, pmid) of each scope."""
    weak = lookup_join(weak_labels(occurrence, label_cuis), label_scope, "label")
    return _weak_counts(weak.join(scoped, ["pmid", "scope"], "left_semi"), label_cuis)


def weak_counts_by_hosts(
    pairs: DataFrame, label_scope: DataFrame, scope_hosts: DataFrame, occurrence: DataFrame, label_cuis: DataFrame
) -> DataFrame:
    """``weak_counts_of_hosts`` for the articles (pmid, parent) of each host; only weak pairs meet the hosts of a scope."""
    weak = lookup_join(weak_labels(occurrence, label_cuis), label_scope, "label")
    of_host = lookup_join(weak, scope_hosts, "scope").join(pairs, ["pmid", "parent"], "left_semi")
    return _weak_counts(of_host.select("label", "pmid").distinct(), label_cuis)


def _weak_counts(weak: DataFrame, label_cuis: DataFrame) -> DataFrame:
    counts = weak.groupBy("label").agg(F.count("*").alias("_n"))
    return label_cuis.join(counts, "label", "left").select(
        "label", "cui", F.when(F.col("cui").isNotNull(), F.coalesce("_n", F.lit(0).cast("long"))).alias("n_weak")
    )


def below_weak_threshold(weak_counts: DataFrame, threshold: int) -> DataFrame:
    """Weak counts plus ``below``: too few articles with the label's concept, or no concept at all."""
    return weak_counts.withColumn("below", F.coalesce(F.col("n_weak") < threshold, F.lit(True)))


def latest_revision(articles: DataFrame, date: str, tie: str, key: str = "pmid") -> DataFrame:
    """One row per article: the newest revision, the smallest ``tie`` of any type on equal dates.

    A date counts before none and a tie before none. Only the first rank is kept, so Spark drops the
    other revisions of an article before the shuffle.
    """
    order = Window.partitionBy(key).orderBy(F.col(date).desc_nulls_last(), F.col(tie).asc_nulls_last())
    ranked = articles.withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def duplicate_ids(rows: DataFrame, key: str = "pmid") -> DataFrame:
    """Ids that occur more than once, with their number of rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def order_by_year(articles: DataFrame) -> DataFrame:
    """Descending publication year; pmid breaks ties so that one busy year can be split."""
    return articles.orderBy(F.desc("year"), "pmid")


def length_stats(articles: DataFrame, text: str = "text") -> DataFrame:
    """Largest and mean number of words."""
    n = word_count(F.col(text))
    return articles.agg(F.max(n).alias("max_words"), F.avg(n).alias("avg_words"))


def label_triples(golden: DataFrame) -> DataFrame:
    """(s, p, o) statements, one per golden label."""
    return golden.select(F.col("pmid").alias("s"), F.lit(LABEL_PREDICATE).alias("p"), F.col("label").alias("o"))
