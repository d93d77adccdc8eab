"""One query per operator over the driver's tables, next to the SQL that defines its result.

A query takes (spark, sf_dir). Results with one row per article and label are folded to one row per
label with a count and a sum of ids, which no missing, added or moved row leaves unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelloom.functions import notes, numeric, records, text
from labelloom.operators import articles as art
from labelloom.operators import evaluate, hierarchy, labels, matching, sampling, stats, training, versions
from labelloom.operators.scale import lookup_join, materialize, materialize_bucketed, new_folder
from labelloom.plans import curation, relabelling
from labelloom.sources import articles as article_sources
from labelloom.sources import tables, writers
from labelloom.sources import thesaurus as thesaurus_source
from labelloom.testbed import views
from labelloom.testbed.sql_views import ANNOTATIONS, ARTICLES, DATASET, FREQUENCIES, H, THESAURUS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views_sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the SQL and the views the SQL uses."""

    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = f"WITH {views_sql.strip()}\n{sql.strip()}" if views_sql else sql.strip()
        return fn

    return register


def rounded(c: str | Column, alias: str, digits: int = 8) -> Column:
    return F.round(c, digits).alias(alias)


def written(df: DataFrame, name: str) -> str:
    """The path of a Parquet table for a reader to read."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


def write_xml(records: DataFrame, root: str, path: str, per_file: int = 500) -> None:
    """XML files of about ``per_file`` of the records (value) each, under one root element."""
    files = F.pmod(F.xxhash64("value"), F.lit(1 + records.count() // per_file))
    whole = F.concat(F.lit(f"<{root}>\n"), F.array_join(F.collect_list("value"), "\n"), F.lit(f"\n</{root}>"))
    records.groupBy(files.alias("file")).agg(whole.alias("value")).write.partitionBy("file").text(path)


def per_label(rows: DataFrame, *extra: Column) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("pmid").alias("sum_pmid"), *extra)


PER_LABEL = "label, count(*) AS n, sum(pmid)::BIGINT AS sum_pmid"


# --- sources and sinks ---------------------------------------------------------------------------


@query(
    """SELECT pmid, md5(title) AS title_md5, length(abstract_text) AS abstract_length, year,
              date_completed::VARCHAR AS date_completed FROM article""",
    ARTICLES,
)
def read_articles(spark, d):
    path = written(views.articles(spark, d), "articles")
    return article_sources.read_articles(spark, path, ["pmid", "title", "abstract_text", "year", "date_completed"]).select(
        "pmid",
        F.md5("title").alias("title_md5"),
        F.length("abstract_text").cast("long").alias("abstract_length"),
        "year",
        F.col("date_completed").cast("string").alias("date_completed"),
    )


@query(
    """SELECT ui AS descriptor_ui, name AS descriptor_name, coalesce(tn, '') AS tree_numbers, n_concepts::INTEGER AS n_concepts, concept AS preferred,
              CASE WHEN k IS NULL THEN name ELSE name||'~alias '||k END AS terms, coalesce(e.names, '') AS indexed,
              coalesce(e.last, 0)::INTEGER AS last_year, CASE WHEN k%5=0 THEN 'M'||(k+1)||'=NRW' ELSE '' END AS relations,
              true AS has_name
       FROM rec LEFT JOIN (SELECT ui, string_agg(tn, '~' ORDER BY tn) AS tn FROM pos GROUP BY ui) USING (ui)
       LEFT JOIN (SELECT k, string_agg(name, '~' ORDER BY name, year_to) AS names, max(year_to) AS last FROM entry GROUP BY k) e USING (k)""",
    THESAURUS,
)
def read_descriptors(spark, d):
    """The thesaurus written as XML files, many records each, and read back."""
    path = new_folder(spark, "descriptors-xml")
    write_xml(views.descriptor_xml(spark, d), "DescriptorRecordSet", path)
    read = thesaurus_source.read_descriptors(spark, path, views.NOW_VERSION)
    return read.select(
        "descriptor_ui",
        "descriptor_name",
        F.array_join(F.array_sort("tree_numbers"), "~").alias("tree_numbers"),
        F.size("concepts").alias("n_concepts"),
        versions.preferred_ui(F.col("concepts")).alias("preferred"),
        F.array_join("terms", "~").alias("terms"),
        F.array_join(F.array_sort(F.transform("previous_indexing", lambda e: e["name"])), "~").alias("indexed"),
        F.coalesce(F.array_max(F.transform("previous_indexing", lambda e: e["year_to"])), F.lit(0)).alias("last_year"),
        F.array_join(F.transform(F.map_entries("relations"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "~").alias("relations"),
        F.col("descriptor_name").isNotNull().alias("has_name"),
    )


@query(
    """SELECT scr_ui, term AS scr_name, concept, term AS terms, CASE WHEN k%4=0 THEN p_brand||'~Gone host' ELSE p_brand END AS mapped,
              CASE WHEN k%4=0 THEN brand_ui||'~B999' ELSE brand_ui END AS mapped_uis, CASE WHEN k%4=0 THEN 'Q1' ELSE '' END AS qualifiers
       FROM scr""",
    THESAURUS,
)
def read_scrs(spark, d):
    """The supplementary records written as XML files and read back."""
    path = new_folder(spark, "scrs-xml")
    write_xml(views.scr_xml(spark, d), "SupplementalRecordSet", path)
    read = thesaurus_source.read_scrs(spark, path, views.OLD_VERSION)
    return read.select(
        "scr_ui",
        "scr_name",
        versions.preferred_ui(F.col("concepts")).alias("concept"),
        F.array_join("terms", "~").alias("terms"),
        F.array_join("mapped.name", "~").alias("mapped"),
        F.array_join("mapped.ui", "~").alias("mapped_uis"),
        F.array_join("qualifiers", "~").alias("qualifiers"),
    )


@query(
    """SELECT doc_id AS pmid, lang||'.xml' AS folder, 1::BIGINT AS n FROM documents
       WHERE doc_id IN (SELECT o_orderkey FROM orders)""",
)
def scan_ids_by_file(spark, d):
    """Article files, one folder of files per language, searched for the articles that have an order."""
    docs = views.table(spark, d, "documents")
    article = F.concat(
        F.lit("<Article>\n<"), F.lit(article_sources.ID_LINE), F.lit('="1">'), F.col("doc_id").cast("string"), F.lit("</PMID>\n<Year>1999</Year>\n</Article>")
    )
    path = new_folder(spark, "article-files")
    names = []
    for lang in sorted(set(views.CONCEPT_WORDS.values())):
        docs.where(F.col("lang") == lang).select(article.alias("value")).write.text(f"{path}/{lang}")
        files = spark.read.text(f"{path}/{lang}").select(F.col("_metadata.file_name").alias("file"), F.lit(f"{lang}.xml").alias("folder"))
        names.append(files.distinct())
    wanted = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("pmid"))
    found = article_sources.scan_ids_by_file(spark, f"{path}/*", wanted)
    of_file = materialize(reduce(DataFrame.unionByName, names), "file-names")
    return found.join(of_file, "file", "left").groupBy("pmid", "folder").agg(F.count("*").alias("n"))


@query(
    """SELECT ui AS label, name, n AS n_descendants, coalesce(parents, '') AS parents, n_parents::INTEGER AS n_parents
       FROM (SELECT rec.ui, any_value(name) AS name, count(descendant) AS n FROM rec LEFT JOIN anc ON ancestor=rec.ui GROUP BY rec.ui)
       LEFT JOIN (SELECT label AS ui, string_agg(parent, '~' ORDER BY parent) AS parents, count(*) AS n_parents FROM par GROUP BY label) USING (ui)
       WHERE n = 0""",
    THESAURUS,
)
def read_label_table(spark, d):
    """A label table written as CSV and read back for the labels without descendants."""
    now = views.thesaurus(spark, d)
    below = hierarchy.ancestors(now).groupBy(F.col("ancestor").alias("label")).agg(F.count("*").alias("n"))
    parents = hierarchy.label_parents(now).groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("parent")), text.LIST_SEPARATOR).alias("Parents"))
    rows = now.select(F.col("descriptor_ui").alias("label"), F.col("descriptor_name").alias("Descr. Name")).join(below, "label", "left").join(parents, "label", "left")
    path = new_folder(spark, "label-table")
    rows.select("label", F.col("`Descr. Name`"), "Parents", F.coalesce("n", F.lit(0)).alias("#Descendant Ds")).write.option("header", True).option("escape", '"').csv(path)
    schema = "label STRING, `Descr. Name` STRING, Parents STRING, `#Descendant Ds` LONG"
    read = tables.read_label_table(spark, path, schema, list_columns=["Parents"], only_leaves=True)
    return read.select(
        "label", F.col("`Descr. Name`").alias("name"), F.col("`#Descendant Ds`").alias("n_descendants"),
        F.array_join("Parents", "~").alias("parents"), F.size("Parents").alias("n_parents"),
    )


@query("SELECT cui, count(*) AS n, sum(pmid*entity_id)::BIGINT AS checksum FROM occ GROUP BY cui", ANNOTATIONS)
def read_occurrences(spark, d):
    read = tables.read_occurrences(spark, written(views.occurrence(spark, d), "occurrences"))
    return read.groupBy("cui").agg(
        F.count("*").alias("n"), F.sum(F.col("pmid") * F.col("entity_id")).alias("checksum")
    )


@query("SELECT cui, source_code FROM cross_walk WHERE source='OTHER'", ANNOTATIONS)
def read_crosswalk(spark, d):
    path = written(views.crosswalk(spark, d), "crosswalk")
    return tables.read_crosswalk(spark, path, "OTHER").select("cui", "source_code")


@query(
    """SELECT pmid, label, 'Language '||label AS label_name, target, md5(title||' '||abstract_text) AS text_md5
       FROM text_rows LEFT JOIN article USING (pmid) WHERE split='test'""",
    ARTICLES,
)
def read_split_tables(spark, d):
    names = views.text_scopes(spark, d)[0].select("label", F.concat(F.lit("Language "), "label").alias("label_name"))
    path = new_folder(spark, "split-tables")
    writers.write_split_tables(writers.attach_text(views.text_dataset(spark, d), views.articles(spark, d)), path)
    rows = tables.read_split_tables(spark, path, names, "test")
    return rows.select("pmid", "label", "label_name", "target", F.md5("text").alias("text_md5"))


@query(
    """SELECT pmid, md5(title) AS title_md5, md5(abstract_text) AS abstract_md5, year, lang AS golden, date_completed::VARCHAR AS revised
       FROM article""",
    ARTICLES,
)
def read_envelope_json(spark, d):
    """An envelope file written from the articles, one object per line, and read back."""
    article = views.articles(spark, d).select(
        "pmid", "title", F.col("abstract_text").alias("abstractText"), "year",
        F.date_format("date_completed", "d-M-yyyy").alias("Date_revised"), F.col("golden").alias("Descriptor_UIs"),
    )
    lines = article.select(F.concat(F.to_json(F.struct(*article.columns)), F.lit(",")).alias("value"))
    path = new_folder(spark, "envelope")
    header = spark.createDataFrame([(article_sources.ENVELOPE_HEADER,)], "value string")
    lines.unionByName(header).write.text(path)
    read = article_sources.envelope_articles(article_sources.read_envelope_json(spark, path))
    return read.select(
        "pmid", F.md5("title").alias("title_md5"), F.md5("abstract_text").alias("abstract_md5"), "year",
        F.col("golden")[0].alias("golden"), F.col("date_revised").cast("string").alias("revised"),
    )


@query(
    "SELECT pmid, md5(title) AS title_md5, md5(abstract_text) AS abstract_md5, lang AS golden FROM article",
    ARTICLES,
)
def write_articles(spark, d):
    path = f"{new_folder(spark, 'articles')}.json"
    writers.write_articles(views.articles(spark, d), path)
    read = article_sources.read_articles(spark, path)
    return read.select("pmid", F.md5("title").alias("title_md5"), F.md5("abstract_text").alias("abstract_md5"), F.col("golden")[0].alias("golden"))


@query("SELECT pmid, md5(title) AS title_md5, md5(replace(abstract_text, chr(10), ' ')) AS abstract_md5 FROM article WHERE abstract_text <> ''", ARTICLES)
def write_abstracts(spark, d):
    """The abstracts' file read back; its format has one line per article, so line breaks become blanks."""
    path = new_folder(spark, "abstracts")
    on_one_line = views.articles(spark, d).where("abstract_text <> ''").withColumn("abstract_text", F.translate("abstract_text", "\n", " "))
    writers.write_abstracts(on_one_line, path)
    read = spark.read.schema("pmid long, abstract string, title string").option("header", True).option("sep", ";").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read.select("pmid", F.md5("title").alias("title_md5"), F.md5("abstract").alias("abstract_md5"))


@query(
    """SELECT s_name AS label, count(*) AS n, round(sum(value::DOUBLE), 4) AS total, max(value)::DOUBLE AS largest
       FROM (SELECT vec_id, unnest(embedding) AS value, unnest(range(len(embedding))) AS pos FROM embeddings)
       LEFT JOIN supplier ON s_suppkey=pos GROUP BY s_name"""
)
def matrix_to_long(spark, d):
    matrix = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("pmid"), F.col("embedding").alias("values"))
    order = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("label"))
    long = tables.matrix_to_long(matrix, order)
    value = F.col("value").cast("double")
    return long.groupBy("label").agg(F.count("*").alias("n"), rounded(F.sum(value), "total", 4), F.max(value).alias("largest"))


@query("SELECT pmid AS s, 'HAS_MESH' AS p, lang AS o FROM article", ARTICLES)
def article_label_triples(spark, d):
    return art.label_triples(art.golden_pairs(views.articles(spark, d)))


@query(
    """SELECT r.ui AS "Descr. UI", r.name AS "Descr. Name", t.letters AS "Categories", t.numbers AS "TreeNumbers",
              r.name||'~alias '||r.k AS "Terms", p.parents AS "DirectParents"
       FROM rec r JOIN leaf USING (ui)
       JOIN (SELECT ui, string_agg(DISTINCT left(tn,1), '~' ORDER BY left(tn,1)) AS letters, string_agg(tn, '~' ORDER BY tn) AS numbers FROM pos GROUP BY ui) t USING (ui)
       JOIN (SELECT label AS ui, string_agg(parent, '~' ORDER BY parent) AS parents FROM par GROUP BY label) p USING (ui)
       WHERE r.n_concepts=1 AND r.introduced<=1998""",
    THESAURUS,
)
def label_table(spark, d):
    old, _, now = views.versions3(spark, d)
    fine = curation.select_fine_grained_labels(now, old)
    return writers.label_table(fine.labels, fine.parents).select(
        "`Descr. UI`", "`Descr. Name`", "Categories", "TreeNumbers", "Terms", "DirectParents"
    )


_GROUP_ROWS = """SELECT doc_id AS pmid, lang, (SELECT string_agg(label, '~' ORDER BY label) FROM langs) AS valid_scl, title||' '||abstract_text AS text,
              CASE WHEN r <= 0.2::DOUBLE THEN 'test' WHEN r <= 0.4::DOUBLE THEN 'dev' ELSE 'train' END AS split
       FROM (SELECT doc_id, lang, """ + H.format("'10|'||doc_id") + """/4294967296::DOUBLE AS r FROM documents
             WHERE doc_id NOT IN (SELECT pmid FROM text_weak)) LEFT JOIN (SELECT pmid, title, abstract_text FROM article) ON pmid=doc_id"""


def _language_group(spark, d):
    """The languages as one group: articles valid for any of them without a weak label."""
    weak_pairs = art.weak_labels(views.text_occurrence(spark, d), views.text_labels(spark, d))
    label_scope, members = views.text_scopes(spark, d)
    groups = label_scope.select("label", F.lit(0).alias("grp"))
    rows = labels.group_dataset(views.text_golden(spark, d), weak_pairs, label_scope, members, groups)
    return writers.attach_text(sampling.split_rows(rows), views.articles(spark, d))


@query(
    f"""SELECT pmid, split, text, valid_scl AS "valid_SCL", (lang='de')::INTEGER AS de, (lang='en')::INTEGER AS en,
              (lang='es')::INTEGER AS es, (lang='fr')::INTEGER AS fr FROM ({_GROUP_ROWS})""",
    ARTICLES,
)
def write_split_tables_wide(spark, d):
    return writers.wide_dataset(_language_group(spark, d), ["de", "en", "es", "fr"])


@query(
    f"""SELECT pmid, split, label, (lang=label)::INTEGER AS target, md5(text) AS text_md5
        FROM (SELECT *, unnest(string_split(valid_scl, '~')) AS label FROM ({_GROUP_ROWS})) WHERE split<>'test'""",
    ARTICLES,
)
def read_wide_split(spark, d):
    """The wide tables of a group written as CSV and read back as rows of single labels."""
    path = new_folder(spark, "wide-split")
    known = ["de", "en", "es", "fr"]
    writers.write_wide_split(_language_group(spark, d), known, path)
    rows = tables.read_wide_split(spark, path, known).where("split <> 'test'")
    return rows.select("pmid", "split", "label", "target", F.md5("text").alias("text_md5"))


@query(
    f"""SELECT 0 AS grp, split, md5('__label__'||lang||' '||replace(text, chr(10), ' ')) AS line_md5 FROM ({_GROUP_ROWS})""",
    ARTICLES,
)
def fasttext_lines(spark, d):
    return writers.fasttext_lines(_language_group(spark, d)).select("grp", "split", F.md5("value").alias("line_md5"))


@query(
    f"""SELECT 0 AS grp, split, md5((SELECT string_agg(CASE WHEN label=lang THEN '__label__' ELSE '__label__not' END||label, ' ' ORDER BY label)
                                     FROM langs)||' '||replace(text, chr(10), ' ')) AS line_md5 FROM ({_GROUP_ROWS})""",
    ARTICLES,
)
def fasttext_lines_all_marks(spark, d):
    lines = writers.fasttext_lines(_language_group(spark, d), add_negative_labels=True)
    return lines.select("grp", "split", F.md5("value").alias("line_md5"))


@query(
    """SELECT grp::INTEGER AS grp, count(*) FILTER (valid AND NOT weak AND (fn OR drawn)) AS selected,
              count(*) FILTER (valid AND NOT weak AND fn) AS with_positive FROM doc GROUP BY grp""",
    None,
)
def group_dataset(spark, d):
    """As many articles as dataset_counters calls selected, for the same groups."""
    gold, weak_rows, label_scope, members = views.annotation_inputs(spark, d)
    groups = sampling.chunk_labels(views.label_parent(spark, d), 40)
    rows = labels.group_dataset(gold, weak_rows, label_scope, members, groups, ratio_kept=0.5)
    return rows.groupBy("grp").agg(F.count("*").alias("selected"), F.count_if(F.size("positive") > 0).alias("with_positive"))


def _scope_info(spark, d):
    hosts, now = _hosts(spark, d)
    added = _added(now)
    year = F.lit(views.NEW_VERSION)
    host_rows = hosts.where("host_ui IS NOT NULL").select(year.alias("year"), F.col("host_ui").alias("host")).distinct()
    members = hierarchy.branches(hierarchy.ancestors(now), host_rows.select(F.col("host").alias("head"))).toDF("host", "member")
    new_labels = added.select(year.alias("year"), F.col("descriptor_ui").alias("label"))
    return stats.label_scope_info(new_labels, host_rows, members)


@query(
    """SELECT DISTINCT 1999 AS year, 'new label' AS role, ui AS label FROM added
       UNION ALL SELECT DISTINCT 1999, 'previous host', host_ui FROM hosts WHERE host_ui IS NOT NULL
       UNION ALL SELECT DISTINCT 1999, 'host descendant', descendant FROM hosts JOIN anc ON ancestor=host_ui""",
    THESAURUS,
)
def label_scope_info(spark, d):
    return _scope_info(spark, d)


@query(
    """SELECT pmid, file, times_in_file, (sum(times_in_file) OVER (PARTITION BY pmid))::BIGINT AS times_found
       FROM (SELECT user_id AS pmid, 'day'||day(ts) AS file, count(*) AS times_in_file FROM events GROUP BY ALL)"""
)
def duplicate_report(spark, d):
    seen = views.table(spark, d, "events").select(
        F.col("user_id").alias("pmid"), F.concat(F.lit("day"), F.day("ts").cast("string")).alias("file")
    )
    return stats.duplicate_report(seen)


# --- scalar functions ----------------------------------------------------------------------------


@query("SELECT p_partkey, lower(regexp_replace(p_name||' (type '||p_type||', '||p_brand||')', '[^a-zA-Z0-9]', '', 'g')) AS term FROM part")
def normalize_term(spark, d):
    name = F.concat("p_name", F.lit(" (type "), "p_type", F.lit(", "), "p_brand", F.lit(")"))
    return views.table(spark, d, "part").select("p_partkey", text.normalize_term(name).alias("term"))


@query(
    """SELECT doc_id, count(*) FILTER (part<>'') AS n_parts, coalesce(string_agg(part, '' ORDER BY i) FILTER (part<>''), '') AS joined
       FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS i
             FROM (SELECT doc_id, string_split_regex(lower(trim(text)), '[^a-zA-Z0-9]') AS parts FROM documents))
       GROUP BY doc_id"""
)
def term_parts(spark, d):
    parts = text.term_parts(F.col("text"))
    return views.table(spark, d, "documents").select(
        "doc_id", F.size(parts).cast("long").alias("n_parts"), F.array_join(parts, "").alias("joined")
    )


_ENTRIES = """entry AS (
SELECT p_partkey AS k, unnest(CASE
         WHEN p_partkey%5=3 THEN [p_brand||'/metabolism (1990-'||(1996+p_partkey%3)||')', p_type||' (Jan 1990-'||(1996+p_partkey%2)||')',
                                  'Gone '||p_partkey, p_type||' (1979-82,89-1992)']
         WHEN p_partkey%5=0 THEN ['Gone '||p_partkey, p_type] ELSE [] END) AS entry FROM part)"""


@query(
    """SELECT k, entry, CASE WHEN entry LIKE 'Brand%' THEN split_part(entry,'/',1) WHEN entry LIKE 'Gone%' THEN entry ELSE split_part(entry,' ',1) END AS name,
              CASE WHEN entry LIKE '%/%' THEN 'metabolism' END AS qualifier,
              CASE WHEN entry LIKE '%1990-%' THEN 1990 END AS year_from,
              CASE WHEN entry LIKE '%89-1992%' THEN 1992 WHEN entry LIKE '%1990-%' THEN regexp_extract(entry, '-([0-9]+)', 1)::INTEGER END AS year_to
       FROM entry""",
    _ENTRIES,
)
def parse_previous_indexing(spark, d):
    rows = views.indexing_texts(spark, d)
    parsed = rows.select(F.col("p_partkey").alias("k"), "entry", notes.parse_previous_indexing(F.col("entry")).alias("p"))
    return parsed.select("k", "entry", "p.*")


_NOTES = """note AS (
SELECT p_partkey AS k, CASE WHEN p_partkey%5=2 THEN '1999; '||p_name||' '||p_partkey
         ||(CASE WHEN p_partkey%4=1 THEN ' now other' WHEN p_partkey%4=2 THEN ' (now other)' ELSE '' END)
         ||' was indexed under '||p_brand||' 1990-1998' END AS note, p_name||' '||p_partkey AS term, p_brand||' 1990-1998' AS hosts FROM part)"""


@query(
    "SELECT k, note IS NOT NULL AS amenable, CASE WHEN note IS NOT NULL THEN term END AS term, CASE WHEN note IS NOT NULL THEN hosts END AS hosts FROM note",
    _NOTES,
)
def parse_history_note(spark, d):
    parsed = views.table(spark, d, "part").select(
        F.col("p_partkey").alias("k"), notes.parse_history_note(views.part_note()).alias("p")
    )
    return parsed.select("k", "p.*")


@query(
    "SELECT k, coalesce((length(two)-length(replace(two,'was indexed under','')))//length('was indexed under'),0)::INTEGER AS n FROM (SELECT k, CASE WHEN k%2=0 THEN note||', '||note ELSE note END AS two FROM note)",
    _NOTES,
)
def note_pattern_count(spark, d):
    note = views.part_note()
    twice = F.when(F.col("p_partkey") % 2 == 0, F.concat(note, F.lit(", "), note)).otherwise(note)
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("k"), notes.note_pattern_count(twice).alias("n"))


@query("SELECT ui AS descriptor_ui, concept AS concept_ui, name AS concept_name FROM rec", THESAURUS)
def preferred_concept(spark, d):
    concept = records.preferred_concept(F.col("concepts"))
    return views.descriptors(spark, d).select(
        "descriptor_ui", concept["ui"].alias("concept_ui"), concept["name"].alias("concept_name")
    )


@query(
    "SELECT ui AS descriptor_ui, string_agg(DISTINCT left(tn,1), '' ORDER BY left(tn,1)) AS categories FROM pos GROUP BY ui",
    THESAURUS,
)
def categories(spark, d):
    letters = records.categories(F.col("tree_numbers"))
    return views.descriptors(spark, d).select("descriptor_ui", F.array_join(F.array_sort(letters), "").alias("categories"))


@query("SELECT ui AS descriptor_ui, 'M'||(k+1) AS related_ui, 'NRW' AS relation FROM rec WHERE k%5=0", THESAURUS)
def concept_relations(spark, d):
    rows = views.descriptors(spark, d)
    given = F.map_entries("relations")
    related = F.transform(
        F.concat(given, F.transform(given, lambda e: F.struct(e["key"].alias("key"), F.lit("BRD").alias("value")))),
        lambda e: F.struct(e["key"].alias("ui"), e["value"].alias("relation")),
    )
    mapped = records.concept_relations(F.col("concepts"), related)
    return rows.select("descriptor_ui", F.explode(mapped).alias("related_ui", "relation"))


@query(
    """SELECT DISTINCT ui AS descriptor_ui, left(tn, length(tn) - strpos(reverse(tn), '.')) AS parent_tree_number
       FROM pos WHERE contains(tn, '.')""",
    THESAURUS,
)
def parent_tree_numbers(spark, d):
    parents = records.parent_tree_numbers(F.col("tree_numbers"))
    return views.descriptors(spark, d).select("descriptor_ui", F.explode(parents).alias("parent_tree_number"))


@query("SELECT doc_id, md5(replace(text, chr(10), '')) AS joined_md5 FROM documents")
def concat_sections(spark, d):
    sections = F.split("text", "\n")
    return views.table(spark, d, "documents").select("doc_id", F.md5(text.concat_sections(sections)).alias("joined_md5"))


@query(
    """SELECT o_orderkey AS pmid, o_orderdate::DATE::VARCHAR AS date_revised,
              (o_orderdate::DATE = date '1999-02-03') AS on_day FROM orders"""
)
def revision_date(spark, d):
    o = views.table(spark, d, "orders")
    composed = numeric.revision_date(F.day("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate"))
    parsed = numeric.parse_revision_date(F.date_format("o_orderdate", "d-M-yyyy"))
    return o.select(
        F.col("o_orderkey").alias("pmid"),
        composed.cast("string").alias("date_revised"),
        (parsed == F.lit("1999-02-03").cast("date")).alias("on_day"),
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'C'||l_partkey AS cui, 'D'||l_partkey AS ui FROM lineitem")
def strip_marks(spark, d):
    key = F.col("l_partkey").cast("string")
    counted = F.concat(F.lit("C"), key, F.lit(":"), F.col("l_linenumber").cast("string"))
    return views.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        text.strip_count(counted).alias("cui"),
        text.strip_star(F.concat(F.lit("*D"), key)).alias("ui"),
    )


@query("SELECT pmid, md5(title||' '||abstract_text) AS text_md5 FROM article", ARTICLES)
def article_text(spark, d):
    joined = text.article_text(F.col("title"), F.col("abstract_text"))
    return views.articles(spark, d).select("pmid", F.md5(joined).alias("text_md5"))


@query(
    """SELECT p_partkey, len(string_split(p_type||'~'||p_brand||'~'||p_name, '~'))::INTEGER AS n,
              p_type||'~'||p_brand||'~'||p_name AS joined FROM part"""
)
def list_columns(spark, d):
    cell = F.concat_ws("~", "p_type", "p_brand", "p_name")
    parts = text.split_list(cell)
    return views.table(spark, d, "part").select(
        "p_partkey", F.size(parts).alias("n"), text.join_list(parts).alias("joined")
    )


@query(
    """SELECT label, pmid, 'Language '||label AS label_name, md5(title||' '||abstract_text) AS text_md5
       FROM text_rows JOIN article USING (pmid)""",
    ARTICLES,
)
def pair_text(spark, d):
    rows = writers.attach_text(views.text_dataset(spark, d), views.articles(spark, d))
    pair = text.pair_text(F.concat(F.lit("Language "), "label"), F.col("text"))
    return rows.select("label", "pmid", pair.alias("p")).select(
        "label", "pmid", "p.label_name", F.md5("p.text").alias("text_md5")
    )


@query(
    """SELECT vec_id, round(1/(1+exp(-embedding[1]::DOUBLE*10)), 8) AS prob,
              (1/(1+exp(-embedding[1]::DOUBLE*10)) >= 0.5::DOUBLE)::INTEGER AS pred FROM embeddings"""
)
def sigmoid_threshold(spark, d):
    prob = numeric.sigmoid(F.col("embedding")[0].cast("double") * 10)
    return views.table(spark, d, "embeddings").select(
        "vec_id", rounded(prob, "prob"), numeric.at_threshold(prob, 0.5).alias("pred")
    )


@query(
    """SELECT threshold, count(*) FILTER (prob > threshold) AS n_above FROM scored
       CROSS JOIN (SELECT unnest([0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9,0.905,0.91,0.915,0.92,0.925,0.93,0.935,0.94,
                                  0.945,0.95,0.955,0.96,0.965,0.97,0.975,0.98,0.985,0.99,0.995,1.0])::DOUBLE AS threshold) g GROUP BY threshold""",
    DATASET,
)
def threshold_grid(spark, d):
    grid = numeric.threshold_grid()
    counts = views.scored(spark, d).agg(*[F.count_if(F.col("prob") > F.lit(t)).alias(f"t{i}") for i, t in enumerate(grid)])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("n_above")) for i, t in enumerate(grid)])
    return counts.select(F.inline(rows))


@query(
    """SELECT d.doc_id AS pmid, CASE WHEN l.quality IS NULL THEN 2 ELSE l.quality END AS target
       FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def remap_unknown(spark, d):
    known = views.table(spark, d, "labels").select("doc_id", "quality")
    rows = views.table(spark, d, "documents").select("doc_id").join(known, "doc_id", "left")
    target = numeric.remap_unknown(F.coalesce("quality", F.lit(-1)))
    return rows.select(F.col("doc_id").alias("pmid"), target.alias("target"))


@query(
    """SELECT d.doc_id::VARCHAR AS pmid, md5(text) AS text_md5, lang AS label_name
       FROM documents d JOIN labels l USING (doc_id) WHERE l.quality=1"""
)
def clean_input(spark, d):
    known = views.table(spark, d, "labels").where("quality = 1").select("doc_id", "quality")
    rows = views.table(spark, d, "documents").join(known, "doc_id", "left").select(
        F.col("doc_id").alias("pmid"), F.when(F.col("quality") == 1, F.col("text")).alias("text"), F.col("lang").alias("label_name")
    )
    return tables.clean_input(rows).select("pmid", F.md5("text").alias("text_md5"), "label_name")


@query(
    """SELECT label, total_weak, total_gold, fp, fn, tn, tp, round(fp_ratio,8) AS fp_ratio, round(precision,8) AS precision,
              round(fn_ratio,8) AS fn_ratio, round(recall,8) AS recall, round_even(precision,0) AS precise,
              1-round_even(recall,0) AS low_recall,
              round(CASE WHEN precision+recall>0 THEN 2*precision*recall/(precision+recall) END,8) AS f1 FROM ratios""",
    FREQUENCIES,
)
def noise_ratios(spark, d):
    ratios = labels.noise_ratios(views.label_stats(spark, d))
    return ratios.select(
        "label", "total_weak", "total_gold", "fp", "fn", "tn", "tp",
        *[rounded(c, c) for c in ("fp_ratio", "precision", "fn_ratio", "recall")],
        F.col("precise").cast("double").alias("precise"),
        F.col("low_recall").cast("double").alias("low_recall"),
        rounded("f1", "f1"),
    )


_CODES = """SELECT ui AS descriptor_ui, category, n_hosts,
              array_to_string(list_sort(list_filter([CASE WHEN emersion>0 THEN category||'.0: Emersion' END, CASE WHEN succession>0 THEN category||'.1: Succession' END,
                CASE WHEN subdivision>0 THEN category||'.2: Subdivision' END, CASE WHEN submersion>0 THEN category||'.3: Submersion' END,
                CASE WHEN overtopping>0 THEN category||'.4: Overtopping' END, CASE WHEN detachment>0 THEN category||'.5: Detachment' END], lambda x: x IS NOT NULL)), '~') AS prov_code FROM types"""


@query(_CODES, THESAURUS)
def provenance_strings(spark, d):
    hosts, now = _hosts(spark, d)
    coded = versions.provenance_codes(versions.provenance_types(hosts, now))
    return coded.select("descriptor_ui", "category", "n_hosts", "prov_code")


# --- filters -------------------------------------------------------------------------------------


@query("SELECT pmid, lang FROM article WHERE length(abstract_text)>0", ARTICLES)
def has_abstract(spark, d):
    return art.has_abstract(views.articles(spark, d)).select("pmid", F.col("golden")[0].alias("lang"))


@query(
    """SELECT o_orderkey AS pmid, o_orderdate::DATE::VARCHAR AS date_completed FROM orders
       WHERE year(o_orderdate) IN (1996, 1997) OR (year(o_orderdate)=1998 AND month(o_orderdate) BETWEEN 1 AND 11)"""
)
def completed_between(spark, d):
    found = art.completed_between(views.dated_articles(spark, d), 1996, 1998)
    return found.select("pmid", F.col("date_completed").cast("string").alias("date_completed"))


@query(
    """SELECT DISTINCT pmid FROM panno WHERE label IN (SELECT descendant FROM anc WHERE ancestor IN ('B002','B013')
       UNION ALL SELECT 'B002' UNION ALL SELECT 'B013')""",
    THESAURUS,
)
def annotated_with_any(spark, d):
    now = views.thesaurus(spark, d)
    closure = hierarchy.ancestors(now)
    brands = now.where(F.col("descriptor_ui").isin("B002", "B013"))
    wanted = brands.select(F.col("descriptor_ui").alias("label"))
    return art.annotated_pmids(views.part_annotations(spark, d), wanted, closure)


@query("SELECT ui AS descriptor_ui FROM rec JOIN leaf USING (ui) WHERE n_concepts=1", THESAURUS)
def single_concept_leaves(spark, d):
    return hierarchy.single_concept_leaves(views.thesaurus(spark, d)).select("descriptor_ui")


@query("SELECT ui AS descriptor_ui, introduced AS version FROM rec JOIN leaf USING (ui) WHERE introduced<=1998", THESAURUS)
def keep_leaves(spark, d):
    old, _, now = views.versions3(spark, d)
    return hierarchy.keep_leaves(old, now).select("descriptor_ui", "version")


@query(
    """SELECT ui AS descriptor_ui, count(*) AS n_positions FROM rec JOIN pos USING (ui)
       WHERE k IS NULL OR k%3<>0 GROUP BY ui""",
    THESAURUS,
)
def drop_check_tags(spark, d):
    key = F.regexp_extract("descriptor_ui", r"^P(\d+)", 1).try_cast("long")
    bare = F.coalesce(key % 3 == 0, F.lit(False))
    tags = views.descriptors(spark, d).withColumn("tree_numbers", F.when(~bare, F.col("tree_numbers")))
    kept = hierarchy.drop_check_tags(tags)
    return kept.select("descriptor_ui", F.size("tree_numbers").cast("long").alias("n_positions"))


@query("SELECT ui AS descriptor_ui FROM rec WHERE ui NOT IN (SELECT ui FROM pos WHERE tn LIKE 'V%')", THESAURUS)
def drop_category(spark, d):
    return hierarchy.drop_category(views.descriptors(spark, d), "V").select("descriptor_ui")


@query(
    """SELECT 'recall' AS metric, label, fp, fn FROM ratios WHERE recall BETWEEN 0.4 AND 0.6 AND fn>=50
       UNION ALL SELECT 'precision', label, fp, fn FROM ratios WHERE precision BETWEEN 0.7 AND 0.8 AND fp>=20""",
    FREQUENCIES,
)
def select_by_noise(spark, d):
    ratios = labels.noise_ratios(views.label_stats(spark, d))
    missed = labels.select_by_noise(ratios, "recall", 0.4, 0.6, 50).withColumn("metric", F.lit("recall"))
    wrong = labels.select_by_noise(ratios, "precision", 0.7, 0.8, 20).withColumn("metric", F.lit("precision"))
    return missed.unionByName(wrong).select("metric", "label", "fp", "fn")


@query(
    f"""SELECT 'some found' AS focus, {PER_LABEL} FROM nwl WHERE label IN ('DSMALL_Brand#3','DPROMO_Brand#1') GROUP BY label
        UNION ALL SELECT 'none found', {PER_LABEL} FROM nwl GROUP BY label""",
    DATASET,
)
def focus_labels(spark, d):
    rows = views.dataset(spark, d)
    known = views.label_parent(spark, d).where(F.col("label").isin("DSMALL_Brand#3", "DPROMO_Brand#1", "Dnone"))
    unknown = views.label_parent(spark, d).select(F.concat(F.lit("no "), "label").alias("label"))
    some = per_label(sampling.focus_labels(rows, known)).withColumn("focus", F.lit("some found"))
    none = per_label(sampling.focus_labels(rows, unknown)).withColumn("focus", F.lit("none found"))
    return some.unionByName(none).select("focus", "label", "n", "sum_pmid")


@query("SELECT k, name, year_to FROM newest", THESAURUS)
def newest_host_only(spark, d):
    rows = views.descriptors(spark, d).where(F.startswith("descriptor_ui", F.lit("P")))
    key = F.substring("descriptor_ui", 2, 20).cast("long")
    kept = rows.select(key.alias("k"), F.explode(versions.newest_entries(F.col("previous_indexing"))).alias("e"))
    return kept.select("k", "e.name", "e.year_to")


def _use_cases(spark, d):
    old, new, now = views.versions3(spark, d)
    added = versions.new_descriptors(old, new, now)
    exceptions = views.scr_exceptions(spark, d)
    hosts = materialize(versions.provenance_hosts(added, old, views.scrs(spark, d), now, exceptions), "hosts")
    cases = curation.describe_introductions(added, hosts, now)
    annotated = views.part_annotations(spark, d).join(views.dated_articles(spark, d), "pmid")
    # Read several times below. The lists of the hosts' branches, as long as labels times members, are in no result here.
    cases = materialize(cases.drop("extended_hosts"), "use-cases")
    return curation.select_use_cases(
        cases, hosts, now, annotated, _part_occurrence(spark, d), _part_cuis(spark, d),
        old_year=views.OLD_VERSION, new_year=views.NEW_VERSION, now_year=views.NOW_VERSION, first_year=1995,
        upper=_UPPER, weak_threshold=_WEAK_THRESHOLD,
    )


_UPPER, _WEAK_THRESHOLD = 800, 2


def _part_occurrence(spark, d):
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    rows = views.table(spark, d, "lineitem").where((flag == "R") | ((flag == "A") & (line % 2 == 1)))
    return rows.select(
        F.col("l_orderkey").alias("pmid"),
        F.concat(F.lit("CP"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("cui"),
        F.col("l_linenumber").alias("entity_id"),
    )


def _part_cuis(spark, d):
    key = F.col("p_partkey")
    ui = F.concat(F.lit("P"), F.lpad(key.cast("string"), 9, "0"))
    return views.table(spark, d, "part").select(ui.alias("label"), F.when(key % 3 != 0, F.concat(F.lit("C"), ui)).alias("cui"))


_PERIOD = """
own_gold AS (SELECT label AS ui, count(DISTINCT pmid) AS n FROM dated
             WHERE year(date_completed)=1999 OR (year(date_completed)=2000 AND month(date_completed)<=11) GROUP BY label),
own_train AS (SELECT label AS ui, count(DISTINCT pmid) AS n FROM dated
              WHERE year(date_completed) BETWEEN 1995 AND 1997 OR (year(date_completed)=1998 AND month(date_completed)<=11) GROUP BY label),
ph_train AS (SELECT DISTINCT phex.ui, pmid FROM phex JOIN dated ON member=label
             WHERE year(date_completed)=1997 OR (year(date_completed)=1998 AND month(date_completed)<=11)),
ph_test AS (SELECT DISTINCT phex.ui, pmid FROM phex JOIN dated ON member=label
            WHERE year(date_completed) BETWEEN 1999 AND 2000 OR (year(date_completed)=2001 AND month(date_completed)<=11)),
weak_train AS (SELECT ui, count(DISTINCT p.pmid) AS n FROM ph_train p JOIN pcui ON pcui.label=p.ui JOIN pocc o ON o.pmid=p.pmid AND o.cui=pcui.cui GROUP BY ui)
"""

_CASES = f"""
coded AS ({_CODES}),
cases AS (SELECT a.ui AS descriptor_ui, c.prov_code, a.n_concepts, coalesce(g.n,0) AS test_gold, coalesce(t.n,0) AS train,
                 CASE WHEN pcui.cui IS NOT NULL AND EXISTS (SELECT 1 FROM phex WHERE phex.ui=a.ui) THEN coalesce(w.n,0)
                      WHEN pcui.cui IS NOT NULL THEN 0 END AS train_weak,
                 coalesce(o.n,0) AS train_gold, coalesce(s.n,0) AS test
          FROM added a JOIN coded c ON c.descriptor_ui=a.ui
          LEFT JOIN own_gold g ON g.ui=a.ui LEFT JOIN own_train o ON o.ui=a.ui
          LEFT JOIN (SELECT ui, count(*) AS n FROM ph_train GROUP BY ui) t ON t.ui=a.ui
          LEFT JOIN (SELECT ui, count(*) AS n FROM ph_test GROUP BY ui) s ON s.ui=a.ui
          LEFT JOIN weak_train w ON w.ui=a.ui LEFT JOIN pcui ON pcui.label=a.ui)
"""


@query(
    f"""SELECT descriptor_ui, prov_code, test_gold, train, train_weak, train_gold, test,
               CASE WHEN prov_code<>'1.2: Subdivision' THEN '0: No (old concept) subdivision' WHEN n_concepts>1 THEN '2: Cs > 1'
                    WHEN descriptor_ui NOT IN (SELECT ui FROM leaf) THEN '3: not a leaf' WHEN test_gold<10 THEN '4: testGold < 10'
                    WHEN train<10 THEN '5: train < 10' WHEN train>{_UPPER} THEN '6: train > {_UPPER}'
                    WHEN train_weak IS NULL OR train_weak<{_WEAK_THRESHOLD} THEN '7: trainWS < {_WEAK_THRESHOLD}' ELSE 'OK' END AS level FROM cases""",
    THESAURUS + "," + _PERIOD + "," + _CASES,
)
def select_use_cases(spark, d):
    return _use_cases(spark, d).select(
        "descriptor_ui", "prov_code", "test_gold", "train", "train_weak", "train_gold", "test", "level"
    )


# --- joins ---------------------------------------------------------------------------------------


@query("SELECT ui AS descriptor_ui, name AS descriptor_name FROM added", THESAURUS)
def new_descriptors(spark, d):
    return versions.new_descriptors(*views.versions3(spark, d)).select("descriptor_ui", "descriptor_name")


@query("SELECT ui AS descriptor_ui FROM rec WHERE introduced<=1998", THESAURUS)
def existing_in(spark, d):
    old, _, now = views.versions3(spark, d)
    return versions.existing_in(now, old).select("descriptor_ui")


@query("SELECT label, parent FROM par", THESAURUS)
def parents(spark, d):
    return hierarchy.label_parents(views.thesaurus(spark, d))


@query("SELECT ancestor, descendant FROM anc", THESAURUS)
def descendants(spark, d):
    return hierarchy.ancestors(views.thesaurus(spark, d))


@query(
    """SELECT label, count(DISTINCT member) AS n_members, min(member) AS first_member, max(member) AS last_member,
              bool_or(member=label) AS has_itself
       FROM par JOIN (SELECT ancestor AS parent, descendant AS member FROM anc UNION ALL SELECT ui, ui FROM rec) b USING (parent)
       GROUP BY label""",
    THESAURUS,
)
def parents_plus(spark, d):
    label_scope, members = hierarchy.parents_plus(views.thesaurus(spark, d))
    sizes = members.groupBy("scope").agg(
        F.count("*").alias("n_members"), F.min("member").alias("first_member"), F.max("member").alias("last_member")
    )
    itself = members.withColumnRenamed("member", "label").withColumn("_self", F.lit(True))
    return label_scope.join(sizes, "scope").join(itself, ["scope", "label"], "left").select(
        "label", "n_members", "first_member", "last_member", F.coalesce("_self", F.lit(False)).alias("has_itself")
    )


@query(
    """SELECT h.ui AS descriptor_ui, h.host_ui, string_agg(DISTINCT kind, '.' ORDER BY kind) AS relations FROM (
         SELECT DISTINCT hosts.ui, host_ui, CASE WHEN host_ui IS NULL THEN 'und' WHEN starts_with(m.tn, t.tn||'.') THEN 'anc'
                WHEN starts_with(t.tn, m.tn||'.') THEN 'des' ELSE 'unr' END AS kind
         FROM hosts JOIN pos m ON m.ui=hosts.ui LEFT JOIN pos t ON t.ui=hosts.host_ui WHERE hosts.host_name IS NOT NULL) h GROUP BY h.ui, h.host_ui""",
    THESAURUS,
)
def hierarchical_relations(spark, d):
    hosts, now = _hosts(spark, d)
    pairs = hosts.where("host_name IS NOT NULL").select("descriptor_ui", "host_ui").distinct()
    related = hierarchy.hierarchical_relations(pairs, now)
    return related.select("descriptor_ui", "host_ui", F.array_join("relations", ".").alias("relations"))


@query(
    """SELECT a.ui AS descriptor_ui, o.host_ui, o.host_name, CASE WHEN o.ui IS NOT NULL THEN 'NRW' END AS relation
       FROM added a LEFT JOIN old_host o USING (ui)""",
    THESAURUS,
)
def previous_concept_host(spark, d):
    old, new, now = views.versions3(spark, d)
    return versions.previous_concept_host(versions.new_descriptors(old, new, now), old)


@query("SELECT ui AS descriptor_ui, scr_ui, found_by FROM found", THESAURUS)
def previous_scr(spark, d):
    added = versions.new_descriptors(*views.versions3(spark, d))
    return versions.previous_scr(added, views.scrs(spark, d), views.scr_exceptions(spark, d))


def _fuzzy_inputs(spark, d):
    """Names of the new labels against the other terms: part names in another word order and number."""
    added = versions.new_descriptors(*views.versions3(spark, d))
    terms = added.select(F.col("descriptor_name").alias("term"))
    key = F.col("p_partkey")
    turned = F.concat(key.cast("string"), F.lit(", "), F.regexp_extract("p_name", r"(\S+)$", 1), F.lit(" "), F.regexp_extract("p_name", r"^(\S+)", 1))
    candidates = views.table(spark, d, "part").select(
        F.when(key % 2 == 0, F.concat(turned, F.lit(" "), "p_type")).otherwise(turned).alias("candidate")
    )
    return terms, candidates


_FUZZY = """,
terms AS (SELECT DISTINCT name AS term, lower(regexp_replace(name,'[^a-zA-Z0-9]','','g')) AS t, list_filter(string_split_regex(lower(trim(name)),'[^a-zA-Z0-9]'), lambda x: x<>'') AS tp FROM added),
cands AS (SELECT DISTINCT candidate, lower(regexp_replace(candidate,'[^a-zA-Z0-9]','','g')) AS c, list_filter(string_split_regex(lower(trim(candidate)),'[^a-zA-Z0-9]'), lambda x: x<>'') AS cp
          FROM (SELECT p_partkey||', '||regexp_extract(p_name,'([^ ]+)$',1)||' '||regexp_extract(p_name,'^([^ ]+)',1)||(CASE WHEN p_partkey%2=0 THEN ' '||p_type ELSE '' END) AS candidate FROM part)),
crossed AS (SELECT *, levenshtein(t, c) AS distance, len(cp)-len(tp) AS extra,
                   len(list_filter(list_distinct(tp), lambda p: len(list_filter(cp, lambda y: y=p)) < len(list_filter(tp, lambda z: z=p))))=0 AS contained
            FROM terms CROSS JOIN cands)"""


@query(
    """SELECT term, candidate, 'distance' AS how, distance::INTEGER AS score, true AS reported
       FROM (SELECT *, min(distance) OVER (PARTITION BY term) AS best FROM crossed) WHERE distance=best
       UNION ALL
       SELECT term, candidate, 'parts', extra::INTEGER, extra=0 OR n_extra<=10 OR extra=fewest
       FROM (SELECT *, count(*) FILTER (extra>0) OVER (PARTITION BY term) AS n_extra, min(extra) FILTER (extra>0) OVER (PARTITION BY term) AS fewest
             FROM crossed WHERE contained)""",
    THESAURUS + _FUZZY,
)
def suggest_fuzzy_matches(spark, d):
    return matching.suggest_fuzzy_matches(*_fuzzy_inputs(spark, d))


@query("SELECT label, (SELECT min(cui) FROM cross_walk WHERE source_code=label AND source='MAIN') AS cui FROM lab", ANNOTATIONS)
def label_to_cui(spark, d):
    known = views.label_parent(spark, d).select("label", F.col("label").alias("concept_ui"))
    return art.label_cui(known, views.crosswalk(spark, d), "MAIN")


@query(f"SELECT {PER_LABEL} FROM golden WHERE label IN (SELECT label FROM lab WHERE parent IN ('TSMALL','TPROMO')) GROUP BY label", ANNOTATIONS)
def golden_in_scope(spark, d):
    chosen = views.label_parent(spark, d).where(F.col("parent").isin("TSMALL", "TPROMO"))
    return per_label(art.golden_in_scope(views.golden(spark, d), chosen))


@query("SELECT pmid, label FROM text_weak", ARTICLES)
def weak_labels(spark, d):
    return art.weak_labels(views.text_occurrence(spark, d), views.text_labels(spark, d))


@query(f"SELECT {PER_LABEL} FROM valid GROUP BY label", ANNOTATIONS)
def valid_labels(spark, d):
    return per_label(labels.valid_labels(views.golden(spark, d), *views.scopes(spark, d)))


@query(f"SELECT {PER_LABEL} FROM valid GROUP BY label", ANNOTATIONS)
def read_scopes(spark, d):
    """The valid labels again, from scopes that were written and read back."""
    path = new_folder(spark, "scopes")
    writers.write_scopes(*views.scopes(spark, d), path)
    return per_label(labels.valid_labels(views.golden(spark, d), *tables.read_scopes(spark, path)))


@query(f"SELECT {PER_LABEL} FROM weak GROUP BY label", ANNOTATIONS)
def filter_weak(spark, d):
    return per_label(labels.filter_weak(*views.annotation_inputs(spark, d)))


@query(
    """SELECT coalesce(g.pmid, w.pmid) AS pmid, coalesce(g.label, w.label) AS label,
              CASE WHEN w.pmid IS NULL THEN 'FN' WHEN g.pmid IS NULL THEN 'FP' ELSE 'TP' END AS outcome
       FROM golden g FULL JOIN weak w ON g.pmid=w.pmid AND g.label=w.label""",
    ANNOTATIONS,
)
def compare_labels(spark, d):
    return labels.compare_labels(*views.annotation_inputs(spark, d))


@query(
    """SELECT f.label, f.fp, f.fn, CASE WHEN parent<>'TLARGE' THEN parent END AS parent
       FROM freq f JOIN lab USING (label)""",
    FREQUENCIES,
)
def attach_label_info(spark, d):
    info = views.label_parent(spark, d).where("parent <> 'TLARGE'").withColumnRenamed("label", "descriptor_ui")
    return labels.attach_label_info(views.label_stats(spark, d), info).select("label", "fp", "fn", "parent")


def _added(now):
    old, new = (now.where(F.col("version") <= v) for v in (views.OLD_VERSION, views.NEW_VERSION))
    return versions.new_descriptors(old, new, now)


def _hosts(spark, d):
    """Former hosts of the new labels, and the thesaurus they are looked up in; both written once."""
    old, new, now = views.versions3(spark, d)
    added = versions.new_descriptors(old, new, now)
    hosts = versions.provenance_hosts(added, old, views.scrs(spark, d), now, views.scr_exceptions(spark, d))
    return materialize(hosts, "hosts"), now


@query(
    """SELECT ui AS descriptor_ui, (SELECT string_agg(DISTINCT host_ui, '~' ORDER BY host_ui) FROM hosts WHERE hosts.ui=phex.ui) AS host_uis,
              count(*) AS n_extended FROM phex GROUP BY ui""",
    THESAURUS,
)
def extended_hosts(spark, d):
    hosts, now = _hosts(spark, d)
    return versions.extended_host_counts(hosts, now).drop("extended_hosts").toDF("descriptor_ui", "host_uis", "n_extended")


@query(
    """SELECT phex.ui AS label, count(DISTINCT pmid) AS n, (sum(DISTINCT pmid))::BIGINT AS sum_pmid FROM phex JOIN dated ON member=label
       WHERE year(date_completed)=1997 OR (year(date_completed)=1998 AND month(date_completed)<=11) GROUP BY phex.ui""",
    THESAURUS,
)
def articles_of_hosts(spark, d):
    hosts, now = _hosts(spark, d)
    annotated = views.part_annotations(spark, d).join(views.dated_articles(spark, d), "pmid")
    label_scope, scope_hosts, branches = versions.extended_hosts(hosts, now)
    found = art.articles_of_hosts(art.completed_between(annotated, 1997, 1998), scope_hosts, branches)
    per_scope = found.groupBy("scope").agg(F.count("*").alias("n"), F.sum("pmid").alias("sum_pmid"))
    return label_scope.join(per_scope, "scope").select("label", "n", "sum_pmid")


@query(
    f"""SELECT base, {PER_LABEL}, sum(new_pred*gold)::BIGINT AS tp, sum(new_pred)::BIGINT AS predicted FROM (
          SELECT b.*, greatest(b.pred, CASE WHEN s.prob > 0.8::DOUBLE THEN 1 ELSE 0 END) AS new_pred
          FROM base b LEFT JOIN scored s ON s.pmid=b.pmid AND s.label=b.label) GROUP BY base, label""",
    DATASET,
)
def relabel(spark, d):
    base, scored = views.base_and_scored(spark, d)
    new = evaluate.relabel(base, scored, 0.8, views.BASES)
    counts = per_label(new, *[F.sum(b).alias(b) for b in views.BASES], *[F.sum(F.col("gold") * F.col(b)).alias(f"tp_{b}") for b in views.BASES])
    methods = F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("predicted"), F.col(f"tp_{b}").alias("tp")) for b in views.BASES])
    return counts.select("label", "n", "sum_pmid", F.inline(methods))


@query(
    """SELECT ui AS descriptor_ui, name AS descriptor_name, n AS train_weak FROM rec
       JOIN (SELECT 'P'||lpad(l_partkey::VARCHAR,9,'0') AS ui, count(*) AS n FROM lineitem WHERE l_returnflag='R' GROUP BY 1) USING (ui)""",
    THESAURUS,
)
def update_counts(spark, d):
    cases = views.descriptors(spark, d).select("descriptor_ui", "descriptor_name", F.lit(-1).cast("long").alias("train_weak"))
    ui = F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))
    counts = views.table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(ui.alias("descriptor_ui")).agg(F.count("*").alias("n"))
    return stats.update_counts(cases, counts, "train_weak")


@query(
    """SELECT q.query, t.term_ui AS descriptor_ui, t.term_ui IS NOT NULL AS "exists"
       FROM (SELECT DISTINCT unnest([p_name||' '||p_partkey, 'alias '||p_partkey, p_brand, p_type]) AS query FROM part) q LEFT JOIN term t ON t.term=q.query
       UNION ALL SELECT 'ui '||'P'||lpad((p_partkey*2)::VARCHAR,9,'0'), r.ui, r.ui IS NOT NULL FROM part LEFT JOIN rec r ON r.ui='P'||lpad((p_partkey*2)::VARCHAR,9,'0')""",
    THESAURUS,
)
def lookup_labels(spark, d):
    part = views.table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    now = views.descriptors(spark, d)
    named = F.array(F.concat("p_name", F.lit(" "), key), F.concat(F.lit("alias "), key), F.col("p_brand"), F.col("p_type"))
    terms = part.select(F.explode(named).alias("query")).distinct()
    uis = part.select(F.concat(F.lit("P"), F.lpad((F.col("p_partkey") * 2).cast("string"), 9, "0")).alias("query"))
    by_ui = hierarchy.lookup_labels(uis, now, "ui").withColumn("query", F.concat(F.lit("ui "), "query"))
    return hierarchy.lookup_labels(terms, now, "term").unionByName(by_ui)


# --- aggregations --------------------------------------------------------------------------------


@query("SELECT pmid, cui, count(entity_id) AS n_occurrences FROM occ GROUP BY pmid, cui", ANNOTATIONS)
def cui_counts(spark, d):
    return art.cui_counts(views.occurrence(spark, d))


@query(
    """SELECT cui, count(DISTINCT pmid) AS n_articles FROM occ WHERE pmid IN (SELECT o_orderkey FROM orders WHERE o_orderpriority='5-LOW') GROUP BY cui""",
    ANNOTATIONS,
)
def articles_with_cui(spark, d):
    chosen = views.table(spark, d, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("pmid"))
    return art.article_counts_by_cui(views.occurrence(spark, d), chosen)


@query(
    """SELECT o_orderkey AS pmid, (o_orderkey IN (SELECT pmid FROM occ WHERE cui IN (SELECT 'C'||label FROM lab WHERE parent='TSMALL')))::INTEGER AS found FROM orders""",
    ANNOTATIONS,
)
def cui_list_in_article(spark, d):
    chosen = views.label_parent(spark, d).where("parent = 'TSMALL'").select(F.concat(F.lit("C"), "label").alias("cui"))
    return art.cui_list_in_article(views.dated_articles(spark, d), views.occurrence(spark, d), chosen)


@query(
    """SELECT l.label, CASE WHEN l.label NOT LIKE '%#7' THEN coalesce(c.n,0) END AS n_weak,
              CASE WHEN l.label LIKE '%#7' THEN true ELSE coalesce(c.n,0)<200 END AS below
       FROM lab l LEFT JOIN (SELECT w.label, count(DISTINCT w.pmid) AS n FROM weak w GROUP BY w.label) c USING (label)""",
    ANNOTATIONS,
)
def below_weak_threshold(spark, d):
    gold, _, label_scope, members = views.annotation_inputs(spark, d)
    cuis = art.label_cui(
        label_scope.select("label", F.col("label").alias("concept_ui")), views.crosswalk(spark, d), "MAIN"
    )
    hosts = label_scope.select("scope", F.col("scope").alias("parent")).distinct()
    branches = members.withColumnRenamed("scope", "parent")
    counts = art.weak_counts_of_hosts(gold, label_scope, hosts, branches, views.occurrence(spark, d), cuis)
    return art.below_weak_threshold(counts, 200).select("label", "n_weak", "below")


@query("SELECT label, total_weak, fp, fn, total_gold, tn FROM freq", FREQUENCIES)
def label_frequencies(spark, d):
    return views.label_stats(spark, d)


_GROUPS = """,
numbered AS (SELECT label, parent, ((row_number() OVER (ORDER BY label)) - 1)//40 AS grp FROM lab),
docs AS (SELECT o_orderkey AS pmid FROM orders),
dg AS (SELECT pmid, grp FROM docs CROSS JOIN (SELECT DISTINCT grp FROM numbered)),
gv AS (SELECT DISTINCT v.pmid, n.grp FROM valid_parent v JOIN numbered n USING (parent)),
gg AS (SELECT g.pmid, n.grp, count(*) AS n FROM golden g JOIN numbered n USING (label) GROUP BY ALL),
gw AS (SELECT w.pmid, n.grp, count(*) AS n FROM weak w JOIN numbered n USING (label) GROUP BY ALL),
gfp AS (SELECT DISTINCT w.pmid, n.grp FROM weak w ANTI JOIN golden USING (pmid, label) JOIN numbered n ON n.label=w.label),
gfn AS (SELECT DISTINCT g.pmid, n.grp FROM golden g ANTI JOIN weak USING (pmid, label) JOIN numbered n ON n.label=g.label),
aw AS (SELECT pmid, count(*) AS n FROM weak0 GROUP BY pmid),
doc AS (SELECT dg.pmid, dg.grp, gv.pmid IS NOT NULL AS valid, gg.pmid IS NOT NULL AS gold, gw.pmid IS NOT NULL AS weak,
               gfp.pmid IS NOT NULL AS fp, gfn.pmid IS NOT NULL AS fn, coalesce(gw.n,0) AS kept_weak, coalesce(aw.n,0) AS all_weak,
               """ + H.format("'u10|'||dg.grp||'|'||dg.pmid") + """/4294967296::DOUBLE <= 0.5::DOUBLE AS drawn
        FROM dg LEFT JOIN gv ON gv.pmid=dg.pmid AND gv.grp=dg.grp LEFT JOIN gg ON gg.pmid=dg.pmid AND gg.grp=dg.grp
        LEFT JOIN gw ON gw.pmid=dg.pmid AND gw.grp=dg.grp LEFT JOIN gfp ON gfp.pmid=dg.pmid AND gfp.grp=dg.grp
        LEFT JOIN gfn ON gfn.pmid=dg.pmid AND gfn.grp=dg.grp LEFT JOIN aw ON aw.pmid=dg.pmid)"""


@query(
    """SELECT grp::INTEGER AS grp, count(*) AS considered, count(*) FILTER (valid AND NOT weak AND (fn OR drawn)) AS selected,
              count(*) FILTER (valid AND NOT weak AND NOT (fn OR drawn)) AS skipped, count(*) FILTER (kept_weak<>all_weak) AS weak_filtered,
              count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (gold) AS golden_positive, count(*) FILTER (NOT gold) AS golden_negative,
              count(*) FILTER (weak) AS weak_positive, count(*) FILTER (NOT weak) AS weak_negative,
              count(*) FILTER (fp) AS fp_docs, count(*) FILTER (fn) AS fn_docs FROM doc GROUP BY grp""",
    ANNOTATIONS + _GROUPS,
)
def dataset_counters(spark, d):
    gold, weak_rows, label_scope, members = views.annotation_inputs(spark, d)
    groups = sampling.chunk_labels(views.label_parent(spark, d), 40)
    return labels.dataset_counters(
        views.dated_articles(spark, d), gold, weak_rows, label_scope, members, groups, ratio_kept=0.5
    )


def _yearly(spark, d):
    """Every line item is a record of its order's yearly train or test dataset.

    The datasets of the articles are written once, in buckets, and whatever meets them is shuffled into as many.
    """
    drawn = views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("pmid"),
        F.year("o_orderdate").alias("year"),
        F.when(numeric.draw(F.lit("y|"), F.col("o_orderkey")) <= F.lit(0.3), "test").otherwise("train").alias("split"),
    )
    dated = views.in_article_buckets(spark, d, drawn, "dataset-articles")
    records_ = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pmid")).join(dated, "pmid")
    gold = views.golden(spark, d).join(dated, "pmid")
    weak_rows = views.weak(spark, d).join(dated, "pmid")
    in_scope = views.label_parent(spark, d).where(F.col("parent").isin("TSMALL", "TECONOMY"))
    sets = dated.select("year", "split").distinct()
    scope = F.array(F.lit("TSMALL"), F.lit("TECONOMY"))
    chosen = materialize(sets.withColumn("parent", F.explode(scope)).join(in_scope, "parent").select("year", "split", "label"), "labels-of-datasets")
    leaves = in_scope.where(~F.endswith("label", F.lit("#1"))).select("label")
    return records_, gold, weak_rows.join(in_scope.select("label"), "label", "left_semi"), chosen, leaves


_YEARLY = """,
dated AS (SELECT o_orderkey AS pmid, year(o_orderdate)::INTEGER AS year, CASE WHEN """ + H.format("'y|'||o_orderkey") + """/4294967296::DOUBLE <= 0.3::DOUBLE THEN 'test' ELSE 'train' END AS split FROM orders),
sets AS (SELECT DISTINCT year, split FROM dated),
scope AS (SELECT label FROM lab WHERE parent IN ('TSMALL','TECONOMY')),
records AS (SELECT d.* FROM lineitem JOIN dated d ON pmid=l_orderkey),
sg AS (SELECT d.*, label FROM golden JOIN dated d USING (pmid) SEMI JOIN scope USING (label)),
sw AS (SELECT d.*, label FROM weak0 JOIN dated d USING (pmid) SEMI JOIN scope USING (label))"""


_ARTICLE_STATISTICS = """SELECT s.year, s.split, (SELECT count(*) FROM records r WHERE r.year=s.year AND r.split=s.split) AS n_articles,
              (SELECT count(*) FROM (SELECT pmid FROM records r WHERE r.year=s.year AND r.split=s.split GROUP BY pmid HAVING count(*)>1)) AS n_duplicated_ids,
              (SELECT count(DISTINCT pmid) FROM sg WHERE sg.year=s.year AND sg.split=s.split) AS n_labelled,
              (SELECT count(*) FROM (SELECT pmid FROM sg WHERE sg.year=s.year AND sg.split=s.split GROUP BY pmid HAVING count(DISTINCT label)>1)) AS n_multi_labelled,
              (SELECT count(DISTINCT pmid) FROM sw WHERE sw.year=s.year AND sw.split=s.split) AS n_weak_labelled,
              (SELECT count(*) FROM scope) AS n_labels, (SELECT count(*) FROM scope WHERE label NOT LIKE '%#1') AS n_leaves FROM sets s"""


@query(_ARTICLE_STATISTICS, ANNOTATIONS + _YEARLY)
def article_statistics(spark, d):
    return curation.dataset_statistics(*_yearly(spark, d))[0]


@query(
    """SELECT 'year,split' AS level, year, split, n_articles, n_duplicated_ids, n_labelled, n_multi_labelled, n_weak_labelled, n_labels, n_leaves FROM stat
       UNION ALL SELECT 'split', NULL, split, sum(n_articles)::BIGINT, sum(n_duplicated_ids)::BIGINT, sum(n_labelled)::BIGINT,
                        sum(n_multi_labelled)::BIGINT, sum(n_weak_labelled)::BIGINT, any_value(n_labels), any_value(n_leaves) FROM stat GROUP BY split
       UNION ALL SELECT '', NULL, NULL, sum(n_articles)::BIGINT, sum(n_duplicated_ids)::BIGINT, sum(n_labelled)::BIGINT,
                        sum(n_multi_labelled)::BIGINT, sum(n_weak_labelled)::BIGINT, any_value(n_labels), any_value(n_leaves) FROM stat""",
    ANNOTATIONS + _YEARLY + f",\nstat AS ({_ARTICLE_STATISTICS})",
)
def sum_up_datasets(spark, d):
    """Statistics of the yearly datasets, written as the sum-up table and read back."""
    path = new_folder(spark, "sum-up")
    writers.write_sum_up(curation.sum_up_datasets(*_yearly(spark, d)), path)
    return tables.read_sum_up(spark, path)


@query(
    """SELECT s.year, s.split, scope.label, count(DISTINCT sg.pmid) AS n_golden, count(DISTINCT sw.pmid) AS n_weak
       FROM sets s CROSS JOIN scope LEFT JOIN sg ON sg.year=s.year AND sg.split=s.split AND sg.label=scope.label
       LEFT JOIN sw ON sw.year=s.year AND sw.split=s.split AND sw.label=scope.label GROUP BY ALL""",
    ANNOTATIONS + _YEARLY,
)
def articles_per_label(spark, d):
    return curation.dataset_statistics(*_yearly(spark, d))[1]


@query(
    """SELECT pmid, count(DISTINCT label) AS n_labels FROM golden WHERE parent IN ('TSMALL','TECONOMY') GROUP BY pmid HAVING count(DISTINCT label)>1""",
    ANNOTATIONS,
)
def articles_with_many_labels(spark, d):
    chosen = views.label_parent(spark, d).where(F.col("parent").isin("TSMALL", "TECONOMY"))
    return stats.articles_with_many_labels(views.golden(spark, d), chosen)


@query("SELECT n_labels, count(*) AS n_docs FROM (SELECT pmid, count(*) AS n_labels FROM golden GROUP BY pmid) GROUP BY n_labels", ANNOTATIONS)
def labels_per_document(spark, d):
    return labels.labels_per_document(views.golden(spark, d))


@query(
    """SELECT combination, count(*) AS n_docs FROM (SELECT string_agg(label, ' ' ORDER BY label) AS combination, count(*) AS n
         FROM (SELECT DISTINCT pmid, label FROM golden) GROUP BY pmid) WHERE n>1 GROUP BY combination""",
    ANNOTATIONS,
)
def label_combinations(spark, d):
    return labels.label_combinations(views.golden(spark, d))


@query("SELECT label, count(*) AS n_rows, sum(target)::BIGINT AS n_positive FROM nwl GROUP BY label", DATASET)
def label_sums(spark, d):
    return sampling.label_sums(views.dataset(spark, d))


@query(
    """SELECT 'descriptor' AS kind, avg(n_concepts) AS avg_concepts FROM rec WHERE introduced<=1998
       UNION ALL SELECT 'scr', 1.0::DOUBLE FROM (SELECT count(*) FROM scr) UNION ALL SELECT 'none', 0.0::DOUBLE""",
    THESAURUS,
)
def concepts_per_record(spark, d):
    old = views.descriptors(spark, d).where(F.col("version") <= views.OLD_VERSION)
    averages = [
        versions.concepts_per_record(rows).select(F.lit(kind).alias("kind"), "avg_concepts")
        for kind, rows in (("descriptor", old), ("scr", views.scrs(spark, d)), ("none", old.where("version > 3000")))
    ]
    return averages[0].unionByName(averages[1]).unionByName(averages[2])


@query(
    """SELECT count(*) AS labels, count(*) FILTER (total_weak>=1) AS total_weak_any, count(*) FILTER (total_gold>=1) AS total_gold_any,
              count(*) FILTER (fp>=1) AS fp_any, count(*) FILTER (fn>=1) AS fn_any, count(*) FILTER (total_weak>=50) AS total_weak_many,
              count(*) FILTER (total_gold>=50) AS total_gold_many, count(*) FILTER (fp>=50) AS fp_many, count(*) FILTER (fn>=50) AS fn_many,
              count(*) FILTER (fp>=50 AND fn>=50) AS fp_and_fn_many, count(*) FILTER (precision BETWEEN 0.4 AND 0.6) AS precision_window,
              count(*) FILTER (recall BETWEEN 0.4 AND 0.6) AS recall_window,
              count(*) FILTER (precision BETWEEN 0.4 AND 0.6 AND recall BETWEEN 0.4 AND 0.6) AS both_windows FROM ratios""",
    FREQUENCIES,
)
def selection_funnel(spark, d):
    return labels.selection_funnel(labels.noise_ratios(views.label_stats(spark, d)))


@query(
    """SELECT ui AS descriptor_ui, category, relation, n_hosts, emersion, succession, subdivision, submersion, overtopping, detachment FROM types""",
    THESAURUS,
)
def provenance_types(spark, d):
    hosts, now = _hosts(spark, d)
    return versions.provenance_types(hosts, now)


@query("SELECT ui AS descriptor_ui, category, host_name, host_ui, relation FROM hosts", THESAURUS)
def provenance_category(spark, d):
    return _hosts(spark, d)[0]


@query(
    """SELECT ui AS descriptor_ui, count(*) FILTER (host_ui IS NOT NULL AND n>1) AS n_multi,
              coalesce(string_agg(host_ui, '~' ORDER BY host_ui) FILTER (host_ui IS NOT NULL AND n>1), '') AS multi_hosts,
              string_agg(kinds, '~' ORDER BY kinds) AS host_relations
       FROM (SELECT i, ui, any_value(host_ui) AS host_ui, count(DISTINCT kind) AS n, string_agg(DISTINCT kind, '.' ORDER BY kind) AS kinds FROM (
              SELECT h.i, h.ui, h.host_ui, CASE WHEN h.host_ui IS NULL THEN 'und' WHEN starts_with(m.tn, t.tn||'.') THEN 'anc'
                WHEN starts_with(t.tn, m.tn||'.') THEN 'des' ELSE 'unr' END AS kind
              FROM (SELECT *, row_number() OVER (ORDER BY ui, host_name) AS i FROM hosts WHERE host_name IS NOT NULL) h
              JOIN pos m ON m.ui=h.ui LEFT JOIN pos t ON t.ui=h.host_ui) GROUP BY i, ui) GROUP BY ui""",
    THESAURUS,
)
def multi_related_hosts(spark, d):
    hosts, now = _hosts(spark, d)
    return versions.host_relations(hosts, now)


@query(
    """SELECT label, split, sum(target)::BIGINT AS class_freq, count(*) AS train_num,
              round((count(*)-sum(target))::DOUBLE/nullif(sum(target),0), 8) AS pos_weight FROM nwl GROUP BY label, split""",
    DATASET,
)
def class_balance(spark, d):
    balance = sampling.class_balance(views.dataset(spark, d), ["label", "split"])
    return balance.select("label", "split", "class_freq", "train_num", rounded("pos_weight", "pos_weight"))


@query(
    """SELECT label, round(n/f, 8) AS inv, round(sqrt(n/f), 8) AS sqrt_inv, round(0.1::DOUBLE/(1-pow(0.9::DOUBLE,f)), 8) AS cb,
              round((n/f)/max(n/f) OVER (), 8) AS inv_by_max
       FROM (SELECT label, count(*)::DOUBLE AS n, sum(target)::DOUBLE AS f FROM nwl WHERE split='train' GROUP BY label)""",
    DATASET,
)
def class_weights(spark, d):
    balance = materialize(sampling.class_balance(views.dataset(spark, d).where("split = 'train'")), "class-balance")
    inv = sampling.class_weights(balance, "inv")
    root = sampling.class_weights(balance, "sqrt_inv").select("label", rounded("weight", "sqrt_inv"))
    cb = sampling.class_weights(balance, "CB", beta=0.9).select("label", rounded("weight", "cb"))
    scaled = sampling.class_weights(balance, "inv", by_max=True).select("label", rounded("weight", "inv_by_max"))
    first = inv.select("label", rounded("weight", "inv"))
    return first.join(root, "label").join(cb, "label").join(scaled, "label")


@query("SELECT user_id AS pmid, count(*) AS n_rows FROM events GROUP BY user_id HAVING count(*)>1")
def duplicate_ids(spark, d):
    return art.duplicate_ids(views.table(spark, d, "events").select(F.col("user_id").alias("pmid")))


@query(
    """SELECT lang, max(n)::INTEGER AS max_words, round(avg(n), 8) AS avg_words
       FROM (SELECT lang, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x<>'')) AS n FROM documents) GROUP BY lang
       UNION ALL SELECT 'all', max(n)::INTEGER, round(avg(n), 8)
       FROM (SELECT len(list_filter(string_split_regex(text, '\\s+'), lambda x: x<>'')) AS n FROM documents)"""
)
def length_stats(spark, d):
    docs = views.table(spark, d, "documents")
    n = text.word_count(F.col("text"))
    per_lang = docs.groupBy("lang").agg(F.max(n).alias("max_words"), F.avg(n).alias("avg_words"))
    total = art.length_stats(docs).select(F.lit("all").alias("lang"), "max_words", "avg_words")
    return per_lang.unionByName(total).select("lang", "max_words", rounded("avg_words", "avg_words"))


@query(
    """SELECT count(*) AS n_articles FROM article WHERE length(abstract_text)>0 AND lang IN ('de','es')
       AND (year(date_completed) IN (1996,1997) OR (year(date_completed)=1998 AND month(date_completed)<=11))""",
    ARTICLES,
)
def search_count(spark, d):
    wanted = views.text_scopes(spark, d)[0].where(F.col("label").isin("de", "es"))
    return art.search_count(views.articles(spark, d), labels=wanted, start=1996, end=1998)


# --- windows, sampling and sets ------------------------------------------------------------------


@query(
    """SELECT user_id AS pmid, ts::DATE::VARCHAR AS date_revised, event_id, event_type FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC, event_id) AS r FROM events) WHERE r=1"""
)
def latest_revision(spark, d):
    revisions = views.table(spark, d, "events").select(
        F.col("user_id").alias("pmid"), F.to_date("ts").alias("date_revised"), "event_id", "event_type"
    )
    newest = art.latest_revision(revisions, "date_revised", "event_id")
    return newest.withColumn("date_revised", F.col("date_revised").cast("string"))


_BITS = H.format("'b42|'||label||'|'||pmid")


@query(
    f"""SELECT label, split, target, count(*) AS n, sum(pmid)::BIGINT AS sum_pmid FROM (
          SELECT *, sum(target) OVER (PARTITION BY label, split) AS pos,
                 row_number() OVER (PARTITION BY label, split, target ORDER BY {_BITS}, pmid) AS rn FROM nwl)
        WHERE target=1 OR rn<=10*pos GROUP BY label, split, target""",
    DATASET,
)
def balance_negatives(spark, d):
    rows = views.dataset(spark, d)
    kept = sampling.balance_negatives(rows, 10, 42)
    return kept.groupBy("label", "split", "target").agg(F.count("*").alias("n"), F.sum("pmid").alias("sum_pmid"))


@query(f"SELECT label, split, count(*) AS n, sum(pmid)::BIGINT AS sum_pmid FROM nwl GROUP BY label, split", DATASET)
def split_rows(spark, d):
    rows = views.dataset(spark, d)
    return rows.groupBy("label", "split").agg(F.count("*").alias("n"), F.sum("pmid").alias("sum_pmid"))


@query(
    f"""SELECT label, target, count(*) AS n, sum(pmid)::BIGINT AS sum_pmid FROM nwl
        WHERE target<>0 OR {H.format("'u10|'||label||'|'||pmid")}/4294967296::DOUBLE <= 0.25::DOUBLE GROUP BY label, target""",
    DATASET,
)
def undersample_negatives(spark, d):
    kept = sampling.undersample_negatives(views.dataset(spark, d), 0.25)
    return kept.groupBy("label", "target").agg(F.count("*").alias("n"), F.sum("pmid").alias("sum_pmid"))


@query("SELECT label, (((row_number() OVER (ORDER BY label)) - 1)//7)::INTEGER AS grp FROM (SELECT DISTINCT name AS label FROM rec)", THESAURUS)
def chunk_labels(spark, d):
    names = views.descriptors(spark, d).select(F.col("descriptor_name").alias("label"))
    return sampling.chunk_labels(names, 7)


@query("SELECT o_orderkey AS pmid, year(o_orderdate)::VARCHAR AS year FROM orders ORDER BY year DESC, pmid")
def order_by_year(spark, d):
    dated = views.dated_articles(spark, d)
    return art.order_by_year(dated.select("pmid", F.year("date_completed").cast("string").alias("year")))


@query("SELECT label, pmid, target FROM text_rows WHERE split<>'test'", ARTICLES)
def shuffle_rows(spark, d):
    return sampling.shuffle_rows(views.text_dataset(spark, d).where("split <> 'test'"), 42).select("label", "pmid", "target")


_RUNS = "m AS (SELECT user_id AS run, day(ts)::INTEGER AS epoch, round(avg(value), 6) AS val_loss FROM events GROUP BY 1, 2)"


@query(
    """SELECT b.run, b.epoch AS best, coalesce((SELECT max(epoch) FROM m WHERE m.run=b.run AND m.epoch<b.epoch), b.epoch) AS previous
       FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) AS r FROM m) b WHERE r=1""",
    _RUNS,
)
def best_epoch(spark, d):
    metrics = views.table(spark, d, "events").groupBy(F.col("user_id").alias("run"), F.day("ts").alias("epoch")).agg(
        F.round(F.avg("value"), 6).alias("val_loss")
    )
    return sampling.best_epoch(metrics)


@query(
    """SELECT pmid, count(*) AS n_common, string_agg(label, ' ' ORDER BY label) AS common FROM (
         SELECT pmid, label FROM golden INTERSECT SELECT pmid, label FROM weak0) GROUP BY pmid""",
    ANNOTATIONS,
)
def common_labels(spark, d):
    return labels.common_labels(views.golden(spark, d), views.weak(spark, d)).select(
        "pmid", F.size("labels").cast("long").alias("n_common"), F.array_join("labels", " ").alias("common")
    )


@query(
    f"""SELECT kind, {PER_LABEL}, sum(target)::BIGINT AS n_positive FROM (
          SELECT 'NWL' AS kind, label, pmid, target FROM nwl
          UNION ALL SELECT 'PWL', w.label, w.pmid, CASE WHEN g.pmid IS NULL THEN 1 ELSE 0 END
          FROM weak w LEFT JOIN golden g ON g.pmid=w.pmid AND g.label=w.label) GROUP BY kind, label""",
    DATASET,
)
def relabel_dataset(spark, d):
    inputs = views.annotation_inputs(spark, d)
    parts = [
        per_label(labels.relabel_dataset(*inputs, kind), F.sum("target").alias("n_positive")).withColumn("kind", F.lit(kind))
        for kind in ("NWL", "PWL")
    ]
    return parts[0].unionByName(parts[1]).select("kind", "label", "n", "sum_pmid", "n_positive")


# --- evaluation ----------------------------------------------------------------------------------

_GRID = """,
steps AS (SELECT unnest([0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9,0.905,0.91,0.915,0.92,0.925,0.93,0.935,0.94,
                         0.945,0.95,0.955,0.96,0.965,0.97,0.975,0.98,0.985,0.99,0.995,1.0])::DOUBLE AS threshold),
swept AS (SELECT b.label, b.base, threshold, b.gold, greatest(b.pred, CASE WHEN s.prob > threshold THEN 1 ELSE 0 END) AS pred
          FROM base b LEFT JOIN scored s ON s.pmid=b.pmid AND s.label=b.label CROSS JOIN steps),
conf AS (SELECT label, base, threshold, count(*) FILTER (gold=0 AND pred=0) AS tn, count(*) FILTER (gold=0 AND pred=1) AS fp,
                count(*) FILTER (gold=1 AND pred=0) AS fn, count(*) FILTER (gold=1 AND pred=1) AS tp FROM swept GROUP BY ALL)"""

_BASE_CONF = """,
bc AS (SELECT label, base, count(*) FILTER (gold=0 AND pred=0) AS tn, count(*) FILTER (gold=0 AND pred=1) AS fp,
              count(*) FILTER (gold=1 AND pred=0) AS fn, count(*) FILTER (gold=1 AND pred=1) AS tp FROM base GROUP BY ALL),
bs AS (SELECT *, coalesce(tp::DOUBLE/nullif(tp+fp,0),0) AS p, coalesce(tp::DOUBLE/nullif(tp+fn,0),0) AS r,
              coalesce(2*tp::DOUBLE/nullif(2*tp+fp+fn,0),0) AS f FROM bc)"""


@query("SELECT label, base, 'hashed' AS model, threshold, tn, fp, fn, tp FROM conf", DATASET + _GRID)
def apply_sweep(spark, d):
    """The base table holds golden and positive rows only; the numbers of valid articles come from the label counts."""
    scored = views.scored(spark, d).withColumn("model", F.lit("hashed"))
    base = views.base_predictions(spark, d).where("gold = 1 OR weak = 1 OR draw = 1")
    valid = views.label_stats(spark, d).select("label", (F.col("total_weak") + F.col("fn") + F.col("tn")).alias("rows"))
    swept = evaluate.apply_sweep(base, scored, views.BASES, ["hashed"], label_rows=valid)
    return swept.select("label", "base", "model", "threshold", "tn", "fp", "fn", "tp")


@query(
    """SELECT c.label, c.base, c.threshold, c.tn, c.fp, c.fn, c.tp,
              round(coalesce(c.tp::DOUBLE/nullif(c.tp+c.fp,0),0),8) AS precision, round(coalesce(c.tp::DOUBLE/nullif(c.tp+c.fn,0),0),8) AS recall,
              round(coalesce(2*c.tp::DOUBLE/nullif(2*c.tp+c.fp+c.fn,0),0),8) AS f1,
              round(p,8) AS base_precision, round(r,8) AS base_recall, round(f,8) AS base_f1
       FROM conf c JOIN bs USING (label, base) WHERE threshold=0.975""",
    DATASET + _GRID + _BASE_CONF,
)
def apply_relabelling(spark, d):
    base, scored = views.base_and_scored(spark, d)
    swept = relabelling.apply_relabelling(base, scored.withColumn("model", F.lit("hashed")), views.BASES, ["hashed"], [0.975])
    scores = ("precision", "recall", "f1")
    return swept.select(
        "label", "base", "threshold", "tn", "fp", "fn", "tp",
        *[rounded(c, c) for c in scores], *[rounded(f"base_{c}", f"base_{c}") for c in scores],
    )


@query(
    """SELECT base, 'hashed' AS model, threshold, round(micro,8) AS micro_f1, round(macro,8) AS macro_f1, round(m0,8) AS base_micro_f1,
              round(a0,8) AS base_macro_f1, round(micro-m0,6) AS micro_gain, round(macro-a0,6) AS macro_gain
       FROM (SELECT base, threshold, 2*sum(tp)::DOUBLE/(2*sum(tp)+sum(fp)+sum(fn)) AS micro,
                    avg(coalesce(2*tp::DOUBLE/nullif(2*tp+fp+fn,0),0)) AS macro FROM conf GROUP BY ALL)
       JOIN (SELECT base, 2*sum(tp)::DOUBLE/(2*sum(tp)+sum(fp)+sum(fn)) AS m0, avg(f) AS a0 FROM bs GROUP BY base) USING (base)""",
    DATASET + _GRID + _BASE_CONF,
)
def relabelling_gain(spark, d):
    base, scored = views.base_and_scored(spark, d)
    gain = relabelling.relabelling_gain(base, scored.withColumn("model", F.lit("hashed")), views.BASES, ["hashed"])
    return gain.select(
        "base", "model", "threshold", *[rounded(c, c) for c in ("micro_f1", "macro_f1", "base_micro_f1", "base_macro_f1")],
        *[rounded(c, c, 6) for c in ("micro_gain", "macro_gain")],
    )


@query("SELECT label, base, tn, fp, fn, tp FROM bc", DATASET + _BASE_CONF)
def confusion(spark, d):
    return evaluate.confusion(views.base_predictions(spark, d), ["label"], views.BASES)


_REPORT = """,
cls AS (SELECT label, base, tn, fp, fn, tp, p AS p1, r AS r1, f AS f1,
               coalesce(tn::DOUBLE/nullif(tn+fn,0),0) AS p0, coalesce(tn::DOUBLE/nullif(tn+fp,0),0) AS r0,
               coalesce(2*tn::DOUBLE/nullif(2*tn+fp+fn,0),0) AS f0, tn+fp AS s0, tp+fn AS s1, tn+fp+fn+tp AS s FROM bs)"""


@query(
    """SELECT label, base, '0' AS class, round(p0,8) AS precision, round(r0,8) AS recall, round(f0,8) AS f1, s0 AS support,
              NULL::BIGINT AS tn, NULL::BIGINT AS fp, NULL::BIGINT AS fn, NULL::BIGINT AS tp FROM cls
       UNION ALL SELECT label, base, '1', round(p1,8), round(r1,8), round(f1,8), s1, tn, fp, fn, tp FROM cls
       UNION ALL SELECT label, base, 'accuracy', NULL, NULL, round((tp+tn)/s::DOUBLE,8), s, NULL, NULL, NULL, NULL FROM cls
       UNION ALL SELECT label, base, 'macro avg', round((p0+p1)/2,8), round((r0+r1)/2,8), round((f0+f1)/2,8), s, NULL, NULL, NULL, NULL FROM cls
       UNION ALL SELECT label, base, 'weighted avg', round((p0*s0+p1*s1)/s,8), round((r0*s0+r1*s1)/s,8), round((f0*s0+f1*s1)/s,8), s, NULL, NULL, NULL, NULL FROM cls""",
    DATASET + _BASE_CONF + _REPORT,
)
def classification_report(spark, d):
    counts = evaluate.confusion(views.base_predictions(spark, d), ["label"], views.BASES)
    report = evaluate.classification_report(counts, ["label", "base"])
    return report.select(
        "label", "base", "class", *[rounded(c, c) for c in ("precision", "recall", "f1")], "support", "tn", "fp", "fn", "tp"
    )


@query(
    "SELECT base, round(2*sum(tp)::DOUBLE/(2*sum(tp)+sum(fp)+sum(fn)),8) AS micro_f1, round(avg(f),8) AS macro_f1 FROM bs GROUP BY base",
    DATASET + _BASE_CONF,
)
def micro_macro_f1(spark, d):
    counts = evaluate.confusion(views.base_predictions(spark, d), ["label"], views.BASES)
    return evaluate.micro_macro_f1(counts, ["base"]).select("base", rounded("micro_f1", "micro_f1"), rounded("macro_f1", "macro_f1"))


@query(
    """SELECT 'positive' AS mode, label, round(avg(-(w*target*ln(prob)+(1-target)*ln(1-prob))),6) AS log_loss FROM lw GROUP BY label
       UNION ALL SELECT 'all', label, round(avg(-w*(target*ln(prob)+(1-target)*ln(1-prob))),6) FROM lw GROUP BY label""",
    DATASET
    + """,
lw AS (SELECT label, target, least(greatest(prob, 1e-12::DOUBLE), 1-1e-12::DOUBLE) AS prob,
              (count(*) OVER (PARTITION BY label) - sum(target) OVER (PARTITION BY label))::DOUBLE/sum(target) OVER (PARTITION BY label) AS w FROM scored)""",
)
def weighted_log_loss(spark, d):
    scored = views.scored(spark, d)
    weights = materialize(sampling.class_balance(scored).select("label", "pos_weight"), "weights")
    weighted = lookup_join(scored, weights, "label")
    losses = evaluate.weighted_log_loss(weighted, ["label"], weight_mode=["positive", "all"])
    return losses.select("mode", "label", rounded("log_loss", "log_loss", 6))


@query(
    """SELECT base, round((tp/nullif(tp+fp,0)::DOUBLE + tn/nullif(tn+fn,0)::DOUBLE)/2,3) AS macro_precision,
              round((tp/(tp+fn)::DOUBLE + tn/(tn+fp)::DOUBLE)/2,3) AS macro_recall,
              round((2*tp/(2*tp+fp+fn)::DOUBLE + 2*tn/(2*tn+fp+fn)::DOUBLE)/2,3) AS macro_f1, (tp+fp+fn+tn)::BIGINT AS support
       FROM (SELECT base, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM bc GROUP BY base)""",
    DATASET + _BASE_CONF,
)
def validation_summary(spark, d):
    counts = evaluate.confusion(views.base_predictions(spark, d), [], views.BASES)
    return evaluate.validation_summary(counts, ["base"])


@query(
    """SELECT label, (sum(pred) FILTER (base='weak'))::BIGINT AS weak_docs, (sum(pred) FILTER (base='draw'))::BIGINT AS draw_docs,
              (sum(gold) FILTER (base='weak'))::BIGINT AS support,
              (SELECT count(*) FROM nwl WHERE nwl.label=base.label) AS valid_docs FROM base GROUP BY label""",
    DATASET,
)
def support_columns(spark, d):
    return evaluate.support_columns(views.base_predictions(spark, d), views.dataset(spark, d), [], views.BASES)


# --- flows ---------------------------------------------------------------------------------------


@query(
    """SELECT (SELECT count(*) FROM rec) AS all_labels, count(*) AS existing, count(*) FILTER (n_concepts=1) AS single_concept,
              count(*) FILTER (ui IN (SELECT ui FROM leaf)) AS leaf,
              count(*) FILTER (n_concepts=1 AND ui IN (SELECT ui FROM leaf)) AS fine_grained FROM rec WHERE introduced<=1998""",
    THESAURUS,
)
def select_fine_grained_labels(spark, d):
    old, _, now = views.versions3(spark, d)
    counts = curation.fine_grained_counts(now, old)
    return counts.select("all_labels", "existing", "single_concept", "leaf", "fine_grained")


def _harvested(spark, d, articles, occurrence):
    concepts = views.text_crosswalk(spark, d)
    every_word = concepts.select(F.col("cui").alias("source_code"), F.col("cui"), F.lit("WORDS").alias("source"))
    known = concepts.select(F.col("source_code").alias("label"), F.col("cui").alias("concept_ui"))
    found = curation.harvest_weak_labelled_articles(articles, known, occurrence, every_word, "WORDS", 1996, 2000)
    joined = text.article_text(F.col("title"), F.col("abstract_text"))
    return found.select(
        "pmid", F.md5(joined).alias("text_md5"), text.join_list(F.col("golden_in_scope")).alias("golden"),
        text.join_list(F.col("weak")).alias("weak"),
    )


@query(
    """SELECT a.pmid, md5(title||' '||abstract_text) AS text_md5, a.lang AS golden,
              coalesce((SELECT string_agg(label, '~' ORDER BY label) FROM text_weak w WHERE w.pmid=a.pmid), '') AS weak
       FROM article a WHERE length(abstract_text)>0
       AND (year(date_completed) BETWEEN 1996 AND 1999 OR (year(date_completed)=2000 AND month(date_completed)<=11))""",
    ARTICLES,
)
def harvest_weak_labelled_articles(spark, d):
    return _harvested(spark, d, views.articles(spark, d), views.text_occurrence(spark, d))


@query(ORACLE["harvest_weak_labelled_articles"])
def harvest_bucketed(spark, d):
    """Articles and occurrences bucketed by article: the harvest moves neither."""
    articles = materialize_bucketed(views.articles(spark, d), "bucketed_articles", "pmid", 8)
    occurrence = materialize_bucketed(views.text_occurrence(spark, d), "bucketed_occurrences", "pmid", 8)
    return _harvested(spark, d, articles, occurrence)


@query(
    f"""SELECT label, split, count(*) AS n, sum(target)::BIGINT AS n_positive, sum(pmid)::BIGINT AS sum_pmid FROM nwl
        WHERE target<>0 OR {H.format("'u10|'||label||'|'||pmid")}/4294967296::DOUBLE <= 0.4::DOUBLE GROUP BY label, split""",
    DATASET,
)
def build_relabel_datasets(spark, d):
    rows = relabelling.build_relabel_datasets(*views.annotation_inputs(spark, d), ratio_kept=0.4)
    return rows.groupBy("label", "split").agg(
        F.count("*").alias("n"), F.sum("target").alias("n_positive"), F.sum("pmid").alias("sum_pmid")
    )


@query(
    """SELECT label, fn, round(recall,8) AS recall FROM ratios WHERE label NOT LIKE 'DSTANDARD%' AND recall BETWEEN 0.4 AND 0.6 AND fn>=50""",
    FREQUENCIES,
)
def select_noisy_labels(spark, d):
    part = views.table(spark, d, "part")
    placed = part.select(
        views._label().alias("descriptor_ui"), F.array(views._type_number()).alias("tree_numbers")
    ).distinct()
    chosen = relabelling.select_noisy_labels(views.label_stats(spark, d), placed, "recall")
    return chosen.select("label", "fn", rounded("recall", "recall"))


@query(
    """SELECT a.ui AS descriptor_ui, a.name AS descriptor_name, o.host_ui, o.host_name,
              CASE WHEN o.ui IS NOT NULL THEN 'NRW' END AS relation,
              CASE WHEN o.ui IS NULL THEN f.scr_ui END AS scr_ui, CASE WHEN o.ui IS NULL THEN f.found_by END AS found_by
       FROM added a JOIN found f USING (ui) LEFT JOIN old_host o USING (ui)""",
    THESAURUS,
)
def diff_versions(spark, d):
    old, new, now = views.versions3(spark, d)
    return curation.diff_versions(old, new, now, views.scrs(spark, d), views.scr_exceptions(spark, d))


@query(
    """SELECT a.ui AS "Descr. UI", c.prov_code AS "Prov. Code", c.n_hosts AS "PH count", a.n_concepts::BIGINT AS "#Ct",
              (SELECT string_agg(parent, '~' ORDER BY parent) FROM par WHERE par.label=a.ui) AS "Parent Ds",
              (SELECT string_agg(host_name, '~' ORDER BY host_name) FROM hosts h WHERE h.ui=a.ui) AS "PHs",
              coalesce((SELECT string_agg(host_ui, '~' ORDER BY host_ui) FROM hosts h WHERE h.ui=a.ui),
                       CASE WHEN c.n_hosts>0 THEN '' END) AS "PHs UIs",
              (SELECT count(*) FROM phex WHERE phex.ui=a.ui) AS "#PHex",
              (SELECT string_agg(member, '~' ORDER BY member) FROM phex WHERE phex.ui=a.ui) AS "PHex UIs",
              (SELECT count(*) FROM anc WHERE ancestor=a.ui) AS "#Descendant Ds",
              (SELECT string_agg(descendant, '~' ORDER BY descendant) FROM anc WHERE ancestor=a.ui) AS "Descendant Ds"
       FROM added a JOIN coded c ON c.descriptor_ui=a.ui""",
    THESAURUS + f", coded AS ({_CODES})",
)
def describe_introductions(spark, d):
    old, new, now = views.versions3(spark, d)
    added = versions.new_descriptors(old, new, now)
    hosts = versions.provenance_hosts(added, old, views.scrs(spark, d), now, views.scr_exceptions(spark, d))
    cases = curation.describe_introductions(added, materialize(hosts, "hosts"), now)
    titles = ["Descr. UI", "Prov. Code", "PH count", "#Ct", "Parent Ds", "PHs", "PHs UIs", "#PHex", "PHex UIs", "#Descendant Ds", "Descendant Ds"]
    return writers.use_case_table(cases, without=("cui",)).select(*[F.col(f"`{t}`") for t in titles])


@query(
    """SELECT label, count(*) AS n, sum(pmid)::BIGINT AS sum_pmid, sum(gold)::BIGINT AS n_gold, sum(weak)::BIGINT AS n_weak
       FROM marked WHERE gold=1 OR weak=1 GROUP BY label
       UNION ALL SELECT NULL, count(*), sum(pmid)::BIGINT, 0::BIGINT, 0::BIGINT FROM found_articles
       WHERE pmid NOT IN (SELECT pmid FROM marked WHERE gold=1 OR weak=1) HAVING count(*) > 0""",
    THESAURUS
    + """, leafcase AS (SELECT ui FROM added JOIN leaf USING (ui)),
with_abstract AS (SELECT doc_id FROM documents WHERE strpos(text, chr(10)) BETWEEN 1 AND length(text) - 1),
searched AS (SELECT DISTINCT pmid, dated.label IN (SELECT ui FROM added) AS is_new FROM phex JOIN leafcase USING (ui) JOIN dated ON member=dated.label
             WHERE year(date_completed) IN (1999,2000) OR (year(date_completed)=2001 AND month(date_completed)<=11)),
found_articles AS (SELECT pmid, max(r) AS r FROM (
                     SELECT pmid, 2 AS r FROM searched WHERE (pmid+1)%211 IN (SELECT doc_id FROM with_abstract)
                     UNION ALL SELECT pmid, 1 FROM searched WHERE NOT is_new AND pmid%211 IN (SELECT doc_id FROM with_abstract)) GROUP BY pmid),
marked AS (SELECT f.pmid, l.label, max(CASE WHEN g.pmid IS NOT NULL THEN 1 ELSE 0 END) AS gold,
                  max(CASE WHEN o.pmid IS NOT NULL THEN 1 ELSE 0 END) AS weak
           FROM found_articles f CROSS JOIN (SELECT ui AS label FROM leafcase) l
           LEFT JOIN panno g ON g.pmid=f.pmid AND g.label=l.label AND f.r=2
           LEFT JOIN pcui c ON c.label=l.label LEFT JOIN pocc o ON o.pmid=f.pmid AND o.cui=c.cui
           GROUP BY f.pmid, l.label)""",
)
def build_retro_dataset(spark, d):
    """Each article in two revisions; only the newer one has the labels under a new record.

    A revision has the abstract of a document, which is empty or missing for some of either age.
    """
    hosts, now = _hosts(spark, d)
    orders = views.dated_articles(spark, d)
    both = F.array(F.lit(1).alias("r"), F.lit(2))
    number = F.col("pmid") * 2 + F.col("_r")
    first = F.substring_index("text", "\n", 1)
    abstracts = views.table(spark, d, "documents").select("doc_id", F.substring(F.col("text"), F.length(first) + 2, F.length("text")).alias("abstract_text"))
    with_text = orders.withColumn("_r", F.explode(both)).withColumn("doc_id", (F.col("pmid") + F.col("_r") - 1) % 211)
    revisions = with_text.join(abstracts, "doc_id", "left").select(
        "pmid", "date_completed", "abstract_text",
        F.date_add("date_completed", F.col("_r")).alias("date_revised"), number.alias("row_id"),
    )
    added = _added(now)
    new_labels = materialize(added.select(F.col("descriptor_ui").alias("label"), F.lit(2).alias("_first")), "new-labels")
    annotations = lookup_join(views.part_annotations(spark, d), new_labels, "label", "left")
    golden = annotations.withColumn("_r", F.explode(F.sequence(F.coalesce("_first", F.lit(1)), F.lit(2))))
    rows = curation.build_retro_dataset(
        revisions, golden.select(number.alias("row_id"), "label"), added, hosts, now,
        _part_occurrence(spark, d), _part_cuis(spark, d), 1999, 2001,
    )
    return per_label(rows, F.sum("gold").cast("long").alias("n_gold"), F.sum("weak").cast("long").alias("n_weak"))


def _scored_bases(spark, d):
    methods = F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("pred")) for b in views.BASES])
    pairs = views.base_predictions(spark, d)
    return pairs.select("label", "pmid", F.col("gold").alias("target"), F.inline(methods))


@query(ORACLE["classification_report"])
def evaluate_scored(spark, d):
    report, _ = relabelling.evaluate_scored(_scored_bases(spark, d), ["base"])
    return report.select(
        "label", "base", "class", *[rounded(c, c) for c in ("precision", "recall", "f1")], "support", "tn", "fp", "fn", "tp"
    )


@query(ORACLE["micro_macro_f1"])
def evaluate_scored_f1(spark, d):
    _, means = relabelling.evaluate_scored(_scored_bases(spark, d), ["base"])
    return means.select("base", rounded("micro_f1", "micro_f1"), rounded("macro_f1", "macro_f1"))


@query()
def train_and_score(spark, d):
    names = views.text_scopes(spark, d)[0].select("label", F.concat(F.lit("Language "), "label").alias("label_name"))
    runs = [
        {"name": f"seed{seed}_n{n}", "seed": seed, "per_positive": n, "labels": None}
        for seed, n in ((42, 10), (27, 3))
    ]
    scored, _ = relabelling.train_and_score(
        materialize(views.text_dataset(spark, d), "dataset"), views.articles(spark, d), names, runs, epochs=[3, 6]
    )
    report, _ = relabelling.evaluate_scored(scored, ["model"])
    return report.where(F.col("class") == "1").select("model", "label", "precision", "recall", "f1", "support")


RUNS = [
    {"name": "a", "seed": 42, "per_positive": 10, "labels": None},
    {"name": "b", "seed": 27, "per_positive": 2, "labels": ["DSMALL_Brand#3", "unknown"]},
    {"name": "c", "seed": 0, "per_positive": 1000000, "labels": ["unknown"]},
]


@query(
    f"""SELECT run, label, split, target, count(*) AS n, sum(pmid)::BIGINT AS sum_pmid FROM (
          SELECT x.*, sum(target) OVER (PARTITION BY run, label, split) AS pos,
                 row_number() OVER (PARTITION BY run, label, split, target ORDER BY {H.format("'b'||seed||'|'||label||'|'||pmid")}, pmid) AS rn
          FROM (SELECT nwl.*, runs.* FROM nwl CROSS JOIN (VALUES ('a', 42, 10), ('b', 27, 2), ('c', 0, 1000000)) runs(run, seed, n)
                WHERE run<>'b' OR label IN ('DSMALL_Brand#3')) x)
        WHERE target=1 OR rn<=n*pos GROUP BY run, label, split, target""",
    DATASET,
)
def run_grid(spark, d):
    rows = sampling.grid_rows(views.dataset(spark, d), RUNS)
    return rows.groupBy("run", "label", "split", "target").agg(F.count("*").alias("n"), F.sum("pmid").alias("sum_pmid"))


@query(
    f"""SELECT run, target, sum(n)::BIGINT AS n,
               round(CASE WHEN target=1 THEN sum(sum(n)) FILTER (target=0) OVER (PARTITION BY run) / sum(sum(n)) FILTER (target=1) OVER (PARTITION BY run) ELSE 1 END, 8)::DOUBLE AS weight
        FROM ({ORACLE["run_grid"].split("SELECT run, label, split, target, count(*) AS n", 1)[1].join(["SELECT run, label, split, target, count(*) AS n", ""])}) GROUP BY run, target""",
    DATASET,
)
def run_weights(spark, d):
    """The class weights that the rows of each run are learned with."""
    rows = sampling.grid_rows(views.dataset(spark, d), RUNS)
    weighted = training.with_run_weights(rows)
    return weighted.groupBy("run", "target").agg(F.count("*").alias("n"), rounded(F.max("weight"), "weight"))


ORACLE["group_dataset"] = f"WITH {(ANNOTATIONS + _GROUPS).strip()}\n{ORACLE['group_dataset']}"
