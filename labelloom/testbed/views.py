"""Engine inputs derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelloom.functions import notes
from labelloom.functions.numeric import draw, drawn_within, made_once
from labelloom.operators import hierarchy, labels, sampling
from labelloom.operators.articles import weak_labels
from labelloom.operators.scale import materialize, materialize_bucketed
from labelloom.plans.relabelling import build_relabel_datasets

OLD_VERSION, NEW_VERSION, NOW_VERSION = 1998, 1999, 2001

# One top-level letter per part type, in alphabetical order of the types.
TYPE_LETTERS = {"ECONOMY": "A", "LARGE": "B", "MEDIUM": "C", "PROMO": "D", "SMALL": "E", "STANDARD": "V"}

# Words that stand for a language in the text of the documents.
CONCEPT_WORDS = {"the": "en", "and": "en", "une": "fr", "les": "fr", "und": "de", "der": "de", "que": "es", "los": "es"}
LETTER = "[a-zàâçéèêëîïôöûùüÿñæœß]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Articles of a bucket, about.
BUCKET_ARTICLES = 50_000


def in_article_buckets(spark: SparkSession, sf_dir: str, rows: DataFrame, name: str) -> DataFrame:
    """Rows written in buckets by pmid, more of them the more articles there are: a task's share stays the same."""
    buckets = max(8, -(-table(spark, sf_dir, "orders").count() // BUCKET_ARTICLES))
    return materialize_bucketed(rows.repartition(buckets, "pmid"), name, "pmid", buckets)


# --- annotations: line items as golden and weak label pairs -------------------------------------


def _annotation_rows(spark: SparkSession, sf_dir: str, condition: Column) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(condition)
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), _label().alias("label"), _type_label().alias("parent")
    )
    return lines.join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("pmid"), "label", "parent", F.col("l_linenumber").alias("entity_id")
    )


def _label() -> Column:
    return F.concat(F.lit("D"), "p_type", F.lit("_"), "p_brand")


def _type_label() -> Column:
    return F.concat(F.lit("T"), "p_type")


def _is_weak() -> Column:
    flag = F.col("l_returnflag")
    return (flag == "R") | ((flag == "A") & (F.col("l_linenumber") % 2 == 1))


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotation_rows(spark, sf_dir, F.col("l_linestatus") == "F").select("pmid", "label")


def weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotation_rows(spark, sf_dir, _is_weak()).select("pmid", "label")


def occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _annotation_rows(spark, sf_dir, _is_weak())
    return rows.select("pmid", F.concat(F.lit("C"), "label").alias("cui"), "entity_id")


def label_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(_label().alias("label"), _type_label().alias("parent")).distinct()


def scopes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(label, scope) and (scope, member) of the annotation labels, each with its type as only parent."""
    parents = label_parent(spark, sf_dir)
    heads = table(spark, sf_dir, "part").select(_type_label().alias("scope")).distinct()
    below = parents.select(F.col("parent").alias("scope"), F.col("label").alias("member"))
    return parents.withColumnRenamed("parent", "scope"), below.unionByName(heads.withColumn("member", F.col("scope")))


def annotation_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return (golden(spark, sf_dir), weak(spark, sf_dir), *scopes(spark, sf_dir))


def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_frequencies(*annotation_inputs(spark, sf_dir))


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ids per label in source MAIN, one in source OTHER; none for labels of one brand."""
    known = label_parent(spark, sf_dir).where(~F.endswith("label", F.lit("#7")))
    main = known.select(F.concat(F.lit("C"), "label").alias("cui"), F.col("label").alias("source_code"), F.lit("MAIN").alias("source"))
    second = known.select(F.concat(F.lit("D"), "label").alias("cui"), F.col("label").alias("source_code"), F.lit("MAIN").alias("source"))
    other = known.select(F.concat(F.lit("A"), "label").alias("cui"), F.col("label").alias("source_code"), F.lit("OTHER").alias("source"))
    return main.unionByName(second).unionByName(other)


# --- articles ------------------------------------------------------------------------------------


def dated_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article per order, with its completion date and no text."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pmid"), F.to_date("o_orderdate").alias("date_completed")
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: first line as title, the rest as abstract, dates of the order with that key."""
    docs = table(spark, sf_dir, "documents")
    title = F.substring_index("text", "\n", 1)
    rows = docs.select(
        F.col("doc_id").alias("pmid"),
        title.alias("title"),
        F.substring(F.col("text"), F.length(title) + 2, F.length("text")).alias("abstract_text"),
        F.array("lang").alias("golden"),
    )
    dated = dated_articles(spark, sf_dir)
    return rows.join(dated, "pmid").withColumn("year", F.year("date_completed").cast("string"))


def text_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pmid"), F.col("lang").alias("label"))


def text_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept words of each document, read from the whole text."""
    whole_word = f"(?<!{LETTER})({'|'.join(CONCEPT_WORDS)})(?!{LETTER})"
    hits = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(whole_word), 1))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pmid"), F.explode(hits).alias("cui"), F.lit(1).cast("long").alias("entity_id")
    )


def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, cui): the concept words of the languages that occur."""
    langs = table(spark, sf_dir, "documents").select(F.col("lang").alias("label")).distinct()
    words = F.array(*[F.struct(F.lit(w).alias("cui"), F.lit(x).alias("lang")) for w, x in CONCEPT_WORDS.items()])
    return langs.withColumn("_w", F.explode(words)).where("_w.lang = label").select("label", "_w.cui")


def text_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_labels(spark, sf_dir).select("cui", F.col("label").alias("source_code"), F.lit("WORDS").alias("source"))


def text_scopes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All languages are children of one parent."""
    langs = table(spark, sf_dir, "documents").select(F.col("lang").alias("label")).distinct()
    return (
        langs.withColumn("scope", F.lit("LANGUAGE")),
        langs.select(F.lit("LANGUAGE").alias("scope"), F.col("label").alias("member")),
    )


def text_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relabelling rows of the documents: (label, pmid, target, split)."""
    weak_pairs = weak_labels(text_occurrence(spark, sf_dir), text_labels(spark, sf_dir))
    label_scope, members = text_scopes(spark, sf_dir)
    return build_relabel_datasets(text_golden(spark, sf_dir), weak_pairs, label_scope, members)


def dataset(spark: SparkSession, sf_dir: str, kind: str = "NWL") -> DataFrame:
    """Relabelling rows of the annotations with their split.

    Articles are compared, split and written once; the rows of their labels come up when they are read.
    """
    split = lambda articles: materialize(sampling.split_rows(articles), "split-articles")
    return labels.relabel_dataset(*annotation_inputs(spark, sf_dir), kind, split)


# --- predictions ---------------------------------------------------------------------------------


def _written_once(articles: DataFrame) -> DataFrame:
    return materialize(articles, "compared-articles")


def scored(spark: SparkSession, sf_dir: str, of_articles: Callable[[DataFrame], DataFrame] = _written_once) -> DataFrame:
    """Relabelling rows with a probability made of a draw and the truth; compared articles are written once."""
    prob = F.lit(0.6) * draw(F.lit("p|"), F.col("pmid"), F.col("label")) + F.lit(0.4) * F.col("target")
    rows = labels.relabel_dataset(*annotation_inputs(spark, sf_dir), of_articles=of_articles)
    return rows.select("*", made_once(prob).alias("prob"))


BASES = ["weak", "draw"]


def base_predictions(spark: SparkSession, sf_dir: str, of_articles: Callable[[DataFrame], DataFrame] = _written_once) -> DataFrame:
    """All valid pairs with golden value and two base methods: weak labels and a random draw."""
    pairs = labels.valid_pairs(*annotation_inputs(spark, sf_dir), of_articles)
    chance = ~drawn_within(0.8, F.lit("b|"), F.col("pmid"), F.col("label"))
    return pairs.select("*", made_once(chance.cast("int")).alias("draw"))


def base_and_scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``base_predictions`` and ``scored`` over the same compared articles, written once and bucketed by article.

    Rows of pairs come up when they are read, in the bucket of their article, so both meet without a shuffle.
    """
    written: list[DataFrame] = []

    def once(articles: DataFrame) -> DataFrame:
        if not written:
            written.append(in_article_buckets(spark, sf_dir, articles, "compared-articles"))
        return written[0]

    return base_predictions(spark, sf_dir, once), scored(spark, sf_dir, once)


# --- thesaurus -----------------------------------------------------------------------------------

# Records of parts that a task makes, about.
TASK_PARTS = 50_000
CONCEPTS_TYPE = "array<struct<ui:string,name:string,preferred:string,terms:array<string>>>"
_NO_TEXTS = "array<string>"


def _brand_number(c: str = "p_brand") -> Column:
    return F.lpad(F.regexp_extract(c, r"(\d+)", 1), 3, "0")


def _type_number() -> Column:
    letter = F.lit(None).cast("string")
    for name, value in TYPE_LETTERS.items():
        letter = F.when(F.col("p_type") == name, value).otherwise(letter)
    return F.concat(letter, F.lit("01"))


def _one_concept(ui: Column, name: Column) -> Column:
    return F.struct(ui.alias("ui"), name.alias("name"), F.lit("Y").alias("preferred"), F.array(name).alias("terms"))


def _record(**columns: Column) -> list[Column]:
    defaults = {
        "public_note": F.lit(None).cast("string"),
        "scope_note": F.lit(None).cast("string"),
        "relations": F.create_map().cast("map<string,string>"),
        "indexing_texts": F.array().cast(_NO_TEXTS),
    }
    chosen = {**defaults, **columns}
    order = [
        "descriptor_ui", "descriptor_name", "public_note", "scope_note", "concepts", "relations",
        "tree_numbers", "indexing_texts", "terms", "version",
    ]
    return [chosen[c].alias(c) for c in order]


def indexing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, entry): the previous-indexing entries of the parts, as text."""
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(_part_entries()).alias("entry"))


def _part_entries() -> Column:
    key = F.col("p_partkey")
    dated_brand = F.concat("p_brand", F.lit("/metabolism (1990-"), (1996 + key % 3).cast("string"), F.lit(")"))
    dated_type = F.concat("p_type", F.lit(" (Jan 1990-"), (1996 + key % 2).cast("string"), F.lit(")"))
    gone = F.concat(F.lit("Gone "), key.cast("string"))
    irregular = F.concat("p_type", F.lit(" (1979-82,89-1992)"))
    return (
        F.when(key % 5 == 3, F.array(dated_brand, dated_type, gone, irregular))
        .when(key % 5 == 0, F.array(gone, F.col("p_type")))
        .otherwise(F.array().cast(_NO_TEXTS))
    )


def part_note() -> Column:
    key = F.col("p_partkey")
    named = F.concat("p_name", F.lit(" "), key.cast("string"))
    renamed = F.when(key % 4 == 1, F.lit(" now other")).when(key % 4 == 2, F.lit(" (now other)")).otherwise("")
    return F.when(
        key % 5 == 2, F.concat(F.lit("1999; "), named, renamed, F.lit(" was indexed under "), "p_brand", F.lit(" 1990-1998"))
    )


def raw_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, brands and parts as three levels of descriptors, previous indexing as text; version is the year of introduction."""
    parts = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    base = F.lit(1990)
    types = parts.select("p_type").distinct().select(
        *_record(
            descriptor_ui=_type_label(),
            descriptor_name=F.col("p_type"),
            concepts=F.array(_one_concept(F.concat(F.lit("MT"), "p_type"), F.col("p_type"))),
            tree_numbers=F.array(_type_number()),
            terms=F.array("p_type"),
            version=base,
        )
    )
    brands = (
        parts.select("p_brand", F.concat(_type_number(), F.lit("."), _brand_number()).alias("_tn"))
        .groupBy("p_brand")
        .agg(F.array_sort(F.collect_set("_tn")).alias("tree_numbers"))
        .select(
            *_record(
                descriptor_ui=F.concat(F.lit("B"), _brand_number()),
                descriptor_name=F.col("p_brand"),
                concepts=F.array(_one_concept(F.concat(F.lit("MB"), _brand_number()), F.col("p_brand"))),
                tree_numbers=F.col("tree_numbers"),
                terms=F.array("p_brand"),
                version=base,
            )
        )
    )
    name = F.when((key % 5 == 2) & (key % 3 == 2), F.concat(F.lit("item "), key.cast("string"))).otherwise(
        F.concat("p_name", F.lit(" "), key.cast("string"))
    )
    own = _one_concept(F.concat(F.lit("M"), key.cast("string")), name)
    next_ui = F.concat(F.lit("M"), (key + 1).cast("string"))
    second = F.struct(next_ui.alias("ui"), name.alias("name"), F.lit("N").alias("preferred"), F.array(name).alias("terms"))
    # A file of parts has few splits, and their records cost much to make.
    tasks = max(8, -(-parts.count() // TASK_PARTS))
    leaves = parts.repartition(tasks, "p_partkey").select(
        *_record(
            descriptor_ui=F.concat(F.lit("P"), F.lpad(key.cast("string"), 9, "0")),
            descriptor_name=name,
            public_note=part_note(),
            concepts=F.when(key % 5 == 0, F.array(own, second)).otherwise(F.array(own)),
            relations=F.when(key % 5 == 0, F.create_map(next_ui, F.lit("NRW"))).otherwise(
                F.create_map().cast("map<string,string>")
            ),
            tree_numbers=F.array(
                F.concat(_type_number(), F.lit("."), _brand_number(), F.lit("."), F.lpad(key.cast("string"), 9, "0"))
            ),
            indexing_texts=_part_entries(),
            terms=F.array(name, F.concat(F.lit("alias "), key.cast("string"))),
            version=(1995 + key % 7).cast("int"),
        )
    )
    return types.unionByName(brands).unionByName(leaves)


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_descriptors`` with parsed previous indexing."""
    return raw_descriptors(spark, sf_dir).withColumn(
        "previous_indexing", F.transform("indexing_texts", notes.parse_previous_indexing)
    ).drop("indexing_texts")


def _xml_concepts(relations: Column) -> Column:
    """The concepts of a record as the files hold them, relations under the preferred concept."""
    entries = F.map_entries(relations)
    return F.struct(
        F.transform(
            "concepts",
            lambda c: F.struct(
                c["preferred"].alias("_PreferredConceptYN"),
                c["ui"].alias("ConceptUI"),
                F.struct(c["name"].alias("String")).alias("ConceptName"),
                F.struct(
                    F.when(
                        c["preferred"] == "Y",
                        F.transform(entries, lambda e: F.struct(e["value"].alias("_RelationName"), e["key"].alias("Concept2UI"))),
                    ).alias("ConceptRelation")
                ).alias("ConceptRelationList"),
                F.struct(F.transform(c["terms"], lambda t: F.struct(t.alias("String"))).alias("Term")).alias("TermList"),
            ),
        ).alias("Concept")
    )


def _some(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def descriptor_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): the XML record of each descriptor; terms of a record belong to its preferred concept."""
    rows = raw_descriptors(spark, sf_dir)
    first = F.transform("concepts", lambda c, i: c.withField("terms", F.when(i == 0, F.col("terms")).otherwise(F.array().cast(_NO_TEXTS))))
    record = F.struct(
        F.col("descriptor_ui").alias("DescriptorUI"),
        F.struct(F.col("descriptor_name").alias("String")).alias("DescriptorName"),
        F.col("public_note").alias("PublicMeSHNote"),
        F.struct(_some(F.col("indexing_texts")).alias("PreviousIndexing")).alias("PreviousIndexingList"),
        F.struct(F.col("tree_numbers").alias("TreeNumber")).alias("TreeNumberList"),
        _xml_concepts(F.col("relations")).alias("ConceptList"),
    )
    return rows.withColumn("concepts", first).select(F.to_xml(record, {"rowTag": "DescriptorRecord"}).alias("value"))


def scr_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): the XML record of each supplementary record; ids of hosts and qualifiers carry a star."""
    none = F.create_map().cast("map<string,string>")
    star = lambda x: F.concat(F.lit("*"), x)
    mapped = F.transform(
        "mapped",
        lambda m, i: F.struct(
            F.struct(star(m["ui"]).alias("DescriptorUI"), F.struct(m["name"].alias("String")).alias("DescriptorName")).alias("DescriptorReferredTo"),
            F.struct(F.when(i == 1, star(F.lit("Q1"))).alias("QualifierUI")).alias("QualifierReferredTo"),
        ),
    )
    record = F.struct(
        F.col("scr_ui").alias("SupplementalRecordUI"),
        F.struct(F.col("scr_name").alias("String")).alias("SupplementalRecordName"),
        F.struct(mapped.alias("HeadingMappedTo")).alias("HeadingMappedToList"),
        _xml_concepts(none).alias("ConceptList"),
    )
    return scrs(spark, sf_dir).select(F.to_xml(record, {"rowTag": "SupplementalRecord"}).alias("value"))


def thesaurus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version, written once like any parsed thesaurus file."""
    return materialize(descriptors(spark, sf_dir), "thesaurus")


def versions3(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    now = thesaurus(spark, sf_dir)
    return now.where(F.col("version") <= OLD_VERSION), now.where(F.col("version") <= NEW_VERSION), now


def scrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplementary records mapped to the brand of a part, and some to a host that is gone."""
    key = F.col("p_partkey")
    term = F.concat("p_name", F.lit(" "), key.cast("string"))
    concept = F.concat(F.when(key % 3 == 0, "M").otherwise("N"), key.cast("string"))
    brand = F.struct(F.col("p_brand").alias("name"), F.concat(F.lit("B"), _brand_number()).alias("ui"))
    gone = F.struct(F.lit("Gone host").alias("name"), F.lit("B999").alias("ui"))
    return table(spark, sf_dir, "part").where(key % 5 == 2).select(
        F.concat(F.lit("S"), key.cast("string")).alias("scr_ui"),
        term.alias("scr_name"),
        F.array(_one_concept(concept, term)).alias("concepts"),
        F.when(key % 4 == 0, F.array(brand, gone)).otherwise(F.array(brand)).alias("mapped"),
        F.array(term).alias("terms"),
    )


def scr_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed matches; those of the last parts name a record that does not exist."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").where((key % 5 == 2) & (key % 11 == 3)).select(
        F.concat(F.lit("P"), F.lpad(key.cast("string"), 9, "0")).alias("descriptor_ui"),
        F.concat(F.lit("S"), (key + 5).cast("string")).alias("scr_ui"),
    )


def part_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, label): the part descriptor of each line item of an order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pmid"),
        F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("label"),
    )
