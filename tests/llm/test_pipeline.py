import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from labelloom.llm import mixing, packing, quality_gam, quality_rules
from labelloom.operators.scale import materialize
from tests.llm.test_corpus import plain_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = corpus_pipeline.documents(spark, SF)
    tables = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = tables[name] = materialize(stage(spark, docs, SF), name)
    return tables


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns_and_decide_as_their_operators(spark, stages):
    docs = stages["documents"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].dtypes == docs.dtypes
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(stages["quality_classifier"]) == ids(quality_gam.quality_scores(docs, labels).where("predicted = 1"))
    assert ids(stages["quality_rules"]) == ids(quality_rules.quality_rules(stages["quality_classifier"]).where("kept"))
    rows = [(r.doc_id, r.text) for r in stages["quality_rules"].collect()]
    assert ids(stages["near_duplicates"]) == sorted(k for k, _, c in plain_groups(rows, 5, 80) if k == c)
    assert ids(stages["source_mixing"]) == ids(stages["near_duplicates"])
    assert sorted({r.doc_id for r in stages["packing"].collect()}) == ids(stages["source_mixing"])


def test_clean_labelled_documents_survive_the_filters(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    failed = quality_rules.quality_rules(stages["documents"]).where("base_failed").select("doc_id")
    clean = labels.where("quality = 1").join(failed, "doc_id", "left_anti")
    assert clean.join(stages["quality_rules"], "doc_id", "left_anti").count() == 0
    assert labels.where("quality = 0").join(stages["quality_rules"], "doc_id").count() == 0


def test_run_equals_its_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.agg(F.sum("length")).first() == stages["packing"].agg(F.sum("length")).first()
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_sequences_hold_the_sources_at_their_shares(spark, monkeypatch):
    """Documents of a run of the mixture are packed before the next run, and every prefix has the shares."""
    monkeypatch.setattr(packing, "RANGE_DOCS", 16, raising=False)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    position = {r.doc_id: r.position for r in mixing.mix(docs.select("doc_id", "source")).select("doc_id", "mix.position").collect()}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    shares = {r.source: r.share for r in mixing.source_shares(docs, F.col("source"), None, 0.5, mixing.PERIOD).collect()}
    rows = corpus_pipeline.sequence_packing(spark, docs, SF).collect()
    first = {}
    for r in sorted(rows, key=lambda r: r.sequence_id):
        first.setdefault(r.doc_id, r.sequence_id)
    assert set(first) == set(position)
    ranges = {}
    for r in rows:
        ranges.setdefault(position[r.doc_id] // 16, set()).add(r.sequence_id)
    for a, b in zip(sorted(ranges), sorted(ranges)[1:]):
        assert max(ranges[a]) < min(ranges[b])
    assert set.union(*ranges.values()) == set(range(1 + max(r.sequence_id for r in rows)))
    left = {s: sum(v == s for v in source.values()) for s in shares}
    docs_in = [d for _, d in sorted((position[d] // 16, d) for d in position)]
    for n in range(16, len(docs_in), 16):
        seen = {s: sum(source[d] == s for d in docs_in[:n]) for s in shares}
        if any(seen[s] == left[s] for s in shares):
            break
        assert all(abs(seen[s] - q * n / sum(shares.values())) < 1.001 for s, q in shares.items())


def test_packing_follows_the_files_of_the_mixing_stage(spark, monkeypatch):
    """What the stage writes decides the sequences: another order of the same rows gives other sequences."""
    monkeypatch.setattr(packing, "RANGE_DOCS", 16, raising=False)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = corpus_pipeline.source_mixing(spark, docs, SF)
    position = {r.doc_id: r.position for r in mixing.mix(docs.select("doc_id", "source")).select("doc_id", "mix.position").collect()}
    backwards = mixed.orderBy(F.desc("doc_id"))
    last = max(position)
    for table, place in ((mixed, position), (backwards, {k: last - k for k in position})):
        written = materialize(table, "ordered")
        ranges = {}
        for r in corpus_pipeline.sequence_packing(spark, written, SF).collect():
            ranges.setdefault(place[r.doc_id] // 16, set()).add(r.sequence_id)
        assert all(max(ranges[a]) < min(ranges[b]) for a, b in zip(sorted(ranges), sorted(ranges)[1:]))


def test_stages_take_odd_rows(spark, edges):
    """Nulls, empty and long texts, repeated rows and columns with clashing names pass all stages."""
    docs = edges
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == edges.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
    empty = edges.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
