import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import features, licenses, quality_gam, quality_rules
from tests.llm.conftest import edge_rows, prose


def plain_counts(text):
    """The contract's figures, counted slowly."""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if __import__("re").search("[^\x20\x09-\x0d]", x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 500 else len(lines) - len(set(lines))
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": dup, "n_repeat_words": len(covered),
    }


def test_counts_equal_plain_ones():
    rng = random.Random(3)
    texts = [r[1] for r in edge_rows()] + ["".join(rng.choices("ab #|\n\t\x0b\xa0é<", k=rng.randint(0, 60))) for _ in range(500)]
    got = features.count_texts(texts)
    for i, text in enumerate(texts):
        assert {k: got[k][i] for k in plain_counts(text)} == plain_counts(text), text


def test_rules_on_edge_rows(edges, nothing):
    rows = quality_rules.quality_rules(edges).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(nothing).count() == 0
    assert quality_rules.kept_rows(nothing).columns == nothing.columns
    kept = quality_rules.kept_rows(edges)
    assert kept.columns == edges.columns
    assert kept.count() == sum(r.kept for r in rows)


def test_em_finds_bad_rule_and_bad_texts():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.9, 0.55])
    votes = np.where(rng.random((4000, 5)) < right, good[:, None], ~good[:, None])
    marks = np.where(rng.random((4000, 5)) < 0.2, "0", np.where(votes, "+", "-"))
    patterns, inverse, numbers = np.unique(["".join(m) for m in marks], return_inverse=True, return_counts=True)
    model = quality_rules.fit_votes(patterns.tolist(), numbers.tolist())
    assert ((model.posterior(patterns.tolist())[inverse] >= 0.5) == good).mean() > 0.95
    assert model.accuracies()[4] < 0.7 < model.accuracies()[0]
    assert (model.posterior(["00000"]) > 0.5).all()


@pytest.mark.parametrize("d", ["/root/testdata/sf0.01"])
def test_rules_and_classifier_agree_with_labels(spark, d):
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    judged = quality_rules.quality_rules(docs).join(labels, "doc_id").where(~F.col("base_failed"))
    assert judged.where((F.col("quality") == 1) & ~F.col("kept")).count() == 0
    assert judged.where((F.col("quality") == 0) & F.col("kept")).count() == 0
    scored = quality_gam.quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in scored if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97


def test_classifier_on_edge_rows(spark, edges, nothing):
    labels = spark.createDataFrame(
        [(0, 1, 0), (1, 1, None), (2, None, 1), (13, 0, 0), (13, 0, 0), (None, 1, 1), (12, 0, 0), (6, 7, 0)],
        "doc_id long, quality int, toxic int",
    )
    rows = quality_gam.quality_scores(edges, labels).collect()
    assert len(rows) == len(edge_rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 2}) == 1
    assert quality_gam.quality_scores(nothing, labels).count() == 0
    same = quality_gam.quality_scores(edges, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in same] == [0.5]
    taken = quality_gam.accepted(edges, labels)
    assert taken.columns == edges.columns and taken.count() == sum(r.predicted for r in rows)


def test_pair_tables_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit_gam(x, y, rounds=60)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    assert {(a, b) for a, b, *_ in model.pairs} >= {(0, 1)}


def plain_score(model, row):
    """One table entry per feature and per pair, looked up by counting the edges at or below a value."""
    bin_of = lambda edges, v: sum(1 for e in edges.tolist() if e <= v)
    odds = model.intercept + sum(t[bin_of(e, row[j])] for j, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
    odds += sum(t[bin_of(ea, row[a]), bin_of(eb, row[b])] for a, b, ea, eb, t in model.pairs)
    return 1 / (1 + np.exp(-odds))


def test_scores_of_the_whole_table_equal_plain_lookups(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model, _ = quality_gam.fit_quality(docs, labels)
    got = {r.doc_id: r.score for r in quality_gam.quality_scores(docs, labels).collect()}
    for r in docs.collect():
        row = quality_gam.feature_matrix(features.count_texts([r.text]))[0]
        assert got[r.doc_id] == pytest.approx(plain_score(model, row))


def test_one_step_of_a_tree_equals_all_cuts():
    """A tree of depth 1 takes the cut with the largest gain of all."""
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(1, 12))
        grad, hess = rng.normal(size=n), rng.random(n) + 0.1
        step, gain = quality_gam.leaf_values(grad, hess, 1, 1.0)
        cuts = [grad.sum() ** 2 / (hess.sum() + 1)]
        cuts += [grad[:i].sum() ** 2 / (hess[:i].sum() + 1) + grad[i:].sum() ** 2 / (hess[i:].sum() + 1) for i in range(1, n)]
        assert gain == pytest.approx(max(cuts))
        assert len(set(np.round(step, 12))) <= 2


def test_recurring_ids_bring_one_row_each(spark):
    """An id that recurs many times in the documents weighs no more, and brings no more rows, than any other."""
    counted = spark.createDataFrame([(i % 3, *[i] * len(features.COUNTS)) for i in range(3000)], ["doc_id", *features.COUNTS])
    drawn = spark.createDataFrame([(0, 1), (2, 0), (9, 1)], "doc_id long, _label int")
    x, y = quality_gam.training_sample(counted, drawn, "doc_id")
    assert len(x) == 2 and sorted(y) == [0.0, 1.0]


EXPRESSIONS = {
    "mit": ({"mit"}, 0.1),
    "mit or gpl-3.0-only": ({"mit"}, 0.1),
    "mit and gpl-3.0-only": ({"mit", "gpl-3.0-only"}, 0.7),
    "gpl-2.0-only with classpath-exception-2.0 or agpl-3.0": ({"gpl-2.0-only with classpath-exception-2.0"}, 0.35),
    "(mit or gpl-2.0-only) and (apache-2.0 or mpl-2.0)": ({"mit", "apache-2.0"}, 0.1),
    "mit or apache-2.0 and gpl-3.0-only": ({"mit"}, 0.1),
    "": None, "mit or": None, "(mit": None, "mit)": None, "or mit": None, "mit gpl": None, "()": None,
}


@pytest.mark.parametrize("expression", EXPRESSIONS)
def test_licence_expressions(expression):
    assert licenses.evaluate(expression) == EXPRESSIONS[expression]


def test_licence_places_equal_plain_ones():
    rng = random.Random(8)
    parts = ["cc", "by", "CC-BY", "general public license", "All Rights", "reserved.", "é", "x", "\n", "general", "public", "Kelvin: K"]
    for _ in range(400):
        text = " ".join(rng.choices(parts, k=rng.randint(0, 25)))
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = __import__("re").findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
        found = [
            (i, label) for phrase, label in licenses.BASE_PHRASES.items()
            for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
        ]
        places = [i for i, _ in found]
        n_words, n_base, first, last, base, labels, score = licenses.Scanner().scan(text)
        assert (n_words, n_base, first, last) == (len(words), len(found), min(places, default=None), max(places, default=None))
        assert base == ",".join(sorted({label for _, label in found}))
        assert set(filter(None, base.split(","))) <= set(labels.split(",")) and 0 <= score <= 1


def test_licence_scan_of_edge_rows(spark, edges, nothing):
    rows = licenses.license_scan(edges).collect()
    assert len(rows) == len(edge_rows()) and all(r.n_base == 0 and r.first_word is None for r in rows)
    assert licenses.license_scan(nothing).count() == 0
    tagged = spark.createDataFrame([(1, "// SPDX-License-Identifier: (MIT OR Apache-2.0)\nx"), (2, "SPDX-License-Identifier: AND")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.license_scan(tagged).collect()}
    assert got == {1: "mit", 2: "invalid-expression"}


def test_long_prose_is_kept(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, prose(rng, 150)) for i in range(60)], "doc_id long, text string")
    assert quality_rules.kept_rows(docs).count() == 60
