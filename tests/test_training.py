import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import evaluate, model, training


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (run, "A", "alpha", f"the {'good' if i % 3 else 'bad'} word{i % 7} x{i}", int(i % 3 > 0), "dev" if i % 5 == 0 else "train")
        for run in ("one", "two") for i in range(240)
    ] + [("two", "B", "beta", "the bad thing", 2, "train"), ("lone", "B", "beta", "good", 1, "train"), ("lone", "B", "beta", "bad", 0, "train")]
    frame = spark.createDataFrame(data, "run string, label string, label_name string, text string, target int, split string")
    return training.numbered_rows(training.with_run_weights(frame)).repartition(3, "numbers").cache()


def test_runs_learn_and_the_choice_is_the_best_candidate(rows):
    models, choices = training.fit_runs(rows, ["one", "two", "lone"], [1, 2, 4])
    chosen = {r.run: (r.best, r.previous) for r in choices.collect()}
    assert set(chosen) == {"one", "two", "lone"} and chosen["lone"] == (1, 1)
    scored = training.score_runs(rows.where("target <> 2"), {n: m["best"] for n, m in models.items()})
    assert scored.where("prob < 0 OR prob > 1 OR prob IS NULL").count() == 0
    wrong = scored.where("model = run AND pred <> target").count()
    assert wrong < 0.02 * scored.where("model = run").count()
    assert "numbers" not in scored.columns and scored.count() == 3 * rows.where("target <> 2").count()


def test_fits_are_repeatable(rows):
    first, _ = training.fit_runs(rows, ["one", "two"], [2])
    again, _ = training.fit_runs(rows, ["one", "two"], [2])
    for run in ("one", "two"):
        assert (first[run]["best"].values == again[run]["best"].values).all()
    # A run does not depend on the others.
    alone, _ = training.fit_runs(rows.where("run = 'two'"), ["two"], [2])
    assert np.allclose(alone["two"]["best"].values, first["two"]["best"].values, atol=1e-6)


def test_losses_are_those_of_the_scored_rows(rows):
    weights, before = training.one_pass(rows.where("target <> 2"), {"one": training.Weights.zero()})
    assert before["one"] == pytest.approx(np.log(2) * (1 + rows.where("run = 'one' AND split = 'dev' AND target = 1").agg(F.sum(F.col("weight") - 1)).first()[0] / 48))
    _, after = training.one_pass(rows.where("target <> 2 AND split = 'dev'"), weights)
    dev = training.score_runs(rows.where("run = 'one' AND split = 'dev'"), weights)
    assert after["one"] == pytest.approx(evaluate.weighted_log_loss(dev, [], pos_weight="weight").first()[0])
    assert after["one"] < before["one"]


def test_one_task_equals_a_plain_loop(rows):
    single = rows.where("run = 'one' AND split = 'train'").coalesce(1)
    data = single.collect()
    plain = np.zeros(training.NUMBERS)
    squares = np.zeros(training.NUMBERS)
    for a in range(0, len(data), training.BATCH_ROWS):
        part = data[a : a + training.BATCH_ROWS]
        slope = np.zeros(training.NUMBERS)
        for r in part:
            p = 1 / (1 + np.exp(-plain[r.numbers].sum()))
            slope[r.numbers] += r.weight * (p - r.target) / len(part)
        squares += slope * slope
        touched = np.flatnonzero(slope)
        plain[touched] -= training.RATE * slope[touched] / np.sqrt(squares[touched] + 1e-12)
    learned, _ = training.one_pass(single, {"one": training.Weights.zero()})
    assert np.allclose(learned["one"].values, plain, atol=1e-3)


def test_candidates_cost_one_pass_per_epoch(rows, monkeypatch):
    passes = []
    real = training.one_pass
    monkeypatch.setattr(training, "one_pass", lambda r, w: passes.append(len(w)) or real(r, w))
    training.fit_runs(rows, ["one", "two", "lone"], [1, 3, 2])
    assert passes == [3, 3, 3, 3]


def test_numbers_hold_the_tokens(spark):
    frame = spark.createDataFrame([("Alpha", "beta ALPHA beta"), ("x", ""), ("", "")], "label_name string, text string")
    got = training.numbered_rows(frame).collect()
    tokens = [r.tokens for r in model.pair_features(frame).collect()]
    assert [len(r.numbers) for r in got] == [1 + len(set(t)) for t in tokens] and all(r.numbers[0] == 0 for r in got)


def test_empty_tables(rows):
    models, choices = training.fit_runs(rows.limit(0), ["one"], [1, 2])
    assert [tuple(r) for r in choices.collect()] == [("one", 1, 1)] and not models["one"]["best"].values.any()
    assert training.score_runs(rows.limit(0), {"one": models["one"]["best"]}).count() == 0


def test_words_are_cut_once_for_all_tokens(spark):
    frame = spark.createDataFrame([("Alpha", "beta ALPHA beta"), ("x", None), (None, "")], "label_name string, text string")
    plan = training.numbered_rows(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(text") == 1 and plan.count("split(lower(label_name") == 1
    # Rows stay, as their numbers do: null where the text or the name is null.
    assert [r.numbers is None for r in training.numbered_rows(frame).collect()] == [False, True, True]
