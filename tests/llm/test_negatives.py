from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from labelloom.llm import hard_negatives

FIELDS = "vec_id long, embedding array<double>, label int, _key string, _x int, rank int"


def brute_force(rows, percent=80, positives=5, negatives=5):
    """(anchor, positive, rank, negative, scores) of whole-number rows (id, vector, label)."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[1]]
    out = []
    for a in [i for i, r in enumerate(rows) if r[0] is not None and r[0] % 100 == 0]:
        scored = [(-sum(x * y for x, y in zip(rows[a][1], r[1])), r[0] is None, r[0] or 0, r) for i, r in enumerate(rows) if i != a and len(r[1]) == len(rows[a][1])]
        scored.sort(key=lambda s: s[:3])
        same = [s for s in scored if s[3][2] == rows[a][2]]
        other = [s for s in scored if s[3][2] != rows[a][2]]
        for p in same[:positives]:
            fit = [s for s in other if percent * -p[0] <= 100 * -s[0] <= 100 * -p[0]]
            out += [(rows[a][0], p[3][0], i, s[3][0], -p[0], -s[0]) for i, s in enumerate(fit[:negatives], 1)]
    return out


def made_rows(n=400, dims=70):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        wide = rng.normal(size=dims) * rng.choice([1, 30])
        rows.append((i, np.floor(wide * 20).astype(int).tolist(), int(rng.choice([1, 1, 1, 2, 3]))))
    for i in range(40):  # ties and repeated rows
        rows.append((1000 + i, rows[i % 5][1], 1 + i % 2))
    rows += [rows[0], rows[0], rows[100], (200, [0] * dims, 2), (300, [1] * dims, 9)]
    rows += [(700 + 100 * i, [i, 3 - i, 2], i % 2) for i in range(6)] + [(None, [1, 1, 1], 0), (None, [1, 1, 1], 1)]
    rows += [(2000, [], 1), (2001, [], 1), (2002, [], 2), (2003, None, 1), (2100, [None] * dims, 1), (2200, rows[3][1], None)]
    return rows


def frame(spark, rows):
    wide = [(i, None if v is None else [None if x is None else float(x) for x in v], label, "k", 3, 1) for i, v, label in rows]
    return spark.createDataFrame(wide, FIELDS).repartition(3)


def mined(df, **options):
    rows = hard_negatives.mine(hard_negatives.whole_numbers(df, 1, "embedding", "label"), F.col("vec_id") % 100 == 0, **options)
    return sorted(map(tuple, rows.collect()), key=repr)


def test_hard_negatives_equal_brute_force(spark):
    rows = made_rows()
    want = sorted(brute_force(rows), key=repr)
    assert mined(frame(spark, rows)) == want
    assert any(r[3] is None for r in want) and len({r[0] for r in want}) > 8


def test_hard_negatives_in_many_blocks(spark):
    rows = made_rows()
    want = sorted(brute_force(rows, percent=50, positives=3, negatives=7), key=repr)
    assert mined(frame(spark, rows), percent=50, positives=3, negatives=7, block_rows=60, block_anchors=2) == want


def test_hard_negatives_of_empty_tables(spark):
    empty = frame(spark, made_rows()).limit(0)
    assert mined(empty) == []
    lone = [(100, [1, 2], 1), (101, [1, 2], 2)]
    assert mined(frame(spark, lone)) == brute_force(lone) == []


def test_whole_numbers_drop_rows_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, -0.001], 1), (2, [inf, 0.0], 1), (3, [nan, 0.0], 1), (4, [None, 0.0], 1), (5, None, 1), (6, [1.0], None), (None, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {(r.vec_id, tuple(r.embedding)) for r in hard_negatives.whole_numbers(df, 256, "embedding", "label").collect()}
    assert got == {(1, (128, -1)), (None, ())}


def test_intervals_hold_the_scores_and_rule_pairs_out():
    rng = np.random.default_rng(1)
    for dims in (1, 5, 64, 130):
        vectors = rng.integers(-300, 300, (300, dims))
        anchors, rows = hard_negatives.Anchors(vectors[:40]), hard_negatives.Coded(vectors, *hard_negatives.code(vectors))
        exact = vectors[:40] @ vectors.T
        seen = defaultdict(int)

        def checked(anchor, low, high):
            seen["levels"] += 1
            value = exact.ravel()
            assert (low <= value).all() and (value <= high).all()
            return np.ones(len(anchor), dtype=bool)

        pairs = np.repeat(np.arange(40), 300), np.tile(np.arange(300), 40)
        anchor, row, score = hard_negatives.refine(anchors, rows, *pairs, checked)
        assert (score == exact[anchor, row]).all() and seen["levels"] == hard_negatives.LEVELS
    top = np.sort(exact, axis=1)[:, -6]
    left = hard_negatives.refine(anchors, rows, *pairs, lambda anchor, low, high: high >= top[anchor])[0]
    assert 6 * 40 <= len(left) < 0.5 * len(pairs[0])
