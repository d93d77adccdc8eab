"""Label comparison on bits, balancing and ancestry against plain definitions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelloom.functions.numeric import draw, draw_bits, drawn_within
from labelloom.operators import articles, evaluate, hierarchy, labels, sampling


@pytest.fixture(scope="module")
def marks():
    """Scopes of one, three and 150 labels, one label in two scopes, members that are no labels of their scope."""
    rng = random.Random(2)
    scope_of = [(f"a{i:03}", "big") for i in range(150)] + [("b0", "one"), ("c0", "few"), ("c1", "few"), ("c2", "few"), ("a007", "few")]
    members = [(s, x) for x, s in scope_of if rng.random() < 0.4] + [("big", "T"), ("few", "T"), ("one", "U"), ("none", "c0")]
    names = sorted({x for x, _ in scope_of}) + ["T", "U", "stray"]
    pick = lambda: [(rng.randrange(60), rng.choice(names)) for _ in range(900)]
    return scope_of, members, pick(), pick()


@pytest.fixture(scope="module")
def frames(spark, marks):
    scope_of, members, golden, weak = marks
    return (
        spark.createDataFrame(golden, "pmid long, label string").repartition(3),
        spark.createDataFrame(weak, "pmid long, label string").repartition(3),
        spark.createDataFrame(scope_of + scope_of[:5], "label string, scope string"),
        spark.createDataFrame(members, "scope string, member string"),
    )


def plain(marks):
    """(pmid, label, scope) -> (gold, weak, valid) for all articles and labels in scope."""
    scope_of, members, golden, weak = marks
    member, gold, low = defaultdict(set), set(golden), set(weak)
    for s, m in members:
        member[s].add(m)
    of_article = defaultdict(set)
    for p, x in gold:
        of_article[p].add(x)
    out = {}
    for p in {p for p, _ in gold | low}:
        for x, s in scope_of:
            valid = bool(of_article[p] & member[s])
            out[p, x, s] = ((p, x) in gold, (p, x) in low and valid, valid)
    return out


def test_pairs_are_judged_in_scopes_of_any_size(frames, marks):
    want = Counter({(p, x, "TP" if g and w else "FP" if w else "FN"): 0 for (p, x, _), (g, w, _) in plain(marks).items() if g or w})
    for (p, x, _), (g, w, _) in plain(marks).items():
        if g or w:
            want[p, x, "TP" if g and w else "FP" if w else "FN"] += 1
    assert Counter(tuple(r) for r in labels.compare_labels(*frames).collect()) == want


def test_label_counts_in_scopes_of_any_size(frames, marks):
    want = defaultdict(lambda: [0] * 5)
    for (_, x, s), (g, w, v) in plain(marks).items():
        for i, hit in enumerate((w, w and not g, g and not w, g, v and not g and not w)):
            want[x, s][i] += hit
    columns = ("total_weak", "fp", "fn", "total_gold", "tn")
    got = [(r.label, *(r[c] for c in columns)) for r in labels.label_frequencies(*frames).collect()]
    assert sorted(got) == sorted((x, *v) for (x, _), v in want.items())


def test_comparison_collects_no_labels(frames):
    for df in (labels.compare_labels(*frames), labels.label_frequencies(*frames), labels.filter_weak(*frames)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_set" not in plan and "collect_list" not in plan


def test_group_rows_in_scopes_of_any_size(spark, frames, marks):
    groups = spark.createDataFrame([(f"a{i:03}", i % 2) for i in range(0, 150, 7)] + [("c1", 1), ("b0", 2)], "label string, grp int")
    group_of = defaultdict(list)
    for r in groups.collect():
        group_of[r.label].append(r.grp)
    want = defaultdict(lambda: [False] * 5 + [0])
    for (p, x, _), (g, w, v) in plain(marks).items():
        for grp in group_of[x]:
            row = want[grp, p]
            row[:5] = [a or b for a, b in zip(row, (v, g, w, w and not g, g and not w))]
            row[5] += w
    columns = ("valid", "gold", "weak", "fp", "fn", "n_weak_valid")
    got = {(r.grp, r.pmid): [r[c] for c in columns] for r in labels.group_documents(*frames, groups).collect()}
    assert {k: v for k, v in got.items() if any(v)} == {k: v for k, v in want.items() if any(v)}


@pytest.mark.parametrize("per_positive", [0, 1, 7, 1000, -1])
def test_balance_keeps_exactly_the_first_draws(spark, per_positive):
    rng = random.Random(4)
    data = [(i, x, s, t) for i in range(3000) for x, s, t in [("hot" if i % 3 else f"c{i % 5}", rng.choice(["train", "dev"]), rng.choice([0] * 30 + [1, -1]))]]
    rows = spark.createDataFrame(data + [(9000, "lone", "train", 0), (9001, "odd", "dev", -1)], "pmid long, label string, split string, target int").repartition(4)
    drawn = rows.withColumn("bits", draw_bits(F.lit("b"), F.lit(5), F.lit("|"), F.col("label"), F.lit("|"), F.col("pmid"))).collect()
    groups = defaultdict(list)
    for r in drawn:
        groups[r.label, r.split].append(r)
    want = []
    for part in groups.values():
        negatives = sorted((r for r in part if r.target == 0), key=lambda r: (r.bits, r.pmid))
        limit = len(negatives) if per_positive < 0 else per_positive * sum(r.target == 1 for r in part)
        want += [(r.pmid, r.label) for r in part if r.target != 0] + [(r.pmid, r.label) for r in negatives[:limit]]
    got = sampling.balance_negatives(rows, per_positive, 5)
    assert got.columns == rows.columns
    assert sorted((r.pmid, r.label) for r in got.collect()) == sorted(want)


def test_grid_copies_rows_only_for_their_runs(spark):
    rows = spark.createDataFrame([(i, f"x{i % 4}", "train", int(i % 9 == 0)) for i in range(200)], "pmid long, label string, split string, target int")
    runs = [
        {"name": "all", "seed": 1, "per_positive": None, "labels": None},
        {"name": "two", "seed": 2, "per_positive": 2, "labels": ["x1", "x3", "gone"]},
        {"name": "gone", "seed": 3, "per_positive": 0, "labels": ["gone"]},
    ]
    of_label = {(r.label, r.run) for r in sampling.runs_per_label(rows, runs).collect()}
    assert of_label == {(f"x{i}", run) for i in range(4) for run in ("all", "two", "gone") if run != "two" or i % 2}
    got = Counter((r.run, r.label, r.target) for r in sampling.grid_rows(rows, runs).collect())
    by_label = Counter((f"x{i % 4}", int(i % 9 == 0)) for i in range(200))
    for (x, t), n in by_label.items():
        assert got["all", x, t] == n and got["gone", x, t] == (n if t else 0)
        if x in ("x1", "x3"):
            assert got["two", x, t] == (n if t else 2 * by_label[x, 1])


def test_descendants_of_heads_are_those_of_the_closure(spark):
    rng = random.Random(7)
    numbers = ["A", "B"]
    for _ in range(150):
        numbers.append(f"{rng.choice(numbers)}.{rng.randrange(10, 30)}")
    held = defaultdict(set)
    for n in set(numbers):
        held[f"D{rng.randrange(60)}"].add(n)
    records = spark.createDataFrame([(d, sorted(n)) for d, n in held.items()], "descriptor_ui string, tree_numbers array<string>")
    closure = hierarchy.ancestors(records)
    heads = spark.createDataFrame([(d,) for d in sorted(held)[::4]] + [("D0",), ("gone",)], "head string")
    among = {r.head for r in heads.collect()}
    want = {(r.ancestor, r.descendant) for r in closure.collect() if r.ancestor in among}
    assert {tuple(r) for r in hierarchy.descendants_of(records, heads).collect()} == want
    assert {tuple(r) for r in hierarchy.branches_of(records, heads).collect()} == want | {(h, h) for h in among}
    every = {(r.ancestor, r.descendant) for r in closure.collect()}
    parents = {(r.parent, r.label) for r in hierarchy.label_parents(records).collect()}
    upper, lower = (records.toDF(f"{c}_ui", c) for c in ("upper", "lower"))
    pairs = upper.join(lower, F.lit(True)).withColumns(
        {"above": hierarchy.is_above(F.col("upper"), F.col("lower")), "parent": hierarchy.is_parent(F.col("upper"), F.col("lower"))}
    )
    for r in pairs.collect():
        assert r.above == ((r.upper_ui, r.lower_ui) in every) and r.parent == ((r.upper_ui, r.lower_ui) in parents)


def test_periods_are_counted_together(spark):
    golden = spark.createDataFrame([(1, "m1", 1), (1, "m2", 2), (2, "m1", 2), (3, "m3", 4), (4, "x", 7)], "pmid long, label string, periods int")
    branches = spark.createDataFrame([("p", "m1"), ("p", "m2"), ("q", "m2"), ("q", "m3")], "parent string, member string")
    hosts = spark.createDataFrame([("s", "p"), ("s", "q"), ("t", "q")], "scope string, parent string")
    got = {tuple(r) for r in articles.periods_of_hosts(golden, hosts, branches).collect()}
    assert got == {("s", 1, 3), ("s", 2, 2), ("s", 3, 4), ("t", 1, 2), ("t", 3, 4)}


def test_balance_writes_no_rows_of_groups_that_stay_whole(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"x{i % 4}", "train", int(i % 9 == 0)) for i in range(2000)], "pmid long, label string, split string, target int")
    written, real = {}, sampling.materialize
    monkeypatch.setattr(sampling, "materialize", lambda df, name: written.update({name: df.count()}) or real(df, name))
    assert sampling.balance_negatives(rows, 1000, 5).count() == 2000
    assert written == {"group-limits": 4}
    # Of a group that is cut, what lies before the range of the last draw and in it.
    few = sampling.balance_negatives(rows.where("label = 'x1'"), 1, 5)
    kept = few.where("target = 0").count()
    assert kept == few.where("target = 1").count() <= written["first-draws"] < 3 * kept


def test_balance_counts_repeated_rows(spark):
    rows = [(1, "hot", "train", 0)] * 400 + [(2, "hot", "train", 0)] * 300 + [(i, "hot", "train", 0) for i in range(3, 50)]
    frame = spark.createDataFrame([*rows, *[(1000 + i, "hot", "train", 1) for i in range(90)]], "pmid long, label string, split string, target int")
    for per_positive in (1, 5, 8):
        got = sampling.balance_negatives(frame, per_positive, 3)
        assert got.where("target = 0").count() == min(90 * per_positive, len(rows)) and got.where("target = 1").count() == 90


def test_articles_are_split_before_their_labels_come_up(spark):
    golden = spark.createDataFrame([(i, "a0") for i in range(30)], "pmid long, label string")
    weak = spark.createDataFrame([(1, "a1")], "pmid long, label string")
    scope = spark.createDataFrame([(f"a{i}", "s") for i in range(20)], "label string, scope string")
    members = scope.select("scope", F.col("label").alias("member"))
    seen = []
    split = lambda articles: seen.append(articles.count()) or sampling.split_rows(articles)
    rows = labels.relabel_dataset(golden, weak, scope, members, of_articles=split)
    assert seen == [30] and rows.count() == 30 * 20 - 1
    plain = sampling.split_rows(labels.relabel_dataset(golden, weak, scope, members))
    assert rows.columns == plain.columns and sorted(rows.collect()) == sorted(plain.collect())


def test_draws_within_a_share_are_those_of_the_numbers(spark):
    rows = spark.range(3000).withColumn("r", draw(F.lit("d"), F.col("id")))
    edge = rows.where("id = 7").first().r
    for share in (-0.1, 0.0, 0.25, edge, 0.8, 1.0, 1.5):
        assert rows.where(drawn_within(share, F.lit("d"), F.col("id")) != (F.col("r") <= F.lit(share))).count() == 0
    assert rows.where(drawn_within(edge, F.lit("d"), F.col("id"))).where("id = 7").count() == 1


def test_focus_is_decided_by_the_rows(spark):
    rows = spark.createDataFrame([(i, f"x{i % 3}") for i in range(30)], "pmid long, label string")
    focus = lambda *names: sampling.focus_labels(rows, spark.createDataFrame([(n,) for n in names], "label string"))
    assert focus("x1", "gone").count() == 10 and focus("gone").count() == 30


def test_log_losses_of_several_modes_come_from_one_reading(spark):
    rows = spark.createDataFrame([("a", 1, 0.7, 3.0), ("a", 0, 0.4, 3.0), ("b", 1, 1.0, 2.0)], "label string, target int, prob double, pos_weight double")
    both = evaluate.weighted_log_loss(rows, ["label"], weight_mode=["positive", "all"])
    single = {(m, r.label, r.log_loss) for m in ("positive", "all") for r in evaluate.weighted_log_loss(rows, ["label"], weight_mode=m).collect()}
    assert {(r["mode"], r.label, r.log_loss) for r in both.collect()} == single
    with pytest.raises(ValueError):
        evaluate.weighted_log_loss(rows, ["label"], weight_mode="none")


@pytest.mark.parametrize("kind", ["NWL", "PWL"])
def test_group_datasets_equal_their_definition(spark, marks_of_groups, kind):
    golden, weak, scope_of, member_of, groups = marks_of_groups
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = labels.group_dataset(
        frame(golden, "pmid long, label string"), frame(weak, "pmid long, label string"), frame(scope_of, "label string, scope string"),
        frame(member_of, "scope string, member string"), frame(groups, "label string, grp int"), kind, ratio_kept=0.5,
    )
    drawn = {(r.grp, r.pmid) for r in spark.range(80).withColumnRenamed("id", "pmid").crossJoin(spark.range(3).select(F.col("id").cast("int").alias("grp"))).where(draw(F.lit("u10|"), F.col("grp"), F.lit("|"), F.col("pmid")) <= 0.5).collect()}
    want = {}
    for g in {x for _, x in groups}:
        of_group = sorted({x for x, y in groups if y == g})
        for pmid in {p for p, _ in golden}:
            mine = {x for p, x in golden if p == pmid}
            scopes = {s for s, m in member_of if m in mine}
            valid = {x for x in of_group if any(y == x and s in scopes for y, s in scope_of)}
            gold = {x for x in of_group if x in mine and any(y == x for y, _ in scope_of)}
            found = {x for x in of_group if (pmid, x) in weak and x in valid}
            if not valid:
                continue
            if kind == "PWL" and found:
                want[g, pmid] = (sorted(valid), sorted(found - gold), sorted(found & gold))
            if kind == "NWL" and not found and (gold or (g, pmid) in drawn):
                want[g, pmid] = (sorted(valid), sorted(gold), sorted(set(of_group) - gold))
    assert {(r.grp, r.pmid): (sorted(r.valid_labels), sorted(r.positive), sorted(r.negative)) for r in got.collect()} == want and want
    # What is shuffled per article are words of bits, not lists of labels.
    folded = [line for line in got._jdf.queryExecution().toString().splitlines() if "collect_list" in line and "pmid" in line]
    assert folded and all("collect_list(struct(slot" in line or "collect_list(named_struct(slot" in line for line in folded)


@pytest.fixture(scope="module")
def marks_of_groups():
    """Groups across scopes, a scope of 70 labels, one label in two scopes."""
    rng = random.Random(6)
    scope_of = [(f"a{i:02}", "big") for i in range(70)] + [("b0", "few"), ("b1", "few"), ("a03", "few")]
    member_of = [("big", "a01"), ("big", "a66"), ("few", "b0"), ("few", "T")]
    groups = [(f"a{i:02}", 0) for i in (1, 2, 3, 65, 66)] + [("b0", 0), ("b1", 1), ("a03", 1), ("a04", 2), ("a69", 2)]
    names = ["a01", "a02", "a03", "a04", "a65", "a66", "a69", "b0", "b1", "T"]
    pick = lambda n: sorted({(rng.randrange(80), rng.choice(names)) for _ in range(n)})
    return pick(160), pick(60), scope_of, member_of, groups
