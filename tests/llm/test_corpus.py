import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import components, jaccard_join, lm_scores, mixing, neighbours, rtree, shingles
from tests.llm.conftest import edge_rows, prose

SF = "/root/testdata/sf0.001"


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]


def plain_groups(rows, size, percent):
    """{key: (set size, smallest key reachable)}, by comparing all pairs."""
    sets, parent = [], {}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for key, text in rows:
        words = words_of(text)
        found = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        sets.append((key, found))
        parent[key] = key
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return [(key, len(found), find(key)) for key, found in sets]


def near_copies(rng, groups, copies, words):
    """Texts with chains of small edits, so that links, near misses and chains all occur."""
    texts = []
    for _ in range(groups):
        base = prose(rng, words).split(" ")
        for _ in range(copies):
            edited = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                edited[rng.randrange(len(edited))] = prose(rng, 1, 6)
            texts.append(" ".join(edited))
            if rng.random() < 0.3:
                base = edited
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("size", "percent", "words"), [(3, 90, 120), (5, 80, 60), (3, 90, 9), (5, 80, 12)])
def test_jaccard_groups_equal_all_pairs(spark, size, percent, words):
    rng = random.Random(words)
    texts = near_copies(rng, 6, 25, words) + [prose(rng, n) for n in range(1, 30)] + ["the " * k for k in range(12)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, jaccard_join.near_duplicates(docs, size, percent).collect()))
    assert got == sorted(plain_groups(rows, size, percent))


def test_large_cluster_is_joined_tile_by_tile(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE_SETS", 8)
    rng = random.Random(1)
    rows = list(enumerate(near_copies(rng, 2, 150, 70)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.near_duplicates(docs, 3, 90).collect()))
    assert got == sorted(plain_groups(rows, 3, 90))


def test_every_link_between_different_texts_is_counted(spark, monkeypatch):
    """Groups of near copies and copies, an id with two texts, over several tiles: all pairs, not a forest."""
    monkeypatch.setattr(jaccard_join, "TILE_SETS", 8)
    rng = random.Random(11)
    texts = near_copies(rng, 3, 40, 250)
    rows = list(enumerate(texts)) + [(500 + i, t) for i, t in enumerate(texts[:20])]
    rows += [(7, prose(rng, 40)), (7, texts[50]), (900, None), (901, " "), (None, texts[3])]
    sets = [(k, frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2))) for k, w in ((k, words_of(t)) for k, t in rows)]

    def link(x, y):
        return bool(x and y) and 100 * len(x & y) >= 90 * len(x | y)

    least = {}
    for k, x in sets:
        least[x] = min([v for v in (k, least.get(x)) if v is not None], default=None)
    want = sorted((k is None, k, len(x), least[x] if x else None, sum(link(x, y) for _, y in sets) - bool(x)) for k, x in sets if k is not None)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_join.linked_documents(docs, 3, 90)
    found = got.collect()
    assert sorted((False, r.doc_id, r.n_shingles, r.class_id, r.n_links) for r in found if r.doc_id is not None) == want
    assert [r.n_links for r in found if r.doc_id is None] == [sum(link(sets[3][1], y) for _, y in sets) - 1]
    groups = sorted(map(repr, map(tuple, jaccard_join.near_duplicates(docs, 3, 90).collect())))
    assert sorted(repr(tuple(r)[:3]) for r in found) == groups
    pairs = sorted(map(tuple, jaccard_join.links(docs, 3, 90).collect()))
    assert pairs == sorted(
        (*sorted((least[x], least[y])), len(x & y)) for x, y in itertools.combinations(list(least), 2) if link(x, y)
    )
    assert len(pairs) > 2 * len(least)  # no forest
    assert jaccard_join.linked_documents(docs.limit(0)).count() == 0


def test_jaccard_of_edge_rows(edges, nothing):
    got = jaccard_join.near_duplicates(edges, 3, 90).collect()
    assert len(got) == len(edge_rows())
    by_key = {r.doc_id: r.component_id for r in got}
    assert by_key[14] == 0 and by_key[15] == 1 and by_key[8] == 8 and by_key[9] == 9
    # Id 3 has two texts, one equal to that of id 6 and one to that of a row without an id.
    assert by_key[6] == 3 and sorted(r.component_id or -1 for r in got if r.doc_id is None) == [-1, 3]
    assert jaccard_join.near_duplicates(nothing).count() == 0
    kept = jaccard_join.one_per_group(edges, 3, 90)
    assert kept.columns == edges.columns
    # Both texts of id 3 stay: one of them is that of id 6, which goes.
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13]


def test_recurring_ids_lose_no_text(spark):
    """Ids that recur with unrelated texts, as in tables stacked from several dumps."""
    rng = random.Random(12)
    texts = [prose(rng, 60) for _ in range(40)]
    rows = [(i % 10, t, f"s{i}") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (50, texts[17], "copy"), (7, None, "x"), (7, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(4)
    kept = jaccard_join.one_per_group(docs, 3, 90)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text or "") for r in kept.collect())
    assert got == sorted([(i % 10, t) for i, t in enumerate(texts)] + [(7, ""), (7, "")])


def test_linked_documents_of_edge_rows(edges):
    """What op9 returns, on nulls, copies, one id with two texts, and columns with the names of its own."""
    rows = [(r[0], r[1]) for r in edge_rows()]
    sets = [frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if (w := words_of(t)) else frozenset() for _, t in rows]
    want = sorted(
        (k, len(x), sum(bool(x and y) and 100 * len(x & y) >= 90 * len(x | y) for y in sets) - bool(x))
        for (k, _), x in zip(rows, sets, strict=True) if k is not None
    )
    clashing = edges.withColumnsRenamed({"lang": "_text", "source": "component_id", "n_words": "_range", "score": "node"})
    got = jaccard_join.linked_documents(clashing, 3, 90).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_shingles, r.n_links) for r in got if r.doc_id is not None) == want


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(6)
    for percent in (80, 90):
        for n in [1, 2, 4, 5, 9, 10, 11, 19, 20, 33, 80, 400, 3000] * 3:
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = (2 * len(a)) * (100 - percent) // (100 + percent)
            gone = int(rng.integers(0, most + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, int(rng.integers(0, gone + 1))).astype(np.uint64)]))
            shared = shingles.overlap(a, b)
            if 100 * shared >= percent * (len(a) + len(b) - shared) and len(set(a.tolist()) ^ set(b.tolist())):
                assert set(shingles.signatures(a, percent).tolist()) & set(shingles.signatures(b, percent).tolist())


def test_shared_passages_join_no_clusters(spark):
    """Texts that each hold a few of some common passages hang together by them, but none is nearly all of a text."""
    rng = random.Random(21)
    passages = [prose(rng, 30) for _ in range(40)]
    texts = [" ".join([prose(rng, 60), *rng.sample(passages, 3)]) for _ in range(600)]
    texts += [texts[i] + " end" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    edges = jaccard_join.shared_shingles(docs, 5, 80, "doc_id", "text", 600 * 150)
    clusters = Counter(r.component for r in components.components(edges).collect())
    # By any passage in common, all texts are one cluster.
    assert max(clusters.values()) < 10
    groups = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs, 5, 80).collect()}
    assert groups == {i: i - 600 if i >= 600 else i for i in range(620)}


def test_linked_sets_offer_a_shingle_in_common():
    """Whatever the counts, also where shingles share a mark, and a key has several texts."""
    rng = np.random.default_rng(8)
    for percent in (80, 90, 100):
        base = [np.unique(rng.integers(0, 3_000, n)) for n in [1, 2, 4, 9, 10, 33, 80, 400] * 3]
        sets = [b for b in base] + [np.unique(np.concatenate([rng.permutation(b)[: max(1, len(b) * 19 // 20)], rng.integers(0, 3_000, len(b) // 20)])) for b in base]
        keys = np.minimum(np.arange(len(sets)), len(sets) - 2)
        for lost in (1, 7):  # shingles share marks
            marks, nodes = np.concatenate(sets) // lost, np.repeat(keys, [len(s) for s in sets])
            at, times = jaccard_join.in_several(marks)
            assert times.tolist() == [int((marks == m).sum()) for m in marks[at]] and set(at) == {i for i, m in enumerate(marks) if (marks == m).sum() > 1}
            found = jaccard_join.rarest(nodes[at], marks[at], times, keys, np.array([len(s) for s in sets]), percent)
            offered = {k: set() for k in keys.tolist()}
            for n, m in zip(nodes[at][found].tolist(), marks[at][found].tolist(), strict=True):
                offered[n].add(m)
            for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
                shared = len(np.intersect1d(a, b))
                if 100 * shared >= percent * (len(a) + len(b) - shared) and keys[i] != keys[j]:
                    assert offered[int(keys[i])] & offered[int(keys[j])]


def test_sets_of_many_texts_are_those_of_each():
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (0, 1, 2, 4, 5, 6, 700)] + [None, "", " \n", "a A a", prose(rng, 9_000), "x " * 50, "y"]
    hashes = {}
    for size in (1, 3, 5):
        for text, got in zip(texts, shingles.shingle_sets(texts, size), strict=True):
            words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
            want = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
            assert len(got) == len(want) and np.array_equal(got, np.unique(got)) and np.array_equal(got, shingles.shingle_set(text, size))
            assert hashes.setdefault((size, frozenset(want)), got.tobytes()) == got.tobytes()
        sets = shingles.shingle_sets(texts, size)
        assert shingles.fingerprints(sets) == [shingles.fingerprint(s) for s in sets]


def test_rtree_bound_loses_no_pair():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(150, 200)], rng.integers(0, 2**63, rng.integers(0, 20)).astype(np.uint64)])) for _ in range(300)]
    sizes = np.array([len(s) for s in sets])
    tree = rtree.RTree(rtree.count_points(sets), sizes)
    points = rtree.count_points(sets)
    for i in range(0, 300, 7):
        found = set(tree.candidates(points[i], int(sizes[i]), 90).tolist())
        for j in range(300):
            shared = shingles.overlap(sets[i], sets[j])
            if 100 * shared >= 90 * (sizes[i] + sizes[j] - shared):
                assert j in found


def test_components_of_hot_stars(spark, monkeypatch):
    """Hubs with most of the edges, linked by a chain, are broadcast and come out as by union-find."""
    monkeypatch.setattr(components, "HOT_NEIGHBOURS", 20)
    rng = random.Random(3)
    edges = [(h, rng.randrange(10_000, 13_000)) for h in (5, 700, 9_000) for _ in range(1200)] + [(i, i + 1) for i in range(20_000, 20_080)] + [(5, 700), (50_000, 20_000)]
    rows = spark.createDataFrame(edges, "u long, v long").repartition(6)
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {r.node: r.component for r in components.components(rows).collect()} == {n: find(n) for n in parent}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (5000, 4000)]
    rows = spark.createDataFrame([(max(e), min(e)) for e in edges], "u long, v long").repartition(5)
    got = {r.node: r.component for r in components.components(rows).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200))
    assert got[5000] == got[4000] == 4000
    assert components.components(rows.limit(0)).count() == 0


def test_scores_equal_plain_counts(edges, nothing):
    rows = lm_scores.lm_scores(edges).collect()
    texts = [(r[0], r[1]) for r in edge_rows()]
    tokens = [(k, [*words_of(t), None]) for k, t in texts]
    trains = [k is None or zlib.crc32(str(k).encode()) % 10 != 0 for k, _ in tokens]
    counts = Counter(w for (_, ws), train in zip(tokens, trains, strict=True) if train for w in ws)
    total, known = sum(counts.values()), len(counts)
    want = [
        (k is not None and not train, len(ws), sum(counts[w] > 0 for w in ws), total,
         round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (known + 1))) for w in ws), 4))
        for (k, ws), train in zip(tokens, trains, strict=True)
    ]
    got = [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows]
    assert sorted(got) == sorted(want)
    assert lm_scores.lm_scores(nothing).count() == 0


def test_automaton_is_a_distribution_and_equals_a_plain_walk():
    words = [(b"", 10), (b"a", 30), (b"b", 20), (b"c", 5)]
    arcs = [(1 * 5 + 2, 12), (1 * 5 + 0, 4), (4 * 5 + 1, 8), (2 * 5 + 1, 9)]
    total, known = 70, 6
    model = lm_scores.build_automaton(words, 10, arcs, total, known)
    root = {w: (c + 0.1) / (total + 0.1 * (known + 1)) for w, c in [*words, (b"d", 3), (b"e", 2), (b"?", 0)]}
    assert math.isclose(sum(root.values()), 1)
    for context in range(5):
        if context == 0:
            continue
        states = np.array([0, 1, 2, 3, -1, -1, -1])
        after = [
            model.traverse(np.array([context, s]) if context < 4 else np.array([s]), np.log10([0.5, p] if context < 4 else [p]), np.array([2 if context < 4 else 1]))[-1]
            for s, p in zip(states, root.values(), strict=True)
        ]
        assert math.isclose(sum(10**x for x in after), 1, rel_tol=1e-9)


def plain_scores(rows):
    """{position: log10 probability}, with every pair that training texts hold twice, whatever their number."""
    texts = [(k is None or zlib.crc32(str(k).encode()) % 10 != 0, [*words_of(t), None]) for k, t in rows]
    ones, pairs, n = Counter(), Counter(), Counter()
    for train, ws in texts:
        if train:
            ones.update(ws)
            pairs.update(zip(["^", *ws], ws))
    total, known = sum(ones.values()), len(ones)
    taken = Counter()
    n.update(ones)
    n["^"] = ones[None]
    for (a, _), c in pairs.items():
        taken[a] += c - 0.5 if c >= 2 else 0
    root = {w: (ones[w] + 0.1) / (total + 0.1 * (known + 1)) for _, ws in texts for w in ws}
    out = []
    for _, ws in texts:
        at = 0.0
        for a, w in zip(["^", *ws], ws):
            share = (pairs[a, w] - 0.5) / n[a] if pairs[a, w] >= 2 else 0
            at += math.log10(share + (1 - taken[a] / max(n[a], 1)) * root[w])
        out.append(at)
    return out


@pytest.mark.parametrize("filler", [0, 3_000_000])
def test_rare_pairs_are_learned_at_any_size(spark, monkeypatch, filler):
    """A pair seen twice has an arc however many other tokens there are, over blocks of any size."""
    monkeypatch.setattr(lm_scores, "BUCKET_TOKENS", 100, raising=False)
    monkeypatch.setattr(lm_scores, "BLOCK_TOKENS", 700)
    rng = random.Random(8)
    few = [prose(rng, 3, 2) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(few, k=rng.randint(0, 40)))) for i in range(200)]
    rows += [(1001, "rare words meet"), (1002, "rare words meet"), (1003, "rare words meet")]
    rows += [(2000 + k, "filler " * (filler // 3)) for k in range(3) if filler]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm_scores.lm_scores(docs).collect()}
    for (key, _), want in zip(rows, plain_scores(rows), strict=True):
        assert math.isclose(got[key], want, rel_tol=1e-9, abs_tol=1e-6), key


def test_scores_of_edge_rows_equal_the_plain_walk(edges):
    """Null ids and texts, repeated rows, a word of 200,000 letters and one repeated 3,000 times."""
    rows = [(r[0], r[1]) for r in edge_rows()]
    want = sorted((k is None, k, round(s, 4)) for (k, _), s in zip(rows, plain_scores(rows), strict=True) if k is not None)
    got = lm_scores.lm_scores(edges.withColumnRenamed("n_words", "block")).collect()
    assert sorted((False, r.doc_id, round(r.score, 4)) for r in got if r.doc_id is not None) == want
    unnamed = sorted(round(s, 4) for (k, _), s in zip(rows, plain_scores(rows), strict=True) if k is None)
    assert sorted(round(r.score, 4) for r in got if r.doc_id is None) == unnamed


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = lm_scores.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    score, base = rows.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base


def test_mixing_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs).select("doc_id", "source", "mix.*").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(mixing.ORACLE_SQL).fetchall())


@pytest.mark.parametrize("block", [1, 3])
def test_sources_stay_within_a_block_of_their_share(spark, block):
    rng = random.Random(4)
    shares = {"a": 5, "b": 3, "c": 2, "d": 1}
    rows = [(i, rng.choice("aaaabbcd")) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = sorted(mixing.mix(docs, shares, block_rows=block).select("source", "mix.*").collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(2000))
    left, seen = Counter(s for _, s in rows), Counter()
    for number, r in enumerate(got, 1):
        assert r.release <= r.slot < r.deadline
        seen[r.source] += 1
        for s, q in shares.items():
            assert abs(seen[s] - q * number / 11) < block * 1.0001 + (block - 1)
        if seen[r.source] == left[r.source]:
            break


def plain_schedule(shares):
    """Earliest deadline first, slot by slot: (source, turn) of each slot of a period."""
    period, done, out = sum(q for _, q in shares), [0] * len(shares), []
    for t in range(period):
        ready = [(-(-(done[i] + 1) * period // q), i) for i, (_, q) in enumerate(shares) if done[i] * period // q <= t]
        i = min(ready)[1]
        out.append((shares[i][0], done[i]))
        done[i] += 1
    return out


def test_classes_of_equal_share_are_scheduled_as_their_sources(spark):
    rng = random.Random(9)
    for n in (1, 2, 7, 60, 400):
        shares = [(f"s{i:04}", rng.choice([1, 1, 2, 3, 3, 9, 40])) for i in range(n)]
        rows = spark.createDataFrame([(s, 5, q) for s, q in shares], "source string, rows long, share long").repartition(3)
        got = sorted(mixing.period_schedule(rows).collect(), key=lambda r: r.slot)
        assert [(r.source, r.turn) for r in got] == plain_schedule(shares)
        assert [r.slot for r in got] == list(range(sum(q for _, q in shares)))


@pytest.mark.parametrize("block", [1, 4])
def test_many_sources_of_all_sizes(spark, block):
    """More sources than any limit there was, some of which run out at once: every row gets a place of its own."""
    rng = random.Random(10)
    rows = [(i, f"s{int(2600 * rng.random() ** 1.2)}" if i % 3 else "hot") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(4)
    got = sorted(mixing.mix(docs, block_rows=block).select("source", "mix.*").collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(9000)) and len({r.source for r in got}) > 2000
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert [r.slot for r in got] == sorted(r.slot for r in got)
    assert max(Counter(r.slot for r in got).values()) <= block
    assert {(r.source, r.block, r.slot) for r in got} and len({(r.source, r.block) for r in got}) == len({r.slot for r in got})


def test_mixing_of_edge_rows(edges, nothing):
    mixed = mixing.mix(edges)
    rows = mixed.collect()
    assert mixed.columns == [*edges.columns, "mix"]
    assert sorted(r.mix.position for r in rows) == list(range(len(edge_rows())))
    assert sorted(map(repr, (tuple(r)[:-1] for r in rows))) == sorted(map(repr, edge_rows()))
    assert mixing.mix(nothing).count() == 0
    again = mixing.mix(mixed)
    assert again.columns == [*edges.columns, "mix", "_mix"]


def vectors(n, dims=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 3
    return (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims))).astype(np.float32)


def plain_nearest(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    for i, v in zip(ids, x, strict=True):
        if i % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            yield int(i), [(int(ids[j]), float(d[j])) for j in order]


def test_neighbours_recall_and_exact_scores(spark):
    x = vectors(6000)
    x[100:900] = x[100]  # a vector that many rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 100 == 0, k=10, part_rows=400).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for query, best in plain_nearest(rows, 10):
        found = [(i, s) for _, i, s in sorted(got[query])]
        assert found == sorted(found, key=lambda p: (p[1], p[0])) and len(found) == 10
        hits += len(set(found) & set(best))
        total += 10
    assert hits >= 0.9 * total
    assert [i for _, i, _ in sorted(got[100])] == list(range(101, 111))


def test_neighbours_of_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1),
        (6, [inf, 1.0], 1), (7, [1.0, None], 1), (8, [1.0, 2.0, 3.0], 1), (None, [1.0, 0.0], 1), (100, [0.0, 1.0], 1), (9, [], 1),
        (2, [0.0, 1.0], None), (200, [1.0, 2.0, 3.0], 1), (200, [1.0, 2.0, 4.0], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, neighbours.nearest(frame, F.col("vec_id") % 100 == 0, k=3).collect()))
    far = math.sqrt(2)
    # Repeated rows are candidates, also of a query with their id; vectors of another length meet each other.
    other = [(200, 1, 8, 0.0), (200, 1, 8, 1.0), (200, 2, 200, 1.0), (200, 2, 200, 1.0)]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, far), (0, 3, 2, far), (100, 1, 2, 0.0), (100, 2, 2, 0.0), (100, 3, 0, far), *other]
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
