"""Near duplicates by Jaccard similarity of word shingles: a join over count-vector R-trees.

Texts with equal shingle sets are one class from the start. Classes that may link share one of their rarest
shingles (see ``rarest``); what hangs together by those is a cluster, and a link never
leaves its cluster. Inside a cluster the counts per group are points: tiles of points are joined by
R-trees that bound the overlap by summed minima, and what hangs together by pairs within the bound are
the clusters whose shingles are looked at. There, too, tiles are joined by R-trees, and pairs that survive
are verified. Tiles are bounded. After each tile has joined itself, components are formed, and pairs of
tiles look only for links between different components. Where links are counted, all tiles of a cluster are
joined and every pair that survives is verified.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from labelloom.llm.common import _slices, map_texts
from labelloom.llm.components import components
from labelloom.llm.rtree import count_point, folded, groups_for, link_tile, linked_pairs, near_points
from labelloom.llm.shingles import fingerprint, fingerprints, mixed, shingle_sets
from labelloom.operators.scale import materialize, scratch_tables

# A tile ends at this many sets, or at as many shingles per set as MIN_WEIGHT on average.
TILE_SETS = 128
MIN_WEIGHT = 1_024
# Tiles that are joined pair by pair are this many times larger.
COARSE = 4
# Points of a tile; they are a few bytes each.
POINT_TILE = 1_024
# One of so many sets of a large cluster is compared at random before tiles are joined pair by pair.
MEETING = 8
# Shingles that are counted in one bucket, about.
BUCKET_SHINGLES = 1 << 22


def shingle_rows(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(key, n, f1, f2, counts) of every row: size of its shingle set, two numbers that equal sets share, its point."""
    fields = [*(T.StructField(c, T.LongType()) for c in ("n", "f1", "f2")), T.StructField("counts", T.BinaryType())]

    def make():
        def describe(texts: list) -> dict:
            sets = shingle_sets(texts, size)
            marks = fingerprints(sets)
            points = [count_point(s, groups_for(len(s))) for s in sets]
            return {
                "n": [len(s) for s in sets],
                "f1": [m[0] for m in marks],
                "f2": [m[1] for m in marks],
                "counts": [p.astype("<u2" if p.max() <= 0xFFFF else "<u4").tobytes() for p in points],
            }

        return describe

    return map_texts(docs, text, [key], make, fields)


def set_bytes(docs: DataFrame, size: int, keep: list[str], text: str) -> DataFrame:
    """The kept columns and ``set``, the sorted shingle hashes as bytes."""
    fields = [T.StructField("set", T.BinaryType())]
    make = lambda: lambda texts: {"set": [s.tobytes() for s in shingle_sets(texts, size)]}
    return map_texts(docs, text, keep, make, fields)


def meet(marks: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (node, smallest node with the same mark), for nodes other than the smallest."""
    order = np.lexsort((nodes, marks))
    marks, nodes = marks[order], nodes[order]
    starts = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]]) if len(marks) else np.zeros(0, dtype=int)
    least = np.repeat(nodes[starts], np.diff(np.r_[starts, len(nodes)]))
    apart = nodes != least
    pairs = np.unique(np.stack([nodes[apart], least[apart]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def parcels(place: np.ndarray, marks: np.ndarray, nodes: np.ndarray, counts: np.ndarray | None = None):
    """A batch with one row per place: the marks, nodes and counts (else none) that go there, as bytes."""
    import pyarrow as pa

    order = np.argsort(place.astype(np.uint16) if place.max(initial=0) < 1 << 16 else place, kind="stable")
    place, marks, nodes = place[order], marks[order], nodes[order]
    counts = np.zeros(0, dtype=np.uint32) if counts is None else counts[order].astype(np.uint32)
    used, starts = np.unique(place, return_index=True)
    cut = list(zip(starts.tolist(), [*starts[1:].tolist(), len(place)], strict=False))
    # Steps from one node to the next are small numbers, which compress well.
    steps = [np.diff(nodes[a:b], prepend=0).tobytes() for a, b in cut]
    columns = [pa.array([x[a:b].tobytes() for a, b in cut], type=pa.binary()) for x in (marks, counts)]
    return pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), columns[0], pa.array(steps, type=pa.binary()), columns[1]], names=PARCEL
    )


PARCEL = ["place", "marks", "nodes", "counts"]
PARCEL_TYPE = "place int, marks binary, nodes binary, counts binary"


def unpacked(table, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """The marks and nodes of parcels, one after another."""
    marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), dtype=kind)
    nodes = [np.cumsum(np.frombuffer(x, dtype=np.int64)) for x in table.column("nodes").to_pylist()]
    return marks, np.concatenate([np.zeros(0, dtype=np.int64), *nodes])


def in_several(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the marks that recur, how often each of them is there)."""
    order = np.argsort(marks)
    new = np.flatnonzero(np.r_[True, marks[order][1:] != marks[order][:-1]]) if len(marks) else order
    times = np.diff(np.r_[new, len(marks)])
    times = np.repeat(times, times)
    return order[times > 1], times[times > 1]


def rarest(nodes: np.ndarray, marks: np.ndarray, counts: np.ndarray, own: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Places of the marks that nodes have to offer, so that two sets that link offer one in common.

    ``nodes``, ``marks`` and ``counts`` are the shingles that recur and in how many sets; ``own`` and ``sizes`` the sets.
    A set that links shares ``percent`` of its shingles with one other set. With its shingles in order of (count, mark)
    those before the last ``percent`` are enough; the ones that do not recur come first and meet nothing.
    """
    names, at, texts = np.unique(own, return_inverse=True, return_counts=True)
    size = np.zeros(len(names), dtype=np.int64)
    np.maximum.at(size, at, sizes)
    node = np.searchsorted(names, nodes)
    recur = np.bincount(node, minlength=len(names))
    # All of them where a node has several texts.
    offered = np.where(texts > 1, recur, recur + (-percent * size // 100) + 1)
    keep = np.flatnonzero(offered[node] > 0)
    keep = keep[np.lexsort((marks[keep], counts[keep], node[keep]))]
    node = node[keep]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else node
    rank = np.arange(len(node)) - np.repeat(first, np.diff(np.r_[first, len(node)]))
    return keep[rank < offered[node]]


def shared_shingles(docs: DataFrame, size: int, percent: int, key: str, text: str, shingles: int) -> DataFrame:
    """Edges (u, v) between keys whose texts offer the same shingle; a star per shingle.

    Texts offer their rarest shingles (see ``rarest``): passages that many texts share connect nothing unless they are
    nearly all of a text. Shingles are counted over all texts in buckets, those that recur go back to buckets
    of their texts, and what these offer meets. ``shingles`` is their number in all texts; a bucket holds about
    BUCKET_SHINGLES or fewer. What is shuffled are packed arrays, a shingle by its bucket and 32 bits. Two that get
    one mark count together in all texts, so a pair that links still meets, by that mark.
    """
    buckets = max(8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // BUCKET_SHINGLES))

    def pack(batches):
        for batch in batches:
            for part in _slices(batch, "_text"):
                sets = shingle_sets(part.column("_text").to_pylist(), size)
                keys, sizes = part.column(0).to_numpy(zero_copy_only=False), np.array([len(s) for s in sets])
                keys, sizes, sets = keys[sizes > 0], sizes[sizes > 0], [s for s in sets if len(s)]
                if sets:
                    over, place = np.divmod(np.concatenate(sets), np.uint64(buckets))
                    yield parcels(place.astype(np.int64), over.astype(np.uint32), np.repeat(keys, sizes))
                    # The sizes of sets go to the buckets of their texts.
                    yield parcels(buckets + home(keys), sizes, keys)

    def home(nodes: np.ndarray) -> np.ndarray:
        return (mixed(nodes.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)

    def count(table):
        import pyarrow as pa

        place = table.column("place")[0].as_py()
        if place >= buckets:
            sizes, nodes = unpacked(table)
            found = parcels(np.full(len(nodes), place - buckets), sizes, nodes)
        else:
            marks, nodes = unpacked(table, np.uint32)
            at, times = in_several(marks)
            found = parcels(home(nodes[at]), marks[at] + np.int64(place << 32), nodes[at], times)
        return pa.Table.from_batches([found])

    def offer(table):
        import pyarrow as pa

        counted = np.array([len(x) > 0 for x in table.column("counts").to_pylist()])
        sizes, own = unpacked(table.filter(pa.array(~counted)))
        recurring = table.filter(pa.array(counted))
        marks, nodes = unpacked(recurring)
        counts = np.frombuffer(b"".join(recurring.column("counts").to_pylist()), dtype=np.uint32)
        at = rarest(nodes, marks, counts, own, sizes, percent)
        at = at[np.argsort(nodes[at], kind="stable")]
        return pa.Table.from_batches([parcels(marks[at] >> 32, marks[at], nodes[at])])

    def join(table):
        import pyarrow as pa

        u, v = meet(*unpacked(table))
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    rows = docs.where(F.col(key).isNotNull()).select(key, F.col(text).alias("_text"))
    packed = rows.mapInArrow(pack, PARCEL_TYPE)
    for step in (count, offer):
        packed = packed.groupBy("place").applyInArrow(step, PARCEL_TYPE)
    return packed.groupBy("place").applyInArrow(join, "u long, v long")


def grouped_links(
    rows: DataFrame, group: list[str], columns: list[str], join: Callable, names: tuple[str, ...] = ("u", "v")
) -> DataFrame:
    """What ``join`` finds among the rows of each group, a list of tuples of the columns: edges (u, v), or ``names``.

    The rows of a group come one after the other in a sorted task.
    """

    def run(batches):
        import pyarrow as pa

        def edges(held: list[tuple]):
            found = join(held) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], type=pa.int64()) for k in range(len(names))], names=list(names)
            )

        current, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in group), strict=True))
            for at, *row in zip(keys, *(batch.column(c).to_pylist() for c in columns), strict=True):
                if at != current:
                    yield edges(held)
                    current, held = at, []
                held.append(tuple(row))
        yield edges(held)

    spread = rows.select(*group, *columns).repartition(*group).sortWithinPartitions(*group, columns[0])
    return spread.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def joined_tiles(rows: DataFrame, group: list[str], percent: int) -> DataFrame:
    """Links (u, v) found inside each group of rows (node, label, side, set); a group is one R-tree."""

    def join(held: list[tuple]) -> list[tuple[int, int]]:
        nodes, labels, sides, sets = zip(*held, strict=True)
        arrays = [np.frombuffer(s, dtype=np.uint64) for s in sets]
        return [(nodes[i], nodes[j]) for i, j in link_tile(arrays, np.array(labels), percent, np.array(sides))]

    return grouped_links(rows, group, ["node", "label", "side", "set"], join)


def tiled(members: DataFrame, tile_sets: int) -> DataFrame:
    """Members (cluster, node, n) with a tile: bounded runs of a cluster's sets in order of size."""
    weight = F.greatest(F.col("n"), F.lit(MIN_WEIGHT))
    sizes = members.groupBy("cluster", "n").agg(F.count("*").alias("_same"))
    earlier = Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum(F.col("_same") * weight).over(earlier), F.lit(0)))
    place = F.col("_before") + F.pmod(F.xxhash64("node"), F.col("_same")) * weight
    return members.join(before, ["cluster", "n"]).select(
        "cluster", "node", "n", F.floor(place / (tile_sets * MIN_WEIGHT)).alias("tile")
    )


def tile_pairs(tiles: DataFrame, percent: int, worth: Column) -> DataFrame:
    """(cluster, coarse_a, coarse_b, coarse, side): the tiles of each pair to be joined, a tile with itself too.

    ``tiles`` is (cluster, coarse, ..., least, most) with the smallest and largest size; pairs of sizes too far
    apart are left out, as are those for which ``worth`` (over columns ending in _a and _b) does not hold.
    """
    left, right = (tiles.toDF("cluster", *(f"{c}_{side}" for c in tiles.columns[1:])) for side in ("a", "b"))
    pairs = left.join(right, "cluster").where(
        (F.col("coarse_a") <= F.col("coarse_b"))
        & (percent * F.col("least_b") <= 100 * F.col("most_a"))
        & (percent * F.col("least_a") <= 100 * F.col("most_b"))
        & worth
    )

    def tile(column: str, side: int) -> Column:
        return F.struct(F.col(column).alias("coarse"), F.lit(side).alias("side"))

    both = F.array(tile("coarse_a", 1), tile("coarse_b", 2))
    at = F.when(F.col("coarse_a") == F.col("coarse_b"), F.array(tile("coarse_a", 0))).otherwise(both)
    return pairs.select("cluster", "coarse_a", "coarse_b", F.inline(at))


def within_bound(clusters: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) that connect the classes of a cluster whose points allow a link.

    ``clusters`` is (cluster, node, n, counts). Only points travel: each tile of a cluster is joined with
    itself and with the tiles of near sizes by an R-tree, and what a pair of tiles finds is handed on as a
    forest. Texts that came together by a shared passage part again here.
    """
    placed = tiled(clusters.select("cluster", "node", "n"), POINT_TILE)
    rows = materialize(
        placed.withColumnRenamed("tile", "coarse").join(clusters.select("node", "counts"), "node"), "cluster-points"
    )
    tiles = rows.groupBy("cluster", "coarse").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    group = ["cluster", "coarse_a", "coarse_b"]
    crossing = rows.join(tile_pairs(materialize(tiles, "point-tiles"), percent, F.lit(True)), ["cluster", "coarse"])

    def join(held: list[tuple]) -> list[tuple[int, int]]:
        nodes, sides, sizes, counts = zip(*held, strict=True)
        points = [np.frombuffer(c, dtype=f"<u{len(c) // groups_for(n)}") for c, n in zip(counts, sizes, strict=True)]
        return [(nodes[i], nodes[j]) for i, j in near_points(folded(points), np.array(sizes), np.array(sides), percent)]

    return grouped_links(crossing, group, ["node", "side", "n", "counts"], join)


def cluster_sets(docs: DataFrame, clusters: DataFrame, classes: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(node, cluster, n, tile, last, classes, set): the sets of the texts of every node of a cluster.

    ``classes`` lists the marks and numbers of rows of the classes that the node stands for.
    """
    placed = tiled(clusters, TILE_SETS)
    largest = placed.groupBy("cluster").agg(F.max("tile").alias("last"))
    stands = classes.groupBy("node").agg(F.collect_list(F.struct("f1", "f2", "copies")).alias("classes"))
    # Rows that share an id are one node; any of their sets may link it.
    texts = docs.select(F.col(key).alias("node"), F.col(text).alias("_whole"))
    chosen = texts.join(placed.join(largest, "cluster").join(stands, "node"), "node")
    kept = ["node", "cluster", "n", "tile", "last", "classes"]
    return materialize(set_bytes(chosen, size, kept, "_whole"), "cluster-sets")


def all_links(sets: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """Every link between different classes: (u, v, shared), or (f1, f2, linked) summed over what tiles find.

    ``sets`` as ``cluster_sets`` gives them. ``u`` < ``v`` are the nodes of the classes; ``linked`` counts the rows of the
    classes that a class links with. All pairs of tiles of a cluster are joined, so a group of n different
    texts costs up to n^2 / 2 checks; the sums stay as long as the table, the pairs do not.
    """
    coarse = sets.withColumn("coarse", F.floor(F.col("tile") / COARSE)).withColumn("_size", F.length("set") / 8)
    tiles = coarse.groupBy("cluster", "coarse").agg(F.min("_size").alias("least"), F.max("_size").alias("most"))
    sides = tile_pairs(materialize(tiles, "link-tiles"), percent, F.lit(True))
    crossing = coarse.drop("_size").join(sides, ["cluster", "coarse"])

    def join(held: list[tuple]) -> list[tuple[int, ...]]:
        # One row for each class, whatever the copies of its node, and none for texts of a class of another node.
        rows: dict[tuple, tuple] = {}
        for node, side, classes, data in held:
            array = np.frombuffer(data, dtype=np.uint64)
            mark = fingerprint(array)
            copies = next((c["copies"] for c in classes if (c["f1"], c["f2"]) == mark), None)
            if copies is not None:
                rows[side, *mark] = (node, copies, array)
        keys, values = list(rows), list(rows.values())
        found = linked_pairs([v[2] for v in values], percent, np.array([k[0] for k in keys], dtype=np.int64))
        if pairs:
            return [
                (*sorted((values[i][0], values[j][0])), k)
                for i, others, shared in found
                for j, k in zip(others.tolist(), shared.tolist(), strict=True)
            ]
        copies = np.array([v[1] for v in values], dtype=np.int64)
        linked = np.zeros(len(values), dtype=np.int64)
        for i, others, _ in found:
            linked[i] += copies[others].sum()
            linked[others] += copies[i]
        return [(*keys[i][1:], int(linked[i])) for i in np.flatnonzero(linked)]

    names = ("u", "v", "shared") if pairs else ("f1", "f2", "linked")
    return grouped_links(crossing, ["cluster", "coarse_a", "coarse_b"], ["node", "side", "classes", "set"], join, names)


def links_in_clusters(sets: DataFrame, percent: int) -> list[DataFrame]:
    """Tables of links (u, v) that connect all classes of a cluster that are connected."""
    own = sets.withColumn("label", F.col("node")).withColumn("side", F.lit(0))
    # Some of a large cluster is dealt out once more at random, so that components meet early; it is not
    # needed for the result, since tiles are joined pair by pair below.
    some = own.where("last > 0").where(F.pmod(F.xxhash64(F.lit("some"), "node"), F.lit(MEETING)) == 0)
    again = some.withColumn(
        "tile", -1 - F.pmod(F.xxhash64(F.lit("again"), "node"), F.ceil((F.col("last") + 1) / MEETING))
    )
    within = materialize(joined_tiles(own.unionByName(again), ["cluster", "tile"], percent), "links-within")

    large = sets.where("last > 0")
    found = components(within)
    labelled = (
        large.join(found, "node", "left")
        .withColumn("label", F.coalesce("component", "node"))
        .withColumn("coarse", F.floor(F.col("tile") / COARSE))
    )
    tiles = materialize(
        labelled.groupBy("cluster", "coarse").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")
        ),
        "tiles",
    )
    # Two tiles of one and the same component have no link to find.
    sides = tile_pairs(tiles, percent, F.least("low_a", "low_b") < F.greatest("high_a", "high_b"))
    crossing = labelled.join(sides, ["cluster", "coarse"])
    across = materialize(joined_tiles(crossing, ["cluster", "coarse_a", "coarse_b"], percent), "links-across")
    return [within, across]


def class_sets(docs: DataFrame, size: int, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, n, f1, f2, node, copies) of every row, and the sets of the classes that may link (``cluster_sets``).

    Rows of equal sets are a class, and ``node`` the smallest key of it; ``copies`` counts them.
    """
    narrow = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    described = materialize(shingle_rows(narrow, size, key, text), "shingle-marks")
    marks = ["n", "f1", "f2"]
    # Written first, so that the join with it can split a class that holds most rows.
    classes = materialize(described.where("n > 0").groupBy(*marks).agg(F.min(key).alias("node"), F.count("*").alias("copies")), "classes")
    members = materialize(described.drop("counts").join(classes, marks, "left"), "class-members")
    total = described.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    clusters = components(materialize(shared_shingles(narrow, size, percent, key, text, total), "shared-shingles"))
    own = described.where("n > 0").withColumnRenamed(key, "node").join(classes.drop("copies"), [*marks, "node"])
    own = own.select("node", "n", "counts")
    meeting = clusters.select("node", F.col("component").alias("cluster")).join(own, "node")
    near = components(materialize(within_bound(materialize(meeting, "clusters"), percent), "within-bound"))
    sizes = own.groupBy("node").agg(F.max("n").alias("n"))
    clusters = materialize(near.select("node", F.col("component").alias("cluster")).join(sizes, "node"), "near-clusters")
    return members, cluster_sets(narrow, clusters, classes, size, key, text)


def with_components(members: DataFrame, sets: DataFrame, percent: int, key: str) -> DataFrame:
    """The rows of ``members`` with ``n_shingles`` and ``component_id``."""
    # Rows of one key with different texts are one node.
    twice = members.where(F.col(key).isNotNull() & (F.col(key) != F.col("node"))).select(
        F.col(key).alias("u"), F.col("node").alias("v")
    )
    keys = members.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows")).where("_rows > 1")
    twice = twice.join(keys, twice["u"] == keys[key], "left_semi")
    found = components(reduce(DataFrame.unionByName, [*links_in_clusters(sets, percent), twice]))
    # Equal texts meet through their class; a key of several texts leads on from its class.
    return (
        members.join(found.withColumnRenamed("component", "_component"), members["node"] == found["node"], "left")
        .select(
            key,
            F.col("n").alias("n_shingles"),
            F.coalesce("_component", members["node"], F.col(key)).alias("component_id"),
            *(members[c] for c in ("f1", "f2", "node", "copies")),
        )
    )


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_shingles, component_id) of every row: groups of texts that links connect.

    Two texts link when 100 * |intersection| >= percent * |union| of their sets of distinct shingles (``size``
    words, A-Z lower-cased; fewer words are one shingle). ``component_id`` is the smallest key reachable,
    the row's own included. Texts without words link with nothing. Keys are whole numbers; rows of one key
    are one node, whatever their texts; a row without a key gets the smallest key of the texts equal to its
    own and their links, null if there is none. Other columns are not read; an empty table gives no rows.

    Shingles are 64-bit hashes. No pair table of a group is ever written: copies are classes, links inside
    a tile connect components, and pairs of one component are not compared (see ``linked_documents``).
    """
    members, sets = class_sets(docs, size, percent, key, text)
    return with_components(members, sets, percent, key).select(key, "n_shingles", "component_id")


def links(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(u, v, shared) of every pair of different shingle sets that link, u < v, with their shared shingles.

    A set is named by the smallest key of its rows, the ``class_id`` of ``linked_documents``; if a key recurs with two
    texts, both are u or v of links of their own. The result has a row for each pair of a group.
    """
    return all_links(class_sets(docs, size, percent, key, text)[1], percent, pairs=True)


def linked_documents(
    docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The columns of ``near_duplicates``, and (class_id, n_links) of every row.

    ``class_id`` is the smallest key of the rows with an equal set, null without words; ``n_links`` counts the other
    rows whose texts link with the row's own, equal texts included. It is 0 without words and null where no
    row of the class has a key. Every pair of classes that may link is verified (see ``all_links``).
    """
    members, sets = class_sets(docs, size, percent, key, text)
    linked = all_links(sets, percent, pairs=False).groupBy("f1", "f2").agg(F.sum("linked").alias("_linked"))
    rows = with_components(members, sets, percent, key)
    counted = rows.join(materialize(linked, "linked"), ["f1", "f2"], "left")
    own = F.when(F.col("n_shingles") == 0, F.lit(0).cast("long")).when(
        F.col("node").isNotNull(), F.col("copies") - 1 + F.coalesce("_linked", F.lit(0))
    )
    return counted.select(key, "n_shingles", "component_id", F.col("node").alias("class_id"), own.alias("n_links"))


def text_nodes(docs: DataFrame, key: str, text: str, node: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a whole number ``node`` for each pair of key and text, and (node, key, mark) of keys with several texts.

    The node is the key itself, or a number above all keys where the key recurs with different texts.
    """
    mark = F.coalesce(F.sha2(F.col(text).cast("string"), 256), F.lit(""))
    marked = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), mark.alias("_mark"))
    several = marked.groupBy("_key").agg(F.min("_mark").alias("_a"), F.max("_mark").alias("_b")).where("_a <> _b")
    pairs = marked.join(several, "_key", "left_semi").distinct()
    top = docs.agg(F.max(F.col(key).cast("long"))).scalar()
    pairs = materialize(pairs.select((top + 1 + F.monotonically_increasing_id()).alias("_node"), "_key", "_mark"), "recurring-keys")
    if pairs.isEmpty():
        return docs.withColumn(node, F.col(key).cast("long")), pairs
    own = [(F.col(key).cast("long") == pairs["_key"]) & (mark == pairs["_mark"])]
    joined = docs.join(pairs, own, "left").withColumn(node, F.coalesce("_node", F.col(key).cast("long")))
    return joined.drop("_key", "_mark", "_node"), pairs


def one_per_group(
    docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near duplicates: one row of each group stays.

    It is the one with the smallest key. Rows are compared, not keys: a key that recurs with different texts
    is a row of its own in the group of each of them; of those in one group the smallest sha-256 stays. Of rows
    equal in key and text one stays. Rows without a key stay: nothing tells which of them to keep.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own_key, own_text = (names[docs.columns.index(c)] for c in (key, text))
    rows, several = text_nodes(docs.toDF(*names), own_key, own_text, "_row")
    with scratch_tables(docs.sparkSession) as keep:
        found = near_duplicates(rows.where(F.col(own_key).isNotNull()).select("_row", own_text), size, percent, "_row", own_text)
        order = F.struct(F.coalesce("_key", F.col("_row")).alias("key"), "_mark", F.col("_row").alias("row"))
        stays = found.join(several, found["_row"] == several["_node"], "left").groupBy("component_id").agg(F.min(order).alias("_first"))
        stays = keep(stays.select(F.col("_first.row").alias("_stays")), "rows-that-stay")
    first = Window.partitionBy("_stays").orderBy(F.xxhash64(*names))
    with_key = (
        rows.join(stays, rows["_row"] == stays["_stays"])
        .withColumn("_place", F.row_number().over(first))
        .where(F.col("_place") == 1)
        .select(*names)
    )
    return with_key.unionByName(rows.where(F.col(own_key).isNull()).select(*names)).toDF(*docs.columns)
