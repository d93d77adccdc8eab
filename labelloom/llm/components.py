"""Connected components of an edge table, by alternating star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelloom.operators.scale import materialize

# Nodes that a task's local forest holds before it is given out.
FOREST_NODES = 500_000
# A node is hot from so many neighbours on, if they are also one in HOT_SHARE of all.
HOT_NEIGHBOURS = 1_024
HOT_SHARE = 256


def local_forests(edges: DataFrame) -> DataFrame:
    """The edges of each task replaced by a forest of (larger, smaller) stars over the same nodes."""

    def run(batches):
        import pyarrow as pa

        parent: dict[int, int] = {}

        def find(a: int) -> int:
            root = a
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[a] != root:
                parent[a], a = root, parent[a]
            return root

        def stars():
            pairs = [(a, find(a)) for a in list(parent)]
            pairs = [(a, b) for a, b in pairs if a != b]
            parent.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in pairs], type=pa.int64()) for k in (0, 1)], names=["u", "v"]
            )

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > FOREST_NODES:
                yield stars()
        if parent:
            yield stars()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (u, v) of long ids.

    Nodes without an edge are not listed. Each round writes the edges to the shared folder. A hot node's edges
    are never gathered: its smallest neighbour is an aggregate, and goes to all tasks; there are at most twice
    HOT_SHARE such nodes. Rounds go on until every node has one edge and it leads to a node that has none.
    """
    current = materialize(local_forests(edges).distinct(), "forests")
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        # Larger neighbours go to the smallest one, in both senses of a star.
        larger, limit = both.where("v > u"), max(HOT_NEIGHBOURS, 2 * current.count() // HOT_SHARE)
        hot = least.where(F.col("n") > limit).drop("n").collect()
        if hot:
            table = F.broadcast(current.sparkSession.createDataFrame(hot, "u long, m long"))
            cold = larger.join(table, "u", "left_anti").join(least.drop("n"), "u")
            joined = larger.join(table, "u").unionByName(cold)
        else:
            joined = larger.join(least.drop("n"), "u")
        large = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        current = materialize(small.where("u <> v").distinct(), "stars")
        # One edge per node, and none that starts where another ends.
        state = (
            current.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in"))
            .unionByName(current.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in")))
            .groupBy("n")
            .agg(F.sum("out").alias("out"), F.max("in").alias("in"))
            .where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0)))
            .limit(1)
            .count()
        )
        if not state:
            break
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
