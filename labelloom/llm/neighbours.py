"""Approximate nearest neighbours with learned partitions.

A bounded sample of the vectors is linked to its nearest neighbours and the graph is cut into parts of
equal size with few links across. A small softmax classifier learns a vector's part. Every row is indexed
under its most probable part; a query goes to several most probable parts, and all their rows are
ranked by exact distance on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from labelloom.llm.common import reachable
from labelloom.operators.scale import materialize

# The driver fits on about this many vectors, drawn by hash.
SAMPLE_ROWS = 4_096
GRAPH_NEIGHBOURS = 10
# Rows that one part should have; parts are limited by what the sample can tell apart.
PART_ROWS = 2_048
MAX_PARTS = 128
# A query visits so many parts that this share of neighbours was found on withheld rows of the sample.
TARGET_RECALL = 0.95
# Rows and queries that one task compares at a time.
BLOCK_ROWS = 4_096
BLOCK_QUERIES = 1_024
DRAW = 1 << 30


def neighbour_lists(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` nearest other rows of each row."""
    k = min(k, len(x) - 1)
    norms = (x * x).sum(axis=1)
    out = np.empty((len(x), k), dtype=np.int64)
    for a in range(0, len(x), 512):
        d = norms[None, :] - 2 * x[a : a + 512] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, neighbours: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Parts of equal size, to one row, that keep neighbours together.

    Parts start as leaves of median cuts along the widest direction; then, round after round, rows ask
    for the part that most of their neighbours (in either direction) are in, and requests between two
    parts are granted in pairs, best gain first, so sizes stay.
    """
    def leaves(group: np.ndarray, number: int) -> list[np.ndarray]:
        if number < 2:
            return [group]
        centred = x[group] - x[group].mean(axis=0)
        direction = np.linalg.svd(centred, full_matrices=False)[2][0]
        ranked = group[np.argsort(centred @ direction, kind="stable")]
        cut = len(group) * (number // 2) // number
        return leaves(ranked[:cut], number // 2) + leaves(ranked[cut:], number - number // 2)

    order = leaves(np.arange(len(x)), parts)
    part = np.empty(len(x), dtype=np.int64)
    for number, group in enumerate(order):
        part[group] = number
    n, k = neighbours.shape
    source = np.concatenate([np.repeat(np.arange(n), k), neighbours.ravel()])
    target = np.concatenate([neighbours.ravel(), np.repeat(np.arange(n), k)])
    for _ in range(rounds):
        links = np.zeros((n, parts))
        np.add.at(links, (source, part[target]), 1.0)
        own = links[np.arange(n), part]
        links[np.arange(n), part] = -1
        wish = links.argmax(axis=1)
        gain = links[np.arange(n), wish] - own
        moved = 0
        wishing = np.flatnonzero(gain > 0)
        wishing = wishing[np.argsort(-gain[wishing], kind="stable")]
        pending: dict[tuple[int, int], list[int]] = {}
        for i in wishing.tolist():
            a, b = int(part[i]), int(wish[i])
            partner = pending.get((b, a))
            if partner:
                j = partner.pop(0)
                part[i], part[j] = b, a
                moved += 2
            else:
                pending.setdefault((a, b), []).append(i)
        if not moved:
            break
    return part


@dataclass
class Router:
    """A softmax classifier with one hidden layer: probabilities of the parts for each vector."""

    mean: np.ndarray
    scale: float
    hidden: np.ndarray
    hidden_bias: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum((x - self.mean) / self.scale @ self.hidden + self.hidden_bias, 0)
        return np.concatenate([(x - self.mean) / self.scale, z], axis=1) @ self.weights + self.bias

    def best(self, x: np.ndarray, number: int) -> np.ndarray:
        """The ``number`` most probable parts of each vector, most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :number]


def fit_router(
    x: np.ndarray, targets: np.ndarray, hidden: int = 64, epochs: int = 60, rate: float = 0.01, seed: int = 7
) -> Router:
    """Adam on cross-entropy with soft targets (shares of a row's neighbours in each part)."""
    rng = np.random.default_rng(seed)
    parts, dims = targets.shape[1], x.shape[1]
    scale = float(x.std()) or 1.0
    router = Router(
        x.mean(axis=0), scale, rng.normal(0, dims**-0.5, (dims, hidden)), np.zeros(hidden),
        np.zeros((dims + hidden, parts)), np.zeros(parts),
    )
    names = ("hidden", "hidden_bias", "weights", "bias")
    first = {n: np.zeros_like(getattr(router, n)) for n in names}
    second = {n: np.zeros_like(getattr(router, n)) for n in names}
    z = (x - router.mean) / scale
    step = 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            rows = shuffled[a : a + 256]
            raw = z[rows] @ router.hidden + router.hidden_bias
            wide = np.concatenate([z[rows], np.maximum(raw, 0)], axis=1)
            logits = wide @ router.weights + router.bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (p - targets[rows]) / len(rows)
            back = (error @ router.weights[dims:].T) * (raw > 0)
            slopes = {
                "weights": wide.T @ error + 1e-5 * router.weights, "bias": error.sum(axis=0),
                "hidden": z[rows].T @ back + 1e-5 * router.hidden, "hidden_bias": back.sum(axis=0),
            }
            step += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * slopes[n]
                second[n] = 0.999 * second[n] + 0.001 * slopes[n] ** 2
                move = (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                setattr(router, n, getattr(router, n) - rate * move)
    return router


def learn_parts(x: np.ndarray, parts: int, target: float = TARGET_RECALL, k: int = GRAPH_NEIGHBOURS) -> tuple[Router, int]:
    """Router learned from a sample of vectors, and the number of parts to visit.

    Every eighth row is withheld from the fit; the fewest parts are visited that hold ``target`` of the
    withheld rows' neighbours. Vectors without structure need most parts, clustered ones few. One part
    when there is nothing to tell apart.
    """
    x = np.unique(x, axis=0)
    parts = max(1, min(parts, len(x) // 16))
    if parts < 2:
        dims = x.shape[1] if x.ndim == 2 else 0
        return Router(np.zeros(dims), 1.0, np.zeros((dims, 1)), np.zeros(1), np.zeros((dims + 1, 1)), np.zeros(1)), 1
    x = x[np.random.default_rng(11).permutation(len(x))]
    withheld, x = x[::8], np.delete(x, np.s_[::8], axis=0)
    neighbours = neighbour_lists(x, k)
    part = balanced_parts(x, neighbours, parts)
    targets = np.zeros((len(x), parts))
    rows = np.repeat(np.arange(len(x)), neighbours.shape[1])
    np.add.at(targets, (rows, part[neighbours.ravel()]), 1.0)
    targets[np.arange(len(x)), part] += neighbours.shape[1]
    router = fit_router(x, targets / targets.sum(axis=1, keepdims=True))
    distance = (x * x).sum(axis=1)[None, :] - 2 * withheld @ x.T
    near = np.argsort(distance, axis=1, kind="stable")[:, :k]
    home, order = router.best(x, 1)[:, 0], router.best(withheld, parts)
    found = np.cumsum((order[:, :, None] == home[near][:, None, :]).sum(axis=(0, 2)))
    return router, int(np.searchsorted(found, target * found[-1])) + 1


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def rows_of(frame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, ids, matrix) of a block."""
    return frame["_row"].to_numpy(), frame["_id"].to_numpy(), np.stack(frame["_x"].to_numpy())


def exact_best(queries: tuple, rows: tuple, k: int) -> tuple[np.ndarray, ...]:
    """(query index, row index, distance) of each query's ``k`` nearest rows, its own left out.

    ``queries`` and ``rows`` are (row numbers, ids, matrix); ties go to smaller ids.

    Distances are sums of squared differences in double precision; a product first rules out rows that
    cannot be among the nearest, with room for its rounding, so ties stay.
    """
    (query_rows, _, q), (row_numbers, row_ids, x) = queries, rows
    found: list[tuple[np.ndarray, ...]] = []
    q_norm, x_norm = (q * q).sum(axis=1), (x * x).sum(axis=1)
    for a in range(0, len(q), 256):
        part = q[a : a + 256]
        rough = q_norm[a : a + 256, None] + x_norm[None, :] - 2 * part @ x.T
        rough[query_rows[a : a + 256, None] == row_numbers[None, :]] = np.inf
        take = min(k, x.shape[0])
        bound = np.partition(rough, take - 1, axis=1)[:, take - 1]
        slack = 1e-9 * (q_norm[a : a + 256] + x_norm.max(initial=0)) + 1e-300
        for i in range(len(part)):
            near = np.flatnonzero(rough[i] <= bound[i] + slack[i]) if np.isfinite(bound[i]) else np.flatnonzero(np.isfinite(rough[i]))
            if not len(near):
                continue
            # Equal vectors have equal distances: only the smallest ids can be among the best.
            distance = np.sqrt(((x[near] - part[i]) ** 2).sum(axis=1))
            best = np.lexsort((row_ids[near], distance))[:k]
            found.append((np.full(len(best), a + i), near[best], distance[best]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS, target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found rows of each query, all if there are fewer.

    Nearness is the Euclidean distance in double precision on the original vectors, ties go to the smaller
    id, and a query's own row is no candidate. Rows with a null id, or whose vector is null, zero, or holds
    null or non-finite components, take no part. Repeated rows are rows of their own, as queries and as
    candidates. Vectors of different lengths have no distance and never meet: those of the commonest length
    (the longest of those on a tie) are found through the parts, all others are compared with all of their
    length. Other columns are not read; an empty table gives no rows.

    Fitted on about ``sample_rows`` vectors; every row is indexed and visited parts are compared whole. The
    router (a few thousand numbers) goes to all tasks. A part, however large, is cut into blocks of rows
    and of queries; each pair of blocks gives its best ``k``, merged per query.
    """
    spark = vectors.sparkSession
    reachable(spark)
    x = vectors.select(
        F.col(key).alias("_id"),
        F.col(vector).cast("array<double>").alias("_x"),
        F.coalesce(is_query, F.lit(False)).alias("_query"),
    )
    x = x.where(F.col("_id").isNotNull() & usable(F.col("_x"))).withColumn("_row", F.monotonically_increasing_id())
    sizes = x.groupBy(F.size("_x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    schema = T.StructType(
        [
            T.StructField("query_id", vectors.schema[key].dataType),
            T.StructField("rank", T.IntegerType()),
            T.StructField(key if key != "query_id" else "vec_id", vectors.schema[key].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    if not sizes:
        return spark.createDataFrame([], schema)
    dims, total = sizes[0]["dims"], sizes[0]["n"]
    others = x.where(F.size("_x") != dims).withColumn("_parts", F.array(-F.size("_x")))
    x = x.where(F.size("_x") == dims)
    draw = F.pmod(F.xxhash64(F.lit("parts"), "_id"), F.lit(DRAW)) < int(min(1.0, sample_rows / total) * DRAW)
    sample = np.array([r["_x"] for r in x.where(draw).orderBy("_id").select("_x").collect()], dtype=float)
    router, probes = learn_parts(sample.reshape(-1, dims), min(MAX_PARTS, -(-total // part_rows)), target_recall)

    def route(batches):
        import pyarrow as pa

        for batch in batches:
            values = batch.column("_x").flatten().to_numpy().reshape(-1, dims)
            best = router.best(values, probes)
            ends = np.arange(len(best) + 1, dtype=np.int32) * probes
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(best.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "_parts"])

    routed = materialize(
        x.mapInArrow(route, T.StructType([*x.schema.fields, T.StructField("_parts", T.ArrayType(T.IntegerType()))])).unionByName(others),
        "routed-vectors",
    )
    home = F.col("_parts")[0]
    row_counts = routed.groupBy(home.alias("_part")).agg(F.count("*").alias("rows"))
    asked = routed.where("_query").select(F.explode("_parts").alias("_part"))
    query_counts = asked.groupBy("_part").agg(F.count("*").alias("queries"))
    cuts = row_counts.join(query_counts, "_part").select(
        "_part", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("_rows"), F.ceil(F.col("queries") / BLOCK_QUERIES).cast("int").alias("_queries")
    )
    cuts = materialize(cuts, "part-blocks")
    salt = F.xxhash64(F.lit("block"), "_row")
    rows = (
        routed.select("_row", "_id", "_x", home.alias("_part"))
        .join(cuts, "_part")
        .withColumn("_row_block", F.pmod(salt, F.col("_rows")).cast("int"))
        .withColumn("_query_block", F.explode(F.sequence(F.lit(0), F.col("_queries") - 1)))
    )
    queries = (
        routed.where("_query").select("_row", "_id", "_x", F.explode("_parts").alias("_part"))
        .join(cuts, "_part")
        .withColumn("_query_block", F.pmod(salt, F.col("_queries")).cast("int"))
        .withColumn("_row_block", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)))
    )
    block = ["_part", "_row_block", "_query_block"]
    id_type = vectors.schema[key].dataType.simpleString()

    def compare(left, right):
        import pandas as pd

        names = ["query_row", "query_id", "row_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names})
        queries, rows = rows_of(left), rows_of(right)
        query, row, score = exact_best(queries, rows, k)
        return pd.DataFrame(dict(zip(names, (queries[0][query], queries[1][query], rows[1][row], score), strict=True)))

    found = (
        queries.select(*block, "_row", "_id", "_x")
        .toDF(*block, "_row", "_id", "_x")
        .groupBy(*block)
        .cogroup(rows.select(*block, "_row", "_id", "_x").toDF(*block, "_row", "_id", "_x").groupBy(*block))
        .applyInPandas(compare, f"query_row long, query_id {id_type}, row_id {id_type}, score double")
    )
    ranked = found.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_row").orderBy("score", "row_id"))
    ).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("row_id").alias(schema.names[2]), "score")
