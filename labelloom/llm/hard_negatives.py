"""Hard negatives of anchors, found with rotated one-bit codes.

A vector is rotated at random and coded by the signs of its components; the code-vector alignment (the
length of the vector along its code) is stored beside it, and what the code leaves over is coded again, a
few times. The inner product with an anchor is then a sum of popcounts over the bit planes of the
anchor, and Cauchy-Schwarz bounds what the last remainder can add: every pair gets an interval that is
certain to hold its score. Pairs whose interval cannot matter go; the rest are scored in integers.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from labelloom.llm.common import reachable
from labelloom.operators.scale import materialize

LEVELS = 4
PLANES = 8
# Rows of a block, fewer in a table that would not fill all tasks, and anchors that meet a block at a time.
BLOCK_ROWS = 65_536
LEAST_BLOCK_ROWS = 2_048
BLOCK_ANCHORS = 8_192
# Pairs held at a time, and pairs scored at a time.
PAIRS = 1 << 20
SCORED = 1 << 15


@cache
def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    return np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0]


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("<u8")


def _popcount(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=1, dtype=np.int64)


def code(vectors: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row and level: the signs as 64-bit words, the length along them, and the length left over."""
    rest = vectors.astype(float) @ rotation(vectors.shape[1])
    ones, along, left = [], [], []
    for _ in range(levels):
        signs = rest >= 0
        length = np.abs(rest).mean(axis=1) if rest.shape[1] else np.zeros(len(rest))
        rest = rest - np.where(signs, length[:, None], -length[:, None])
        ones.append(_words(signs))
        along.append(length)
        left.append(np.sqrt((rest * rest).sum(axis=1)))
    return np.stack(ones, axis=1), np.stack(along, axis=1), np.stack(left, axis=1)


class Coded:
    """Integer vectors with their stored codes."""

    def __init__(self, vectors: np.ndarray, ones: np.ndarray, along: np.ndarray, left: np.ndarray):
        self.vectors = vectors
        self.norm = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        self.levels = [tuple(np.ascontiguousarray(x[:, i]) for x in (ones, along, left)) for i in range(ones.shape[1])]


class Anchors:
    """Rotated anchors as bit planes of their components, rounded to PLANES bits; the rounding is bounded."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        turned = vectors.astype(float) @ rotation(vectors.shape[1])
        self.norm = np.sqrt((turned * turned).sum(axis=1))
        self.low = turned.min(axis=1, initial=0)
        self.step = (turned.max(axis=1, initial=0) - self.low) / (2**PLANES - 1)
        units = np.rint((turned - self.low[:, None]) / np.where(self.step > 0, self.step, 1)[:, None]).astype(np.int64)
        rounded = self.low[:, None] + self.step[:, None] * units
        self.error = np.abs(turned - rounded).sum(axis=1)
        self.total = rounded.sum(axis=1)
        self.planes = [_words((units >> b) & 1 == 1) for b in range(PLANES)]

    def along_code(self, anchor: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Inner product of rounded anchors with codes of signs."""
        units = sum(_popcount(p[anchor] & ones) << b for b, p in enumerate(self.planes))
        return 2 * (self.low[anchor] * _popcount(ones) + self.step[anchor] * units) - self.total[anchor]


def scores(anchors: Anchors, rows: Coded, anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs."""
    if anchors.norm.max(initial=0) * rows.norm.max(initial=0) >= 2.0**62:
        raise ValueError("inner products of these vectors do not fit into 64 bits")
    out = np.empty(len(anchor), dtype=np.int64)
    for a in range(0, len(anchor), SCORED):
        part = slice(a, a + SCORED)
        out[part] = (anchors.vectors[anchor[part]] * rows.vectors[row[part]]).sum(axis=1)
    return out


def refine(anchors: Anchors, rows: Coded, anchor: np.ndarray, row: np.ndarray, wanted) -> tuple[np.ndarray, ...]:
    """(anchor, row, score) of the pairs that ``wanted`` still keeps at the last level.

    ``wanted(anchor, low, high)`` says which pairs can matter, given intervals that hold their scores.
    """
    dims = max(1, rows.vectors.shape[1])
    estimate, rounding = np.zeros(len(anchor)), np.zeros(len(anchor))
    for ones, along, left in rows.levels:
        inner = anchors.along_code(anchor, ones[row])
        estimate = estimate + along[row] * inner
        rounding = rounding + along[row] * anchors.error[anchor]
        # What is left over stands at right angles to the code.
        certain = np.maximum(np.abs(inner) - anchors.error[anchor], 0)
        across = np.sqrt(np.maximum(anchors.norm[anchor] ** 2 - certain**2 / dims, 0))
        slack = 1e-9 * anchors.norm[anchor] * rows.norm[row] + 1e-6
        radius = left[row] * across + rounding + slack
        keep = np.flatnonzero(wanted(anchor, estimate - radius, estimate + radius))
        anchor, row, estimate, rounding = anchor[keep], row[keep], estimate[keep], rounding[keep]
    return anchor, row, scores(anchors, rows, anchor, row)


def first(slot: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of each slot's ``k`` highest scores, ties to smaller keys, masked keys last."""
    order = np.lexsort((np.ma.getdata(key), np.ma.getmaskarray(key), -score, slot))
    ranked = slot[order]
    start = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(ranked)) - np.repeat(start, np.diff(np.r_[start, len(ranked)]))
    return order[rank < k]


class Best:
    """The ``k`` best rows of each slot so far."""

    def __init__(self, slots: int, k: int):
        self.k, self.slots = k, slots
        self.slot, self.score, self.key = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.key = np.ma.array(self.key)

    def add(self, slot: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        slot, score = np.r_[self.slot, slot], np.r_[self.score, score]
        key = np.ma.concatenate([self.key, key])
        keep = first(slot, score, key, self.k)
        self.slot, self.score, self.key = slot[keep], score[keep], key[keep]

    def floor(self) -> np.ndarray:
        """The score below which a row cannot be among a slot's best."""
        full = np.bincount(self.slot, minlength=self.slots) >= self.k
        low = np.full(self.slots, np.inf)
        np.minimum.at(low, self.slot, self.score.astype(float))
        return np.where(full, low, -np.inf)


def _pairs(mask: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    anchor, row = np.nonzero(mask)
    return anchor + at, row


def best_positives(anchors: Anchors, anchor_rows: dict, rows: Coded, row_info: dict, best: Best) -> None:
    """Add the rows of each anchor's own label, the anchor's row left out, to the best of its slot."""
    step = max(1, PAIRS // max(1, len(row_info["uid"])))
    for a in range(0, len(anchor_rows["uid"]), step):
        part = slice(a, a + step)
        mask = (anchor_rows["label"][part, None] == row_info["label"][None, :]) & (anchor_rows["uid"][part, None] != row_info["uid"][None, :])
        anchor, row = _pairs(mask, a)
        floor = best.floor()
        anchor, row, score = refine(anchors, rows, anchor, row, lambda anchor, low, high: high >= floor[anchor])
        best.add(anchor, score, row_info["key"][row])


def best_negatives(anchors: Anchors, anchor_rows: dict, rows: Coded, row_info: dict, best: Best, percent: int) -> None:
    """Add rows of other labels whose score lies in a positive's range to the best of that positive.

    Positive j of anchor a is slot a * width + j; missing positives have masked scores.
    """
    positive = anchor_rows["positives"]
    width = positive.shape[1]
    present = ~np.ma.getmaskarray(positive) & (np.ma.getdata(positive) >= 0)
    value = np.where(present, np.ma.getdata(positive), -1)
    least = -(-(percent * value) // 100)
    highest = np.where(present, value, -np.inf).max(axis=1, initial=-np.inf)
    step = max(1, PAIRS // max(1, len(row_info["uid"])))
    for a in range(0, len(anchor_rows["uid"]), step):
        part = slice(a, a + step)
        floor = np.where(present, np.maximum(least, best.floor().reshape(-1, width)), np.inf)
        lowest = floor.min(axis=1, initial=np.inf)
        mask = (anchor_rows["label"][part, None] != row_info["label"][None, :]) & np.isfinite(highest[part, None])
        anchor, row = _pairs(mask, a)
        anchor, row, score = refine(
            anchors, rows, anchor, row, lambda anchor, low, high: (high >= lowest[anchor]) & (low <= highest[anchor])
        )
        for j in range(width):
            inside = np.flatnonzero(present[anchor, j] & (score <= value[anchor, j]) & (score >= floor[anchor, j]))
            best.add(anchor[inside] * width + j, score[inside], row_info["key"][row[inside]])


def usable(label: Column, vector: Column) -> Column:
    """No null label, and a vector without null or non-finite components."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole_numbers(vectors: DataFrame, scale: float, vector: str, label: str) -> DataFrame:
    """Rows that take part, with the vector's components as floor(scale * x)."""
    x = F.col(vector).cast("array<double>")
    part = vectors.where(usable(F.col(label), x))
    return part.withColumn(vector, F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v).cast("long")))


def _matrix(column, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), dims)


def coded(batches):
    """Batches of rows with their codes, rows of equal length together."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        table = pa.Table.from_batches([batch])
        for dims in pc.unique(table["_dims"]).to_pylist():
            part = table.filter(pc.equal(table["_dims"], dims))
            ones, along, left = code(_matrix(part["_x"], dims))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), LEVELS).cast(pa.list_(pa.float64())) for x in (along, left)]
            words = pa.array([x.tobytes() for x in ones], type=pa.binary())
            whole = part.append_column("_ones", words).append_column("_along", lists[0]).append_column("_left", lists[1])
            yield from whole.combine_chunks().to_batches()


def _info(table, labels: np.ndarray) -> dict:
    """Keys (masked where null), labels and row numbers."""
    key = table["_key"].combine_chunks()
    return {
        "uid": table["_uid"].to_numpy(),
        "key": np.ma.array(key.fill_null(0).to_numpy(), mask=key.is_null().to_numpy(zero_copy_only=False)),
        "label": labels,
    }


def meet(rows, anchors, dims: int, compare) -> tuple[dict, Best]:
    """What ``compare`` finds for the anchors of one length in the rows of a block."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows, anchors = (t.filter(pc.equal(t["_dims"], dims)) for t in (rows, anchors))
    labels = pa.concat_arrays([x.combine_chunks() for x in (anchors["_name"], rows["_name"])]).dictionary_encode().indices.to_numpy()
    anchor_info, row_info = _info(anchors, labels[: len(anchors)]), _info(rows, labels[len(anchors) :])
    if "_positives" in anchors.column_names:
        scores = anchors["_positives"].to_pylist()
        width = max(map(len, scores))
        anchor_info["positives"] = np.ma.array([x + [0] * (width - len(x)) for x in scores], mask=[[False] * len(x) + [True] * (width - len(x)) for x in scores])
    ones = np.frombuffer(b"".join(rows["_ones"].to_pylist()), dtype="<u8").reshape(len(rows), LEVELS, -(-dims // 64))
    stored = Coded(_matrix(rows["_x"], dims), ones, _matrix(rows["_along"], LEVELS), _matrix(rows["_left"], LEVELS))
    return anchor_info, compare(Anchors(_matrix(anchors["_x"], dims)), anchor_info, stored, row_info)


def mine(
    vectors: DataFrame, is_anchor: Column, percent: int = 80, positives: int = 5, negatives: int = 5,
    key: str = "vec_id", label: str = "label", vector: str = "embedding", block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of integer vectors.

    An anchor's positives are its ``positives`` best other rows of the same label; a positive's negatives
    are the ``negatives`` best rows of other labels whose score lies between ``percent`` per cent of the
    positive's score and that score. Scores are integer inner products with the anchor; ties go to smaller
    keys. Exact: the intervals of the codes only rule out what cannot be among these.

    Rows with a null label or a null vector, or a null component, take no part. A row with a null key takes
    part, behind all others on a tie. Repeated rows are rows of their own, also as positives or negatives of
    each other. Vectors of different lengths have no inner product and never meet; empty vectors score 0.
    A positive below 0, or without a row in its range, has no negatives. Integers are compared within 64
    bits; larger products raise an error. Other columns are not read; an empty table gives no rows.

    Rows are dealt evenly into blocks and anchors into shards; each pair of block and shard meets once
    per pass, holds at most ``block_rows`` coded rows and about ``block_anchors`` anchors, and gives the
    best few rows per anchor, so a hot label is spread over all blocks.
    """
    spark = vectors.sparkSession
    reachable(spark)
    x = vectors.select(
        F.col(key).cast("long").alias("_key"),
        F.col(label).cast("string").alias("_name"),
        F.col(vector).cast("array<long>").alias("_x"),
        F.coalesce(is_anchor, F.lit(False)).alias("_anchor"),
    ).where("_name IS NOT NULL AND _x IS NOT NULL AND forall(_x, v -> v IS NOT NULL)")
    size = x.agg(F.count("*").alias("rows"), F.count_if("_anchor").alias("anchors")).first()
    tasks = 2 * spark.sparkContext.defaultParallelism
    blocks = max(1, min(-(-size["rows"] // min(LEAST_BLOCK_ROWS, block_rows)), max(-(-size["rows"] // block_rows), tasks)))
    shards = max(1, -(-size["anchors"] // block_anchors))
    numbered = x.repartition(blocks).select("*", F.spark_partition_id().alias("_block"), F.monotonically_increasing_id().alias("_uid"), F.size("_x").alias("_dims"))
    fields = [T.StructField("_ones", T.BinaryType()), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("_along", "_left"))]
    table = materialize(numbered.mapInArrow(coded, T.StructType([*numbered.schema.fields, *fields])), "coded-vectors")

    shard = F.pmod(F.xxhash64("_uid"), F.lit(shards)).cast("int").alias("_shard")
    rows = table.drop("_anchor").withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    anchors = table.where("_anchor").select("_key", "_name", "_x", "_uid", "_dims", shard)

    def met(anchors: DataFrame, run, fields: str) -> DataFrame:
        copies = anchors.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return copies.groupBy("_block", "_shard").cogroup(rows.groupBy("_block", "_shard")).applyInArrow(run, fields)

    def positives_of(anchors, rows):
        import pyarrow as pa

        def compare(coded_anchors, anchor_info, coded_rows, row_info):
            best = Best(len(anchor_info["uid"]), positives)
            best_positives(coded_anchors, anchor_info, coded_rows, row_info, best)
            return best

        parts = [pa.table({"_uid": pa.array([], pa.int64()), "positive_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})]
        for dims in set(anchors["_dims"].to_pylist()) & set(rows["_dims"].to_pylist()):
            info, best = meet(rows, anchors, dims, compare)
            parts.append(pa.table({"_uid": info["uid"][best.slot], "positive_id": pa.array(np.ma.getdata(best.key), mask=np.ma.getmaskarray(best.key)), "score": best.score}))
        return pa.concat_tables(parts)

    def negatives_of(anchors, rows):
        import pyarrow as pa

        def compare(coded_anchors, anchor_info, coded_rows, row_info):
            best = Best(anchor_info["positives"].size, negatives)
            best_negatives(coded_anchors, anchor_info, coded_rows, row_info, best, percent)
            return best

        names = ("_uid", "_j", "negative_id", "negative_score")
        parts = [pa.table({n: pa.array([], pa.int64()) for n in names})]
        for dims in set(anchors["_dims"].to_pylist()) & set(rows["_dims"].to_pylist()):
            info, best = meet(rows, anchors, dims, compare)
            width = info["positives"].shape[1]
            ids = pa.array(np.ma.getdata(best.key), mask=np.ma.getmaskarray(best.key))
            parts.append(pa.table({"_uid": info["uid"][best.slot // width], "_j": best.slot % width, "negative_id": ids, "negative_score": best.score}))
        return pa.concat_tables(parts)

    found = met(anchors, positives_of, "_uid long, positive_id long, score long")
    nearest = Window.partitionBy("_uid").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"))
    kept = found.withColumn("_j", F.row_number().over(nearest) - 1).where(F.col("_j") < positives)
    chosen = kept.groupBy("_uid").agg(F.array_sort(F.collect_list(F.struct("_j", "positive_id", "score"))).alias("_chosen"))
    chosen = materialize(anchors.join(chosen, "_uid").withColumn("_positives", F.col("_chosen.score")), "anchor-positives")
    found = met(chosen.drop("_chosen"), negatives_of, "_uid long, _j long, negative_id long, negative_score long")
    nearest = Window.partitionBy("_uid", "_j").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    kept = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= negatives)
    pairs = chosen.select("_uid", F.col("_key").alias("anchor_id"), F.explode("_chosen").alias("_p")).select(
        "_uid", "anchor_id", F.col("_p._j").cast("long").alias("_j"), F.col("_p.positive_id").alias("positive_id"), F.col("_p.score").alias("positive_score")
    )
    return pairs.join(kept, ["_uid", "_j"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


# The query in SQL: labels of ids divisible by 7 moved on by one, components as floor(256 * x).
ORACLE_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id, b.r, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, r) AS j FROM pairs WHERE same
), ranges AS (SELECT * FROM positives WHERE j <= 5), negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.j ORDER BY n.score DESC, n.vec_id NULLS LAST, n.r) AS rank
  FROM ranges p JOIN pairs n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""
