"""Pack documents into windows of a fixed number of tokens by non-negative least squares.

A document is cut at multiples of the window; its full windows stand alone and its tail is one of
window - 1 possible lengths. The histogram of tails is all that packing needs to know: combinations of one
to three lengths that fill a window are enumerated, non-negative least squares finds how often to repeat
each one so that together they use the histogram up, and the repeats are rounded down. Residual tails
are packed greedily, largest first with the best fit; what would leave windows half empty is laid end to
end and cut at the window's border. The plan is a short list of rank ranges per length: the n-th tail of
a length finds its window by looking its rank up, so no document waits for another.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from labelloom.llm.common import map_arrays
from labelloom.llm.encoder import encoder
from labelloom.operators.scale import materialize

# Tail lengths are rounded up to multiples of this for the least squares; the waste is below it per tail.
GRAIN = 4
# A greedily packed window is accepted from this share of its tokens.
WELL_FILLED = 0.99
# Documents that are packed together where sequences follow an order.
RANGE_DOCS = 1_024


def combinations(units: int) -> np.ndarray:
    """All ways to write ``units`` as a sum of one to three positive parts, as rows padded with 0."""
    rows = [(units, 0, 0)]
    for a in range(units - 1, 0, -1):
        for b in range(min(a, units - a), 0, -1):
            c = units - a - b
            if c <= b:
                rows.append((a, b, c))
    return np.array(rows)


def least_squares_repeats(histogram: np.ndarray, patterns: np.ndarray, batch: int = 16) -> np.ndarray:
    """x >= 0 that minimises ||A x - histogram||, A counting the parts of each pattern.

    Active sets: patterns with the steepest gradient join, a step that would turn one negative stops
    there and drops it. The solution has at most as many patterns as there are lengths.
    """
    n = len(patterns)

    def part_counts(which: np.ndarray) -> np.ndarray:
        a = np.zeros((len(histogram), len(which)))
        for part in patterns[which].T:
            np.add.at(a, (part, np.arange(len(which))), 1.0)
        a[0] = 0
        return a

    x = np.zeros(n)
    target = histogram.astype(float)
    target[0] = 0
    active = np.zeros(0, dtype=int)
    residual = target.copy()
    scale = max(float(np.abs(target).max()), 1.0)
    for _ in range(4 * len(histogram)):
        gradient = residual[patterns[:, 0]] + residual[patterns[:, 1]] + residual[patterns[:, 2]]
        gradient[active] = -np.inf
        fresh = np.argsort(-gradient, kind="stable")[:batch]
        fresh = fresh[gradient[fresh] > 1e-7 * scale]
        if not len(fresh) or len(active) >= len(histogram):
            break
        before = float(residual @ residual)
        active = np.concatenate([active, fresh])
        while len(active):
            a = part_counts(active)
            gram = a.T @ a
            gram[np.diag_indices_from(gram)] += 1e-9
            solution = np.linalg.solve(gram, a.T @ target)
            if (solution > 0).all():
                break
            negative = np.flatnonzero(solution <= 0)
            old = x[active[negative]]
            steps = old / np.maximum(old - solution[negative], 1e-300)
            step = float(min(1.0, steps.min()))
            x[active] += step * (solution - x[active])
            gone = (x[active] <= 1e-9) & (solution <= 0)
            x[active[gone]] = 0
            active = active[~gone]
        x[active] = solution if len(active) else 0
        residual = target - part_counts(active) @ x[active] if len(active) else target.copy()
        if before - float(residual @ residual) < 1e-5 * float(target @ target):
            break
    return x


@dataclass
class Plan:
    """Where the tails of each length go, by rank from 0.

    Row of ``table``: length, first rank, rank behind the last, window of the first one, windows per rank
    (1, or 0 for tails laid end to end), place in that window (end to end: token of the stream).
    ``windows`` counts the windows used.
    """

    table: np.ndarray
    windows: int


def plan_tails(histogram: np.ndarray, window: int, grain: int = GRAIN, well_filled: float = WELL_FILLED) -> Plan:
    """Distribute ``histogram[length]`` tails of each length below ``window`` over windows."""
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    rows: list[tuple[int, int, int, int, int, int]] = []
    windows = 0

    def take(lengths: list[int], times: int) -> None:
        nonlocal windows
        offset = 0
        for index, length in enumerate(lengths):
            at = int(used[length])
            used[length] += times
            left[length] -= times
            rows.append((length, at, at + times, windows, 1, offset))
            offset += length
        windows += times

    units = window // grain
    cells = -(-np.arange(len(left)) // grain)
    coarse = np.bincount(cells, left, units + 1)
    patterns = combinations(units)
    held = (coarse[patterns] > 0) | (patterns == 0)
    patterns = patterns[held.all(axis=1)]
    repeats = np.floor(least_squares_repeats(coarse, patterns) + 1e-6).astype(np.int64) if len(patterns) else []
    members = [np.flatnonzero(cells == u) for u in range(units + 1)]

    def lengths_of(pattern: tuple[int, ...]) -> list[int] | None:
        """A length that is left for each part, longest first within its cell; None if one is missing."""
        chosen: list[int] = []
        for unit in pattern:
            found = next((int(v) for v in members[unit][::-1] if left[v] > chosen.count(int(v))), None)
            if found is None:
                return None
            chosen.append(found)
        return chosen

    for k in np.argsort(-np.asarray(repeats), kind="stable"):
        pattern = tuple(int(u) for u in patterns[k] if u)
        todo = int(repeats[k])
        while todo > 0:
            lengths = lengths_of(pattern)
            if lengths is None:
                break
            times = min([todo, *(int(left[v]) // lengths.count(v) for v in lengths)])
            take(lengths, times)
            todo -= times

    stream: list[tuple[int, int]] = []
    for longest in range(len(left) - 1, 0, -1):
        while left[longest] > 0:
            lengths, room = [longest], window - longest
            while room > 0:
                fits = next((v for v in range(min(room, longest), 0, -1) if left[v] > lengths.count(v)), 0)
                if not fits:
                    break
                lengths.append(fits)
                room -= fits
            if window - room < well_filled * window:
                stream.append((longest, int(left[longest])))
                left[longest] = 0
                break
            take(lengths, min(int(left[v]) // lengths.count(v) for v in lengths))

    position = 0
    for length, times in stream:
        at = int(used[length])
        rows.append((length, at, at + times, windows, 0, position))
        used[length] += times
        position += times * length
    windows += -(-position // window)
    table = np.array(rows, dtype=np.int64).reshape(-1, 6)
    return Plan(table[np.lexsort((table[:, 1], table[:, 0]))], windows)


def place_tails(plan: Plan, window: int, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
    """(window number, offset, tokens before the cut) of tails; a cut tail goes on in the next window."""
    span = int(plan.table[:, 2].max(initial=0)) + 1
    row = plan.table[np.searchsorted(plan.table[:, 0] * span + plan.table[:, 1], lengths * span + ranks, "right") - 1]
    nth = ranks - row[:, 1]
    stream = row[:, 4] == 0
    token = row[:, 5] + np.where(stream, nth * lengths, 0)
    number = row[:, 3] + np.where(stream, token // window, nth)
    offset = np.where(stream, token % window, row[:, 5])
    return number, offset, np.minimum(lengths, window - offset)


def measured(
    docs: DataFrame, path: str, end_id: int, window: int, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: its task and rank of its tail there, crc32 of its full windows, ids of its tail.

    ``part``, ``tail`` and ``tail_rank`` together name a row.
    """
    fields = [
        T.StructField("tokens", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("full_rank", T.LongType()),
        T.StructField("tail", T.IntegerType()),
        T.StructField("tail_rank", T.LongType()),
        T.StructField("full_crc", T.ArrayType(T.LongType())),
        T.StructField("tail_ids", T.BinaryType()),
    ]

    def make():
        from pyspark import TaskContext

        encode, part = encoder(path, spaced=True), TaskContext.get().partitionId()
        size, seen, full = 4 * window, np.zeros(window, dtype=np.int64), 0

        def measure(texts) -> dict:
            nonlocal full
            rows = []
            for data in encode.ids(texts).ended(end_id).slices():
                n = len(data) // size
                tail = bytes(data[n * size :])
                length = len(tail) // 4
                crc = [zlib.crc32(data[i * size : (i + 1) * size]) for i in range(n)]
                rows.append((len(data) // 4, part, full, length, int(seen[length]), crc, tail))
                seen[length] += 1
                full += n
            return dict(zip([f.name for f in fields], zip(*rows, strict=True), strict=True))

        return measure

    return materialize(map_arrays(docs, text, [key, *keep], make, fields), "packing-tails")


PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pieces(batch, plan: Plan, window: int, full_first: list[int], ranks: np.ndarray) -> tuple[list[int], list[tuple]]:
    """(row of the batch, values of PIECE) of every piece of measured documents.

    ``full_first`` numbers the first full window of each document, ``ranks`` its tail among those of its length.
    """
    tail = batch.column("tail").to_numpy().astype(np.int64)
    has = np.flatnonzero(tail)
    number, offset, first = (np.zeros(len(tail), dtype=np.int64) for _ in range(3))
    number[has], offset[has], first[has] = place_tails(plan, window, tail[has], ranks[has])
    take, out = [], []
    columns = zip(
        batch.column("tokens").to_pylist(), full_first, batch.column("full_crc").to_pylist(), batch.column("tail_ids"),
        tail.tolist(), number.tolist(), offset.tolist(), first.tolist(), strict=True,
    )
    for i, (tokens, full, crcs, ids, length, sequence, place, cut) in enumerate(columns):
        for k, crc in enumerate(crcs):
            out.append((k * window, window, crc, tokens, plan.windows + full + k, 0))
        if length:
            start, data = tokens - length, memoryview(ids.as_buffer())
            out.append((start, cut, zlib.crc32(data[: 4 * cut]), tokens, sequence, place))
            if cut < length:
                out.append((start + cut, length - cut, zlib.crc32(data[4 * cut :]), tokens, sequence + 1, 0))
        take += [i] * (len(out) - len(take))
    return take, out


def pack(
    docs: DataFrame, path: str, end_id: int = 0, window: int = 1024, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``window`` tokens.

    (key, start, length, ids_crc32, doc_tokens, sequence_id, offset). A document is the ids of its whole text
    and ``end_id``; a null or empty text is the end id alone. Each id lies in one piece; the pieces of a
    sequence fill it from offset 0 without gaps. Equal rows are documents of their own; a null key stays
    null; other columns are not read; an empty table gives no pieces.

    The driver and every task get the plan: a few rows per tail length, bounded by the window. Ranks come
    from counts per task and length; full windows are numbered behind the windows of the tails.
    """
    rows = measured(docs, path, end_id, window, key, text)
    spark = rows.sparkSession
    counts = (
        rows.groupBy("part", F.col("tail").alias("length"))
        .agg(F.count("*").alias("n"), F.sum(F.size("full_crc")).cast("long").alias("full"))
    )
    counts = materialize(counts, "packing-counts")
    found = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    histogram = np.array([found.get(v, 0) for v in range(window)], dtype=np.int64)
    histogram[0] = 0
    plan = plan_tails(histogram, window)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    starts = before.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("before")
    )
    all_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    full = counts.groupBy("part").agg(F.sum("full").alias("full"))
    full = full.select("part", F.coalesce(F.sum("full").over(all_parts), F.lit(0)).alias("full_before"))
    offsets = starts.join(full, "part")
    joined = rows.join(offsets, "part").select(
        key, "tokens", "tail", (F.col("full_before") + F.col("full_rank")).alias("full_first"),
        F.expr("before[tail] + tail_rank").alias("rank"), "full_crc", "tail_ids",
    )
    schema = T.StructType([rows.schema[key], *(T.StructField(c, T.LongType()) for c in PIECE)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            ranks = batch.column("rank").to_numpy(zero_copy_only=False)
            take, out = pieces(batch, plan, window, batch.column("full_first").to_pylist(), ranks)
            if out:
                values = [pa.array(v, type=pa.int64()) for v in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(take)), *values], schema=arrow)

    return joined.mapInArrow(run, schema)


def pack_in_order(
    docs: DataFrame, path: str, order: str, end_id: int = 0, window: int = 1024, key: str = "doc_id", text: str = "text",
    range_docs: int | None = None,
) -> DataFrame:
    """Pieces as those of ``pack``, with sequences that follow the documents' order.

    ``order`` names a column that numbers the documents from 0. Runs of ``range_docs`` (RANGE_DOCS) of them are packed by
    themselves, each with a plan of its own tails, and their sequences are numbered run by run: all documents of
    a run are in the sequences before those of the next run. Only the last sequence of a run's cut tails and
    what its greedy windows leave is padded.
    """
    return pack_ranges(measured(docs, path, end_id, window, key, text, (order,)), order, window, key, range_docs)


def pack_ranges(rows: DataFrame, order: str, window: int = 1024, key: str = "doc_id", range_docs: int | None = None) -> DataFrame:
    """``pack_in_order`` for ``measured`` documents."""
    rows = rows.withColumn("_range", F.floor(F.col(order) / (range_docs or RANGE_DOCS)).cast("long"))
    fields = [T.StructField("_range", T.LongType()), rows.schema[key], *(T.StructField(c, T.LongType()) for c in PIECE)]
    schema = T.StructType(fields)

    def run(table):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        table = table.sort_by(order).combine_chunks()
        tail = table.column("tail").to_numpy().astype(np.int64)
        plan = plan_tails(np.bincount(tail, minlength=window) * (np.arange(window) > 0), window)
        by_length = np.argsort(tail, kind="stable")
        ranks = np.empty(len(tail), dtype=np.int64)
        ranks[by_length] = np.arange(len(tail)) - np.searchsorted(tail[by_length], tail[by_length])
        full = np.array([len(c) for c in table.column("full_crc").to_pylist()], dtype=np.int64)
        take, out = pieces(table, plan, window, (np.cumsum(full) - full).tolist(), ranks)
        kept = table.select(["_range", key]).take(pa.array(take, type=pa.int64()))
        values = [pa.array(v, type=pa.int64()) for v in zip(*out, strict=True)]
        return pa.Table.from_arrays([*kept.columns, *values], schema=to_arrow_schema(schema))

    packed = materialize(rows.groupBy("_range").applyInArrow(run, schema), "packed-ranges")
    sizes = packed.groupBy("_range").agg((F.max("sequence_id") + 1).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    sequence = (F.col("_first") + F.col("sequence_id")).alias("sequence_id")
    return packed.join(starts, "_range").select(key, *(sequence if c == "sequence_id" else c for c in PIECE))
