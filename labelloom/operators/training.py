"""Classifiers of (label name, text) pairs for all runs of a parameter grid, one pass over the rows per epoch.

Every task starts an epoch from the same weights and learns from its own rows, in small batches with a step
size per weight; what the tasks learned is averaged by their numbers of rows. The pass that learns epoch e + 1
also measures the validation loss of epoch e, so the candidates of a run cost as much as the longest of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from labelloom.functions.numeric import at_threshold
from labelloom.operators.model import pair_features
from labelloom.operators.sampling import best_epoch, class_balance

# Token numbers, number 0 being the one that every row has.
NUMBERS = 1 << 18
# Weights travel in blocks; blocks that a task has not touched do not.
BLOCK = 1 << 12
BATCH_ROWS = 32
RATE = 0.5


@dataclass
class Weights:
    """Weights of one run and the sums of squared gradients that set their step sizes."""

    values: np.ndarray
    squares: np.ndarray

    @classmethod
    def zero(cls) -> Weights:
        return cls(np.zeros(NUMBERS, dtype=np.float32), np.zeros(NUMBERS, dtype=np.float32))

    def copy(self) -> Weights:
        return Weights(self.values.copy(), self.squares.copy())

    def probabilities(self, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of rows given as runs of token numbers, none of them empty."""
        if not len(starts):
            return np.zeros(0)
        odds = np.add.reduceat(self.values[numbers].astype(float), starts)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def learn(self, numbers: np.ndarray, starts: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        ends = np.append(starts[1:], len(numbers))
        for a in range(0, len(starts), BATCH_ROWS):
            part = slice(a, a + BATCH_ROWS)
            own = numbers[starts[part][0] : ends[part][-1]]
            error = weight[part] * (self.probabilities(own, starts[part] - starts[part][0]) - target[part])
            used, place = np.unique(own, return_inverse=True)
            slope = np.bincount(place, np.repeat(error, ends[part] - starts[part])) / len(error)
            self.squares[used] += (slope * slope).astype(np.float32)
            self.values[used] -= (RATE * slope / np.sqrt(self.squares[used] + 1e-12)).astype(np.float32)


def numbered_rows(rows: DataFrame) -> DataFrame:
    """Rows with ``numbers``, their hashed tokens and 0, in place of the text; no dictionary is built."""
    number = lambda t: (1 + F.pmod(F.xxhash64(t), F.lit(NUMBERS - 1))).cast("int")
    # sort_array compares numbers as such, array_sort would call a function for each pair.
    numbers = F.sort_array(F.array_distinct(F.concat(F.array(F.lit(0)), F.transform("tokens", number))))
    return pair_features(rows).withColumn("numbers", numbers).drop("tokens", "text")


def with_run_weights(rows: DataFrame) -> DataFrame:
    """Rows plus ``weight``: negatives per positive over all rows of a run for its positives, else 1."""
    ratios = class_balance(rows, ["run"]).select("run", "pos_weight")
    weight = F.when(F.col("target") == 1, F.coalesce("pos_weight", F.lit(1.0))).otherwise(F.lit(1.0))
    return rows.join(ratios, "run").withColumn("weight", weight).drop("pos_weight")


def _of_runs(batch):
    """(run, split, token numbers, starts, targets, weights) of the rows of each run and split in a batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    table = pa.Table.from_batches([batch])
    for pair in table.group_by(["run", "split"]).aggregate([]).to_pylist():
        rows = table.filter(pc.and_(pc.equal(table["run"], pair["run"]), pc.equal(table["split"], pair["split"]))).combine_chunks()
        lists = rows["numbers"].combine_chunks()
        starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())[:-1]])
        yield pair["run"], pair["split"], lists.flatten().to_numpy(), starts, rows["target"].to_numpy().astype(float), rows["weight"].to_numpy()


def log_losses(p: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return -(weight * target * np.log(p) + (1 - target) * np.log(1 - p))


def one_pass(rows: DataFrame, weights: dict[str, Weights]) -> tuple[dict[str, Weights], dict[str, float]]:
    """The weights after an epoch over the training rows, and the validation loss of those before it.

    ``rows`` are (run, split, numbers, target, weight). What reaches the driver are a run's weights, whatever the
    number of rows; runs without validation rows have an infinite loss.
    """

    def learn(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        mine: dict[str, Weights] = {}
        seen, loss = dict.fromkeys(weights, 0), {run: np.zeros(2) for run in weights}
        for batch in batches:
            for run, split, numbers, starts, target, weight in _of_runs(batch):
                if split == "train":
                    mine.setdefault(run, weights[run].copy()).learn(numbers, starts, target, weight)
                    seen[run] += len(starts)
                else:
                    losses = log_losses(weights[run].probabilities(numbers, starts), target, weight)
                    loss[run] += [losses.sum(), len(losses)]
        out = [(run, -1, task, seen[run], loss[run].tobytes()) for run in weights if seen[run] or loss[run][1]]
        for run, learned in mine.items():
            steps = [new - old for new, old in ((learned.values, weights[run].values), (learned.squares, weights[run].squares))]
            for block in range(NUMBERS // BLOCK):
                part = [s[block * BLOCK : (block + 1) * BLOCK] for s in steps]
                if part[0].any():
                    out.append((run, block, task, seen[run], np.stack(part).tobytes()))
        if out:
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=names)

    def add(table):
        import pyarrow as pa

        table = table.sort_by("task")
        kind = np.float64 if table["block"][0].as_py() < 0 else np.float32
        counts = table["n"].to_pylist()
        total = sum(np.frombuffer(x, dtype=kind) * (1 if kind is np.float64 else n) for n, x in zip(counts, table["data"].to_pylist(), strict=True))
        row = (table["run"][0].as_py(), table["block"][0].as_py(), 0, sum(counts), total.astype(np.float64).tobytes())
        return pa.table([pa.array([v], type=t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=names)

    names = ["run", "block", "task", "n", "data"]
    schema = "run string, block int, task int, n long, data binary"
    wanted = rows.where(F.col("run").isin(list(weights))).select("run", "split", "numbers", "target", "weight")
    parts = wanted.mapInArrow(learn, schema)
    sums = parts.groupBy("run", "block").applyInArrow(add, schema).collect()
    found = {run: w.copy() for run, w in weights.items()}
    losses, rows_of = {run: float("inf") for run in weights}, {}
    for r in sums:
        if r["block"] < 0:
            total, n = np.frombuffer(r["data"], dtype=np.float64)
            losses[r["run"]] = total / n if n else float("inf")
            rows_of[r["run"]] = r["n"]
    for r in sums:
        if r["block"] >= 0:
            steps = np.frombuffer(r["data"], dtype=np.float64).reshape(2, BLOCK) / rows_of[r["run"]]
            at = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
            found[r["run"]].values[at] += steps[0].astype(np.float32)
            found[r["run"]].squares[at] += steps[1].astype(np.float32)
    return found, losses


def fit_runs(rows: DataFrame, runs: list[str], epochs: list[int]) -> tuple[dict[str, dict[str, Weights]], DataFrame]:
    """Per run the weights of the best candidate epoch and of the candidate before it, and the choices made.

    ``rows`` are (run, split, numbers, target, weight) with the splits train and dev; rows of unknown target (neither
    0 nor 1) are left out. The longest candidate sets the number of passes, and one more over the validation
    rows measures it. ``choices`` is (run, best, previous) as ``sampling.best_epoch`` gives it.
    """
    known = rows.where(F.col("target").isin(0, 1) & F.col("split").isin("train", "dev"))
    weights = {run: Weights.zero() for run in runs}
    kept: dict[int, dict[str, Weights]] = {}
    metrics: list[tuple[str, int, float]] = []
    for epoch in range(max(epochs) + 1):
        if epoch in epochs:
            kept[epoch] = weights
        last = epoch == max(epochs)
        weights, losses = one_pass(known.where("split = 'dev'") if last else known, weights)
        if epoch in epochs:
            metrics += [(run, epoch, float(loss)) for run, loss in losses.items()]
    choices = best_epoch(rows.sparkSession.createDataFrame(metrics, "run string, epoch int, val_loss double"))
    chosen = {r["run"]: {"best": kept[r["best"]][r["run"]], "prev": kept[r["previous"]][r["run"]]} for r in choices.collect()}
    return chosen, choices


def score_runs(rows: DataFrame, models: dict[str, Weights], threshold: float = 0.5) -> DataFrame:
    """Rows (with ``numbers``) once per model, plus ``model``, ``prob`` and the 0/1 ``pred``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [f for f in rows.schema.fields if f.name != "numbers"]
    schema = T.StructType([*kept, T.StructField("model", T.StringType()), T.StructField("prob", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        arrow = to_arrow_schema(schema)
        for batch in batches:
            lists = batch.column("numbers")
            starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())[:-1]]) if len(lists) else np.zeros(0, dtype=np.int64)
            for name, weights in models.items():
                prob = weights.probabilities(lists.flatten().to_numpy(), starts)
                columns = [batch.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([name] * len(lists), pa.string()), pa.array(prob, pa.float64())], schema=arrow)

    scored = rows.mapInArrow(run, schema)
    return scored.withColumn("pred", at_threshold(F.col("prob"), threshold))
