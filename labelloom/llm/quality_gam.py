"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins and gets a lookup table of log odds, as do a few pairs of features. The
tables are learned by cyclic boosting: round after round each feature in turn gets one shallow tree over
its bins, fitted to the current gradients and added at a small rate. A score is the logistic of the sum
of one table entry per feature and pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from labelloom.llm import features
from labelloom.llm.common import held_out, id_hash, map_texts, text_column
from labelloom.operators.scale import materialize

HELD_OUT_FOLDS = 5
# Labelled rows that the driver fits on at most, up to the spread of a draw by hash.
SAMPLE_ROWS = 20_000
DRAW = 1 << 30

FEATURES = (
    "words", "word_length", "symbols_per_word", "symbol_share", "dup_lines", "repeated", "distinct",
    "commonest", "capitals", "digits", "marks", "stops", "wide", "long_words", "short_words", "bare_words",
    "words_per_line",
)


def feature_matrix(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios of the counts of a text, one column per feature; an empty text has zeros."""
    c = {k: np.asarray(v, dtype=float) for k, v in counts.items()}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    columns = (
        np.log1p(c["n_words"]),
        c["word_chars"] / words,
        c["n_symbols"] / words,
        c["n_symbols"] / chars,
        c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words,
        c["n_distinct"] / words,
        c["n_top"] / words,
        c["n_upper"] / chars,
        c["n_digits"] / chars,
        c["n_marks"] / words,
        c["n_stops"] / words,
        c["n_wide"] / np.maximum(c["n_chars"], 1),
        c["n_long"] / words,
        c["n_short"] / words,
        c["n_bare"] / words,
        c["n_words"] / lines,
    )
    return np.column_stack(columns)


def leaf_values(grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float) -> tuple[np.ndarray, float]:
    """A tree of cuts over ordered bins: one Newton step per bin, and the gain over no step."""

    def grow(a: int, b: int, depth: int) -> float:
        g, h = grad[a:b].sum(), hess[a:b].sum()
        whole = g * g / (h + ridge)
        if depth and b - a > 1:
            left_g, left_h = np.cumsum(grad[a:b])[:-1], np.cumsum(hess[a:b])[:-1]
            split = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge)
            at = int(split.argmax())
            if split[at] > whole + 1e-12:
                return grow(a, a + at + 1, depth - 1) + grow(a + at + 1, b, depth - 1)
        step[a:b] = g / (h + ridge)
        return whole

    step = np.zeros(len(grad))
    return step, grow(0, len(grad), depth)


def quadrant_values(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best single cut of each axis of a two-way table: one Newton step per quadrant, and the gain."""
    best, gain = np.zeros_like(grad), 0.0
    if min(grad.shape) < 2:
        return best, gain
    g, h = (np.cumsum(np.cumsum(x, axis=0), axis=1) for x in (grad, hess))
    corner = [x[:-1, :-1] for x in (g, h)]
    upper = [x[:-1, -1:] - c for x, c in zip((g, h), corner, strict=True)]
    lower = [x[-1:, :-1] - c for x, c in zip((g, h), corner, strict=True)]
    rest = [x[-1, -1] - c - u - w for x, c, u, w in zip((g, h), corner, upper, lower, strict=True)]
    quadrants = [corner, upper, lower, rest]
    total = sum(q**2 / (w + ridge) for q, w in quadrants)
    i, j = np.unravel_index(int(total.argmax()), total.shape)
    steps = [q[i, j] / (w[i, j] + ridge) for q, w in quadrants]
    best[: i + 1, : j + 1], best[: i + 1, j + 1 :], best[i + 1 :, : j + 1], best[i + 1 :, j + 1 :] = steps
    return best, float(total[i, j])


@dataclass
class Gam:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    # (feature, feature, coarse edges, coarse edges, table)
    pairs: list[tuple] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            odds += table[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, edges_a, edges_b, table in self.pairs:
            at = np.searchsorted(edges_a, x[:, a], side="right"), np.searchsorted(edges_b, x[:, b], side="right")
            odds += table[at]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def cut_points(column: np.ndarray, bins: int) -> np.ndarray:
    """Quantile edges between bins; equal values never part."""
    quantiles = np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")
    edges = np.unique(quantiles)
    above = np.searchsorted(np.unique(column), edges, side="right")
    values = np.unique(column)
    return np.unique(np.array([(e + values[i]) / 2 for e, i in zip(edges, above, strict=True) if i < len(values)]))


def fit_gam(
    x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, depth: int = 2,
    n_pairs: int = 6, pair_bins: int = 8, ridge: float = 1.0,
) -> Gam:
    """Fit by cyclic boosting; without rows of both classes only a smoothed intercept is learned."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    n_features = x.shape[1]
    model.edges = [cut_points(x[:, j], bins) for j in range(n_features)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    odds = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(n_features):
            grad, hess = slopes()
            size = len(model.tables[j])
            step, _ = leaf_values(
                np.bincount(binned[j], grad, size), np.bincount(binned[j], hess, size), depth, ridge
            )
            model.tables[j] += rate * step
            odds += rate * step[binned[j]]

    coarse = [cut_points(x[:, j], pair_bins) for j in range(n_features)]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def two_way(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(at[a] * shape[1] + at[b], values, shape[0] * shape[1]).reshape(shape)

    grad, hess = slopes()
    gains = [
        (quadrant_values(two_way(a, b, grad), two_way(a, b, hess), ridge)[1], a, b)
        for a in range(n_features)
        for b in range(a + 1, n_features)
    ]
    chosen = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:n_pairs] if gain > 0]
    tables = {ab: np.zeros((len(coarse[ab[0]]) + 1, len(coarse[ab[1]]) + 1)) for ab in chosen}
    for _ in range(rounds):
        for a, b in chosen:
            grad, hess = slopes()
            step, _ = quadrant_values(two_way(a, b, grad), two_way(a, b, hess), ridge)
            tables[a, b] += rate * step
            odds += rate * step[at[a], at[b]]
    model.pairs = [(a, b, coarse[a], coarse[b], t) for (a, b), t in tables.items()]
    return model


def training_ids(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """(key, _label) of labelled ids outside the held-out fold, drawn by hash down to about ``rows``."""
    known = (
        labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(key), HELD_OUT_FOLDS))
        .groupBy(key)
        .agg(F.min(label).alias("_label"))
    )
    number = known.count()
    bits = F.pmod(F.xxhash64(F.lit("quality"), F.col(key)), F.lit(DRAW))
    return known.where(bits < int(min(1.0, rows / max(number, 1)) * DRAW))


def training_sample(counted: DataFrame, drawn: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts and labels of the drawn ids; of several rows of an id, those with the smallest counts."""
    figures = F.struct(*features.COUNTS)
    rows = counted.select(key, figures.alias("_c")).join(F.broadcast(drawn), key).groupBy(key)
    found = rows.agg(F.min("_c").alias("_c"), F.first("_label").alias("_label")).select(key, "_c.*", "_label")
    found = found.orderBy(id_hash(F.col(key)), key).toPandas()
    x = feature_matrix({c: found[c].to_numpy() for c in features.COUNTS})
    return x, found["_label"].to_numpy(dtype=float)


def fit_quality(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text",
    label: str = "quality",
) -> tuple[Gam, DataFrame]:
    """The model, and the counts (key, COUNTS) of all texts that it was fitted on, in the shared folder."""
    counted = materialize(
        map_texts(docs, text, [key], lambda: features.count_texts, features.FIELDS), "classifier-counts"
    )
    drawn = training_ids(labels, key, label, sample_rows)
    return fit_gam(*training_sample(counted, drawn, key)), counted


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    accept: float = 0.3,
    sample_rows: int = SAMPLE_ROWS,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> DataFrame:
    """(key, held_out, score, predicted) of every row's whole text.

    The model learns from labelled rows whose id is outside the held-out fold (crc32 of the id as text
    mod 5 is not 0); ids, languages, sources and labels are no inputs. ``score`` is the probability of
    label 1, ``predicted`` 1 from ``accept`` on. Labels other than 0 and 1 are ignored, several labels of
    one id count as the smallest; without labels of both classes all texts get the same score. Null and
    empty texts are scored by zero counts. Equal texts get equal scores, a null id is never held out and
    stays null, other columns are not read, an empty table gives an empty one.

    Texts are read once and their counts are written to the shared folder; the driver gets about
    ``sample_rows`` rows of counts whatever the size of the tables.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    model, counted = fit_quality(docs, labels, sample_rows, key, text, label)
    schema = T.StructType([counted.schema[key], T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        arrow = to_arrow_schema(schema)
        for batch in batches:
            x = feature_matrix({c: batch.column(c).to_numpy(zero_copy_only=False) for c in features.COUNTS})
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(model.score(x))], schema=arrow)

    scored = counted.select(key, *features.COUNTS).mapInArrow(run, schema)
    return scored.select(
        key,
        held_out(F.col(key), HELD_OUT_FOLDS).alias("held_out"),
        "score",
        (F.col("score") >= accept).cast("int").alias("predicted"),
    )


def accepted(
    docs: DataFrame, labels: DataFrame, accept: float = 0.3, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id",
    text: str = "text", label: str = "quality",
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``accept`` or more (see quality_scores).

    Only the texts that the model learns from are counted beforehand.
    """
    drawn = training_ids(labels, key, label, sample_rows)
    chosen = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(drawn.select(key)), key, "left_semi")
    counted = map_texts(chosen, "_text", [key], lambda: features.count_texts, features.FIELDS)
    model = fit_gam(*training_sample(counted, drawn, key))

    def score(texts: list) -> np.ndarray:
        return model.score(feature_matrix(features.count_texts(texts)))

    return docs.where(text_column(docs, text, score, T.DoubleType()) >= accept)
