"""Weak supervision for text quality: rules vote or abstain, EM weighs them, a posterior decides.

Each rule says good (1), bad (-1) or nothing (0). A latent class per document explains the votes; every
rule has, per class, a probability of voting good when it votes. An abstention says nothing. Expectation-maximisation runs on the counts of distinct
vote patterns, gathered over all documents: their number is bounded by 3 to the number of rules, however
many documents there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from labelloom.llm import features
from labelloom.llm.common import map_texts, text_column
from labelloom.operators.scale import materialize


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, good where ``good`` holds, else abstains. SQL over the counts."""

    name: str
    bad: str
    good: str


WORDS = "greatest(n_words, 1)"
RULES = (
    Rule("symbols", f"n_symbols > 0.1 * {WORDS}", f"n_symbols <= 0.02 * {WORDS}"),
    Rule("repeated_windows", f"n_repeat_words > 0.3 * {WORDS}", f"n_repeat_words <= 0.1 * {WORDS}"),
    Rule("repeated_lines", "n_dup_lines > 0.3 * greatest(n_lines, 1)", "n_dup_lines <= 0.1 * greatest(n_lines, 1)"),
    Rule("capitals", "n_upper > 0.3 * greatest(word_chars, 1)", "n_upper <= 0.1 * greatest(word_chars, 1)"),
    Rule("outcries", f"n_marks > 0.2 * {WORDS}", f"n_marks <= 0.03 * {WORDS}"),
    Rule("word_length", f"word_chars < 2.2 * {WORDS} or word_chars > 14 * {WORDS}", f"word_chars between 3 * {WORDS} and 10 * {WORDS}"),
    Rule("bare_words", f"n_bare > 0.15 * {WORDS}", f"n_bare <= 0.03 * {WORDS}"),
    Rule("commonest_word", f"n_top > 0.25 * {WORDS}", f"n_top <= 0.12 * {WORDS}"),
    Rule("symbol_share", "n_symbols > 0.05 * greatest(word_chars, 1)", "n_symbols <= 0.01 * greatest(word_chars, 1)"),
    Rule("noise", "n_symbols + n_marks > 0.08 * greatest(word_chars, 1)", "n_symbols + n_marks <= 0.02 * greatest(word_chars, 1)"),
    Rule("length", "n_words < 50", "n_words >= 80"),
)


def vote(rule: Rule) -> Column:
    return F.expr(f"CASE WHEN {rule.bad} THEN -1 WHEN {rule.good} THEN 1 ELSE 0 END")


def pattern(rules: tuple[Rule, ...]) -> Column:
    """All votes of a row as one string of ``-``, ``0`` and ``+``."""
    marks = [F.when(vote(r) < 0, "-").when(vote(r) > 0, "+").otherwise("0") for r in rules]
    return F.concat(*marks)


@dataclass(frozen=True)
class VoteModel:
    prior: float
    # log P(vote | class, it votes), by class (bad, good), rule and vote (-1, 0, 1); 0 for no vote.
    log_table: np.ndarray

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """Probability of the good class for each pattern."""
        if not patterns:
            return np.zeros(0)
        votes = np.array([["-0+".index(c) for c in p] for p in patterns])
        rules = np.arange(votes.shape[1])
        bad, good = (self.log_table[k][rules, votes].sum(axis=1) for k in (0, 1))
        odds = np.log1p(-self.prior) - np.log(self.prior) + bad - good
        return 1 / (1 + np.exp(np.clip(odds, -700, 700)))

    def accuracies(self) -> np.ndarray:
        """Per rule, how often its vote is right when it votes."""
        table = np.exp(self.log_table)
        right = self.prior * table[1, :, 2] + (1 - self.prior) * table[0, :, 0]
        wrong = self.prior * table[1, :, 0] + (1 - self.prior) * table[0, :, 2]
        return right / (right + wrong)


def fit_votes(patterns: list[str], numbers: list[int], rounds: int = 100, smooth: float = 1.0) -> VoteModel:
    """EM on pattern counts, from the majority of votes; a rule is never taken to be worse than chance.

    ``smooth`` is added to every count, so a vote that never occurred has a small probability. One bad
    vote against several good ones decides nothing by itself; the estimates say how much it weighs.
    """
    n_rules = len(patterns[0]) if patterns else len(RULES)
    votes = np.array([["-0+".index(c) - 1 for c in p] for p in patterns]).reshape(-1, n_rules)
    weight = np.array(numbers, dtype=float)
    lean = votes.sum(axis=1) - (votes < 0).sum(axis=1)
    good = 1 / (1 + np.exp(-lean.astype(float)))
    model = VoteModel(0.5, np.zeros((2, n_rules, 3)))
    for _ in range(rounds):
        total = weight.sum()
        prior = float(np.clip((weight @ good + smooth) / (total + 2 * smooth), 0.05, 0.95))
        table = np.ones((2, n_rules, 3))
        for k, share in enumerate((1 - good, good)):
            bad_votes = (weight * share) @ (votes < 0) + smooth
            good_votes = (weight * share) @ (votes > 0) + smooth
            table[k, :, 0] = bad_votes / (bad_votes + good_votes)
        # Never worse than chance: a bad vote is at least as likely on bad texts as on good ones.
        worse = table[0, :, 0] < table[1, :, 0]
        table[:, worse, 0] = table[:, worse, 0].mean(axis=0)
        table[:, :, 2] = 1 - table[:, :, 0]
        model = VoteModel(prior, np.log(table))
        after = model.posterior(patterns)
        if not len(after) or np.abs(after - good).max() < 1e-9:
            break
        good = after
    return model


def counted_votes(docs: DataFrame, keep: list[str], rules: tuple[Rule, ...], text: str) -> DataFrame:
    """The kept columns of every row, the counts of its whole text, and its votes."""
    return map_texts(docs, text, keep, lambda: features.count_texts, features.FIELDS).withColumn("votes", pattern(rules))


def posteriors(counted: DataFrame) -> DataFrame:
    """(votes, posterior): the model's verdict on every pattern of votes that occurs, as a small table."""
    seen = counted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    patterns = [r["votes"] for r in seen]
    model = fit_votes(patterns, [r["n"] for r in seen])
    table = list(zip(patterns, model.posterior(patterns).tolist(), strict=True))
    return counted.sparkSession.createDataFrame(table, "votes string, posterior double")


def failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(
    docs: DataFrame,
    keep_at: float = 0.5,
    rules: tuple[Rule, ...] = RULES,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Counts, votes and verdict for every row's whole text.

    (key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior,
    votes). ``base_failed``: fewer than 50 words, or more than half of them in repeated 3-word windows;
    such texts are never kept. Others are kept from a posterior of ``keep_at``. A null or empty text has
    no words and fails. Equal texts get equal verdicts, a null key stays null, other columns are not read,
    an empty table gives an empty one.

    The text is read once; the counts are written to the shared folder, because the estimate needs all of
    them before the first verdict. The posteriors travel as a table of at most 3^rules patterns.
    """
    counted = materialize(counted_votes(docs, [key], rules, text), "quality-counts")
    return (
        counted.join(F.broadcast(posteriors(counted)), "votes")
        .withColumn("base_failed", failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at))
        .select(
            key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "kept", "posterior", "votes",
        )
    )


def kept_rows(
    docs: DataFrame, keep_at: float = 0.5, rules: tuple[Rule, ...] = RULES, text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep (see quality_rules)."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    counts = text_column(renamed, names[docs.columns.index(text)], features.count_texts, T.StructType(features.FIELDS))
    counted = renamed.withColumn("_counts", counts).select(*names, "_counts.*")
    # Texts are counted once: the estimate needs all votes before the first verdict.
    voted = materialize(counted.select(*names, failed().alias("_failed"), pattern(rules).alias("votes")), "quality-votes")
    good = voted.where("NOT _failed").join(F.broadcast(posteriors(voted)), "votes").where(F.col("posterior") >= keep_at)
    return good.select(*names).toDF(*docs.columns)
