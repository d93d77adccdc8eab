"""Language-model scores by a weighted backoff automaton.

States are contexts: every word of the training texts, and the start of a text. A state has an arc for
each word that follows it at least twice, weighted with the smoothed probability of that pair, and a failure
arc to the root, weighted with the probability mass left over; the root has an arc for any word. A text is
traversed once from left to right: each word takes the arc of the current state or fails to the root, adds
its log probability and leads to its own state.

Texts are cut into words once, into blocks of many documents with a vocabulary of their own. Counts of
words and pairs are exact and unbounded: vocabularies are summed by word and joined back block by block. The
distinct pairs of a block go out as packed arrays, one per bucket of pairs, and each bucket answers every
array with the counts over the whole corpus in the same order; so a block has the arcs that it holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from labelloom.llm.common import _slices, held_out, reachable
from labelloom.llm.id_files import decode_ranks, encode_ranks
from labelloom.llm.shingles import mixed
from labelloom.operators.scale import materialize

HELD_OUT_FOLDS = 10
# Added to every word's count, one unknown word included.
SMOOTH = 0.1
# A pair is an arc if it occurs so often in the training texts, at any size of the corpus.
MIN_COUNT = 2
# Taken from the count of every arc and left to the root.
DISCOUNT = 0.5
BLOCK_TOKENS = 2_000_000
# Tokens of the corpus for each bucket of pairs, words for each part that numbers them, and tokens whose arcs
# are looked up at once.
BUCKET_TOKENS = 500_000
LOOKUP_TOKENS = 1 << 18
PART_WORDS = 50_000


def word_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of documents as word numbers: (block, keys, trains, lengths, control, data, words).

    A number per word, and number 0, the end, after each document, are packed in ``control`` and ``data`` (see
    ``id_files.encode_ranks``); ``words`` holds the block's words from number 1 on, parted by blanks.
    """
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("keys", T.ArrayType(docs.schema[key].dataType)),
            T.StructField("trains", T.ArrayType(T.BooleanType())),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("control", T.BinaryType()),
            T.StructField("data", T.BinaryType()),
            T.StructField("words", T.BinaryType()),
        ]
    )

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        number = TaskContext.get().partitionId() << 32

        def block(number, keys, trains, parts, words):
            lengths = [len(p) for p in parts]
            values = [number, keys, trains, lengths, *encode_ranks(np.concatenate(parts)), b" ".join(words)]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], type=f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow
            )

        keys, trains, parts, words, held = [], [], [], {}, 0
        end = np.zeros(1, dtype="<u4")
        for batch in batches:
            for part in _slices(batch, "_text"):
                columns = (part.column(c).to_pylist() for c in (key, "_train", "_text"))
                for row_key, train, row_text in zip(*columns, strict=True):
                    found = row_text.encode().lower().split() if row_text else []
                    ids = np.fromiter((words.setdefault(w, len(words) + 1) for w in found), dtype="<u4", count=len(found))
                    keys.append(row_key)
                    trains.append(train)
                    parts.append(np.concatenate([ids, end]))
                    held += len(found) + 1
                    if held >= BLOCK_TOKENS:
                        yield block(number, keys, trains, parts, words)
                        number += 1
                        keys, trains, parts, words, held = [], [], [], {}, 0
        if keys:
            yield block(number, keys, trains, parts, words)

    rows = docs.select(
        key, (~held_out(F.col(key), HELD_OUT_FOLDS)).alias("_train"), F.col(text).cast("string").alias("_text")
    )
    return rows.mapInArrow(run, schema)


def _unpacked(trains, lengths, control, data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, whether each belongs to a training text, ends of the texts) of a block."""
    lengths = np.asarray(lengths, dtype=np.int64)
    ids = decode_ranks(control, data, int(lengths.sum())).astype(np.int64)
    return ids, np.repeat(np.asarray(trains, dtype=bool), lengths), np.cumsum(lengths)


def vocabularies(blocks: DataFrame) -> DataFrame:
    """(block, number, word, count): the words of every block and their training count there; end is ''."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                number, *packed, words = (batch.column(j)[i].as_py() for j in range(6))
                ids, train, _ = _unpacked(*packed)
                names = [b"", *words.split()]
                counts = np.bincount(ids[train], minlength=len(names))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(names), number)), pa.array(np.arange(len(names), dtype=np.int32)),
                        pa.array(names, type=pa.binary()).cast(pa.string()), pa.array(counts),
                    ],
                    names=["block", "number", "word", "count"],
                )

    chosen = blocks.select("block", "trains", "lengths", "control", "data", "words")
    return chosen.mapInArrow(run, "block long, number int, word string, count long")


def numbered(totals: DataFrame) -> DataFrame:
    """``totals`` (word, count) with ``id``: a number of its own from 1 on for every word that occurs MIN_COUNT times.

    Words are dealt over parts and ranked there, frequent ones first; a number names part and rank, and
    stays below 2^32 for about four billion words.
    """
    parts = max(int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions")), totals.count() // PART_WORDS)
    part = F.pmod(F.xxhash64("word"), F.lit(parts))
    often = totals.where(F.col("count") >= MIN_COUNT).withColumn("_part", part)
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("count"), "word"))
    ids = often.select("word", "count", ((rank - 1) * parts + F.col("_part") + 1).alias("id"))
    rare = totals.where(F.col("count") < MIN_COUNT).select("word", "count", F.lit(None).cast("long").alias("id"))
    return ids.unionByName(rare)


def block_pairs(ids: np.ndarray, train: np.ndarray, ends: np.ndarray, number: np.ndarray, buckets: int):
    """The distinct pairs of a block whose words both have a number (0: none), in the order in which they travel.

    (bucket, first, second, training count in the block, pair): ``first`` is 0 for the start of a text, ``pair``
    is made of the block's own numbers, as in ``Automaton``.
    """
    size = len(number) + 1
    known = np.append(number > 0, True)
    before = _contexts(ids, ends, size)
    use = known[before] & known[ids]
    # Sorted in place with the training mark as the lowest bit; a block is large.
    codes = before[use]
    codes *= size
    codes += ids[use]
    codes <<= 1
    codes += train[use]
    codes.sort()
    starts = np.flatnonzero(np.diff(codes >> 1, prepend=-1))
    pairs = codes[starts] >> 1
    counts = np.add.reduceat(codes & 1, starts) if len(starts) else codes
    del codes, before, use
    first, second = np.append(number, 0)[pairs // size], number[pairs % size]
    key = first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
    bucket = (mixed(key) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((key, bucket))
    return bucket[order], first[order], second[order], counts[order], pairs[order]


def _contexts(ids: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The state in front of each token; the last state is the start of a text."""
    before = np.concatenate([[size - 1], ids[:-1]])
    before[ends[:-1]] = size - 1
    return before


def _numbers(right, column: str, size: int) -> np.ndarray:
    """A column of the rows of a block's words as an array by the word's number in the block; 0 where it is null."""
    out = np.zeros(size, dtype=np.int64)
    out[right.column("number").to_numpy()] = right.column(column).fill_null(0).to_numpy()
    return out


def packed_pairs(blocks: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, n, then first, second and count as two columns each) of every block's pairs.

    ``words`` is (block, number, total, id). Columns ending in _c and _d are ``encode_ranks`` of the steps from one
    first word to the next, of the second words, and of the training counts in the block.
    """

    def pack(left, right):
        import pyarrow as pa

        rows = []
        for i in range(left.num_rows):
            number, trains, lengths, control, data = (
                left.column(c)[i].as_py() for c in ("block", "trains", "lengths", "control", "data")
            )
            ids, train, ends = _unpacked(trains, lengths, control, data)
            bucket, first, second, counts, _ = block_pairs(ids, train, ends, _numbers(right, "id", right.num_rows), buckets)
            used, starts = np.unique(bucket, return_index=True)
            for b, x, y in zip(used.tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
                steps = np.diff(first[x:y], prepend=0)
                rows.append((b, number, y - x, *encode_ranks(steps), *encode_ranks(second[x:y]), *encode_ranks(counts[x:y])))
        columns = list(zip(*rows, strict=True)) or [()] * 9
        types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
        return pa.table([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

    names = ["bucket", "block", "n", "first_c", "first_d", "second_c", "second_d", "count_c", "count_d"]
    schema = "bucket int, block long, n int, " + ", ".join(f"{c} binary" for c in names[3:])
    left = blocks.select("block", "trains", "lengths", "control", "data").groupBy("block")
    return left.cogroup(words.select("block", "number", "id").groupBy("block")).applyInArrow(pack, schema)


def summed_pairs(packed: DataFrame) -> DataFrame:
    """What the blocks of each bucket get back: (bucket, block, n, control, data, contexts, taken).

    A row with a block holds the training counts over the whole corpus of the pairs that the block sent, in
    their order (see ``encode_ranks``; without control bytes as 64-bit numbers). A row without holds the bucket's contexts and what their arcs take from them.
    """

    def add(table):
        import pyarrow as pa

        sizes = table.column("n").to_pylist()
        parts = [[], [], []]
        for k, column in enumerate(("first", "second", "count")):
            controls, datas = (table.column(f"{column}_{x}").to_pylist() for x in "cd")
            for n, control, data in zip(sizes, controls, datas, strict=True):
                values = decode_ranks(control, data, n).astype(np.uint64)
                parts[k].append(np.cumsum(values) if column == "first" else values)
        first, second, count = (np.concatenate(p) for p in parts)
        key, place = np.unique(first << np.uint64(32) | second, return_inverse=True)
        total = np.bincount(place, count, len(key)).astype(np.int64)
        cuts = np.cumsum([0, *sizes])
        # Counts of more than four bytes go out as they are.
        pack = encode_ranks if total.max(initial=0) < 1 << 32 else lambda x: (None, x.tobytes())
        back = [pack(total[place[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        arcs = total >= MIN_COUNT
        contexts, at = np.unique((key >> np.uint64(32))[arcs].astype(np.int64), return_inverse=True)
        taken = np.bincount(at, total[arcs] - DISCOUNT, len(contexts))
        bucket, one = table.column("bucket")[0].as_py(), len(sizes)
        return pa.table(
            {
                "bucket": pa.array([bucket] * (one + 1), type=pa.int32()),
                "block": pa.array([*table.column("block").to_pylist(), None], type=pa.int64()),
                "n": pa.array([*sizes, len(contexts)], type=pa.int32()),
                "control": pa.array([*[c for c, _ in back], None], type=pa.binary()),
                "data": pa.array([*[d for _, d in back], None], type=pa.binary()),
                "contexts": pa.array([*[None] * one, contexts.tobytes()], type=pa.binary()),
                "taken": pa.array([*[None] * one, taken.tobytes()], type=pa.binary()),
            }
        )

    schema = "bucket int, block long, n int, control binary, data binary, contexts binary, taken binary"
    return packed.groupBy("bucket").applyInArrow(add, schema)


def _counts(control: bytes | None, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.int64) if control is None else decode_ranks(control, data, n).astype(np.int64)


def context_shares(summed: DataFrame) -> DataFrame:
    """(id, taken) of every context with an arc: what all its arcs take from its count."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            contexts, taken = (b"".join(batch.column(k).to_pylist()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(contexts, np.int64)), pa.array(np.frombuffer(taken, np.float64))], names=["id", "taken"]
            )

    rows = summed.where("block IS NULL").select("contexts", "taken").mapInArrow(run, "id long, taken double")
    return rows.groupBy("id").agg(F.sum("taken").alias("taken"))


@dataclass
class Automaton:
    """Failure weight per state, the start of a text behind the others, arcs as sorted pairs with their weights (all log10)."""

    fail: np.ndarray
    pairs: np.ndarray
    weights: np.ndarray

    def traverse(self, states: np.ndarray, root: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probability of each token, from its own state (-1: none) and its weight at the root."""
        size = len(self.fail)
        before = _contexts(states, ends, size)
        out = root + np.where(before >= 0, self.fail[before], 0.0)
        # Runs of tokens, so that what is looked up stays small next to the block.
        for a in range(0, len(states) if len(self.pairs) else 0, LOOKUP_TOKENS):
            first, second = before[a : a + LOOKUP_TOKENS], states[a : a + LOOKUP_TOKENS]
            pair = np.where((first >= 0) & (second >= 0), first * size + second, -1)
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            hit = np.flatnonzero(self.pairs[at] == pair)
            out[a + hit] = self.weights[at[hit]]
        return out


def weighted(count: np.ndarray, follow: np.ndarray, arcs: np.ndarray, total: int, known: int, taken: np.ndarray) -> Automaton:
    """Absolute discounting, interpolated with the root's probabilities.

    By state, the start of a text last: ``count``, the number of tokens that ``follow`` it, and what all its arcs
    have ``taken`` from that, those that are not among ``arcs`` (pair, count) included.
    """
    size = len(count)
    arcs = arcs[np.argsort(arcs[:, 0])]
    pairs, kept = arcs[:, 0], arcs[:, 1] - DISCOUNT
    first, second = pairs // size, pairs % size
    left = 1 - taken / np.maximum(follow, 1)
    root = (count + SMOOTH) / (total + SMOOTH * (known + 1))
    weights = np.log10(kept / np.maximum(follow[first], 1) + left[first] * root[second])
    fail = np.where(follow > 0, np.log10(np.maximum(left, 1e-300)), 0.0)
    return Automaton(fail, pairs, weights)


def build_automaton(
    words: list[tuple[bytes, int]], texts: int, arcs: list[tuple[int, int]], total: int, known: int
) -> Automaton:
    """The automaton of a whole corpus that fits one machine.

    ``words`` are the states and their counts, which are also the numbers of tokens that follow them
    (0 for the end); ``texts`` is the number of training texts, ``arcs`` the pairs and their counts.
    """
    count = np.array([c for _, c in words] + [0], dtype=float)
    follow = np.array([0 if w == b"" else c for w, c in words] + [texts], dtype=float)
    table = np.array(arcs, dtype=np.int64).reshape(-1, 2)
    taken = np.bincount(table[:, 0] // len(count), table[:, 1] - DISCOUNT, len(count))
    return weighted(count, follow, table, total, known, taken)


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row's whole text.

    Tokens are the words (runs of characters other than space and \\t to \\r, A-Z lower-cased) and one end; a
    null or empty text is the end alone. Training texts are those whose id's crc32 mod 10 is not 0 (a null
    id trains). ``base_score`` sums log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens; ``score`` is the log10
    probability that the automaton gives the text, and sums to one over all words after any context: a pair
    that training texts hold c >= 2 times after a word they hold n times weighs (c - 0.5) / n, and what is left
    of the context goes to the root.
    Equal texts get equal scores, repeated rows count each time, other columns are not read, an empty
    table gives no rows; without training texts every token has probability 1 of being unknown.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    reachable(docs.sparkSession)
    blocks = materialize(word_blocks(docs, key, text), "word-blocks")
    words = vocabularies(blocks)
    totals = materialize(words.groupBy("word").agg(F.sum("count").alias("count")), "word-counts")
    whole = totals.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"),
        F.count(F.when(F.col("count") > 0, 1)).alias("words"),
        F.coalesce(F.max(F.when(F.col("word") == "", F.col("count"))), F.lit(0)).alias("texts"),
    ).first()
    total, known, texts = whole["tokens"], whole["words"], whole["texts"]
    tokens = blocks.agg(F.coalesce(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tokens // BUCKET_TOKENS)
    ids = materialize(numbered(totals), "word-numbers").withColumnRenamed("count", "total")
    if (ids.agg(F.max("id")).first()[0] or 0) >= 1 << 32:
        raise ValueError("more than four billion words occur twice")
    per_block = materialize(words.join(ids, "word").select("block", "number", "total", "id"), "block-words")
    summed = materialize(summed_pairs(packed_pairs(blocks, per_block, buckets)), "pair-counts")
    shares = materialize(context_shares(summed), "context-shares")
    start = shares.where("id = 0").first()
    start_taken = start["taken"] if start else 0.0
    of_words = per_block.join(shares, "id", "left").select("block", "number", "total", "id", "taken")
    of_pairs = summed.where("block IS NOT NULL").select("block", "bucket", "n", "control", "data")
    known_rows = of_words.unionByName(of_pairs, allowMissingColumns=True)
    schema = T.StructType(
        [
            docs.schema[key],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def score(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        arrow = to_arrow_schema(schema)
        out = []
        counted = right.filter(pc.is_valid(right.column("bucket"))).sort_by("bucket")
        right = right.filter(pc.is_valid(right.column("number")))
        for i in range(left.num_rows):
            keys = left.column("keys")[i].values
            trains, lengths, control, data, names = (
                left.column(c)[i].as_py() for c in ("trains", "lengths", "control", "data", "words")
            )
            ids, train, ends = _unpacked(trains, lengths, control, data)
            # Blanks part the words; the end is number 0.
            size = names.count(b" ") + 2 if names else 1
            count = _numbers(right, "total", size)
            taken = np.zeros(size + 1)
            taken[right.column("number").to_numpy()] = right.column("taken").fill_null(0.0).to_numpy()
            taken[size] = start_taken
            pairs = block_pairs(ids, train, ends, _numbers(right, "id", size), buckets)[-1]
            found = zip(*(counted.column(c).to_pylist() for c in ("control", "data", "n")), strict=True)
            sums = np.concatenate([np.zeros(0, dtype=np.int64), *(_counts(*f) for f in found)])
            arcs = np.stack([pairs, sums], axis=1)[sums >= MIN_COUNT]
            follow = np.append(count, texts).astype(float)
            follow[0] = 0
            automaton = weighted(np.append(count, 0).astype(float), follow, arcs, total, known, taken)
            del pairs, sums, arcs
            root = np.log10((count + SMOOTH) / (total + SMOOTH * (known + 1)))[ids]
            starts = ends - np.asarray(lengths)
            n_known = np.add.reduceat((count > 0)[ids].astype(np.int64), starts)
            scores = np.add.reduceat(automaton.traverse(ids, root, ends), starts)
            values = [keys, pa.array(lengths, type=pa.int64()), pa.array(n_known), pa.array(np.add.reduceat(root, starts)), pa.array(scores)]
            out.append(pa.Table.from_arrays([pa.array(v) if isinstance(v, list) else v for v in values], schema=arrow))
        return pa.concat_tables(out) if out else arrow.empty_table()

    left = blocks.groupBy("block")
    scored = left.cogroup(known_rows.groupBy("block")).applyInArrow(score, schema)
    return scored.select(
        key,
        held_out(F.col(key), HELD_OUT_FOLDS).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
