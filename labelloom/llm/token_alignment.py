"""Tokens of two tokenizers linked where they cover the same bytes.

Each text is tokenised whole by a byte-level vocabulary (A) and a piece model (B). Where tokens of both end
at one byte and the next ones both carry the mark of a space, the text is cut into windows: a tuple of A ids
beside a tuple of B ids that cover the same bytes. Few windows are new: what a window's ids link is worked out once
and kept under its ids. How many documents hold a pair linked is counted over the corpus.

Texts are met as units, in which no token of either tokenizer can cross the border: a blank or newline with the
word behind it, or a whole text where white space is of another kind. A unit is tokenised once as well.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from labelloom.llm import ragged
from labelloom.llm.common import _slices, bounded_batches, map_arrays, reachable
from labelloom.llm.id_files import decode_ranks, encode_ranks
from labelloom.llm.ragged import Ragged, WordTable
from labelloom.llm.token_counts import byte_symbols
from labelloom.operators.scale import lookup_join, materialize

SPACE = "▁"
# Units that are tokenised in one call.
JOINED = 256
# Windows that a worker keeps.
MEMO_WINDOWS = 250_000
UNEVEN = f"{ragged.UNEVEN}|{SPACE}"


class ByteVocabulary:
    """Tokenizer A: ids of texts with special strings as plain text, and the bytes of its tokens."""

    def __init__(self, path: str):
        # A task has one core; the library's own threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of = {c: b for b, c in byte_symbols().items()}
        self.labels = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            if all(c in byte_of for c in token):
                self.labels[i] = bytes(map(byte_of.__getitem__, token))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, each of which starts with white space."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]


class PieceModel:
    """Tokenizer B: ids of texts whose first blank is the one that the library adds, and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.labels = [self._label(i) for i in range(self.model.get_piece_size())]

    def _label(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(SPACE, " ").encode()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, each of which starts with white space."""
        plain = [t[0] == " " for t in texts]
        # A word in front takes the added blank where the text does not start with one.
        found = self.model.encode([t[1:] if p else "a" + t for t, p in zip(texts, plain, strict=True)], num_threads=1)
        return [np.array(x if p else x[1:], dtype=np.uint32) for x, p in zip(found, plain, strict=True)]


class Side:
    """One tokenizer with the sizes, marks and names of its ids."""

    def __init__(self, tokenizer: ByteVocabulary | PieceModel):
        self.tokenizer = tokenizer
        self.size = np.array([len(x) for x in tokenizer.labels], dtype=np.int64)
        self.spaced = np.array([x[:1] == b" " for x in tokenizer.labels])

    def units(self, texts: list[str]) -> tuple[Ragged, np.ndarray]:
        """Ids of each unit, and whether their bytes are the unit's."""
        sizes = [len(t.encode()) for t in texts]
        parts, good, counts = [], np.ones(len(texts), dtype=bool), np.zeros(len(texts), dtype=np.int64)
        starts = range(0, len(texts), JOINED)
        for a, ids in zip(starts, self.tokenizer.ids(["".join(texts[a : a + JOINED]) for a in starts]), strict=True):
            part = texts[a : a + JOINED]
            if b"".join(map(self.tokenizer.labels.__getitem__, ids.tolist())) == "".join(part).encode():
                ends = np.cumsum(self.size[ids])
                cuts = np.searchsorted(ends, np.cumsum(sizes[a : a + JOINED])) + 1
                counts[a : a + JOINED] = np.diff(cuts, prepend=0)
                parts.append(ids)
                continue
            for i, t in enumerate(part, a):
                own = self.tokenizer.ids([t])[0]
                good[i] = b"".join(map(self.tokenizer.labels.__getitem__, own.tolist())) == t.encode()
                counts[i] = len(own)
                parts.append(own)
        values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        return Ragged.of_sizes(counts, values), good


class Aligner:
    """Windows of units, kept by their ids; window 0 stands for a unit whose bytes are not its tokens'."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Side(ByteVocabulary(path_a)), Side(PieceModel(path_b))
        self.numbers = [str(i) for i in range(max(len(self.a.size), len(self.b.size)))]
        self.clear()

    def clear(self) -> None:
        self.memo: dict[tuple[bytes, bytes], int] = {}
        self.texts = [""]
        self.counts = np.zeros((1, 4), dtype=np.int64)
        # The links of each window as numbers of id pairs.
        self.links = Ragged.of_sizes(np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64))
        self.pair_number: dict[int, int] = {}
        self.pairs = np.zeros(0, dtype=np.int64)
        self.units = WordTable(lambda words: self.unit_windows([ragged.chunks.spaced_text(w) for w in words]), dtype=np.int64)

    def unit_windows(self, units: list[str]) -> Ragged:
        """The windows of each unit."""
        (a, good_a), (b, good_b) = self.a.units(units), self.b.units(units)
        good = good_a & good_b
        if not good.all():
            keep = np.flatnonzero(good)
            found = self._windows(a.take(keep), b.take(keep))
            sizes = np.ones(len(units), dtype=np.int64)
            sizes[keep] = found.sizes
            out = Ragged.of_sizes(sizes, np.zeros(int(sizes.sum()), dtype=np.int64))
            out.values[np.repeat(good, sizes)] = found.values
            return out
        return self._windows(a, b)

    def _windows(self, a: Ragged, b: Ragged) -> Ragged:
        ends_a, ends_b = np.cumsum(self.a.size[a.values]), np.cumsum(self.b.size[b.values])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        # Groups of tokens between shared ends; the tokens that each group starts with.
        to_a, to_b = np.searchsorted(ends_a, shared) + 1, np.searchsorted(ends_b, shared) + 1
        from_a, from_b = (np.concatenate([[0], x])[:-1] for x in (to_a, to_b))
        unit_first = np.searchsorted(to_a, a.offsets[:-1], side="right")
        cut = self.a.spaced[a.values[from_a]] & self.b.spaced[b.values[from_b]]
        cut[unit_first] = True
        first = np.flatnonzero(cut)
        last = np.concatenate([first[1:], [len(shared)]])[: len(first)]
        sizes = np.diff(np.concatenate([np.searchsorted(first, unit_first), [len(first)]]))
        bytes_a, bytes_b = a.values.tobytes(), b.values.tobytes()
        tokens = [(4 * x).tolist() for x in (from_a[first], to_a[last - 1], from_b[first], to_b[last - 1])]
        numbers, new = [], []
        for i, (w, x, y, z) in enumerate(zip(*tokens, strict=True)):
            key = bytes_a[w:x], bytes_b[y:z]
            number = self.memo.get(key)
            if number is None:
                number = self.memo[key] = len(self.texts) + len(new)
                new.append(i)
            numbers.append(number)
        if new:
            self._align(a.values, b.values, (from_a, to_a, from_b, to_b), first[new], last[new])
        return Ragged.of_sizes(sizes, np.array(numbers, dtype=np.int64))

    def _align(self, a: np.ndarray, b: np.ndarray, groups: tuple, first: np.ndarray, last: np.ndarray) -> None:
        """Add windows, given as ranges of groups."""
        every = np.arange(len(groups[0]))
        spans = Ragged(np.stack([first, last], axis=1).ravel(), every).take(2 * np.arange(len(first)))
        from_a, to_a, from_b, to_b = (x[spans.values] for x in groups)
        n_a, n_b = to_a - from_a, to_b - from_b
        links = Ragged.of_sizes(n_a * n_b, np.zeros(0, dtype=np.int64))
        place = np.arange(links.offsets[-1]) - np.repeat(links.offsets[:-1], links.sizes)
        width = np.repeat(n_b, links.sizes)
        left = a[np.repeat(from_a, links.sizes) + place // width].astype(np.int64)
        right = b[np.repeat(from_b, links.sizes) + place % width].astype(np.int64)
        totals = [np.concatenate([[0], np.cumsum(x)])[spans.offsets] for x in (n_a, n_b, n_a * n_b)]
        self.counts = np.concatenate([self.counts, np.stack([*(np.diff(t) for t in totals[:2]), spans.sizes, np.diff(totals[2])], axis=1)])
        used, place = np.unique(left << 32 | right, return_inverse=True)
        numbers = [self.pair_number.setdefault(p, len(self.pair_number)) for p in used.tolist()]
        if len(self.pair_number) > len(self.pairs):
            self.pairs = np.fromiter(self.pair_number, dtype=np.int64, count=len(self.pair_number))
        self.links = self.links.join(Ragged(totals[2], np.array(numbers, dtype=np.int64)[place]))
        names_a, names_b = (list(map(self.numbers.__getitem__, x.tolist())) for x in (a, b))
        written = [
            names_a[w] + "|" + names_b[y] if x - w == z - y == 1 else ",".join(names_a[w:x]) + "|" + ",".join(names_b[y:z])
            for w, x, y, z in zip(from_a.tolist(), to_a.tolist(), from_b.tolist(), to_b.tolist(), strict=True)
        ]
        self.texts += [";".join(written[x:y]) for x, y in pairwise(spans.offsets.tolist())]

    def windows(self, texts) -> Ragged:
        """The windows of each text of an Arrow array; none for texts without tokens."""
        import pyarrow.compute as pc

        if len(self.texts) > MEMO_WINDOWS:
            self.clear()
        texts = ragged.strings(texts)
        uneven = pc.or_(pc.match_substring_regex(texts, UNEVEN), pc.equal(texts, ""))
        even, places, rest = ragged.split_off(texts, uneven)
        words, numbers = ragged.numbered(pc.split_pattern(pc.replace_substring(even, "\n", " \0"), " "), places, [[] for _ in rest])
        found = self.units(words).rows_of(numbers)
        # Whole texts where no units are cut, and where a unit's tokens are not its bytes.
        bad = np.unique(np.searchsorted(found.offsets, np.flatnonzero(found.values == 0), side="right") - 1)
        whole = [i for i in sorted({*places.tolist(), *bad.tolist()}) if texts[i].as_py()]
        if not whole:
            return found
        own = [self.unit_windows([" " + texts[i].as_py()]) for i in whole]
        sizes = found.sizes
        kept = np.ones(len(found.values), dtype=bool)
        for i, x in zip(whole, own, strict=True):
            kept[found.offsets[i] : found.offsets[i + 1]] = False
            sizes[i] = 0 if (x.values == 0).any() else len(x.values)
        out = Ragged.of_sizes(sizes, np.zeros(int(sizes.sum()), dtype=np.int64))
        filled = np.ones(len(out.values), dtype=bool)
        for i, x in zip(whole, own, strict=True):
            if sizes[i]:
                out.values[out.offsets[i] : out.offsets[i + 1]] = x.values
                filled[out.offsets[i] : out.offsets[i + 1]] = False
        out.values[filled] = found.values[kept]
        return out

    def groups(self, texts) -> dict:
        """Each text's groups of ids as one string."""
        return {"groups": self._joined(self.windows(texts))}

    def block(self, texts) -> dict:
        """What a block of texts holds: see ``aligned_blocks``."""
        windows = self.windows(texts)
        totals = np.concatenate([np.zeros((1, 4), dtype=np.int64), np.cumsum(self.counts[windows.values], axis=0)])
        counts = np.diff(totals[windows.offsets], axis=0)
        digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in self._joined(windows)]
        links = self.links.rows_of(windows)
        key = np.repeat(np.arange(len(links)), links.sizes) * max(1, len(self.pairs)) + links.values
        key, times = np.unique(key, return_counts=True)
        doc, pair = np.divmod(key, max(1, len(self.pairs)))
        holding = np.bincount(pair, minlength=len(self.pairs))
        used = np.argsort(-holding, kind="stable")[: np.count_nonzero(holding)]
        rank = np.zeros(len(self.pairs), dtype=np.int64)
        rank[used] = np.arange(len(used))
        places, repeats = encode_ranks(rank[pair]), encode_ranks(times)
        return {
            **{n: counts[:, i] for i, n in enumerate(COUNTS)}, "groups_sha256": digests,
            "sizes": np.bincount(doc, minlength=len(links)),
            "pairs": self.pairs[used], "docs_with": holding[used],
            "places_c": places[0], "places_d": places[1], "repeats_c": repeats[0], "repeats_d": repeats[1],
        }

    def _joined(self, windows: Ragged) -> list[str]:
        flat = list(map(self.texts.__getitem__, windows.values.tolist()))
        return [";".join(flat[a:b]) for a, b in pairwise(windows.offsets.tolist())]


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
PER_BLOCK = ["places_c", "places_d", "repeats_c", "repeats_d"]

_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per Python worker, kept from task to task."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, groups): the id groups of every row's whole text as ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
    return map_arrays(docs, text, [key], lambda: aligner(path_a, path_b).groups, [T.StructField("groups", T.StringType())])


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, key: str, text: str) -> DataFrame:
    """A row per block of texts, written once.

    Per text: its key, counts, digest, and the number of its distinct id pairs (``sizes``). Per block: its
    distinct pairs (A id << 32 | B id), commonest first, in how many texts each is linked, and for all texts
    in a row the places of their pairs among these and how often each is linked (``encode_ranks``).
    """
    reachable(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    arrays = {"keys": kind, **{c: T.LongType() for c in COUNTS}, "groups_sha256": T.StringType(), "sizes": T.IntegerType()}
    arrays |= {"pairs": T.LongType(), "docs_with": T.LongType()}
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            *(T.StructField(n, T.ArrayType(t)) for n, t in arrays.items()),
            *(T.StructField(n, T.BinaryType()) for n in PER_BLOCK),
        ]
    )

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        align, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _slices(batch, "_text"):
                found = align.block(part.column("_text"))
                row = {"block": number, "keys": part.column(0).to_pylist(), **found}
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], type=f.type) for f in arrow], schema=arrow)
                number += 1

    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return materialize(rows.mapInArrow(run, schema), "aligned-blocks")


def sent_pairs(blocks: DataFrame) -> DataFrame:
    """(block, place, pair, docs): a block's distinct pairs and the number of its texts that hold each."""
    entries = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "docs_with")).alias("place", "_p"))
    return entries.select("block", "place", F.col("_p.pairs").alias("pair"), F.col("_p.docs_with").alias("docs"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a_id, b_id, n_docs): in how many rows each pair of ids is linked."""
    counts = sent_pairs(aligned_blocks(docs, path_a, path_b, key, text)).groupBy("pair").agg(F.sum("docs").alias("n_docs"))
    return counts.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"), "n_docs")


def alignment_digests(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row's whole text.

    A is a byte-level vocabulary file that gets a space and the text, B a piece model that adds the space
    itself; strings of special tokens are plain text to both. Groups end where tokens of both end; all A and B
    tokens of a group are linked. A pair's count is the number of rows that hold it linked; ``n_best`` are
    the links whose count is the highest of their A id, ``count_sum`` adds the counts over links.

    Rows whose text is null or empty, or whose joined token bytes are not the space and the text, have zeros and
    '' and count for no pair. Equal rows count as rows of their own; a null key stays null; other columns are not
    read; an empty table gives an empty table.

    Texts are tokenised once. A block of texts sends each of its distinct pairs once and gets the counts
    back, so a common pair comes once per block; pairs are bounded by the vocabularies, not by the rows.
    """
    blocks = aligned_blocks(docs, path_a, path_b, key, text)
    sent = sent_pairs(blocks)
    counts = materialize(sent.groupBy("pair").agg(F.sum("docs").alias("n_docs")), "pair-counts")
    a_id = F.shiftright("pair", 32).cast("int")
    highest = counts.groupBy(a_id.alias("_a")).agg(F.max("n_docs").alias("_highest"))
    valued = counts.withColumn("_a", a_id).join(highest, "_a").select("pair", "n_docs", (F.col("n_docs") == F.col("_highest")).alias("best"))
    back = lookup_join(sent.drop("docs"), valued, "pair").groupBy("block").agg(F.collect_list(F.struct("place", "n_docs", "best")).alias("values"))
    joined = blocks.drop("pairs", "docs_with").join(back, "block", "left")
    fields = [T.StructField(n, T.LongType()) for n in (*COUNTS, "n_best", "count_sum")]
    schema = T.StructType([docs.schema[key], *fields, T.StructField("groups_sha256", T.StringType())])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("sizes", "values", *PER_BLOCK)}
                sizes = row["sizes"].values.to_numpy()
                n = int(sizes.sum())
                count, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                if row["values"].is_valid:
                    values = row["values"].values
                    order = np.argsort(values.field("place").to_numpy())
                    count = values.field("n_docs").to_numpy()[order]
                    best = values.field("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
                places, times = (decode_ranks(row[f"{c}_c"].as_py(), row[f"{c}_d"].as_py(), n) for c in ("places", "repeats"))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                sums = [np.diff(np.concatenate([[0], np.cumsum(x[places] * times.astype(np.int64))])[ends]) for x in (best, count)]
                found = dict(zip(("n_best", "count_sum"), sums, strict=True))
                columns = [batch.column("keys")[i].values]
                columns += [pa.array(found[f.name]) if f.name in found else batch.column(f.name)[i].values for f in fields]
                yield pa.RecordBatch.from_arrays([*columns, batch.column("groups_sha256")[i].values], schema=arrow)

    return joined.mapInArrow(run, schema)
