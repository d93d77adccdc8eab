"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch are held as one array of symbols with a sequence number for each. In every round
each sequence applies its own lowest-rank pair, all sequences at once; what survives is counted. The
merge file ranks pairs so that a pair made from a new symbol always ranks behind the merge that made it,
so merging all places of the lowest pair at once gives what one-by-one merging gives.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from labelloom.llm import chunks
from labelloom.llm.common import map_texts

# The pre-token pattern of the byte-level vocabulary, for ASCII chunks.
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Ranked symbol pairs of a vocabulary file, looked up for whole arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.rank, self.made = keys, first, made[first]
        # A first table of bits answers most pairs that have no rank.
        self.bits = 22
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[self._slot(keys)] = True
        self.byte_id = np.array([vocab[c] for _, c in sorted(byte_symbols().items())], dtype=np.int64)
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.byte_of = {c: b for b, c in byte_symbols().items()}
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.none = len(merges)
        self.table = chunks.ChunkTable(self.chunk_counts)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``none`` without one) and its place in the merge table."""
        keys = left * self.size + right
        rank = np.full(len(keys), self.none, dtype=np.int64)
        place = np.zeros(len(keys), dtype=np.int64)
        maybe = np.flatnonzero(self.seen[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == keys[maybe]
        rank[maybe[hit]], place[maybe[hit]] = self.rank[at[hit]], at[hit]
        return rank, place

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each byte string after all merges."""
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        out = np.minimum(lengths, 1)
        symbols = self.byte_id[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        live = lengths[owner] > 1
        symbols, owner = symbols[live], owner[live]
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            rank = np.full(len(symbols), self.none, dtype=np.int64)
            place = np.zeros(len(symbols), dtype=np.int64)
            rank[:-1], place[:-1] = self.pair_ranks(symbols[:-1], symbols[1:])
            last = starts + sizes - 1
            rank[last] = self.none
            best = np.minimum.reduceat(rank, starts)
            done = best == self.none
            out[owner[starts[done]]] = sizes[done]
            best_here = np.repeat(best, sizes)
            apply = (rank == best_here) & (best_here < self.none)
            # In a run of overlapping places (x x x) every other one is merged, from the left.
            at = np.flatnonzero(apply)
            if len(at):
                run = np.cumsum(np.r_[True, (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])])
                run_first = at[np.r_[True, run[1:] != run[:-1]]]
                at = at[(at - run_first[run - 1]) % 2 == 0]
            keep = np.repeat(~done, sizes)
            symbols = symbols.copy()
            symbols[at] = self.made[place[at]]
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def pre_tokens(self, chunk: str) -> list[bytes]:
        text = chunks.spaced_text(chunk)
        if text.isascii():
            return [p.encode() for p in ASCII_PATTERN.findall(text)]
        byte_of = self.byte_of
        return [bytes([byte_of[c] for c in p]) for p, _ in self.pre.pre_tokenize_str(text)]

    def chunk_counts(self, fresh: list[str]) -> list[int]:
        """Tokens of each chunk; a special string is one token."""
        parts = [None if c in self.specials else self.pre_tokens(c) for c in fresh]
        names: dict[bytes, int] = {}
        index = [names.setdefault(t, len(names)) for p in parts if p for t in p]
        counts = self.count(list(names))[index] if index else np.zeros(0, dtype=np.int64)
        sizes = np.array([len(p) if p else 0 for p in parts], dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        stops = np.cumsum(sizes)
        totals = ends[stops] - ends[stops - sizes]
        return [1 if p is None else int(n) for p, n in zip(parts, totals, strict=True)]

    def __call__(self, texts: list) -> dict:
        lists = chunks.split_special(texts, self.specials, chunks.spaced_chunks)
        return {
            "n_bytes": [len(t.encode()) if t else 0 for t in texts],
            "n_tokens": [sum(v) for v in self.table.values_of(lists)],
        }


_tables: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    """One merge table per Python worker, kept from task to task."""
    if path not in _tables:
        _tables[path] = Merges(path)
    return _tables[path]


def token_counts(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row's whole text under a byte-level merge file.

    Null and empty texts have no bytes and no tokens. Equal rows give equal rows; a null key stays null;
    other columns are not read. Special strings of the file inside a text count as one token. An empty
    table gives an empty table. One pass without a shuffle; a worker holds one slice of texts and a
    bounded table of chunks.
    """
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    counted = map_texts(docs, text, [key], lambda: merges(path), fields)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
