"""Encoding and decoding with a tokenization automaton compiled from the merges of a vocabulary file.

The automaton reads tokens: its arcs are labelled with tokens, each state stands for the token read last,
and of all ways to cut a word into tokens it accepts one, the one the merges give. It is compiled merge by
merge. It starts as one state with an arc for every byte; the gadget of merge u v -> w

1. adds a state w, a copy of state v as it is now;
2. takes the arc v away from state u, as v no longer follows u;
3. adds an arc w, to state w, to every state that still has an arc u.

Arcs are not written out (there are nearly as many as pairs of tokens). A state keeps what its gadgets took
away and the state it was copied from, with the number of the gadget; an arc is looked up by going back
through copies and gadgets to the bytes, and what was found is kept in a table.

Every prefix of a word is accepted along exactly one path as well, so a word is read byte by byte: a table
of transitions over bytes gives the longest arc label that ends there, shorter ones follow, and the one
whose arc exists ends the prefix. Reading the path backwards from the end gives the ids. Decoding joins
the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, types as T

from labelloom.llm import chunks
from labelloom.llm.common import map_arrays
from labelloom.llm.ragged import Ragged, WordTable, spaced_words, strings
from labelloom.llm.token_counts import byte_symbols

# Words up to so many bytes are read together, longer ones one by one.
TOGETHER_BYTES = 64
# Slots of the table of arcs that were looked up.
ARC_SLOTS = 1 << 20
# Pre-tokens of characters below this are cut by a pattern, others by the library's pre-tokenizer.
PATTERN_CHARACTERS = 0x250
ALWAYS = np.int64(1) << 40


def pre_token_pattern() -> re.Pattern:
    """The byte-level pre-tokenizer's pattern for characters below PATTERN_CHARACTERS, white space aside."""

    def among(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(PATTERN_CHARACTERS) if unicodedata.category(chr(c))[0] == kind)

    letters, numbers, white = among("L"), among("N"), chunks.WHITE
    # The contractions and the order of alternatives.
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{white}{letters}{numbers}]+|[{white}]+(?![^{white}])|[{white}]+")


class Automaton:
    """States, gadgets and byte transitions of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        symbols = byte_symbols()
        byte_of = {c: b for b, c in symbols.items()}
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.specials.values()])
        self.labels = [b""] * self.size
        for token, i in vocab.items():
            if token not in self.specials:
                self.labels[i] = bytes(byte_of[c] for c in token)
        for token, i in self.specials.items():
            self.labels[i] = token.encode()
        self._compile(vocab, merges, [vocab[symbols[b]] for b in range(256)])
        self._read_bytes()

    def _compile(self, vocab: dict[str, int], merges: list, byte_ids: list[int]) -> None:
        """Gadget after gadget: the copied state, the number of the gadget, the arc that it takes away."""
        self.left, self.right = (np.zeros(self.size, dtype=np.int64) for _ in range(2))
        self.gadget = np.full(self.size, ALWAYS)
        self.gadget[byte_ids] = -1
        taken: dict[int, int] = {}
        for number, (u, v) in enumerate(merges):
            state, arc, made = vocab[u], vocab[v], vocab[u + v]
            if taken.setdefault(state * self.size + arc, number) != number:
                continue
            if self.gadget[made] != ALWAYS:
                raise ValueError(f"two merges make the token {u + v!r}")
            self.gadget[made], self.left[made], self.right[made] = number, state, arc
        order = sorted(taken)
        self.taken = np.array(order, dtype=np.int64)
        self.taken_by = np.array([taken[k] for k in order], dtype=np.int64)
        self.maybe_taken = np.zeros(ARC_SLOTS, dtype=bool)
        self.maybe_taken[self._slot(self.taken)] = True
        self.known = np.full(ARC_SLOTS, -1, dtype=np.int64)
        self.known_arc = np.zeros(ARC_SLOTS, dtype=bool)
        # A gadget whose state has lost its arc before adds nothing, nor do those built on it.
        made = np.flatnonzero((self.gadget >= 0) & (self.gadget < ALWAYS))
        self.live = self.gadget < ALWAYS
        self.live[made] = self._look_up(self.left[made], self.right[made], self.gadget[made])
        for i in made[np.argsort(self.gadget[made])].tolist():
            self.live[i] &= self.live[self.left[i]] and self.live[self.right[i]]

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - 20)).astype(np.int64)

    def _taken_by(self, state: np.ndarray, arc: np.ndarray) -> np.ndarray:
        """The gadget that took the arc from the state, ALWAYS if none did."""
        keys = state * self.size + arc
        out = np.full(len(keys), ALWAYS)
        maybe = np.flatnonzero(self.maybe_taken[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.taken, keys[maybe]), len(self.taken) - 1)
        hit = self.taken[at] == keys[maybe]
        out[maybe[hit]] = self.taken_by[at[hit]]
        return out

    def _look_up(self, state: np.ndarray, arc: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Whether each state has the arc after the gadgets below ``before``."""
        out = np.ones(len(state), dtype=bool)
        at = np.arange(len(state))
        while len(at):
            gone = self._taken_by(state, arc) < before
            out[at[gone]] = False
            born, made = self.gadget[state], self.gadget[arc]
            more = ~gone & ((born >= 0) | (made >= 0))
            at, state, arc, born, made = at[more], state[more], arc[more], born[more], made[more]
            # The younger of the two goes back: a state to the copied one as it was before its gadget, an arc to
            # the arc in whose place it came, as it was after its gadget had taken one away.
            copied = born > made
            before = np.where(copied, born, made + 1)
            state, arc = np.where(copied, self.right[state], state), np.where(copied, arc, self.left[arc])
        return out

    def has_arc(self, state: np.ndarray, arc: np.ndarray) -> np.ndarray:
        keys = state * self.size + arc
        slot = self._slot(keys)
        out = self.known_arc[slot]
        new = np.flatnonzero(self.known[slot] != keys)
        if len(new):
            out[new] = self._look_up(state[new], arc[new], np.full(len(new), ALWAYS))
            self.known[slot[new]], self.known_arc[slot[new]] = keys[new], out[new]
        return out

    def _read_bytes(self) -> None:
        """Transitions over bytes: the longest prefix of a label that ends at each byte, and the labels that do."""
        number = {b"": 0}
        parent, byte, depth = [0], [0], [0]
        ends: dict[int, int] = {}
        for token in np.flatnonzero(self.live).tolist():
            label, at = self.labels[token], 0
            for d in range(1, len(label) + 1):
                node = number.setdefault(label[:d], len(number))
                if node == len(parent):
                    parent.append(at), byte.append(label[d - 1]), depth.append(d)
                at = node
            ends[at] = token
        parents, bytes_, depths = (np.array(x, dtype=np.int64) for x in (parent, byte, depth))
        nodes = len(parents)
        self.next_node = np.zeros((nodes, 256), dtype=np.int32)
        back = np.zeros(nodes, dtype=np.int64)
        self.longest = np.full(nodes, -1, dtype=np.int64)
        by_depth = np.argsort(depths, kind="stable")
        starts = np.searchsorted(depths[by_depth], np.arange(depths.max() + 2))
        for d, (a, b) in enumerate(pairwise(starts.tolist())):
            here = by_depth[a:b]
            if d > 1:
                back[here] = self.next_node[back[parents[here]], bytes_[here]]
            if d:
                self.next_node[here] = self.next_node[back[here]]
                own = np.array([ends.get(n, -1) for n in here.tolist()], dtype=np.int64)
                self.longest[here] = np.where(own >= 0, own, self.longest[back[here]])
            below = by_depth[b : starts[d + 2]] if d + 2 < len(starts) else here[:0]
            self.next_node[parents[below], bytes_[below]] = below
        self.length = np.array([len(x) for x in self.labels], dtype=np.int64)
        self.shorter = np.full(self.size, -1, dtype=np.int64)
        final = np.array(list(ends), dtype=np.int64)
        self.shorter[[ends[n] for n in final.tolist()]] = self.longest[back[final]]

    def encode_words(self, words: Ragged) -> Ragged:
        """Ids of words given as bytes; each word is one pre-token."""
        sizes = words.sizes
        last = np.zeros(len(words.values), dtype=np.int64)
        together = np.flatnonzero(sizes <= TOGETHER_BYTES)
        order = together[np.argsort(-sizes[together], kind="stable")]
        self._read_together(words, order, last)
        for i in np.flatnonzero(sizes > TOGETHER_BYTES).tolist():
            a, b = words.offsets[i : i + 2]
            last[a:b] = self._read_one(words.values[a:b])
        return self._paths(words, last)

    def _read_together(self, words: Ragged, order: np.ndarray, last: np.ndarray) -> None:
        """The last token of every prefix of the words, which come longest first; byte after byte for all."""
        starts, sizes = words.offsets[order], words.sizes[order]
        node = np.zeros(len(order), dtype=np.int64)
        for j in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -j, side="left"))
            starts, sizes = starts[:n], sizes[:n]
            node = self.next_node[node[:n], words.values[starts + j]].astype(np.int64)
            token, at = self.longest[node], starts + j
            while len(at):
                before = at - self.length[token]
                first = before < at - j
                good = first | self.has_arc(last[np.where(first, at, before)], token)
                last[at[good]] = token[good]
                rest = ~good
                at, token = at[rest], self.shorter[token[rest]]

    def _read_one(self, word: np.ndarray) -> np.ndarray:
        """The last token of every prefix of one word."""
        arcs: dict[tuple[int, int], bool] = {}
        out: list[int] = []
        node = 0
        for j, byte in enumerate(word.tolist()):
            node = int(self.next_node[node, byte])
            token = int(self.longest[node])
            while (before := j - len(self.labels[token])) >= 0:
                pair = out[before], token
                if pair not in arcs:
                    arcs[pair] = bool(self.has_arc(np.array([pair[0]]), np.array([token]))[0])
                if arcs[pair]:
                    break
                token = int(self.shorter[token])
            out.append(token)
        return np.array(out, dtype=np.int64)

    def _paths(self, words: Ragged, last: np.ndarray) -> Ragged:
        """Each word's tokens, read backwards from its end."""
        at, word = words.offsets[1:].copy(), np.flatnonzero(words.sizes > 0)
        found = []
        while len(word):
            token = last[at[word] - 1]
            found.append((word, token))
            at[word] -= self.length[token]
            word = word[at[word] > words.offsets[word]]
        sizes = np.zeros(len(words), dtype=np.int64)
        for word, _ in found:
            sizes[word] += 1
        out = Ragged.of_sizes(sizes, np.zeros(int(sizes.sum()), dtype=np.uint32))
        for k, (word, token) in enumerate(found):
            out.values[out.offsets[word + 1] - 1 - k] = token
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs joined; bytes that are no text become replacement characters."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


class TextCodec:
    """Ids of whole texts as the library gives them, and texts of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.automaton = Automaton(path)
        self.specials = self.automaton.specials
        self.pattern = pre_token_pattern()
        self.narrow = re.compile(f"[\0-{chr(PATTERN_CHARACTERS - 1)}]*")
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.byte_of = {c: b for b, c in byte_symbols().items()}
        self.table = WordTable(self.word_ids)
        self.numbers = [str(i) for i in range(self.automaton.size)]

    def pre_tokens(self, text: str) -> list[str]:
        if self.narrow.fullmatch(text):
            return self.pattern.findall(text)
        return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in self.pre.pre_tokenize_str(text)]

    def word_ids(self, words: list[str]) -> Ragged:
        """Ids of marked chunks (see ``chunks.spaced_chunks``); a special string is its own id."""
        import pyarrow as pa

        # Chunks that start with white space and hold no more of it are cut as one text.
        easy = [i for i, w in enumerate(words) if w[0] != "\1" and w not in self.specials and self.narrow.fullmatch(w)]
        hard = sorted(set(range(len(words))).difference(easy))
        texts = [chunks.spaced_text(words[i]) for i in easy]
        pieces = self.pattern.findall("".join(texts))
        cuts = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        ends = np.searchsorted(cuts, np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))), side="left") + 1
        counts = [np.diff(ends, prepend=0)]
        others = [[] if words[i] in self.specials else self.pre_tokens(chunks.spaced_text(words[i])) for i in hard]
        counts.append(np.array([len(p) for p in others], dtype=np.int64))
        pieces += [p for x in others for p in x]
        encoded = pa.array(pieces, type=pa.string()).dictionary_encode()
        ids = self.automaton.encode_words(arrow_bytes(encoded.dictionary))
        found = ids.rows_of(Ragged.of_sizes(np.concatenate(counts), encoded.indices.to_numpy().astype(np.int64)))
        order = np.empty(len(words), dtype=np.int64)
        order[np.array(easy + hard, dtype=np.int64)] = np.arange(len(words))
        found = found.take(order)
        special = [i for i in hard if words[i] in self.specials]
        if special:
            sizes = found.sizes
            sizes[special] = 1
            out = Ragged.of_sizes(sizes, np.zeros(int(sizes.sum()), dtype=np.uint32))
            kept = np.ones(len(out.values), dtype=bool)
            kept[out.offsets[special]] = False
            out.values[kept] = found.values
            out.values[out.offsets[special]] = [self.specials[words[i]] for i in special]
            return out
        return found

    def encode(self, texts) -> Ragged:
        """Ids of an Arrow array of texts, null and empty ones without any."""
        words, numbers = spaced_words(strings(texts), self.specials)
        return self.table(words).rows_of(numbers)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special ones included."""
        return self.automaton.decode(ids)

    def digests(self, texts) -> dict:
        encoded = self.encode(texts)
        ids_hash, text_hash = [], []
        flat, ends = encoded.values.tolist(), encoded.offsets.tolist()
        for a, b in pairwise(ends):
            ids = flat[a:b]
            ids_hash.append(hashlib.sha256(",".join(map(self.numbers.__getitem__, ids)).encode()).hexdigest())
            text_hash.append(hashlib.sha256(self.decode(ids).encode()).hexdigest())
        return {"n_tokens": encoded.sizes, "ids_sha256": ids_hash, "decoded_sha256": text_hash}

    def both(self, texts) -> dict:
        encoded = self.encode(texts)
        flat = encoded.values.tolist()
        ids = [flat[a:b] for a, b in pairwise(encoded.offsets.tolist())]
        return {"ids": ids, "decoded": [self.decode(x) for x in ids]}


def arrow_bytes(array) -> Ragged:
    """The bytes of an Arrow array of strings without nulls."""
    _, ends, data = array.buffers()
    offsets = np.frombuffer(ends, dtype=np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return Ragged(offsets, np.frombuffer(data or b"", dtype=np.uint8))


_codecs: dict[str, TextCodec] = {}


def codec(path: str) -> TextCodec:
    """One codec per Python worker, kept from task to task."""
    if path not in _codecs:
        _codecs[path] = TextCodec(path)
    return _codecs[path]


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded) of every row's whole text: its ids, and the text that those give back.

    Null and empty texts have no ids and decode to an empty text. Special strings of the file inside a text
    are one id each, and decode to themselves. Equal rows give equal rows; a null key stays null; other
    columns are not read; an empty table gives an empty table. One pass without a shuffle: a worker holds
    the automaton (some 150 MB for 50,000 merges), one slice of texts, and a bounded table of words.
    """
    fields = [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())]
    return map_arrays(docs, text, [key], lambda: codec(path).both, fields)


def encoding_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode_texts`` gives.

    The first is of the decimal ids joined by commas, the second of the decoded text in UTF-8.
    """
    fields = [T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256"))]
    return map_arrays(docs, text, [key], lambda: codec(path).digests, fields)
