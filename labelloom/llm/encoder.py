"""Ids of whole texts as the ``tokenizers`` library gives them, each distinct word encoded once."""

from __future__ import annotations

import json
import os

import numpy as np

from labelloom.llm import chunks
from labelloom.llm.ragged import Ragged, WordTable, bare_words, spaced_words, strings
from labelloom.llm.token_counts import byte_symbols

# Words that go to the library as one text.
JOINED = 512
# Words that no step of the library changes: Latin-1 without capitals, white space and control characters.
UNCHANGED = "^[!-@\\[-~\\x{a1}-\\x{bf}\\x{d7}\\x{df}-\\x{ff}]+$"


class Encoder:
    """Words are joined to texts that the library cuts at the same places; where ids of a word end follows
    from the bytes that each token stands for. Other words are parted by a special token that none of them holds.
    """

    def __init__(self, path: str, spaced: bool):
        # A task has one core; the library's own threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.spaced, self.cut, self.text_of = (True, spaced_words, chunks.spaced_text) if spaced else (False, bare_words, str)
        self.separator = max(self.specials, key=self.specials.get)
        self.table = WordTable(self._encode)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, plain = model.get("end_of_word_suffix") or "", set(byte_symbols().values())
        self.size = np.zeros(1 + max([*model["vocab"].values(), *self.specials.values()]), dtype=np.int64)
        for token, i in model["vocab"].items():
            bare = token[: -len(suffix)] if suffix and token.endswith(suffix) else token
            self.size[i] = len(bare) if plain.issuperset(bare) else 0

    def _easy(self, words: list[str]) -> list[int]:
        """Places of the words that may stand between others in a text."""
        if self.spaced:
            return [i for i, w in enumerate(words) if w[0] != "\1" and w not in self.specials]
        import pyarrow as pa
        import pyarrow.compute as pc

        return np.flatnonzero(pc.match_substring_regex(pa.array(words, type=pa.string()), UNCHANGED).to_numpy(zero_copy_only=False)).tolist()

    def _encode(self, words: list[str]) -> Ragged:
        """The ids of words; a special string is one id."""
        easy = self._easy(words)
        found, hard = self._together([self.text_of(words[i]) for i in easy])
        again = [easy[i] for i in hard]
        rest = sorted({*range(len(words))}.difference(easy)) + again
        found = found.join(self._apart([words[i] if words[i] in self.specials else self.text_of(words[i]) for i in rest]))
        gone = set(again)
        order = np.empty(len(words), dtype=np.int64)
        order[np.array([i for i in easy if i not in gone] + rest, dtype=np.int64)] = np.arange(len(words))
        return found.take(order)

    def _together(self, texts: list[str]) -> tuple[Ragged, list[int]]:
        """Ids of texts that are joined, and the places of those whose tokens do not end with them."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return Ragged.empty(np.uint32), []
        sizes = pc.binary_length(pa.array(texts, type=pa.string())).to_numpy()
        groups = range(0, len(texts), JOINED)
        joined = [("" if self.spaced else " ").join(texts[a : a + JOINED]) for a in groups]
        parts, counts, hard = [], [], []
        for a, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=np.uint32)
            ends, wanted = np.cumsum(self.size[ids]), np.cumsum(sizes[a : a + JOINED])
            at = np.searchsorted(ends, wanted)
            if not len(ids) or ends[-1] != wanted[-1] or (ends[at] != wanted).any():
                hard += range(a, a + len(wanted))
                continue
            parts.append(ids)
            counts.append(np.diff(at, prepend=-1))
        if not parts:
            return Ragged.empty(np.uint32), hard
        return Ragged.of_sizes(np.concatenate(counts), np.concatenate(parts)), hard

    def _apart(self, texts: list[str]) -> Ragged:
        """Ids of texts that a special token parts, and of special strings."""
        if not texts:
            return Ragged.empty(np.uint32)
        mark, own = self.specials[self.separator], {}
        for i in [i for i, t in enumerate(texts) if self.separator in t]:
            own[i] = self.tokenizer.encode(texts[i], add_special_tokens=False).ids
        plain = ["" if i in own else t for i, t in enumerate(texts)]
        joined = [self.separator.join(plain[a : a + JOINED]) + self.separator for a in range(0, len(plain), JOINED)]
        encoded = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in encoded])
        ends = np.flatnonzero(ids == mark)
        found = Ragged.of_sizes(np.diff(ends, prepend=-1) - 1, ids[ids != mark])
        if not own:
            return found
        sizes = found.sizes
        sizes[list(own)] = [len(x) for x in own.values()]
        out = Ragged.of_sizes(sizes, np.zeros(int(sizes.sum()), dtype=np.uint32))
        rest = np.ones(len(out.values), dtype=bool)
        for i, x in own.items():
            out.values[out.offsets[i] : out.offsets[i + 1]] = x
            rest[out.offsets[i] : out.offsets[i + 1]] = False
        out.values[rest] = found.values
        return out

    def ids(self, texts) -> Ragged:
        """The ids of an Arrow array of texts; none for null and empty ones."""
        words, numbers = self.cut(strings(texts), self.specials)
        return self.table(words).rows_of(numbers)

    def __call__(self, texts: list) -> list[bytes]:
        """The ids of a list of texts as little-endian unsigned 32-bit bytes."""
        import pyarrow as pa

        return [bytes(x) for x in self.ids(pa.array(texts, type=pa.string())).slices()]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder per Python worker, kept from task to task."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]
