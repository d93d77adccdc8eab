"""Texts as numbers of words: a slice of texts is cut and numbered in Arrow and each distinct word is worked
on once; what it gives is gathered for all texts as one ragged array.

The cuts are those of ``chunks``. A worker keeps what recurring words gave in a bounded table.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass

import numpy as np

from labelloom.llm import chunks

TABLE_ENTRIES = 400_000
# White space that is neither blank nor newline, beside the marks of a chunk.
OTHER_WHITE = "\\x00\\x01\\t\\x0b-\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
# Texts that are not words parted by one blank or newline each.
UNEVEN = f"[{OTHER_WHITE}]|[ \\n][ \\n]|^[ \\n]|[ \\n]$"


@dataclass
class Ragged:
    """Rows of different lengths: row i is values[offsets[i] : offsets[i + 1]]."""

    offsets: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of_sizes(cls, sizes: np.ndarray, values: np.ndarray) -> Ragged:
        return cls(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), values)

    @classmethod
    def empty(cls, dtype) -> Ragged:
        return cls(np.zeros(1, dtype=np.int64), np.zeros(0, dtype=dtype))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def take(self, rows: np.ndarray) -> Ragged:
        """The given rows, one after another."""
        starts = self.offsets[rows]
        sizes = self.offsets[rows + 1] - starts
        out = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        at = np.arange(out[-1])
        at += np.repeat(starts - out[:-1], sizes)
        return Ragged(out, self.values[at])

    def join(self, other: Ragged) -> Ragged:
        """The rows of both."""
        return Ragged(np.concatenate([self.offsets, other.offsets[1:] + self.offsets[-1]]), np.concatenate([self.values, other.values]))

    def rows_of(self, parts: Ragged) -> Ragged:
        """Rows made of rows of this one: row i joins the rows that ``parts`` lists in its row i."""
        flat = self.take(parts.values)
        return Ragged(flat.offsets[parts.offsets], flat.values)

    def ended(self, value) -> Ragged:
        """Each row with one more value behind it."""
        out = Ragged.of_sizes(self.sizes + 1, np.full(len(self.values) + len(self), value, dtype=self.values.dtype))
        kept = np.ones(len(out.values), dtype=bool)
        kept[out.offsets[1:] - 1] = False
        out.values[kept] = self.values
        return out

    def slices(self) -> list[memoryview]:
        """The bytes of each row."""
        data = memoryview(np.ascontiguousarray(self.values)).cast("B")
        ends = (self.offsets * self.values.itemsize).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]


def numbered(regular, places: np.ndarray, others: list[list[str]]) -> tuple[list[str], Ragged]:
    """Distinct words of lists of words, and the numbers of each text's words.

    ``regular`` is an Arrow list array of the texts not in ``places``; ``others`` are the lists of those.
    """
    import pyarrow as pa

    flat = regular.flatten()
    if others:
        flat = pa.concat_arrays([flat, pa.array([w for x in others for w in x], type=flat.type)])
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy()
    sizes = np.concatenate([regular.value_lengths().to_numpy(), np.array([len(x) for x in others], dtype=np.int32)])
    numbers = Ragged.of_sizes(sizes, codes)
    if others:
        order = np.empty(len(sizes), dtype=np.int64)
        order[np.concatenate([np.setdiff1d(np.arange(len(sizes)), places), places])] = np.arange(len(sizes))
        numbers = numbers.take(order)
    return encoded.dictionary.to_pylist(), numbers


def split_off(texts, uneven) -> tuple:
    """Even texts, places of the uneven ones, and those as a list."""
    import pyarrow.compute as pc

    places = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
    if not len(places):
        return texts, places, []
    return texts.filter(pc.invert(uneven)), places, texts.take(places).to_pylist()


def _any_of(texts, specials: Collection[str]):
    import pyarrow.compute as pc

    found = pc.equal(texts, None).fill_null(False)
    for s in specials:
        found = pc.or_(found, pc.match_substring(texts, s))
    return found


def spaced_words(texts, specials: dict[str, int]) -> tuple[list[str], Ragged]:
    """Chunks for byte-level pre-tokenizers, marked as ``chunks.spaced_chunks`` marks them.

    ``texts`` is an Arrow array of strings without nulls.
    """
    import pyarrow.compute as pc

    uneven = pc.or_(pc.match_substring_regex(texts, UNEVEN), _any_of(texts, specials))
    even, places, rest = split_off(texts, uneven)
    marked = pc.binary_join_element_wise("\1", pc.replace_substring(even, "\n", " \0"), "")
    split = pc.split_pattern(marked, " ")
    return numbered(split, places, chunks.split_special(rest, specials, exact_chunks))


def exact_chunks(text: str) -> list[str]:
    return ["\1" + c for c in chunks.SPACED.findall(text)]


def bare_words(texts, specials: dict[str, int]) -> tuple[list[str], Ragged]:
    """Words for pre-tokenizers that lower-case and drop white space; Latin-1 texts are lower-cased here."""
    import pyarrow.compute as pc

    # Lower-casing before or after makes no difference to these texts, unless it spells a special string.
    uneven = pc.match_substring_regex(texts, f"{UNEVEN}|[^\\x00-\\x{{ff}}]")
    lowered = pc.utf8_lower(pc.if_else(uneven, "", texts))
    uneven = pc.or_(uneven, _any_of(lowered, specials))
    _, places, rest = split_off(texts, uneven)
    even = lowered.filter(pc.invert(uneven)) if rest else lowered
    split = pc.split_pattern(pc.replace_substring(even, "\n", " "), " ")
    return numbered(split, places, chunks.split_special(rest, specials, lambda t: chunks.bare_chunks(t, tuple(specials))))


class WordTable:
    """What ``resolve`` gives for words, kept for those that recur; at most ``entries`` beside a slice's own."""

    def __init__(self, resolve: Callable[[list[str]], Ragged], dtype=np.uint32, entries: int = TABLE_ENTRIES):
        self.resolve, self.entries = resolve, entries
        self.place: dict[str, int] = {}
        self.store, self.used = Ragged.empty(dtype), np.zeros(0, dtype=bool)

    def __call__(self, words: list[str]) -> Ragged:
        """The rows of distinct words."""
        if len(self.place) > self.entries:
            self._shrink()
        known = np.fromiter(map(self.place.get, words, [-1] * len(words)), dtype=np.int64, count=len(words))
        fresh = np.flatnonzero(known < 0)
        self.used[known[known >= 0]] = True
        if len(fresh):
            new = [words[i] for i in fresh.tolist()]
            known[fresh] = np.arange(len(self.store), len(self.store) + len(new))
            self.place.update(zip(new, known[fresh].tolist(), strict=True))
            self.store = self.store.join(self.resolve(new))
            self.used = np.concatenate([self.used, np.zeros(len(new), dtype=bool)])
        return self.store.take(known)

    def _shrink(self) -> None:
        """Keep the words that were looked up again; all go when those alone fill the table."""
        keep = np.flatnonzero(self.used)
        if len(keep) > self.entries // 2:
            keep = keep[:0]
        number = np.full(len(self.store), -1, dtype=np.int64)
        number[keep] = np.arange(len(keep))
        self.place = {w: n for w, i in self.place.items() if (n := int(number[i])) >= 0}
        self.store, self.used = self.store.take(keep), np.zeros(len(keep), dtype=bool)


def strings(column) -> object:
    """An Arrow array of strings, nulls as empty ones."""
    return column.fill_null("")
