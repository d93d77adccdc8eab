"""Word shingles of whole texts as sorted 64-bit hashes, and signatures that similar sets must share.

Two sets of a and b shingles whose Jaccard similarity is at least p / 100 differ in at most
D = (a + b)(100 - p) / (100 + p) shingles. Hashed into D + 1 + s groups, at least 1 + s groups hold the same
shingles in both. A set with at most s empty groups therefore shares a group that is not empty with every
set that it links with, and the content of a group, hashed, is a signature to look for. Sets with more
empty groups offer their empty groups as well, so nothing is missed. The number of groups follows
from a band of sizes; sets small enough to link with the band below also offer its signatures.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# Words of short texts that are worked on together, about.
RUN_WORDS = 8_192


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    out = x >> np.uint64(30)
    out ^= x
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of all words together if there are fewer.

    Words are runs of characters other than space and \\t to \\r, A-Z lower-cased. None without words.
    """
    return shingle_sets([text], size)[0]


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """``shingle_set`` of every text; the words of many texts are worked on as one array."""
    out: list[np.ndarray] = []
    held, words = [], 0
    for text in texts:
        own = text.encode().lower().split() if text else []
        held.append(own)
        words += len(own)
        if words >= RUN_WORDS:
            out += _sets_of_run(held, size)
            held, words = [], 0
    return out + _sets_of_run(held, size)


def _sets_of_run(held: list[list[bytes]], size: int) -> list[np.ndarray]:
    import xxhash

    counts = [len(words) for words in held]
    # Words are hashed each time they stand: real vocabularies are too large for a table to be quicker.
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(held)), dtype=np.uint64, count=sum(counts))
    runs = _runs_of_words(hashes, size) if len(hashes) >= size else hashes[:0]
    out, start = [], 0
    for n in counts:
        if n >= size:
            own = runs[start : start + n - size + 1]
        else:
            own = _runs_of_words(hashes[start : start + n], n) if n else hashes[:0]
        own = np.sort(own)
        out.append(own[np.r_[True, own[1:] != own[:-1]]] if n else own)
        start += n
    return out


def _runs_of_words(hashes: np.ndarray, width: int) -> np.ndarray:
    out = np.full(len(hashes) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = mixed(out * MULTIPLIER + hashes[k : len(hashes) - width + 1 + k])
    return out


def largest_partner(n: int, percent: int) -> int:
    """The most shingles that a set linking with one of ``n`` can have."""
    return 100 * n // percent


def least_overlap(total, percent: int):
    """Shared shingles that two sets with ``total`` shingles together need to link."""
    return -(-percent * total // (100 + percent))


def allowed_empty(groups: int, low: int) -> int:
    """Extra groups, so that few sets of ``low`` shingles or more leave more groups empty than there are extra.

    Each extra group adds to the empty ones. Where they never catch up (small sets) the nearest miss is taken.
    """
    best, least, extra = 0, np.inf, 0
    while True:
        total = groups + extra
        mean = total * (1 - 1 / total) ** low if total > 1 else 0.0
        needed = int(np.ceil(mean + 2 * mean**0.5))
        if needed - extra < least:
            best, least = extra, needed - extra
        if needed <= extra or extra > groups:
            return best
        extra = needed if groups > 64 else extra + 1


@cache
def bands(percent: int, most: int = 1 << 34) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smallest size, groups, allowed empty groups) of each band of sizes; 0 groups where only equal sets link."""
    low, out = 1, []
    while low <= most:
        high = max(largest_partner(low, percent), low * 5 // 4)
        differ = (high + largest_partner(high, percent)) * (100 - percent) // (100 + percent)
        empty = allowed_empty(differ + 1, low)
        out.append((low, differ + 1 + empty if differ else 0, empty))
        low = high + 1
    return tuple(np.array(c) for c in zip(*out, strict=True))


def signatures(hashes: np.ndarray, percent: int) -> np.ndarray:
    """What a set offers: one number per non-empty group (empty ones too where needed), in one or two bands."""
    n = len(hashes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    lows, groups, allowed = bands(percent)
    band = int(np.searchsorted(lows, n, side="right")) - 1
    parts = []
    for k in (band, band - 1):
        if k < 0 or not groups[k] or (k < band and n > largest_partner(int(lows[k + 1]) - 1, percent)):
            continue
        number = int(groups[k])
        place = (hashes % np.uint64(number)).astype(np.int64)
        content = np.zeros(number, dtype=np.uint64)
        np.add.at(content, place, mixed(hashes ^ MULTIPLIER))
        used = np.bincount(place, minlength=number) > 0
        if number - int(used.sum()) > allowed[k]:
            used[:] = True
        at = np.flatnonzero(used).astype(np.uint64)
        parts.append(mixed(content[used] + mixed(at + (np.uint64(k) << np.uint64(40)))))
    if not parts:
        return np.zeros(0, dtype=np.int64)
    return np.concatenate(parts).view(np.int64)


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two numbers that equal sets share; sums, so the order does not matter."""
    if not len(hashes):
        return 0, 0
    return (
        int(mixed(hashes).sum(dtype=np.uint64).view(np.int64)),
        int(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)),
    )


def _runs_of_sets(sets: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The sets one after another, so many at a time that they have RUN_WORDS elements or more."""
    held, elements = [], 0
    for s in sets:
        held.append(s)
        elements += len(s)
        if elements >= RUN_WORDS:
            yield held
            held, elements = [], 0
    if held:
        yield held


def fingerprints(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """``fingerprint`` of every set."""
    out: list[tuple[int, int]] = []
    for run in _runs_of_sets(sets):
        flat, sizes = np.concatenate(run), np.array([len(s) for s in run])
        used = np.flatnonzero(sizes)
        marks = np.zeros((2, len(run)), dtype=np.uint64)
        if len(used):
            starts = (np.cumsum(sizes) - sizes)[used]
            marks[0, used] = np.add.reduceat(mixed(flat), starts)
            marks[1, used] = np.add.reduceat(mixed(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)
        out += zip(*marks.view(np.int64).tolist(), strict=True)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Shared elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
