"""Counts that describe a text: what quality rules and the quality classifier look at."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import types as T

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
ENDS = b".!?:;,\"')"
COUNTS = [
    "n_words",  # runs of characters other than space and \t to \r
    "word_chars",  # code points in words
    "n_symbols",  # characters of #*$%&|<>
    "n_dup_lines",  # lines with a word, equal to an earlier line
    "n_repeat_words",  # words in 3-word windows found twice or more
    "n_lines",  # lines with a word
    "n_distinct",  # distinct words
    "n_top",  # places of the commonest word
    "n_chars",  # code points
    "n_upper",  # ASCII capitals
    "n_digits",  # ASCII digits
    "n_marks",  # exclamation and question marks
    "n_stops",  # full stops and commas
    "n_wide",  # code points beyond ASCII
    "n_long",  # words of more than 14 bytes
    "n_short",  # words of one or two bytes
    "n_bare",  # words that hold no letter, digit or character beyond ASCII
]
FIELDS = [T.StructField(c, T.LongType()) for c in COUNTS]
LETTERS = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def repeated_words(ids: np.ndarray) -> int:
    """Words covered by 3-word windows that occur twice or more, the first occurrence included."""
    if len(ids) < 4:
        return 0
    # Ids are below 2^21 for texts of under two million distinct words; longer ones are numbered in pairs first.
    size = int(ids.max()) + 1
    pairs = ids[:-1] * size + ids[1:]
    if size > 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * size + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    repeated = np.zeros(len(windows), dtype=bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= repeated
    return int(covered.sum())


def counts(text: str | None) -> list[int]:
    """The figures of COUNTS for one whole text; all 0 for a null or empty one."""
    if not text:
        return [0] * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    joined = b" ".join(words)
    if len(joined) == len(raw) and raw.isascii():
        word_chars = len(raw) - max(n - 1, 0)
    else:
        word_chars = len(joined.decode()) - max(n - 1, 0)
    lines = [x for x in text.split("\n") if x.encode().strip()]
    without = len(raw.translate(None, LETTERS)) if n else 0
    bare = sum(1 for w in words if not w.translate(None, SYMBOLS + b"-_=+~^.,;:!?")) if without else 0
    return [
        n,
        word_chars,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        len(number),
        int(np.bincount(ids).max()) if n else 0,
        len(text),
        len(raw) - len(raw.translate(None, UPPER)),
        len(raw) - len(raw.translate(None, b"0123456789")),
        raw.count(b"!") + raw.count(b"?"),
        raw.count(b".") + raw.count(b","),
        len(text) - len(raw.translate(None, bytes(range(128, 256)))),
        int((sizes > 14).sum()),
        int((sizes <= 2).sum()),
        bare,
    ]


def count_texts(texts: list) -> dict:
    """One list per figure; equal texts of a batch are counted once."""
    cached: dict[str | None, list[int]] = {}
    repeats = Counter(texts) if len(texts) > 1 else {}
    rows = []
    for t in texts:
        if repeats.get(t, 1) > 1:
            row = cached.get(t)
            if row is None:
                row = cached[t] = counts(t)
        else:
            row = counts(t)
        rows.append(row)
    return dict(zip(COUNTS, zip(*rows, strict=True), strict=True))
