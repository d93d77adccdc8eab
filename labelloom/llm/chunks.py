"""Cut texts into chunks that a tokenizer of the ``tokenizers`` library encodes independently.

Words of prose recur, so a chunk is encoded once and its ids are looked up afterwards. The cuts stand only
where the pre-tokenizer of the vocabulary file cannot match across, so the ids of a text are those of
its chunks in a row. The lookup table of a Python worker is bounded and dropped when it is full.
"""

from __future__ import annotations

import re
from collections.abc import Collection
# Characters with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0  -     　"
CACHE_ENTRIES = 350_000
SEEN_SLOTS = 1 << 22

# A space goes with the word behind it; the last of several white-space characters stands alone or with it.
SPACED = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
BARE = re.compile(f"[^{WHITE}]+")
# White space for Python's split, but not for the tokenizer.
OTHER_BLANKS = re.compile("[\x1c-\x1f]")


def spaced_chunks(text: str) -> list[str]:
    """Chunks for byte-level pre-tokenizers, where white space is part of the tokens.

    A word stands for itself with one space in front, "\\0" and a word for the word behind one newline, and
    "\\1" for the exact text that follows it. Texts with other white space go through the pattern.
    """
    plain = text.replace("\n", " ")
    if "\0" in text or "\1" in text or " ".join(text.split()) != plain:
        return ["\1" + c for c in SPACED.findall(text)]
    words = text.replace("\n", " \0").split(" ")
    words[0] = "\1" + words[0]
    return words


def spaced_text(chunk: str) -> str:
    if chunk[0] == "\1":
        return chunk[1:]
    return "\n" + chunk[1:] if chunk[0] == "\0" else " " + chunk


def bare_chunks(text: str, specials: Collection[str] = ()) -> list[str]:
    """Chunks for pre-tokenizers that lower-case and drop white space: the words between it.

    Lower-casing before or after makes no difference to Latin-1 texts, which NFC leaves alone, unless it
    spells one of ``specials``, which the library finds in the text as it is.
    """
    try:
        text.encode("latin-1")
        lowered = text.lower()
        if not any(s in lowered for s in specials):
            text = lowered
    except UnicodeEncodeError:
        pass
    if OTHER_BLANKS.search(text):
        return BARE.findall(text)
    return text.split()


class ChunkTable(dict):
    """chunk -> value, bounded; ``resolve`` gives the values of chunks that are not there.

    A chunk is kept from its second time on: most chunks that come once never come again.
    """

    def __init__(self, resolve, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.resolve, self.entries = resolve, entries
        self.seen, self.marked = bytearray(SEEN_SLOTS), 0

    def keep(self, values: dict) -> None:
        if len(self) > self.entries:
            self.clear()
        if self.marked > SEEN_SLOTS // 2:
            self.seen, self.marked = bytearray(SEEN_SLOTS), 0
        seen = self.seen
        slots = [hash(c) & (SEEN_SLOTS - 1) for c in values]
        self.update({c: v for (c, v), slot in zip(values.items(), slots, strict=True) if seen[slot]})
        for slot in slots:
            seen[slot] = 1
        self.marked += len(slots)

    def values_of(self, lists: list[list[str]]) -> list[list]:
        """The values of each list's chunks."""
        values = [list(map(self.get, chunks)) for chunks in lists]
        short = [(c, v) for c, v in zip(lists, values, strict=True) if None in v]
        fresh = list({x for chunks, found in short for x, y in zip(chunks, found, strict=True) if y is None})
        if fresh:
            known = dict(zip(fresh, self.resolve(fresh), strict=True))
            for chunks, found in short:
                found[:] = [known[c] if v is None else v for c, v in zip(chunks, found, strict=True)]
            self.keep(known)
        return values


def split_special(texts: list, specials: dict[str, int], cut) -> list[list[str]]:
    """Chunks of each text; special strings are cut out first and are chunks of their own."""
    pattern = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
    out = []
    for text in texts:
        if not text:
            out.append([])
        elif pattern and any(s in text for s in specials):
            parts = pattern.split(text)
            out.append([c for i, p in enumerate(parts) if p for c in ([p] if i % 2 else cut(p))])
        else:
            out.append(cut(text))
    return out
