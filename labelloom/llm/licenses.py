"""Licence scan: an Aho-Corasick automaton finds phrases and tags, a shunting-yard parser reads expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, types as T

from labelloom.llm.common import map_texts

# Phrases with their labels, searched as consecutive words.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Further notices: phrase -> licence id.
NOTICE_PHRASES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "apache license": "apache-2.0",
    "bsd license": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd-3-clause",
    "mozilla public license": "mpl-2.0",
    "lesser general public license": "lgpl-3.0-only",
    "affero general public license": "agpl-3.0-only",
    "eclipse public license": "epl-2.0",
    "boost software license": "bsl-1.0",
    "isc license": "isc",
    "cc0": "cc0-1.0",
    "cc by sa": "cc-by-sa-4.0",
    "cc by nc": "cc-by-nc-4.0",
    "cc by nd": "cc-by-nd-4.0",
    "cc by nc sa": "cc-by-nc-sa-4.0",
    "cc by nc nd": "cc-by-nc-nd-4.0",
    "creative commons attribution": "cc-by-4.0",
    "public domain": "public-domain",
    "released under the unlicense": "unlicense",
    "proprietary and confidential": "proprietary",
}

TAG_PHRASE = "spdx license identifier"
TAG = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)")

# How much a licence restricts reuse, from 0 (free) to 1 (no reuse); the first matching rule counts.
RESTRICTION_RULES = [
    (re.compile(r"cc0|public-domain|unlicense|0bsd"), 0.05),
    (re.compile(r"cc-by.*-n[cd]"), 0.8),
    (re.compile(r"agpl"), 0.75),
    (re.compile(r"lgpl|mpl|epl|cddl|cc-by-sa"), 0.4),
    (re.compile(r"gpl"), 0.7),
    (re.compile(r"mit|apache|bsd|isc|bsl|zlib|cc-by"), 0.1),
    (re.compile(r"proprietary|reserved|licenseref"), 1.0),
]
UNKNOWN_RESTRICTION = 0.9
EXCEPTION_FACTOR = 0.5

# Words: digits, lower-case ASCII letters and everything beyond ASCII; the rest becomes a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
TOKEN = re.compile(r"\(|\)|[^\s()]+")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def restriction(name: str) -> float:
    return next((r for rule, r in RESTRICTION_RULES if rule.search(name)), UNKNOWN_RESTRICTION)


def to_postfix(expression: str) -> list[str] | None:
    """Operands and operators of a licence expression in postfix order; None if it is malformed."""
    output: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in TOKEN.findall(expression):
        if token in PRECEDENCE:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                output.append(stack.pop())
            stack.append(token)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                output.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand_next:
                return None
            output.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return output + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Licence ids that hold together, and how much they restrict; None for a malformed expression.

    ``or`` takes the freer side (the left one on a tie), ``and`` both with the stricter figure, ``with``
    joins an exception to the id in front of it and halves its restriction.
    """
    postfix = to_postfix(expression)
    if postfix is None:
        return None
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append(({token}, restriction(token)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "or":
            stack.append(right if right[1] < left[1] else left)
        elif token == "and":
            stack.append((left[0] | right[0], max(left[1], right[1])))
        else:
            exception = " ".join(sorted(right[0]))
            stack.append(({f"{x} with {exception}" for x in left[0]}, left[1] * EXCEPTION_FACTOR))
    return stack.pop()


class Scanner:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in {**BASE_PHRASES, **NOTICE_PHRASES, TAG_PHRASE: ""}:
            self.automaton.add_word(f" {phrase} ", phrase)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple:
        raw = text.encode().lower()
        words = raw.translate(WORD_BYTES).split()
        line = f" {b' '.join(words).decode()} "
        labels: set[str] = set()
        bases: set[str] = set()
        places, score, at, word, tagged = [], 0.0, 0, 0, False
        for end, phrase in self.automaton.iter(line):
            if phrase == TAG_PHRASE:
                tagged = True
                continue
            if phrase in BASE_PHRASES:
                start = end - len(phrase) - 1
                # Blanks passed since the last counted place; a shorter phrase may begin further left.
                word += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
                at = start
                places.append(word)
                bases.add(BASE_PHRASES[phrase])
                score = max(score, restriction(BASE_PHRASES[phrase]))
            if phrase in NOTICE_PHRASES:
                labels.add(NOTICE_PHRASES[phrase])
                score = max(score, restriction(NOTICE_PHRASES[phrase]))
        if tagged:
            for found in TAG.findall(raw.decode()):
                value = evaluate(found.strip().rstrip("*/->").strip())
                labels.update(value[0] if value else {"invalid-expression"})
                score = max(score, value[1] if value else UNKNOWN_RESTRICTION)
        return (
            len(words),
            len(places),
            min(places, default=None),
            max(places, default=None),
            ",".join(sorted(bases)),
            ",".join(sorted(x.replace(",", " ") for x in bases | labels)),
            score,
        )

    def __call__(self, texts: list) -> dict:
        rows = [self.scan(t or "") for t in texts]
        return dict(zip(NAMES, zip(*rows, strict=True), strict=True))


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
]
NAMES = [f.name for f in FIELDS]


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence notices of every row's whole text: (key, *FIELDS).

    Words are lower-cased (A-Z only) runs of digits, ASCII letters and characters beyond ASCII. ``n_base``
    counts all places of the base phrases, overlapping ones included; ``labels`` holds the base labels,
    the ids of further notices and those that the expressions of identifier tags evaluate to
    (``invalid-expression`` for a malformed one). ``score`` is the strictest restriction found, 0 for a
    text without any. Null and empty texts have no words, no places (first and last are null) and empty
    labels. Equal rows give equal rows, a null key stays null, other columns are not read, an empty table
    gives an empty one. One pass without a shuffle.
    """
    return map_texts(docs, text, [key], Scanner, FIELDS)
