import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from labelloom.llm import token_alignment
from labelloom.llm.token_counts import byte_symbols
from tests.llm.conftest import SCHEMA, edge_rows

A, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
PIECES = [
    "a", "the", " ", "  ", "\n", "\t", "'s", "<|endoftext|>", "<s>", "é", "́", "\x85", "\xa0", "ß", "中文", "🙂", "aaa",
    "!!!", "\0", "\1", "▁", "12", "\r\n", ".", " word", " Word,", "\n\n", "schü", "nñ", "<0x41>", "$$$", "�", " and", " the",
]


@pytest.fixture(scope="module")
def plain():
    """Groups of A ids and B ids of one text, by the libraries and byte offsets alone."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {c: x for x, c in byte_symbols().items()}

    def groups(text):
        if not text:
            return []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        parts_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            return []
        out, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
        while i < len(ids_a) or j < len(ids_b):
            if at_a <= at_b and i < len(ids_a):
                out[-1][0].append(ids_a[i])
                at_a += len(parts_a[i])
                i += 1
            else:
                out[-1][1].append(ids_b[j])
                at_b += len(parts_b[j])
                j += 1
            if at_a == at_b:
                out.append(([], []))
        return out[:-1]

    return groups


def written(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def fuzzed(n=3000):
    rng = random.Random(8)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(n)] + [None, "", " ", "▁a", "a▁b", "\n", "x" * 9000]


def test_groups_equal_those_of_whole_texts(plain):
    texts = fuzzed() + [" ".join(random.Random(i).choices(["the", "Word,", "schü", "12", "nñ"], k=60)) for i in range(200)]
    aligner = token_alignment.Aligner(A, B)
    for a in range(0, len(texts), 100):
        part = texts[a : a + 100]
        assert aligner.groups(pa.array(part, pa.string()))["groups"] == [written(plain(t)) for t in part]


def test_a_cleared_memo_changes_nothing(plain, monkeypatch):
    monkeypatch.setattr(token_alignment, "MEMO_WINDOWS", 20)
    texts = fuzzed(400)
    aligner = token_alignment.Aligner(A, B)
    for a in range(0, len(texts), 40):
        part = texts[a : a + 40]
        assert aligner.groups(pa.array(part, pa.string()))["groups"] == [written(plain(t)) for t in part]


def test_windows_are_kept_by_their_ids():
    aligner = token_alignment.Aligner(A, B)
    text = "the Word, the Word, 12 the"
    aligner.windows(pa.array([text]))
    known = len(aligner.texts)
    # A whole text with other white space is cut at its spaces, and its windows are known.
    aligner.windows(pa.array(["the Word, the\tWord, the 12"]))
    assert len(aligner.texts) <= known + 1


def expected(rows, plain):
    groups = [plain(r[1]) for r in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    counts = Counter(p for x in links for p in x)
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    out = []
    for r, g, found in zip(rows, groups, links, strict=True):
        best = sum(n for p, n in found.items() if counts[p] == highest[p[0]])
        total = sum(n * counts[p] for p, n in found.items())
        digest = hashlib.sha256(written(g).encode()).hexdigest() if g else ""
        out.append((r[0], sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(found.values()), best, total, digest))
    return out, counts


def test_digests_and_counts_of_edge_rows(spark, edges, nothing, plain, monkeypatch):
    want, counts = expected(edge_rows(), plain)
    got = token_alignment.alignment_digests(edges.withColumnRenamed("n_words", "block"), A, B).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    pairs = {(r.a_id, r.b_id): r.n_docs for r in token_alignment.pair_counts(edges, A, B).collect()}
    assert pairs == counts
    assert token_alignment.alignment_digests(nothing, A, B).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "a▁b")], SCHEMA.split(", lang")[0])
    assert sorted(map(tuple, token_alignment.alignment_digests(blank, A, B).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_counts_over_many_blocks(spark, plain):
    texts = fuzzed(600)
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, _ = expected(rows, plain)
    assert sorted(map(tuple, token_alignment.alignment_digests(docs, A, B).collect())) == want
