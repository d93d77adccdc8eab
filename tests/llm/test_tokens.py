import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from labelloom.llm import encoder as encoders, id_files, packing, token_counts
from tests.llm.conftest import edge_rows

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES = [
    "a", "the", " ", "  ", "\n", "\t", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "é", "́", "\x1c", "\x85",
    "\xa0", "ß", "١", "中文", "🙂", "aaa", "!!!", "\0", "\1", " ", "Σ", "İ", "12", "\r\n", ".", " x", "|", "Word,",
]


def ids_of(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def fuzzed(n=4000):
    rng = random.Random(9)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(n)] + [None, ""]


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORD, False)])
def test_chunked_encoding_equals_the_library(path, spaced):
    texts = fuzzed() + [r[1] for r in edge_rows()]
    encoder = encoders.Encoder(path, spaced)
    encoder.table.entries = 50  # emptied again and again
    got = [np.frombuffer(x, "<u4").tolist() for a in range(0, len(texts), 500) for x in encoder(texts[a : a + 500])]
    assert got == ids_of(path, texts)


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORD, False)])
def test_special_strings_in_other_case_are_plain_text(path, spaced):
    rng = random.Random(3)
    pieces = ["<|ENDOFTEXT|>", "<|StartOfText|>", "<|EndOfText|>", "<|endoftext|>", " ", "\n", "a", "Word", "é", "Σ", "\x1c"]
    texts = ["a <|ENDOFTEXT|> b", "<|StartOfText|>", "x<|ENDOFTEXT|>y", "É <|EndOfText|>"]
    texts += ["".join(rng.choices(pieces, k=rng.randint(1, 8))) for _ in range(1000)]
    encoder = encoders.Encoder(path, spaced)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(texts)] == ids_of(path, texts)


def test_merged_counts_equal_the_library():
    texts = fuzzed() + [r[1] for r in edge_rows()]
    assert token_counts.Merges(BYTE)(texts)["n_tokens"] == [len(i) for i in ids_of(BYTE, texts)]


def test_token_counts_of_edge_rows(edges, nothing):
    rows = token_counts.token_counts(edges, BYTE, limit=512).collect()
    texts = [r[1] for r in edge_rows()]
    want = [(r[0], len((t or "").encode()), len(i), len(i) > 512) for r, t, i in zip(edge_rows(), texts, ids_of(BYTE, texts), strict=True)]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert token_counts.token_counts(nothing, BYTE, limit=512).count() == 0


def test_variable_length_round_trip():
    rng = np.random.default_rng(2)
    for size in (0, 1, 3, 4, 5, 1000):
        ranks = (2 ** rng.uniform(0, 32, size)).astype(np.uint32)
        control, data = id_files.encode_ranks(ranks)
        assert len(control) == -(-size // 4)
        assert (id_files.decode_ranks(control, data, size) == ranks).all()


def test_id_files_read_back(edges, nothing):
    rows = id_files.encode_corpus(edges, WORD, end_id=1).collect()
    texts = [r[1] for r in edge_rows()]
    ids = [i + [1] for i in ids_of(WORD, texts)]
    want = sorted((-1 if r[0] is None else r[0], len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(edge_rows(), ids, strict=True))
    got = sorted(rows, key=lambda r: r.start)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for before, row in zip([None, *got], got):
        assert row.start == at
        at += row.n_tokens
        assert before is None or before.doc_id is None or before.doc_id <= row.doc_id
    assert id_files.encode_corpus(nothing, WORD, end_id=1).count() == 0


def check_pieces(rows, documents, window):
    """``documents``: (key, ids) of every document, each of which must lie in pieces exactly once."""
    by_key, sequences = {}, {}
    for r in rows:
        by_key.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    wanted = {}
    for key, ids in documents:
        wanted.setdefault(key, []).append(np.array(ids, "<u4"))
    assert set(by_key) == set(wanted)
    for key, pieces in by_key.items():
        for ids in wanted[key]:
            at = 0
            while at < len(ids):
                piece = next(
                    p for p in pieces
                    if p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
                )
                pieces.remove(piece)
                at += piece.length
        assert not pieces
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([p.length for p in pieces])
        assert [p.offset for p in pieces] == [0, *ends[:-1].tolist()]
        assert ends[-1] <= window
    return sum(r.length for r in rows) / (window * max(1, len(sequences)))


def test_packing_of_edge_rows(edges, nothing):
    documents = [(r[0], i + [0]) for r, i in zip(edge_rows(), ids_of(BYTE, [r[1] for r in edge_rows()]), strict=True)]
    check_pieces(packing.pack(edges, BYTE).collect(), documents, 1024)
    assert packing.pack(nothing, BYTE).count() == 0


def test_packing_wastes_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    documents = [(r.doc_id, i + [0]) for r, i in zip(rows, ids_of(BYTE, [r.text for r in rows]), strict=True)]
    assert check_pieces(packing.pack(docs, BYTE).collect(), documents, 1024) > 0.98


@pytest.mark.parametrize("kind", ["even", "one length", "hot length", "few", "none"])
def test_tail_plan_places_every_tail(kind):
    rng = np.random.default_rng(4)
    lengths = {
        "even": rng.integers(1, 1024, 3000), "one length": np.full(500, 900), "few": np.array([5, 1000]),
        "hot length": np.concatenate([np.full(2000, 700), rng.integers(1, 1024, 4000)]), "none": np.zeros(0, dtype=int),
    }[kind]
    histogram = np.bincount(lengths, minlength=1024)
    plan = packing.plan_tails(histogram, 1024)
    if not len(lengths):
        assert plan.windows == 0
        return
    each = np.repeat(np.arange(1024), histogram)
    ranks = np.concatenate([np.arange(n) for n in histogram])
    number, offset, first = packing.place_tails(plan, 1024, each, ranks)
    taken = np.zeros((plan.windows + 1, 1024), dtype=int)
    for n, o, f, whole in zip(number, offset, first, each, strict=True):
        taken[n, o : o + f] += 1
        taken[n + 1, : whole - f] += 1
    assert taken.max() == 1 and taken.sum() == each.sum() and not taken[plan.windows :].any()
    assert len(lengths) < 10 or taken.sum() > 0.98 * 1024 * plan.windows
