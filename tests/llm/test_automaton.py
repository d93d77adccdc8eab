import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from labelloom.llm import merge_automaton
from labelloom.llm.ragged import Ragged
from tests.llm.conftest import edge_rows
from tests.llm.test_tokens import fuzzed

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return merge_automaton.TextCodec(BYTE)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(BYTE)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def rows(ragged):
    return [ragged.values[a:b].tolist() for a, b in zip(ragged.offsets, ragged.offsets[1:])]


def test_ids_and_texts_equal_the_library(codec, library):
    texts = fuzzed(6000) + [r[1] for r in edge_rows()] + ["ab" * 50_000, "aaaaaaa" * 30 + "!" * 300, "�", "É" * 100]
    codec.table.entries = 50  # emptied again and again
    for a in range(0, len(texts), 500):
        part = texts[a : a + 500]
        got = rows(codec.encode(pa.array(part, pa.string())))
        want = [e.ids for e in library.encode_batch([t or "" for t in part], add_special_tokens=False)]
        assert got == want
        assert [codec.decode(i) for i in got] == [t or "" for t in part] == [library.decode(i, skip_special_tokens=False) for i in want]


def test_any_ids_decode_as_the_library_does(codec, library):
    rng = random.Random(6)
    for _ in range(2000):
        ids = [rng.randrange(codec.automaton.size) for _ in range(rng.randint(0, 6))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def merged(word, ranks):
    """Plain merging: the lowest rank first, its places from the left."""
    while True:
        pairs = [(ranks[p], p) for p in zip(word, word[1:]) if p in ranks]
        if not pairs:
            return word
        pair, out, i = min(pairs)[1], [], 0
        while i < len(word):
            if tuple(word[i : i + 2]) == pair:
                out.append(word[i] + word[i + 1])
                i += 2
            else:
                out.append(word[i])
                i += 1
        word = out


@pytest.mark.parametrize("seed", range(12))
def test_automata_of_random_merges(tmp_path, seed):
    """Merges in any order, some of them out of reach, against merging by hand."""
    rng = random.Random(seed)
    symbols = merge_automaton.byte_symbols()
    tokens, merges = list("abc"), []
    for _ in range(rng.randint(1, 40)):
        u, v = rng.choice(tokens), rng.choice(tokens)
        if u + v not in tokens and len(u + v) < 12:
            merges.append((u, v))
            tokens.append(u + v)
    vocab = {c: b for b, c in symbols.items()}
    vocab |= {t: 256 + i for i, t in enumerate(t for t in tokens if len(t) > 1)}
    file = tmp_path / "vocabulary.json"
    file.write_text(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": [f"{u} {v}" for u, v in merges]}}))
    automaton = merge_automaton.Automaton(str(file))
    words = ["".join(rng.choices("abc", weights=[5, 2, 1], k=rng.choice([0, 1, 2, 5, 9, 20, 70]))) for _ in range(400)]
    data = Ragged.of_sizes(np.array([len(w) for w in words]), np.frombuffer("".join(words).encode(), dtype=np.uint8))
    names = {i: t for t, i in vocab.items()}
    got = [[names[i] for i in x] for x in rows(automaton.encode_words(data))]
    ranks = {m: i for i, m in enumerate(merges)}
    assert got == [merged(list(w), ranks) for w in words]
    # Arcs one by one: a pair of tokens follow each other exactly if merging leaves them as they are.
    for _ in range(300):
        u, v = rng.choice(tokens), rng.choice(tokens)
        if merged(list(u), ranks) == [u] and merged(list(v), ranks) == [v]:
            arc = automaton.has_arc(np.array([vocab[u]]), np.array([vocab[v]]))[0]
            assert arc == (merged(list(u + v), ranks) == [u, v])


def test_digests_of_edge_rows(spark, edges, nothing, library):
    got = merge_automaton.encoding_digests(edges.withColumnRenamed("n_words", "_text"), BYTE).collect()
    want = []
    for r in edge_rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), r[1] or "")]
        want.append((r[0], len(ids), *digest))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert merge_automaton.encoding_digests(nothing, BYTE).count() == 0


def test_encoded_texts_come_back(edges, nothing, library):
    got = merge_automaton.encode_texts(edges, BYTE).collect()
    want = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids, r[1] or "") for r in edge_rows()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert merge_automaton.encode_texts(nothing, BYTE).count() == 0
