import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, position long"


def prose(rng, words, size=4):
    syllables = ["the", "an", "on", "er", "re", "sh", "wh", "ti", "ble", "hä", "ó"]
    text = ["".join(rng.choices(syllables, k=rng.randint(1, size))) for _ in range(words)]
    return " ".join(w + (rng.choice(".,\n") if rng.random() < 0.1 else "") for w in text)


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, equal rows, one id with two texts."""
    rng = random.Random(5)
    texts = [prose(rng, n) for n in (60, 90, 120, 300, 2, 1, 80, 80)]
    texts += [None, "", " \n\t ", prose(rng, 40_000), "x" * 200_000, "the " * 3_000, texts[0], "".join(c.upper() if c.isascii() else c for c in texts[1])]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 7, 0.5, 3) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2]]
    rows += [(None, texts[3], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [(3, texts[6], None, "s0", 1, 1, 1.0, 1)]
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
