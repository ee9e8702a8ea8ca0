import random

import pytest

WORDS = ["the", "of", "and", "house", "river", "stone", "école", "straße", "niño", "don't", "42", "x_y", "--", "Ünï"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, odd letters, and extra columns with clashing names."""
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, text(60)), (5, text(60)), (5, "again"), (None, text(80)), (None, None), (7, text(30_000)), (8, "日本語 текст ΣΑΣ İ 😀 ́ ½²"), (9, "a<|endoftext|>b  c\x1cd\x85e\xa0f"), (10, "'S don't 'LL   zz"), (11, "A B c"), (12, "a b C")]
    rows += [rows[3]] * 3 + [(100 + i, rows[3][1]) for i in range(5)]
    return spark.createDataFrame([(i, t, "en", 7, 8, b"x") for i, t in rows], "doc_id long, text string, lang string, key int, digest int, sketch binary")


@pytest.fixture(scope="session")
def pairs(awkward):
    """(doc_id, text or empty) of the rows above."""
    return [(r["doc_id"], r["text"] or "") for r in awkward.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
