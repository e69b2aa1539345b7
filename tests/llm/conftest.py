from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def model_files():
    return pytest.importorskip("public_tokenizers").path


@pytest.fixture(scope="session")
def corner_docs(spark):
    """Nulls in every column, empty and white texts, a very long one, repeated rows, ties and clashing columns."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    body = lambda n: " ".join(word() for _ in range(n))
    same = body(40)
    rows = [
        (1, same, "en", "s1", 1), (2, same, "en", "s1", 1), (2, same, "en", "s1", 1), (3, None, "en", None, None), (4, "", None, "s2", 0),
        (None, body(30), "de", "s2", 5), (5, "   \n\t ", "fr", "s2", 5), (6, body(30_000), "en", "s3", 9), (7, "x" * 20_000, None, "s3", 9),
        (8, "one two", "en", "s1", 7), (9, "é ☃ ünï\x00cødé 日本語 ▁ <|endoftext|>", "fr", None, 3), (10, "1234 5678 !!!", "en", "s1", 3),
    ]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS + ", score string, size string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
