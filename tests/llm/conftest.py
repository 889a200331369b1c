from __future__ import annotations

import pytest

LONG = "word " * 3000 + "end"

EDGES = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank"),
    (2, "the QUICK brown fox jumps over the lazy dog near the river bank"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "two words"),
    (7, LONG),
    (None, "A text whose id is null, and long enough to have some shingles of its own"),
    (None, None),
    (8, "Grüße aus Köln 😀 á Ünïcode line 12.5 mail a.b@c.de, x"),
    (9, "same\nsame\n\nother line of five words\nother line of five words\nother line of six whole words"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names operators use inside."""
    rows = [(i, t, "en", f"s{k % 3}" if k % 4 else None, k, 0.5, "x", k) for k, (i, t) in enumerate(EDGES)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n long, score double, label string, rate long"
    )


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.01"
