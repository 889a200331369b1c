from __future__ import annotations

import random

import pytest

from threadlens.llm import queries, token_counts
from threadlens.llm.token_counts import Counter


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path(queries.COUNTED))


def random_texts(n, seed):
    rng = random.Random(seed)
    # white space of all kinds, short forms, special strings, letters that one edition of Unicode knows and another doesn't
    some = ["'s", "'re", "'RE", " ", "  ", "\n", "\t", "a", "bc", "The", "<|endoftext|>", "<|endof", "é", "İ", "ſ", "՘", "౜",
            "\U00018d80", "12", "٣", "!", "…", "😀", "\xa0", "​", "́", "\x1c", "\x85", "x" * 90, "\x00"]
    return [
        "".join(rng.choice(some) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(32, 0x500), rng.randrange(0x10000, 0x30000)]))
                for _ in range(rng.randrange(12)))
        for _ in range(n)
    ]


def test_counts_are_the_librarys(library, monkeypatch):
    counter = Counter(queries.tokenizer_path(queries.COUNTED))
    for texts in (random_texts(4000, 1), random_texts(500, 2)):
        assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        monkeypatch.setattr(token_counts, "SLICE_CHARS", 5)  # long texts go piece by piece
        monkeypatch.setattr(token_counts, "SLICE_PIECES", 3)
    assert counter.disputed and counter.agreed


def test_long_pieces_and_forgotten_ones(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_PIECES", 4)
    counter = Counter(queries.tokenizer_path(queries.COUNTED))
    texts = ["ab" * 20_000, " " * 5000 + "x", "aaaa" * 3000, "one two three four five six one two", "6" * 999, "é" * 4000, "", " "]
    for _ in range(2):
        assert [counter.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_merges_against_plain_rounds():
    """The lowest rank of all adjacent pairs, the leftmost first, again and again."""
    counter = Counter(queries.tokenizer_path(queries.COUNTED))
    rng = random.Random(3)
    for _ in range(300):
        data = bytes(rng.choice(b"the innoer") for _ in range(rng.randrange(1, 40)))
        symbol, merged = list(data), 0
        while True:
            found = [(counter.ranks[a].get(b, 1 << 30), i) for i, (a, b) in enumerate(zip(symbol, symbol[1:]))]
            rank, at = min(found, default=(1 << 30, 0))
            if rank == 1 << 30:
                break
            symbol[at : at + 2] = [counter.made[rank]]
            merged += 1
        assert counter.merges(list(data)) == merged


def test_other_rules_are_refused():
    with pytest.raises(ValueError):
        Counter(queries.tokenizer_path("word_bpe_49k.json"))


def test_query_against_the_library(spark, sf_dir, library):
    rows = queries.op11_token_counts(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)


def test_edges(spark, edge_docs, library):
    path = queries.tokenizer_path(queries.COUNTED)
    got = token_counts.count_tokens(edge_docs, path)
    assert sorted(got.columns) == sorted([*edge_docs.columns, "n_bytes", "n_tokens", "over_limit"])
    rows = got.collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 1024)
    assert token_counts.count_tokens(edge_docs.limit(0), path).count() == 0
    again = token_counts.count_tokens(got, path)  # its own columns are replaced
    assert sorted(again.columns) == sorted(got.columns) and again.exceptAll(got.select(*again.columns)).count() == 0
