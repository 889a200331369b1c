from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.llm import decontamination, language, mixing, queries, token_output, toxicity, words

# --------------------------------------------------------------------- words


def test_words_and_hashes():
    w = words.split(["Ein Wört, İx", "", "ein  2b"], digits=True)
    assert w.doc.tolist() == [0, 0, 0, 2, 2]
    h = w.hash()
    assert h[0] == h[3] and len(set(h.tolist())) == 4
    assert (w.hash(w.start + 2)[0]) == words.split(["ei"]).hash()[0]


# ------------------------------------------------------------------ toxicity


def test_interaction_is_learned():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(4) < 0.5) for _ in range(2000)]
    label = np.array([float(0 in r and 1 in r) for r in rows])  # both terms, neither alone
    bias, weight, vectors = toxicity.fit(rows, label, 4)
    score = [bias + weight[r].sum() + 0.5 * ((vectors[r].sum(0) ** 2).sum() - (vectors[r] ** 2).sum()) for r in rows]
    assert np.mean((np.array(score) > 0) == (label > 0)) > 0.97


def test_toxicity_held_out(spark, sf_dir, edge_docs):
    docs = spark.read.parquet(f"{sf_dir.replace('0.01', '0.1')}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir.replace('0.01', '0.1')}/labels.parquet")
    machine = queries.toxicity_machine(spark, docs, sf_dir.replace("0.01", "0.1"))
    rows = toxicity.score(docs, machine).join(labels, "doc_id").where(F.expr("crc32(cast(doc_id as string)) % 3 = 1"))
    got = [(r["score"] >= 0.7, r["toxic"] == 1) for r in rows.collect()]
    true = sum(a and b for a, b in got)
    assert true / sum(b for _, b in got) > 0.75 and true / sum(a for a, _ in got) > 0.95
    scored = toxicity.score(edge_docs, machine)
    assert scored.count() == edge_docs.count() and sorted(scored.columns) == sorted(edge_docs.columns)
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    plain = {r["doc_id"]: r["score"] for r in scored.where("doc_id IN (3, 4, 5)").collect()}
    assert len(set(plain.values())) == 1


def test_toxicity_without_labels(spark, edge_docs):
    none = spark.createDataFrame([], "doc_id long, label int")
    machine = toxicity.train(edge_docs.select("doc_id", "text"), none, F.lit(True))
    assert toxicity.score(edge_docs, machine).where("score < 0.001").count() == edge_docs.count()


# ------------------------------------------------------------ decontamination


def plain_containment(docs, items, share=0.8, size=5):
    def shingles(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    out = []
    for d, text in docs:
        own = shingles(text)
        for i, item in items:
            s = shingles(item)
            if s and len(s & own) >= share * len(s) - 1e-9:
                out.append((d, i, len(s & own), len(s)))
    return Counter(out)


def found(docs, items):
    return Counter((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in decontamination.find(docs, items).collect())


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_containment_against_plain_loops(spark, edge_docs, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", block)
    item = " ".join(f"t{i}" for i in range(26))
    near = item.replace("t0 ", "u0 ").replace(" t25", " u25")  # 20 of 22 shingles
    half = " ".join(item.split(" ")[:13])
    made = [(50, f"before {near.upper()}, after"), (51, half), (52, "x " * 9000 + item + " y" * 9000), (52, item)]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    items = spark.createDataFrame(
        [(1, item), (1, item), (2, "brown fox jumps over the lazy dog"), (3, "too short"), (4, None), (5, ""), (6, "word " * 40)],
        "item_id long, text string",
    )
    want = plain_containment([tuple(r) for r in docs.collect()], [tuple(r) for r in items.distinct().collect()])
    assert found(docs, items) == want and want
    hit = {k[0] for k in want}
    rest = decontamination.clean(docs, items)
    assert Counter(r["doc_id"] for r in rest.collect()) == Counter(r["doc_id"] for r in docs.collect() if r["doc_id"] not in hit)
    assert decontamination.find(docs.limit(0), items).count() == 0
    assert decontamination.find(docs, items.limit(0)).count() == 0
    assert decontamination.clean(docs, items.limit(0)).count() == docs.count()


# -------------------------------------------------------------- token output


@pytest.mark.parametrize("top", [1, 2, 200, 49_408, 1 << 33, 1 << 64])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = np.array([int(x * (top - 1)) for x in rng.random(n) ** 4], np.uint64)
        coded, offsets = token_output.pack(ids)
        assert (token_output.unpack(coded, offsets, n) == ids).all()
        assert len(offsets) == -(-n // token_output.BLOCK)


def test_simple8b_packs_small_ids_tightly():
    coded, _ = token_output.pack(np.ones(2560, np.uint64))
    assert len(coded) <= 10 * 5


def test_encoder_is_the_library(monkeypatch):
    """Random texts of marks, white space, capitals, accents, special strings and letters that normal form changes."""
    import random

    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "CACHE_PIECES", 900)  # pieces are forgotten and learnt again
    rng = random.Random(3)
    some = ["'s", "'re", " ", "  ", "\n", "\t", "a", "bc", "The", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endof", "|>", "é", "e\u0301", "İ", "İ.",
            "ſ", "ß", "ẞ", "Œ", "œ", "ǅ", "ŉ", "ª", "º", "µ", ".", ",", "...", "&&&", "-", "_", "12", "٣", "!", "…", "😀", "\xa0", "\u0301",
            "\u0338", "\x1c", "\x85", "\r", "it's.", "wörd,", "Ω", "Å", "Σ", "ΑΣ"]
    texts = ["İ.", "x.İ,"] + [
        "".join(rng.choice(some) if rng.random() < 0.85 else chr(rng.choice([rng.randrange(32, 0x500), rng.randrange(0x10000, 0x30000)]))
                for _ in range(rng.randrange(12)))
        for _ in range(6000)
    ]
    for name, by_pieces in ((queries.TOKENIZER, True), (queries.COUNTED, False)):  # other rules: whole texts to the library
        encoder, library = token_output.Encoder(queries.tokenizer_path(name)), Tokenizer.from_file(queries.tokenizer_path(name))
        assert encoder.by_pieces == by_pieces
        for k in range(0, len(texts), 300):
            want = [e.ids for e in library.encode_batch(texts[k : k + 300], add_special_tokens=False)]
            assert [np.frombuffer(g, "<u4").tolist() for g in encoder.ids(texts[k : k + 300])] == want


def test_tokens_against_whole_encoding(spark, edge_docs, documents, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "SEGMENT", 3000)
    odd = "İ. İstanbul ΣΑΣ <|endoftext|> <|ENDOFTEXT|> it's THEY'RE e.g., Œuvre Å x y\tz\r\n3.14 ... 中文."
    docs = edge_docs.select("doc_id", "text").union(documents.select("doc_id", "text").where("doc_id BETWEEN 100 AND 260"))
    docs = docs.union(spark.createDataFrame([(60, odd)], "doc_id long, text string"))
    token_output.write(docs, str(tmp_path / "t"), queries.tokenizer_path(), 2)
    got = sorted(token_output.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    ids = {(r["doc_id"], tuple(r["ids"])) for r in token_output.read_ids(spark, str(tmp_path / "t")).collect()}
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want, at = [], 0
    whole = [(r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in docs.collect()]
    assert ids == {(d, tuple(i)) for d, i in whole}
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in whole), key=lambda d: (d is not None, d))
    by_id = {}
    for d, i in whole:
        by_id.setdefault(d, []).append((len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in by_id[r["doc_id"]]
        at += r["n_tokens"]
    assert not want
    token_output.write(docs.limit(0), str(tmp_path / "none"), queries.tokenizer_path(), 2)
    assert token_output.read(spark, str(tmp_path / "none")).count() == 0


# -------------------------------------------------------------------- mixing


def test_mixing_reaches_the_target_weights(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.expr("CASE WHEN id < 10000 THEN 'hot' WHEN id < 29990 THEN concat('s', id % 5) ELSE 'rare' END").alias("source")
    )
    weights = spark.createDataFrame([("hot", 0.2), ("s0", 0.4), ("s1", 0.0), ("rare", 0.4), ("unseen", 9.0)], "source string, weight double")
    rates = mixing.rates(docs, weights)
    mixed = mixing.mix(docs, rates, columns=("__copy",))
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(n) == {"hot", "s0", "rare"}
    for source, share in (("hot", 0.2), ("s0", 0.4), ("rare", 0.4)):
        assert abs(n[source] / 30_000 - share) < 0.02
    again = mixing.mix(docs.repartition(5), rates, columns=("__copy",))
    assert mixed.exceptAll(again).count() == 0 and again.exceptAll(mixed).count() == 0
    copies = [r["count"] for r in mixed.where("source = 'hot'").groupBy("doc_id").count().collect()]
    plain = Counter(copies)  # Poisson with mean 0.6
    assert abs(plain[1] / 10_000 - 0.3293) < 0.02 and abs(plain[2] / 10_000 - 0.0988) < 0.012


def test_poisson_inverse_against_plain_sums(spark):
    import math

    for mean in (0.01, 0.7, 5.0, 16.0):
        rows = spark.range(300).select(mixing.uniform(F.lit(3), F.col("id")).alias("u")).withColumn(
            "k", mixing.drawn(F.col("u"), mixing.cumulative(F.lit(mean)))
        ).collect()
        for r in rows:
            k, p, total = 0, math.exp(-mean), math.exp(-mean)
            while total < r["u"]:
                k += 1
                p *= mean / k
                total += p
            assert r["k"] == k


def test_mixing_edges(edge_docs):
    rates = mixing.rates(edge_docs, mixing.smoothed(edge_docs), total=600)
    mixed = mixing.mix(edge_docs, rates)
    assert mixed.columns == edge_docs.columns and 400 < mixed.count() < 800
    assert mixed.where("source IS NULL").count() > 0
    assert mixing.mix(edge_docs.limit(0), rates).count() == 0
    empty = edge_docs.limit(0)
    assert mixing.mix(empty, mixing.rates(empty, mixing.smoothed(empty))).count() == 0


# ------------------------------------------------------------------ language


def test_viterbi_against_plain_loops():
    rng = np.random.default_rng(4)
    size = np.array([5, 0, 1, 9])
    score = rng.normal(0, 3, (15, 3)).astype(np.float32)
    got = language.viterbi(score, np.repeat(np.arange(4), size), 4, penalty=2.0)
    begin = 0
    for n in size:
        part = score[begin : begin + n].astype(float)

        def value(path, part=part):
            return sum(part[i, p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

        if n:
            from itertools import product

            best = max(value(p) for p in product(range(3), repeat=int(n)))
            assert abs(value(got[begin : begin + n].tolist()) - best) < 1e-4
        begin += n


def test_language_held_out_and_spans(spark, documents, edge_docs):
    fold = F.expr("crc32(cast(doc_id as string)) % 4")
    model = language.train(documents.where(fold != 2))
    found = language.predict(documents.where(fold == 2).select("doc_id", "lang", "text"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.98
    edge = {r["n"]: r for r in language.predict(edge_docs, model).collect()}
    assert {edge[k]["lang_pred"] for k in (3, 4, 5, 9)} == {"und"} and edge[3]["score"] == 0
    assert edge[0]["lang_pred"] in model.languages and 0 < edge[0]["score"] <= 1
    en, fr = (documents.where(f"lang = '{x}' AND n_chars > 2000").first()["text"][:900] for x in ("en", "fr"))
    mixed = spark.createDataFrame([(1, f"{en}\n{fr}")], "doc_id long, text string")
    spans = language.spans(mixed, model).orderBy("start").collect()
    assert [s["lang"] for s in spans] == ["en", "fr"] and abs(spans[1]["start"] - len(en)) < 40
    none = language.train(documents.limit(0))
    assert language.predict(edge_docs, none).where("lang_pred = 'und' AND score = 0").count() == edge_docs.count()


def test_letters_of_every_plane_are_words(spark):
    rows = [("hello world this is a text", "en"), ("\U00020001\U00020002 \U00030005\U00030006", "zh")] * 5
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    texts = [(k, t) for k, t in enumerate(["\U00030007", "\U000323AF\U00031350", "\U0010FFFF", "\U00040000", "12 😀"])]
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert got == {0: "zh", 1: "zh", 2: "und", 3: "und", 4: "und"}


def test_script_narrows_candidates(spark):
    rows = [("привет мир это текст", "ru"), ("hello world this is a text", "en"), ("bonjour le monde", "fr")] * 5
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    got = language.predict(spark.createDataFrame([("мир",), ("world",), ("中文",)], "text string"), model).collect()
    assert [r["lang_pred"] for r in got][:2] == ["ru", "en"] and got[2]["lang_pred"] in model.languages
