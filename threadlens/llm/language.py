"""Language identification of mixed-language text.

Each word is scored for every language by its letter trigrams.  The script of
the word narrows the candidates to the languages that were learned with letters
of that script.  A Viterbi pass over the words of a text, with a penalty for each
change of language, labels spans; a text's language is the one that labels most
of its letters.

Training counts trigrams per language over all training texts: tasks add up
bounded tables, and Spark sums them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import small_batches, text_chunks

GRAMS = 1 << 16
SWITCH = 8.0
SMOOTH = 0.5
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
CHARS = 1 << 21
TABLE = 0x40000  # up to the last plane that holds letters

#: First and last code point of the blocks of a script.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x531, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF),
    ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF),
    ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("tibetan", 0xF00, 0xFFF), ("myanmar", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x3FFFF),
)
NAMES = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]


class Model(NamedTuple):
    """``scores[gram, language]`` are log probabilities, ``allowed[script, language]`` the candidates."""

    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray


def script_table() -> np.ndarray:
    out = np.zeros(TABLE, np.uint8)
    for name, first, last in SCRIPTS:
        out[first : last + 1] = NAMES.index(name)
    return out


def grams(w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, bucket) of the trigram around every letter, and the letters before each word.

    Anything outside the word reads as 0, so first and last letters are marked.
    """
    length = w.end - w.start
    before = np.cumsum(length) - length
    place = np.repeat(w.start - before, length) + np.arange(int(length.sum()))
    inside = np.zeros(len(w.codes) + 2, np.uint32)
    inside[place + 1] = w.codes[place]
    h = inside[place] * np.uint32(0x85EBCA6B)
    h ^= inside[place + 1] * np.uint32(0xC2B2AE35)
    h ^= inside[place + 2] * np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    return place, (h >> np.uint32(16)).astype(np.int64), before


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from (text, lang); rows with a null text or language are left out."""

    def counted(batches):
        tables: dict[str, np.ndarray] = {}
        scripts = script_table()
        for batch, texts in text_chunks(batches, "text", CHARS):
            names = batch.column("lang").to_pylist()
            w = words.split(texts, size=TABLE)
            place, bucket, _ = grams(w)
            known = {n: k for k, n in enumerate(dict.fromkeys(names))}
            owner = np.array([known[n] for n in names])[np.repeat(w.doc, w.end - w.start)]
            kind = scripts[np.minimum(w.codes[place], TABLE - 1)]
            for n, k in known.items():
                own = owner == k
                if n not in tables:
                    tables[n] = np.zeros(GRAMS + len(NAMES), np.int64)
                tables[n][:GRAMS] += np.bincount(bucket[own], minlength=GRAMS)
                tables[n][GRAMS:] += np.bincount(kind[own], minlength=len(NAMES))
        for n, counts in tables.items():
            held = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * len(held), pa.string()), pa.array(held), pa.array(counts[held])], ["lang", "bucket", "n"]
            )

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    # At most GRAMS + scripts rows per language reach the driver, whatever the size of the corpus.
    counts = small_batches(rows).mapInArrow(counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.asarray(counts.column("lang").to_pylist(), object)
    languages = sorted(set(names.tolist()))
    table = np.zeros((GRAMS + len(NAMES), len(languages)))
    table[counts.column("bucket").to_numpy(), np.searchsorted(languages, names.astype(str)) if languages else []] = counts.column("n").to_numpy()
    seen = table[:GRAMS] + SMOOTH
    kinds = table[GRAMS:]
    allowed = kinds >= SCRIPT_SHARE * np.maximum(1, kinds.sum(0))
    allowed[~allowed.any(1)] = True
    return Model(languages, np.log(seen / seen.sum(0)).astype(np.float32), allowed)


def word_scores(w: words.Words, model: Model, scripts: np.ndarray) -> np.ndarray:
    """Log probability of every word in every language."""
    _, bucket, before = grams(w)
    out = np.empty((len(w.start), len(model.languages)), np.float32)
    for k in range(len(model.languages)):
        out[:, k] = np.add.reduceat(np.ascontiguousarray(model.scores[:, k])[bucket], before)
    kind = scripts[np.minimum(w.codes[w.start], TABLE - 1)]
    out[~model.allowed[kind]] = -1e6
    return out


def viterbi(score: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float = SWITCH) -> np.ndarray:
    """Best language of every word; the words of all texts advance in step.

    A change costs the same whatever the languages, so the best predecessor of a
    label is the label itself or the best label of the word before.
    """
    size = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")
    path = np.empty(len(score), np.int16)
    came = np.empty(len(score), np.int16)
    changed = np.empty(score.shape, bool)
    if not len(score):
        return path
    total = score[first[order[: live[0]]]].astype(np.float64)
    last = np.zeros((len(order), score.shape[1]))
    last[: len(total)] = total
    for t in range(1, len(live)):
        at = first[order[: live[t]]] + t
        now = last[: live[t]]
        best = now.argmax(1)
        came[at] = best
        switch = now[np.arange(len(best)), best] - penalty
        turned = switch[:, None] > now
        changed[at] = turned
        last[: live[t]] = np.where(turned, switch[:, None], now) + score[at]
    state = last.argmax(1)
    for t in range(len(live) - 1, 0, -1):
        at = first[order[: live[t]]] + t
        own = state[: live[t]]
        path[at] = own
        state[: live[t]] = np.where(changed[at, own], came[at], own)
    path[first[order[: live[0]]]] = state[: live[0]]
    return path


def labelled(texts: list[str], model: Model, scripts: np.ndarray) -> tuple[words.Words, np.ndarray]:
    w = words.split(texts, size=TABLE)
    if not len(w.start) or not model.languages:
        return w, np.empty(0, np.int16)
    return w, viterbi(word_scores(w, model, scripts), w.doc, len(texts))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with lang_pred and score, the share of letters labelled so.

    A null text, or one without letters, is ``und`` with score 0, as is every
    text if nothing was learned.  Equal shares go to the first name.
    """
    rest = [f for f in docs.schema.fields if f.name not in (text, "lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def made(batches):
        model, scripts = sent.value, script_table()
        names = pa.array([*model.languages, UNKNOWN])
        for batch, texts in text_chunks(batches, text, CHARS):
            w, path = labelled(texts, model, scripts)
            n = max(1, len(model.languages))
            letters = np.zeros((len(texts), n))
            if len(path):
                letters = np.bincount(w.doc * n + path, w.end - w.start, len(texts) * n).reshape(-1, n)
            whole = letters.sum(1)
            best = np.where(whole > 0, letters.argmax(1), len(model.languages))
            score = letters.max(1) / np.maximum(1, whole)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in rest), names.take(pa.array(best)), pa.array(score)],
                names=[*(f.name for f in rest), "lang_pred", "score"],
            )

    schema = T.StructType([*rest, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return small_batches(docs.select(*(f.name for f in rest), text)).mapInArrow(made, schema)


def spans(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, end, lang) of every run of words with one language, in code points."""
    source = docs.select(id, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def made(batches: Iterator[pa.RecordBatch]):
        model, scripts = sent.value, script_table()
        names = pa.array(model.languages, pa.string())
        for batch, texts in text_chunks(batches, text, CHARS):
            w, path = labelled(texts, model, scripts)
            if not len(path):
                continue
            new = np.flatnonzero(np.diff(w.doc, prepend=-1) | np.diff(path, prepend=-1))
            last = np.append(new[1:], len(path)) - 1
            begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[w.doc[new]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id).take(pa.array(w.doc[new])), pa.array(w.start[new] - begin), pa.array(w.end[last] - begin),
                 names.take(pa.array(path[new]))], names=[id, "start", "end", "lang"],
            )

    schema = T.StructType([source.schema[id], *(T.StructField(n, T.LongType()) for n in ("start", "end")), T.StructField("lang", T.StringType())])
    return small_batches(source).mapInArrow(made, schema)
