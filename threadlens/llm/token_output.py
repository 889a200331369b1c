"""Token ids in a binary file format: Simple-8b words in blocks.

A 64-bit word holds a selector in its four top bits and, in the other sixty,
as many ids of one width as the selector says.  Ids that need more than sixty
bits follow a word with the escape selector as they are.  Ids are coded in blocks
of ``BLOCK`` that start at a word of their own; a segment stores the word offset
of every block, so a reader decodes all blocks of a segment in step, or any one
of them alone.

Files: rows of (part, segment, start, doc_ids, sizes, n_ids, offsets, words) in
Parquet, which every store that Spark reads can hold.  A part is a range of the
documents' order, a segment a run of whole documents of about ``SEGMENT`` ids;
``start`` counts the ids before the segment inside its part, and a small table of
part sizes gives the ids before a part.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import RecentTable, kept_by_worker, small_batches, text_chunks

BLOCK = 256
SEGMENT = 1 << 18
#: Fixed values of the code: ids per word and bits per id by selector; selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
CACHE_PIECES = 300_000


# ------------------------------------------------------------------- the code


SHORT_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
#: How the largest width among the next n ids follows from two shorter windows that cover n.
WINDOWS = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (4, 2), 7: (4, 3), 8: (4, 4), 10: (8, 2), 12: (8, 4), 15: (8, 7),
           20: (12, 8), 30: (15, 15), 60: (30, 30)}


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of every id (0 for 0)."""
    if not len(ids) or ids.max() < 1 << 16:
        return SHORT_BITS[ids]
    high = ids >> np.uint64(32)
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low).astype(np.uint8)


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of every block) of unsigned ids.

    The largest width among the next n ids is known at every place for each
    selector's n, so the selector that covers the most ids is too.  Then all
    blocks advance in step from word to word.  What lies beyond a block's end
    counts as 0 bits, so its last word may be part full.
    """
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    blocks = -(-n // block)
    ahead = int(COUNTS.max())
    widest = {1: np.zeros((blocks, block + ahead), np.uint8)}
    filled = np.zeros(blocks * block, np.uint8)
    filled[:n] = bit_lengths(ids)
    widest[1][:, :block] = filled.reshape(blocks, block)
    for size, (first, second) in WINDOWS.items():
        reach = widest[1].shape[1] - size + 1
        widest[size] = np.maximum(widest[first][:, :reach], widest[second][:, first : first + reach])
    # A selector that fits leaves all with fewer ids fitting, so the first that fits follows from how many don't.
    choice = np.ones((blocks, block), np.uint8)
    for selector in range(1, len(COUNTS)):
        choice += widest[COUNTS[selector]][:, :block] > WIDTHS[selector]
    choice[choice == len(COUNTS)] = 0
    choice = choice.ravel()
    at = np.arange(0, n, block, dtype=np.int64)
    end = np.minimum(at + block, n)
    heads = []
    live = np.arange(len(at))
    while len(live):
        now = at[live]
        heads.append(now)
        at[live] = now + COUNTS[choice[now]]
        live = live[at[live] < end[live]]
    head = np.sort(np.concatenate(heads))
    selector = choice[head]
    taken = np.diff(head, append=n)
    offset = np.arange(len(head)) + np.cumsum(selector == 0) - (selector == 0)
    words = np.zeros(len(head) + int((selector == 0).sum()), np.uint64)
    shift = (np.arange(n) - np.repeat(head, taken)) * np.repeat(np.where(selector == 0, 0, WIDTHS[selector]), taken)
    words[offset] = np.bitwise_or.reduceat(ids << shift.astype(np.uint64), head)
    escaped = offset[selector == 0]
    words[escaped + 1] = words[escaped]
    words[escaped] = 0
    words[offset] |= selector.astype(np.uint64) << np.uint64(60)
    return words, offset[np.searchsorted(head, np.arange(0, n, block))].astype(np.int32)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ids; every block is read from its own offset, all at once.

    A word after an escape is an id as it is; whether a word is one follows, for
    all blocks in step, from the words before it in the block.
    """
    if not n:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == 0).any():
        end = np.append(offsets[1:], len(words))
        at = offsets.astype(np.int64)
        live = np.arange(len(at))
        while len(live):
            escape = selector[at[live]] == 0
            raw[at[live[escape]] + 1] = True
            at[live] += np.where(escape, 2, 1)
            live = live[at[live] < end[live]]
    place = np.flatnonzero(~raw)
    kind = selector[place]
    count = COUNTS[kind]
    first = np.searchsorted(place, offsets)
    last = np.append(first[1:], len(place)) - 1
    held = np.add.reduceat(count, first)
    count[last] -= held - np.minimum(block, n - np.arange(len(offsets)) * block)
    begin = np.cumsum(count) - count
    width = np.where(kind == 0, 0, WIDTHS[kind])
    value = np.where(kind == 0, words[np.minimum(place + 1, len(words) - 1)], words[place])
    mask = np.where(kind == 0, ~np.uint64(0), (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))
    shift = (np.arange(n) - np.repeat(begin, count)) * np.repeat(width, count)
    return (np.repeat(value, count) >> shift.astype(np.uint64)) & np.repeat(mask, count)


# ---------------------------------------------------------------- tokenization


#: The rules under which a text may be cut at white space and plain words go straight to the model.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Marks that the rules cut off a word; the apostrophe may begin a short form and is none of them.
MARKS = ".,;:!?#$%&*+-/=@^_`|~<>(){}[]\"\\"


class Encoder:
    """Whole texts to ids, by way of a bounded table of the pieces seen.

    Where the file has the rules above, a text's ids are those of its pieces
    between spaces and line ends, in order: white space separates before anything
    else, and no character composes with it.  A piece is looked up, or encoded
    once.  Texts in Latin-1 may be lower-cased first, and marks behind a plain word
    are a piece of their own, as the tokenizer would do both.  Under other rules,
    or with special tokens of marks or white space, whole texts go to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.special = [t["content"] for t in rules["added_tokens"]]
        self.by_pieces = (
            rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER
            and not any(rules.get(k) for k in ("truncation", "padding", "post_processor"))
            and all(not any(t[k] for k in ("lstrip", "rstrip", "single_word")) for t in rules["added_tokens"])
            and all(s.isascii() and s == s.lower() and s.strip(MARKS) and not any(map(str.isspace, s)) for s in self.special)
        )
        self.known = RecentTable(CACHE_PIECES)
        # Byte-level vocabularies write a byte as its character if it can be seen, else as the next free one from 256.
        seen = {b: b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        self.bytes = seen | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in seen)}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if not self.by_pieces:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        cut = [self.pieces(t) for t in texts]
        used = set().union(*cut)
        table = self.known
        new = used.difference(table.new)
        if table.make_room(len(new)):
            new = used
        again = new & table.old.keys()
        for piece in again:
            table.new[piece] = table.old[piece]
        self.learn(new - again)
        get = table.new.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def pieces(self, text: str) -> list[str]:
        """The text between spaces and line ends; in lower case if that changes nothing that the tokenizer sees."""
        try:
            text.isascii() or text.encode("latin-1")
            lowered = text.lower()
            if not any(s in lowered for s in self.special):  # a special token's string must keep its case
                text = lowered
        except UnicodeEncodeError:
            pass
        return text.replace("\n", " ").split(" ")

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of ``pieces`` into the table.

        A plain word, of small Latin letters, is in normal form and one pre-token,
        so only the mapping of its bytes to characters is left to do before the
        model.  Marks behind a plain word are a pre-token, encoded like any other
        piece; all else takes all the tokenizer's steps.
        """
        known, older, tokenize, table = self.known.new, self.known.old, self.tokenizer.model.tokenize, self.bytes
        whole, tailed = [], []
        for piece in pieces:
            word = piece.rstrip(MARKS)
            if word.isalpha() and word.islower() and (word.isascii() or max(word) < "ɐ"):
                if word in older:
                    known[word] = older[word]
                elif word not in known:
                    shown = word if word.isascii() else word.encode().decode("latin-1").translate(table)
                    known[word] = array("I", [t.id for t in tokenize(shown)]).tobytes()
                if len(word) < len(piece):
                    tail = piece[len(word) :]
                    tailed.append((piece, word, tail))
                    if tail not in known and tail not in pieces:
                        whole.append(tail)
            else:
                whole.append(piece)
        whole = list(dict.fromkeys(whole))
        for piece, found in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            known[piece] = array("I", found.ids).tobytes()
        for piece, word, tail in tailed:
            known[piece] = known[word] + known[tail]


# ----------------------------------------------------------------------- files

SEGMENTS = (
    "part int, segment int, start long, doc_ids array<{id}>, sizes array<int>, n_ids int, offsets array<int>, words binary"
)


def write(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None, id: str = "doc_id", text: str = "text"
) -> None:
    """Encode the texts of ``docs`` and write them to ``path`` in ascending order of ``id``.

    A range partitioning of the texts by id puts the documents in order; rows
    with the same id follow one another in the order of a hash of their text, and
    null ids come first.  A null text is an empty document, which is its end id
    alone (nothing if ``end_id`` is None).
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    )
    kind = dict(ordered.dtypes)["doc_id"]
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def packed(batches):
        encoder = kept_by_worker(("encoder", tokenizer_path), lambda: Encoder(tokenizer_path))
        coded = ((b.column("doc_id").to_pylist(), [x + tail for x in encoder.ids(texts)]) for b, texts in text_chunks(batches))
        part, segment, start = TaskContext.get().partitionId(), 0, 0
        for doc_ids, ids in segments_of(coded):
            flat = np.frombuffer(b"".join(ids), "<u4")
            words, offsets = pack(flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([start]),
                 pa.array([doc_ids]), pa.array([[len(x) // 4 for x in ids]], pa.list_(pa.int32())), pa.array([len(flat)], pa.int32()),
                 pa.array([offsets], pa.list_(pa.int32())), pa.array([words.astype("<u8").tobytes()], pa.binary())],
                ["part", "segment", "start", "doc_ids", "sizes", "n_ids", "offsets", "words"],
            )
            segment, start = segment + 1, start + len(flat)

    small_batches(ordered).mapInArrow(packed, SEGMENTS.format(id=kind)).write.mode("overwrite").parquet(path)


def segments_of(coded: Iterable[tuple[list, list[bytes]]]) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of whole documents with about ``SEGMENT`` ids."""
    doc_ids, ids, size = [], [], 0
    for more_ids, more in coded:
        for d, x in zip(more_ids, more, strict=True):
            doc_ids.append(d)
            ids.append(x)
            size += len(x) // 4
            if size >= SEGMENT:
                yield doc_ids, ids
                doc_ids, ids, size = [], [], 0
    if doc_ids:
        yield doc_ids, ids


def read(spark: SparkSession, path: str, id: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is the
    unsigned CRC-32 of its ids as little-endian 32-bit integers.
    """
    rows = spark.read.parquet(path)
    kind = dict(rows.dtypes)["doc_ids"][len("array<") : -1]
    # One row per part, and as many parts as the writer had partitions.
    sizes = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select(F.col("part").alias("__part"), before.alias("base"))
    based = rows.join(F.broadcast(bases), F.col("part") == F.col("__part")).select(
        (F.col("base") + F.col("start")).alias("start"), "doc_ids", "sizes", "n_ids", "offsets", "words"
    )

    def decoded(batches):
        for batch in batches:
            for row in batch.to_pylist():
                flat = unpack(np.frombuffer(row["words"], "<u8"), np.array(row["offsets"]), row["n_ids"]).astype("<u4")
                sizes = np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(flat[e - s : e].tobytes()) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(row["start"] + ends - sizes),
                     pa.array(sizes), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    found = small_batches(based).mapInArrow(decoded, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
    return found.withColumnRenamed("doc_id", id)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document in the files."""
    rows = spark.read.parquet(path)
    kind = dict(rows.dtypes)["doc_ids"][len("array<") : -1]

    def decoded(batches):
        for batch in batches:
            for row in batch.to_pylist():
                flat = unpack(np.frombuffer(row["words"], "<u8"), np.array(row["offsets"]), row["n_ids"]).astype(np.int64)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int32), flat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type), lists], ["doc_id", "ids"]
                )

    return small_batches(rows).mapInArrow(decoded, f"doc_id {kind}, ids array<long>")
