"""Token counts by heap-and-linked-list byte-pair merging.

A piece of text starts as one symbol per byte, in a doubly linked list.  A heap
holds every adjacent pair that has a rank; the pair of the lowest rank (the
leftmost of equals) is popped, its right symbol leaves the list, and the pairs
with the new neighbours join the heap.  Entries whose pair is gone are skipped
when popped, so a piece of n bytes takes n log n steps whatever its length.  The
count is the number of first symbols less the number of merges: no id is made.

Byte-level tokenizers cut a text into pieces first and never merge across them,
so the counts of the pieces add up.  Pieces repeat, so a Python worker keeps
a bounded table of their counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import RecentTable, kept_by_worker, small_batches, text_chunks

#: Fixed value: the pattern by which byte-level tokenizers cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern where a text is ASCII.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-Z]+| ?[0-9]+| ?[^\sa-zA-Z0-9]+|\s+(?!\S)|\s+"
CACHE_PIECES = 300_000
CACHE_LENGTH = 64
SLICE_PIECES = 1 << 16
SLICE_CHARS = 1 << 20
LIMIT = 1024


class Counter:
    """Counts of whole texts under the rules of one tokenizer file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        check_rules(rules)
        # Bytes are written as characters of their own; the vocabulary tells which.
        seen = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        shown = seen | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in seen)}
        symbols = {shown[b]: b for b in range(256)}
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in rules["model"]["merges"]]
        self.made = [symbols.setdefault(a + b, len(symbols)) for a, b in merges]
        self.gone = len(symbols)  # a symbol that is in no pair
        none: dict[int, int] = {}
        self.ranks = [none] * (self.gone + 1)
        for rank, (a, b) in enumerate(merges):
            left = symbols[a]
            if self.ranks[left] is none:
                self.ranks[left] = {}
            self.ranks[left].setdefault(symbols[b], rank)
        self.cut = regex.compile(PATTERN)
        self.cut_ascii = re.compile(ASCII_PATTERN, re.ASCII)
        self.kinds = [("a", regex.compile(r"\p{L}")), ("1", regex.compile(r"\p{N}")), ("!", regex.compile(r"[^\s\p{L}\p{N}]"))]
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        special = sorted((t["content"] for t in rules["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.strings = special
        self.agreed: set[str] = set(map(chr, range(128)))
        self.disputed: set[str] = set()
        self.known = RecentTable(CACHE_PIECES)

    def count(self, text: str) -> int:
        """Tokens of ``text``; a special token's string is one."""
        if self.special is None or not any(s in text for s in self.strings):
            return self.plain(text)
        found, at = 0, 0
        for match in self.special.finditer(text):
            found += 1 + self.plain(text[at : match.start()])
            at = match.end()
        return found + self.plain(text[at:])

    def plain(self, text: str) -> int:
        if not text.isascii() and not self.alike(text):
            return sum(self.of_pieces([text[a:b]]) for _, (a, b) in self.split(text))
        cut = self.cut_ascii if text.isascii() else self.cut
        if len(text) <= SLICE_CHARS:
            return self.of_pieces(cut.findall(text))
        pieces = (m.group() for m in cut.finditer(text))
        return sum(iter(lambda: self.of_pieces(list(islice(pieces, SLICE_PIECES))), 0))

    def alike(self, text: str) -> bool:
        """Whether the pattern's library and the tokenizer's take all of the text's characters for the same kind.

        They follow different editions of Unicode.  A character that they dispute
        sends its text to the tokenizer's own cutting.
        """
        used = set(text)
        for char in used - self.agreed - self.disputed:
            kinds = [(bool(kind.match(char)), len(self.split(mate + char)) == 1) for mate, kind in self.kinds]
            (self.agreed if all(a == b for a, b in kinds) else self.disputed).add(char)
        return self.disputed.isdisjoint(used)

    def of_pieces(self, pieces: list[str]) -> int:
        table = self.known
        table.make_room()
        counts = list(map(table.new.get, pieces))
        if None in counts:
            known, older = table.new, table.old
            for k, n in enumerate(counts):
                if n is None:
                    piece = pieces[k]
                    n = known.get(piece) or older.get(piece)
                    if n is None:
                        data = piece.encode()
                        n = len(data) - self.merges(list(data))
                    if len(piece) <= CACHE_LENGTH:
                        known[piece] = n
                    counts[k] = n
        return sum(counts)

    def merges(self, symbol: list[int]) -> int:
        """Merges that ``symbol``, the bytes of a piece, goes through."""
        n, ranks, made, gone = len(symbol), self.ranks, self.made, self.gone
        width = 1 << n.bit_length()
        heap, at, left = [], 0, symbol[0]
        for right in symbol[1:]:
            rank = ranks[left].get(right)
            if rank is not None:
                heap.append(rank * width + at)
            left = right
            at += 1
        if not heap:
            return 0
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merged = 0
        while heap:
            rank, at = divmod(heappop(heap), width)
            right = after[at]
            if right >= n or ranks[symbol[at]].get(symbol[right]) != rank:
                continue
            merged += 1
            symbol[at] = new = made[rank]
            symbol[right] = gone
            after[at] = right = after[right]
            if right < n:
                before[right] = at
                rank = ranks[new].get(symbol[right])
                if rank is not None:
                    heappush(heap, rank * width + at)
            left = before[at]
            if left >= 0:
                rank = ranks[symbol[left]].get(new)
                if rank is not None:
                    heappush(heap, rank * width + left)
        return merged


def check_rules(rules: dict) -> None:
    """Raises ValueError for a file whose rules are not those of a plain byte-level merging tokenizer."""
    model, cutter = rules["model"], rules.get("pre_tokenizer") or {}
    wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    plain = (
        model.get("type") == "BPE" and not any(model.get(k) for k in odd) and rules.get("normalizer") is None
        and {k: cutter.get(k) for k in wanted} == wanted
        and not any(t[k] for t in rules["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    )
    if not plain:
        raise ValueError("counts need a byte-level merging tokenizer without further rules")


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, text: str = "text",
    names: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit"),
) -> DataFrame:
    """``docs`` with (n_bytes, n_tokens, over_limit), which replace columns of these names.

    Whole texts are counted where they lie, so nothing is shuffled and a lost task
    is a task done again.  A null or empty text has 0 bytes and 0 tokens; repeated
    rows give repeated results; special strings inside a text are special tokens,
    as is the tokenizer's default.  ``over_limit`` is true above ``limit`` tokens.
    The file at ``tokenizer_path`` is read by every task.
    """
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType([
        *kept, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.BooleanType()),
    ])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_by_worker(("token counter", tokenizer_path), lambda: Counter(tokenizer_path))
        for batch, texts in text_chunks(batches, text):
            tokens = pa.array([counter.count(t) for t in texts], pa.int64())
            n_bytes = pc.fill_null(pc.cast(pc.binary_length(batch.column(text)), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), n_bytes, tokens, pc.greater(tokens, limit)], names=schema.names
            )

    return small_batches(docs).mapInArrow(counted, schema)
