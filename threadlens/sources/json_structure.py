"""JSON documents of any layout and size, cut by structure.

The text source cuts a file at every opening brace.  What lies inside a string and
how deep a place is nested depends on all that comes before it, so a first pass
sums up each block of a file: its number of quotes, and its change of depth for a
start outside and inside a string.  These sums are carried from block to block, one
small row each, and a second pass then cuts every block knowing the state at its
start.  A message that goes on in the next block is glued from the blocks' edges.
The rest, without the messages, is the file's frame and must be JSON itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import MAX_GROUP_ROWS, running_sum, slice_groups
from ..schema import JSON_EXPORT_HEAD, JSON_MESSAGE
from ..session import materialize, small_batches

ROWS = 2000
BEFORE, INSIDE, BEHIND = 0, 1, 2  # the array of messages
SHAPE = "file_id string, block bigint, quotes bigint, even bigint, odd bigint, opens array<struct<odd bigint, even_depth bigint, odd_depth bigint, even_low bigint, odd_low bigint>>, even_low bigint, odd_low bigint"
STATE = "file_id string, block bigint, quoted boolean, depth bigint, mode int, seen boolean"
PIECE = "file_id string, kind string, block bigint, n bigint, text string, bad boolean"


def read_braces(spark: SparkSession, *paths: str) -> DataFrame:
    """``file_id, block, row, value``: the pieces of the files between opening braces, in order inside a task."""
    rows = spark.read.format("text").option("lineSep", "{").option("recursiveFileLookup", True).load(list(paths))
    return rows.select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value",
    )


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, bytes]]:
    """The text of every run of rows of one block in a batch, with the braces back in place."""
    seen: dict = {}
    for batch in batches:
        keys = [c for c in batch.columns if c not in ("row", "value")]
        for key, run in groupby(zip(*(batch[k] for k in keys), batch["value"]), key=lambda r: r[:-1]):
            text = "{".join(r[-1] for r in run)
            first_of_file = key[1] == 0 and seen.get("last") != key[:2]
            seen["last"] = key[:2]
            yield key, (text if first_of_file else "{" + text).encode()


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of quotes that no backslash escapes, places of brackets, their steps of depth)."""
    raw = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(raw == 0x22)
    after = quotes[(quotes > 0) & (raw[np.maximum(quotes, 1) - 1] == 0x5C)]
    escaped = []
    for at in after.tolist():
        start = at
        while start and data[start - 1] == 0x5C:
            start -= 1
        if (at - start) % 2:
            escaped.append(at)
    if escaped:
        quotes = quotes[~np.isin(quotes, escaped)]
    folded = raw | 0x20  # [ and {, ] and } differ in this bit alone
    opening, closing = folded == 0x7B, folded == 0x7D
    brackets = np.flatnonzero(opening | closing)
    return quotes, brackets, np.where(opening[brackets], 1, -1)


def _named(data: bytes, at: int) -> bool:
    """Whether the bracket at ``at`` is the value of a key named messages."""
    end = at
    for wanted in (b":", b'"messages"'):
        while end and data[end - 1] in b" \t\r\n":
            end -= 1
        if data[max(0, end - len(wanted)) : end] != wanted:
            return False
        end -= len(wanted)
    return True


def _shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of every block.  A place is even or odd by the quotes between the block's start and it."""
    rows = []
    for (file_id, block), run in groupby(_joined(batches), key=lambda r: (r[0][0], r[0][1])):
        quotes, depth, low, opens = 0, [0, 0], [0, 0], []
        for _, data in run:
            marks, brackets, steps = _marks(data)
            side = (quotes + np.searchsorted(marks, brackets)) % 2
            ways = [depth[s] + np.cumsum(np.where(side == s, steps, 0)) for s in (0, 1)]
            for o in opens:  # what is behind them goes on here
                for s in (0, 1):
                    o[3 + s] = min(o[3 + s], int(ways[s].min(initial=o[3 + s])))
            for k in np.flatnonzero(steps > 0).tolist():
                at = int(brackets[k])
                if data[at] == 0x5B and _named(data, at):
                    opens.append([int(side[k]), *(int(w[k]) for w in ways), *(int(w[k:].min()) for w in ways)])
            if len(steps):
                low = [min(low[s], int(ways[s].min())) for s in (0, 1)]
                depth = [int(w[-1]) for w in ways]
            quotes += len(marks)
        rows.append((file_id, block, quotes, *depth, opens, *low))
    if not rows:
        return
    names = [c.strip().split()[0] for c in SHAPE.split(", opens")[0].split(",")]
    out = pd.DataFrame(rows, columns=[*names, "opens", "even_low", "odd_low"])
    fields = ("odd", "even_depth", "odd_depth", "even_low", "odd_low")
    out["opens"] = [[dict(zip(fields, o)) for o in os] for os in out["opens"]]
    yield out


def _states(shapes: pd.DataFrame) -> pd.DataFrame:
    """State at the start of every block of one file, from the sums of the blocks before it."""
    quoted, depth, mode, seen, rows = 0, 0, BEFORE, False, []
    for r in shapes.sort_values("block").itertuples():
        rows.append((r.file_id, r.block, bool(quoted), depth, mode, seen))
        outside = "odd" if quoted else "even"
        low = getattr(r, f"{outside}_low")
        if mode == INSIDE and depth + low < 2:
            mode = BEHIND
        if mode == BEFORE:
            for o in r.opens:
                if o["odd"] == quoted and depth + o[f"{outside}_depth"] == 2:
                    mode = BEHIND if depth + o[f"{outside}_low"] < 2 else INSIDE
                    break
        seen = mode == INSIDE
        depth += getattr(r, outside)
        quoted = (quoted + r.quotes) % 2
    return pd.DataFrame(rows, columns=[c.split()[0] for c in STATE.split(", ")])


def states(braces: DataFrame) -> DataFrame:
    """``file_id, block, quoted, depth, mode, seen``: what holds at the start of every block.

    A file has one row of sums per block, so a task that follows one file reads
    a row for every 128 MB (or what the block size is) of it.
    """
    shapes = small_batches(braces.select("file_id", "block", "value")).mapInPandas(_shapes, SHAPE)
    # A block is read by one task, but may come in several batches.
    return shapes.groupBy("file_id").applyInPandas(_states, STATE)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Messages, edges and the frame's pieces of blocks whose state is known."""
    held: list[tuple] = []
    for key, run in groupby(_joined(batches), key=lambda r: r[0]):
        held.extend(_cut_block(key, (data for _, data in run)))
        while len(held) >= ROWS:
            yield pd.DataFrame(held[:ROWS], columns=[c.split()[0] for c in PIECE.split(", ")])
            held = held[ROWS:]
    if held:
        yield pd.DataFrame(held, columns=[c.split()[0] for c in PIECE.split(", ")])


def _cut_block(key: tuple, parts: Iterable[bytes]) -> Iterator[tuple]:
    file_id, block, quoted, depth, mode, seen = key
    quoted, depth, mode = int(quoted), int(depth), int(mode)
    pending: list[bytes] = []
    started = n = 0  # messages that start in this block, pieces of the frame
    kind = "head" if mode == INSIDE and depth > 2 else "message"
    bad = False
    checked = mode == INSIDE and depth == 2  # the gap before the first message lies in the block before

    def text(last: bytes) -> str:
        out = b"".join([*pending, last]).decode("utf-8", "replace")
        pending.clear()
        return out

    for data in parts:
        marks, brackets, steps = _marks(data)
        clear = (quoted + np.searchsorted(marks, brackets)) % 2 == 0
        brackets, steps = brackets[clear], steps[clear]
        after = depth + np.cumsum(steps)
        before = after - steps
        last = 0
        for k in np.flatnonzero((before <= 2) | (after <= 2)).tolist():
            at, char = int(brackets[k]), data[brackets[k]]
            if mode == BEFORE and char == 0x5B and before[k] == 1 and _named(data, at):
                yield file_id, "frame", block, n, text(data[last : at + 1]), bad
                n, mode, last = n + 1, INSIDE, at + 1
            elif mode == INSIDE and before[k] == 2 and steps[k] > 0:
                gap = text(data[last:at]).strip()
                bad |= gap != ("," if seen and not checked else "") or char != 0x7B
                seen, checked, last, kind = True, False, at, "message"
                started += 1
            elif mode == INSIDE and after[k] == 2 and steps[k] < 0:
                whole = text(data[last : at + 1])
                yield file_id, kind, block, started - (kind == "message"), whole, bad or char != 0x7D
                last = at + 1
            elif mode == INSIDE and after[k] == 1:
                bad |= bool(text(data[last:at]).strip()) or char != 0x5D
                mode, last = BEHIND, at
            bad |= bool(after[k] < 0)
        pending.append(data[last:])
        if len(after):
            depth = int(after[-1])
        quoted = (quoted + len(marks)) % 2
    rest = text(b"")
    if mode != INSIDE:
        yield file_id, "frame", block, n, rest, bad
    elif depth > 2:
        # The block ends inside a message: one of its own, or one that came in.
        yield file_id, "tail" if kind == "message" else "head", block, max(started - 1, 0), rest, bad
    else:
        # The next block begins with a brace, which opens a message.
        bad |= rest.strip() != ("," if seen else "")
        yield file_id, "frame", block, n, "", bad


def pieces(spark: SparkSession, braces: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """(``file_id, msg_idx, text, bad`` of every message, ``file_id, frame, bad`` of every file).

    Positions are a block's start plus the messages that start in it before.
    """
    known = materialize(states(braces), "json-states")
    keyed = braces.join(known, ["file_id", "block"]).sortWithinPartitions("file_id", "block", "row")
    keyed = keyed.select("file_id", "block", "quoted", "depth", "mode", "seen", "value")
    layer = materialize(small_batches(keyed).mapInPandas(_cut, PIECE), "json-pieces")
    edges = layer.where("kind IN ('head', 'tail')")
    place = slice_groups(edges.select("file_id", "block", "kind"), ["file_id"], ["block", "kind"], max_rows)
    place = running_sum(place, F.when(F.col("kind") == "tail", 1).otherwise(0), "run").result()
    parts = F.array_sort(F.collect_list(F.struct("block", "kind", "text")))
    glued = edges.join(place, ["file_id", "block", "kind"]).groupBy("file_id", "run").agg(
        F.min_by(F.col("block") + F.col("n"), "block").alias("msg_idx"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.bool_or(F.col("bad") | (F.col("run") == 0)).alias("bad"),
    ).select("file_id", "msg_idx", "text", "bad")
    whole = layer.where("kind = 'message'").select("file_id", (F.col("block") + F.col("n")).alias("msg_idx"), "text", "bad")
    frame_parts = F.array_sort(F.collect_list(F.struct("block", "n", "text")))
    frames = layer.where("kind = 'frame'").groupBy("file_id").agg(
        F.array_join(F.transform(frame_parts, lambda p: p["text"]), "").alias("frame"), F.bool_or("bad").alias("bad")
    )
    return whole.unionByName(glued), frames


def parsed(messages: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``file_id, msg_idx, m``, ``file_id, d, bad``): elements and heads of the files; ``bad`` where something isn't JSON."""
    corrupt = "_corrupt_record"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    inner = JSON_MESSAGE[len("struct<") : -1]
    read = messages.withColumn("p", F.from_json("text", f"{inner}, {corrupt} string", options))
    elements = messages.select("file_id", "msg_idx", F.from_json("text", JSON_MESSAGE).alias("m"))
    spoiled = read.groupBy("file_id").agg(F.bool_or(F.col("bad") | F.col("p").isNull() | F.col("p")[corrupt].isNotNull()).alias("spoiled"))
    head = F.from_json(F.regexp_replace("frame", r"^\x{FEFF}", ""), f"{JSON_EXPORT_HEAD}, messages array<struct<id string>>, {corrupt} string", options)
    heads = frames.withColumn("d", head).join(spoiled, "file_id", "left").select(
        "file_id", "d", (F.col("bad") | F.coalesce("spoiled", F.lit(False))).alias("bad")
    )
    return elements, heads
