"""HTML exports.

The text source cuts a file at the class name of its message groups, wherever it
stands, so one large file is read by many tasks.  Whether a cut opens a group is
decided by content: the tag that the cut falls into must be unfinished there and
be inside its class attribute.  A cut anywhere else (in text, in a style, in
another attribute) is undone by feeding on.  What a block of the file has before
its first opening, and its last group, may belong together with other blocks'
edges; they are written out as they are and glued in a second, small step.

Python takes the markup apart (``html.parser``, in bounded batches); ids, times,
tokens and reply rules are Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import js_trim, non_empty, u16_clip
from ..functions.clock import parse_title_time, snowflake_to_ts
from ..functions.parts import media_token, url_file_name
from ..operators.ordered import MAX_GROUP_ROWS, running_sum, slice_groups
from ..session import materialize, small_batches

GROUP = "chatlog__message-group"
BOX = "chatlog__message-container"
#: An unfinished tag up to the start of a name in its class attribute.
BEFORE_NAME = re.compile(
    r"""<[a-z](?:[^"'>]|"[^"]*"|'[^']*')*?[\s"'/]class\s*=\s*(?:"(?:[^"]*\s)?|'(?:[^']*\s)?|)$""", re.IGNORECASE
)
AFTER_NAME = re.compile(r"[\s\"'/>]")
ROWS = 2000

PLACEHOLDERS = ("Click to see original", "Click to see attachment")  # fixed values
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

MARKUP = (
    "file_id string, msg_idx bigint, group_author string, group_key string, group_username string,"
    " data_id string, element_id string, title string, system_text string, body string,"
    " reply_author string, reply_link string, reply_body string,"
    " files array<string>, embeds array<struct<video boolean, provider string, title string>>,"
    " sticker boolean, reactions array<struct<emoji string, n string>>"
)
EDGE = "block bigint, edge string, text string, n bigint"


class _Node:
    __slots__ = ("tag", "attrs", "classes", "items")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs = tag, attrs
        self.classes = (attrs.get("class") or "").split()
        self.items: list = []

    def walk(self) -> Iterator[_Node]:
        stack = [x for x in reversed(self.items) if isinstance(x, _Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.items) if isinstance(x, _Node))

    def all(self, cls: str) -> list[_Node]:
        return [n for n in self.walk() if cls in n.classes]

    def one(self, *classes: str) -> _Node | None:
        return next((n for n in self.walk() if any(c in n.classes for c in classes)), None)

    def tagged(self, *tags: str) -> _Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def text(self) -> str:
        out, stack = [], list(reversed(self.items))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            else:
                stack.extend(reversed(item.items))
        return "".join(out).strip()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs))
        self.open[-1].items.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].items.append(_Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.open[-1].items.append(data)


def _text(node: _Node | None) -> str | None:
    return None if node is None else node.text()


def _take_apart(tree: _Tree) -> Iterator[tuple]:
    """Message rows of a group, which is the first element of its tree; the position is added by the caller."""
    tree.close()
    group = next(x for x in tree.root.items if isinstance(x, _Node))
    author = group.one("chatlog__author") or group.one("chatlog__system-notification-author")
    who = author.attrs if author else {}
    for box in group.all(BOX):
        stamp = box.one(
            "chatlog__timestamp", "chatlog__short-timestamp", "chatlog__system-notification-timestamp"
        )
        reply = box.one("chatlog__reply")
        link = reply.one("chatlog__reply-link") if reply else None
        files = []
        for a in box.all("chatlog__attachment"):
            inner = a.tagged("img", "video")
            files.append(a.attrs.get("href") or (inner.attrs.get("src") if inner else None) or "")
        embeds = [
            (e.tagged("video") is not None, _text(e.one("chatlog__embed-provider")),
             _text(e.one("chatlog__embed-title")))
            for e in box.all("chatlog__embed")
        ]
        reacts = []
        for r in box.all("chatlog__reaction"):
            img = r.tagged("img")
            reacts.append(((img.attrs.get("alt") or "") if img else "?",
                           _text(r.one("chatlog__reaction-count"))))
        yield (
            _text(author), who.get("data-user-id"), who.get("title"),
            box.attrs.get("data-message-id"), box.attrs.get("id"),
            stamp.attrs.get("title") if stamp else None,
            _text(box.one("chatlog__system-notification-content")),
            _text(box.one("chatlog__markdown-preserve")),
            _text(reply.one("chatlog__reply-author")) if reply else None,
            link.attrs.get("onclick") if link else None,
            _text(reply.one("chatlog__reply-content")) if reply else None,
            files, embeds, box.one("chatlog__sticker") is not None, reacts,
        )


MARKUP_COLUMNS = [c.split()[0] for c in MARKUP.replace("struct<video boolean, provider string, title string>", "x")
                  .replace("struct<emoji string, n string>", "x").split(", ")]
EDGE_COLUMNS = [c.split()[0] for c in EDGE.split(", ")]


def _groups(records: Iterable[str], from_start: bool) -> Iterator[tuple[str, _Tree, list[str], int]]:
    """(kind, tree, raw pieces, cut that opened it) of what a run of records holds, in order.

    Before each record but a file's first stands the group's name.  Kinds: ``head``,
    what comes before the first opening where the run is not ``from_start`` of a
    file; ``group``; and ``tail``, the last group, which may go on after the run.
    """
    tree, pieces, opened, at = _Tree(), [], False, 0
    for k, record in enumerate(records):
        text = record if k == 0 and from_start else GROUP + record
        unfinished = tree.rawdata
        if k and BEFORE_NAME.match(unfinished) and AFTER_NAME.match(record):
            before = "".join(pieces)
            pieces = [before[: len(before) - len(unfinished)]]
            if opened:
                yield "group", tree, pieces, at
            elif not from_start:
                yield "head", tree, pieces, at
            tree, pieces, opened, at = _Tree(), [], True, k
            text = unfinished + text
        tree.feed(text)
        pieces.append(text)
    if opened:
        yield "tail", tree, pieces, at
    elif not from_start and pieces:
        yield "head", tree, pieces, at


def _frames(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows in frames of a bounded number."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield _frame(held, columns)
            held = []
    if held:
        yield _frame(held, columns)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    out["embeds"] = [[dict(zip(("video", "provider", "title"), e)) for e in es or ()] for es in out["embeds"]]
    out["reactions"] = [[dict(zip(("emoji", "n"), r)) for r in rs or ()] for rs in out["reactions"]]
    return out


NO_MARKUP = (None,) * (len(MARKUP_COLUMNS) - 1)
NO_EDGE = (None,) * len(EDGE_COLUMNS)


def _parse_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Message rows of the groups that lie inside a block, and the block's edges.

    A message's position is its block's start plus the messages of the block
    before it.  Every message has the name of its box, which is many bytes long,
    so positions stay below the start of the next block that opens a group.
    """

    def rows() -> Iterator[tuple]:
        lines = (r for batch in batches for r in zip(batch["file_id"], batch["block"], batch["value"]))
        for (file_id, block), run in groupby(lines, key=lambda r: r[:2]):
            n = 0
            for kind, tree, pieces, _ in _groups((r[2] for r in run), block == 0):
                if kind == "group":
                    for row in _take_apart(tree):
                        yield (file_id, block + n, *row, *NO_EDGE)
                        n += 1
                    continue
                text = "".join(pieces)
                yield (file_id, *NO_MARKUP, block, kind, text, n)
                n += text.count(BOX)

    yield from _frames(rows(), MARKUP_COLUMNS + EDGE_COLUMNS)


def _parse_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Message rows of glued edges: a block's tail and the heads that follow it."""

    def rows() -> Iterator[tuple]:
        lines = (r for batch in batches for r in zip(batch["file_id"], batch["run"], batch["block"], batch["text"], batch["n"]))
        for (file_id, _), run in groupby(lines, key=lambda r: r[:2]):
            parts = list(run)
            # which part each cut lies in: numbers of cuts up to the end of every part
            cuts, next_free = [], [block + n for _, _, block, _, n in parts]
            for _, _, _, text, _ in parts:
                cuts.append((cuts[-1] if cuts else 0) + text.count(GROUP))
            for _, tree, _, at in _groups("".join(p[3] for p in parts).split(GROUP), True):
                part = next(k for k, upto in enumerate(cuts) if at <= upto)
                for row in _take_apart(tree):
                    yield (file_id, next_free[part], *row)
                    next_free[part] += 1

    yield from _frames(rows(), MARKUP_COLUMNS)


def read_fragments(spark: SparkSession, *paths: str) -> DataFrame:
    """``file_id, block, value``: the pieces of the files between the groups' class names, in order inside a task."""
    rows = spark.read.format("text").option("lineSep", GROUP).option("recursiveFileLookup", True).load(list(paths))
    return rows.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"), "value")


def markup(fragments: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """One row per message box with its markup taken apart; written out, since the edges are read again.

    A glued run is as large as the group that spans blocks, however many there are.
    """
    layer = materialize(small_batches(fragments).mapInPandas(_parse_blocks, f"{MARKUP}, {EDGE}"), "html-markup")
    edges = layer.where("edge IS NOT NULL").select("file_id", *EDGE_COLUMNS)
    place = slice_groups(edges.select("file_id", "block", "edge"), ["file_id"], ["block", "edge"], max_rows)
    place = running_sum(place, F.when(F.col("edge") == "tail", 1).otherwise(0), "run").result()
    runs = edges.join(place, ["file_id", "block", "edge"]).where("run > 0")
    parts = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["file_id", "run"]
    glued = (
        runs.repartition(parts, *keys).sortWithinPartitions(*keys, "block", "edge").select(*keys, "block", "text", "n")
        .mapInPandas(_parse_runs, MARKUP)
    )
    return layer.where("edge IS NULL").select(*MARKUP_COLUMNS).unionByName(glued)


def _embed_token(e: Column) -> Column:
    title = e["title"]
    yt = F.concat(F.lit("[YT: "), F.coalesce(title, F.lit("Video")), F.lit("]"))
    return (
        F.when(e["video"], F.lit("[VID: Embedded Video]"))
        .when(e["provider"].contains("YouTube"), yt)
        .when(title.isNotNull(), F.concat(F.lit("[EMBED: "), title, F.lit("]")))
    )


def to_raw_messages(markup: DataFrame, tz: str = "UTC") -> DataFrame:
    c = F.col
    legacy = F.when(
        c("element_id").startswith("message-"), F.substring("element_id", 9, 1 << 20)
    ).otherwise(non_empty(c("element_id")))
    message_id = F.coalesce(non_empty(c("data_id")), legacy)
    ts = F.coalesce(snowflake_to_ts(message_id), parse_title_time(non_empty(c("title")), tz))
    raw_snip = F.regexp_replace("reply_body", "\n", " ")
    hidden = raw_snip.contains(PLACEHOLDERS[0]) | raw_snip.contains(PLACEHOLDERS[1])
    snip = F.when((raw_snip != "") & ~hidden, u16_clip(raw_snip, 80, "…")).otherwise(F.lit("…"))
    is_reply = c("reply_author").isNotNull()
    reply_id = non_empty(F.regexp_extract("reply_link", r"(\d{17,21})", 1))
    empty = F.array().cast("array<string>")
    content = F.when(
        c("system_text").isNotNull(), F.array(F.concat(F.lit("["), c("system_text"), F.lit("]")))
    ).when(c("body") != "", F.array(c("body"))).otherwise(empty)
    links = F.filter("files", lambda f: f != "")
    parts = F.concat(
        content,
        F.transform(links, lambda f: media_token(url_file_name(f))),
        F.filter(F.transform("embeds", _embed_token), lambda t: t.isNotNull()),
        F.when(c("sticker"), F.array(F.lit("[STICKER]"))).otherwise(empty),
    )
    reacts = F.transform("reactions", lambda r: F.concat_ws(":", r["emoji"], F.coalesce(r["n"], F.lit("1"))))
    none = F.lit(None).cast("string")
    out = markup.select(
        "file_id",
        "msg_idx",
        F.lit("html").alias("format"),
        message_id.alias("message_id"),
        non_empty(c("group_key")).alias("author_key"),
        F.coalesce("group_author", F.lit("Unknown")).alias("author_name"),
        non_empty(js_trim(c("group_username"))).alias("author_username"),
        ts.alias("ts"),
        c("system_text").isNotNull().alias("is_system"),
        none.alias("reply_to_key"),
        F.when(is_reply, reply_id).alias("reply_to_message_id"),
        c("reply_author").alias("reply_to_name"),
        F.when(is_reply, F.coalesce(snip, F.lit("…"))).alias("reply_snippet"),
        parts.alias("parts"),
        F.when(
            F.size("reactions") > 0, F.concat(F.lit("^{"), F.array_join(reacts, ", "), F.lit("}"))
        ).alias("reactions"),
    )
    has_body = (F.size("parts") > 0) | F.col("reply_to_name").isNotNull() | F.col("reactions").isNotNull()
    return out.where(F.col("ts").isNotNull() & has_body)


def scan(fragments: DataFrame, tz: str = "UTC", max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    return to_raw_messages(markup(fragments, max_rows), tz)
