"""JSON exports.

An indented export starts every message with four blanks and ``{``, and ends it on
the same line or with a line of four blanks and ``}``.
A raw line break cannot occur inside a JSON string, so that line is a safe
record separator: the text source splits one large file over many tasks at
message borders.  ``read`` takes a file of any other layout, and one that only
looks like this, by its structure (``json_structure``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import js_trim, non_empty, u16_clip
from ..functions.clock import parse_timestamp
from ..functions.names import display_name
from ..functions.parts import media_token
from ..operators.skew import HOT_ROWS, join_dimension
from ..schema import JSON_EXPORT, JSON_EXPORT_HEAD, JSON_MESSAGE
from ..session import materialize
from . import json_structure
from .catalog import ROW_MASK, join_names, loadable

SEPARATOR = "\n    {"
MESSAGE_END = "\n    }"

# Message kinds that are system notifications.
SYSTEM_KINDS = (
    "RecipientAdd",
    "RecipientRemove",
    "Call",
    "ChannelNameChange",
    "ChannelIconChange",
    "ChannelPinnedMessage",
    "GuildMemberJoin",
    "ThreadCreated",
)

CORRUPT = "_corrupt_record"
#: Files of another layout up to this number are read by their names; with more, all files are read and theirs kept.
NAMED_FILES = 1000
PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def read_fragments(spark: SparkSession, *paths: str) -> DataFrame:
    """``file_id, pos, value``: the pieces of the files between separators."""
    src = spark.read.format("text").option("lineSep", SEPARATOR).option("recursiveFileLookup", True).load(list(paths))
    return with_positions(
        src.select("value", F.col("_metadata.file_path").alias("file_id"),
                   F.col("_metadata.file_block_start").alias("block"))
    )


def with_positions(rows: DataFrame) -> DataFrame:
    """Position inside the file from the block start and the row in the task."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_MASK))
    return rows.select("file_id", (F.col("block") + row).alias("pos"), "value")


def _is_split_head(value: Column) -> Column:
    return value.rlike(r'"messages"\s*:\s*\[\s*$')


def _is_document(value: Column) -> Column:
    return value.rlike(r"^\x{FEFF}?\s*[\{\[]")


def headers(fragments: DataFrame) -> DataFrame:
    """One row per file: channel, base name, dates, ``invalid`` and ``error``.

    A file is invalid when its JSON does not parse, when it has no message
    list, or when the document is cut off.
    """
    return _described(_line_heads(fragments))


def _line_heads(fragments: DataFrame) -> DataFrame:
    """``file_id, d, bad, lined``: the head, whether something doesn't parse, whether messages are on lines of their own."""
    v = F.col("value")
    head_text = F.when(_is_split_head(v), F.concat(v, F.lit("]}"))).otherwise(v)
    is_doc = _is_document(v)
    doc = F.from_json(
        head_text,
        f"{JSON_EXPORT_HEAD}, messages array<struct<id string>>, {CORRUPT} string",
        PERMISSIVE,
    )
    rest = _after_message(v)
    body = F.from_json(_message_text(v), f"id string, {CORRUPT} string", PERMISSIVE)
    h = fragments.select(
        "file_id",
        "pos",
        F.when(is_doc, F.col("pos")).alias("at"),
        F.when(is_doc, doc).alias("d"),
        F.when(is_doc, _is_split_head(v)).alias("lined"),
        F.when(~is_doc, body[CORRUPT].isNotNull()).alias("bad"),
        F.when(~is_doc, rest).alias("rest"),
    )
    h = h.groupBy("file_id").agg(
        F.min_by("d", "at").alias("d"),
        F.coalesce(F.min_by("lined", "at"), F.lit(False)).alias("lined"),
        F.bool_or("bad").alias("bad"),
        F.max_by("rest", "pos").alias("rest"),
    )
    bad = F.coalesce("bad", F.lit(False)) | ~F.coalesce(F.col("rest").rlike(r"(?s)^\s*\].*\}\s*$"), F.lit(True))
    return h.select("file_id", "d", bad.alias("bad"), "lined")


def _described(h: DataFrame) -> DataFrame:
    d = F.col("d")
    bad_json = d.isNull() | d[CORRUPT].isNotNull() | F.col("bad")
    error = F.when(bad_json, "Invalid JSON").when(d["messages"].isNull(), 'Missing a "messages" array.')
    channel = d["channel"]
    return h.select(
        "file_id",
        F.coalesce(non_empty(channel["id"]), F.lit("json-unknown")).alias("channel_id"),
        join_names(
            d["guild"]["name"],
            channel["category"],
            F.coalesce(non_empty(channel["name"]), F.lit("unknown")),
        ).alias("base_name"),
        F.substring(non_empty(d["dateRange"]["after"]), 1, 10).alias("after_date"),
        parse_timestamp(d["exportedAt"]).alias("exported_at"),
        error.isNotNull().alias("invalid"),
        error.alias("error"),
    )


def read(spark: SparkSession, *paths: str, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``(headers, messages)`` of all JSON files below ``paths``, whatever their layout.

    ``messages`` has ``file_id, msg_idx, m``.  ``where`` selects files by their
    ``file_id``.  Files are tried by lines first; those that are not laid out so, or
    don't parse so, are cut by their structure.
    """
    keep = F.lit(True) if where is None else where
    fragments = read_fragments(spark, *paths).where(keep)
    heads = materialize(_line_heads(fragments), "json-heads")
    d = F.col("d")
    fits = F.coalesce(F.col("lined") & ~F.col("bad") & d[CORRUPT].isNull() & d.isNotNull(), F.lit(False))
    others = heads.where(~fits).select("file_id")
    names = [r["file_id"] for r in others.limit(NAMED_FILES + 1).collect()]
    if not names:
        return _described(heads), explode_messages(fragments)
    regular = explode_messages(fragments).join(heads.where(fits).select("file_id"), "file_id", "left_semi")
    if len(names) <= NAMED_FILES:
        braces = json_structure.read_braces(spark, *map(loadable, names))
    else:
        braces = json_structure.read_braces(spark, *paths).where(keep).join(others, "file_id", "left_semi")
    messages, frames = json_structure.pieces(spark, braces)
    elements, found = json_structure.parsed(messages, frames)
    described = _described(heads.where(fits).select("file_id", "d", "bad").unionByName(found))
    return described, regular.unionByName(elements)


def _first_line(value: Column) -> Column:
    return F.substring_index(value, "\n", 1)


def _on_one_line(value: Column) -> Column:
    """Whether the message ends on the line that it starts on."""
    return _first_line(value).rlike(r"\}\s*,?\s*$")


def _message_text(value: Column) -> Column:
    one = F.concat(F.lit("{"), F.regexp_replace(_first_line(value), r",\s*$", ""))
    many = F.concat(F.lit("{"), F.substring_index(value, MESSAGE_END, 1), F.lit("}"))
    return F.when(_on_one_line(value), one).otherwise(many)


def _after_message(value: Column) -> Column:
    at = F.position(F.lit(MESSAGE_END), value)
    many = F.substring(value, at + len(MESSAGE_END), F.length(value))
    one = F.substring(value, F.length(_first_line(value)) + 1, F.length(value))
    return F.when(_on_one_line(value), one).otherwise(many)


def explode_messages(fragments: DataFrame) -> DataFrame:
    """``file_id, msg_idx, m``: one row per message element."""
    v = F.col("value")
    is_doc = _is_document(v)
    one = F.from_json(_message_text(v), JSON_MESSAGE)
    many = F.from_json(v, JSON_EXPORT)["messages"]
    elements = F.when(is_doc & ~_is_split_head(v), many).when(~is_doc, F.array(one))
    return fragments.select(
        "file_id", "pos", F.posexplode(elements).alias("i", "m")
    ).select("file_id", (F.col("pos") + F.col("i")).alias("msg_idx"), "m")


def embed_token(embed: Column) -> Column:
    title = js_trim(F.coalesce(embed["title"], F.lit("")))

    def token(kind: str, fallback: str) -> Column:
        return F.concat(F.lit(f"[{kind}: "), F.coalesce(non_empty(title), F.lit(fallback)), F.lit("]"))

    return (
        F.when(non_empty(embed["video"]["url"]).isNotNull(), token("VID", "Embedded Video"))
        .when(embed["url"].rlike(r"(?i)youtube\.com|youtu\.be"), token("YT", "Video"))
        .when(title != "", F.concat(F.lit("[EMBED: "), title, F.lit("]")))
    )


def reaction_token(emoji: Column, count: Column) -> Column:
    return F.concat_ws(
        ":", F.coalesce(emoji, F.lit("?")), F.coalesce(count, F.lit(1)).cast("string")
    )


def _files_of(attachments: Column) -> Column:
    named = F.filter(attachments, lambda a: a["fileName"] != "")
    tokens = F.transform(named, lambda a: media_token(a["fileName"]))
    return F.coalesce(tokens, F.array().cast("array<string>"))


def message_parts(m: Column) -> Column:
    """Text, forwarded text, forwarded files, files, embeds, sticker."""
    empty = F.array().cast("array<string>")

    def text(c: Column) -> Column:
        t = js_trim(F.coalesce(c, F.lit("")))
        return F.when(t != "", F.array(t)).otherwise(empty)

    fwd = m["forwardedMessage"]
    embeds = F.filter(F.transform(m["embeds"], embed_token), lambda t: t.isNotNull())
    sticker = F.when(F.coalesce(F.size(m["stickers"]), F.lit(0)) > 0, F.array(F.lit("[STICKER]")))
    return F.concat(
        text(m["content"]),
        text(fwd["content"]),
        _files_of(fwd["attachments"]),
        _files_of(m["attachments"]),
        F.coalesce(embeds, empty),
        F.coalesce(sticker, empty),
    )


def message_reactions(m: Column) -> Column:
    items = F.transform(m["reactions"], lambda r: reaction_token(r["emoji"]["name"], r["count"]))
    return F.when(
        F.size(m["reactions"]) > 0,
        F.concat(F.lit("^{"), F.array_join(items, ", "), F.lit("}")),
    )


def to_raw_messages(messages: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Message elements to raw messages, replies resolved inside each file."""
    m = F.col("m")
    flat = messages.select(
        "file_id",
        "msg_idx",
        F.lit("json").alias("format"),
        m["id"].alias("__id"),
        m["author"]["id"].alias("author_key"),
        display_name(m["author"]["nickname"], m["author"]["name"]).alias("author_name"),
        non_empty(js_trim(m["author"]["name"])).alias("author_username"),
        parse_timestamp(m["timestamp"]).alias("ts"),
        m["type"].isin(*SYSTEM_KINDS).alias("is_system"),
        F.when(m["type"] == "Reply", non_empty(m["reference"]["messageId"])).alias("reply_to_message_id"),
        message_parts(m).alias("parts"),
        message_reactions(m).alias("reactions"),
        js_trim(F.regexp_replace(F.coalesce(m["content"], F.lit("")), "\n", " ")).alias("__flat"),
    )
    snip = F.coalesce(non_empty(u16_clip(F.col("__flat"), 80, "…")), F.lit("…"))
    target = flat.where(F.col("__id").isNotNull()).groupBy(
        "file_id", F.col("__id").alias("reply_to_message_id")
    ).agg(
        # the last duplicate of an id is the one a reply sees
        F.max_by(F.struct(
            non_empty(F.col("author_key")).alias("k"), F.col("author_name").alias("n"), snip.alias("s")
        ), "msg_idx").alias("__ref")
    )
    joined = join_dimension(
        flat, target, ["file_id", "reply_to_message_id"], ["msg_idx"], hot_rows=hot_rows
    )
    out = joined.select(
        "file_id",
        "msg_idx",
        "format",
        non_empty(F.col("__id")).alias("message_id"),
        non_empty(F.col("author_key")).alias("author_key"),
        "author_name",
        "author_username",
        "ts",
        F.coalesce("is_system", F.lit(False)).alias("is_system"),
        F.col("__ref.k").alias("reply_to_key"),
        "reply_to_message_id",
        F.col("__ref.n").alias("reply_to_name"),
        F.col("__ref.s").alias("reply_snippet"),
        "parts",
        "reactions",
    )
    has_body = (F.size("parts") > 0) | F.col("reply_to_name").isNotNull() | F.col("reactions").isNotNull()
    return out.where(F.col("ts").isNotNull() & has_body)


def scan(fragments: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Raw messages of files in the line layout, or of documents small enough to be one record each."""
    return to_raw_messages(explode_messages(fragments), hot_rows)
