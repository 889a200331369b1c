"""Plain-text exports: a line format read with windows instead of a loop.

Every line gets its position in the file.  A header line opens a message; all
lines up to the next header belong to it.  The blocks a large file is read in
serve as slices, so the header of a line is found without sorting a whole file
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.chars import WS, js_trim, non_empty
from ..functions.clock import parse_timestamp
from ..functions.parts import media_token
from ..operators.ordered import SLICE, Ordered, last_known
from .catalog import ROW_MASK

# Line shapes of the format (US clock only).
HEADER = (
    rf"^\[(\d{{1,2}}/\d{{1,2}}/\d{{4}}[{WS}]+\d{{1,2}}:\d{{2}}[{WS}]+[AP]M)\][{WS}]+(.+)$"
)
RULE = r"^={40,}$"
BLOCKS = {
    "{Embed}": "embed",
    "{Attachments}": "attachments",
    "{Stickers}": "stickers",
    "{Reactions}": "reactions",
    "{Reply}": "text",
    "{Forwarded Message}": "text",
}
SYSTEM_TEXTS = (
    r"^Pinned a message\.?$",
    r"joined the server\.?$",
    r"left the server\.?$",
    r"^Started a thread",
    r"boosted the server",
    r"^Changed the channel",
    r"^Added .+ to the group",
    r"^Removed .+ from the group",
)


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """``file_id, block, pos, line``"""
    rows = spark.read.format("text").option("lineSep", "\n").option("recursiveFileLookup", True).load(list(paths)).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_MASK))
    return rows.withColumn("pos", F.col("block") + row)


def headers(lines: DataFrame) -> DataFrame:
    """Channel from the ``Guild:`` and ``Channel:`` lines among the first ten.

    The rank is cut at ten before the shuffle.
    """
    w = W.partitionBy("file_id").orderBy("pos")
    top = lines.where("block = 0").withColumn("__n", F.row_number().over(w)).where("__n <= 10")

    def field(name: str) -> Column:
        shape = rf"^{name}:[{WS}]*(.+)"
        hit = F.when(F.col("line").rlike(shape), F.col("pos"))
        value = js_trim(F.regexp_extract("line", shape, 1))
        return F.coalesce(F.max_by(value, hit), F.lit(""))

    h = top.groupBy("file_id").agg(field("Guild").alias("guild"), field("Channel").alias("chan"))
    short = js_trim(F.substring_index("chan", "/", -1))
    short = F.coalesce(non_empty(short), non_empty(F.col("chan")), F.lit("unknown"))
    known = (F.col("guild") != "") | (F.col("chan") != "")
    return h.select(
        "file_id",
        F.when(known, F.concat_ws("|", "guild", "chan")).otherwise(F.lit("txt-unknown")).alias("channel_id"),
        F.concat(
            F.when(F.col("guild") != "", F.concat("guild", F.lit(" - "))).otherwise(F.lit("")), short
        ).alias("base_name"),
        F.lit(None).cast("string").alias("after_date"),
        F.lit(None).cast("timestamp").alias("exported_at"),
        F.lit(False).alias("invalid"),
        F.lit(None).cast("string").alias("error"),
    )


def attachment_token(url: Column) -> Column:
    """Media token of a link; what does not parse as a link is unknown media."""
    path = F.regexp_replace(F.regexp_replace(url, r"^https?://[^/?#]*", ""), r"[?#].*$", "")
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    name = F.substring_index(F.substring_index(decoded, "/", -1), "?", 1)
    valid = url.rlike(rf"^https?://[^/?#{WS}]+") & decoded.isNotNull()
    return F.when(valid, media_token(name, blank_is_media=False)).otherwise(F.lit("[MEDIA: unknown]"))


def is_system_text(parts: Column) -> Column:
    text = js_trim(F.get(parts, F.lit(0)))
    hit = F.lit(False)
    for shape in SYSTEM_TEXTS:
        hit = hit | text.rlike("(?i)" + shape)
    return (F.size(parts) == 1) & hit


def scan(lines: DataFrame, tz: str = "UTC") -> DataFrame:
    """Lines to raw messages; clock times are read in zone ``tz``."""
    line = F.col("line")
    flagged = lines.withColumn("__head", F.when(line.rlike(HEADER), F.col("pos")))
    o = Ordered(flagged.withColumnRenamed("block", SLICE), ("file_id",), ("pos",), sliced=True)
    owned = last_known(o, F.col("__head"), "head").result().where(F.col("head").isNotNull())

    # From here on a group is one message.
    trimmed = js_trim(line)
    block = F.create_map(*[F.lit(x) for kv in BLOCKS.items() for x in kv])
    owned = owned.withColumn("__t", trimmed)
    marker = F.try_element_at(block, F.col("__t"))
    mark = F.when(F.col("__t") == "", F.lit("text")).otherwise(marker)
    body = owned.withColumn("__mark", mark).withColumn("__rule", F.col("__t").rlike(RULE))
    inside = W.partitionBy("file_id", "head").orderBy("pos")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    is_head = F.col("pos") == F.col("head")
    body = body.withColumn("mode", F.coalesce(F.last("__mark", ignorenulls=True).over(before), F.lit("text")))
    body = body.withColumn("closed", F.max("__rule").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    body = body.where(is_head | ~F.col("closed"))
    marker_line = F.col("__mark").isNotNull() & (F.col("__t") != "")
    plain = ~is_head & ~marker_line

    def collected(cond: Column, value: str) -> Column:
        rows = F.collect_list(F.when(plain & cond, F.struct("pos", F.col(value).alias("v"))))
        return F.transform(F.array_sort(rows), lambda r: r["v"])

    mode = F.col("mode")
    is_link = F.col("__t").startswith("http")
    msgs = body.groupBy("file_id", "head").agg(
        F.max(F.when(is_head, line)).alias("header"),
        collected((mode == "text") & ~F.col("__t").startswith("Originally sent:"), "line").alias("text"),
        collected((mode == "attachments") & is_link, "__t").alias("links"),
        collected((mode == "stickers") & is_link, "__t").alias("stickers"),
        collected((mode == "reactions") & (F.col("__t") != ""), "__t").alias("reacts"),
    )
    text = js_trim(F.array_join("text", "\n"))
    empty = F.array().cast("array<string>")
    media = F.filter(F.transform("links", attachment_token), lambda t: t.isNotNull())
    parts = F.concat(
        F.when(text != "", F.array(text)).otherwise(empty),
        media,
        F.transform("stickers", lambda _: F.lit("[STICKER]")),
    )
    none = F.lit(None).cast("string")
    out = msgs.withColumn("parts", parts).select(
        "file_id",
        F.col("head").alias("msg_idx"),
        F.lit("txt").alias("format"),
        none.alias("message_id"),
        none.alias("author_key"),
        js_trim(F.regexp_extract("header", HEADER, 2)).alias("author_name"),
        none.alias("author_username"),
        parse_timestamp(F.regexp_extract("header", HEADER, 1), tz).alias("ts"),
        is_system_text(F.col("parts")).alias("is_system"),
        none.alias("reply_to_key"),
        none.alias("reply_to_message_id"),
        none.alias("reply_to_name"),
        none.alias("reply_snippet"),
        "parts",
        F.when(
            F.size("reacts") > 0, F.concat(F.lit("^{"), F.array_join("reacts", ", "), F.lit("}"))
        ).alias("reactions"),
    )
    kept = F.col("ts").isNotNull() & ((F.size("parts") > 0) | F.col("reactions").isNotNull())
    return out.where(kept)
