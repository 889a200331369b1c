"""CSV and JSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import WS
from ..functions.clock import iso_millis
from ..functions.redact import guard_formula, redact
from . import document as D

ORDER = ("ts", "file_idx", "msg_idx")


def _redact(text: Column, o: D.RenderOptions) -> Column:
    return redact(text, o.redact_urls, o.redact_emails)


def csv_cells(msgs: DataFrame, options: D.RenderOptions = D.RenderOptions()) -> DataFrame:
    """Guarded cells plus the channel and order columns.

    Reactions glued to text stay in the content; only a standalone reaction
    part moves to its own column.
    """
    body = F.filter("parts", lambda p: ~p.startswith("^"))
    reactions = F.get(F.filter("parts", lambda p: p.startswith("^")), F.lit(0))
    name = F.lit("") if options.redact_names else F.coalesce("author_name", F.lit(""))
    cells = {
        "timestamp": iso_millis(F.col("ts")),
        "author_id": F.col("author_id"),
        "author_name": name,
        "content": _redact(F.array_join(body, " | "), options),
        "reactions": F.coalesce(reactions, F.lit("")),
    }
    return msgs.select("channel_id", *ORDER, *[guard_formula(c).alias(k) for k, c in cells.items()])


def write_csv(msgs: DataFrame, path: str, options: D.RenderOptions = D.RenderOptions()) -> None:
    cells = csv_cells(msgs, options)
    by = ["channel_id", *ORDER]
    (
        cells.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop(*ORDER)
        .write.partitionBy("channel_id")
        .csv(path, header=True, quoteAll=True, escape='"', emptyValue="", nullValue="")
    )


def json_messages(msgs: DataFrame, options: D.RenderOptions = D.RenderOptions()) -> DataFrame:
    """``timestamp, author, authorId, content, replyTo, reactions`` per message.

    Only the first part can be a reply; a later part opening with ``>`` is a
    quotation and stays in the content.
    """
    first = F.get("parts", F.lit(0))
    is_reply = F.coalesce("has_reply", F.lit(True)) & F.coalesce(first.startswith(">"), F.lit(False))
    rest = F.when(
        is_reply, F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))
    ).otherwise(F.col("parts"))
    content = F.array_join(F.filter(rest, lambda p: ~p.startswith("^")), "\n")
    reply = F.when(is_reply, F.regexp_replace(first, rf"^>[{WS}]*", ""))
    reply = F.when(reply != "", reply)
    react = F.get(F.filter("parts", lambda p: p.startswith("^")), F.lit(0))
    react = F.substring(react, 2, 1 << 30)
    author = F.col("author_id") if options.redact_names else F.col("author_name")
    return msgs.select(
        "channel_id",
        *ORDER,
        iso_millis(F.col("ts")).alias("timestamp"),
        author.alias("author"),
        F.col("author_id").alias("authorId"),
        _redact(content, options).alias("content"),
        _redact(reply, options).alias("replyTo"),
        F.when(react != "", react).alias("reactions"),
    )


JSON_FIELDS = ("timestamp", "author", "authorId", "content", "replyTo", "reactions")


def write_json_lines(msgs: DataFrame, path: str, options: D.RenderOptions = D.RenderOptions()) -> None:
    by = ["channel_id", *ORDER]
    (
        json_messages(msgs, options)
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .select("channel_id", *JSON_FIELDS)
        .write.partitionBy("channel_id")
        .option("ignoreNullFields", False)
        .json(path)
    )


def _quoted(text: Column) -> Column:
    """JSON text of a string value, null for null."""
    lit = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(lit, F.lit(2), F.length(lit) - 2))


def _element(j: str, columns: tuple[str, ...] = JSON_FIELDS) -> Column:
    """One message object in the two-blank indented layout."""
    lines = [F.concat(F.lit(f'      "{c}": '), _quoted(F.col(c))) for c in columns]
    return F.concat(F.lit("    {\n"), F.concat_ws(",\n", *lines), F.lit(f"\n    }}{j}"))


def json_document(
    msgs: DataFrame, people: DataFrame, options: D.RenderOptions = D.RenderOptions(), channel: str = ""
) -> DataFrame:
    """The one-document form of one conversation, as ordered document rows.

    Only two scalars reach the driver: the last participant and the position of
    the last message, whose elements take no comma.
    """
    spark = msgs.sparkSession
    number = F.regexp_extract("uid", r"^U(\d{1,18})$", 1).try_cast("bigint")
    who = people.select(
        "uid",
        (F.col("uid") if options.redact_names else F.col("label")).alias("label"),
        F.coalesce(number, F.lit(1 << 40)).alias("k"),
    )
    last_who = who.agg(F.max(F.struct("k", "uid")).alias("m")).first()["m"]
    last_msg = msgs.agg(F.max(F.struct(*ORDER)).alias("m")).first()["m"]
    one = spark.range(1).select(F.lit(channel).alias("channel_id"))
    open_people = '{\n  "participants": {' if last_who else '{\n  "participants": {},'
    open_messages = ("  },\n" if last_who else "") + ('  "messages": [' if last_msg else '  "messages": []')
    head = one.select(*D.row(D.HEAD, F.lit(open_people)))
    middle = one.select(*D.row(D.BODY, F.lit(open_messages), F.lit(-(1 << 62))))
    foot = one.select(*D.row(D.FOOT, F.lit("  ]\n}" if last_msg else "}")))
    rows = head.unionByName(middle).unionByName(foot)
    if last_who:
        comma = F.when(F.col("uid") == last_who["uid"], F.lit("")).otherwise(F.lit(","))
        entry = F.concat(F.lit("    "), _quoted(F.col("uid")), F.lit(": "), _quoted(F.col("label")), comma)
        named = who.withColumn("channel_id", F.lit(channel))
        # equal k only for ids that are not U<n>; they follow in id order
        rows = rows.unionByName(named.select(*D.row(D.LEGEND, entry, F.col("k"))))
    if last_msg:
        body = json_messages(msgs, options).withColumn("channel_id", F.lit(channel))
        at_end = (
            (F.unix_micros("ts") == F.unix_micros(F.lit(last_msg["ts"])))
            & (F.col("file_idx") == last_msg["file_idx"])
            & (F.col("msg_idx") == last_msg["msg_idx"])
        )
        text = F.when(at_end, _element("")).otherwise(_element(","))
        rows = rows.unionByName(body.select(*D.body_row(text)))
    return rows
