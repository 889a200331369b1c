"""Export files written from the conversations, for the source queries.

A channel is 50 conversations, so a file's size does not grow with the table;
the number of files does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions import clock
from threadlens.functions.redact import escape_html
from threadlens.session import work_dir

from .tables import _mid_of, chat_turns, text


def _write(rows: DataFrame, label: str) -> str:
    """One text file per channel; the folder is new for every run."""
    path = f"{work_dir(rows.sparkSession)}/threadlens/{label}-{uuid.uuid4().hex}"
    rows.write.partitionBy("channel").text(path)
    return path


def _per_channel(turns: DataFrame, piece, sep: str, head, foot) -> DataFrame:
    pieces = F.array_sort(F.collect_list(F.struct("place", piece.alias("t"))))
    body = F.array_join(F.transform(pieces, lambda p: p["t"]), sep)
    docs = turns.groupBy("channel_id").agg(body.alias("body"))
    return docs.select(F.concat(head, F.col("body"), foot).alias("value"), F.col("channel_id").alias("channel"))


def write_json(spark, sf_dir, indented: bool = True) -> str:
    t = chat_turns(spark, sf_dir)
    w = F.col("who").cast("string")
    turn = F.col("turn")
    kind = F.when(F.col("role") == "system", "GuildMemberJoin").when(turn % 3 == 2, "Reply").otherwise("Default")
    message = F.struct(
        F.col("mid").alias("id"),
        kind.alias("type"),
        clock.iso_millis(F.timestamp_millis("t_ms")).alias("timestamp"),
        F.col("text").alias("content"),
        F.struct(text("9", w).alias("id"), text("user", w).alias("name"), text(" nick ", w, " ").alias("nickname"),
                 F.lit(False).alias("isBot")).alias("author"),
        F.when(turn % 5 == 3, F.array(F.struct(text("pic", w, ".PNG").alias("fileName")))).alias("attachments"),
        F.when(turn % 4 == 2, F.array(F.struct(text("title ", w).alias("title"), F.lit("https://youtu.be/x").alias("url")))).alias("embeds"),
        F.when(turn % 4 == 1, F.array(F.struct(F.struct(F.lit("👍").alias("name")).alias("emoji"), F.col("who").alias("count")))).alias("reactions"),
        F.when(turn % 3 == 2, F.struct(_mid_of(F.col("t_ms") - 90000).alias("messageId"))).alias("reference"),
        F.when(turn % 7 == 5, F.struct(text("fwd ", w).alias("content"), F.array(F.struct(text("fwd", w, ".png").alias("fileName"))).alias("attachments"))).alias("forwardedMessage"),
    )
    inner = F.to_json(message)
    if indented:
        bare = F.substring(inner, F.lit(2), F.length(inner) - 2)
        piece = F.concat(F.lit("    {\n      "), bare, F.lit("\n    }"))
        head = text('{\n  "guild": {"id": "1", "name": "Guild"},\n  "channel": {"id": "', F.col("channel_id"),
                    '", "category": "cat", "name": "chan"},\n  "exportedAt": "2025-01-01T00:00:00+00:00",\n  "messages": [\n')
        return _write(_per_channel(t, piece, ",\n", head, F.lit('\n  ],\n  "messageCount": 1\n}')), "json-export")
    head = text('{"guild":{"name":"Guild"},"channel":{"id":"', F.col("channel_id"), '","name":"chan"},"messages":[')
    return _write(_per_channel(t, inner, ",", head, F.lit("]}")), "json-compact")


def write_txt(spark, sf_dir) -> str:
    t = chat_turns(spark, sf_dir)
    w = F.col("who").cast("string")
    turn = F.col("turn")
    rule = "=" * 62
    stamp = F.date_format(F.timestamp_millis("t_ms"), "M/d/yyyy h:mm a")
    piece = F.concat(
        text("[", stamp, "] nick ", w, "\n", F.when(F.col("role") == "system", "joined the server.").otherwise(F.col("text")), "\n"),
        F.when(turn % 5 == 3, text("\n{Attachments}\nhttps://cdn.example/a/pic%20", w, ".png\n")).otherwise(F.lit("")),
        F.when(turn % 4 == 1, F.lit("\n{Reactions}\n👍\n🔥\n")).otherwise(F.lit("")),
        F.when(turn % 4 == 2, F.lit("\n{Embed}\nsome title\n\n")).otherwise(F.lit("")),
        F.when(turn % 4 == 3, F.lit("\n{Stickers}\nhttps://cdn.example/s.png\n")).otherwise(F.lit("")),
    )
    head = text(f"{rule}\nGuild: Guild\nChannel: cat / ", F.col("channel_id"), f"\n{rule}\n\n")
    return _write(_per_channel(t, piece, "\n", head, F.lit(f"\n{rule}\nExported 1 message(s)\n{rule}\n")), "txt-export")


def write_html(spark, sf_dir) -> str:
    t = chat_turns(spark, sf_dir)
    w = F.col("who").cast("string")
    turn = F.col("turn")
    system = F.col("role") == "system"
    blank = F.lit("")
    author = F.when(system, text('<span class="chatlog__system-notification-author" title="user', w, '" data-user-id="9', w, '">nick ', w, "</span>")).otherwise(
        text('<span class="chatlog__author" title="user', w, '" data-user-id="9', w, '">nick ', w, "</span>"))
    reply = F.when(turn % 3 == 2, text(
        '<div class="chatlog__reply"><div class="chatlog__reply-author">nick ', ((F.col("who") + 4) % 23).cast("string"),
        '</div><div class="chatlog__reply-content"><span class="chatlog__reply-link" onclick="scrollToMessage(event,\'',
        _mid_of(F.col("t_ms") - 90000), "')\">earlier words</span></div></div>")).otherwise(blank)
    body = F.when(system, text('<span class="chatlog__system-notification-content">', escape_html(F.col("text")), "</span>")).otherwise(
        text('<span class="chatlog__markdown-preserve">', escape_html(F.col("text")), "</span>"))
    attach = F.when(turn % 5 == 3, text('<a class="chatlog__attachment" href="https://cdn.example/a%20', w, '.gif?x=1"><img src="t.png"></a>')).otherwise(blank)
    react = F.when(turn % 4 == 1, text('<div class="chatlog__reactions"><div class="chatlog__reaction"><img alt="👍"><span class="chatlog__reaction-count">', w, "</span></div></div>")).otherwise(blank)
    # Turns of one author in a conversation form a group; some messages have an id without a time and a title in minutes.
    timeless = turn % 4 == 2
    stamp = F.date_format(F.timestamp_millis("t_ms"), "EEEE, MMMM d, y h:mm a")
    ident = F.when(timeless, text('id="message-', (F.col("place") + 1).cast("string"), '">', '<span class="chatlog__timestamp" title="', stamp, '"></span>')).otherwise(
        text('data-message-id="', F.col("mid"), '">'))
    message = text('<div class="chatlog__message-container" ', ident, reply, body, attach, react, "</div>")
    ordered = F.array_sort(F.collect_list(F.struct("turn", message.alias("t"))))
    t = t.groupBy("channel_id", "conv_id", "who").agg(
        F.min("place").alias("place"), F.first(author).alias("author"), F.array_join(F.transform(ordered, lambda m: m["t"]), "").alias("inner"))
    # Three spellings of a group's opening in every file.
    opening = F.when(F.col("place") % 3 == 0, '<div class="chatlog__message-group">').when(
        F.col("place") % 3 == 1, '<div id="g1" data-note="x > y" class="chatlog__message-group">').otherwise("<div class='first chatlog__message-group'>")
    piece = text(opening, F.col("author"), F.col("inner"), "</div>")
    head = text("<!DOCTYPE html><html><head><style>.chatlog__message-group{margin:0}</style></head><body><div class=\"chatlog\">\n")
    return _write(_per_channel(t, piece, "\n", head, F.lit("\n</div></body></html>")), "html-export")

