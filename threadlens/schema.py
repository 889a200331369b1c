"""Row layouts shared by the whole library.

``(file_idx, msg_idx)`` is the document order: the order files were given and
the order of messages inside one file.  Spark rows have no order of their own,
so every "first wins" / "last wins" rule is stated over these two columns.
"""

from __future__ import annotations

from pyspark.sql import types as T

RAW_MESSAGE = T.StructType(
    [
        T.StructField("channel_id", T.StringType()),
        T.StructField("file_idx", T.IntegerType()),
        T.StructField("grp_file_idx", T.IntegerType()),
        T.StructField("msg_idx", T.LongType()),
        T.StructField("format", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("author_key", T.StringType()),
        T.StructField("author_name", T.StringType()),
        T.StructField("author_username", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("is_system", T.BooleanType()),
        T.StructField("reply_to_key", T.StringType()),
        T.StructField("reply_to_message_id", T.StringType()),
        T.StructField("reply_to_name", T.StringType()),
        T.StructField("reply_snippet", T.StringType()),
        T.StructField("parts", T.ArrayType(T.StringType())),
        T.StructField("reactions", T.StringType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("channel_id", T.StringType()),
        T.StructField("file_idx", T.IntegerType()),
        T.StructField("grp_file_idx", T.IntegerType()),
        T.StructField("msg_idx", T.LongType()),
        T.StructField("format", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("author_name", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("parts", T.ArrayType(T.StringType())),
        T.StructField("is_system", T.BooleanType()),
        T.StructField("has_reply", T.BooleanType()),
        T.StructField("reply_to_message_id", T.StringType()),
    ]
)

FILES = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("file_idx", T.IntegerType()),
        T.StructField("format", T.StringType()),
        T.StructField("channel_id", T.StringType()),
        T.StructField("base_name", T.StringType()),
        T.StructField("sort_order", T.LongType()),
        T.StructField("after_date", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("exported_at", T.TimestampType()),
        T.StructField("invalid", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)

# One JSON export document.  The schema is always stated, never inferred: an
# empty "reactions": [] would otherwise infer as array<string>.
JSON_AUTHOR = "struct<id string, name string, discriminator string, nickname string, isBot boolean>"
JSON_MESSAGE = (
    "struct<id string, type string, timestamp string, content string,"
    f" author {JSON_AUTHOR},"
    " attachments array<struct<id string, url string, fileName string>>,"
    " embeds array<struct<title string, url string, video struct<url string>>>,"
    " stickers array<struct<id string, name string>>,"
    " reactions array<struct<emoji struct<id string, name string, code string>, count bigint>>,"
    " reference struct<type string, messageId string, channelId string>,"
    " forwardedMessage struct<content string, attachments array<struct<fileName string>>>>"
)
JSON_EXPORT_HEAD = (
    "guild struct<id string, name string>,"
    " channel struct<id string, type string, category string, name string, topic string>,"
    " dateRange struct<after string, before string>,"
    " exportedAt string"
)
JSON_EXPORT = f"{JSON_EXPORT_HEAD}, messages array<{JSON_MESSAGE}>"
