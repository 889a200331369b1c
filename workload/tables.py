"""The given tables as messages, written once for Spark and once for SQL.

``events`` become chat messages with replies, media and reactions derived from
the number in ``props``.  ``conversations`` become channels of 50 conversations
each, and from them three overlapping exports (JSON, HTML, text).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.session import configure

EPOCH_MS = 1420070400000
DAY0_MS = 1704067200000  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_sql(*ctes: str, body: str) -> str:
    """One statement from named common table expressions, each listed once."""
    seen = list(dict.fromkeys(ctes))
    return "WITH " + ",\n".join(seen) + "\n" + body


def text(*pieces) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces])


def array_if(cond: Column, *items: Column) -> Column:
    return F.when(cond, F.array(*items)).otherwise(F.array().cast("array<string>"))


# ── events ──────────────────────────────────────────────────────────────────


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    ev = ev.withColumn("k", k).withColumn("u", F.col("user_id").cast("string"))
    k = F.col("k")
    ks = k.cast("string")
    target = ((F.col("user_id") + k) % 40 + 1).cast("string")
    body = reduce(
        F.concat,
        [
            array_if(k % 3 == 0, text("> U", target, ": re ", ks)),
            array_if(
                k % 11 != 0,
                text(F.col("event_type"), " *k", ks, "* worth ",
                     F.floor(F.col("value") * 100).cast("bigint").cast("string")),
            ),
            array_if(k % 5 == 0, text("[IMG: f", ks, ".png]")),
            array_if(k % 7 == 0, F.lit("[STICKER]")),
            array_if(k % 13 == 0, F.lit("[NOTE]")),
        ],
    )
    react = text("^{👍:", (k % 6 + 1).cast("string"), ", 🔥}")
    last = F.try_element_at(body, F.lit(-1))
    glued = F.concat(
        F.slice(body, F.lit(1), F.greatest(F.size(body) - 1, F.lit(0))), F.array(text(last, " ", react))
    )
    parts = (
        F.when(k % 4 != 0, body)
        .when((F.size(body) > 0) & ~last.startswith("["), glued)
        .otherwise(F.concat(body, F.array(react)))
    )
    return ev.select(
        F.col("event_type").alias("channel_id"),
        F.lit(0).alias("file_idx"),
        F.col("event_id").alias("msg_idx"),
        F.col("event_id").cast("string").alias("message_id"),
        text("U", (F.col("user_id") + 1).cast("string")).alias("author_id"),
        text("user_", F.col("u")).alias("author_name"),
        F.col("ts").cast("timestamp").alias("ts"),
        parts.alias("parts"),
        (k % 17 == 0).alias("is_system"),
        (k % 3 == 0).alias("has_reply"),
        "k",
    )


EVENT_BODY = """ev AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
ev_body AS (
  SELECT *, list_concat(list_concat(list_concat(list_concat(
      CASE WHEN k % 3 = 0 THEN ['> U' || CAST((user_id + k) % 40 + 1 AS VARCHAR) || ': re ' || CAST(k AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END,
      CASE WHEN k % 11 <> 0 THEN [event_type || ' *k' || CAST(k AS VARCHAR) || '* worth ' || CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END),
      CASE WHEN k % 5 = 0 THEN ['[IMG: f' || CAST(k AS VARCHAR) || '.png]'] ELSE CAST([] AS VARCHAR[]) END),
      CASE WHEN k % 7 = 0 THEN ['[STICKER]'] ELSE CAST([] AS VARCHAR[]) END),
      CASE WHEN k % 13 = 0 THEN ['[NOTE]'] ELSE CAST([] AS VARCHAR[]) END) AS body,
    '^{👍:' || CAST(k % 6 + 1 AS VARCHAR) || ', 🔥}' AS react
  FROM ev),
msgs AS (
  SELECT event_type AS channel_id, 0 AS file_idx, event_id AS msg_idx, CAST(event_id AS VARCHAR) AS message_id,
    'U' || CAST(user_id + 1 AS VARCHAR) AS author_id, 'user_' || CAST(user_id AS VARCHAR) AS author_name, ts,
    CASE WHEN k % 4 <> 0 THEN body
         WHEN len(body) > 0 AND NOT starts_with(body[-1], '[') THEN list_concat(body[1:len(body) - 1], [body[-1] || ' ' || react])
         ELSE list_concat(body, [react]) END AS parts,
    k % 17 = 0 AS is_system, k % 3 = 0 AS has_reply, k
  FROM ev_body)"""

# Per-message values, computed once for all statistics.
ENRICHED = r"""enr0 AS (
  SELECT *, strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) AS INTEGER) AS dow,
    array_to_string(list_filter(list_transform(
        list_filter(parts, lambda p: NOT starts_with(p, '> ') AND NOT starts_with(p, '[')),
        lambda p: trim(regexp_replace(p, '\s*\^\{[^}]*\}\s*', '', 'g'))), lambda p: p <> ''), ' ') AS text,
    CAST(len(list_filter(parts, lambda p: starts_with(p, '['))) AS BIGINT) AS media,
    regexp_extract(list_filter(parts, lambda p: regexp_matches(p, '\^\{[^}]*\}'))[-1], '\^\{([^}]*)\}', 1) AS blob,
    len(list_filter(parts, lambda p: starts_with(p, '> '))) > 0 AS is_reply,
    regexp_extract(list_filter(parts, lambda p: regexp_matches(p, '^>\s*[^:]+:'))[1], '^>\s*([^:]+):', 1) AS target
  FROM msgs),
enr AS (
  SELECT *, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS words,
    CAST(length(text) AS BIGINT) AS chars, CASE WHEN is_reply THEN trim(target) END AS reply_to
  FROM enr0)"""

EVENTS = (EVENT_BODY, ENRICHED)

# ── conversations ───────────────────────────────────────────────────────────


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with channel, people, time and ids."""
    conv = table(spark, sf_dir, "conversations")
    role = F.col("role")
    shift = F.when(role == "assistant", 5).when(role == "system", 11).otherwise(0)
    t_ms = F.lit(DAY0_MS) + F.col("conv_id") * 3600000 + F.col("turn") * 90000
    return conv.select(
        "conv_id", "turn", "role", "text",
        text("c", F.floor(F.col("conv_id") / 50).cast("string")).alias("channel_id"),
        F.floor(F.col("conv_id") / 50).cast("int").alias("chan_no"),
        ((F.col("conv_id") * 3 + shift) % 23).alias("who"),
        t_ms.alias("t_ms"),
        ((t_ms - F.lit(EPOCH_MS)) * 4194304).cast("string").alias("mid"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("place"),
    )


CHAT = f"""turns AS (
  SELECT conv_id, turn, role, text, 'c' || CAST(conv_id // 50 AS VARCHAR) AS channel_id, CAST(conv_id // 50 AS INTEGER) AS chan_no,
    (conv_id * 3 + CASE role WHEN 'assistant' THEN 5 WHEN 'system' THEN 11 ELSE 0 END) % 23 AS who,
    {DAY0_MS} + conv_id * 3600000 + turn * 90000 AS t_ms,
    CAST(({DAY0_MS} + conv_id * 3600000 + turn * 90000 - {EPOCH_MS}) * 4194304 AS VARCHAR) AS mid,
    conv_id * 100 + turn AS place
  FROM conversations)"""


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as assembled messages; every third turn answers the one before."""
    t = chat_turns(spark, sf_dir)
    w = F.col("who").cast("string")
    reply_to = ((F.col("who") + 4) % 23).cast("string")
    parts = F.concat(
        array_if(F.col("turn") % 3 == 2, text("> U", reply_to, ": earlier")),
        F.array(F.col("text")),
        array_if(F.col("turn") % 5 == 3, text("[IMG: pic", F.col("conv_id").cast("string"), ".png]")),
    )
    return t.select(
        "channel_id",
        F.lit(0).alias("file_idx"),
        F.col("place").alias("msg_idx"),
        F.col("mid").alias("message_id"),
        text("U", w).alias("author_id"),
        text("nick ", w).alias("author_name"),
        F.timestamp_millis("t_ms").alias("ts"),
        parts.alias("parts"),
        (F.col("role") == "system").alias("is_system"),
        (F.col("turn") % 3 == 2).alias("has_reply"),
    )


CHAT_MSGS = """cmsgs AS (
  SELECT channel_id, 0 AS file_idx, place AS msg_idx, mid AS message_id, 'U' || CAST(who AS VARCHAR) AS author_id,
    'nick ' || CAST(who AS VARCHAR) AS author_name, t_ms,
    list_concat(list_concat(
      CASE WHEN turn % 3 = 2 THEN ['> U' || CAST((who + 4) % 23 AS VARCHAR) || ': earlier'] ELSE CAST([] AS VARCHAR[]) END, [text]),
      CASE WHEN turn % 5 = 3 THEN ['[IMG: pic' || CAST(conv_id AS VARCHAR) || '.png]'] ELSE CAST([] AS VARCHAR[]) END) AS parts,
    role = 'system' AS is_system, turn % 3 = 2 AS has_reply
  FROM turns)"""

CHATS = (CHAT, CHAT_MSGS)


def people_of(msgs: DataFrame) -> DataFrame:
    """Identity table of messages whose authors are already resolved."""
    return msgs.groupBy(F.col("author_id").alias("uid")).agg(
        F.min("author_name").alias("label"), F.count("*").alias("n")
    )


# Three exports of every channel, authors already resolved.  The text export
# runs two hours ahead, has lost its seconds and ids, calls every fifth person
# by a name nobody else uses, repeats turn 1 and has rows nobody else has.
def merge_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chat_turns(spark, sf_dir)
    who = F.col("who").cast("string")
    common = dict(channel="channel_id")
    null = F.lit(None).cast("string")

    def rows(df, slot, fmt, mid, author, ms, parts, at=None):
        reply = F.when((F.col("turn") % 3 == 2) & F.lit(fmt != "txt"), _mid_of(F.col("t_ms") - 90000))
        return df.select(
            common["channel"],
            (F.col("chan_no") * 3 + slot).alias("file_idx"),
            F.lit(slot).alias("grp_file_idx"),
            (F.col("place") if at is None else at).alias("msg_idx"),
            F.lit(fmt).alias("format"),
            mid.alias("message_id"),
            author.alias("author_id"),
            text("name of ", author).alias("author_name"),
            F.timestamp_millis(ms).alias("ts"),
            parts.alias("parts"),
            (F.col("role") == "system").alias("is_system"),
            (F.col("turn") % 3 == 2).alias("has_reply"),
            reply.alias("reply_to_message_id"),
        )

    def body(fmt_text):
        head = array_if(F.col("turn") % 3 == 2, text("> A", ((F.col("who") + 4) % 23).cast("string"), ": earlier"))
        return F.concat(head, F.array(fmt_text))

    keyed = text("A", who)
    loose = F.when(F.col("who") % 5 == 0, text("G", who)).otherwise(keyed)
    late = F.floor((F.col("t_ms") + 7200000) / 60000) * 60000
    json = rows(t, 1, "json", F.col("mid"), keyed, F.col("t_ms"), body(text("**", F.col("text"), "** :wave:")))
    html = rows(t.where("turn >= 1"), 0, "html", F.col("mid"), keyed, F.col("t_ms"), body(F.col("text")))
    txt = rows(t.where("turn < 4"), 2, "txt", null, loose, late, F.array(F.col("text")), F.col("place") * 2)
    again = rows(t.where("turn = 1"), 2, "txt", null, loose, late, F.array(F.col("text")), F.col("place") * 2 + 1)
    only = rows(
        t.where("turn = 0"), 2, "txt", null, loose, late,
        F.array(text("only in the text export ", F.col("conv_id").cast("string"))), F.col("place") * 2 + 1,
    )
    return json.unionByName(html).unionByName(txt).unionByName(again).unionByName(only)


def _mid_of(ms: Column) -> Column:
    return ((ms - F.lit(EPOCH_MS)) * 4194304).cast("string")


_REPLY = "CASE WHEN turn % 3 = 2 THEN ['> A' || CAST((who + 4) % 23 AS VARCHAR) || ': earlier'] ELSE CAST([] AS VARCHAR[]) END"
_REF = f"CASE WHEN turn % 3 = 2 THEN CAST((t_ms - 90000 - {EPOCH_MS}) * 4194304 AS VARCHAR) END"
_LOOSE = "CASE WHEN who % 5 = 0 THEN 'G' ELSE 'A' END || CAST(who AS VARCHAR)"
_LATE = "((t_ms + 7200000) // 60000) * 60000"

MERGE_IN = f"""merge_in AS (
  SELECT channel_id, chan_no * 3 + 1 AS file_idx, 1 AS grp_file_idx, place AS msg_idx, 'json' AS format, mid AS message_id,
    'A' || CAST(who AS VARCHAR) AS author_id, t_ms, list_concat({_REPLY}, ['**' || text || '** :wave:']) AS parts, text AS raw, {_REF} AS ref FROM turns
  UNION ALL
  SELECT channel_id, chan_no * 3, 0, place, 'html', mid, 'A' || CAST(who AS VARCHAR), t_ms, list_concat({_REPLY}, [text]), text, {_REF} FROM turns WHERE turn >= 1
  UNION ALL
  SELECT channel_id, chan_no * 3 + 2, 2, place * 2, 'txt', NULL, {_LOOSE}, {_LATE}, [text], text, NULL FROM turns WHERE turn < 4
  UNION ALL
  SELECT channel_id, chan_no * 3 + 2, 2, place * 2 + 1, 'txt', NULL, {_LOOSE}, {_LATE}, [text], text, NULL FROM turns WHERE turn = 1
  UNION ALL
  SELECT channel_id, chan_no * 3 + 2, 2, place * 2 + 1, 'txt', NULL, {_LOOSE}, {_LATE},
    ['only in the text export ' || CAST(conv_id AS VARCHAR)], 'only in the text export ' || CAST(conv_id AS VARCHAR), NULL FROM turns WHERE turn = 0)"""

# Normalised text and position, as the merge steps use them.
NORM_SQL = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(list_transform(parts, lambda p: regexp_replace(p, '\[([^\]]*)\]\(\S*?\)', '\1', 'g')), lambda p: NOT starts_with(p, '[') AND NOT starts_with(p, '> ')), lambda p: regexp_replace(p, '\^\{[^}]*\}', '', 'g')), ' '), ':[A-Za-z0-9_+-]+:', '', 'g'), '[*_~`|\\]', '', 'g'), '\s+', ' ', 'g')))"

MERGE_NORM = f"""mn AS (
  SELECT *, {NORM_SQL} AS norm, CAST(grp_file_idx AS BIGINT) * 1000000000 + msg_idx AS pos FROM merge_in)"""

MERGES = (CHAT, MERGE_IN, MERGE_NORM)
