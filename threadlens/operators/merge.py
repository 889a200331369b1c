"""Merging overlapping exports of the same channel into one conversation.

All steps work per channel.  Input rows are assembled messages (see
``schema.MESSAGE``); ``prepare`` adds the columns the steps share.  The order of
the steps matters: predicates on dates or authors must not move below them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.chars import js_round, js_trim, u16len
from ..functions.parts import norm_text
from .ordered import MAX_GROUP_ROWS, last_known, next_known, row_numbers, slice_groups
from .skew import HOT_ROWS, join_dimension

# What counts as evidence and when it is acted on.
DISTINCTIVE_LEN = 12
ANCHOR_WINDOW_MS = 26 * 3600 * 1000
ANCHOR_MIN_SAMPLES = 10
ANCHOR_STEP_MS = 5 * 60 * 1000
ANCHOR_SLACK_MS = 90 * 1000
AGREEMENT = 0.6
BRIDGE_MIN_VOTES = 3

KEY_CHARS = 64
MSG_BITS = 41  # positions inside a file

SIGNATURE = ("channel_id", "author_id", "day", "text_key")


def text_key(norm: Column) -> Column:
    """Matching key of a normalised text: the text, or its SHA-256 if long.

    Keeps message bodies out of the shuffles that only compare them.
    """
    digest = F.concat(F.lit("\u0000"), F.sha2(norm, 256))
    return F.when(F.length(norm) <= KEY_CHARS, norm).otherwise(digest)


def prepare(msgs: DataFrame) -> DataFrame:
    """Add ``text_key``, ``distinctive`` and the position ``pos`` in the channel."""
    norm = norm_text(F.col("parts"))
    pos = F.col("grp_file_idx").cast("bigint") * (1 << MSG_BITS) + F.col("msg_idx")
    return (
        msgs.withColumn("__norm", norm)
        .withColumn("text_key", text_key(F.col("__norm")))
        .withColumn("distinctive", u16len(F.col("__norm")) >= DISTINCTIVE_LEN)
        .withColumn("pos", pos)
        .drop("__norm")
    )


# ── clock anchoring ─────────────────────────────────────────────────────────


def clock_deltas(msgs: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Distance from each text-export message to its nearest id-bearing twin.

    Twins share channel, author and distinctive text.  Both sides are reduced
    to distinct times first and then lined up in time, so a text posted again
    and again costs its number of times, not their product.
    """
    rows = msgs.where("distinctive").withColumn("t", clock.millis(F.col("ts")))
    keys = ["channel_id", "author_id", "text_key"]
    keyed = (
        rows.where("format <> 'txt'")
        .groupBy(*keys, "t")
        .agg(F.min("pos").alias("twin_pos"))
        .select(*keys, "t", F.lit(0).alias("kind"), F.lit(-1).alias("grp_file_idx"),
                "twin_pos", F.lit(0).cast("bigint").alias("n"))
    )
    loose = (
        rows.where("format = 'txt'")
        .groupBy(*keys, "t", "grp_file_idx")
        .agg(F.count("*").alias("n"))
        .select(*keys, "t", F.lit(1).alias("kind"), "grp_file_idx",
                F.lit(None).cast("bigint").alias("twin_pos"), "n")
    )
    line = keyed.unionByName(loose)
    o = slice_groups(line, keys, ["t", "kind", "grp_file_idx"], max_rows)
    twin = F.when(F.col("kind") == 0, F.struct("t", "twin_pos"))
    o = next_known(last_known(o, twin, "before"), twin, "after")
    back = F.col("t") - F.col("before.t")
    ahead = F.col("t") - F.col("after.t")
    earlier_listed = F.col("before.twin_pos") <= F.col("after.twin_pos")
    delta = (
        F.when(F.col("after").isNull(), back)
        .when(F.col("before").isNull(), ahead)
        .when(back < -ahead, back)
        .when(back > -ahead, ahead)
        .when(earlier_listed, back)
        .otherwise(ahead)
    )
    out = o.where("kind = 1").result().withColumn("delta", delta)
    return (
        out.where(F.abs("delta") <= ANCHOR_WINDOW_MS)
        .groupBy("channel_id", "grp_file_idx", "delta")
        .agg(F.sum("n").alias("n"))
    )


def clock_offsets(deltas: DataFrame) -> DataFrame:
    """Clock offset per text export whose samples agree.

    The exact upper median in two steps: minute buckets first (at most 3,121
    per file, the window being ± 26 h), then the single bucket that holds it.
    """
    file = ["channel_id", "grp_file_idx"]
    hist = deltas.withColumn("bucket", F.floor(F.col("delta") / 60000))
    run = W.partitionBy(*file).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*file)
    buckets = (
        hist.groupBy(*file, "bucket")
        .agg(F.sum("n").alias("bn"))
        .withColumn("before", F.coalesce(F.sum("bn").over(run), F.lit(0)))
        .withColumn("total", F.sum("bn").over(whole))
        .withColumn("mid", F.floor(F.col("total") / 2))
    )
    holder = buckets.where("total >= %d AND before <= mid AND mid < before + bn" % ANCHOR_MIN_SAMPLES)
    inner = W.partitionBy(*file).orderBy("delta").rowsBetween(W.unboundedPreceding, W.currentRow)
    median = (
        hist.join(holder, [*file, "bucket"])
        .withColumn("upto", F.col("before") + F.sum("n").over(inner))
        .where("upto > mid")
        .groupBy(*file)
        .agg(F.min("delta").alias("median"), F.first("total").alias("total"))
    )
    offset = js_round(F.col("median") / ANCHOR_STEP_MS) * ANCHOR_STEP_MS
    median = median.withColumn("offset_ms", offset).where("offset_ms <> 0")
    close = F.sum(
        F.when(F.abs(F.col("delta") - F.col("offset_ms")) <= ANCHOR_SLACK_MS, F.col("n"))
    )
    return (
        hist.join(median, file)
        .groupBy(*file, "offset_ms", "total")
        .agg(F.coalesce(close, F.lit(0)).alias("close"))
        .where(F.col("close") >= F.col("total") * F.lit(AGREEMENT))
        .select(*file, "offset_ms")
    )


def shift_clocks(msgs: DataFrame, offsets: DataFrame) -> DataFrame:
    """Apply the offsets to the text-export rows (one small row per file)."""
    joined = msgs.join(offsets, ["channel_id", "grp_file_idx"], "left")
    moved = F.timestamp_millis(clock.millis(F.col("ts")) - F.col("offset_ms"))
    shift = (F.col("format") == "txt") & F.col("offset_ms").isNotNull()
    return joined.withColumn("ts", F.when(shift, moved).otherwise(F.col("ts"))).drop("offset_ms")


def anchor_clocks(msgs: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    return shift_clocks(msgs, clock_offsets(clock_deltas(msgs, max_rows)))


# ── content bridge ──────────────────────────────────────────────────────────


def content_bridge(msgs: DataFrame) -> DataFrame:
    """Keyless authors whose distinctive texts belong to one id-bearing identity.

    Returns ``channel_id, from_id, to_id``.  Both sides are counted per
    (text, day) before they meet, so a text posted a million times is one row.
    """
    mixed = (
        msgs.groupBy("channel_id")
        .agg(
            F.bool_or(F.col("format") == "txt").alias("has_txt"),
            F.bool_or(F.col("format") != "txt").alias("has_keyed"),
        )
        .where("has_txt AND has_keyed")
        .select("channel_id")
    )
    rows = msgs.where("distinctive").withColumn("day", clock.day_key(F.col("ts")))
    content = ["channel_id", "text_key", "day"]
    keyed_at = (
        rows.where(F.col("message_id").isNotNull())
        .groupBy(*content)
        .agg(F.min_by("author_id", "pos").alias("to_id"))
    )
    loose = (
        rows.where(F.col("message_id").isNull())
        .join(mixed, "channel_id", "left_semi")
        .groupBy(*content, F.col("author_id").alias("from_id"))
        .agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    )
    per_pair = (
        loose.join(keyed_at, content, "left")
        .groupBy("channel_id", "from_id", "to_id")
        .agg(F.sum("n").alias("n"), F.min("pos").alias("pos"))
    )
    vote = F.col("to_id").isNotNull() & (F.col("to_id") != F.col("from_id"))
    strength = F.when(vote, F.struct(F.col("n"), (-F.col("pos")).alias("earliest")))
    best = per_pair.groupBy("channel_id", "from_id").agg(
        F.max_by("to_id", strength).alias("to_id"),
        F.max(F.when(vote, F.col("n"))).alias("votes"),
        F.sum("n").alias("total"),
    )
    enough = (F.col("votes") >= BRIDGE_MIN_VOTES) & (
        F.col("votes") >= F.col("total") * F.lit(AGREEMENT)
    )
    return best.where(enough).select("channel_id", "from_id", "to_id")


def reply_token_uid(parts: Column) -> Column:
    """Id inside a leading ``> uid: …`` token, else null."""
    first = F.get(parts, F.lit(0))
    return F.when(
        first.rlike(r"^> [^:]+:"), js_trim(F.regexp_extract(first, r"^> ([^:]+):", 1))
    )


def set_reply_token_uid(parts: Column, uid: Column) -> Column:
    """Parts with the id of the leading reply token replaced."""
    first = F.get(parts, F.lit(0))
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    after = F.substring(first, F.position(F.lit(":"), first), F.length(first))
    return F.concat(F.array(F.concat(F.lit("> "), uid, after)), rest)


def apply_bridge(msgs: DataFrame, bridge: DataFrame) -> DataFrame:
    """Move bridged authors and the reply tokens that name them."""
    by_author = bridge.select("channel_id", F.col("from_id").alias("author_id"), "to_id")
    moved = msgs.join(by_author, ["channel_id", "author_id"], "left")
    moved = moved.withColumn("author_id", F.coalesce("to_id", "author_id")).drop("to_id")
    by_reply = bridge.select("channel_id", F.col("from_id").alias("__reply"), "to_id")
    moved = moved.withColumn("__reply", reply_token_uid(F.col("parts")))
    moved = moved.join(by_reply, ["channel_id", "__reply"], "left")
    fixed = set_reply_token_uid(F.col("parts"), F.col("to_id"))
    parts = F.when(F.col("to_id").isNotNull(), fixed).otherwise(F.col("parts"))
    return moved.withColumn("parts", parts).drop("to_id", "__reply")


# ── reply targets and labels ────────────────────────────────────────────────


def resolve_reply_targets(msgs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Reply tokens name the author of the message they refer to by id."""
    target = (
        msgs.where(F.col("message_id").isNotNull())
        .groupBy("channel_id", F.col("message_id").alias("reply_to_message_id"))
        .agg(F.min_by("author_id", "pos").alias("__target"))
    )
    joined = join_dimension(
        msgs, target, ["channel_id", "reply_to_message_id"], ["pos"], hot_rows=hot_rows
    )
    named = F.col("__target").isNotNull() & (F.col("__target") != "")
    fix = named & reply_token_uid(F.col("parts")).isNotNull()
    fixed = set_reply_token_uid(F.col("parts"), F.col("__target"))
    parts = F.when(fix, fixed).otherwise(F.col("parts"))
    return joined.withColumn("parts", parts).drop("__target")


def label_authors(msgs: DataFrame, identity: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every message carries the label of its identity as the author name."""
    labels = identity.select(F.col("uid").alias("author_id"), "label")
    joined = join_dimension(msgs, labels, ["author_id"], ["pos"], hot_rows=hot_rows)
    name = F.coalesce(F.when(F.col("label") != "", F.col("label")), F.col("author_name"))
    return joined.withColumn("author_name", name).drop("label")


# ── de-duplication ──────────────────────────────────────────────────────────


def keyed_dedup(msgs: DataFrame) -> DataFrame:
    """Best copy per message id: JSON over HTML over TXT, then the later file,
    then the earlier row in that file.

    One aggregation with the rank as a struct, so that copies collapse before the
    shuffle.  ``pos`` becomes the position of the id's first copy, which is
    what ties in time are ordered by.
    """
    rank = (
        F.when(F.col("format") == "json", 2).when(F.col("format") == "txt", 0).otherwise(1)
    ).cast("bigint")
    win = F.struct(rank.alias("format"), F.col("grp_file_idx"), (-F.col("msg_idx")).alias("row"))
    payload = [c for c in msgs.columns if c not in ("channel_id", "message_id", "pos")]
    best = (
        msgs.where(F.col("message_id").isNotNull())
        .groupBy("channel_id", "message_id")
        .agg(F.max_by(F.struct(*payload), win).alias("m"), F.min("pos").alias("pos"))
    )
    return best.select("channel_id", "message_id", "pos", "m.*")


def keyless_quota(keyless: DataFrame, keyed: DataFrame) -> DataFrame:
    """How many rows of each (signature, file) survive.

    A signature keeps as many rows as its fullest file has, minus what the
    id-bearing rows already cover, taken in document order.
    """
    sig = list(SIGNATURE)
    per_file = keyless.groupBy(*sig, "grp_file_idx").agg(F.count("*").alias("n"))
    covered = keyed.groupBy(*sig).agg(F.count("*").alias("covered"))
    caps = (
        per_file.groupBy(*sig)
        .agg(F.max("n").alias("most"))
        .join(covered, sig, "left")
        .select(*sig, F.greatest(F.lit(0), F.col("most") - F.coalesce("covered", F.lit(0))).alias("cap"))
        .where("cap > 0")
    )
    earlier = W.partitionBy(*sig).orderBy("grp_file_idx").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("cap") - F.coalesce(F.sum("n").over(earlier), F.lit(0))
    quota = F.greatest(F.lit(0), F.least(F.col("n"), left))
    return (
        per_file.join(caps, sig)
        .withColumn("quota", quota)
        .where("quota > 0")
        .select(*sig, "grp_file_idx", "n", "quota")
    )


def keyless_union(
    keyless: DataFrame, keyed: DataFrame, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Keyless rows within the quota of their signature and file."""
    sig = list(SIGNATURE)
    quota = keyless_quota(keyless, keyed)
    group = [*sig, "grp_file_idx"]
    largest = quota.agg(F.max("n")).first()[0] or 0
    rows = keyless.join(quota, group)
    if largest <= max_rows:
        rank = F.row_number().over(W.partitionBy(*group).orderBy("msg_idx"))
        return rows.withColumn("__rank", rank).where("__rank <= quota").drop("__rank", "n", "quota")
    # Groups kept as a whole need no rank; in a signature at most one file is
    # kept in part.
    whole = rows.where("quota = n")
    part = row_numbers(
        slice_groups(rows.where("quota < n"), group, ["msg_idx"], max_rows), "__rank"
    ).result()
    part = part.where("__rank <= quota").drop("__rank")
    return whole.unionByName(part).drop("n", "quota")


def dedup(msgs: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Union of the copies of each channel without repeats.

    In the result ``(ts, file_idx, msg_idx)`` is the conversation order:
    ``file_idx`` is the channel's place and ``msg_idx`` puts id-bearing rows
    before keyless ones of the same instant.  The place of the kept copy stays
    in ``src_file_idx`` and ``src_msg_idx``.
    """
    place = msgs.groupBy("channel_id").agg(F.min("file_idx").alias("__place"))
    keyed = keyed_dedup(msgs).withColumn("day", clock.day_key(F.col("ts")))
    keyless = msgs.where(F.col("message_id").isNull()).withColumn(
        "day", clock.day_key(F.col("ts"))
    )
    kept = keyless_union(keyless, keyed, max_rows)
    seq = F.col("pos") + F.when(F.col("message_id").isNull(), F.lit(1 << 62)).otherwise(
        F.lit(0).cast("bigint")
    )
    both = keyed.unionByName(kept).join(place, "channel_id")
    return both.select(
        "channel_id",
        F.col("__place").alias("file_idx"),
        "grp_file_idx",
        seq.alias("msg_idx"),
        "format",
        "message_id",
        "author_id",
        "author_name",
        "ts",
        "parts",
        "is_system",
        "has_reply",
        "reply_to_message_id",
        F.col("file_idx").alias("src_file_idx"),
        F.col("msg_idx").alias("src_msg_idx"),
    )

