"""Pre-filters on assembled messages, applied after the merge."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parts import has_text


def in_date_range(df: DataFrame, start: Column | None, end: Column | None, ts: str = "ts"):
    """Both ends included."""
    if start is not None:
        df = df.where(F.col(ts) >= start)
    if end is not None:
        df = df.where(F.col(ts) <= end)
    return df


def drop_bots(df: DataFrame, bots: DataFrame, name: str = "author_name") -> DataFrame:
    """Rows whose canonical author name is not in ``bots`` (one name column)."""
    listed = bots.select(F.col(bots.columns[0]).alias(name)).distinct()
    return df.join(listed, name, "left_anti")


def drop_system(df: DataFrame, flag: str = "is_system") -> DataFrame:
    return df.where(~F.col(flag))


def drop_media_only(df: DataFrame, parts: str = "parts") -> DataFrame:
    return df.where(has_text(F.col(parts)))


def keep_authors_by_label(
    df: DataFrame, labels: DataFrame, identity: DataFrame, author: str = "author_id"
) -> DataFrame:
    """Whitelist by display name: names become ids first, ids select rows."""
    wanted = labels.select(F.col(labels.columns[0]).alias("label")).distinct()
    ids = identity.join(wanted, "label", "left_semi").select(F.col("uid").alias(author))
    return df.join(ids, author, "left_semi")


def keep_authors_by_id(df: DataFrame, ids: DataFrame, author: str = "author_id") -> DataFrame:
    wanted = ids.select(F.col(ids.columns[0]).alias(author)).distinct()
    return df.join(wanted, author, "left_semi")


def _is_pattern(pattern: str) -> bool:
    """Whether the JVM, which will run the pattern, accepts it."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def _compile_keyword(keyword: str) -> str:
    """Java pattern for ``/regex/flags`` or a literal; literal if invalid."""
    shaped = re.match(r"^/(.+)/([gimsuy]*)$", keyword, re.DOTALL)
    if shaped:
        body, flags = shaped.groups()
        flags = flags or "i"
        inline = "".join(f for f in ("i", "m", "s") if f in flags) + ("u" if "i" in flags else "")
        pattern = f"(?{inline}){body}" if inline else body
        if _is_pattern(pattern):
            return pattern
    return "(?iu)" + re.escape(keyword)


def matches_keywords(parts: Column, keywords: Iterable[str]) -> Column:
    """Any keyword occurs in the parts joined by a blank."""
    text = F.array_join(parts, " ")
    hit = F.lit(False)
    for keyword in keywords:
        hit = hit | text.rlike(_compile_keyword(keyword))
    return hit


def drop_low_activity(
    df: DataFrame,
    min_messages: int,
    channel: str = "channel_id",
    author: str = "author_id",
) -> DataFrame:
    """Authors with fewer than ``min_messages`` rows in a channel are left out.

    A count and a join rather than ``count(*) over (...)``: the count combines
    before the shuffle, and no task has to hold all rows of a busy author.
    """
    if min_messages <= 0:
        return df
    quiet = (
        df.groupBy(channel, author)
        .count()
        .where(F.col("count") < min_messages)
        .select(channel, author)
    )
    return df.join(quiet, [channel, author], "left_anti")


__all__ = [
    "drop_bots",
    "drop_low_activity",
    "drop_media_only",
    "drop_system",
    "in_date_range",
    "keep_authors_by_id",
    "keep_authors_by_label",
    "matches_keywords",
]
