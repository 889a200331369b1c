"""Token estimation and budget arithmetic."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import EMOJI_BODY, js_round, u16len

CHARS_PER_TOKEN = 2.6  # fixed value
BUDGET_HEADROOM = 0.15  # fixed value
BUDGET_FLOOR = 1000  # fixed value
MESSAGE_OVERHEAD = 14  # fixed value: author and time line
PART_OVERHEAD = 3  # fixed value: indent and line break

# Model presets: stated context limits in tokens.
MODEL_PRESETS = {
    "claude-1m": 1_375_000,
    "claude-200k": 200_000,
    "gpt4-128k": 128_000,
    "gemini-1m": 1_000_000,
    "gemini-2m": 2_000_000,
}

# Segments the estimate charges for: Latin words, digit runs, space runs,
# line-break runs, emoji clusters, any other single character.
LATIN = r"[A-Za-z\xC0-\x{24F}]+"
DIGITS = r"[0-9]+"
SPACES = r"[ \t]+"
BREAKS = r"\r?\n(?:[ \t]*\r?\n)*"
CLUSTER = (
    rf"[{EMOJI_BODY}](?:[\x{{FE0F}}\x{{200D}}][{EMOJI_BODY}]?)*"
)
# Plain ASCII is tried before the long emoji class; no ASCII character is in it.
SEGMENT = rf"{LATIN}|{DIGITS}|{SPACES}|{BREAKS}|[\x00-\x7F]|{CLUSTER}|(?s:.)"

# A counter turns text into a token count.  Either a Column function like
# ``estimate_tokens`` or a vectorised user function (a pandas_udf string->long).
TokenCounter = Callable[[Column], Column]


def _segment_cost(seg: Column) -> Column:
    """Cost of one segment in hundredths of a token."""
    c = F.ascii(seg)
    n = F.length(seg)
    latin = c.between(65, 90) | c.between(97, 122) | c.between(0xC0, 0x24F)
    long_word = F.lit(100) + F.floor((n - 6) / F.lit(6.5) + F.lit(0.5)) * 100
    return (
        F.when(latin, F.when(n <= 6, F.lit(100)).otherwise(long_word))
        .when(c.between(48, 57), F.ceil(n / 3) * 100)
        .when(c.isin(32, 9), F.when(n > 1, F.lit(100)).otherwise(F.lit(0)))
        .when(c.isin(10, 13), F.lit(100))
        .when((c > 0xFFFF) | ((c >= 0x3000) & (n >= 2)), F.lit(300))
        .when(c >= 0x3000, F.lit(150))
        .otherwise(F.lit(82))
        .cast("bigint")
    )


def token_hundredths(text: Column) -> Column:
    """Unrounded estimate, in whole hundredths so that sums never drift."""
    segments = F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(0))
    return F.aggregate(segments, F.lit(0).cast("bigint"), lambda acc, s: acc + _segment_cost(s))


def estimate_tokens(text: Column) -> Column:
    return F.floor((token_hundredths(text) + 50) / 100).cast("bigint")


def tokens_from_chars(chars: Column) -> Column:
    return js_round(chars / F.lit(CHARS_PER_TOKEN))


def chars_from_tokens(tokens: Column) -> Column:
    return js_round(tokens * F.lit(CHARS_PER_TOKEN))


def chars_for_tokens(tokens: int) -> int:
    return math.floor(tokens * CHARS_PER_TOKEN + 0.5)


def effective_budget(limit: int) -> int:
    """Stated limit minus the headroom kept on everything above the floor."""
    if limit <= BUDGET_FLOOR:
        return limit
    return math.floor(BUDGET_FLOOR + (limit - BUDGET_FLOOR) * (1 - BUDGET_HEADROOM) + 0.5)


def legend_reserve(user_count: int) -> int:
    return 200 + user_count * 40


def message_cost(parts: Column) -> Column:
    """Conservative rendered size of one message in characters."""
    return F.aggregate(
        parts,
        F.lit(MESSAGE_OVERHEAD).cast("bigint"),
        lambda acc, p: acc + u16len(p) + F.lit(PART_OVERHEAD),
    )
