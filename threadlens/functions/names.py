"""Functions over author names and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import js_trim, non_empty

PLACEHOLDER = r"(?iu)^(deleted user|unknown|deleted_user.*)$"  # fixed value
SIMILAR_AT = 0.6  # fixed value


def is_placeholder(name: Column) -> Column:
    return name.rlike(PLACEHOLDER)


def display_name(nickname: Column, name: Column) -> Column:
    return js_trim(F.coalesce(non_empty(nickname), non_empty(name), F.lit("Unknown")))


def username_similar(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length reaches 0.6.

    The edit distance is at least the difference in length, so pairs that
    differ too much in length are turned down before it is computed.
    """
    longest = F.greatest(F.length(a), F.length(b))
    length_ok = F.lit(1) - F.abs(F.length(a) - F.length(b)) / longest >= F.lit(SIMILAR_AT)
    close = F.lit(1) - F.levenshtein(F.lower(a), F.lower(b)) / longest >= F.lit(SIMILAR_AT)
    present = F.coalesce((a != "") & (b != ""), F.lit(False))
    return F.when(present, F.when(length_ok, close).otherwise(False)).otherwise(False)


def author_bucket(uid: Column, n: int) -> Column:
    """Stable bucket of an id from a wrapping 32-bit polynomial hash."""
    units = F.split(uid, "")
    span = F.lit(4294967296)

    def step(acc: Column, ch: Column) -> Column:
        cp = F.ascii(ch).cast("bigint")
        # an astral character contributes its two UTF-16 units in turn
        high = F.lit(55296) + F.floor((cp - 65536) / 1024)
        low = F.lit(56320) + (cp - 65536) % 1024
        bmp = (acc * 31 + cp) % span
        pair = (((acc * 31 + high) % span) * 31 + low) % span
        return F.when(ch == "", acc).when(cp > 65535, pair).otherwise(bmp).cast("bigint")

    raw = F.aggregate(units, F.lit(0).cast("bigint"), step)
    signed = F.when(raw >= 2147483648, raw - span).otherwise(raw)
    return (F.abs(signed) % n).cast("int")
