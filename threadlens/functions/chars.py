"""Character classes and string primitives with JavaScript meaning.

Spark ``trim`` strips only U+0020, Java ``\\s`` is ASCII and ``length`` counts
code points, while export text follows JavaScript rules: Unicode white space
and lengths in UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the export tools see it.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

# Code points with the Unicode property Extended_Pictographic.
PICTOGRAPHIC = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA
24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620
2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666
2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1
26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD
2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E
2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50
2B55 3030 303D 3297 3299 1F004 1F02C-1F02F 1F094-1F09F 1F0AF-1F0B0 1F0C0 1F0CF-1F0D0
1F0F6-1F0FF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1AF-1F1E5 1F201-1F20F 1F21A
1F22F 1F232-1F23A 1F23C-1F23F 1F249-1F25F 1F266-1F321 1F324-1F393 1F396-1F397
1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F3FA 1F400-1F4FD 1F4FF-1F53D 1F549-1F54E
1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5
1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF
1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6E5 1F6E9 1F6EB-1F6F0 1F6F3-1F6FF
1F7DC-1F7F0 1F80C-1F80F 1F848-1F84F 1F85A-1F85F 1F888-1F88F 1F8AE-1F8AF 1F8BC-1F8BF
1F8C2-1F8CF 1F8D9-1F8FF 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA58-1FA5F 1FA6E-1FAFF
1FC00-1FFFD
"""


def _class_body(ranges: str) -> str:
    out = []
    for item in ranges.split():
        out.append("-".join(rf"\x{{{edge}}}" for edge in item.split("-")))
    return "".join(out)


EMOJI_BODY = _class_body(PICTOGRAPHIC)
# The look-ahead rejects plain Latin text after one cheap test, so the long
# class is only consulted for characters that might be in it.
EMOJI = rf"(?![\x00-\xA8\xAF-\x{{200C}}])[{EMOJI_BODY}]"
EMOJI_OR_JOINER = rf"(?![\x00-\xA8\xAF-\x{{200C}}])[{EMOJI_BODY}\x{{FE0F}}\x{{200D}}]"


# Turns down everyday letters and signs with one cheap test each.
NOT_PLAIN = r"(?![!-~\xA1-\x{167F}])"


def js_trim(c: Column) -> Column:
    """Trim by the wide white-space class; untouched text is not searched."""
    edge = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1)).rlike(rf"[{WS}]")
    return F.when(edge, F.regexp_replace(c, rf"^[{WS}]+|{NOT_PLAIN}[{WS}]+$", "")).otherwise(c)


def squeeze_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"{NOT_PLAIN}[{WS}]+", " ")


def u16len(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def u16_clip(c: Column, units: int, tail: str) -> Column:
    """First ``units`` UTF-16 units followed by ``tail`` when ``c`` is longer.

    Text without astral characters takes the plain substring; otherwise the
    cut is made on the UTF-16 bytes, and a character split in half at the cut
    is dropped rather than left as half a surrogate pair.
    """
    raw = F.encode(c, "UTF-16BE")
    splits_pair = F.hex(F.substring(raw, units * 2 - 1, 1)).between("D8", "DB")
    keep = F.lit(units) - F.when(splits_pair, 1).otherwise(0)
    astral = F.decode(F.substring(raw, F.lit(1), keep * 2), "UTF-16BE")
    clipped = F.when(u16len(c) == F.length(c), F.substring(c, 1, units)).otherwise(astral)
    return F.when(u16len(c) > units, F.concat(clipped, F.lit(tail))).otherwise(c)


def non_empty(c: Column) -> Column:
    """Null for an empty string: the ``a || b`` fallback."""
    return F.when(c != "", c)


def js_round(c: Column) -> Column:
    """Half-up rounding, also for negative numbers."""
    return F.floor(c + F.lit(0.5)).cast("bigint")
