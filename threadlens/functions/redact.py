"""Redaction of links, mail addresses and phone numbers; escaping for sinks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import WS

# What counts as a link, an address or a phone number.
URL_STOP_PLAIN = WS
URL_STOP_TXT = WS + r"\]"
URL_STOP_MARKDOWN = WS + r"\]>)"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = rf"(\+?[0-9]{{1,3}}[{WS}-]?)?\(?[0-9]{{3}}\)?[{WS}.-]?[0-9]{{3}}[{WS}.-]?[0-9]{{4}}"


def redact(
    text: Column, urls: bool = False, emails: bool = False, url_stop: str = URL_STOP_PLAIN
) -> Column:
    """Links first, then addresses, then phone numbers.

    ``emails`` covers phone numbers too.  The cheap ``contains``/digit guards
    keep the slow patterns away from text that cannot match.
    """
    out = text
    if urls:
        out = F.when(
            out.contains("://"), F.regexp_replace(out, rf"https?://[^{url_stop}]+", "[URL]")
        ).otherwise(out)
    if emails:
        out = F.when(out.contains("@"), F.regexp_replace(out, EMAIL, "[EMAIL]")).otherwise(out)
        out = F.when(out.rlike("[0-9]{4}"), F.regexp_replace(out, PHONE, "[PHONE]")).otherwise(out)
    return out


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    out = F.replace(out, F.lit('"'), F.lit("&quot;"))
    return F.replace(out, F.lit("'"), F.lit("&#39;"))


def guard_formula(cell: Column) -> Column:
    """Keep a spreadsheet from reading a cell as a formula."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def safe_filename(name: Column) -> Column:
    out = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    out = F.regexp_replace(out, r"^\.+", "")
    out = F.substring(F.regexp_replace(out, r"[. ]+$", ""), 1, 120)
    return F.when(out == "", F.lit("export")).otherwise(out)
