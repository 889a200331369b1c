"""Functions over message parts.

A message body is an ordered array of strings: an optional reply token
``> uid: snippet`` first, then text, media tokens ``[IMG: f]`` and reaction
tokens ``^{👍:3, 🔥:1}``, which may also sit at the end of a text part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import EMOJI_OR_JOINER, WS, js_trim, non_empty, squeeze_ws, u16_clip

# Token kinds that count as media.
MEDIA_TYPES = ("IMG", "GIF", "VID", "MEDIA", "YT", "EMBED", "STICKER")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "gif")
VIDEO_EXTENSIONS = ("mp4", "mov", "webm")

BLOB = r"\^\{([^}]*)\}"
BLOB_WITH_SPACE = rf"[{WS}]*\^\{{[^}}]*\}}[{WS}]*"


def starts(p: Column, prefix: str) -> Column:
    return p.startswith(prefix)


def norm_text(parts: Column) -> Column:
    """Text reduced to what all export formats share, for matching copies."""
    linked = F.transform(parts, lambda p: F.regexp_replace(p, rf"\[([^\]]*)\]\([^{WS}]*?\)", "$1"))
    kept = F.filter(linked, lambda p: ~(starts(p, "[") | starts(p, "> ")))
    joined = F.array_join(F.transform(kept, lambda p: F.regexp_replace(p, r"\^\{[^}]*\}", "")), " ")
    bare = F.regexp_replace(joined, r":[A-Za-z0-9_+-]+:", "")
    bare = F.regexp_replace(bare, EMOJI_OR_JOINER, "")
    bare = F.regexp_replace(bare, r"[*_~`|\\]", "")
    return F.lower(js_trim(squeeze_ws(bare)))


def text_pieces(parts: Column) -> Column:
    """Text parts without reply, media and reaction tokens."""
    body = F.filter(parts, lambda p: ~(starts(p, "> ") | starts(p, "[")))
    clean = F.transform(body, lambda p: js_trim(F.regexp_replace(p, BLOB_WITH_SPACE, "")))
    return F.filter(clean, lambda p: p != "")


def plain_text(parts: Column) -> Column:
    return F.array_join(text_pieces(parts), " ")


def media_count(parts: Column) -> Column:
    """Every bracketed part, whatever its kind."""
    return F.size(F.filter(parts, lambda p: starts(p, "["))).cast("bigint")


def media_types(parts: Column) -> Column:
    """Kinds of the media tokens, non-media brackets left out."""
    kinds = F.transform(parts, lambda p: F.regexp_extract(p, r"^\[([A-Z]+)(?::|\])", 1))
    return F.filter(kinds, lambda k: k.isin(*MEDIA_TYPES))


def is_reply(parts: Column) -> Column:
    """Any part that opens like a reply; body blockquotes count as well."""
    return F.exists(parts, lambda p: starts(p, "> "))


def reply_target(parts: Column) -> Column:
    hits = F.filter(parts, lambda p: p.rlike(r"^>\s*[^:]+:"))
    found = F.regexp_extract(F.get(hits, F.lit(0)), rf"^>[{WS}]*([^:]+):", 1)
    return js_trim(found)


def last_blob(parts: Column) -> Column:
    """Inside of the reaction token in the last part that has one, else null."""
    holders = F.filter(parts, lambda p: p.rlike(BLOB))
    return F.regexp_extract(F.try_element_at(holders, F.lit(-1)), BLOB, 1)


def all_blobs(parts: Column) -> Column:
    return F.flatten(
        F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(BLOB), F.lit(1)))
    )


def parse_int(s: Column) -> Column:
    """Leading integer of a text, else null."""
    return F.regexp_extract(s, rf"^[{WS}]*([+-]?[0-9]+)", 1).try_cast("bigint")


def reaction_entries(blob: Column, count_at: str = "second", missing: int = 1) -> Column:
    """Reaction token body as ``array<struct<emoji, n>>``.

    ``count_at='second'`` reads the piece after the first colon, ``'last'``
    the one after the last colon.  A missing or unreadable count is ``missing``.
    """

    def one(entry: Column) -> Column:
        if count_at == "second":
            pieces = F.split(entry, ":")
            name, count = F.get(pieces, F.lit(0)), F.get(pieces, F.lit(1))
        else:
            has_colon = entry.contains(":")
            name = F.when(has_colon, F.regexp_extract(entry, r"(?s)^(.*):", 1)).otherwise(entry)
            count = F.when(has_colon, F.substring_index(entry, ":", -1))
        n = parse_int(count)
        value = F.when(n.isNull() | (n == 0), F.lit(missing).cast("bigint")).otherwise(n)
        return F.struct(js_trim(name).alias("emoji"), value.alias("n"))

    entries = F.transform(F.split(blob, ","), one)
    return F.filter(entries, lambda e: e["emoji"] != "")


def reaction_total(parts: Column) -> Column:
    """Sum over all reaction tokens; an entry without a count adds nothing."""
    entries = F.flatten(F.transform(all_blobs(parts), lambda b: F.split(b, ",")))

    def amount(entry: Column) -> Column:
        n = F.when(entry.contains(":"), parse_int(F.substring_index(entry, ":", -1)))
        return F.coalesce(n, F.lit(0).cast("bigint"))

    return F.aggregate(entries, F.lit(0).cast("bigint"), lambda acc, e: acc + amount(e))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, rf"[{WS}]+"), lambda w: w != "")).cast("bigint")


def snippet(text: Column, limit: int = 90) -> Column:
    """One line of at most ``limit`` units; the cut keeps room for the ellipsis."""
    flat = js_trim(squeeze_ws(text))
    clipped = u16_clip(flat, limit - 1, "…")
    fits = F.octet_length(F.encode(flat, "UTF-16BE")) <= 2 * limit
    return F.when(fits, flat).otherwise(clipped)


def has_text(parts: Column) -> Column:
    return F.exists(parts, lambda p: ~p.rlike(r"^[\[^>]"))


def media_token(file_name: Column, blank_is_media: bool = True) -> Column:
    """``[IMG: f]``, ``[GIF: f]``, ``[VID: f]`` or ``[MEDIA: f]`` by extension."""
    ext = F.lower(F.substring_index(file_name, ".", -1))
    kind = (
        F.when(ext == "gif", "GIF")
        .when(ext.isin(*IMAGE_EXTENSIONS), "IMG")
        .when(ext.isin(*VIDEO_EXTENSIONS), "VID")
        .otherwise("MEDIA")
    )
    token = F.concat(F.lit("["), kind, F.lit(": "), file_name, F.lit("]"))
    return token if blank_is_media else F.when(file_name != "", token)


def url_file_name(url: Column) -> Column:
    """Last path segment of a link, percent-decoded where that is possible."""
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(path, r"[?#].*$", "")
    # '+' is a literal in a path, while url decoding would turn it into a space
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.substring_index(F.substring_index(decoded, "/", -1), "?", 1)


def assemble_parts(
    reply_uid: Column, has_reply: Column, snippet_text: Column, parts: Column, reactions: Column
) -> Column:
    """Reply token, body, reactions glued to the last part unless it is media."""
    head = F.when(
        has_reply, F.array(F.concat(F.lit("> "), reply_uid, F.lit(": "), snippet_text))
    ).otherwise(F.array().cast("array<string>"))
    body = F.concat(head, parts)
    last = F.try_element_at(body, F.lit(-1))
    glue = (F.size(body) > 0) & ~starts(last, "[")
    glued = F.concat(
        F.slice(body, F.lit(1), F.greatest(F.size(body) - 1, F.lit(0))),
        F.array(F.concat(last, F.lit(" "), reactions)),
    )
    return (
        F.when(non_empty(reactions).isNull(), body)
        .when(glue, glued)
        .otherwise(F.concat(body, F.array(reactions)))
    )


def split_parts(parts: Column, has_reply: Column) -> Column:
    """``struct<reply, lines array, reactions array>`` for display."""
    first = F.get(parts, F.lit(0))
    reply_first = F.coalesce(has_reply, F.lit(True)) & F.coalesce(starts(first, ">"), F.lit(False))
    reply = F.when(reply_first, F.regexp_replace(first, rf"^>[{WS}]*", ""))
    rest = F.when(
        reply_first, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    ).otherwise(parts)
    tail = rf"[{WS}]*(\^\{{[^}}]*\}})[{WS}]*$"
    reactions = F.filter(
        F.transform(
            rest,
            lambda p: F.when(starts(p, "^"), F.substring(p, 2, 1 << 30)).otherwise(
                F.substring(non_empty(F.regexp_extract(p, tail, 1)), 2, 1 << 30)
            ),
        ),
        lambda r: r.isNotNull(),
    )
    body = F.filter(rest, lambda p: ~starts(p, "^"))
    # only a part that carried a trailing reaction group is trimmed at its end
    lines = F.transform(body, lambda p: F.regexp_replace(p, tail, ""))
    lines = F.filter(lines, lambda p: p != "")
    return F.struct(reply.alias("reply"), lines.alias("lines"), reactions.alias("reactions"))
