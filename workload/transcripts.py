"""Whole transcripts and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.operators import budget
from threadlens.plans import conversation
from threadlens.plans.options import Options
from threadlens.sinks import document, layout, markdown, page, txt

from .tables import CHATS, EVENT_BODY, EVENTS, chat_messages, event_messages, people_of, with_sql

QUERIES = {}
SQL = {}


def query(name, sql, ctes):
    def add(fn):
        QUERIES[name] = fn
        SQL[name] = with_sql(*ctes, body=sql)
        return fn

    return add


LAID = r"""laid AS (
  SELECT *, rest > 0 AND NOT coalesce(lastv.b = block AND lastv.a = author_id, false) AS has_head FROM (
    SELECT *, last_value(CASE WHEN rest > 0 THEN {'b': block, 'a': author_id} END IGNORE NULLS) OVER (PARTITION BY channel_id, day ORDER BY ts, msg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastv FROM (
      SELECT *, len(parts) - CAST(glued AS INTEGER) AS rest, sum(CASE WHEN divider <> 'none' THEN 1 ELSE 0 END) OVER (PARTITION BY channel_id, day ORDER BY ts, msg_idx) AS block FROM (
        SELECT *, coalesce(starts_with(parts[1], '^'), false) AND (divider <> 'none' OR NOT coalesce(above, false)) AS glued FROM (
          SELECT *, last_value(CASE WHEN len(parts) > 0 THEN parts[-1] LIKE '%:' WHEN divider <> 'none' THEN false END IGNORE NULLS) OVER (PARTITION BY channel_id, day ORDER BY ts, msg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM (
            SELECT *, CASE WHEN gap IS NULL THEN 'day' WHEN gap > 14400000 THEN 'break' ELSE 'none' END AS divider,
              CASE WHEN gap IS NULL OR gap > 3600000 THEN '[' || strftime(ts, '%-I:%M %p') || ']' WHEN gap < 60000 THEN '[+' || (gap // 1000) || 's]' WHEN gap < 3600000 THEN '[+' || (gap // 60000) || 'm]' ELSE '[+1h]' END AS time_text
            FROM (SELECT *, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY channel_id, day ORDER BY ts, msg_idx) AS gap FROM enr)))))))"""


@query("txt_layout", "SELECT channel_id, msg_idx, divider, time_text, glued, has_head FROM laid", (*EVENTS, LAID))
def txt_layout(spark, sf_dir):
    rows = layout.txt_layout(layout.narrow(event_messages(spark, sf_dir)))
    return rows.select("channel_id", "msg_idx", "divider", "time_text", "glued", "has_head")


LONG_GAP = "CASE WHEN gap >= 3600000 THEN (gap // 3600000) || 'h ' || ((gap % 3600000) // 60000) || 'm' ELSE (gap // 60000) || 'm' END"
DAY_TEXT = "strftime(ts, '%A, %b %d, %Y')"
LAST = "4611686018427387904"
#: The transcripts leave one channel without messages, which gets the empty document.
SHOWN = "shown AS (SELECT * FROM msgs WHERE channel_id <> 'view')"
EMPTY = "(SELECT DISTINCT channel_id FROM msgs WHERE channel_id = 'view')"
LABELS = "labels AS (SELECT author_id AS uid, min(author_name) AS label FROM msgs GROUP BY 1)"
SHARES = """shares AS (
  SELECT channel_id, author_id AS uid, label, n, (t // 10) || '.' || (t % 10) AS pct, CAST(substr(author_id, 2) AS BIGINT) AS num FROM (
    SELECT *, CAST((n * 2000 + sum(n) OVER (PARTITION BY channel_id)) // (sum(n) OVER (PARTITION BY channel_id) * 2) AS BIGINT) AS t
    FROM (SELECT channel_id, author_id, count(*) AS n FROM shown GROUP BY 1, 2)) JOIN labels ON uid = author_id)"""
STARTS = "starts AS (SELECT channel_id, strftime(min(ts), '%a, %d %b %Y %H:%M:%S GMT') AS start, count(*) AS total FROM shown GROUP BY 1)"


def document_rows(rows):
    """Rows of a transcript; participants with equal keys are ordered by a hash, which is left out."""
    legend = F.col("sect") == document.LEGEND
    return rows.select(
        "channel_id", "sect", "k1", F.when(~legend, F.col("k2")).alias("k2"), F.when(~legend, F.col("k3")).alias("k3"), "text"
    )


def fixed_row(sect: int, text: str, source: str = "starts", k1: str = "0") -> str:
    other = "NULL" if sect == 1 else "0"
    return (
        f"SELECT channel_id, {sect} AS sect, CAST({k1} AS BIGINT) AS k1, CAST({other} AS BIGINT) AS k2, "
        f"CAST({other} AS BIGINT) AS k3, {text} AS text FROM {source}"
    )


TXT_LINED = """lined AS (
  SELECT *, divider <> 'none' OR rest > 0 AS owns, sum(CASE WHEN divider <> 'none' OR rest > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY channel_id, day ORDER BY ts, msg_idx) AS line_no FROM laid),
tails AS (
  SELECT channel_id, day, line_no - CAST(owns AS INTEGER) AS line_no, string_agg(parts[1], ' ' ORDER BY ts, msg_idx) AS tail
  FROM lined WHERE glued AND divider = 'none' GROUP BY ALL)"""
TXT_SQL = f"""
{fixed_row(0, "'# LLM-Optimized Chat Log (Limit: ~1,375,000 tokens)' || chr(10) || '# Start: ' || start || chr(10) || '# Participants:'")}
UNION ALL {fixed_row(1, "'# ' || uid || ': ' || label || ' (' || n || ' msgs, ' || pct || '%)'", "shares", "num")}
UNION ALL {fixed_row(1, "''", k1=LAST)}
UNION ALL {fixed_row(0, "'No messages found or file empty.'", EMPTY)}
UNION ALL
SELECT channel_id, 2, epoch_us(ts), 0, msg_idx, array_to_string(list_concat(list_concat(
    CASE WHEN divider = 'none' THEN CAST([] AS VARCHAR[]) ELSE [chr(10) || CASE divider WHEN 'day' THEN '=== ' || {DAY_TEXT} || ' ===' ELSE '=== SESSION BREAK (' || {LONG_GAP} || ') ===' END || CASE WHEN glued THEN ' ' || parts[1] ELSE '' END] END,
    CASE WHEN has_head THEN [chr(10) || time_text || ' ' || author_id || ':'] ELSE CAST([] AS VARCHAR[]) END),
    list_transform(CASE WHEN glued THEN parts[2:] ELSE parts END, lambda p: '  ' || p)), chr(10)) || coalesce(' ' || tail, '')
FROM lined LEFT JOIN tails USING (channel_id, day, line_no) WHERE owns AND channel_id <> 'view'"""


@query("txt_transcript", TXT_SQL, (*EVENTS, LAID, LABELS, SHOWN, SHARES, STARTS, TXT_LINED))
def txt_transcript(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    options = document.RenderOptions(redact_urls=True, redact_emails=True)
    return document_rows(txt.render(m.where("channel_id <> 'view'"), people_of(m), options, channels=m))


MARKDOWN_SQL = f"""
{fixed_row(0, "'# Chat Log (~1,375,000 token limit)' || chr(10) || '**Start:** ' || start || chr(10) || chr(10) || '## Participants'")}
UNION ALL {fixed_row(1, "'- **' || uid || '**: ' || label || ' (' || n || ' msgs, ' || pct || '%)'", "shares", "num")}
UNION ALL {fixed_row(1, "chr(10) || '---' || chr(10)", k1=LAST)}
UNION ALL {fixed_row(0, "'No messages found.'", EMPTY)}
UNION ALL
SELECT channel_id, 2, epoch_us(ts), 0, msg_idx, CASE WHEN f THEN '## ' || {DAY_TEXT} || chr(10) || chr(10) ELSE '' END || '**[' || strftime(ts, '%-I:%M %p') || '] ' || author_id || ':**' || chr(10) ||
  CASE WHEN len(parts) > 0 THEN array_to_string(parts, chr(10)) || chr(10) ELSE '' END
FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, msg_idx) = 1 AS f FROM shown)"""


@query("markdown_transcript", MARKDOWN_SQL, (EVENT_BODY, LABELS, SHOWN, SHARES, STARTS))
def markdown_transcript(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    return document_rows(markdown.render(m.where("channel_id <> 'view'"), people_of(m), channels=m))


def escaped(x: str) -> str:
    return f"""replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')"""


def hue_style(uid: str) -> str:
    h = f"list_reduce(list_transform(string_split({uid}, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, c: (a * 31 + c) % 4294967296, CAST(0 AS BIGINT))"
    return f"""' style="color:hsl(' || (abs(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END) % 12 * 30) || ' 60% 40%)"'"""


def page_line(x: str) -> str:
    marked = rf"""regexp_replace({escaped(x)}, '\[(IMG|GIF|VID|MEDIA|YT|EMBED|STICKER)(:[^\]]*)?\]', '<kbd>\0</kbd>', 'g')"""
    return rf"""regexp_replace({marked}, 'https?://[^<\s]+', '<a href="\0" rel="noreferrer">\0</a>', 'g')"""


PAGE_START = """'<!doctype html><meta charset="utf-8"><title>Chat Log</title><style>body{font-family:system-ui;line-height:1.5;margin:2em auto;max-width:44em}article{margin-top:1em}article.same{margin-top:0}p{margin:0;white-space:pre-line}time,small,blockquote{opacity:.65}h2{border-bottom:thin solid;font-size:1em}</style>' || chr(10) || '<h1>Chat Log</h1>' || chr(10)"""
PAGE_PARTS = r"""cut AS (
  SELECT *, CASE WHEN r THEN regexp_replace(parts[1], '^>\s*', '') END AS reply,
    list_filter(list_transform(list_filter(rest, lambda p: NOT starts_with(p, '^')), lambda p: regexp_replace(p, '\s*(\^\{[^}]*\})\s*$', '')), lambda p: p <> '') AS lines,
    list_transform(list_filter(rest, lambda p: regexp_matches(p, '\^\{[^}]*\}\s*$')), lambda p: regexp_extract(p, '\^\{([^}]*)\}\s*$', 1)) AS groups
  FROM (SELECT *, has_reply AND starts_with(parts[1], '>') AS r, CASE WHEN has_reply AND starts_with(parts[1], '>') THEN parts[2:] ELSE parts END AS rest FROM (
    SELECT *, CASE WHEN gap IS NULL THEN 'day' WHEN gap > 14400000 THEN 'break' ELSE 'none' END AS divider FROM (
      SELECT *, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w AS gap, lag(author_id) OVER w AS above FROM enr WHERE channel_id <> 'view' WINDOW w AS (PARTITION BY channel_id, day ORDER BY ts, msg_idx))))),
told AS (
  SELECT *, coalesce(reply <> '', false) AS is_reply, CASE WHEN regexp_matches(reply, '^[^\s]+?:') THEN regexp_extract(reply, '^([^\s]+?):', 1) ELSE '' END AS named,
    CASE WHEN regexp_matches(reply, '^[^\s]+?:') THEN regexp_replace(reply, '^[^\s]+?:\s*', '') ELSE reply END AS said,
    list_filter(list_transform(flatten(list_transform(groups, lambda g: string_split(g, ','))), lambda t: trim(t)), lambda t: t <> '') AS tokens
  FROM cut)"""
HTML_SQL = f"""
{fixed_row(0, PAGE_START + " || '<p>' || format('{:,}', total) || ' messages · from ' || start || ' (UTC)</p>' || chr(10) || '<ul>'")}
UNION ALL {fixed_row(1, "'<li><strong' || " + hue_style("uid") + " || '>' || " + escaped("label") + " || '</strong> <small>' || n || ' · ' || pct || '%</small></li>'", "shares", "-n")}
UNION ALL {fixed_row(1, "'</ul>' || chr(10) || '<main>'", k1=LAST)}
UNION ALL {fixed_row(3, "'</main>'")}
UNION ALL {fixed_row(0, PAGE_START + " || '<main><p>No messages found.</p></main>'", EMPTY)}
UNION ALL
SELECT channel_id, 2, epoch_us(ts), 0, msg_idx,
  CASE divider WHEN 'day' THEN '<h2>' || {DAY_TEXT} || '</h2>' || chr(10) WHEN 'break' THEN '<h2>Session break · ' || {LONG_GAP} || '</h2>' || chr(10) ELSE '' END ||
  '<article' || CASE WHEN same THEN ' class="same"' ELSE '' END || '>' ||
  CASE WHEN same THEN '' ELSE '<strong' || {hue_style("author_id")} || '>' || {escaped("a.label")} || '</strong> <time>' || strftime(ts, '%-I:%M %p') || '</time>' END ||
  CASE WHEN is_reply THEN '<blockquote><cite>' || {escaped("coalesce(b.label, named)")} || '</cite> ' || {page_line("said")} || '</blockquote>' ELSE '' END ||
  CASE WHEN len(lines) > 0 THEN '<p>' || array_to_string(list_transform(lines, lambda p: {page_line("p")}), chr(10)) || '</p>' ELSE '' END ||
  CASE WHEN len(tokens) > 0 THEN '<footer>' || array_to_string(list_transform(tokens, lambda t: '<small>' || regexp_replace({escaped("t")}, '^(.*?):(\\d+)$', '\\1 × \\2') || '</small>'), ' ') || '</footer>' ELSE '' END || '</article>'
FROM (SELECT *, divider = 'none' AND coalesce(above = author_id, false) AND NOT is_reply AS same FROM told) t JOIN labels a ON a.uid = author_id LEFT JOIN labels b ON b.uid = named"""


@query("html_transcript", HTML_SQL, (*EVENTS, LABELS, SHOWN, SHARES, STARTS, PAGE_PARTS))
def html_transcript(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    return document_rows(page.render(m.where("channel_id <> 'view'"), people_of(m), channels=m))


# ── the trim, by measuring every cut ────────────────────────────────────────


def laid_out(source: str, keys: str) -> str:
    """The layout of the rows of ``source``, days and dividers apart, inside groups of ``keys``."""
    w = f"(PARTITION BY {keys} ORDER BY ts, msg_idx"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""(
  SELECT *, rest > 0 AND NOT coalesce(lastv.b = block AND lastv.a = author_id, false) AS has_head FROM (
    SELECT *, last_value(CASE WHEN rest > 0 THEN {{'b': block, 'a': author_id}} END IGNORE NULLS) OVER {w} {before} AS lastv FROM (
      SELECT *, len(parts) - CAST(glued AS INTEGER) AS rest, sum(CASE WHEN divider <> 'none' THEN 1 ELSE 0 END) OVER {w}) AS block FROM (
        SELECT *, coalesce(starts_with(parts[1], '^'), false) AND (divider <> 'none' OR NOT coalesce(above, false)) AS glued FROM (
          SELECT *, last_value(CASE WHEN len(parts) > 0 THEN parts[-1] LIKE '%:' WHEN divider <> 'none' THEN false END IGNORE NULLS) OVER {w} {before} AS above FROM (
            SELECT *, CASE WHEN gap IS NULL THEN 'day' WHEN gap > 14400000 THEN 'break' ELSE 'none' END AS divider,
              CASE WHEN gap IS NULL OR gap > 3600000 THEN '[' || strftime(ts, '%-I:%M %p') || ']' WHEN gap < 60000 THEN '[+' || (gap // 1000) || 's]' WHEN gap < 3600000 THEN '[+' || (gap // 60000) || 'm]' ELSE '[+1h]' END AS time_text
            FROM (SELECT *, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER {w}) AS gap FROM {source})))))))"""


def trim_ctes(priority: str, size, limit: int, shown: str, blank: int, source: str = "enr") -> tuple[str, ...]:
    """Sizes, in hundredths, of every cut of every channel: ``j`` is the oldest normal message kept, null if none is.

    The header is measured for the 400 largest cuts whose bodies fit, and for none kept.
    Of a cut's size the days after its own are laid out whole, those before it with
    their priority messages alone, and its own day once more for the cut.
    """
    nl = "chr(10)"
    line = f"""{size(f"CASE WHEN divider = 'none' THEN '' ELSE {nl} || {nl} || CASE divider WHEN 'day' THEN '=== ' || {DAY_TEXT} || ' ===' ELSE '=== SESSION BREAK (' || {LONG_GAP} || ') ===' END END || CASE WHEN has_head THEN {nl} || {nl} || time_text || ' ' || author_id || ':' ELSE '' END")} + CASE WHEN glued THEN glued_size ELSE own_size END"""
    own = size(f"array_to_string(list_transform(parts, lambda p: {nl} || '  ' || p), '')")
    glued = size(f"' ' || parts[1] || array_to_string(list_transform(parts[2:], lambda p: {nl} || '  ' || p), '')")
    first = f"'# LLM-Optimized Chat Log (Limit: ~{shown} tokens)' || {nl} || '# Start: ' || strftime(start, '%a, %d %b %Y %H:%M:%S GMT') || {nl} || '# Participants:'"
    entry = f"{nl} || '# ' || author_id || ': ' || label || ' (' || n || ' msgs, ' || (t // 10) || '.' || (t % 10) || '%)'"
    return (
        f"""sized AS MATERIALIZED (
  SELECT *, {own} AS own_size, CASE WHEN len(parts) > 0 AND starts_with(parts[1], '^') THEN {glued} ELSE 0 END AS glued_size, {priority} AS pri,
    row_number() OVER (PARTITION BY channel_id ORDER BY ts, msg_idx) AS i FROM {source})""",
        f"""whole AS (SELECT channel_id, day, sum({line}) AS s FROM {laid_out("sized", "channel_id, day")} GROUP BY ALL)""",
        f"""kept_only AS (SELECT channel_id, day, sum({line}) AS s FROM {laid_out("(SELECT * FROM sized WHERE pri)", "channel_id, day")} GROUP BY ALL)""",
        """per_day AS (SELECT channel_id, day, w.s AS whole, coalesce(k.s, 0) AS fixed FROM whole w LEFT JOIN kept_only k USING (channel_id, day))""",
        """around AS (SELECT *, sum(whole) OVER (PARTITION BY channel_id ORDER BY day DESC) - whole + sum(fixed) OVER (PARTITION BY channel_id ORDER BY day) - fixed AS outside FROM per_day)""",
        """own_day AS (SELECT a.* EXCLUDE (pri), a.pri, b.i AS j FROM sized b JOIN sized a ON a.channel_id = b.channel_id AND a.day = b.day AND (a.i >= b.i OR a.pri) WHERE NOT b.pri)""",
        f"""bodies AS MATERIALIZED (
  SELECT channel_id, j, sum(l) + any_value(outside) AS body FROM (SELECT channel_id, day, j, {line} AS l FROM {laid_out("own_day", "channel_id, j")}) JOIN around USING (channel_id, day) GROUP BY ALL
  UNION ALL SELECT channel_id, NULL, sum(fixed) FROM per_day GROUP BY ALL)""",
        f"""near AS (SELECT * FROM bodies WHERE body <= {limit} * 100 + 50 QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY j NULLS LAST) <= 400 OR j IS NULL)""",
        """counts AS (SELECT n.channel_id, n.j, s.author_id, count(*) AS n, min(s.ts) AS start FROM near n JOIN sized s ON s.channel_id = n.channel_id AND (s.pri OR s.i >= n.j) GROUP BY ALL)""",
        """parts_of AS (SELECT *, CAST((n * 2000 + sum(n) OVER (PARTITION BY channel_id, j)) // (sum(n) OVER (PARTITION BY channel_id, j) * 2) AS BIGINT) AS t FROM counts)""",
        f"""headers AS (SELECT channel_id, j, sum(s) + {size(first.replace("start", "min(start)"))} + any_value(blank) AS header FROM (SELECT channel_id, j, start, {size(entry)} AS s, {blank} AS blank FROM parts_of JOIN labels ON uid = author_id) GROUP BY channel_id, j)""",
        f"""fitting AS (SELECT channel_id, near.j, CAST((body + header + 50) // 100 AS BIGINT) AS size FROM near JOIN headers h USING (channel_id) WHERE near.j IS NOT DISTINCT FROM h.j)""",
    )


def trim_sql(limit: int, least: int) -> str:
    return f"""
SELECT channel_id, total, coalesce(kept, 0) AS kept, coalesce(c.size, z.size) AS size, c.channel_id IS NULL AND fixed > 0 AS budget_exceeded
FROM (SELECT channel_id, count(*) AS total, count(*) FILTER (WHERE pri) AS fixed FROM sized GROUP BY 1)
LEFT JOIN (SELECT * FROM fitting WHERE size <= {limit} QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY j NULLS LAST) = 1) c USING (channel_id)
LEFT JOIN (SELECT channel_id, size FROM fitting WHERE j IS NULL) z USING (channel_id)
LEFT JOIN (SELECT channel_id AS k_id, j AS k_j, CAST(sum(n) AS BIGINT) AS kept FROM counts WHERE n >= {least} GROUP BY ALL) ON k_id = channel_id AND k_j IS NOT DISTINCT FROM c.j"""


def utf16(x: str) -> str:
    return f"((length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))) * 100)"


#: Segments of texts whose emoji stand alone: words, digits, blanks, line breaks, any other character.
SEGMENTS = r"[A-Za-z\x{C0}-\x{24F}]+|[0-9]+|[ \t]+|\r?\n(?:[ \t]*\r?\n)*|(?s:.)"
SEGMENT_COST = """CASE WHEN unicode(s) BETWEEN 65 AND 90 OR unicode(s) BETWEEN 97 AND 122 OR unicode(s) BETWEEN 192 AND 591
    THEN CASE WHEN length(s) <= 6 THEN 100 ELSE 100 + CAST(floor((length(s) - 6) / 6.5 + 0.5) AS BIGINT) * 100 END
  WHEN unicode(s) BETWEEN 48 AND 57 THEN CAST(ceil(length(s) / 3) AS BIGINT) * 100 WHEN unicode(s) IN (32, 9) THEN CASE WHEN length(s) > 1 THEN 100 ELSE 0 END
  WHEN unicode(s) IN (10, 13) THEN 100 WHEN unicode(s) > 65535 THEN 300 WHEN unicode(s) >= 12288 THEN 150 ELSE 82 END"""


def token_cost(x: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all({x}, '{SEGMENTS}'), lambda s: {SEGMENT_COST})), 0)"


@query("budget_trim", trim_sql(6950, 1), (*EVENTS, LABELS, *trim_ctes(r"regexp_matches(array_to_string(parts, ' '), '(?i)\*k9\*')", token_cost, 6950, "8,000", 0)))
def budget_trim(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    return budget.trim(m, people_of(m), max_tokens=8000, keywords=("*k9*",)).report


@query("budget_trim_characters", trim_sql(30_000, 2), (*EVENTS, LABELS, *trim_ctes("false", utf16, 30_000, "7,500", 100)))
def budget_trim_characters(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    return budget.trim(m, people_of(m), max_chars=30000, min_messages=2).report


PLAIN_CHATS = "chats AS (SELECT *, make_timestamp(t_ms * 1000) AS ts, strftime(make_timestamp(t_ms * 1000), '%Y-%m-%d') AS day FROM cmsgs WHERE NOT is_system)"


@query("processed_conversation", trim_sql(17_150, 1), (*CHATS, LABELS.replace("FROM msgs", "FROM cmsgs"), PLAIN_CHATS, *trim_ctes("false", token_cost, 17_150, "20,000", 0, "chats")))
def processed_conversation(spark, sf_dir):
    m = chat_messages(spark, sf_dir)
    return conversation.process(m, people_of(m), Options(max_tokens=20_000, drop_system=True)).report
