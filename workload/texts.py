"""Scalar functions over documents, pages, conversations, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import chars, clock, names, parts as P, redact, tokens
from threadlens.operators import identity

from .tables import CHAT, CHATS, EVENT_BODY, EVENTS, chat_messages, chat_turns, event_messages, table, with_sql

QUERIES = {}
SQL = {}
NOTHING = ("nothing AS (SELECT 1)",)


def query(name, sql=None, ctes=NOTHING):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_sql(*ctes, body=sql)
        return fn

    return add


PHONE = r"(\+?[0-9]{1,3}[\s-]?)?\(?[0-9]{3}\)?[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}"


def redact_sql(col, stop=r"\s"):
    return (
        f"regexp_replace(regexp_replace(regexp_replace({col}, 'https?://[^{stop}]+', '[URL]', 'g'),"
        f" '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}', '[EMAIL]', 'g'), '{PHONE}', '[PHONE]', 'g')"
    )


@query("redact_documents", f"SELECT doc_id, md5({redact_sql('text')}) AS redacted FROM documents")
def redact_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(redact.redact(F.col("text"), True, True)).alias("redacted"))


@query("redact_pages_text_style", f"SELECT page_id, md5({redact_sql('html', chr(92) + 's' + chr(92) + ']')}) AS redacted FROM pages")
def redact_pages_text_style(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(redact.redact(F.col("html"), True, True, redact.URL_STOP_TXT)).alias("redacted"))


@query("redact_pages_markdown_style", f"SELECT page_id, md5({redact_sql('html', chr(92) + 's' + chr(92) + ']>)')}) AS redacted FROM pages")
def redact_pages_markdown_style(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(redact.redact(F.col("html"), True, True, redact.URL_STOP_MARKDOWN)).alias("redacted"))


#: Where pictographs lie.  Wider than the exact list, which the tables' texts don't tell apart.
EMOJI_SQL = (
    r"\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{231A}-\x{23FF}\x{25AA}-\x{27BF}"
    r"\x{2934}\x{2935}\x{2B05}-\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}"
)
NORM_DOC = (
    r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN starts_with(t, '[') OR starts_with(t, '> ') THEN '' ELSE"
    r" regexp_replace(t, '\^\{[^}]*\}', '', 'g') END, ':[A-Za-z0-9_+-]+:', '', 'g'), '[" + EMOJI_SQL + r"\x{FE0F}\x{200D}]', '', 'g'),"
    r" '[*_~`|\\]', '', 'g'), '\s+', ' ', 'g')))"
)


@query("norm_text", f"SELECT doc_id, md5({NORM_DOC}) AS norm FROM (SELECT doc_id, regexp_replace(text, '\\[([^\\]]*)\\]\\(\\S*?\\)', '\\1', 'g') AS t FROM documents)")
def norm_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(P.norm_text(F.array("text"))).alias("norm"))


#: Segments: words, digits, blanks, line breaks, other ASCII, runs of joined pictographs, any other character.
SEG = (
    r"[A-Za-z\x{C0}-\x{24F}]+|[0-9]+|[ \t]+|\r?\n(?:[ \t]*\r?\n)*|[\x00-\x7F]|"
    + f"[{EMOJI_SQL}]" + r"(?:[\x{FE0F}\x{200D}]" + f"[{EMOJI_SQL}]?)*|(?s:.)"
)
SEG_COST = """CASE WHEN u BETWEEN 65 AND 90 OR u BETWEEN 97 AND 122 OR u BETWEEN 192 AND 591
      THEN CASE WHEN n <= 6 THEN 100 ELSE 100 + CAST(floor((n - 6) / 6.5 + 0.5) AS BIGINT) * 100 END
    WHEN u BETWEEN 48 AND 57 THEN CAST(ceil(n / 3) AS BIGINT) * 100
    WHEN u IN (32, 9) THEN CASE WHEN n > 1 THEN 100 ELSE 0 END
    WHEN u IN (10, 13) THEN 100
    WHEN u > 65535 OR (u >= 12288 AND n >= 2) THEN 300 WHEN u >= 12288 THEN 150 ELSE 82 END"""


def token_sql(table_name, key, text):
    return f"""SELECT {key}, CAST(floor((sum({SEG_COST}) + 50) / 100) AS BIGINT) AS tokens
FROM (SELECT {key}, unicode(s) AS u, length(s) AS n FROM (SELECT {key}, unnest(regexp_extract_all({text}, '{SEG}')) AS s FROM {table_name}))
GROUP BY {key}"""


@query("token_estimate_documents", token_sql("documents", "doc_id", "text"))
def token_estimate_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tokens.estimate_tokens(F.col("text")).alias("tokens"))


@query("token_estimate_messages", token_sql("cmsgs", "msg_idx", "array_to_string(parts, chr(10))"), CHATS)
def token_estimate_messages(spark, sf_dir):
    m = chat_messages(spark, sf_dir)
    return m.select("msg_idx", tokens.estimate_tokens(F.array_join("parts", "\n")).alias("tokens"))


@query("tokens_from_chars", """
SELECT doc_id, CAST(floor(length(text) / 2.6::DOUBLE + 0.5) AS BIGINT) AS tokens, CAST(floor(length(text) * 2.6::DOUBLE + 0.5) AS BIGINT) AS chars FROM documents""")
def tokens_from_chars(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = F.length("text")
    return d.select("doc_id", tokens.tokens_from_chars(n).alias("tokens"), tokens.chars_from_tokens(n).alias("chars"))


U16 = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


@query("text_sizes", f"""
SELECT doc_id, CAST({U16.format('text')} AS BIGINT) AS units, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents""")
def text_sizes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", chars.u16len(F.col("text")).alias("units"), P.word_count(F.col("text")).alias("words"))


@query("message_cost", f"""
SELECT msg_idx, CAST(14 + coalesce(list_sum(list_transform(parts, lambda p: {U16.format('p')} + 3)), 0) AS BIGINT) AS cost FROM msgs""", (EVENT_BODY,))
def message_cost(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    return m.select("msg_idx", tokens.message_cost(F.col("parts")).alias("cost"))


@query("snippets", r"""
SELECT doc_id, CASE WHEN length(t) > 90 THEN substr(t, 1, 89) || '…' ELSE t END AS snippet FROM (
  SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def snippets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", P.snippet(F.col("text")).alias("snippet"))


@query("snowflakes", """
SELECT place, mid AS snowflake, t_ms AS ms, strftime(make_timestamp(t_ms * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(t_ms % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso FROM turns""", (CHAT,))
def snowflakes(spark, sf_dir):
    t = chat_turns(spark, sf_dir)
    ts = clock.snowflake_to_ts(F.col("mid"))
    return t.select("place", clock.ts_to_snowflake(ts).alias("snowflake"), clock.millis(ts).alias("ms"), clock.iso_millis(ts).alias("iso"))


@query("time_labels", """
SELECT event_id, strftime(ts, '%A, %b %d, %Y') AS divider, strftime(ts, '%-I:%M %p') AS clock, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS http,
  CASE WHEN hour(ts) < 5 THEN 'Night owls' WHEN hour(ts) < 9 THEN 'Early birds' WHEN hour(ts) < 12 THEN 'Morning crew' WHEN hour(ts) < 17 THEN 'Afternoon talkers' WHEN hour(ts) < 21 THEN 'Evening crew' ELSE 'Night owls' END AS persona
FROM events""")
def time_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    t = F.col("ts")
    return e.select("event_id", clock.day_divider(t).alias("divider"), clock.clock_time(t).alias("clock"),
                    clock.http_date(t).alias("http"), clock.persona(clock.hour_of(t)).alias("persona"))


@query("duration_labels", """
SELECT event_id, CASE WHEN s < 60 THEN '[+' || s || 's]' WHEN s < 3600 THEN '[+' || (s // 60) || 'm]' ELSE '[+' || (s // 3600) || 'h]' END AS delta,
  CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || ((s % 3600) // 60) || 'm' ELSE (s // 60) || 'm' END AS long
FROM (SELECT event_id, CAST(floor(value * 217) AS BIGINT) AS s FROM events)""")
def duration_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ms = F.floor(F.col("value") * 217).cast("bigint") * 1000
    return e.select("event_id", clock.time_delta(ms).alias("delta"), clock.long_duration(ms).alias("long"))


@query("parsed_clock_times", """
SELECT event_id, (epoch_us(date_trunc('minute', ts)) // 1000) AS us_ms, (epoch_us(ts) // 1000000) * 1000 AS iso_ms, (epoch_us(date_trunc('minute', ts)) // 1000) AS title_ms FROM events""")
def parsed_clock_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    us = F.date_format("ts", "M/d/yyyy h:mm a")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    title = F.date_format("ts", "EEEE, MMMM d, yyyy h:mm a")
    return e.select(
        "event_id",
        clock.millis(clock.parse_timestamp(us)).alias("us_ms"),
        clock.millis(clock.parse_timestamp(iso)).alias("iso_ms"),
        clock.millis(clock.parse_title_time(title)).alias("title_ms"),
    )


@query("day_edges", """
SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) // 1000 AS first_ms,
  epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) // 1000 + 86399999 AS last_ms, epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) // 1000 - 32400000 AS tokyo_ms FROM events""")
def day_edges(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    d = F.col("day")
    return days.select("day", clock.millis(clock.day_edge(d)).alias("first_ms"),
                       clock.millis(clock.day_edge(d, True)).alias("last_ms"),
                       clock.millis(clock.day_edge(d, False, "Asia/Tokyo")).alias("tokyo_ms"))


@query("escaped_pages", """
SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM pages""")
def escaped_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(redact.escape_html(F.col("html"))).alias("escaped"))


@query("guarded_cells", r"""
SELECT doc_id, CASE WHEN regexp_matches(c, '^[=+\-@\t\r]') THEN '''' || c ELSE c END AS cell FROM (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN 'x' ELSE '@' END || source AS c FROM documents)""")
def guarded_cells(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lead = F.get(F.array(F.lit("="), F.lit("-"), F.lit("x"), F.lit("@")), (F.col("doc_id") % 4).cast("int"))
    return d.select("doc_id", redact.guard_formula(F.concat(lead, "source")).alias("cell"))


@query("safe_file_names", r"""
SELECT page_id, CASE WHEN n = '' THEN 'export' ELSE n END AS name FROM (
  SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^\.+', ''), '[. ]+$', ''), 1, 120) AS n FROM pages)""")
def safe_file_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", redact.safe_filename(F.col("url")).alias("name"))


@query("media_tokens", r"""
SELECT page_id, '[' || CASE WHEN e = 'gif' THEN 'GIF' WHEN e IN ('png', 'jpg', 'jpeg', 'webp') THEN 'IMG' WHEN e IN ('mp4', 'mov', 'webm') THEN 'VID' ELSE 'MEDIA' END || ': ' || n || ']' AS token FROM (
  SELECT page_id, n, lower(string_split(n, '.')[-1]) AS e FROM (
    SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/')[-1] || CASE page_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.gif' WHEN 2 THEN '.mp4' ELSE '.pdf' END AS n FROM pages))""")
def media_tokens(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    ext = F.get(F.array(*[F.lit(x) for x in (".PNG", ".gif", ".mp4", ".pdf")]), (F.col("page_id") % 4).cast("int"))
    name = F.concat(P.url_file_name(F.col("url")), ext)
    return p.select("page_id", P.media_token(name).alias("token"))


@query("reaction_readings", r"""
SELECT msg_idx,
  array_to_string(list_transform(list_filter(string_split(blob, ','), lambda x: trim(split_part(x, ':', 1)) <> ''),
    lambda x: trim(split_part(x, ':', 1)) || '=' || CAST(coalesce(nullif(TRY_CAST(regexp_extract(split_part(x, ':', 2), '^\s*([+-]?[0-9]+)', 1) AS BIGINT), 0), 1) AS VARCHAR)), ';') AS stats,
  array_to_string(list_transform(string_split(blob, ','),
    lambda x: trim(CASE WHEN contains(x, ':') THEN regexp_extract(x, '^(.*):', 1) ELSE x END) || '=' || CAST(CASE WHEN contains(x, ':') THEN coalesce(nullif(TRY_CAST(regexp_extract(split_part(x, ':', -1), '^\s*([+-]?[0-9]+)', 1) AS BIGINT), 0), 1) ELSE 1 END AS VARCHAR)), ';') AS explorer
FROM enr WHERE blob IS NOT NULL""", EVENTS)
def reaction_readings(spark, sf_dir):
    m = event_messages(spark, sf_dir).withColumn("blob", P.last_blob(F.col("parts"))).where("blob IS NOT NULL")

    def shown(entries):
        return F.array_join(F.transform(entries, lambda e: F.concat(e["emoji"], F.lit("="), e["n"].cast("string"))), ";")

    return m.select("msg_idx", shown(P.reaction_entries(F.col("blob"))).alias("stats"),
                    shown(P.reaction_entries(F.col("blob"), "last")).alias("explorer"))


@query("display_parts", r"""
SELECT msg_idx, CASE WHEN r THEN regexp_replace(parts[1], '^>\s*', '') END AS reply,
  array_to_string(list_filter(list_transform(list_filter(rest, lambda p: NOT starts_with(p, '^')), lambda p: regexp_replace(p, '\s*(\^\{[^}]*\})\s*$', '')), lambda p: p <> ''), '|') AS lines,
  array_to_string(list_transform(list_filter(rest, lambda p: regexp_matches(p, '\^\{[^}]*\}\s*$')), lambda p: substr(regexp_extract(p, '(\^\{[^}]*\})\s*$', 1), 2)), '|') AS reactions
FROM (SELECT *, has_reply AND starts_with(parts[1], '>') AS r, CASE WHEN has_reply AND starts_with(parts[1], '>') THEN parts[2:] ELSE parts END AS rest FROM msgs)""", (EVENT_BODY,))
def display_parts(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    s = P.split_parts(F.col("parts"), F.col("has_reply"))
    m = m.select("msg_idx", s.alias("s"))
    return m.select("msg_idx", "s.reply", F.array_join("s.lines", "|").alias("lines"), F.array_join("s.reactions", "|").alias("reactions"))


PEOPLE_SQL = """who AS (SELECT c_custkey, CAST(c_custkey // 25 AS BIGINT) AS nick, lower(c_mktsegment) || '_' || CAST(c_custkey % 97 AS VARCHAR) AS username FROM customer)"""


def customer_handles(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        F.floor(F.col("c_custkey") / 25).alias("nick"),
        F.concat(F.lower("c_mktsegment"), F.lit("_"), (F.col("c_custkey") % 97).cast("string")).alias("username"),
    )


@query("similar_usernames", """
SELECT DISTINCT x.nick, x.username AS a, y.username AS b FROM who x JOIN who y ON x.nick = y.nick AND x.username < y.username
WHERE 1 - levenshtein(x.username, y.username) / greatest(length(x.username), length(y.username)) >= 0.6""", (PEOPLE_SQL,))
def similar_usernames(spark, sf_dir):
    return identity.similar_usernames(customer_handles(spark, sf_dir))


@query("name_tests", """
SELECT event_id, regexp_matches(n, '(?i)^(deleted user|unknown|deleted_user.*)$') AS placeholder FROM (
  SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'Deleted User' WHEN 1 THEN 'deleted_user_' || CAST(user_id AS VARCHAR) WHEN 2 THEN 'unknown' ELSE 'unknown ' || CAST(user_id AS VARCHAR) END AS n FROM events)""")
def name_tests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u = F.col("user_id").cast("string")
    n = (F.when(F.col("user_id") % 4 == 0, F.lit("Deleted User")).when(F.col("user_id") % 4 == 1, F.concat(F.lit("deleted_user_"), u))
         .when(F.col("user_id") % 4 == 2, F.lit("unknown")).otherwise(F.concat(F.lit("unknown "), u)))
    return e.select("event_id", names.is_placeholder(n).alias("placeholder"))


@query("author_buckets", """
SELECT c_custkey, CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 12 AS INTEGER) AS bucket FROM (
  SELECT c_custkey, list_reduce(list_transform(string_split(c_name, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, c: (a * 31 + c) % 4294967296, CAST(0 AS BIGINT)) AS h FROM customer)""")
def author_buckets(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", names.author_bucket(F.col("c_name"), 12).alias("bucket"))
