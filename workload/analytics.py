"""Statistics, graph and sequence queries over the events as messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import clock
from threadlens.operators import analytics as A
from threadlens.operators import filters, graph, sequences as S
from threadlens.session import materialize

from .tables import EVENT_BODY, EVENTS, event_messages, people_of, table, with_sql

QUERIES = {}
SQL = {}


def query(name, sql=None, ctes=EVENTS):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_sql(*ctes, body=sql)
        return fn

    return add


def enriched(spark, sf_dir, tz="UTC"):
    return A.enrich(event_messages(spark, sf_dir), tz)


def ms(name):
    return clock.millis(F.col(name)).alias(name)


@query("totals", """
SELECT count(*) AS messages, count(DISTINCT author_id) AS participants, count(DISTINCT day) AS active_days,
  (SELECT hour FROM enr GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 1) AS peak_hour,
  (SELECT CAST(sum(CASE WHEN n IS NULL OR n = 0 THEN 1 ELSE n END) AS BIGINT) FROM (
     SELECT TRY_CAST(regexp_extract(split_part(x, ':', 2), '^\\s*([+-]?[0-9]+)', 1) AS BIGINT) AS n, trim(split_part(x, ':', 1)) AS e
     FROM (SELECT unnest(string_split(blob, ',')) AS x FROM enr WHERE blob IS NOT NULL)) WHERE e <> '') AS reactions,
  (epoch_us(min(ts)) // 1000) AS "start", (epoch_us(max(ts)) // 1000) AS "end"
FROM enr""".replace("\\\\", "\\"))
def totals(spark, sf_dir):
    t = A.totals(enriched(spark, sf_dir))
    return t.withColumn("start", ms("start")).withColumn("end", ms("end"))


@query("heatmap", "SELECT dow, hour, count(*) AS n FROM enr GROUP BY dow, hour")
def heatmap(spark, sf_dir):
    return A.heatmap(enriched(spark, sf_dir))


@query("heatmap_dense", """
SELECT d.d AS dow, h.h AS hour, coalesce(n, 0) AS n, round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE 0.15 + 0.85 * n / max(n) OVER () END, 6) AS shade
FROM (SELECT unnest(range(7)) AS d) d CROSS JOIN (SELECT unnest(range(24)) AS h) h
LEFT JOIN (SELECT dow, hour, count(*) AS n FROM enr GROUP BY dow, hour) c ON c.dow = d.d AND c.hour = h.h""")
def heatmap_dense(spark, sf_dir):
    shaded = A.heat_intensity(A.heatmap(enriched(spark, sf_dir), dense=True))
    return shaded.withColumn("shade", F.round("shade", 6))


@query("heatmap_zoned", """
SELECT CAST(dayofweek(l) AS INTEGER) AS dow, CAST(hour(l) AS INTEGER) AS hour, count(*) AS n
FROM (SELECT ts + INTERVAL 9 HOUR AS l FROM msgs) GROUP BY 1, 2""")
def heatmap_zoned(spark, sf_dir):
    return A.heatmap(enriched(spark, sf_dir, tz="Asia/Tokyo"))


@query("peak_hour", "SELECT hour AS peak_hour FROM enr GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 1")
def peak_hour(spark, sf_dir):
    return A.peak_hour(enriched(spark, sf_dir))


@query("timeline", "SELECT day, count(*) AS n FROM enr GROUP BY day")
def timeline(spark, sf_dir):
    return A.timeline(enriched(spark, sf_dir))


USER_SQL = """SELECT author_id, arg_min(author_name, msg_idx) AS author_name, count(*) AS messages, CAST(sum(words) AS BIGINT) AS words,
  CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(media) AS BIGINT) AS media, count(*) FILTER (WHERE is_reply) AS replies,
  count(DISTINCT day) AS active_days, CAST(floor(sum(chars) / count(*) + 0.5) AS BIGINT) AS avg_len,
  (epoch_us(min(ts)) // 1000) AS first_seen, (epoch_us(max(ts)) // 1000) AS last_seen FROM enr GROUP BY author_id"""


@query("user_stats", USER_SQL)
def user_stats(spark, sf_dir):
    u = A.user_stats(enriched(spark, sf_dir)).drop("first_pos")
    return u.withColumn("first_seen", ms("first_seen")).withColumn("last_seen", ms("last_seen"))


REACT_CTE = r"""react AS (
  SELECT trim(split_part(x, ':', 1)) AS emoji, TRY_CAST(regexp_extract(split_part(x, ':', 2), '^\s*([+-]?[0-9]+)', 1) AS BIGINT) AS c, ts, msg_idx, pos
  FROM (SELECT unnest(string_split(blob, ',')) AS x, generate_subscripts(string_split(blob, ','), 1) AS pos, ts, msg_idx FROM enr WHERE blob IS NOT NULL))"""
REACT_SUM = "CAST(sum(CASE WHEN c IS NULL OR c = 0 THEN 1 ELSE c END) AS BIGINT)"


@query("reaction_totals", f"SELECT emoji, {REACT_SUM} AS n FROM react WHERE emoji <> '' GROUP BY emoji", (*EVENTS, REACT_CTE))
def reaction_totals(spark, sf_dir):
    return A.reaction_totals(enriched(spark, sf_dir)).drop("first_pos")


MEDIA_CTE = r"""kinds AS (
  SELECT * FROM (SELECT regexp_extract(unnest(parts), '^\[([A-Z]+)(?::|\])', 1) AS kind, generate_subscripts(parts, 1) AS pos, ts, msg_idx FROM msgs)
  WHERE kind IN ('IMG', 'GIF', 'VID', 'MEDIA', 'YT', 'EMBED', 'STICKER'))"""


@query("media_breakdown", "SELECT kind, count(*) AS n FROM kinds GROUP BY kind", (*EVENTS, MEDIA_CTE))
def media_breakdown(spark, sf_dir):
    return A.media_breakdown(enriched(spark, sf_dir)).drop("first_pos")


EDGES_CTE = """edges AS (
  SELECT author_id AS src, reply_to AS dst, count(*) AS n, min((ts, msg_idx)) AS fp FROM enr WHERE reply_to <> '' GROUP BY 1, 2)"""
EDGE_CTES = (*EVENTS, EDGES_CTE)


@query("reply_edges", "SELECT src, dst, n FROM edges", EDGE_CTES)
def reply_edges(spark, sf_dir):
    return A.reply_edges(enriched(spark, sf_dir)).drop("first_pos")


@query("user_drill_down", "SELECT day, count(*) AS n, CAST(sum(words) AS BIGINT) AS words FROM enr WHERE author_id IN ('U3', 'U7', 'U11') GROUP BY day")
def user_drill_down(spark, sf_dir):
    some = A.drill_down(enriched(spark, sf_dir), ["U3", "U7", "U11"])
    return some.groupBy("day").agg(F.count("*").alias("n"), F.sum("words").alias("words"))


U16 = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


@query("summary_card", f"""
SELECT count(*) AS kept, count(DISTINCT author_id) AS users,
  CAST(floor(sum({U16.format("array_to_string(parts, ' ')")}) / count(*) + 0.5) AS BIGINT) AS avg_chars,
  (epoch_us(min(ts)) // 1000) AS "start", (epoch_us(max(ts)) // 1000) AS "end" FROM msgs""", (EVENT_BODY,))
def summary_card(spark, sf_dir):
    c = A.summary_card(event_messages(spark, sf_dir))
    return c.withColumn("start", ms("start")).withColumn("end", ms("end"))


@query("top_authors", "SELECT author_id, count(*) AS n FROM msgs GROUP BY 1 ORDER BY n DESC, min((ts, msg_idx)) LIMIT 15", (EVENT_BODY,))
def top_authors(spark, sf_dir):
    return A.top_authors(event_messages(spark, sf_dir)).drop("first_pos")


CHARS = U16.format("array_to_string(parts, chr(10))") + " + 15"


@query("budget_breakdown", f"""
SELECT author_id, count(*) AS n, CAST(sum({CHARS}) AS BIGINT) AS chars, round(sum({CHARS}) * 100 / 520000.0, 6) AS used_pct
FROM msgs GROUP BY 1 ORDER BY n DESC, min((ts, msg_idx)) LIMIT 10""", (EVENT_BODY,))
def budget_breakdown(spark, sf_dir):
    return A.budget_breakdown(event_messages(spark, sf_dir), 200_000).drop("first_pos")


@query("budget_used", f"""
SELECT CAST(sum({CHARS}) AS BIGINT) AS total_chars, CAST(floor(sum({CHARS}) / 520000.0 * 100 + 0.5) AS BIGINT) AS used_pct FROM msgs""", (EVENT_BODY,))
def budget_used(spark, sf_dir):
    return A.budget_used(event_messages(spark, sf_dir), 200_000)


@query("leaderboard", """
SELECT author_id, n AS messages, CAST(greatest(2, floor(n * 1.0 / max(n) OVER () * 100 + 0.5)) AS BIGINT) AS pct, row_number() OVER (ORDER BY n DESC, fp) AS rank
FROM (SELECT author_id, count(*) AS n, min((ts, msg_idx)) AS fp FROM msgs GROUP BY 1 ORDER BY n DESC, fp LIMIT 12)""", (EVENT_BODY,))
def leaderboard(spark, sf_dir):
    top = A.leaderboard(A.user_stats(enriched(spark, sf_dir)))
    return top.select("author_id", "messages", "pct", "rank")


BARS = """SELECT {key}, n, CAST(greatest(2, floor(n * 1.0 / max(n) OVER () * 100 + 0.5)) AS BIGINT) AS pct, row_number() OVER (ORDER BY n DESC, fp) AS rank
FROM ({inner} ORDER BY n DESC, fp LIMIT 8)"""


@query("top_reactions", BARS.format(key="emoji", inner=f"SELECT emoji, {REACT_SUM} AS n, min((ts, msg_idx, pos)) AS fp FROM react WHERE emoji <> '' GROUP BY emoji"),
       (*EVENTS, REACT_CTE))
def top_reactions(spark, sf_dir):
    return A.with_bars(A.reaction_totals(enriched(spark, sf_dir)), 8).drop("first_pos")


@query("top_media", BARS.format(key="kind", inner="SELECT kind, count(*) AS n, min((ts, msg_idx, pos)) AS fp FROM kinds GROUP BY kind"),
       (*EVENTS, MEDIA_CTE))
def top_media(spark, sf_dir):
    return A.with_bars(A.media_breakdown(enriched(spark, sf_dir)), 8).drop("first_pos")


@query("parse_summary", """
SELECT count(*) AS messages, count(DISTINCT author_name) AS participants, count(DISTINCT file_idx) AS files, count(DISTINCT channel_id) AS channels FROM msgs""", (EVENT_BODY,))
def parse_summary(spark, sf_dir):
    return A.parse_summary(event_messages(spark, sf_dir))


@query("author_counts", "SELECT author_name, count(*) AS n FROM msgs GROUP BY 1", (EVENT_BODY,))
def author_counts(spark, sf_dir):
    return A.author_counts(event_messages(spark, sf_dir))


def users_and_edges(spark, sf_dir):
    """Both are read by several branches of the network, so they are written."""
    e = enriched(spark, sf_dir)
    return materialize(A.user_stats(e), "users"), materialize(A.reply_edges(e), "edges")


# ── reply graph ─────────────────────────────────────────────────────────────

PAIRS_CTE = """pairs AS (
  SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(CASE WHEN src < dst THEN n ELSE 0 END) AS BIGINT) AS ab,
    CAST(sum(CASE WHEN src > dst THEN n ELSE 0 END) AS BIGINT) AS ba, CAST(sum(n) AS BIGINT) AS raw
  FROM edges WHERE src <> dst GROUP BY 1, 2),
sent AS (SELECT src, sum(n) AS s FROM edges WHERE src <> dst GROUP BY 1),
shown AS (SELECT author_id AS uid, author_name, messages, fp FROM (
    SELECT author_id, min(author_name) AS author_name, count(*) AS messages, min((ts, msg_idx)) AS fp FROM enr GROUP BY 1)
  WHERE author_id IN (SELECT a FROM pairs UNION SELECT b FROM pairs) ORDER BY messages DESC, fp LIMIT 28),
net AS (SELECT p.*, sqrt((ab / coalesce(sa.s, 1)) * (ba / coalesce(sb.s, 1))) AS weight
  FROM pairs p LEFT JOIN sent sa ON sa.src = a LEFT JOIN sent sb ON sb.src = b
  WHERE raw >= 3 AND a IN (SELECT uid FROM shown) AND b IN (SELECT uid FROM shown))"""
NET_CTES = (*EDGE_CTES, PAIRS_CTE)


@query("reply_pairs", "SELECT * FROM pairs", NET_CTES)
def reply_pairs(spark, sf_dir):
    return graph.reply_pairs(A.reply_edges(enriched(spark, sf_dir)))


@query("reply_network_edges", """
SELECT a, b, ab, ba, raw, round(weight, 6) AS weight,
  round(CASE WHEN max(weight) OVER () > 0 THEN weight / max(weight) OVER () ELSE raw / max(raw) OVER () END, 6) AS w FROM net""", NET_CTES)
def reply_network_edges(spark, sf_dir):
    net = graph.network_edges(*users_and_edges(spark, sf_dir))
    return net.withColumn("weight", F.round("weight", 6)).withColumn("w", F.round("w", 6))


@query("reply_network_nodes", """
SELECT uid, author_name, messages, rank FROM shown JOIN (
  SELECT author_id, row_number() OVER (ORDER BY count(*) DESC, min((ts, msg_idx))) - 1 AS rank FROM enr GROUP BY 1) ON author_id = uid
WHERE uid IN (SELECT a FROM net UNION SELECT b FROM net)""", NET_CTES)
def reply_network_nodes(spark, sf_dir):
    return graph.network_nodes(*users_and_edges(spark, sf_dir))


@query("reply_partners", """
SELECT uid, side, partner, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY uid, side ORDER BY n DESC, fp) AS rank FROM (
    SELECT src AS uid, 'replies_to' AS side, dst AS partner, n, fp FROM edges WHERE src <> dst
    UNION ALL SELECT dst, 'replied_by', src, n, fp FROM edges WHERE src <> dst)) WHERE rank <= 5""", EDGE_CTES)
def reply_partners(spark, sf_dir):
    return graph.reply_partners(A.reply_edges(enriched(spark, sf_dir)))


@query("top_reply_duo", "SELECT src, dst, n FROM edges WHERE src <> dst ORDER BY n DESC, fp LIMIT 1", EDGE_CTES)
def top_reply_duo(spark, sf_dir):
    return graph.top_duo(A.reply_edges(enriched(spark, sf_dir)))


# ── sequences ───────────────────────────────────────────────────────────────


@query("session_breaks", """
SELECT channel_id, msg_idx, CAST(ts_ms - prev AS BIGINT) AS gap_ms, coalesce(ts_ms - prev > 14400000, false) AS is_break,
  CAST(1 + sum(CASE WHEN ts_ms - prev > 14400000 THEN 1 ELSE 0 END) OVER (PARTITION BY channel_id, day ORDER BY ts, msg_idx) AS BIGINT) AS session_no
FROM (SELECT *, (epoch_us(ts) // 1000) AS ts_ms, lag((epoch_us(ts) // 1000)) OVER (PARTITION BY channel_id, day ORDER BY ts, msg_idx) AS prev FROM enr)""")
def session_breaks(spark, sf_dir):
    s = S.sessions(event_messages(spark, sf_dir))
    return s.select("channel_id", "msg_idx", "gap_ms", "is_break", "session_no")


@query("author_blocks", """
SELECT channel_id, msg_idx, grouped, CAST(sum(CASE WHEN grouped THEN 0 ELSE 1 END) OVER (PARTITION BY channel_id, day ORDER BY ts, msg_idx) AS BIGINT) AS block_no FROM (
  SELECT *, coalesce(NOT is_system AND NOT lag(is_system) OVER w AND lag(author_id) OVER w = author_id AND (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER w < 420000, false) AS grouped
  FROM enr WINDOW w AS (PARTITION BY channel_id, day ORDER BY ts, msg_idx))""")
def author_blocks(spark, sf_dir):
    return S.author_blocks(event_messages(spark, sf_dir)).select("channel_id", "msg_idx", "grouped", "block_no")


# A day per customer that leaves gaps between active days by itself: squares modulo a prime.
SPARSE = """sparse AS (SELECT strftime(DATE '2000-01-01' + CAST((c_custkey * c_custkey) % 7919 AS INTEGER), '%Y-%m-%d') AS day, count(*) AS n FROM customer GROUP BY 1)"""


def sparse_days(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("c_custkey") * F.col("c_custkey") % 7919).cast("int"))
    return c.groupBy(clock.day_key(day.cast("timestamp")).alias("day")).agg(F.count("*").alias("n"))


@query("longest_streak", """
SELECT coalesce(max(c), 0) AS streak FROM (SELECT count(*) AS c FROM (
  SELECT CAST(day AS DATE) - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS g FROM sparse) GROUP BY g)""", (SPARSE,))
def longest_streak(spark, sf_dir):
    return S.longest_streak(sparse_days(spark, sf_dir))


@query("longest_silence", """
SELECT from_day, to_day, days FROM (SELECT lag(day) OVER (ORDER BY day) AS from_day, day AS to_day,
  CAST(day AS DATE) - CAST(lag(day) OVER (ORDER BY day) AS DATE) - 1 AS days FROM sparse) WHERE days > 0 ORDER BY days DESC, from_day LIMIT 1""", (SPARSE,))
def longest_silence(spark, sf_dir):
    return S.longest_silence(sparse_days(spark, sf_dir))


@query("conversation_starters", """
SELECT author_name, count(*) AS n FROM (SELECT day, arg_min(author_name, (ts, msg_idx)) AS author_name FROM enr WHERE NOT is_system GROUP BY day) GROUP BY 1""")
def conversation_starters(spark, sf_dir):
    return S.starters(enriched(spark, sf_dir)).drop("first_pos")


@query("night_owls", "SELECT author_name, count(*) AS n FROM enr WHERE NOT is_system AND hour < 6 GROUP BY 1")
def night_owls(spark, sf_dir):
    return S.night_owls(enriched(spark, sf_dir)).drop("first_pos")


@query("busiest_day", "SELECT day, count(*) AS n FROM enr GROUP BY day ORDER BY n DESC, day LIMIT 1")
def busiest_day(spark, sf_dir):
    return S.busiest_day(S.day_counts(enriched(spark, sf_dir)))


@query("busiest_weekday", "SELECT dow, count(*) AS n FROM enr GROUP BY dow ORDER BY n DESC, dow LIMIT 1")
def busiest_weekday(spark, sf_dir):
    return S.busiest_weekday(enriched(spark, sf_dir))


@query("weekday_rhythm", "SELECT dow, count(*) AS n FROM enr GROUP BY dow")
def weekday_rhythm(spark, sf_dir):
    return S.weekday_rhythm(enriched(spark, sf_dir))


@query("hour_rhythm", "SELECT hour, count(*) AS n FROM enr GROUP BY hour")
def hour_rhythm(spark, sf_dir):
    return S.hour_rhythm(enriched(spark, sf_dir))


RTOTAL = r"""list_sum(list_transform(
      list_filter(flatten(list_transform(flatten(list_transform(parts, lambda p: regexp_extract_all(p, '\^\{([^}]*)\}', 1))), lambda b: string_split(b, ','))), lambda x: contains(x, ':')),
      lambda x: coalesce(TRY_CAST(regexp_extract(split_part(x, ':', -1), '^\s*([+-]?[0-9]+)', 1) AS BIGINT), 0)))"""


@query("most_reacted", f"""
SELECT score, author_name, CASE WHEN text = '' THEN '(media)' ELSE text END AS text, ts FROM (
  SELECT CAST(coalesce({RTOTAL}, 0) AS BIGINT) AS score, author_name, text, (epoch_us(ts) // 1000) AS ts, msg_idx, ts AS t FROM enr WHERE NOT is_system)
WHERE score > 0 ORDER BY score DESC, ts, msg_idx LIMIT 1""")
def most_reacted(spark, sf_dir):
    return S.most_reacted(enriched(spark, sf_dir)).withColumn("ts", ms("ts"))


@query("longest_message", """
SELECT chars AS score, author_name, text, (epoch_us(ts) // 1000) AS ts FROM enr WHERE NOT is_system AND chars > 0 ORDER BY chars DESC, (epoch_us(ts) // 1000), msg_idx LIMIT 1""")
def longest_message(spark, sf_dir):
    return S.longest_message(enriched(spark, sf_dir)).withColumn("ts", ms("ts"))


@query("recap", f"""
SELECT 'messages' AS metric, NULL AS name, count(*) AS value, NULL AS detail FROM enr
UNION ALL SELECT 'participants', NULL, count(DISTINCT author_id), NULL FROM enr
UNION ALL SELECT 'active_days', NULL, count(DISTINCT day), NULL FROM enr
UNION ALL SELECT 'reactions', NULL, {REACT_SUM}, NULL FROM react WHERE emoji <> ''
UNION ALL SELECT 'peak_hour', NULL, (SELECT hour FROM enr GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 1), NULL
UNION ALL SELECT 'avg_per_day', NULL, CAST(floor(count(*) / count(DISTINCT day) + 0.5) AS BIGINT), NULL FROM enr
UNION ALL SELECT 'streak', NULL, (SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT CAST(day AS DATE) - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS g FROM (SELECT DISTINCT day FROM enr)) GROUP BY g)), NULL
UNION ALL (SELECT 'busiest_day', day, count(*) AS n, NULL FROM enr GROUP BY day ORDER BY n DESC, day LIMIT 1)
UNION ALL (SELECT 'busiest_weekday', CAST(dow AS VARCHAR), count(*) AS n, NULL FROM enr GROUP BY dow ORDER BY n DESC, dow LIMIT 1)
UNION ALL (SELECT 'quiet_gap', f, g, t FROM (SELECT lag(day) OVER (ORDER BY day) AS f, day AS t, CAST(day AS DATE) - CAST(lag(day) OVER (ORDER BY day) AS DATE) - 1 AS g FROM (SELECT DISTINCT day FROM enr)) WHERE g > 0 ORDER BY g DESC, f LIMIT 1)
UNION ALL SELECT 'total_words', NULL, CAST(sum(words) AS BIGINT), NULL FROM enr
UNION ALL SELECT 'total_media', NULL, count(*), NULL FROM kinds
UNION ALL SELECT 'top_user', author_name, n, CAST(row_number() OVER (ORDER BY n DESC, fp) AS VARCHAR) FROM (SELECT min(author_name) AS author_name, count(*) AS n, min((ts, msg_idx)) AS fp FROM enr GROUP BY author_id ORDER BY n DESC, fp LIMIT 3)
UNION ALL SELECT 'top_emoji', emoji, n, CAST(row_number() OVER (ORDER BY n DESC, fp) AS VARCHAR) FROM (SELECT emoji, {REACT_SUM} AS n, min((ts, msg_idx, pos)) AS fp FROM react WHERE emoji <> '' GROUP BY emoji ORDER BY n DESC, fp LIMIT 3)
UNION ALL (SELECT 'starter', author_name, count(*) AS n, NULL FROM (SELECT day, arg_min(author_name, (ts, msg_idx)) AS author_name FROM enr WHERE NOT is_system GROUP BY day) GROUP BY 2 ORDER BY n DESC, min(day) LIMIT 1)
UNION ALL (SELECT 'night_owl', author_name, count(*) AS n, NULL FROM enr WHERE NOT is_system AND hour < 6 GROUP BY 2 ORDER BY n DESC, min((ts, msg_idx)) LIMIT 1)
UNION ALL (SELECT 'most_reacted', author_name, score, CASE WHEN text = '' THEN '(media)' ELSE text END FROM (
  SELECT CAST(coalesce({RTOTAL}, 0) AS BIGINT) AS score, author_name, text, (epoch_us(ts) // 1000) AS ts, msg_idx FROM enr WHERE NOT is_system) WHERE score > 0 ORDER BY score DESC, ts, msg_idx LIMIT 1)
UNION ALL (SELECT 'longest', author_name, chars, text FROM enr WHERE NOT is_system AND chars > 0 ORDER BY chars DESC, (epoch_us(ts) // 1000), msg_idx LIMIT 1)
UNION ALL (SELECT 'top_pair', 'user_' || CAST(CAST(substr(src, 2) AS BIGINT) - 1 AS VARCHAR), n, 'user_' || CAST(CAST(substr(dst, 2) AS BIGINT) - 1 AS VARCHAR) FROM edges WHERE src <> dst ORDER BY n DESC, fp LIMIT 1)
""", (*EDGE_CTES, REACT_CTE, MEDIA_CTE))
def recap(spark, sf_dir):
    return S.recap(materialize(enriched(spark, sf_dir), "enriched"))


@query("day_index", """
SELECT day, n, CAST(coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_idx,
  CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS end_idx, hours FROM (
  SELECT day, count(*) AS n, array_to_string([count(*) FILTER (WHERE hour = h) FOR h IN range(24)], ',') AS hours FROM enr GROUP BY day)"""
       .replace("[count(*) FILTER (WHERE hour = h) FOR h IN range(24)]",
                "[" + ", ".join(f"count(*) FILTER (WHERE hour = {h})" for h in range(24)) + "]"))
def day_index(spark, sf_dir):
    idx = S.day_index(enriched(spark, sf_dir))
    return idx.withColumn("hours", F.array_join(F.transform("hours", lambda n: n.cast("string")), ","))


@query("calendar_shades", "SELECT day, n, round(0.14 + 0.82 * sqrt(n / max(n) OVER ()), 6) AS shade FROM sparse", (SPARSE,))
def calendar_shades(spark, sf_dir):
    return S.calendar_shades(sparse_days(spark, sf_dir)).withColumn("shade", F.round("shade", 6))


@query("adjacent_months", """
SELECT m AS month, lag(m) OVER (ORDER BY m) AS previous, lead(m) OVER (ORDER BY m) AS next FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders)""",
       ("one AS (SELECT 1)",))
def adjacent_months(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(clock.day_key(F.col("o_orderdate")).alias("day")).distinct()
    return S.adjacent_months(days)


@query("index_for_hour", """
SELECT day, coalesce(min(rn) FILTER (WHERE hour >= 18), min(rn)) AS idx FROM (
  SELECT day, hour, row_number() OVER (ORDER BY ts, msg_idx) - 1 AS rn FROM enr) GROUP BY day""")
def index_for_hour(spark, sf_dir):
    return S.index_for_hour(S.day_index(enriched(spark, sf_dir)), 18)


@query("message_page", """
SELECT rn AS idx, msg_idx, author_name FROM (SELECT row_number() OVER (ORDER BY ts, msg_idx) - 1 AS rn, * FROM enr) WHERE rn BETWEEN 400 AND 649""")
def message_page(spark, sf_dir):
    return S.page(enriched(spark, sf_dir), 400, 250).select("idx", "msg_idx", "author_name")


# ── filters ─────────────────────────────────────────────────────────────────


@query("filter_date_range", """
SELECT channel_id, count(*) AS n FROM msgs WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12 23:59:59.999' GROUP BY 1""", (EVENT_BODY,))
def filter_date_range(spark, sf_dir):
    kept = filters.in_date_range(
        event_messages(spark, sf_dir), clock.day_edge(F.lit("2024-01-05")), clock.day_edge(F.lit("2024-01-12"), True)
    )
    return kept.groupBy("channel_id").agg(F.count("*").alias("n"))


@query("filter_bots", "SELECT author_name, count(*) AS n FROM msgs WHERE author_name NOT IN ('user_1', 'user_5', 'user_9') GROUP BY 1", (EVENT_BODY,))
def filter_bots(spark, sf_dir):
    bots = spark.createDataFrame([("user_1",), ("user_5",), ("user_9",)], "name string")
    kept = filters.drop_bots(event_messages(spark, sf_dir), bots)
    return kept.groupBy("author_name").agg(F.count("*").alias("n"))


@query("filter_system", "SELECT channel_id, count(*) AS n FROM msgs WHERE NOT is_system GROUP BY 1", (EVENT_BODY,))
def filter_system(spark, sf_dir):
    kept = filters.drop_system(event_messages(spark, sf_dir))
    return kept.groupBy("channel_id").agg(F.count("*").alias("n"))


@query("filter_media_only", r"""
SELECT channel_id, count(*) AS n FROM msgs WHERE len(list_filter(parts, lambda p: NOT regexp_matches(p, '^[\[^>]'))) > 0 GROUP BY 1""", (EVENT_BODY,))
def filter_media_only(spark, sf_dir):
    kept = filters.drop_media_only(event_messages(spark, sf_dir))
    return kept.groupBy("channel_id").agg(F.count("*").alias("n"))


@query("filter_by_label", "SELECT author_id, count(*) AS n FROM msgs WHERE author_name IN ('user_2', 'user_3') GROUP BY 1", (EVENT_BODY,))
def filter_by_label(spark, sf_dir):
    msgs = event_messages(spark, sf_dir)
    names = spark.createDataFrame([("user_2",), ("user_3",)], "label string")
    kept = filters.keep_authors_by_label(msgs, names, people_of(msgs))
    return kept.groupBy("author_id").agg(F.count("*").alias("n"))


@query("filter_by_author_id", "SELECT channel_id, count(*) AS n FROM msgs WHERE author_id IN ('U4', 'U44') GROUP BY 1", (EVENT_BODY,))
def filter_by_author_id(spark, sf_dir):
    ids = spark.createDataFrame([("U4",), ("U44",)], "uid string")
    kept = filters.keep_authors_by_id(event_messages(spark, sf_dir), ids)
    return kept.groupBy("channel_id").agg(F.count("*").alias("n"))


@query("keyword_match", r"""
SELECT msg_idx FROM msgs WHERE regexp_matches(array_to_string(parts, ' '), '(?i)\*k9\*') OR regexp_matches(array_to_string(parts, ' '), '(?i)click.*worth 1[0-9]+')""", (EVENT_BODY,))
def keyword_match(spark, sf_dir):
    hit = filters.matches_keywords(F.col("parts"), ["*K9*", "/click.*worth 1[0-9]+/"])
    return event_messages(spark, sf_dir).where(hit).select("msg_idx")


@query("filter_low_activity", """
SELECT channel_id, author_id, count(*) AS n FROM msgs GROUP BY 1, 2 HAVING count(*) >= 13""", (EVENT_BODY,))
def filter_low_activity(spark, sf_dir):
    kept = filters.drop_low_activity(event_messages(spark, sf_dir), 13)
    return kept.groupBy("channel_id", "author_id").agg(F.count("*").alias("n"))
