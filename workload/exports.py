"""Source scans, renderers, budget, chunks and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadlens.functions import clock
from threadlens.operators import budget
from threadlens.plans import conversation
from threadlens.session import materialize, work_dir
from threadlens.sinks import document, export, layout, markdown, tables as sink_tables
from threadlens.sources import catalog, html_export, json_export, txt_export
from threadlens.streaming import ingest

from . import files
from .tables import CHAT, EVENT_BODY, EVENTS, event_messages, people_of, table, with_sql

QUERIES = {}
SQL = {}


def query(name, sql=None, ctes=(CHAT,)):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_sql(*ctes, body=sql)
        return fn

    return add


def shown(raw, *more):
    return raw.select(
        *more, "message_id", "author_key", "author_name", "author_username", clock.millis(F.col("ts")).alias("t_ms"), "is_system",
        "reply_to_key", "reply_to_message_id", "reply_to_name", "reply_snippet",
        F.array_join("parts", "|").alias("parts"), "reactions",
    )


JSON_SQL = f"""
SELECT t.mid AS message_id, '9' || t.who AS author_key, 'nick ' || t.who AS author_name, 'user' || t.who AS author_username, t.t_ms, t.role = 'system' AS is_system,
  CASE WHEN t.reply THEN '9' || p.who END AS reply_to_key, CASE WHEN t.reply THEN p.mid END AS reply_to_message_id, CASE WHEN t.reply THEN 'nick ' || p.who END AS reply_to_name,
  CASE WHEN t.reply THEN CASE WHEN length(s) > 80 THEN substr(s, 1, 80) || '…' ELSE s END END AS reply_snippet,
  trim(t.text, E' \\n\\t') || CASE WHEN t.turn % 7 = 5 THEN '|fwd ' || t.who || '|[IMG: fwd' || t.who || '.png]' ELSE '' END || CASE WHEN t.turn % 5 = 3 THEN '|[IMG: pic' || t.who || '.PNG]' ELSE '' END || CASE WHEN t.turn % 4 = 2 THEN '|[YT: title ' || t.who || ']' ELSE '' END AS parts,
  CASE WHEN t.turn % 4 = 1 THEN '^{{👍:' || t.who || '}}' END AS reactions
FROM (SELECT *, turn % 3 = 2 AND role <> 'system' AS reply FROM turns) t LEFT JOIN (SELECT *, trim(replace(text, chr(10), ' ')) AS s FROM turns) p ON p.conv_id = t.conv_id AND p.turn = t.turn - 1"""


@query("json_export_scan", JSON_SQL)
def json_export_scan(spark, sf_dir):
    return shown(json_export.to_raw_messages(json_export.read(spark, files.write_json(spark, sf_dir))[1]))


@query("json_document_scan", JSON_SQL)
def json_document_scan(spark, sf_dir):
    path = files.write_json(spark, sf_dir, indented=False)
    return shown(json_export.to_raw_messages(json_export.read(spark, path)[1]))


@query("json_export_headers", """
SELECT DISTINCT channel_id, 'Guild - cat - chan' AS base_name, 1735689600000 AS exported_ms, false AS invalid FROM turns""")
def json_export_headers(spark, sf_dir):
    h, _ = json_export.read(spark, files.write_json(spark, sf_dir))
    return h.select("channel_id", "base_name", clock.millis(F.col("exported_at")).alias("exported_ms"), "invalid")


@query("txt_export_scan", """
SELECT 'nick ' || who AS author_name, (t_ms // 60000) * 60000 AS t_ms, role = 'system' AND turn % 5 <> 3 AND turn % 4 <> 3 AS is_system,
  CASE WHEN role = 'system' THEN 'joined the server.' ELSE trim(text, E' \\n\\t') END || CASE WHEN turn % 5 = 3 THEN '|[IMG: pic ' || who || '.png]' ELSE '' END || CASE WHEN turn % 4 = 3 THEN '|[STICKER]' ELSE '' END AS parts,
  CASE WHEN turn % 4 = 1 THEN '^{👍, 🔥}' END AS reactions FROM turns""".replace("\\\\", "\\"))
def txt_export_scan(spark, sf_dir):
    raw = txt_export.scan(txt_export.read_lines(spark, files.write_txt(spark, sf_dir)))
    return shown(raw).select("author_name", "t_ms", "is_system", "parts", "reactions")


@query("txt_export_headers", "SELECT DISTINCT 'Guild|cat / ' || channel_id AS channel_id, 'Guild - ' || channel_id AS base_name FROM turns")
def txt_export_headers(spark, sf_dir):
    h = txt_export.headers(txt_export.read_lines(spark, files.write_txt(spark, sf_dir)))
    return h.select("channel_id", "base_name")


@query("html_export_scan", """
SELECT row_number() OVER (PARTITION BY channel_id ORDER BY first_place, turn) AS position,
  CASE WHEN turn % 4 = 2 THEN CAST(place + 1 AS VARCHAR) ELSE mid END AS message_id, '9' || who AS author_key, 'nick ' || who AS author_name, 'user' || who AS author_username, CASE WHEN turn % 4 = 2 THEN (t_ms // 60000) * 60000 ELSE t_ms END AS t_ms, role = 'system' AS is_system, NULL AS reply_to_key,
  CASE WHEN turn % 3 = 2 THEN CAST((t_ms - 90000 - 1420070400000) * 4194304 AS VARCHAR) END AS reply_to_message_id, CASE WHEN turn % 3 = 2 THEN 'nick ' || ((who + 4) % 23) END AS reply_to_name,
  CASE WHEN turn % 3 = 2 THEN 'earlier words' END AS reply_snippet,
  CASE WHEN role = 'system' THEN '[' || trim(text, E' \\n\\t') || ']' ELSE trim(text, E' \\n\\t') END || CASE WHEN turn % 5 = 3 THEN '|[GIF: a ' || who || '.gif]' ELSE '' END AS parts,
  CASE WHEN turn % 4 = 1 THEN '^{👍:' || who || '}' END AS reactions FROM (SELECT *, min(place) OVER (PARTITION BY conv_id, who) AS first_place FROM turns)""".replace("\\\\", "\\"))
def html_export_scan(spark, sf_dir):
    raw = html_export.scan(html_export.read_fragments(spark, files.write_html(spark, sf_dir)))
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("msg_idx"))
    return shown(raw.withColumn("position", rank), "position")


@query("export_file_names", """
SELECT page_id, CASE WHEN page_id % 3 < 2 THEN CAST(1000 + page_id AS VARCHAR) ELSE n END AS channel_id,
  CASE WHEN page_id % 3 < 2 THEN 'G - chan [' || (1000 + page_id) || ']' ELSE regexp_replace(n, '\\.html$', '') END AS base_name, CASE WHEN page_id % 3 = 0 THEN '2024-03-05' END AS after_date
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'G - chan [' || (1000 + page_id) || '] (after 2024-03-05).html' WHEN 1 THEN 'G - chan [' || (1000 + page_id) || '].html' ELSE 'plain ' || page_id || '.html' END AS n FROM pages)""".replace("\\\\", "\\"), ("nothing AS (SELECT 1)",))
def export_file_names(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    stem = F.concat(F.lit("G - chan ["), (i + 1000).cast("string"), F.lit("]"))
    name = (F.when(i % 3 == 0, F.concat(stem, F.lit(" (after 2024-03-05).html"))).when(i % 3 == 1, F.concat(stem, F.lit(".html")))
            .otherwise(F.concat(F.lit("plain "), i.cast("string"), F.lit(".html"))))
    return catalog.html_names(p.select("page_id", name.alias("name"))).drop("name")


UPLOADS = """ups AS (SELECT event_id AS file_id, 'file ' || (user_id % 40) || '.json' AS name, epoch_us(ts) // 1000 AS sort_order, CAST(floor(value * 100) AS BIGINT) AS size, event_type AS channel_id FROM events)"""


def uploads(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("file_id"),
        F.concat(F.lit("file "), (F.col("user_id") % 40).cast("string"), F.lit(".json")).alias("name"),
        clock.millis(F.col("ts")).alias("sort_order"),
        F.floor(F.col("value") * 100).cast("bigint").alias("size"),
        F.col("event_type").alias("channel_id"),
    )


@query("latest_uploads", "SELECT file_id, name, sort_order, size FROM ups QUALIFY row_number() OVER (PARTITION BY name ORDER BY sort_order DESC, size DESC, file_id) = 1", (UPLOADS,))
def latest_uploads(spark, sf_dir):
    return catalog.latest_uploads(uploads(spark, sf_dir)).drop("channel_id")


@query("file_numbers", """
SELECT file_id, row_number() OVER (ORDER BY sort_order, file_id) - 1 AS file_idx, row_number() OVER (PARTITION BY channel_id ORDER BY sort_order, file_id) - 1 AS grp_file_idx FROM ups""", (UPLOADS,))
def file_numbers(spark, sf_dir):
    return catalog.number_files(uploads(spark, sf_dir)).select("file_id", "file_idx", "grp_file_idx")


@query("merged_channel_groups", "SELECT CASE WHEN channel_id = 'view' THEN 'click' ELSE channel_id END AS channel_id, count(*) AS n FROM ups GROUP BY 1", (UPLOADS,))
def merged_channel_groups(spark, sf_dir):
    mapping = spark.createDataFrame([("view", "click")], "from_id string, to_id string")
    return catalog.remap_channels(uploads(spark, sf_dir), mapping).groupBy("channel_id").agg(F.count("*").alias("n"))


# ── renderers ───────────────────────────────────────────────────────────────


@query("csv_cells", r"""
SELECT msg_idx, strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp, author_id, author_name,
  CASE WHEN regexp_matches(c, '^[=+\-@\t\r]') THEN '''' || c ELSE c END AS content, coalesce(list_filter(parts, lambda p: starts_with(p, '^'))[1], '') AS reactions
FROM (SELECT *, array_to_string(list_filter(parts, lambda p: NOT starts_with(p, '^')), ' | ') AS c FROM msgs)""", (EVENT_BODY,))
def csv_cells(spark, sf_dir):
    c = sink_tables.csv_cells(event_messages(spark, sf_dir))
    return c.select("msg_idx", "timestamp", "author_id", "author_name", "content", "reactions")


@query("json_messages", r"""
SELECT msg_idx, author_name AS author, author_id AS "authorId",
  array_to_string(list_filter(CASE WHEN r THEN parts[2:] ELSE parts END, lambda p: NOT starts_with(p, '^')), chr(10)) AS content,
  CASE WHEN r THEN regexp_replace(parts[1], '^>\s*', '') END AS "replyTo", substr(list_filter(parts, lambda p: starts_with(p, '^'))[1], 2) AS reactions
FROM (SELECT *, has_reply AND starts_with(parts[1], '>') AS r FROM msgs)""", (EVENT_BODY,))
def json_messages(spark, sf_dir):
    j = sink_tables.json_messages(event_messages(spark, sf_dir))
    return j.select("msg_idx", "author", "authorId", "content", "replyTo", "reactions")


@query("markdown_rows", """
SELECT channel_id, msg_idx, md5(CASE WHEN f THEN '## ' || strftime(ts, '%A, %b %d, %Y') || chr(10) || chr(10) ELSE '' END || '**[' || strftime(ts, '%-I:%M %p') || '] ' || author_id || ':**' || chr(10) ||
  CASE WHEN len(parts) > 0 THEN array_to_string(parts, chr(10)) || chr(10) ELSE '' END) AS body
FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, msg_idx) = 1 AS f FROM msgs)""", (EVENT_BODY,))
def markdown_rows(spark, sf_dir):
    rows = markdown.body_rows(event_messages(spark, sf_dir))
    return rows.select("channel_id", F.col("k3").alias("msg_idx"), F.md5("text").alias("body"))


LEGEND = """
SELECT channel_id, author_id AS uid, n, (t // 10) || '.' || (t % 10) AS pct FROM (
  SELECT *, CAST((n * 2000 + sum(n) OVER (PARTITION BY channel_id)) // (sum(n) OVER (PARTITION BY channel_id) * 2) AS BIGINT) AS t FROM (SELECT channel_id, author_id, count(*) AS n FROM msgs GROUP BY 1, 2))"""


@query("participant_legend", LEGEND, (EVENT_BODY,))
def participant_legend(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    return document.legend(m, people_of(m)).select("channel_id", "uid", "n", "pct")


@query("html_layout", """
SELECT channel_id, msg_idx, CASE WHEN gap IS NULL THEN 'day' WHEN gap > 14400000 THEN 'break' ELSE 'none' END AS divider, above FROM (
  SELECT *, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w AS gap, lag(author_id) OVER w AS above FROM enr WINDOW w AS (PARTITION BY channel_id, day ORDER BY ts, msg_idx))""", EVENTS)
def html_layout(spark, sf_dir):
    return layout.page_layout(event_messages(spark, sf_dir)).select("channel_id", "msg_idx", "divider", "above")


@query("export_summary", """
SELECT channel_id, count(*) AS total, count(*) FILTER (WHERE NOT is_system) AS kept, count(*) FILTER (WHERE is_system) AS excluded, count(*) FILTER (WHERE is_system) = 0 AS complete FROM msgs GROUP BY 1""", (EVENT_BODY,))
def export_summary(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    return export.summarise(m, m.where("NOT is_system")).select("channel_id", "total", "kept", "excluded", "complete")


# ── budget and chunks ───────────────────────────────────────────────────────

U16 = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
COST = f"(14 + coalesce(list_sum(list_transform(parts, lambda p: {U16.format('p')} + 3)), 0))"


@query("newest_first_fill", f"""
SELECT channel_id, msg_idx, priority, priority OR 2000 + fixed + suffix <= 40000 AS in_fill FROM (
  SELECT *, sum(CASE WHEN priority THEN cost ELSE 0 END) OVER (PARTITION BY channel_id) AS fixed,
    sum(CASE WHEN priority THEN 0 ELSE cost END) OVER (PARTITION BY channel_id ORDER BY ts DESC, msg_idx DESC) AS suffix
  FROM (SELECT *, {COST} AS cost, regexp_matches(array_to_string(parts, ' '), '(?i)\\*k9\\*') AS priority FROM msgs))""".replace("\\\\*", "\\*"), (EVENT_BODY,))
def newest_first_fill(spark, sf_dir):
    from threadlens.operators.filters import matches_keywords

    hit = matches_keywords(F.col("parts"), ["*k9*"])
    f = budget.fill_newest(event_messages(spark, sf_dir), hit, 2000, 40000)
    return f.select("channel_id", "msg_idx", "priority", "in_fill")


CHUNK_SQL = f"""
WITH RECURSIVE c AS (
  SELECT *, CAST(sum(cost) OVER (PARTITION BY channel_id ORDER BY ts, msg_idx) AS BIGINT) AS upto, row_number() OVER (PARTITION BY channel_id ORDER BY ts, msg_idx) - 1 AS idx, count(*) OVER (PARTITION BY channel_id) AS n
  FROM (SELECT channel_id, ts, msg_idx, CAST({COST} AS BIGINT) AS cost FROM msgs)),
e AS MATERIALIZED (SELECT a.channel_id, a.idx, a.n, greatest(a.idx + 1, (SELECT count(*) FROM c b WHERE b.channel_id = a.channel_id AND b.upto <= a.upto - a.cost + CAST(floor(floor(1000 + (4000 - 1000) * 0.85 + 0.5) * 2.6 + 0.5) AS BIGINT) - 200)) AS "end" FROM c a),
walk(channel_id, chunk, start, "end", n) AS (
  SELECT channel_id, 1, idx, "end", n FROM e WHERE idx = 0
  UNION ALL
  SELECT e.channel_id, w.chunk + 1, e.idx, e."end", e.n FROM walk w JOIN e ON e.channel_id = w.channel_id AND e.idx = greatest(w.start + 1, w."end" - 20) WHERE w."end" < w.n)
SELECT channel_id, chunk, start, "end" FROM walk"""


def _chunk_sql() -> str:
    body = CHUNK_SQL.strip()
    return body.replace("WITH RECURSIVE c AS", "WITH RECURSIVE " + EVENT_BODY + ",\nc AS", 1)


@query("chunk_bounds")
def chunk_bounds(spark, sf_dir):
    costs = materialize(budget.index_costs(event_messages(spark, sf_dir)), "chunk-costs")
    return budget.chunk_bounds(costs, 4000, overlap=20)


SQL["chunk_bounds"] = _chunk_sql()


@query("chunk_members")
def chunk_members(spark, sf_dir):
    m = event_messages(spark, sf_dir)
    c = budget.chunk_messages(m, 4000, overlap=20)
    return c.groupBy("channel_id", "chunk").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))


SQL["chunk_members"] = _chunk_sql().replace(
    'SELECT channel_id, chunk, start, "end" FROM walk',
    'SELECT channel_id, chunk, "end" - start AS n, start AS first, "end" - 1 AS last FROM walk',
)


# ── whole plans ─────────────────────────────────────────────────────────────


@query("ingest_stream", "SELECT channel_id, count(*) AS n FROM turns GROUP BY 1")
def ingest_stream(spark, sf_dir):
    source = files.write_json(spark, sf_dir)
    base = f"{work_dir(spark)}/threadlens/stream-{uuid.uuid4().hex}"
    q = ingest.ingest_json(spark, f"{source}/*", f"{base}/raw", f"{base}/state")
    q.awaitTermination()
    return ingest.read_ingested(spark, f"{base}/raw").groupBy("channel_id").agg(F.count("*").alias("n"))


@query("conversation_from_raw")
def conversation_from_raw(spark, sf_dir):
    from .merging import raw_people

    people, msgs = conversation.build_messages(raw_people(spark, sf_dir))
    return msgs.groupBy("channel_id", "format", "author_name").agg(F.count("*").alias("n"))
