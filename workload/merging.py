"""Merge steps and identity over three simulated exports of every channel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions import clock
from threadlens.operators import identity, merge
from threadlens.schema import RAW_MESSAGE
from threadlens.session import materialize

from .tables import CHAT, MERGES, _mid_of, chat_turns, merge_input, text, with_sql

QUERIES = {}
SQL = {}


def query(name, sql=None, ctes=MERGES):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_sql(*ctes, body=sql)
        return fn

    return add


def prepared(spark, sf_dir) -> DataFrame:
    return merge.prepare(merge_input(spark, sf_dir))


# Stage by stage in SQL: nearest twins, offsets, shifted clocks, bridge, replies.
STAGES = """near AS (
  SELECT x.channel_id, x.grp_file_idx, x.msg_idx, arg_min(x.t_ms - k.t_ms, (abs(x.t_ms - k.t_ms), k.pos)) AS delta
  FROM mn x JOIN mn k ON k.channel_id = x.channel_id AND k.author_id = x.author_id AND k.norm = x.norm
  WHERE x.format = 'txt' AND k.format <> 'txt' AND length(x.norm) >= 12 GROUP BY 1, 2, 3),
deltas AS (SELECT channel_id, grp_file_idx, delta FROM near WHERE abs(delta) <= 93600000),
med AS (
  SELECT channel_id, grp_file_idx, CAST(floor(delta / 300000 + 0.5) AS BIGINT) * 300000 AS offset_ms, n FROM (
    SELECT *, row_number() OVER (PARTITION BY channel_id, grp_file_idx ORDER BY delta) - 1 AS i, count(*) OVER (PARTITION BY channel_id, grp_file_idx) AS n FROM deltas)
  WHERE n >= 10 AND i = n // 2),
offsets AS (
  SELECT m.channel_id, m.grp_file_idx, offset_ms FROM med m JOIN deltas d ON d.channel_id = m.channel_id AND d.grp_file_idx = m.grp_file_idx
  WHERE offset_ms <> 0 GROUP BY m.channel_id, m.grp_file_idx, offset_ms, n HAVING count(*) FILTER (WHERE abs(delta - offset_ms) <= 90000) >= 0.6 * n),
anch AS (
  SELECT mn.* EXCLUDE (t_ms), CASE WHEN format = 'txt' AND o.offset_ms IS NOT NULL THEN mn.t_ms - o.offset_ms ELSE mn.t_ms END AS t_ms
  FROM mn LEFT JOIN offsets o ON o.channel_id = mn.channel_id AND o.grp_file_idx = mn.grp_file_idx),
dayed AS (SELECT *, strftime(make_timestamp(t_ms * 1000), '%Y-%m-%d') AS day FROM anch),
keyed_at AS (SELECT channel_id, norm, day, arg_min(author_id, pos) AS to_id FROM dayed WHERE message_id IS NOT NULL AND length(norm) >= 12 GROUP BY 1, 2, 3),
votes AS (
  SELECT l.channel_id, l.author_id AS from_id, k.to_id, count(*) AS n, min(l.pos) AS pos FROM dayed l
  LEFT JOIN keyed_at k ON k.channel_id = l.channel_id AND k.norm = l.norm AND k.day = l.day
  WHERE l.message_id IS NULL AND length(l.norm) >= 12 GROUP BY 1, 2, 3),
bridge AS (
  SELECT channel_id, from_id, to_id FROM (
    SELECT *, row_number() OVER (PARTITION BY channel_id, from_id ORDER BY CASE WHEN to_id IS NULL OR to_id = from_id THEN 1 ELSE 0 END, n DESC, pos) AS r,
      sum(n) OVER (PARTITION BY channel_id, from_id) AS total FROM votes)
  WHERE r = 1 AND to_id IS NOT NULL AND to_id <> from_id AND n >= 3 AND n >= 0.6 * total),
bridged AS (
  SELECT d.* EXCLUDE (author_id, parts), coalesce(b.to_id, d.author_id) AS author_id,
    CASE WHEN r.to_id IS NULL THEN d.parts ELSE list_concat(['> ' || r.to_id || substr(d.parts[1], strpos(d.parts[1], ':'))], d.parts[2:]) END AS parts
  FROM dayed d LEFT JOIN bridge b ON b.channel_id = d.channel_id AND b.from_id = d.author_id
  LEFT JOIN bridge r ON r.channel_id = d.channel_id AND r.from_id = CASE WHEN regexp_matches(d.parts[1], '^> [^:]+:') THEN trim(regexp_extract(d.parts[1], '^> ([^:]+):', 1)) END),
targets AS (SELECT channel_id, message_id, arg_min(author_id, pos) AS target FROM bridged WHERE message_id IS NOT NULL GROUP BY 1, 2),
replied AS (
  SELECT b.* EXCLUDE (parts), CASE WHEN t.target IS NOT NULL AND regexp_matches(b.parts[1], '^> [^:]+:')
      THEN list_concat(['> ' || t.target || substr(b.parts[1], strpos(b.parts[1], ':'))], b.parts[2:]) ELSE b.parts END AS parts
  FROM bridged b LEFT JOIN targets t ON t.channel_id = b.channel_id AND t.message_id = b.ref),
keyed AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, message_id ORDER BY CASE format WHEN 'json' THEN 2 WHEN 'txt' THEN 0 ELSE 1 END DESC, grp_file_idx DESC, msg_idx) AS r
    FROM replied WHERE message_id IS NOT NULL) WHERE r = 1),
per_file AS (SELECT channel_id, author_id, day, norm, grp_file_idx, count(*) AS n FROM replied WHERE message_id IS NULL GROUP BY ALL),
caps AS (
  SELECT p.channel_id, p.author_id, p.day, p.norm, greatest(0, max(p.n) - coalesce(max(k.n), 0)) AS cap FROM per_file p
  LEFT JOIN (SELECT channel_id, author_id, day, norm, count(*) AS n FROM keyed GROUP BY ALL) k
    ON k.channel_id = p.channel_id AND k.author_id = p.author_id AND k.day = p.day AND k.norm = p.norm GROUP BY 1, 2, 3, 4),
loose AS (
  SELECT x.* EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, author_id, day, norm ORDER BY grp_file_idx, msg_idx) AS i FROM replied WHERE message_id IS NULL) x
  JOIN caps c ON c.channel_id = x.channel_id AND c.author_id = x.author_id AND c.day = x.day AND c.norm = x.norm WHERE x.i <= c.cap)"""
ALL = (*MERGES, STAGES)


@query("clock_deltas", "SELECT channel_id, grp_file_idx, delta, count(*) AS n FROM deltas GROUP BY 1, 2, 3", ALL)
def clock_deltas(spark, sf_dir):
    return merge.clock_deltas(prepared(spark, sf_dir))


@query("clock_offsets", "SELECT * FROM offsets", ALL)
def clock_offsets(spark, sf_dir):
    return merge.clock_offsets(merge.clock_deltas(prepared(spark, sf_dir)))


def anchored(spark, sf_dir):
    return merge.anchor_clocks(materialize(prepared(spark, sf_dir), "prepared"))


@query("anchored_clocks", "SELECT channel_id, format, pos, t_ms FROM anch".replace("pos", "grp_file_idx, msg_idx"), ALL)
def anchored_clocks(spark, sf_dir):
    a = anchored(spark, sf_dir)
    return a.select("channel_id", "format", "grp_file_idx", "msg_idx", clock.millis(F.col("ts")).alias("t_ms"))


@query("content_bridge", "SELECT * FROM bridge", ALL)
def content_bridge(spark, sf_dir):
    return merge.content_bridge(anchored(spark, sf_dir))


def bridged(spark, sf_dir):
    a = materialize(anchored(spark, sf_dir), "anchored")
    return merge.apply_bridge(a, merge.content_bridge(a))


@query("bridged_authors", "SELECT channel_id, grp_file_idx, msg_idx, author_id, CASE WHEN regexp_matches(parts[1], '^> ') THEN split_part(parts[1], ':', 1) END AS head FROM bridged", ALL)
def bridged_authors(spark, sf_dir):
    first = F.get("parts", F.lit(0))
    head = F.when(first.rlike("^> "), F.substring_index(first, ":", 1))
    return bridged(spark, sf_dir).select("channel_id", "grp_file_idx", "msg_idx", "author_id", head.alias("head"))


def replied(spark, sf_dir):
    return merge.resolve_reply_targets(materialize(bridged(spark, sf_dir), "bridged"))


@query("reply_targets", "SELECT channel_id, grp_file_idx, msg_idx, split_part(parts[1], ':', 1) AS head FROM replied WHERE ref IS NOT NULL", ALL)
def reply_targets(spark, sf_dir):
    head = F.substring_index(F.get("parts", F.lit(0)), ":", 1)
    r = replied(spark, sf_dir).where("reply_to_message_id IS NOT NULL")
    return r.select("channel_id", "grp_file_idx", "msg_idx", head.alias("head"))


@query("labelled_authors", "SELECT channel_id, author_id, 'Label ' || author_id AS author_name, count(*) AS n FROM mn GROUP BY 1, 2", MERGES)
def labelled_authors(spark, sf_dir):
    m = prepared(spark, sf_dir)
    people = m.select(F.col("author_id").alias("uid")).distinct().withColumn("label", text("Label ", F.col("uid")))
    return merge.label_authors(m, people).groupBy("channel_id", "author_id", "author_name").agg(F.count("*").alias("n"))


@query("signatures", "SELECT channel_id, author_id, strftime(make_timestamp(t_ms * 1000), '%Y-%m-%d') AS day, md5(norm) AS norm, count(*) AS n FROM mn GROUP BY 1, 2, 3, norm")
def signatures(spark, sf_dir):
    from threadlens.functions.parts import norm_text

    m = merge_input(spark, sf_dir).select(
        "channel_id", "author_id", clock.day_key(F.col("ts")).alias("day"), F.md5(norm_text(F.col("parts"))).alias("norm")
    )
    return m.groupBy("channel_id", "author_id", "day", "norm").agg(F.count("*").alias("n"))


@query("keyed_dedup", "SELECT channel_id, message_id, format, grp_file_idx, msg_idx FROM keyed", ALL)
def keyed_dedup(spark, sf_dir):
    return merge.keyed_dedup(prepared(spark, sf_dir)).select("channel_id", "message_id", "format", "grp_file_idx", "msg_idx")


@query("keyless_union", "SELECT channel_id, author_id, day, grp_file_idx, msg_idx FROM loose", ALL)
def keyless_union(spark, sf_dir):
    r = materialize(replied(spark, sf_dir), "replied")
    keyed = merge.keyed_dedup(r).withColumn("day", clock.day_key(F.col("ts")))
    loose = r.where("message_id IS NULL").withColumn("day", clock.day_key(F.col("ts")))
    return merge.keyless_union(loose, keyed).select("channel_id", "author_id", "day", "grp_file_idx", "msg_idx")


@query("merged_conversation", """
SELECT channel_id, author_id, t_ms, format, md5(array_to_string(parts, chr(10))) AS body FROM keyed
UNION ALL SELECT channel_id, author_id, t_ms, format, md5(array_to_string(parts, chr(10))) FROM loose""", ALL)
def merged_conversation(spark, sf_dir):
    r = merge.dedup(materialize(replied(spark, sf_dir), "replied"))
    return r.select("channel_id", "author_id", clock.millis(F.col("ts")).alias("t_ms"), "format",
                    F.md5(F.array_join("parts", "\n")).alias("body"))


@query("conversation_order", """
SELECT channel_id, row_number() OVER (PARTITION BY channel_id ORDER BY t_ms, cls, pos) AS place, author_id, format FROM (
  SELECT k.channel_id, k.t_ms, 0 AS cls, f.pos, k.author_id, k.format FROM keyed k JOIN (SELECT channel_id, message_id, min(pos) AS pos FROM replied GROUP BY 1, 2) f ON f.channel_id = k.channel_id AND f.message_id = k.message_id
  UNION ALL SELECT channel_id, t_ms, 1, pos, author_id, format FROM loose)""", ALL)
def conversation_order(spark, sf_dir):
    from threadlens.operators.ordered import row_numbers, slice_groups

    r = merge.dedup(materialize(replied(spark, sf_dir), "replied"))
    o = row_numbers(slice_groups(r, ["channel_id"], ["ts", "file_idx", "msg_idx"]), "place")
    return o.result().select("channel_id", "place", "author_id", "format")


# ── identity ────────────────────────────────────────────────────────────────


def raw_people(spark, sf_dir) -> DataFrame:
    """Raw messages of a JSON, an older HTML and a text export per channel.

    Some people were renamed between the exports, every third one remade the
    account half way, the text export knows usernames or a name of its own,
    and replies name people who never wrote.
    """
    t = chat_turns(spark, sf_dir)
    w = F.col("who").cast("string")
    null = F.lit(None).cast("string")
    second = (F.col("who") % 3 == 0) & (F.col("conv_id") % 50 >= 25)
    key = text("k", w, F.when(second, "b").otherwise(""))
    user = text("user", w, F.when(second, "_b").otherwise("_a"), "#0001")
    nick = text("nick ", w)
    old = F.when(F.col("who") % 4 == 0, text("old ", w)).otherwise(nick)
    loose = F.when(F.col("who") % 5 == 0, text("ghost ", w)).when(F.col("who") % 2 == 0, text("user", w, "_a")).otherwise(nick)
    lurker = F.when((F.col("turn") % 3 == 2) & (F.col("who") % 6 == 0), text("lurker ", w))

    def rows(df, slot, fmt, k, name, username, reply, shift=0):
        cols = {
            "channel_id": F.col("channel_id"),
            "file_idx": F.col("chan_no") * 3 + slot,
            "grp_file_idx": F.lit(slot),
            "msg_idx": F.col("place"),
            "format": F.lit(fmt),
            "message_id": null if fmt == "txt" else F.col("mid"),
            "author_key": k,
            "author_name": name,
            "author_username": username,
            "ts": F.timestamp_millis(F.col("t_ms") + shift),
            "is_system": F.col("role") == "system",
            "reply_to_key": null,
            "reply_to_message_id": F.when((F.col("turn") % 3 == 2) & F.lit(fmt == "html"), _mid_of(F.col("t_ms") - 90000)),
            "reply_to_name": reply,
            "reply_snippet": F.when(reply.isNotNull(), F.lit("earlier")),
            "parts": F.array("text"),
            "reactions": F.when(F.col("turn") % 4 == 1, text("^{👍:", w, "}")),
        }
        return df.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in RAW_MESSAGE.fields])

    html = rows(t.where("turn >= 1"), 0, "html", key, old, user, lurker)
    json = rows(t, 1, "json", key, nick, user, null)
    txt = rows(t.where("turn < 4"), 2, "txt", null, loose, null, null)
    return html.unionByName(json).unionByName(txt)


PEOPLE = """raw AS (
  SELECT chan_no * 3 + slot AS file_idx, place AS msg_idx, t_ms, key, name, username, reply FROM (
    SELECT *, 0 AS slot, 'k' || who || sfx AS key, CASE WHEN who % 4 = 0 THEN 'old ' || who ELSE 'nick ' || who END AS name, 'user' || who || CASE sfx WHEN 'b' THEN '_b' ELSE '_a' END || '#0001' AS username,
      CASE WHEN turn % 3 = 2 AND who % 6 = 0 THEN 'lurker ' || who END AS reply FROM (SELECT *, CASE WHEN who % 3 = 0 AND conv_id % 50 >= 25 THEN 'b' ELSE '' END AS sfx FROM turns) WHERE turn >= 1
    UNION ALL
    SELECT *, 1, 'k' || who || sfx, 'nick ' || who, 'user' || who || CASE sfx WHEN 'b' THEN '_b' ELSE '_a' END || '#0001', NULL FROM (SELECT *, CASE WHEN who % 3 = 0 AND conv_id % 50 >= 25 THEN 'b' ELSE '' END AS sfx FROM turns)
    UNION ALL
    SELECT *, 2, NULL, CASE WHEN who % 5 = 0 THEN 'ghost ' || who WHEN who % 2 = 0 THEN 'user' || who || '_a' ELSE 'nick ' || who END, NULL, NULL FROM (SELECT *, '' AS sfx FROM turns) WHERE turn < 4)),
o AS (SELECT *, CAST(file_idx AS BIGINT) * 1000000000 + msg_idx AS at_ FROM raw),
ids AS (SELECT key, min(at_) AS at_, arg_min(name, at_) AS name FROM o WHERE key IS NOT NULL GROUP BY 1),
claim1 AS (SELECT name, arg_min(key, at_) AS owner, min(at_) AS at_, 1 AS pass, 0 AS sub FROM ids GROUP BY 1),
handles AS (SELECT key, at_, unnest([username, split_part(username, '#', 1)]) AS name, unnest([0, 1]) AS sub FROM o WHERE key IS NOT NULL),
claim2 AS (SELECT name, arg_min(key, (at_, sub)) AS owner, min(at_) AS at_, 2 AS pass, arg_min(sub, (at_, sub)) AS sub FROM handles WHERE name NOT IN (SELECT name FROM claim1) GROUP BY 1),
claim3 AS (SELECT name, name AS owner, min(at_) AS at_, 3 AS pass, 0 AS sub FROM o WHERE key IS NULL AND name NOT IN (SELECT name FROM claim1 UNION SELECT name FROM claim2) GROUP BY 1),
claim4 AS (SELECT reply AS name, reply AS owner, min(at_) AS at_, 4 AS pass, 0 AS sub FROM o WHERE reply IS NOT NULL
  AND reply NOT IN (SELECT name FROM claim1 UNION SELECT name FROM claim2 UNION SELECT name FROM claim3) GROUP BY 1),
minted AS (
  SELECT 'U' || row_number() OVER (ORDER BY pass, at_) AS uid, * FROM (
    SELECT 'id' AS kind, key, 1 AS pass, at_ FROM ids UNION ALL SELECT 'name', name, 3, at_ FROM claim3 UNION ALL SELECT 'name', name, 4, at_ FROM claim4)),
aliases AS (
  SELECT kind, key, uid, pass, at_, 0 AS sub FROM minted WHERE kind = 'id'
  UNION ALL SELECT 'name', c.name, m.uid, c.pass, c.at_, c.sub FROM (SELECT *, 'id' AS k FROM claim1 UNION ALL SELECT *, 'id' FROM claim2 UNION ALL SELECT *, 'name' FROM claim3 UNION ALL SELECT *, 'name' FROM claim4) c
    JOIN minted m ON m.kind = c.k AND m.key = c.owner),
recency AS (SELECT file_idx, max(t_ms) AS rec FROM o GROUP BY 1),
seen AS (
  SELECT o.*, a.uid, r.rec FROM o JOIN aliases a ON a.kind = CASE WHEN o.key IS NULL THEN 'name' ELSE 'id' END AND a.key = coalesce(o.key, o.name) JOIN recency r ON r.file_idx = o.file_idx),
prof AS (
  SELECT uid, count(*) AS n, min(t_ms) AS lo, max(t_ms) AS hi, min(at_) AS at_, bool_or(key IS NOT NULL) AS id_backed, arg_min(username, at_) FILTER (WHERE username IS NOT NULL) AS username,
    max((rec, t_ms, at_, name)) FILTER (WHERE key IS NOT NULL) AS s1, max((rec, t_ms, at_, name)) FILTER (WHERE key IS NULL) AS s2 FROM seen GROUP BY 1),
nicks AS (SELECT *, coalesce(struct_extract_at(s1, 4), struct_extract_at(s2, 4), uid) AS nick FROM prof),
pairs AS (
  SELECT least(x.uid, y.uid) AS a, greatest(x.uid, y.uid) AS b FROM nicks x JOIN nicks y ON lower(x.nick) = lower(y.nick) AND x.uid < y.uid AND x.id_backed AND y.id_backed
  WHERE 1 - levenshtein(lower(x.username), lower(y.username)) / greatest(length(x.username), length(y.username)) >= 0.6 AND least(x.hi, y.hi) - greatest(x.lo, y.lo) <= 604800000),
roots AS (SELECT uid, least(uid, coalesce((SELECT min(a) FROM pairs WHERE b = uid), uid)) AS root FROM nicks),
canon AS (SELECT root, arg_max(n.uid, (n, -at_)) AS canon FROM roots r JOIN nicks n ON n.uid = r.uid GROUP BY 1),
members AS (SELECT n.*, c.canon FROM nicks n JOIN roots r ON r.uid = n.uid JOIN canon c ON c.root = r.root),
folded AS (
  SELECT canon AS uid, sum(n) AS n, min(at_) AS at_, max((struct_extract_at(s1, 1), struct_extract_at(s1, 2), at_, struct_extract_at(s1, 4))) FILTER (WHERE s1 IS NOT NULL) AS f1,
    max((struct_extract_at(s2, 1), struct_extract_at(s2, 2), at_, struct_extract_at(s2, 4))) FILTER (WHERE s2 IS NOT NULL) AS f2 FROM members GROUP BY 1),
lab0 AS (SELECT uid, CAST(n AS BIGINT) AS n, at_, coalesce(struct_extract_at(f1, 4), struct_extract_at(f2, 4), uid) AS label FROM folded),
labels AS (
  SELECT uid, n, CASE WHEN r > 1 THEN label || ' (' || r || ')' ELSE label END AS label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, at_) AS r FROM lab0)
  UNION ALL
  SELECT a.uid, 0, arg_min(a.key, (a.pass, a.at_, a.sub)) FROM aliases a WHERE a.kind = 'name' AND a.uid NOT IN (SELECT uid FROM prof) GROUP BY a.uid),
final AS (SELECT kind, key, coalesce(m.canon, a.uid) AS uid FROM aliases a LEFT JOIN members m ON m.uid = a.uid)"""
IDS = (CHAT, PEOPLE)


@query("author_observations", """
SELECT file_idx, key, name, coalesce(username, '') AS username, count(*) AS n, min(t_ms) AS lo, max(t_ms) AS hi FROM o GROUP BY 1, 2, 3, 4""", IDS)
def author_observations(spark, sf_dir):
    o = identity.observations(raw_people(spark, sf_dir))
    return o.select("file_idx", "key", "name", "username", "n", "lo", "hi")


@query("file_recency", "SELECT file_idx, rec AS recency FROM recency", IDS)
def file_recency(spark, sf_dir):
    return identity.file_recency(raw_people(spark, sf_dir))


def registered(spark, sf_dir):
    raw = raw_people(spark, sf_dir)
    obs = materialize(identity.observations(raw), "observations")
    minted, claims = identity.register(obs, identity.reply_mentions(raw))
    minted = materialize(minted, "minted")
    return obs, identity.number_identities(minted), claims


@query("identity_numbers", "SELECT kind, key, uid FROM minted", IDS)
def identity_numbers(spark, sf_dir):
    return registered(spark, sf_dir)[1].select("kind", "key", "uid")


@query("identity_aliases", "SELECT kind, key, uid, pass FROM aliases", IDS)
def identity_aliases(spark, sf_dir):
    _, numbered, claims = registered(spark, sf_dir)
    return identity.alias_table(numbered, claims).select("kind", "key", "uid", "pass")


def profiles(spark, sf_dir):
    obs, numbered, claims = registered(spark, sf_dir)
    aliases = materialize(identity.alias_table(numbered, claims), "aliases")
    return identity.profile(obs, aliases, identity.file_recency(raw_people(spark, sf_dir)))


@query("identity_profiles", "SELECT uid, n, lo, hi, id_backed, username, nick FROM nicks", IDS)
def identity_profiles(spark, sf_dir):
    return profiles(spark, sf_dir).select("uid", "n", "lo", "hi", "id_backed", "username", "nick")


@query("remade_account_groups", """
SELECT uid, least(a, uid) AS root FROM (SELECT b AS uid, min(a) AS a FROM pairs GROUP BY 1 UNION SELECT a, a FROM pairs)""", IDS)
def remade_account_groups(spark, sf_dir):
    people = materialize(profiles(spark, sf_dir), "people")
    return identity.connected_components(identity.remade_edges(people))


@query("identity_labels", "SELECT * FROM labels", IDS)
def identity_labels(spark, sf_dir):
    return identity.build_identity(raw_people(spark, sf_dir)).people


@query("identity_real_names", "SELECT f.kind, f.key, l.label AS uid FROM final f JOIN labels l ON l.uid = f.uid", IDS)
def identity_real_names(spark, sf_dir):
    return identity.build_identity(raw_people(spark, sf_dir), use_real_names=True).aliases


ASSEMBLED_SQL = """
SELECT r.file_idx, r.msg_idx, coalesce(f.uid, r.name) AS author_id, CASE WHEN r.reply IS NOT NULL THEN '> ' || g.uid || ': earlier' END AS head
FROM raw r LEFT JOIN final f ON f.kind = CASE WHEN r.key IS NULL THEN 'name' ELSE 'id' END AND f.key = coalesce(r.key, r.name)
LEFT JOIN final g ON g.kind = 'name' AND g.key = r.reply"""


@query("assembled_messages", ASSEMBLED_SQL, IDS)
def assembled_messages(spark, sf_dir):
    raw = raw_people(spark, sf_dir)
    m = identity.assemble(raw, identity.build_identity(raw))
    head = F.when(F.col("has_reply"), F.get("parts", F.lit(0)))
    return m.select("file_idx", "msg_idx", "author_id", head.alias("head"))
