import pytest
from pyspark.sql import functions as F

from threadlens.operators import analytics as A, filters, graph, sequences as S


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture
def chat(make_msgs):
    return make_msgs(
        dict(author_id="U1", author_name="ann", ts="2025-07-12T03:50:00Z", parts=["Hello world"]),
        dict(author_id="U1", author_name="ann", ts="2025-07-12T03:51:00Z", parts=["a photo", "[IMG: x.png]", "^{👍:3}"]),
        dict(author_id="U2", author_name="bea", ts="2025-07-12T05:00:00Z", parts=["> U1: Hello world", "hi"], has_reply=True),
        dict(author_id="U2", author_name="bea", ts="2025-07-13T10:00:00Z", parts=["ok ^{😂:2}"]),
    )


def test_totals_and_grids(chat):
    e = A.enrich(chat)
    t = A.totals(e).first()
    assert (t["messages"], t["participants"], t["active_days"], t["peak_hour"], t["reactions"]) == (4, 2, 2, 3, 5)
    assert rows(A.heatmap(e), "dow", "hour", "n") == [(0, 10, 1), (6, 3, 2), (6, 5, 1)]
    assert A.heatmap(e, dense=True).count() == 168
    assert rows(A.timeline(e), "day", "n") == [("2025-07-12", 3), ("2025-07-13", 1)]


def test_users_media_reactions_edges(chat):
    e = A.enrich(chat)
    u = {r["author_id"]: r for r in A.user_stats(e).collect()}
    assert (u["U1"]["messages"], u["U1"]["words"], u["U1"]["media"], u["U1"]["replies"]) == (2, 4, 1, 0)
    assert (u["U2"]["replies"], u["U2"]["media"], u["U2"]["active_days"], u["U2"]["avg_len"]) == (1, 0, 2, 2)
    assert rows(A.reaction_totals(e), "emoji", "n") == [("👍", 3), ("😂", 2)]
    assert rows(A.media_breakdown(e), "kind", "n") == [("IMG", 1)]
    assert rows(A.reply_edges(e), "src", "dst", "n") == [("U2", "U1", 1)]


def test_zone_moves_the_day(chat):
    e = A.enrich(chat, tz="America/New_York")
    assert rows(A.timeline(e), "day", "n") == [("2025-07-11", 2), ("2025-07-12", 1), ("2025-07-13", 1)]


def test_invalid_time_counts_as_message_only(make_msgs):
    e = A.enrich(make_msgs(dict(author_id="U1", ts=None), dict(author_id="U2", ts="2025-01-01T00:00:00Z")))
    t = A.totals(e).first()
    assert (t["messages"], t["participants"], t["active_days"]) == (2, 1, 1)


def test_strict_reply(make_msgs):
    m = make_msgs(dict(author_id="U1", ts="2025-01-01T00:00:00Z", parts=["> quoted: text"]))
    assert A.reply_edges(A.enrich(m)).count() == 1
    assert A.reply_edges(A.enrich(m, strict_reply=True)).count() == 0


@pytest.fixture
def story(make_msgs):
    return make_msgs(
        dict(author_id="U1", author_name="ann", ts="2025-01-01T10:00:00Z", parts=["hello all, this one is by far the longest of them"]),
        dict(author_id="U2", author_name="bea", ts="2025-01-01T10:05:00Z", parts=["> U1: hello", "ok ^{🔥:7}"]),
        dict(author_id="U1", author_name="ann", ts="2025-01-02T11:00:00Z", parts=["second ^{🔥:2}"]),
        dict(author_id="U2", author_name="bea", ts="2025-01-02T11:01:00Z", parts=["> U1: second", "reply"]),
        dict(author_id="U1", author_name="ann", ts="2025-01-03T09:00:00Z", parts=["[IMG: p.png]"]),
    )


def test_recap(story):
    r = {(x["metric"], x["name"]): (x["value"], x["detail"]) for x in S.recap(A.enrich(story)).collect()}
    by = {k[0]: (k[1], *v) for k, v in r.items()}
    assert by["streak"][1] == 3
    assert by["avg_per_day"][1] == 2
    assert by["busiest_day"] == ("2025-01-01", 2, None)
    assert by["busiest_weekday"][0] == "3"
    assert by["top_emoji"][:2] == ("🔥", 9)
    assert by["most_reacted"][:2] == ("bea", 7)
    assert by["longest"][0] == "ann"
    assert by["top_pair"] == ("bea", 2, "ann")
    assert by["starter"][:2] == ("ann", 3)
    assert by["total_media"][1] == 1
    assert "night_owl" not in by and "quiet_gap" not in by


def test_empty_recap(make_msgs):
    e = A.enrich(make_msgs(dict(author_id="U1", ts="2025-01-01T00:00:00Z")).where("false"))
    assert {r["metric"]: r["value"] for r in S.recap(e).collect()}["messages"] == 0


def test_network(spark):
    users = [("U1", 100), ("U2", 50), ("U3", 50), ("U4", 30), ("U5", 40), ("U6", 40)]
    edges = [("U1", "U2", 5), ("U1", "U3", 5), ("U1", "U5", 5), ("U1", "U6", 5), ("U2", "U3", 20), ("U3", "U2", 18),
             ("U2", "U1", 4), ("U3", "U1", 4), ("U4", "U1", 10), ("U5", "U6", 6), ("U6", "U5", 6), ("U2", "U6", 2),
             ("U1", "U1", 99)]
    u = spark.createDataFrame([(a, a, n, i) for i, (a, n) in enumerate(users)], "author_id string, author_name string, messages long, first_pos int")
    e = spark.createDataFrame([(*x, i) for i, x in enumerate(edges)], "src string, dst string, n long, first_pos int")
    net = {(r["a"], r["b"]): r for r in graph.network_edges(u, e).collect()}
    assert net["U5", "U6"]["w"] == pytest.approx(1)
    assert net["U1", "U4"]["w"] == 0
    assert ("U2", "U6") not in net
    assert net["U2", "U3"]["raw"] == 38
    assert net["U2", "U3"]["w"] > net["U1", "U2"]["w"]
    assert graph.network_nodes(u, e).count() == 6
    assert graph.network_nodes(u, e, max_nodes=1).count() == 0
    assert graph.top_duo(e).first()["src"] == "U2"
    partners = [r for r in graph.reply_partners(e).collect() if r["uid"] == "U1" and r["side"] == "replied_by"]
    assert [(r["partner"], r["n"]) for r in sorted(partners, key=lambda r: r["rank"])] == [("U4", 10), ("U2", 4), ("U3", 4)]


def test_sessions_and_blocks_sliced(make_msgs):
    stamps = ["00:00:00", "00:05:00", "00:12:00", "05:00:00", "05:01:00", "09:01:00", "09:01:01"]
    who = ["a", "a", "a", "a", "b", "b", "b"]
    m = make_msgs(*[dict(author_id=w, ts=f"2025-01-01T{s}Z", is_system=(s == "09:01:01")) for s, w in zip(stamps, who)])
    for limit in (1000, 3):
        s = [tuple(r) for r in S.sessions(m, limit).orderBy("msg_idx").select("is_break", "session_no").collect()]
        assert s == [(False, 1), (False, 1), (False, 1), (True, 2), (False, 2), (False, 2), (False, 2)]
        b = [r["grouped"] for r in S.author_blocks(m, limit).orderBy("msg_idx").collect()]
        assert b == [False, True, False, False, False, False, False]


def test_filters(make_msgs, spark):
    m = make_msgs(
        dict(author_id="U1", author_name="ann", ts="2025-01-01T00:00:00Z", parts=["Cost (a+b)"]),
        dict(author_id="U2", author_name="bot", ts="2025-01-01T23:59:59.999Z", parts=["[IMG: x]"]),
        dict(author_id="U1", author_name="ann", ts="2025-01-02T00:00:00Z", parts=["ÉTÉ"], is_system=True),
    )
    day = F.lit("2025-01-01")
    from threadlens.functions.clock import day_edge

    assert filters.in_date_range(m, day_edge(day), day_edge(day, True)).count() == 2
    assert filters.drop_bots(m, spark.createDataFrame([("bot",)], "n string")).count() == 2
    assert filters.drop_system(m).count() == 2
    assert filters.drop_media_only(m).count() == 2
    hit = lambda *k: m.where(filters.matches_keywords(F.col("parts"), k)).count()
    assert (hit("(A+B)"), hit("été"), hit("/c.st/"), hit("/c.st/m"), hit("/(/")) == (1, 1, 1, 0, 0)
    # what the JVM takes is a pattern, anything else a literal
    assert (hit("/(?<x>c.st)/"), hit("/(?P<x>c.st)/")) == (1, 0)
    assert filters.drop_low_activity(m, 2).count() == 2
    people = spark.createDataFrame([("U1", "ann"), ("U2", "bot")], "uid string, label string")
    assert filters.keep_authors_by_label(m, spark.createDataFrame([("ann",)], "n string"), people).count() == 2
    assert filters.keep_authors_by_id(m, spark.createDataFrame([("U2",)], "u string")).count() == 1


def test_pages_and_hours(make_msgs):
    m = make_msgs(*[dict(author_id="a", ts=f"2025-01-0{1 + i // 5}T{4 * (i % 5):02d}:00:00Z") for i in range(15)])
    e = A.enrich(m)
    for limit in (1000, 2):
        got = S.page(e, 3, 6, max_rows=limit).orderBy("idx").select("idx", "msg_idx").collect()
        assert [tuple(r) for r in got] == [(i, i) for i in range(3, 9)]
    idx = S.day_index(e)
    assert rows(S.index_for_hour(idx, 9), "day", "idx") == [("2025-01-01", 3), ("2025-01-02", 8), ("2025-01-03", 13)]
    assert rows(S.index_for_hour(idx, 20), "day", "idx") == [("2025-01-01", 0), ("2025-01-02", 5), ("2025-01-03", 10)]
