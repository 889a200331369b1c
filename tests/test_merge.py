from datetime import datetime, timedelta

from pyspark.sql import functions as F

from threadlens.functions.clock import millis
from threadlens.operators import merge as M
from threadlens.session import materialize

BASE = datetime(2025, 7, 12, 20, 0, 0)


def stamp(minutes, seconds=0):
    return (BASE + timedelta(minutes=minutes, seconds=seconds)).isoformat() + "Z"


def keyed(i, text, author="U1", fmt="json", file=0, minutes=None, **kw):
    return dict(message_id=str(i), author_id=author, format=fmt, file_idx=file, msg_idx=i,
                ts=stamp(i * 7 if minutes is None else minutes, 30), parts=[text], **kw)


def loose(i, text, author="U1", file=1, minutes=None, **kw):
    return dict(author_id=author, format="txt", file_idx=file, msg_idx=i,
                ts=stamp(i * 7 if minutes is None else minutes), parts=[text], **kw)


def run(msgs, max_rows=1000):
    """The merge with a written layer between steps, as the plan runs it."""
    m = materialize(M.prepare(msgs), "t")
    m = materialize(M.anchor_clocks(m, max_rows), "t")
    m = materialize(M.apply_bridge(m, M.content_bridge(m)), "t")
    m = materialize(M.resolve_reply_targets(m), "t")
    return materialize(M.dedup(m, max_rows), "t")


def test_shifted_text_copy_disappears(make_msgs):
    """Two hours off, over midnight; one row only the text export has."""
    rows = [keyed(i, f"distinct message number {i}", minutes=i * 20) for i in range(12)]
    rows += [loose(i, f"distinct message number {i}", minutes=i * 20 + 120) for i in range(12)]
    rows.append(loose(50, "only here, long enough", minutes=400))
    m = make_msgs(*rows)
    for limit in (1000, 5):
        out = run(m, limit)
        assert out.count() == 13
        kept = out.where("format = 'txt'").first()
        assert kept["ts"] == BASE + timedelta(minutes=280)


def test_few_or_disagreeing_samples_shift_nothing(make_msgs):
    few = [keyed(i, f"distinct message number {i}") for i in range(4)] + [
        loose(i, f"distinct message number {i}", minutes=i * 7 + 120) for i in range(4)]
    assert M.clock_offsets(M.clock_deltas(M.prepare(make_msgs(*few)))).count() == 0
    wild = [keyed(i, f"distinct message number {i}") for i in range(12)] + [
        loose(i, f"distinct message number {i}", minutes=i * 7 + 60 + 37 * i) for i in range(12)]
    assert M.clock_offsets(M.clock_deltas(M.prepare(make_msgs(*wild)))).count() == 0


def test_nearest_twin_among_many_copies(make_msgs):
    """A text posted over and over: each row meets the nearest copy only."""
    rows = [keyed(i, "the very same announcement", minutes=i * 60) for i in range(30)]
    rows += [loose(i, "the very same announcement", minutes=i * 60 + 10) for i in range(30)]
    m = M.prepare(make_msgs(*rows))
    for limit in (1000, 7):
        d = M.clock_deltas(m, limit).collect()
        assert [(r["delta"], r["n"]) for r in d] == [(9 * 60000 + 30000, 30)]


def test_bridge_links_a_renamed_author(make_msgs):
    rows = [keyed(i, f"long enough text {i}") for i in range(5)]
    rows += [loose(i, f"long enough text {i}", author="U9") for i in range(5)]
    rows.append(loose(20, "> U9: quoted words that are long", author="U7"))
    out = run(make_msgs(*rows))
    assert out.where("author_id = 'U9'").count() == 0
    assert out.count() == 6
    assert out.where("author_id = 'U7'").first()["parts"] == ["> U1: quoted words that are long"]


def test_no_bridge_on_thin_evidence(make_msgs):
    two = [keyed(i, f"long enough text {i}") for i in range(2)] + [loose(i, f"long enough text {i}", author="U9") for i in range(2)]
    assert M.content_bridge(M.prepare(make_msgs(*two))).count() == 0
    mixed = [keyed(i, f"long enough text {i}") for i in range(3)]
    mixed += [loose(i, f"long enough text {i}", author="U9") for i in range(3)]
    mixed += [loose(10 + i, f"something else entirely {i}", author="U9") for i in range(3)]
    assert M.content_bridge(M.prepare(make_msgs(*mixed))).count() == 0
    short = [keyed(i, f"lol{i}") for i in range(9)] + [loose(i, f"lol{i}", author="U9") for i in range(9)]
    assert M.content_bridge(M.prepare(make_msgs(*short))).count() == 0


def test_best_copy_per_id(make_msgs):
    out = run(make_msgs(
        keyed(1, "html, later file", fmt="html", file=5),
        keyed(1, "json first", file=1),
        keyed(1, "json again", file=1, minutes=999) | dict(msg_idx=9),
        keyed(1, "json later export", file=3),
    ))
    assert [r["parts"] for r in out.collect()] == [["json later export"]]


def test_reply_token_follows_the_message_id(make_msgs):
    out = run(make_msgs(
        keyed(1, "hello there friends", author="U1"),
        dict(message_id="2", author_id="U2", format="html", file_idx=1, ts=stamp(50), has_reply=True,
             parts=["> oldname: hello", "yes"], reply_to_message_id="1"),
    ))
    assert out.where("message_id = '2'").first()["parts"] == ["> U1: hello", "yes"]


def test_repeats_and_overlaps(make_msgs):
    """Repeats inside one file stay, overlap between files goes, ids cover first."""
    m = make_msgs(
        loose(0, "lol", file=0, minutes=0), loose(1, "lol", file=0, minutes=1), loose(2, "lol", file=0, minutes=2),
        loose(0, "lol", file=1, minutes=0), loose(1, "lol", file=1, minutes=1),
        keyed(7, "lol", file=2, minutes=1),
        loose(0, "lol", file=0, minutes=0, channel_id="other"), loose(1, "lol", file=0, minutes=3000),
    )
    for limit in (1000, 2):
        out = run(m, limit)
        assert out.where("channel_id = 'c' AND to_date(ts) = '2025-07-12'").count() == 3
        assert out.count() == 5
        kept = out.where("channel_id = 'c' AND format = 'txt' AND to_date(ts) = '2025-07-12'")
        assert sorted(r["src_msg_idx"] for r in kept.collect()) == [0, 1]


def test_order_within_an_instant(make_msgs):
    out = run(make_msgs(
        loose(0, "text only", file=0, minutes=0), keyed(5, "b", file=1, minutes=0) | dict(ts=stamp(0)),
        keyed(4, "a", file=1, minutes=0) | dict(ts=stamp(0)),
    ))
    got = [r["parts"][0] for r in out.orderBy("ts", "file_idx", "msg_idx").collect()]
    assert got == ["a", "b", "text only"]


def test_result_does_not_depend_on_partitioning(make_msgs, spark):
    rows = [keyed(i, f"text number {i % 9} long", author=f"U{i % 3}") for i in range(40)]
    rows += [loose(i, f"text number {i % 9} long", author=f"U{i % 3}", minutes=i * 7) for i in range(60)]
    m = make_msgs(*rows)
    seen = set()
    for parts in ("1", "8", "20"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = run(m.repartition(int(parts))).select("author_id", millis(F.col("ts")).alias("t"), "msg_idx", "format", "parts")
        seen.add(repr(sorted(map(repr, out.collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(seen) == 1
