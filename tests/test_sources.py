import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from threadlens.functions.clock import millis
from threadlens.plans import conversation
from threadlens.plans.options import Options
from threadlens.sources import catalog, html_export, json_export, json_structure, txt_export

EPOCH = 1_420_070_400_000  # fixed value: ids count milliseconds from here, shifted by 22 bits


def msg(id, text="noted", user="40", **kw):
    d = {"id": id, "type": "Default", "timestamp": "2023-11-19T17:52:08+00:00", "content": text,
         "author": {"id": user, "name": f"handle{user}", "nickname": f"Person {user}"},
         "attachments": [], "embeds": [], "stickers": [], "reactions": []}
    d.update(kw)
    return d


def doc(*messages, **kw):
    d = {"guild": {"name": "Harbour"}, "channel": {"id": "5150", "category": "boats", "name": "moorings"},
         "dateRange": {"after": "2023-10-31T00:00:00", "before": None}, "exportedAt": "2024-06-02T10:30:00+00:00",
         "messages": list(messages)}
    d.update(kw)
    return d


MESSAGES = [
    msg("801", "\t tide at nine \n bring " + "rope " * 30),
    msg("802", "", user="41", attachments=[{"fileName": "chart.JPEG"}, {"fileName": "log.csv"}, {"fileName": ""}]),
    msg("803", "which berth?", user="42", reactions=[{"emoji": {}, "count": 2}, {"emoji": {"name": "⚓"}}, {"emoji": {"name": "🛟"}, "count": 11}]),
    msg("804", "on my way", user="41", type="Reply", reference={"messageId": "801"}),
    msg("805", "no clock", timestamp="soon"),
    msg("806", "", user="43"),
    msg("807", "Call ended.", type="Call"),
    msg("808", "", user="42", stickers=[{"id": "9"}], embeds=[{"title": "Knots", "url": "https://www.youtube.com/watch?v=k"},
        {"title": " ", "url": "https://example.org"}, {"title": "Weather"}, {"title": "Clip", "video": {"url": "https://v"}}]),
    msg("809", "see above", type="Reply", reference={"messageId": "no such"}, forwardedMessage={"content": " passed on ", "attachments": [{"fileName": "dock.webm"}]}),
    msg("810", "which one", type="Reply", reference={"messageId": "802"}, author={"id": "44", "name": "bare name"}),
]


def layouts(d):
    """One document in many spellings."""
    lines = ",\n".join("    " + json.dumps(m) for m in d["messages"])
    first = json.dumps({k: v for k, v in d.items() if k != "messages"})[:-1]
    started = ",\n".join("    " + json.dumps(m, indent=2).replace("\n", " ", 1).replace("{ ", "{", 1) for m in d["messages"])
    nested = json.dumps(d, indent=2).replace('{\n      "id"', '{"id"')
    return {
        "two blanks": json.dumps(d, indent=2), "one line": json.dumps(d), "no blanks": json.dumps(d, separators=(",", ":"), ensure_ascii=False),
        "tabs": json.dumps(d, indent="\t"), "deep": json.dumps(d, indent=7), "byte order mark": "\ufeff" + json.dumps(d, indent=2),
        "line each": f'{first},\n  "messages": [\n{lines}\n  ],\n  "messageCount": 3\n}}',
        "started on the brace": f'{first},\n  "messages": [\n{started}\n  ],\n  "messageCount": 3\n}}', "nested start": nested,
        "windows": json.dumps(d, indent=2).replace("\n", "\r\n"),
        "first": json.dumps({"messages": d["messages"], **{k: v for k, v in d.items() if k != "messages"}}),
    }


LAYOUTS = list(layouts(doc()))


@pytest.mark.parametrize("layout", LAYOUTS)
def test_json_export(spark, tmp_path, layout):
    (tmp_path / "a.json").write_text(layouts(doc(*MESSAGES))[layout])
    heads, elements = json_export.read(spark, str(tmp_path))
    got = {r["message_id"]: r for r in json_export.to_raw_messages(elements).collect()}
    assert sorted(got) == ["801", "802", "803", "804", "807", "808", "809", "810"]
    assert got["802"]["parts"] == ["[IMG: chart.JPEG]", "[MEDIA: log.csv]"]
    assert got["803"]["reactions"] == "^{?:2, ⚓:1, 🛟:11}"
    assert (got["804"]["reply_to_name"], got["804"]["reply_to_key"]) == ("Person 40", "40")
    whole = "tide at nine   bring " + ("rope " * 30).strip()
    assert got["804"]["reply_snippet"] == whole[:80] + "…"
    assert got["807"]["is_system"] and not got["804"]["is_system"]
    assert got["808"]["parts"] == ["[YT: Knots]", "[EMBED: Weather]", "[VID: Clip]", "[STICKER]"]
    assert got["809"]["parts"] == ["see above", "passed on", "[VID: dock.webm]"]
    assert (got["809"]["reply_to_message_id"], got["809"]["reply_to_name"]) == ("no such", None)
    assert got["810"]["author_name"] == "bare name" and got["810"]["reply_snippet"] == "…"
    order = [r["message_id"] for r in sorted(got.values(), key=lambda r: r["msg_idx"])]
    assert order == sorted(got)
    h = heads.first()
    assert (h["channel_id"], h["base_name"], h["after_date"], h["invalid"]) == ("5150", "Harbour - boats - moorings", "2023-10-31", False)


def random_document(rng, n):
    """Strings full of what structure is made of."""
    odd = ["{", "}", "[", "]", '"', "\\", ",", ":", '"messages":[', "\n", "é", "😀", "word ", "},{", '\\"', "\\\\"]
    out = []
    for k in range(n):
        text = "".join(rng.choice(odd) for _ in range(rng.randrange(25)))
        m = msg(str(k), text, embeds=[{"title": text[:3], "url": "u"}] * rng.randrange(3), attachments=[{"fileName": "f{.png"}] * rng.randrange(2))
        out.append(dict(rng.sample(list(m.items()), len(m))))
    extra = {"messages of before": [[{"id": 1}], []], "topic": '{"messages":[{'}
    return doc(*out, **(extra if rng.random() < 0.5 else {}), tail={"messages": [{"a": "]"}, {}], "b": [{"c": {}}]})


@pytest.mark.parametrize("split", [900, 1 << 20])
def test_json_cut_by_structure_against_a_plain_parse(spark, tmp_path, split):
    rng = random.Random(split)
    docs = {f"d{k}.json": random_document(rng, [0, 1, 3, 30, 30, 2][k]) for k in range(6)}
    for k, (name, d) in enumerate(docs.items()):
        (tmp_path / name).write_text(json.dumps(d, indent=[None, 1, None, "\t"][k % 4], ensure_ascii=k % 2 == 0))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        braces = json_structure.read_braces(spark, str(tmp_path))
        if split < 1000:
            assert braces.select("file_id", "block").distinct().count() > 12
        elements, heads = json_structure.parsed(*json_structure.pieces(spark, braces, max_rows=5))
        got = elements.select(F.substring_index("file_id", "/", -1).alias("name"), "msg_idx", "m.id", "m.content").collect()
        for name, d in docs.items():
            mine = sorted((r["msg_idx"], r["id"], r["content"]) for r in got if r["name"] == name)
            assert [(i, c) for _, i, c in mine] == [(m["id"], m["content"]) for m in d["messages"]]
            assert len({p for p, *_ in mine}) == len(mine)
        assert heads.where("NOT bad AND d.messages IS NOT NULL AND d.channel.id = '5150'").count() == len(docs)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


@pytest.mark.parametrize("content", [
    '{"messages": [{"id": "1"} {"id": "2"}]}', '{"messages": [{"id": "1"},]}', '{"messages": [,{"id": "1"}]}', '{"messages": [{"id": "1"}]',
    '{"messages": [{"id": "1"}, 7]}', '{"messages": [{"id": "1"}]]}', '{"messages": [{"id": "1", }]}', '{"messages": [{"id": "1}]}', "[]]",
])
def test_json_that_is_none(spark, tmp_path, content):
    (tmp_path / "a.json").write_text(content)
    (tmp_path / "b.json").write_text(json.dumps(doc(msg("1"))))
    heads, _ = json_export.read(spark, str(tmp_path))
    assert {r["file_id"].rsplit("/", 1)[1] for r in heads.collect() if r["invalid"]} == {"a.json"}


def test_last_duplicate_id_answers_a_reply(spark, tmp_path):
    d = doc(msg("1", "old"), msg("2", "r", type="Reply", reference={"messageId": "1"}), msg("1", "new"))
    (tmp_path / "a.json").write_text(json.dumps(d, indent=2))
    got = json_export.scan(json_export.read_fragments(spark, str(tmp_path)))
    assert got.where("message_id = '2'").first()["reply_snippet"] == "new"


def test_large_json_file_is_read_by_many_tasks(spark, tmp_path):
    d = doc(*[msg(str(i), f"text {i}") for i in range(3000)])
    (tmp_path / "a.json").write_text(json.dumps(d, indent=2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        frag = json_export.read_fragments(spark, str(tmp_path))
        assert frag.rdd.getNumPartitions() > 4
        ids = [r["message_id"] for r in json_export.scan(frag).orderBy("msg_idx").select("message_id").collect()]
        assert ids == [str(i) for i in range(3000)]
        assert json_export.headers(frag).first()["invalid"] is False
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("content, error", [
    ("{nope", "Invalid JSON"),
    ("not json at all", "Invalid JSON"),
    ('{"channel": {"id": "1"}}', 'Missing a "messages" array.'),
    (json.dumps(doc(msg("1"), msg("2")), indent=2)[:-40], "Invalid JSON"),
])
def test_invalid_json(spark, tmp_path, content, error):
    (tmp_path / "a.json").write_text(content)
    for heads in (json_export.headers(json_export.read_fragments(spark, str(tmp_path))), json_export.read(spark, str(tmp_path))[0]):
        h = heads.first()
        assert h["invalid"] and h["error"] == error


def test_lines_of_messages_are_cut_at_lines(spark, tmp_path):
    d = doc(msg("1", "a {b}"), msg("2", "c },"), msg("3"))
    lines = ",\n".join("    " + json.dumps(m) for m in d["messages"])
    head = json.dumps({k: v for k, v in d.items() if k != "messages"})[:-1]
    (tmp_path / "a.json").write_text(f'{head},\n  "messages": [\n{lines}\n  ],\n  "messageCount": 3\n}}')
    fragments = json_export.read_fragments(spark, str(tmp_path))
    assert not json_export.headers(fragments).first()["invalid"]
    got = json_export.scan(fragments).orderBy("msg_idx").collect()
    assert [r["message_id"] for r in got] == ["1", "2", "3"] and got[1]["parts"] == ["c },"]


def test_equal_names_in_different_folders_are_different_files(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "general.json").write_text(json.dumps(doc(msg(f"{folder}1")), indent=2))
    files = catalog.latest_uploads(catalog.list_files(spark, str(tmp_path)))
    assert sorted(r["key"] for r in files.collect()) == ["a/general.json", "b/general.json"]
    again = catalog.latest_uploads(catalog.list_files(spark, str(tmp_path / "a"), str(tmp_path / "b")))
    assert again.count() == 1
    with pytest.raises(ValueError, match="no export files"):
        (tmp_path / "none").mkdir()
        conversation.read_exports(spark, str(tmp_path / "none"), Options())


TXT = """==============================================================
Guild: Harbour
Channel: boats / slipway
==============================================================

[11/19/2023 5:52 PM] ida
{Attachments}
https://files.example/m/low%20tide.gif?w=2
gopher://nothing

Low tide picture

[11/19/2023 11:59 PM] otto
first line

    indented line

{Stickers}
https://files.example/s/1.png

{Reactions}
⚓ (4)
🛟

[11/20/2023 12:00 AM] mia
pinned a message.

[11/20/2023 12:07 AM] ida
{Forwarded Message}
old words
Originally sent: 1/2/2020

{Embed}
Forecast
windy

said after
{Attachments}
https://files.example/x/a+b.tar
https://

[2/30/2023 1:00 PM] ghost
not a day

[11/20/2023 9:15 AM] otto
[not a header] text
==============================================================
Exported 6 message(s)
==============================================================
"""


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_txt_export(spark, tmp_path, newline):
    (tmp_path / "a.txt").write_bytes(TXT.replace("\n", newline).encode())
    lines = txt_export.read_lines(spark, str(tmp_path))
    got = txt_export.scan(lines).orderBy("msg_idx").collect()
    assert [r["author_name"] for r in got] == ["ida", "otto", "mia", "ida", "otto"]
    assert got[0]["parts"] == ["Low tide picture", "[GIF: low tide.gif]"]
    assert got[1]["parts"] == ["first line\n\n    indented line", "[STICKER]"] and got[1]["reactions"] == "^{⚓ (4), 🛟}"
    assert got[2]["is_system"] and not got[1]["is_system"]
    assert got[3]["parts"] == ["old words\n\nsaid after", "[MEDIA: a+b.tar]", "[MEDIA: unknown]"]
    assert got[4]["parts"] == ["[not a header] text"]
    assert [(r["ts"].day, r["ts"].hour, r["ts"].minute) for r in got] == [(19, 17, 52), (19, 23, 59), (20, 0, 0), (20, 0, 7), (20, 9, 15)]
    h = txt_export.headers(lines).first()
    assert (h["channel_id"], h["base_name"]) == ("Harbour|boats / slipway", "Harbour - slipway")
    away = txt_export.scan(lines, "Asia/Tokyo").orderBy("msg_idx").first()
    assert away["ts"].hour == 8


def test_txt_file_over_many_blocks(spark, tmp_path):
    body = "".join(f"[3/4/2025 3:{i % 60:02d} AM] p{i % 7}\nline {i}\nmore {i}\n\n" for i in range(4000))
    (tmp_path / "a.txt").write_text("Guild: g\nChannel: c\n\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = txt_export.read_lines(spark, str(tmp_path))
        got = [r["parts"][0] for r in txt_export.scan(lines).orderBy("msg_idx").select("parts").collect()]
        assert got == [f"line {i}\nmore {i}" for i in range(4000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def sent(when):
    """An id that holds its time."""
    return str((int(datetime.fromisoformat(when).replace(tzinfo=UTC).timestamp() * 1000) - EPOCH) << 22)


OPENINGS = [
    '<div class="chatlog__message-group">', "<div class='chatlog__message-group'>", "<div class=chatlog__message-group>",
    '<div id="g7" class="chatlog__message-group">', '<div data-note="a > b" class="first chatlog__message-group last" title="x < y">',
    '<section\n  class="wide\n chatlog__message-group">', '<DIV CLASS = "chatlog__message-group" >',
]


def html(groups, opening=lambda k: OPENINGS[0]):
    out = ["<!DOCTYPE html><html><head><style>.chatlog__message-group{}</style></head><body><p>chatlog__message-group</p>"]
    for k, (author, uid, boxes) in enumerate(groups):
        tag = opening(k)
        out.append(tag)
        for i, (mid, inner) in enumerate(boxes):
            head = f'<span class="chatlog__author" title="{author}.x" data-user-id="{uid}">{author}</span>' if i == 0 else ""
            out.append(f'<div class="chatlog__message-container" {mid}><div>{head}{inner}</div></div>')
        out.append(f"</{tag[1:8].split()[0].rstrip('>')}>")
    return "".join(out) + '<div class="chatlog__postamble">Exported</div></body></html>'


def body(t):
    return f'<div class="chatlog__content"><span class="chatlog__markdown-preserve">{t}</span></div>'


GROUPS = [
    ("ida", "40", [('data-message-id="%s"' % sent("2023-11-19T17:52:08"), body("nine &amp; <em>ten</em> class=&quot;chatlog__message-group&quot;"))]),
    ("otto", "41", [
        ('id="message-77"', '<span class="chatlog__short-timestamp" title="Sunday, November 19, 2023 6:20 PM"></span>' + body("dated by title")),
        ('data-message-id="%s"' % sent("2023-11-19T18:21:30"),
         body("full") + '<div class="chatlog__attachment"><video src="https://f/clip%201.MP4?x"></video></div><a class="chatlog__attachment" href="pic.png#top"></a>'
         '<div class="chatlog__embed"><div class="chatlog__embed-title">Weather</div></div><div class="chatlog__embed"><div class="chatlog__embed-provider">YouTube</div></div>'
         '<div class="chatlog__reaction"><img alt="⚓"></div><div class="chatlog__reaction"><img alt="🛟"><span class="chatlog__reaction-count">12</span></div>'
         '<p title="chatlog__message-group" data-class="x chatlog__message-group">chatlog__message-group</p>'),
        ('id="message-78"', body("no time at all")),
        ('data-message-id="%s"' % sent("2023-11-19T18:22:00"), '<span class="chatlog__system-notification-content">left the call.</span>'),
        ('data-message-id="%s"' % sent("2023-11-19T18:23:59"),
         '<div class="chatlog__reply"><div class="chatlog__reply-author">ida</div><div class="chatlog__reply-content"><span class="chatlog__reply-link" '
         f'onclick="scrollToMessage(event,\'{sent("2023-11-19T17:52:08")}\')">Click to see original</span></div></div>' + body("eleven")),
    ]),
    ("mia", "43", [('data-message-id="%s"' % sent("2023-11-20T00:00:00"), '<div class="chatlog__sticker"></div><div class="chatlog__sticker"></div>')]),
]


def scanned(spark, path, **kw):
    return html_export.scan(html_export.read_fragments(spark, str(path)), **kw).orderBy("msg_idx").collect()


@pytest.mark.parametrize("spelling", [*range(len(OPENINGS)), "all"])
def test_html_export(spark, tmp_path, spelling):
    (tmp_path / "a.html").write_text(html(GROUPS, lambda k: OPENINGS[(k + 3) % len(OPENINGS) if spelling == "all" else spelling]))
    got = scanned(spark, tmp_path)
    assert [r["author_key"] for r in got] == ["40", "41", "41", "41", "41", "43"]
    assert [r["message_id"] for r in got][:2] == [sent("2023-11-19T17:52:08"), "77"]
    assert got[0]["parts"] == ['nine & ten class="chatlog__message-group"'] and got[0]["author_username"] == "ida.x"
    assert (got[0]["ts"].hour, got[0]["ts"].second, got[1]["ts"].hour, got[1]["ts"].minute) == (17, 8, 18, 20)
    assert got[2]["parts"] == ["full", "[VID: clip 1.MP4]", "[IMG: pic.png]", "[EMBED: Weather]", "[YT: Video]"]
    assert got[2]["reactions"] == "^{⚓:1, 🛟:12}"
    assert got[3]["is_system"] and got[3]["parts"] == ["[left the call.]"]
    assert (got[4]["reply_to_name"], got[4]["reply_snippet"], got[4]["reply_to_message_id"]) == ("ida", "…", sent("2023-11-19T17:52:08"))
    assert got[5]["parts"] == ["[STICKER]"]
    assert len({r["msg_idx"] for r in got}) == len(got)


def test_html_files_with_and_without_messages(spark, tmp_path):
    (tmp_path / "a.html").write_text(html(GROUPS, lambda k: OPENINGS[k % 2 + 3]))
    (tmp_path / "b.html").write_text("<html><body><p class='chatlog__message-group-like'>chatlog__message-group</p></body></html>")
    (tmp_path / "c.htm").write_text("chatlog__message-group")
    files, raw = conversation.read_exports(spark, str(tmp_path), Options())
    assert {r["name"]: r["invalid"] for r in files.collect()} == {"a.html": False, "b.html": True, "c.htm": True}
    assert raw.count() == 6


@pytest.mark.parametrize("split", ["2500", "1000000"])
def test_html_groups_over_blocks(spark, tmp_path, split):
    """Groups larger and smaller than a block, in all spellings, with the class name in texts and attributes."""
    rng = random.Random(int(split))
    groups, n = [], 0
    for _ in range(50):
        rows = []
        for _ in range(rng.choice([0, 1, 1, 2, 5, 30])):
            false = rng.choice(["", "", "chatlog__message-group", '<i title="chatlog__message-group x">y</i>', "<!-- chatlog__message-group -->"])
            when = datetime(2023, 11, 19, tzinfo=UTC) + timedelta(seconds=n)
            rows.append((f'data-message-id="{(int(when.timestamp() * 1000) - EPOCH) << 22}"', body(f"text {n}") + false))
            n += 1
        groups.append((f"who{len(groups) % 7}", str(len(groups)), rows))
    (tmp_path / "a.html").write_text(html(groups, lambda k: OPENINGS[rng.randrange(len(OPENINGS))]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = scanned(spark, tmp_path, max_rows=7)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r["msg_idx"] for r in got}) == n
    assert [r["parts"][0] for r in got] == [f"text {k}" for k in range(n)]
    owner = [uid for _, uid, rows in groups for _ in rows]
    assert [r["author_key"] for r in got] == owner


def test_file_names(spark):
    names = ["G - c [123] (after 2025-01-02).html", "G - c [123].html", "custom.html"]
    got = catalog.html_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert [(r["channel_id"], r["base_name"], r["after_date"]) for r in got] == [
        ("123", "G - c [123]", "2025-01-02"), ("123", "G - c [123]", None), ("custom.html", "custom", None)]


def test_uploads_and_groups(spark):
    f = spark.createDataFrame(
        [("a", "x.json", 1, 10, "c1"), ("b", "x.json", 2, 11, "c1"), ("c", "y.json", 1, 5, "c2")],
        "file_id string, name string, sort_order long, size long, channel_id string").withColumn("base_name", F.col("channel_id"))
    assert sorted(r["file_id"] for r in catalog.latest_uploads(f).collect()) == ["b", "c"]
    n = {r["file_id"]: (r["file_idx"], r["grp_file_idx"]) for r in catalog.number_files(f).collect()}
    assert n == {"a": (0, 0), "c": (1, 0), "b": (2, 1)}
    assert {r["channel_id"] for r in catalog.merge_groups(f, ["c2", "c1"]).collect()} == {"c2"}


def test_whole_folder(spark, tmp_path):
    src = tmp_path / "in"
    (src / "more").mkdir(parents=True)
    (src / "a.json").write_text(json.dumps(doc(*MESSAGES), indent=2))
    (src / "more" / "one line.json").write_text(json.dumps(doc(msg("1", "other"), channel={"id": "6", "name": "six"})))
    (src / "b.txt").write_text(TXT)
    (src / "G - c [99].html").write_text(html(GROUPS))
    (src / "d.html").write_text(html(GROUPS, lambda k: OPENINGS[k + 2]))
    (src / "bad.json").write_text("{")
    files, raw = conversation.read_exports(spark, str(src), Options())
    f = {r["name"]: r for r in files.collect()}
    assert len(f) == 6 and [n for n, r in f.items() if r["invalid"]] == ["bad.json"]
    assert f["G - c [99].html"]["channel_id"] == "99" and f["one line.json"]["channel_id"] == "6"
    assert {r["format"]: r["count"] for r in raw.groupBy("format").count().collect()} == {"json": 9, "txt": 5, "html": 12}
    people, msgs = conversation.build_messages(raw, files)
    assert msgs.count() == 9 + 5 + 12
    assert msgs.where(millis(F.col("ts")).isNull()).count() == 0
    stats = conversation.analyze(msgs, people)
    assert stats["totals"].first()["messages"] == 26
