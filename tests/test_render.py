import csv
import io
import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from threadlens.sinks import document as D, export, markdown, page, tables, txt


def people(msgs):
    return msgs.select(F.col("author_id").alias("uid"), F.concat(F.lit("name "), "author_id").alias("label")).distinct()


def clock(t):
    return t.strftime("%-I:%M %p")


def expected_txt(rows, limit):
    """The text layout written as a plain loop."""
    counts = {}
    for _, a, _ in rows:
        counts[a] = counts.get(a, 0) + 1
    out = [f"# LLM-Optimized Chat Log (Limit: ~{limit:,} tokens)", "# Start: " + rows[0][0].strftime("%a, %d %b %Y %H:%M:%S GMT"), "# Participants:"]
    for uid in sorted(counts, key=lambda u: int(u[1:])):
        tenths = (counts[uid] * 2000 + len(rows)) // (len(rows) * 2)
        out.append(f"# {uid}: name {uid} ({counts[uid]} msgs, {tenths // 10}.{tenths % 10}%)")
    out.append("")
    author = prev = None
    for t, a, parts in rows:
        gap = (t - prev).total_seconds() if prev and prev.date() == t.date() else None
        if gap is None or gap > 14400:
            h, m = int((gap or 0) // 3600), int((gap or 0) % 3600 // 60)
            out.append(f"\n=== {t.strftime('%A, %b %d, %Y')} ===" if gap is None else f"\n=== SESSION BREAK ({h}h {m}m) ===")
            author = None
        if gap is None or gap > 3600:
            label = f"[{clock(t)}]"
        else:
            label = f"[+{int(gap)}s]" if gap < 60 else f"[+{int(gap // 60)}m]" if gap < 3600 else "[+1h]"
        parts = list(parts)
        if parts and parts[0].startswith("^") and not out[-1].endswith(":"):
            out[-1] += " " + parts.pop(0)
        prev = t
        if not parts:
            continue
        if a != author:
            out.append(f"\n{label} {a}:")
            author = a
        out += ["  " + p for p in parts]
    return "\n".join(out)


@pytest.fixture(scope="module")
def random_rows():
    rnd = random.Random(11)
    t = datetime(2025, 1, 1, 20, tzinfo=timezone.utc)
    rows = []
    for _ in range(70):
        t += timedelta(seconds=rnd.choice([5, 70, 600, 3600, 4000, 15000, 40000]))
        parts = rnd.choice([["hi"], ["^this"], ["^{👍:1}"], ["colon:"], ["a", "[IMG: x]"], ["^{a:1}", "more"], ["> U1: q", "yes ^{🔥:2}"]])
        rows.append((t, f"U{rnd.randrange(1, 12)}", parts))
    return rows


def as_msgs(make_msgs, rows):
    return make_msgs(*[dict(author_id=a, ts=t.isoformat(), parts=p) for t, a, p in rows])


def test_txt_equals_a_plain_loop(make_msgs, random_rows):
    m = as_msgs(make_msgs, random_rows)
    want = expected_txt(random_rows, 5000)
    for limit in (10_000, 6):
        rows = txt.render(m, people(m), D.RenderOptions(max_tokens=5000), limit)
        assert D.document_text(rows).first()["text"] == want


def test_written_document_keeps_its_order(make_msgs, random_rows, tmp_path):
    m = as_msgs(make_msgs, random_rows)
    rows = txt.render(m, people(m), D.RenderOptions(max_tokens=5000))
    D.write_document(rows, str(tmp_path / "out"), partitions=4)
    files = sorted((tmp_path / "out" / "channel_id=c").glob("part-*"))
    assert len(files) > 1
    assert "".join(f.read_text() for f in files).rstrip("\n") == expected_txt(random_rows, 5000)


SECRETS = dict(author_id="U1", author_name="ann", ts="2025-01-01T00:00:00Z", parts=["at https://a.b/c me@x.org 555-123-4567", "> body quote"])


@pytest.mark.parametrize("fmt", ["txt", "md", "html"])
def test_redaction_in_documents(make_msgs, fmt):
    m = make_msgs(SECRETS)
    o = D.RenderOptions(redact_names=True, redact_urls=True, redact_emails=True, preamble="  Intro  ")
    text = D.document_text(export.render_document(m, people(m), fmt, o)).first()["text"]
    for hidden in ("a.b/c", "me@x", "555-123", "name U1"):
        assert hidden not in text
    assert "[URL] [EMAIL] [PHONE]" in text and "Intro" in text


def test_markdown(make_msgs, random_rows):
    m = as_msgs(make_msgs, random_rows)
    text = D.document_text(markdown.render(m, people(m))).first()["text"]
    assert text.startswith("# Chat Log (~1,375,000 token limit)\n**Start:** ")
    assert text.count("\n## ") == 1 + len({t.date() for t, _, _ in random_rows})
    assert text.count("**[") == len(random_rows)


def test_csv(make_msgs, tmp_path):
    m = make_msgs(
        dict(author_id="U1", author_name="=ann", ts="2025-01-01T00:00:00.5Z", parts=['+say "x"', "b ^{a:1}"]),
        dict(author_id="U2", author_name="bea", ts="2025-01-01T00:00:01Z", parts=["[IMG: x]", "^{a:1}"]),
    )
    tables.write_csv(m, str(tmp_path / "csv"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "csv" / "channel_id=c").glob("part-*")))
    rows = [r for r in csv.reader(io.StringIO(text)) if r and r[0] != "timestamp"]
    assert rows == [
        ["2025-01-01T00:00:00.500Z", "U1", "'=ann", "'+say \"x\" | b ^{a:1}", ""],
        ["2025-01-01T00:00:01.000Z", "U2", "bea", "[IMG: x]", "^{a:1}"],
    ]


def test_json_document(make_msgs, random_rows):
    m = as_msgs(make_msgs, random_rows).withColumn("has_reply", F.col("parts")[0].startswith("> U1"))
    text = D.document_text(tables.json_document(m, people(m), channel="c")).first()["text"]
    got = json.loads(text)
    assert json.dumps(got, indent=2, ensure_ascii=False) == text
    assert list(got["participants"]) == sorted(got["participants"], key=lambda u: int(u[1:]))
    assert len(got["messages"]) == len(random_rows)
    quoted = [x for x in got["messages"] if x["replyTo"]]
    assert quoted and all(x["replyTo"] == "U1: q" and x["content"] == "yes ^{🔥:2}" for x in quoted)


def test_html(make_msgs):
    m = make_msgs(
        dict(author_id="U1", ts="2025-01-01T00:00:00Z", parts=["a <b> https://x.y/z?q=1 [IMG: p.png]"]),
        dict(author_id="U1", ts="2025-01-01T00:01:00Z", parts=["again ^{👍:2, x}"]),
        dict(author_id="U1", ts="2025-01-01T00:02:00Z", parts=["> U1: said", "ok"], has_reply=True),
        dict(author_id="U1", ts="2025-01-01T09:00:00Z", parts=["late"]),
    )
    text = D.document_text(page.render(m, people(m))).first()["text"]
    assert 'a &lt;b&gt; <a href="https://x.y/z?q=1" rel="noreferrer">https://x.y/z?q=1</a> <kbd>[IMG: p.png]</kbd>' in text
    assert text.count('<article class="same">') == 1 and text.count("<article>") == 3
    assert "<small>👍 × 2</small> <small>x</small>" in text
    assert "<cite>name U1</cite>" in text and "Session break · 8h 58m" in text
    assert "4 messages · from Wed, 01 Jan 2025 00:00:00 GMT" in text and text.endswith("</main>")


def test_html_spreads_messages_that_name_nobody(spark, make_msgs, no_broadcast):
    """Most messages are no reply, and most replies name one person; neither falls to one task."""
    t = datetime(2025, 1, 1, tzinfo=timezone.utc)
    m = make_msgs(*(
        dict(author_id=f"U{i % 9}", ts=(t + timedelta(minutes=i)).isoformat(), has_reply=i % 3 == 0,
             parts=[f"> U1: said {i}", "ok"] if i % 3 == 0 else ["> ok"])
        for i in range(400)
    ))
    spread, plain = (page.body_rows(m, people(m), hot_rows=n) for n in (50, 1000))
    largest = [x.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] for x in (spread, plain)]
    assert largest[0] < 130 and largest[1] > 260
    assert sorted(map(repr, spread.collect())) == sorted(map(repr, plain.collect()))
    assert spread.where("text LIKE '%<cite>name U1</cite> said%'").count() == 134


def test_html_names_of_replies(spark, make_msgs):
    said = ["> U2: a", "> U9: b", "> c d", ">", "> : e"]
    m = make_msgs(*(dict(author_id="U2", ts=f"2025-01-01T00:0{i}:00Z", parts=[x, "ok"], has_reply=True) for i, x in enumerate(said)))
    who = people(m).unionByName(spark.createDataFrame([("", "nobody")], "uid string, label string"))
    for hot_rows in (1, 1000):
        rows = page.body_rows(m, who, hot_rows=hot_rows).orderBy("k3").collect()
        quotes = [r["text"].partition("<blockquote>")[2].partition("</blockquote>")[0] for r in rows]
        assert quotes == ["<cite>name U2</cite> a", "<cite>U9</cite> b", "<cite>nobody</cite> c d", "", "<cite>nobody</cite> : e"]


def test_export_folders(make_msgs, tmp_path):
    m = make_msgs(SECRETS)
    for fmt in export.FORMATS:
        export.write_export(m, people(m), fmt, str(tmp_path / fmt))
        assert list((tmp_path / fmt).iterdir())
    s = export.export_summary(3, 5, False)
    assert (s["complete"], s["excluded"]) == (False, 2)
