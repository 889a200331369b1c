import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_render import as_msgs, expected_txt, people
from datetime import datetime, timedelta, timezone

from threadlens.functions.tokens import chars_for_tokens, effective_budget, estimate_tokens
from threadlens.operators import budget as B
from threadlens.sinks import export
from threadlens.streaming import ingest


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    t = datetime(2025, 3, 1, tzinfo=timezone.utc)
    out = []
    for i in range(60):
        t += timedelta(seconds=rnd.choice([30, 400, 5000, 20000]))
        words = " ".join(rnd.choice(["alpha", "be", "gamma-ray", "12345", "délta"]) for _ in range(rnd.randrange(1, 20)))
        out.append((t, f"U{rnd.randrange(1, 6)}", [words] + (["^{👍:1}"] if rnd.random() < 0.2 else []) + (["KEEP me"] if i % 17 == 0 else [])))
    return out


@pytest.mark.parametrize("keywords", [(), ("keep",)])
def test_trim_keeps_the_most_that_fits(make_msgs, rows, keywords):
    """Character budget: every possible cut is rendered by the plain loop."""
    m = as_msgs(make_msgs, rows)
    limit = 2500
    prio = [bool(keywords) and any("KEEP" in p for p in r[2]) for r in rows]
    normal = [i for i, p in enumerate(prio) if not p]

    def size(k):
        keep = set(normal[len(normal) - k:])
        kept = [r for i, r in enumerate(rows) if prio[i] or i in keep]
        text = expected_txt(kept, int(limit / 4 + 0.5)) if kept else B.txt.EMPTY_TEXT
        return len(text.encode("utf-16-le")) // 2

    best = max(k for k in range(len(normal) + 1) if size(k) <= limit)
    out = B.trim(m, people(m), max_chars=limit, keywords=keywords)
    r = out.report.first()
    assert (r["kept"], r["size"], r["budget_exceeded"]) == (best + sum(prio), size(best), False)
    got = {x["msg_idx"] for x in out.messages.collect()}
    assert got == set(normal[len(normal) - best:]) | {i for i, p in enumerate(prio) if p}


def test_token_size_is_that_of_the_rendered_text(make_msgs, rows, spark):
    m = as_msgs(make_msgs, rows)
    out = B.trim(m, people(m), max_tokens=900)
    kept = sorted(x["msg_idx"] for x in out.messages.collect())
    text = expected_txt([rows[i] for i in kept], 900)
    real = spark.range(1).select(estimate_tokens(F.lit(text))).first()[0]
    r = out.report.first()
    assert r["size"] == real <= 900 and real > 720


def test_priority_alone_over_the_limit(make_msgs, rows):
    m = as_msgs(make_msgs, rows)
    r = B.trim(m, people(m), max_chars=100, keywords=("keep",)).report.first()
    assert r["budget_exceeded"] and r["kept"] == sum(any("KEEP" in p for p in x[2]) for x in rows)


def test_chunks(make_msgs, rows):
    m = as_msgs(make_msgs, rows)
    cost = [14 + sum(len(p.encode("utf-16-le")) // 2 + 3 for p in r[2]) for r in rows]
    room = chars_for_tokens(effective_budget(450)) - 200
    want, start = [], 0
    while start < len(rows):
        end, used = start, 0
        while end < len(rows) and (end == start or used + cost[end] <= room):
            used += cost[end]
            end += 1
        want.append((start, end))
        if end >= len(rows):
            break
        start = max(start + 1, end - 3)
    assert len(want) > 5
    for limit, slice_rows in ((1000, 1 << 20), (7, 8), (1000, 3), (1000, 1)):
        costs = B.materialize(B.index_costs(m, limit), "t")
        got = B.chunk_bounds(costs, 450, 3, limit, slice_rows).orderBy("chunk").collect()
        assert [(r["start"], r["end"]) for r in got] == want
        assert [r["chunk"] for r in got] == list(range(1, len(want) + 1))
    members = B.chunk_messages(m, 450, 3).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in members] == [e - s for s, e in want]


def test_exits_against_single_steps():
    rnd = random.Random(8)
    for n in (1, 2, 50):
        to = np.array([i + rnd.choice([1, 1, 2, 7, B.BEYOND]) for i in range(n)])
        want = []
        for i in range(n):
            while i < n:
                i = to[i]
            want.append(i)
        assert B._exits(to).tolist() == want


def test_written_chunks_are_the_members(make_msgs, rows, spark, tmp_path):
    """Every chunk is a document of its own under a safe name, the overlap in both."""
    m = as_msgs(make_msgs, rows)
    files = spark.createDataFrame([("c", 'bad/na:me?. ', 0), ("c", "later", 1)], "channel_id string, base_name string, file_idx int")
    export.write_chunks(m, people(m), files, "txt", str(tmp_path / "out"), 450, 3)
    want = {f"bad_na_me_._part{r['chunk']}": r["n"] for r in B.chunk_messages(m, 450, 3).groupBy("chunk").agg(F.count("*").alias("n")).collect()}
    got = {}
    for folder in (tmp_path / "out").glob("channel_id=*"):
        text = "".join(p.read_text() for p in sorted(folder.glob("part-*.txt")))
        head = text.split("\n\n", 1)[0]
        got[folder.name.split("=", 1)[1]] = sum(int(n) for n in re.findall(r"\((\d+) msgs", head))
    assert sorted(got.values()) == sorted(want.values()) and len(got) > 5
    assert all(name.startswith("bad_na_me_") for name in got)


def test_ingest_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def put(name, ids):
        msgs = [{"id": i, "type": "Default", "timestamp": "2025-01-01T00:00:00Z", "content": i, "author": {"id": "1", "name": "a"}} for i in ids]
        (src / name).write_text(json.dumps({"channel": {"id": "7", "name": "c"}, "messages": msgs}, indent=2))

    def run():
        ingest.ingest_json(spark, str(src), str(tmp_path / "raw"), str(tmp_path / "state")).awaitTermination()
        return sorted(r["message_id"] for r in ingest.read_ingested(spark, str(tmp_path / "raw")).collect())

    put("a.json", ["1", "2"])
    (src / "bad.json").write_text("{")
    assert run() == ["1", "2"]
    put("b.json", ["3"])
    assert run() == ["1", "2", "3"]
