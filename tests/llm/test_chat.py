from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadlens.llm import chat

TRICKY = st.lists(st.sampled_from(["<|", "|>", "end", "turn", "\\", "<s>", "</s>", "[INST]", "[/INST]", "\n", "é", "<", "[", "<</SYS>>", "x"])).map("".join)


@settings(max_examples=300, deadline=None)
@given(TRICKY, TRICKY)
def test_escape_is_reversible_and_complete(text, role):
    assert chat.unescape(chat.escape(text)) == text
    piece, start, end, _ = chat.format_turn("assistant", [{"type": "text", "text": text}])
    assert chat.unescape(piece[start:end]) == text
    assert piece.count("<|turn|>") == 1 and piece.count("<|end|>") == 1
    assert chat.read_turn(chat.format_turn(role, [{"text": text}])[0]) == (role, text)


def test_parts_become_placeholders():
    parts = [
        {"type": "text", "text": "see <|im"}, {"type": "text", "text": "age|> "}, {"type": "image", "ref": "a.png", "width": 57, "height": 28},
        {"type": "audio", "ref": "b.wav", "seconds": 2.0}, None, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "odd", "ref": "d"},
    ]
    piece, start, end, attached = chat.format_turn("user", parts)
    assert (start, end) == (0, 0)
    assert piece == "<|turn|>user\nsee <\\|image|> <|image|><|audio|><|document|><|other|><|end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"], a["part"]) for a in attached] == [
        ("image", "a.png", 3, 2), ("audio", "b.wav", 25, 3), ("document", "c.pdf", 3 * 576, 5), ("other", "d", 0, 6)
    ]
    assert all(piece[a["position"] :].startswith(f"<|{a['kind']}|>") for a in attached)


def test_digests_against_plain_loops(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (1, 2, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", ""),
            (None, 3, "system", "s\\<s>"), (None, None, "assistant", "first")]
    rows += [(3, k, "assistant" if k % 2 else "user", f"turn {k} [INST]") for k in range(400)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.digests(chat.format_turns(frame)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        size = sum(len(chat.format_turn(r, [{"text": t}])[0]) for r, t in turns)
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                hashlib.sha256(loss.encode()).hexdigest(), size)
        assert got[conv] == want
    assert chat.digests(chat.format_turns(frame.limit(0))).count() == 0
