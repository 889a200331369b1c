"""Chat formatting with typed content parts.

A turn holds a list of parts: text, image, audio or document.  A visitor walks
over them in order and writes text as it is and every other part as a placeholder
token, with a record of what it refers to, where it stands and how many tokens it
will be expanded to.

Template: ``<|turn|>`` role, line end, content, ``<|end|>``, line end.  Control
strings inside a text (those of this template, placeholders, and the usual ones of
others) get a backslash after their first character, one more if there are some
already, so the text can be read back exactly.  The loss mask marks the content
of the assistant's turns.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

TURN, END = "<|turn|>", "<|end|>"
CONTROL = re.compile(r"([<\[])(\\*)((?:/?s>)|(?:/?INST\])|(?:<SYS>>)|(?:</SYS>>)|(?:\|\w+\|>))")
ESCAPED = re.compile(r"([<\[])\\(\\*)((?:/?s>)|(?:/?INST\])|(?:<SYS>>)|(?:</SYS>>)|(?:\|\w+\|>))")
PIECE = re.compile(r"<\|turn\|>([^\n]*)\n(.*)<\|end\|>\n\Z", re.S)
PATCH = 28
AUDIO_TOKENS_PER_SECOND = 12.5
TOKENS_PER_PAGE = 576

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PARTS = f"array<{PART}>"
ATTACHMENT = "struct<part:int,kind:string,ref:string,position:int,tokens:int>"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


class PartVisitor:
    """Flattens the parts of a turn; ``content()`` and ``attachments`` are the result.

    A run of text parts is escaped whole, so that a control string made of two
    parts is caught too.
    """

    def __init__(self):
        self.run: list[str] = []
        self.done: list[str] = []
        self.size = 0
        self.attachments: list[dict] = []

    def visit(self, number: int, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(number, part)

    def add(self, piece: str) -> None:
        self.done.append(piece)
        self.size += len(piece)

    def end_run(self) -> None:
        self.add(escape("".join(self.run)))
        self.run = []

    def attach(self, number: int, kind: str, part: dict, tokens: int) -> None:
        self.end_run()
        self.attachments.append({"part": number, "kind": kind, "ref": part.get("ref"), "position": self.size, "tokens": tokens})
        self.add(f"<|{kind}|>")

    def visit_text(self, number: int, part: dict) -> None:
        self.run.append(part.get("text") or "")

    def visit_image(self, number: int, part: dict) -> None:
        self.attach(number, "image", part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, number: int, part: dict) -> None:
        self.attach(number, "audio", part, math.ceil((part.get("seconds") or 0) * AUDIO_TOKENS_PER_SECOND))

    def visit_document(self, number: int, part: dict) -> None:
        self.attach(number, "document", part, (part.get("pages") or 0) * TOKENS_PER_PAGE)

    def visit_other(self, number: int, part: dict) -> None:
        self.attach(number, "other", part, 0)

    def content(self) -> str:
        self.end_run()
        return "".join(self.done)


def format_turn(role: str, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """(formatted, loss start, loss end, attachments); offsets are code points in ``formatted``, 0 and 0 without loss."""
    visitor = PartVisitor()
    for number, part in enumerate(parts):
        visitor.visit(number, part or {})
    head = f"{TURN}{escape_role(role)}\n"
    content = visitor.content()
    for a in visitor.attachments:
        a["position"] += len(head)
    start, end = (len(head), len(head) + len(content)) if role == "assistant" else (0, 0)
    return f"{head}{content}{END}\n", start, end, visitor.attachments


def read_turn(piece: str) -> tuple[str, str]:
    """(role, text) of a formatted turn without attachments."""
    found = PIECE.match(piece)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape_role(found[1]), unescape(found[2])


def format_turns(turns: DataFrame, id: str = "conv_id", order: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per turn: (id, order, role, formatted, loss_start, loss_end, attachments, n_tokens_extra).

    A conversation is the ``formatted`` pieces of its turns in order.  A null
    role is empty, null parts are no parts, and a part without type is text.
    """
    source = turns.select(F.col(id), F.col(order), F.col(role).alias("role"), F.col(parts).cast(PARTS).alias("parts"))
    schema = T.StructType([
        source.schema[id], source.schema[order], T.StructField("role", T.StringType()), T.StructField("formatted", T.StringType()),
        T.StructField("loss_start", T.IntegerType()), T.StructField("loss_end", T.IntegerType()),
        T.StructField("attachments", T.ArrayType(T.StructType([
            T.StructField("part", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()),
            T.StructField("position", T.IntegerType()), T.StructField("tokens", T.IntegerType()),
        ]))),
        T.StructField("n_tokens_extra", T.LongType()),
    ])
    attached = pa.list_(pa.struct([("part", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("position", pa.int32()), ("tokens", pa.int32())]))

    def made(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            roles = [r or "" for r in batch.column("role").to_pylist()]
            out = [format_turn(r, p or []) for r, p in zip(roles, batch.column("parts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id), batch.column(order), pa.array(roles, pa.string()), pa.array([o[0] for o in out], pa.string()),
                 pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()),
                 pa.array([o[3] for o in out], attached), pa.array([sum(a["tokens"] for a in o[3]) for o in out], pa.int64())],
                names=schema.names,
            )

    return small_batches(source).mapInArrow(made, schema)


def text_parts(text: F.Column) -> F.Column:
    """A plain text as the only part of a turn."""
    null = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in null.items())
    ))


class Digest:
    """Running digests of one conversation; holds no text."""

    def __init__(self, id):
        self.id, self.n, self.chars, self.loss = id, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int, end: int) -> None:
        role, text = read_turn(piece)
        self.n += 1
        self.chars += len(piece)
        self.turns.update(f"{role}\n{text}\n".encode())
        if end > start:
            under = unescape(piece[start:end])
            self.loss += len(under)
            self.masked.update(under.encode())

    def row(self) -> tuple:
        return self.id, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def digests(formatted: DataFrame, id: str = "conv_id", order: str = "turn") -> DataFrame:
    """Per conversation what its formatted turns hold.

    The turns of a conversation stream through one task in order, as a digest
    must; the task holds its state and one batch, whatever the length.  Turns
    with the same number follow in the order of role and text.
    """
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        formatted.select(id, order, "formatted", "loss_start", "loss_end")
        .repartition(n, id).sortWithinPartitions(id, order, "formatted")
    )
    schema = T.StructType([
        ordered.schema[id], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ])

    def rows(done: list[Digest], kind: pa.DataType) -> pa.RecordBatch:
        columns = zip(*(d.row() for d in done), strict=True)
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

    def streamed(batches: Iterator[pa.RecordBatch]):
        now = kind = None
        for batch in batches:
            done, kind = [], batch.schema.field(id).type
            columns = (batch.column(c).to_pylist() for c in (id, "formatted", "loss_start", "loss_end"))
            for key, piece, start, end in zip(*columns, strict=True):
                if now is None or now.id != key:
                    if now is not None:
                        done.append(now)
                    now = Digest(key)
                now.add(piece, start, end)
            if done:
                yield rows(done, kind)
        if now is not None:
            yield rows([now], kind)

    return small_batches(ordered).mapInArrow(streamed, schema)
