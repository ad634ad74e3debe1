"""Chat formatting with a grammar round trip: conversations as marked text with a loss mask, from which every turn can be read back.

Grammar. A text is a row of turns, each `<|im_start|>role`, a line feed, the text, `<|im_end|>` and a line feed; inside a role or a text no
mark may stand. parse() is a deterministic parser of it: after an opening mark the role ends at the first line feed, the text at the next
mark, which must close it; anything else is no text of the grammar.

Method. Every turn is rendered as it is, parsed, and compared with its source. If it differs, its conflicting content is escaped and the
turn rendered and parsed again, until it is identical: a backslash goes into everything that is a mark or a mark with backslashes, and the
parser takes one out, so that escaping is reversible, also of texts that look escaped. As the parser is back in its first state after a
turn, turns that come back alone come back in a row; every part is parsed once more as a whole before it goes out.

Scale. Turns are dealt by ranges of (conversation, turn), so that a conversation with a third of all rows is spread over tasks by its turns.
A task streams its rows and emits parts of at most PART_BYTES (or one longer turn); nearly all conversations are one part. What is read back
is parsed part by part where it lies. Only the digest of a conversation in several parts is sequential by its definition: its parts pass
through one task as a stream that holds one part and the state of the hashes.

Odd rows. A null text or role is an empty one. Turns come in the order of turn, nulls first; equal ones by the first characters of role and
text and then by hash, so reruns agree. A null conv_id is a conversation of its own. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, prepare

START, END = b"<|im_start|>", b"<|im_end|>"
_MARK = re.compile(rb"<\|im_(?:start|end)\|>")
_LIKE = re.compile(rb"<\|(\\*im_(?:start|end)\|>)")
_ESCAPED = re.compile(rb"<\|\\(\\*im_(?:start|end)\|>)")
_PAIR = re.compile(rb"\\(.)", re.S)

#: Turns of this role are under the loss mask.
LEARNED = b"assistant"

#: Bytes of a part of a conversation at most, but for a single longer turn.
PART_BYTES = 1 << 20

#: Characters of role and text that order turns of equal number, so that bounds of ranges stay short.
ORDER_CHARS = 64


def escape(text: bytes) -> bytes:
    """text without marks; unescape() gives it back."""
    return _LIKE.sub(rb"<|\\\1", text)


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"<|\1", text)


def _escape_role(role: bytes) -> bytes:
    return escape(role.replace(b"\\", b"\\\\").replace(b"\n", b"\\n"))


def _unescape_role(role: bytes) -> bytes:
    return _PAIR.sub(lambda m: b"\n" if m[1] == b"n" else m[1], unescape(role))


def _turn(role: bytes, text: bytes) -> bytes:
    return START + role + b"\n" + text + END + b"\n"


def parse(formatted: bytes) -> list[tuple[bytes, bytes, int, int]] | None:
    """The turns of a text of the grammar: role, text, and where the escaped text begins and ends; None if it is none."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            return None
        head = at + len(START)
        line, mark = formatted.find(b"\n", head), _MARK.search(formatted, head)
        if line < 0 or mark is None or mark[0] != END or mark.start() <= line or not formatted.startswith(b"\n", mark.end()):
            return None
        turns.append((_unescape_role(formatted[head:line]), unescape(formatted[line + 1 : mark.start()]), line + 1, mark.start()))
        at = mark.end() + 1
    return turns


def render(role: bytes, text: bytes) -> bytes:
    """A turn of the grammar that parses to role and text; what conflicts is escaped, the rest stays as it is."""
    for r, t in ((role, text), (role, escape(text)), (_escape_role(role), text), (_escape_role(role), escape(text))):
        made = _turn(r, t)
        if (back := parse(made)) is not None and [x[:2] for x in back] == [(role, text)]:
            return made
    raise ValueError("a turn doesn't come back")


def _chars(text: bytes) -> int:
    return len(text.decode("utf-8", "replace"))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, task, part, whole, formatted, loss) of turns (conv_id, turn, role, text): a conversation is its parts in a row, by task and part.

    loss has the ranges of code points (from, end exclusive) of formatted that are learned from; whole says that a part is a whole conversation.
    """
    prepare(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "turn", "role", "text"]
    rows = turns.select(*names[:2], *[F.coalesce(c, F.lit("")).alias(c) for c in names[2:]])
    order: list[str | Column] = ["conv_id", "turn", F.left("role", F.lit(ORDER_CHARS)), F.left("text", F.lit(ORDER_CHARS)), F.xxhash64("role", "text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.col("role").cast("binary"), F.col("text").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, ids = TaskContext.get().partitionId(), None

        def part(conv, k: int, whole: bool, sources: list[tuple[bytes, bytes]], texts: list[bytes]) -> pa.RecordBatch:
            body = b"".join(texts)
            back = parse(body)
            if back is None or [x[:2] for x in back] != sources:
                raise ValueError("a part doesn't come back")
            loss, seen, chars = [], 0, 0
            for role, _, first, last in back:
                if role == LEARNED:
                    chars += _chars(body[seen:first])
                    begun, chars = chars, chars + _chars(body[first:last])
                    seen = last
                    loss.append({"from": begun, "to": chars})
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], ids), pa.array([task], pa.int32()), pa.array([k], pa.int32()), pa.array([whole]), pa.array([body], pa.binary()).cast(pa.string()), pa.array([loss], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))],
                names=["conv_id", "task", "part", "whole", "formatted", "loss"],
            )

        # The first and the last conversation of a task may go on in others.
        now, k, first, sources, texts, size = None, 0, True, [], [], 0
        for b in bounded(batches, "text"):
            ids = b.schema.field("conv_id").type
            for conv, role, text in zip(*(b[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                made = render(role, text)
                if texts and (conv != now or size + len(made) > PART_BYTES):
                    yield part(now, k, not first and k == 0 and conv != now, sources, texts)
                    k, first, sources, texts, size = (k + 1, first, [], [], 0) if conv == now else (0, False, [], [], 0)
                now = conv
                sources.append((role, text))
                texts.append(made)
                size += len(made)
        if texts:
            yield part(now, k, False, sources, texts)

    return rows.mapInArrow(run, f"conv_id {kind}, task int, part int, whole boolean, formatted string, loss array<struct<from: int, to: int>>")


def write(parts: DataFrame, path: str) -> None:
    """Writes formatted() as Parquet files of the given folder."""
    parts.write.mode("overwrite").option("compression", "zstd").parquet(path)


def recovered(parts: DataFrame) -> DataFrame:
    """(conv_id, task, part, position, role, text, learned): the turns that the parts hold, each with its place in its part."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "formatted"):
            keep, place, roles, texts = [], [], [], []
            for i, body in enumerate(b["formatted"].to_pylist()):
                for j, (role, text, _, _) in enumerate(parse(body)):
                    keep.append(i)
                    place.append(j)
                    roles.append(role)
                    texts.append(text)
            at = b.select(["conv_id", "task", "part"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*at.columns, pa.array(place, pa.int32()), pa.array(roles, pa.binary()).cast(pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array([r == LEARNED for r in roles], pa.bool_())], names=["conv_id", "task", "part", "position", "role", "text", "learned"])

    return parts.select("conv_id", "task", "part", F.col("formatted").cast("binary")).mapInArrow(run, f"conv_id {kind}, task int, part int, position int, role string, text string, learned boolean")


def digests(parts: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, escaped) of every conversation, read from its parts alone.

    Turns come from the parser, learned text from the loss ranges; escaped counts the turns that needed it.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "escaped"]

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=names)
            out.clear()
            return made

        now, state, begun = None, None, False
        for b in bounded(batches, "formatted"):
            kinds[0] = b.schema.field("conv_id").type
            for conv, whole, body, loss in zip(*(b[c].to_pylist() for c in ("conv_id", "whole", "formatted", "loss")), strict=True):
                if begun and (whole or conv != now):
                    out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))
                    begun = False
                if not begun:
                    now, begun, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text, first, last in parse(body):
                    state[0] += 1
                    state[1].update(role + b"\n" + text + b"\n")
                    state[5] += last - first != len(text)
                text = body.decode("utf-8", "replace")
                state[4] += len(text)
                for x in loss:
                    learned = unescape(text[x["from"] : x["to"]].encode())
                    state[2] += _chars(learned)
                    state[3].update(learned)
            yield batch()
        if begun:
            out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))
            yield batch()

    rows = parts.withColumn("formatted", F.col("formatted").cast("binary"))
    split = rows.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "task", "part")
    columns, schema = ["conv_id", "whole", "formatted", "loss"], f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, escaped long"
    return rows.filter("whole").select(columns).mapInArrow(run, schema).union(split.select(columns).mapInArrow(run, schema))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The parts that write() left in a folder."""
    return spark.read.parquet(path)
