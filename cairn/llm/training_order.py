"""Training-order materialisation of token ids in fixed-stride binary shards.

A sequence is a block of `sequence` token ids. The documents that a task reads are one stream, each ended by the end-of-text id, and the stream
is cut into sequences; its last one is filled up with end-of-text ids. A sequence's index is its place among those that one task could make, task
after task. A keyed Feistel permutation with cycle-walking maps all such indexes onto each other, which gives the training order; no table of random
numbers is sorted or kept. Equal ranges of the permuted indexes are the shards, and a sequence's global slot is its rank: the sequences of the shards
before its own, then its place in the shard. Slots are gapless, and every sequence takes `stride` bytes: slot s lies in the last shard whose base is at
most s, from byte (s - base) * stride on. A reader needs the bases, one number a shard, reads on sequentially, and resumes at any slot.

A shard file is:
- data records: `sequence` ids as little-endian uint16 or uint32, one record a slot;
- footer records of the same stride: for each piece of a document (record, place in the sequence, number of ids, doc_id, place in the document,
  CRC-32 of the ids' bytes), little-endian, filled up with zeros;
- a last record: MAGIC, shard, data records, pieces, filled up with zeros.
Each record is followed by one byte, a line feed, which belongs to the stride.

Scale. Every text is tokenised once, where it is read, and the compressed sequences are shuffled once, by shard: indexes need no count of sequences, so
no row has to be found again by its position. A lost executor's tasks are run again with the same outcome.
"""

from __future__ import annotations

import base64
import bisect
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, prepare, texts_of

SEQUENCE = 1024
#: Bytes of sequences in one shard, about.
SHARD_BYTES = 16 << 20
#: The permuted indexes are those of so many tasks with so many sequences each.
TASKS = 3_000_000
TASK_SEQUENCES = 50_000_000
#: Code points that are encoded together; a longer text is parted before a white space that no token spans.
PIECE = 1 << 20
MAGIC = b"CAIRNSH1"
_PIECE = np.dtype([("record", "<i8"), ("at", "<i4"), ("n", "<i4"), ("doc_id", "<i8"), ("first", "<i8"), ("null", "<i4"), ("crc", "<u4")])
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which the public byte-level vocabulary splits text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of 0 to n - 1: a balanced Feistel network on the next even number of bits, with cycle-walking."""

    n: int
    key: int
    rounds: int = 6

    @property
    def half(self) -> int:
        return max(1, ((max(2, self.n) - 1).bit_length() + 1) // 2)

    def _round_key(self, r: int) -> np.uint64:
        return np.uint64((self.key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % (1 << 64))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for r in reversed(range(self.rounds)) if back else range(self.rounds):
            if back:
                left, right = right, left
            f = right + self._round_key(r)
            f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left = left ^ ((f ^ (f >> np.uint64(31))) & mask)
            if not back:
                left, right = right, left
        return (left << half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, dtype=np.uint64), back)
        while (outside := out >= self.n).any():
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def parted(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in pieces of `most` code points or a few more, cut where white space follows something else: there every token ends."""
    at = 0
    while at < len(text):
        stop = at + most
        while stop < len(text) and not (text[stop].isspace() and not text[stop - 1].isspace()):
            stop += 1
        yield text[at:stop]
        at = stop


def encoder(content: bytes) -> tuple[Callable[[str], np.ndarray], int]:
    """The encoding function and end-of-text id of a byte-level vocabulary in the ranks format."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
    encoding, end = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1
    kind = np.dtype("<u2" if end < 1 << 16 else "<u4")
    return lambda text: np.concatenate([np.zeros(0, kind), *(np.array(encoding.encode_ordinary(t), kind) for t in parted(text))]), end


@dataclass(frozen=True)
class Layout:
    """What a reader has to know of a set of shards: `bases` is the first slot of each shard."""

    path: str
    sequences: int
    bases: tuple[int, ...]
    sequence: int
    width: int

    @property
    def stride(self) -> int:
        return self.sequence * self.width + 1

    @property
    def shards(self) -> int:
        return len(self.bases)

    def place(self, slot: int) -> tuple[int, int]:
        """The shard that has a slot, and the byte where its sequence begins."""
        shard = bisect.bisect_right(self.bases, slot) - 1
        return shard, (slot - self.bases[shard]) * self.stride


def sequences(docs: DataFrame, content: bytes, width: int, shards: int, key: int, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """(shard, place, ids, pieces): the token sequences of docs, their permuted indexes and the shards of those; ids are compressed.

    pieces: which documents' ids a sequence holds, as footer entries without a record.
    """
    sent, order = docs.sparkSession.sparkContext.broadcast(content), Feistel(TASKS * TASK_SEQUENCES, key)  # a vocabulary file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(sent.value)
        kind, part, seq, squeeze = np.dtype(f"<u{width}"), TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
        held, room, pieces = [], sequence, []  # of the sequence that is being filled

        def full(ready: list) -> pa.RecordBatch:
            if part >= TASKS or seq > TASK_SEQUENCES:
                raise ValueError("more tasks or sequences of a task than the permutation has indexes for")
            place = order.slot(np.arange(seq - len(ready), seq) + part * TASK_SEQUENCES)
            shard = (place.astype(np.float64) * shards / order.n).astype(np.int32).clip(0, shards - 1)
            return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(place), *[pa.array(c, pa.binary()) for c in zip(*ready, strict=True)]], names=["shard", "place", "ids", "pieces"])

        for b in bounded(batches, "text"):
            ready = []
            for i, t in zip(b["doc_id"].to_pylist(), texts_of(b["text"]), strict=True):
                ids = np.append(encode(t), kind.type(end))
                first = 0
                while first < len(ids):
                    some = ids[first : first + room]
                    pieces.append((0, sequence - room, len(some), i or 0, first, i is None, zlib.crc32(some.tobytes())))
                    held.append(some)
                    room, first = room - len(some), first + len(some)
                    if not room:
                        ready.append((squeeze.compress(np.concatenate(held).tobytes()), np.array(pieces, _PIECE).tobytes()))
                        held, room, pieces, seq = [], sequence, [], seq + 1
                        if len(ready) >= 1000:
                            yield full(ready)
                            ready = []
            if ready:
                yield full(ready)
        if held:
            seq += 1
            yield full([(squeeze.compress(np.concatenate([*held, np.full(room, end, kind)]).tobytes()), np.array(pieces, _PIECE).tobytes())])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "shard int, place long, ids binary, pieces binary")


def write(docs: DataFrame, path: str, key: int = 20240229, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, sequence: int = SEQUENCE, shard_bytes: int = SHARD_BYTES) -> Layout:
    """Writes the shards to path, one file a shard; how many there are follows from the bytes of the texts.

    Null and empty texts are the end-of-text id alone; repeated rows are documents of their own; a doc_id that is no integer is an error. The
    vocabulary, a file of fixed size that the driver reads, is broadcast. An empty table writes no shard.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(vocabulary, "rb") as f:
        content = f.read()
    width = 2 if encoder(content)[1] < 1 << 16 else 4
    text_bytes = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 1)).first()[0] or 0
    if not text_bytes:
        return Layout(path, 0, (), sequence, width)
    shards = max(1, int(text_bytes * width / 3) // shard_bytes)  # some three bytes a token

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, footer, written, shard, expand = sequence * width, [], 0, -1, zstandard.ZstdDecompressor()
        records = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["record"])
        for b in batches:
            if not b.num_rows:
                continue
            shard = b["shard"][0].as_py()
            for record, raw in enumerate(b["pieces"].to_pylist(), written):
                own = np.frombuffer(raw, _PIECE).copy()
                own["record"] = record
                footer.append(own.tobytes())
            written += b.num_rows
            yield records([expand.decompress(x) for x in b["ids"].to_pylist()])
        if written:
            whole = b"".join(footer)
            last = MAGIC + struct.pack("<qqq", shard, written, len(whole) // _PIECE.itemsize)
            yield records([whole[i : i + size].ljust(size, b"\0") for i in range(0, len(whole), size)])
            yield records([last.ljust(size, b"\0")])

    made = sequences(docs, content, width, shards, key, doc_id, text, sequence).repartitionById(shards, F.col("shard")).sortWithinPartitions("place")
    made.mapInArrow(pack, "record binary").select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option("compression", "none").text(path)
    return layout_of(spark, path, sequence, width)


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def layout_of(spark, path: str, sequence: int = SEQUENCE, width: int = 2) -> Layout:
    """The layout of the shards under path, from their last records."""
    stride = sequence * width + 1

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [struct.unpack_from("<qq", x, len(MAGIC)) for x in b["last"].to_pylist() if x[: len(MAGIC)] == MAGIC]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], pa.int64()) for i in (0, 1)], names=["shard", "n"])

    ends = _files(spark, path).filter("length > 0").select(F.expr(f"substring(content, -{stride}, {stride})").alias("last"))
    counts = {r.shard: r.n for r in ends.mapInArrow(last, "shard long, n long").collect()}  # two numbers a shard
    bases, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        bases.append(total)
        total += counts.get(k, 0)
    return Layout(path, total, tuple(bases), sequence, width)


def read_index(spark, layout: Layout) -> DataFrame:
    """(doc_id, slot, shard, at, n_tokens, first_token, crc32, crc_ok) for every piece of a document in a sequence, read back from the shard files.

    at: the piece's place in the sequence; first_token: its place in the document. crc_ok: whether the ids that lie there have the CRC-32 that the
    footer says.
    """
    schema = "doc_id long, slot long, shard int, at int, n_tokens int, first_token long, crc32 long, crc_ok boolean"
    if not layout.shards:
        return spark.createDataFrame([], schema)
    stride, width, bases = layout.stride, layout.width, spark.sparkContext.broadcast(layout.bases)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for buffer in b.column(0):
                raw = memoryview(buffer.as_buffer())
                if bytes(raw[len(raw) - stride :][: len(MAGIC)]) != MAGIC:
                    raise ValueError("not a shard file")
                shard, written, n = struct.unpack_from("<qqq", raw, len(raw) - stride + len(MAGIC))
                cells = np.frombuffer(raw, np.uint8).reshape(-1, stride)[written:-1, :-1]
                index = np.frombuffer(cells.tobytes()[: n * _PIECE.itemsize], _PIECE)
                for i in range(0, n, 20_000):
                    some = index[i : i + 20_000]
                    starts = some["record"] * stride + some["at"].astype(np.int64) * width
                    ok = [zlib.crc32(raw[a : a + k]) == c for a, k, c in zip(starts.tolist(), (some["n"] * width).tolist(), some["crc"].tolist(), strict=True)]
                    columns = [pa.array(some["doc_id"].copy(), mask=some["null"].astype(bool)), pa.array(some["record"] + bases.value[shard]), pa.array(np.full(len(some), shard, np.int32)), *[pa.array(some[c].copy()) for c in ("at", "n", "first")], pa.array(some["crc"].astype(np.int64)), pa.array(ok)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "slot", "shard", "at", "n_tokens", "first_token", "crc32", "crc_ok"])

    return _files(spark, layout.path).filter("length > 0").select("content").mapInArrow(parse, schema)


def read_records(content: bytes, layout: Layout, first: int = 0) -> Iterator[np.ndarray]:
    """The sequences of one shard file in training order, from record `first` on."""
    _, written, _ = struct.unpack_from("<qqq", content, len(content) - layout.stride + len(MAGIC))
    for r in range(first, written):
        yield np.frombuffer(content, np.dtype(f"<u{layout.width}"), layout.sequence, r * layout.stride)


def materialise(docs: DataFrame, **options) -> DataFrame:
    """Writes the shards of docs to the shared folder, where they stay, and returns their index, one row a piece of a document, with `path`."""
    layout = write(docs, Scratch(docs.sparkSession, "training-order", keep=True).path("shards"), **options)
    return read_index(docs.sparkSession, layout).withColumn("path", F.lit(layout.path))
