"""Contiguous balanced shards by global byte-size prefix sums.

Rows are laid out in one global order; the prefix sum of their sizes is the total of the partitions before a row's own plus
the sizes before it in its partition. Cutting the sums at equal targets gives contiguous shards of near equal bytes.

The order is by hash of the text, then by row key, so that rows with equal texts lie together. A group of equal texts
that a cut would part goes whole to the shard that holds its middle if it is small beside a shard (WHOLE) and has no more than GROUP_ROWS
rows; a larger one is parted at the cut, since only that keeps the bytes equal.

Scale. Texts stay where they are read: only sizes and hashes are range-partitioned, by (hash, row key), so that one text
that makes up a third of all rows is dealt over many partitions, as many as the rows ask for. Tasks go through a partition in order and hold
one group at most. The driver sees a few numbers of each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, kept_as, row_key

SHARDS = 8
#: A group of equal texts is kept whole if its bytes are at most this share of a shard.
WHOLE = 0.01
#: Rows of a group that is kept whole, at most, and rows of a range partition.
GROUP_ROWS = 500_000
PARTITION_ROWS = 2_000_000


def byte_size(text: str) -> Column:
    """Bytes of the text in UTF-8 (0 for null) and one for the end of the record."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition sorted by h: its rows and bytes, and the hash, rows and bytes of its first and last group."""
    rows = total = 0
    part, ends = None, [[None, 0, 0], [None, 0, 0]]
    for b in batches:
        if not b.num_rows:
            continue
        h, size = b["h"].to_numpy(), b["size"].to_numpy()
        if part is None:
            part = b["part"][0].as_py()
            ends[0][0] = ends[1][0] = int(h[0])
        if h[-1] != ends[1][0]:
            ends[1] = [int(h[-1]), 0, 0]
        for e in ends:
            own = h == e[0]
            e[1], e[2] = e[1] + int(own.sum()), e[2] + int(size[own].sum())
        rows, total = rows + len(h), total + int(size.sum())
    if rows:
        values = (part, rows, total, *ends[0], *ends[1])
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["part", "n", "bytes", "first", "first_rows", "first_bytes", "last", "last_rows", "last_bytes"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool, bool]]:
    """A partition sorted by h as tables, each with whether its first group began before and its last group may go on.

    Groups come whole in a table but for those of more than GROUP_ROWS rows.
    """
    held: list[pa.RecordBatch] = []
    rows, begun, last = 0, False, None
    for b in batches:
        if not b.num_rows:
            continue
        h = b["h"].to_numpy()
        if last != h[0]:
            if held:
                yield pa.Table.from_batches(held), begun, False
            held, rows, begun = [], 0, False
        last = int(h[-1])
        other = np.flatnonzero(h != h[-1])
        cut = int(other[-1]) + 1 if other.size else 0
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]), begun, False
            held, rows, begun = [], 0, False
        held.append(b.slice(cut))
        rows += b.num_rows - cut
        if rows > GROUP_ROWS:
            yield pa.Table.from_batches(held), begun, True
            held, rows, begun = [], 0, True
    if held:
        yield pa.Table.from_batches(held), begun, False


def assign(docs: DataFrame, scratch: Scratch, keep: tuple[str, ...] = ("doc_id",), text: str = "text", shards: int = SHARDS, whole: float = WHOLE) -> DataFrame:
    """One row per row of docs: the columns keep, `size`, `text_crc32`, `shard`, `slot`, `global_slot`, `byte_offset`.

    slot counts the rows of a shard, global_slot all rows, both gapless from 0 in the global order; byte_offset is
    the prefix sum. Null texts have size 1 and the CRC of the empty text. Repeated rows each have a slot of their
    own. With fewer rows than shards some shards stay empty; an empty table gives an empty table. A column of keep with the name
    of a made one gets an underscore behind it.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    made = ["size", "text_crc32", "h", "_k1", "_k2", "part", "shard", "global_slot", "byte_offset", "slot"]
    own = kept_as(keep, made)
    rows = docs.select(*own, byte_size(text).alias("size"), crc.alias("text_crc32"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), *row_key(*keep, text))
    keep = docs.select(*own).columns
    rows = scratch.cut(rows, "sizes")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PARTITION_ROWS))
    ordered = rows.repartitionByRange(n, "h", "_k1", "_k2").withColumn("part", F.spark_partition_id()).sortWithinPartitions("h", "_k1", "_k2", *keep)
    ordered = scratch.cut(ordered, "ordered")
    scratch.drop("sizes")
    order = ["h", "_k1", "_k2", *keep]

    def by_part(df: DataFrame) -> DataFrame:
        # One task reads one part whole and in order, however the files of the written table were split.
        return df.repartitionById(n, F.col("part")).sortWithinPartitions(*order)

    table = "part long, n long, bytes long, first long, first_rows long, first_bytes long, last long, last_rows long, last_bytes long"
    ends = sorted(by_part(ordered).select("h", "_k1", "_k2", "size", "part").mapInArrow(_ends, table).collect(), key=lambda r: r.part)
    total = sum(r.bytes for r in ends)

    # Where the group at either end of a partition begins, and its rows and bytes over all partitions; and each partition's base.
    base, row_base, head, at, at_row = {}, {}, {}, 0, 0
    begin, group, whole_group = 0, None, {}
    for r in ends:
        base[r.part], row_base[r.part] = at, at_row
        if r.first != group:
            group, begin = r.first, at
        head[r.part] = begin
        for h, k, b in ((r.first, r.first_rows, r.first_bytes), (r.last, r.last_rows, r.last_bytes))[: 1 + (r.last != r.first)]:
            old = whole_group.get(h, (0, 0))
            whole_group[h] = (old[0] + k, old[1] + b)
        if r.last != r.first:
            group, begin = r.last, at + r.bytes - r.last_bytes
        at, at_row = at + r.bytes, at_row + r.n
    columns = [c for c in ordered.columns if c not in ("h", "_k1", "_k2", "part")]
    sent = spark.sparkContext.broadcast((base, row_base, head, whole_group))  # numbers of each partition, not of each row
    limit = whole * total / shards

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, rows_before, heads, whole_groups = sent.value
        at = at_row = start = None
        for t, begun, goes_on in _groups(batches):
            h, size = t["h"].to_numpy(), t["size"].to_numpy()
            if at is None:
                part = t["part"][0].as_py()
                at, at_row, start = bases[part], rows_before[part], heads[part]
            offset = np.cumsum(size) - size + at
            new = np.concatenate(([True], h[1:] != h[:-1]))
            of, at_first = np.cumsum(new) - 1, np.flatnonzero(new)
            starts, bytes_, rows = offset[at_first].copy(), np.add.reduceat(size, at_first), np.diff([*at_first.tolist(), len(h)])
            starts[0] = start if begun or at == bases[part] else starts[0]
            for k in (0, -1):
                rows[k], bytes_[k] = max(rows[k], (known := whole_groups.get(int(h[at_first[k]]), (0, 0)))[0]), max(bytes_[k], known[1])
            if begun or goes_on:
                rows[0 if begun else -1] = max(rows[0 if begun else -1], GROUP_ROWS + 1)
            together = (bytes_ <= limit) & (rows <= GROUP_ROWS)
            middle = np.where(together[of], starts[of] + bytes_[of] / 2, offset + size / 2)
            shard = np.minimum(shards - 1, np.floor(middle * shards / total)).astype(np.int32)
            out = t.select(columns).append_column("shard", pa.array(shard)).append_column("global_slot", pa.array(np.arange(len(h)) + at_row)).append_column("byte_offset", pa.array(offset))
            yield from out.to_batches()
            at, at_row, start = at + int(size.sum()), at_row + len(h), int(starts[-1])

    placed = by_part(ordered).mapInArrow(place, ordered.select(*columns).withColumns({"shard": F.lit(0), "global_slot": F.lit(0).cast("long"), "byte_offset": F.lit(0).cast("long")}).schema)
    placed = scratch.cut(placed, "placed")
    scratch.drop("ordered")
    first = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("global_slot")).collect()}  # a number for each shard
    begins = F.coalesce(*[F.when(F.col("shard") == k, F.lit(v)) for k, v in sorted(first.items())], F.lit(0))
    return placed.withColumn("slot", (F.col("global_slot") - begins).cast("long"))
