"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source is laid out as a stream of words, its documents in a seeded order, one after the other, and the stream is cut into
blocks of equally many words (the last one may be shorter). All blocks of the mix are apportioned to the sources by highest quotients
target / (2 k + 1); because the seats are awarded in one order, every prefix of it is apportioned too, and cutting the
order at equal counts gives integer quotas for every shard. Then blocks are selected: a keyed permutation of a source's blocks gives the
order in which its shards draw them, one after the other, as many as their quotas say; after the last block the order begins anew. So the
seed chooses which blocks are in, which are repeated and which shard has them, and reruns agree.

Scale. Only (row key, source, words) is shuffled to find the blocks of a document, never a text. Positions in a stream are sums over SLICES
slices of a source by hash, then within a slice, so a source with a third of all rows is dealt over all tasks. The table of sources, a few
numbers for each, is gathered on the driver: weights are given by source.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_value, fresh, held, kept_as, row_key, small
from .training_order import Feistel

WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and the most times that a source may be repeated.
SHARE = 1.5
MOST_TIMES = 2
SHARDS = 8
SLICES = 1024
#: Most words of a block; small sources make the blocks smaller, so that each target is BLOCKS_EACH blocks at least.
BLOCK_WORDS = 1024
BLOCKS_EACH = 1000
#: Copies of a repeated row that one row stands for while they are dealt out.
PORTION = 100
#: Blocks of documents that a task looks at together.
TOGETHER = 1 << 18


def word_count(text: str) -> Column:
    """Number of maximal runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST_TIMES) -> list[float]:
    """Words for each source: share of all words by weight, none above most times its size; the excess is reshared by weight."""
    left, out, active = share * sum(sizes), [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / total > most * sizes[i]]
        for i in over or active:
            out[i] = float(most * sizes[i]) if over else left * weights[i] / total
        left -= sum(out[i] for i in over)
        active = [i for i in active if i not in set(over)] if over else []
    return out


def apportion(wanted: list[float], seats: int) -> list[int]:
    """Sainte-Laguë: seats go one by one to the highest quotient wanted / (2 k + 1), ties to the earlier source.

    Seats that every highest-quotients order awards are given at once: with S sources, no quotient below
    sum / (seats - S / 2) is needed for them. The last S seats at most are awarded one by one.
    """
    total, n = sum(wanted), sum(1 for w in wanted if w > 0)
    if not total or seats <= 0:
        return [0] * len(wanted)
    sure = max(0.0, seats - n / 2 - 1)
    got = [int(w * sure / total + 0.5) if w > 0 else 0 for w in wanted]
    while sum(got) > seats:  # only by rounding of very large numbers
        got[max(range(len(got)), key=lambda i: got[i] / max(wanted[i], 1e-300))] -= 1
    heap = [(-w / (2 * got[i] + 1), i) for i, w in enumerate(wanted) if w > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-wanted[i] / (2 * got[i] + 1), i))
    return got


@dataclass
class Plan:
    """A mix: sources in code point order, null last, with their sizes, targets, numbers of blocks, and block quotas by shard."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    block: int
    blocks: list[int]
    quotas: list[list[int]]
    seed: int

    def order(self, source: int) -> Feistel:
        """The permutation in which a source's blocks are drawn."""
        return Feistel(max(1, self.blocks[source]), self.seed * 1_000_003 + source)


def plan(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_TIMES, shards: int = SHARDS, seed: int = 17) -> Plan:
    """The mix of sources of the given sizes; weights repeat over the sources in code point order, null last."""
    sources = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    n = [sizes[s] for s in sources]
    wanted = targets(n, [weights[i % len(weights)] for i in range(len(n))], share, most)
    least = min((w for w in wanted if w > 0), default=0.0)
    block = max(1, min(BLOCK_WORDS, int(least / BLOCKS_EACH)))
    blocks = [-(-x // block) for x in n]
    ends = [apportion(wanted, round(sum(wanted) / block) * (k + 1) // shards) for k in range(shards)]
    # A source never gives a block more than most times: what rounding puts above that is cut off its last shards.
    ends = [[min(q, int(most * blocks[i])) for i, q in enumerate(e)] for e in ends]
    quotas = [[q - (ends[k - 1][i] if k else 0) for i, q in enumerate(e)] for k, e in enumerate(ends)]
    return Plan(sources, n, wanted, block, blocks, quotas, seed)


def draws(p: Plan, source: int, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of a source that begin at the given words of its stream: words taken, whole copies, and the first shard (-1 for none).

    taken: the words of a document's blocks, each as often as the block is drawn. copies: how often the block with its middle word is drawn.
    """
    ends = np.cumsum([q[source] for q in p.quotas])
    rounds, rest = divmod(int(ends[-1]), max(1, p.blocks[source]))
    order, b = p.order(source), p.block
    taken, copies, first = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
    some = np.flatnonzero(size > 0)
    low, high = at[some] // b, (at[some] + size[some] - 1) // b
    each = high - low + 1
    middle = (at[some] + size[some] // 2) // b
    copies[some] = rounds + (order.slot(middle) < rest) if len(some) else 0
    begins = np.cumsum(each) - each
    stops = np.append(begins[1:], each.sum()) if len(some) else begins
    i = 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(stops, begins[i] + TOGETHER, side="right")))
        for piece in range(0, int(stops[j - 1] - begins[i]), TOGETHER):  # more than one for a very long document only
            number = np.arange(begins[i] + piece, min(stops[j - 1], begins[i] + piece + TOGETHER))
            doc = np.searchsorted(begins, number, side="right") - 1
            block = low[doc] + number - begins[doc]
            rank = order.slot(block)
            times = rounds + (rank < rest)
            words = np.minimum((block + 1) * b, at[some][doc] + size[some][doc]) - np.maximum(block * b, at[some][doc])
            np.add.at(taken, some[doc], words * times)
            shard = np.where(times > 0, np.searchsorted(ends, rank, side="right"), len(ends))
            best = np.full(len(at), len(ends), np.int64)
            np.minimum.at(best, some[doc], shard)
            found = best < len(ends)
            first[found] = np.where(first[found] < 0, best[found], np.minimum(first[found], best[found]))
        i = j
    return taken, copies, first


def mix(docs: DataFrame, scratch: Scratch, text: str = "text", source: str = "source", key: tuple[str, ...] = ("doc_id",), weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_TIMES, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """One row per row of docs: the key columns, `size`, `source_size`, `target`, `taken`, `copies`, `first_shard`, `_k1`, `_k2`.

    taken: how many of the row's words the mix takes, repeats counted. copies: whole copies for a consumer that can't
    cut documents; the block of the row's middle word decides, so copies follow taken. first_shard: the first shard that draws a block
    with words of the row; null if none does. Rows with null or blank texts have size 0 and are not taken; a null source is a source of its
    own. Repeated rows count as often as they occur. _k1, _k2: the row key of all columns. A key column with the name of one of these gets an
    underscore behind it. An empty table gives an empty table.
    """
    made = ["size", "source_size", "target", "taken", "copies", "first_shard", "_k1", "_k2"]
    own = kept_as(key, made)
    key = docs.select(*own).columns
    keyed = docs.select(*own, F.col(source).alias("__source"), word_count(text).alias("size"), *row_key(*docs.columns))
    rows = scratch.cut(keyed, "sizes")
    totals = rows.groupBy("__source").agg(F.sum("size").alias("n")).collect()  # a row a source
    p = plan({r[0]: int(r[1]) for r in totals}, weights, share, most, shards, seed)

    # Position of each row in its source's stream: words of the slices before its own, then of the rows before it in the slice.
    order = F.xxhash64(F.lit(seed), "_k1", "_k2")
    placed = rows.withColumn("__order", order).withColumn("__slice", F.shiftrightunsigned("__order", 64 - SLICES.bit_length() + 1).cast("int"))
    by_slice = placed.groupBy("__source", "__slice").agg(F.sum("size").alias("n"))
    before = by_slice.select("__source", "__slice", (F.sum("n").over(Window.partitionBy("__source").orderBy("__slice")) - F.col("n")).alias("__base"))
    inside = F.sum("size").over(Window.partitionBy("__source", "__slice").orderBy(F.shiftleft("__order", 10), "_k1", "_k2").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    ranked = placed.withColumn("__inside", inside)
    same = F.expr("a.__source <=> b.__source AND a.__slice = b.__slice")
    placed = ranked.alias("a").join(before.alias("b"), same).select("a.*", (F.col("__inside") + F.col("__base")).alias("__at"))

    each = [(s, i, p.sizes[i], p.targets[i]) for i, s in enumerate(p.sources)]
    table = docs.sparkSession.createDataFrame(each, "__s string, __number int, source_size long, target double")
    full = placed.join(small(table, len(each)), F.col("__source").cast("string").eqNullSafe(F.col("__s")))
    full = full.select(*key, "size", "source_size", "target", "_k1", "_k2", "__number", "__at")
    sent = docs.sparkSession.sparkContext.broadcast(by_value(p))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_ = held(sent)
        for b in batches:
            number, at, size = (b[c].to_numpy() for c in ("__number", "__at", "size"))
            out = np.zeros((3, len(at)), np.int64)
            for i in np.unique(number).tolist():
                own = number == i
                out[:, own] = draws(plan_, i, at[own], size[own])
            cells = [pa.array(out[0]), pa.array(out[1].astype(np.int32)), pa.array(out[2].astype(np.int32), mask=out[2] < 0)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cells], names=[*b.schema.names, "taken", "copies", "first_shard"])

    schema = full.withColumns({"taken": F.lit(0).cast("long"), "copies": F.lit(0), "first_shard": F.lit(None).cast("int")}).schema
    return full.mapInArrow(drawn, schema).select(*key, *made)


def apply(docs: DataFrame, text: str = "text", source: str = "source", key: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """The rows of docs as the mix has them: each as many times as its copies say. Columns, their names and values are unchanged.

    Rows that are equal in all columns are one row with the sum of their copies, which are dealt out again in portions of PORTION.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    mixed = mix(docs, scratch, text, source, key, **options)
    counts = scratch.cut(mixed.groupBy("_k1", "_k2").agg(F.sum("copies").alias("n"), F.count("*").alias("rows")).filter("n > 0"), "copies")
    scratch.drop("sizes")
    k1, k2, n, rows = fresh(docs, "_k1", "_k2", "_n", "_rows")
    keyed = docs.withColumns(dict(zip((k1, k2), row_key(*docs.columns, names=(k1, k2)), strict=True)))
    counts = counts.select(F.col("_k1").alias(k1), F.col("_k2").alias(k2), F.col("n").alias(n), F.col("rows").alias(rows))
    out = keyed.join(counts.filter(F.col(rows) == 1), [k1, k2]).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    several = counts.filter(F.col(rows) > 1)
    if several.count():
        # Equal rows become one where they are read; what goes out again is dealt over all tasks.
        one = keyed.join(several, [k1, k2]).dropDuplicates([k1, k2])
        portions = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / PORTION) - 1), lambda i: F.least(F.lit(PORTION).cast("long"), F.col(n) - i * PORTION))
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        one = one.withColumn(n, F.explode(portions)).repartition(parts).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
        out = out.unionByName(one)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
