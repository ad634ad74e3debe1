"""SimHash near-duplicates, searched with pigeonring filtering.

A text's fingerprint has 64 bits: bit b is 1 if it is set in over half of the XXH64 hashes of the text's word
shingles. Two fingerprints link at a Hamming distance of at most `distance`; classes are the connected components.

Search. The 64 bits are cut into a ring of distance + 1 segments. If two fingerprints differ in at most `distance` bits, then by
the strong pigeonring principle some start exists from which every chain of l consecutive segments differs in at most
floor(distance * l / (distance + 1)) bits: 0 in the first segment, at most 1 in the first two, and so on. A difference of at most 1
leaves one half of the second segment untouched, so equal (segment, half of the next segment) pairs are an index key
that loses no link; the whole chain is tested next, and only what passes gets the full Hamming check.

Scale. Equal fingerprints collapse to one node first. Within a key, nodes already known to be connected are not compared
again and only links that join two parts are emitted, so a dense group of n nodes yields at most n - 1 rows. A key with
more than BLOCK nodes is dealt out in pairs of blocks over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, texts_of
from .components import components

DISTANCE = 4
#: Most nodes of one key that a single task compares.
BLOCK = 20_000


def hashes(text: str | None, width: int = 4, seed: int = 42) -> np.ndarray:
    """The hash of each word shingle of one text; one of all words if they are fewer than width, none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], seed) for a, b in zip(starts[:k].tolist(), last.tolist(), strict=True)], dtype="<u8")


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of one text; 0 for a text without words."""
    h = hashes(text, width, seed)
    k = len(h)
    if not k:
        return 0
    cells = h.view(np.uint8).reshape(k, 8) + np.arange(0, 2048, 256, dtype=np.int64)
    byte_counts = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256)
    set_bits = byte_counts @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    return int.from_bytes(np.packbits(set_bits.ravel() * 2 > k, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """The columns of docs but the text, and `fp`, the fingerprint as a signed long. Null texts count as empty."""
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "__text"):
            fp = np.array([fingerprint(t, width, seed) for t in texts_of(b.column("__text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    got = docs.select(*keep, F.col(text).alias("__text"))
    return got.mapInArrow(run, got.select(*keep).withColumn("fp", F.lit(0).cast("long")).schema)


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the ring's segments, as equally wide as can be."""
    m = distance + 1
    ends = [-(-64 * k // m) for k in range(m + 1)]
    return [(ends[k], ends[k + 1] - ends[k]) for k in range(m)]


def _index(nodes: DataFrame, distance: int) -> DataFrame:
    """Rows (key, start, fp) of a node: every start segment with either half of the segment after it."""
    keys, ring = [], segments(distance)
    for i, (at, bits) in enumerate(ring):
        after, wide = ring[(i + 1) % len(ring)]
        low = wide // 2
        first = F.shiftrightunsigned("fp", at).bitwiseAND((1 << bits) - 1)
        for half, (shift, width) in enumerate(((0, low), (low, wide - low))):
            part = F.shiftrightunsigned("fp", after + shift).bitwiseAND((1 << width) - 1)
            key = F.shiftleft(F.lit(2 * i + half).cast("long"), 48) + F.shiftleft(first, 16) + part
            keys.append(F.struct(key.alias("key"), F.lit(i).alias("start")))
    return nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.key", "k.start", "fp")


def _chain(x: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Which differences x (by index) keep within the proportional budgets of all chains that begin at their start segment."""
    ring = np.array(segments(distance), dtype=np.uint64)
    at, total, m = np.arange(len(x)), np.zeros(len(x), np.int64), len(ring)
    for length in range(m):
        seg = ring[(start[at] + length) % m]
        total = total + np.bitwise_count((x[at] >> seg[:, 0]) & ((np.uint64(1) << seg[:, 1]) - np.uint64(1)))
        ok = total <= distance * (length + 1) // m
        at, total = at[ok], total[ok]
    return at


def _links(group: np.ndarray, fp: np.ndarray, start: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links that join parts of each group; rows are sorted by group. All pairs are covered, connected ones skipped."""
    root = np.arange(len(fp))
    one, two = [], []
    i, d = np.flatnonzero(group[:-1] == group[1:]), 1
    while i.size:
        a = i[root[i] != root[i + d]]
        if a.size:
            x = fp[a] ^ fp[a + d]
            a = a[_chain(x, start[a], distance)]
            a = a[np.bitwise_count(fp[a] ^ fp[a + d]) <= distance]
        joined = False
        for p in a.tolist():
            ra, rb = p, p + d
            while root[ra] != ra:
                ra = root[ra]
            while root[rb] != rb:
                rb = root[rb]
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                one.append(p)
                two.append(p + d)
                joined = True
        while joined and not np.array_equal(root, nxt := root[root]):
            root = nxt
        d += 1
        i = i[i + d < len(fp)]
        i = i[group[i] == group[i + d]]
    return one, two


def _edges(distance: int):
    """Over a partition sorted by (key, pair): the joining links of every group as (u, v)."""

    def of_groups(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        k, p = rows["key"].to_numpy(), rows["pair"].to_numpy()
        fp = rows["fp"].to_numpy().view(np.uint64)
        group = np.concatenate(([0], np.cumsum((k[1:] != k[:-1]) | (p[1:] != p[:-1]))))
        one, two = _links(group, fp, rows["start"].to_numpy().astype(np.int64), distance)
        if one:
            signed = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[one]), pa.array(signed[two])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            now = pa.Table.from_batches([b])
            now = pa.concat_tables([rest, now]) if rest is not None else now
            k, p = now["key"].to_numpy(), now["pair"].to_numpy()
            same = np.flatnonzero((k != k[-1]) | (p != p[-1])) if len(k) else np.array([], int)
            cut = int(same[-1]) + 1 if same.size else 0
            rest = now.slice(cut)
            if cut:
                yield from of_groups(now.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from of_groups(rest)

    return run


def links(nodes: DataFrame, scratch: Scratch, block: int = BLOCK, distance: int = DISTANCE) -> DataFrame:
    """Edges (u, v) between distinct fingerprints, with the same components as all pairs within the distance."""
    index = _index(nodes, distance)
    hot = index.groupBy("key").count().filter(F.col("count") > block)
    blocks = F.ceil(F.col("count") / block).cast("int")
    own = F.pmod(F.hash("fp"), blocks)
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.least(own, o) * F.lit(1_000_000) + F.greatest(own, o))
    dealt = index.join(hot, "key", "left").select("key", "start", "fp", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("pair"))
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.select(F.col("key"), F.col("pair").cast("long"), "start", "fp").repartition(n, "key", "pair").sortWithinPartitions("key", "pair", "fp")
    return sorted_.mapInArrow(_edges(distance), "u long, v long")


def classes(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", width: int = 4, distance: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """One row per row of docs, and one per fingerprint.

    The first table has the columns of docs but the text, `fp` and `component_id`: the smallest doc_id of the rows reachable
    over links, the row's own included (null ids are passed over; null if the component has no other). Repeated rows
    stay repeated. Null and blank texts have fingerprint 0 and link like any other. An empty table gives empty tables.
    The second table is (fp, component_id, component), the latter a fingerprint that names the component.
    """
    marks = scratch.cut(fingerprints(docs, text, width), "fingerprints")
    nodes = scratch.cut(marks.groupBy("fp").agg(F.min(doc_id).alias("least")), "nodes")
    stars = components(links(nodes.select("fp"), scratch, distance=distance), scratch)
    named = nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = scratch.cut(named.join(least, "component").select("fp", "component_id", "component"), "classes")
    return marks.join(by_fp.select("fp", "component_id"), "fp"), by_fp
