"""Near copies by Jaccard similarity: a wide SimHash fingerprint, pigeonring filtering, exact verification.

Sixty-four bits within a few of each other bound no Jaccard similarity, so for a similarity this module takes as many bits as it needs. A bit of
two fingerprints differs with probability arccos(c) / pi, c being the cosine of the texts' sets of word shingles, at least 2 t / (1 + t) for a
Jaccard similarity t. The bits form a ring of segments; `distance` is the most bits in which two linked fingerprints differ, three standard
deviations more than two texts at the threshold are expected to.

Search. Fingerprints that agree in a whole segment meet. From there, by the pigeonring principle, the chain of consecutive segments is followed:
after each of them the cumulative differences must be within the chain's share of `distance`. What stays within all budgets that the index row
carries gets the full Hamming check; what passes that is compared by the exact Jaccard similarity of the sets, and only pairs at the threshold
link. So there are no false links; RECALL is the probability with which two texts exactly at the threshold meet, and the more similar ones meet
more surely. Classes are connected components, which finds many of the rest through third texts.

Scale. Equal sets are one node. The segments are as wide as the number of rows asks, so that as few strangers meet in a large table as in a small
one, and their number follows from RECALL. Only nodes with a possible partner go on from a step to the next, sets are made for those alone, and
tasks emit links that join two parts. Each node first meets others at its most common key, and then one node of each part meets those of other
parts at the keys of large parts; after that only keys where parts meet, and nodes with a possible partner in another part, are left. A key with more than BLOCK nodes is dealt out in pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, fresh, give_back, row_key, small, texts_of
from .components import components
from .simhash import hashes

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.95
#: A key with more nodes is dealt out in blocks of so many; a task compares two blocks.
BLOCK = 500
#: One node in so many tells which keys are common; a common key that the sample misses costs time and nothing else.
SAMPLED = 64
#: Bits of a set's parity map, whose differences are never more than those of the sets.
PARITY = 4096
#: Groups of up to so many nodes are compared together, larger ones node by node.
TOGETHER = 256

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


@dataclass(frozen=True)
class Ring:
    """`segments` segments of `width` bits, and the most bits in which two linked fingerprints differ."""

    width: int
    segments: int
    distance: int

    @property
    def bits(self) -> int:
        return self.width * self.segments

    @property
    def words(self) -> int:
        return -(-self.bits // 64)

    @property
    def chain(self) -> int:
        """Segments behind the first one that an index row carries."""
        return min(64 // self.width, self.segments - 1)

    def budget(self, length: int) -> int:
        """Most differences of a chain of so many segments."""
        return self.distance * length // self.segments


def ring_for(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Ring:
    """The ring for a table of so many rows: some 64 strangers at most share a segment, and texts at the threshold meet with the given probability."""
    differ = math.acos(min(1.0, 2 * threshold / (1 + threshold))) / math.pi
    width = min(32, max(16, math.ceil(math.log2(max(2, rows))) - 6))
    segments = max(2, math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** width)))
    bits = width * segments
    return Ring(width, segments, math.ceil(differ * bits + 3 * math.sqrt(differ * (1 - differ) * bits)))


def shingle_set(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """A text's ascending shingle hashes, each once, and the set's id."""
    own = np.unique(hashes(text, width))
    return own, int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).astype(np.int64))


def fingerprint(own: np.ndarray, ring: Ring) -> bytes:
    """The ring's bits, little-endian: a bit is 1 if it is set in over half of the set's hashes, which are mixed anew for every 64 bits; 0 for the empty set."""
    counts = np.zeros(ring.words * 2048)
    step = (np.arange(1, ring.words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    place = (np.arange(ring.words * 8, dtype=np.int64) * 256).reshape(ring.words, 1, 8)
    for i in range(0, len(own), 4096):
        z = own[None, i : i + 4096] + step
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        counts += np.bincount((z.view(np.uint8).reshape(ring.words, -1, 8) + place).ravel(), minlength=len(counts))
    on = (counts.reshape(-1, 256) @ _BITS).ravel() * 2 > len(own)
    on[ring.bits :] = False
    return np.packbits(on, bitorder="little").tobytes()


def marked(docs: DataFrame, ring: Ring, text: str = "text", width: int = WIDTH) -> DataFrame:
    """The columns of docs but the text; `text_id`, `set_id` and `fp` of its shingle set. Null and blank texts have the empty set."""
    keep = [c for c in docs.columns if c != text]
    names = [*keep, "text_id", "set_id", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "__text"):
            got = [shingle_set(t, width) for t in texts_of(b.column("__text"))]
            cells = [pa.array([i for _, i in got], pa.int64()), pa.array([fingerprint(s, ring) for s, _ in got], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), b.column("text_id"), *cells], names=names)

    sent = docs.select(*keep, F.xxhash64(text).alias("text_id"), F.col(text).alias("__text"))
    return sent.mapInArrow(run, sent.drop("__text").withColumns({"set_id": F.lit(0).cast("long"), "fp": F.lit(b"")}).schema)


def _fps(column: pa.Array) -> np.ndarray:
    """(rows, bytes) of equally long fingerprints."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _index(nodes: DataFrame, ring: Ring) -> DataFrame:
    """(key, chain, set_id): a row for each segment of each node; the key is the segment's place and bits, the chain the segments behind it."""
    weights = 1 << np.arange(ring.width, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                b = whole.slice(i, 2000)
                bits = np.unpackbits(_fps(b["fp"]), axis=1, bitorder="little")[:, : ring.bits].reshape(b.num_rows, ring.segments, ring.width)
                own = bits @ weights
                chain = np.zeros(own.shape, np.uint64)
                for k in range(ring.chain):
                    chain |= np.roll(own, -(k + 1), axis=1).astype(np.uint64) << np.uint64(ring.width * k)
                key = own + (np.arange(ring.segments, dtype=np.int64) << 32)
                ids = np.repeat(b["set_id"].to_numpy(), ring.segments)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(chain.ravel().view(np.int64)), pa.array(ids)], names=["key", "chain", "set_id"])

    return nodes.select("set_id", "fp").mapInArrow(run, "key long, chain long, set_id long")


def chains_hold(x: np.ndarray, ring: Ring) -> np.ndarray:
    """Whether differences x of chains, whose first segments agree, stay within the budgets of all lengths."""
    ok, total = np.ones(x.shape, bool), np.zeros(x.shape, np.int64)
    for k in range(ring.chain):
        total = total + np.bitwise_count((x >> np.uint64(ring.width * k)) & np.uint64((1 << ring.width) - 1))
        ok &= total <= ring.budget(k + 2)
    return ok


def _partnered(sizes: np.ndarray, alike) -> np.ndarray:
    """Which rows of sorted groups have a partner: alike(a, b) says for index arrays which pairs are. All pairs are covered until both rows have one."""
    starts, total = np.cumsum(sizes) - sizes, int(sizes.sum())
    out = np.zeros(total, bool)
    end = np.repeat(starts + sizes, sizes)
    i, d = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= TOGETHER), sizes)), 1
    while i.size:
        i = i[i + d < end[i]]
        a = i[~(out[i] & out[i + d])]
        a = a[alike(a, a + d)]
        out[a] = out[a + d] = True
        d += 1
    for s, n in zip(starts[sizes > TOGETHER].tolist(), sizes[sizes > TOGETHER].tolist(), strict=True):
        rows = np.arange(s, s + n)
        for r in range(s, s + n):
            if not out[r]:
                near = rows[alike(np.full(n, r), rows)]
                near = near[near != r]
                out[near] = True
                out[r] = bool(len(near))
    return out


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal rows."""
    n = len(columns[0])
    new = np.zeros(max(0, n - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.diff([0, *(np.flatnonzero(new) + 1).tolist(), n])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a partition sorted by (key, pair) as tables that end between groups."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k, p = b["key"].to_numpy(), b["pair"].to_numpy()
        other = np.flatnonzero((k != k[-1]) | (p != p[-1]))
        cut = int(other[-1]) + 1 if other.size else 0
        if not cut and rest and (rest[-1]["key"][-1].as_py(), rest[-1]["pair"][-1].as_py()) != (int(k[0]), int(p[0])):
            yield pa.Table.from_batches(rest)
            rest = []
        if cut:
            yield pa.Table.from_batches([*rest, b.slice(0, cut)])
            rest = []
        rest.append(b.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def _filtered(of_rows, schema: str):
    """Over sorted groups: the columns of schema of the rows that of_rows(table, sizes) marks."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            on = of_rows(t, _runs(t["key"].to_numpy(), t["pair"].to_numpy()))
            yield from t.select(names).filter(pa.array(on)).to_batches()
        give_back()

    return lambda df: df.mapInArrow(run, schema)


def _dealt(met: DataFrame, hot: DataFrame | None, block: int, order: tuple[str, ...] = ()) -> DataFrame:
    """met (key, set_id, ...) in partitions sorted by (key, pair); the nodes of the hot keys (key, n) in all pairs of their blocks."""
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if hot is None:
        return met.repartition(parts, "key").sortWithinPartitions("key", *order).withColumn("pair", F.lit(0).cast("long"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.hash("set_id"), blocks)
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.least(own, o).cast("long") * (1 << 31) + F.greatest(own, o))
    pair = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("pair")
    return met.join(hot, "key", "left").select(*met.columns, pair).repartition(parts, "key", "pair").sortWithinPartitions("key", "pair", *order)


def _hot(met: DataFrame, scratch: Scratch, name: str, block: int, sampled: int = 1) -> DataFrame | None:
    """(key, n): keys with more than block rows, as counted, or as one row in `sampled` tells; None if there are none."""
    few = met.filter(F.pmod(F.xxhash64("set_id"), F.lit(sampled)) == 0) if sampled > 1 else met
    counted = few.groupBy("key").agg((F.count("*") * sampled).alias("n")).filter((F.col("n") > block) & (F.col("n") > sampled))
    hot = scratch.cut(counted, name)
    n = hot.count()
    return small(hot, n) if n else None


def _keys_between(met: DataFrame, also: Column | None = None) -> DataFrame:
    """The keys of met (key, set_id, root) with nodes of several parts, for which the aggregate `also` holds; one of those with the same nodes."""
    same = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.sum(F.xxhash64(F.lit(9), "set_id").cast("decimal(20,0)")).alias("s"))
    keys = met.groupBy("key").agg(*same, F.min("root").alias("a"), F.max("root").alias("b"), (F.lit(True) if also is None else also).alias("also")).filter("a < b AND also")
    return keys.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key")


def _sets(docs: DataFrame, text: str, live: DataFrame, width: int) -> DataFrame:
    """(set_id, size, parity, shingles) of the live (text_id): the sets' ascending hashes as bytes, made from the texts once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "t"):
            got = [shingle_set(t, width) for t in texts_of(b["t"])]
            cells = ([i for _, i in got], [len(s) for s, _ in got], [parity(s) for s, _ in got], [s.tobytes() for s, _ in got])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["set_id", "size", "parity", "shingles"])

    found = docs.select(F.xxhash64(text).alias("text_id"), F.col(text).alias("t")).join(small(live, live.count()), "text_id", "left_semi")
    return found.select("t").mapInArrow(run, "set_id long, size long, parity binary, shingles binary").dropDuplicates(["set_id"])


def parity(own: np.ndarray) -> bytes:
    return np.packbits((np.bincount((own % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(bool)).tobytes()


def _may_reach(n: np.ndarray, maps: np.ndarray, a, b, threshold: float) -> np.ndarray:
    """Whether sizes and parity maps allow sets a and b the threshold."""
    ok = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-6
    at = np.flatnonzero(ok)
    for part in np.array_split(at, len(at) // 20_000 + 1):
        apart = np.bitwise_count(maps[a[part]] ^ maps[b[part]]).sum(axis=1, dtype=np.int64)
        ok[part] = apart <= (n[a[part]] + n[b[part]]) * (1 - threshold) / (1 + threshold) + 1e-6
    return ok


def _links(own: list[np.ndarray], maps: np.ndarray, root: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that join parts of the sets, which are in order of size; root numbers the parts known before. All other pairs are covered."""
    n, out = np.array([len(s) for s in own]), []
    ends = np.searchsorted(n, n / threshold + 1e-6, side="right")
    for i in range(len(own)):
        j = np.arange(i + 1, ends[i])
        j = j[root[j] != root[i]]
        j = j[_may_reach(n, maps, np.full(len(j), i), j, threshold)]
        for k in j.tolist():
            if root[k] == root[i]:
                continue
            a, b = own[i], own[k]
            both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0
            if both >= threshold * (len(a) + len(b) - both) - 1e-9:
                root[root == root[k]] = root[i]
                out.append((i, k))
    return out


def _compared(met: DataFrame, sets: DataFrame, scratch: Scratch, name: str, threshold: float, block: int) -> DataFrame:
    """Links (u, v) within the keys of met (key, set_id, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            at = 0
            for size in _runs(t["key"].to_numpy(), t["pair"].to_numpy()).tolist():
                rows, at = t.slice(at, size), at + size
                if size < 2:
                    continue
                ids, root = rows["set_id"].to_numpy(), np.unique(rows["root"].to_numpy(), return_inverse=True)[1]
                maps = np.frombuffer(b"".join(rows["parity"].to_pylist()), np.uint64).reshape(size, -1)
                got = _links([np.frombuffer(s, np.uint64) for s in rows["shingles"].to_pylist()], maps, root, threshold)
                if got:
                    u, v = np.array(got).T
                    yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"])

    hot = _hot(met, scratch, f"{name}-hot", block)
    return _dealt(met.join(sets, "set_id"), hot, block, ("size", "set_id")).mapInArrow(run, "u long, v long")


def links(docs: DataFrame, scratch: Scratch, text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, ring: Ring | None = None) -> tuple[DataFrame, DataFrame]:
    """The columns of docs but the text, with set_id; and edges (u, v) between set_ids of at least the threshold, which join all that the search finds."""
    ring = ring or ring_for(docs.count(), threshold, recall)
    marks = scratch.cut(marked(docs, ring, text, width), "marks")
    nodes = scratch.cut(marks.groupBy("set_id").agg(F.min("text_id").alias("text_id"), F.first("fp").alias("fp")), "nodes")

    # Who has a partner in a chain; of those, who has one within the full distance.
    index = _index(nodes, ring)
    hot = _hot(_index(nodes.filter(F.pmod(F.xxhash64("set_id"), F.lit(SAMPLED)) == 0), ring), scratch, "hot", block, SAMPLED)

    def in_chain(t: pa.Table, sizes: np.ndarray) -> np.ndarray:
        c = t["chain"].to_numpy().view(np.uint64)
        return _partnered(sizes, lambda a, b: chains_hold(c[a] ^ c[b], ring))

    def in_distance(t: pa.Table, sizes: np.ndarray) -> np.ndarray:
        fp = _fps(t["fp"]).view(np.uint64)
        return _partnered(sizes, lambda a, b: np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1, dtype=np.int64) <= ring.distance)

    def within(met: DataFrame, name: str) -> DataFrame:
        """Of met (key, set_id, ...) those with a node within the full distance at their key."""
        kept = ", ".join(f"{c} long" for c in met.columns)
        dealt = _dealt(met.join(nodes.select("set_id", "fp"), "set_id"), _hot(met, scratch, f"{name}-hot", block), block)
        return scratch.cut(_filtered(in_distance, kept)(dealt).distinct(), name)

    def sets_of(near: DataFrame, name: str, besides: DataFrame | None = None) -> DataFrame:
        wanted = near.select("set_id").distinct()
        if besides is not None:
            wanted = wanted.join(besides.select("set_id"), "set_id", "left_anti")
        live = scratch.cut(nodes.join(wanted, "set_id", "left_semi").select("text_id"), f"{name}-live")
        return scratch.cut(_sets(docs, text, live, width), name)

    met = scratch.cut(_filtered(in_chain, "key long, set_id long")(_dealt(index, hot, block)).distinct(), "met")

    # Each node at its most common key alone, which joins most near copies of a text: from there on they are one part.
    counts = met.groupBy("key").agg(F.count("*").alias("c"))
    top = met.join(counts, "key").groupBy("set_id").agg(F.max_by("key", F.struct("c", "key")).alias("key"))
    top = within(scratch.cut(top.select("key", "set_id"), "top"), "top-near")
    sets = sets_of(top, "sets-1")
    first = scratch.cut(_compared(top.withColumn("root", F.col("set_id")), sets, scratch, "first", threshold, block), "links-1")

    def parted(edges: DataFrame, name: str) -> DataFrame:
        """met with the root of each node's part."""
        stars = components(edges, scratch, name).withColumnRenamed("node", "set_id")
        return scratch.cut(met.join(stars, "set_id", "left").select("key", "set_id", F.coalesce("root", "set_id").alias("root")), f"{name}-met")

    # Where a large part meets others, one node of each part, which differs from key to key.
    some = parted(first, "parts-1").groupBy("key", "root").agg(F.min_by("set_id", F.xxhash64("key", "set_id")).alias("set_id"), F.count("*").alias("m"))
    some = scratch.cut(some.select("key", "set_id", "root", "m"), "some")
    some = within(scratch.cut(some.join(_keys_between(some, F.max("m") > 1), "key", "left_semi"), "some-apart"), "some-near")
    sets = sets.union(sets_of(some, "sets-2", sets))
    first = first.union(scratch.cut(_compared(some, sets, scratch, "some", threshold, block), "links-2"))

    # Then all keys where parts meet, one of those with the same nodes; and of those what sizes and parity maps allow a link between parts.
    rooted = parted(first, "parts-2")
    apart = scratch.cut(rooted.join(_keys_between(rooted), "key", "left_semi"), "apart")
    near = within(apart, "near")
    sets = sets.union(sets_of(near, "sets-3", sets))

    def allowed(t: pa.Table, sizes: np.ndarray) -> np.ndarray:
        n, root = t["size"].to_numpy(), t["root"].to_numpy()
        maps = np.frombuffer(b"".join(t["parity"].to_pylist()), np.uint64).reshape(t.num_rows, -1)

        def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = root[a] != root[b]
            out[out] = _may_reach(n, maps, a[out], b[out], threshold)
            return out

        return _partnered(sizes, alike)

    maps = sets.select("set_id", "size", "parity")
    left = _filtered(allowed, "key long, set_id long, root long")(_dealt(near.join(maps, "set_id"), _hot(near, scratch, "allowed-hot", block), block)).distinct()
    left = scratch.cut(left, "allowed")
    second = scratch.cut(_compared(left, sets, scratch, "second", threshold, block), "links-3")
    scratch.drop("hot", "nodes", "met", "top", "top-hot", "top-near", "sets-1", "sets-1-live", "first-hot", "parts-1-met", "some", "some-apart", "some-apart-hot")
    scratch.drop("some-near", "some-near-hot", "sets-2", "sets-2-live", "some-hot", "parts-2-met", "apart", "near-hot", "near", "sets-3", "sets-3-live", "allowed-hot", "allowed", "second-hot")
    return marks.drop("fp", "text_id"), first.union(second)


def classes(docs: DataFrame, scratch: Scratch, text: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """The columns of docs but the text, with set_id; and (set_id, component) of the sets that are not their component's name themselves."""
    rows, edges = links(docs, scratch, text, **options)
    return rows, components(edges, scratch).toDF("set_id", "component")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each class of near copies: that of the smallest doc_id, one of them if rows share it.

    Columns, their names and the values of the kept rows are unchanged. Among rows that share the smallest doc_id of a class the one
    with the least row key stays; of repeated equal rows one stays; rows with null ids stay only where a class has no other
    id. Null and blank texts are one class. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    k1, k2 = fresh(docs, "_k1", "_k2")
    keys = row_key(*docs.columns, names=(k1, k2))
    keyed = docs.select(keys[0].alias("k1"), keys[1].alias("k2"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows, named = classes(keyed, scratch, "text", **options)
    parts = small(named, named.count())
    of = lambda df: df.join(parts, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    best = of(rows.groupBy("set_id").agg(F.min("id").alias("id"))).groupBy("component").agg(F.min("id").alias("id"))
    best = best.select(F.col("component").alias("c"), F.col("id").alias("i"))
    ones = of(rows).join(best, (F.col("component") == F.col("c")) & F.col("id").eqNullSafe(F.col("i"))).groupBy("component", "k1", "k2").agg(F.count("*").alias("n"))
    # The winner is a row of fixed width, so that a class of any size is reduced where it is read.
    ones = ones.groupBy("component").agg(F.min_by("k2", "k1").alias("k2"), F.min_by("n", "k1").alias("n"), F.min("k1").alias("k1"))
    kept = scratch.cut(ones.select(F.col("k1").alias(k1), F.col("k2").alias(k2), "n"), "kept")
    scratch.drop("marks")
    single, several = kept.filter("n = 1").select(k1, k2), kept.filter("n > 1").select(k1, k2)
    again = docs.withColumns({k1: keys[0], k2: keys[1]})
    n_single, n_several = single.count(), several.count()
    found = again.join(small(single, n_single), [k1, k2], "left_semi")
    if n_several:
        found = found.unionByName(again.join(small(several, n_several), [k1, k2], "left_semi").dropDuplicates([k1, k2]))
    return found.drop(k1, k2)
