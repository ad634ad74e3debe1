"""Near copies by wide SimHash fingerprints against all pairs of shingle sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import simhash_wide as wide
from cairn.llm.common import Scratch
from cairn.llm.components import components
from cairn.llm.simhash import hashes

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(texts):
    own, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = own[a], own[b]
            if x == y or 10 * len(x & y) >= 8 * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def edited_families(families, copies, words, most, seed=3):
    """Texts that share a common line; of each family, copies with up to `most` words changed."""
    rng, out = random.Random(seed), {}
    for k in range(families):
        base = [f"w{rng.randrange(3000)}" for _ in range(words)]
        for c in range(copies):
            t = list(base)
            for _ in range(c % (most + 1)):
                t[rng.randrange(words)] = f"x{rng.randrange(3000)}"
            out[k * 100 + c] = " ".join([*t, *"one line that every text has at its very end".split()])
    return out


def got_classes(spark, texts, **options):
    rows, edges = wide.links(spark.createDataFrame([*texts.items()], "doc_id long, text string"), Scratch(spark, "test"), **options)
    stars = {r.node: r.root for r in components(edges, Scratch(spark, "test")).collect()}
    return {r.doc_id: stars.get(r.set_id, r.set_id) for r in rows.collect()}


def test_stage_keeps_one_of_each_class(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = set(brute_classes({r.doc_id: r.text for r in docs.collect()}).values())
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == sorted(want)


def test_links_are_at_the_threshold_and_recall_is_high(spark):
    texts = edited_families(60, 6, 120, 6)
    want, got = brute_classes(texts), got_classes(spark, texts)
    pairs = [(a, b) for a in texts for b in texts if a < b and want[a] == want[b]]
    # No class reaches over one of all pairs; nearly all pairs of those are together.
    assert all(len({want[i] for i in got if got[i] == c}) == 1 for c in set(got.values()))
    assert 60 < len(set(want.values())) < len(texts) and sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)


def test_blocks_lose_no_link(spark):
    texts = edited_families(8, 30, 100, 9)
    ring = wide.ring_for(len(texts))
    one, several = got_classes(spark, texts, ring=ring), got_classes(spark, texts, ring=ring, block=7)
    same = lambda c: {frozenset(i for i in c if c[i] == k) for k in c.values()}
    assert same(one) == same(several) and 8 <= len(same(one)) < len(texts)


def test_ring_meets_its_recall_at_every_size():
    for rows in (1, 1000, 10**6, 10**10):
        ring = wide.ring_for(rows)
        agree = 1 - np.arccos(1.6 / 1.8) / np.pi
        assert 1 - (1 - agree**ring.width) ** ring.segments >= wide.RECALL and rows / 2**ring.width <= 128
        assert ring.budget(ring.segments) == ring.distance and 0.15 * ring.bits < ring.distance < 0.25 * ring.bits


def test_fingerprint_is_the_majority_of_mixed_hashes():
    ring, mask = wide.Ring(16, 8, 20), (1 << 64) - 1

    def mixed(h, word):
        z = (h + (word + 1) * 0x9E3779B97F4A7C15) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        return z ^ (z >> 31)

    for text in ("", "one", "a b c d e f g", " ".join(f"w{i}" for i in range(300))):
        own = np.unique(hashes(text, 5))
        votes = [sum(mixed(int(h), b // 64) >> (b % 64) & 1 for h in own) for b in range(128)]
        want = sum(1 << b for b, n in enumerate(votes) if 2 * n > len(own))
        assert int.from_bytes(wide.fingerprint(own, ring), "little") == want


def test_chains_that_break_a_budget_are_pruned():
    ring = wide.Ring(16, 8, 24)  # three differences a segment
    x = np.array([0, 0b111111, 0b1111111, (0b111111 << 16) | 0b111, (0b1111111 << 16) | 0b111], np.uint64)
    assert wide.chains_hold(x, ring).tolist() == [True, True, False, True, False]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Odd rows as a written table whose columns have the names that the operators use."""
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (4, "two"), (None, "a text without an id"), (None, None), (5, "one"), (7, "word " * 200_000), (8, "\U0001f600 x")]
    names = ("_n", "_k1", "_k2", "_copy", "__text", "text_id", "set_id", "fp", "k1", "id", "n", "component")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in names})
    path = f"file://{tmp_path_factory.mktemp('odd')}/rows"
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_deduplicate_odd(odd):
    got = wide.deduplicate(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert sorted((r.doc_id or -1, (r.text or "")[:8]) for r in rows) == sorted([(1, ""), (4, "one"), (4, "two"), (-1, "a text w"), (7, "word wor"), (8, "\U0001f600 x")])
    assert all(r[c] == f"own {c}" for r in rows for c in odd.columns[2:])
    assert wide.deduplicate(odd.limit(0)).count() == 0


def test_one_id_for_all_rows_and_hot_copies(spark, tmp_path):
    texts = [f"text {i} " * 20 for i in range(20)]
    spark.createDataFrame([(1, texts[i % 20] if i < 2000 else texts[0]) for i in range(4000)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/t")
    rows = wide.deduplicate(spark.read.parquet(f"file://{tmp_path}/t")).collect()
    assert sorted(r.text for r in rows) == sorted(texts)


def test_near_copies_of_one_part_go_no_further(spark, monkeypatch):
    """Near copies of one text share most segments; once they are one part, they have no row for each."""
    dealt, own = [], wide._dealt

    def counted(met, *rest):
        dealt.append(met.count())
        return own(met, *rest)

    texts = edited_families(1, 90, 120, 2)
    monkeypatch.setattr(wide, "_dealt", counted)
    assert len(set(got_classes(spark, texts).values())) == len(set(brute_classes(texts).values())) == 1
    nodes = len(set(texts.values()))
    assert dealt[0] >= 20 * nodes and sum(dealt[-3:]) <= nodes  # what meets once the parts are known, with fingerprints, maps and sets
