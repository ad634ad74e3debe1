"""Methods against plain restatements of them, and the odd inputs that each must survive."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import langid, mixing, sharding, simhash, spotsigs, toxicity, training_order, warc
from cairn.llm.common import Scratch, bounded

PAGES = "page_id long, url string, html string"


def test_slices_are_bounded_by_bytes_and_lose_no_row():
    texts = ["a" * n for n in (5, 0, 100, 3, 3, 3, 50_000, 1)] + [None]
    b = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(9))], names=["t", "i"])
    parts = list(bounded([b, b.slice(0, 0)], "t", 150))
    assert [i for p in parts for i in p["i"].to_pylist()] == list(range(9))
    assert all(p.num_rows == 1 or sum(len(t or "") + 16 for t in p["t"].to_pylist()) <= 150 for p in parts)


# Source mix


def test_mix_equals_a_walk_over_blocks(spark):
    rng = random.Random(4)
    sizes = {"a": [rng.randrange(0, 40) for _ in range(300)], "b": [rng.randrange(0, 900) for _ in range(20)] + [30_000], "c": [7]}
    p = mixing.plan({s: sum(n) for s, n in sizes.items()})
    for k, s in enumerate(p.sources):
        size = np.array(sizes[s])
        at = np.cumsum(size) - size
        taken, copies, first = mixing.draws(p, k, at, size)
        # Shard after shard, each block in the order of the permutation; the words of a block go to the documents they lie in.
        order, n, want, shard_of, drawn = p.order(k), p.blocks[k], np.zeros(len(size), int), np.full(len(size), -1), 0
        word_of = np.repeat(np.arange(len(size)), size)
        times = np.zeros(n, int)
        by_rank = np.argsort(order.slot(np.arange(n)))
        for shard, quota in enumerate(q[k] for q in p.quotas):
            for _ in range(quota):
                block = by_rank[drawn % n]
                drawn += 1
                times[block] += 1
                docs = word_of[block * p.block : (block + 1) * p.block]
                np.add.at(want, docs, 1)
                new = np.unique(docs)
                shard_of[new[shard_of[new] < 0]] = shard
        assert taken.tolist() == want.tolist() and first.tolist() == shard_of.tolist()
        middle = (at + size // 2) // p.block
        assert copies.tolist() == [int(times[m]) if z else 0 for m, z in zip(middle.tolist(), size.tolist(), strict=True)]
        assert (taken <= 2 * size).all() and abs(taken.sum() - p.targets[k]) <= 2 * p.block + 1


def test_mix_keeps_values_of_columns_with_its_own_names(spark, tmp_path):
    rows = [(i % 50, f"some words of text {i % 50}", "a" if i % 3 else None, "x", 1) for i in range(400)] + [(7, None, "b", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, _k1 string, _n int").write.parquet(f"file://{tmp_path}/t")
    docs = spark.read.parquet(f"file://{tmp_path}/t")
    got = mixing.apply(docs)
    assert got.columns == docs.columns and {(r["_k1"], r["_n"]) for r in got.collect()} == {("x", 1)}
    assert got.count() == mixing.mix(docs, Scratch(spark, "test")).agg(F.sum("copies")).first()[0]


# WARC


def round_trip(spark, rows, **options):
    path = Scratch(spark, "test").path("w")
    warc.write(warc.plan(spark.createDataFrame(rows, PAGES).withColumns({"payload": F.lit("x"), "record_type": F.lit(1), "_d": F.lit(2)}), Scratch(spark, "test")), path, **options)
    got = warc.verified(warc.read(path, spark)).collect()
    assert all(r.verified for r in got)
    return {re.fullmatch("<urn:page:(.*)>", r.id)[1]: (r.payload_bytes, r.payload_digest) for r in got}


def test_payloads_that_look_like_records(spark):
    payloads = ["WARC/1.0\r\nContent-Length: ²\r\n\r\n", "WARC/1.0\r\nContent-Length: " + "9" * 5000 + "\r\n\r\n", "WARC/1.0\r\n" * 3000 + "\r\n", "WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 500, "\r\n\r\n", "WARC/1.0\r\n"]
    urls = ["u", None, "http://x/WARC/1.0", "u\r\n\r\n", "u" * 40_000, ""]
    rows = [(i, u, t) for i, (u, t) in enumerate(zip(urls, payloads, strict=True))]
    assert round_trip(spark, rows) == {str(i): (len(t.encode()), hashlib.sha1(t.encode()).hexdigest()) for i, _, t in rows}


def test_pages_of_all_sizes(spark):
    rng = random.Random(1)
    rows = [(i, "u", chr(97 + i % 26) * rng.choice([0, 999, 1000, 1001, 5000, 70_001])) for i in range(120)] + [(500, "u", "z" * 3_000_000), (501, "u", "z" * 3_000_000)]
    got = round_trip(spark, rows, file_records=7, file_bytes=100_000)
    assert got == {str(i): (len(t), hashlib.sha1(t.encode()).hexdigest()) for i, _, t in rows}


def test_a_damaged_block_is_not_verified(spark, tmp_path):
    body = b"hello"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: 5\r\n\r\n" % hashlib.sha1(body).hexdigest().encode()
    (tmp_path / "part-0").write_bytes(record + b"hellO" + b"\r\n\r\n" + record.replace(b"page:1", b"page:2") + body + b"\r\n\r\n")
    assert {r.id: r.verified for r in warc.verified(warc.read(f"file://{tmp_path}", spark)).collect()} == {"<urn:page:1>": False, "<urn:page:2>": True}


# Toxicity


def test_automaton_equals_naive_matching():
    rng = random.Random(2)
    words = ["bad", "badly", "good", "b4d", "bаd", "worse", "verybad", "bad-tempered", "BAD", "kind"]  # one has a homoglyph
    lexicon = toxicity.Lexicon({" bad": 2.0, " bad ": 1.0, " worse ": 0.5}, [" good bad "], np.zeros(3))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(300)]
    weight, count = toxicity.sums(texts, lexicon.automaton())
    for t, w, n in zip(texts, weight, count, strict=True):
        folded = f" {toxicity.fold(t)} "
        spans = [(m.start(), m.start() + 10) for m in re.finditer("(?= good bad )", folded)]
        want = 0.0
        for term, value in lexicon.terms.items():
            for m in re.finditer(f"(?={re.escape(term)})", folded):
                end = m.start() + len(term)
                want += 0 if any(s <= m.start() and end <= e for s, e in spans) else value
        assert w == pytest.approx(want) and n == len(folded.split())


def test_documents_that_share_an_id_teach_once(spark):
    docs = spark.createDataFrame([(i % 20, f"text {'nasty' if i % 2 else 'nice'} {i}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    scratch = Scratch(spark, "test")
    toxicity.fit(docs, labels, scratch)
    assert spark.read.parquet(scratch.path("sample")).count() == 20


# Language ID


def test_grams_and_weights_equal_plain_counting():
    fold = lambda c: c.lower()[0] if c.isalpha() else " "
    for text in ("", " ", "a", "Ab c.", "été 12 ça", "\U00010400x" * 3, "ab " * 10):
        c = [ord(fold(x)) for x in text] + [32, 32]
        want = np.zeros(langid.BUCKETS, int)
        m32 = lambda x: x & 0xFFFFFFFF
        for i in range(len(text)):
            two = m32(c[i] * 0x9E3779B1 + c[i + 1])
            three = m32(m32(two * 0x85EBCA77) + c[i + 2])
            if c[i] != 32:
                want[m32(c[i] * 0x27D4EB2F) >> 17] += 1
            if c[i] != 32 or c[i + 1] != 32:
                want[m32(two * 0xC2B2AE3D) >> 17] += 1
                want[m32(three * 0xC2B2AE3D) >> 17] += 1
        at, n = langid._counts(text)
        assert at.tolist() == np.flatnonzero(want).tolist() and n.tolist() == want[want > 0].tolist()


def test_long_texts_count_the_same_in_pieces(monkeypatch):
    text = "some words of a text, été " * 500
    whole = langid._counts(text)
    monkeypatch.setattr(langid, "PIECE", 97)
    assert all(np.array_equal(a, b) for a, b in zip(whole, langid._counts(text), strict=True))


def test_ftrl_equals_a_dense_step_by_step_run():
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(50, 6, replace=False)), rng.uniform(0.1, 1, 6)) for _ in range(40)]
    y = rng.integers(0, 3, 40)
    alpha, beta, l1, l2, seed = 0.5, 1.0, 0.02, 0.1, 3
    got = langid._ftrl(rows, y, 3, 2, alpha, beta, l1, l2, seed)
    z, n = np.zeros((langid.BUCKETS + 1, 3)), np.zeros((langid.BUCKETS + 1, 3))
    order = np.random.default_rng(seed)

    def weights():
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(2):
        for i in order.permutation(40):
            x = np.zeros(langid.BUCKETS + 1)
            x[rows[i][0]], x[-1] = rows[i][1], 1
            w = weights()
            e = np.exp(x @ w - (x @ w).max())
            g = np.outer(x, e / e.sum() - np.eye(3)[y[i]])
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / alpha * w
            n += g * g
    assert np.allclose(got, weights())


def test_one_text_languages_are_learned_and_reruns_agree(spark):
    docs = spark.range(30_300).select(F.when(F.col("id") < 30_000, "the one english text").otherwise(F.concat(F.lit("der deutsche satz nummer "), "id")).alias("text"), F.when(F.col("id") < 30_000, "en").otherwise("de").alias("lang"))
    a, b = langid.fit(docs), langid.fit(docs.repartition(7))
    assert a.languages == ["de", "en"] and np.array_equal(a.table, b.table)
    p = langid.predict(docs.select("text").distinct(), a).collect()
    assert all(r.lang_pred == ("en" if "english" in r.text else "de") for r in p)


def test_rows_without_a_label_teach_nothing(spark):
    docs = spark.createDataFrame([(f"text {i}", "x" if i % 2 else "y") for i in range(40)], "text string, lang string")
    more = docs.union(spark.createDataFrame([("zzz " * 50, None)] * 40, "text string, lang string"))
    assert np.array_equal(langid.fit(docs).table, langid.fit(more).table)


# SpotSigs


def test_hashed_anchors_where_common_words_are_rare(spark):
    texts = [(i, " ".join(f"palabra{(i * 7 + k) % 90}" for k in range(60))) for i in range(6)] + [(9, "solo")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    chosen = {r.w for r in d.select(F.explode(F.split("text", " ")).alias("w")).distinct().filter(F.pmod(F.hash("w"), F.lit(spotsigs.HASHED)) == 0).collect()}
    got = {r.doc_id: len(r.s) for r in spotsigs.with_signatures(d, "text", "s").collect()}
    for i, t in texts:
        w = t.split()
        content = lambda k: tuple([x for x in w[k:] if x not in chosen][: spotsigs.CHAIN])  # noqa: E731, B023
        want = {("^", content(0))} | {(x, content(k + 1)) for k, x in enumerate(w) if x in chosen}
        assert got[i] == len(want)
    assert chosen


def test_likeness_is_that_of_the_fingerprints(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in spotsigs.edited(docs).collect()}
    ids = sorted(rows, reverse=True)
    cut = lambda f: {f[k : k + 8] for k in range(0, len(f), 8)}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, following in zip(ids, [*ids[1:], ids[0]], strict=True):
        r = rows[i]
        assert r.near_edited == pytest.approx(like(cut(r.fingerprint), cut(r.edited_fingerprint)))
        exact = like(cut(r.fingerprint), cut(rows[following].fingerprint))
        assert r.near_next == pytest.approx(exact) and r.alike_next == (exact >= spotsigs.THRESHOLD - 1e-12)


# Long texts and clashing names


def test_one_very_long_text_and_many_long_ones(spark):
    huge = "word und the " * 1_600_000  # 20 MB
    rows = [(0, huge, "en")] + [(i, f"{i} text der long " * 6000, "de") for i in range(1, 129)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).cache()
    model = langid.fit(docs)
    assert {r.lang_pred for r in langid.predict(docs, model).select("lang_pred").collect()} <= {"en", "de"}
    lexicon = toxicity.Lexicon({" und ": 1.0}, [], np.array([-1.0, 1.0, 0.0]))
    assert toxicity.score(docs, lexicon).filter("doc_id = 0").first().predicted == 1
    assert simhash.fingerprints(docs.select("doc_id", "text")).count() == 129
    index = training_order.materialise(docs)
    assert index.filter("NOT crc_ok").isEmpty() and index.select("doc_id").distinct().count() == 129


def test_sharding_keeps_columns_with_its_own_names(spark):
    docs = spark.createDataFrame([(i, "t" * (i % 9), i, i) for i in range(200)], "size long, text string, h long, part long")
    got = sharding.assign(docs, Scratch(spark, "test"), keep=("size", "h", "part"))
    rows = got.collect()
    assert {"size", "size_", "h_", "part_"} <= set(got.columns) and sorted(r.size_ for r in rows) == list(range(200)) == sorted(r.global_slot for r in rows)
