"""Each operator against brute force, and its defined results for nulls, empty and repeated rows and clashing columns."""

import collections
import glob
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import decontaminate, langid, mixing, secrets, sharding, simhash, spotsigs, toxicity, training_order, warc
from cairn.llm.common import Scratch, is_held_out
from cairn.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "a", 4),
    (4, "one", "en", "a", 3),
    (4, "one", "en", "a", 3),
    (None, "a text without an id", "en", None, 20),
    (5, "\U0001f600 \U00010330\U00010331 ### 123", None, "b", 9),
    (6, "word " * 30000, "en", "b", 150000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Rows with every oddity, as a written table with columns whose names the operators use themselves."""
    path = str(tmp_path_factory.mktemp("odd") / "t")
    extra = {c: F.lit("x") for c in ("fp", "size", "score", "shard", "slot", "copies", "component_id", "lang_pred", "target", "w", "key", "value", "n")}
    spark.createDataFrame(ODD, SCHEMA).withColumns(extra).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "t")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def scratch(spark):
    return Scratch(spark, "test")


# Mixing


def test_apportion_equals_seat_by_seat():
    rng = random.Random(1)
    for _ in range(300):
        w = [rng.choice([0.0, rng.random() * 100, float(rng.randint(1, 5))]) for _ in range(rng.randint(1, 8))]
        seats = rng.randint(0, 300)
        got = [0] * len(w)
        for _ in range(seats if sum(w) else 0):
            i = max(range(len(w)), key=lambda i: (w[i] / (2 * got[i] + 1), -i))
            got[i] += 1
        assert mixing.apportion(w, seats) == got


def test_targets_reshare_the_excess():
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([20, 295 * 2 / 3 if 295 * 2 / 3 < 200 else 200, 315 - 20 - min(200, 295 * 2 / 3)])
    assert mixing.targets([0, 10], [5, 1]) == [0.0, 15.0]
    assert mixing.targets([], []) == []


def test_mix(spark, docs, texts):
    rows = mixing.mix(docs, scratch(spark)).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    assert {r.doc_id: r["size"] for r in rows} == size
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    of = {r.doc_id: r.source for r in docs.collect()}
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(2, 0.01 * t)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    again = mixing.mix(docs, scratch(spark)).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}


def test_mix_odd(spark, odd, empty):
    rows = mixing.mix(odd, scratch(spark)).collect()
    assert len(rows) == len(ODD)
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    mixed = mixing.apply(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(empty, scratch(spark)).count() == 0 and mixing.apply(empty).count() == 0


def test_shard_quotas_add_up():
    p = mixing.plan({"b": 5000, "a": 100, None: 20000})
    assert p.sources == ["a", "b", None]
    for i in range(3):
        total = sum(q[i] for q in p.quotas) * p.block
        assert abs(total - p.targets[i]) <= 2 * p.block and all(q[i] >= 0 for q in p.quotas)


# WARC


def test_warc_round_trip_and_false_magic(spark):
    trap = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "é" * 600
    rows = [(1, "u", trap * 3), (2, "u\r\nX: y", big), (7, None, big), (3, "u", big), (4, "u", None), (5, "u", "x"), (6, "u", "x"), (None, "u", "WARC/1.0\r\n")]
    rows += [(100 + i, "u", f"{i} {trap}" * (i % 4)) for i in range(50)]
    path = scratch(spark).path("w")
    warc.write(warc.plan(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch(spark)), path, file_records=7)
    got = warc.read(path, spark).select(warc.page_of(F.col("id")).alias("page"), "type", warc.page_of(F.col("refers_to")).alias("to"), "digest", "payload_bytes", "block_bytes").collect()
    assert len(got) == len(rows)
    want = {}
    for i, _, h in rows:
        want[str(i) if i is not None else None] = (h or "").encode()
    for r in got:
        assert r.digest == "sha1:" + hashlib.sha1(want[r.page]).hexdigest() and r.payload_bytes == len(want[r.page])
        revisit = r.page in ("2", "3")
        assert r.type == ("revisit" if revisit else "response") and r.to == ("7" if revisit else None)
    assert warc.candidates(path, spark).count() > len(rows)
    assert all(r.verified for r in warc.verified(warc.read(path, spark)).collect())


def test_reachable_follows_the_chain_only():
    at, after = np.array([0, 5, 10, 20, 30]), np.array([10, 20, 30, 40, 50])
    assert warc.reachable(at, after, 50).tolist() == [True, False, True, False, True]
    with pytest.raises(ValueError):
        warc.reachable(at, np.array([10, 20, 31, 40, 50]), 50)


def test_warc_empty(spark):
    path = scratch(spark).path("w")
    warc.write(warc.plan(spark.createDataFrame([], "page_id long, url string, html string"), scratch(spark)), path)
    assert warc.read(path, spark).count() == 0


# Toxicity


def test_fold_keeps_length_and_undoes_disguise():
    assert toxicity.fold("Iԁі0т 1d10t") == toxicity.fold("idiot") + " " + toxicity.fold("idiot")
    for t in ("Straße ﬁ Ünï", "\U0001f600x", ""):
        assert len(toxicity.fold(t)) == len(t)


def test_lexicon_learns_and_respects_exceptions(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(40)] = rng.choice(["grumbo", "Grumb0", "grumbolino"])
        elif i % 4 == 1:
            w[10:12] = ["grumbo", "pie"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.fit(d, y, scratch(spark), exceptions=("grumbo pie",))
    got = {r.doc_id: r.predicted for r in toxicity.score(d, lexicon).collect()}
    wrong = sum(got[i] != t for i, t in labels)
    assert any(t.startswith(" grum") for t in lexicon.terms) and wrong <= 4


def test_toxicity_held_out_recall(spark):
    sf = "/root/testdata/sf0.1"
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lexicon = toxicity.fit(d, y.filter(~is_held_out()), scratch(spark))
    held = toxicity.score(d.select("doc_id", "text"), lexicon).join(y.filter(is_held_out()), "doc_id").collect()
    toxic = [r.predicted for r in held if r.toxic]
    clean = [r.predicted for r in held if not r.toxic]
    assert sum(toxic) >= 0.95 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_toxicity_odd(spark, odd, empty):
    none = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"), scratch(spark))
    rows = toxicity.score(odd, none).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert toxicity.score(empty, none).count() == 0


# Decontamination


def test_containment_equals_brute_force(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    short = [(900, "the and"), (901, None), (902, "  ...  "), (903, "Is"), (None, "the of")]
    bench = bench.unionByName(spark.createDataFrame(short, "item_id long, text string"))
    items = {r.item_id: r.text for r in bench.collect() if r.item_id is not None}

    def grams(t, n):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set(), len(w)

    # A document that holds four fifths of an item, and one that holds a little less.
    ws = items[0].split()
    rows = [*texts.items(), (10_001, "zz " + " ".join(ws[: int(len(ws) * 0.9)]) + " yy"), (10_002, " ".join(ws[: int(len(ws) * 0.6)]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = set()
    for k, t in items.items():
        n = min(5, grams(t, 1)[1])
        own = grams(t, n)[0] if n else set()
        for i, x in rows:
            if own and len(own & grams(x, n)[0]) >= 0.8 * len(own) - 1e-9:
                want.add((i, k))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(d, bench, scratch(spark)).collect()}
    assert got == want and any(i == 10_001 for i, _ in got)
    assert decontaminate.remove(d, bench).count() == len(rows) - len({i for i, _ in want})


def test_containment_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, "one"), (2, "word word word word word word")], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.contained(odd, bench, scratch(spark)).collect()]
    assert sorted(got) == [(4, 1), (6, 2)]
    left = decontaminate.remove(odd, bench)
    assert left.columns == odd.columns and left.count() == len(ODD) - 3
    assert decontaminate.contained(empty, bench, scratch(spark)).count() == 0
    assert decontaminate.remove(odd, bench.limit(0)).count() == len(ODD)


# Secrets


def brute_spans(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A | re.I):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secrets_equal_brute_force(spark, docs, odd, empty):
    tricky = ["secret=token:abcdefgh", "TOKEN = 'abc-def_1'", "é apiKey:'x'", "AKIA" * 6, "ſecret=abcdefgh", "a" * 23 + " " + "b" * 30, "token=token=abcdefg"]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, t) for i, t in enumerate(tricky)] + [(None, None), (1000, tricky[0])]
    got = secrets.scan_all(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.spans) for r in got) == sorted((i or -1, brute_spans(t or "")) for i, t in rows)
    assert secrets.scan_all(odd).count() == len(ODD) and secrets.scan_all(empty).count() == 0


def test_ledger_scans_only_what_is_new(spark):
    ledger = scratch(spark).path("ledger")
    one = spark.createDataFrame([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "x")], "doc_id long, text string")
    assert secrets.scan(one, ledger) == 2
    two = spark.createDataFrame([(4, "x"), (5, "password: hunter22"), (6, None)], "doc_id long, text string")
    assert secrets.scan(two, ledger) == 2 and secrets.scan(two, ledger) == 0
    got = {r.doc_id: r.spans for r in secrets.findings(one.union(two), ledger).collect()}
    assert got == {1: "assign:0:14", 2: "assign:0:14", 3: "", 4: "", 5: "assign:0:18", 6: ""}


# Training order


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        f = training_order.Feistel(n, 9)
        slots = f.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (f.index(slots) == np.arange(n)).all()
    assert training_order.Feistel(1000, 1).slot(np.arange(5)).tolist() != training_order.Feistel(1000, 2).slot(np.arange(5)).tolist()


def test_shards_round_trip(spark, docs, texts, odd, empty):
    path = scratch(spark).path("shards")
    layout = training_order.write(docs, path, shard_bytes=100_000)
    rows = training_order.read_index(spark, layout).collect()
    assert {r.slot for r in rows} == set(range(layout.sequences)) and all(r.crc_ok for r in rows) and layout.shards > 1
    with open(training_order.VOCABULARY, "rb") as f:
        encode, end = training_order.encoder(f.read())
    content = {}
    for name in glob.glob(f"{path.removeprefix('file://')}/part-*"):
        raw = open(name, "rb").read()
        assert len(raw) % layout.stride == 0
        shard = struct.unpack_from("<q", raw, len(raw) - layout.stride + 8)[0]
        records = list(training_order.read_records(raw, layout))
        assert [r.tolist() for r in training_order.read_records(raw, layout, 2)] == [r.tolist() for r in records[2:]]
        content[shard] = raw
    # Arithmetic alone leads from a slot to its ids.
    parts = collections.defaultdict(list)
    for r in rows:
        shard, begin = layout.place(r.slot)
        assert r.shard == shard
        ids = np.frombuffer(content[r.shard], f"<u{layout.width}", layout.sequence, begin)
        parts[r.doc_id].append((r.first_token, ids[r.at : r.at + r.n_tokens].tolist()))
    got = {i: [x for _, piece in sorted(p) for x in piece] for i, p in parts.items()}
    assert got == {i: [*encode(t).tolist(), end] for i, t in texts.items()}
    got = training_order.materialise(odd).collect()
    assert {r.doc_id for r in got} == {x[0] for x in ODD} and all(r.crc_ok for r in got)
    whole = collections.Counter()
    for r in got:
        whole[r.doc_id] += r.n_tokens
    assert whole[4] == 2 * (len(encode("one")) + 1) and whole[1] == 1 and whole[6] == len(encode("word " * 30000)) + 1
    assert training_order.materialise(empty).count() == 0


def test_long_texts_are_parted_where_tokens_end():
    with open(training_order.VOCABULARY, "rb") as f:
        encode, _ = training_order.encoder(f.read())
    text = "it's  a text, with 12 words\n\n and more \t of it " * 50 + "x" * 300 + " end  "
    for most in (7, 64, 1000):
        pieces = list(training_order.parted(text, most))
        assert "".join(pieces) == text and np.concatenate([encode(p) for p in pieces]).tolist() == encode(text).tolist()
    assert list(training_order.parted("")) == []


def test_input_is_read_once(spark, docs):
    got = training_order.materialise(docs.repartition(5).withColumn("x", F.rand()).filter("x < 0.5")).collect()
    assert sorted({r.slot for r in got}) == list(range(max(r.slot for r in got) + 1)) and all(r.crc_ok for r in got)


# Sharding


def test_shards_are_contiguous_and_balanced(spark, docs, texts):
    rows = sharding.assign(docs, scratch(spark)).orderBy("global_slot").collect()
    assert [r.global_slot for r in rows] == list(range(len(texts)))
    offset, by = 0, collections.defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.byte_offset) == (len(raw) + 1, zlib.crc32(raw), offset)
        offset += r["size"]
        by[r.shard].append(r)
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    largest = max(r["size"] for r in rows)
    for group in by.values():
        assert [r.slot for r in group] == list(range(len(group)))
        assert abs(sum(r["size"] for r in group) - offset / 8) <= largest + 0.02 * offset / 8


def test_small_groups_stay_whole_and_large_ones_are_parted(spark):
    rows = [(i, "same text " * 20) for i in range(3000)] + [(10_000 + i, f"text {i // 3} " * 9) for i in range(3000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark)).collect()
    shards, total = collections.defaultdict(set), collections.Counter()
    for r in got:
        shards[r.text_crc32].add(r.shard)
        total[r.shard] += r["size"]
    assert sum(len(s) > 1 for s in shards.values()) == 1
    assert max(total.values()) - min(total.values()) <= 0.03 * sum(total.values()) / 8


def test_sharding_odd(spark, odd, empty):
    rows = sharding.assign(odd, scratch(spark)).collect()
    assert sorted(r.global_slot for r in rows) == list(range(len(ODD)))
    assert sharding.assign(empty, scratch(spark)).count() == 0


# SpotSigs


def brute_signatures(t):
    common = set(spotsigs.COMMON)
    w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
    assert not w or sum(x in common for x in w) * spotsigs.RARE >= len(w)
    out = {("^", *[x for x in w if x not in common][: spotsigs.CHAIN])} if w else set()
    for i, x in enumerate(w):
        if x in common:
            out.add((x, *[y for y in w[i + 1 :] if y not in common][: spotsigs.CHAIN]))
    return out


def test_signatures_equal_brute_force(spark):
    texts = {1: "The cat and a dog of Rome, the cat and a dog", 2: "of", 3: "", 4: "le chat de la maison est le roi", 5: "the cat and a dog OF Rome!"}
    d = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    rows = {r.doc_id: r.s for r in spotsigs.with_signatures(d, "text", "s").collect()}
    for i in texts:
        assert len(rows[i]) == len(brute_signatures(texts[i]))
        for j in texts:
            a, b = brute_signatures(texts[i]), brute_signatures(texts[j])
            assert len(set(rows[i]) & set(rows[j])) == len(a & b)


def test_edited_text(spark, docs, texts):
    rows = spotsigs.edited(docs).collect()
    ids = sorted(texts, reverse=True)
    follows = {a: ids[(k + 1) % len(ids)] for k, a in enumerate(ids)}
    for r in rows:
        t = texts[r.doc_id]
        h = len(t) // 2
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - h] + texts[follows[r.doc_id]][:h]).encode()).hexdigest()
        assert r.n_chars == len(t) and 0 <= r.near_next <= 1
    assert len(rows) == len(texts)
    assert sum(r.near_edited for r in rows) > 5 * sum(r.near_next for r in rows)


def test_edited_odd(spark, odd, empty):
    rows = spotsigs.edited(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_chars == 0 and by[1].edited_sha256 == hashlib.sha256(b"").hexdigest() and by[1].near_edited == 1.0
    assert by[1].fingerprint == by[2].fingerprint == ""
    one = spotsigs.edited(odd.filter("doc_id = 6")).collect()[0]
    assert one.near_next == 1.0
    assert spotsigs.edited(empty).count() == 0


def test_similar_sets_lose_no_pair(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(15):
        base = [x for _ in range(40) for x in (rng.choice(spotsigs.COMMON), rng.choice(words))]
        for c in range(5):
            t = list(base)
            for _ in range(c):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((k * 10 + c, " ".join(t)))
    rows += [(999, None), (998, rows[0][1])]
    pairs, members = spotsigs.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark))
    of = {r.doc_id: r.set_id for r in members.collect()}
    got = {frozenset((r.a, r.b)) for r in pairs.collect()}
    sets = {i: brute_signatures(t or "") for i, t in rows}
    want = set()
    for i, a in sets.items():
        for j, b in sets.items():
            if a and b and of[i] != of[j] and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                want.add(frozenset((of[i], of[j])))
    assert got == want and want and of[998] == of[rows[0][0]]


# SimHash


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_classes_equal_brute_force(spark, texts):
    rng = random.Random(7)
    rows = [*texts.items()]
    for i in range(40):
        w = rows[i][1].split()
        w[rng.randrange(len(w))] = "other"
        rows.append((5000 + i, " ".join(w)))
    rows += [(-3, rows[0][1]), (6000, None), (6001, " ")]
    fp = {i: brute_fingerprint(t) for i, t in rows}
    got, _ = simhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark))
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in got.collect()}
    assert {i: v[0] for i, v in got.items()} == fp
    parent = {i: i for i in fp}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fp)
    for i in ids:
        for j in ids:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert {i: v[1] for i, v in got.items()} == {i: root(i) for i in ids}
    assert got[6001][1] == 6000


@pytest.mark.parametrize("block,distance", [(simhash.BLOCK, 4), (40, 4), (simhash.BLOCK, 6), (60, 7)])
def test_links_of_dense_groups_keep_components(spark, block, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 2**63, 10, dtype=np.uint64)
    v = base[rng.integers(0, 10, 800)]
    for _ in range(max(1, distance // 2)):
        v = v ^ (np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64))
    nodes = [int(x) for x in np.unique(v).view(np.int64)]
    d = spark.createDataFrame([(x,) for x in nodes], "fp long")
    got = [(r.u, r.v) for r in simhash.links(d, scratch(spark), block, distance).collect()]
    near = [(a, b) for k, a in enumerate(nodes) for b in nodes[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= distance]

    def parts(edges):
        p = {x: x for x in nodes}

        def root(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in edges:
            p[max(root(a), root(b))] = min(root(a), root(b))
        return {x: root(x) for x in nodes}

    assert parts(got) == parts(near) and len(got) < len(near)
    stars = components(spark.createDataFrame(got, "u long, v long"), scratch(spark)).collect()
    assert {r.node: r.root for r in stars} == {x: r for x, r in parts(near).items() if x != r}


@pytest.mark.parametrize(
    "edges, roots",
    [
        ([], {}),
        ([(4, 4)], {}),
        ([(1, 5), (5, 1), (7, 1), (9, 8), (9, 8)], {5: 1, 7: 1, 9: 8}),  # stars in either direction, with repeats
        ([(k, k + 1) for k in range(20)], {k + 1: 0 for k in range(20)}),
        ([(9, 2), (9, 3), (-4, 3)], {9: -4, 3: -4, 2: -4}),  # a node with two smaller neighbours
    ],
)
def test_components_of_small_graphs(spark, edges, roots):
    got = components(spark.createDataFrame(edges, "u long, v long"), scratch(spark)).collect()
    assert len(got) == len(roots) and {r.node: r.root for r in got} == roots



# Language ID


def test_language_id_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(langid.learnable(d, is_held_out()))
    rows = langid.predict(d.filter(is_held_out()), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert model.languages == ["de", "en", "es", "fr"] and all(0 <= r.score <= 1 for r in rows)


def test_language_id_odd(spark, odd, empty):
    model = langid.fit(odd)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[1].score == 0
    assert by[5].lang_pred == "en" and by[6].lang_pred == "en"  # Gothic letters are letters
    assert langid.fit(empty) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0
