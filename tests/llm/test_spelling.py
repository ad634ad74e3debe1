"""Spelling variants against brute force: every pair of words compared letter by letter."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import spelling
from cairn.llm.common import Scratch

SCHEMA = "doc_id long, text string"


def _near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _counts(rows, least_chars=6, least_count=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= least_chars and k >= least_count}


def _expected(rows, least_chars=6, least_count=5, factor=5):
    n = _counts(rows, least_chars, least_count)
    near = {w: [x for x in n if _near(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= factor * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def _found(spark, rows, schema=SCHEMA, **settings_):
    made = spelling.variants(spark.createDataFrame(rows, schema), Scratch(spark, "test"), **settings_).collect()
    assert len({r.word for r in made}) == len(made)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in made}


words = st.lists(st.text("abé", min_size=1, max_size=6), min_size=1, max_size=40, unique=True)


@settings(max_examples=300, deadline=None)
@given(words, st.text("abéc", max_size=7))
def test_automaton_meets_trie(inside, word):
    raw = sorted(w.encode("latin-1") for w in inside)
    found = list(spelling.accepted(word.encode("latin-1"), spelling.trie_of(raw, list(range(1, len(raw) + 1)))))
    assert sorted(found) == sorted((x, i + 1) for i, x in enumerate(raw) if _near(word, x.decode("latin-1")))


@pytest.fixture(scope="module")
def real(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


def test_documents(spark, real):
    assert _found(spark, real) == _expected(real)


def test_many_shards_and_groups(spark, real, monkeypatch):
    want = _expected(real)
    monkeypatch.setattr(spelling, "SHARD_LETTERS", 600)
    monkeypatch.setattr(spelling, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(spelling, "TASK_WORDS", 200)
    assert _found(spark, real) == want


def test_chains_ties_and_letters(spark):
    text = lambda **n: " ".join(" ".join([w] * k) for w, k in n.items())
    rows = [(1, text(abcdef=5, abcdeff=50, abcdefff=260, abcdeffff=1400)), (2, text(xbcdxf=6, xacdxf=30, xzcdxf=30)), (3, "ÀÉÎÕÜ× ÀÉÎÕÜ÷ " * 7 + "Àéîõüa " * 40), (4, "AbCdEf-abcdef_ABCDEF"), (5, "naïveté naivete " * 9)]
    found = _found(spark, rows)
    assert found == _expected(rows)
    assert found["abcdef"][:2] == ("abcdeff", "abcdeffff") and found["xbcdxf"][0] == "xacdxf"


def test_odd_rows(spark):
    long = "wxyz" * 5000
    rows = [(1, None), (2, ""), (None, "nullid " * 6), (3, f"{long} " * 6 + f"{long}a " * 40), (4, " \n- 12"), (5, "ab " * 50), (6, "repeat again " * 3), (6, "repeat again " * 3)]
    assert _found(spark, rows) == _expected(rows)
    assert _found(spark, []) == {}
    clash = [(i, "sprache spracje " * 9, "x", 1, "y") for i in range(3)]
    assert _found(spark, clash, "doc_id long, text string, word string, n int, form string") == _expected([r[:2] for r in clash])
    assert _found(spark, [(1, "cat cut cat cat dog")], least_chars=3, least_count=1, factor=2) == _expected([(1, "cat cut cat cat dog")], 3, 1, 2)
    with pytest.raises(ValueError, match="factor"):
        _found(spark, rows, factor=1)


def test_grouped(spark):
    rows = [(1, "bonjour " * 100 + "bonjou " * 8 + "bonnjour " * 6 + "autrement " * 5)]
    out = {r.root: (r.n, r.n_forms, r.variants) for r in spelling.grouped(spelling.variants(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "test"))).collect()}
    assert out["bonjour"][1:] == (3, ["bonjou", "bonnjour"]) and out["autrement"] == (5, 1, [])
