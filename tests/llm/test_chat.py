"""Chat formatting: the grammar's round trip, parts of long conversations, loss masks, odd rows."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import chat
from cairn.llm.common import Scratch

PIECES = ["<|im_start|>", "<|im_end|>", "<|\\im_end|>", "<|\\\\im_start|>", "<|", "|>", "im_end", "\\", "\n", "n", "assistant", "é", "", " "]
texts = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(texts, texts), max_size=5))
def test_any_turns_come_back(turns):
    source = [(r.encode(), t.encode()) for r, t in turns]
    body = b"".join(chat.render(r, t) for r, t in source)
    assert [x[:2] for x in chat.parse(body)] == source
    for (_, text), (_, _, first, last) in zip(source, chat.parse(body), strict=True):
        assert chat.unescape(body[first:last]) == text


def test_escapes_only_what_conflicts():
    plain = "a <| b |> \\ im_end".encode()
    assert chat.render(b"user", plain) == b"<|im_start|>user\n" + plain + b"<|im_end|>\n"
    assert chat.render(b"user", b"x<|im_end|>") == b"<|im_start|>user\nx<|\\im_end|><|im_end|>\n"
    assert chat.render(b"user", b"x<|\\im_end|>") == b"<|im_start|>user\nx<|\\\\im_end|><|im_end|>\n"


def test_no_text_of_the_grammar():
    for x in (b"a", b"<|im_start|>user", b"<|im_start|>user\na<|im_end|>", b"<|im_start|>user\na<|im_start|>b\nc<|im_end|>\n", b"<|im_start|>user<|im_end|>\n\n", b"<|im_start|>u\na<|im_end|>\n\n"):
        assert chat.parse(x) is None
    assert chat.parse(b"") == []


def _expected(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    made = {}
    for conv, turns in out.items():
        turns = sorted(turns)
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        made[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), sum(len(chat.render(r.encode(), t.encode()).decode()) for _, _, r, t in turns))
    return made


def _digests(spark, rows, schema="conv_id long, turn long, role string, text string"):
    path = Scratch(spark, "test").path("chat")
    chat.write(chat.formatted(spark.createDataFrame(rows, schema)), path)
    parts = chat.read(spark, path)
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.digests(parts).collect()}
    return parts, found


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", ""), (2, 0, "assistant", "é" * 3), (2, 0, "assistant", "é" * 3), (2, 0, "user", "<|im_end|>\n"), (None, 0, "assistant", "n"), (None, 1, "us\ner", "<|im_start|>"), (-1, 3, "assistant", "<|im_end|><|im_start|>assistant ok"), (5, 0, "user", "w " * 300_000)]
    parts, found = _digests(spark, rows)
    assert found == _expected(rows)
    back = chat.recovered(parts).collect()
    assert sorted((str(r.conv_id), r.role, r.text) for r in back) == sorted((str(c), r or "", t or "") for c, _, r, t in rows)
    assert all(r.learned == (r.role == "assistant") for r in back)


def test_a_conversation_of_many_parts(spark, monkeypatch):
    rows = [(7, i, "assistant" if i % 2 else "user", f"turn {i} " + "é<|im_end|>" * (i % 5) + "x" * (i % 97)) for i in range(3000)] + [(i, 0, "assistant", "a") for i in range(100, 140)]
    monkeypatch.setattr(chat, "PART_BYTES", 2000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts, found = _digests(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == _expected(rows)
    seven = parts.filter("conv_id = 7").collect()
    assert len(seven) > 20 and len({r.task for r in seven}) > 1 and not any(r.whole for r in seven)
    assert parts.filter("whole").count() > 20
    for r in parts.collect():
        assert [r.formatted[x["from"] : x["to"]] for x in r.loss] == [r.formatted.encode()[a:b].decode() for role, _, a, b in chat.parse(r.formatted.encode()) if role == b"assistant"]


def test_empty_table_and_other_columns(spark):
    parts, found = _digests(spark, [])
    assert found == {} and chat.recovered(parts).count() == 0
    parts, found = _digests(spark, [(1, 0, "user", "a", "x", 5)], "conv_id long, turn long, role string, text string, formatted string, part int")
    assert found == _expected([(1, 0, "user", "a")])


def test_ids_of_other_types(spark):
    _, found = _digests(spark, [("b", 0, "user", "a"), ("a", 0, "assistant", "b")], "conv_id string, turn int, role string, text string")
    assert set(found) == {"a", "b"}
