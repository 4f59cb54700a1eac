import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import queries_chat
from sparkloom.llm.chat import START, formatted, parse, read_back, turn

SIGNS = ["[INST]", "[/INST]", " [/INST]", "</s>", " </s>", "<s>", "<<SYS>>", "<</SYS>>\n", "<|", "|>", "<|end|>", "\\", "[", "<", "/", "INST]", " ", "\n", "é", "[\\INST]", "<\\\\/s>"]
said = st.lists(st.sampled_from(SIGNS) | st.text(max_size=3), max_size=8).map("".join)
role = st.sampled_from(["user", "assistant", "system", "tool", "", "[INST]", "<|role|a|>", "%"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(role, said), max_size=5))
def test_any_turns_come_back(turns):
    text = "".join(turn(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in parse(text)] == turns


def test_plain_text_is_not_escaped():
    assert turn("user", "hello [there] <b> \\ x")[0] == "[INST] hello [there] <b> \\ x [/INST]"


def test_conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 3, "assistant", "b"),
        (2, 5, None, "x"), (2, None, "system", "é" * 70_000), (None, 0, "user", "no id"), (3, 0, "assistant", "<|end|>"), (4, 1, "user", "same"), (4, 1, "user", "same"),
    ]
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], "conv_id long, turn long, role string, text string, formatted string, n_turns string").repartition(3)
    texts = {r.conv_id: r for r in formatted(df).collect()}
    got = {r.conv_id: r for r in read_back(formatted(df)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for key in got:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert [(r, t) for r, t, _, _ in parse(texts[key].formatted, len(START))] == turns
        assert (got[key].n_turns, got[key].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[key].loss_chars, got[key].loss_sha256, got[key].formatted_chars) == (len(loss), sha(loss), len(texts[key].formatted))
        assert [texts[key].formatted[s.begin : s.end] for s in texts[key].loss_spans] == [texts[key].formatted[b:e] for r, _, b, e in parse(texts[key].formatted, len(START)) if r == "assistant"]
    assert read_back(formatted(df.limit(0))).count() == 0


def test_long_conversations_are_written_in_parts(spark):
    rows = [(k % 3 or None, i, ("user", "assistant", "tool")[i % 3], f"</s> {i} " * (i % 7)) for k in range(6) for i in range(k, 60, 6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    whole, parts = formatted(df).collect(), formatted(df, 100).collect()
    assert len(whole) == 3 and len(parts) >= 10 and max(len(p.formatted) for p in parts) < 400
    for w in whole:
        own = sorted((p for p in parts if p.conv_id == w.conv_id), key=lambda p: p.part)
        assert [p.part for p in own] == list(range(len(own))) and "".join(p.formatted for p in own) == w.formatted
        assert [p.formatted[s.begin : s.end] for p in own for s in p.loss_spans] == [w.formatted[s.begin : s.end] for s in w.loss_spans]
    order = lambda r: r.conv_id or 0
    assert sorted(read_back(formatted(df, 100)).collect(), key=order) == sorted(read_back(formatted(df)).collect(), key=order)


def test_parts_out_of_order_are_refused(spark):
    torn = spark.createDataFrame([(1, 1, " x </s>", [])], "conv_id long, part long, formatted string, loss_spans array<struct<begin:long,end:long>>")
    with pytest.raises(Exception, match="comes after"):
        read_back(torn).collect()


def test_sql_counts_turns_of_other_roles(spark, tmp_path):
    rows = [(1, 0, "tool", "a <|end|> b"), (1, 1, "a b/\u00e9", "x"), (1, 2, "user", "y"), (2, 0, "", "[INST]")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = queries_chat.op5_chat(spark, str(tmp_path)), con.sql(queries_chat.SQL["op5_chat"])
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries_chat.SQL['op5_chat']})").fetchall()) and sorted(want.columns) == sorted(got.columns)
