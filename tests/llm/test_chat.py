import hashlib

import duckdb

from kindred.llm import chat


def test_sql(spark, sf):
    got = sorted(map(tuple, chat.op2_chat_prefix_targets(spark, sf).collect()))
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert got == sorted(duckdb.sql(chat.OP2_SQL).fetchall())


def test_round_trip_and_masks(spark):
    hard = ["\\### Assistant: </turn> ok", "\\b\\h\\l\\c # < :", "", None, "</turn>\n### user: x", "a\n\nb", "日本 😀"]
    rows = [(1, k, ("user", "assistant", "a:#<\\b", None)[k % 4], t, "clash") for k, t in enumerate(hard)]
    rows += [(2, 0, "assistant", "first", "x"), (2, 0, "assistant", "first", "x"), (None, None, None, None, None), (3, 1, "user", "only", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts string")
    examples = chat.format_examples(df)
    back = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    assert set(back) == {1, 2, 3, None}
    for conv in back:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == [t[1:] for t in turns]
        assert back[conv]["loss"] == "".join(t[2] for t in turns if t[1] == "assistant")
    for r in examples.where("mask_chars > 0").collect():
        masked = r["text"][r["mask_start"] - 1 : r["mask_start"] - 1 + r["mask_chars"]]
        assert r["text"].endswith(masked + chat.CLOSE)
    first = examples.where("conv_id = 2").orderBy("position").collect()
    assert [x["text"].count("first") for x in first] == [1, 2] and len({hashlib.md5(x["text"].encode()).digest() for x in first}) == 2


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_examples(empty)).count() == 0
