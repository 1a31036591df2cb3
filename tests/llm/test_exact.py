import hashlib
import re
from collections import defaultdict

from kindred.llm import exact


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[plain(t)].append(k)
    out = []
    for k, t in rows:
        members = groups[plain(t)]
        known = [m for m in members if m is not None]
        out.append((k, min(known) if known else None, len(members), hashlib.sha256(plain(t).encode()).hexdigest()))
    return sorted(out, key=str)


def told(df):
    rows = df.collect()
    for g in {r["text_sha256"] for r in rows}:
        assert sum(r["kept"] for r in rows if r["text_sha256"] == g) == 1
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str)


def test_odd_rows_with_small_blocks(odd, scratch):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert told(exact.exact_groups(odd, scratch, block=16)) == brute(rows)


def test_blocks_at_the_edges(spark, scratch):
    texts = ["", "a" * 15, "a" * 16, "a" * 17, "a" * 32, "a" * 33, "a" * 48, "a" * 16 + "b" * 16, "b" * 16 + "a" * 16, "é" * 8, "é" * 8 + "a", "a" * 47 + "b"] * 2
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(exact.exact_groups(df, scratch, block=16)) == brute(rows)


def test_hot_runs_are_salted(spark, scratch):
    rows = [(k, "hot text " * 30 if k % 2 else f"text {k}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(exact.exact_groups(df, scratch, block=64)) == brute(rows)


def test_drop_copies(odd, nothing, scratch):
    kept = exact.drop_copies(odd, scratch)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len({plain(r["text"]) for r in rows}) == len(rows) == len({plain(r["text"]) for r in odd.collect()})
    assert exact.drop_copies(nothing, scratch).count() == 0 and exact.exact_groups(nothing, scratch).count() == 0


def test_no_text_is_exchanged_to_drop_copies(spark, scratch):
    df = spark.createDataFrame([(k, f"text {k % 70}") for k in range(100)], "doc_id long, text string")
    kept = exact.drop_copies(scratch.cut(df), scratch)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(70))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "sha2" not in plan


def test_a_doc_id_of_which_some_rows_go(spark, scratch):
    rows = [(1, "a"), (2, "a"), (2, "b"), (2, "b"), (2, "c"), (3, "b"), (3, "a"), (None, "c"), (None, "d"), (None, "d"), (4, None), (5, ""), (5, "e"), (6, "f")]
    kept = exact.drop_copies(scratch.cut(spark.createDataFrame(rows, "doc_id long, text string")), scratch)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (4, None), (5, "e"), (6, "f")], key=str)
