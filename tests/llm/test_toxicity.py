import random

import pytest

from kindred.llm import toxicity as X


def corpus(n, seed=1):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in ("lan", "mor", "tis", "vel", "qua", "ster") for b in ("do", "ra", "nig", "est", "um", "olo")]
    bad = ["badword", "nastyish", "vileterm", "uglything"]
    rows = []
    for k in range(n):
        toxic = k % 6 == 0
        text = [draw.choice(words) for _ in range(draw.randint(5, 60))]
        if toxic:
            for _ in range(max(1, len(text) // 12)):
                text.insert(draw.randrange(len(text)), draw.choice(bad))
        rows.append((k, " ".join(text), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    from kindred.plans.scratch import Scratch

    rows = corpus(1200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").cache()
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(rows[0][0], None), (None, 1)], "doc_id long, toxic int").cache()
    return rows, docs, labels, X.learn(docs, labels, Scratch(spark, "test"))


def test_held_out_rows(learned):
    rows, docs, _, scored = learned
    got = {r["doc_id"]: r["_tox_score"] for r in scored(docs).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    import zlib

    held = [(y, got[k] >= X.THRESHOLD) for k, _, y in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 100 and sum(y == p for y, p in held) >= 0.97 * len(held)


def test_only_the_text_counts(learned, odd, nothing):
    _, _, _, scored = learned
    got = scored(odd, True).collect()
    assert len(got) == odd.count()
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["text"] or "", r["_tox_score"]) == r["_tox_score"]
    assert scored(nothing, True).count() == 0


def test_filter_keeps_columns_and_clean_rows(spark, odd, learned, scratch):
    _, _, labels, _ = learned
    rows, docs, _, _ = learned
    kept = X.drop_toxic(docs, labels, scratch)
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum(k in ids for k, _, y in rows if not y) >= 0.97 * sum(not y for *_, y in rows)
    assert sum(k in ids for k, _, y in rows if y) <= 0.05 * sum(y for *_, y in rows)
    none = labels.limit(0)
    assert X.drop_toxic(odd, none, scratch).columns == odd.columns and X.drop_toxic(odd, none, scratch).count() == odd.count()
    assert {r["score"] for r in X.score(odd, none, scratch).collect()} == {0.0}


def test_features_of_odd_texts():
    measure = X.Features({"badword": 3.0, "nast*": 2.0}, memory=2)
    for text in ("", " ", "!!!", "you badword", "b@dw0rd", "b a d w o r d", "NASTY nastiest", "日本語 😀", "x" * 100_000):
        assert len(measure(text)) == len(measure("")) and all(v == v for v in measure(text))
    assert measure("you are a badword")[7] > 0 and measure("b@dw0rd here")[8] > 0 and measure("nastiest")[4] > 0


def test_query_on_held_out_rows(spark, sf):
    """The query itself: every document once, the folds by crc32, and held-out labels classed well on the documents at hand."""
    import zlib

    where = sf.replace("0.001", "0.1")
    rows = X.op3_toxicity_trees(spark, where).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id").collect())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    caught = [p for y, p in held if y == 1]
    assert sum(caught) >= 0.9 * len(caught) and sum(y == 1 for y, p in held if p) >= 0.9 * sum(p for _, p in held)


def test_row_without_id(spark, scratch):
    docs = spark.createDataFrame([(None, "some text"), (1, "other text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs.write.parquet(scratch.root + "/x/documents.parquet")
    labels.write.parquet(scratch.root + "/x/labels.parquet")
    assert {(r["doc_id"], r["held_out"]) for r in X.op3_toxicity_trees(spark, scratch.root + "/x").collect()} == {(None, False), (1, False)}
