import random

from kindred.llm import decontaminate as D


def least_edits(item, text):
    row, best = list(range(len(item) + 1)), len(item)
    for ch in text:
        new = [0]
        for i, c in enumerate(item):
            new.append(min(row[i] + (c != ch), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def mutated(text, edits, draw):
    text = list(text)
    for _ in range(edits):
        at, what = draw.randrange(len(text)), draw.random()
        if what < 0.4:
            text[at] = draw.choice("xyzé")
        elif what < 0.7:
            del text[at]
        else:
            text.insert(at, draw.choice("xyz "))
    return "".join(text)


def test_lemma_and_alignment_against_edit_distance(spark, sf):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    around = [D.plain(r["text"])[:300] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(50).collect()]
    index, draw = D.GramIndex(items), random.Random(5)
    found = 0
    for _ in range(60):
        k = draw.randrange(len(items))
        item = D.plain(items[k][1])
        text = D.plain(f"{draw.choice(around)} {mutated(item, int(len(item) * draw.choice((0, 0.03, 0.06, 0.08, 0.1))), draw)} {draw.choice(around)}")
        want, got = least_edits(item, text), index.matches(text)
        assert (want <= index.edits[k]) == (k in got)
        if k in got:
            found += 1
            assert got[k][0] == want
    assert found > 20


def test_windows_short_items_and_ends():
    items = [(1, "short"), (2, "A sentence of  middling length, nothing more."), (3, "  "), (4, "q" * 40)]
    index = D.GramIndex(items)
    text = D.plain("x" * 50 + "a SENTENCE of middling length, nothing more.")
    assert index.matches(text) == {1: (0, len(text))}
    assert set(index.matches(D.plain("this is short"))) == {0}
    far = "word " * 200_000 + items[1][1] + " tail" * 10
    assert set(index.matches(D.plain(far))) == {1}
    assert index.matches("") == {} and D.GramIndex([]).matches("anything at all") == {}


def test_tables(spark, odd, nothing, scratch):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon", "x"), (1, "alpha beta gamma delta epsilon", "x"), (2, None, "x"), (3, "not there at all, really", "x"), (4, "", "x")], "item_id long, text string, doc_id string")
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in D.contaminated(odd, bench, scratch).collect()) == [(1, 1, 0), (2, 1, 0), (3, 1, 0)]
    kept = D.drop_contaminated(odd, bench, scratch)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert D.contaminated(nothing, bench, scratch).count() == 0 and D.contaminated(odd, bench.limit(0), scratch).count() == 0 and D.drop_contaminated(odd, bench.limit(0), scratch).count() == odd.count()


def test_blocks_of_items(spark):
    bench = spark.createDataFrame([(k, "t" * 10) for k in range(10)], "item_id long, text string")
    assert [len(b) for b in D.blocks(bench, 35)] == [3, 3, 3, 1]


def test_several_blocks(spark, sf, scratch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(D.contaminated(docs, bench, scratch))
    assert len(list(D.blocks(bench, 4000))) > 2 and rows(D.contaminated(docs, bench, scratch, limit=4000)) == want
    ids = {r[0] for r in want}
    assert sorted(r["doc_id"] for r in D.drop_contaminated(docs, bench, scratch, limit=4000).collect()) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] not in ids)


def test_index_of_a_full_block_is_small():
    import pickle

    draw = random.Random(3)
    size = 200_000
    index = D.GramIndex([(k, "".join(draw.choices("abcdefghij klmnop", k=400))) for k in range(size // 400)])
    assert len(pickle.dumps(index, 5)) * D.BLOCK_CHARS / size <= 110e6  # with the sparse table that only small indexes have


def test_query_against_plain_search(spark, sf):
    """Every document that holds an item word for word is found, and what is found is within the item's edits."""
    docs = {r["doc_id"]: D.plain(r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: D.plain(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]): r for r in D.op10_benchmark_qgram(spark, sf).collect()}
    assert {(d, i) for d, t in docs.items() for i, x in items.items() if x in t} <= set(found)
    for (d, i), r in found.items():
        near = docs[d][max(r["end"] - len(items[i]) - 60, 0) : r["end"] + 5]
        assert least_edits(items[i], near) == r["distance"] <= len(items[i]) * D.RATE
