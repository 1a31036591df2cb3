import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from kindred.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return bpe.Bpe(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(own, text):
    return list(memoryview(own.encode(text)).cast("i"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"ab 'sl1!?\n\t\r_", "é", "日", "😀", "٣", " ", "​", "̀", "\x1c", "\x85", "\0", "<|endoftext|>", "the", "ing"]), max_size=30).map("".join))
def test_same_as_library(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(own, text) == want
    assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_forced_boundaries_are_certain(own):
    vocabulary = set(own.token.values())
    for text in ("zqxj", "日本語テキスト", "a" * 500, "xX" * 50):
        cut = own.cut(text.encode())
        assert b"".join(cut) == text.encode()
        for left, right in zip(cut, cut[1:]):
            assert not any(left[-1:] + right[:1] in t for t in vocabulary if t != b"<|endoftext|>")


def test_bounded_cache(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    text = " ".join(f"word{i}" for i in range(200)) * 2
    assert ids(own, text) == library.encode(text, add_special_tokens=False).ids


def test_tables(spark, odd, nothing, library, scratch):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    want = {(d, t): library.encode(t, add_special_tokens=False).ids for d, t in rows}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted(map(tuple, bpe.digests(bpe.encode_decode(odd, PATH)).collect()), key=str)
    assert got == sorted(((d, len(want[d, t]), sha(",".join(map(str, want[d, t]))), sha(t)) for d, t in rows), key=str)
    # Without common pre-tokens all go through the shuffle; with many allowed, all but those that occur once are broadcast.
    for common in (0, 20, 500_000):
        counted = sorted(map(tuple, bpe.count_tokens(odd, PATH, scratch, common).collect()), key=str)
        assert counted == sorted(((d, len(t.encode()), len(want[d, t])) for d, t in rows), key=str)
    assert bpe.encode_decode(nothing, PATH).count() == 0 and bpe.count_tokens(nothing, PATH, scratch).count() == 0


def test_hot_long_pre_tokens(spark, library, scratch):
    """A rule of eighty signs in every document, and a text that looks like a digest of it."""
    rule = "=" * 80
    rows = [(k, f"{rule}\n{'x' * 100} {k}") for k in range(50)] + [(99, "#" + hashlib.sha256(rule.encode()).hexdigest()), (100, "y" * 64), (101, "y" * 65)]
    got = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH, scratch, 20).collect()}
    assert got == {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in rows}


def test_queries_on_whole_tables(spark, sf, library):
    """Both queries against the library on every document."""
    where = sf.replace("0.001", "0.01")
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in docs.items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    counted = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in bpe.op7_token_counts(spark, where).collect()}
    assert counted == {d: (len(docs[d].encode()), len(ids), len(ids) > 512) for d, ids in want.items()}
    digests = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op6_bpe_forced_boundaries(spark, where).collect()}
    assert digests == {d: (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))) for d, ids in want.items()}


def test_most_frequent_rows(spark):
    from kindred.llm.counts import frequent_from

    rows = spark.createDataFrame([(n,) for n in (1, 1, 1, 2, 2, 5, 5, 90, 1000)], "n long")
    assert [frequent_from(rows, k) for k in (0, 1, 2, 3, 4, 5, 6, 8, 9)] == [1001, 1000, 90, 90, 5, 5, 2, 2, 1]
    assert frequent_from(rows.limit(0), 5) == 1
