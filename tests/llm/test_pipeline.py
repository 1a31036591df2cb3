import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from kindred.llm import decontaminate as D, toxicity as X


def test_stages_against_brute_force(spark, sf, scratch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(scratch.cut(stage(spark, steps[-1], sf)))
    assert all(s.columns == columns for s in steps[:-1])
    ids = [{r["doc_id"]: r["text"] for r in s.select("doc_id", "text").collect()} for s in steps[:-1]]
    scores = {r["doc_id"]: r["score"] for r in X.score(docs, spark.read.parquet(f"{sf}/labels.parquet"), scratch).collect()}
    assert set(ids[1]) == {d for d, s in scores.items() if s < X.THRESHOLD}
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for d in sorted(ids[1]):
        first.setdefault(plain(ids[1][d]), d)
    assert set(ids[2]) == set(first.values())

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}

    sets = {d: shingles(t) for d, t in ids[2].items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for d in set(ids[2]) - set(ids[3]):  # whatever goes has a near copy that is older
        assert max(alike(d, o) for o in ids[2] if o != d) >= 0.8
    kept = sorted(ids[3])
    assert not [(a, b) for k, a in enumerate(kept) for b in kept[k + 1 :] if alike(a, b) >= 0.8]
    bench = [D.plain(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = {d for d, t in ids[3].items() if any(b in D.plain(t) for b in bench)}
    assert not holds & set(ids[4]) and len(set(ids[3]) - set(ids[4]) - holds) <= 1
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in steps[-1].collect():
        want = library.encode(ids[4][r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert steps[-1].count() == len(ids[4])


def test_odd_rows_pass_through(spark, odd, nothing, sf):
    for df in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, sf).columns == df.columns
            stage(spark, df, sf).count()
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, sf).count() == 0


def test_registered():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
