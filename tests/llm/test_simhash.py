import re
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from kindred.llm import simhash as S


def naive(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def close(fp, radius=3):
    return [(i, int(j)) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= radius) + i + 1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aA bÉ\t\n\x0b\x1c\x85 ñZ"), max_size=40))
def test_fingerprint(text):
    assert int(S.fingerprint(text)[0]) == naive(text)


def test_long_text_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = S.fingerprint(text, words=4)
    monkeypatch.setattr(S, "_WORDS", 64)
    assert (S.fingerprint(text, words=4) == whole).all() and int(whole[0]) == naive(text)


def clustered(seed, groups=20, members=40, noise=400):
    draw = np.random.default_rng(seed)
    one = lambda n: np.uint64(1) << draw.integers(0, 64, n, dtype=np.uint64)
    near = [b ^ one(members) ^ one(members) for b in draw.integers(0, 2**64, groups, dtype=np.uint64)]
    return np.unique(np.concatenate([*near, draw.integers(0, 2**64, noise, dtype=np.uint64)]))


EXACT = np.full(65, 3)


def joined(n, i, j):
    return components(n, list(zip(i.tolist(), j.tolist())))


def test_index_finds_all_links():
    for seed in range(4):
        fp = clustered(seed)
        assert joined(len(fp), *S.GrayIndex(fp.reshape(-1, 1), EXACT).links((3,))) == components(len(fp), close(fp))


def test_led_indexes_find_all_links_and_prune(spark, sf):
    """Four indexes, each led by a chunk, over all fingerprints of the documents: upper nodes prune nearly all pairs, and no link is lost."""
    text = [r["text"] for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").collect()]
    fp = np.unique(np.concatenate([S.fingerprint(t) for t in text]))
    edges, looked = [], 0
    for k in range(4):
        index = S.GrayIndex(fp.reshape(-1, 1), EXACT, 0xFFFF << 16 * k)
        assert len(index.levels) >= 2
        i, j = index.links((3,))
        edges += list(zip(i.tolist(), j.tolist()))
        looked += (index.met - index.pruned) * S.FANOUT**2
        assert index.pruned > 0.7 * index.met
    assert components(len(fp), edges) == components(len(fp), close(fp))
    assert looked < len(fp) ** 2  # pairs compared in four indexes, leaves' and upper nodes' together


def test_dealt_buckets_lose_no_link(spark):
    fp = clustered(9)
    df = spark.createDataFrame([(int(v),) for v in fp.view(np.int64)], "id long")
    place = {int(v): k for k, v in enumerate(fp.view(np.int64))}
    for deal, target in ((10, 100), (20_000, 100), (20_000, 2048)):
        edges = S._searched(S._buckets(df, deal, target), 100, S._exact).collect()
        assert components(len(fp), [(place[e["src"]], place[e["dst"]]) for e in edges]) == components(len(fp), close(fp))


def test_rows_of_a_bucket_come_together(spark):
    import pyarrow as pa

    bucket, ids = np.sort(np.random.default_rng(1).integers(0, 50, 1000)), np.arange(1000)
    table = pa.table({"bucket": bucket, "id": ids})
    got = [rows["id"].tolist() for rows in S._per_bucket(iter(table.to_batches(max_chunksize=7)))]
    assert got == [ids[bucket == b].tolist() for b in range(50) if (bucket == b).sum() > 1]


def test_groups_against_brute_force(spark, odd, nothing, scratch, sf):
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        fp = np.array([naive(t) for _, t in rows], np.uint64)
        root, least = components(len(rows), close(fp)), defaultdict(list)
        for k, (d, _) in enumerate(rows):
            least[root[k]].append(d)
        want = sorted(((d, "%016x" % fp[k], min((x for x in least[root[k]] if x is not None), default=None)) for k, (d, _) in enumerate(rows)), key=str)
        got = [(r["doc_id"], "%016x" % (r["fp"] & (1 << 64) - 1), r["component_id"]) for r in S.near_groups(df, scratch).collect()]
        assert sorted(got, key=str) == want
    assert S.near_groups(nothing, scratch).count() == 0


def test_similarity_recall(spark, scratch):
    draw = np.random.default_rng(3)
    base = [[f"w{x}" for x in draw.integers(0, 5000, 200)] for _ in range(30)]
    rows = []
    for k, words in enumerate(base):
        rows.append((10 * k, " ".join(words)))
        for m in range(1, 4):
            changed = list(words)
            for at in draw.integers(0, 200, m):
                changed[at] = "changed"
            rows.append((10 * k + m, " ".join(changed)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in S.similar_groups(df, scratch).collect()}
    assert all(found[k] // 10 == k // 10 for k, _ in rows)  # nothing unlike is joined
    assert sum(found[k] == k // 10 * 10 for k, _ in rows) >= 0.97 * len(rows)
    kept = [r["doc_id"] for r in S.drop_near_copies(df, scratch).collect()]
    assert sorted(kept) == sorted(k for k, _ in rows if found[k] == k)


def test_links_are_direct_and_span():
    fp = clustered(2)
    i, j = S.GrayIndex(fp.reshape(-1, 1), EXACT).links((1, 3))
    assert (np.bitwise_count(fp[i] ^ fp[j]) <= 3).all()
    root = components(len(fp), close(fp))
    assert joined(len(fp), i, j) == root and len(i) == len(fp) - len(set(root))


def test_tolerated_differences():
    draw = np.random.default_rng(7)
    for bits in (4, 9, 16, 128):
        for miss in (0.05, 0.001):
            t = S.tolerated(bits, 0.15, miss)
            assert (draw.binomial(bits, 0.15, 200_000) > t).mean() <= 1.3 * miss + 1e-4
            assert t == 0 or (draw.binomial(bits, 0.15, 200_000) > t - 1).mean() > 0.7 * miss - 1e-4


def near_texts(seed, families, copies, words=120, most=4):
    draw, rows = np.random.default_rng(seed), []
    for f in range(families):
        base = [f"f{f}w{x}" for x in range(words)]
        for _ in range(copies):
            said = list(base)
            for at in draw.choice(words, int(draw.integers(0, most)), replace=False):
                said[at] = f"x{draw.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(said)))
    return rows


def truth(rows):
    sets = [set(S.shingle_set(t).tolist()) for _, t in rows]
    return [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def test_large_buckets_in_blocks(spark, scratch):
    """Groups far beyond the size from which buckets are divided: nothing is left out."""
    rows = near_texts(31, 3, 70) + [(210 + k, f"single text number {k} with its own words {' '.join(f's{k}v{x}' for x in range(30))}") for k in range(20)]
    found = {r["doc_id"]: r["component_id"] for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), scratch, deal=16, target=200).collect()}
    assert [found[k] for k in range(len(rows))] == components(len(rows), truth(rows))


def test_upper_nodes_prune_in_search_by_similarity(spark, scratch, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    entries = scratch.cut(S.wide_fingerprints(docs).groupBy("digest").agg(S.F.min("fp").alias("fp")).withColumn("id", S.F.monotonically_increasing_id()))
    search = S.Search(entries, S.bit_share(0.8))
    rows = search.dealt(entries.select("id", "fp")).orderBy("bucket").toPandas()
    for _, part in rows.groupby("bucket"):
        index = S.GrayIndex(S._sketch({c: part[c].to_numpy() for c in part.columns}), search.limits)
        index.links(search.radii)
        assert len(index.levels) >= 2 and index.pruned > 0.3 * index.met


def test_recall_on_many_pairs(spark, scratch):
    """Thousands of distinct pairs from 0.8 on, each in a family of its own."""
    draw, rows = np.random.default_rng(41), []
    for f in range(3000):
        words = [f"f{f}w{x}" for x in range(int(draw.integers(60, 200)))]
        rows.append((2 * f, " ".join(words)))
        for at in draw.choice(len(words), int(draw.integers(1, max(2, len(words) // 45 + 1))), replace=False):
            words[at] = "changed"
        rows.append((2 * f + 1, " ".join(words)))
    sets = [set(S.shingle_set(t).tolist()) for _, t in rows]
    alike = [len(sets[2 * f] & sets[2 * f + 1]) / len(sets[2 * f] | sets[2 * f + 1]) for f in range(3000)]
    true = [f for f in range(3000) if alike[f] >= 0.8]
    found = {r["doc_id"]: r["component_id"] for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert len(true) > 2000 and min(alike[f] for f in true) < 0.83
    assert sum(found[2 * f] == found[2 * f + 1] for f in true) >= 0.99 * len(true)
    assert all(found[2 * f] != found[2 * f + 1] for f in range(3000) if alike[f] < 0.8)


def test_only_the_copy_goes(spark, scratch):
    """Rows that share a doc_id, or have none, go by their shingle sets."""
    a, b = " ".join(f"a{x}" for x in range(60)), " ".join(f"b{x}" for x in range(60))
    rows = [(1, a), (5, a + " more"), (5, b), (None, a + " other"), (None, "no copy of anything at all here"), (7, b + " more"), (8, a + " once")]
    kept = S.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)


def test_a_failed_centre_hides_no_link(spark, scratch):
    """1-2 and 2-4 are alike, 1-4 are not, and 2-3 and 3-4 were proposed first."""
    base = [f"w{x}" for x in range(100)]
    one, two = list(base), list(base)
    one[20] = "x1"
    four = list(base)
    four[70] = "y1"
    rows = [(1, " ".join(one)), (2, " ".join(base)), (4, " ".join(four))]
    rows += [(k, " ".join(two[: 100 - k] + [f"z{k}v{x}" for x in range(k)])) for k in range(18, 40)]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    found = {r["doc_id"]: r["component_id"] for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert [found[k] for k in range(len(rows))] == components(len(rows), truth(rows))


def test_links_are_verified_on_sets(spark, scratch):
    sets = {1: range(100), 2: range(4, 104), 3: range(96, 196), 4: [*range(95), *range(200, 205)], 5: [], 6: []}
    told = scratch.cut(spark.createDataFrame([(k, list(v)) for k, v in sets.items()], "id long, grams array<long>"))
    # 4 was proposed with 3 only, which is unlike; it is like 1, the most linked entry, and is held against that.
    proposed = scratch.cut(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (1, 7)], "src long, dst long"))
    more = scratch.cut(spark.createDataFrame([(1, 2), (1, 8), (3, 4), (2, 3)], "src long, dst long"))
    told = scratch.cut(told.unionByName(spark.createDataFrame([(8, list(range(100)))], "id long, grams array<long>")))
    assert {tuple(r) for r in S.verified_links(proposed, told, scratch).collect()} == {(1, 2), (1, 4), (5, 6)}
    assert {tuple(r) for r in S.verified_links(more, told, scratch).collect()} == {(1, 2), (1, 8), (1, 4)}
    assert S.verified_links(scratch.cut(proposed.where("src < 0")), told, scratch).count() == 0


def test_drop_near_copies_on_odd_rows(odd, nothing, scratch):
    kept = S.drop_near_copies(odd, scratch)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {1, 4, 7, 10, 11, 12} <= set(ids) and not {2, 3, 5, 6, 8} & set(ids) and ids.count(None) == 1
    assert S.drop_near_copies(nothing, scratch).count() == 0


def test_equal_fingerprints_are_verified(spark, scratch):
    draw = np.random.default_rng(5)
    line = " ".join(f"line{k}" for k in range(7))
    rows = [(k, " ".join([line] * 300 + [f"w{x}" for x in draw.integers(0, 10**6, 200)])) for k in (1, 2)]  # one line sets every bit
    assert (S.fingerprint(rows[0][1], 5, S.WIDE) == S.fingerprint(rows[1][1], 5, S.WIDE)).all()
    found = S.similar_groups(spark.createDataFrame([*rows, (3, rows[0][1] + " " + line)], "doc_id long, text string"), scratch)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {1: 1, 2: 2, 3: 1}


def test_failed_links_hide_no_true_one(spark, scratch):
    draw = np.random.default_rng(11)
    rows = []
    for family in range(4):  # texts of one template: most pairs lie within the radius, few have the similarity
        base = [f"f{family}w{x}" for x in range(120)]
        for k in range(60):
            words = list(base)
            for at in draw.choice(120, int(draw.integers(2, 4)), replace=False):
                words[at] = f"x{draw.integers(0, 10**9)}"
            rows.append((family * 60 + k, " ".join(words)))
    found = {r["doc_id"]: r["component_id"] for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    true = truth(rows)
    assert len(true) > 20
    assert [found[k] for k in range(len(rows))] == components(len(rows), true)


def test_repeats_hide_no_near_copy(spark, scratch):
    draw = np.random.default_rng(17)
    lines = [" ".join(f"w{x}" for x in draw.integers(0, 10**6, 12)) for _ in range(20)]
    rows = [(1, " ".join(lines)), (2, " ".join(lines + [lines[3]] * 60)), (3, " ".join(lines + [lines[9]] * 60))]
    sets = [set(S.shingle_set(t).tolist()) for _, t in rows]
    assert min(len(sets[0] & s) / len(sets[0] | s) for s in sets) >= 0.8
    found = S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), scratch)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {1: 1, 2: 1, 3: 1}


def test_short_near_copies(spark, scratch):
    draw = np.random.default_rng(23)
    rows = []
    for k in range(150):  # four of five shingles
        words = [f"w{x}" for x in draw.integers(0, 10**6, 9)]
        rows += [(2 * k, " ".join(words[:8])), (2 * k + 1, " ".join(words))]
    assert abs(S.small_share() - 0.1875) < 1e-9
    found = {r["doc_id"]: r["component_id"] for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert all(found[k] // 2 == k // 2 for k in found)
    assert sum(found[2 * k] == found[2 * k + 1] for k in range(150)) >= 0.95 * 150


def template_texts(seed, families, copies, words=120, least=2, most=4):
    draw, rows = np.random.default_rng(seed), []
    for f in range(families):
        base = [f"f{f}w{x}" for x in range(words)]
        for _ in range(copies):
            said = list(base)
            for at in draw.choice(words, int(draw.integers(least, most)), replace=False):
                said[at] = f"x{draw.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(said)))
    return rows


def test_pairs_of_a_family_are_no_rows(spark, scratch, monkeypatch):
    """Texts a little below the similarity to each other: no table has a row for each pair of them."""
    rows = template_texts(43, 1, 200, words=215, least=3, most=4)
    written, cut = [], type(scratch).cut

    def counted(self, df, **options):
        out = cut(self, df, **options)
        written.append(out.count())
        return out

    monkeypatch.setattr(type(scratch), "cut", counted)
    found = {r["doc_id"]: r["component_id"] for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert [found[k] for k in range(len(rows))] == components(len(rows), truth(rows))
    assert max(written) <= 10 * len(rows)


def test_large_open_groups_by_samples(spark, scratch):
    """Groups beyond ``target`` are searched by samples, those beyond ``deal`` in blocks."""
    rows = template_texts(47, 3, 80)
    true = truth(rows)
    assert len(true) > 20
    for deal in (1 << 16, 24):
        found = {r["doc_id"]: r["component_id"] for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), scratch, deal=deal, target=60).collect()}
        assert [found[k] for k in range(len(rows))] == components(len(rows), true)


def test_similarity_from_what_sets_apart(monkeypatch):
    """Told from deltas to one set as from the sets themselves, by bits and by look-up."""
    draw = np.random.default_rng(53)
    base = set(draw.integers(-(2**62), 2**62, 90).tolist())
    sets = [set(), set()]
    for k in range(60):
        kept = [x for x in sorted(base) if draw.random() > 0.06]
        sets.append({*kept, *draw.integers(0, 60, int(draw.integers(0, 12))).tolist()})
    size = np.array([len(s) for s in sets])
    i, j = np.triu_indices(len(sets), 1)
    want = [len(sets[a] | sets[b]) == 0 or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 for a, b in zip(i, j)]
    assert 0.1 < np.mean(want) < 0.9
    for room in (1 << 26, 0):
        monkeypatch.setattr(S, "_BITS", room)
        for centre in (base, set()):
            delta = np.empty(len(sets), object)
            delta[:] = [np.array(sorted(s ^ centre), np.int64) for s in sets]
            assert S._alike_rows(size, delta, 0.8)(i, j).tolist() == want
