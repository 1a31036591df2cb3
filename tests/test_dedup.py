import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import augment as A, blocking as B, entities as E, evaluate as M, features as P, labels as L, matcher as X, pairs as J, profile as R
from kindred.operators.cleaning import add_script, build_dataset, clean_dataset, preprocess_names, split_by_label
from kindred.operators.graph import connected_components
from kindred.plans import dedup
from kindred.plans.service import Engine, search_index
from kindred.sources import tables as T
from kindred.streaming import ingest

PEOPLE = [
    ("r1", "arm", "Иван Петров", "u1"), ("r2", "arm", "Petrov Ivan", "u1"), ("r3", "arm", "IVAN PETROV!", "u1"), ("r4", "kaz", "Ivan Petrov", None), ("r5", "arm", "ООО Ромашка", None), ("r6", "arm", "Romashka LLC", None),
    ("r7", "arm", "unknown", None), ("r8", "arm", None, None), ("r9", "arm", "X", None), ("r10", "arm", "ანა", None),
]


@pytest.fixture(scope="module")
def people(spark):
    raw = T.rows_table(spark, [dict(zip(("record_id", "country", "party_name", "party_public_id"), p)) for p in PEOPLE])
    table = T.with_index(raw.withColumn("n", F.regexp_extract("record_id", r"(\d+)", 1)), "n").drop("n")
    return preprocess_names(add_script(table)).cache()


def test_cleaning(spark, people):
    raw = people.select(*[f.name for f in T.RELATIONS.fields])
    assert {r["record_id"] for r in build_dataset(raw).collect()} == {"r1", "r2", "r3", "r4", "r5", "r6"}
    assert {r["record_id"] for r in clean_dataset(raw).collect()} >= {"r1", "r7", "r10"}
    train, search = split_by_label(raw)
    assert (train.count(), search.count()) == (3, 7)


def test_block_keys(people):
    got = {r["record_id"]: r for r in B.make_block_keys(people).collect()}
    assert got["r2"]["block_prefix_4"] == "petr" and got["r2"]["block_first_token_len"] == "petr_2" and got["r2"]["block_sorted_tokens"] == "ivan petrov"
    assert got["r8"]["block_prefix_4"] == "unknown" and got["r8"]["block_prefix_len"] == "unknown_0" and got["r8"]["block_sorted_tokens"] == ""


@pytest.mark.parametrize(("n", "pairs"), [(1, 0), (2, 1), (500, 124750), (501, 0)])
def test_block_sizes_at_the_limit(spark, n, pairs):
    df = spark.range(n).select(F.col("id").alias("idx"), F.lit("k").alias("block_prefix_len"))
    assert B.candidate_pairs(df, ["block_prefix_len"]).count() == pairs


def test_pairs_once_whatever_the_pass(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, None, None)], "idx long, p string, q string")
    assert sorted(map(tuple, B.candidate_pairs(df, ["p", "q"]).collect())) == [(1, 2), (1, 3), (2, 3)]
    assert B.block_pairs(df, ["p", "q"]).count() == 4
    twice = spark.createDataFrame([(2, 1), (1, 2), (1, 3)], "idx1 long, idx2 long")
    assert sorted(map(tuple, B.deduplicate_pairs(twice).collect())) == [(1, 2), (1, 3)]
    one = B.reduction_ratio(df.limit(1), "p").first()
    assert one["reduction_ratio"] is None


def test_stop_blocks(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(["firm_2", "trade", "abcd", "abcd", "abcd", "", None])], "idx long, k string")
    got = {r["block_value"]: (r["is_large_block"], r["is_generic_block"]) for r in B.stop_blocks(df, "k", 2).collect()}
    assert got == {"firm_2": (False, True), "trade": (False, True), "abcd": (True, False), "": (False, True)}
    assert B.filter_stop_blocks(df, "k", B.stop_blocks(df, "k", 2)).count() == 1
    assert B.summarize_stop_blocks(B.stop_blocks(df, "k", 2)).first()["stop_blocks"] == 4


def test_components_against_union_find(spark):
    draw = random.Random(4)
    for n, m in ((60, 40), (60, 70), (5, 0)):
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + ([(k, k + 1) for k in range(200, 240)] if m else [])
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            if a != b:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        df = spark.createDataFrame([*edges, (None, 1)], "src long, dst long")
        assert {r["node"]: r["component"] for r in connected_components(df).collect()} == {x: find(x) for x in list(root)}


def test_cluster_numbers_and_singles(spark):
    edges = spark.createDataFrame([(9, 5), (2, 3), (3, 4), (4, 7)], "idx1 long, idx2 long")
    got = {r["idx"]: (r["entity_id"], r["cluster_size"]) for r in E.build_clusters(edges).collect()}
    assert got == {2: ("entity_00000000", 4), 3: ("entity_00000000", 4), 4: ("entity_00000000", 4), 7: ("entity_00000000", 4), 5: ("entity_00000001", 2), 9: ("entity_00000001", 2)}
    rows = spark.createDataFrame([(1,), (2,)], "idx long")
    assert {r["idx"]: (r["entity_id"], r["cluster_size"]) for r in E.attach_clusters(rows, E.build_clusters(edges)).collect()} == {1: ("single_1", 1), 2: ("entity_00000000", 4)}
    assert E.build_clusters(edges.limit(0)).count() == 0


def test_whole_batch(spark, people, tmp_path):
    deduplicated, entities = dedup.run_batch(people, str(tmp_path / "run"))
    by = {r["record_id"]: r["entity_id"] for r in deduplicated.collect()}
    assert by["r1"] == by["r2"] == by["r3"] != by["r4"] and by["r5"] == by["r6"] and by["r8"] == "single_8" and by["r7"].startswith("single")
    first = {r["entity_id"]: r for r in entities.collect()}[by["r1"]]
    assert first["canonical_name"] == "ivan petrov" and first["cluster_size"] == 3 and first["record_ids"] == ["r1", "r2", "r3"] and first["normalized_names"] == ["ivan petrov", "petrov ivan"]
    again = dedup.run_batch(people.limit(0), str(tmp_path / "run"))
    assert again[0].count() == 10  # finished stages are read
    assert T.export_deduplicated(deduplicated).columns[-1] == "canonical_name" and "is_singleton" in T.export_entities(entities).columns
    T.write_csv(T.export_entities(entities), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert text.startswith("﻿entity_id".encode())


def test_empty_input(spark, people):
    deduplicated, entities = dedup.clusters_from_edges(people, dedup.duplicate_edges(people.limit(0)))
    assert {r["entity_id"] for r in deduplicated.collect()} == {f"single_{k}" for k in range(1, 11)} and entities.count() == 10


def test_lists_and_flags(spark):
    rows = [(k, "e", f"n{k % 25:02d}", f"c{k % 4}") for k in range(50)] + [(99, "s", "x", None)]
    df = spark.createDataFrame(rows, "idx long, entity_id string, name_latin string, country string").withColumns({
        "record_id": F.col("idx").cast("string"), "party_name": F.col("name_latin"), "canonical_name": F.col("name_latin"), "script": F.lit(None).cast("string"), "relation_kind": F.lit("k"), "relation_role": F.lit("r"), "company_public_id": F.lit(None).cast("string")})
    got = {r["entity_id"]: r for r in E.quality_flags(E.canonical_entities(df)).collect()}
    assert got["e"]["normalized_names"] == [f"n{k:02d}" for k in range(20)] and got["e"]["canonical_name"] == "n00" and got["e"]["companies"] == [] and got["e"]["canonical_script"] is None
    assert [got["e"][c] for c in ("is_singleton", "is_large_cluster", "has_many_names", "has_many_countries", "is_suspicious_entity")] == [0, 1, 1, 1, 1]
    assert got["s"]["is_singleton"] == 1 and got["s"]["unique_countries_count"] == 0


def test_features(spark):
    df = spark.createDataFrame([("ivan petrov llc", "petrov ivan", "RU", None), (None, None, None, None), ("a b", "a b", "RU", "RU")], "name_latin_1 string, name_latin_2 string, country_1 string, country_2 string")
    a, b, c = P.pair_features(df).collect()
    assert (a["has_legal_form_1"], a["same_legal_form"], a["core_token_sort_ratio"], a["core_exact_match"], a["same_country"], a["token_count_diff"]) == (1, 0, 100, 0, 0, 1)
    assert (b["exact_match"], b["token_jaccard"], b["fuzz_ratio"], b["token_set_ratio"]) == (1, 1, 100, 0) and c["same_country"] == 1
    assert set(P.feature_columns()) <= set(P.pair_features(df).columns) and len(P.model_feature_columns()) == 26


def test_models(spark, tmp_path):
    draw = random.Random(2)
    rows = [(f"name {draw.choice('abcdef')}{k}", f"name {draw.choice('abcdef')}{k if k % 2 else k + 1000}", k % 2) for k in range(200)]
    told = P.pair_features(spark.createDataFrame(rows, "name_latin_1 string, name_latin_2 string, label int"))
    for train in (X.train_logistic_regression, lambda d: X.train_random_forest(d, trees=10, depth=4, leaf=2)):
        model = train(told)
        scored = X.model_scorer(model)(told)
        got = M.metrics(scored.withColumn("prediction", F.col("duplicate_prediction"))).first()
        assert got["accuracy"] > 0.9 and X.feature_importance(model).count() == 26
    T.save_model(model, str(tmp_path / "m"))
    assert T.load_model(str(tmp_path / "m")).transform(told).count() == 200


def test_edges(spark):
    df = spark.createDataFrame([(2, 1, 0.9), (1, 2, 0.95), (3, 4, 0.9)], "idx1 long, idx2 long, duplicate_score double")
    assert sorted(map(tuple, X.deduplicate_edges(df).collect())) == [(1, 2, 0.95), (3, 4, 0.9)]
    assert E.duplicate_edges(df, 0.9).count() == 3  # the threshold itself counts


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 1, 0.4), (0, 0, 0.1)], "label int, prediction int, score double")
    got = M.metrics(df).first()
    assert (got["precision"], got["recall"], got["f1"], got["accuracy"]) == (0.5, 0.5, 0.5, 0.5)
    assert M.roc_auc(df).first()[0] == 0.875 and M.roc_auc(df.where("label = 1")).first()[0] is None
    none = M.metrics(df.where("label = 0 and prediction = 0")).first()
    assert none["precision"] == none["recall"] == none["f1"] == 0
    assert len(M.sweep_thresholds()) == 18 and M.sweep_thresholds()[-1] == 0.95
    assert M.best_baseline(M.threshold_grid(df, ["score"], [0.2, 0.5])).count() == 1
    gold = spark.createDataFrame([("1", "a", "a"), ("0", "a", "b"), ("unsure", "a", "a"), ("", "a", "a"), (None, "a", "a")], "manual_label string, left_cluster_id string, right_cluster_id string")
    assert M.metrics(M.cluster_predictions(M.gold_pairs(gold)), "gold").first()["f1"] == 1
    names = spark.createDataFrame([("ivan petrov", "petrov ivan"), ("ivan petrov", "ivan petrof"), ("ivan x", "ivan zzzzzz"), ("abc", "xyz"), ("same", "same")], "left_name_latin string, right_name_latin string")
    assert [r[0] for r in names.select(M.error_category()).collect()] == ["token_order_variation", "transliteration_variation", "same_first_name", "other", "near_exact_match"]


def test_training_pairs(spark, people):
    rows = spark.range(400).select(F.col("id").alias("idx"), F.concat(F.lit("u"), F.col("id") % 3).alias("party_public_id"), F.concat(F.lit("name "), F.col("id") % 40).alias("name_latin"), F.lit("n").alias("party_name"))
    good = J.positive_pairs(rows)
    assert {r["n"] for r in good.join(rows.select(F.col("idx").alias("idx1"), "party_public_id"), "idx1").groupBy("party_public_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {50}
    easy = J.easy_negative_pairs(rows, 100)
    assert easy.count() == 100 and easy.where((F.col("idx1") - F.col("idx2")) % 3 == 0).count() == 0
    hard = J.hard_negative_pairs(rows)
    assert hard.count() > 0 and hard.where("name_similarity < 80").count() == 0
    pairs = J.make_pair_key(J.attach_records(good.unionByName(hard.drop("name_similarity")), rows))
    more = A.augment_pairs(pairs, 20, 20)
    assert {r["pair_type"]: r["n"] for r in more.groupBy("pair_type").agg(F.count(F.lit(1)).alias("n")).where("pair_type like 'augmented%'").collect()} == {"augmented_positive": 20, "augmented_hard_negative": 20}
    assert sorted(map(tuple, more.collect())) == sorted(map(tuple, A.augment_pairs(pairs, 20, 20).collect()))
    groups = J.split_by_group(J.remove_duplicate_pairs(pairs).withColumn("entity_group", J.entity_group()))
    assert groups.groupBy("entity_group").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert J.pair_summary(pairs).count() == 2
    names = spark.createDataFrame([("a b",), ("a b c",), ("a b c d",), (None,)], "s string")
    assert [r[0] for r in names.select(A.drop_patronymic(F.coalesce("s", F.lit("")))).collect()] == ["a b", "a b", "a b c", ""]


def test_labels(spark):
    rows = spark.createDataFrame([(1, "u", "ivan petrov", "arm", "latin"), (2, "u", "petrov ivan", "kaz", "latin"), (3, "v", "anna", "arm", "latin"), (4, None, "x", "arm", "latin")], "idx long, party_public_id string, name_latin string, country string, script string")
    stats = L.mark_trusted(L.label_stats(rows).join(L.label_similarity(rows), "party_public_id"), names=1)
    got = {r["party_public_id"]: r for r in stats.collect()}
    assert got["u"]["avg_name_similarity"] == 100 and not got["u"]["is_trusted"] and got["v"]["is_trusted"] and got["v"]["min_name_similarity"] == 100
    assert L.suspicious_labels(stats).count() == 1 and L.cross_language_like(stats).count() == 0 and L.label_summary(stats).first()["ids"] == 2


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "b", 45.0), (2, None, None)], "k long, s string, v double")
    assert {r["column"]: r["nulls"] for r in R.null_profile(df).collect()} == {"k": 0, "s": 1, "v": 1}
    assert {r["bucket"]: r["n"] for r in R.histogram(df, "v", 0.0, 40.0, 4).collect()} == {1: 1, 4: 1}
    assert R.duplicate_flags(df, "s").where("is_duplicate").count() == 0 and R.duplicate_flags(df, "k").where("is_duplicate").count() == 2


def test_banded_pairs(spark):
    names = ["anna", "anne", "boris", "borys", "zoe"]
    df = spark.createDataFrame(list(enumerate(names)), "idx long, name_latin string")
    got = {tuple(sorted((r["idx1"], r["idx2"]))) for r in B.banded_pairs(df, band=2, least=0.7).collect()}
    assert got == {(0, 1), (2, 3)}


def test_service(spark, people):
    engine = Engine(spark, people)
    found = engine.search({"party_name": "Ivan PETROV", "country": "arm"}, 3).collect()
    assert found[0]["name_latin_2"] == "ivan petrov" and found[0]["similarity_score"] == 1.0 and len({r["name_latin_2"] for r in found}) == len(found)
    assert engine.search({"party_name": "no such name"}).count() == 0 and engine.status()["records"] == 10
    with pytest.raises(ValueError):
        engine.search({"party_name": "x"}, 0)
    assert engine.check_duplicate({"party_name": "Иван Петров"}, {"party_name": "ivan petrov"}) == {"duplicate_probability": 1.0, "is_duplicate": True}
    assert engine.check_duplicate({"party_name": "unknown"}, {"party_name": "unknown"})["duplicate_probability"] == 0
    rows, entities = engine.deduplicate([{"party_name": "Anna Ivanova"}, {"party_name": "Ivanova Anna"}, {"party_name": "Other"}])
    assert entities.count() == 2 and T.to_response(rows.orderBy("idx"))[0]["record_id"] == "batch_record_0"


def test_sources(spark, tmp_path):
    assert T.read_edges(spark, [str(tmp_path / "none")]).count() == 0
    edges = spark.createDataFrame([(1, 2, 0.9)], T.EDGES)
    T.write_parquet(edges, str(tmp_path / "e"))
    assert T.read_edges(spark, [str(tmp_path / "e"), str(tmp_path / "none")]).count() == 1
    (tmp_path / "gold.csv").write_text("label,left_country,right_country,left_party_name,right_party_name,left_name_latin,right_name_latin,left_cluster_id,right_cluster_id,manual_label\n1,a,a,x,y,x,y,c,c,unsure\n")
    assert T.read_gold(spark, str(tmp_path / "gold.csv")).first()["manual_label"] == "unsure"
    assert T.conform(spark.createDataFrame([(1,)], "country int")).schema["country"].dataType.simpleString() == "string"


def test_stream(spark, people, tmp_path):
    T.rows_table(spark, [{"record_id": "77", "party_name": "Petrov, Ivan"}]).write.parquet(str(tmp_path / "in"))
    ingest.stream_matches(spark, str(tmp_path / "in"), B.make_block_keys(people), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["idx"] for r in got} == {77} and {r["idx_known"] for r in got} >= {1, 2, 3, 4}


def test_mutations(spark):
    df = spark.createDataFrame([(k, n) for k in range(60) for n in ("ivan petrov llc", "abc", "қам ҳоз", "one two three", "", None)], "k long, s string")
    at = lambda f: {(r[0], r[1] or ""): r[2] for r in df.select("k", "s", f(F.coalesce("s", F.lit("")), F.col("k"))).collect()}
    for (_, s), got in at(A.delete_char).items():
        assert got == s if len(s) <= 3 else got in {s[:i] + s[i + 1 :] for i in range(len(s))}
    for (_, s), got in at(A.swap_chars).items():
        assert got == s if len(s) <= 3 else got in {s[:i] + s[i + 1] + s[i] + s[i + 2 :] for i in range(len(s) - 1)}
    assert {g for (_, s), g in at(A.national_char).items() if s == "қам ҳоз"} == {"kам ҳоз", "қам hоз"} and {g for (_, s), g in at(A.national_char).items() if s == "abc"} == {"abc"}
    assert {g for (_, s), g in at(A.swap_words).items() if s == "one two three"} == {"two one three", "three two one", "one three two"}
    assert {g for (_, s), g in at(A.drop_word).items() if s == "one two three"} == {"two three", "one three", "one two"} and {g for (_, s), g in at(A.drop_word).items() if s == "abc"} == {"abc"}
    assert {g for (_, s), g in at(A.drop_legal_form).items() if s == "ivan petrov llc"} == {"ivan petrov"}
    assert {g for (_, s), g in at(A.change_case).items() if s == "abc"} == {"ABC", "Abc"} and {g for (_, s), g in at(A.add_legal_form).items() if s == ""} == {""}
    assert len({g for (_, s), g in at(A.add_suffix).items() if s == "abc"}) == 12
    out = df.select(A.mutated("s", "k", A.POSITIVE)).collect()
    assert all(r[0] is not None for r in out) and len({r[0] for r in out}) > 20


def test_pairs_of_all_members(spark):
    rows = spark.range(3000).select(F.col("id").alias("idx"), F.when(F.col("id") < 2900, "hot").when(F.col("id") < 2905, "five").otherwise(F.col("id").cast("string")).alias("party_public_id"))
    got = J.positive_pairs(rows).collect()
    five = {(r["idx1"], r["idx2"]) for r in got if r["idx1"] >= 2900}
    hot = [(r["idx1"], r["idx2"]) for r in got if r["idx1"] < 2900]
    assert five == {(a, b) for a in range(2900, 2905) for b in range(a + 1, 2905)} and len(set(hot)) == 50 and len({x for p in hot for x in p}) > 80
    assert J.easy_negative_pairs(rows, 500).distinct().count() == 500


def test_review_set(spark):
    rows = spark.createDataFrame([(k, k + 1, int(k % 3 == 0), f"a{k}", f"b{k}") for k in range(100)], "idx1 long, idx2 long, label int, name_latin_1 string, name_latin_2 string")
    some = J.review_set(rows, 20)
    assert {r["label"]: r["n"] for r in some.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 20, 1: 20}
    assert {"left_name_latin", "right_name_latin", "manual_label"} <= set(some.columns) and J.review_set(rows, 50).count() == 84


def test_rule_prefilter_loses_nothing(spark):
    rng = random.Random(3)
    names = [" ".join(rng.choice(("anna", "ivan", "llc", "petrov", "ivanov", "too", "x")) for _ in range(rng.randint(0, 5))) for _ in range(90)]
    rows = spark.createDataFrame(list(enumerate(names)), "i long, n string")
    pairs = rows.select(F.col("n").alias("name_latin_1"), "i").crossJoin(rows.select(F.col("n").alias("name_latin_2"), F.col("i").alias("j"))).where("i < j")
    scored = X.rule_scorer(P.text_features(pairs)).withColumn("may", X.rule_may_match())
    assert scored.where("duplicate_score >= 0.9 and not may").count() == 0 and scored.where("not may").count() > 100


def test_search_in_a_written_index(spark, people, tmp_path):
    """A loaded index finds what a cached one finds, by equalities that reach the scan."""
    T.write_parquet(search_index(people), str(tmp_path / "index"))
    loaded, cached = Engine.load(spark, str(tmp_path / "index")), Engine(spark, people)
    query = {"party_name": "Ivan PETROV", "country": "arm"}
    found = loaded.search(query, 5, deduplicate=False)
    assert found.collect() == cached.search(query, 5, deduplicate=False).collect() != [] and loaded.status()["records"] == 10
    assert "In(block_value" in found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1].split("\n")[0]


def test_consistency(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "lost")], "idx long, entity_id string")
    entities = spark.createDataFrame([("a", 2), ("b", 7), ("extra", 1)], "entity_id string, cluster_size long")
    assert tuple(E.consistency(rows, entities).first()) == (5, 3, 1, 2, 1)
    assert tuple(E.consistency(rows.limit(0), entities.limit(0)).first()) == (0, 0, 0, 0, 0)
