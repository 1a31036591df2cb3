"""Registered queries of the entity-resolution operators, and the SQL that each is held against.

Records come from the driver's tables: ``part`` stands in for party records (name, brand as country, type as relation kind), with a label made of type and size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.functions import names as N, similarity as S, values as V
from kindred.operators import augment as A, blocking as B, cleaning as C, entities as E, evaluate as M, features as P, labels as L, matcher as X, pairs as J, profile as R
from kindred.plans import dedup
from kindred.plans.scratch import Scratch
from kindred.plans.service import Engine
from kindred.sources import tables as T


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Processed records from ``part``."""
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").cast("long").alias("idx"), F.col("p_partkey").cast("string").alias("record_id"), F.col("p_name").alias("party_name"), F.col("p_brand").alias("country"),
        F.col("p_type").alias("relation_kind"), F.col("p_size").cast("string").alias("relation_role"), F.concat_ws("-", "p_brand", "p_size").alias("company_public_id"),
        F.concat_ws("-", "p_type", "p_size").alias("party_public_id"),
    )
    return C.preprocess_names(C.add_script(raw))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _text(column: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({column}), '[^\w\s]', ' ', 'g'), '\d+', ' ', 'g'), '\s+', ' ', 'g'))"


_REC = f"""rec AS (
  SELECT p_partkey AS idx, p_name AS party_name, p_brand AS country, p_type AS kind, p_size AS role, p_type || '-' || p_size AS label, p_brand || '-' || p_size AS company,
    {_text('p_name')} AS nm FROM part)"""


def _keys_sql(nm: str) -> str:
    first = f"substr(split_part({nm}, ' ', 1), 1, 4)"
    prefix = f"substr(replace({nm}, ' ', ''), 1, 4)"
    unknown = lambda x: f"CASE WHEN {x} = '' THEN 'unknown' ELSE {x} END"
    bucket = f"'_' || (length({nm}) // 5)"
    return f"""{unknown(prefix)} AS block_prefix_4, {unknown(first)} AS block_first_token_4, ({unknown(prefix)}) || {bucket} AS block_prefix_len,
    ({unknown(first)}) || {bucket} AS block_first_token_len, array_to_string(list_sort(string_split({nm}, ' ')), ' ') AS block_sorted_tokens"""


_KEYED = f"keyed AS (SELECT *, {_keys_sql('nm')} FROM rec)"
_PASS = """pass AS (
  SELECT idx, 'block_prefix_len' AS p, block_prefix_len AS k FROM keyed UNION ALL SELECT idx, 'block_first_token_len', block_first_token_len FROM keyed
  UNION ALL SELECT idx, 'block_sorted_tokens', block_sorted_tokens FROM keyed),
good AS (SELECT p, k FROM pass GROUP BY p, k HAVING count(*) BETWEEN 2 AND 500),
cand AS (SELECT DISTINCT a.idx AS idx1, b.idx AS idx2 FROM pass a JOIN good USING (p, k) JOIN pass b USING (p, k) WHERE a.idx < b.idx)"""
_NAMES = "nms AS (SELECT DISTINCT nm FROM rec), np AS (SELECT a.nm AS a, b.nm AS b FROM nms a JOIN nms b ON a.nm < b.nm)"


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence: a reduction over the rows of its table."""
    zeros = f"list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT)"
    inner = f"list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda acc, jj: list_append(acc, CASE WHEN ord(substr({b}, jj[1], 1)) = x[1] THEN r[jj[1]] + 1 ELSE greatest(r[jj[1] + 1], acc[jj[1]]) END))"
    rows = f"list_reduce(list_prepend({zeros}, list_transform(string_split({a}, ''), lambda ch: [ord(ch)::BIGINT])), lambda r, x: {inner})"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE ({rows})[length({b}) + 1] END)"


def _raw(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * {_lcs(a, b)} / (length({a}) + length({b})) END)"


def _ratio(a: str, b: str) -> str:
    return f"round(CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * {_lcs(a, b)} / (length({a}) + length({b})) END, 6)"


def name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of the few distinct names of ``part``."""
    n = records(spark, sf).select(F.col("name_latin").alias("a")).distinct()
    return n.join(n.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))


# --- queries ---------------------------------------------------------------------------------------------------------------------


def normalize_names(spark, sf):
    both = table(spark, sf, "part").select(F.col("p_name").alias("name")).unionByName(table(spark, sf, "customer").select(F.col("c_name").alias("name"))).distinct()
    return both.select("name", N.normalize_text("name").alias("normalized"), N.normalize_text("name", keep_digits=True).alias("with_digits"), N.remove_legal_forms(N.normalize_text("name")).alias("no_legal"))


def normalize_documents(spark, sf):
    """Whole multilingual texts, marks dropped; digests stand for the long results."""
    plain = N.normalize_text("text", mode="clean")
    return table(spark, sf, "documents").select("doc_id", plain.alias("t")).select("doc_id", F.sha2("t", 256).alias("digest"), F.length("t").cast("long").alias("chars"))


def transliterate_documents(spark, sf):
    """The pipeline's own normal form (marks split words) and its Latin spelling."""
    plain = table(spark, sf, "documents").select("doc_id", N.normalize_text("text").alias("t"))
    return plain.select("doc_id", F.sha2("t", 256).alias("normalized"), F.sha2(N.transliterate("t"), 256).alias("latin"))


def text_flags(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", N.detect_script("text").alias("script"), N.detect_alphabet("text").alias("alphabet"), N.is_garbage("text").alias("garbage"), F.sha2(N.normalize_quotes("text"), 256).alias("quotes"),
        F.sha2(N.normalize_separators("text"), 256).alias("separators"), F.sha2(N.normalize_punctuation_soft(N.normalize_dashes("text")), 256).alias("soft"),
    )


def dataset_filters(spark, sf):
    """Which rows cleaning keeps, by country."""
    raw = table(spark, sf, "part").select(F.col("p_name").alias("party_name"), F.col("p_brand").alias("country"), F.lit("2024-01-31").alias("source_snapshot_date"))
    return C.build_dataset(raw).groupBy("country", "script").agg(F.count(F.lit(1)).alias("n"), F.min("snapshot_date").alias("first"))


def snapshot_dates(spark, sf):
    """ISO dates and Unix seconds read back from orders."""
    tjk = F.col("o_orderkey") % 2 == 0
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(tjk, "tjk").otherwise("arm").alias("country"),
        F.when(tjk, F.unix_timestamp("o_orderdate").cast("string")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("raw"),
    )
    return rows.select("o_orderkey", "country", N.parse_snapshot("raw").alias("snapshot"))


def block_keys(spark, sf):
    return B.make_block_keys(records(spark, sf)).select("idx", *V.BLOCK_COLUMNS)


def block_size_stats(spark, sf):
    keyed = B.make_block_keys(records(spark, sf))
    each = [B.block_sizes(keyed, c).withColumn("block_col", F.lit(c)) for c in V.BLOCK_COLUMNS]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def stop_blocks(spark, sf):
    return B.stop_blocks(B.make_block_keys(records(spark, sf)), "block_prefix_4", 100)


def stop_block_filter(spark, sf):
    keyed = B.make_block_keys(records(spark, sf))
    return B.filter_stop_blocks(keyed, "block_prefix_4", B.stop_blocks(keyed, "block_prefix_4", 100)).select("idx", "block_prefix_4")


def reduction_ratio(spark, sf):
    return _rounded(B.reduction_ratio(B.make_block_keys(records(spark, sf)), "block_prefix_len"))


def candidate_pairs(spark, sf):
    return B.candidate_pairs(B.make_block_keys(records(spark, sf)))


def large_block_dropped(spark, sf):
    """All customers have one normalised name: a single block, dropped where it has more than 500 rows."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("idx"), F.col("c_name").alias("party_name"))
    pairs = B.candidate_pairs(B.make_block_keys(C.preprocess_names(rows)))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"))


def blocking_recall(spark, sf):
    rows = records(spark, sf)
    positives = rows.select(F.col("idx").alias("idx1"), "name_latin", "country").join(rows.select(F.col("idx").alias("idx2"), "name_latin", "country"), ["name_latin", "country"]).where("idx1 < idx2").select("idx1", "idx2", F.lit(1).alias("label"))
    return _rounded(B.blocking_recall(positives, B.candidate_pairs(B.make_block_keys(rows))))


def _country_pairs(spark, sf):
    rows = records(spark, sf)
    return J.attach_records(B.candidate_pairs(B.make_block_keys(rows), within=["country"]), rows)


def pair_features_basic(spark, sf):
    keep = ["exact_match", "token_jaccard", "common_tokens", "len_1", "len_2", "length_diff", "token_count_1", "token_count_2", "token_count_diff", "has_legal_form_1", "same_legal_form", "core_exact_match", "same_country", "same_relation_kind", "same_relation_role", "has_garbage_entity"]
    return _rounded(P.pair_features(_country_pairs(spark, sf)).select("idx1", "idx2", *keep))


def pair_features(spark, sf):
    return _rounded(P.pair_features(_country_pairs(spark, sf)).select("idx1", "idx2", *P.feature_columns()))


def pair_ratio_indel(spark, sf):
    return _rounded(name_pairs(spark, sf).select("a", "b", S.fuzz_ratio_udf("a", "b").alias("fuzz_ratio"), S.token_sort_udf("a", "b").alias("token_sort_ratio")))


def pair_ratio_native(spark, sf):
    return _rounded(name_pairs(spark, sf).select("a", "b", S.native_ratio(F.col("a"), F.col("b")).alias("fuzz_ratio")))


def pair_token_set(spark, sf):
    return _rounded(name_pairs(spark, sf).select("a", "b", S.token_set_udf("a", "b").alias("token_set_ratio")))


def pair_partial_ratio(spark, sf):
    return _rounded(name_pairs(spark, sf).select("a", "b", S.partial_ratio_udf("a", "b").alias("partial_ratio")))


def baseline_scores(spark, sf):
    return _rounded(P.baseline_scores(_country_pairs(spark, sf)).select("idx1", "idx2", "baseline_exact", "baseline_ratio", "baseline_token_sort", "baseline_token_set"))


def rule_match_edges(spark, sf):
    return dedup.duplicate_edges(records(spark, sf)).select("idx1", "idx2", "duplicate_score")


def confident_edges(spark, sf):
    pairs = X.garbage_rule(X.rule_scorer(P.pair_features(_country_pairs(spark, sf))))
    return X.confident_edges(pairs).select("idx1", "idx2", "duplicate_score")


def _deduplicated(spark, sf):
    rows = records(spark, sf)
    return dedup.clusters_from_edges(rows, dedup.duplicate_edges(rows))


def entity_clusters(spark, sf):
    return _deduplicated(spark, sf)[0].select("idx", "entity_id", "cluster_size", "canonical_name")


def canonical_entities(spark, sf):
    lists = ["record_ids", "original_names", "normalized_names", "countries", "companies"]
    return _deduplicated(spark, sf)[1].select(*[F.concat_ws("|", c).alias(c) if c in lists else F.col(c) for c in V.ENTITY_EXPORT], "has_many_names", "has_many_countries")


def _by_name(spark, sf):
    """Clusters of records with one name, whatever the country: a few large ones."""
    return records(spark, sf).withColumns({"entity_id": F.col("name_latin"), "cluster_size": F.lit(1), "canonical_name": F.col("name_latin")})


def cluster_stats(spark, sf):
    return E.cluster_stats(_by_name(spark, sf))


def suspicious_clusters(spark, sf):
    return E.suspicious_clusters(E.large_clusters(E.cluster_stats(_by_name(spark, sf)))).select("entity_id", "cluster_size", "unique_names", "unique_countries")


def size_distribution(spark, sf):
    return E.size_distribution(_deduplicated(spark, sf)[0])


def final_summary(spark, sf):
    return E.final_summary(_deduplicated(spark, sf)[0])


def label_id_stats(spark, sf):
    return _rounded(L.label_stats(records(spark, sf)))


def trusted_ids(spark, sf):
    return L.mark_trusted(L.label_stats(records(spark, sf)), 5, 6, 6).select("party_public_id", "is_trusted")


def label_similarity(spark, sf):
    return _rounded(L.label_similarity(records(spark, sf)))


def null_profile(spark, sf):
    events = table(spark, sf, "events")
    return R.null_profile(events.select("event_id", "user_id", "event_type", F.when(F.col("value") >= 10, F.col("value")).alias("value")))


def fill_rates(spark, sf):
    events = table(spark, sf, "events").withColumn("label", F.when(F.col("user_id") % 10 == 0, F.col("user_id"))).withColumn("big", F.when(F.col("value") >= 10, F.col("value")))
    return _rounded(R.fill_rates(events, "label", ["event_type", "big"]))


def crosstab(spark, sf):
    return R.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def value_share(spark, sf):
    return _rounded(R.value_shares(table(spark, sf, "events"), "event_type"))


def top_values(spark, sf):
    return _rounded(R.value_shares(table(spark, sf, "lineitem"), "l_suppkey", 10))


def group_profile(spark, sf):
    return R.group_profile(table(spark, sf, "orders"), "o_orderstatus", "o_orderdate", ["o_custkey"])


def date_span(spark, sf):
    return R.date_spans(table(spark, sf, "orders"), "o_custkey", "o_orderdate")


def longest_spans(spark, sf):
    return R.longest_spans(table(spark, sf, "orders"), "o_custkey", "o_orderdate")


def duplicate_flag(spark, sf):
    return R.duplicate_flags(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


def year_counts(spark, sf):
    return R.year_counts(table(spark, sf, "orders"), "o_orderdate")


def numeric_profile(spark, sf):
    return _rounded(R.numeric_profile(table(spark, sf, "lineitem"), "l_quantity"))


def value_histogram(spark, sf):
    return R.histogram(table(spark, sf, "lineitem"), "l_quantity", 0.0, 40.0, 8)


def grouped_describe(spark, sf):
    return _rounded(R.grouped_describe(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice"), 4)


def size_buckets(spark, sf):
    return R.size_buckets(table(spark, sf, "orders"), "o_custkey")


def size_profile(spark, sf):
    return _rounded(R.size_profile(table(spark, sf, "orders"), "o_custkey"))


def variation(spark, sf):
    return R.variation(table(spark, sf, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


def shared_names(spark, sf):
    return R.shared_names(table(spark, sf, "part"), "p_name", "p_brand")


def duplicate_groups(spark, sf):
    return R.duplicate_groups(records(spark, sf), "name_latin")


def spelling_variants(spark, sf):
    rows = records(spark, sf).withColumn("party_name", F.when(F.col("idx") % 2 == 0, F.upper("party_name")).otherwise(F.col("party_name")))
    return R.spelling_variants(rows).withColumn("originals", F.concat_ws("|", "originals"))


def name_flags(spark, sf):
    return R.name_flags(table(spark, sf, "customer"), "c_name", ["customer", "llc"])


def positive_pairs(spark, sf):
    return J.positive_pairs(records(spark, sf))


def easy_negatives(spark, sf):
    return J.easy_negative_pairs(records(spark, sf), 2000)


def hard_negatives(spark, sf):
    """The operator's own sample and cap apply."""
    return _rounded(J.hard_negative_pairs(records(spark, sf)))


def pair_groups(spark, sf):
    pairs = J.attach_records(J.positive_pairs(records(spark, sf)), records(spark, sf))
    return J.split_by_group(J.remove_duplicate_pairs(pairs).withColumn("entity_group", J.entity_group())).select("pair_key", "entity_group", "split")


def augmented_pairs(spark, sf):
    pairs = J.make_pair_key(J.attach_records(J.positive_pairs(records(spark, sf)), records(spark, sf)))
    return A.augment_pairs(pairs, 500, 500).select("pair_key", "name_latin_1", "name_latin_2", "label", "pair_type")


def banded_pairs(spark, sf):
    rows = records(spark, sf)
    few = rows.groupBy("name_latin").agg(F.min("idx").alias("idx"))
    return _rounded(B.banded_pairs(few, least=0.6))


def similar_names(spark, sf):
    return _rounded(J.similar_name_pairs(records(spark, sf), threshold=80))


def _scored_labels(spark, sf) -> DataFrame:
    """Quality labels beside a score from the length of their texts."""
    both = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return both.select(F.col("quality").alias("label"), (F.least(F.floor(F.col("n_chars") / 4), F.lit(1000)) / 1000.0).alias("score"), "lang").withColumn("prediction", (F.col("score") >= 0.2).cast("int"))


def confusion(spark, sf):
    return M.confusion(_scored_labels(spark, sf))


def threshold_sweep(spark, sf):
    return _rounded(M.threshold_grid(_scored_labels(spark, sf), ["score"], M.sweep_thresholds()))


def metrics_by_type(spark, sf):
    return _rounded(M.metrics(_scored_labels(spark, sf), by=["lang"]))


def roc_auc(spark, sf):
    return _rounded(M.roc_auc(_scored_labels(spark, sf)))


def roc_curve(spark, sf):
    return _rounded(M.roc_curve(_scored_labels(spark, sf)))


def error_summary(spark, sf):
    return _rounded(M.error_summary(_scored_labels(spark, sf)))


def error_categories(spark, sf):
    return name_pairs(spark, sf).select("a", "b", M.error_category("a", "b").alias("category"))


def embedding_topk(spark, sf):
    """The ten nearest vectors of every twentieth one, against all."""
    e = table(spark, sf, "embeddings")
    return _rounded(R.vector_neighbours(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding"))


def tfidf_topk(spark, sf):
    return _rounded(R.tfidf_neighbours(table(spark, sf, "part").select(F.col("p_name")).distinct(), "p_name", "p_name"))


def search_topk(spark, sf):
    return _rounded(Engine(spark, records(spark, sf)).search({"party_name": "widget red", "country": "Brand#1"}, 5))


def _mutated_parts(spark, sf):
    """Records with misspelt names; the label is the name before, which no feature reads."""
    rows = records(spark, sf)
    spelt = rows.withColumns({"party_public_id": F.concat_ws("-", "party_name", "country"), "name_latin": A.mutated("name_latin", "idx", A.POSITIVE_EARLIER)})
    return spelt.withColumns({"party_name": F.col("name_latin"), "name_latin": F.lower("name_latin")})


def _labelled_pairs(spark, sf) -> DataFrame:
    """Positive, easy and hard pairs with features and the split of their entity group."""
    rows = _mutated_parts(spark, sf)
    pairs = J.positive_pairs(rows).unionByName(J.easy_negative_pairs(rows, 2000)).unionByName(J.hard_negative_pairs(rows, threshold=60, most=3000).drop("name_similarity"))
    beside = J.split_by_group(J.remove_duplicate_pairs(J.attach_records(pairs, rows)).withColumn("entity_group", J.entity_group()))
    return Scratch(spark, "labelled").cut(P.pair_features(beside))


def _model(rows, kind):
    told = rows.where("split = 'train'")
    return X.model_scorer(X.train_random_forest(told, trees=20, depth=6) if kind == "forest" else X.train_logistic_regression(told))


def forest_scores(spark, sf):
    """Test pairs scored by a forest that was trained on the pairs of other entities."""
    rows = _labelled_pairs(spark, sf)
    return X.garbage_rule(_model(rows, "forest")(rows.where("split = 'test'"))).select("idx1", "idx2", "pair_type", "label", "duplicate_score", "duplicate_prediction")


def logistic_scores(spark, sf):
    rows = _labelled_pairs(spark, sf)
    return X.garbage_rule(_model(rows, "logistic")(rows.where("split = 'test'"))).select("idx1", "idx2", "pair_type", "label", "duplicate_score", "duplicate_prediction")


def model_metrics(spark, sf):
    """Both models and the rule on the test pairs, by pair type."""
    rows = _labelled_pairs(spark, sf)
    test, out = rows.where("split = 'test'"), None
    for name, scorer, threshold in (("forest", _model(rows, "forest"), 0.5), ("logistic", _model(rows, "logistic"), 0.5), ("rule", X.rule_scorer, V.SCORE_THRESHOLD)):
        one = M.evaluate_model(test, scorer, threshold, by=["pair_type"]).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return _rounded(out)


def wrong_pairs(spark, sf):
    """Labels that the score of text lengths decides wrongly."""
    return M.wrong_pairs(_scored_labels(spark, sf)).groupBy("lang", "mistake").agg(F.count(F.lit(1)).alias("n"))


def review_set(spark, sf):
    """At most 40 labelled pairs of either class for manual review."""
    rows = records(spark, sf)
    pairs = J.attach_records(J.positive_pairs(rows).unionByName(J.easy_negative_pairs(rows, 500)), rows)
    return J.review_set(pairs, 40).select("label", "idx1", "idx2", "left_name_latin", "right_name_latin", "manual_label")


#: Names in other scripts, with legal forms, garbage and odd signs.
CASES = [
    "Михайлов Сергей", "Йосиф Ёлкин", "Ömer Şahin LLC", "ООО «Ромашка» №5", "և ու", "ՍՊԸ Արմեն", "Kəmalə ı", "foo_bar 2²", " A.B. ", "unknown", "Замените  на имя", "согласно списку", "Анна ТОО", "Acme Trade Ltd", "Acme Trade", "12345", "ანა", "",
]


def name_cases(spark, sf):
    """The whole chain from a raw name to its Latin spelling, on names that the tables lack."""
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(CASES)], "k long, name string")
    plain = N.normalize_text("name")
    return rows.select("k", plain.alias("normalized"), N.remove_legal_forms(plain).alias("no_legal"), N.transliterate(plain).alias("latin"), N.detect_script("name").alias("script"), N.is_garbage("name").cast("int").alias("garbage"))


def pair_cases(spark, sf):
    """Legal-form, core and garbage features of pairs that have such cases."""
    sides = [("acme trade ltd", "acme trade"), ("acme ltd", "acme llc"), ("ooo romashka", "romashka ooo"), ("petrov ivan", "ivan petrov"), ("a", ""), ("too x", "ao x")]
    rows = spark.createDataFrame([(k, a, b, a, "unknown" if k == 4 else b, "arm", "arm" if k % 2 else "kaz") for k, (a, b) in enumerate(sides)], "k long, name_latin_1 string, name_latin_2 string, party_name_1 string, party_name_2 string, country_1 string, country_2 string")
    return _rounded(P.pair_features(rows).select("k", "has_legal_form_1", "has_legal_form_2", "same_legal_form", "exact_match", "core_exact_match", "token_jaccard", "same_country", "is_garbage_2", "has_garbage_entity"))


def chain_clusters(spark, sf):
    """Entities of chains longer than two, a star and a loner, whatever the order of their edges."""
    edges = [(4, 3), (1, 2), (3, 2), (7, 9), (9, 8), (12, 10), (12, 11), (20, 21)]
    rows = spark.createDataFrame([(a, b, 0.5 if a == 20 else 0.95) for a, b in edges], "idx1 long, idx2 long, duplicate_score double")
    records_ = spark.range(1, 23).select(F.col("id").alias("idx"), F.lit("x").alias("name_latin"))
    return E.attach_clusters(records_, E.build_clusters(E.duplicate_edges(rows, 0.9), Scratch(spark, "chains"))).select("idx", "entity_id", F.col("cluster_size").cast("long").alias("cluster_size"))


def conformed(spark, sf):
    """A table with few of the relation columns, brought to the declared schema."""
    raw = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("record_id"), F.col("s_name").alias("party_name"))
    return T.with_index(T.conform(raw)).select("idx", "record_id", "party_name", "country", "ownership_share_pct")


QUERIES = {f.__name__: f for f in (
    entity_clusters, normalize_names, normalize_documents, transliterate_documents, text_flags, dataset_filters, snapshot_dates, block_keys, block_size_stats, stop_blocks, stop_block_filter, reduction_ratio,
    candidate_pairs, large_block_dropped, blocking_recall, pair_features_basic, pair_features, pair_ratio_indel, pair_ratio_native, pair_token_set, pair_partial_ratio, baseline_scores, rule_match_edges,
    confident_edges, canonical_entities, cluster_stats, suspicious_clusters, size_distribution, final_summary, label_id_stats, trusted_ids, label_similarity, null_profile, fill_rates, crosstab,
    value_share, top_values, group_profile, date_span, longest_spans, duplicate_flag, year_counts, numeric_profile, value_histogram, grouped_describe, size_buckets, size_profile, variation, shared_names,
    duplicate_groups, spelling_variants, name_flags, positive_pairs, easy_negatives, hard_negatives, pair_groups, augmented_pairs, banded_pairs, similar_names, confusion, threshold_sweep, metrics_by_type,
    roc_auc, roc_curve, error_summary, error_categories, embedding_topk, tfidf_topk, search_topk, forest_scores, logistic_scores, model_metrics, wrong_pairs, review_set, name_cases, pair_cases, chain_clusters, conformed,
)}

# --- SQL -------------------------------------------------------------------------------------------------------------------------

_CLUSTER = f"""{_REC}, {_KEYED}, good AS (
  SELECT country, block_sorted_tokens AS k FROM keyed GROUP BY ALL HAVING count(*) BETWEEN 2 AND 500),
grp AS (SELECT keyed.*, min(idx) OVER (PARTITION BY keyed.country, block_sorted_tokens) AS least, count(*) OVER (PARTITION BY keyed.country, block_sorted_tokens) AS n, good.k IS NOT NULL AS linked
  FROM keyed LEFT JOIN good ON keyed.country = good.country AND block_sorted_tokens = good.k),
num AS (SELECT least, 'entity_' || lpad((dense_rank() OVER (ORDER BY least) - 1)::VARCHAR, 8, '0') AS e FROM grp WHERE linked GROUP BY least),
ent AS (SELECT grp.*, CASE WHEN linked THEN e ELSE 'single_' || idx END AS entity_id, CASE WHEN linked THEN n ELSE 1 END AS cluster_size FROM grp LEFT JOIN num USING (least)),
modes AS (SELECT entity_id, nm, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, nm) AS r FROM ent GROUP BY entity_id, nm),
dedup AS (SELECT ent.*, m.nm AS canonical_name FROM ent JOIN modes m ON ent.entity_id = m.entity_id AND m.r = 1)"""


def _mode(c: str, name: str) -> str:
    return f"(SELECT {c} FROM dedup i WHERE i.entity_id = o.entity_id GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {name}"


def _firsts(c: str, name: str) -> str:
    return f"(SELECT string_agg(v, '|' ORDER BY pos, v) FROM (SELECT {c} AS v, min(idx) AS pos FROM dedup i WHERE i.entity_id = o.entity_id GROUP BY {c} ORDER BY pos, v LIMIT 20)) AS {name}"


_QUALITY = """sl AS (
  SELECT quality AS label, (least(n_chars // 4, 1000) / 1000.0)::DOUBLE AS score, lang FROM labels JOIN documents USING (doc_id)), s AS (SELECT *, (score >= 0.2)::INT AS prediction FROM sl)"""
_METRICS = """tp, fp, fn, tn, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""
_COUNTS = """count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn,
  count(*) FILTER (label = 0 AND prediction = 0) AS tn"""
_PAIRED = f"""{_REC}, {_KEYED}, pass AS (
  SELECT idx, country, 'a' AS p, block_prefix_len AS k FROM keyed UNION ALL SELECT idx, country, 'b', block_first_token_len FROM keyed UNION ALL SELECT idx, country, 'c', block_sorted_tokens FROM keyed),
good AS (SELECT country, p, k FROM pass GROUP BY ALL HAVING count(*) BETWEEN 2 AND 500),
cand AS (SELECT DISTINCT a.idx AS idx1, b.idx AS idx2 FROM pass a JOIN good USING (country, p, k) JOIN pass b USING (country, p, k) WHERE a.idx < b.idx),
pr AS (SELECT idx1, idx2, x.nm AS a, y.nm AS b, x.kind AS k1, y.kind AS k2, x.role AS r1, y.role AS r2, list_distinct(string_split(x.nm, ' ')) AS s, list_distinct(string_split(y.nm, ' ')) AS t,
  len(string_split(x.nm, ' ')) AS c1, len(string_split(y.nm, ' ')) AS c2 FROM cand JOIN rec x ON x.idx = idx1 JOIN rec y ON y.idx = idx2)"""
_SET_PARTS = f"""w AS (
  SELECT a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM np),
d AS (SELECT a, b, array_to_string(list_sort(list_filter(x, lambda q: list_contains(y, q))), ' ') AS i, array_to_string(list_sort(list_filter(x, lambda q: NOT list_contains(y, q))), ' ') AS lft,
  array_to_string(list_sort(list_filter(y, lambda q: NOT list_contains(x, q))), ' ') AS rgt FROM w),
z AS (SELECT *, CASE WHEN i = '' THEN 0 ELSE 1 END AS g FROM d),
n AS (SELECT *, length(i) + g + length(lft) AS n1, length(i) + g + length(rgt) AS n2 FROM z),
f AS (SELECT *, 100.0 * (1 - (length(lft) + length(rgt) - 2 * {_lcs('lft', 'rgt')}) / (n1 + n2)) AS r0 FROM n),
sets AS (SELECT a, b, CASE WHEN i <> '' AND (lft = '' OR rgt = '') THEN 100.0 WHEN i = '' THEN r0
  ELSE greatest(r0, 100.0 * (1 - (g + length(lft)) / (length(i) + n1)), 100.0 * (1 - (g + length(rgt)) / (length(i) + n2))) END AS token_set_ratio FROM f)"""
_SET = f"WITH {_REC}, {_NAMES}, {_SET_PARTS} SELECT a, b, round(token_set_ratio, 6) AS token_set_ratio FROM sets"
#: Sorted-token ratio of all pairs of distinct names, a < b.
_SORTED = f"""so AS (SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS x, array_to_string(list_sort(string_split(b, ' ')), ' ') AS y FROM np),
sim AS (SELECT a, b, {_raw('a', 'b')} AS plain, {_raw('x', 'y')} AS sorted FROM so)"""
#: Best ratio of the shorter name with a window of the longer one, for pairs of distinct names a < b; both ways round where they are equally long.
_PARTIAL = f"""dirs AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS q, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS t FROM np UNION ALL SELECT a, b, b, a FROM np WHERE length(a) = length(b)),
win AS (SELECT a, b, q, t, unnest(range(1 - length(q), length(t))) AS i FROM dirs),
cut AS (SELECT DISTINCT a, b, q, substr(t, (greatest(i, 0) + 1)::INT, (i + length(q) - greatest(i, 0))::INT) AS v FROM win),
par AS (SELECT a, b, max(CASE WHEN contains(q, v[1]) OR contains(q, v[-1]) THEN {_raw('q', 'v')} ELSE 0 END) AS partial FROM cut GROUP BY 1, 2)"""

SQL = {
    "entity_clusters": f"WITH {_CLUSTER} SELECT idx, entity_id, cluster_size::INT AS cluster_size, canonical_name FROM dedup",
    "canonical_entities": f"""WITH {_CLUSTER}, o AS (SELECT entity_id, count(*) AS cluster_size, count(DISTINCT nm) AS unique_names_count, count(DISTINCT country) AS unique_countries_count, count(DISTINCT company) AS unique_companies_count FROM dedup GROUP BY entity_id)
SELECT entity_id, {_mode('canonical_name', 'canonical_name')}, cluster_size, {_mode('country', 'canonical_country')}, 'latin' AS canonical_script, {_mode('kind', 'main_relation_kind')}, {_mode('role::VARCHAR', 'main_relation_role')},
  unique_names_count, unique_countries_count, unique_companies_count, (cluster_size = 1)::INT AS is_singleton, (cluster_size >= 20)::INT AS is_large_cluster, (unique_names_count > 5 OR unique_countries_count > 3)::INT AS is_suspicious_entity,
  {_firsts('party_name', 'original_names')}, {_firsts('nm', 'normalized_names')}, {_firsts('country', 'countries')}, {_firsts('company', 'companies')}, {_firsts('idx::VARCHAR', 'record_ids')},
  (unique_names_count > 5)::INT AS has_many_names, (unique_countries_count > 3)::INT AS has_many_countries FROM o""",
    "normalize_names": f"""WITH n AS (SELECT p_name AS name FROM part UNION SELECT c_name FROM customer)
SELECT name, {_text('name')} AS normalized, trim(regexp_replace(regexp_replace(lower(name), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS with_digits, {_text('name')} AS no_legal FROM n""",
    "normalize_documents": r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\p{Nd}+', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, sha256(t) AS digest, length(t) AS chars FROM t""",
    "text_flags": r"""WITH f AS (SELECT doc_id, coalesce(text, '') AS text, regexp_matches(text, '[А-Яа-яЁё]') AS c, regexp_matches(text, '[A-Za-z]') AS l, regexp_matches(text, '[\x{0530}-\x{058F}]') AS a, regexp_matches(text, '[\x{10A0}-\x{10FF}]') AS g, regexp_matches(text, '[\x{0400}-\x{04FF}]') AS cy FROM documents)
SELECT doc_id, CASE WHEN c::INT + l::INT + a::INT + g::INT = 0 THEN 'unknown' WHEN c::INT + l::INT + a::INT + g::INT > 1 THEN 'mixed' WHEN c THEN 'cyrillic' WHEN l THEN 'latin' WHEN a THEN 'armenian' ELSE 'georgian' END AS script,
  CASE WHEN a THEN 'Armenian' WHEN cy THEN 'Cyrillic' WHEN l THEN 'Latin' ELSE 'Other' END AS alphabet,
  (trim(text) = '' OR regexp_matches(lower(text), 'unknown|неизвест|анхай|anhayt|kazmakerpoutyoun|замените\s+на|согласно'))::INT AS garbage,
  sha256(translate(text, '’`´‘"''«»', '''''''''''''''''')) AS quotes, sha256(regexp_replace(text, '[|/\\_]+', ' ', 'g')) AS separators, sha256(translate(translate(text, '–—−', '---'), '.,;:()[]{}', '          ')) AS soft FROM f""",
    "dataset_filters": "SELECT p_brand AS country, 'latin' AS script, count(*) AS n, TIMESTAMP '2024-01-31' AS first FROM part WHERE length(trim(p_name)) >= 2 GROUP BY 1",
    "snapshot_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'tjk' ELSE 'arm' END AS country, CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('second', o_orderdate) ELSE date_trunc('day', o_orderdate)::TIMESTAMP END AS snapshot FROM orders",
    "block_keys": f"WITH {_REC}, {_KEYED} SELECT idx, {', '.join(V.BLOCK_COLUMNS)} FROM keyed",
    "block_size_stats": f"WITH {_REC}, {_KEYED} " + " UNION ALL ".join(f"SELECT {c} AS block_value, count(*) AS block_size, '{c}' AS block_col FROM keyed GROUP BY 1" for c in V.BLOCK_COLUMNS),
    "stop_blocks": f"""WITH {_REC}, {_KEYED}, b AS (SELECT block_prefix_4 AS block_value, count(*) AS block_size FROM keyed GROUP BY 1)
SELECT *, block_size > 100 AS is_large_block, block_value IN ('unknown', 'firm') AS is_generic_block FROM b WHERE block_size > 100 OR block_value IN ('unknown', 'firm')""",
    "stop_block_filter": f"WITH {_REC}, {_KEYED} SELECT idx, block_prefix_4 FROM keyed WHERE block_prefix_4 NOT IN (SELECT block_prefix_4 FROM keyed GROUP BY 1 HAVING count(*) > 100 OR block_prefix_4 IN ('unknown', 'firm'))",
    "reduction_ratio": f"""WITH {_REC}, {_KEYED}, b AS (SELECT count(*)::DOUBLE AS s FROM keyed GROUP BY block_prefix_len), t AS (SELECT count(*)::DOUBLE AS n FROM keyed)
SELECT n * (n - 1) / 2 AS total_pairs, (SELECT sum(s * (s - 1) / 2) FROM b) AS block_pairs, round(1 - (SELECT sum(s * (s - 1) / 2) FROM b) / (n * (n - 1) / 2), 6) AS reduction_ratio FROM t""",
    "candidate_pairs": f"WITH {_REC}, {_KEYED}, {_PASS} SELECT idx1, idx2 FROM cand",
    "large_block_dropped": "SELECT (CASE WHEN count(*) BETWEEN 2 AND 500 THEN count(*) * (count(*) - 1) // 2 ELSE 0 END)::BIGINT AS pairs FROM customer",
    "blocking_recall": f"""WITH {_REC}, {_KEYED}, {_PASS}, pos AS (SELECT a.idx AS idx1, b.idx AS idx2 FROM rec a JOIN rec b ON a.nm = b.nm AND a.country = b.country AND a.idx < b.idx)
SELECT count(*) AS positives, count(c.idx1) AS found, round(coalesce(count(c.idx1) / nullif(count(*), 0), 0), 6) AS recall FROM pos LEFT JOIN cand c USING (idx1, idx2)""",
    "pair_features_basic": f"""WITH {_PAIRED} SELECT idx1, idx2, (a = b)::INT AS exact_match, round(len(list_intersect(s, t)) / len(list_distinct(list_concat(s, t))), 6) AS token_jaccard, len(list_intersect(s, t))::INT AS common_tokens,
  length(a)::INT AS len_1, length(b)::INT AS len_2, abs(length(a) - length(b))::INT AS length_diff, c1::INT AS token_count_1, c2::INT AS token_count_2, abs(c1 - c2)::INT AS token_count_diff, 0 AS has_legal_form_1, 1 AS same_legal_form,
  (a = b)::INT AS core_exact_match, 1 AS same_country, (k1 = k2)::INT AS same_relation_kind, (r1 = r2)::INT AS same_relation_role, 0 AS has_garbage_entity FROM pr""",
    "pair_ratio_indel": f"WITH {_REC}, {_NAMES}, z AS (SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS x, array_to_string(list_sort(string_split(b, ' ')), ' ') AS y FROM np) SELECT a, b, {_ratio('a', 'b')} AS fuzz_ratio, {_ratio('x', 'y')} AS token_sort_ratio FROM z",
    "pair_ratio_native": f"WITH {_REC}, {_NAMES} SELECT a, b, {_ratio('a', 'b')} AS fuzz_ratio FROM np",
    "pair_token_set": _SET,
    "rule_match_edges": f"""WITH {_PAIRED}, e AS (SELECT idx1, idx2, a = b AS same, array_to_string(list_sort(string_split(a, ' ')), ' ') = array_to_string(list_sort(string_split(b, ' ')), ' ') AS sorted FROM pr)
SELECT idx1, idx2, CASE WHEN same THEN 1.0 ELSE 0.95 END::DOUBLE AS duplicate_score FROM e WHERE same OR sorted""",
    "confident_edges": f"""WITH {_PAIRED} SELECT idx1, idx2, CASE WHEN a = b THEN 1.0 ELSE 0.95 END::DOUBLE AS duplicate_score FROM pr
WHERE a = b OR array_to_string(list_sort(string_split(a, ' ')), ' ') = array_to_string(list_sort(string_split(b, ' ')), ' ')""",
    "cluster_stats": f"WITH {_REC} SELECT nm AS entity_id, count(*) AS cluster_size, 1::BIGINT AS unique_names, count(DISTINCT country) AS unique_countries, 1::BIGINT AS unique_scripts, count(DISTINCT kind) AS unique_relation_kinds, count(DISTINCT company) AS unique_companies FROM rec GROUP BY 1",
    "suspicious_clusters": f"WITH {_REC} SELECT nm AS entity_id, count(*) AS cluster_size, 1::BIGINT AS unique_names, count(DISTINCT country) AS unique_countries FROM rec GROUP BY 1 HAVING count(*) >= 20 AND count(DISTINCT country) > 3",
    "size_distribution": f"WITH {_CLUSTER}, s AS (SELECT entity_id, count(*) AS cluster_size FROM dedup GROUP BY 1) SELECT cluster_size, count(*) AS clusters, cluster_size * count(*) AS records FROM s GROUP BY 1",
    "final_summary": f"""WITH {_CLUSTER}, s AS (SELECT entity_id, count(*) AS n FROM dedup GROUP BY 1) SELECT sum(n)::BIGINT AS input_records, count(*) AS unique_entities, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n > 1) AS multi_record_entities,
  coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS records_in_duplicates, max(n) AS largest_entity, round(1 - count(*) / sum(n), 6) AS compression FROM s""",
    "label_id_stats": f"WITH {_REC} SELECT label AS party_public_id, count(*) AS cluster_size, count(DISTINCT nm) AS unique_names, count(DISTINCT country) AS countries, 1::BIGINT AS scripts, round(count(DISTINCT nm) / count(*), 6) AS unique_name_ratio FROM rec GROUP BY 1",
    "trusted_ids": f"WITH {_REC} SELECT label AS party_public_id, count(*) <= 5 AND count(DISTINCT nm) <= 6 AND count(DISTINCT country) <= 6 AS is_trusted FROM rec GROUP BY 1",
    "null_profile": """WITH e AS (SELECT count(*) AS n, count(*) FILTER (event_id IS NULL) AS a, count(*) FILTER (user_id IS NULL) AS b, count(*) FILTER (event_type IS NULL) AS c, count(*) FILTER (value IS NULL OR value < 10) AS d FROM events),
u AS (SELECT n, unnest(['event_id', 'user_id', 'event_type', 'value']) AS "column", unnest([a, b, c, d]) AS nulls FROM e) SELECT "column", nulls, round(100.0 * nulls / n, 2) AS percent FROM u""",
    "fill_rates": "SELECT user_id % 10 = 0 AS labelled, round(avg((event_type IS NOT NULL)::INT), 6) AS event_type, round(avg((value >= 10)::INT), 6) AS big FROM events GROUP BY 1",
    "crosstab": 'SELECT o_orderpriority, count(*) FILTER (o_orderstatus = \'F\') AS "F", count(*) FILTER (o_orderstatus = \'O\') AS "O", count(*) FILTER (o_orderstatus = \'P\') AS "P" FROM orders GROUP BY 1',
    "value_share": "SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(event_type) FROM events), 6) AS share FROM events WHERE event_type IS NOT NULL GROUP BY 1",
    "top_values": "SELECT l_suppkey AS value, count(*) AS n, round(count(*) / (SELECT count(l_suppkey) FROM lineitem), 6) AS share FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
    "group_profile": "SELECT o_orderstatus, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last, count(DISTINCT o_custkey) AS unique_o_custkey FROM orders GROUP BY 1",
    "date_span": "SELECT o_custkey, min(o_orderdate) AS first, max(o_orderdate) AS last, count(DISTINCT o_orderdate) AS dates, floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000)::BIGINT AS days FROM orders GROUP BY 1",
    "longest_spans": "SELECT o_custkey, min(o_orderdate) AS first, max(o_orderdate) AS last, count(DISTINCT o_orderdate) AS dates, floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000)::BIGINT AS days FROM orders GROUP BY 1 ORDER BY days DESC, o_custkey LIMIT 10",
    "duplicate_flag": "SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) > 1 AS is_duplicate FROM orders",
    "year_counts": "SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1",
    "numeric_profile": "SELECT count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.5), 6) AS median, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem",
    "value_histogram": "SELECT least(floor(least(greatest(l_quantity, 0), 40) / 5) + 1, 8)::INT AS bucket, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1",
    "grouped_describe": "SELECT o_orderstatus, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, max(o_totalprice) AS max FROM orders GROUP BY 1",
    "size_buckets": "WITH s AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey) SELECT CASE WHEN n >= 5 THEN '5+' ELSE n::VARCHAR END AS bucket, count(*) AS clusters FROM s GROUP BY 1",
    "size_profile": "WITH s AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey) SELECT count(*) AS clusters, round(avg(n), 6) AS mean, quantile_cont(n, 0.5)::DOUBLE AS median, max(n) AS max FROM s",
    "variation": "SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS unique_o_orderstatus, count(DISTINCT o_orderpriority) AS unique_o_orderpriority FROM orders GROUP BY 1 HAVING count(*) >= 2",
    "shared_names": "SELECT p_name, count(DISTINCT p_brand) AS keys FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1",
    "duplicate_groups": f"WITH {_REC} SELECT nm AS name_latin, count(*) AS n FROM rec GROUP BY 1 HAVING count(*) > 1",
    "spelling_variants": f"WITH {_REC}, v AS (SELECT DISTINCT nm AS name_latin, CASE WHEN idx % 2 = 0 THEN upper(party_name) ELSE party_name END AS o FROM rec) SELECT name_latin, count(*) AS variants, string_agg(o, '|' ORDER BY o) AS originals FROM v GROUP BY 1 HAVING count(*) > 1",
    "name_flags": r"SELECT count(*) AS n, count(*) FILTER (upper(c_name) = c_name AND lower(c_name) <> c_name) AS is_upper, count(*) FILTER (regexp_matches(c_name, '\d')) AS has_digits, count(*) FILTER (regexp_matches(c_name, '[^\w\s]')) AS has_special, 0::BIGINT AS has_initials, count(*) FILTER (c_name ILIKE '%customer%') AS form_customer, count(*) FILTER (c_name ILIKE '%llc%') AS form_llc FROM customer",
    "confusion": f"WITH {_QUALITY} SELECT label::INT AS actual, count(*) FILTER (prediction = 0) AS predicted_0, count(*) FILTER (prediction = 1) AS predicted_1 FROM s GROUP BY 1",
    "threshold_sweep": f"WITH {_QUALITY}, g AS (SELECT 'score' AS method, t AS threshold, label, (score >= t)::INT AS prediction FROM s, (SELECT round(0.1 + 0.05 * k, 2)::DOUBLE AS t FROM range(18) r(k))), c AS (SELECT method, threshold, {_COUNTS} FROM g GROUP BY 1, 2) SELECT method, threshold, {_METRICS} FROM c",
    "metrics_by_type": f"WITH {_QUALITY}, c AS (SELECT lang, {_COUNTS} FROM s GROUP BY 1) SELECT lang, {_METRICS} FROM c",
    "roc_auc": f"WITH {_QUALITY}, p AS (SELECT score FROM s WHERE label = 1), q AS (SELECT score FROM s WHERE label = 0) SELECT round(avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM p, q",
    "roc_curve": f"""WITH {_QUALITY}, c AS (SELECT score::DOUBLE AS score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM s GROUP BY 1),
u AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM c)
SELECT score, round(tp / ap, 6)::DOUBLE AS tpr, round(fp / an, 6)::DOUBLE AS fpr, round(tp / (tp + fp), 6)::DOUBLE AS precision, round(tp / ap, 6)::DOUBLE AS recall FROM u""",
    "error_summary": f"WITH {_QUALITY} SELECT count(*) AS pairs, count(*) FILTER (label <> prediction) AS errors, count(*) FILTER (label = 0 AND prediction = 1) AS false_positives, count(*) FILTER (label = 1 AND prediction = 0) AS false_negatives, round(count(*) FILTER (label <> prediction) / count(*), 6) AS error_rate FROM s",
    "embedding_topk": """WITH n AS (SELECT q.vec_id AS query, e.vec_id AS other, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, other) AS k FROM n) SELECT query, other, round(c, 6) AS cosine FROM r WHERE k <= 10""",
    "pair_partial_ratio": f"WITH {_REC}, {_NAMES}, {_PARTIAL} SELECT a, b, round(partial, 6)::DOUBLE AS partial_ratio FROM par",
    "pair_features": f"""WITH {_PAIRED}, {_NAMES}, {_SORTED}, {_SET_PARTS}, {_PARTIAL}, x AS (SELECT a, b, plain, sorted, token_set_ratio, partial FROM sim JOIN sets USING (a, b) JOIN par USING (a, b)),
y AS (SELECT pr.*, round(coalesce(plain, 100.0), 6)::DOUBLE AS v1, round(coalesce(partial, 100.0), 6)::DOUBLE AS v2, round(coalesce(sorted, 100.0), 6)::DOUBLE AS v3, round(coalesce(token_set_ratio, 100.0), 6)::DOUBLE AS v4
  FROM pr LEFT JOIN x ON x.a = least(pr.a, pr.b) AND x.b = greatest(pr.a, pr.b))
SELECT idx1, idx2, v1 AS fuzz_ratio, v2 AS partial_ratio, v3 AS token_sort_ratio, v4 AS token_set_ratio, (a = b)::INT AS exact_match, round(len(list_intersect(s, t)) / len(list_distinct(list_concat(s, t))), 6) AS token_jaccard,
  len(list_intersect(s, t))::INT AS common_tokens, length(a)::INT AS len_1, length(b)::INT AS len_2, abs(length(a) - length(b))::INT AS length_diff, c1::INT AS token_count_1, c2::INT AS token_count_2,
  abs(c1 - c2)::INT AS token_count_diff, 0 AS has_legal_form_1, 0 AS has_legal_form_2, 1 AS same_legal_form, v1 AS core_fuzz_ratio, v3 AS core_token_sort_ratio, v4 AS core_token_set_ratio, (a = b)::INT AS core_exact_match,
  1 AS same_script, (k1 = k2)::INT AS same_relation_kind, (r1 = r2)::INT AS same_relation_role, 0 AS is_garbage_1, 0 AS is_garbage_2, 0 AS has_garbage_entity FROM y""",
    # The documents' letters beyond ASCII are Latin ones with one mark, which splits the word; their Latin spelling is then what is left.
    "transliterate_documents": r"""WITH c AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), ''), lambda x: CASE WHEN strip_accents(x) <> x THEN strip_accents(x) || ' ' ELSE x END), '') AS t FROM documents),
t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\p{Nd}+', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM c) SELECT doc_id, sha256(t) AS normalized, sha256(t) AS latin FROM t""",
    "search_topk": f"""WITH {_REC}, {_KEYED}, h AS (SELECT *, array_to_string(list_sort(string_split(nm, ' ')), ' ') AS x, 'red widget' AS y FROM keyed
  WHERE block_prefix_len = 'widg_2' OR block_first_token_len = 'widg_2' OR block_sorted_tokens = 'red widget'),
g AS (SELECT *, CASE WHEN nm = 'widget red' THEN 1.0 WHEN x = y THEN 0.95 ELSE 0.9 * {_raw('x', 'y')} / 100 END AS score FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY nm ORDER BY score DESC, idx) AS k FROM g)
SELECT idx::VARCHAR AS record_id_2, party_name AS party_name_2, nm AS name_latin_2, country AS country_2, kind AS relation_kind_2, role::VARCHAR AS relation_role_2, company AS company_public_id_2, round(score, 6)::DOUBLE AS similarity_score
FROM r WHERE k = 1 ORDER BY score DESC, idx LIMIT 5""",
    "label_similarity": f"""WITH {_REC}, {_NAMES}, {_SORTED}, n AS (SELECT label, nm, min(idx) AS pos FROM rec GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pos, nm) AS k FROM n),
p AS (SELECT x.label, sorted FROM r x JOIN r y ON x.label = y.label AND x.k < y.k AND y.k <= 20 JOIN sim ON a = least(x.nm, y.nm) AND b = greatest(x.nm, y.nm)),
m AS (SELECT label, avg(sorted) AS g, min(sorted) AS l FROM p GROUP BY 1)
SELECT q.label AS party_public_id, round(coalesce(g, 100.0), 6)::DOUBLE AS avg_name_similarity, round(coalesce(l, 100.0), 6)::DOUBLE AS min_name_similarity FROM (SELECT DISTINCT label FROM rec) q LEFT JOIN m USING (label)""",
    "similar_names": f"WITH {_REC}, {_NAMES}, {_SORTED} SELECT a AS name_1, b AS name_2, round(sorted, 6)::DOUBLE AS similarity FROM sim WHERE sorted >= 80",
    "hard_negatives": f"""WITH {_REC}, {_NAMES}, {_SORTED}, w AS (SELECT idx, label, nm, substr(nm, 1, 3) AS k FROM rec), good AS (SELECT k FROM w GROUP BY 1 HAVING count(*) <= 500),
p AS (SELECT x.idx AS idx1, y.idx AS idx2, CASE WHEN x.nm = y.nm THEN 100.0 ELSE sorted END AS s FROM w x JOIN good USING (k) JOIN w y USING (k) LEFT JOIN sim ON a = least(x.nm, y.nm) AND b = greatest(x.nm, y.nm) WHERE x.idx < y.idx AND x.label <> y.label)
SELECT idx1, idx2, 0 AS label, 'hard_negative_similar_name' AS pair_type, round(s, 6)::DOUBLE AS name_similarity FROM p WHERE s >= 80 ORDER BY idx1, idx2 LIMIT 100000""",
    "baseline_scores": f"""WITH {_PAIRED}, {_NAMES}, {_SORTED}, {_SET_PARTS}, e AS (SELECT * FROM sim JOIN sets USING (a, b))
SELECT idx1, idx2, (pr.a = pr.b)::INT AS baseline_exact, round(coalesce(plain, 100.0), 6)::DOUBLE AS baseline_ratio, round(coalesce(sorted, 100.0), 6)::DOUBLE AS baseline_token_sort, round(coalesce(token_set_ratio, 100.0), 6)::DOUBLE AS baseline_token_set
FROM pr LEFT JOIN e ON e.a = least(pr.a, pr.b) AND e.b = greatest(pr.a, pr.b)""",
    "banded_pairs": f"""WITH {_REC}, n AS (SELECT nm, min(idx) AS idx FROM rec GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY nm, idx) AS pos FROM n),
p AS (SELECT x.idx AS idx1, y.idx AS idx2, 1 - levenshtein(x.nm, y.nm) / greatest(length(x.nm), length(y.nm), 1) AS s FROM o x JOIN o y ON y.pos > x.pos AND y.pos - x.pos <= 199) SELECT idx1, idx2, round(s, 6) AS similarity FROM p WHERE s > 0.6""",
    "tfidf_topk": """WITH n AS (SELECT DISTINCT p_name AS a FROM part), w AS (SELECT a, ' ' || unnest(string_split(lower(a), ' ')) || ' ' AS w FROM n), k AS (SELECT a, w, unnest([2, 3, 4]) AS k FROM w),
g AS (SELECT a, substr(w, unnest(range(1, length(w) - k + 2))::INT, k) AS g FROM k WHERE length(w) >= k), tf AS (SELECT a, g, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT g, count(*) AS df FROM tf GROUP BY 1),
t AS (SELECT a, g, tf * (ln((1.0 + (SELECT count(*) FROM n)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (g)), u AS (SELECT a, g, w / sqrt(sum(w * w) OVER (PARTITION BY a)) AS w FROM t),
c AS (SELECT x.a, y.a AS b, round(sum(x.w * y.w), 9) AS c FROM u x JOIN u y USING (g) WHERE x.a <> y.a GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM c)
SELECT a AS p_name, b AS other, round(c, 6) AS cosine FROM r WHERE k <= 20""",
    "wrong_pairs": f"WITH {_QUALITY} SELECT lang, CASE WHEN label = 1 THEN 'false_negative' ELSE 'false_positive' END AS mistake, count(*) AS n FROM s WHERE label <> prediction GROUP BY 1, 2",
    # Worked out by hand from the rules: marks split words, digits go, legal forms go before transliteration only.
    "name_cases": """SELECT * FROM (VALUES
  (0::BIGINT, 'михаи лов сергеи', 'михаи лов сергеи', 'mihai lov sergei', 'cyrillic', 0), (1, 'и осиф е лкин', 'и осиф е лкин', 'i osif e lkin', 'cyrillic', 0), (2, 'o mer s ahin llc', 'o mer s ahin', 'o mer s ahin llc', 'latin', 0),
  (3, 'ооо ромашка no', 'ромашка no', 'ooo romashka no', 'cyrillic', 0), (4, 'եւ ու', 'եւ ու', 'eu ou', 'armenian', 0), (5, 'սպը արմեն', 'սպը արմեն', 'spy armen', 'armenian', 0), (6, 'kəmalə ı', 'kəmalə ı', 'kemale i', 'latin', 0),
  (7, 'foo_bar', 'foo_bar', 'foo_bar', 'latin', 0), (8, 'a b', 'a b', 'a b', 'latin', 0), (9, 'unknown', 'unknown', 'unknown', 'latin', 1), (10, 'замените на имя', 'замените на имя', 'zamenite na imya', 'cyrillic', 1),
  (11, 'согласно списку', 'согласно списку', 'soglasno spisku', 'cyrillic', 1), (12, 'анна тоо', 'анна тоо', 'anna too', 'cyrillic', 0), (13, 'acme trade ltd', 'acme trade', 'acme trade ltd', 'latin', 0),
  (14, 'acme trade', 'acme trade', 'acme trade', 'latin', 0), (15, '', '', '', 'unknown', 0), (16, 'ანა', 'ანა', 'ანა', 'georgian', 0), (17, '', '', '', 'unknown', 1)) t(k, normalized, no_legal, latin, script, garbage)""",
    "pair_cases": """SELECT k, a AS has_legal_form_1, b AS has_legal_form_2, c AS same_legal_form, 0 AS exact_match, d AS core_exact_match, j::DOUBLE AS token_jaccard, k::INT % 2 AS same_country, g AS is_garbage_2, g AS has_garbage_entity FROM (VALUES
  (0::BIGINT, 1, 0, 0, 1, 0.666667, 0), (1, 1, 1, 0, 1, 0.333333, 0), (2, 1, 1, 1, 1, 1.0, 0), (3, 0, 0, 1, 0, 1.0, 0), (4, 0, 0, 1, 0, 0.0, 1), (5, 1, 1, 0, 1, 0.333333, 0)) t(k, a, b, c, d, j, g)""",
    "chain_clusters": """WITH RECURSIVE e(a, b) AS (VALUES (4, 3), (1, 2), (3, 2), (7, 9), (9, 8), (12, 10), (12, 11)), r(n, m) AS (SELECT x, x FROM range(1, 23) t(x) UNION SELECT r.n, CASE WHEN r.m = e.a THEN e.b ELSE e.a END FROM r JOIN e ON r.m IN (e.a, e.b)),
c AS (SELECT n, min(m) AS l FROM r GROUP BY 1), z AS (SELECT l, count(*) AS k, dense_rank() OVER (ORDER BY count(*) = 1, l) - 1 AS o FROM c GROUP BY 1)
SELECT n::BIGINT AS idx, CASE WHEN k = 1 THEN 'single_' || n ELSE 'entity_' || lpad(o::VARCHAR, 8, '0') END AS entity_id, k AS cluster_size FROM c JOIN z USING (l)""",
    "conformed": "SELECT s_suppkey::BIGINT AS idx, s_suppkey::VARCHAR AS record_id, s_name AS party_name, NULL::VARCHAR AS country, NULL::DOUBLE AS ownership_share_pct FROM supplier",
}
