"""Registered queries of sources, sinks, the service, reports and rules that the batch queries don't pass through, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred import queries as Q
from kindred.functions import names as N
from kindred.operators import augment as A, blocking as B, cleaning as C, entities as E, evaluate as M, features as P, labels as L, matcher as X, pairs as J
from kindred.plans import dedup
from kindred.plans.scratch import Scratch
from kindred.plans.service import Engine, search_index
from kindred.queries import _CLUSTER, _KEYED, _PAIRED, _PASS, _QUALITY, _REC, _rounded, _scored_labels, records, table
from kindred.sources import tables as T


def _folder(spark, name: str) -> str:
    return Scratch(spark, name).root


# --- sources and sinks -----------------------------------------------------------------------------------------------------------


def stored_stage(spark, sf):
    """A stage that is there already is read, whatever a second run would write."""
    at = f"{_folder(spark, 'stage')}/nation"
    T.write_once(table(spark, sf, "nation"), at)
    return T.write_once(table(spark, sf, "nation").limit(0), at)


def stored_relations(spark, sf):
    """Relations written by country and read back in the declared schema."""
    at = _folder(spark, "relations")
    raw = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("record_id"), F.col("p_name").alias("party_name"), F.col("p_brand").alias("country"))
    T.write_parquet(raw, at, "country")
    return T.read_relations(spark, at).select("record_id", "country", "party_name", "party_type", "ownership_share_pct")


def stored_edges(spark, sf):
    """Two edge tables together; a path that doesn't exist and a file that is no parquet add nothing."""
    at = _folder(spark, "edges")
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("idx1"), (F.col("p_partkey") + 1).cast("long").alias("idx2"), F.lit(0.9).alias("duplicate_score"))
    for k in (0, 1):
        T.write_parquet(rows.where(F.col("idx1") % 2 == k), f"{at}/{k}")
    rows.limit(1).select(F.lit("no parquet").alias("line")).write.text(f"{at}/broken")
    return T.read_edges(spark, [f"{at}/0", f"{at}/1", f"{at}/absent", f"{at}/broken"], tolerant=True)


def csv_export(spark, sf):
    """Lists leave as JSON, and the file begins with the byte-order mark."""
    at = _folder(spark, "csv")
    both = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    T.write_csv(both.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("nations")), at)
    begins = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(at).agg(F.every(F.col("content").substr(1, 3) == F.lit(b"\xef\xbb\xbf")).alias("marked"))
    back = spark.read.option("escape", '"').schema("r_name string, nations string").option("header", True).option("enforceSchema", True).csv(at)
    return back.crossJoin(begins)


def gold_metrics(spark, sf):
    """Reviewed pairs from CSV: undecided ones go, and two records in one cluster count as predicted."""
    at = _folder(spark, "gold")
    said = F.element_at(F.array(*map(F.lit, ("0", "1", "unsure", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    sides = [F.concat(F.lit("c"), (F.col("doc_id") % k).cast("string")).alias(f"{side}_cluster_id") for side, k in (("left", 3), ("right", 2))]
    rows = table(spark, sf, "labels").select(F.col("quality").alias("label"), *sides, said.alias("manual_label"))
    ready = rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast("string").alias(f.name) for f in T.GOLD.fields))
    ready.write.option("header", True).csv(at)
    return _rounded(M.metrics(M.cluster_predictions(M.gold_pairs(T.read_gold(spark, at))), "gold"))


def stored_model(spark, sf):
    """A saved and reloaded model scores as before, and has a weight for each feature."""
    rows, at = Q._labelled_pairs(spark, sf), _folder(spark, "model")
    model = X.train_logistic_regression(rows.where("split = 'train'"))
    T.save_model(model, at)
    one, two = (X.model_scorer(m)(rows).select("pair_key", F.col("duplicate_score").alias(name)) for m, name in ((model, "a"), (T.load_model(at), "b")))
    differ = one.join(two, "pair_key").agg(F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-9).alias("differing"))
    return differ.crossJoin(X.feature_importance(model).agg(F.count(F.lit(1)).alias("features")))


def json_rows(spark, sf):
    """Rows as the service's plain objects, and back."""
    objects = T.to_response(table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("record_id"), F.col("n_name").alias("party_name")))
    return T.rows_table(spark, objects).select("record_id", "party_name", "country")


def deduplicated_export(spark, sf):
    return T.export_deduplicated(Q._deduplicated(spark, sf)[0])


# --- filters, labels, rules ------------------------------------------------------------------------------------------------------


def cleaned_rows(spark, sf):
    """Placeholders and names without a known script go; dates in five formats or, in one country only, Unix seconds."""
    k, name = F.col("p_partkey").cast("long"), F.col("p_name")
    said = F.array(*map(F.lit, ("2024-01-31T10:20:30", "2024-01-31 10:20:30", "2024-01-31", "31.01.2024", "2024/01/31")))
    raw = table(spark, sf, "part").select(
        k.alias("idx"), F.when(k % 7 == 0, k.cast("string")).when(k % 5 == 0, F.concat(F.lit("ЗАМЕНИТЕ НА "), name)).otherwise(name).alias("party_name"), F.when(k % 6 == 0, "tjk").otherwise("arm").alias("country"),
        F.when(k % 3 == 0, (k + 1_700_000_000).cast("string")).otherwise(F.element_at(said, (k % 11 % 5 + 1).cast("int"))).alias("source_snapshot_date"),
    )
    return C.clean_dataset(raw).select("idx", "party_name", "script", "date")


def label_split(spark, sf):
    told, search = C.split_by_label(records(spark, sf).withColumn("party_public_id", F.when(F.col("idx") % 3 > 0, F.col("party_public_id"))))
    return told.select("idx", F.lit("train").alias("part")).unionByName(search.select("idx", F.lit("search").alias("part")))


def suspicious_ids(spark, sf):
    return L.suspicious_labels(L.mark_trusted(L.label_stats(records(spark, sf)), 1, 1, 1)).select("party_public_id", "cluster_size", "unique_names", "countries")


def cross_language_ids(spark, sf):
    return L.cross_language_like(_rounded(L.label_similarity(records(spark, sf))))


def label_report(spark, sf):
    return _rounded(L.label_summary(L.mark_trusted(L.label_stats(records(spark, sf)), 5, 6, 6)))


def text_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", B.token_count_bucket("text").alias("tokens"), F.sha2(N.safe_lower("text"), 256).alias("lowered"))


def stop_block_summary(spark, sf):
    return B.summarize_stop_blocks(B.stop_blocks(B.make_block_keys(records(spark, sf)), "block_prefix_4", 20))


def pair_keys(spark, sf):
    """Pairs that come twice, either way round, once, with the group of their labels."""
    rows = records(spark, sf)
    pairs = B.candidate_pairs(B.make_block_keys(rows), within=["country"])
    both = pairs.unionByName(pairs.select(F.col("idx2").alias("idx1"), F.col("idx1").alias("idx2")))
    once = J.attach_records(J.remove_duplicate_pairs(both), rows, ["party_public_id"])
    return once.select("pair_left", "pair_right", "pair_key", J.entity_group().alias("entity_group"))


def undirected_pairs(spark, sf):
    pairs = B.block_pairs(B.make_block_keys(records(spark, sf))).select("idx1", "idx2")
    return B.deduplicate_pairs(pairs.unionByName(pairs.select(F.col("idx2").alias("idx1"), F.col("idx1").alias("idx2"))))


def positive_pair_counts(spark, sf):
    """How many pairs each label of three records or more has: all, or the cap; and how many of them join two labels (none)."""
    rows = records(spark, sf)
    trusted = L.label_stats(rows).where("cluster_size >= 3").select("party_public_id")
    beside = J.attach_records(J.positive_pairs(rows, trusted), rows, ["party_public_id"])
    return beside.groupBy(F.col("party_public_id_1").alias("party_public_id")).agg(F.count_distinct("idx1", "idx2").alias("pairs"), F.count_if(F.col("party_public_id_1") != F.col("party_public_id_2")).alias("astray"))


def easy_negative_counts(spark, sf):
    rows = records(spark, sf)
    beside = J.attach_records(J.easy_negative_pairs(rows, 2000), rows, ["party_public_id"])
    return beside.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("idx1", "idx2").alias("distinct_pairs"), F.count_if(F.col("party_public_id_1") == F.col("party_public_id_2")).alias("astray"))


def split_groups(spark, sf):
    """No group of labels lies in two splits."""
    groups = Q.pair_groups(spark, sf).groupBy("entity_group").agg(F.count_distinct("split").alias("n"))
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("divided"))


def augmented_counts(spark, sf):
    return Q.augmented_pairs(spark, sf).groupBy("pair_type", "label").agg(F.count(F.lit(1)).alias("pairs"))


def mutation_rules(spark, sf):
    """What each mutation must leave of a name, whichever place or word its hash picks."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("idx"), F.concat_ws(" ", "p_name", F.lit("oğlu ltd")).alias("name"))
    name, key = F.col("name"), F.col("idx").cast("string")
    words, chars = (lambda c: F.array_sort(N.tokens(c))), (lambda c: F.array_sort(F.split(c, "")))
    less, turned, moved, fewer, more, cased = (f(name, key) for f in (A.delete_char, A.swap_chars, A.swap_words, A.drop_word, A.add_legal_form, A.change_case))
    return rows.select(
        "idx", A.drop_patronymic(name).alias("no_last"), A.drop_legal_form(name).alias("no_form"), A.national_char(name, key).alias("national"),
        ((F.length(less) == F.length(name) - 1) & (F.levenshtein(less, name) == 1)).alias("one_char_less"),
        ((chars(turned) == chars(name)) & (F.levenshtein(turned, name) <= 2)).alias("neighbours_turned"),
        ((words(moved) == words(name)) & (moved != name)).alias("words_moved"),
        ((F.size(N.tokens(fewer)) == 3) & (F.size(F.array_except(words(fewer), words(name))) == 0)).alias("one_word_less"),
        ((F.size(N.tokens(more)) == 5) & F.contains(more, name)).alias("one_word_more"), ((F.lower(cased) == F.lower(name)) & (cased != name)).alias("only_case"),
    )


def threshold_predictions(spark, sf):
    return _scored_labels(spark, sf).groupBy(X.predict_by_threshold("score", 0.25).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def best_baseline(spark, sf):
    """Of two scores and eighteen thresholds the pair with the best F1."""
    return _rounded(M.best_baseline(M.threshold_grid(_scored_labels(spark, sf).withColumn("half", F.col("score") / 2), ["score", "half"], M.sweep_thresholds())))


def error_types(spark, sf):
    """Mistakes of the length score, typed by two made features."""
    rows = _scored_labels(spark, sf).withColumns({"token_jaccard": (F.col("score") * 1000 % 10) / 10, "core_token_set_ratio": F.col("score") * 1000 % 101})
    return rows.groupBy(M.error_type().alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def pair_report(spark, sf):
    pairs = Q._country_pairs(spark, sf).withColumn("label", (F.col("name_latin_1") == F.col("name_latin_2")).cast("int"))
    return J.pair_summary(pairs.withColumn("pair_type", F.when(F.col("relation_kind_1") == F.col("relation_kind_2"), "one_kind").otherwise("two_kinds")))


def sequence_ratios(spark, sf):
    return _rounded(Q.name_pairs(spark, sf).select("a", "b", Q.S.sequence_udf("a", "b").alias("sequence_ratio")))


# --- entities and service --------------------------------------------------------------------------------------------------------


def entity_report(spark, sf):
    return _rounded(E.entity_summary(Q._deduplicated(spark, sf)[1]))


def consistency(spark, sf):
    return E.consistency(*Q._deduplicated(spark, sf))


def whole_batch(spark, sf):
    """The batch plan with its stages as tables."""
    return dedup.run_batch(records(spark, sf), _folder(spark, "batch"))[1].select("entity_id", "cluster_size", "canonical_name", "canonical_country")


def service_status(spark, sf):
    """The service loaded from a written search index."""
    at = _folder(spark, "index")
    T.write_parquet(search_index(records(spark, sf)), at)
    status = Engine.load(spark, at).status()
    return spark.createDataFrame([(status["status"], status["records"], len(status["endpoints"]))], "status string, records long, endpoints int")


def duplicate_checks(spark, sf):
    """One pair at a time: equal, words turned, another script and a legal form, garbage, nothing in common."""
    sides = [("Acme Trade", "ACME trade!"), ("Petrov Ivan", "Ivan Petrov"), ("ООО Ромашка", "Romashka"), ("unknown", "unknown"), ("abc", "xyz")]
    told = [Engine(spark).check_duplicate({"party_name": a}, {"party_name": b}) for a, b in sides]
    return spark.createDataFrame([(k, float(t["duplicate_probability"]), bool(t["is_duplicate"])) for k, t in enumerate(told)], "k long, probability double, is_duplicate boolean")


def batch_service(spark, sf):
    """A batch of records through the service; single records' entities carry their position, so only their kind is shown."""
    rows = [{"party_name": n, "country": "arm", "record_id": i} for n, i in (("Ivan Petrov", "a"), ("Petrov Ivan", "b"), ("IVAN PETROV", None), ("Acme LLC", "d"), ("Acme", "e"), ("unknown", "f"), ("unknown", "g"), ("ანა", "h"))]
    out = Engine(spark).deduplicate(rows)[0]
    return out.select("record_id", F.col("cluster_size").cast("long").alias("cluster_size"), "canonical_name", F.when(F.col("cluster_size") > 1, F.col("entity_id")).otherwise("single").alias("entity"))


QUERIES = {f.__name__: f for f in (
    stored_stage, stored_relations, stored_edges, csv_export, gold_metrics, stored_model, json_rows, deduplicated_export, cleaned_rows, label_split, suspicious_ids, cross_language_ids, label_report, text_tokens,
    stop_block_summary, pair_keys, undirected_pairs, positive_pair_counts, easy_negative_counts, split_groups, augmented_counts, mutation_rules, threshold_predictions, best_baseline, error_types, pair_report,
    sequence_ratios, entity_report, consistency, whole_batch, service_status, duplicate_checks, batch_service,
)}

# --- SQL -------------------------------------------------------------------------------------------------------------------------

_STATS = f"{_REC}, st AS (SELECT label, count(*) AS n, count(DISTINCT nm) AS names, count(DISTINCT country) AS countries, count(*) <= 5 AND count(DISTINCT nm) <= 6 AND count(DISTINCT country) <= 6 AS ok FROM rec GROUP BY 1)"
_GROUPED = f"{_REC}, lab AS (SELECT label, count(*) AS n FROM rec GROUP BY 1 HAVING count(*) > 1), most AS (SELECT label, least(n * (n - 1) // 2, 50) AS pairs FROM lab)"

SQL = {
    "stored_stage": "SELECT * FROM nation",
    "stored_relations": "SELECT p_partkey::VARCHAR AS record_id, p_brand AS country, p_name AS party_name, NULL::VARCHAR AS party_type, NULL::DOUBLE AS ownership_share_pct FROM part",
    "stored_edges": "SELECT p_partkey::BIGINT AS idx1, p_partkey::BIGINT + 1 AS idx2, 0.9::DOUBLE AS duplicate_score FROM part",
    "csv_export": "SELECT r_name, to_json(list(n_name ORDER BY n_name))::VARCHAR AS nations, true AS marked FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "gold_metrics": f"""WITH s AS (SELECT (doc_id % 4)::INT AS label, (doc_id % 3 = doc_id % 2)::INT AS prediction FROM labels WHERE doc_id % 4 < 2), c AS (SELECT {Q._COUNTS} FROM s) SELECT {Q._METRICS} FROM c""",
    "stored_model": "SELECT 0::BIGINT AS differing, 26::BIGINT AS features",
    "json_rows": "SELECT n_nationkey::VARCHAR AS record_id, n_name AS party_name, NULL::VARCHAR AS country FROM nation",
    "deduplicated_export": f"""WITH {_CLUSTER} SELECT idx::VARCHAR AS record_id, country, kind AS relation_kind, role::VARCHAR AS relation_role, company AS company_public_id, label AS party_public_id, party_name, nm AS name_latin, entity_id,
  cluster_size::INT AS cluster_size, canonical_name FROM dedup""",
    "cleaned_rows": """SELECT p_partkey::BIGINT AS idx, p_name AS party_name, 'latin' AS script, CASE WHEN p_partkey % 6 = 0 THEN TIMESTAMP '1970-01-01' + to_seconds(1700000000 + p_partkey) WHEN p_partkey % 3 = 0 THEN NULL
  WHEN p_partkey % 11 % 5 < 2 THEN TIMESTAMP '2024-01-31 10:20:30' ELSE TIMESTAMP '2024-01-31' END AS date FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 7 > 0""",
    "label_split": "SELECT p_partkey::BIGINT AS idx, CASE WHEN p_partkey % 3 > 0 THEN 'train' ELSE 'search' END AS part FROM part",
    "suspicious_ids": f"WITH {_STATS} SELECT label AS party_public_id, n AS cluster_size, names AS unique_names, countries FROM st WHERE n > 1 OR names > 1 OR countries > 1",
    "cross_language_ids": f"SELECT * FROM ({Q.SQL['label_similarity']}) WHERE avg_name_similarity < 50",
    "label_report": f"""WITH {_STATS} SELECT count(*) AS ids, count(*) FILTER (ok) AS trusted, round(count(*) FILTER (ok) / count(*), 6) AS trusted_ratio, round(avg(n), 6) AS mean_size, quantile_cont(n, 0.5)::DOUBLE AS median_size,
  max(n) AS max_size, round(avg(names), 6) AS mean_names FROM st""",
    "text_tokens": r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''))::INT AS tokens, sha256(lower(coalesce(text, ''))) AS lowered FROM documents",
    "stop_block_summary": f"""WITH {_REC}, {_KEYED}, b AS (SELECT block_prefix_4 AS v, count(*) AS block_size FROM keyed GROUP BY 1),
s AS (SELECT *, block_size > 20 AS is_large_block, v IN ('unknown', 'firm') AS is_generic_block FROM b WHERE block_size > 20 OR v IN ('unknown', 'firm')) SELECT count(*) AS stop_blocks, count(*) FILTER (is_large_block) AS large_blocks, count(*) FILTER (is_generic_block) AS generic_blocks,
  coalesce(sum(block_size), 0)::BIGINT AS rows_in_stop_blocks, max(block_size) AS largest_block FROM s""",
    "pair_keys": f"""WITH {_PAIRED} SELECT idx1 AS pair_left, idx2 AS pair_right, idx1 || '_' || idx2 AS pair_key, least(x.label, y.label) || '__' || greatest(x.label, y.label) AS entity_group
FROM cand JOIN rec x ON x.idx = idx1 JOIN rec y ON y.idx = idx2""",
    "undirected_pairs": f"WITH {_REC}, {_KEYED}, {_PASS} SELECT idx1, idx2 FROM cand",
    "positive_pair_counts": f"WITH {_GROUPED} SELECT label AS party_public_id, pairs, 0::BIGINT AS astray FROM most JOIN lab USING (label) WHERE n >= 3",
    "easy_negative_counts": "SELECT 2000::BIGINT AS pairs, 2000::BIGINT AS distinct_pairs, 0::BIGINT AS astray",
    "split_groups": f"WITH {_GROUPED} SELECT count(*) AS groups, 0::BIGINT AS divided FROM most",
    "augmented_counts": f"""WITH {_GROUPED}, t AS (SELECT sum(pairs)::BIGINT AS n FROM most) SELECT 'positive_same_public_id' AS pair_type, 1 AS label, n AS pairs FROM t
UNION ALL SELECT 'augmented_positive', 1, least(n, 500) FROM t""",
    "mutation_rules": """SELECT p_partkey::BIGINT AS idx, p_name || ' oğlu' AS no_last, p_name || ' oğlu' AS no_form, p_name || ' oglu ltd' AS national, true AS one_char_less, true AS neighbours_turned, true AS words_moved,
  true AS one_word_less, true AS one_word_more, true AS only_case FROM part""",
    "threshold_predictions": f"WITH {_QUALITY} SELECT (score >= 0.25)::INT AS predicted, count(*) AS n FROM s GROUP BY 1",
    "best_baseline": f"""WITH {_QUALITY}, m AS (SELECT 'score' AS method, label, score AS v FROM s UNION ALL SELECT 'half', label, score / 2 FROM s),
g AS (SELECT method, t AS threshold, label, (v >= t)::INT AS prediction FROM m, (SELECT round(0.1 + 0.05 * k, 2)::DOUBLE AS t FROM range(18) r(k))), c AS (SELECT method, threshold, {Q._COUNTS} FROM g GROUP BY 1, 2),
o AS (SELECT method, threshold, {Q._METRICS}, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f FROM c ORDER BY round(f, 12) DESC NULLS LAST, method, threshold LIMIT 1) SELECT * EXCLUDE (f) FROM o""",
    "error_types": f"""WITH {_QUALITY}, e AS (SELECT label, prediction, round(score * 1000)::INT % 10 AS j, round(score * 1000)::INT % 101 AS c FROM s)
SELECT CASE WHEN label = prediction THEN 'correct' WHEN label = 0 THEN CASE WHEN j >= 5 THEN 'false_positive_similar_names' ELSE 'false_positive_other' END WHEN c < 90 THEN 'false_negative_low_name_similarity'
  ELSE 'false_negative_threshold' END AS error_type, count(*) AS n FROM e GROUP BY 1""",
    "pair_report": f"""WITH {_PAIRED}, t AS (SELECT (a = b)::INT AS label, CASE WHEN k1 = k2 THEN 'one_kind' ELSE 'two_kinds' END AS pair_type FROM pr)
SELECT label, pair_type, count(*) AS pairs, round(100.0 * count(*) / (SELECT count(*) FROM t), 2)::DOUBLE AS percent FROM t GROUP BY 1, 2""",
    "entity_report": f"""WITH {_CLUSTER}, o AS (SELECT entity_id, count(*) AS k, count(DISTINCT nm) > 5 AS names, count(DISTINCT country) > 3 AS countries FROM dedup GROUP BY 1)
SELECT count(*) AS entities, count(*) FILTER (k = 1) AS is_singleton, count(*) FILTER (k >= 20) AS is_large_cluster, count(*) FILTER (names) AS has_many_names, count(*) FILTER (countries) AS has_many_countries,
  count(*) FILTER (names OR countries) AS is_suspicious_entity, round(avg(k), 6) AS mean_size, quantile_cont(k, 0.5)::DOUBLE AS median_size, max(k) AS max_size FROM o""",
    "consistency": f"WITH {_CLUSTER} SELECT count(*) AS records, count(DISTINCT entity_id) AS entities, 0::BIGINT AS without_entity, 0::BIGINT AS unknown_entities, 0::BIGINT AS wrong_sizes FROM dedup",
    "whole_batch": f"""WITH {_CLUSTER}, c AS (SELECT entity_id, country, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, country) AS r FROM dedup GROUP BY 1, 2)
SELECT entity_id, count(*) AS cluster_size, any_value(canonical_name) AS canonical_name, any_value(c.country) AS canonical_country FROM dedup JOIN c USING (entity_id) WHERE r = 1 GROUP BY 1""",
    "service_status": "SELECT 'ok' AS status, count(*) AS records, 3 AS endpoints FROM part",
    # Worked out by hand from the rules.
    "duplicate_checks": "SELECT * FROM (VALUES (0::BIGINT, 1.0::DOUBLE, true), (1, 0.95, true), (2, 1.0, true), (3, 0.0, false), (4, 0.0, false)) t(k, probability, is_duplicate)",
    "batch_service": """SELECT * FROM (VALUES ('a', 3::BIGINT, 'ivan petrov', 'entity_00000000'), ('b', 3, 'ivan petrov', 'entity_00000000'), ('batch_record_2', 3, 'ivan petrov', 'entity_00000000'),
  ('d', 2, 'acme', 'entity_00000001'), ('e', 2, 'acme', 'entity_00000001'), ('f', 1, 'unknown', 'single'), ('g', 1, 'unknown', 'single'), ('h', 1, 'ანა', 'single')) t(record_id, cluster_size, canonical_name, entity)""",
}
