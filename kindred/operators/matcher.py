"""Pair scorers: a deterministic rule, logistic regression and random forest; scores, thresholds and edge filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from kindred.functions import names as N, similarity as S, values as V
from kindred.operators.features import model_feature_columns

#: A scorer adds ``duplicate_score`` to pairs with features.
Scorer = Callable[[DataFrame], DataFrame]


def assembled(pairs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return VectorAssembler(inputCols=columns or model_feature_columns(), outputCol="features", handleInvalid="error").transform(pairs)


def _balanced(pairs: DataFrame, label: str) -> tuple[DataFrame, float]:
    """Rows weighted by n / (2 x rows of their class), and the sum of weights."""
    sizes = {r[label]: r["n"] for r in pairs.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(sizes.values())
    weight = F.coalesce(*(F.when(F.col(label) == k, F.lit(n / (2.0 * v))) for k, v in sizes.items()), F.lit(1.0))
    return pairs.withColumn("_w", weight), float(n)


def train_logistic_regression(pairs: DataFrame, label: str = "label", columns: list[str] | None = None) -> PipelineModel:
    rows, total = _balanced(assembled(pairs, columns), label)
    model = LogisticRegression(featuresCol="features", labelCol=label, weightCol="_w", maxIter=1000, regParam=1.0 / max(total, 1.0), standardization=False).fit(rows)
    return _with_assembler(model, columns)


def train_random_forest(pairs: DataFrame, label: str = "label", columns: list[str] | None = None, trees: int = 300, depth: int = 12, leaf: int = 10, seed: int = 42) -> PipelineModel:
    rows, _ = _balanced(assembled(pairs, columns), label)
    model = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="_w", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed).fit(rows)
    return _with_assembler(model, columns)


def _with_assembler(model: Model, columns: list[str] | None) -> PipelineModel:
    return PipelineModel([VectorAssembler(inputCols=columns or model_feature_columns(), outputCol="features"), model])


def model_scorer(model: PipelineModel) -> Scorer:
    """``duplicate_score`` is the probability of class 1; ``duplicate_prediction`` the model's own decision."""

    def run(pairs: DataFrame) -> DataFrame:
        out = model.transform(pairs)
        return out.withColumns({"duplicate_score": vector_to_array("probability")[1], "duplicate_prediction": F.col("prediction").cast("int")}).drop("features", "rawPrediction", "probability", "prediction")

    return run


def rule_scorer(pairs: DataFrame) -> DataFrame:
    """1 for equal names or cores, 0.95 for a strong token overlap, else a share of the sorted-token ratio: deterministic, needs no training."""
    strong = (F.col("token_jaccard") >= 0.75) & (F.col("length_diff") <= 5) & (F.col("core_token_set_ratio") >= 95)
    score = F.when((F.col("exact_match") == 1) | (F.col("core_exact_match") == 1), 1.0).when(strong, 0.95).otherwise(F.col("token_sort_ratio") / 100.0 * 0.9)
    return pairs.withColumns({"duplicate_score": score, "duplicate_prediction": (score >= V.SCORE_THRESHOLD).cast("int")})


def rule_may_match(a: str = "name_latin_1", b: str = "name_latin_2") -> Column:
    """Without any edit ratio: whether ``rule_scorer`` can give a pair of names 0.9 or more. Only equal sorted tokens have a sorted-token ratio of 100."""
    x, y = N.text(a), N.text(b)
    s, t = N.tokens(x), N.tokens(y)
    near = (F.abs(F.length(x) - F.length(y)) <= 5) & (S.jaccard(s, t) >= 0.75)
    return (x == y) | (F.array_sort(s) == F.array_sort(t)) | near | (S.core_name(x) == S.core_name(y))


def garbage_rule(pairs: DataFrame, score: str = "duplicate_score") -> DataFrame:
    return pairs.withColumn(score, F.when(F.col("has_garbage_entity") == 1, F.lit(0.0)).otherwise(F.col(score)))


def decided(pairs: DataFrame, threshold: float = 0.5, score: str = "duplicate_score") -> DataFrame:
    return pairs.withColumn("duplicate_prediction", (F.col(score) >= threshold).cast("int"))


def predict_by_threshold(score: str, threshold: float):
    return (F.col(score) >= threshold).cast("int")


def confident_edges(pairs: DataFrame, threshold: float = 0.95, strict: float = 0.995) -> DataFrame:
    """Edges fit for clustering: above the threshold, without garbage, and exact, very confident or with a strong token overlap."""
    exact = (F.col("exact_match") == 1) | (F.col("core_exact_match") == 1)
    strong = (F.col("token_jaccard") >= 0.75) & (F.col("length_diff") <= 5) & (F.col("core_token_set_ratio") >= 95)
    clean = F.col("has_garbage_entity") == 0 if "has_garbage_entity" in pairs.columns else F.lit(True)
    score = F.col("duplicate_score")
    return pairs.where((score >= threshold) & clean & (exact | (score >= strict) | strong))


def deduplicate_edges(edges: DataFrame) -> DataFrame:
    """idx1 <= idx2 with the best score of each pair."""
    return edges.groupBy(F.least("idx1", "idx2").alias("idx1"), F.greatest("idx1", "idx2").alias("idx2")).agg(F.max("duplicate_score").alias("duplicate_score"))


def feature_importance(model: PipelineModel, columns: list[str] | None = None) -> DataFrame:
    from pyspark.sql import SparkSession

    names = columns or model_feature_columns()
    last = model.stages[-1]
    weights = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return SparkSession.getActiveSession().createDataFrame([(n, float(w)) for n, w in zip(names, weights.toArray())], "feature string, importance double").orderBy(F.desc("importance"), "feature")
