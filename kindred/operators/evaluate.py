"""Metrics of predictions: one aggregation each, however many rows, methods or thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.functions import similarity as S
from kindred.plans.scratch import Scratch


def _shares(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    precision, recall = zero(F.try_divide(tp, tp + fp)), zero(F.try_divide(tp, tp + fn))
    return {"accuracy": zero(F.try_divide(tp + tn, tp + fp + fn + tn)), "precision": precision, "recall": recall, "f1": zero(F.try_divide(2.0 * precision * recall, precision + recall))}


def metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    """Counts, accuracy, precision, recall and F1, for each group of ``by``; a share without cases is 0."""
    y, p = F.col(label), F.col(prediction)
    counts = df.groupBy(*by).agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    return counts.withColumns(_shares(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))))


def threshold_grid(df: DataFrame, scores: list[str], thresholds: list[float], label: str = "label") -> DataFrame:
    """method, threshold and metrics of every combination, from one aggregation."""
    grid = F.explode(F.array(*(F.struct(F.lit(s).alias("method"), F.lit(float(t)).alias("threshold"), (F.col(s) >= t).cast("int").alias("p")) for s in scores for t in thresholds)))
    return metrics(df.select(F.col(label).alias("label"), grid.alias("g")).select("label", "g.*"), "label", "p", ["method", "threshold"])


def sweep_thresholds() -> list[float]:
    return [round(0.10 + 0.05 * k, 2) for k in range(18)]


def best_baseline(grid: DataFrame) -> DataFrame:
    return grid.orderBy(F.desc("f1"), "method", "threshold").limit(1)


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """actual, predicted_0, predicted_1 for the actual classes 0 and 1."""
    both = df.sparkSession.createDataFrame([(0,), (1,)], "actual int")
    counts = df.groupBy(F.col(label).cast("int").alias("actual")).agg(F.count_if(F.col(prediction) == 0).alias("predicted_0"), F.count_if(F.col(prediction) == 1).alias("predicted_1"))
    return both.join(counts, "actual", "left").na.fill(0)


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """A row for each distinct score, so that curves need no sort of all rows."""
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def _running(points: DataFrame, descending: bool) -> DataFrame:
    """score, pos, neg and the sums tp, fp up to each score and with it. Scores are sorted in ranges and each range adds what those before it have, so no task sees all."""
    spark = points.sparkSession
    order = F.desc("score") if descending else F.asc("score")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = Scratch(spark, "curve").cut(points.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = ranged.groupBy("_part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    ahead = sizes.select("_part", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"))
    inside = Window.partitionBy("_part").orderBy(order)
    local = ranged.withColumns({"tp": F.sum("pos").over(inside), "fp": F.sum("neg").over(inside)})
    return local.join(F.broadcast(ahead), "_part").select("score", "pos", "neg", (F.col("tp") + F.col("_p")).alias("tp"), (F.col("fp") + F.col("_n")).alias("fp"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """score, tpr, fpr, precision, recall at each distinct score."""
    points = score_counts(df, label, score)
    total = points.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    joined = _running(points, descending=True).crossJoin(F.broadcast(total))
    recall = F.coalesce(F.try_divide("tp", "p"), F.lit(0.0))
    return joined.select("score", recall.alias("tpr"), F.coalesce(F.try_divide("fp", "n"), F.lit(0.0)).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), recall.alias("recall"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """auc by rank sums, ties shared; null if a class is missing."""
    points = _running(score_counts(df, label, score), descending=False)
    won = points.select("pos", "neg", (F.col("pos") * (F.col("fp") - F.col("neg") / 2.0)).alias("w"))
    return won.agg(F.try_divide(F.sum("w"), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def error_type() -> Column:
    """What kind of mistake a scored pair is."""
    y, p = F.col("label"), F.col("prediction")
    return (
        F.when(y == p, "correct")
        .when((y == 0) & (p == 1), F.when(F.col("token_jaccard") >= 0.5, "false_positive_similar_names").otherwise("false_positive_other"))
        .when((y == 1) & (p == 0), F.when(F.col("core_token_set_ratio") < 90, "false_negative_low_name_similarity").otherwise("false_negative_threshold"))
        .otherwise("unknown")
    )


def gold_pairs(df: DataFrame) -> DataFrame:
    """Hand-labelled pairs that are decided, with ``gold`` as a number."""
    return df.withColumn("gold", F.trim("manual_label").try_cast("int")).where(F.coalesce(F.col("gold").isin(0, 1), F.lit(False)))


def cluster_predictions(df: DataFrame) -> DataFrame:
    """``prediction`` is 1 where both sides are in one cluster."""
    return df.withColumn("prediction", S.same(F.col("left_cluster_id"), F.col("right_cluster_id")))


def error_category(left: str = "left_name_latin", right: str = "right_name_latin") -> Column:
    """How the names of a wrong pair differ; the first that fits."""
    a, b = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    like = S.sequence_udf(a, b)
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")
    return (
        F.when(like > 0.95, "near_exact_match")
        .when((F.array_sort(F.array_distinct(words(a))) == F.array_sort(F.array_distinct(words(b)))) & (a != b), "token_order_variation")
        .when(like > 0.85, "transliteration_variation")
        .when(F.coalesce(F.get(words(a), F.lit(0)), F.lit("")) == F.coalesce(F.get(words(b), F.lit(0)), F.lit("")), "same_first_name")
        .otherwise("other")
    )


def error_summary(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p, n = F.col(label), F.col(prediction), F.count(F.lit(1))
    return df.agg(
        n.alias("pairs"), F.count_if(y != p).alias("errors"), F.count_if((y == 0) & (p == 1)).alias("false_positives"), F.count_if((y == 1) & (p == 0)).alias("false_negatives"), F.try_divide(F.count_if(y != p), n).alias("error_rate"),
    )


def wrong_pairs(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The pairs that were decided wrongly, with the kind of mistake."""
    return df.where(F.col(label) != F.col(prediction)).withColumn("mistake", F.when(F.col(label) == 1, "false_negative").otherwise("false_positive"))


def evaluate_model(pairs: DataFrame, scorer, threshold: float = 0.5, label: str = "label", by: list[str] = ()) -> DataFrame:
    """Metrics of a scorer on labelled pairs with features, for each group of ``by``."""
    scored = scorer(pairs).withColumn("prediction", (F.col("duplicate_score") >= threshold).cast("int"))
    return metrics(scored, label, "prediction", by)
