"""Quality of weak labels: statistics per label id, similarity of its names, trusted and suspicious ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kindred.functions import similarity as S


def label_stats(records: DataFrame, label: str = "party_public_id", name: str = "name_latin", country: str = "country", script: str = "script") -> DataFrame:
    out = records.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("cluster_size"), F.count_distinct(name).alias("unique_names"), F.count_distinct(country).alias("countries"), F.count_distinct(script).alias("scripts")
    )
    return out.withColumn("unique_name_ratio", F.col("unique_names") / F.col("cluster_size"))


def label_similarity(records: DataFrame, label: str = "party_public_id", name: str = "name_latin", most: int = 20) -> DataFrame:
    """Mean and least sorted-token ratio between the first distinct names of each label id; 100 for a single name."""
    rows = records.where(F.col(label).isNotNull())
    names = rows.where(F.col(name).isNotNull()).groupBy(label, F.col(name).alias("n")).agg(F.min("idx").alias("at"))
    few = names.withColumn("r", F.row_number().over(Window.partitionBy(label).orderBy("at", "n"))).where(F.col("r") <= most)
    pairs = few.select(label, "n", "r").join(few.select(label, F.col("n").alias("n2"), F.col("r").alias("r2")), label).where("r < r2")
    told = pairs.groupBy(label).agg(F.avg(S.token_sort_udf("n", "n2")).alias("avg_name_similarity"), F.min(S.token_sort_udf("n", "n2")).alias("min_name_similarity"))
    return rows.select(label).distinct().join(told, label, "left").withColumns({c: F.coalesce(c, F.lit(100.0)) for c in ("avg_name_similarity", "min_name_similarity")})


def mark_trusted(stats: DataFrame, size: int = 20_000, names: int = 3, countries: int = 3, scripts: int = 3) -> DataFrame:
    return stats.withColumn("is_trusted", (F.col("cluster_size") <= size) & (F.col("unique_names") <= names) & (F.col("countries") <= countries) & (F.col("scripts") <= scripts))


def suspicious_labels(stats: DataFrame) -> DataFrame:
    return stats.where(~F.col("is_trusted")).orderBy(F.desc("cluster_size"), stats.columns[0])


def cross_language_like(stats: DataFrame, threshold: float = 50.0) -> DataFrame:
    return stats.where(F.col("avg_name_similarity") < threshold).orderBy("avg_name_similarity", stats.columns[0])


def label_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count(F.lit(1)).alias("ids"), F.count_if("is_trusted").alias("trusted"), F.try_divide(F.count_if("is_trusted"), F.count(F.lit(1))).alias("trusted_ratio"),
        F.avg("cluster_size").alias("mean_size"), F.percentile("cluster_size", F.lit(0.5)).alias("median_size"), F.max("cluster_size").alias("max_size"), F.avg("unique_names").alias("mean_names"),
    )
