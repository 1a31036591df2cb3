"""Clusters, canonical entities and their quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.functions import values as V
from kindred.operators.graph import connected_components
from kindred.plans.scratch import Scratch


def duplicate_edges(pairs: DataFrame, threshold: float = 0.5, score: str = "duplicate_score") -> DataFrame:
    return pairs.where(F.col(score) >= threshold)


def build_clusters(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """idx, entity_id, cluster_size. Entities are numbered by their least idx: ``entity_00000000`` has the smallest.

    Numbers come from a range-partitioned sort of the component labels, a row each: local ranks plus the sizes of the partitions before.
    """
    scratch = scratch or Scratch(edges.sparkSession, "clusters")
    nodes = scratch.cut(connected_components(edges, "idx1", "idx2", scratch))
    sizes = nodes.groupBy("component").agg(F.count(F.lit(1)).cast("int").alias("cluster_size"))
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = scratch.cut(sizes.repartitionByRange(parts, "component").withColumn("_part", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("_part").orderBy("component"))
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = starts.withColumn("_before", before).drop("_n")  # a row for each partition
    number = (F.col("_local") + F.col("_before") - 1).cast("string")
    padded = F.when(F.length(number) < 8, F.lpad(number, 8, "0")).otherwise(number)
    numbered = ranged.withColumn("_local", local).join(F.broadcast(offsets), "_part").select("component", "cluster_size", F.concat(F.lit("entity_"), padded).alias("entity_id"))
    return nodes.join(numbered, "component").select(F.col("node").alias("idx"), "entity_id", "cluster_size")


def attach_clusters(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """Records without a cluster become entities of their own: ``single_<idx>``, size 1."""
    out = records.join(clusters, "idx", "left")
    return out.withColumns({"entity_id": F.coalesce("entity_id", F.concat(F.lit("single_"), F.col("idx").cast("string"))), "cluster_size": F.coalesce("cluster_size", F.lit(1)).cast("int")})


def most_frequent(c: str) -> Column:
    """The most frequent known value, the least of equals; null if none."""
    return F.mode(F.col(c), True)


def add_canonical_names(records: DataFrame, name: str = "name_latin") -> DataFrame:
    best = records.groupBy("entity_id").agg(F.coalesce(most_frequent(name), F.lit("")).alias("canonical_name"))
    return records.join(best, "entity_id", "left")


def first_values(records: DataFrame, column: str, out: str, cap: int = V.LIST_CAP) -> DataFrame:
    """entity_id and the first ``cap`` distinct values in order of idx: distinct values first, then ranks, so that no list outgrows the cap."""
    seen = records.where(F.col(column).isNotNull()).groupBy("entity_id", F.col(column).cast("string").alias("_v")).agg(F.min("idx").alias("_at"))
    nth = F.row_number().over(Window.partitionBy("entity_id").orderBy("_at", "_v"))
    few = seen.withColumn("_r", nth).where(F.col("_r") <= cap)
    return few.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_v"))), lambda x: x["_v"]).alias(out))


def canonical_entities(records: DataFrame, cap: int = V.LIST_CAP) -> DataFrame:
    """One row an entity: modes, size, distinct counts and capped lists."""
    out = records.groupBy("entity_id").agg(
        most_frequent("canonical_name").alias("canonical_name"), F.count(F.lit(1)).alias("cluster_size"), most_frequent("country").alias("canonical_country"),
        most_frequent("script").alias("canonical_script"), most_frequent("relation_kind").alias("main_relation_kind"), most_frequent("relation_role").alias("main_relation_role"),
        F.count_distinct("name_latin").alias("unique_names_count"), F.count_distinct("country").alias("unique_countries_count"), F.count_distinct("company_public_id").alias("unique_companies_count"),
    )
    lists = {"record_ids": "record_id", "original_names": "party_name", "normalized_names": "name_latin", "countries": "country", "companies": "company_public_id"}
    for name, column in lists.items():
        out = out.join(first_values(records, column, name, cap), "entity_id", "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({name: F.coalesce(name, empty) for name in lists})


def quality_flags(entities: DataFrame, large: int = 20, names: int = 5, countries: int = 3) -> DataFrame:
    many_names, many_countries = F.col("unique_names_count") > names, F.col("unique_countries_count") > countries
    return entities.withColumns({
        "is_singleton": (F.col("cluster_size") == 1).cast("int"), "is_large_cluster": (F.col("cluster_size") >= large).cast("int"), "has_many_names": many_names.cast("int"),
        "has_many_countries": many_countries.cast("int"), "is_suspicious_entity": (many_names | many_countries).cast("int"),
    })


def cluster_stats(records: DataFrame) -> DataFrame:
    have = {"unique_names": "name_latin", "unique_countries": "country", "unique_scripts": "script", "unique_relation_kinds": "relation_kind", "unique_companies": "company_public_id"}
    return records.groupBy("entity_id").agg(F.count(F.lit(1)).alias("cluster_size"), *(F.count_distinct(c).alias(n) for n, c in have.items()))


def large_clusters(stats: DataFrame, least: int = 20) -> DataFrame:
    return stats.where(F.col("cluster_size") >= least)


def suspicious_clusters(stats: DataFrame, names: int = 5, countries: int = 3) -> DataFrame:
    return stats.where((F.col("unique_names") > names) | (F.col("unique_countries") > countries)).orderBy(F.desc("cluster_size"), F.desc("unique_names"), "entity_id")


def size_distribution(records: DataFrame) -> DataFrame:
    """cluster_size, clusters, records."""
    sizes = records.groupBy("entity_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return sizes.groupBy("cluster_size").agg(F.count(F.lit(1)).alias("clusters")).withColumn("records", F.col("cluster_size") * F.col("clusters"))


def final_summary(records: DataFrame) -> DataFrame:
    sizes = records.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_records"), F.count(F.lit(1)).alias("unique_entities"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") > 1).alias("multi_record_entities"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("records_in_duplicates"), F.max("n").alias("largest_entity"),
    ).withColumn("compression", F.round(1 - F.try_divide("unique_entities", "input_records"), 6))


def entity_summary(entities: DataFrame) -> DataFrame:
    """Counts of each flag and the profile of sizes."""
    flags = ["is_singleton", "is_large_cluster", "has_many_names", "has_many_countries", "is_suspicious_entity"]
    return entities.agg(
        F.count(F.lit(1)).alias("entities"), *(F.sum(f).alias(f) for f in flags), F.avg("cluster_size").alias("mean_size"), F.percentile("cluster_size", F.lit(0.5)).alias("median_size"), F.max("cluster_size").alias("max_size"),
    )


def consistency(records: DataFrame, entities: DataFrame) -> DataFrame:
    """What must hold of finished tables, as counts: records, entities, records without an entity, entity ids on one side only, entities whose size is not their number of records."""
    sizes = records.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_n"))
    told = entities.select(F.col("entity_id").alias("_e"), F.col("cluster_size").alias("_k"))
    both = sizes.join(told, F.col("entity_id") == F.col("_e"), "full_outer")
    known, zero = F.col("entity_id").isNotNull(), F.lit(0)
    return both.agg(
        F.coalesce(F.sum("_n"), zero).alias("records"), F.count("_e").alias("entities"), F.coalesce(F.sum(F.when(~known & F.col("_e").isNull(), F.col("_n"))), zero).alias("without_entity"),
        F.count_if(known != F.col("_e").isNotNull()).alias("unknown_entities"), F.count_if(F.col("_n") != F.col("_k")).alias("wrong_sizes"),
    )
