"""Sources and sinks: declared schemas, tables on any Hadoop file system, exports, models and rows in memory."""

from __future__ import annotations

import json
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kindred.functions import values as V

RELATIONS = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("country", T.StringType()), T.StructField("source_snapshot_date", T.StringType()), T.StructField("relation_kind", T.StringType()),
    T.StructField("relation_role", T.StringType()), T.StructField("party_type", T.StringType()), T.StructField("company_public_id", T.StringType()), T.StructField("company_name_norm", T.StringType()),
    T.StructField("party_public_id", T.StringType()), T.StructField("party_name", T.StringType()), T.StructField("ownership_share_pct", T.DoubleType()),
])
GOLD = T.StructType([T.StructField(c, T.IntegerType() if c == "label" else T.StringType()) for c in (
    "label", "left_country", "right_country", "left_party_name", "right_party_name", "left_name_latin", "right_name_latin", "left_cluster_id", "right_cluster_id", "manual_label")])
EDGES = "idx1 long, idx2 long, duplicate_score double"


def conform(df: DataFrame, schema: T.StructType = RELATIONS) -> DataFrame:
    """The schema's columns in its types, nulls for those that are missing, then all others."""
    have = set(df.columns)
    own = [(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    return df.select(*own, *(F.col(c) for c in df.columns if c not in schema.fieldNames()))


def with_index(df: DataFrame, key: Column | str = "record_id") -> DataFrame:
    """``idx`` as a long that is the same on each run: an integer key as it is, any other by its hash."""
    c = F.col(key) if isinstance(key, str) else key
    whole = c.try_cast("long")
    return df.withColumn("idx", F.when(whole.isNotNull() & (whole >= 0), whole).otherwise(F.xxhash64(c).bitwiseAND(F.lit((1 << 62) - 1)) + (1 << 62)))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path))


def read_edges(spark: SparkSession, paths: list[str], tolerant: bool = False) -> DataFrame:
    """The union of the edge tables that exist (none: an empty one). Corrupt files fail, unless ``tolerant``."""
    have = [p for p in paths if exists(spark, p)]
    if not have:
        return spark.createDataFrame([], EDGES)
    reader = spark.read.option("ignoreCorruptFiles", str(tolerant).lower())
    return reader.schema(EDGES).parquet(*have)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Write unless the table is there already, then read it: a restarted run goes on from finished stages. Paths carry the run's id."""
    spark = df.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled; arrays as JSON. Each file begins with the byte-order mark that spreadsheet programs look for: Spark writes no bytes before the header, so the first column's name carries it."""
    flat = df.select(*(F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c in df.columns))
    marked = flat.withColumnRenamed(flat.columns[0], "﻿" + flat.columns[0])
    marked.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').schema(GOLD).csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def rows_table(spark: SparkSession, rows: list[dict[str, Any]], schema: T.StructType = RELATIONS) -> DataFrame:
    """Records in memory; what a record lacks is null."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def to_response(df: DataFrame) -> list[dict[str, Any]]:
    """A small result as plain objects."""
    return [json.loads(x) for x in df.toJSON().collect()]


def _export(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(c for c in columns if c in df.columns))


def export_deduplicated(df: DataFrame) -> DataFrame:
    return _export(df, V.DEDUPLICATED_EXPORT)


def export_entities(df: DataFrame) -> DataFrame:
    return _export(df, V.ENTITY_EXPORT)
