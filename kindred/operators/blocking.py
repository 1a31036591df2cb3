"""Blocking keys, their statistics and the candidate pairs that they give.

Blocks of one row or of more than ``max_block_size`` rows give no pair. Block sizes are counted before any row meets another, so an over-large block
(a third of all rows, say) is never brought together: its rows leave by the semi-join with the blocks that count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.functions import names as N, values as V
from kindred.plans.scratch import Scratch


def first_token(c: Column | str) -> Column:
    return F.coalesce(F.get(N.tokens(N.safe_text(c)), F.lit(0)), F.lit(""))


def _or_unknown(c: Column) -> Column:
    return F.when(c == "", "unknown").otherwise(c)


def prefix_key(c: Column | str, n: int = 4) -> Column:
    return _or_unknown(F.substring(F.replace(N.safe_text(c), F.lit(" "), F.lit("")), 1, n))


def first_token_prefix_key(c: Column | str, n: int = 4) -> Column:
    return _or_unknown(F.substring(first_token(c), 1, n))


def sorted_tokens_key(c: Column | str) -> Column:
    return F.array_join(F.array_sort(N.tokens(N.safe_text(c))), " ")


def length_bucket(c: Column | str, size: int = 5) -> Column:
    return F.floor(F.length(N.safe_text(c)) / size).cast("int")


def token_count_bucket(c: Column | str) -> Column:
    return F.size(N.tokens(N.safe_text(c)))


def simple_block(c: Column | str) -> Column:
    return F.substring(N.text(c), 1, 3)


def make_block_keys(df: DataFrame, name: str = "name_latin") -> DataFrame:
    bucket = length_bucket(name).cast("string")
    return df.withColumns({
        "block_prefix_4": prefix_key(name),
        "block_first_token_4": first_token_prefix_key(name),
        "block_prefix_len": F.concat_ws("_", prefix_key(name), bucket),
        "block_first_token_len": F.concat_ws("_", first_token_prefix_key(name), bucket),
        "block_sorted_tokens": sorted_tokens_key(name),
    })


def block_sizes(df: DataFrame, key: str) -> DataFrame:
    """block_value, block_size; rows without a key count for no block."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("block_value")).agg(F.count(F.lit(1)).alias("block_size"))


def reduction_ratio(df: DataFrame, key: str) -> DataFrame:
    """total_pairs, block_pairs, reduction_ratio (null for fewer than two rows)."""
    n = F.col("n").cast("double")
    inner = F.col("block_size").cast("double")
    blocks = block_sizes(df, key).agg(F.coalesce(F.sum(inner * (inner - 1) / 2), F.lit(0.0)).alias("block_pairs"))
    whole = df.agg(F.count(F.lit(1)).alias("n")).select((n * (n - 1) / 2).alias("total_pairs"))
    return whole.crossJoin(blocks).withColumn("reduction_ratio", 1 - F.try_divide("block_pairs", "total_pairs"))


def is_generic(value: Column | str) -> Column:
    words = N.tokens(F.replace(N.safe_text(value), F.lit("_"), F.lit(" ")))
    return (F.size(words) == 0) | F.arrays_overlap(words, F.array(*map(F.lit, V.GENERIC_TOKENS)))


def stop_blocks(df: DataFrame, key: str, max_block_size: int = V.MAX_BLOCK_SIZE) -> DataFrame:
    """Blocks that are too large or generic: block_value, block_size, is_large_block, is_generic_block."""
    marked = block_sizes(df, key).withColumn("is_large_block", F.col("block_size") > max_block_size).withColumn("is_generic_block", is_generic("block_value"))
    return marked.where("is_large_block or is_generic_block")


def summarize_stop_blocks(stops: DataFrame) -> DataFrame:
    return stops.agg(
        F.count(F.lit(1)).alias("stop_blocks"), F.count_if("is_large_block").alias("large_blocks"), F.count_if("is_generic_block").alias("generic_blocks"),
        F.coalesce(F.sum("block_size"), F.lit(0)).alias("rows_in_stop_blocks"), F.max("block_size").alias("largest_block"),
    )


def filter_stop_blocks(df: DataFrame, key: str, stops: DataFrame) -> DataFrame:
    return df.join(stops.select(F.col("block_value").alias(key)).distinct(), key, "left_anti")


def _keyed(df: DataFrame, passes: list[str], within: list[str]) -> DataFrame:
    """One narrow row (idx, within.., pass, key) for each pass; null keys and null groups have none."""
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("block_col"), F.col(p).alias("block_value")) for p in passes))).alias("b")
    rows = df.select("idx", *within, each).select("idx", *within, "b.*").where("block_value is not null")
    for c in within:
        rows = rows.where(F.col(c).isNotNull())
    return rows


def block_pairs(df: DataFrame, passes: list[str] | None = None, max_block_size: int = V.MAX_BLOCK_SIZE, within: list[str] = ()) -> DataFrame:
    """idx1 < idx2 with block_col and block_value for every pair of every admissible block; ``within`` (country, say) joins the key."""
    within = list(within)
    rows = _keyed(df, passes or V.DEFAULT_PASSES, within)
    key = [*within, "block_col", "block_value"]
    good = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(2, max_block_size)).drop("_n")
    kept = rows.join(good, key, "left_semi")
    right = kept.withColumnRenamed("idx", "idx2")
    return kept.withColumnRenamed("idx", "idx1").join(right, key).where("idx1 < idx2").select("idx1", "idx2", "block_col", "block_value")


def candidate_pairs(df: DataFrame, passes: list[str] | None = None, max_block_size: int = V.MAX_BLOCK_SIZE, within: list[str] = ()) -> DataFrame:
    """Distinct (idx1, idx2) over all passes."""
    return block_pairs(df, passes, max_block_size, within).select("idx1", "idx2").distinct()


def oriented(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"idx1": F.least("idx1", "idx2"), "idx2": F.greatest("idx1", "idx2")})


def deduplicate_pairs(pairs: DataFrame) -> DataFrame:
    return oriented(pairs).dropDuplicates(["idx1", "idx2"])


def blocking_recall(labelled: DataFrame, candidates: DataFrame) -> DataFrame:
    """positives, found, recall: the share of distinct positive pairs among the candidates, 0 without positives."""
    positives = oriented(labelled.where("label = 1").select("idx1", "idx2")).distinct()
    found = positives.join(oriented(candidates.select("idx1", "idx2")).distinct().withColumn("_hit", F.lit(1)), ["idx1", "idx2"], "left")
    return found.agg(F.count(F.lit(1)).alias("positives"), F.count("_hit").alias("found")).withColumn("recall", F.coalesce(F.try_divide("found", "positives"), F.lit(0.0)))


def banded_pairs(df: DataFrame, name: str = "name_latin", band: int = 199, least: float = 0.85) -> DataFrame:
    """Pairs of names at most ``band`` apart in name order whose normalised Levenshtein similarity is above ``least``.

    Positions come from a range-partitioned sort: row numbers within each partition plus the counts of those before it, so no task sees all rows.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = Scratch(spark, "band").cut(df.select("idx", F.col(name).alias("name")).repartitionByRange(parts, "name", "idx").withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy("name", "idx")))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = local.join(F.broadcast(before), "_part").select("idx", "name", (F.col("_at") + F.col("_before")).alias("at"))
    left = placed.withColumn("bin", F.explode(F.array(F.floor(F.col("at") / band), F.floor(F.col("at") / band) + 1)))
    right = placed.select(F.col("idx").alias("idx2"), F.col("name").alias("name2"), F.col("at").alias("at2"), F.floor(F.col("at") / band).alias("bin"))
    near = left.join(right, "bin").where((F.col("at2") > F.col("at")) & (F.col("at2") - F.col("at") <= band))
    longest = F.greatest(F.length("name"), F.length("name2"), F.lit(1))
    score = 1 - F.levenshtein("name", "name2") / longest
    return near.select(F.col("idx").alias("idx1"), "idx2", score.alias("similarity")).where(F.col("similarity") > least)
