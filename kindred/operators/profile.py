"""Profiles of tables: nulls, frequencies, cross-tables, spans, quartiles, histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.functions import names as N
from kindred.operators import nearest


def null_profile(df: DataFrame) -> DataFrame:
    """column, nulls, percent: one pass, whatever the number of columns."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns)))
    return one.select("_n", rows.alias("x")).select("x.column", "x.nulls", F.round(100.0 * F.try_divide("x.nulls", "_n"), 2).alias("percent"))


def fill_rates(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    return df.groupBy(F.col(label).isNotNull().alias("labelled")).agg(*(F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in columns))


def value_shares(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """value, n, share, most frequent first if limited."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(column).alias("_all"))
    out = counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("_all")).alias("share"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def crosstab(df: DataFrame, rows: str, columns: str, values: list, share: bool = False) -> DataFrame:
    counts = df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0)
    if not share:
        return counts
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return counts.select(rows, *(F.try_divide(F.col(f"`{v}`"), total).alias(str(v)) for v in values))


def group_profile(df: DataFrame, by: str, date: str, keys: list[str]) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("first"), F.max(date).alias("last"), *(F.count_distinct(k).alias(f"unique_{k}") for k in keys))


def size_buckets(df: DataFrame, key: str, top: int = 5) -> DataFrame:
    """bucket ('1', '2', .. and 'top+'), clusters."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(F.when(F.col("n") >= top, f"{top}+").otherwise(F.col("n").cast("string")).alias("bucket")).agg(F.count(F.lit(1)).alias("clusters"))


def size_profile(df: DataFrame, key: str) -> DataFrame:
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("clusters"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("max"))


def variation(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Distinct values per key, for keys with at least two rows."""
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(c).alias(f"unique_{c}") for c in columns))
    return out.where("n >= 2")


def shared_names(df: DataFrame, name: str, key: str) -> DataFrame:
    """Names that more than one key has."""
    return df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count_distinct(key).alias("keys")).where("keys > 1")


def duplicate_groups(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def spelling_variants(df: DataFrame, latin: str = "name_latin", original: str = "party_name") -> DataFrame:
    """Distinct originals of each Latin name that has several: their number, and the originals themselves in order."""
    each = df.where(F.col(latin).isNotNull() & F.col(original).isNotNull()).select(latin, original).distinct()
    return each.groupBy(latin).agg(F.count(F.lit(1)).alias("variants"), F.sort_array(F.collect_list(original)).alias("originals")).where("variants > 1")


def duplicate_flags(df: DataFrame, key: str) -> DataFrame:
    """``is_duplicate`` where the key occurs more than once; counted before the join, so a hot key is no window partition."""
    often = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(often, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("is_duplicate", F.col("_n") > 1).drop("_k", "_n")


def date_spans(df: DataFrame, key: str, date: str) -> DataFrame:
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count_distinct(date).alias("dates"))
    return out.withColumn("days", N.days_between(F.col("first"), F.col("last")))


def longest_spans(df: DataFrame, key: str, date: str, n: int = 10) -> DataFrame:
    return date_spans(df, key, date).orderBy(F.desc("days"), key).limit(n)


def year_counts(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy(F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def numeric_profile(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.min(c).alias("min"), F.max(c).alias("max"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bucket (from 1; values are clipped to the range), n."""
    clipped = F.least(F.greatest(F.col(column).cast("double"), F.lit(low)), F.lit(high))
    bucket = F.least(F.floor((clipped - low) / F.lit((high - low) / bins)) + 1, F.lit(bins)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def grouped_describe(df: DataFrame, by: str, column: str) -> DataFrame:
    c = F.col(column)
    at = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("std"), F.min(c).alias("min"), at.alias("_q"), F.max(c).alias("max"))
    return out.select(by, "n", "mean", "std", "min", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), "max")


def name_flags(df: DataFrame, name: str, forms: list[str] = ()) -> DataFrame:
    """Counts of names in capitals, with digits, special characters or initials, and of those that mention each legal form."""
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in N.name_profile(name).items()), *(F.count_if(N.mentions(name, f)).alias(f"form_{f}") for f in forms))


def tfidf_neighbours(df: DataFrame, key: str, text: str, k: int = 20, sizes: tuple[int, ...] = (2, 3, 4), queries: DataFrame | None = None) -> DataFrame:
    """key, other, cosine of the k nearest texts of each of ``queries`` (rows of ``df``; all of them by default) by TF-IDF over character n-grams within words, padded by a space.

    All grams count, in weights and norms. Texts meet over shared grams, so a large table needs a stated query set: the work is that of the queries' grams times their postings. Ties by key.
    """
    words = N.tokens(F.lower(N.text(text)))

    def grams(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        all_ = []
        for at, n in enumerate(sizes):  # a word no longer than n is one gram, and gives none of the larger sizes
            each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))  # noqa: B023
            all_.append(each if not at else F.when(F.length(padded) > sizes[at - 1], each).otherwise(F.array().cast("array<string>")))
        return F.flatten(F.array(*all_))

    rows = df.select(F.col(key).alias("a"), F.explode(F.flatten(F.transform(words, grams))).alias("g")).groupBy("a", "g").agg(F.count(F.lit(1)).alias("tf"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    weights = rows.groupBy("g").agg(F.count(F.lit(1)).alias("df")).crossJoin(total).select("g", (F.log((1.0 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))
    told = rows.join(weights, "g").select("a", "g", (F.col("tf") * F.col("idf")).alias("w"))
    norms = told.groupBy("a").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = told.join(norms, "a").select("a", "g", (F.col("w") / F.col("norm")).alias("w"))
    asked = unit if queries is None else unit.join(queries.select(F.col(key).alias("a")).distinct(), "a", "left_semi")
    scores = asked.join(unit.select(F.col("a").alias("b"), "g", F.col("w").alias("v")), "g").where("a <> b").groupBy("a", "b").agg(F.round(F.sum(F.col("w") * F.col("v")), 9).alias("cosine"))
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return scores.withColumn("_r", nth).where(F.col("_r") <= k).select(F.col("a").alias(key), F.col("b").alias("other"), "cosine")


def vector_neighbours(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """The k vectors of highest cosine for each of a stated set of query vectors, exact; ties by key.

    Blocks of queries meet blocks of vectors in cells, as matrix products; a block's bytes are bounded, and no side is broadcast. Rows without a key are left out; a pair
    without a cosine (a null, or vectors of unequal length) comes last, one with a zero vector has NaN and comes first.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    few = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    asked, width = few.count(), max(width, 1)
    block = max(nearest.BLOCK_BYTES // (8 * width), 1)
    of_queries = max(math.ceil(asked / block), 1)
    of_rows = max(math.ceil(n / block), min(math.ceil(asked * n / nearest.CELL_PAIRS / of_queries), nearest.CELLS), 1)

    def dealt(side: DataFrame, asks: bool, own: int, met: int) -> DataFrame:
        mine, other = F.pmod(F.xxhash64("key"), F.lit(own)), F.explode(F.sequence(F.lit(0), F.lit(met - 1)))
        cell = F.col("_mine") * of_rows + F.col("_other") if asks else F.col("_other") * of_rows + F.col("_mine")
        return side.select("*", mine.alias("_mine"), other.alias("_other")).select(cell.cast("long").alias("cell"), F.lit(asks).alias("asked"), "key", "vector")

    cells = dealt(few, True, of_queries, of_rows).unionByName(dealt(rows, False, of_rows, of_queries))
    kind = df.schema[key].dataType.simpleString()
    near = cells.repartition(of_queries * of_rows, "cell").sortWithinPartitions("cell").mapInArrow(lambda batches: nearest.in_cells(batches, width, k), f"query {kind}, other {kind}, cosine double")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "other"))
    return near.withColumn("_r", nth).where(F.col("_r") <= k).select("query", "other", "cosine")
