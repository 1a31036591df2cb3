"""Pairs: records beside them, labelled pairs, keys, groups and splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.functions import similarity as S, values as V
from kindred.operators.blocking import simple_block


def attach_records(pairs: DataFrame, records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``pairs`` with <column>_1 and <column>_2 of the records that exist; what the records lack is left out."""
    have = [c for c in (columns or V.PAIR_COLUMNS) if c in records.columns]
    for side in ("1", "2"):
        part = records.select(F.col("idx").alias(f"idx{side}"), *(F.col(c).alias(f"{c}_{side}") for c in have))
        pairs = pairs.join(part, f"idx{side}", "left")
    return pairs


def hashed(*columns: Column | str, seed: int = 42) -> Column:
    """A repeatable random order."""
    return F.xxhash64(*columns, F.lit(seed))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all, if fewer), the same ones each time."""
    return df.orderBy(hashed(key, seed=seed), key).limit(n)


def _numbered(rows: DataFrame, by: str, seed: int, salts: int = 64) -> DataFrame:
    """``rows`` (idx, ..) with ``_at``, from 0 within each ``by`` in a repeatable order, and ``_m``, its rows. Rows are counted in salted parts first, so no key's rows are all in one task."""
    part = rows.withColumn("_salt", F.pmod(hashed("idx", seed=seed), F.lit(salts)).cast("int"))
    sizes = part.groupBy(by, "_salt").agg(F.count(F.lit(1)).alias("_k"))
    ahead = sizes.withColumn("_before", F.sum("_k").over(Window.partitionBy(by).orderBy("_salt")) - F.col("_k")).withColumn("_m", F.sum("_k").over(Window.partitionBy(by))).drop("_k")
    nth = F.row_number().over(Window.partitionBy(by, "_salt").orderBy(hashed("idx", seed=seed), "idx"))
    return part.withColumn("_nth", nth).join(ahead, [by, "_salt"]).withColumn("_at", F.col("_nth") - 1 + F.col("_before")).drop("_salt", "_nth", "_before")


def positive_pairs(records: DataFrame, trusted: DataFrame | None = None, label: str = "party_public_id", cap: int = 50, seed: int = 42) -> DataFrame:
    """At most ``cap`` pairs of records for each label id, drawn from all pairs of its records.

    A label with m records has m(m-1)/2 pairs, so pairs are never all made: members are numbered, and pairs of numbers are drawn: all of them where there are at most 4 x cap, else 4 x cap, of which
    ``cap`` distinct ones stay.
    """
    rows = records.where(F.col(label).isNotNull()).select("idx", F.col(label).alias("label_id"))
    if trusted is not None:
        rows = rows.join(trusted.select(F.col(trusted.columns[0]).alias("label_id")).distinct(), "label_id", "left_semi")
    members = _numbered(rows, "label_id", seed)
    m, t, most = F.col("_m"), F.col("_t"), 4 * cap
    all_ = m * (m - 1) / 2
    asked = members.where("_at = 0 and _m > 1").select("label_id", "_m", F.explode(F.sequence(F.lit(0), F.least(all_, F.lit(float(most))).cast("int") - 1)).alias("_t"))
    # Few: the t-th pair (i < j) in order of j. Many: two different members by hash.
    j = F.floor((1 + F.sqrt(1 + 8.0 * t)) / 2).cast("long")
    first = F.pmod(F.xxhash64("label_id", t, F.lit(seed)), m)
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("label_id", t, F.lit(seed + 1)), m - 1), m)
    few = all_ <= most
    drawn = asked.select("label_id", F.when(few, t - (j * (j - 1) / 2).cast("long")).otherwise(F.least(first, second)).alias("_i"), F.when(few, j).otherwise(F.greatest(first, second)).alias("_j")).distinct()
    nth = F.row_number().over(Window.partitionBy("label_id").orderBy(hashed("_i", "_j", seed=seed), "_i", "_j"))  # at most 4 x cap rows
    drawn = drawn.withColumn("_r", nth).where(F.col("_r") <= cap)
    one = members.select("label_id", F.col("_at").alias("_i"), F.col("idx").alias("_a"))
    two = members.select("label_id", F.col("_at").alias("_j"), F.col("idx").alias("_b"))
    return drawn.join(one, ["label_id", "_i"]).join(two, ["label_id", "_j"]).select(F.least("_a", "_b").alias("idx1"), F.greatest("_a", "_b").alias("idx2"), F.lit(1).alias("label"), F.lit("positive_same_public_id").alias("pair_type"))


def easy_negative_pairs(records: DataFrame, n: int = 100_000, label: str = "party_public_id", seed: int = 42) -> DataFrame:
    """n random pairs of records of different labels (fewer only if there are hardly that many), the same each time.

    Two hash orders of a sample stand beside each other in several offsets, joined by position within hash buckets; of the distinct pairs the first n by hash stay.
    """
    rows = records.where(F.col(label).isNotNull()).select("idx", F.col(label).alias("label_id"))
    total = rows.count()
    share = min(1.0, 3.0 * n / max(total, 1))
    drawn = rows.where(F.pmod(hashed("idx", seed=seed + 1), F.lit(1 << 20)) < int(share * (1 << 20)))
    buckets = max(1, int(total * share) // 10_000)
    same = rows.groupBy("label_id").agg(F.count(F.lit(1)).cast("double").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
    differ = max(1.0 - same / max(total, 1) ** 2, 1e-3)  # how often two random rows have different labels
    offsets = max(4, math.ceil(2.0 * n / max(total * share * differ, 1.0)))

    def side(salt: int, name: str) -> DataFrame:
        h = hashed("idx", seed=seed + salt)
        part = drawn.withColumn("_b", F.pmod(h, F.lit(buckets)))
        at = F.row_number().over(Window.partitionBy("_b").orderBy(hashed("idx", seed=seed + salt + 10), "idx"))
        return part.select("_b", at.alias("_at"), F.col("idx").alias(f"idx{name}"), F.col("label_id").alias(f"l{name}"))

    moved = side(3, "2").withColumn("_at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(offsets - 1)), lambda k: F.col("_at") + k)))
    pairs = side(2, "1").join(moved, ["_b", "_at"]).where("l1 <> l2").select(F.least("idx1", "idx2").alias("idx1"), F.greatest("idx1", "idx2").alias("idx2")).distinct()
    some = pairs.orderBy(hashed("idx1", "idx2", seed=seed), "idx1", "idx2").limit(n)
    return some.select("idx1", "idx2", F.lit(0).alias("label"), F.lit("easy_negative_different_public_id").alias("pair_type"))


def hard_negative_pairs(
    records: DataFrame, label: str = "party_public_id", name: str = "name_latin", sample: int = 50_000, threshold: float = 80, most: int = 100_000, max_block_size: int = V.MAX_BLOCK_SIZE, seed: int = 42
) -> DataFrame:
    """Pairs of different labels within a block of three letters whose sorted tokens are alike, in order of idx."""
    rows = sample_rows(records.where(F.col(label).isNotNull()), sample, "idx", seed).select("idx", F.col(label).alias("l"), F.col(name).alias("n"), simple_block(name).alias("b"))
    good = rows.groupBy("b").count().where(F.col("count") <= max_block_size).select("b")
    rows = rows.join(good, "b", "left_semi")
    right = rows.select("b", F.col("idx").alias("idx2"), F.col("l").alias("l2"), F.col("n").alias("n2"))
    pairs = rows.withColumnRenamed("idx", "idx1").join(right, "b").where("idx1 < idx2 and l <> l2")
    scored = pairs.withColumn("name_similarity", S.token_sort_udf("n", "n2")).where(F.col("name_similarity") >= threshold)
    return scored.orderBy("idx1", "idx2").limit(most).select("idx1", "idx2", F.lit(0).alias("label"), F.lit("hard_negative_similar_name").alias("pair_type"), "name_similarity")


def similar_name_pairs(records: DataFrame, name: str = "name_latin", sample: int = 5_000, threshold: float = 90, seed: int = 42) -> DataFrame:
    """All pairs of unequal names of a sample whose sorted tokens are alike: a nested loop over at most ``sample`` distinct names."""
    rows = sample_rows(records.select(F.col(name).alias("n")).distinct(), sample, "n", seed)
    pairs = rows.join(F.broadcast(rows.withColumnRenamed("n", "n2")), F.col("n") < F.col("n2"))
    return pairs.withColumn("similarity", S.token_sort_udf("n", "n2")).where(F.col("similarity") >= threshold).select(F.col("n").alias("name_1"), F.col("n2").alias("name_2"), "similarity")


def make_pair_key(pairs: DataFrame) -> DataFrame:
    left, right = F.least("idx1", "idx2"), F.greatest("idx1", "idx2")
    return pairs.withColumns({"pair_left": left, "pair_right": right, "pair_key": F.concat_ws("_", left.cast("string"), right.cast("string"))})


def remove_duplicate_pairs(pairs: DataFrame) -> DataFrame:
    return make_pair_key(pairs).dropDuplicates(["pair_key"])


def entity_group(left: Column | str = "party_public_id_1", right: Column | str = "party_public_id_2") -> Column:
    a, b = ((F.col(c) if isinstance(c, str) else c).cast("string") for c in (left, right))
    return F.concat_ws("__", F.least(a, b), F.greatest(a, b))


def split_by_group(pairs: DataFrame, test: float = 0.15, valid: float = 0.15, seed: int = 42) -> DataFrame:
    """``pairs`` with ``split`` (train, valid, test), the same for all pairs of an entity group."""
    bucket = F.pmod(F.xxhash64("entity_group", F.lit(seed)), F.lit(10_000)) / 10_000.0
    return pairs.withColumn("split", F.when(bucket < test, "test").when(bucket < test + valid, "valid").otherwise("train"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """label, pair_type, pairs, percent."""
    counts = pairs.groupBy("label", "pair_type").agg(F.count(F.lit(1)).alias("pairs"))
    total = pairs.agg(F.count(F.lit(1)).alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("label", "pair_type", "pairs", F.round(100.0 * F.col("pairs") / F.col("_all"), 2).alias("percent"))


def review_set(pairs: DataFrame, each: int = 150, label: str = "label", seed: int = 42) -> DataFrame:
    """A balanced set for manual review: up to ``each`` pairs of either label in a repeatable random order, sides as left_ and right_ columns, and an empty manual_label."""
    names = [c for c in pairs.columns if c not in (label, "idx1", "idx2")]
    sides = {f"{c}_{k}": f"{side}_{c}" for c in V.PAIR_COLUMNS for k, side in (("1", "left"), ("2", "right"))}
    some = [pairs.where(F.col(label) == y).orderBy(hashed("idx1", "idx2", seed=seed), "idx1", "idx2").limit(each) for y in (1, 0)]
    rows = some[0].unionByName(some[1]).orderBy(hashed("idx1", "idx2", seed=seed + 1), "idx1", "idx2")
    return rows.select(F.col(label).alias("label"), "idx1", "idx2", *(F.col(c).alias(sides.get(c, c)) for c in names), F.lit("").alias("manual_label"))
