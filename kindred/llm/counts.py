"""Bounded choices of the most frequent rows of a table of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def frequent_from(counts: DataFrame, limit: int) -> int:
    """The least ``n`` from which on at most ``limit`` rows of ``counts`` (.., n) are as frequent, by classes of n a sixteenth of a doubling wide.

    The classes' sizes, a thousand rows at most, are all that reaches the driver. Without rows, and where the most frequent class has more rows, it is more than the largest n.
    """
    classes = counts.groupBy(F.floor(16 * F.log2("n")).alias("c")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"), F.max("n").alias("most")).orderBy(F.desc("c")).collect()
    least, total = (classes[0]["most"] + 1 if classes else 1), 0
    for c in classes:
        total += c["rows"]
        if total > limit:
            break
        least = c["least"]
    return least
