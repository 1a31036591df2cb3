"""Streams of new records against a finished index: each micro-batch is cleaned, blocked and scored, and its edges are appended.

This goes beyond batch runs; a micro-batch is named by its id, so a batch that is run again overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.functions import values as V
from kindred.operators import blocking as B, cleaning as C, features as P, matcher as M
from kindred.sources import tables as S


def match_batch(batch: DataFrame, index: DataFrame, scorer: M.Scorer = M.rule_scorer, threshold: float = V.SCORE_THRESHOLD, passes: list[str] | None = None) -> DataFrame:
    """idx (new record), idx_known, duplicate_score for pairs over the threshold that share a block key."""
    passes = passes or V.DEFAULT_PASSES
    new = B.make_block_keys(C.preprocess_names(C.add_script(batch)))

    def keyed(df: DataFrame, out: str) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.col(p).alias("k")) for p in passes)))
        return df.select(F.col("idx").alias(out), each.alias("x")).select(out, "x.*")

    pairs = keyed(new, "idx1").join(keyed(index, "idx2"), ["p", "k"]).select("idx1", "idx2").distinct()
    have = [c for c in V.PAIR_COLUMNS if c in new.columns and c in index.columns]
    for side, df in (("1", new), ("2", index)):
        pairs = pairs.join(df.select(F.col("idx").alias(f"idx{side}"), *(F.col(c).alias(f"{c}_{side}") for c in have)), f"idx{side}")
    scored = M.garbage_rule(scorer(P.pair_features(pairs)))
    return scored.where(F.col("duplicate_score") >= threshold).select(F.col("idx1").alias("idx"), F.col("idx2").alias("idx_known"), "duplicate_score")


def stream_matches(spark: SparkSession, source: str, index: DataFrame, out: str, checkpoint: str, scorer: M.Scorer = M.rule_scorer, threshold: float = V.SCORE_THRESHOLD) -> StreamingQuery:
    """Match the files that arrive in ``source``; available ones are worked off, then the query ends."""
    stream = spark.readStream.schema(S.RELATIONS).parquet(source)

    def handle(batch: DataFrame, number: int) -> None:
        found = match_batch(S.with_index(batch), index, scorer, threshold)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
