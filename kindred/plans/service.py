"""The service: search, duplicate check and batch deduplication over processed records."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kindred.functions import values as V
from kindred.operators import blocking as B, cleaning as C, features as P, matcher as M
from kindred.plans.dedup import clusters_from_edges, scored_pairs
from kindred.sources import tables as S


class Engine:
    """Holds a scorer and, for search, an index of records by block key (deduplicated records keep their ``entity_id``)."""

    def __init__(self, spark: SparkSession, database: DataFrame | None = None, scorer: M.Scorer = M.rule_scorer):
        self.spark, self.scorer = spark, scorer
        self.index = None if database is None else database if "block_value" in database.columns else search_index(database).cache()

    @classmethod
    def load(cls, spark: SparkSession, database: str, model: str | None = None) -> Engine:
        """``database`` is a written ``search_index``, of which a search reads the row groups that can have its keys, or a table of records, which is indexed and cached."""
        return cls(spark, spark.read.parquet(database), M.model_scorer(S.load_model(model)) if model else M.rule_scorer)

    def status(self) -> dict[str, Any]:
        return {"status": "ok", "endpoints": ["search", "check_duplicate", "deduplicate_batch"], "records": 0 if self.index is None else self.index.where(F.col("block_col") == V.BLOCK_COLUMNS[0]).count()}

    def _records(self, records: list[dict[str, Any]]) -> DataFrame:
        """A few records in memory, processed, in one partition: idx -1, -2, .."""
        rows = S.rows_table(self.spark, records).coalesce(1).withColumn("idx", -1 - F.monotonically_increasing_id())
        return C.preprocess_names(C.add_script(rows))

    def _query(self, record: dict[str, Any]) -> DataFrame:
        return B.make_block_keys(self._records([record]))

    def _scored(self, pairs: DataFrame) -> DataFrame:
        return M.garbage_rule(self.scorer(P.pair_features(pairs)))

    def search(self, record: dict[str, Any], top_k: int = 10, passes: list[str] | None = None, deduplicate: bool = True) -> DataFrame:
        """The best ``top_k`` (1-100) records that share a block key with the query, best first, ties by idx; one a Latin name if ``deduplicate``."""
        if not 1 <= top_k <= 100:
            raise ValueError("top_k must be between 1 and 100")
        query = self._query(record)
        keys = query.select(*(passes or V.DEFAULT_PASSES)).first()
        # Equalities that reach the scan: the index is sorted by value, so statistics rule out what can't match.
        hit = F.lit(False)
        for p in passes or V.DEFAULT_PASSES:
            hit = hit | ((F.col("block_value") == F.lit(keys[p])) & (F.col("block_col") == p))
        found = self.index.where(F.col("block_value").isin(sorted(set(keys))) & hit).dropDuplicates(["idx"])
        left = query.select(F.col("idx").alias("idx1"), *(F.col(c).alias(f"{c}_1") for c in V.PAIR_COLUMNS if c in query.columns))
        extra = ["entity_id"] if "entity_id" in found.columns else []
        right = found.select(F.col("idx").alias("idx2"), *(F.col(c).alias(f"{c}_2") for c in V.PAIR_COLUMNS if c in found.columns), *extra)
        scored = self._scored(right.crossJoin(F.broadcast(left))).withColumn("similarity_score", F.col("duplicate_score"))
        if deduplicate:
            nth = F.row_number().over(Window.partitionBy("name_latin_2").orderBy(F.desc("similarity_score"), "idx2"))
            scored = scored.withColumn("_r", nth).where(F.col("_r") == 1)
        have = [c for c in V.RESULT_COLUMNS if c in scored.columns]
        return scored.orderBy(F.desc("similarity_score"), "idx2").limit(top_k).select(*have, *extra)

    def check_duplicate(self, first: dict[str, Any], second: dict[str, Any], threshold: float = V.SCORE_THRESHOLD) -> dict[str, Any]:
        # Both records in one row, so that they are processed once and no join is planned.
        both = self._records([first, second]).agg(F.array_sort(F.collect_list(F.struct((-F.col("idx")).alias("at"), *V.PAIR_COLUMNS))).alias("r"))
        pair = both.select(*(F.get("r", F.lit(k - 1))[c].alias(f"{c}_{k}") for k in (1, 2) for c in V.PAIR_COLUMNS))
        score = self._scored(pair).first()["duplicate_score"]
        return {"duplicate_probability": score, "is_duplicate": score >= threshold}

    def deduplicate(self, rows: list[dict[str, Any]] | DataFrame, threshold: float = V.SCORE_THRESHOLD) -> tuple[DataFrame, DataFrame]:
        """(deduplicated records, entities) of a batch; records without an id are named ``batch_record_<i>``."""
        if not 0 <= threshold <= 1:
            raise ValueError("threshold must be between 0 and 1")
        if isinstance(rows, list):
            named = [{**r, "record_id": r.get("record_id") or f"batch_record_{i}"} for i, r in enumerate(rows)]
            table = S.rows_table(self.spark, named).withColumn("idx", F.monotonically_increasing_id())
        else:
            table = S.conform(rows) if "idx" in rows.columns else S.with_index(S.conform(rows))
        records = C.preprocess_names(C.add_script(table))
        pairs = scored_pairs(records, self.scorer, threshold=threshold)
        edges = M.deduplicate_edges(pairs.where("duplicate_prediction = 1").select("idx1", "idx2", "duplicate_score"))
        return clusters_from_edges(records, edges, threshold)


def search_index(records: DataFrame) -> DataFrame:
    """Each record once for each block key (block_col, block_value), in order of the value: ready to be written, loaded and looked up. A frequent key spans several partitions."""
    ready = records if "name_latin" in records.columns else C.preprocess_names(C.add_script(records))
    own = [c for c in ready.columns if c not in V.BLOCK_COLUMNS]
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("block_col"), F.col(p).alias("block_value")) for p in V.BLOCK_COLUMNS))).alias("_b")
    rows = B.make_block_keys(ready).select(*own, each).select(*own, "_b.*")
    order = ["block_value", "block_col", "idx"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)
