"""Batch plans: candidates, scores, edges, clusters, entities as one lazy plan up to the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kindred.functions import names as N, values as V
from kindred.operators import blocking as B, entities as E, features as P, matcher as M, pairs as J
from kindred.plans.scratch import Scratch
from kindred.sources import tables as S


def scored_pairs(records: DataFrame, scorer: M.Scorer = M.rule_scorer, passes: list[str] | None = None, max_block_size: int = V.MAX_BLOCK_SIZE, threshold: float = 0.5, within: list[str] = (), least: float = 0.0) -> DataFrame:
    """Candidate pairs of processed records with features, score and decision; pairs with garbage score 0. Pairs that surely score below ``least`` may be left out."""
    keyed = B.make_block_keys(records)
    candidates = B.candidate_pairs(keyed, passes, max_block_size, within)
    flagged = records.withColumn("is_garbage", N.is_garbage("party_name"))
    pairs = J.attach_records(candidates, flagged, [*V.PAIR_COLUMNS, "is_garbage"])
    if least >= 0.9 and scorer is M.rule_scorer:  # edit ratios of pairs that can't reach it are never computed
        pairs = pairs.where(M.rule_may_match())
    return M.decided(M.garbage_rule(scorer(P.pair_features(pairs))), threshold)


def duplicate_edges(records: DataFrame, scorer: M.Scorer = M.rule_scorer, passes: list[str] | None = None, max_block_size: int = V.MAX_BLOCK_SIZE, threshold: float = V.SCORE_THRESHOLD, by_country: bool = True) -> DataFrame:
    """The three columns that clustering reads. With ``by_country`` records of different countries never meet."""
    pairs = scored_pairs(records, scorer, passes, max_block_size, threshold, ["country"] if by_country else [], threshold)
    return M.deduplicate_edges(pairs.where(F.col("duplicate_score") >= threshold).select("idx1", "idx2", "duplicate_score"))


def clusters_from_edges(records: DataFrame, edges: DataFrame, threshold: float = V.SCORE_THRESHOLD, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(deduplicated records, entities with flags)."""
    scratch = scratch or Scratch(records.sparkSession, "dedup")
    clusters = E.build_clusters(E.duplicate_edges(edges, threshold), scratch)
    deduplicated = scratch.cut(E.add_canonical_names(E.attach_clusters(records, clusters)))
    return deduplicated, E.quality_flags(E.canonical_entities(deduplicated))


def run_batch(records: DataFrame, out: str, scorer: M.Scorer = M.rule_scorer, threshold: float = V.SCORE_THRESHOLD, by_country: bool = True) -> tuple[DataFrame, DataFrame]:
    """Edges, deduplicated records and entities as tables below ``out``; finished stages are read, not run again."""
    edges = S.write_once(duplicate_edges(records, scorer, threshold=threshold, by_country=by_country), f"{out}/edges")
    deduplicated, entities = clusters_from_edges(records, edges, threshold)
    return S.write_once(deduplicated, f"{out}/deduplicated"), S.write_once(entities, f"{out}/entities")
