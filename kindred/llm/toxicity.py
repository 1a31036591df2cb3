"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon of words and of word beginnings that is learned from labelled rows, second-person words near lexicon words,
capitals, punctuation, digits, obfuscated words (digits or symbols inside, spaced letters) and how many of them uncover a lexicon word, length and
repetition. Nothing but the text is an input of a score.

Learning reads labelled rows of the training folds only: at most about ``SAMPLE`` of them, drawn by a hash of the doc_id. Half of the draw
gives the lexicon, four tenths the trees and a tenth the calibration, so no stage learns from what an earlier one has fitted. Scoring covers
all documents and whole texts in one pass without a shuffle.

Defined results: a null text counts as empty and gets the score of an empty text; repeated rows get equal scores; a doc_id that is labelled more than once has
its highest label, null labels count as none; if the draw lacks one of the classes, every score is the share of toxic rows in it (0 without labels); an
empty table gives no rows; a row without a doc_id is scored like any other and is not held out; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F, types as T

from kindred.llm.arrow import column, giving_back, slices, texts
from kindred.plans.scratch import Scratch

#: Labelled rows that are learned from; entries of the lexicon; score from which a document counts as toxic.
SAMPLE, LEXICON, THRESHOLD = 24_000, 600, 0.3
#: Trees, their depth, and the seed of the fit.
TREES, DEPTH, SEED = 24, 3, 11
#: Second-person words of the languages at hand, and digits and signs that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer usted ustedes ti tus vosotros vuestro".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"\b[^\W\d_]+(?:[0-9@$!|*.\-_+]+[^\W\d_]+)+|\b(?:[^\W\d_][ .\-_*]){3,}[^\W\d_]\b")
BEGINNINGS = (4, 5, 6)
NEAR = 5


def _keys(words) -> set[str]:
    """Words, and beginnings of longer words, as lexicon keys."""
    out = set(words)
    for w in words:
        for k in BEGINNINGS:
            if len(w) > k:
                out.add(w[:k] + "*")
    return out


def _weight(word: str, lexicon: dict[str, float]) -> tuple[float, float]:
    return lexicon.get(word, 0.0), max((lexicon.get(word[:k] + "*", 0.0) for k in BEGINNINGS if len(word) > k), default=0.0)


class Features:
    """The feature vector of a text for a lexicon; remembers the weights of words it has seen, up to a bound."""

    def __init__(self, lexicon: dict[str, float], memory: int = 300_000):
        self.lexicon, self.memory, self.known = lexicon, memory, {}

    def weight(self, word: str) -> tuple[float, float]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.memory:
                self.known.clear()
            found = self.known[word] = _weight(word, self.lexicon)
        return found

    def __call__(self, text: str) -> list[float]:
        words = WORD.findall(text.lower())
        counts, n = Counter(words), max(len(words), 1)
        hits = {}
        total = starts = best = times = started = 0.0
        weight = self.weight
        for w, k in counts.items():
            a, b = weight(w)
            if a > 0:
                hits[w] = a
                total += a * k
                times += k
                best = max(best, a)
            if b > 0:
                starts += b * k
                started += k
        near = 0
        if hits and any(w in SECOND_PERSON for w in counts):
            said = [i for i, w in enumerate(words) if w in SECOND_PERSON]
            at = 0
            for i, w in enumerate(words):
                if w in hits:
                    while at < len(said) and said[at] < i - NEAR:
                        at += 1
                    near += at < len(said) and said[at] <= i + NEAR
        masked = MASKED.findall(text)
        bare = [re.sub(r"(.)\1{2,}", r"\1", re.sub(r"[\W\d_]", "", m.lower().translate(LEET))) for m in masked]
        uncovered = sum(weight(w)[0] > 0 for w in bare)
        raw = np.frombuffer(text.encode(), np.uint8)
        size = max(len(raw), 1)
        kinds = np.bincount(raw, minlength=256)
        capitals = kinds[65:91].sum()
        letters = max(capitals + kinds[97:123].sum(), 1)
        signs = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
        return [
            total / n, times / n, math.log1p(times), best, starts / n, started / n, math.log1p(started), near / n, uncovered / n, len(masked) / n,
            capitals / letters, signs / size, (kinds[33] + kinds[63]) / size, kinds[48:58].sum() / size, math.log1p(len(words)), len(counts) / n,
        ]


def labelled(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> DataFrame:
    """text, toxic, part (0-9) of the draw from the training folds."""
    train = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    train = train.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, sample / max(train.count(), 1))
    drawn = train.where(F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))
    return scratch.cut(rows.select("text", "toxic", F.pmod(F.xxhash64("_id", F.lit(SEED + 1)), F.lit(10)).alias("part")))


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """The keys whose presence speaks most for toxic texts: log odds of document frequencies, for keys with some support."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            seen = {0: Counter(), 1: Counter()}
            for t, y in zip(texts(batch, "text"), column(batch, "toxic").to_pylist()):
                seen[int(y > 0)].update(_keys(set(WORD.findall(t.lower()))))
            both = sorted(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([seen[1][k] for k in both], pa.int64()), pa.array([seen[0][k] for k in both], pa.int64())], ["key", "pos", "neg"])

    sizes = rows.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    pos, neg = F.col("pos"), F.col("neg")
    odds = F.log((pos + 0.5) / (sizes[0] + 1.0)) - F.log((neg + 0.5) / (sizes[1] + 1.0))
    found = rows.select("text", "toxic").mapInArrow(giving_back(gather), "key string, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    top = found.where(pos >= max(3, sizes[0] // 200)).select("key", odds.alias("w"), "pos").where(F.col("w") >= 1.5).orderBy(F.desc(F.col("w") * F.log1p("pos")), "key").limit(size)
    return {r["key"]: r["w"] for r in top.collect()}


def featured(rows: DataFrame, lexicon: dict[str, float], keep: bool = False) -> DataFrame:
    """``rows`` with a vector ``_tox_features``, and without ``text`` unless it is kept."""
    others = [f for f in rows.schema.fields if keep or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Features(lexicon)
        for batch in slices(batches, "text"):
            vectors = pa.array([measure(t) for t in texts(batch, "text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in others), vectors], [*(f.name for f in others), "_tox_f"])

    out = rows.mapInArrow(giving_back(run), T.StructType([*others, T.StructField("_tox_f", T.ArrayType(T.DoubleType()))]))
    return out.withColumn("_tox_features", array_to_vector("_tox_f")).drop("_tox_f")


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Callable[[DataFrame, bool], DataFrame]:
    """A function that adds ``_tox_score`` to rows with a ``text`` (and keeps that column if told to)."""
    rows = labelled(docs, labels, scratch, sample)
    lexicon = learn_lexicon(rows.where("part < 5"))
    told = scratch.cut(featured(rows.where("part >= 5"), lexicon).withColumn("toxic", F.col("toxic").cast("double")))
    fit, rest = told.where("part < 9"), told.where("part = 9")
    seen = fit.agg(F.count(F.lit(1)), F.avg("toxic")).first()
    if not seen[0] or seen[1] in (0.0, 1.0):
        flat = F.lit(float(seen[1] or 0.0)).alias("_tox_score")
        return lambda df, keep=False: df.select(*[c for c in df.columns if keep or c != "text"], flat)
    boosted = GBTClassifier(featuresCol="_tox_features", labelCol="toxic", predictionCol="_tox_class", maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=5, seed=SEED)
    trees = boosted.setRawPredictionCol("_tox_margin").setProbabilityCol("_tox_p").fit(fit)

    def raw(df: DataFrame) -> DataFrame:
        return trees.transform(df).withColumn("_tox_raw", vector_to_array("_tox_p")[1]).drop("_tox_margin", "_tox_p", "_tox_class", "_tox_features")

    # The trees' own rows say little about new ones; without held-back rows (tiny tables) they must do.
    held = raw(rest if rest.limit(1).count() else fit)
    # One row for each distinct score: the same curve, as equal scores are pooled in any case, and no score is a hot key.
    distinct = held.groupBy("_tox_raw").agg(F.avg("toxic").alias("toxic"), F.count(F.lit(1)).cast("double").alias("_tox_weight"))
    curve = IsotonicRegression(featuresCol="_tox_raw", labelCol="toxic", weightCol="_tox_weight", predictionCol="_tox_score").fit(distinct)

    def scored(df: DataFrame, keep: bool = False) -> DataFrame:
        out = curve.transform(raw(featured(df, lexicon, keep)))
        return out.withColumn("_tox_score", F.least(F.greatest("_tox_score", F.lit(0.0)), F.lit(1.0))).drop("_tox_raw")

    return scored


def score(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score for every row of ``docs``."""
    scored = learn(docs, labels, scratch, sample)
    return scored(docs.select(F.col("doc_id").cast("long"), "text"), False).select("doc_id", F.col("_tox_score").alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, row by row and without a shuffle."""
    scored = learn(docs, labels, scratch)
    return scored(docs, True).where(F.col("_tox_score") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_toxicity_trees(spark, sf_dir: str) -> DataFrame:
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "toxicity"))
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
