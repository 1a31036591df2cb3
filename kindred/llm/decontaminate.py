"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared lower-cased and with each run of white space as one space. An item of m characters stands in a document if some part of it is
within k edits (insertions, deletions, substitutions), k being ``RATE`` of m. By the q-gram lemma such a part shares at least m - q + 1 - qk
character q-grams with the item, and as at most k edits shift it, they lie within k + 1 neighbouring diagonals (document place less item place). Shared
q-grams are counted in bands of 2(k + 1) diagonals that overlap by half, so one band holds them all; bands that reach the bound are
verified by an alignment within the band. Items too short for the bound to be positive get a smaller k, and items shorter than q are
looked up as they are.

The benchmark is the query set: it is held against all documents in blocks of at most ``BLOCK_CHARS`` characters (a longer item is a block of its own), whose index of at most some 36 bytes a character
is broadcast: 64 MB a block. Blocks run one after another, each over all documents: the result of all but the last is written before the next index is made, and its index is destroyed.

Defined results: null or empty texts hold nothing, and null or blank items stand nowhere; repeated rows are matched each for itself, repeated item
rows like one; a null doc_id is kept; empty tables give no rows; other columns are not read. Long texts are read in overlapping windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kindred.llm.arrow import column, giving_back, slices, texts
from kindred.plans.scratch import Scratch

Q, RATE, BLOCK_CHARS = 10, 0.08, 1_800_000
#: Characters of a document that are looked at together.
WINDOW = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram. Equal hashes of unequal q-grams only raise a count; alignment decides."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64) + np.uint64(1)
    out = wide[:n].copy()
    for i in range(1, q):
        out *= _BASE
        out += wide[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


class GramIndex:
    """q-grams of a block of items with their (item, place) postings."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE):
        self.q, self.items = q, [(i, plain(t)) for i, t in items]
        self.codes = [points(t) for _, t in self.items]
        size = np.array([len(c) for c in self.codes] or [0], np.int64)
        self.size = size
        self.edits = np.maximum(np.minimum((size * rate).astype(np.int64), (size - q + 1 - 4) // q), 0)
        self.needed = np.maximum(size - q + 1 - q * self.edits, 1)
        self.short = [k for k, c in enumerate(self.codes) if 0 < len(c) < q]
        hashes = [gram_hashes(c, q) for c in self.codes]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        flat, self.owner, self.place = flat[order], owner[order].astype(np.int32), place[order].astype(np.int32)
        self.grams, first = np.unique(flat, return_index=True)
        self.first = np.append(first, len(flat)).astype(np.int32)
        self.bits = 16  # some 32 places for each q-gram of a small index, eight of a large one
        while 1 << self.bits < (32 if self.bits < 22 else 8) * len(self.grams):
            self.bits += 1
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.grams >> np.uint64(64 - self.bits)] = True

    def bands(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, first diagonal) of each band that reaches its item's bound."""
        hashes = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - self.bits)])
        if not len(at) or not len(self.grams):
            return
        found = hashes[at]
        gram = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
        same = self.grams[gram] == found
        at, gram = at[same], gram[same]
        if len(at) < self.needed.min():
            return
        times = (self.first[gram + 1] - self.first[gram]).astype(np.int64)
        ends = np.cumsum(times)
        posting = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times - self.first[gram], times)
        item = self.owner[posting].astype(np.int64)
        diagonal = np.repeat(at, times) - self.place[posting]
        band = diagonal // (self.edits[item] + 1)
        key = item << 40 | (band + (1 << 38))
        keys, counts = np.unique(key, return_counts=True)
        # A band of twice the stride: its own half and the next one.
        after = np.searchsorted(keys, keys + 1)
        there = (after < len(keys)) & (keys[np.minimum(after, len(keys) - 1)] == keys + 1)
        both = counts + np.where(there, counts[np.minimum(after, len(keys) - 1)], 0)
        owner = keys >> 40
        for k in np.flatnonzero(both >= self.needed[owner]):
            i = int(owner[k])
            yield i, (int(keys[k] & ((1 << 40) - 1)) - (1 << 38)) * int(self.edits[i] + 1)

    def align(self, codes: np.ndarray, i: int, diagonal: int) -> tuple[int, int]:
        """(distance, end place) of the item's best alignment within the band, which starts and ends anywhere in it."""
        item, k = self.codes[i], int(self.edits[i])
        # k diagonals on each side, as an alignment whose q-grams all lie in the band may leave it by k at its ends.
        width = 2 * (k + 1) + 2 * k
        low = diagonal - k
        places = np.arange(width)
        far = np.int64(1 << 30)
        row = np.where((low + places >= 0) & (low + places <= len(codes)), 0, far)
        for r, c in enumerate(item):
            j = low + r + places
            inside = (j >= 0) & (j < len(codes))
            step = np.where(inside, row + (codes[np.clip(j, 0, len(codes) - 1)] != c), far)
            step[:-1] = np.minimum(step[:-1], row[1:] + 1)
            row = np.minimum(np.minimum.accumulate(step - places) + places, far)
            j += 1
            row[(j < 0) | (j > len(codes))] = far
            if row.min() > k:
                return int(far), -1
        best = int(row.argmin())
        return int(row[best]), low + len(item) + best

    def matches(self, text: str) -> dict[int, tuple[int, int]]:
        """For each item that stands in the text: (distance, end place in the plain text) of its best place, the first of equals."""
        codes, best = points(text), {}
        for i in self.short:
            at = text.find(self.items[i][1])
            if at >= 0:
                best[i] = (0, at + len(self.codes[i]))
        reach = int((self.size + 4 * (self.edits + 1)).max(initial=0)) + self.q
        for start in range(0, max(len(codes) - self.q + 1, 0), WINDOW):
            part = codes[max(start - reach, 0) : start + WINDOW + reach]
            shift = max(start - reach, 0)
            for i, diagonal in self.bands(part):
                distance, end = self.align(part, i, diagonal)
                if distance <= self.edits[i] and (distance, end + shift) < best.get(i, (1 << 30, 0)):
                    best[i] = (distance, end + shift)
        return best


def blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull()).distinct().orderBy("item_id", "text").toLocalIterator():
        if held and size + len(r["text"]) > limit:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if held:
        yield held


_MATCHES = "doc_id long, item_id long, distance int, end long"


def _each_block(docs: DataFrame, benchmark: DataFrame, q: int, rate: float, limit: int):
    """(index as a broadcast, whether it is the last) of each block of the benchmark."""
    spark, waiting = docs.sparkSession, None
    for block in blocks(benchmark, limit):
        if waiting is not None:
            yield spark.sparkContext.broadcast(GramIndex(waiting, q, rate)), False
        waiting = block
    if waiting is not None:
        yield spark.sparkContext.broadcast(GramIndex(waiting, q, rate)), True


def contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, q: int = Q, rate: float = RATE, limit: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, end (after the best place's last character in the plain text): a row for each item in each document that holds it."""
    out = docs.sparkSession.createDataFrame([], _MATCHES)
    for index, last in _each_block(docs, benchmark, q, rate, limit):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = index.value
            for batch in slices(batches, "text"):
                rows = []
                for doc, text in zip(column(batch, "doc_id").to_pylist(), texts(batch, "text")):
                    rows += [(doc, known.items[i][0], d, e) for i, (d, e) in sorted(known.matches(plain(text)).items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "item_id", "distance", "end"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(run), _MATCHES)
        if not last:
            found = scratch.cut(found)
            index.destroy()
        out = out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, q: int = Q, rate: float = RATE, limit: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` without a benchmark item, row by row and without a shuffle."""
    for index, last in _each_block(docs, benchmark, q, rate, limit):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = index.value
            for batch in slices(batches, "text"):
                yield batch.filter(pa.array([not known.matches(plain(t)) for t in texts(batch, "text")], pa.bool_()))

        docs = docs.mapInArrow(giving_back(run), docs.schema)
        if not last:
            docs = scratch.cut(docs)
            index.destroy()
    return docs


def op10_benchmark_qgram(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "qgram"))
