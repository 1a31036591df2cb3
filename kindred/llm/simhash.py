"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: bits over word shingles; a bit is set if it is set in over half of the shingles' XXH64 (and of mixes of it beyond the first 64 bits).
Equal fingerprints are one entry (in search by similarity: equal shingle sets, told by 128 bits). Linked entries, and with them their documents, form components.

The index (``GrayIndex``): entries sorted by Gray rank, whose neighbours share most bits; sixteen neighbours form a leaf with the mask of the bits that all of
them share and their pattern, sixteen nodes an upper node alike. Two nodes are compared in the bits that both mask: a node's mask holds its parent's, so differences
accumulate on the way down, and pairs of whole groups are pruned beyond a limit. So are two nodes whose members are all in one component already, which keeps a
large group of near copies from being compared pair by pair. Of a bucket's links a spanning forest leaves the task: no link between different components is lost.

The index of all entries is too large for one task. Its uppermost nodes, patterns of a few bits, are buckets of some thousand entries, and each bucket's index is searched by itself.

Exact search (``near_groups``): 64 bits, links at up to three differing bits. Two such entries agree in one of four 16-bit chunks, so there are four such indexes, each
led by the bits of its chunk: uppermost nodes share the first bits of it (as many as leave ``BUCKET`` entries), and within the chunk no difference is tolerated, as another index finds
those pairs. Buckets of more than ``deal`` entries are dealt by the whole chunk, then by quarters of the bits that remain, until they fit: each step is exact, as at most three bits differ.

Search by similarity (``similar_groups``): texts of a given Jaccard similarity differ in a known share of bits, far more than three of 64. Here entries
have 512 bits of their distinct shingles, and an index has a sample of them: a few deal, 128 are indexed. A limit is the number of differences that all but ``PRUNED`` of the pairs of the least
similarity stay within, for as many bits as two nodes mask; there are as many samples as find such a pair with ``RECALL`` in spite of that. What is within the radius is proposed, as a spanning forest, nearest
first. Each proposed link is then held against the whole texts' shingle sets, and only links of the similarity stay. Small sets differ in more bits, as ties are frequent: entries of up to ``SMALL``
shingles are searched once more, for the largest share of bits that two such sets may differ in. Entries that a failed link leaves apart from the most linked entry of their proposed group are held
against that entry too. Groups that are still in several verified components are searched once more, and there each pair is held against the sets where it is met (families of one template have many pairs a little below the similarity): rows carry what sets them apart
from the group's centre, which tells the similarity exactly, and a task gives a spanning forest of the true links, never the pairs. Groups of up to ``target`` entries meet whole, larger ones by samples. So no failed link hides a true one, precision is exact, and
recall a matter of chance, documented in the README; it is higher the more similar the texts. Buckets of more than ``deal`` entries are large groups of near copies: all are first held against the
bucket's least entry; then blocks of the others meet blocks of all, and only pairs within that entry's verified component are left out (``_in_blocks``).

Defined results: a null or empty text has fingerprint zero and is linked like any other; fewer words than a shingle give one shingle of all words;
repeated rows get the same component; a null doc_id gets the least known doc_id of its component (null if none is known); an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from kindred.llm.arrow import column, giving_back, slices, texts
from kindred.operators.graph import connected_components
from kindred.plans.scratch import Scratch

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Words of a shingle, least Jaccard similarity, recall of the search at that similarity, and 64-bit words of a fingerprint in search by similarity.
WIDE_SHINGLE, SIMILARITY, RECALL, WIDE = 5, 0.8, 0.995, 8
#: Shares of the radius that are searched in turn.
STEPS = (0.5, 1.0)
#: Distinct shingles up to which entries are searched once more, by the share of bits that small sets may differ in; beyond, it is the angle's to 0.003.
SMALL = 32
#: Bits of a sample that are indexed, share of the least similar pairs that a node's limit and the radius lose, and levels of nodes of the largest bucket.
SKETCH, PRUNED, OUTSIDE, LEVELS = 128, 0.05, 0.001, 4
#: Unrelated entries of a bucket in exact search and in search by similarity; entries beyond which a bucket is divided; members of a node of the index.
BUCKET, TARGET, DEAL, FANOUT = 2048, 8192, 1 << 16, 16
#: Words whose shingles are hashed at once; pairs of nodes and of leaves that are compared at once; rows of a task.
_WORDS, _PAIRS, _LEAVES, TASK_ROWS = 1 << 16, 1 << 13, 1 << 10, 1 << 18
#: Bytes of a bucket's bit sets; beyond, shared members are looked up.
_BITS = 1 << 26


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Further 64 bits of each hash; word 0 is the hash itself."""
    if not word:
        return hashes
    out = hashes + np.uint64((0x9E3779B97F4A7C15 * word) & ((1 << 64) - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out ^ (out >> np.uint64(31))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit; sums of 255 rows fit a byte."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    return bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)


def _shingles(said: list[bytes], shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text's words, ``_WORDS`` at a time."""
    total, digest = len(said) - shingle + 1, xxhash.xxh64_intdigest
    for at in range(0, total, _WORDS):
        part = said[at : at + min(_WORDS, total - at) + shingle - 1]
        yield np.array([digest(b" ".join(s), seed) for s in zip(*(part[i:] for i in range(shingle)))], "<u8")


def _majority(parts: Iterable[np.ndarray], words: int) -> np.ndarray:
    """The bits that are set in over half of the hashes."""
    counts, total = np.zeros((words, 64), np.int64), 0
    for hashes in parts:
        total += len(hashes)
        for k in range(words):
            counts[k] += _ones(_mixed(hashes, k))
    return np.packbits(counts * 2 > total, axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE, words: int = 1, seed: int = SEED) -> np.ndarray:
    """The fingerprint's 64-bit words. Lower-cases A-Z and splits on ASCII white space, as bytes methods do."""
    said = text.encode().lower().split()
    if not said:
        return np.zeros(words, np.uint64)
    return _majority(_shingles(said, min(shingle, len(said)), seed), words)


def set_fingerprint(grams: np.ndarray, words: int = WIDE) -> np.ndarray:
    """The fingerprint of a shingle set: each distinct shingle counts once, as in the similarity."""
    return _majority((grams[at : at + _WORDS].view("<u8") for at in range(0, len(grams), _WORDS)), words)


def shingle_set(text: str, shingle: int = WIDE_SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct shingles' hashes, as signed longs."""
    said = text.encode().lower().split()
    if not said:
        return np.zeros(0, np.int64)
    return np.unique(np.concatenate(list(_shingles(said, min(shingle, len(said)), seed)))).view(np.int64)


def set_digest(grams: np.ndarray) -> bytes:
    """128 bits that tell shingle sets apart."""
    return xxhash.xxh3_128_digest(grams.tobytes())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fp = pa.array(np.concatenate([fingerprint(t, shingle) for t in texts(batch, "text")]).view(np.int64))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), fp], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(run), "doc_id long, fp long")


def wide_fingerprints(docs: DataFrame, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """doc_id, fp, digest, size: the wide fingerprint, and the digest and size of the shingle set, which alone tell equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_set(t, shingle) for t in texts(batch, "text")]
            fp = [set_fingerprint(g).view(np.int64) for g in sets]
            digest = [set_digest(g) for g in sets]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fp, pa.list_(pa.int64())), pa.array(digest, pa.binary()), pa.array([len(g) for g in sets], pa.int64())], ["doc_id", "fp", "digest", "size"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(run), "doc_id long, fp array<long>, digest binary, size long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of 64-bit words in Gray-code order."""
    out = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def _cumulative(n: int, share: float) -> Iterator[float]:
    """P(X <= 0), P(X <= 1), .. of a binomial X."""
    total = 0.0
    for t in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(t + 1) - math.lgamma(n - t + 1) + t * math.log(share) + (n - t) * math.log1p(-share))
        yield total


def tolerated(bits: int, share: float, miss: float) -> int:
    """The differing bits that all but ``miss`` of the pairs stay within, which differ in that share of their bits."""
    return next((t for t, p in enumerate(_cumulative(bits, share)) if p >= 1 - miss), bits)


class GrayIndex:
    """A hierarchy over distinct fingerprints (rows of 64-bit words) in Gray order.

    ``FANOUT`` neighbours form a leaf with the mask of the bits that all of them share and their pattern; ``FANOUT`` nodes form an upper node alike.
    ``limits`` has, for each number of commonly masked bits, the differences among them that two nodes may have. Bits of ``lead`` come first in the
    order, and nodes that differ in one of them are pruned as well. ``met`` and ``pruned`` count the pairs of nodes looked at and those pruned by differences.
    """

    def __init__(self, fp: np.ndarray, limits: np.ndarray, lead: int = 0):
        ranks = [gray_rank(fp[:, k]) for k in range(fp.shape[1] - 1, -1, -1)]
        self.lead = np.uint64(lead)
        self.order = np.lexsort([*ranks, gray_rank(fp[:, 0] & self.lead)] if lead else ranks)
        self.limits, self.met, self.pruned = limits, 0, 0
        ones, mask = fp[self.order], np.full(fp.shape, ~np.uint64(0))
        padded = np.concatenate([ones, np.repeat(ones[-1:], -len(ones) % FANOUT, axis=0)])
        self.words = [np.ascontiguousarray(padded[:, k]).reshape(-1, FANOUT) for k in range(fp.shape[1])]
        self.levels = []
        while not self.levels or len(mask) > FANOUT:
            starts = np.arange(0, len(mask), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones & mask, starts), np.bitwise_and.reduceat(~ones & mask, starts)
            mask = ones | zeros
            self.levels.append((mask, ones))

    def links(self, radii: tuple[int, ...], component: np.ndarray | None = None, alike: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows (i, j) of a spanning forest of the links within the last radius between ``component``s; each is such a link (and, by rows, ``alike``), and those within a lesser radius come first."""
        root = np.arange(len(self.order)) if component is None else self._least(component)
        found = []
        for radius in radii:
            for i, j in self._near(root, radius):
                for k in range(0, len(i), len(i) if alike is None else _PAIRS):  # bounds the memory of one step
                    a, b = (i, j) if alike is None else (i[k : k + _PAIRS], j[k : k + _PAIRS])
                    if alike is not None:
                        apart = root[a] != root[b]
                        a, b = a[apart], b[apart]
                        true = alike(self.order[a], self.order[b])
                        a, b = a[true], b[true]
                    found += _union(root, a, b)
        i, j = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))
        return self.order[i], self.order[j]

    def _least(self, component: np.ndarray) -> np.ndarray:
        """For each place the first place of its component."""
        _, first, group = np.unique(component[self.order], return_index=True, return_inverse=True)
        return first[group]

    def _near(self, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs within the radius and apart in ``root`` (as it is when they are reached), in steps, nearest first in each."""
        limits, top, n = np.minimum(self.limits, radius), len(self.levels) - 1, len(self.order)
        stack = [(top, *np.triu_indices(len(self.levels[top][0])))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > _PAIRS:  # bounds the memory of one step, whatever the bucket
                stack += [(level, i[k : k + _PAIRS], j[k : k + _PAIRS]) for k in range(0, len(i), _PAIRS)][::-1]
                continue
            starts = np.arange(0, n, FANOUT ** (level + 1))
            low, high = np.minimum.reduceat(root, starts), np.maximum.reduceat(root, starts)
            apart = (low[i] != high[j]) | (high[i] != low[j])
            i, j = i[apart], j[apart]
            mask, pattern = self.levels[level]
            shared = mask[i] & mask[j]
            differ = (pattern[i] ^ pattern[j]) & shared
            near = np.bitwise_count(differ).sum(1, dtype=np.int64) <= limits[np.bitwise_count(shared).sum(1, dtype=np.int64)]
            if self.lead:
                near &= differ[:, 0] & self.lead == 0
            self.met += len(i)
            self.pruned += len(i) - int(near.sum())
            i, j = i[near], j[near]
            if not len(i):
                continue
            if not level:
                for k in range(0, len(i), _LEAVES):
                    yield from self._within(root, i[k : k + _LEAVES], j[k : k + _LEAVES], radius)
                continue
            below, step = len(self.levels[level - 1][0]), np.arange(FANOUT)
            a, b = np.broadcast_arrays((i[:, None] * FANOUT + step)[:, :, None], (j[:, None] * FANOUT + step)[:, None, :])
            a, b = a.ravel(), b.ravel()
            ok = (b < below) & (a <= b)
            a, b = a[ok], b[ok]
            near_first = np.argsort(b - a, kind="stable")  # neighbours in Gray order most likely join, which prunes the rest
            stack.append((level - 1, a[near_first], b[near_first]))

    def _within(self, root: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of members of leaves i and j."""
        differ = np.zeros((len(i), FANOUT, FANOUT), np.uint8 if len(self.words) < 4 else np.uint16)
        for word in self.words:
            differ += np.bitwise_count(word[i][:, :, None] ^ word[j][:, None, :])
        at = np.flatnonzero(differ.ravel() <= radius)
        pair, member = np.divmod(at, FANOUT * FANOUT)
        a, b = i[pair] * FANOUT + member // FANOUT, j[pair] * FANOUT + member % FANOUT
        ok = (a < b) & (b < len(root))
        a, b, at = a[ok], b[ok], at[ok]
        apart = root[a] != root[b]
        if apart.any():
            a, b = a[apart], b[apart]
            nearest = np.argsort(differ.ravel()[at[apart]], kind="stable")
            yield a[nearest], b[nearest]


def _union(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Join the components of each pair, earlier pairs first; every member then points at its component's least place. The pairs that joined."""
    used = []
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return used
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        high, first = np.unique(np.maximum(a, b), return_index=True)
        root[high] = np.minimum(a, b)[first]
        used.append((i[first], j[first]))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


class _Sets:
    """Sets of a bucket's rows, told by members that at least two of them have: how many a pair shares."""

    def __init__(self, sets: np.ndarray):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        _, member, times = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
        often = times[member] > 1
        row, place = np.repeat(np.arange(len(sets)), self.sizes)[often], (np.cumsum(times > 1) - 1)[member[often]]
        self.members, words = int((times > 1).sum()), max(-(-int((times > 1).sum()) // 64), 1)
        self.bits = None
        if len(sets) * words * 8 <= _BITS:
            at, bit = row * words + place // 64, np.uint64(1) << (place % 64).astype(np.uint64)
            order = np.argsort(at, kind="stable")
            at, bit = at[order], bit[order]
            self.bits = np.zeros((len(sets), words), np.uint64)
            if len(at):
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                self.bits.ravel()[at[first]] = np.bitwise_or.reduceat(bit, first)
            return
        self.keys = np.sort(row * self.members + place)
        self.ends = np.cumsum(np.bincount(row, minlength=len(sets)))

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            step = max(1, (_BITS >> 3) // self.bits.shape[1] // 8)
            parts = [np.bitwise_count(self.bits[i[k : k + step]] & self.bits[j[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(i), step)]
            return np.concatenate([np.zeros(0, np.int64), *parts])
        starts, out = np.r_[0, self.ends[:-1]], np.zeros(len(i), np.int64)
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
            mine, theirs = self.keys[starts[a] : self.ends[a]] - a * self.members, self.keys[starts[b] : self.ends[b]] - b * self.members
            out[k] = len(np.intersect1d(mine, theirs, assume_unique=True))
        return out


def _alike_rows(size: np.ndarray, delta: np.ndarray, similarity: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether pairs of rows have the similarity, from the sizes of their sets and what sets them apart from one and the same set; the rule of ``_alike``."""
    sets = _Sets(delta)

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        both = size[i] + size[j]
        out = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
        i, j, n = i[out], j[out], both[out]
        differ = sets.sizes[i] + sets.sizes[j] - 2 * sets.shared(i, j)
        shared = (n - differ) // 2
        out[out] = (n == 0) | (shared / np.maximum(n - shared, 1) >= similarity)
        return out

    return alike


def _numbers(values: pa.Array) -> np.ndarray:
    """A column of numbers, or of lists of equal length as rows."""
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if pa.types.is_list(values.type) else values.to_numpy(zero_copy_only=False)


def _lists(values: pa.Array) -> np.ndarray:
    """A column of lists of any length, as arrays."""
    ends = values.offsets.to_numpy()
    flat, out = values.values.to_numpy(zero_copy_only=False), np.empty(len(values), object)
    for k in range(len(values)):
        out[k] = flat[ends[k] : ends[k + 1]]
    return out


def _per_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of one bucket after the other, from rows sorted by bucket; no more than a bucket and a batch is held."""

    def groups(rows: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        ends = np.flatnonzero(np.r_[rows["bucket"][1:] != rows["bucket"][:-1], True]) + 1
        for start, end in zip(np.r_[0, ends[:-1]], ends):
            if end - start > 1:
                yield {k: v[start:end] for k, v in rows.items()}

    held: dict[str, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {name: (_lists if name == "delta" else _numbers)(column(batch, name)) for name in batch.schema.names}
        held = {k: np.concatenate([held[k], v]) for k, v in rows.items()} if held else rows
        whole = int(np.searchsorted(held["bucket"], held["bucket"][-1]))
        if whole:
            yield from groups({k: v[:whole] for k, v in held.items()})
            held = {k: v[whole:] for k, v in held.items()}
    if held:
        yield from groups(held)


def _links(found: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Edges (src < dst) in batches."""
    src, dst, n = [], [], 0

    def out() -> pa.RecordBatch:
        a, b = np.concatenate(src), np.concatenate(dst)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["src", "dst"])

    for a, b in found:
        src.append(a)
        dst.append(b)
        n += len(a)
        if n >= _PAIRS:
            yield out()
            src, dst, n = [], [], 0
    if n:
        yield out()


def _searched(dealt: DataFrame, rows: int, search) -> DataFrame:
    """src, dst of a search over each bucket of ``dealt``; the number of tasks follows the rows."""
    parts = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS, 1)
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(giving_back(search), "src long, dst long")


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links at up to ``RADIUS`` bits of each bucket (bucket, id: the fingerprint, lead)."""
    limits = np.full(65, RADIUS)

    def each(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids = rows["id"]
        i, j = GrayIndex(ids.view(np.uint64).reshape(-1, 1), limits, int(rows["lead"].view(np.uint64)[0])).links((RADIUS,))
        return ids[i], ids[j]

    return _links(each(rows) for rows in _per_bucket(batches))


def _chunks(rest: Column, sizes: list[int], path: Column) -> Column:
    """(path extended by chunk number and value, the bits that remain) for each chunk of ``rest``."""
    out, at = [], 0
    for k, size in enumerate(sizes):
        low = rest.bitwiseAND(F.lit((1 << at) - 1).cast("long"))
        high = F.shiftrightunsigned(rest, at + size) if at + size < 64 else F.lit(0).cast("long")
        value = F.shiftrightunsigned(rest, at).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
        out.append(F.struct(F.xxhash64(path, F.lit(k), value).alias("bucket"), F.shiftleft(high, at).bitwiseOR(low).alias("rest")))
        at += size
    return F.explode(F.array(*out))


def _buckets(entries: DataFrame, deal: int, target: int = BUCKET) -> DataFrame:
    """bucket, id, lead (bits that count only where they agree). Two unequal paths may share a bucket number; that only makes a bucket larger."""
    width = min(16, max(0, math.ceil(math.log2(max(entries.count(), 1) / target))))

    def first(k: int, bits: int) -> Column:
        value = F.shiftrightunsigned("id", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))
        return F.xxhash64(F.lit(k), F.shiftrightunsigned(value, 16 - bits))

    leads = [(0xFFFF << 16 * k) - (1 << 64 if k == 3 else 0) for k in range(4)]
    dealt = entries.select("id", F.explode(F.array(*(F.struct(first(k, width).alias("bucket"), F.lit(k).alias("k"), F.lit(leads[k]).cast("long").alias("lead")) for k in range(4)))).alias("x")).select("id", "x.*")
    out, bits = None, 64
    while True:
        # At most 4 x entries / deal buckets are that large, and few are; a table of known size, sent to the tasks only if it is small.
        large = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > deal).select("bucket")
        done = dealt.join(large, "bucket", "left_anti").select("bucket", "id", "lead")
        out = done if out is None else out.unionByName(done)
        again = dealt.join(large, "bucket", "left_semi")
        if 1 << bits <= deal or again.isEmpty():  # distinct fingerprints that differ in so few bits fit
            return out if 1 << bits > deal else out.unionByName(again.select("bucket", "id", "lead"))
        if bits == 64:  # by the whole chunk; whatever agrees on it comes along
            low = F.col("k") * 16
            value = F.expr("shiftrightunsigned(id, k * 16) & 65535L")
            rest = F.expr("CASE WHEN k = 3 THEN 0L ELSE shiftleft(shiftrightunsigned(id, k * 16 + 16), k * 16) END | (id & (shiftleft(1L, k * 16) - 1))")
            dealt, bits = again.select("id", F.xxhash64(F.lit(-1), "k", value).alias("bucket"), F.lit(0).cast("long").alias("lead"), rest.alias("rest"), low.alias("k")), 48
        else:
            sizes = [bits // 4 + (k < bits % 4) for k in range(4)]
            dealt, bits = again.select("id", "lead", "k", _chunks(F.col("rest"), sizes, F.col("bucket")).alias("x")).select("id", "lead", "k", "x.*"), bits - min(sizes)


def _components(marked: DataFrame, entries: DataFrame, edges: DataFrame, scratch: Scratch, key: str = "fp") -> DataFrame:
    """doc_id, fp, component_id from documents (doc_id, fp, key), entries (key, id, least) and links between entry ids."""
    linked = scratch.cut(connected_components(edges, scratch=scratch))
    lone = entries.join(linked, entries["id"] == linked["node"], "left").select(key, "least", F.coalesce("component", "id").alias("component"))
    # Both sides of the joins are plain exchanges of tables, so that adaptive execution may split a key that a third of all rows share.
    found = scratch.cut(lone)
    least = scratch.cut(found.groupBy("component").agg(F.min("least").alias("component_id")))
    named = scratch.cut(found.join(least, "component").select(key, "component", "component_id"))
    return marked.join(named, key).select(*marked.columns, "component", "component_id")


def near_groups(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, deal: int = DEAL) -> DataFrame:
    """doc_id, fp, component_id for every row: links at up to three bits of 64, all of them."""
    marked = scratch.cut(fingerprints(docs, shingle))
    entries = scratch.cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("id", F.col("fp")))
    links = _searched(_buckets(entries.select("id"), deal), 4 * entries.count(), _exact)
    return _components(marked, entries, links, scratch).select("doc_id", "fp", "component_id")


def bit_share(similarity: float) -> float:
    """The expected share of differing bits of two sets of equal size with that Jaccard similarity: the angle of their vectors over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def small_share(similarity: float = SIMILARITY, most: int = SMALL) -> float:
    """The largest expected share of differing bits of two sets of at least that similarity and at most ``most`` members: ties make it larger than the angle's."""
    worst = 0.0
    for b in range(1, most + 1):
        for a in range(math.ceil(similarity * b - 1e-9), b + 1):
            c = math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)  # the fewest shared members
            if c <= a:
                worst = max(worst, _differ(a, b, c))
    return worst


def _differ(a: int, b: int, c: int) -> float:
    """How likely a bit differs between the majorities of ``a`` and ``b`` fair hashes of which they share ``c``."""

    def over(own: int, x: int, total: int) -> float:
        return sum(math.comb(own, u) for u in range(own + 1) if 2 * (x + u) > total) / 2**own

    both = ((math.comb(c, x) / 2**c, over(a - c, x, a), over(b - c, x, b)) for x in range(c + 1))
    return sum(p * (s * (1 - t) + t * (1 - s)) for p, s, t in both)


class Search:
    """A search of ``entries`` (id, fp and more) for pairs that differ in at most that share of their bits: samples of bits that deal and that are compared.

    A sample's first ``width`` bits deal, so that a bucket holds some ``target`` unrelated entries; ``SKETCH`` further bits are what its buckets are indexed by.
    There are so many samples that a pair of exactly the share is met with ``RECALL``: agreeing on the dealing bits, within the limits of
    ``LEVELS`` levels of nodes, and within the radius.
    """

    def __init__(self, entries: DataFrame, share: float, target: int = TARGET, recall: float = RECALL, bits: int = 64 * WIDE, seed: int = SEED):
        self.entries, self.share, self.count = entries, share, entries.count()
        self.width = max(0, math.ceil(math.log2(max(self.count, 1) / target)))
        self.radius = tolerated(SKETCH, share, OUTSIDE)
        self.radii = tuple(round(self.radius * x) for x in STEPS)
        self.limits = np.array([tolerated(m, share, PRUNED) for m in range(SKETCH + 1)])
        met = (1 - share) ** self.width * (1 - LEVELS * PRUNED) * (1 - OUTSIDE)
        draw = random.Random(seed)
        self.samples = [draw.sample(range(bits), self.width + SKETCH) for _ in range(math.ceil(math.log(1 - recall) / math.log(1 - met)))]

    def dealt(self, entries: DataFrame) -> DataFrame:
        """bucket, id, s0, s1 and the other columns of ``entries`` (id, fp, ..), once for each sample."""
        samples, width = self.samples, self.width
        others = {c: t for c, t in entries.dtypes if c not in ("id", "fp")}
        types = dict.fromkeys(("bucket", "id", *(f"s{k}" for k in range(SKETCH // 64))), "bigint") | others
        names = list(types)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    words = _numbers(column(part, "fp"))
                    bit = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
                    for k, places in enumerate(samples):
                        key = xx_rows(np.packbits(bit[:, places[:width]], axis=1), k)
                        sketch = np.ascontiguousarray(np.packbits(bit[:, places[width:]], axis=1)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key), column(part, "id"), *(pa.array(np.ascontiguousarray(s)) for s in sketch.T), *(column(part, c) for c in others)], names)

        return entries.mapInArrow(giving_back(deal), ", ".join(f"{c} {t}" for c, t in types.items()))

    def forest(self, dealt: DataFrame) -> DataFrame:
        """src, dst: a spanning forest of each bucket's pairs within the radius, nearest first, between the components of ``dealt`` if it has them."""
        radii, limits = self.radii, self.limits

        def each(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            i, j = GrayIndex(_sketch(rows), limits).links(radii, rows.get("component"))
            return rows["id"][i], rows["id"][j]

        return _searched(dealt, self.count * len(self.samples), lambda batches: _links(each(r) for r in _per_bucket(batches))).distinct()

    def true(self, dealt: DataFrame, similarity: float) -> DataFrame:
        """src, dst: a spanning forest of each bucket's links of the similarity within the radius, between the components of ``dealt`` (which has size and delta too)."""
        radius, limits = self.radius, self.limits
        return _searched(dealt, self.count * len(self.samples), lambda batches: _links(_true(rows, limits, radius, similarity) for rows in _per_bucket(batches))).distinct()


def _true(rows: dict[str, np.ndarray], limits: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    i, j = GrayIndex(_sketch(rows), limits).links((radius,), rows["component"], _alike_rows(rows["size"], rows["delta"], similarity))
    return rows["id"][i], rows["id"][j]


def _whole(rows: DataFrame, count: int, similarity: float) -> DataFrame:
    """src, dst: a spanning forest of the links of the similarity between the components of each group (rows: group, id, fp, size, component, delta), whose pairs all meet."""
    dealt = rows.select(F.col("group").alias("bucket"), "id", *(F.col("fp")[k].alias(f"s{k}") for k in range(SKETCH // 64)), "size", "component", "delta")
    limits = np.full(SKETCH + 1, SKETCH)
    return _searched(dealt, count, lambda batches: _links(_true(r, limits, SKETCH, similarity) for r in _per_bucket(batches)))


def _sketch(rows: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([rows[f"s{k}"].view(np.uint64) for k in range(SKETCH // 64)], axis=1)


def _large(dealt: DataFrame, scratch: Scratch, deal: int) -> DataFrame:
    """bucket, hub (its least id) of the buckets of more than ``deal`` entries."""
    return scratch.cut(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("hub")).where(F.col("_n") > deal).select("bucket", "hub"))


def _in_blocks(dealt: DataFrame, large: DataFrame, scratch: Scratch, deal: int) -> DataFrame:
    """``dealt`` (with component), its ``large`` buckets cut into pairs of blocks, each a bucket of at most some ``deal`` entries.

    Entries of the hub's component, which are joined already, meet only the others of the bucket; those meet all. Nothing is left out but pairs within that
    component, so a large group of copies costs its size times the blocks of what is no part of it.
    """
    home = dealt.join(large, "bucket").where("id = hub").select("bucket", F.col("component").alias("_home"))
    hot = dealt.join(home, "bucket").withColumn("_own", F.col("component") == F.col("_home")).drop("_home")
    half = F.lit(max(deal // 2, 1))
    blocks = hot.groupBy("bucket").agg(F.ceil(F.count_if("_own") / half).cast("long").alias("_h"), F.ceil(F.count_if(~F.col("_own")) / half).cast("long").alias("_o"))
    hot = hot.join(scratch.cut(blocks), "bucket")
    at = F.when(F.col("_own"), F.col("_o") + F.pmod(F.xxhash64("id"), "_h")).otherwise(F.pmod(F.xxhash64("id"), "_o"))
    other = F.when(F.col("_own"), F.col("_o")).otherwise(F.col("_o") + F.col("_h"))
    met = F.explode(F.when(other > 0, F.sequence(F.lit(0).cast("long"), other - 1)).otherwise(F.array().cast("array<long>")))
    hot = hot.withColumn("_at", at).withColumn("_met", met).withColumn("bucket", F.xxhash64("bucket", F.least("_at", "_met"), F.greatest("_at", "_met")))
    return dealt.join(large, "bucket", "left_anti").unionByName(hot.select(*dealt.columns))


def _groups(proposed: DataFrame, scratch: Scratch) -> DataFrame:
    """node, group of the proposed links."""
    return scratch.cut(connected_components(proposed, scratch=scratch)).withColumnRenamed("component", "group")


def _open_groups(loose: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """group, members, centre (the most linked entry), node, component by ``links`` (verified) of the entries whose proposed group (``loose``) has several such components."""
    tight = scratch.cut(connected_components(links, scratch=scratch))
    degree = links.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    placed = scratch.cut(loose.join(tight, "node", "left").join(degree, "node", "left").select("group", "node", F.coalesce("component", "node").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree")))
    most = F.max(F.struct("degree", (-F.col("node")).alias("least")))
    several = placed.groupBy("group").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count(F.lit(1)).alias("members"), most.alias("_c"))
    several = scratch.cut(several.where("_a < _b").select("group", "members", (-F.col("_c.least")).alias("centre")))
    return scratch.cut(placed.drop("degree").join(several, "group"))


def _deltas(open_: DataFrame, entries: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """group, members, id, fp, size, component, delta: the shingles that an entry or its group's centre has, but not both; where those are more than the sets themselves, the sets."""
    centres = scratch.cut(open_.select("group", F.col("centre").alias("id")).distinct().join(sets, "id").select("group", F.col("grams").alias("_c")))
    told = open_.withColumnRenamed("node", "id").join(sets, "id").join(centres, "group")
    size, shared = F.size("grams"), F.size(F.array_intersect("grams", "_c"))
    way = scratch.cut(told.groupBy("group").agg((F.sum(F.size("_c") - 2 * shared) < 0).alias("_by")))
    delta = F.when(F.col("_by"), F.concat(F.array_except("grams", "_c"), F.array_except("_c", "grams"))).otherwise(F.col("grams"))
    rows = told.join(way, "group").select("group", "members", "id", size.cast("long").alias("size"), "component", delta.alias("delta"))
    return scratch.cut(rows.join(entries.select("id", "fp"), "id").select("group", "members", "id", "fp", "size", "component", "delta"))


def _sets(docs: DataFrame, entries: DataFrame, links: DataFrame, scratch: Scratch, shingle: int) -> DataFrame:
    """id, grams (distinct shingle hashes) of each linked entry, from a text of its least doc_id (of those without one, if it has no other)."""
    nodes = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    linked = scratch.cut(entries.join(nodes, "id", "left_semi").select("id", "least", F.col("digest").alias("_digest")))
    wanted = scratch.cut(linked.select("least").distinct())  # a table of known size: sent to the tasks only if it is small

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_set(t, shingle) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(g) for g in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["digest", "grams"])

    few = docs.select(F.col("doc_id").cast("long"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    told = few.mapInArrow(giving_back(run), "digest binary, grams array<long>")
    own = told.join(linked, F.col("digest") == F.col("_digest"))
    return scratch.cut(own.groupBy("id").agg(F.min("grams").alias("grams")))


def _alike(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links whose sets have the similarity; two empty sets are alike."""
    both = links.join(sets.select(F.col("id").alias("src"), F.col("grams").alias("_a")), "src").join(sets.select(F.col("id").alias("dst"), F.col("grams").alias("_b")), "dst")
    shared = both.select("src", "dst", F.size(F.array_intersect("_a", "_b")).alias("_k"), (F.size("_a") + F.size("_b")).alias("_n"))
    return shared.where((F.col("_n") == 0) | (F.col("_k") / F.greatest(F.col("_n") - F.col("_k"), F.lit(1)) >= similarity)).select("src", "dst")


def verified_links(proposed: DataFrame, sets: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, loose: DataFrame | None = None) -> DataFrame:
    """src, dst: proposed links of the similarity, and such links to the most linked entry of each proposed group of what is apart from it."""
    sure = scratch.cut(_alike(proposed, sets, similarity))
    loose = _groups(proposed, scratch) if loose is None else loose
    tight = scratch.cut(connected_components(sure, scratch=scratch))
    degree = sure.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    placed = scratch.cut(loose.join(tight, "node", "left").join(degree, "node", "left").select("group", "node", F.coalesce("component", "node").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree")))
    centre = placed.groupBy("group").agg(F.max(F.struct("degree", (-F.col("node")).alias("least"), "component")).alias("c")).select("group", (-F.col("c.least")).alias("centre"), F.col("c.component").alias("home"))
    centre = scratch.cut(centre)  # a table of known size: a large group is not dealt to one task where the centres can be broadcast
    apart = placed.join(centre, "group").where(F.col("component") != F.col("home"))
    more = apart.select(F.least("centre", "node").alias("src"), F.greatest("centre", "node").alias("dst")).join(proposed, ["src", "dst"], "left_anti")
    return scratch.cut(sure.unionByName(_alike(more, sets, similarity)))


def similar_groups(docs: DataFrame, scratch: Scratch, shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY, deal: int = DEAL, target: int = TARGET) -> DataFrame:
    """doc_id, fp, digest, component_id for every row: links between texts of the similarity, proposed by 512 bits and verified on whole texts."""
    marked = scratch.cut(wide_fingerprints(docs, shingle))
    # Equal fingerprints don't mean equal sets: one entry a set, so that links between equal fingerprints are verified like all others.
    entries = scratch.cut(marked.groupBy("digest").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id()))
    searches = [Search(entries, bit_share(similarity), target), Search(entries.where(F.col("size") <= SMALL), small_share(similarity), target)]
    dealt = [scratch.cut(s.dealt(s.entries.select("id", "fp"))) for s in searches]
    large = [_large(d, scratch, deal) for d in dealt]
    hubs = [d.join(w, "bucket").where("id <> hub").select(F.least("id", "hub").alias("src"), F.greatest("id", "hub").alias("dst")) for d, w in zip(dealt, large)]
    hubs = scratch.cut(hubs[0].unionByName(hubs[1]).distinct())
    known = None
    if not hubs.isEmpty():  # a large bucket is a large group: who is like its hub is joined first, and need not meet the others in it
        known = scratch.cut(_alike(hubs, _sets(docs, entries, hubs, scratch, shingle), similarity))
        joined = scratch.cut(connected_components(known, scratch=scratch))
        placed = [d.join(joined, d["id"] == joined["node"], "left").drop("node").withColumn("component", F.coalesce("component", "id")) for d in dealt]
        dealt = [_in_blocks(d, w, scratch, deal) for d, w in zip(placed, large)]
    proposed = [s.forest(d) for s, d in zip(searches, dealt)]
    proposed = proposed[0].unionByName(proposed[1])
    proposed = scratch.cut((proposed if known is None else proposed.unionByName(known)).distinct())
    sets = _sets(docs, entries, proposed, scratch, shingle)
    loose = _groups(proposed, scratch)
    links = verified_links(proposed, sets, scratch, similarity, loose)
    # A proposed link that failed must not hide a true one: what verified links leave apart in a proposed group is searched once more, for true links only.
    rows = _deltas(_open_groups(loose, links, scratch), entries, sets, scratch)
    few, many = rows.where(F.col("members") <= target), rows.where(F.col("members") > target).drop("members")
    more = scratch.cut(_whole(few, rows.count(), similarity))
    found = links.unionByName(more)
    if not many.isEmpty():
        for share, some in ((bit_share(similarity), many), (small_share(similarity), many.where(F.col("size") <= SMALL))):
            search = Search(some, share, target)
            # Samples of bits deal within each group.
            again = scratch.cut(search.dealt(search.entries).withColumn("bucket", F.xxhash64("bucket", "group")).drop("group"))
            wide = _large(again, scratch, deal)
            found = found.unionByName(scratch.cut(search.true(again if wide.isEmpty() else _in_blocks(again, wide, scratch, deal), similarity)))
    return _components(marked, entries, found, scratch, "digest")


def xx_rows(rows: np.ndarray, salt: int) -> np.ndarray:
    """A signed 64-bit number for each row of bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    out = np.full(len(rows), np.uint64(salt + 1))
    for word in wide.view("<u8").T:
        out = _mixed(out ^ word, 1)
    return out.view(np.int64)


def drop_near_copies(docs: DataFrame, scratch: Scratch, shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document (doc_id and shingle set) with the least doc_id, null last. Repeated rows of it stay with it."""
    groups = scratch.cut(similar_groups(docs, scratch, shingle, similarity).select("doc_id", "digest", "component").distinct())
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    least = scratch.cut(groups.groupBy("component").agg(F.min(rank).alias("_least")))
    told = scratch.cut(groups.join(least, "component").select("doc_id", "digest", (rank != F.col("_least")).alias("_goes")))
    # Where all texts of a doc_id go, the doc_id tells its rows; where only some go (or there is no doc_id), the shingle set must.
    ids = scratch.cut(told.groupBy("doc_id").agg(F.bool_and("_goes").alias("_all"), F.bool_or("_goes").alias("_any")).where("_any").select(F.col("doc_id").alias("_near_id"), (F.col("_all") & F.col("doc_id").isNotNull()).alias("_all")))
    stay = docs.join(ids.where("_all"), F.col("doc_id") == F.col("_near_id"), "left_anti")
    some = ids.where("NOT _all").select("_near_id")
    if some.isEmpty():
        return stay
    goes = scratch.cut(told.where("_goes").join(some, F.col("doc_id").eqNullSafe(F.col("_near_id")), "left_semi").select(F.col("doc_id").alias("_near_id"), F.col("digest").alias("_near_set")))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            digest = pa.array([set_digest(shingle_set(t, shingle)) for t in texts(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, digest], [*batch.schema.names, "_near_digest"])

    same = F.col("doc_id").eqNullSafe(F.col("_near_id"))
    marked = stay.join(some, same, "left_semi").mapInArrow(giving_back(run), T.StructType([*docs.schema.fields, T.StructField("_near_digest", T.BinaryType())]))
    kept = marked.join(goes, same & (F.col("_near_digest") == F.col("_near_set")), "left_anti").select(*[F.col(f"`{c}`") for c in names])
    return stay.join(some, same, "left_anti").unionByName(kept)


def op9_simhash_gray(spark, sf_dir: str) -> DataFrame:
    rows = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "simhash"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
