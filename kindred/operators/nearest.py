"""The nearest vectors by cosine, exact: blocks of queries meet blocks of vectors as matrix products, and what may be among the nearest is computed once more, in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a block of vectors as doubles, pairs that are worth a cell of their own, and blocks of vectors that small blocks may be cut to.
BLOCK_BYTES, CELL_PAIRS, CELLS = 1 << 25, 1 << 24, 64
#: Queries and vectors of one product, and pairs that are computed in order at once.
_QUERIES, _VECTORS, _EXACT = 256, 4096, 1 << 15
#: What products may be off by, for each dimension and in all.
_OFF = 1e-14
#: Places in the order of pairs without a cosine (last), of NaN (first), and of pairs of a query with itself (none).
_NULL, _NAN, _SELF = -2.0, 3.0, -np.inf


def _matrix(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, padded by zeros, and their lengths; -1 where a vector or one of its numbers is null."""
    flat = values.flatten()
    length = np.array([-1 if v is None else v for v in values.value_lengths().to_pylist()], np.int64)
    ends = np.cumsum(np.maximum(length, 0))
    row = np.repeat(np.arange(len(length)), np.maximum(length, 0))
    out = np.zeros((len(length), width))
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    out[row[known], (np.arange(len(flat)) - (ends - np.maximum(length, 0))[row])[known]] = flat.drop_null().to_numpy(zero_copy_only=False)
    length[row[~known]] = -1
    out[length < 0] = 0
    return out, length


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed in order, as the expression does: equal vectors give equal sums."""
    return np.add.accumulate(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


def _first(order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each place of ``order``, which is sorted by ``group``, its number within the group."""
    at = group[order]
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    return np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))


def _few_copies(ids: np.ndarray, vectors: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k nearest of any query: of equal vectors those of the k + 1 least ids, as ties go by id and one may be the query itself."""
    bits = np.ascontiguousarray(np.column_stack([vectors, length.astype(float)]))
    _, same = np.unique(bits.view(np.dtype((np.void, bits.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort([ids, same])
    fresh = np.r_[True, (ids[order][1:] != ids[order][:-1]) | (same[order][1:] != same[order][:-1])]
    nth = np.cumsum(fresh)
    return order[nth - nth[np.arange(len(order)) - _first(order, same)] <= k]


def nearest(ids: np.ndarray, vectors: np.ndarray, length: np.ndarray, of: np.ndarray, asked: np.ndarray, asked_length: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query, vector), cosine and whether it is known, of the k nearest of each query; ties by id (``ids`` and ``of`` are numbers in the order of the keys)."""
    keep = _few_copies(ids, vectors, length, k)
    margin = _OFF * (vectors.shape[1] + 1)
    norms, own = _dots(vectors, vectors), _dots(asked, asked)
    with np.errstate(all="ignore"):
        unit, asked_unit = vectors / np.sqrt(norms)[:, None], asked / np.sqrt(own)[:, None]
    out = []
    for at in range(0, len(of), _QUERIES):
        qs = slice(at, at + _QUERIES)
        held_q, held_v, held_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        bar = np.full(len(of[qs]), _SELF)
        for k0 in range(0, len(keep), _VECTORS):
            rows = keep[k0 : k0 + _VECTORS]
            with np.errstate(all="ignore"):
                near = asked_unit[qs] @ unit[rows].T
            near[np.isnan(near)] = _NAN
            unlike = asked_length[qs][:, None] != length[rows]
            near[unlike | (asked_length[qs] < 0)[:, None]] = _NULL
            near[of[qs][:, None] == ids[rows]] = _SELF
            if not k0 and len(rows) > k:
                bar = np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k]
            q, v = np.nonzero((near >= (bar - margin)[:, None]) & (near != _SELF))
            held_q, held_v, held_s = np.r_[held_q, q], np.r_[held_v, rows[v]], np.r_[held_s, near[q, v]]
            order = np.lexsort([-held_s, held_q])
            nth = order[_first(order, held_q) == k - 1]
            bar[held_q[nth]] = held_s[nth]
            stays = held_s >= bar[held_q] - margin
            held_q, held_v, held_s = held_q[stays], held_v[stays], held_s[stays]
        held_q += at
        known, cosine = held_s != _NULL, np.zeros(len(held_q))
        with np.errstate(all="ignore"):
            for c in range(0, len(held_q), _EXACT):
                a, b = held_q[c : c + _EXACT], held_v[c : c + _EXACT]
                cosine[c : c + _EXACT] = _dots(asked[a], vectors[b]) / np.sqrt(own[a] * norms[b])
        place = np.where(known, np.where(np.isnan(cosine), _NAN, cosine), _NULL)
        order = np.lexsort([ids[held_v], -place, held_q])
        order = order[_first(order, held_q) < k]
        out.append((held_q[order], held_v[order], cosine[order], known[order]))
    return tuple(np.concatenate(x) for x in zip(*out))


def in_cells(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """query, other, cosine from rows (cell, asked, key, vector) sorted by cell: the k nearest within each cell. No more than a cell and a batch is held."""

    def told(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        cell = cell.combine_chunks()
        key, asked = cell["key"].combine_chunks(), cell["asked"].to_numpy()
        ids = np.unique(key.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        vectors, length = _matrix(cell["vector"].combine_chunks(), width)
        qs, vs = np.flatnonzero(asked), np.flatnonzero(~asked)
        if len(qs) and len(vs):
            q, v, cosine, known = nearest(ids[vs], vectors[vs], length[vs], ids[qs], vectors[qs], length[qs], k)
            yield pa.RecordBatch.from_arrays([key.take(pa.array(qs[q])), key.take(pa.array(vs[v])), pa.array(cosine, mask=~known)], ["query", "other", "cosine"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        cells = batch.column(0).to_numpy()
        ends = np.flatnonzero(np.r_[cells[1:] != cells[:-1], True]) + 1 if len(cells) else []
        for start, end in zip(np.r_[0, ends[:-1]].astype(int), ends):
            if held and held[-1].column(0)[0].as_py() != cells[start]:
                yield from told(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield from told(pa.Table.from_batches(held))
