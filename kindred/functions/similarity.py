"""String similarities of name pairs: native expressions where Catalyst has them, one Arrow function for all edit ratios of a batch."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from kindred.functions import names as N, values as V


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of it in one integer."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer one, its short prefixes and suffixes included."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0

    def best(s: str, t: str) -> float:
        m, out = len(s), 0.0
        if s in t:
            return 100.0
        for i in range(1 - m, len(t)):
            w = t[max(i, 0) : i + m]
            if w and (w[0] in s or w[-1] in s):
                out = max(out, ratio(s, w))
        return out

    s, t = (a, b) if len(a) <= len(b) else (b, a)
    return max(best(s, t), best(t, s)) if len(a) == len(b) else best(s, t)


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(z)) for z in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    gap = 1 if both else 0
    n, m = len(both) + gap + len(left), len(both) + gap + len(right)
    first = 100.0 * (1 - (len(left) + len(right) - 2 * lcs(left, right)) / (n + m))
    if not both:
        return first
    return max(first, 100.0 * (1 - (gap + len(left)) / (len(both) + n)), 100.0 * (1 - (gap + len(right)) / (len(both) + m)))


def sequence_ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def _pairwise(f: Callable[[str, str], float]):
    """An Arrow function of two columns; null on either side gives 0."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for k in zip(a, b):
            if k not in seen:
                seen[k] = 0.0 if k[0] is None or k[1] is None else f(*k)
            out.append(seen[k])
        return pd.Series(out, dtype="float64")

    return pandas_udf(run, T.DoubleType())


fuzz_ratio_udf, partial_ratio_udf, token_sort_udf, token_set_udf, sequence_udf = map(_pairwise, (ratio, partial_ratio, token_sort_ratio, token_set_ratio, sequence_ratio))

_RATIOS = ["fuzz_ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "core_fuzz_ratio", "core_token_sort_ratio", "core_token_set_ratio"]


@pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in _RATIOS]))
def all_ratios(a: pd.Series, b: pd.Series, core_a: pd.Series, core_b: pd.Series) -> pd.DataFrame:
    """Every edit ratio that the features need, in one trip to Python; equal pairs of a batch are computed once."""
    seen: dict[tuple, tuple] = {}
    out = []
    for k in zip(a, b, core_a, core_b):
        if k not in seen:
            x, y, p, q = k
            seen[k] = (ratio(x, y), partial_ratio(x, y), token_sort_ratio(x, y), token_set_ratio(x, y), ratio(p, q), token_sort_ratio(p, q), token_set_ratio(p, q))
        out.append(seen[k])
    return pd.DataFrame(out, columns=_RATIOS, dtype="float64")


def native_ratio(a: Column, b: Column) -> Column:
    """``ratio`` as an expression: the table of common subsequences, a row for each character. For short strings where Python is to be avoided."""
    zeros = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))
    chars_b = F.when(b == "", F.array().cast("array<string>")).otherwise(F.split(b, ""))
    chars_a = F.when(a == "", F.array().cast("array<string>")).otherwise(F.split(a, ""))

    def step(row: Column, ch: Column) -> Column:
        cells = F.arrays_zip(chars_b.alias("c"), F.slice(row, 1, F.length(b)).alias("up_left"), F.slice(row, 2, F.length(b)).alias("up"))
        return F.aggregate(
            cells, F.array(F.lit(0)),
            lambda acc, x: F.concat(acc, F.array(F.when(x["c"] == ch, x["up_left"] + 1).otherwise(F.greatest(x["up"], F.element_at(acc, -1))))),
        )

    length = F.element_at(F.aggregate(chars_a, zeros, step), -1)
    n = F.length(a) + F.length(b)
    return F.when(n == 0, 100.0).otherwise(200.0 * length / n)


def jaccard(a: Column, b: Column) -> Column:
    """Of token arrays, as sets: both empty 1, one empty 0."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def legal_forms(tokens: Column) -> Column:
    return F.array_intersect(tokens, F.array(*map(F.lit, V.LEGAL_FORMS_FEATURES)))


def core_name(name: Column | str) -> Column:
    return N.drop_tokens(name, V.LEGAL_FORMS_FEATURES)


def same(a: Column, b: Column) -> Column:
    """1 if equal and known, else 0."""
    return F.coalesce((a == b).cast("int"), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
