import math
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import similarity as S
from kindred.operators import nearest, profile as R


def by_pairs(rows, asked, k):
    """Each pair by the expression's steps."""
    dot = lambda a, b: reduce(lambda s, v: s + v, (x * y for x, y in zip(a, b)), 0.0)  # noqa: E731  in order: sum() would compensate
    out = set()
    for q, a in asked:
        each = []
        for o, b in rows:
            if o is None or o == q:
                continue
            known = a is not None and b is not None and len(a) == len(b) and None not in a and None not in b
            both = known and dot(a, a) * dot(b, b)
            c = None if not known else float("nan") if not both else dot(a, b) / math.sqrt(both)
            each.append(((2, 0) if c is None else (0, 0) if c != c else (1, -c), o, c))
        out |= {(q, o, str(c)) for _, o, c in sorted(each, key=lambda x: x[:2])[:k]}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_nearest_against_all_pairs(spark, monkeypatch, small):
    if small:  # many cells, several products in each
        for name, value in (("BLOCK_BYTES", 64 * 40), ("_QUERIES", 3), ("_VECTORS", 7), ("_EXACT", 5)):
            monkeypatch.setattr(nearest, name, value)
    draw = np.random.default_rng(61)
    vectors = [[float(x) for x in draw.normal(size=8).astype("f4")] for _ in range(60)]
    vectors += [list(vectors[5]) for _ in range(60)]  # copies: more than k, ties by key
    vectors += [[-x for x in vectors[7]], [0.0] * 8, None, None, [1.0, 2.0], [1.0, 3.0], [1.0, None] + [0.5] * 6]
    rows = [(int(k), v) for k, v in zip(draw.permutation(len(vectors)), vectors)]
    df = spark.createDataFrame([*rows, (None, vectors[0])], "id long, v array<float>")
    asked = [(k, v) for k, v in rows if k % 4 == 0 or v is None or len(v) == 2 or not any(x or 0 for x in v)]
    got = R.vector_neighbours(df, df.where(F.col("id").isin([k for k, _ in asked])), "id", "v", 5).collect()
    assert len(got) == 5 * len(asked)
    assert {(r["query"], r["other"], str(r["cosine"])) for r in got} == by_pairs(rows, asked, 5)
    assert R.vector_neighbours(df.where("id < 0"), df.where("id < 0"), "id", "v").count() == 0


def test_no_pair_of_all_is_a_row(spark):
    """No join of all queries with all vectors, and nothing broadcast."""
    df = spark.range(3000).select(F.col("id"), F.array(F.rand(1), F.rand(2), F.rand(3)).alias("v"))
    out = R.vector_neighbours(df, df.where("id % 20 = 0"), "id", "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    one = df.where("id = 40").select(F.col("v").alias("q")).first()["q"]
    want = df.where("id <> 40").select("id", S.cosine(F.lit(one), F.col("v")).alias("c")).orderBy(F.desc("c"), "id").limit(10).collect()
    got = out.where("query = 40").orderBy(F.desc("cosine"), "other").collect()
    assert [(r["other"], r["cosine"]) for r in got] == [(r["id"], r["c"]) for r in want]
