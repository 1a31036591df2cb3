from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kindred.functions import similarity as S

WORDS = st.lists(st.sampled_from(["ivan", "petr", "llc", "анна", "co", "x"]), max_size=4).map(" ".join)
SHORT = st.text(alphabet="abcй ", max_size=12)


def table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(SHORT, SHORT)
def test_ratios(a, b):
    assert S.lcs(a, b) == table(a, b)
    assert S.ratio(a, b) == S.ratio(b, a) and 0 <= S.ratio(a, b) <= 100 and S.ratio(a, a) == 100
    assert S.partial_ratio(a, b) >= S.ratio(a, b) - 1e-9 or not a or not b or len(a) != len(b)
    assert S.partial_ratio(a, a + b) == (100 if a or not b else 0)  # an empty name is like no other


@settings(max_examples=200, deadline=None)
@given(SHORT.filter(bool), SHORT.filter(bool))
def test_partial_ratio_by_definition(a, b):
    def best(s, t):
        return max(S.ratio(s, t[max(i, 0) : i + len(s)]) for i in range(1 - len(s), len(t)))

    s, t = sorted((a, b), key=len)
    want = max(best(s, t), best(t, s)) if len(a) == len(b) else best(s, t)
    assert S.partial_ratio(a, b) == want


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_token_ratios(a, b):
    assert S.token_sort_ratio(a, b) == S.token_sort_ratio(" ".join(reversed(a.split())), b)
    assert S.token_set_ratio(a, b) == S.token_set_ratio(b, a)
    if a and set(a.split()) <= set(b.split()):
        assert S.token_set_ratio(a, b) == 100
    if not a:
        assert S.token_set_ratio(a, b) == 0


def test_expressions(spark):
    rows = [("ivan petrov", "petrov ivan"), ("", ""), ("a", ""), ("", "b"), ("abc", "axbyc"), (None, "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(S.fuzz_ratio_udf("a", "b").alias("u"), S.native_ratio(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))).alias("n")).collect()
    assert [r["n"] for r in got] == [S.ratio(a or "", b or "") for a, b in rows]
    assert [r["u"] for r in got] == [S.ratio(a, b) if a is not None else 0 for a, b in rows]
    arrays = spark.createDataFrame([(["a", "a", "b"], ["b", "c"]), ([], []), ([], ["a"])], "x array<string>, y array<string>")
    assert [round(r[0], 6) for r in arrays.select(S.jaccard(F.col("x"), F.col("y"))).collect()] == [0.333333, 1.0, 0.0]
