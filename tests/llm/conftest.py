import pytest
from pyspark.sql import types as T

#: Names that operators use inside, to clash with.
CLASHING = ["_t", "_b", "_s", "_low", "_words", "fp", "uid", "occ", "bucket", "features", "score", "label", "path", "left", "right", "piece", "n", "toxic", "prediction", "probability", "keep_id", "ids", "id", "host"]

LONG = "word " * 60_000 + "tail"
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "alpha beta gamma delta epsilon zeta eta theta"), (3, "alpha  beta\tgamma\ndelta epsilon zeta eta theta"), (4, ""), (5, None), (6, " "), (7, LONG), (8, LONG),
    (None, "no id here at all"), (None, None), (9, "one"), (9, "one"), (10, "x" * 70_000), (11, "日本語 😀 é ß <|endoftext|> tail"), (12, "two words"),
]


def table(spark, rows, key="doc_id", text="text"):
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField(text, T.StringType()), *(T.StructField(c, T.StringType()) for c in ("lang", "source")), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHING)])
    return spark.createDataFrame([(k, t, None, None, None, *("clash" for _ in CLASHING)) for k, t in rows], schema)


@pytest.fixture(scope="session")
def odd(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def scratch(spark):
    from kindred.plans.scratch import Scratch

    return Scratch(spark, "test")
