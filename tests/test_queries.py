import glob
import os

import duckdb
import pytest

from kindred import queries as Q, service_queries as V

SF = "/root/testdata/sf0.001"
QUERIES, SQL = {**Q.QUERIES, **V.QUERIES}, {**Q.SQL, **V.SQL}


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_as_sql(spark, base, name):
    got, want = QUERIES[name](spark, SF).toPandas(), base.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).values.tolist()))
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).toPandas().shape[1] > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_models_learn(spark):
    """Held-out pairs of other entities: far better than chance, and the label is no feature."""
    rows = {(r["model"], r["pair_type"]): r["accuracy"] for r in Q.model_metrics(spark, SF.replace("0.001", "0.01")).collect()}
    for model in ("forest", "logistic"):
        assert rows[model, "positive_same_public_id"] > 0.8 and rows[model, "easy_negative_different_public_id"] > 0.85


def test_samples_are_whole(spark):
    where = SF.replace("0.001", "0.01")
    assert Q.easy_negatives(spark, where).distinct().count() == 2000
    labels = {r["party_public_id"]: r["n"] for r in Q.records(spark, where).groupBy("party_public_id").count().withColumnRenamed("count", "n").collect()}
    of = {r["idx"]: r["party_public_id"] for r in Q.records(spark, where).collect()}
    got = {}
    for r in Q.positive_pairs(spark, where).collect():
        assert of[r["idx1"]] == of[r["idx2"]] and r["idx1"] < r["idx2"]
        got.setdefault(of[r["idx1"]], set()).add((r["idx1"], r["idx2"]))
    assert {k: len(v) for k, v in got.items()} == {k: min(n * (n - 1) // 2, 50) for k, n in labels.items() if n > 1}
