"""Every query with SQL, against DuckDB on the smallest tables; the others must run and have rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.5f}"
    return str(value)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    expected = sorted(tuple(plain(row[i]) for i in order) for row in want.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == expected


@pytest.mark.parametrize("name", ["tuned_forest", "fitted_importance", "split_importance", "cv_early_stopped", "cv_kernels", "cv_logistic", "cv_boosted_trees", "cv_perceptron", "stacked_ensemble", "permutation_importance"])
def test_runs(spark, small, name):
    rows = entry.queries()[name](spark, small).collect()
    assert rows and all(0 <= v <= 1 for r in rows for c, v in r.asDict().items() if c.endswith(("auc", "share")))


def test_entry(spark):
    assert entry.entry(spark).count() == 5040
