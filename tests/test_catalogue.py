"""Every query with an oracle equals DuckDB on the smallest tables."""

import duckdb
import pytest

from shoalmark import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    def text(x):
        if x is None or x != x:
            return "~"
        return f"{x + 0.0:.5f}" if isinstance(x, float) else str(x)

    return sorted(tuple(text(r[c]) for c in columns) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(catalogue.oracle_sql()[name]).to_arrow_table()
    assert columns == sorted(want.column_names)
    assert rows(columns, [r.asDict() for r in got.collect()]) == rows(columns, want.to_pylist())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - {"bpr_topn", "svd_embedding_similarity"}))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).limit(5).collect() is not None
