"""Every query whose rows SQL can say, against DuckDB over the same tables."""

import os

import duckdb
import pytest

from gaugeworks import queries as base

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(x):
    return round(x, 9) if isinstance(x, float) else float(x) if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(base.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    got = base.queries()[name](spark, SF)
    want = sql.execute(base.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = lambda it: sorted(repr(tuple(same(v) for v in r)) for r in it)
    assert rows(got.select(*names).collect()) == rows(want.fetchall())


def test_streams_keep_every_talent(spark):
    rows = base.queries()["talent_roundtrip"](spark, SF).collect()
    assert rows and all(r.same for r in rows)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
