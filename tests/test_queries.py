"""Every query with SQL against DuckDB, the others against plain Python."""

import duckdb
import pytest

from quernel.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def values(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_equals_sql(spark, duck, name):
    own, sql = q.QUERIES[name](spark, SF).toPandas(), duck.execute(q.SQL[name]).df()
    columns = sorted(sql.columns)
    assert columns == sorted(own.columns) and values(own, columns) == values(sql, columns)


def test_stream_equals_batch(spark):
    key = lambda r: str(tuple(r))
    assert sorted(q.event_fold_stream(spark, SF).collect(), key=key) == sorted(q.event_fold_batch(spark, SF).collect(), key=key)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
