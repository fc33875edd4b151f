"""Every query of the code graph against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from codelattice.jobs import catalogue, docs, features, reading

QUERIES = catalogue.QUERIES | docs.QUERIES | reading.QUERIES | features.QUERIES
ORACLE_SQL = catalogue.ORACLE_SQL | docs.ORACLE_SQL | reading.ORACLE_SQL | features.ORACLE_SQL

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("part", "lineitem", "orders", "events", "documents", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(column: str, value) -> str:
    if pd.isna(value):
        return ""
    if column in ("day", "ts", "start", "last_ts", "snapshot"):
        return str(pd.Timestamp(value))
    return str(value) if isinstance(value, (bool, str)) else str(float(value))


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted(tuple(map(plain, names, r)) for r in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got)
