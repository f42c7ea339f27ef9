"""Every registered query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from attestor import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(value):
    value = value.item() if hasattr(value, "item") else value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value if isinstance(value, (int, bool)) or value is None else str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    ours = queries.QUERIES[name](spark, DATA).toPandas()
    assert rows(ours) == rows(duck.sql(queries.ORACLE_SQL[name]).df())


def test_every_sql_has_a_query():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
