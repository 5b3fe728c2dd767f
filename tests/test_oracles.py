"""Each registered query gives the rows of its SQL."""

import math
import os
from decimal import Decimal

import pytest

from fjordlake.plans.oracles import ORACLES
from fjordlake.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


def plain(x):
    if isinstance(x, Decimal):
        return float(x)
    return None if isinstance(x, float) and math.isnan(x) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    got = rows_of(frame.columns, frame.collect())
    answer = duck.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    want = rows_of(columns, answer.fetchall())
    assert sorted(columns) == sorted(frame.columns)
    assert len(got) == len(want) > 0
    assert [(g, w) for g, w in zip(got, want) if g != w][:3] == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, SF.replace("sf0.01", "sf0.001")).count() > 0
