import os

import pytest

from fjordlake.llm.oracles import ORACLES
from fjordlake.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    frame = QUERIES[name](spark, SF)
    answer = connection.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(answer.fetchall())
    got = sorted(tuple(r[c] for c in columns) for r in frame.collect())
    assert len(got) == len(want) > 0
    assert [x for x in zip(got, want) if x[0] != x[1]][:3] == []
