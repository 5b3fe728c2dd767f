import pytest
from pyspark.sql import functions as F

from fjordlake.llm import storage as S


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("salts", [2, 8])
def test_exploded_groups_are_not_broadcast_by_their_size_in_files(spark, salts):
    rows = spark.range(300).select((F.col("id") % 40).alias("key"), "id")
    groups = S.materialize(spark.range(30).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice")), "groups")
    joined = S.join_groups(rows, groups, "key", salts, S._BROADCAST_ROWS + 1)
    assert sorted((r.id, r.twice) for r in joined.collect()) == [(i, 2 * (i % 40) if i % 40 < 30 else None) for i in range(300)]
    assert "BroadcastHashJoin" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert "BroadcastHashJoin" in plan(S.join_groups(rows, groups, "key", salts))


def test_many_rows_are_not_broadcast(spark, monkeypatch):
    rows, some = spark.range(100), S.materialize(spark.range(5), "some")
    assert "BroadcastHashJoin" in plan(rows.join(S.broadcast_if_small(some), "id", "left_semi"))
    monkeypatch.setattr(S, "_BROADCAST_ROWS", 4)
    joined = rows.join(S.broadcast_if_small(some), "id", "left_semi")
    assert joined.count() == 5 and "SortMergeJoin" in plan(joined) and "BroadcastHashJoin" not in plan(joined)
