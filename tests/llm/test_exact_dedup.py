import hashlib

from fjordlake.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, keep_id string, sha string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA).repartition(3)


def test_against_brute_force(spark):
    rows = [(i, f"text {i % 7}" if i % 3 else "") for i in range(60)] + [(99, None), (98, "Text 1"), (97, "x" * 100_000)]
    want = {}
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        want[i] = (max(same), len(same), i == max(same), hashlib.sha256((t or "").encode()).hexdigest())
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in X.exact_duplicates(frame(spark, rows)).collect()}
    assert got == want
    kept = X.drop_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "keep_id", "sha"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in want.items() if v[2])


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (None, "c"), (2, "d")]
    got = X.exact_duplicates(frame(spark, rows)).collect()
    assert len(got) == 7 and sum(r.kept for r in got) == 4
    kept = sorted((r.doc_id or 0, r.text) for r in X.drop_duplicates(frame(spark, rows)).collect())
    assert kept == [(0, "c"), (1, "a"), (1, "b"), (2, "d")]


def test_shared_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(X.F, "sha2", lambda c, n: X.F.hex(X.F.lit(b"\x00" * 32)))
    rows = [(1, "a"), (2, "b"), (3, "a")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in X.exact_duplicates(frame(spark, rows)).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_empty(spark):
    assert X.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
