"""Writes that are seen as a whole or not at all."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fjordlake.sinks.documents import Documents, Folder
from fjordlake.sinks.versions import Versions


@pytest.fixture
def documents(spark, tmp_path):
    spark.dataSource.register(Documents)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = f"file://{tmp_path}/documents"

    def write(rows, **options):
        rows.write.format("documents_by_kind").mode("append").options(**options).save(path)

    yield path, write, lambda: spark.read.format("documents_by_kind").option("pushdown", "true").load(path)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), "kind string, body string").repartition(3)


def test_kinds_are_replaced_one_by_one(spark, documents):
    path, write, read = documents
    write(rows_of(spark, *[("a", f"{i}") for i in range(50)], ("b", '{"x": "é"}'), (None, "n")))
    open_ = spark.read.format("documents_by_kind").option("manifest", Folder(path).manifests()[-1]).load(path)
    write(rows_of(spark, ("a", "new"), ("c", None)))
    assert sorted((r.kind or "", r.body) for r in read().collect()) == [("", "n"), ("a", "new"), ("b", '{"x": "é"}'), ("c", "")]
    assert open_.count() == 52  # a reader of the first manifest has its files still
    listed = {f["kind"]: (f["rows"], f["raw_bytes"]) for f in Folder(path).manifest()}
    assert listed == {"a": (1, 4), "b": (1, 12), "c": (1, 1), None: (1, 2)}


def test_filters_leave_files_out(spark, documents):
    _, write, read = documents
    write(rows_of(spark, *[(k, k) for k in "abcdef"]))
    found = read().where(F.col("kind").isin("a", "c"))
    assert sorted(r.body for r in found.collect()) == ["a", "c"] and found.rdd.getNumPartitions() == 2
    assert [r.body for r in read().where("kind = 'd' AND body <> 'x'").collect()] == ["d"]


def test_a_failing_task_leaves_the_old(spark, documents, tmp_path):
    path, write, read = documents
    write(rows_of(spark, ("a", "old"), ("b", "old")))
    before = os.listdir(tmp_path / "documents" / "data")
    bad = spark.range(40).repartition(4).select(
        F.lit("a").alias("kind"), F.when(F.col("id") == 33, F.raise_error(F.lit("no")).cast("string")).otherwise("new").alias("body")
    )
    with pytest.raises(PySparkException):
        write(bad)
    assert sorted(r.body for r in read().collect()) == ["old", "old"] and len(Folder(path).manifests()) == 1
    write(rows_of(spark, ("c", "new")))  # and clears what was left, even by tasks that were still writing
    assert sorted(r.body for r in read().collect()) == ["new", "old", "old"]
    assert len(list((tmp_path / "documents" / "data").rglob("*.gz"))) == 3 and before[0] in os.listdir(tmp_path / "documents" / "data")


def test_old_files_go_with_their_manifests(spark, documents, tmp_path):
    path, write, read = documents
    for k in range(4):
        write(rows_of(spark, ("a", str(k))), keep="1")
    assert [r.body for r in read().collect()] == ["3"]
    assert len(Folder(path).manifests()) == 1 and len(list((tmp_path / "documents" / "data").rglob("*.gz"))) == 1


def test_readers_keep_their_version(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/table")
    with pytest.raises(FileNotFoundError):
        versions.read()
    assert versions.write(spark.range(10)) == 1
    open_, until = versions.read(), versions.marks()[0][1]
    versions.write(spark.range(25))
    assert (open_.count(), versions.read().count(), versions.read(until).count() in (10, 25)) == (10, 25, True)
    with pytest.raises(PySparkException):
        versions.write(spark.range(5).select(F.raise_error(F.lit("no")).cast("string").alias("x")))
    assert versions.newest() == 2 and versions.read().count() == 25 and open_.count() == 10
    assert versions.write(spark.range(3)) == 4
    versions.clear(1)
    assert [n for n, _ in versions.marks()] == [4] and sorted(os.listdir(tmp_path / "table" / "data")) == ["4"]
    assert versions.newest(0) is None
