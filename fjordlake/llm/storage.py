"""Tables written to the folder that the driver and all executors share.

Lineage is cut by writing a table and reading it again, so a lost executor
costs a read of a file and not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: str | None = None
_stored: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only for a local session without it."""
    global _own_dir
    base = spark.conf.get(_SETTING, None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="fjordlake-")
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fjordlake/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session with another value of a setting, and as it was again afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and returns the table read back.

    What was shuffled for it goes as soon as it is written, as nothing else reads that.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _stored[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing reads any more; others are left alone."""
    for table in tables:
        path = _stored.pop(table, None)
        if path is not None:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a few numbers and digests, some 20 MB.
_BROADCAST_ROWS = 500_000


def broadcast_if_small(rows: DataFrame) -> DataFrame:
    """A materialised table of narrow rows, marked for broadcast if it has few; else for a shuffled join."""
    return F.broadcast(rows) if rows.count() <= _BROADCAST_ROWS else shuffled(rows)


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` marked for a shuffled join.

    Spark itself would size a table by its files, which are compressed, and
    one exploded as before that: it would send tables that the driver cannot hold.
    """
    return rows.hint("merge")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, salts: int = 32, weight: int | None = None) -> DataFrame:
    """``rows`` left-joined with a materialised table of one row a ``key``, however many rows have one key.

    Few groups are broadcast; more are joined by the key and a salt, so that
    the rows of one key are dealt to ``salts`` tasks. ``weight`` is what counts
    instead of the number of groups where these hold arrays.
    """
    if (groups.count() if weight is None else weight) <= _BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), key, "left")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return dealt.join(shuffled(salted), [key, "salt"], "left").drop("salt")


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lowers the rows of an Arrow batch, whose default suits numbers and not texts, unless the session sets its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))
