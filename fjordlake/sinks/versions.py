"""Tables whose refresh readers do not notice: versions, and a mark for each that is set after its write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Versions of a Parquet table in a folder of any store that Spark can reach.

    A version is a folder of its own and counts once its mark, an empty file,
    is there. Readers open a version and keep it: a refresh writes beside
    it. :meth:`clear` removes old versions, all but the newest ``keep``, and
    what writes without a mark have left.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._make = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._make(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[tuple[str, int]]:
        where = self._make(f"{self.path}/{folder}")
        return [(s.getPath().getName(), s.getModificationTime()) for s in self._files.listStatus(where)] if self._files.exists(where) else []

    def marks(self) -> list[tuple[int, int]]:
        """Numbers of versions and when they were set, in milliseconds, in order."""
        return sorted((int(name), at) for name, at in self._names("marks") if name.isdigit())

    def newest(self, until_ms: int | None = None) -> int | None:
        """The last version, or the last that was set at a time or before."""
        found = [n for n, at in self.marks() if until_ms is None or at <= until_ms]
        return found[-1] if found else None

    def folder(self, number: int) -> str:
        return f"{self.path}/data/{number}"

    def write(self, rows: DataFrame) -> int:
        """A new version of the rows; without its mark if the write fails, so that the former one stays."""
        taken = [int(n) for n, _ in self._names("data") if n.isdigit()]
        number = max([0, *taken, *[n for n, _ in self.marks()]]) + 1
        rows.write.parquet(self.folder(number))
        self._files.create(self._make(f"{self.path}/marks/{number}"), False).close()
        return number

    def read(self, until_ms: int | None = None) -> DataFrame:
        """The rows of the newest version; they stay the same while others are written."""
        number = self.newest(until_ms)
        if number is None:
            raise FileNotFoundError(f"no version in {self.path}")
        return self.spark.read.parquet(self.folder(number))

    def clear(self, keep: int = 2) -> None:
        marked = [n for n, _ in self.marks()]
        kept = set(marked[-keep:])
        for n in marked:
            if n not in kept:
                self._files.delete(self._make(f"{self.path}/marks/{n}"), False)
        for name, _ in self._names("data"):
            if name.isdigit() and int(name) not in kept and int(name) < max(kept, default=0):
                self._files.delete(self._make(f"{self.path}/data/{name}"), True)
