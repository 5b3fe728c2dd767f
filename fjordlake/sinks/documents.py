"""Gzipped documents by kind: tasks write, and one manifest publishes all or nothing."""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from pyspark import TaskContext


@dataclass
class Written:
    kind: str
    file: str
    rows: int
    raw_bytes: int
    bytes: int


@dataclass
class _Message(WriterCommitMessage):
    files: list[Written]


class Folder:
    """A folder with ``data`` files and numbered ``manifests``, in a store that Arrow can reach."""

    def __init__(self, path: str) -> None:
        self.files, self.path = fs.FileSystem.from_uri(path)
        self.path = self.path.rstrip("/")

    def _list(self, folder: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.path}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File)

    def manifests(self) -> list[str]:
        return [n for n in self._list("manifests") if n.endswith(".json")]

    def manifest(self, name: str | None = None) -> list[dict]:
        """Kind, file, rows, bytes as text and bytes on disk of all files of a manifest, the newest if none is named."""
        names = self.manifests()
        if name is None and not names:
            return []
        with self.files.open_input_stream(f"{self.path}/manifests/{name or names[-1]}") as f:
            return json.loads(f.read())

    def put(self, name: str, content: bytes) -> None:
        folder = f"{self.path}/{name}".rpartition("/")[0]
        self.files.create_dir(folder, recursive=True)
        with self.files.open_output_stream(f"{self.path}/{name}", compression=None) as f:
            f.write(content)

    def get(self, name: str) -> bytes:
        with self.files.open_input_stream(f"{self.path}/{name}", compression=None) as f:
            return f.read()

    def publish(self, files: list[Written]) -> None:
        """A manifest of the new files and of those of other kinds, in one move."""
        kinds = {f.kind for f in files}
        kept = [f for f in self.manifest() if f["kind"] not in kinds]
        names = self.manifests()
        number = int(names[-1].split(".")[0]) + 1 if names else 1
        hidden = f"manifests/.{uuid.uuid4().hex}"
        self.put(hidden, json.dumps([*kept, *map(asdict, files)]).encode())
        self.files.move(f"{self.path}/{hidden}", f"{self.path}/manifests/{number:08d}.json")

    def clear(self, keep: int) -> None:
        """Removes all but the newest manifests, and data that none of those names, also what failed writes have left."""
        names = self.manifests()
        used = {f["file"] for n in names[-keep:] for f in self.manifest(n)}
        found = self.files.get_file_info(fs.FileSelector(f"{self.path}/data", recursive=True, allow_not_found=True))
        for f in found:
            if f.type == fs.FileType.File and f.path.rsplit("/data/", 1)[1] not in used:
                self.files.delete_file(f.path)
        for n in names[:-keep]:
            self.files.delete_file(f"{self.path}/manifests/{n}")

    def remove(self, write: str) -> None:
        where = f"{self.path}/data/{write}"
        if self.files.get_file_info(where).type == fs.FileType.Directory:
            self.files.delete_dir(where)


class Documents(DataSource):
    """Rows ``kind, body``: texts of documents, one a line of gzipped files, in folder ``path``.

    A write replaces the kinds it has rows of; other kinds stay. It is seen
    as a whole or not at all, and files of a failed write are removed, at the
    latest with the next write; there is one writer at a time. A read takes
    the newest manifest when it is planned, or the one that option
    ``manifest`` names, and keeps to it. Option ``keep`` is how many
    manifests stay; with ``pushdown`` (and Spark's
    ``spark.sql.python.filterPushdown.enabled``) filters on ``kind`` leave
    files out.
    """

    @classmethod
    def name(cls) -> str:
        return "documents_by_kind"

    def schema(self) -> str:
        return "kind string, body string"

    def reader(self, schema) -> DataSourceReader:
        kind = _FilteredReader if self.options.get("pushdown", "false") == "true" else _Reader
        return kind(self.options["path"], self.options.get("manifest"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("keep", 2)))


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, keep: int) -> None:
        self.path, self.keep, self.id = path, keep, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        folder, attempt = Folder(self.path), f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        files: list[Written] = []
        for batch in iterator:
            kinds = batch.column("kind")
            for kind in kinds.unique().to_pylist():
                bodies = batch.filter(pc.is_null(kinds) if kind is None else pc.equal(kinds, kind)).column("body").to_pylist()
                raw = "".join(f"{b or ''}\n" for b in bodies).encode()
                content = gzip.compress(raw, mtime=0)
                name = f"{self.id}/{attempt}-{len(files)}.json.gz"
                folder.put(f"data/{name}", content)
                files.append(Written(kind, name, len(bodies), len(raw), len(content)))
        return _Message(files)

    def commit(self, messages: list[_Message | None]) -> None:
        folder = Folder(self.path)
        folder.publish([f for m in messages if m is not None for f in m.files])
        folder.clear(self.keep)

    def abort(self, messages: list[_Message | None]) -> None:
        Folder(self.path).remove(self.id)


class _File(InputPartition):
    def __init__(self, kind: str, file: str) -> None:
        self.kind, self.file = kind, file


class _Reader(DataSourceReader):
    def __init__(self, path: str, manifest: str | None) -> None:
        self.path = path
        self.files = Folder(path).manifest(manifest)

    def partitions(self) -> list[InputPartition]:
        return [_File(f["kind"], f["file"]) for f in self.files]

    def read(self, partition: _File) -> Iterator[tuple[str, str]]:
        if partition is None:
            return
        for line in gzip.decompress(Folder(self.path).get(f"data/{partition.file}")).decode().split("\n")[:-1]:
            yield partition.kind, line


class _FilteredReader(_Reader):
    def pushFilters(self, filters):
        from pyspark.sql.datasource import EqualTo, In

        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("kind",):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.files = [x for x in self.files if x["kind"] in wanted]
            else:
                yield f
