"""Token ids of documents in compressed, checksummed segment files, and their reading."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .idcoder import read_segment, write_segment
from .storage import new_path
from .text import chunks
from .tokens import default_path, encoder

_SEGMENT = "part int, segment int, n_docs long, n_ids long, payload binary"


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_ids: int = 4 << 20,
    block: int = 2048,
) -> None:
    """Encodes all whole texts, each followed by ``end_id``, in ascending order of id (nulls first).

    Documents are range-partitioned and sorted by id; each task writes
    segments of about ``segment_ids`` ids (whole documents), in the
    format of :mod:`.idcoder`. As only Spark can write to every store, the
    segments are the ``payload`` rows of a Parquet table, numbered by part and
    segment. Null texts count as empty. Rows that repeat an id follow each
    other in order of their texts. An empty table makes an empty one.
    """
    vocabulary = tokenizer or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).column
        part, segment, size = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        found: list = []
        sizes: list = []

        def close() -> pa.RecordBatch:
            data = write_segment(names, np.concatenate(found), np.concatenate(sizes), block)
            row = [[part], [segment], [len(names)], [size], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(row, kinds)], names=["part", "segment", "n_docs", "n_ids", "payload"]
            )

        for batch in chunks(batches, "text", 1 << 20):
            ids, at = encode(batch.column("text"))
            names += batch.column("doc_id").to_pylist()
            found.append(np.insert(ids, at[1:], end_id))
            sizes.append(np.diff(at) + 1)
            size += len(found[-1])
            if size >= segment_ids:
                yield close()
                names, found, sizes, size, segment = [], [], [], 0, segment + 1
        if names:
            yield close()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, _SEGMENT).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of :func:`write_token_files`: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.

    ``start`` counts the ids of all documents before it. It comes from the
    segments' sizes: a running sum inside each part and one over the parts,
    a row for each.
    """
    segments = spark.read.schema(_SEGMENT).parquet(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, data in zip(*(batch.column(c).to_pylist() for c in ("part", "segment", "payload"))):
                names, ids, sizes = read_segment(data)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                found = [raw[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                n = len(names)
                columns = [
                    pa.array([part] * n, pa.int32()),
                    pa.array([segment] * n, pa.int32()),
                    pa.array(names, pa.int64()),
                    pa.array(ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(list(map(zlib.crc32, found)), pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(list(map(bytes, found)), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    fields = ["part", "segment", "doc_id", "before", "n_tokens", "ids_crc32"] + (["ids"] if with_ids else [])
    kinds = "part int, segment int, doc_id long, before long, n_tokens long, ids_crc32 long"
    documents = segments.select("part", "segment", "payload").mapInArrow(read, kinds + (", ids binary" if with_ids else ""))
    sizes = segments.select("part", "segment", "n_ids")
    order = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(over_parts), F.lit(0)).alias("base"))
    base = inside.join(parts, "part").select("part", "segment", (F.col("inside") + F.col("base")).alias("base"))
    columns = ["n_tokens", "ids_crc32"] + (["ids"] if with_ids else [])
    return documents.join(base, ["part", "segment"]).select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), *columns
    )


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes the documents' token files to the shared folder and reads them back."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
