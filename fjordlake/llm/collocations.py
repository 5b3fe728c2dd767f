"""Phrases whose words stand together more often than their parts would by chance, for each language.

Texts are cut into pieces at punctuation; equal pieces are one row with its
number. Runs of words are counted level by level, each time in duckdb: a task
combines the runs of its pieces, the rest is shuffled by run, and each bucket
is summed, out of core where it must be. A run can only be frequent if the
shorter runs in it are, so each level marks its frequent runs in a bitmap of
fixed size, and the next level counts what the bitmap lets through. Runs that
meet in a bit are counted for nothing and change no result.

For its score a phrase asks for the numbers of its parts: a request for each
part of each cut is shuffled to the bucket of that part, and answers come back
to the phrase.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator
from functools import reduce

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import broadcast_if_small, discard, materialize
from .text import chunks, hash_slices, mix, release, text_buffer

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COUNTED = "lang string, phrase string, n long"
_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
_SALTS = 8
#: Runs made strings at once; their places take some 16 bytes for each byte of them.
_RUNS = 100_000


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Distinct pieces of a language with single spaces between words, and how often each occurs."""
    text = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), _UPPER, _LOWER)
    rows = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
        F.explode(F.split(text, "[.,;:!?\n\x0b\f\r]+")).alias("piece"),
    )
    rows = rows.select("lang", F.trim(F.regexp_replace("piece", "[ \t]+", " ")).alias("piece")).where("piece <> ''")
    return rows.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("n"))


def _sums(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Summed numbers of equal runs, those of at least ``least``, by duckdb with a bound on memory."""
    folder = tempfile.mkdtemp(prefix="runs-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
    con = duckdb.connect(config={"threads": 1, "memory_limit": "192MB", "temp_directory": folder})
    try:
        con.register("runs", pa.RecordBatchReader.from_batches(_SCHEMA, batches))
        sums = f"SELECT lang, phrase, sum(n)::BIGINT AS n FROM runs GROUP BY lang, phrase HAVING sum(n) >= {least}"
        for batch in con.sql(sums).to_arrow_reader(50_000):
            yield batch.cast(_SCHEMA)
    finally:
        con.close()
        shutil.rmtree(folder, ignore_errors=True)  # the scratch of this task alone
        release()


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, first and end byte of each word, and its row, of pieces with single spaces."""
    data, at = text_buffer(column)
    space = np.flatnonzero(data == 0x20)
    starts = np.union1d(at[:-1], space + 1)
    row = np.searchsorted(at, starts, "right") - 1
    ends = np.append(starts[1:] - 1, len(data))
    last = np.append(row[1:] != row[:-1], True)
    ends[last] = at[row[last] + 1]
    return data, starts, ends, row


def _run_hashes(langs: pa.Array, words: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """A number for the run of ``size`` words from each word on, of one row's language; for the bitmap alone."""
    coded = pc.dictionary_encode(langs)
    own = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    value = np.array(own, np.uint64)[coded.indices.to_numpy()][row[: len(words) - size + 1]]
    for j in range(size):
        value = mix(value ^ words[j : j + len(value)])
    return value


def _taken(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of ``data`` as strings."""
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    where = np.repeat(starts - at[:-1], ends - starts) + np.arange(at[-1])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[where])))


def _runs(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], marks=None, marked: int = 0) -> Iterator[pa.RecordBatch]:
    """The runs of ``sizes`` words whose runs of ``marked`` words are all in the bitmap, with their pieces' numbers."""
    for batch in chunks(batches, "piece", 1 << 20):
        langs, n = batch.column("lang"), batch.column("n").to_numpy()
        data, starts, ends, row = _words(batch.column("piece"))
        if marked and len(starts) >= marked:
            found = _bit(_run_hashes(langs, hash_slices(data, starts, ends), row, marked), marks.value)
            found &= row[: len(found)] == row[marked - 1 :]
        for size in sizes:
            if len(starts) < size:
                continue
            first = row[: len(row) - size + 1] == row[size - 1 :]
            for j in range(size - marked + 1 if marked else 0):
                first &= found[j : j + len(first)]
            first = np.flatnonzero(first)
            for some in np.array_split(first, len(first) // _RUNS + 1):
                if len(some):
                    run = _taken(data, starts[some], ends[some + size - 1])
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(row[some])), run, pa.array(n[row[some]])], schema=_SCHEMA)


def _bit(hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(65 - (64 * len(marks)).bit_length())
    return (marks[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _counted(table: DataFrame, least: int, sizes: tuple[int, ...], marks=None, marked: int = 0) -> DataFrame:
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sums(_runs(batches, sizes, marks, marked), 1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sums((b.cast(_SCHEMA) for b in batches if b.num_rows), least)

    combined = table.mapInArrow(combine, _COUNTED).repartition("lang", "phrase")
    return materialize(combined.mapInArrow(merge, _COUNTED), f"runs{max(sizes)}")


def _marks(spark: SparkSession, runs: DataFrame, size: int, bits: int):
    """The bitmap of runs of ``size`` words, broadcast."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "phrase"):
            data, starts, ends, row = _words(batch.column("phrase"))
            at = _run_hashes(batch.column("lang"), hash_slices(data, starts, ends), row, size)[::size] >> np.uint64(64 - bits)
            word, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bit.view(np.int64))], ["word", "bits"])

    words = runs.mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = words.toArrow()  # at most 2 ** (bits - 6) rows
    marks = np.zeros(1 << (bits - 6), np.uint64)
    marks[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(marks)


def cut_score(a: str = "a", l: str = "l", r: str = "r", n: str = "n") -> Column:  # noqa: E741
    """``floor(1000 * a * n / (l * r))``, exact while the products have at most 38 digits."""
    return F.expr(f"cast((cast(1000 as decimal(38,0)) * {a} * {n}) div (cast({l} as decimal(38,0)) * {r}) as long)")


def _scored(candidates: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with the numbers of their weakest cut."""
    words = F.split("phrase", " ")
    cuts = candidates.select(
        "lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("cut")
    )
    asked = F.array(
        F.struct(F.lit(True).alias("first"), F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("part")),
        F.struct(F.lit(False).alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ").alias("part")),
    )
    salt = F.pmod(F.hash("phrase"), F.lit(_SALTS)).alias("salt")  # many phrases may ask for one part
    requests = cuts.select("lang", "phrase", "a", "cut", salt, F.inline(asked))
    numbers = parts.select("lang", F.col("phrase").alias("part"), "n").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    )
    answers = requests.join(numbers.hint("shuffle_hash"), ["lang", "part", "salt"])
    both = answers.groupBy("lang", "phrase", "a", "cut").agg(
        F.max(F.when(F.col("first"), F.col("n"))).alias("l"), F.max(F.when(~F.col("first"), F.col("n"))).alias("r")
    )
    scored = both.join(broadcast_if_small(totals), "lang").withColumn("score", cut_score())
    weakest = F.min(F.struct("score", "cut", "l", "r", "n")).alias("weakest")
    return scored.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "weakest.*")


def _inner(candidates: DataFrame) -> DataFrame:
    """Phrases that lie in longer candidates, with the highest number of those."""
    words = F.split("phrase", " ")
    inside = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size(words) - 1),
            lambda k: F.transform(
                F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")
            ),
        )
    )
    longer = candidates.where(F.size(words) > 2).select("lang", F.explode(inside).alias("phrase"), "a")
    return longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
    least: int = 100, most_words: int = 5, share: int = 100, top: int = 2000, bits: int = 26,
) -> DataFrame:
    """The ``top`` phrases of 2 to ``most_words`` words of each language by the score of their weakest cut.

    ``bits`` is the size of the bitmap of frequent runs (8 MB on the driver
    and in a worker, whatever the input) and has no effect on the result.

    Candidates occur at least ``least`` times within pieces. One is dropped
    if its words lie inside a longer candidate that has at least ``share``
    per cent of its occurrences. Returns ``lang, rank, phrase, a, l, r, n,
    score, cut``: occurrences of the phrase and of the two parts of its cut
    after ``cut`` words, all words of the language, and ``floor(1000 * a * n
    / (l * r))``. Ties between cuts go to the first; ranks are by score, then
    ``a``, then the phrase's bytes.

    A-Z counts as a-z. Null texts are empty; rows with a null language count
    as ``und``. Repeated rows count each. Tables without candidates give an
    empty result; further columns are ignored. Counts are exact, and so are
    scores below 10^17 words of a language.
    """
    spark = docs.sparkSession
    table = materialize(pieces(docs, text_col, lang_col), "pieces")
    totals = materialize(table.groupBy("lang").agg(F.sum(F.col("n") * F.size(F.split("piece", " "))).alias("n")), "totals")
    runs = [_counted(table, least, (1,))]
    for size in range(2, min(most_words, 3) + 1):
        runs.append(_counted(table, least, (size,), _marks(spark, runs[-1], size - 1, bits), size - 1))
    if most_words > 3:
        runs.append(_counted(table, least, tuple(range(4, most_words + 1)), _marks(spark, runs[-1], 3, bits), 3))
    discard(table)
    found = reduce(DataFrame.unionByName, runs[1:]).withColumnRenamed("n", "a")
    scored = _scored(found, reduce(DataFrame.unionByName, runs), totals)
    left = scored.join(_inner(found), ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(share).cast("decimal(20,0)") * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
