"""Byte strings that occur more than once in a corpus, found by suffix arrays of shards.

Two strings of ``width`` bytes can only be equal if the smallest hash of the
short runs in them, their anchor, is. Windows that slide along a text keep an
anchor for some places, so all windows of a text fall into blocks, one for
each anchor. A block whose anchor occurs once holds nothing that is repeated,
one whose anchor always comes with the same bytes is repeated whole. What is
left, anchors with different blocks, is dealt to shards by anchor, each
different block once with its number. A shard's suffix array is made by
Larsson-Sadakane refinement: sorted by a few bytes, then only groups of equal
suffixes are sorted again, by the ranks of what follows, over twice the length
each time. Kasai's common prefixes of neighbours give classes of equal windows.
The blocks of an anchor that has too many for a shard are spread over shards
and merged by binary search: their windows are halved by their distance from
the anchor, all windows of a half share more bytes, which is a longer anchor
for it, and halves are counted across shards as blocks were. So the ends of
what is repeated are closed in on, until every anchor fits into a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, join_groups, materialize, shuffled
from .text import chunks, lanes, mix, release, text_buffer

_SEGMENT = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)
_SALTS = 8
#: More than is ever broadcast: anchors are joined the same way at every size.
_MANY = 1 << 62
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_BLOCKS = "key binary, start long, size int, anchor int, gram long, d1 long, d2 long"


def _two(raw: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _pair(slices: list[bytes | memoryview]) -> tuple[np.ndarray, np.ndarray]:
    found = np.array([_two(x) for x in slices], np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _least(values: np.ndarray, count: int) -> np.ndarray:
    """The minimum of each ``count`` consecutive values."""
    have = 1
    while 2 * have <= count:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = count - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def blocks(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """First window, number of windows, anchor's distance from the first and its hash, of each block of the texts ``data[at[i]:at[i + 1]]``."""
    gram = 8 * max(1, min(4, width // 16))
    ends = np.repeat(at[1:], np.diff(at))
    found = []
    for a in range(0, len(data) - width + 1, _SEGMENT):
        b = min(a + _SEGMENT, len(data) - width + 1)
        part = data[a : b + width - 1]
        eight, n = lanes(part), len(part) - gram + 1
        value = np.zeros(n, np.uint64)
        for k in range(0, gram, 8):
            value += mix(eight[k : k + n]) * _ODD[k // 8]
        value = mix(value)
        first = _least(value & ~_PLACE | np.arange(n, dtype=np.uint64), width - gram + 1) & _PLACE
        whole = np.flatnonzero(np.arange(a, b) + width <= ends[a:b])
        if len(whole):
            anchor = first[whole].astype(np.int64)
            new = np.flatnonzero(np.r_[True, (np.diff(whole) != 1) | (np.diff(anchor) != 0)])
            found.append((whole[new] + a, np.diff(np.r_[new, len(whole)]), anchor[new] - whole[new], value[anchor[new]].view(np.int64)))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 4


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order; a suffix at i stops before ``ends[i]``, equal ones are in order of places."""
    n = len(data)
    left = (ends - np.arange(n)).astype(np.int32)
    bits = (8 * np.minimum(left, 7)).astype(np.uint64)
    key = lanes(data)[:n].byteswap()
    key = (key >> (np.uint64(64) - bits)) << (np.uint64(64) - bits) | np.minimum(left, 7).astype(np.uint64)
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    group = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(n, dtype=np.int32), 0))
    del key, bits
    rank = np.empty(n, np.int32)
    rank[order] = group
    had, have = 6, 7
    while True:
        alone = np.r_[group[1:] != group[:-1], True] & np.r_[True, group[1:] != group[:-1]]
        slots = np.flatnonzero(~alone & (left[order] > had))
        if not len(slots):
            break
        p = order[slots]
        after = np.where(left[p] > have, rank[np.minimum(p + have, n - 1)] + 1, 0)
        both = rank[p].astype(np.int64) << 32 | after
        again = np.argsort(both)
        p, both = p[again], both[again]
        order[slots] = p
        group[slots] = np.maximum.accumulate(np.where(np.r_[True, both[1:] != both[:-1]], slots, 0))
        rank[p] = group[slots]
        had, have = have, 2 * have
    slots = np.flatnonzero(~alone)
    order[slots] = order[slots][np.lexsort((order[slots], group[slots]))]
    return order


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each suffix, by its place, how many bytes it shares with the one before it in order.

    By Kasai, a suffix shares at least one byte less than the one a byte
    before it; it is exactly one less where both neighbours are preceded by
    the same byte, so bytes are compared for the other places alone.
    """
    n, at = len(data), np.arange(len(data))
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    starts = np.r_[True, ends[1:] != ends[:-1]]
    there = np.maximum(before, 0)
    same = ~starts & (before > 0) & ~starts[there] & (data[at - 1] == data[there - 1])
    todo = np.flatnonzero(~same)
    other, eight = before[todo], lanes(data)
    limit = np.where(other < 0, 0, np.minimum(ends[todo] - todo, ends[np.maximum(other, 0)] - other))
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(limit > 0)
    got = 0
    while len(live):
        differ = eight[todo[live] + got] ^ eight[other[live] + got]
        lowest = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        shared[todo[live]] = np.minimum(got + equal, limit[live])
        got += 8
        live = live[(equal == 8) & (limit[live] > got)]
    last = np.maximum.accumulate(np.where(same, 0, at))
    return shared[last] - (at - last)


def window_classes(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows of ``width`` bytes, and a number that is the same for equal ones."""
    order = suffix_array(data, ends)
    shared = common_prefixes(data, ends, order)
    number = np.cumsum(shared[order] < width)
    full = ends[order] - order >= width
    return order[full], number[full]


def _blocks_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", 1 << 21):
        data, at = text_buffer(batch.column("text"))
        start, size, anchor, gram = blocks(data, at, width)
        raw = memoryview(np.ascontiguousarray(data))
        row = np.searchsorted(at, start, "right") - 1
        for a in range(0, len(start), 200_000):
            some = slice(a, a + 200_000)
            d1, d2 = _pair([raw[i : i + k + width - 1] for i, k in zip(start[some].tolist(), size[some].tolist())])
            inside = pa.array(start[some] - at[row[some]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(row[some])), inside, *(pa.array(x[some].astype(np.int32)) for x in (size, anchor)), pa.array(gram[some]), pa.array(d1), pa.array(d2)],
                ["key", "start", "size", "anchor", "gram", "d1", "d2"],
            )


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted blocks."""
    for batch in batches:
        texts, wanted = batch.column("text"), batch.column("wanted")
        for i in range(batch.num_rows):
            raw, asked = memoryview(texts[i].as_buffer() or b""), pa.RecordBatch.from_struct_array(wanted[i].values)
            for a in range(0, asked.num_rows, 1000):
                some = asked.slice(a, 1000)
                at = zip(some.column("start").to_pylist(), some.column("size").to_pylist())
                cut = pa.array([bytes(raw[k : k + size + width - 1]) for k, size in at], pa.binary())
                yield some.select(["gram", "d1", "d2", "n", "size", "anchor"]).append_column("raw", cut)
    release()


_CUT = "gram long, d1 long, d2 long, n long, size int, anchor int, raw binary"
#: A part of a block: the block's digest and number, the part's first window in it, and anchor, digest and bytes of the part.
_PART = "of struct<gram:bigint,d1:bigint,d2:bigint>, n long, lo int, size int, anchor int, gram long, d1 long, d2 long, raw binary"
_RUNS = "of struct<gram:bigint,d1:bigint,d2:bigint>, lo int, hi int"


def _halves(batches: Iterator[pa.RecordBatch], width: int, shift: int) -> Iterator[pa.RecordBatch]:
    """Parts cut where the windows' distances from the anchor differ in more than their last ``shift`` bits.

    The new anchor is what all windows of such distances share, whether the
    part has them or not, so that equal windows come to one anchor.
    """
    for batch in chunks(batches, "raw", 1 << 21):
        row, first, size, raws, grams = [], [], [], [], []
        columns = (batch.column(c).to_pylist() for c in ("size", "anchor", "gram", "raw"))
        for i, (n, anchor, gram, raw) in enumerate(zip(*columns)):
            a = 0
            while a < n:
                near = (anchor - a) >> shift << shift  # the windows' distances fall from anchor to anchor - n + 1
                b = min(n, anchor - near + 1)
                shared = raw[anchor - near : max(anchor - near, anchor - near - (1 << shift) + 1 + width)]
                row.append(i)
                first.append(a)
                size.append(b - a)
                raws.append(raw[a : b + width - 1])
                grams.append(_two(gram.to_bytes(8, "little", signed=True) + bytes([shift]) + near.to_bytes(2, "little") + shared)[0])
                a = b
        row_, first_ = np.array(row), np.array(first, np.int32)
        d1, d2 = _pair(raws)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("of").take(pa.array(row_)), batch.column("n").take(pa.array(row_)),
                pa.array(batch.column("lo").to_numpy()[row_] + first_), pa.array(size, pa.int32()),
                pa.array(batch.column("anchor").to_numpy()[row_] - first_), pa.array(grams, pa.int64()), pa.array(d1), pa.array(d2), pa.array(raws, pa.binary()),
            ],
            ["of", "n", "lo", "size", "anchor", "gram", "d1", "d2", "raw"],
        )
    release()


def _shard(rows: pa.Table, width: int) -> pa.RecordBatch:
    """Runs of windows that are repeated in a shard, by its parts' blocks."""
    data, at = text_buffer(rows["raw"].cast(pa.large_binary()).combine_chunks().view(pa.large_string()))
    part = np.repeat(np.arange(rows.num_rows), np.diff(at))
    place, number = window_classes(data, at[1:][part], width)
    total = np.bincount(number, weights=rows["n"].to_numpy()[part[place]].astype(np.float64))
    repeated = np.sort(place[total[number] > 1])
    new = np.flatnonzero(np.r_[True, (np.diff(repeated) != 1) | (np.diff(part[repeated]) != 0)]) if len(repeated) else np.empty(0, np.int64)
    lo, hi = repeated[new], repeated[np.r_[new[1:] - 1, len(repeated) - 1]] if len(new) else new
    of = part[lo]
    ends = [pa.array((x - at[of] + rows["lo"].to_numpy()[of]).astype(np.int32)) for x in (lo, hi)]
    return pa.RecordBatch.from_arrays([rows["of"].combine_chunks().take(pa.array(of)), *ends], ["of", "lo", "hi"])


def _solve(batches: Iterator[pa.RecordBatch], width: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """The shards of a task, which hold all parts of their anchors."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in chunks(batches, "raw", shard_bytes):
        gram = batch.column("gram").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(gram)) + 1).tolist(), len(gram)]
        for a, b in zip(cuts, cuts[1:]):
            if held and size >= shard_bytes and gram[a] != last:
                yield _shard(pa.Table.from_batches(held), width)
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += held[-1].column("raw").nbytes
            last = gram[a]
    if held:
        yield _shard(pa.Table.from_batches(held), width)
    release()


def _text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _block_hits(rows: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    """Byte ranges ``key, lo, hi`` of texts, one or more for each block with repeated windows."""
    all_blocks = materialize(rows.mapInArrow(lambda it: _blocks_of(it, width), _BLOCKS), "blocks")
    grams = all_blocks.groupBy("gram").agg(F.count(F.lit(1)).alias("found"), _differ().alias("mixed"))
    grams = materialize(grams.where("found > 1").select("gram", "mixed"), "grams")
    suspects = join_groups(all_blocks, grams, "gram", _SALTS, _MANY).where("mixed IS NOT NULL")
    suspects = materialize(suspects.withColumn("of", F.struct("gram", "d1", "d2")).drop("gram", "d1", "d2"), "suspects")
    discard(all_blocks, grams)
    end = F.col("start") + F.col("size") + F.lit(width - 1)
    whole = suspects.where("NOT mixed").select("key", F.col("start").alias("lo"), end.alias("hi"))
    mixed = suspects.where("mixed").drop("mixed")

    one = mixed.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start", "size", "anchor")).alias("at"))
    wanted = one.select("at.key", F.struct("of.gram", "of.d1", "of.d2", "at.start", "at.size", "at.anchor", "n").alias("w"))
    wanted = materialize(wanted.groupBy("key").agg(F.collect_list("w").alias("wanted")), "wanted")
    keys = materialize(wanted.select("key", F.lit(True).alias("is_wanted")), "keys")
    texts = join_groups(rows, keys, "key", _SALTS).where("is_wanted").groupBy("key").agg(F.first("text").alias("text"))
    asked = texts.join(shuffled(wanted), "key").select("text", "wanted")
    cut = materialize(asked.mapInArrow(lambda it: _cut(it, width), _CUT), "cut")
    discard(wanted, keys)

    runs = materialize(_runs(cut, width, shard_bytes), "runs").groupBy("of").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    runs = materialize(runs, "runs_of")
    weight = int(runs.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0])
    found = join_groups(mixed, runs, "of", _SALTS, weight).where("runs IS NOT NULL")
    parts = found.select("key", "start", F.inline("runs"))
    parts = parts.select("key", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + width).alias("hi"))
    return materialize(whole.unionByName(parts).distinct(), "hits")


def _differ() -> Column:
    return (F.min("d1") != F.max("d1")) | (F.min("d2") != F.max("d2"))


def _runs(cut: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    """Runs of repeated windows of blocks, as first and last window."""
    spark, most = cut.sparkSession, max(2, shard_bytes // width)
    parts = cut.select(F.struct("gram", "d1", "d2").alias("of"), "n", F.lit(0).alias("lo"), "size", "anchor", "gram", "d1", "d2", "raw")
    settled, fitting, shift = [], [], 7
    while (1 << shift) < width:
        shift += 1
    many = materialize(parts.groupBy("gram").count().where(F.col("count") > most).select("gram", F.lit(True).alias("many")), "many")
    while not many.isEmpty():
        shift -= 1
        marked = join_groups(parts, many, "gram", _SALTS)
        fitting.append(marked.where("many IS NULL").drop("many"))
        cut_ = lambda it, shift=shift: _halves(it, width, shift)
        halves = materialize(marked.where("many").drop("many").mapInArrow(cut_, _PART), "halves")
        counts = halves.groupBy("gram").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("found"), _differ().alias("mixed"))
        counts = materialize(counts.where("found > 1"), "counts")
        known = join_groups(halves, counts, "gram", _SALTS).where("mixed IS NOT NULL")
        settled.append(known.where("NOT mixed").select("of", "lo", (F.col("lo") + F.col("size") - 1).alias("hi")))
        parts = known.where("mixed").drop("mixed", "parts", "found")
        many = materialize(counts.where(F.col("mixed") & (F.col("parts") > most)).select("gram", F.lit(True).alias("many")), "many")
    fitting = reduce(DataFrame.unionByName, [*fitting, parts])
    size = fitting.agg(F.coalesce(F.sum(F.length("raw")), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size) // (32 * shard_bytes))
    shards = fitting.repartition(tasks, "gram").sortWithinPartitions("gram")
    return reduce(DataFrame.unionByName, [*settled, shards.mapInArrow(lambda it: _solve(it, width, shard_bytes), _RUNS)])


def _joined(hits: DataFrame) -> DataFrame:
    """Ranges of a text that touch or overlap as one."""
    order = Window.partitionBy("key").orderBy("lo")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col("lo") > before)).cast("int")
    spans = hits.withColumn("new", new).withColumn("span", F.sum("new").over(order))
    return spans.groupBy("key", "span").agg(F.min("lo").alias("start"), F.max("hi").alias("end"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        kept = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            raw, at, left = memoryview(text.as_buffer() or b""), 0, []
            for s in spans or []:
                left.append(raw[at : s["start"]])
                at = s["end"]
            kept.append(b"".join([*left, raw[at:]]))
        columns = [batch.column(c) for c in batch.schema.names if c != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())], [*names, "kept"])


def repeated_strings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, shard_bytes: int = 1 << 20
) -> DataFrame:
    """What stays of each text when all bytes in strings of ``width`` bytes that start anywhere else too are removed.

    Returns, one row for each row of ``docs``, ``id_col, n_bytes, spans,
    kept``: the removed byte ranges, ``array<struct<start, end>>`` in order,
    apart from each other, and the bytes that stay (removed ranges may cut a
    character). Strings do not cross texts, may overlap, and are those of the
    input: all occurrences go, the first one included.

    Null texts are empty, texts below ``width`` bytes keep all. Rows with the
    same text, whatever their ids, repeat each other. Ids may be null or
    repeated; further columns are ignored; an empty table gives an empty
    result. ``width`` is at least 16. Blocks and texts are known by 128-bit
    digests (BLAKE2b, SHA-256), within a shard bytes are compared.
    ``shard_bytes`` bounds what a suffix array is made of, to about three
    times that, and has no effect on the result.
    """
    if width < 16:
        raise ValueError("width must be at least 16")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumn("key", _text_key(F.col("text")))
    spans = materialize(_joined(_block_hits(rows.select("key", "text"), width, shard_bytes)), "spans")
    by_text = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    by_text = materialize(by_text, "by_text")
    joined = join_groups(rows, by_text, "key", _SALTS, spans.count())
    joined = joined.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "spans", "text")
    kind = "array<struct<start:bigint,end:bigint>>"
    found = joined.mapInArrow(_kept, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, spans {kind}, kept binary")
    return found.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("spans", F.expr(f"cast(array() AS {kind})")).alias("spans"), "kept")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Of every document how many bytes and runs of 200-byte repeats go, and the digest of what stays."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeated_strings(docs).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
