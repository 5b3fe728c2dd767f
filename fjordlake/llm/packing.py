"""Best-fit packing of tokenised documents into sequences, improved by local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count as count_from

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .text import chunks
from .tokens import default_path, encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = ["sequence_id", "offset", "filled"]


def token_pieces(
    docs: DataFrame,
    capacity: int,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, its ``ids``.

    A document is its token ids and then ``end_id``; one longer than
    ``capacity`` is cut so that all pieces but the first are full.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).column
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for part in chunks(batches, "text", 1 << 20):
            ids, at = encode(part.column("text"))
            ids = np.insert(ids, at[1:], end_id).astype("<u4")
            at = at + np.arange(len(at))
            n = np.diff(at)
            many = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            first = n - (many - 1) * capacity  # all others are full
            start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[row])
            begin = (at[:-1][row] + start) * 4
            raw = memoryview(ids.tobytes())
            slices = [raw[i:j] for i, j in zip(begin.tolist(), (begin + length * 4).tolist())]
            columns = [
                part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                pa.array(list(map(zlib.crc32, slices)), pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array(list(map(bytes, slices)), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(cut, _PIECES + (", ids binary" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each to the fullest bin that still holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Exchanges items between underfull bins while the sum of squared fills grows.

    Bins give in turn, emptiest first, and all other underfull bins, fullest
    first, take what closes most of their gap: a move (an item for none), one
    item for one of theirs, or one item for two of theirs. Each step raises
    the sum, so the search ends; bins that run empty are dropped. The
    emptiest bins give first, as many as there are bins too many; all
    underfull ones give where those cannot. It ends where no step raises the
    sum or no fewer bins could hold the items.
    """
    size = lengths.tolist()
    least = -(-sum(size) // capacity)
    fills = [sum(size[i] for i in b) for b in bins]
    bins = [list(b) for b in bins]
    every = False
    while True:
        underfull = sorted((k for k in range(len(bins)) if fills[k] < capacity), key=lambda k: (fills[k], k))
        spare = len(bins) - least
        if spare <= 0 or len(underfull) < 2:
            return bins
        givers = underfull if every else underfull[: 2 * spare + 2]
        changed = False
        for a in underfull[::-1]:
            while fills[a] < capacity and bins[a]:
                step = _best_step(bins, fills, size, givers, a, capacity)
                if step is None:
                    break
                k, item, back, d = step
                bins[a] = [i for i in bins[a] if i not in back] + [item]
                bins[k] = [i for i in bins[k] if i != item] + list(back)
                fills[a] += d
                fills[k] -= d
                changed = True
        if changed:
            full = [(f, b) for f, b in zip(fills, bins) if b]
            fills, bins = [f for f, _ in full], [b for _, b in full]
            every = False
        elif every or len(givers) == len(underfull):
            return bins
        else:
            every = True


def _best_step(bins, fills, size, givers, a: int, capacity: int):
    """The step that raises the fill of bin ``a`` most: giver, its item, what it gets back, by how much.

    Of items of one size one stands for all, in ``a`` as in the givers, so a
    bin has few sets of one or two items however many it holds. A giver is
    not fuller than ``a``, so that every gain raises the sum of squares.
    """
    give: dict[int, tuple[int, int]] = {}
    for k in givers:
        if k != a and fills[k] <= fills[a]:
            for i in bins[k]:
                give.setdefault(size[i], (k, i))
    if not give:
        return None
    alike: dict[int, list[int]] = {}
    for i in bins[a]:
        alike.setdefault(size[i], []).append(i)
    one = [v[0] for v in alike.values()]
    sets: list[tuple[int, ...]] = [(), *((i,) for i in one)]
    sets += [(one[x], one[y]) for x in range(len(one)) for y in range(x)]
    sets += [(v[0], v[1]) for v in alike.values() if len(v) > 1]
    back = np.array([sum(size[i] for i in s) for s in sets])
    sizes = np.array(sorted(give))
    at = np.searchsorted(sizes, back + (capacity - fills[a]), "right") - 1
    gain = np.where(at >= 0, sizes[at] - back, 0)
    s = int(gain.argmax())
    if gain[s] <= 0:
        return None
    return (*give[int(sizes[at[s]])], sets[s], int(gain[s]))


def _packer(capacity: int, base: int):
    return lambda frame: _pack_group(frame, capacity, base)


def _dealer(groups: int):
    """Deals rows in order of length, so that every group gets the same mixture of lengths."""

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = TaskContext.get().partitionId() * 7919
        for frame in frames:
            rank = np.empty(len(frame), np.int64)
            rank[np.argsort(frame["length"].to_numpy(), kind="stable")] = np.arange(len(frame))
            yield frame.assign(group=(rank + turn) % groups)
            turn += len(frame)

    return deal


def _pack_group(frame: pd.DataFrame, capacity: int, base: int) -> pd.DataFrame:
    lengths = frame["length"].to_numpy()
    group = int(frame["group"].iloc[0])
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    if "sequence_id" in frame and frame["sequence_id"].notna().all():
        before = [list(v) for v in frame.reset_index(drop=True).groupby("sequence_id").indices.values()]
        if len(before) <= len(bins):  # the bins they came from, searched on
            bins = local_search(before, lengths, capacity)
    sequence, offset, filled = (np.zeros(len(lengths), np.int64) for _ in range(3))
    for n, b in enumerate(bins):
        ends = np.cumsum(lengths[b])
        sequence[b] = base | group << 24 | n
        offset[b] = ends - lengths[b]
        filled[b] = ends[-1]
    return frame.drop(columns="group").assign(sequence_id=sequence, offset=offset, filled=filled)


def pack_pieces(
    pieces: DataFrame, capacity: int, group_rows: int = 8192, rounds: int | None = 7, fewer: float = 0.7
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length`` of at most ``capacity``.

    Pieces are dealt evenly into groups of about ``group_rows`` with equal
    mixtures of lengths, whatever their ids, and each group is packed by best fit and local search. All
    pieces of sequences filled to less than 15/16, a small share of each
    group, are dealt into new groups and packed again, round after round, until one
    group holds all of them, after ``rounds`` rounds, or when more than ``fewer`` of a round's pieces are
    left; ``rounds=None, fewer=1.0`` goes on as long as a round settles any. A group keeps its old
    sequences where packing anew does not need fewer.
    """
    left = materialize(pieces, "pieces")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields)
    out, before, enough = None, 0, capacity * 15 // 16
    for turn in range(rounds) if rounds else count_from(0):
        count = left.count()
        if turn and (count >= before or count > fewer * before):  # what is left does not get better
            break
        before = count
        groups = max(1, -(-count // group_rows))
        if turn == 0:
            dealt = left.mapInPandas(_dealer(groups), f"{fields}, group long")
        else:  # a sequence stays together
            dealt = left.withColumn("group", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(groups)))
        packed = dealt.groupBy("group").applyInPandas(
            _packer(capacity, turn << 56),
            fields + ", sequence_id long, offset long, filled long",
        )
        packed = materialize(packed, "packed")
        if groups == 1:
            settled, left = packed, None
        else:
            settled, left = packed.where(F.col("filled") >= enough), packed.where(F.col("filled") < enough)
        out = settled if out is None else out.unionByName(settled)
        if left is None:
            break
        left = left.drop("offset", "filled")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields if f.name not in _PLACED)
    if left is not None:  # as last packed
        out = out.unionByName(packed.where(F.col("filled") < enough))
    return out.drop("filled")


def pack_documents(
    docs: DataFrame,
    capacity: int = 1024,
    tokenizer: str | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    rounds: int | None = 7,
    fewer: float = 0.7,
) -> DataFrame:
    """Packs the token ids of all documents into sequences of at most ``capacity`` tokens.

    Returns per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset`` and, with ``with_ids``, the piece's ``ids`` as
    little-endian unsigned 32-bit integers. ``rounds`` and ``fewer`` say how long underfull
    sequences are packed again, see :func:`pack_pieces`. Null and empty texts are the end
    id alone. Rows that repeat an id are packed each for itself. Extra
    columns are ignored; an empty table gives no pieces.
    """
    pieces = token_pieces(docs, capacity, tokenizer or default_path(), end_id, id_col, text_col, with_ids)
    packed = pack_pieces(pieces, capacity, rounds=rounds, fewer=fewer)
    columns = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return packed.select(F.col("doc_id").alias(id_col), *columns)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: its ``ids`` in order and how many, from pieces packed ``with_ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
    )
