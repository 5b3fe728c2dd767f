"""A range coder with three models for token ids, many blocks at a time.

Format of a segment, all integers little-endian:

    magic "FJI3", then u32: ids there may be, ids in a block, documents, blocks
    i64 per document: its id; u8 per document: 1 if the id is null; u32 per document: its ids
    u32 per block: ids in it, bytes of its code, CRC-32 of its ids
    the blocks' codes, one after the other

The ids of all documents of a segment follow each other and are cut into
blocks. Each block is coded on its own: all three models are empty where it
starts, so any block can be read without the others. Order 2 names the id
that last followed the two ids before it and order 1 the one that last
followed the id before it; the interval begins with the shares of the two, and
an id that one of them names is coded by that share alone. The share of either
adapts to how often its predictions of the same confidence came true. Order 0
has the rest and spreads it over classes of neighbouring ids in proportion to how often they have
occurred in the block, evenly inside a class; its shares are taken anew every
32 ids. As ids of common tokens are small, classes are single ids at first and
get wider as the ids get larger.

Blocks are coded side by side as the columns of numpy arrays: a step codes one
id of every block.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

MAGIC = b"FJI3"
_TOTAL = 30  # an id's interval is a share of 2**30
_SLOT_BITS = 9
_LEVELS = 8  # confidences of a prediction: 0 for none, then 1 to 4
_RENEW = 32  # steps after which order 0 takes its shares anew
_FIRST, _MORE = 16, 8  # count of a class at first, and for each id in it
_SCALE = 16  # order 0 shares of classes add up to 2**16
_MOST = 60000  # chance, of 2**16, that a prediction can have at most
# by confidence, and 8 more if the prediction was right: what the confidence gains, and where its chance goes
_GAIN = np.array([0, 0, -1, -1, -1, 0, 0, 0, 0, 1, 1, 1, 0, 0, 0, 0], np.int64).astype(np.uint32)
_GOAL = np.array([0, 64, 64, 64, 64, 0, 0, 0, 0, _MOST, _MOST, _MOST, _MOST, 0, 0, 0], np.int64)
_MASK48 = np.uint64((1 << 48) - 1)
_LOW32 = np.uint64((1 << 32) - 1)


@lru_cache(maxsize=4)
def classes(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each id below ``size``, each class's first id, and the power of two that is its width."""
    first, power, at = [], [], 0
    while at < size:
        k = min(12, max(0, at.bit_length() - 4))
        first.append(at)
        power.append(k)
        at += 1 << k
    of = np.repeat(np.arange(len(first)), 1 << np.array(power))[:size]
    return of.astype(np.int64), np.array(first, np.int64), np.array(power, np.int64)


class Models:
    """Predictions of all three orders for many blocks at once."""

    def __init__(self, blocks: int, size: int):
        self.of, self.first, self.power = classes(max(size, 1))
        self.width = len(self.first) + 1
        self.base = np.arange(blocks, dtype=np.uint32) << np.uint32(_SLOT_BITS)
        self.level_base = np.arange(blocks, dtype=np.int64) * (2 * _LEVELS)
        # an entry is (id + 1) << 3 | confidence; 0 is empty
        self.one = np.zeros(blocks << _SLOT_BITS, np.uint32)
        self.two = np.zeros(blocks << _SLOT_BITS, np.uint32)
        # chance in 2**16 that a prediction of each order and confidence comes true
        start = [0, 3000, 9000, 20000, 36000, 0, 0, 0, 0, 12000, 26000, 40000, 52000, 0, 0, 0]
        self.chance = np.tile(np.array(start, np.int64), blocks)
        self.last = np.zeros(blocks, np.uint32)
        self.hash2 = np.zeros(blocks, np.uint32)
        self.count = np.full((blocks, self.width - 1), _FIRST, np.uint32)
        self.counts = self.count.ravel()
        self.count_base = np.arange(blocks, dtype=np.int64) * (self.width - 1)
        # a power of two columns for each block; those after its last share are never below a goal
        self.stride = 1 << (self.width - 1).bit_length()
        self.below = np.full((blocks, self.stride), 1 << _SCALE, np.int64)
        self.below[:, 0] = 0
        self.below_base = np.arange(blocks, dtype=np.int64) * self.stride
        self.active = blocks
        self.steps = 0

    def narrow(self, blocks: int) -> None:
        """Only the first so many blocks go on."""
        if blocks < self.active:
            self.active = blocks
            for name in ("base", "level_base", "last", "hash2", "count_base", "below_base", "count", "below"):
                setattr(self, name, getattr(self, name)[:blocks])

    def predict(self) -> None:
        """Ids + 1 that orders 1 and 2 name (0: none), their shares, and the ``rest`` that is order 0's."""
        if self.steps % _RENEW == 0:
            total = _FIRST * (self.width - 1) + _MORE * self.steps
            sums = np.cumsum(self.count, axis=1, dtype=np.uint32).astype(np.int64)
            sums *= (1 << (_SCALE + 20)) // total
            sums >>= 20
            sums[:, -1] = 1 << _SCALE
            self.below[:, 1 : self.width] = sums
            self.flat = self.below.ravel()
        self.at1 = (self.base + (self.last * np.uint32(0x9E3779B1) >> np.uint32(32 - _SLOT_BITS))).astype(np.int64)
        self.at2 = (self.base + (self.hash2 >> np.uint32(32 - _SLOT_BITS))).astype(np.int64)
        self.e1, self.e2 = self.one.take(self.at1), self.two.take(self.at2)
        self.id1, self.id2 = self.e1 >> np.uint32(3), self.e2 >> np.uint32(3)
        self.sure1, self.sure2 = (self.e1 & np.uint32(7)).astype(np.int64), (self.e2 & np.uint32(7)).astype(np.int64)
        self.level1, self.level2 = self.level_base + self.sure1, self.level_base + self.sure2 + _LEVELS
        self.c1, self.c2 = self.chance.take(self.level1), self.chance.take(self.level2)
        self.share2 = self.c2 << (_TOTAL - 16)
        left = (1 << _TOTAL) - self.share2
        self.share1 = self.c1 * (left >> 16) * (self.id1 != self.id2)
        self.rest = left - self.share1

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the shares of ids begin, and their sizes."""
        seen = (ids + 1).astype(np.uint32)
        in2 = self.id2 == seen
        first, size = self.share2 * ~in2, np.where(in2, self.share2, self.share1)
        other = np.flatnonzero(~(in2 | (self.id1 == seen)))
        if len(other):
            rest = self.rest.take(other)
            k = self.of.take(ids.take(other))
            a, b = self._class(self.below_base.take(other) + k, rest)
            inside, power = ids.take(other) - self.first.take(k), self.power.take(k)
            at = ((b - a) * inside) >> power
            first[other] = (1 << _TOTAL) - rest + a + at
            size[other] = (((b - a) * (inside + 1)) >> power) - at
        return first, size

    def ids_at(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose shares hold the values, where those begin, and their sizes."""
        in2 = value < self.share2
        found = np.where(in2, self.id2, self.id1).astype(np.int64) - 1
        first, size = self.share2 * ~in2, np.where(in2, self.share2, self.share1)
        named = (1 << _TOTAL) - self.rest
        other = np.flatnonzero(value >= named)
        if len(other):
            rest, start, base = self.rest.take(other), named.take(other), self.below_base.take(other)
            inner = value.take(other) - start
            # shares begin at (below * rest) >> 16, so the class is the last whose below is not above this
            goal = np.minimum((((inner + 1) << _SCALE) - 1) // rest, (1 << _SCALE) - 1)
            at, step = base, self.stride >> 1
            while step:
                at = at + (self.flat.take(at + step) <= goal) * step
                step >>= 1
            k = at - base
            a, b = self._class(at, rest)
            power = self.power.take(k)
            inside = (((inner - a + 1) << power) - 1) // np.maximum(b - a, 1)
            # beyond the last id only where a code is damaged
            found[other] = np.minimum(self.first.take(k) + inside, len(self.of) - 1)
            at = ((b - a) * inside) >> power
            first[other] = start + a + at
            size[other] = (((b - a) * (inside + 1)) >> power) - at
        return found, first, size

    def _class(self, at: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the shares of classes begin and end inside order 0's."""
        return (self.flat.take(at) * rest) >> _SCALE, (self.flat.take(at + 1) * rest) >> _SCALE

    def update(self, ids: np.ndarray) -> None:
        self.steps += 1
        at = self.count_base + self.of.take(ids)
        self.counts[at] = self.counts.take(at) + np.uint32(_MORE)
        seen = (ids + 1).astype(np.uint32)
        fresh = (seen << np.uint32(3)) | np.uint32(1)
        for entries, at, entry, named, sure, level, chance in (
            (self.two, self.at2, self.e2, self.id2, self.sure2, self.level2, self.c2),
            (self.one, self.at1, self.e1, self.id1, self.sure1, self.level1, self.c1),
        ):
            case = sure + ((named == seen).astype(np.int64) << 3)
            # a right one gains confidence; a wrong one loses it, or is replaced
            entry += _GAIN.take(case)
            np.copyto(entry, fresh, where=case < 2)
            entries[at] = entry
            self.chance[level] = chance + ((_GOAL.take(case) - chance) >> 4)
        self.hash2 = (self.last * np.uint32(0x85EBCA6B) + seen) * np.uint32(0xC2B2AE35)
        self.last = seen


def _columns(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids as steps x blocks, and the ids in each block; only the last block may be shorter."""
    n = max(1, -(-len(ids) // block))
    lengths = np.full(n, block)
    lengths[-1] = len(ids) - block * (n - 1)
    padded = np.zeros(n * block, np.uint32)
    padded[: len(ids)] = ids
    return np.ascontiguousarray(padded.reshape(n, block).T), lengths


def encode_ids(ids: np.ndarray, block: int, size: int) -> tuple[list[bytes], np.ndarray]:
    """Codes of the blocks of ``ids``, which are below ``size``, and the ids in each."""
    steps, lengths = _columns(ids, block)
    n = len(lengths)
    model = Models(n, size)
    low, width = np.zeros(n, np.uint64), np.full(n, (1 << 48) - 1, np.uint64)
    words = np.zeros((block * 2 + 4, n), np.uint32)  # 16 bits each, a carry on top
    place = np.zeros(n, np.int64)
    column = np.arange(n)
    flat = words.ravel()
    for t in range(int(lengths[0]) if len(ids) else 0):
        m = n if t < lengths[-1] else n - 1
        model.narrow(m)
        now = steps[t, :m].astype(np.int64)
        model.predict()
        first, share = model.interval(now)
        unit = width[:m] >> np.uint64(_TOTAL)
        lo = low[:m] + unit * first.astype(np.uint64)
        wi = unit * share.astype(np.uint64)
        over = np.flatnonzero(lo > _MASK48)
        if len(over):  # carry into the 16 bits before; ripples are settled at the end
            flat[(place[over] - 1) * n + over] += 1
            lo[over] &= _MASK48
        small = np.flatnonzero(wi <= _LOW32)
        while len(small):
            flat[place[small] * n + small] = (lo[small] >> np.uint64(32)).astype(np.uint32)
            place[small] += 1
            lo[small] = (lo[small] & _LOW32) << np.uint64(16)
            wi[small] <<= np.uint64(16)
            small = small[wi[small] <= _LOW32]
        low[:m], width[:m] = lo, wi
        model.update(now)
    for shift in (32, 16, 0):
        words[place, column] = ((low >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint32)
        place += 1
    words = words[: place.max() + 1]
    while True:
        carry = words >> np.uint32(16)
        if not carry.any():
            break
        words &= np.uint32(0xFFFF)
        words[:-1] += carry[1:]
    codes = np.ascontiguousarray(words.astype("<u2").T)
    return [codes[i, : place[i]].tobytes() for i in range(n)], lengths


def decode_ids(codes: list[bytes], lengths: np.ndarray, size: int) -> list[np.ndarray]:
    """The ids of each block; any blocks of a segment may be given, in any order."""
    if not len(codes):
        return []
    order = np.argsort(-np.asarray(lengths), kind="stable")
    lengths = np.asarray(lengths)[order]
    n, most = len(order), int(lengths[0])
    stride = max(len(c) for c in codes) // 2 + 8
    words = np.zeros((n, stride), np.uint64)
    for i, k in enumerate(order):
        part = np.frombuffer(codes[k], "<u2")
        words[i, : len(part)] = part
    flat = words.ravel()
    code = (words[:, 0] << np.uint64(32)) | (words[:, 1] << np.uint64(16)) | words[:, 2]
    read = np.arange(n) * stride + 3
    last = np.arange(n) * stride + stride - 1
    width = np.full(n, (1 << 48) - 1, np.uint64)
    model = Models(n, size)
    out = np.zeros((most, n), np.uint32)
    ends = np.searchsorted(-lengths, -np.arange(most), "left")  # blocks longer than t
    for t in range(most):
        m = int(ends[t])
        if m < model.active:
            model.narrow(m)
            code, width, read, last = code[:m], width[:m], read[:m], last[:m]
        model.predict()
        unit = width >> np.uint64(_TOTAL)
        with np.errstate(divide="ignore"):  # a damaged code may run dry; its checksum tells
            value = np.minimum(code // unit, np.uint64((1 << _TOTAL) - 1)).astype(np.int64)
        now, first, share = model.ids_at(value)
        code = code - unit * first.astype(np.uint64)
        width = unit * share.astype(np.uint64)
        small = np.flatnonzero(width <= _LOW32)
        while len(small):
            code[small] = (code[small] << np.uint64(16)) | flat[np.minimum(read[small], last[small])]
            read[small] += 1
            width[small] <<= np.uint64(16)
            small = small[(width[small] <= _LOW32) & (width[small] > 0)]
        out[t, :m] = now
        model.update(now)
    found: list[np.ndarray] = [np.empty(0, np.uint32)] * n
    columns = np.ascontiguousarray(out.T)
    for i, k in enumerate(order):
        found[k] = columns[i, : lengths[i]]
    return found


def write_segment(doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray, block: int) -> bytes:
    """The file image of some documents' ids, one after the other, of which ``sizes`` belong to each."""
    ids = ids.astype("<u4")
    size = int(ids.max()) + 1 if len(ids) else 1
    codes, lengths = encode_ids(ids, block, size)
    ends = np.cumsum(lengths)
    sums = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends.tolist(), lengths.tolist())]
    blocks = np.array([lengths, [len(c) for c in codes], sums], "<u4").T
    return b"".join(
        [
            MAGIC,
            struct.pack("<IIII", size, block, len(doc_ids), len(codes)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            np.asarray(sizes, "<u4").tobytes(),
            blocks.tobytes(),
            *codes,
        ]
    )


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """What :func:`write_segment` was given; raises ValueError where a block's checksum is wrong."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    size, _, n_docs, n_blocks = struct.unpack_from("<IIII", data, 4)
    at = 20

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(data, kind, count, at)
        at += part.nbytes
        return part

    names, nulls, sizes = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs).astype(np.int64)
    blocks = take("<u4", 3 * n_blocks).reshape(-1, 3).astype(np.int64)
    ends = at + np.cumsum(blocks[:, 1])
    codes = [data[e - k : e] for e, k in zip(ends.tolist(), blocks[:, 1].tolist())]
    found = decode_ids(codes, blocks[:, 0], size)
    for k, part in enumerate(found):
        if zlib.crc32(part.astype("<u4").tobytes()) != blocks[k, 2]:
            raise ValueError(f"block {k} is damaged")
    ids = np.concatenate(found) if found else np.empty(0, np.uint32)
    return [None if z else int(i) for i, z in zip(names.tolist(), nulls.tolist())], ids, sizes
