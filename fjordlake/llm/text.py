"""Words, word hashes and shingles of whole Arrow string columns, as numpy arrays.

Everything works on the bytes of a column at once, so a task pays per byte and
not per Python object. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STEP = 1 << 19
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
#: Words above this many bytes are hashed one by one.
_LONG = 64
#: Words hashed in one go by :func:`hard_hashes`, so that their state stays in a cache.
_AT_ONCE = 1 << 13
#: The state that :func:`hard_hashes` begins with (fixed values of SipHash).
_STATE = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)
#: Which bits of 8 bytes, read little-endian, belong to a word of 0 to 8 bytes.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        x = x + _MIX
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class WordClass:
    """Which bytes part words."""

    parts: np.ndarray

    @staticmethod
    def of(is_separator) -> WordClass:
        return WordClass(np.array([is_separator(c) for c in range(256)]))


#: Words ``[^\x20\x09-\x0D]+`` with A-Z in lower case.
SPACE = WordClass.of(lambda c: c == 0x20 or 0x09 <= c <= 0x0D)
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` with A-Z in lower case.
ALNUM = WordClass.of(
    lambda c: c < 0x80 and not (0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A)
)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of ``data`` as one number; past the end they are 0."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))


def hash_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each slice of ``data``: its 8-byte lanes and its length, mixed one after the other.

    No step is linear in the bytes, so different slices of ordinary texts meet by chance alone.
    Whoever undoes the steps can find some that meet; :func:`hard_hashes` are
    for hashes that decide something, and :func:`same_slices` compares the bytes.
    """
    eight, length = lanes(data), ends - starts
    value = mix(length.astype(np.uint64) ^ mix(eight[starts] & _KEEP[np.minimum(length, 8)]))
    todo = np.flatnonzero(length > 8)
    at = 8
    while len(todo) and at < _LONG:
        left = length[todo] - at
        value[todo] = mix(value[todo] ^ mix((eight[starts[todo] + at] & _KEEP[np.minimum(left, 8)]) + np.uint64(at)))
        at += 8
        todo = todo[left > 8]
    for i in todo.tolist():
        raw = data[starts[i] : ends[i]].tobytes()
        value[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
    return value


def hard_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As :func:`hash_slices`, but nobody finds slices that meet by undoing steps.

    The state is four times as wide as what is given (the rounds of SipHash-1-3,
    all slices at once): a step can be undone, but not from 64 bits of 256. What is left
    is to hash some 2^32 words of one's own until two meet.
    """
    eight, length = lanes(data), ends - starts
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), _AT_ONCE):
        at, size = starts[a : a + _AT_ONCE], length[a : a + _AT_ONCE]
        state = [np.full(len(at), c, np.uint64) for c in _STATE]
        _take_in(state, eight[at] & _KEEP[np.minimum(size, 8)])
        todo, k = np.flatnonzero(size > 8), 8
        while len(todo) and k < _LONG:
            left = size[todo] - k
            some = [v[todo] for v in state]
            _take_in(some, eight[at[todo] + k] & _KEEP[np.minimum(left, 8)])
            for v, new in zip(state, some):
                v[todo] = new
            k += 8
            todo = todo[left > 8]
        _take_in(state, size.astype(np.uint64))
        state[2] ^= np.uint64(0xFF)
        for _ in range(3):
            _round(state)
        out[a : a + _AT_ONCE] = state[0] ^ state[1] ^ state[2] ^ state[3]
        for i in todo.tolist():
            raw = data[at[i] : at[i] + size[i]].tobytes()
            out[a + i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
    return out


def _take_in(state: list[np.ndarray], lane: np.ndarray) -> None:
    state[3] ^= lane
    _round(state)
    state[0] ^= lane


def _round(state: list[np.ndarray]) -> None:
    v0, v1, v2, v3 = state
    for x, y, turn in ((v0, v1, 13), (v2, v3, 16)):
        x += y
        _turn(y, turn)
        y ^= x
    _turn(v0, 32)
    for x, y, turn in ((v0, v3, 21), (v2, v1, 17)):
        x += y
        _turn(y, turn)
        y ^= x
    _turn(v2, 32)


def _turn(x: np.ndarray, by: int) -> None:
    high = x >> np.uint64(64 - by)
    x <<= np.uint64(by)
    x |= high


def same_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether slice x[i] has the bytes of slice y[i]."""
    eight, length = lanes(data), ends - starts
    same = length[x] == length[y]
    todo, at = np.flatnonzero(same), 0
    while len(todo):
        a, b, left = x[todo], y[todo], length[x[todo]] - at
        keep = _KEEP[np.clip(left, 0, 8)]
        last = len(eight) - 1
        equal = (eight[np.minimum(starts[a] + at, last)] & keep) == (eight[np.minimum(starts[b] + at, last)] & keep)
        same[todo[~equal]] = False
        at += 8
        todo = todo[equal & (left > 8)]
    return same


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and, for each row, where it starts (and the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Hash, first byte and end byte of every word; ``rows[i]:rows[i + 1]`` are those of row i."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts())


def words(column: pa.Array, kind: WordClass, hashed=hash_slices) -> Words:
    """The words of every row of a string column.

    A word's hash is that of its bytes with A-Z in lower case, so no word
    becomes a Python object. Where hashes alone decide which words are the
    same, ``hashed`` is :func:`hard_hashes`.
    """
    data, at = text_buffer(column)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + _STEP)
        while b < n:  # up to the end of a word
            ahead = np.flatnonzero(kind.parts[data[b : b + 4096]])
            if len(ahead):
                b += int(ahead[0])
                break
            b = min(n, b + 4096)
        found.append(_span(data[a:b], a, at, kind, hashed))
        a = b
    if not found:
        empty = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), empty, empty, np.zeros(len(at), np.int64))
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found))
    return Words(hashes, starts, ends, np.searchsorted(starts, at))


def _span(data: np.ndarray, base: int, at: np.ndarray, kind: WordClass, hashed):
    n = len(data)
    inside = ~kind.parts[data]
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[at[np.searchsorted(at, base) : np.searchsorted(at, base + n, "right")] - base] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return hashed(_LOWER[data], starts, ends), starts + base, ends + base


def exact(found: Words, column: pa.Array) -> np.ndarray:
    """A number for each word, the same for two words if and only if their bytes are (A-Z as a-z)."""
    data = _LOWER[text_buffer(column)[0]]
    hashes = found.hashes.copy()
    while True:
        _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        other = np.flatnonzero(~same_slices(data, found.starts, found.ends, np.arange(len(number)), first[number]))
        if not len(other):
            return number
        hashes[other] = mix(hashes[other])


def shingles(words_: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words of a row, of all its words if it has fewer; and its row."""
    counts, h, rows = words_.counts(), words_.hashes, words_.row_of()
    if len(h) == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out, owner = [], []
    for w in range(1, width + 1):
        if w < width:
            first = words_.rows[:-1][counts == w]
        else:
            first = np.arange(max(0, len(h) - width + 1))
            first = first[rows[first] == rows[first + width - 1]] if len(first) else first
        if len(first):
            out.append(_run(h, first, w))
            owner.append(rows[first])
    return np.concatenate(out), np.concatenate(owner)


def _run(h: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        value = h[first] + np.uint64(width)
        for j in range(1, width):
            value = (value ^ (value >> _SHIFT)) * _MIX + h[first + j]
        return mix(value)


def same_words(found: Words, column: pa.Array, of: np.ndarray, known: bytes, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Whether word ``of[i]`` of the column (A-Z as a-z) is that of ``known`` from ``starts[which[i]]`` to the next start."""
    data = np.concatenate([_LOWER[text_buffer(column)[0]], np.frombuffer(known, np.uint8)])
    base = len(data) - len(known)
    begin = np.concatenate([found.starts, starts[:-1] + base])
    end = np.concatenate([found.ends, starts[1:] + base])
    return same_slices(data, begin, end, of, which + len(found.starts))


def lowered(column: pa.Array, start: int, end: int) -> bytes:
    """Bytes of the column from ``start`` to ``end``, A-Z as a-z."""
    return _LOWER[text_buffer(column)[0][start:end]].tobytes()


def distinct_by_row(values: np.ndarray, owner: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, one row after the other; and where each row starts."""
    order = np.argsort(owner, kind="stable")
    values, owner = values[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(n_rows + 1))
    parts = [np.unique(values[a:b]) if b - a > 1 else values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    sizes = np.fromiter(map(len, parts), np.int64, n_rows)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def release() -> None:
    """Gives memory that is free back to the system; a Python worker goes on with other stages' tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunks(batches: Iterator[pa.RecordBatch], *columns: str | int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts in ``columns`` come to about the bytes given last (4 MB) at most.

    At the end of a task's rows the worker's free memory is given back.
    """
    names = [c for c in columns if isinstance(c, str)]
    most_bytes = next((c for c in columns if isinstance(c, int)), 4 << 20)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in names)
        part = np.cumsum(lengths) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    release()
