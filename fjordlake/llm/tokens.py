"""Token ids of whole Arrow string columns by a tokenizers file, remembering short parts of texts."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .text import _KEEP, lanes, mix, text_buffer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task one core

_GROUP = 1 << 17  # parts that are looked up at once
_PART = 16  # bytes of a part that is remembered
_IDS = 6  # ids of a part that is remembered

# Kinds of bytes: 0 for all but letters, digits and signs of ASCII, between which a piece always ends.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[list(b".,;:!?*%&#$|-")] = 3
#: First bytes of characters that are no white space for sure.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xF5] = True
_SOLID[[0xE1, 0xE2, 0xE3]] = False


class Encoder:
    """``column(texts)`` gives the ids that the tokenizer gives for each whole text.

    A byte-level tokenizer with the usual pattern starts a new piece at a
    space between two characters that are not white space, around a single
    line feed between two such, and where letters, digits and signs of ASCII
    meet (an apostrophe is none of them); and it merges inside pieces only. So
    a text's ids are those of its parts, cut there, one after the other. Parts
    of up to 16 bytes and 6 ids are remembered in a table of fixed size, by
    their bytes and not by a hash: its memory is bounded by ``most_bytes``,
    whatever the texts. All parts that it does not hold are encoded in one
    call, a line feed between them, whose id tells where each ends. For
    tokenizers of another kind, and texts that hold one of its special tokens,
    the whole text is encoded at once.
    """

    def __init__(self, path: str, most_bytes: int = 32 << 20):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        kind = self.tokenizer.pre_tokenizer
        plain = isinstance(kind, ByteLevel) and kind.use_regex and not kind.add_prefix_space
        plain = plain and self.tokenizer.normalizer is None and self.tokenizer.post_processor is None
        feed = self._whole(["\n"])[0]
        self.by_parts = plain and len(feed) == 1
        self.feed = int(feed[0]) if len(feed) else -1
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        slots = 1 << ((most_bytes // (17 + _IDS * self.dtype.itemsize)).bit_length() - 1)
        self.mask = np.uint64(slots - 1)
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.count = np.zeros(slots, np.uint8)
        self.ids = np.zeros((slots, _IDS), self.dtype)

    def encode(self, text: str | None) -> np.ndarray:
        return self.column(pa.array([text], pa.large_string()))[0]

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, little-endian and of the smallest width that holds the vocabulary, and where each row's begin."""
        data, at = text_buffer(column)
        if not len(data):
            return np.empty(0, self.dtype), np.zeros(len(at), np.int64)
        starts, odd = self._cut(data, at)
        ends = np.append(starts[1:], len(data))
        found, sizes = [], []
        for a in range(0, len(starts), _GROUP):
            ids, size = self._parts(data, starts[a : a + _GROUP], ends[a : a + _GROUP], odd[a : a + _GROUP])
            found.append(ids)
            sizes.append(size)
        below = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.concatenate(found), below[np.searchsorted(starts, at)]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where parts start, and which of them are to be encoded one by one."""
        n = len(data)
        begin = np.zeros(n + 1, bool)
        begin[at] = True
        begin = begin[:n]
        rows = np.flatnonzero(begin)
        if not self.by_parts:
            return rows, np.ones(len(rows), bool)
        kind = _KIND[data]
        cut = begin.copy()
        cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        gap = np.flatnonzero((data == 0x20) | (data == 0x0A))
        gap = gap[(gap > 0) & (gap < n - 1)]
        gap = gap[~begin[gap] & ~begin[gap + 1] & _SOLID[data[gap + 1]] & self._solid_before(data, gap)]
        cut[gap] = True
        cut[gap[data[gap] == 0x0A] + 1] = True
        special = [s for s in self.special if data.tobytes().find(s) >= 0]
        alone = np.zeros(n, bool)
        if special:
            bounds = np.append(rows, n)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                raw = data[a:b].tobytes()
                if any(s in raw for s in special):
                    cut[a + 1 : b] = False
                    alone[a] = True
        starts = np.flatnonzero(cut)
        # parts with white space beyond a single space at their start cannot stand beside others
        blank = ~_SOLID[data] & ((data < 0x80) | (data >= 0xC0))
        blank[starts[data[starts] == 0x20]] = False
        odd = alone[starts] | (np.add.reduceat(blank, starts, dtype=np.int64) > 0)
        only = np.append(starts[1:], n) - starts == 1
        return starts, odd | (only & (data[starts] == 0x20))

    @staticmethod
    def _solid_before(data: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Whether the character that ends before each place is no white space."""
        first = data[gap - 1]
        for back in (2, 3, 4):
            more = np.flatnonzero((first >= 0x80) & (first < 0xC0))
            if not len(more):
                break
            first[more] = data[np.maximum(gap[more] - back, 0)]
        return _SOLID[first]

    def _parts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some parts, and how many each has."""
        length = ends - starts
        short = np.flatnonzero(~odd & (length <= _PART))
        base = int(starts[0])
        eight = lanes(data[base : int(ends[-1])])
        at, n = starts[short] - base, length[short]
        low = eight[at] & _KEEP[np.minimum(n, 8)]
        high = eight[np.minimum(at + 8, len(eight) - 1)] & _KEEP[np.clip(n - 8, 0, 8)]
        h = mix(low ^ mix(high))
        slot, second = (h & self.mask).astype(np.int64), ((h >> np.uint64(32)) & self.mask).astype(np.int64)
        there = (self.low[slot] == low) & (self.high[slot] == high)
        slot = np.where(there, slot, second)
        there |= (self.low[slot] == low) & (self.high[slot] == high)
        missing = np.flatnonzero(~there)
        size = np.zeros(len(starts), np.int64)
        pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # parts, ids, sizes
        known = short[there]
        count = self.count[slot[there]].astype(np.int64)
        size[known] = count
        pieces.append((known, self.ids[slot[there]][np.arange(_IDS) < count[:, None]], count))
        if len(missing):
            _, first, again = np.unique(h[missing], return_index=True, return_inverse=True)
            chosen = missing[first]
            # a part whose hash another one has is encoded for itself
            clash = (low[chosen][again] != low[missing]) | (high[chosen][again] != high[missing])
            own = np.concatenate([chosen, missing[clash]])
            flat, each = self._joined(data, starts[short[own]], ends[short[own]])
            below = np.cumsum(each) - each
            again[clash] = len(chosen) + np.arange(int(clash.sum()))
            parts = short[missing]
            size[parts] = each[again]
            pieces.append((parts, flat[_ranges(below[again], each[again])], each[again]))
            keep = np.flatnonzero(each[: len(chosen)] <= _IDS)
            spot = chosen[keep]
            a, b = (h[spot] & self.mask).astype(np.int64), ((h[spot] >> np.uint64(32)) & self.mask).astype(np.int64)
            free = (self.count[a] == 0) | ((self.count[b] > 0) & (h[spot] >> np.uint64(63) == 0))
            a = np.where(free, a, b)
            _, last = np.unique(a[::-1], return_index=True)  # two may have chosen one slot
            last = len(a) - 1 - last
            a, keep, spot = a[last], keep[last], spot[last]
            self.low[a], self.high[a], self.count[a] = low[spot], high[spot], each[keep]
            places = below[keep][:, None] + np.arange(_IDS)
            self.ids[a] = flat[np.minimum(places, len(flat) - 1)]
        long = np.flatnonzero(~odd & (length > _PART))
        if len(long):
            flat, each = self._joined(data, starts[long], ends[long])
            size[long] = each
            pieces.append((long, flat, each))
        alone = np.flatnonzero(odd)
        if len(alone):
            texts = [data[starts[i] : ends[i]].tobytes().decode() for i in alone.tolist()]
            found = self._whole(texts)
            each = np.fromiter(map(len, found), np.int64, len(found))
            size[alone] = each
            pieces.append((alone, np.concatenate(found), each))
        if len(pieces) == 1:
            return pieces[0][1], size
        below = np.cumsum(size) - size
        out = np.empty(int(size.sum()), self.dtype)
        for parts, flat, each in pieces:
            out[_ranges(below[parts], each)] = flat
        return out, size

    def _joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts without line feeds (or a line feed alone), and how many each has."""
        length = ends - starts
        feed = (length == 1) & (data[starts] == 0x0A)
        take = np.flatnonzero(~feed)
        each = np.ones(len(starts), np.int64)
        flat = np.empty(0, np.int64)
        if len(take):
            size = length[take] + 1
            raw = data[np.minimum(_ranges(starts[take], size), len(data) - 1)]
            raw[np.cumsum(size) - 1] = 0x0A
            flat = self._whole([raw[:-1].tobytes().decode()])[0]
            marks = np.append(np.flatnonzero(flat == self.feed), len(flat))
            each[take] = np.diff(np.append(-1, marks)) - 1
            flat = flat[flat != self.feed]
        if feed.any():
            out = np.full(int(each.sum()), self.feed, np.int64)
            below = np.cumsum(each) - each
            out[_ranges(below[take], each[take])] = flat
            flat = out
        return flat.astype(self.dtype), each


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, then those of the next, and so on."""
    below = np.cumsum(sizes) - sizes
    return np.repeat(starts - below, sizes) + np.arange(int(sizes.sum()))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per Python worker, so that its tasks share what is remembered."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
