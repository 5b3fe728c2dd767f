"""Near-duplicate passages by compact windows of min-hashes over token shingles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import _BROADCAST_ROWS, broadcast_if_small, discard, join_groups, materialize, setting
from .text import SPACE, chunks, mix, text_buffer, words

_CHUNK = 1 << 20
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_HELD = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Limits:
    """Passages have ``length`` words or more; two are near copies from a similarity of numerator/denominator.

    The similarity is that of their sets of ``width``-word shingles. Two
    places that share one of ``hashes`` min-hashes over those are candidates
    if the shingles around them on one side agree in more than ``agree`` of 8
    min-hashes: equal passages agree in all, and places that share a phrase
    alone hardly ever do. ``shift`` bounds how far words put in or left out
    move one agreement against another. ``rounds`` is how many members of a
    list all others meet before the rest meets by sketches of more agreement.
    """

    length: int = 50
    width: int = 5
    hashes: int = 6
    agree: int = 3
    shift: int = 8
    numerator: int = 80
    denominator: int = 100
    rounds: int = 2


def _token_shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words, in order of place, and where each row's begin."""
    found = words(column, SPACE)
    counts = np.maximum(found.counts() - width + 1, 0)
    rows = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(rows[-1]) - np.repeat(rows[:-1], counts) + np.repeat(found.rows[:-1], counts)
    value = np.zeros(len(place), np.uint64)
    for j in range(width):
        value = mix(value ^ found.hashes[place + j])
    return value, rows


def compact_windows(values: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows ``left, center, right`` of each row's sequence of hash values, of ``length`` places or more.

    A window stands for all subsequences from ``left..center`` to
    ``center..right``: the value at ``center`` is the least of each, the
    first of equals. They are the nodes of the row's Cartesian tree whose
    subtrees have ``length`` places, about two for each ``length`` of them.
    Their centers are the minima of all runs of ``length`` places; as a
    node's parent has a larger subtree, a stack over the centers alone builds
    this part of the tree. ``right`` is inclusive.
    """
    n = len(values)
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty
    bits = np.uint64(max(1, n.bit_length()))
    ranked = (values >> bits << bits) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // length) * length, np.uint64(2**64 - 1))
    padded[:n] = ranked
    grid = padded.reshape(-1, length)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - length + 1], ahead[length - 1 : n])
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    least = least[row[: n - length + 1] == row[length - 1 :]]
    if not len(least):
        return empty, empty, empty
    center = (least[np.concatenate([[True], least[1:] != least[:-1]])] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    own = row[center]
    left, right = rows[own].tolist(), (rows[own + 1] - 1).tolist()
    stack: list[int] = []
    last = -1
    places, ranks = center.tolist(), ranked[center].tolist()
    for k, (r, at, rank) in enumerate(zip(own.tolist(), places, ranks)):
        if r != last:
            stack, last = [], r
        while stack and ranks[stack[-1]] > rank:
            right[stack.pop()] = at - 1
        if stack:
            left[k] = places[stack[-1]] + 1
        stack.append(k)
    return np.array(left, np.int64), center, np.array(right, np.int64)


def _sketches(values: Iterable[np.ndarray], n: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place 4 bits of the least of each of 8 sequences over the ``half`` places that end, and that begin, there."""
    before, after = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for k, v in enumerate(values):
        padded = np.full(-(-n // half) * half + half, np.uint64(2**64 - 1))
        padded[:n] = v
        grid = padded.reshape(-1, half)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[half - 1 : n + half - 1])  # of places t to t + half - 1
        bits = ((least >> np.uint64(40)) & np.uint64(15)).astype(np.uint32) << np.uint32(4 * k)
        after |= bits
        before[half - 1 :] |= bits[: n - half + 1] if n >= half else np.empty(0, np.uint32)
    return before, after


@dataclass
class _Places:
    """The compact windows of some texts under one hash function, with the sketches at their centers."""

    key: np.ndarray
    row: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    sketch: np.ndarray


def _places(column: pa.Array, limits: Limits, sketched: bool = False) -> tuple[np.ndarray, np.ndarray, Iterator[_Places]]:
    """Shingles of some texts, where each text's begin, and the windows of each hash function."""
    shingle, rows = _token_shingles(column, limits.width)
    least = limits.length - limits.width + 1

    def each() -> Iterator[_Places]:
        of = lambda k: mix(shingle ^ mix(np.array([k + 1], np.uint64)))
        before, after = _sketches(map(of, range(8)), len(shingle), least // 2) if sketched else (None, None)
        row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        for k in range(limits.hashes):
            values = of(k)
            lo, at, hi = compact_windows(values, rows, least)
            row = row_of[at]
            key = ((values[at] & ~np.uint64(15)) | np.uint64(k)).view(np.int64)
            sketch = (before[at].astype(np.uint64) << np.uint64(32) | after[at]).view(np.int64) if sketched else at
            yield _Places(key, row, at - rows[row], lo - rows[row], hi - rows[row], sketch)

    return shingle, rows, each() if len(shingle) else iter(())


def _equal_texts(docs: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """``docs`` with each text that several have in that of the smallest id alone; and the spans of such texts, which are passages as a whole."""
    digest, short = F.sha2("text", 256), F.xxhash64("text").alias("short")
    groups = docs.groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    groups = materialize(groups.where("first < last").drop("last"), "equal")
    copies = join_groups(docs.withColumn("digest", digest), groups, "digest").where("first IS NOT NULL")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", _CHUNK):
            n = words(part.column("text"), SPACE).counts()
            first = pa.array(np.zeros(len(n), np.int32))
            columns = [part.column("doc_id"), first, pa.array(n.astype(np.int32)), part.column("again"), part.column("short")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "start", "end", "again", "short"])

    copies = copies.select("doc_id", "text", (F.col("doc_id") > F.col("first")).alias("again"), short)
    copies = materialize(copies.mapInArrow(work, "doc long, start int, end int, again boolean, short long"), "copies")
    gone = copies.where("again").select(F.col("doc").alias("doc_id"), "short").distinct()
    gone = materialize(gone, "gone")
    rest = docs.withColumn("short", short).join(broadcast_if_small(gone), ["doc_id", "short"], "left_anti").select(*docs.columns)
    if gone.count() > _BROADCAST_ROWS:
        rest = materialize(rest, "texts")
    return rest, copies.drop("short").where(F.col("end") >= limits.length)


def _keys(docs: DataFrame, limits: Limits) -> DataFrame:
    """``key`` of every window, once for each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", _CHUNK):
            for w in _places(part.column("text"), limits)[2]:
                order = np.lexsort((w.row, w.key))
                key, row = w.key[order], w.row[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[new])], names=["key"])

    return docs.select("text").mapInArrow(work, "key long")


def _windows(docs: DataFrame, limits: Limits) -> DataFrame:
    """A row per compact window: ``key, doc, at, lo, hi, sketch``; of a text's windows alike in key and sketch the first."""
    names = ["key", "doc", "at", "lo", "hi", "sketch"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", _CHUNK):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            for w in _places(part.column("text"), limits, True)[2]:
                order = np.lexsort((w.at, w.sketch, w.row, w.key))
                a, b = order[1:], order[:-1]
                new = np.ones(len(order), bool)
                new[1:] = (w.key[a] != w.key[b]) | (w.row[a] != w.row[b]) | (w.sketch[a] != w.sketch[b])
                some = order[new]
                columns = [w.key[some], ids[w.row[some]], *[x[some].astype(np.int32) for x in (w.at, w.lo, w.hi)], w.sketch[some]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return docs.mapInArrow(work, "key long, doc long, at int, lo int, hi int, sketch long")


def _own_spans(docs: DataFrame, limits: Limits) -> DataFrame:
    """Near copies inside one text: ``doc, start, end`` in words, and ``again``: whether one begins before it.

    Windows of one key are compared each with the next one of its text, at
    the distance between them; a distance is compared once, over all places
    where it occurs.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", _CHUNK):
            shingle, rows, found = _places(part.column("text"), limits)
            ids = part.column("doc_id").to_pylist()
            seen: list[np.ndarray] = []
            for w in found:
                order = np.lexsort((w.at, w.row, w.key))
                a, b = order[:-1], order[1:]
                again = (w.key[a] == w.key[b]) & (w.row[a] == w.row[b])
                a, b = a[again], b[again]
                seen.append(np.stack([w.row[a], w.at[b] - w.at[a], w.lo[a], w.hi[b]], axis=1))
            out: list[tuple[int, int, int, bool]] = []
            pairs = np.concatenate(seen) if seen else np.empty((0, 4), np.int64)
            pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
            cut = np.flatnonzero((np.diff(pairs[:, 0]) != 0) | (np.diff(pairs[:, 1]) != 0)) + 1
            for group in np.split(pairs, cut) if len(pairs) else []:
                row, apart = int(group[0, 0]), int(group[0, 1])
                reach = np.maximum.accumulate(group[:, 3])
                breaks = np.flatnonzero(group[1:, 2] > reach[:-1]) + 1
                for lo, hi in zip(group[np.append(0, breaks), 2].tolist(), reach[np.append(breaks - 1, len(group) - 1)].tolist()):
                    x = shingle[rows[row] + lo : rows[row] + hi + 1]
                    for p, q, r, s in near_spans(x, x, -apart, -apart, limits, True):
                        out += [(row, lo + p, lo + q, p > r), (row, lo + r, lo + s, r > p)]
            row, start, end, again = np.array(out, np.int64).reshape(-1, 4).T
            doc = pa.array([ids[i] for i in row.tolist()], pa.int64())
            columns = [doc, pa.array(start.astype(np.int32)), pa.array((end + limits.width - 1).astype(np.int32)), pa.array(again > 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "start", "end", "again"])

    return docs.mapInArrow(work, "doc long, start int, end int, again boolean")


def _is_near(x: np.ndarray, y: np.ndarray, limits: Limits) -> bool:
    """Whether the sets of two spans of shingles are at the threshold, and the second is not much too short."""
    both = len(np.intersect1d(x, y))
    union = len(np.unique(x)) + len(np.unique(y)) - both
    least = (limits.length - limits.width + 1) * limits.numerator // limits.denominator
    return both * limits.denominator >= union * limits.numerator and len(y) >= least


def _before(values: np.ndarray) -> np.ndarray:
    """Where each value occurred last before its place; -1 if it did not."""
    out = np.full(len(values), -1)
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _inside(x: np.ndarray, y: np.ndarray, place: np.ndarray, other: np.ndarray, limits: Limits) -> list[tuple[int, ...]]:
    """Near copies inside a chain of agreements ``x[place] == y[other]`` that is none as a whole.

    Each place of x counts for its span if y's part of the chain has its
    shingle, and against it if not, so that a span's sum is not negative if
    two spans of its length can be at the threshold. From each agreement the
    longest such spans are tried first, down to one whose sets are near; those
    that cannot be, by the numbers of different shingles in them, are left out.
    """
    least = limits.length - limits.width + 1
    p, q = int(place[0]), int(place[-1]) + 1
    low = int(other.min())
    part = y[low : int(other.max()) + 1]
    known = np.isin(x[p:q], part)
    worth = np.where(known, limits.denominator + limits.numerator, 0) - 2 * limits.numerator
    sums = np.concatenate([[0], np.cumsum(worth)])
    begins, ends = sums[place - p], sums[place - p + 1]
    last_x, last_y = _before(x[p:q]), _before(part)
    found: list[tuple[int, ...]] = []
    reach = 0  # spans that end sooner are in one that is found
    highest = np.maximum.accumulate(ends[::-1])
    furthest = np.maximum(len(place) - np.searchsorted(highest, begins) - 1, 0)
    for i in np.flatnonzero(place[furthest] + 1 - place >= least).tolist():
        if place[furthest[i]] < reach:
            continue
        last = np.flatnonzero((ends >= begins[i]) & (place + 1 >= max(int(place[i]) + least, reach + 1)))
        last = last[last >= i]
        if not len(last):
            continue
        a, r = int(place[i]) - p, int(other[i]) - low
        new = last_x[a:] < a
        at = place[last] - p - a
        n_x, both = np.cumsum(new)[at], np.cumsum(new & known[a:])[at]
        top = np.maximum.accumulate(other[i:])[last - i] - low - r
        n_y = np.cumsum(last_y[r:] < r)[top]
        both = np.minimum(both, n_y)
        last = last[both * limits.denominator >= (n_x + n_y - both) * limits.numerator]
        for j in last[::-1].tolist():
            r, s = int(other[i : j + 1].min()), int(other[i : j + 1].max()) + 1
            a, b = int(place[i]), int(place[j]) + 1
            if _is_near(x[a:b], y[r:s], limits):
                found.append((a, b, r, s))
                reach = b
                break
    return found


def near_spans(x: np.ndarray, y: np.ndarray, low: int, high: int, limits: Limits, same: bool) -> list[tuple[int, ...]]:
    """Near copies ``x[p:q], y[r:s]`` of two sequences of shingles, on the diagonals from ``low`` to ``high``.

    A diagonal is a place in x less a place in y. Agreements on them are
    joined over gaps of up to a fifth of the least length; what is long
    enough is a near copy if the shingle sets of both spans say so. If they do
    not, the near copies inside are looked for: see :func:`_inside`.
    """
    least = limits.length - limits.width + 1
    found = _on_diagonals(x, y, low, high, 0, len(x), limits, same)
    # their neighbours too, in what no span holds and is long enough for one
    reach = 0
    for p, q in [*sorted((f[0], f[1]) for f in found), (len(x), len(x))]:
        if p - reach >= least:
            found += _on_diagonals(x, y, low - 2, high + 2, reach, p, limits, same)
        reach = max(reach, q)
    return sorted(set(found))


def _on_diagonals(x, y, low: int, high: int, first: int, last: int, limits: Limits, same: bool) -> list[tuple[int, ...]]:
    """Near copies ``x[p:q], y[r:s]`` with p and q from ``first`` to ``last``."""
    least = limits.length - limits.width + 1
    found: list[tuple[int, ...]] = []
    places, diagonals = [], []
    for d in range(low, high + 1):
        a, b = max(first, d), min(last, len(y) + d)
        if b > a and not (same and d == 0):
            hits = np.flatnonzero(x[a:b] == y[a - d : b - d]) + a
            places.append(hits)
            diagonals.append(np.full(len(hits), d))
    # sets at the threshold have so many shingles in common
    if sum(map(len, places)) * limits.denominator < least * limits.numerator:
        return found
    place, diagonal = np.concatenate(places), np.concatenate(diagonals)
    if len(places) > 1:
        order = np.argsort(place, kind="stable")
        place, diagonal = place[order], diagonal[order]
    cut = np.flatnonzero(np.diff(place) > max(1, limits.length // 5)) + 1
    begin, end = np.append(0, cut), np.append(cut, len(place))
    some = place[end - 1] - place[begin] + 1 >= least
    for a, b in zip(begin[some].tolist(), end[some].tolist()):
        p, q = int(place[a]), int(place[b - 1]) + 1
        other = place[a:b] - diagonal[a:b]
        r, s = int(other.min()), int(other.max()) + 1
        if q - p == s - r == b - a and len(places) == 1:
            found.append((p, q, r, s))  # word for word
        elif _is_near(x[p:q], y[r:s], limits):
            found.append((p, q, r, s))
        else:
            found += _inside(x, y, place[a:b], other, limits)
    return found


def _numbered(docs: DataFrame, limits: Limits) -> DataFrame:
    """``doc, h``: 32-bit hashes of a text's shingles in order, of which any part can be cut without a Python worker."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", _CHUNK):
            shingle, rows = _token_shingles(part.column("text"), limits.width)
            h = pa.array((shingle >> np.uint64(32)).astype(np.uint32).view(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), h)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc", "h"])

    return docs.mapInArrow(work, "doc long, h array<int>")


def _may_be_new(x, y, low: int, high: int, held_x: np.ndarray, held_y: np.ndarray, limits: Limits) -> bool:
    """Whether near copies that :func:`near_spans` finds may reach beyond the spans that are held, rows of first and last place of a region.

    They begin and end at agreements and have no long gap between two of
    them. So what lies in one held span from each agreement to the next one
    adds nothing, whatever of it is near.
    """
    places, diagonals = [], []
    for d in range(low - 2, high + 3):
        a, b = max(0, d), min(len(x), len(y) + d)
        if b > a:
            hits = np.flatnonzero(x[a:b] == y[a - d : b - d]) + a
            places.append(hits)
            diagonals.append(np.full(len(hits), d))
    least = limits.length - limits.width + 1
    if sum(map(len, places)) * limits.denominator < least * limits.numerator:
        return False
    place, diagonal = np.concatenate(places), np.concatenate(diagonals)
    order = np.argsort(place, kind="stable")
    place, diagonal = place[order], diagonal[order]
    other = place - diagonal
    near = np.flatnonzero(np.diff(place) <= max(1, limits.length // 5))
    return bool(
        _outside(place[near], place[near + 1], held_x).any()
        or _outside(np.minimum(other[near], other[near + 1]), np.maximum(other[near], other[near + 1]), held_y).any()
    )


def _outside(first: np.ndarray, last: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which ranges from ``first`` to ``last`` are in none of the spans held, which are in order and apart."""
    if not len(held):
        return np.ones(len(first), bool)
    at = np.searchsorted(held[:, 0], first, "right") - 1
    return (at < 0) | (held[np.maximum(at, 0), 1] < last)


def _verified(pairs: DataFrame, docs: DataFrame, limits: Limits, found: DataFrame | None = None) -> DataFrame:
    """Near copies ``doc, start, end`` in words, of both documents of the pairs, looked for in the regions that these name.

    ``again`` marks those of b, the larger id. Of pairs that can add nothing
    to the spans ``found`` before, as their regions or all their agreements
    are in those, none are looked for.

    Only the shingles of the regions meet, cut from those of their documents.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    ids = materialize(ids, "wanted")
    numbered = _numbered(docs.join(broadcast_if_small(ids), "doc_id", "left_semi"), limits)
    none = F.array().cast(_HELD)
    if found is not None:
        # a is looked for in all spans, b, whose are copies of a smaller one, in those that are marked so
        held = [
            merge_spans(rows.select("doc", "start", "end").distinct()).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(name))
            for rows, name in ((found, "any"), (found.where("again"), "marked"))
        ]
        held = materialize(held[0].join(held[1], "doc", "left"), "held")
        numbered = numbered.join(held, "doc", "left").withColumns({c: F.coalesce(c, none) for c in ("any", "marked")})
    else:
        numbered = numbered.withColumns({"any": none, "marked": none})
    numbered = materialize(numbered, "numbered")
    region = lambda h, at: F.slice(h, F.greatest(F.col(f"lo_{at}"), F.lit(0)) + 1, F.col(f"hi_{at}") - F.greatest(F.col(f"lo_{at}"), F.lit(0)) + 1)
    of = lambda c, at: F.filter(c, lambda s: (s["end"] > F.col(f"lo_{at}")) & (s["start"] <= F.col(f"hi_{at}")))
    more = limits.shift
    inside = lambda c, at: F.exists(c, lambda s: (s["start"] <= F.col(f"lo_{at}") + more) & (F.col(f"hi_{at}") - more + limits.width <= s["end"]))
    both = pairs.join(numbered.select(F.col("doc").alias("b"), F.col("h").alias("h_b"), F.col("marked").alias("marked_b")), "b")
    both = both.select(*pairs.columns, region("h_b", "b").alias("y"), of("marked_b", "b").alias("held_b"), inside("marked_b", "b").alias("in_b"))
    both = both.join(numbered.select(F.col("doc").alias("a"), "h", "any"), "a").where(~(inside("any", "a") & F.col("in_b")))
    columns = both.select("a", "b", "low", "high", "lo_a", "lo_b", region("h", "a").alias("x"), "y", of("any", "a").alias("held_a"), "held_b")

    known = found is not None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, at_x), (y, at_y), (s, at_s), (t, at_t) = (
                (c.flatten(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (batch.column(c) for c in ("x", "y", "held_a", "held_b"))
            )
            x, y = x.to_numpy(), y.to_numpy()
            s, t = (np.stack([c.field("start").to_numpy(), c.field("end").to_numpy() - limits.width], axis=1).astype(np.int64) for c in (s, t))
            out: list[tuple] = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "low", "high", "lo_a", "lo_b")))
            for i, (a, b, low, high, p0, r0) in enumerate(rows):
                p0, r0 = max(p0, 0), max(r0, 0)
                low, high = low - p0 + r0, high - p0 + r0
                x_, y_ = x[at_x[i] : at_x[i + 1]], y[at_y[i] : at_y[i + 1]]
                if known and not _may_be_new(x_, y_, low, high, s[at_s[i] : at_s[i + 1]] - p0, t[at_t[i] : at_t[i + 1]] - r0, limits):
                    continue
                spans = near_spans(x_, y_, low, high, limits, False)
                more = limits.width - 1
                for p, q, r, e in spans:
                    out += [(a, p0 + p, p0 + q + more, False), (b, r0 + r, r0 + e + more, True)]
            doc, start, end, again = np.array(out, np.int64).reshape(-1, 4).T
            columns = [pa.array(doc), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(again > 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "start", "end", "again"])

    with setting(docs.sparkSession, _ROWS, "200"):
        spans = materialize(columns.mapInArrow(work, "doc long, start int, end int, again boolean").distinct(), "spans")
    discard(ids, numbered)
    return spans


def _candidates(sides: DataFrame, limits: Limits) -> DataFrame:
    """Pairs ``a, b, low, high`` of documents and shifts, with the regions around their places that may be copies.

    ``sides`` has windows ``f`` and ``g`` of one list. Places whose sketches
    agree too little on both sides, and windows that overlap by less than a
    passage, go at once; a pair's places at near shifts are one region.
    """
    f, g = F.least("f", "g"), F.greatest("f", "g")
    sides = sides.where("f.doc <> g.doc").select(f.alias("f"), g.alias("g"))
    differ = F.col("f.sketch").bitwiseXOR(F.col("g.sketch"))
    ones = F.lit(0x1111111111111111)
    filled = differ.bitwiseOR(F.shiftright(differ, 1)).bitwiseOR(F.shiftright(differ, 2)).bitwiseOR(F.shiftright(differ, 3)).bitwiseAND(ones)
    right, left = F.bit_count(filled.bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_count(F.shiftrightunsigned(filled, 32))
    alike = F.least(left, right) < 8 - limits.agree
    before = F.least(F.expr("g.at - g.lo"), F.expr("f.at - f.lo"))
    after = F.least(F.expr("g.hi - g.at"), F.expr("f.hi - f.at"))
    least = (limits.length - limits.width + 1) * limits.numerator // limits.denominator
    more = F.lit(limits.shift)
    near = sides.where(alike & (before + after + 1 >= least)).select(
        F.col("f.doc").alias("a"), F.col("g.doc").alias("b"), F.expr("f.at - g.at").alias("shift"),
        (F.col("f.at") - before - more).alias("lo_a"), (F.col("f.at") + after + more).alias("hi_a"),
        (F.col("g.at") - before - more).alias("lo_b"), (F.col("g.at") + after + more).alias("hi_b"),
    )
    # shifts in bands, and regions cut at blocks of the first document, so that far ones stay apart
    near = near.withColumn("band", F.floor(F.col("shift") / limits.shift)).withColumn("block", F.floor(F.col("lo_a") / 4096))
    return near.groupBy("a", "b", "band", "block").agg(
        F.min("shift").alias("low"), F.max("shift").alias("high"), F.min("lo_a").alias("lo_a"), F.max("hi_a").alias("hi_a"),
        F.min("lo_b").alias("lo_b"), F.max("hi_b").alias("hi_b"),
    ).drop("band", "block")


def passage_spans(docs: DataFrame, limits: Limits) -> DataFrame:
    """Spans ``doc, start, end, again`` of near-duplicate passages of ``docs`` (``doc_id, text``), in words.

    Windows that share a least value under a hash function form a list. Two
    of its windows are candidates if they overlap around it by a passage and
    the shingles beside it agree; see :func:`_candidates`. In each round every
    window of a list meets one of it, first that of the smallest document,
    then one drawn by a hash, so a passage costs as many pairs as it has
    copies. Windows of which all words from ``lo`` to ``hi`` are in verified
    passages are done, as every passage that they stand for is found; the
    others go on. After the last round the windows that are left meet those
    of their lists with which they share half of a sketch's side: lists of a
    common phrase come apart by what stands beside it. Copies inside one text
    are found apart, see :func:`_own_spans`, and equal texts meet others once,
    see :func:`_equal_texts`. Pairs are only looked into if they may add to
    the spans found before.
    """
    docs, copies = _equal_texts(docs, limits)
    shared = _keys(docs, limits).groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    shared = materialize(shared, "shared")
    rest = materialize(_windows(docs, limits).join(shared, "key", "left_semi"), "listed")
    discard(shared)
    open_ = rest
    found = materialize(_own_spans(docs, limits).unionByName(copies), "spans")
    asked = None
    window = F.struct("doc", "at", "lo", "hi", "sketch")
    for turn in range(limits.rounds + 1):
        last = turn == limits.rounds
        if last:
            halves = [F.shiftrightunsigned(F.col("sketch"), n).bitwiseAND(F.lit(0xFFFF)) for n in (0, 16, 32, 48)]
            parted = F.posexplode(F.array(*halves)).alias("side", "half")
            every = rest.select("key", window.alias("g"), parted)
            sides = open_.select("key", window.alias("f"), parted).join(every, ["key", "side", "half"]).where("f <> g")
        else:
            order = F.xxhash64("doc", "at", F.lit(turn)) if turn else F.lit(0)
            first = open_.groupBy("key").agg(F.min(F.struct(order.alias("order"), window.alias("w"))).alias("m"))
            first = materialize(first.select("key", F.col("m.w").alias("f")), "first")
            sides = rest.select("key", window.alias("g")).join(first, "key")
        pairs = _candidates(sides, limits)
        if asked is not None:
            pairs = pairs.join(asked, pairs.columns, "left_anti")
        pairs = materialize(pairs, "pairs")
        found = found.unionByName(_verified(pairs, docs, limits, found))
        if last:
            break
        asked = pairs if asked is None else asked.unionByName(pairs)
        # the windows drawn have met all others of their lists; covered ones need no more partners
        tried = first.select("key", "f.doc", "f.at", "f.sketch")
        covered = materialize(merge_spans(found.select("doc", "start", "end").distinct()), "covered")
        left = open_.join(tried, ["key", "doc", "at", "sketch"], "left_anti")
        done = left.join(broadcast_if_small(covered), "doc").where((F.col("start") <= F.col("lo")) & (F.col("hi") + limits.width <= F.col("end")))
        done = done.select("key", "doc", "at").distinct()
        still = materialize(left.join(done, ["key", "doc", "at"], "left_anti"), "open")
        discard(first, *([open_] if turn else []))
        open_ = still
        if open_.isEmpty():
            break
    discard(rest, open_)
    return found


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None
) -> DataFrame:
    """Per row ``id_col, n_spans, n_words, spans``: where its text has passages that near copies of exist elsewhere.

    ``spans`` are structs ``start, end`` (words, end exclusive) that do not
    touch each other, in order; ``n_words`` are the words inside. Null texts,
    texts shorter than a passage and rows without an id have none. Rows that
    repeat an id are one document: what any of its texts shares counts for
    all. Extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    spans = passage_spans(rows.where("doc_id IS NOT NULL AND text IS NOT NULL"), limits or Limits())
    merged = merge_spans(spans.select("doc", "start", "end").distinct())
    by_doc = merged.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_spans"), F.sum(F.expr("end - start")).alias("n_words"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    joined = rows.select("doc_id").join(by_doc, F.col("doc_id") == F.col("doc"), "left")
    return joined.select(
        F.col("doc_id").alias(id_col),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("spans", none).alias("spans"),
    )


def merge_spans(spans: DataFrame) -> DataFrame:
    """Spans of each ``doc`` joined where they overlap or touch."""
    order = Window.partitionBy("doc").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    group = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    grouped = fresh.withColumn("g", group).groupBy("doc", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return grouped.drop("g")


def drop_repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None
) -> DataFrame:
    """``docs`` with all columns, whose texts have lost each passage that a document of smaller id, or the text before, has.

    Of a passage's copies the one of the smallest id stays. What goes is from
    the first byte of its first word to the last of its last; white space
    around it stays. Rows without an id or text come back as they are; rows
    that repeat an id lose what any of their texts shares at the same words.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"d{i}" for i in range(len(columns))])
    at, own = columns.index(text_col), F.col(f"d{columns.index(id_col)}").cast("long")
    rows = plain.select(own.alias("doc_id"), F.col(f"d{at}").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    again = merge_spans(passage_spans(rows, limits or Limits()).where("again").select("doc", "start", "end").distinct())
    gone = again.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"))
    joined = plain.join(gone, own == F.col("doc"), "left").drop("doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, f"d{at}", _CHUNK):
            text, spans = part.column(f"d{at}"), part.column("gone").to_pylist()
            found, (data, begin) = words(text, SPACE), text_buffer(text)
            new = text.to_pylist()
            for i, each in enumerate(spans):
                if each and new[i] is not None:
                    first, last = found.rows[i], found.rows[i + 1]
                    kept, reach = [], begin[i]
                    for span in each:
                        a, b = first + span["start"], min(first + span["end"], last)
                        if a < b:
                            kept.append(data[reach : found.starts[a]].tobytes())
                            reach = found.ends[b - 1]
                    new[i] = (b"".join(kept) + data[reach : begin[i + 1]].tobytes()).decode()
            out = [pa.array(new, text.type) if k == at else part.column(f"d{k}") for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(out, names=[f"d{k}" for k in range(len(columns))])

    return joined.mapInArrow(cut, plain.schema).toDF(*columns)
