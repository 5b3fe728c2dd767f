"""Ordered scans of a key's rows, whose state at a row depends on all rows before it, in chunks.

The rows of a key are cut into chunks of their order. Each chunk gives a
transfer function: the state that it would leave for any state that it is
entered with. A second pass goes through the functions of a key, not through
its rows, and gives each chunk its state; then chunks run side by side. So a
key with a third of all rows is worked on by many tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import sorted_ranges


def chunked_scan(
    rows: DataFrame,
    by: str,
    order: Sequence[str],
    summary: Callable[[pa.Table], Any],
    follow: Callable[[Any, Any], Any],
    apply: Callable[[pa.Table, Any, Any], pa.Table],
    schema: T.StructType,
    chunk_bits: int = 15,
) -> DataFrame:
    """``apply(chunk, state, next summary)`` for each chunk of at most ``2 ** chunk_bits`` rows of each key.

    ``summary`` makes a chunk's transfer function, ``follow`` evaluates it;
    the first chunk of a key is entered with None. Summaries of a key meet in
    one task, so they should be small beside their chunks.
    """
    ordered = sorted_ranges(rows, by, *order, name="scan").withColumn("__chunk", F.shiftright("__at", chunk_bits))
    chunks = ordered.drop("__range").groupBy(by, "__chunk")

    def summarise(key: tuple[pa.Scalar, ...], chunk: pa.Table) -> pa.Table:
        made = pickle.dumps(summary(chunk.sort_by("__at")))
        return pa.table({by: [key[0].as_py()], "__chunk": [key[1].as_py()], "__made": pa.array([made], pa.binary())}, schema=arrow)

    kind = T.StructType([rows.schema[by], T.StructField("__chunk", T.LongType()), T.StructField("__made", T.BinaryType())])
    arrow = pa.schema([(by, _arrow(rows.schema[by].dataType)), ("__chunk", pa.int64()), ("__made", pa.binary())])

    def enter(key: tuple[pa.Scalar, ...], made: pa.Table) -> pa.Table:
        made = made.sort_by("__chunk")
        functions = [pickle.loads(m) for m in made["__made"].to_pylist()]
        state, out = None, []
        for k, function in enumerate(functions):
            out.append(pickle.dumps((state, functions[k + 1] if k + 1 < len(functions) else None)))
            state = follow(function, state)
        return pa.table([made[by], made["__chunk"], pa.array(out, pa.binary())], schema=arrow)

    entered = chunks.applyInArrow(summarise, kind).groupBy(by).applyInArrow(enter, kind)

    def run(key: tuple[pa.Scalar, ...], chunk: pa.Table, entry: pa.Table) -> pa.Table:
        return apply(chunk.sort_by("__at"), *pickle.loads(entry["__made"][0].as_py()))

    return chunks.cogroup(entered.groupBy(by, "__chunk")).applyInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _first(start: int, end: int, test: Callable[[slice], np.ndarray]) -> int:
    """The first place from ``start`` on where the test holds, ``end`` if there is none; looks at ever longer slices."""
    size = 16
    while start < end:
        hits = np.flatnonzero(test(slice(start, min(end, start + size))))
        if len(hits):
            return start + int(hits[0])
        start, size = start + size, 2 * size
    return end


class _Near:
    """Rows whose value is near the last accepted one."""

    def __init__(self, value: str, largest: float, least: float) -> None:
        self.value, self.largest, self.least = value, largest, least

    def near(self, x: np.ndarray, last: float) -> np.ndarray:
        away = np.abs(x - last)
        return (away >= self.least) & (away <= self.largest)

    def values(self, chunk: pa.Table) -> np.ndarray:
        return chunk[self.value].cast(pa.float64()).to_numpy(zero_copy_only=False)

    def chain(self, x: np.ndarray, start: int) -> list[int]:
        """The rows that are accepted from an accepted one on."""
        out = []
        while start < len(x):
            out.append(start)
            last = x[start]
            start = _first(start + 1, len(x), lambda s: self.near(x[s], last))
        return out

    def summary(self, chunk: pa.Table) -> tuple[float, list[tuple[float, float]]]:
        """The state left if the first row is accepted; values, in order, that could be the first accepted, with the state each leaves.

        A value is left out if every state near it is near an earlier one, by a margin beyond rounding.
        """
        x = self.values(chunk)
        left: dict[int, float] = {}

        def leaves(start: int) -> float:
            path = []
            while start < len(x) and start not in left:
                path.append(start)
                last = x[start]
                start = _first(start + 1, len(x), lambda s: self.near(x[s], last))
            end = left[start] if start < len(x) else x[path[-1]]
            left.update(dict.fromkeys(path, end))
            return end

        first, open_ = [], [(-np.inf, np.inf)]
        finite = x[~np.isnan(x)]
        low, high = (finite.min() - self.largest, finite.max() + self.largest) if len(finite) else (0.0, 0.0)
        margin = 1e-9 * (1 + max(abs(low), abs(high)))
        for j, v in enumerate(x.tolist()):
            if np.isnan(v):
                continue
            near = [(v - self.largest, v + self.largest)] if self.least <= 0 else [(v - self.largest, v - self.least), (v + self.least, v + self.largest)]
            if any(a <= d + margin and c - margin <= b for a, b in open_ for c, d in near):
                first.append((v, leaves(j)))
                for c, d in near:
                    open_ = [p for a, b in open_ for p in ((a, min(b, c + margin)), (max(a, d - margin), b)) if p[0] <= p[1]]
                if not any(a <= high and low <= b for a, b in open_):
                    break
        return leaves(0), first

    def follow(self, made: tuple[float, list[tuple[float, float]]], state: float | None) -> float:
        if state is None:
            return made[0]
        values = np.array([v for v, _ in made[1]])
        hit = np.flatnonzero(self.near(values, state)) if len(values) else []
        return made[1][int(hit[0])][1] if len(hit) else state

    def apply(self, chunk: pa.Table, state: float | None, after: Any) -> pa.Table:
        x = self.values(chunk)
        start = 0 if state is None else _first(0, len(x), lambda s: self.near(x[s], state))
        return chunk.drop_columns(["__at", "__chunk"]).take(pa.array(self.chain(x, start), pa.int64()))


def accepted_changes(rows: DataFrame, by: str, value: str, order: list[str], largest: float, least: float = 0.0, chunk_bits: int = 15) -> DataFrame:
    """Rows whose value is within ``largest`` (and not below ``least``) of the last accepted one of its key; the first is accepted.

    A null value is near nothing; as first row it is accepted and nothing after it.
    """
    how = _Near(value, largest, least)
    return chunked_scan(rows, by, order, how.summary, how.follow, how.apply, rows.schema, chunk_bits)


class _Throttle:
    """Leading and trailing throttle, by the phases of its windows.

    From a row that passes at once windows of ``limit`` follow each other,
    and the last row of a window passes at its end, until a window is empty;
    the next row passes at once again. That can only happen at a gap of more
    than ``limit``, surely at one of twice that, else if a window of the
    present phase fits in; and right after a row that passed at once.
    """

    def __init__(self, time: str, limit: int) -> None:
        self.time, self.limit = time, limit

    def times(self, chunk: pa.Table) -> np.ndarray:
        return chunk[self.time].cast(pa.timestamp("us")).cast(pa.int64()).to_numpy() // 1000

    def end(self, phase, at):
        """The end of the window that a time is in."""
        return at + self.limit - (at - phase) % self.limit

    def fits(self, phase, before, at):
        """Whether a window after that of ``before`` is over at ``at``."""
        return self.end(phase, before) + self.limit <= at

    def lead(self, t: np.ndarray, gaps: np.ndarray, start: int, phase: int) -> int:
        """The first of the rows with a gap before them, from ``gaps[start]`` on, that passes at once."""
        k = _first(start, len(gaps), lambda s: self.fits(phase, t[gaps[s] - 1], t[gaps[s]]))
        return int(gaps[k]) if k < len(gaps) else len(t)

    def next_lead(self, t: np.ndarray, gaps: np.ndarray, i: int) -> int:
        if i + 1 < len(t) and t[i + 1] - t[i] >= self.limit:
            return i + 1
        return self.lead(t, gaps, int(np.searchsorted(gaps, i + 2)), int(t[i]))

    def summary(self, chunk: pa.Table):
        """First and last time; phase and whether the last row passed at once, if the first does; and what each gap leaves."""
        t = self.times(chunk)
        gaps = np.flatnonzero(np.diff(t) > self.limit) + 1
        left: dict[int, tuple[int, bool]] = {}

        def leaves(i: int) -> tuple[int, bool]:
            path = []
            while i < len(t) and i not in left:
                path.append(i)
                i = self.next_lead(t, gaps, i)
            end = left[i] if i < len(t) else (int(t[path[-1]]), path[-1] == len(t) - 1)
            left.update(dict.fromkeys(path, end))
            return end

        sure = np.flatnonzero(t[gaps] - t[gaps - 1] >= 2 * self.limit)
        some = gaps[: int(sure[0]) + 1] if len(sure) else gaps
        parts = [(int(t[g - 1]), int(t[g]), leaves(int(g))) for g in some]
        return int(t[0]), int(t[-1]), leaves(0), parts

    def leads(self, first: int, state) -> bool:
        if state is None:
            return True
        phase, alone, last = state
        return first - last >= self.limit if alone else self.fits(phase, last, first)

    def follow(self, made, state):
        first, last, led, parts = made
        if self.leads(first, state):
            return *led, last
        for before, at, out in parts:
            if self.fits(state[0], before, at):
                return *out, last
        return state[0], False, last

    def apply(self, chunk: pa.Table, state, after) -> pa.Table:
        t = self.times(chunk)
        gaps = np.flatnonzero(np.diff(t) > self.limit) + 1
        i = 0 if self.leads(int(t[0]), state) else self.lead(t, gaps, 0, state[0])
        leads = []
        while i < len(t):
            leads.append(i)
            i = self.next_lead(t, gaps, i)
        led = np.zeros(len(t), bool)
        led[leads] = True
        run = np.cumsum(led)
        phase = np.r_[0 if state is None else state[0], t[leads]].astype(np.int64)[run]
        following = np.r_[t[1:], np.iinfo(np.int64).max if after is None else after[0]]
        due = self.end(phase, t)
        passes = led | (following >= due)
        kept = chunk.drop_columns(["__at", "__chunk"]).filter(pa.array(passes))
        return kept.append_column("emitted_ms", pa.array(np.where(led, t, due)[passes]))


def throttled(
    rows: DataFrame, by: str, limit_ms: int, time: str = "ts", order: tuple[str, ...] = ("ts", "event_id"), chunk_bits: int = 15
) -> DataFrame:
    """Rows that a throttle passes: at most one in ``limit_ms``, the first at once and the last of a burst at its end."""
    how = _Throttle(time, limit_ms)
    schema = T.StructType([*rows.schema.fields, T.StructField("emitted_ms", T.LongType())])
    return chunked_scan(rows, by, order, how.summary, how.follow, how.apply, schema, chunk_bits)
