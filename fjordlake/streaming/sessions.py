"""Sessions, debouncing, throttling and refresh on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sinks.versions import Versions


def drag_sessions(events: DataFrame, gap: str, late: str, by: str = "user_id", time: str = "ts") -> DataFrame:
    """Sessions that end after a gap without events, with their last event: one row each once the watermark has passed it."""
    marked = events.withWatermark(time, late)
    grouped = marked.groupBy(by, F.session_window(time, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("event_id", F.struct(time, "event_id")).alias("last_event")
    )
    return grouped.select(by, F.col("w.start").alias("first_ts"), F.col("w.end").alias("end_ts"), "n", "last_event")


def throttle(events: DataFrame, limit_ms: int, by: str = "user_id", time: str = "ts", value: str = "value") -> DataFrame:
    """``by, emitted_ms, value``: at most one a ``limit_ms`` of event time, the first at once, the last when its wait is over.

    The state of a key is when it may emit next and the value that waits. A
    waiting value comes out with the next event of its key, or when the
    watermark passes the time it is due.
    """
    state = "due long, waiting double, waits boolean"
    kind = events.schema[by].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        due, waiting, waits = held.get if held.exists else (None, 0.0, False)
        out: list[tuple[int, float]] = []
        if held.hasTimedOut:
            held.remove()
            if waits:
                yield pd.DataFrame([(key[0], due, waiting)], columns=[by, "emitted_ms", value])
            return
        rows = pd.concat(list(frames)).sort_values(time)
        at = rows[time].astype("datetime64[us]").astype("int64").to_numpy() // 1000
        for now, x in zip(at.tolist(), rows[value].tolist()):
            if due is not None and now >= due:
                if waits:
                    out.append((due, waiting))
                    due, waits = due + limit_ms, False
                if now >= due:
                    due = None
            if due is None:
                out.append((now, x))
                due = now + limit_ms
            else:
                waiting, waits = x, True
        held.update((due, waiting, waits))
        held.setTimeoutTimestamp(max(due, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=[by, "emitted_ms", value])

    return events.groupBy(by).applyInPandasWithState(
        step, f"`{by}` {kind}, emitted_ms long, `{value}` double", state, "append", GroupStateTimeout.EventTimeTimeout
    )


def keep_fresh(updates: DataFrame, path: str, checkpoint: str, keep: int = 2) -> StreamingQuery:
    """A new version of a table for each batch of newly arrived files that has rows.

    The version counts after its write, so readers that are open keep theirs
    and later ones see the newest document: :class:`~fjordlake.sinks.versions.Versions`.
    """

    def refresh(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            versions = Versions(batch.sparkSession, path)
            versions.write(batch)
            versions.clear(keep)

    return updates.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
