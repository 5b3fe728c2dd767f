"""A typed scan of coverages: a partition for each cube or position, with filters in its requests."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual

from .rest import address

_COLUMNS = [("parameter", pa.string()), ("place", pa.string()), ("lat", pa.float64()), ("lon", pa.float64()), ("time_str", pa.string()), ("value", pa.float64())]
_SCHEMA = pa.schema(_COLUMNS)
_ROWS = 20_000


class Coverages(DataSource):
    """Rows ``parameter, place, lat, lon, time_str, value`` of CoverageJSON documents.

    ``base`` is an address (http, https), to which the request is added, or a
    folder of a store that Arrow can reach, with a folder of documents, a
    line each, for every request: ``cube/<parameters>``, joined by ``+``, or
    ``position/<name>``.

    ``kind`` is ``cube``, with ``parameters`` (a line each) in batches of
    ``batchSize`` and an optional ``box`` (west, south, east, north), or
    ``position``, with ``places``, a line ``name lat lon`` each. ``mode``
    ``strict`` raises for a request that fails or whose values are not as
    many as its axes say, ``skip`` leaves the request out. ``extra`` is added
    to addresses (a line ``key=value`` each); ``pauseMs`` waits before each
    request of a partition.

    With ``pushdown`` (and Spark's
    ``spark.sql.python.filterPushdown.enabled``) filters on ``parameter`` and
    ``place`` leave requests out, and ``lat`` and ``lon`` bounds narrow the
    box of a cube's request and leave positions out. Nulls inside the values
    are rows with a null value.
    """

    @classmethod
    def name(cls) -> str:
        return "coverages"

    def schema(self) -> str:
        return "parameter string, place string, lat double, lon double, time_str string, value double"

    def reader(self, schema) -> DataSourceReader:
        kind = _FilteredReader if self.options.get("pushdown", "false") == "true" else _Reader
        return kind(dict(self.options))


@dataclass
class Request(InputPartition):
    kind: str
    parameters: list[str]
    place: str | None = None
    lat: float | None = None
    lon: float | None = None
    box: list[float] | None = None


@dataclass
class _Bounds:
    """What filters leave of parameters, places and the plane."""

    names: dict[str, set[str] | None] = field(default_factory=lambda: {"parameter": None, "place": None})
    low: dict[str, float] = field(default_factory=lambda: {"lat": -math.inf, "lon": -math.inf})
    high: dict[str, float] = field(default_factory=lambda: {"lat": math.inf, "lon": math.inf})

    def has(self, column: str, name: str | None) -> bool:
        wanted = self.names[column]
        return wanted is None or name in wanted

    def holds(self, lat: float, lon: float) -> bool:
        return all(self.low[c] <= x <= self.high[c] for c, x in (("lat", lat), ("lon", lon)))

    def narrowed(self, box: list[float]) -> list[float]:
        west, south, east, north = box
        return [max(west, self.low["lon"]), max(south, self.low["lat"]), min(east, self.high["lon"]), min(north, self.high["lat"])]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        lower = {k.lower(): v for k, v in options.items()}
        lines = lambda name: [x.strip() for x in lower.get(name, "").splitlines() if x.strip()]
        self.base, self.kind = lower["base"].rstrip("/"), lower.get("kind", "cube")
        self.parameters, self.size = lines("parameters"), int(lower.get("batchsize", 2))
        self.places = [(" ".join(p[:-2]), float(p[-2]), float(p[-1])) for p in map(str.split, lines("places"))]
        self.box = [float(x) for x in lower["box"].split(",")] if "box" in lower else None
        self.strict = lower.get("mode", "strict") == "strict"
        self.extra = dict(x.split("=", 1) for x in lines("extra"))
        self.pause = float(lower.get("pausems", 0)) / 1000
        self.bounds = _Bounds()

    def partitions(self) -> list[InputPartition]:
        if self.kind == "position":
            wanted = [p for p in self.places if self.bounds.has("place", p[0]) and self.bounds.holds(*p[1:])]
            return [Request("position", self.parameters, *p) for p in wanted]
        batches = [self.parameters[i : i + self.size] for i in range(0, len(self.parameters), self.size)]
        box = self.bounds.narrowed(self.box) if self.box else None
        if not self.bounds.has("place", None) or (box and (box[0] > box[2] or box[1] > box[3])):
            return []
        return [Request("cube", b, box=box) for b in batches if any(self.bounds.has("parameter", p) for p in b)]

    def location(self, request: Request) -> str:
        if self.base.startswith(("http://", "https://")):
            place = {"coords": f"POINT({request.lon} {request.lat})"} if request.kind == "position" else {"bbox": ",".join(map(str, request.box or []))}
            return address(f"{self.base}/{request.kind}", **place, **{"parameter-name": ",".join(request.parameters)}, **self.extra)
        return f"{request.kind}/{request.place if request.kind == 'position' else '+'.join(request.parameters)}"

    def documents(self, where: str) -> Iterator[dict]:
        if where.startswith(("http://", "https://")):
            from urllib.request import urlopen

            with urlopen(where, timeout=60) as answer:
                yield json.loads(answer.read())
            return
        files, root = self.store
        found = [f for f in files.get_file_info(fs.FileSelector(f"{root}/{where}")) if f.type == fs.FileType.File and ".json" in f.base_name and f.base_name[0] not in "._"]
        for f in sorted(found, key=lambda f: f.path):
            with files.open_input_stream(f.path) as stream:
                yield from map(json.loads, filter(None, stream.read().decode().split("\n")))

    def read(self, request: Request | None) -> Iterator[pa.RecordBatch]:
        if request is None:
            return
        time.sleep(self.pause)
        self.store = None if self.base.startswith(("http://", "https://")) else fs.FileSystem.from_uri(self.base)
        try:
            tables = [t for d in self.documents(self.location(request)) for t in self.rows(request, d)]
        except (OSError, ValueError, KeyError, TypeError):
            if self.strict:
                raise
            return
        for table in tables:
            yield from table.to_batches(max_chunksize=_ROWS)

    def rows(self, request: Request, document: dict) -> Iterator[pa.Table]:
        axes, ranges = document["domain"]["axes"], document["ranges"]
        times = axes["t"]["values"]
        if request.kind == "position":
            ys, xs = [request.lat], [request.lon]
        else:
            ys, xs = (_axis(axes, n, o) for n, o in (("y", "lat"), ("x", "lon")))
        n = len(times) * len(ys) * len(xs)
        for name in request.parameters:
            if name not in ranges or not self.bounds.has("parameter", name):
                continue
            values = pa.array(ranges[name]["values"], pa.float64())
            if len(values) != n or not n:
                raise ValueError(f"{name} has {len(values)} values for {n} places and times")
            lat = pa.array([y for _ in times for y in ys for _ in xs], pa.float64())
            lon = pa.array([x for _ in times for _ in ys for x in xs], pa.float64())
            when = pa.array([t for t in times for _ in range(len(ys) * len(xs))], pa.string())
            same = [pa.repeat(pa.scalar(v, pa.string()), n) for v in (name, request.place)]
            yield pa.table([*same, lat, lon, when, values], schema=_SCHEMA)


def _axis(axes: dict, name: str, other: str) -> list[float]:
    a = axes.get(name) or {}
    if a.get("start") is not None and a.get("num"):
        step = (a["stop"] - a["start"]) / (a["num"] - 1) if a["num"] > 1 else 0.0
        return [a["start"] + i * step for i in range(a["num"])]
    return a["values"] if a.get("values") else axes[other]["values"]


class _FilteredReader(_Reader):
    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, EqualTo | In) and column in self.bounds.names:
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                known = self.bounds.names[column]
                self.bounds.names[column] = wanted if known is None else known & wanted
                continue
            elif isinstance(f, GreaterThanOrEqual) and column in self.bounds.low:
                self.bounds.low[column] = max(self.bounds.low[column], f.value)
            elif isinstance(f, LessThanOrEqual) and column in self.bounds.high:
                self.bounds.high[column] = min(self.bounds.high[column], f.value)
            yield f  # bounds narrow a request, which may answer with more: Spark tests every row again
