"""A data source that reads JSON documents by address, one partition each."""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def address(base: str, **parameters: object) -> str:
    """An address with its query; empty parameters are left out."""
    return f"{base}?{urlencode({k: v for k, v in parameters.items() if v not in (None, '')})}"


def redacted(url: str, key: str = "api-key") -> str:
    """An address for logs, without the value of its key."""
    head, found, tail = url.partition(f"{key}=")
    return head + found + "***" + tail[tail.find("&") :] * ("&" in tail) if found else url


class JsonDocuments(DataSource):
    """Rows ``url, body`` of the addresses in option ``urls`` (a line each).

    Option ``onError`` is ``fail`` or ``skip``; ``pauseMs`` waits before each
    address of a partition; ``partitions`` groups the addresses.
    """

    @classmethod
    def name(cls) -> str:
        return "json_documents"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Group(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in options.get("urls", "").splitlines() if u.strip()]
        self.skip = options.get("onerror", options.get("onError", "fail")) == "skip"
        self.pause = float(options.get("pausems", options.get("pauseMs", 0))) / 1000
        self.groups = int(options.get("partitions", len(self.urls) or 1))

    def partitions(self) -> list[InputPartition]:
        return [_Group(self.urls[i :: self.groups]) for i in range(min(self.groups, len(self.urls)) or 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        from urllib.request import urlopen

        for url in partition.urls:
            time.sleep(self.pause)
            try:
                with urlopen(url, timeout=60) as answer:
                    yield url, answer.read().decode("utf-8")
            except OSError:
                if not self.skip:
                    raise
