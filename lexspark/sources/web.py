"""Paged and single-file HTTP sources. Requests go through a function that a caller may replace, so
that tests need no network; each task keeps its own pace."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_SIZE, SMALL_PAGE, RETRIES = 200, 50, 3


def post(url: str, body: dict, timeout: float = 30.0) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def with_retry(call: Callable[[], object], retries: int = RETRIES, pause: float = 1.0) -> object:
    """The call's result; waits longer before each further try; a 404 gives None."""
    for k in range(retries):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            error = e
        except OSError as e:
            error = e
        time.sleep(pause * 2**k)
    raise error


class Pages(InputPartition):
    def __init__(self, start: int, length: int):
        self.start, self.length = start, length


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable[[str, dict], dict]):
        self.url, self.type, self.fetch = options["url"], int(options.get("type", 1)), fetch
        self.size, self.pause = int(options.get("pageSize", PAGE_SIZE)), float(options.get("pause", 1.0))

    def page(self, start: int, length: int) -> dict:
        return with_retry(lambda: self.fetch(self.url, {"mevzuatTur": self.type, "start": start, "length": length}), pause=self.pause) or {"data": [], "total": 0}

    def partitions(self) -> list[Pages]:
        total = int(self.page(0, 1).get("total", 0))
        return [Pages(s, min(self.size, total - s)) for s in range(0, total, self.size)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        try:
            pages = [self.page(partition.start, partition.length)]
        except OSError:  # a page that keeps failing is asked for in smaller ones
            steps = range(partition.start, partition.start + partition.length, SMALL_PAGE)
            pages = [self.page(s, min(SMALL_PAGE, partition.start + partition.length - s)) for s in steps]
        for page in pages:
            for record in page["data"]:
                yield (json.dumps(record, ensure_ascii=False),)


class PagedSource(DataSource):
    """spark.read.format("paged").option("url", ...).option("type", ...): a record of JSON text per
    row, one task per page."""

    fetch = staticmethod(post)

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema: object) -> DataSourceReader:
        return PagedReader(self.options, type(self).fetch)


def download(url: str) -> bytes | None:
    def call() -> bytes:
        with urllib.request.urlopen(url, timeout=30) as reply:
            return reply.read()

    return with_retry(call)


def files(urls: DataFrame, fetch: Callable[[str], bytes | None] = download, tasks: int = 4, pause: float = 2.0) -> DataFrame:
    """(url, content) of urls(url), null where there is no file. As many requests run at once as
    there are tasks, each waiting between its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = []
            for url in batch.column(0).to_pylist():
                contents.append(fetch(url))
                time.sleep(pause)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], ["url", "content"])

    return urls.select("url").distinct().repartition(tasks).mapInArrow(run, "url string, content binary")
