"""A data source for paged collections (one JSON file or reply a page, each naming the next)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Waits between tries after a reply that asks to come back later, in seconds.
WAITS = (0.5, 1.0, 2.0)
LONGEST_WAIT = 10.0


class RetryLater(Exception):
    """A page could not be had now; ``after`` says in how many seconds."""

    def __init__(self, after: float | None = None) -> None:
        super().__init__("retry later")
        self.after = after


def fetched(get: Callable[[str], dict], page: str, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A page with bounded retries; a wait beyond ``LONGEST_WAIT`` is an error at once."""
    for wait in (*WAITS, None):
        try:
            return get(page)
        except RetryLater as e:
            if wait is None or (e.after or 0) > LONGEST_WAIT:
                raise
            sleep(e.after if e.after is not None else wait)
    raise AssertionError


def pages(get: Callable[[str], dict], first: str, most: int | None = None) -> Iterator[dict]:
    """Items of all pages from ``first`` on, at most ``most``; a page that comes again ends the walk."""
    page, seen, n = first, set(), 0
    while page and page not in seen:
        seen.add(page)
        reply = fetched(get, page)
        for item in reply.get("items", []):
            if most is not None and n >= most:
                return
            n += 1
            yield item
        page = reply.get("next")


class _Collection(InputPartition):
    def __init__(self, folder: str) -> None:
        self.folder = folder


class PagedReader(DataSourceReader):
    """One partition for each collection; the pages of a collection depend on each other."""

    def __init__(self, options: dict) -> None:
        self.root = unquote(urlparse(options["path"]).path)
        self.most = int(options["maxitems"]) if "maxitems" in options else None

    def partitions(self) -> list[InputPartition]:
        return [_Collection(str(p)) for p in sorted(Path(self.root).iterdir()) if p.is_dir()] or [_Collection("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.folder:
            return
        folder = Path(partition.folder)
        get = lambda page: json.loads((folder / f"{page}.json").read_text(encoding="utf-8"))
        for item in pages(get, "1", self.most):
            yield folder.name, str(item.get("id")), item.get("parent"), item.get("author"), item.get("text"), item.get("at"), item.get("likes")


class PagedSource(DataSource):
    """``spark.read.format("paged").option("maxItems", n).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "collection string, id string, parent string, author string, text string, at string, likes bigint"

    def reader(self, schema) -> PagedReader:
        return PagedReader({k.lower(): v for k, v in dict(self.options).items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
