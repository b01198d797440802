"""Paged sources as Spark data sources: one partition a page, with proof that the snapshot is whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from flowspark.sources.saved import saved

#: (page from 1, size) -> {"total": items in all, or None, "list": the page's items as dicts}
Fetch = Callable[[int, int], dict]


class IncompleteError(ValueError):
    """The pages don't make up one whole snapshot."""


@dataclass
class Page(InputPartition):
    """Items ``first`` to ``stop`` of page ``number``; ``total`` as planned, or None where the source doesn't tell."""

    number: int
    total: int | None
    first: int = 0
    stop: int | None = None


def _items(got: dict, key: str) -> list[dict]:
    items = got.get("list") if isinstance(got, dict) else None
    if not isinstance(items, list):
        raise IncompleteError("a page has no list")
    ids = [i.get(key) if isinstance(i, dict) else None for i in items]
    if any(i is None or i == "" for i in ids):
        raise IncompleteError("an item has no id")
    if len(set(ids)) < len(ids):
        raise IncompleteError("an id comes twice in a page")
    return items


def _total(got: dict) -> int | None:
    total = got.get("total") if isinstance(got, dict) else None
    if total is not None and (isinstance(total, bool) or not str(total).isdigit()):
        raise IncompleteError(f"a total of {total!r}")
    return None if total is None else int(total)


def _whole(fetch: Fetch, page: int, size: int, total: int, key: str, growing: bool = False) -> list[dict]:
    """The items of a page of a source of ``total`` items; of one that grows, at least those it had then."""
    got = fetch(page, size)
    now = _total(got)
    if now is None or now < total or now != total and not growing:
        raise IncompleteError(f"the total changed from {total} to {now}")
    items = _items(got, key)
    due = min(size, total - (page - 1) * size)
    if len(items) < due or len(items) > (size if growing else due):
        raise IncompleteError(f"page {page} has {len(items)} items in place of {due}")
    return items


class _Pages(DataSourceReader):
    def __init__(self, fetch: Fetch, schema: StructType, size: int, key: str):
        self.fetch, self.names, self.size, self.key = fetch, schema.fieldNames(), size, key

    def partitions(self) -> list[Page]:
        total = _total(self.fetch(1, self.size))
        return [Page(1, None)] if total is None else [Page(k + 1, total) for k in range(max(1, -(-total // self.size)))]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition.total is not None:
            items = _whole(self.fetch, partition.number, self.size, partition.total, self.key)
        else:
            items = self._untold()
        for item in items:
            yield tuple(item.get(n) for n in self.names)

    def _untold(self) -> Iterator[dict]:
        """Of a source without a total: page by page to the first that isn't full."""
        page = 1
        while True:
            got = self.fetch(page, self.size)
            if _total(got) is not None:
                raise IncompleteError("a total came later")
            items = _items(got, self.key)
            yield from items
            if len(items) < self.size:
                return
            page += 1


class _NewItems(DataSourceStreamReader):
    """Items that a growing source appends; the offset is how many there are."""

    def __init__(self, fetch: Fetch, schema: StructType, size: int, key: str):
        self.fetch, self.names, self.size, self.key = fetch, schema.fieldNames(), size, key

    def initialOffset(self) -> dict:
        return {"items": 0}

    def latestOffset(self) -> dict:
        total = _total(self.fetch(1, self.size))
        if total is None:
            raise IncompleteError("a stream needs totals")
        return {"items": total}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        a, b, n = start["items"], end["items"], self.size
        if b < a:
            raise IncompleteError(f"the total fell from {a} to {b}")
        return [Page(k + 1, b, max(0, a - k * n), min(n, b - k * n)) for k in range(a // n, -(-b // n))] if b > a else []

    def read(self, partition: Page) -> Iterator[tuple]:
        items = _whole(self.fetch, partition.number, self.size, partition.total, self.key, growing=True)
        for item in items[partition.first : partition.stop]:
            yield tuple(item.get(n) for n in self.names)

    def commit(self, end: dict) -> None:
        pass


def paged_source(fetch: Fetch, schema: str | StructType, size: int = 100, key: str = "id", name: str = "paged") -> type[DataSource]:
    """A data source class over ``fetch``, for ``spark.dataSource.register``; it reads in batch and as a stream."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return kind

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Pages(fetch, schema, size, key)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return _NewItems(fetch, schema, size, key)

    return Paged


def read_paged(spark: SparkSession, fetch: Fetch, schema: str | StructType, size: int = 100, key: str = "id") -> DataFrame:
    """All items of a paged source, or an error: a snapshot is whole or it isn't taken.

    Each task proves its own page: the total as planned, as many items as are due, an id each. The pages are kept in the
    shared folder, fetched once, and no id may come twice in all of them. A source without totals is read by one task.
    """
    spark.dataSource.register(paged_source(fetch, schema, size, key))
    whole = saved(spark.read.format("paged").load())
    twice = whole.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise IncompleteError(f"ids come twice, such as {[r[0] for r in twice]}")
    return whole
