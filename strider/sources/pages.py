"""A paged data set as a Spark data source: one input partition for each page.

spark.dataSource.register(PagedSource)
spark.read.format("paged").option("path", folder).option("rows", 1000).option("page", 200).load()

Pages come from a reader class; the bundled one reads page files (offset.json) of a folder, a
stand-in for a service. A page that fails is Spark's task retry; a count that disagrees fails.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition


class PageSpan(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows, self.page = options["path"], int(options["rows"]), int(options.get("page", 1000))

    def partitions(self) -> list[PageSpan]:
        return [PageSpan(o, min(self.page, self.rows - o)) for o in range(0, self.rows, self.page)]

    def read(self, partition: PageSpan) -> Iterator[tuple]:
        with open(os.path.join(self.path, f"{partition.offset}.json"), encoding="utf-8") as f:
            rows = json.load(f)
        if len(rows) != partition.limit:
            raise ValueError(f"page at {partition.offset} has {len(rows)} rows, {partition.limit} were promised")
        for r in rows:
            yield r["id"], json.dumps(r, sort_keys=True)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, body string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


class KeySpan(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


class KeyedReader(DataSourceReader):
    """Looks up rows by key: an equality or a list of ids in the filter becomes the requests, `batch` keys each."""

    def __init__(self, options: dict):
        self.path, self.batch, self.keys = options["path"], int(options.get("batch", 200)), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("id",) and isinstance(f, (EqualTo, In)):
                found = {str(v) for v in ((f.value,) if isinstance(f, EqualTo) else f.value) if v is not None}
                self.keys = found if self.keys is None else self.keys & found
            else:
                yield f

    def partitions(self) -> list[KeySpan]:
        if self.keys is None:
            raise ValueError("a lookup needs ids: filter by id, with spark.sql.python.filterPushdown.enabled")
        keys = sorted(self.keys)
        return [KeySpan(keys[i : i + self.batch]) for i in range(0, len(keys), self.batch)] or [KeySpan([])]

    def read(self, partition: KeySpan) -> Iterator[tuple]:
        for key in partition.keys:
            file = os.path.join(self.path, f"{key}.json")
            if os.path.exists(file):
                with open(file, encoding="utf-8") as f:
                    for row in json.load(f):
                        yield key, json.dumps(row, sort_keys=True)


class KeyedSource(DataSource):
    """spark.read.format("keyed").option("path", folder).load().where(col("id").isin(keys)): a file of rows for each key,
    a stand-in for a service that answers `field in (...)`. Keys without a file have no rows. Load anew for each lookup:
    Spark plans the scan of a loaded frame once, with the ids of its first filter."""

    @classmethod
    def name(cls) -> str:
        return "keyed"

    def schema(self) -> str:
        return "id string, body string"

    def reader(self, schema) -> KeyedReader:
        return KeyedReader(self.options)
