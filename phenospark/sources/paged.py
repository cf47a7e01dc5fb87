"""Tables behind a paged service, as a data source of Spark: a page is a partition.

A page is fetched once. It is written under another name, with its checksum beside it, and gets its
own name when it is whole; what was there and is whole is not fetched again. So a pull that
was stopped, or a task that runs twice, goes on with what is missing.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from http.client import HTTPException

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class Pages:
    """``url`` has {limit} and {offset}; ``folder`` is a URI that driver and executors share."""

    url: str
    folder: str
    page: int = 25_000
    retries: int = 3
    wait: float = 2.0
    timeout: float = 120.0

    def _at(self, offset: int) -> tuple[pafs.FileSystem, str]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        return fs, f"{root}/page-{self.page}-{offset:012d}.csv"

    def stored(self, offset: int) -> bytes | None:
        """The page, if it is there and is what was written."""
        fs, path = self._at(offset)
        have = fs.get_file_info([path, f"{path}.json"])
        if any(f.type != pafs.FileType.File for f in have):
            return None
        with fs.open_input_stream(f"{path}.json") as f:
            try:
                want = json.loads(f.read())
            except ValueError:
                return None
        with fs.open_input_stream(path) as f:
            data = f.read()
        return data if want.get("sha256") == hashlib.sha256(data).hexdigest() else None

    def _store(self, offset: int, data: bytes) -> None:
        fs, path = self._at(offset)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        making = f"{path}.{uuid.uuid4().hex}.partial"
        for name, content in ((f"{path}.json", json.dumps({"sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data)}).encode()), (path, data)):
            with fs.open_output_stream(making) as f:
                f.write(content)
            fs.move(making, name)

    def get(self, offset: int, least: int = 0) -> list[dict[str, str]]:
        """The rows of the page at ``offset``. One with fewer than ``least`` rows stopped short; such pages and
        failed requests are tried again, with longer and longer pauses."""
        data = self.stored(offset)
        if data is not None and len(rows := _rows(data)) >= least:
            return rows
        why: Exception | None = None
        for attempt in range(self.retries + 1):
            if attempt:
                time.sleep(self.wait * 2 ** (attempt - 1))
            try:
                request = urllib.request.Request(self.url.format(limit=self.page, offset=offset), headers={"Accept": "text/csv"})
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    data = reply.read()  # an error if it is shorter than announced
                rows = _rows(data)
                if len(rows) < least:
                    raise ValueError(f"{len(rows)} rows instead of {least}")
                self._store(offset, data)
                return rows
            except (urllib.error.URLError, HTTPException, OSError, ValueError, csv.Error) as e:
                why = e
        raise RuntimeError(f"page at {offset} of {self.url} could not be fetched: {why}")

    def count(self) -> int:
        """How many rows there are: pages are tried at doubling distances, then halving ones. They are stored."""
        full = lambda k: len(self.get(k * self.page)) >= self.page
        high = 1
        while full(high - 1):
            high *= 2
        low = high // 2  # pages before it are full, page high - 1 is not
        while low < high - 1:
            mid = (low + high) // 2
            low, high = (mid, high) if full(mid - 1) else (low, mid)
        last = high - 1
        return last * self.page + len(self.get(last * self.page))


def _rows(data: bytes) -> list[dict[str, str]]:
    return list(csv.DictReader(io.StringIO(data.decode("utf-8"))))


class _Page(InputPartition):
    def __init__(self, offset: int, rows: int):
        super().__init__(offset)
        self.offset, self.rows = offset, rows


class _Reader(DataSourceReader):
    def __init__(self, pages: Pages, columns: list[str], total: int | None):
        self.pages, self.columns, self.total = pages, columns, total

    def partitions(self) -> list[_Page]:
        total = self.pages.count() if self.total is None else self.total
        return [_Page(o, min(self.pages.page, total - o)) for o in range(0, total, self.pages.page)] or [_Page(0, 0)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for row in self.pages.get(partition.offset, partition.rows)[: partition.rows]:
            if missing := [c for c in self.columns if c not in row]:
                raise ValueError(f"the page at {partition.offset} has no column {missing}")
            yield tuple(row[c] for c in self.columns)


class PagedCsv(DataSource):
    """Format ``paged_csv``: options of Pages, ``columns`` (a JSON list) and, if it is known, ``rows``."""

    @classmethod
    def name(cls) -> str:
        return "paged_csv"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema) -> _Reader:
        o = self.options
        pages = Pages(o["url"], o["folder"], int(o.get("page", 25_000)), int(o.get("retries", 3)), float(o.get("wait", 2.0)), float(o.get("timeout", 120.0)))
        return _Reader(pages, json.loads(o["columns"]), int(o["rows"]) if "rows" in o else None)


def paged_table(spark: SparkSession, pages: Pages, columns: list[str], rows: int | None = None) -> DataFrame:
    """The table behind the pages, all columns text. An answer without rows is an empty table."""
    spark.dataSource.register(PagedCsv)
    reader = spark.read.format("paged_csv").option("columns", json.dumps(columns))
    for name in ("url", "folder", "page", "retries", "wait", "timeout"):
        reader = reader.option(name, str(getattr(pages, name)))
    return (reader if rows is None else reader.option("rows", str(rows))).load()
