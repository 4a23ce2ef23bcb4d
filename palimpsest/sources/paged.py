"""A batch source that is read by pages: one input partition per page."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows beyond which a sorted listing is refused instead of being cut.
MOST_ROWS = 10_000


class Page(InputPartition):
    def __init__(self, limit: int, offset: int):
        self.limit, self.offset = limit, offset


def pages(total: int, size: int, most: int = MOST_ROWS) -> list[Page]:
    """The pages of a listing of ``total`` rows; a listing over ``most`` is refused, never cut."""
    if size < 1:
        raise ValueError("a page has at least one row")
    if total > most:
        raise ValueError(f"{total} rows are more than the {most} that the source serves in order")
    return [Page(min(size, total - at), at) for at in range(0, total, size)]


def fetch_json(url: str, limit: int, offset: int, timeout: float = 60.0) -> list[dict]:
    """One page of a JSON listing; the url has {limit} and {offset}."""
    with urlopen(Request(url.format(limit=limit, offset=offset), headers={"Accept": "application/json"}), timeout=timeout) as response:  # noqa: S310
        return json.load(response)


def read_lines(path: str, limit: int, offset: int) -> list[dict]:
    """One page of a file of JSON lines: the same source without a network."""
    rows = []
    with open(path, encoding="utf-8") as f:
        for i, line in enumerate(f):
            if i >= offset + limit:
                break
            if i >= offset:
                rows.append(json.loads(line))
    return rows


def count_lines(path: str) -> int:
    with open(path, "rb") as f:
        return sum(1 for _ in f)


class PagedReader(DataSourceReader):
    def __init__(self, fields: list[str], fetch: Callable[[int, int], list[dict]], total: int, size: int, typed: bool):
        self.fields, self.fetch, self.total, self.size, self.typed = fields, fetch, total, size, typed

    def partitions(self) -> list[InputPartition]:
        return pages(self.total, self.size)

    def read(self, partition: Page) -> Iterator[tuple]:
        rows = self.fetch(partition.limit, partition.offset)
        if len(rows) != partition.limit:
            raise ValueError(f"page at {partition.offset} has {len(rows)} rows instead of {partition.limit}")
        for row in rows:
            yield tuple(row.get(f) if self.typed or row.get(f) is None else str(row[f]) for f in self.fields)


class PagedSource(DataSource):
    """``spark.read.format("paged")`` over ``path``, a file of JSON lines, or ``url``.

    Columns are those of ``columns`` (names with types, values as the JSON has them) or of
    ``fields`` (names alone, all strings).  ``total`` is counted if it is not given: of a
    file its lines, of a url what ``countUrl`` answers.  ``pageSize`` is 500.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        typed = self.options.get("columns")
        return typed or ", ".join(f"`{f}` string" for f in self.options["fields"].split(","))

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        total = o.get("total")
        if "path" in o:
            path = o["path"]
            fetch = lambda limit, offset: read_lines(path, limit, offset)
            total = count_lines(path) if total is None else int(total)
        else:
            url = o["url"]
            fetch = lambda limit, offset: fetch_json(url, limit, offset)
            total = int(fetch_json(o.get("countUrl") or o["counturl"], 0, 0)) if total is None else int(total)
        return PagedReader(schema.names, fetch, total, int(o.get("pageSize", o.get("pagesize", "500"))), "columns" in o)
