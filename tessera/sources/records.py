"""Records of paged services: one envelope for many shapes of answers, and a paged data source.

``PagedRecords`` is a Spark data source. It asks for the first page on the driver, where the total is told, and reads
the others in partitions of pages. ``fetch`` is a class's own: subclasses reach a service, tests read files.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Members that may hold the results, in order.
MEMBERS = ["results", "data", "datasets", "items", "hits"]


def items_of(answer: object) -> list:
    """The results in an answer: a list itself, the first member that holds one (or hits inside it), or one record."""
    if isinstance(answer, list):
        return answer
    if not isinstance(answer, dict):
        return []
    for name in MEMBERS:
        inner = answer.get(name)
        inner = inner.get("hits") if isinstance(inner, dict) else inner
        if isinstance(inner, list):
            return inner
    return [answer] if "id" in answer or "name" in answer else []


def items_column(text: Column) -> Column:
    """The same over a JSON text column, as an array of JSON texts; what does not parse has none."""
    lists = [text, *(F.get_json_object(text, f"$.{m}{h}") for m in MEMBERS for h in ("", ".hits"))]
    parsed = [F.when(F.ltrim(x).startswith("["), F.from_json(x, "array<string>")) for x in lists]
    one = F.get_json_object(text, "$.id").isNotNull() | F.get_json_object(text, "$.name").isNotNull()
    return F.coalesce(*parsed, F.when(one, F.array(text)), F.array().cast("array<string>"))


class Pages(InputPartition):
    def __init__(self, first: int, last: int, known: bool):
        self.first, self.last, self.known = first, last, known


class PagedRecords(DataSource):
    """Options: ``size`` (records a page), ``most`` (records in all), ``pages`` (pages a partition); others are for fetch."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return "page int, pos int, record string"

    def fetch(self, page: int, size: int) -> object:
        """The parsed answer for a page, counted from 1. With ``total`` in it, pages are read in parallel."""
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self)


class _Reader(DataSourceReader):
    def __init__(self, source: PagedRecords):
        self.source = source
        self.size, self.most, self.pages = (int(source.options.get(k, d)) for k, d in (("size", 100), ("most", 10**12), ("pages", 8)))

    def partitions(self) -> list[Pages]:
        answer = self.source.fetch(1, self.size)
        total = answer.get("total") if isinstance(answer, dict) else None
        if total is None:  # one partition pages on until a short page
            return [Pages(1, math.ceil(self.most / self.size), False)]
        last = max(1, math.ceil(min(int(total), self.most) / self.size))
        return [Pages(i, min(i + self.pages - 1, last), True) for i in range(1, last + 1, self.pages)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.last + 1):
            items = items_of(self.source.fetch(page, self.size))
            for pos, item in enumerate(items):
                if (page - 1) * self.size + pos < self.most:
                    yield page, pos, json.dumps(item, ensure_ascii=False, sort_keys=True)
            if not partition.known and len(items) < self.size:
                return
