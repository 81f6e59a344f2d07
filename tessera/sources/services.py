"""Search services over HTTP: pages by number or by offset, lookups of single records, and files fetched to a folder.

``search_records`` and ``file_downloads`` are Spark data sources (``register`` adds them to a session). A page, record
or file is asked for again after 429 (as long as the service says), 5xx and broken connections; what still fails then
fails the task, so no result is ever a part without a word.
"""

from __future__ import annotations

import contextlib
import json
import math
import time
import uuid
from collections.abc import Iterator
from http.client import HTTPException
from urllib.error import HTTPError, URLError
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from tessera.sources.records import items_of


class Missing(Exception):
    """The service has no such thing (404, 410)."""


class Client:
    """GET with retries. Options: ``retries`` (tries in all), ``wait`` (seconds after the first failure, then twice as
    many, and so on), ``timeout`` (seconds), ``token``."""

    def __init__(self, options: dict):
        self.retries, self.wait, self.timeout = int(options.get("retries", 5)), float(options.get("wait", 2)), float(options.get("timeout", 30))
        self.headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {options['token']}"} if options.get("token") else {})

    def run(self, url: str, use):
        """``use`` of the open answer; it is used again from the start after a failure."""
        for tried in range(1, self.retries + 1):
            try:
                with urlopen(Request(url, headers=self.headers), timeout=self.timeout) as answer:
                    return use(answer)
            except HTTPError as e:
                if e.code in (404, 410):
                    raise Missing(url) from e
                told = e.headers.get("Retry-After", "") if e.code == 429 else ""
                if tried == self.retries or (e.code != 429 and e.code < 500):
                    raise
                time.sleep(float(told) if told.isdigit() else self.wait * 2 ** (tried - 1))
            except (URLError, HTTPException, OSError, ValueError):
                if tried == self.retries:
                    raise
                time.sleep(self.wait * 2 ** (tried - 1))

    def json(self, url: str, params: dict | None = None) -> object:
        return self.run(f"{url}?{urlencode(params)}" if params else url, lambda answer: json.loads(answer.read()))


# --- search ------------------------------------------------------------------------------------------------


class Stretch(InputPartition):
    """Pages ``first`` to ``last`` of a query; ``known``: the service told how many there are."""

    def __init__(self, query: str, first: int, last: int, known: bool):
        self.query, self.first, self.last, self.known = query, first, last, known


class SearchRecords(DataSource):
    """(query, page, pos, id, record): what a service finds for each query, in its order; records are JSON texts.

    Options: ``url``; ``queries`` (a JSON list, or one text); ``style``: ``pages`` (``q``, ``size``, ``page``; open
    records of one ``kind``, best match first) or ``offsets`` (``search``, ``limit``, ``offset``); ``size`` (of a page),
    ``most`` (records of a query), ``pages`` (pages a partition), ``params`` (a JSON object of further parameters), and
    those of ``Client``. Filters on ``query`` are pushed down: other queries are not asked.
    """

    @classmethod
    def name(cls) -> str:
        return "search_records"

    def schema(self) -> str:
        return "query string, page int, pos int, id string, record string"

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(dict(self.options))


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        told = options.get("queries", "")
        self.url, self.style, self.client = options["url"].rstrip("/"), options.get("style", "pages"), Client(options)
        self.queries = [str(q) for q in json.loads(told)] if told.startswith("[") else [told]
        self.size, self.most, self.pages = (int(options.get(k, d)) for k, d in (("size", 100), ("most", 10**12), ("pages", 8)))
        self.kind, self.params = options.get("kind", ""), json.loads(options.get("params", "{}"))
        if self.style not in ("pages", "offsets"):
            raise ValueError(f"style {self.style!r} is neither pages nor offsets")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("query",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.queries = [q for q in self.queries if q in wanted]
            else:
                yield f

    def fetch(self, query: str, page: int) -> object:
        if self.style == "pages":
            asked = f"{query} AND resource_type.type:{self.kind}" if self.kind else query
            params = {"q": asked, "size": self.size, "page": page, "sort": "bestmatch", "access_right": "open"}
        else:
            params = {"search": query, "limit": self.size, "offset": (page - 1) * self.size}
        return self.client.json(self.url, params | self.params)

    def partitions(self) -> list[Stretch]:
        """The first page of each query tells its total; without one, a partition reads on until a short page."""
        out = []
        for query in dict.fromkeys(self.queries):
            total = total_of(self.fetch(query, 1)) if self.most > self.size else None
            last = math.ceil((self.most if total is None else min(total, self.most)) / self.size)
            if total is None:
                out.append(Stretch(query, 1, last, False))
            else:
                out += [Stretch(query, i, min(i + self.pages - 1, last), True) for i in range(1, last + 1, self.pages)]
        return out or [Stretch("", 1, 0, True)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for page in range(partition.first, partition.last + 1):
            items = items_of(self.fetch(partition.query, page))
            for pos, item in enumerate(items):
                if (page - 1) * self.size + pos < self.most:
                    told = item.get("id") if isinstance(item, dict) else None
                    yield partition.query, page, pos, None if told is None else str(told), json.dumps(item, ensure_ascii=False, sort_keys=True)
            if not partition.known and len(items) < self.size:
                return


def total_of(answer: object) -> int | None:
    """How many records an answer says there are: ``total`` or ``count``, of itself or of its ``hits``."""
    if isinstance(answer, dict):
        for node in (answer.get("hits"), answer):
            for name in ("total", "count"):
                told = node.get(name) if isinstance(node, dict) else None
                if isinstance(told, dict):
                    told = told.get("value")
                if isinstance(told, int) and not isinstance(told, bool):
                    return told
    return None


def unique_records(found: DataFrame, queries: list[str]) -> DataFrame:
    """Each record once, as the first of the queries found it first; records without an id all stay."""
    number = F.coalesce(*(F.when(F.col("query") == q, i) for i, q in enumerate(queries)), F.lit(len(queries)))
    first = F.min(F.struct(number.alias("number"), "page", "pos", "query", "record")).alias("first")
    known = found.where("id IS NOT NULL").groupBy("id").agg(first).select("first.query", "first.page", "first.pos", "id", "first.record")
    return known.unionByName(found.where("id IS NULL"))


def lookup_records(ids: DataFrame, key: str, url: str, **options) -> DataFrame:
    """(key, record): each record by its id, as JSON text; null where the service has none. Null ids are not asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = Client(options)
        for batch in batches:
            records = []
            for value in batch[key].astype(str):
                try:
                    records.append(json.dumps(client.json(f"{url.rstrip('/')}/{quote(value, safe='')}"), ensure_ascii=False, sort_keys=True))
                except Missing:
                    records.append(None)
            yield pd.DataFrame({key: batch[key], "record": records})

    asked = ids.select(key).where(F.col(key).isNotNull()).distinct()
    return asked.mapInPandas(run, f"{key} {dict(ids.dtypes)[key]}, record string")


# --- files -------------------------------------------------------------------------------------------------

#: A file counts as there if its size is within so many bytes of the one told.
SLACK = 100
CHUNK = 1 << 20


class FileDownloads(DataSource):
    """Writes the files of rows (url, target, size) below ``path``: ``target`` is a relative name, ``size`` may be null or 0.

    A file that is there with about the told size (or any, if none is told) is left alone. Others are written under a
    name of the job's own and moved when whole, so a target is never half a file, whatever becomes of a task; what
    dead tasks leave is removed when the job ends. Each job adds a file of outcomes below ``_outcomes``, which
    ``read_outcomes`` reads. Options are those of ``Client``; ``path`` is a folder that all executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "file_downloads"

    def schema(self) -> str:
        return "url string, target string, size long"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DownloadWriter(dict(self.options), schema.names)


class Part(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class DownloadWriter(DataSourceWriter):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names, self.job = options, names, uuid.uuid4().hex

    def _folder(self):
        from pyarrow import fs

        path = self.options["path"]
        return (fs.LocalFileSystem(), path.rstrip("/")) if "://" not in path and not path.startswith("file:") else fs.FileSystem.from_uri(path.rstrip("/"))

    def write(self, rows: Iterator) -> Part:
        """One task's files, one after the other. Its outcomes count only once the job commits."""
        files, folder = self._folder()
        client, part = Client(self.options), f"{folder}/_working/{self.job}-{uuid.uuid4().hex}.jsonl"
        files.create_dir(f"{folder}/_working", recursive=True)
        with files.open_output_stream(part) as out:
            for row in rows:
                told = dict(zip(self.names, row, strict=True))
                outcome, size = self._one(files, folder, client, told.get("url"), told.get("target"), told.get("size") or 0)
                out.write((json.dumps({"target": told.get("target"), "outcome": outcome, "bytes": size}) + "\n").encode())
        return Part(part)

    def _one(self, files, folder: str, client: Client, url: str | None, target: str | None, told: int) -> tuple[str, int]:
        if not url or not target:
            return "no_address", 0
        if target.startswith(("/", "_")) or ".." in target.split("/"):
            return "bad_name", 0
        path = f"{folder}/{target}"
        there = files.get_file_info(path)
        if there.is_file and (not told or abs(there.size - told) < SLACK):
            return "present", there.size
        parent = path.rpartition("/")[0]
        files.create_dir(parent, recursive=True)
        working = f"{folder}/_working/{self.job}-{uuid.uuid4().hex}.tmp"

        def save(answer) -> int:
            said, size = answer.headers.get("Content-Length"), 0
            with files.open_output_stream(working) as out:
                while chunk := answer.read(CHUNK):
                    size += out.write(chunk)
            if said is not None and size != int(said):
                raise OSError(f"{url}: {size} of {said} bytes")
            return size

        try:
            size = client.run(url, save)
            files.move(working, path)
        except Missing:
            return "missing", 0
        except (HTTPError, URLError, HTTPException, OSError):
            with contextlib.suppress(OSError):
                files.delete_file(working)
            return "failed", 0
        return ("size_differs" if told and abs(size - told) > SLACK else "downloaded"), size

    def commit(self, messages: list[Part | None]) -> None:
        files, folder = self._folder()
        files.create_dir(f"{folder}/_outcomes", recursive=True)
        for m in messages:
            if m is not None:
                files.move(m.name, f"{folder}/_outcomes/{m.name.rpartition('/')[2]}")
        self._clean(files, folder)

    def abort(self, messages: list[Part | None]) -> None:
        self._clean(*self._folder())

    def _clean(self, files, folder: str) -> None:
        """Removes what this job's tasks have left, also those that died."""
        from pyarrow import fs

        for info in files.get_file_info(fs.FileSelector(f"{folder}/_working", allow_not_found=True)):
            if info.base_name.startswith(self.job):
                files.delete_file(info.path)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(target, outcome, bytes) of all jobs that committed: downloaded, present, size_differs, missing, failed, no_address, bad_name."""
    return spark.read.schema("target string, outcome string, bytes long").json(f"{path}/_outcomes")


def register(spark: SparkSession) -> None:
    """Adds both sources to a session, and lets Spark offer filters to sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchRecords)
    spark.dataSource.register(FileDownloads)
