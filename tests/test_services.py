"""Search sources, lookups and downloads against a local server with short pages, errors, 429 and cut answers."""

import json
import os
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

import pytest
from pyspark.sql import functions as F

from tessera.sources import services as S

FOUND = {"gear": 23, "plate AND resource_type.type:dataset": 7, "none": 0, "plate": 11, "bolt": 10}
FILES = {"a.bin": b"a" * 5000, "b.bin": b"b" * 300_000, "late.bin": b"c" * 2000, "cut.bin": b"d" * 9000, "odd.bin": b"e" * 700}


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *a):
        pass

    def answer(self, code, body=b"", length=None, **headers):
        self.send_response(code)
        self.send_header("Content-Length", str(len(body) if length is None else length))
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        at = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(at.query).items()}
        with self.server.lock:
            self.server.asked.append(self.path)
            n = self.server.seen[self.path] = self.server.seen[self.path] + 1
        if n == 1 and self.server.trouble and (q.get("page") == "2" or q.get("offset") == "4" or at.path.endswith("late.bin")):
            return self.answer(429, Retry_After="0")
        if n == 2 and self.server.trouble and (q.get("page") == "2" or at.path.endswith("late.bin")):
            return self.answer(503)
        record = lambda i, of: {"id": f"{of[:4]}{i}" if i % 5 else i // 5, "of": of}
        if at.path == "/pages":
            total, size, page = FOUND.get(q["q"], 0), int(q["size"]), int(q["page"])
            hits = [record(i, q["q"]) for i in range(total)][(page - 1) * size : page * size]
            return self.answer(200, json.dumps({"hits": {"total": total, "hits": hits[:-1] if page == 3 else hits}}).encode())
        if at.path == "/offsets":
            total, at_, size = FOUND.get(q["search"], 0), int(q["offset"]), int(q["limit"])
            return self.answer(200, json.dumps([record(i, q["search"]) for i in range(total)][at_ : at_ + size]).encode())
        if at.path.startswith("/pages/"):
            key = unquote(at.path[7:])
            return self.answer(404) if key == "gone" else self.answer(400) if key == "bad" else self.answer(200, json.dumps({"id": key}).encode())
        if at.path.startswith("/files/") and at.path[7:] in FILES:
            body = FILES[at.path[7:]]
            if at.path.endswith("cut.bin") and n <= 2:
                return self.answer(200, body[:100], length=len(body))
            return self.answer(200, body)
        return self.answer(500 if "broken" in at.path else 404)


@pytest.fixture()
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.seen, s.asked, s.lock, s.trouble = Counter(), [], threading.Lock(), True
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.url = f"http://127.0.0.1:{s.server_port}"
    yield s
    s.shutdown()


@pytest.fixture(autouse=True)
def registered(spark):
    S.register(spark)


def search(spark, server, style, queries, **more):
    options = {"url": f"{server.url}/{style}", "style": style, "queries": json.dumps(queries), "wait": "0.01"} | more
    return spark.read.format("search_records").options(**options).load()


def brute(style, query, size, most):
    out, i = [], 0
    total = FOUND.get(query, 0)
    for i in range(min(total, most)):
        page, pos = i // size + 1, i % size
        if style == "pages" and page == 3 and pos == min(size, total - 2 * size) - 1:
            continue  # this page of the server is one short
        out.append((query, page, pos, f"{query[:4]}{i}" if i % 5 else str(i // 5)))
    return out


@pytest.mark.parametrize("style,size,most,pages", [("pages", 4, 1000, 2), ("pages", 5, 13, 1), ("offsets", 4, 1000, 2), ("offsets", 5, 7, 8), ("pages", 50, 1000, 8), ("pages", 5, 3, 8)])
def test_rows_equal_a_plain_read(spark, server, style, size, most, pages):
    queries = ["gear", "bolt", "none", "gear"]
    got = search(spark, server, style, queries, size=str(size), most=str(most), pages=str(pages))
    want = [r for q in ("gear", "bolt", "none") for r in brute(style, q, size, most)]
    assert sorted((r["query"], r["page"], r["pos"], r["id"]) for r in got.collect()) == sorted(want)
    if style == "pages" and size < 10 and most > 2 * size:
        assert got.rdd.getNumPartitions() > 2


def test_kind_and_parameters(spark, server):
    got = search(spark, server, "pages", ["plate"], kind="dataset", params='{"communities": "x"}', size="3").collect()
    assert len(got) == 7 - 1 and json.loads(got[0]["record"])["of"].endswith("dataset")
    assert all("access_right=open" in p and "communities=x" in p for p in server.asked)


def test_queries_are_pushed_down(spark, server):
    rows = search(spark, server, "offsets", ["gear", "bolt", "plate"], size="4").where(F.col("query").isin("bolt", "other") & (F.col("pos") == 0))
    assert [r["page"] for r in rows.orderBy("page").collect()] == [1, 2, 3]
    assert not any("gear" in p or "plate" in p for p in server.asked)
    assert search(spark, server, "pages", ["gear"]).where("query = 'nothing'").count() == 0


def test_a_record_is_taken_once(spark, server):
    found = search(spark, server, "offsets", ["bolt", "gear", "plate"], size="4")
    got = sorted((r["query"], r["id"]) for r in S.unique_records(found, ["bolt", "gear", "plate"]).collect())
    seen, want = set(), []
    for q in ("bolt", "gear", "plate"):
        for _, _, _, i in brute("offsets", q, 4, 1000):
            if i not in seen:
                seen.add(i)
                want.append((q, i))
    assert got == sorted(want)


def test_lookups(spark, server):
    ids = spark.createDataFrame([("x/1",), ("gone",), (None,), ("x/1",), ("é",)], "key string")
    got = {r["key"]: r["record"] for r in S.lookup_records(ids, "key", f"{server.url}/pages", wait=0.01).collect()}
    assert got == {"x/1": '{"id": "x/1"}', "gone": None, "é": '{"id": "é"}'}
    with pytest.raises(Exception):
        S.lookup_records(spark.createDataFrame([("bad",)], "key string"), "key", f"{server.url}/pages", wait=0.01).collect()


def test_errors_are_no_short_results(spark, server):
    with pytest.raises(Exception):
        spark.read.format("search_records").options(url=f"{server.url}/broken", queries="gear", wait="0.01", retries="2").load().collect()
    with pytest.raises(Exception, match="neither pages nor offsets"):
        search(spark, server, "other", ["gear"]).collect()


def test_totals():
    assert [S.total_of(x) for x in ({"hits": {"total": 3}}, {"total": {"value": 4}}, {"count": 5}, [], {"total": True}, {"hits": []}, None)] == [3, 4, 5, None, None, None, None]


def download(spark, rows, path):
    spark.createDataFrame(rows, "url string, target string, size long").repartition(3).write.format("file_downloads").mode("append").option("wait", "0.01").option("retries", "3").save(str(path))


def files_below(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if "_outcomes" not in d}


def test_downloads(spark, server, tmp_path):
    at = lambda n: f"{server.url}/files/{n}"
    rows = [(at("a.bin"), "x/1/a.bin", 5000), (at("b.bin"), "x/2/b.bin", None), (at("late.bin"), "y/late.bin", 0), (at("cut.bin"), "y/cut.bin", 9000), (at("odd.bin"), "y/odd.bin", 5), (at("no.bin"), "y/no.bin", 1), (f"{server.url}/broken", "y/broken", 1), (None, "y/none", 1), (at("a.bin"), "../a.bin", 1)]
    path = tmp_path / "files"
    download(spark, rows, path)
    want = {"x/1/a.bin": "a.bin", "x/2/b.bin": "b.bin", "y/late.bin": "late.bin", "y/cut.bin": "cut.bin", "y/odd.bin": "odd.bin"}
    assert files_below(path) == set(want)
    assert all((path / t).read_bytes() == FILES[n] for t, n in want.items())
    outcomes = {r["target"]: r["outcome"] for r in S.read_outcomes(spark, str(path)).collect()}
    assert outcomes == dict.fromkeys(("x/1/a.bin", "x/2/b.bin", "y/late.bin", "y/cut.bin"), "downloaded") | {"y/odd.bin": "size_differs", "y/no.bin": "missing", "y/broken": "failed", "y/none": "no_address", "../a.bin": "bad_name"}

    server.asked.clear()
    (path / "x/1/a.bin").write_bytes(b"short")  # of another size: fetched again
    download(spark, rows[:4], path)
    assert sorted(p for p in server.asked) == ["/files/a.bin"] and (path / "x/1/a.bin").read_bytes() == FILES["a.bin"]


def test_a_task_that_dies_leaves_nothing(server, tmp_path):
    """Two tries break in the middle of a file, one of them without any cleaning up; the third one counts."""
    path = tmp_path / "files"
    writer = S.DownloadWriter({"path": str(path), "wait": "0.01", "retries": "1"}, ["url", "target", "size"])
    row = (f"{server.url}/files/a.bin", "z/a.bin", 5000)

    class Killed(BaseException):
        pass

    class Dying:
        def __iter__(self):
            yield row
            raise Killed

    for _ in range(2):
        with pytest.raises(Killed):
            writer.write(iter(Dying()))
    (path / "_working" / f"{writer.job}-half.tmp").write_bytes(b"half")  # a worker killed while it wrote
    (path / "_working" / "otherjob-1.tmp").write_bytes(b"other")
    server.asked.clear()
    part = writer.write(iter([row]))
    assert server.asked == []  # there already, whole
    writer.commit([part, None])
    assert files_below(path) == {"z/a.bin", "_working/otherjob-1.tmp"} and (path / "z/a.bin").read_bytes() == FILES["a.bin"]
    outcomes = [json.loads(x) for f in (path / "_outcomes").iterdir() for x in f.read_text().splitlines()]
    assert outcomes == [{"target": "z/a.bin", "outcome": "present", "bytes": 5000}]
    again = S.DownloadWriter({"path": str(path)}, ["url", "target", "size"])
    again.write(iter([row]))
    again.abort([None])
    assert files_below(path) == {"z/a.bin", "_working/otherjob-1.tmp"}
