"""Archive files made here: WARC, CDXJ, sparse index, HAR, zipped archives; streams."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import files, indexes, warc
from palimpsest.sources.har import har_captures, har_pages, parse_har
from palimpsest.streaming import access


def _record(kind, url, body, date="2020-03-04T05:06:07Z", **extra):
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {url}", f"WARC-Date: {date}", f"Content-Length: {len(body)}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in extra.items()]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _http(status="200 OK", body=b"<html>hi</html>", **headers):
    head = [f"HTTP/1.1 {status}", "Content-Type: text/html; charset=utf-8", *[f"{k.replace('_', '-')}: {v}" for k, v in headers.items()]]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body


def _request(method="GET", cookie="c=1"):
    return f"{method} / HTTP/1.1\r\nHost: s.test\r\nCookie: {cookie}\r\n\r\n".encode()


@pytest.fixture(scope="module")
def parts():
    return [
        _record("warcinfo", "", b"software: x\r\njson-metadata: {\"title\": \"T\"}\r\n"),
        _record("request", "http://s.test/a", _request()), _record("response", "http://s.test/a", _http()),
        _record("response", "http://s.test/b#f", _http("404 Not Found", b"gone")), _record("request", "http://s.test/b#f", _request()),
        _record("response", "http://s.test/c", _http()),
        _record("request", "http://s.test/head", _request("HEAD")), _record("response", "http://s.test/head", _http()),
        _record("revisit", "http://s.test/r", b"", WARC_Refers_To_Target_URI="http://s.test/a", WARC_Refers_To_Date="2020-03-04T05:06:07Z"),
        _record("revisit", "http://s.test/self", b"", WARC_Refers_To_Target_URI="http://s.test/self", WARC_Refers_To_Date="2020-03-04T05:06:07Z"),
        _record("response", "http://s.test/part", _http("206 Partial Content", b"xy", Content_Range="bytes 5-6/10", Content_Length="2")),
        _record("response", "http://s.test/whole", _http("206 Partial Content", b"xy", Content_Range="bytes 0-1/2", Content_Length="2")),
        _record("metadata", "metadata://s.test/m", b"{}", Content_Type="application/json"), _record("metadata", "http://s.test/m2", b"no"), _record("resource", "urn:text:1", b"txt", Content_Type="text/plain"),
    ]


@pytest.fixture(scope="module")
def folder(tmp_path_factory, parts):
    d = tmp_path_factory.mktemp("arc")
    (d / "plain.warc").write_bytes(b"".join(parts))
    (d / "zipped.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    return d


WANT = {"http://s.test/a", "http://s.test/b", "http://s.test/c", "http://s.test/r", "http://s.test/whole", "metadata://s.test/m", "urn:text:1"}


@pytest.mark.parametrize("name", ["plain.warc", "zipped.warc.gz"])
def test_warc(spark, folder, name):
    warc.register(spark)
    rows = {x.url: x for x in spark.read.format("warc").load(str(folder / name)).collect()}
    assert set(rows) == WANT
    a = rows["http://s.test/a"]
    assert (a.status, a.mime, a.ts_ms, a.cookie, bytes(a.payload)) == (200, "text/html", 1583298367000, "c=1", b"<html>hi</html>")
    assert rows["http://s.test/b"].status == 404 and rows["http://s.test/b"].cookie == "c=1" and rows["http://s.test/c"].cookie is None
    assert rows["http://s.test/r"].mime == "warc/revisit" and rows["http://s.test/r"].orig_url == "http://s.test/a"
    one = warc.read_record(str(folder / name), a.start, a.length)
    assert one.url == "http://s.test/a" and one.kind == "response"
    index = spark.read.format("warc").option("payload", "false").load(str(folder / name))
    assert index.count() == len(WANT) and index.where("payload is not null").count() == 0
    info = spark.read.format("warc").option("infoonly", "true").load(str(folder / name)).collect()
    assert [warc.info_pages(bytes(x.payload)) for x in info] == [{"title": "T"}]


def test_cut_off_files(spark, folder, tmp_path):
    warc.register(spark)
    raw = (folder / "plain.warc").read_bytes()
    (tmp_path / "cut.warc").write_bytes(raw[: len(raw) // 2])
    (tmp_path / "empty.warc").write_bytes(b"")
    assert 0 < spark.read.format("warc").load(str(tmp_path)).count() < len(WANT)


def test_cdxj(spark, tmp_path):
    lines = [
        'test,s)/a 20200304050607 {"url": "http://s.test/a#x", "digest": "ABC", "status": "200", "mime": "text/html", "offset": "10", "length": "20", "filename": "f.warc.gz"}',
        '{"url": "http://s.test/bare", "timestamp": "20200101", "digest": "sha-256:1", "status": "x"}', "not an index line", 'test,s)/h 20200304050607 {"url": "http://s.test/h", "method": "HEAD"}', "",
        'test,s)/r 20200304 {"url": "http://s.test/r", "mime": "warc/revisit"}',
    ]
    (tmp_path / "i.cdxj.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    rows = {x.url: x for x in indexes.read_cdxj(spark, str(tmp_path / "i.cdxj.gz")).collect()}
    assert set(rows) == {"http://s.test/a", "http://s.test/bare", "http://s.test/r"}
    a = rows["http://s.test/a"]
    assert (a.urlkey, a.ts_ms, a.status, a.digest, a.source.start, a.source.length, a.source.path) == ("test,s)/a", 1583298367000, 200, "sha1:ABC", 10, 20, "f.warc.gz")
    assert rows["http://s.test/bare"].ts_ms == 1577836800000 and rows["http://s.test/bare"].digest == "sha-256:1"


def test_idx_pages_har(spark):
    lines = spark.createDataFrame([('!meta 0 {"format": "cdxj-gzip"}',), ("test,s)/a 2020\tf.cdx.gz\t0\t100\t1",), ('test,s)/b 2021 {"filename": "g.cdx.gz", "offset": 5, "length": 6, "digest": "sha256:d"}',)], "line string")
    rows = indexes.parse_idx(lines, "w").orderBy("prefix").collect()
    assert [(x.prefix, x.filename, x.offset, x.length, x.digest) for x in rows] == [("test,s)/a 2020", "f.cdx.gz", 0, 100, None), ("test,s)/b 2021", "g.cdx.gz", 5, 6, "sha256:d")]
    pages = spark.createDataFrame([('{"format": "json-pages-1.0"}',), ('{"id": "1", "url": "http://s.test/", "ts": "2020-01-01T00:00:00Z"}',)], "line string")
    assert [(x.id, x.title, x.ts_ms) for x in indexes.parse_pages(pages).collect()] == [("1", "http://s.test/", 1577836800000)]
    entry = lambda url, **c: {"pageref": "p", "startedDateTime": "2020-01-01T00:00:00Z", "request": {"url": url, "method": "GET"}, "response": {"status": 200, "headers": [], "content": c}}
    har = json.dumps({"log": {"pages": [{"id": "p", "title": "T", "startedDateTime": "2020-01-01T00:00:00Z", "pageTimings": {"onLoad": 5}}, {"id": "q", "title": "no", "pageTimings": {}}], "entries": [entry("http://s.test/#h", text="aGk=", encoding="base64", mimeType="text/html"), entry("http://s.test/raw", text="x"), entry("http://s.test/none")]}})
    hars = parse_har(spark.createDataFrame([(har,), ("broken",)], "text string"))
    assert [(r["url"], bytes(r["payload"])) for r in har_captures(hars).collect()] == [("http://s.test/", b"hi"), ("http://s.test/raw", b"x")]
    assert [x.asDict() for x in har_pages(hars).collect()] == [{"id": "p", "url": "http://s.test/#h", "title": "T", "ts_ms": 1577836800000}]


def test_zipped_archive(spark, folder, tmp_path):
    path = str(tmp_path / "a.wacz")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("datapackage.json", json.dumps({"profile": "data-package"}), zipfile.ZIP_DEFLATED)
        z.write(folder / "zipped.warc.gz", "archive/data.warc.gz")
        z.writestr("indexes/index.cdx", 'test,s)/a 2020 {"url": "http://s.test/a"}\n')
        z.writestr("pages/pages.jsonl", '{"format": "json-pages-1.0"}\n{"id": "1", "url": "http://s.test/a", "ts": "2020-01-01T00:00:00Z"}\n')
    assert {e["filename"] for e in files.zip_entries(path)} >= {"datapackage.json", "archive/data.warc.gz"}
    assert files.read_member(path, "indexes/index.cdx", 5, 3) == b"s)/"
    got = indexes.read_wacz(spark, path)
    assert {x.url for x in got["captures"].collect()} == WANT
    assert got["index"].count() == got["pages"].count() == 1 and got["blocks"].count() == 0
    kinds = spark.read.format("binaryFile").load([path, str(folder / "plain.warc"), str(folder / "zipped.warc.gz")]).select(files.file_kind(F.col("content")).alias("k")).collect()
    assert {x.k for x in kinds} == {"zip", "warc", "gzip"}
    assert files.known_extension("https://s.test/x.warc.gz?y#z") == ".warc.gz" and files.known_extension("x.txt") is None


def test_multi_manifest(spark):
    text = json.dumps({"resources": [{"name": "a.wacz", "hash": "sha256:1", "path": "p"}], "initialPages": [{"id": "1", "url": "u", "filename": "a.wacz"}, {"id": "2", "url": "v", "filename": "none"}]})
    archives, pages = indexes.multi_manifest(spark, text)
    assert {x.id: x.archive for x in indexes.pages_with_archives(pages, archives).collect()} == {"1": "1", "2": None}


def test_streams(spark, tmp_path):
    rows = [("c1", "u", f"2024-01-01 00:0{i}:00") for i in range(4)] + [("c2", "v", "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "client string, url string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("client string, url string, ts timestamp").parquet(f"{tmp_path}/in")
    q = access.client_windows(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    r = access.repeat_counts(stream).writeStream.outputMode("append").format("memory").queryName("repeats").trigger(availableNow=True).start()
    for s in (q, r):
        assert s.awaitTermination(90)
    assert {(x.client, x.n) for x in spark.table("windows").collect()} == {("c1", 4), ("c2", 1)}
    assert sorted((x.client, x.skip) for x in spark.table("repeats").collect()) == [("c1", 0), ("c1", 1), ("c1", 2), ("c1", 3), ("c2", 0)]
    kind = "url string, ts_ms long, seq long, mime string, status int"
    spark.createDataFrame([("u", 1, 1, "warc/revisit", 200), ("u", 1, 2, "text/html", 200), ("u", None, 3, "text/html", 200)], kind).write.parquet(f"{tmp_path}/caps")
    access.ingest(spark, f"{tmp_path}/caps", kind, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    assert [(x.url, x.mime) for x in spark.read.parquet(f"{tmp_path}/out").collect()] == [("u", "text/html")]


@pytest.mark.parametrize("size", [1, 50, 300, 1000])
def test_parts_of_a_file_hold_each_record_once(spark, folder, size):
    """Wherever a file is cut, requests stay with their responses."""
    warc.register(spark)
    whole = sorted(map(str, spark.read.format("warc").load(str(folder / "zipped.warc.gz")).collect()))
    parts = spark.read.format("warc").option("splitbytes", size).load(str(folder / "zipped.warc.gz"))
    assert sorted(map(str, parts.collect())) == whole


@pytest.mark.parametrize("name", ["plain.warc", "zipped.warc.gz"])
def test_index_passes_over_long_bodies(tmp_path, name):
    body = b"x" * 3_000_000
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n"
    blocks = [warc._block("response", f"http://s.test/{i}", 1000 * i, http + body, WARC_Payload_Digest="sha1:A" if i else None) for i in range(3)]
    (tmp_path / name).write_bytes(b"".join(map(gzip.compress, blocks)) if name.endswith("gz") else b"".join(blocks))
    with files.open_file(str(tmp_path / name)) as f:
        rows = [warc.capture(r, None) for r in warc.records(f, index_only=True)]
    assert [r["url"][-1] for r in rows] == ["0", "1", "2"]
    assert rows[0]["digest"] == "sha-256:" + hashlib.sha256(body).hexdigest() and rows[1]["digest"] == "sha1:A"
    assert len(rows[0]["payload"]) == len(body) and len(rows[1]["payload"]) < len(body)


def test_members_of_an_archive_share_its_directory(tmp_path, monkeypatch):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(50):
            z.writestr(f"p/{i}", f"text {i}")
    for name in "ab":
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("in.zip", inner.getvalue())
    (tmp_path / "plain").write_bytes(b"x")
    read = []
    opened = zipfile.ZipFile.__init__
    monkeypatch.setattr(zipfile.ZipFile, "__init__", lambda self, *a, **k: (read.append(1), opened(self, *a, **k))[1])
    paths = [f"{tmp_path}/{name}.zip#!/in.zip#!/p/{i}" for name in "ab" for i in range(50)]
    assert list(files.read_members([*paths, f"{tmp_path}/plain", paths[0]])) == [f"text {i}".encode() for _ in "ab" for i in range(50)] + [b"x", b"text 0"]
    assert len(read) <= 6  # two archives, one of them again: outer and inner directory each time


def test_ranges_are_dealt_to_few_tasks(tmp_path, monkeypatch):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nbody "
    for name in "ab":
        blocks = [warc._block(k, f"http://{name}.test/{i}", 1000 * i, http) for i in range(200) for k in (("request", "response") if i % 2 else ("response", "request"))]
        (tmp_path / f"{name}.warc.gz").write_bytes(b"".join(map(gzip.compress, blocks)))
    monkeypatch.setattr(warc, "TASKS", 4)
    for payload in ("true", "false"):
        reader = warc._Reader({"path": str(tmp_path), "splitbytes": "700", "payload": payload})
        parts = reader.partitions()
        assert len(parts) <= 4 + 2 and sum(len(list(p.ranges())) for p in parts) > 100
        assert [r[0] for p in parts for r in reader.read(p)] == [f"http://{name}.test/{i}" for name in "ab" for i in range(200)]


def test_parts_make_whole_files(spark, tmp_path):
    warc.register(spark)
    rows = spark.range(100).selectExpr("concat('http://s.test/', id) as url", "id * 1000 as ts_ms", "200 as status", "'text/html' as mime", "cast(concat('b', id) as binary) as payload", "'GET' as method", "id % 2 = 0 as request_first")
    written = warc.write_warc(rows.repartition(5, "url"), str(tmp_path / "w"), {"title": "T"}, 2).collect()
    assert sorted(x.name for x in tmp_path.rglob("*")) == ["part-00000.warc.gz", "part-00001.warc.gz", "w"]
    assert sum(x.n for x in written) == 100
    assert spark.read.format("warc").option("infoonly", "true").load(str(tmp_path / "w")).count() == 2
    got = spark.read.format("warc").load(str(tmp_path / "w")).select("url", F.decode("payload", "UTF-8").alias("b")).collect()
    assert sorted((x.url, x.b) for x in got) == sorted((f"http://s.test/{i}", f"b{i}") for i in range(100))


def test_archives_are_written_in_ranges_and_read_in_blocks(spark, tmp_path, monkeypatch):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nbody "
    blocks = [warc._block(k, f"http://s.test/{i}", 1000 * i, http) for i in range(300) for k in ("response", "request")]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(map(gzip.compress, blocks)))
    monkeypatch.setattr(indexes, "SPLIT", 2000)
    want = [f"http://s.test/{i}" for i in range(300)]
    for name in (str(path),):
        made = indexes.write_wacz(spark.createDataFrame([(name,)], "path string"), str(tmp_path / "w")).collect()
        assert [x.n for x in made] == [300] and [x.name for x in (tmp_path / "w").iterdir()] == ["x.wacz"]
    archive = str(tmp_path / "w/x.wacz")
    data = indexes.manifest(archive)["data"]["resources"]
    for r in data:
        body = files.read_member(archive, r["path"])
        assert r["bytes"] == len(body) and r["hash"] == "sha256:" + hashlib.sha256(body).hexdigest() == "sha256:" + files.member_digest(archive, r["path"])
    assert files.read_member(archive, "archive/data.warc.gz") == path.read_bytes()
    index = files.read_member(archive, "indexes/index.cdxj").decode()
    assert [x.split(" ")[0] for x in index.split("\n")] == want
    lists = list(files.text_lines(archive, "indexes/index.cdxj", most=7))
    assert max(map(len, lists)) == 7 and [x for part in lists for x in part] == index.split("\n")
    assert len(list(files.text_lines(archive, "indexes/index.cdxj", size=1))) == 300
    got = indexes.read_wacz(spark, archive)
    assert sorted(x.url for x in got["index"].collect()) == sorted(x.url for x in got["pages"].collect()) == sorted(x.url for x in got["captures"].collect()) == sorted(want)
