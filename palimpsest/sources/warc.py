"""The ``warc`` data source: WARC 1.x files, plain or gzipped, as captures.

Written from the WARC 1.1 standard. Gzipped files are cut into ranges of
members, a task each; records are paired (a request with an adjacent response
of the same URL, in either order) and turned into rows. Options: infoonly (stop
at the first record that is no warcinfo), payload=false (index only, bodies are
passed over), splitbytes.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.session import durable
from palimpsest.sources.files import create_file, expand, file_size, move_file, open_file, read_range, remove_folder

SCHEMA = (
    "url string, ts_ms bigint, status int, status_text string, mime string, digest string, resp_headers map<string,string>,"
    " req_headers map<string,string>, method string, page_id string, orig_url string, orig_ts_ms bigint, cookie string,"
    " path string, start bigint, length bigint, seq bigint, kind string, payload binary"
)
#: Bytes read at once. What is left of a block is copied for each record in it, so blocks are small.
_BLOCK = 1 << 16


@dataclass
class Record:
    start: int
    length: int
    headers: dict[str, str]
    content: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    @property
    def url(self) -> str:
        return self.headers.get("warc-target-uri", "").strip("<>")


def _first_member(f, at: int, block: int = _BLOCK) -> int | None:  # noqa: ANN001
    """Offset of the first gzip member of a record at or after ``at``."""
    held = b""
    f.seek(at)
    while True:
        more = f.read(block)
        held += more
        k = held.find(b"\x1f\x8b\x08")
        while k >= 0 and (len(held) - k >= 4096 or not more):
            try:
                if zlib.decompressobj(31).decompress(held[k : k + 4096], 5) == b"WARC/":
                    return at + k
            except zlib.error:
                pass
            k = held.find(b"\x1f\x8b\x08", k + 1)
        if not more:
            return None
        keep = k if k >= 0 else max(0, len(held) - 2)
        at, held = at + keep, held[keep:]


def _members(f, at: int = 0, head: int | None = None, block: int = _BLOCK) -> Iterator[tuple[int, int, bytes]]:  # noqa: ANN001
    """(offset, compressed length, bytes) of each gzip member from ``at`` on; with ``head`` only that
    many bytes and what follows in the same block of output are kept."""
    f.seek(at)
    held = b""
    while True:
        if not held:
            held = f.read(block)
            if not held:
                return
        z, out, used, kept = zlib.decompressobj(31), [], 0, 0
        while True:
            data = z.decompress(held, _BLOCK)
            if head is None or kept < head:
                out.append(data)
            kept += len(data)
            left = z.unused_data if z.eof else z.unconsumed_tail
            used += len(held) - len(left)
            held = left
            if z.eof:
                break
            if not held and len(data) < _BLOCK:
                held = f.read(block)
                if not held:
                    return  # cut off: drop the last member
        yield at, used, b"".join(out)
        at += used


def parse_headers(block: bytes) -> tuple[str, dict[str, str]]:
    """First line and lower-cased headers; continued lines are joined."""
    lines = block.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    out: dict[str, str] = {}
    name = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return lines[0], out


#: Bytes of a record that an index needs: its own and its HTTP headers.
HEAD = 1 << 16


def _spare(headers: dict[str, str]) -> bool:
    """Whether an index can do without the body: its digest is given, or it has none to give."""
    return headers.get("warc-type") in ("request", "revisit") or "warc-payload-digest" in headers


def records(f, at: int = 0, index_only: bool = False, block: int = _BLOCK) -> Iterator[Record]:  # noqa: ANN001
    """The records of an open file from offset ``at`` of one on, in order.

    With ``index_only`` bodies whose digest the record names are passed over.
    """
    f.seek(at)
    zipped = f.read(2) == b"\x1f\x8b"
    f.seek(at)
    if zipped:
        for start, length, data in _members(f, at, HEAD if index_only else None, block):
            end = data.find(b"\r\n\r\n")
            if end < 0 or not data.startswith(b"WARC/"):
                continue
            _, headers = parse_headers(data[:end])
            size = int(headers.get("content-length", 0) or 0)
            if index_only and not _spare(headers) and len(data) < end + 4 + size:
                f2 = f.tell()
                f.seek(start)
                data = zlib.decompressobj(31).decompress(f.read(length))
                f.seek(f2)
            yield Record(start, length, headers, data[end + 4 : end + 4 + size])
        return
    buf = b""
    while True:
        while b"\r\n\r\n" not in buf:
            more = f.read(_BLOCK)
            if not more:
                return
            buf += more
        lead = len(buf) - len(buf.lstrip(b"\r\n"))
        if lead:
            buf, at = buf[lead:], at + lead
            continue
        end = buf.find(b"\r\n\r\n")
        line, headers = parse_headers(buf[:end])
        if not line.startswith("WARC/"):
            return
        size = int(headers.get("content-length", 0) or 0)
        need = end + 4 + size
        want = min(need, end + 4 + HEAD) if index_only and _spare(headers) else need
        while len(buf) < want:
            more = f.read(max(_BLOCK, want - len(buf)))
            if not more:
                return
            buf += more
        if need > len(buf):
            yield Record(at, need, headers, buf[end + 4 :])
            at += need
            f.seek(at)
            buf = b""
            continue
        yield Record(at, need, headers, buf[end + 4 : need])
        buf, at = buf[need:], at + need


def may_pair(a: Record, b: Record) -> bool:
    """A request and a response of one URL."""
    return a.url == b.url and (a.kind == "request") != (b.kind == "request") and "warcinfo" not in (a.kind, b.kind)


def in_range(rows: Iterator[Record], low: int, high: int | None) -> Iterator[Record]:
    """Records of a part of a file, so that runs of records that may pair stay together.

    A part begins at its first record that cannot pair with the one before, and
    ends where the next part begins; the first part begins with the file.
    """
    last: Record | None = None
    inside = low == 0
    beyond = False
    for r in rows:
        fresh = last is not None and not may_pair(last, r)
        if not inside and fresh:
            inside = True
        if high is not None and r.start >= high:
            if beyond and fresh:
                return
            beyond = True
        last = r
        if inside:
            yield r


def paired(rows: Iterator[Record]) -> Iterator[tuple[Record, Record | None]]:
    """Adjacent request and response of one URL together, else each alone."""
    last: Record | None = None
    for r in rows:
        if r.kind == "warcinfo":
            if last:
                yield last, None
                last = None
            yield r, None
            continue
        if last and may_pair(last, r):
            yield (r, last) if last.kind == "request" else (last, r)
            last = None
        else:
            if last:
                yield last, None
            last = r
    if last:
        yield last, None


def to_ms(iso: str | None) -> int | None:
    from datetime import UTC, datetime

    if not iso:
        return None
    try:
        t = datetime.fromisoformat(iso.replace("Z", "+00:00"))
    except ValueError:
        return None
    t = t if t.tzinfo else t.replace(tzinfo=UTC)
    return int(t.timestamp() * 1000 + 0.5)


def full_range(headers: dict[str, str]) -> bool:
    """A partial response that holds the whole body."""
    n, r = headers.get("content-length"), headers.get("content-range", "")
    return bool(n and n.isdigit() and r == f"bytes 0-{int(n) - 1}/{int(n)}")


def capture(record: Record, request: Record | None) -> dict | None:
    """A row of a record (with its request), None for what isn't kept."""
    url = record.url.partition("#")[0]
    kind = record.kind
    if kind not in ("response", "revisit", "resource") and not (kind == "metadata" and url.startswith("metadata://")):
        return None
    row: dict = {
        "url": url, "ts_ms": to_ms(record.headers.get("warc-date")), "digest": record.headers.get("warc-payload-digest"),
        "start": record.start, "length": record.length, "kind": kind, "status": 200, "status_text": "OK",
        "page_id": record.headers.get("warc-page-id"), "resp_headers": {}, "req_headers": {}, "method": "GET",
    }
    if request:
        line, row["req_headers"] = parse_headers(request.content.partition(b"\r\n\r\n")[0])
        row["method"] = line.split(" ")[0].upper() or "GET"
        row["cookie"] = row["req_headers"].get("cookie")
        if row["method"] in ("HEAD", "OPTIONS"):
            return None
    if kind == "revisit":
        row["mime"] = "warc/revisit"
        row["orig_url"] = record.headers.get("warc-refers-to-target-uri")
        row["orig_ts_ms"] = to_ms(record.headers.get("warc-refers-to-date"))
        if row["orig_url"] == url and row["orig_ts_ms"] == row["ts_ms"]:
            return None
        row["payload"] = None
        return row
    if kind in ("resource", "metadata"):
        row["mime"] = record.headers.get("content-type", "application/octet-stream").split(";")[0].strip()
        row["resp_headers"] = {"content-type": record.headers.get("content-type", "")}
        row["payload"] = record.content
        return row
    head, _, body = record.content.partition(b"\r\n\r\n")
    line, row["resp_headers"] = parse_headers(head)
    parts = line.split(" ", 2)
    row["status"] = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else 200
    row["status_text"] = parts[2].strip() if len(parts) > 2 else ""
    if row["status"] == 206 and not full_range(row["resp_headers"]):
        return None
    row["mime"] = row["resp_headers"].get("content-type", "").split(";")[0].strip() or None
    row["payload"] = body
    if not row["digest"]:
        row["digest"] = "sha-256:" + hashlib.sha256(body).hexdigest()
    return row


_FIELDS = [x.strip().split(" ")[0] for x in SCHEMA.replace("map<string,string>", "map").split(",")]


#: Bytes of a gzipped file that one task reads.
SPLIT = 64 << 20
#: Tasks that the ranges are dealt to: were there more ranges, a task reads several neighbours, one after the other.
TASKS = 512


class _Part(InputPartition):
    """A file as a whole, or its ranges of ``step`` bytes from ``low`` to ``high``; the last has no end."""

    def __init__(self, path: str, low: int = 0, high: int = 0, step: int = 0, last: bool = True) -> None:
        self.path, self.low, self.high, self.step, self.last = path, low, high, step, last

    def ranges(self) -> Iterator[tuple[int, int | None]]:
        if not self.step:
            yield 0, None
        for low in range(self.low, self.high, self.step or 1):
            yield low, None if self.last and low + self.step >= self.high else low + self.step


class _Reader(DataSourceReader):
    """Gzipped files are cut into ranges of members; plain ones, whose record
    boundaries cannot be told from inside, are read by one task each."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options.get("path", "")
        self.payload = options.get("payload", "true").lower() != "false"
        self.info_only = options.get("infoonly", "false").lower() == "true"
        self.split = int(options.get("splitbytes", SPLIT))

    def _files(self) -> list[str]:
        return expand(self.path)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        sizes = {p: file_size(p) if p.endswith(".gz") and not self.info_only else 0 for p in self._files()}
        at_once = max(1, -(-sum(sizes.values()) // (self.split * TASKS))) * self.split
        for p, size in sizes.items():
            if size <= self.split:
                out.append(_Part(p))
            else:
                out += [_Part(p, a, min(a + at_once, size), self.split, a + at_once >= size) for a in range(0, size, at_once)]
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        block = max(1 << 14, min(_BLOCK, self.split))
        with open_file(partition.path) as f:
            for low, high in partition.ranges():
                at = low and _first_member(f, low, block)
                if at is None:
                    return
                yield from self._rows(partition.path, in_range(records(f, at, not self.payload, block), low, high))

    def _rows(self, path: str, rows: Iterator[Record]) -> Iterator[tuple]:
        for seq, (record, request) in enumerate(paired(rows)):
            if self.info_only:
                if record.kind != "warcinfo":
                    return
                yield tuple({"kind": "warcinfo", "payload": record.content, "path": path, "seq": seq}.get(c) for c in _FIELDS)
                continue
            row = capture(record, request)
            if row is None:
                continue
            row |= {"path": path, "seq": record.start}
            if not self.payload:
                row["payload"] = None
            yield tuple(row.get(c) for c in _FIELDS)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def info_rows(info: DataFrame) -> DataFrame:
    """(path, title, desc, pages) of warcinfo rows as read with ``infoonly`` (SC6); pages as an array."""
    meta = F.regexp_extract(F.decode("payload", "UTF-8"), r"(?im)^json-metadata:\s*(.*?)\s*$", 1)
    kind = "title string, desc string, pages array<struct<id: string, url: string, title: string, timestamp: string>>"
    return info.select("path", F.from_json(meta, kind).alias("m")).where("m is not null").select("path", "m.title", "m.desc", "m.pages")


_SINK = "url string, ts_ms long, status int, mime string, payload binary, method string, orig_url string, orig_ts_ms long, digest string, request_first boolean"


def _iso(ms: int) -> str:
    from datetime import UTC, datetime

    ms = int(ms)  # a column with nulls comes as floats
    return datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"


def _block(kind: str, url: str, ms: int, content: bytes, **more: str | None) -> bytes:
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Target-URI: {url}", f"WARC-Date: {_iso(ms)}", f"Content-Length: {len(content)}"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in more.items() if v is not None]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def capture_records(row: dict) -> list[bytes]:
    """The records of a capture: a revisit, or a response with its request."""
    if row["mime"] == "warc/revisit":
        date = _iso(row["orig_ts_ms"]) if row["orig_ts_ms"] is not None else None
        return [_block("revisit", row["url"], row["ts_ms"], b"", WARC_Refers_To_Target_URI=row["orig_url"], WARC_Refers_To_Date=date, WARC_Payload_Digest=row["digest"])]
    body = row["payload"] or b""
    http = f"HTTP/1.1 {row['status']} X\r\nContent-Type: {row['mime']}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    out = [_block("response", row["url"], row["ts_ms"], http + body, WARC_Payload_Digest=row["digest"])]
    if row["method"]:
        out.append(_block("request", row["url"], row["ts_ms"], f"{row['method']} / HTTP/1.1\r\nAccept: */*\r\n\r\n".encode()))
    return out[::-1] if row["request_first"] else out


def write_warc(captures: DataFrame, folder: str, info: dict | None = None, files: int | None = None) -> DataFrame:
    """Captures as gzipped WARC files of ``folder``; (path, n) of those written.

    Each partition is a file, or with ``files`` a part of one of so many: parts are written by tasks of
    their own and then put together, as members of gzip may be. A file is written under a name of its
    attempt and renamed when whole, so that a task that is run again leaves one file.
    """
    head = _block("warcinfo", "", 0, f"software: palimpsest\r\njson-metadata: {json.dumps(info or {})}\r\n".encode())
    names = [x.strip().split(" ")[0] for x in _SINK.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        k = context.partitionId()
        name = f"{folder}/part-{k:05d}.warc.gz" if files is None else f"{folder}-parts/{k:05d}"
        held = f"{name}.{context.taskAttemptId()}"
        n = 0
        with create_file(held) as f:
            if files is None:
                f.write(gzip.compress(head, mtime=0))
            for b in batches:
                columns = [b[c].astype(object).where(b[c].notna(), None) for c in names]
                for values in zip(*columns, strict=True):
                    for x in capture_records(dict(zip(names, values, strict=True))):
                        f.write(gzip.compress(x, mtime=0))
                n += len(b)
        move_file(held, name)
        yield pd.DataFrame({"path": [name], "n": [n], "file": [k % files if files else k]})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, parts, n in zip(b["file"], b["parts"], b["n"], strict=True):
                name = f"{folder}/part-{file:05d}.warc.gz"
                held = f"{name}.{TaskContext.get().taskAttemptId()}"
                with create_file(held) as f:
                    f.write(gzip.compress(head, mtime=0))
                    for p in sorted(parts):
                        with open_file(p) as part:
                            while data := part.read(8 << 20):
                                f.write(data)
                move_file(held, name)
                yield pd.DataFrame({"path": [name], "n": [n]})

    fields = [x.strip().split(" ") for x in _SINK.split(",")]
    have = set(captures.columns)
    rows = captures.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in fields))
    written = durable(rows.mapInPandas(run, "path string, n long, file int"))
    if files is None:
        return written.select("path", "n")
    parts = written.groupBy("file").agg(F.collect_list("path").alias("parts"), F.sum("n").alias("n"))
    whole = durable(parts.repartitionByRange(files, "file").mapInPandas(join, "path string, n long"))
    remove_folder(f"{folder}-parts")
    return whole


def read_record(path: str, start: int, length: int) -> Record | None:
    """One record by its byte range (SC8)."""
    import io

    return next(records(io.BytesIO(read_range(path, start, length))), None)


def info_pages(content: bytes) -> dict:
    """Title, description, pages and lists of a warcinfo block's JSON metadata (SC6)."""
    fields = parse_headers(b"\n" + content)[1]
    try:
        return json.loads(fields.get("json-metadata", "{}"))
    except ValueError:
        return {}
