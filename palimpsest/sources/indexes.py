"""CDXJ and sparse index files, page lists, archive manifests."""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.timestamps import page_ts, ts_to_ms
from palimpsest.functions.urls import post_urls
from palimpsest.session import durable
from palimpsest.sources.files import create_file, expand, file_size, move_file, open_file, read_member, remove_folder, text_lines, zip_entries
from palimpsest.sources.warc import SPLIT, WarcSource, _first_member, _Reader, capture, in_range, paired, records

_CDX = "url string, mime string, status string, digest string, length string, offset string, filename string, timestamp string, method string, requestBody string, referrer string"


def read_cdxj(spark: SparkSession, path: str) -> DataFrame:
    """Captures of ``urlkey ts {json}`` or bare ``{json}`` lines, plain or gzipped (SC9, SC10).

    Lines that can't be read are skipped; HEAD and OPTIONS too; status defaults
    to 200; a digest without algorithm is taken for SHA-1; a bare line keeps the
    timestamp of its JSON.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    return parse_cdxj(lines)


def parse_cdxj(lines: DataFrame) -> DataFrame:
    j = F.regexp_extract("line", r"(\{.*\})\s*\z", 1)
    stamp = F.regexp_extract("line", r"^\S+ ([0-9]{4,17}) \{", 1)
    rows = lines.where(j != "").select(F.from_json(j, _CDX).alias("c"), stamp.alias("_ts"), F.regexp_extract("line", r"^(\S+) [0-9]", 1).alias("_key"))
    rows = rows.where("c.url is not null")
    status = F.coalesce(F.col("c.status").try_cast("int"), F.lit(200))
    digest = F.when(F.col("c.digest").contains(":"), F.col("c.digest")).otherwise(F.concat(F.lit("sha1:"), F.col("c.digest")))
    out = rows.select(
        F.nullif(F.col("_key"), F.lit("")).alias("urlkey"), F.substring_index("c.url", "#", 1).alias("url"),
        ts_to_ms(F.when(F.col("_ts") != "", F.col("_ts")).otherwise(F.col("c.timestamp"))).alias("ts_ms"),
        status.alias("status"), F.col("c.mime").alias("mime"), digest.alias("digest"), F.upper(F.coalesce("c.method", F.lit("GET"))).alias("method"),
        F.col("c.requestBody").alias("request_body"), F.col("c.referrer").alias("referrer"),
        F.struct(F.col("c.filename").alias("path"), F.col("c.offset").try_cast("long").alias("start"), F.col("c.length").try_cast("long").alias("length")).alias("source"),
    )
    kept = out.where(~F.col("method").isin("HEAD", "OPTIONS"))
    # requests with a body are told apart by it: only they go through Python
    posted = F.col("method").isin("POST", "PUT") & F.col("request_body").isNotNull()
    plain, mime = kept.where(~posted), F.lit("application/x-www-form-urlencoded")
    return plain.unionByName(kept.where(posted).withColumn("url", post_urls("url", "request_body", mime, "method")))


def parse_idx(lines: DataFrame, archive: str | Column) -> DataFrame:
    """Blocks of a sparse index (SC18): tab-separated or ``key {json}`` lines; ``!meta`` heads the file."""
    body = lines.where("line <> '' and not startswith(line, '!meta')")
    tabs = F.split("line", "\t")
    j = F.from_json(F.regexp_extract("line", r"(\{.*\})", 1), "filename string, offset long, length long, digest string")
    is_json = F.col("line").rlike(r"\{.*\}")
    pick = lambda name, i, t: F.when(is_json, F.col(f"_j.{name}")).otherwise(F.try_element_at(tabs, F.lit(i)).try_cast(t))
    return body.withColumn("_j", j).select(
        (archive if isinstance(archive, Column) else F.lit(archive)).alias("archive"), F.when(is_json, F.trim(F.regexp_extract("line", r"^([^{]*)", 1))).otherwise(tabs[0]).alias("prefix"),
        pick("filename", 2, "string").alias("filename"), pick("offset", 3, "long").alias("offset"), pick("length", 4, "long").alias("length"),
        F.col("_j.digest").alias("digest"), F.lit(False).alias("loaded"),
    )


def parse_pages(lines: DataFrame) -> DataFrame:
    """Pages of a JSON-lines list, its header line dropped (SC17)."""
    page = "id string, url string, title string, text string, ts string, timestamp string, date string, datetime string, size long, state int"
    rows = lines.select(F.from_json("line", page).alias("p"), F.col("line").alias("extra")).where("p.url is not null")
    time = page_ts(F.col("p.ts").try_cast("long"), F.col("p.timestamp"), F.coalesce("p.ts", "p.date", "p.datetime"))
    return rows.select("p.id", "p.url", F.coalesce("p.title", "p.url").alias("title"), time.alias("ts_ms"), "p.text", "p.state", "extra")


def manifest(path: str) -> dict:
    """An archive's manifest and kind: leaf, multi (other archives) or legacy (SC16)."""
    names = [e["filename"] for e in zip_entries(path)]
    if "datapackage.json" in names:
        data = json.loads(read_member(path, "datapackage.json"))
        kind = "multi" if data.get("profile") == "multi-wacz-package" else "leaf"
    elif "webarchive.yaml" in names:
        import yaml

        data, kind = yaml.safe_load(read_member(path, "webarchive.yaml")) or {}, "legacy"
    else:
        data, kind = {}, "leaf"
    return {"kind": kind, "data": data, "files": names}


class _WaczReader(_Reader):
    """WARC members of archives; each is read in ranges like a file of its own."""

    def _files(self) -> list[str]:
        return [f"{p}#!/{e['filename']}" for p in expand(self.path) if p.endswith((".wacz", ".zip")) for e in zip_entries(p) if e["filename"].endswith((".warc", ".warc.gz"))]


class WaczSource(WarcSource):
    @classmethod
    def name(cls) -> str:
        return "wacz"

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _WaczReader(dict(self.options))


def member_lines(spark: SparkSession, path: str, ends: tuple[str, ...], start: str = "") -> DataFrame:
    """(archive, line) of the text members of archives, read where the archives are: no line passes the driver.
    A member is read line by line, however long it is."""
    paths = [p for p in expand(path) if p.endswith((".wacz", ".zip"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                for e in zip_entries(p):
                    if e["filename"].startswith(start) and e["filename"].endswith(ends):
                        for lines in text_lines(p, e["filename"]):
                            yield pd.DataFrame({"archive": p, "line": pd.Series(lines, dtype=object)})

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return rows.mapInPandas(run, "archive string, line string")


def read_wacz(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """captures, index, blocks and pages of an archive or a folder of them (SC19, SC20).

    Nothing is read until a table is used; WARC members by the ``wacz`` source,
    index and page members line by line in tasks of their own.
    """
    spark.dataSource.register(WaczSource)
    lines = member_lines(spark, path, (".idx",))
    return {
        "captures": spark.read.format("wacz").load(path),
        "index": parse_cdxj(member_lines(spark, path, (".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz"))),
        "blocks": parse_idx(lines, F.col("archive")),
        "pages": parse_pages(member_lines(spark, path, (".jsonl",), "pages/")),
    }


def multi_manifest(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Archives and initial pages of a multi-archive JSON (SC21)."""
    j = json.loads(text)
    archives = [(r.get("name"), (r.get("hash") or "").split(":")[-1] or None, r.get("path"), r.get("crawlId")) for r in j.get("resources", [])]
    pages = [(p.get("id"), p.get("url"), p.get("title"), p.get("ts"), p.get("filename"), p.get("crawl_id")) for p in j.get("initialPages", [])]
    return (
        spark.createDataFrame(archives, "name string, hash string, path string, crawl_id string"),
        spark.createDataFrame(pages, "id string, url string, title string, ts string, filename string, crawl_id string"),
    )


def pages_with_archives(pages: DataFrame, archives: DataFrame) -> DataFrame:
    """Pages with the hash of the archive they come from."""
    a = archives.select(F.col("name").alias("filename"), F.col("hash").alias("archive"))
    return pages.join(a, "filename", "left")


def write_wacz(files: DataFrame, folder: str, title: str = "") -> DataFrame:
    """One archive for each WARC file of ``files`` (path): the file as it is, a CDXJ index of its records,
    its HTML captures as pages, and a manifest with hashes. Returns (path, n) of the archives.

    Index and pages are written range by range of the WARC files, by tasks of their own; an archive is
    then put together from them. Nothing is held in memory but a block.
    """
    parts = f"{folder}-parts"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                size = file_size(p) if p.endswith(".gz") else 0
                lows = range(0, max(size, 1), SPLIT)
                yield pd.DataFrame({"path": p, "low": lows, "high": [*lows[1:], -1]})

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, low, high in zip(b["path"], b["low"], b["high"], strict=True):
                names = [f"{parts}/{_stem(p)}-{low:015d}.{kind}" for kind in ("cdxj", "jsonl")]
                held = [f"{x}.{TaskContext.get().taskAttemptId()}" for x in names]
                n = 0
                with open_file(p) as f, create_file(held[0]) as lines, create_file(held[1]) as pages:
                    at = low and _first_member(f, low)
                    rows = in_range(records(f, at, index_only=True), low, None if high < 0 else high) if at is not None else iter(())
                    for r in (capture(*x) for x in paired(rows)):
                        if r is None:
                            continue
                        n += 1
                        j = {"url": r["url"], "mime": r["mime"], "status": str(r["status"]), "digest": r["digest"], "offset": str(r["start"]), "length": str(r["length"]), "filename": "data.warc.gz"}
                        lines.write(f"\n{r['url']} {_ts14(r['ts_ms'])} {json.dumps(j)}".encode())
                        if r["mime"] == "text/html":
                            pages.write(("\n" + json.dumps({"id": f"p{r['start']}", "url": r["url"], "ts": str(r["ts_ms"])})).encode())
                for x, name in zip(held, names, strict=True):
                    move_file(x, name)
                yield pd.DataFrame({"path": [p], "low": [low], "cdxj": [names[0]], "jsonl": [names[1]], "n": [n]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, made, n in zip(b["path"], b["parts"], b["n"], strict=True):
                name = f"{folder}/{_stem(p)}.wacz"
                held = f"{name}.{TaskContext.get().taskAttemptId()}"
                first = '{"format": "json-pages-1.0", "id": "pages", "title": "All Pages"}'
                members = {
                    "archive/data.warc.gz": _blocks([p]), "indexes/index.cdxj": _blocks([x["cdxj"] for x in made], skip=1),
                    "pages/pages.jsonl": chain([first.encode()], _blocks([x["jsonl"] for x in made])),
                }
                resources = []
                with create_file(held) as f, zipfile.ZipFile(f, "w") as z:
                    for k, blocks in members.items():
                        told, size = hashlib.sha256(), 0
                        with z.open(_entry(k), "w", force_zip64=True) as m:
                            for data in blocks:
                                m.write(data)
                                told.update(data)
                                size += len(data)
                        resources.append({"path": k, "hash": "sha256:" + told.hexdigest(), "bytes": size})
                    z.writestr(_entry("datapackage.json"), json.dumps({"profile": "data-package", "title": title, "resources": resources}))
                move_file(held, name)
                yield pd.DataFrame({"path": [name], "n": [n]})

    ranges = durable(files.select("path").mapInPandas(cut, "path string, low long, high long"))
    n_ranges, n_files = ranges.count(), ranges.where("low = 0").count()
    made = ranges.repartitionByRange(max(1, n_ranges), "path", "low").mapInPandas(index, "path string, low long, cdxj string, jsonl string, n long")
    whole = durable(made).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("low", "cdxj", "jsonl"))).alias("parts"), F.sum("n").alias("n"))
    out = durable(whole.repartitionByRange(max(1, n_files), "path").mapInPandas(pack, "path string, n long"))
    if n_files:
        remove_folder(parts)
    return out


def _stem(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def _entry(name: str) -> zipfile.ZipInfo:
    """A member; what is zipped already is stored as it is."""
    entry = zipfile.ZipInfo(name)
    entry.compress_type = zipfile.ZIP_STORED if name.endswith(".gz") else zipfile.ZIP_DEFLATED
    return entry


def _blocks(paths: list[str], skip: int = 0) -> Iterator[bytes]:
    """Blocks of files, one after the other, without the first ``skip`` bytes."""
    for p in paths:
        with open_file(p) as f:
            while data := f.read(1 << 20):
                yield data[skip:]
                skip = max(0, skip - len(data))


def _ts14(ms: int) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y%m%d%H%M%S")


def manifests(archives: DataFrame) -> DataFrame:
    """(path, kind, member, hash) of the manifests of archives (SC13, SC16), read by tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                m = manifest(p)
                listed = {r.get("path"): r.get("hash") for r in m["data"].get("resources", [])}
                yield pd.DataFrame({"path": p, "kind": m["kind"], "member": pd.Series(m["files"], dtype=object), "hash": pd.Series([listed.get(n) for n in m["files"]], dtype=object)})

    return archives.select("path").mapInPandas(run, "path string, kind string, member string, hash string")
