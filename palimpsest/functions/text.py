"""Text of pages, character sets, content encodings, byte ranges."""

from __future__ import annotations

import gzip
import re
import zlib
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIP = set("banner-div footer header noscript script style".split())
_OPEN = re.compile("<")


class _Text(HTMLParser):
    """Text tokens outside skipped elements. Only the last opened one is known: its end ends the skipping.

    The parser stops at tags alone: references stay as they are written, whole or not.
    """

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.open: str | None = None
        self.parts: list[str] = []
        self.held = ""

    def reset(self) -> None:
        super().reset()
        self.interesting = _OPEN

    def clear_cdata_mode(self) -> None:
        super().clear_cdata_mode()
        self.interesting = _OPEN

    def flush(self) -> None:
        text = self.held.strip()
        if text and self.open is None:
            self.parts.append(text)
        self.held = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        if tag in SKIP:
            self.open = tag

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.flush()

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if tag == self.open:
            self.open = None

    def handle_data(self, data: str) -> None:
        self.held += data

    def handle_comment(self, data: str) -> None:
        self.flush()


def extract_text(html: str | None) -> str | None:
    """Visible text of a page, tokens trimmed and joined by one space (H1)."""
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    p.flush()
    return " ".join(p.parts)


@F.pandas_udf(T.StringType())
def page_text(html: pd.Series) -> pd.Series:
    return html.map(extract_text, na_action="ignore")


_CHARSET = r"(?i)<meta[^>]+charset\s*=\s*[\"']?\s*([a-z0-9_:.-]+)"


def charset(html: Column) -> Column:
    """The character set a page declares within its first 1024 characters; null for none (H6)."""
    return F.nullif(F.lower(F.regexp_extract(F.substring(html, 1, 1024), _CHARSET, 1)), F.lit(""))


def decode_text(body: Column, declared: Column) -> Column:
    """Bytes as text by byte order mark, else by the declared set, else UTF-8 (U16)."""
    mark = F.hex(F.substring(body, 1, 3))
    rest = lambda n: F.substring(body, n + 1, 2147483647)
    return (
        F.when(mark.startswith("EFBBBF"), F.decode(rest(3), "UTF-8"))
        .when(mark.startswith("FFFE"), F.decode(rest(2), "UTF-16LE"))
        .when(mark.startswith("FEFF"), F.decode(rest(2), "UTF-16BE"))
        .when(F.lower(declared).isin("latin1", "iso-8859-1", "windows-1252"), F.decode(body, "ISO-8859-1"))
        .otherwise(F.try_validate_utf8(body.cast("string")))
    )


def dechunk(data: bytes) -> bytes:
    """A chunked body joined; data that isn't chunked as it is."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n", at)
        if end < 0:
            return data if not out else b"".join(out)
        try:
            size = int(data[at:end].split(b";")[0].strip() or b"x", 16)
        except ValueError:
            return data if not out else b"".join(out)
        if size == 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def decode_body(data: bytes | None, content: str | None, transfer: str | None) -> bytes | None:
    """Transfer and content encodings undone; what cannot be decoded stays (H27). Brotli needs a module that may be absent."""
    if data is None:
        return None
    if transfer and "chunked" in transfer.lower():
        data = dechunk(data)
    kind = (content or "").lower().strip()
    try:
        if kind in ("gzip", "x-gzip"):
            return gzip.decompress(data)
        if kind == "deflate":
            try:
                return zlib.decompress(data)
            except zlib.error:
                return zlib.decompress(data, -15)
        if kind == "br":
            try:
                import brotli
            except ImportError:
                return data
            return brotli.decompress(data)
    except (OSError, EOFError, zlib.error, ValueError):
        return data
    return data


@F.pandas_udf(T.BinaryType())
def decoded(data: pd.Series, content: pd.Series, transfer: pd.Series) -> pd.Series:
    return pd.Series([decode_body(d, c, t) for d, c, t in zip(data, content, transfer, strict=True)], dtype=object)


def byte_range(payload: Column, header: Column) -> dict[str, Column]:
    """status, content_range and body for a Range header (H28): 206, or 416 when it starts beyond the end."""
    n = F.octet_length(payload).cast("long")
    lo = F.regexp_extract(header, r"^bytes=([0-9]*)-([0-9]*)\z", 1)
    hi = F.regexp_extract(header, r"^bytes=([0-9]*)-([0-9]*)\z", 2)
    start = F.when(lo == "", F.greatest(n - hi.try_cast("long"), F.lit(0))).otherwise(lo.try_cast("long"))
    end = F.when((lo == "") | (hi == ""), n - 1).otherwise(F.least(hi.try_cast("long"), n - 1))
    asked = (lo != "") | (hi != "")
    ok = asked & (start < n) & (start <= end)
    return {
        "status": F.when(~asked | header.isNull(), 200).when(ok, 206).otherwise(416),
        "content_range": F.when(asked, F.when(ok, F.format_string("bytes %d-%d/%d", start, end, n)).otherwise(F.format_string("bytes */%d", n))),
        "body": F.when(~asked | header.isNull(), payload).when(ok, F.substring(payload, (start + 1).cast("int"), (end - start + 1).cast("int"))),
    }
