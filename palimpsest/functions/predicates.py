"""Boolean columns over captures and requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mime_in(mime: Column, prefixes: str | None) -> Column:
    """Starts with one of a comma list; an empty element takes all; null mimes only then."""
    parts = (prefixes or "").split(",")
    if "" in [p.strip() for p in parts]:
        return F.lit(True)
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(mime.startswith(p.strip()), F.lit(False))
    return out


def of_page(page: Column, wanted) -> Column:  # noqa: ANN001
    """Captures of a page; those of no page pass."""
    return page.isNull() | (page == wanted)


def not_revisit(mime: Column) -> Column:
    return ~F.coalesce(mime == "warc/revisit", F.lit(False))


def is_page(url: Column, status: Column, mime: Column) -> Column:
    """Whether a capture looks like a page a reader would open."""
    path = F.regexp_extract(url, r"^[a-z]+:(?://[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    last = F.regexp_extract(path, r"([^/]*)\z", 1)
    web = F.lower(url).startswith("http://") | F.lower(url).startswith("https://") | F.lower(url).startswith("blob:")
    html = mime.isNull() | (mime == "") | mime.startswith("text/html")
    return web & (status == 200) & ~path.endswith("/robots.txt") & (F.length(query) <= F.length(path)) & ~last.startswith(".") & html


def same_url(a: Column, b: Column, method: Column) -> Column:
    """Equal, equal once percent-decoded, or a prefix for other methods than GET."""
    plain = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    other = F.coalesce(method, F.lit("GET")) != "GET"
    return (a == b) | F.coalesce(plain(a) == plain(b), F.lit(False)) | (other & b.startswith(a))


def time_agrees(ts: Column, wanted: Column) -> Column:
    """Equal, or equal once cut to seconds (F8)."""
    return (ts == wanted) | (F.floor(ts / 1000) * 1000 == wanted)


def digest_agrees(a: Column, b: Column) -> Column:
    """Equal whatever the algorithm's label."""
    bare = lambda c: F.regexp_replace(c, r"^[^:]*:", "")
    return bare(a) == bare(b)


def null_body(status: Column) -> Column:
    return status.isin(101, 204, 205, 304)


def starts_with_any(value: Column, prefixes: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(value, p)) if prefixes else F.lit(False)


def contains_any(value: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(value, p)) if parts else F.lit(False)


def is_ajax(headers: Column, mode: Column, destination: Column) -> Column:
    """Requests made by a page's script."""
    marked = F.coalesce(F.lower(headers["x-requested-with"]) == "xmlhttprequest", F.lit(False))
    no_page = F.coalesce(destination, F.lit("")) == ""
    return marked | (no_page & F.coalesce(mode, F.lit("")).isin("cors", "same-origin"))


_RANGE_ARG = r"([?&])(?:range=[0-9]+-[0-9]*|bytestart=[0-9]+&byteend=[0-9]+)(?=&|\z)"


def has_range_query(url: Column) -> Column:
    """URLs that ask for a byte range in their query."""
    return url.rlike(_RANGE_ARG)


def strip_range_query(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, _RANGE_ARG, "$1"), r"([?&])&+", "$1"), r"[?&]\z", "")


def uses_globals(script: Column) -> Column:
    """Scripts that name a global the wrapper shadows (F16)."""
    return script.rlike(r"\b(?:window|self|document|location|top|parent|frames|opener|globalThis|this|eval|postMessage)\b")


def full_range(content_range: Column, content_length: Column) -> Column:
    """A 206 that holds the whole body (SC5)."""
    n = content_length.cast("long")
    return content_range == F.concat(F.lit("bytes 0-"), (n - 1).cast("string"), F.lit("/"), n.cast("string"))
