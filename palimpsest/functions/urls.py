"""URL columns: replay addresses, rewriting, SURT keys, suffixes, cookies."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemes whose links are left alone.
INERT = ("#", "{", *(f"{scheme}:" for scheme in "about blob data file javascript mailto".split()))
_MODIFIER = r"([a-z]+_|\$[-.:0-9a-z]+)?"
_REPLAY = rf"^(?:\:([^/]+)/)?([0-9]*){_MODIFIER}(?:%7C|[/|])(.+)\z"


def parse_replay(path: Column) -> dict[str, Column]:
    """page_id, ts, modifier, url and fragment of a replay path (U1); nulls where it isn't one."""
    part = lambda i: F.nullif(F.regexp_extract(path, _REPLAY, i), F.lit(""))
    url = part(4)
    return {
        "page_id": part(1),
        "ts": part(2),
        "modifier": part(3),
        "url": F.substring_index(url, "#", 1),
        "fragment": F.when(F.instr(url, "#") > 0, F.regexp_extract(url, r"(#.*)\z", 1)),
    }


#: A path from the root of which nothing is resolved or encoded: no segment is empty or begins with a dot.
_PLAIN = re.compile(r"(?:/[A-Za-z0-9_~%@!$&'()*+,=:-][A-Za-z0-9_.~%@!$&'()*+,=:-]*)+")
_ABSOLUTE = re.compile(r"(?i)https?:(?:\\?/){2}|https?\\:")


@lru_cache(1 << 12)
def _root(base: str) -> str:
    """What comes before a path from the root of a page's site."""
    return _join(base, "/")[:-1]


@lru_cache(1 << 8)
def _prefix_forms(prefix: str) -> tuple[str, str]:
    """A replay prefix as a path alone, and without its scheme."""
    split = urlsplit(prefix)
    return urlunsplit(("", "", split.path, "", "")), "//" + split.netloc + split.path


def whatwg_join(base: str, url: str) -> str:
    """Absolute URL as browsers build it: host lower-cased, default port dropped, path encoded."""
    return _root(base) + url if _PLAIN.fullmatch(url) else _join(base, url)


def _join(base: str, url: str) -> str:
    parts = urlsplit(urljoin(base, url.strip()))
    scheme, host = parts.scheme.lower(), (parts.hostname or "")
    try:
        port = parts.port
    except ValueError:
        port = None
    if port and (scheme, port) not in (("http", 80), ("https", 443)):
        host = f"{host}:{port}"
    if parts.username is not None:
        host = f"{parts.username}{':' + parts.password if parts.password else ''}@{host}"
    path = quote(parts.path or ("/" if scheme in ("http", "https") else ""), safe="/%:@!$&'()*+,;=-._~|[]^`{}\\\"")
    query = quote(parts.query, safe="/%:@!$&'()*+,;=-._~?|[]^`{}\\")
    return urlunsplit((scheme, host, path, query, quote(parts.fragment, safe="/%:@!$&'()*+,;=-._~?|[]^`{}\\")))


def rewrite_url(url: str, prefix: str, base: str, force: bool = False, rewriting: bool = True) -> str:
    """A link turned into one of the replay prefix (U2, scalar form)."""
    if not rewriting or url is None:
        return url
    original, url = url, url.strip()
    if url.startswith("\\"):
        url = re.sub(r"\\(?!/)", "/", url)
    relative, scheme_relative = _prefix_forms(prefix)
    if not url or url.lower().startswith(INERT) or url.startswith((prefix, relative)):
        return original
    if _ABSOLUTE.match(url):
        return prefix + url
    if url.startswith("//") or url.startswith("\\/\\/"):
        return scheme_relative + url
    if url.startswith("/"):
        return relative + whatwg_join(base, url)
    if force or "../" in url:
        return prefix + whatwg_join(base, url)
    return original


def rewrite_links(url: Column, prefix: str, origin: Column) -> Column:
    """Column form of U2 where no path needs resolving: absolute, scheme- and root-relative links.

    ``origin`` is scheme and host of the page. Other links stay, as they do in
    the scalar form unless they climb or are forced.
    """
    split = urlsplit(prefix)
    relative, scheme_relative = split.path, "//" + split.netloc + split.path
    u = F.trim(url)
    inert = F.lit(False)
    for p in INERT:
        inert = inert | F.lower(u).startswith(p)
    same = (u == "") | inert | u.startswith(prefix) | u.startswith(relative)
    return (
        F.when(same, url)
        .when(F.lower(u).startswith("http://") | F.lower(u).startswith("https://"), F.concat(F.lit(prefix), u))
        .when(u.startswith("//"), F.concat(F.lit(scheme_relative), u))
        .when(u.startswith("/"), F.concat(F.lit(relative), origin, u))
        .otherwise(url)
    )


@F.pandas_udf(T.StringType())
def resolve(url: pd.Series, base: pd.Series) -> pd.Series:
    """URLs made absolute against their bases (U6); null where either is."""
    return pd.Series([None if u is None or b is None else whatwg_join(b, u) for u, b in zip(url, base, strict=True)])


def rewriter(prefix: str, force: bool = False):  # noqa: ANN201
    """Arrow UDF (url, base) for links that need resolving."""

    @F.pandas_udf(T.StringType())
    def run(url: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else rewrite_url(u, prefix, b or "", force) for u, b in zip(url, base, strict=True)])

    return run


def join_url(base: Column, to: Column) -> Column:
    """``to`` resolved against ``base`` in columns only (U6): scheme-, root- and path-relative
    references, queries and fragments alone, dot segments removed."""
    origin = origin_of(base)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    own, tail = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)\z", 1)
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    parts = F.split(joined, "/")
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
    walked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, p: F.when(p == "..", up(done)).when(p == ".", done).otherwise(F.concat(done, F.array(p))),
    )
    ends = F.element_at(parts, -1).isin(".", "..")
    clean = F.when(joined.contains("/."), F.concat(F.array_join(walked, "/"), F.when(ends, "/").otherwise(""))).otherwise(joined)
    bare = F.substring_index(base, "#", 1)
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), to)
        .when(to.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), to))
        .when(to == "", bare)
        .when(to.startswith("#"), F.concat(bare, to))
        .when(to.startswith("?"), F.concat(origin, F.when(path == "", "/").otherwise(path), to))
        .otherwise(F.concat(origin, clean, tail))
    )


def unrewrite(url: Column, prefix: str) -> Column:
    """The archived URL behind a rewritten one."""
    return F.when(url.startswith(prefix), F.substring(url, len(prefix) + 1, 1 << 20)).otherwise(url)


def origin_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def surt(url: Column) -> Column:
    """Sort-friendly key: host labels reversed, then path and query, lower-cased (U8)."""
    host = F.regexp_replace(host_of(url), r"^www[0-9]*\.", "")
    labels = F.concat_ws(",", F.reverse(F.split(host, r"\.")))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    path = F.when((rest == "") | rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(host == "", url).otherwise(F.lower(F.concat(labels, F.lit(")"), path)))


def is_surt(key: Column) -> Column:
    return key.rlike(r"^[\w-]+(?:,[\w-]+)*(?::[0-9]+)?\)/")


def prefix_upper_bound(prefix: str) -> str:
    """Least string above all that start with ``prefix``."""
    return prefix[:-1] + chr(ord(prefix[-1]) + 1) if prefix else prefix


def lev_score(a: Column, b: Column) -> Column:
    """Shorter length less the edit distance, 0 at least."""
    return F.greatest(F.lit(0), F.least(F.length(a), F.length(b)) - F.levenshtein(a, b))


def domain_suffixes(host: Column) -> Column:
    """The host and its parents down to two labels, without ``www``."""
    bare = F.regexp_replace(host, r"^www\.", "")
    labels = F.split(bare, r"\.")
    n = F.greatest(F.size(labels) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def cookies(header: Column, secure: Column) -> Column:
    """Set-Cookie for a page script: expiry, HttpOnly and, on plain http, Secure dropped."""
    parts = F.transform(F.split(header, ";"), lambda p: F.trim(p))
    keep = F.filter(
        parts,
        lambda p: ~(F.lower(p).startswith("expires=") | (F.lower(p) == "httponly") | ((F.lower(p) == "secure") & ~secure) | (p == "")),
    )
    return F.array_join(keep, "; ")


_STATUS = {
    100: "Continue", 101: "Switching Protocols", 200: "OK", 201: "Created", 202: "Accepted", 204: "No Content",
    206: "Partial Content", 300: "Multiple Choices", 301: "Moved Permanently", 302: "Found", 303: "See Other",
    304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect", 400: "Bad Request", 401: "Unauthorized",
    403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 410: "Gone", 416: "Range Not Satisfiable",
    429: "Too Many Requests", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}


def status_text(status: Column) -> Column:
    """Reason phrase of a status code (U14); 'Unknown Status' beyond the table."""
    known = F.create_map([F.lit(x) for kv in _STATUS.items() for x in kv])
    return F.coalesce(F.element_at(known, status.cast("int")), F.lit("Unknown Status"))


def attachment_name(url: Column) -> Column:
    """RFC 5987 file name for downloads (U15): the last path part, 'index' without one."""
    last = F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?\z", 1)
    name = F.when(last == "", F.lit("index")).otherwise(last)
    return F.concat(F.lit("attachment; filename*=UTF-8''"), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")))


def canonical_redirect(url: str) -> str | None:
    """Where a request must be sent first: browsers' spelling of the URL, if it differs."""
    if not url.startswith(("http://", "https://")):
        return None
    good = whatwg_join(url, url)
    return good if good != url else None


def tld_swap(url: Column, found: str, new: str) -> Column:
    """Proxy-origin mapping: one host suffix for another, scheme kept."""
    pattern = rf"^(https?://(?:[^/?#]*\.)?[^/?#.]+)\.{re.escape(found)}(?=[/?#:]|\z)"
    return F.regexp_replace(url, pattern, f"$1.{new}")


def upgrade_scheme(url: Column) -> Column:
    return F.regexp_replace(url, r"^http://", "https://")


def post_query(url: str, body: str, mime: str = "application/x-www-form-urlencoded", method: str = "POST") -> str:
    """A request with a body as a URL: the body's fields appended as query."""
    from palimpsest.functions.fuzzy_match import json_fields

    mime = mime.split(";")[0].strip().lower()
    if mime == "application/x-www-form-urlencoded":
        extra = body
    elif mime.endswith("json"):
        extra = "&".join(f"{quote(k, safe='')}={quote(v, safe='')}" for k, v in json_fields(body))
    elif mime.startswith("multipart/"):
        fields = re.findall(r'name="([^"]*)"\r?\n\r?\n(.*?)\r?\n--', body, re.S)
        extra = "&".join(f"{quote(k, safe='')}={quote(v, safe='')}" for k, v in fields)
    else:
        extra = "__wb_post_data=" + quote(body, safe="") if body else ""
    mark = f"__wb_method={method.upper()}"
    return url + ("&" if "?" in url else "?") + "&".join(x for x in (mark, extra) if x)


def truncate_query(url: str, total: int = 8192, each: int = 1024, key: int = 512) -> str:
    """Long appended queries shortened: names, values, then the whole."""
    head, mark, query = url.partition("?")
    if not mark:
        return url[:total]
    out = []
    for part in query.split("&"):
        k, eq, v = part.partition("=")
        out.append(k[:key] + eq + v[:each])
    return (head + "?" + "&".join(out))[:total]


def rewrite_by_patterns(url: Column, patterns: list[tuple[str, str]]) -> Column:
    """What the first pattern that changes the URL makes of it; null if none does."""
    tried = [F.regexp_replace(url, p, new) for p, new in patterns]
    return F.coalesce(*(F.when(t != url, t) for t in tried), F.lit(None).cast("string"))


def short_id(*parts: Column, size: int = 24) -> Column:
    """An identifier of hexadecimal digits that depends on ``parts`` only (U17), so that retried tasks agree."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, size)


@F.pandas_udf(T.StringType())
def post_urls(url: pd.Series, body: pd.Series, mime: pd.Series, method: pd.Series) -> pd.Series:
    """URLs of requests with a body, the body's fields appended and cut to length (U9, SC10)."""
    rows = zip(url, body, mime, method, strict=True)
    return pd.Series([None if u is None else truncate_query(post_query(u, b or "", m or "application/x-www-form-urlencoded", v or "POST")) for u, b, m, v in rows])
