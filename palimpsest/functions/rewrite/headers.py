"""Response headers for replay."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.urls import rewrite_url

OLD = "X-Archive-Orig-"
KEEP = {"accept-patch", "accept-ranges", "allow", "content-disposition", "content-language", "content-range", "content-type", "date", "proxy-authenticate", "www-authenticate"}
LOCATIONS = {"content-base", "content-location", "location"}
CORS = {f"access-control-{x}" for x in ("allow-origin", "allow-credentials", "expose-headers", "max-age", "allow-methods", "allow-headers")}
RENAME = set(
    "age alt-svc cache-control connection content-md5 content-security-policy content-security-policy-report-only etag expires last-modified p3p pragma"
    " public-key-pins referrer-policy retry-after server status strict-transport-security trailer transfer-encoding tk upgrade upgrade-insecure-requests"
    " vary via warning x-frame-options x-xss-protection origin-agent-cluster".split()
)


def policy(name: Column, url_rewrite: bool = True, content_rewrite: bool = True) -> Column:
    """keep, rename, url, link or length, for a lower-case header name."""
    renamed = RENAME | (CORS if url_rewrite else set()) | ({"content-encoding"} if content_rewrite else set())
    urls = sorted(LOCATIONS) if url_rewrite else []
    out = F.when(name.isin(*sorted(renamed)), "rename")
    if urls:
        out = out.when(name.isin(*urls), "url")
    out = out.when(name == "link", "link" if url_rewrite else "keep")
    if content_rewrite:
        out = out.when(name == "content-length", "length")
    return out.otherwise("keep")


def rename_headers(headers: Column, url_rewrite: bool = True, content_rewrite: bool = True) -> Column:
    """Headers with the archived ones renamed, as a map; links and locations are left to the scalar form."""
    return F.transform_keys(
        headers, lambda k, _: F.when(policy(F.lower(k), url_rewrite, content_rewrite) == "rename", F.concat(F.lit(OLD.lower()), F.lower(k))).otherwise(F.lower(k))
    )


_LINK = re.compile(r"<([^>]*)>((?:\s*;\s*[^,;]+(?:=(?:\"[^\"]*\"|[^,;]*))?)*)")


def rewrite_link(value: str, prefix: str, base: str, preload_only: bool = False) -> str:
    """A Link header with its targets rewritten; for scripts' requests only preloads."""

    def one(m: re.Match) -> str:
        if preload_only and not re.search(r"rel\s*=\s*\"?\s*(?:module)?preload", m[2], re.I):
            return m[0]
        return f"<{rewrite_url(m[1], prefix, base)}>{m[2]}"

    return _LINK.sub(one, value)


def rewrite_headers(headers: dict[str, str], prefix: str, base: str, url_rewrite: bool = True, content_rewrite: bool = True, ajax: bool = False) -> dict[str, str]:
    """All headers of one response."""
    out: dict[str, str] = {}
    for name, value in headers.items():
        n = name.lower()
        if n in RENAME or (url_rewrite and n in CORS) or (content_rewrite and n == "content-encoding"):
            out[OLD.lower() + n] = value
        elif url_rewrite and n in LOCATIONS:
            out[n] = rewrite_url(value, prefix, base)
        elif url_rewrite and n == "link":
            out[n] = rewrite_link(value, prefix, base, preload_only=ajax)
        elif content_rewrite and n == "content-length":
            out[OLD.lower() + n] = value
        else:
            out[n] = value
    return out


def link_column(value: Column, prefix: str) -> Column:
    """Column form of H17 for absolute targets."""
    return F.regexp_replace(value, r"<(https?://[^>]*)>", f"<{prefix}$1>")
