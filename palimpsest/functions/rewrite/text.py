"""Styles, JSON and JSONP, import maps, domain rules, rewrite modes."""

from __future__ import annotations

import base64
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.urls import rewrite_url

_CSS_URL = re.compile(r"(url\s*\(\s*)(['\"]?)([^)'\"]*)(['\"]?)(\s*\))", re.I)
_CSS_IMPORT = re.compile(r"(@import\s+)(['\"])([^'\"]+)(['\"])", re.I)


def rewrite_css(text: str, prefix: str, base: str, modifier: str | None = None) -> str:
    """Style sheets: url() and @import targets rewritten."""

    def fix(url: str) -> str:
        u = url.strip()
        return url if not u or u.startswith("data:") else rewrite_url(u, prefix, base)

    text = _CSS_URL.sub(lambda m: m[1] + m[2] + fix(m[3]) + m[4] + m[5], text)
    return _CSS_IMPORT.sub(lambda m: m[1] + m[2] + fix(m[3]) + m[4], text)


_CALLBACK = r"[?&](?:callback|jsonp|cb|json)=([^&#]+)"
_JSONP = r"^(?:\s*(?:/\*(?:.|\n)*?\*/|//[^\n]*\n))*\s*([\w.$\[\]]+)\s*\((?=\s*[{\[\"'0-9]|\s*\))"


def jsonp_callback(url: Column) -> Column:
    """The callback a URL asks for, null for none or ``?``."""
    name = F.regexp_extract(url, "(?i)" + _CALLBACK, 1)
    return F.when((name != "") & (name != "?"), F.try_url_decode(name))


def rewrite_jsonp(text: Column, url: Column) -> Column:
    """Archived JSONP under the callback that the request names."""
    call = jsonp_callback(url)
    old = F.regexp_extract(text, _JSONP, 1)
    at = F.instr(text, F.concat(old, F.lit("(")))
    tail = F.substring(text, at + F.length(old), F.length(text))
    return F.when(call.isNotNull() & (old != "") & (at > 0), F.concat(call, tail)).otherwise(text)


def rewrite_jsonp_text(text: str, url: str) -> str:
    m, c = re.search(_JSONP, text), re.search(_CALLBACK, url, re.I)
    if not m or not c or c[1] == "?":
        return text
    return c[1] + text[m.end(1) :]


def rewrite_json(text: str, url: str, limit: int | None = None) -> str:
    """JSON: callback first, then the rules of the URL's domain."""
    return apply_rules(rewrite_jsonp_text(text, url), url, limit)


def rewrite_importmap(text: str, prefix: str, base: str) -> str:
    """Import maps: every target rewritten (H16); unreadable ones stay."""
    try:
        m = json.loads(text)
    except ValueError:
        return text
    fix = lambda d: {k: rewrite_url(v, prefix, base, force=True) if isinstance(v, str) else v for k, v in d.items()}
    if isinstance(m.get("imports"), dict):
        m["imports"] = fix(m["imports"])
    if isinstance(m.get("scopes"), dict):
        m["scopes"] = {rewrite_url(k, prefix, base, force=True): fix(v) for k, v in m["scopes"].items() if isinstance(v, dict)}
    return json.dumps(m)


#: (part of the URL, rules as (pattern, replacement)); the first part that occurs wins.
DOMAIN_RULES: list[tuple[tuple[str, ...], list[tuple[str, str]]]] = [
    (("youtube.com", "youtube-nocookie.com"), [(r'"(?:yt_dash|dash_mpd)":\s*"[^"]*"', '"dash_mpd":""'), (r'"(?:canAutoPlay)":\s*true', '"canAutoPlay":false')]),
    (("player.vimeo.com/video/",), [(r'"dash"\s*:', '"__dash":'), (r'"hls"\s*:', '"__hls":')]),
    (("instagram.com/",), [(r'"is_dash_eligible":\s*(?:true|1)', '"is_dash_eligible":false')]),
    (("facebook.com/",), [(r'"dash_(?:manifest|prefetch_experimental)":\s*"[^"]*"', '"dash_manifest":""'), (r'"supportsDash"\s*:\s*true', '"supportsDash":false')]),
]


def rules_for(url: str) -> list[tuple[str, str]]:
    """Rules of the first domain part that the URL contains."""
    return next((rules for parts, rules in DOMAIN_RULES if any(p in url for p in parts)), [])


def apply_rules(text: str, url: str, limit: int | None = None) -> str:
    """Domain rules, and video variants cut to the best allowed one."""
    for pattern, new in rules_for(url):
        text = re.sub(pattern, new, text)
    if "video_info" in text and '"variants"' in text:
        text = best_variant_json(text, limit or 5_000_000)
    return text


def best_variant_json(text: str, limit: int = 5_000_000) -> str:
    """``"variants":[…]`` lists cut to the best mp4 not above ``limit`` bits a second (T5)."""

    def cut(m: re.Match) -> str:
        try:
            rows = json.loads(m[1])
        except ValueError:
            return m[0]
        fit = [r for r in rows if str(r.get("content_type")) == "video/mp4" and 0 < int(r.get("bitrate") or 0) <= limit]
        if not fit:
            return m[0]
        return '"variants":' + json.dumps([max(fit, key=lambda r: r["bitrate"])], separators=(",", ":"))

    return re.sub(r'"variants"\s*:\s*(\[[^\]]*\])', cut, text)


def best_variant(variants: Column, limit: int) -> Column:
    """Of an array of (bitrate, content_type, url) the best mp4 within ``limit`` (T5)."""
    fit = F.filter(variants, lambda v: (v["content_type"] == "video/mp4") & (v["bitrate"] <= limit))
    return F.array_max(F.transform(fit, lambda v: F.struct(v["bitrate"].alias("bitrate"), v["url"].alias("url"))))["url"]


_SCRIPT_MIMES = [f"{kind}javascript" for kind in ("application/", "application/x-", "text/")]


def rewrite_mode(destination: Column, mime: Column, url: Column, modifier: Column, body: Column) -> Column:
    """Which rewriter a response needs (H19); '' for none."""
    path = F.lower(F.substring_index(F.substring_index(url, "#", 1), "?", 1))
    bare = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    jsonp = F.when(url.rlike("(?i)" + _CALLBACK), "jsonp")
    is_js = bare.isin(*_SCRIPT_MIMES) | path.endswith(".js")
    worker = modifier.isin("wkr_", "sw_", "wkrf_")
    script = F.coalesce(
        F.when(worker, "js-worker"), F.when(F.coalesce(modifier == "esm_", F.lit(False)), "js"), jsonp,
        F.when(path.endswith(".json") | bare.isin("application/json"), "json"), F.lit("js"),
    )
    sniffed = F.when(F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 1024)).contains("<html"), "html")
    by_mime = (
        F.when(bare.isin("text/html", "application/xhtml+xml"), "html")
        .when(bare == "text/css", "css")
        .when(bare.isin("application/x-mpegurl", "application/vnd.apple.mpegurl"), "hls")
        .when(bare == "application/dash+xml", "dash")
        .when(bare == "application/json", F.coalesce(jsonp, F.lit("json")))
        .when(is_js, script)
        .when(bare == "", F.coalesce(sniffed, F.lit("")))
        .otherwise("")
    )
    d = F.coalesce(destination, F.lit(""))
    return F.when(d == "style", "css").when(d == "script", script).when(d == "worker", "js-worker").otherwise(by_mime)


def decode_script_base64(text: str) -> str | None:
    """The script of a base64 data URL, None for other text."""
    m = re.match(r"data:(?:text|application)/(?:x-)?javascript;base64,([A-Za-z0-9+/=]+)\Z", text)
    if not m:
        return None
    try:
        return base64.b64decode(m[1], validate=True).decode()
    except ValueError:
        return None


def rewrite_script_base64(text: str, rewrite) -> str:  # noqa: ANN001
    script = decode_script_base64(text)
    if script is None:
        return text
    head = text[: text.index(",") + 1]
    return head + base64.b64encode(rewrite(script).encode()).decode()


def not_found_body(destination: Column, url: Column) -> Column:
    """Body for a missing resource by what asked for it."""
    d = F.coalesce(destination, F.lit(""))
    said = F.concat(F.lit("Not in this archive: "), url)
    return (
        F.when(d == "script", F.concat(F.lit("/* "), F.replace(said, F.lit("*/"), F.lit("* /")), F.lit(" */")))
        .when(d == "style", F.concat(F.lit("/* "), F.replace(said, F.lit("*/"), F.lit("* /")), F.lit(" */")))
        .when(d.isin("", "json"), F.to_json(F.struct(F.lit("not_found").alias("error"), url.alias("URL"))))
        .otherwise(F.concat(F.lit("<!doctype html><p>"), F.replace(F.replace(said, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>")))
    )
