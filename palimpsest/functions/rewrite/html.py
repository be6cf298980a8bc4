"""Pages: links, styles and scripts rewritten tag by tag.

Text outside changed tags is copied byte for byte. Changed tags are written
with lower-case names and double-quoted values.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.rewrite.js import rewrite_js
from palimpsest.functions.rewrite.text import rewrite_css, rewrite_importmap, rewrite_script_base64
from palimpsest.functions.urls import rewrite_url, whatwg_join

MAX_PAGE = 50_000_000
_ANY = {"href": "", "src": "", "background": "", "poster": "im_", "cite": "", "action": "", "formaction": "", "data": "oe_", "codebase": "oe_", "longdesc": ""}
#: Modifier of each link attribute by tag; '' keeps the page's own.
ATTRS: dict[str, dict[str, str]] = {
    "a": {"href": ""}, "area": {"href": ""}, "audio": {"src": "oe_"}, "base": {"href": ""}, "blockquote": {"cite": ""}, "body": {"background": "im_"},
    "button": {"formaction": ""}, "command": {"icon": "im_"}, "del": {"cite": ""}, "embed": {"src": "oe_"}, "form": {"action": ""}, "frame": {"src": "fr_"},
    "iframe": {"src": "if_"}, "image": {"src": "im_", "xlink:href": "im_", "href": "im_"}, "img": {"src": "im_", "srcset": "im_"}, "input": {"src": "im_", "formaction": ""},
    "ins": {"cite": ""}, "link": {"href": "oe_"}, "meta": {"content": ""}, "object": {"codebase": "oe_", "data": "oe_"}, "param": {"value": "oe_"}, "q": {"cite": ""},
    "script": dict.fromkeys(("src", "xlink:href"), "js_"), "source": {"src": "oe_", "srcset": "oe_"}, "video": {"src": "oe_", "poster": "im_"},
}
_SAME = {"mp_", "ln_", "mt_", ""}
_TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</[a-zA-Z][^>]*>|<[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_TAG = re.compile(r"<([a-zA-Z][^\s/>]*)")
_RAW = {"script", "style", "textarea", "title"}
#: Flash players and the pages that show the same in a frame.
PLAYERS = [(r"^(?:https?:)?//(?:www\.)?youtube(?:-nocookie)?\.com/v/([^?&/]+).*", r"https://www.youtube.com/embed/\1"), (r"^(?:https?:)?//(?:www\.)?vimeo\.com/moogaloop\.swf\?.*?clip_id=([0-9]+).*", r"https://player.vimeo.com/video/\1")]
_ORDER = re.compile(r"(?i)(loadOrderID&(?:quot;&)?#x[^;]+?;)[0-9]+")
_ENDS = {tag: re.compile(rf"(?i)</{tag}\s*>") for tag in _RAW}
_REFERENCE = re.compile(r"&(?=#?\w+;)")
_LOAD_ORDER = re.compile(r"[?&]:loadOrderID=([0-9]+)")
_SRCSET = re.compile(r"\s*([^\s,]\S*?)(\s+[0-9.]+[wxh])?\s*(?:,\s+|,(?=(?:https?:)?//)|(?<=[wxh]),|\Z)")
_REFRESH = re.compile(r"([\s0-9.]+;(?:\s*url\s*=)?\s*)(['\"]?)(\S+?)(['\"]?)\s*\Z", re.I)


def rewrite_srcset(value: str, fix) -> str:  # noqa: ANN001
    """Every address of a srcset, commas within addresses kept (H4)."""
    if not value.strip():
        return value
    out = []
    for m in _SRCSET.finditer(value):
        if m[1]:
            out.append(fix(m[1]) + (" " + m[2].strip() if m[2] else ""))
    return ", ".join(out)


@lru_cache(1 << 8)
def _modified(prefix: str, modifier: str) -> str:
    return re.sub(r"mp_/\Z", modifier + "/", prefix)


class PageRewriter:
    def __init__(self, prefix: str, base: str, head: str = "", live: bool = False, wrap_scripts: bool = True) -> None:
        self.prefix, self.base, self.head, self.wrap = prefix, base, head, wrap_scripts
        self.has_body = False

    def with_modifier(self, modifier: str) -> str:
        return self.prefix if modifier in _SAME else _modified(self.prefix, modifier)

    def link(self, url: str, modifier: str = "", force: bool = False) -> str:
        return rewrite_url(url, self.with_modifier(modifier), self.base, force)

    def meta(self, attrs: list[list]) -> None:
        """Policies switched off, refresh targets and addresses rewritten (H5)."""
        have = {n: v or "" for n, v in attrs}
        equiv = have.get("http-equiv", "").lower()
        for a in attrs:
            if a[0] != "content":
                continue
            value = a[1] or ""
            if equiv == "content-security-policy":
                a[0] = "_content"
            elif equiv == "refresh":
                m = _REFRESH.match(value)
                if m:
                    a[1] = m[1] + m[2] + self.link(m[3]) + m[4]
            elif have.get("name", "").lower() == "referrer":
                a[1] = "no-referrer-when-downgrade"
            elif value.startswith(("http://", "https://")):
                a[1] = self.link(value)

    def attrs(self, tag: str, attrs: list[list]) -> list[list]:
        rules = ATTRS.get(tag, {})
        if tag == "meta":
            self.meta(attrs)
            return attrs
        have = {n: v or "" for n, v in attrs}
        extra: list[list] = []
        for a in attrs:
            name, value = a
            if value is None:
                continue
            if name.startswith("on") and not name.startswith("on-"):
                lead = "javascript:" if value.startswith("javascript:") else ""
                a[1] = lead + rewrite_js(value[len(lead) :], inline=True)
            elif name == "style":
                a[1] = rewrite_css(value, self.prefix, self.base)
            elif name == "background":
                a[1] = self.link(value)
            elif name in ("srcset", "imagesrcset") or (tag == "img" and name == "data-srcset"):
                a[1] = rewrite_srcset(value, lambda u: self.link(u, rules.get("srcset", "im_")))
            elif name in ("integrity", "crossorigin") and tag in ("script", "link"):
                a[0] = "_" + name
            elif name == "target" and tag in ("a", "area", "base", "form") and value.lower() in ("_blank", "_parent", "_top", "new"):
                a[1] = "__replay_top"
            elif name.startswith("data-") and value.startswith(("http://", "https://")):
                a[1] = self.link(value)
            elif tag == "param" and name == "value":
                a[1] = self.link(value) if value.startswith(("http://", "https://")) else value
            elif tag == "base" and name == "href":
                a[1] = self.set_base(value)
            elif tag == "script" and name in ("src", "xlink:href"):
                modifier = "esm_" if have.get("type", "").lower() == "module" else ""
                if value.startswith("data:"):
                    a[1] = rewrite_script_base64(value, lambda t: rewrite_js(t, self.prefix, self.base))
                elif value.strip():
                    new = self.link(value, modifier, force=True)
                    if not value.startswith(("http", "/", "data:")) and new != value:
                        extra.append(["data-orig-src", value])
                    a[1] = new
            elif tag == "link" and name == "href":
                kind = have.get("rel", "").lower()
                modifier = "cs_" if kind == "stylesheet" else "esm_" if kind == "modulepreload" else ""
                a[1] = self.link(value, modifier, force=kind == "modulepreload")
            elif tag == "object" and name == "data":
                self.convert_object(a, have.get("type", ""))
            elif tag == "embed" and name == "src":
                extra += self.convert_embed(a, have.get("type", ""))
            elif name in rules:
                a[1] = self.link(value, rules[name])
            elif name in ("href", "src") and value.startswith(("/", "http://", "https://")):
                a[1] = self.link(value, _ANY.get(name, ""))
        return attrs + extra

    def convert_object(self, a: list, kind: str) -> None:
        """Documents become frames, drawings images, known players of old plug-ins frames (H8)."""
        value = a[1]
        if kind == "application/pdf":
            a[:], self.tag = ["src", self.link(value, "if_")], "iframe"
        elif kind == "image/svg+xml":
            a[:], self.tag = ["src", self.link(value)], "img"
        elif kind == "application/x-shockwave-flash":
            for pattern, page in PLAYERS:
                new = re.sub(pattern, page, value)
                if new != value:
                    a[:], self.tag = ["src", self.link(new, "if_")], "iframe"
                    return
            a[1] = self.link(value, "oe_")
        else:
            a[1] = self.link(value, "oe_")

    def convert_embed(self, a: list, kind: str) -> list[list]:
        value = a[1]
        if kind.startswith("image/"):
            a[1], self.tag = self.link(value), "img"
        elif kind == "application/pdf" or not kind.startswith("application/"):
            a[1], self.tag = self.link(value, "if_"), "iframe"
            if kind != "application/pdf":  # what it is is not known: it may not download or leave
                return [["sandbox", "allow-same-origin allow-scripts"]]
        else:
            a[1] = self.link(value, "oe_")
        return []

    def text(self, text: str) -> str:
        """Text between tags: the order of loading as the page's own address has it."""
        if self.order is None or "loadorderid" not in text.lower():
            return text
        return _ORDER.sub(lambda m: m[1] + self.order, text)

    def set_base(self, value: str) -> str:
        url = value.strip()
        if not url:
            return value
        if re.match(r"(?i)(?:https?:)?//[^/?#]+(?=\Z|[?#])", url):
            url = re.sub(r"(?i)^((?:https?:)?//[^/?#]+)", r"\1/", url)
        out = self.link(url)
        self.base = whatwg_join(self.base, url)
        return out

    def script(self, kind: str, text: str) -> str:
        k = kind.lower().strip()
        if k == "importmap":
            return rewrite_importmap(text, self.prefix.replace("mp_/", "esm_/"), self.base)
        if k in ("", "text/javascript", "application/javascript", "module", "text/ecmascript", "application/ecmascript"):
            if not self.wrap:
                return text
            new = rewrite_js(text, self.prefix, self.base, module=k == "module" or None)
            return new + ";document.close();" if self.has_body and new == text and text.strip() else new
        return text

    def run(self, text: str) -> str:
        if len(text) > MAX_PAGE:
            return text
        self.turned: dict[str, list[str | None]] = {}
        told = _LOAD_ORDER.search(self.base)
        self.order = told[1] if told else None
        out: list[str] = []
        at, placed = 0, not self.head
        while True:
            m = _TOKEN.search(text, at)
            if not m:
                out.append(self.text(text[at:]))
                break
            out.append(self.text(text[at : m.start()]))
            raw, at = m[0], m.end()
            if raw[1] in "!?":
                out.append(raw)
                continue
            if raw[1] == "/":
                ended = raw[2:].rstrip("> \n\t").lower()
                new = self.turned[ended].pop() if self.turned.get(ended) else None
                out.append(f"</{new}>" if new else raw)
                continue
            tag = _TAG.match(raw)[1].lower()
            if tag == "body":
                self.has_body = True
            body = raw[1 + len(tag) :].rstrip(">")
            closed = body.endswith("/")
            attrs = [[n.lower(), None if v is None else html.unescape(v[1:-1] if v[:1] in "\"'" else v)] for n, v in ((a[1], a[2]) for a in _ATTR.finditer(body[:-1] if closed else body))]
            before = [list(a) for a in attrs]
            self.tag = tag
            after = self.attrs(tag, attrs)
            if tag == "object" and not closed:  # its end is told apart by this
                self.turned.setdefault(tag, []).append(self.tag if self.tag != tag else None)
            if after == before:
                out.append(raw)
            else:
                shown = "".join(f' {n}="{_quote(v or "")}"' for n, v in after)
                end = "></iframe>" if tag == "embed" and self.tag == "iframe" else "/>" if closed else ">"
                out.append(f"<{self.tag}{shown}{end}")
            if not placed and tag not in ("html", "!doctype"):
                out.append(self.head) if tag == "head" else out.insert(len(out) - 1, self.head)
                placed = True
            if tag in _RAW and not closed:
                end = _ENDS[tag].search(text, at)
                stop = end.start() if end else len(text)
                inner = text[at:stop]
                if tag == "style":
                    inner = rewrite_css(inner, self.prefix, self.base)
                elif tag == "script":
                    inner = self.script(next((v or "" for n, v in before if n == "type"), ""), inner)
                out.append(inner)
                at = stop
        if not placed:
            out.append(self.head)
        return "".join(out)


class ProxyPageRewriter(PageRewriter):
    """Pages replayed at their own addresses, on another host (H12): frames change the host,
    links and media only the scheme, and scripts nothing."""

    def __init__(self, base: str, found: str = "", new: str = "", upgrade: bool = False) -> None:
        super().__init__("", base, wrap_scripts=False)
        self.found, self.new, self.upgrade = found, new, upgrade

    def link(self, value: str, modifier: str = "", force: bool = False) -> str:
        if modifier in ("if_", "fr_", "mt_") and self.found:
            value = re.sub(rf"(?i)^((?:https?:)?//(?:[^/?#]*\.)?){re.escape(self.found)}(?=[/?#:]|\Z)", rf"\g<1>{self.new}", value)
        return re.sub(r"^http://", "https://", value) if self.upgrade else value

    def attrs(self, tag: str, attrs: list[list]) -> list[list]:
        if self.upgrade or tag in ("embed", "object", "meta"):
            return super().attrs(tag, attrs)
        rules = ATTRS.get(tag, {})
        if "-" not in tag:  # components of the page's own making stay
            for a in attrs:
                if a[1] is not None and (a[0] in rules or a[0] in ("href", "src")):
                    a[1] = self.link(a[1], rules.get(a[0], ""))
        return attrs

    def script(self, kind: str, text: str) -> str:
        return text


def _quote(value: str) -> str:
    return _REFERENCE.sub("&amp;", value).replace('"', "&quot;") if "&" in value or '"' in value else value


def rewrite_html(text: str, prefix: str, base: str, head: str = "", wrap_scripts: bool = True) -> str:
    """A page for replay (H2-H5)."""
    return PageRewriter(prefix, base, head, wrap_scripts=wrap_scripts).run(text)


def page_rewriter(prefix: str, head: str = ""):  # noqa: ANN201
    """Arrow UDF (html, url) of rewritten pages."""

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else rewrite_html(t, prefix, u or "", head) for t, u in zip(text, url, strict=True)])

    return run
