"""HLS and DASH manifests cut to one variant."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from palimpsest.functions.urls import rewrite_url

#: (pixels, bits a second): replay now, replay of old captures.
DEFAULT_LIMITS = (860 * 480, 1_000_000)
LEGACY_LIMITS = (1280 * 720, 2_000_000)


def limits(options: dict | None = None) -> tuple[int, int]:
    """Largest picture and rate: of the record, else by its age."""
    o = options or {}
    if o.get("legacy"):
        base = LEGACY_LIMITS
    else:
        base = DEFAULT_LIMITS
    return int(o.get("max_pixels") or base[0]), int(o.get("max_bandwidth") or base[1])


def hls_variants(text: str) -> list[dict]:
    """(line_no, bandwidth, width, height, uri) of a master playlist."""
    out = []
    lines = text.rstrip().split("\n")
    for i, line in enumerate(lines):
        if not line.startswith("#EXT-X-STREAM-INF:"):
            continue
        rate = re.search(r"(?<![-\w])BANDWIDTH=([0-9]+)", line)
        size = re.search(r"RESOLUTION=([0-9]+)x([0-9]+)", line)
        out.append({
            "line_no": i, "bandwidth": int(rate[1]) if rate else 0,
            "width": int(size[1]) if size else 0, "height": int(size[2]) if size else 0,
            "uri": lines[i + 1].strip() if i + 1 < len(lines) else "",
        })
    return out


def rewrite_hls(text: str, options: dict | None = None, prefix: str | None = None, base: str = "", by_bandwidth: bool = False) -> str:
    """A playlist with only the best allowed variant (H24): most pixels within the limit
    (most bits a second, ``by_bandwidth``), of equals the first; if none fits, the least."""
    pixels, rate = limits(options)
    lines = text.rstrip().split("\n")
    rows = hls_variants(text)
    value = (lambda r: r["bandwidth"]) if by_bandwidth else (lambda r: r["width"] * r["height"])
    bound = rate if by_bandwidth else pixels
    drop: set[int] = set()
    if rows:
        ordered = sorted(rows, key=value)
        fit = [r for r in ordered if value(r) <= bound]
        top = max(map(value, fit)) if fit else None
        keep = next(r for r in fit if value(r) == top) if fit else ordered[0]
        for r in rows:
            if r is not keep:
                drop |= {r["line_no"], r["line_no"] + 1}
    out = []
    for i, line in enumerate(lines):
        if i in drop:
            continue
        if prefix and line.strip() and not line.startswith("#"):
            line = rewrite_url(line, prefix, base)
        out.append(line)
    return "\n".join(out)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def dash_representations(text: str) -> list[dict]:
    """(set_no, rep_id, bandwidth, width, height, mime) of an MPD."""
    out = []
    sets = [e for e in ElementTree.fromstring(text).iter() if _local(e.tag) == "AdaptationSet"]
    for n, s in enumerate(sets):
        for r in s:
            if _local(r.tag) == "Representation":
                out.append({
                    "set_no": n, "rep_id": r.get("id"), "bandwidth": int(r.get("bandwidth") or 0), "width": int(r.get("width") or 0),
                    "height": int(r.get("height") or 0), "mime": r.get("mimeType") or s.get("mimeType") or "",
                })
    return out


_DECLARATION = "<?xml " + " ".join(f'{k}="{v}"' for k, v in (("version", "1.0"), ("encoding", "UTF-8"))) + "?>\n"


def rewrite_dash(text: str, options: dict | None = None, best_ids: list[str] | None = None) -> str:
    """An MPD with one representation a set (H25): the largest picture within the limit
    where sizes are given, else the highest rate within its limit. Unreadable text stays."""
    pixels, rate = limits(options)
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return text
    space = root.tag[1:].partition("}")[0] if root.tag.startswith("{") else ""
    if space:
        ElementTree.register_namespace("", space)
    for s in [e for e in root.iter() if _local(e.tag) == "AdaptationSet"]:
        best, best_pixels, best_rate = None, 0, 0
        reps = [r for r in s if _local(r.tag) == "Representation"]
        for r in reps:
            size = int(r.get("width") or 0) * int(r.get("height") or 0)
            speed = int(r.get("bandwidth") or 0)
            if 0 < size <= pixels:
                if size > best_pixels:
                    best, best_pixels, best_rate = r, size, speed
            elif speed <= rate and speed > best_rate:
                best, best_rate = r, speed
        if best is None:
            continue
        if best_ids is not None and best.get("id"):
            best_ids.append(best.get("id"))
        for r in reps:
            if r is not best:
                s.remove(r)
    return _DECLARATION + ElementTree.tostring(root, encoding="unicode")
