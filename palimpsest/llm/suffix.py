"""Suffix arrays by induced sorting, as whole-array numpy passes.

Suffixes are classified L or S; the leftmost S-type substrings (each shorter
than its neighbours' span) are ranked, the string of their ranks is sorted in
turn, and one left-to-right and one right-to-left pass induce all suffixes from
them, a bucket of first bytes at a time. Common prefixes come permuted: only
irreducible ones are compared, all others follow by counting down.
"""

from __future__ import annotations

import numpy as np

#: Symbols: 0 ends the string, 1 separates pieces, bytes follow; UTF-8 has no byte above 0xF4.
END, SEPARATOR, SHIFT, PAD = 0, 1, 2, 0xFF


def join_pieces(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all pieces with separators and the final 0; the start of each piece."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(pieces) else np.zeros(0, np.int64)
    raw = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    out = np.empty(len(raw) + 1, np.uint8)
    out[:-1] = raw + np.uint8(SHIFT)  # 0xFF wraps to 1, the separator
    out[-1] = END
    return out, starts


def classify(s: np.ndarray) -> np.ndarray:
    """True for S-type suffixes (less than the suffix after them)."""
    n = len(s)
    differs = np.flatnonzero(s[1:] != s[:-1])
    rising = s[differs + 1] > s[differs]
    kind = np.ones(n, bool)
    if n > 1:
        ups = np.zeros(n, np.int64)  # the next change decides for all equal symbols before it
        ups[differs] = np.arange(1, len(differs) + 1)
        nxt = np.minimum(np.maximum.accumulate(ups), len(differs))
        before = np.where(ups > 0, nxt - 1, nxt)
        kind[: n - 1] = rising[np.minimum(before, len(rising) - 1)][: n - 1] if len(rising) else False
    return kind


def words_at(s: np.ndarray) -> np.ndarray:
    """The eight symbols from each position as a little-endian word (unaligned view)."""
    padded = np.zeros(len(s) + 8, np.uint8)
    padded[: len(s)] = s
    return np.ndarray(len(s), "<u8", padded, 0, (1,))


def _refine(rank: np.ndarray, items: np.ndarray, key: np.ndarray) -> None:
    """Split groups of equal rank by ``key``; a rank is its group's first place."""
    r, bits = rank[items], len(rank).bit_length()
    if key.dtype == np.int64 and 3 * bits <= 63:  # ranks as keys: all three numbers fit one word
        packed = np.sort(r << 2 * bits | key + 1 << bits | np.arange(len(items)))
        order, k, r = packed & (1 << bits) - 1, packed >> bits & (1 << bits) - 1, packed >> 2 * bits
    else:
        order = np.lexsort((key, r)) if r.any() else np.argsort(key)
        k, r = key[order], r[order]
    it = items[order]
    place = np.arange(len(it))
    group = np.append(True, r[1:] != r[:-1])
    fresh = group | np.append(True, k[1:] != k[:-1])
    base = np.maximum.accumulate(np.where(group, place, 0))
    rank[it] = r + np.maximum.accumulate(np.where(fresh, place, 0)) - base


def sort_lms(s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """LMS suffixes in order: substrings ranked by words, then ranks doubled."""
    m = len(lms)
    ends = np.append(lms[1:], lms[-1])  # a substring includes the next LMS symbol
    length = ends - lms + 1
    words = words_at(s)
    rank = np.zeros(m, np.int64)
    done = 0
    items = np.arange(m)
    while len(items):
        w = words[np.minimum(lms[items] + done, len(s) - 1)].byteswap()
        left = length[items] - done
        short = left < 8  # the end of a substring sorts above any symbol that could follow
        w[short] |= (np.uint64(1) << (np.uint64(8) * (8 - left[short]).astype(np.uint64))) - np.uint64(1)
        _refine(rank, items, w)
        done += 8
        items = items[length[items] >= done]  # one that ends right here still has its end to show
    step = 1
    items = np.arange(m)
    while True:
        count = np.bincount(rank[items], minlength=m)
        items = items[count[rank[items]] > 1]  # a rank of its own stays so
        if not len(items) or step > m:
            break
        ahead = items + step
        key = np.where(ahead < m, rank[np.minimum(ahead, m - 1)], -1)
        _refine(rank, items, key)
        step *= 2
    out = np.empty(m, np.int64)
    out[np.argsort(rank, kind="stable")] = np.arange(m)
    order = np.empty(m, np.int64)
    order[out] = lms
    return order


def _deal(into: list[list[np.ndarray]], s: np.ndarray, at: np.ndarray) -> None:
    """Append positions to the buckets of their symbols, keeping their order."""
    if not len(at):
        return
    c = s[at]
    order = np.argsort(c, kind="stable")
    at, c = at[order], c[order]
    cut = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    for i, j in zip(cut, np.append(cut[1:], len(c)), strict=True):
        into[int(c[i])].append(at[i:j])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``s`` (uint8, ends with its only 0) in order."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    kind = classify(s)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    if not len(lms):
        lms = np.array([n - 1])
    ordered = sort_lms(s, lms)
    seeds: list[list[np.ndarray]] = [[] for _ in range(256)]
    _deal(seeds, s, ordered)
    none = np.zeros(0, np.int64)
    left: list[list[np.ndarray]] = [[] for _ in range(256)]
    lower: list[np.ndarray] = []
    for c in range(256):
        done = 0
        while done < len(left[c]):
            cur = np.concatenate(left[c][done:])
            done = len(left[c])
            pred = cur[cur > 0] - 1
            _deal(left, s, pred[~kind[pred]])
        cur = np.concatenate(seeds[c]) if seeds[c] else none
        pred = cur[cur > 0] - 1
        _deal(left, s, pred[~kind[pred]])
        lower.append(np.concatenate(left[c]) if left[c] else none)
    right: list[list[np.ndarray]] = [[] for _ in range(256)]
    upper: list[np.ndarray] = [none] * 256
    for c in range(255, -1, -1):
        if c == END:
            right[c].insert(0, np.array([n - 1]))
        done = 0
        while done < len(right[c]):
            cur = np.concatenate(right[c][done:])
            done = len(right[c])
            pred = cur[cur > 0] - 1
            _deal(right, s, pred[kind[pred]])
        upper[c] = np.concatenate(right[c])[::-1] if right[c] else none
        cur = lower[c][::-1]
        pred = cur[cur > 0] - 1
        _deal(right, s, pred[kind[pred]])
    return np.concatenate([x for c in range(256) for x in (lower[c], upper[c])])


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the common prefix with the suffix before it in order."""
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    back = np.where((i > 0) & (phi > 0), s[np.maximum(i - 1, 0)] == s[np.maximum(phi - 1, 0)], False)
    hard = np.flatnonzero(~back & (phi >= 0))
    words = words_at(s)
    size = np.zeros(n, np.int64)
    a, b, at = hard.copy(), phi[hard], hard
    while len(at):
        x = words[a] ^ words[b]
        same = x == 0
        off = ~same
        if off.any():
            low = x[off] & (~x[off] + np.uint64(1))
            size[at[off]] += (np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        size[at[same]] += 8
        a, b, at = a[same] + 8, b[same] + 8, at[same]
    first = np.maximum.accumulate(np.where(back, 0, i))
    return np.maximum(size[first] - (i - first), 0)


def repeated_starts(pieces: list[bytes], spans: list[int], counts: list[int] | None = None) -> list[list[np.ndarray]]:
    """For each span and piece, the starts of ``span``-byte strings that start anywhere else too.

    Only the first ``counts[i]`` starts of piece i count (all by default): the
    bytes behind them merely complete their strings and may overlap other pieces.
    """
    if not pieces:
        return [[] for _ in spans]
    s, begin = join_pieces(pieces)
    sa = suffix_array(s)
    lcp = permuted_lcp(s, sa)
    size = np.array([len(p) for p in pieces], np.int64)
    own = np.zeros(len(s) + 1, np.int32)
    np.add.at(own, begin, 1)
    np.add.at(own, begin + (size if counts is None else np.minimum(size, counts)), -1)
    own = np.cumsum(own)[:-1] > 0
    at = np.flatnonzero(own[sa])
    out = []
    if len(at) < 2:
        return [[np.zeros(0, np.int64)] * len(pieces) for _ in spans]
    # common prefix of neighbours among the starts that count: the least in between
    common = np.minimum.reduceat(lcp[sa], at[:-1] + 1)
    if at[-1] + 1 < len(sa):  # the last stretch would run on to the end
        common[-1] = lcp[sa[at[-2] + 1 : at[-1] + 1]].min()
    for span in spans:
        hit = np.zeros(len(s), bool)
        again = np.flatnonzero(common >= span)
        hit[sa[at[again + 1]]] = True
        hit[sa[at[again]]] = True
        out.append([np.flatnonzero(hit[b : b + max(0, n - span + 1)]) for b, n in zip(begin, size, strict=True)])
    return out
