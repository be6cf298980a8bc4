"""Operator 4, benchmark decontamination by the q-gram lemma.

A passage of m bytes with at most k edits shares at least m + 1 - Q * (k + 1)
Q-grams with its place in a text, all within k + 1 neighbouring diagonals.
Bands of 2 * (k + 1) diagonals overlap by half, so one band holds them all.
Shared grams are counted by (text, passage, band); bands that meet the bound
are verified by alignment within the band.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import LOWER, SPACE, chunks, flat, tidied

#: Bytes of a gram: eight, so that a gram is a machine word and needs no hash. Passages
#: so short that the budget would leave no common gram of eight have shorter ones.
Q = 8
#: Edits allowed, as a share of the passage's bytes.
RATE = 0.1
#: Passages are searched in blocks of so many bytes; a block is what is broadcast.
BLOCK_BYTES = 2 << 20
_BITS = 20
#: Shared grams that are expanded at once.
SLICE = 1 << 21


def fold(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ASCII lower case, runs of white space as one space; offsets; original places."""
    low = LOWER[data]
    space = SPACE[data]
    low[space] = 32
    keep = np.ones(len(data), bool)
    if len(data) > 1:
        keep[1:] = ~(space[1:] & space[:-1])
    at = off[:-1][off[:-1] < len(data)]
    keep[at] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], before[off], np.flatnonzero(keep)


def _words(data: np.ndarray, q: int = Q) -> np.ndarray:
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray(max(0, len(data) - q + 1), "<u8", padded, 0, (1,))
    return words if q == 8 else words & np.uint64((1 << 8 * q) - 1)


def _slot(words: np.ndarray) -> np.ndarray:
    return (words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


def gram_size(m: int, rate: float = RATE) -> int:
    """The longest gram, Q at most, of which a passage of ``m`` bytes keeps one despite its budget."""
    return min(Q, m // (int(rate * m) + 1))


class Passages:
    """An index of those folded passages whose gram size is ``q``; empty ones are left out."""

    def __init__(self, texts: list[bytes], rate: float = RATE, q: int = Q, least: int = 1) -> None:
        self.own, folded, self.q = [], [], q
        for i, t in enumerate(texts):
            d = np.frombuffer(t, np.uint8)
            f = fold(d, np.array([0, len(d)]))[0].tobytes().strip()
            if len(f) >= least and gram_size(len(f), rate) == q:
                self.own.append(i)
                folded.append(np.frombuffer(f, np.uint8))
        self.texts = folded
        self.m = np.array([len(f) for f in folded], np.int64)
        self.k = (rate * self.m).astype(np.int64)
        self.least = self.m + 1 - q * (self.k + 1)
        words = [_words(f, q) for f in folded]
        grams = np.concatenate(words) if words else np.zeros(0, np.uint64)
        slot = _slot(grams).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        self.grams = grams[order]
        #: entries of each slot of the hashed table of grams
        self.table = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=1 << _BITS))]).astype(np.int32)
        self.item = np.repeat(np.arange(len(folded)), [len(w) for w in words])[order] if folded else np.zeros(0, np.int64)
        self.at = np.concatenate([np.arange(len(w)) for w in words])[order] if folded else np.zeros(0, np.int64)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[slot] = True

    def _shared(self, words: np.ndarray, off: np.ndarray, pos: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair of row and passage, band) of every gram of ``pos`` that is a passage's too."""
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(lo, n) + nth
        pos = np.repeat(pos, n)
        equal = self.grams[entry] == words[pos]
        pos, entry = pos[equal], entry[equal]
        row = np.searchsorted(off, pos, side="right") - 1
        item = self.item[entry]
        diagonal = pos - off[row] - self.at[entry] + self.m[item]  # never negative
        return row * len(self.m) + item, diagonal // (self.k[item] + 1)

    def candidates(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Distinct (row, passage, band) of folded texts that meet the bound.

        Grams that many passages share are expanded a slice at a time, and only
        counts are kept from slice to slice.
        """
        words = _words(data, self.q)
        none = np.zeros((0, 3), np.int64)
        slot = _slot(words).astype(np.int32)
        pos = np.flatnonzero(self.bits[slot]) if len(self.grams) else np.zeros(0, np.int64)
        lo = self.table[slot[pos]].astype(np.int64)
        n = self.table[slot[pos] + 1] - lo
        if not n.sum():
            return none
        upto = np.cumsum(n)
        cuts = np.unique(np.append(np.searchsorted(upto, np.arange(0, int(upto[-1]), SLICE)), len(pos)))
        slices = list(zip(cuts, cuts[1:], strict=False)) if cuts[0] == 0 else [(0, cuts[0]), *zip(cuts, cuts[1:], strict=False)]
        held = [self._shared(words, off, pos, lo, n)] if len(slices) == 1 else None
        again = lambda: held or (self._shared(words, off, pos[i:j], lo[i:j], n[i:j]) for i, j in slices)
        # texts that share too few grams with a passage altogether go first
        pairs, count = _counted(pair for pair, _ in again())
        pairs = pairs[count >= self.least[pairs % len(self.m)]]
        if not len(pairs):
            return none
        width = int(off[-1] + self.m.max()) + 3

        def banded():  # noqa: ANN202
            for pair, band in again():
                at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                take = pairs[at] == pair
                key = at[take] * width + band[take]
                yield np.concatenate([key + 1, key])

        key, count = _counted(banded())
        key = key[count >= self.least[pairs[key // width] % len(self.m)]]
        pair = pairs[key // width]
        return np.stack([pair // len(self.m), pair % len(self.m), key % width - 1], 1)

    def verify(self, data: np.ndarray, off: np.ndarray, found: np.ndarray) -> np.ndarray:
        """(row, passage, start, end, edits) of candidates within budget, places in the folded text."""
        out = [self._align(data, off, found[i : i + 256]) for i in range(0, len(found), 256)]
        return np.concatenate(out) if out else np.zeros((0, 5), np.int64)

    def _align(self, data: np.ndarray, off: np.ndarray, found: np.ndarray) -> np.ndarray:
        row, item, band = found.T
        m, k = self.m[item], self.k[item]
        low = band * (k + 1) - m - k  # first diagonal; a path strays k from its start
        width = int((2 * (k + 1) + 2 * k).max())
        longest = int(m.max())
        cells = np.arange(width)
        base, size = off[row], np.diff(off)[row]
        pattern = np.zeros((len(row), longest), np.uint8)
        for c, i in enumerate(item):
            pattern[c, : len(self.texts[i])] = self.texts[i]
        edit = np.int64(1) << 32
        far = edit << 20
        place = low[:, None] + cells  # text place of the cell in row 0
        allowed = (place >= 0) & (place <= size[:, None])
        d = np.where(allowed, cells, far)
        result = np.full((len(row), width), far, np.int64)
        for r in range(1, longest + 1):
            at = place + r - 1  # text byte that a diagonal step consumes
            inside = (at >= 0) & (at < size[:, None])
            ch = data[np.minimum(np.maximum(base[:, None] + at, 0), len(data) - 1)]
            step = d + np.where(inside & (ch == pattern[:, r - 1 : r]), 0, edit)
            step[~inside] = far
            skip = np.full_like(d, far)
            skip[:, :-1] = d[:, 1:] + edit
            new = np.minimum(step, skip)
            new = np.minimum.accumulate(new - cells * edit, axis=1) + cells * edit
            ok = (at + 1 >= 0) & (at + 1 <= size[:, None])
            d = np.where(ok, new, far)
            done = m == r
            if done.any():
                result[done] = d[done]
        best = result.argmin(1)
        value = result[np.arange(len(row)), best]
        edits, first = value >> 32, value & (edit - 1)
        good = (value < far) & (edits <= k)
        start, end = low + first, low + best + m
        return np.stack([row, item, start, end, edits], 1)[good]


def _counted(parts) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Sorted different values of all parts and how often each occurs; a part is reduced before the next."""
    value, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in parts:
        v, c = np.unique(part, return_counts=True)
        if not len(value):
            value, count = v, c
            continue
        both, back = np.unique(np.concatenate([value, v]), return_inverse=True)
        value, count = both, np.bincount(back, np.concatenate([count, c]), len(both)).astype(np.int64)
    return value, count


def best_places(found: np.ndarray) -> np.ndarray:
    """Of overlapping places of a passage in a text, the one with the fewest edits."""
    if not len(found):
        return found
    found = found[np.lexsort((found[:, 2], found[:, 4], found[:, 1], found[:, 0]))]
    out: list[np.ndarray] = []
    for x in found:
        clash = False
        for y in reversed(out):
            if y[0] != x[0] or y[1] != x[1]:
                break
            if x[2] < y[3] and y[2] < x[3]:
                clash = True
                break
        if not clash:
            out.append(x)
    return np.array(out)


def _search(index):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, rate, least = index.value
        indexes = [p for p in (Passages(texts, rate, q, max(1, least)) for q in range(1, Q + 1)) if len(p.m)]
        for batch in batches:
            data, off = flat(batch.column(1))
            for (first, _, d, o), passages in itertools.product(chunks(data, off), indexes):
                f, fo, places = fold(d, o)
                found = passages.candidates(f, fo)
                if not len(found):
                    continue
                hit = best_places(passages.verify(f, fo, found))
                if not len(hit):
                    continue
                row = hit[:, 0]
                begin = places[np.minimum(fo[row] + hit[:, 2], len(places) - 1)] - o[row]
                last = places[np.maximum(fo[row] + hit[:, 3] - 1, 0)] + 1 - o[row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + first)), pa.array(np.array(passages.own)[hit[:, 1]].astype(np.int32)),
                     pa.array(begin), pa.array(last), pa.array(hit[:, 4].astype(np.int32))],
                    names=["doc_id", "nth", "start_byte", "end_byte", "edits"],
                )

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 1) -> DataFrame:
    """Places of benchmark passages in ``docs``, ASCII case and white space folded.

    Returns doc_id, item_id, start_byte, end_byte (in the text's UTF-8) and
    edits, one row for each item and place; places that overlap count once.
    Null and empty texts and passages match nothing; a passage of under ten
    folded bytes has no budget and is found where it stands as it is, one of
    fewer than ``least`` is not searched; equal passages are all reported; repeated rows of
    ``docs`` report alike; other columns are not read; empty tables give an
    empty result. Texts are read whole. Nothing is shuffled but what matches.

    The passages are a query set: they are searched in blocks of BLOCK_BYTES,
    each block broadcast alone, with one pass over ``docs`` a block.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("_t")).where(F.octet_length("_t") > 0)
    items = items.withColumn("_key", F.md5("_t"))
    distinct = items.select("_t", "_key").dropDuplicates(["_key"])
    total = distinct.agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    out = None
    for b in range(blocks):
        part = distinct.where(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == b) if blocks > 1 else distinct
        local = part.orderBy("_key").collect()
        shared = spark.sparkContext.broadcast(([r["_t"].encode() for r in local], rate, least))
        keys = spark.createDataFrame([(i, r["_key"]) for i, r in enumerate(local)], "nth int, _key string")
        hits = rows.mapInArrow(tidied(_search(shared)), f"doc_id {kind}, nth int, start_byte long, end_byte long, edits int")
        hits = hits.join(F.broadcast(keys), "nth").drop("nth")  # as many rows as the block has passages
        out = hits if out is None else out.unionByName(hits)
    return out.join(items.select("item_id", "_key"), "_key").select("doc_id", "item_id", "start_byte", "end_byte", "edits")


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, doc_id: str = "doc_id", least: int = 1) -> DataFrame:
    """Rows of ``docs`` whose id has no leak (see find_leaks); rows with a null id are judged by id
    null. Nothing else is changed: null and empty texts, repeated rows and all columns stay; an empty
    table gives an empty one."""
    bad = find_leaks(docs, benchmark, rate, doc_id, least=least).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["_bad"]), "left_anti")
