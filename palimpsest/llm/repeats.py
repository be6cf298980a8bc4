"""Operator 7, suffix-array dedup: bytes of long strings that occur twice.

Two lengths are judged at once: strings of SPAN bytes, and strings of PASSAGE
bytes, whose runs of PASSAGE_WORDS words or more are repeated passages. Every
PASSAGE-byte string has a least GRAM-byte hash among its grams; runs of string
starts with the same least hash are filed under it. Strings can only be equal
within one hash, so hashes seen in one place only are dropped, runs whose bytes
(with all that completes their last SPAN-byte string) are equal are settled at
once, and one copy of each different run of the remaining hashes goes to a shard.
There, runs that share no gram with its neighbourhood are passed over, and the
suffix array of the others tells which starts repeat, and for how many bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import chunks, durable, filter_words, flat, in_filter, membership_filter, mix, prefix_hash, range_hash, tidied
from palimpsest.llm.suffix import repeated_starts

SPAN = 400
#: Shorter strings that make up repeated passages: 50 words are some 280 bytes of prose.
PASSAGE = 240
PASSAGE_WORDS = 50
GRAM = 40
#: Bytes of runs whose suffixes are sorted at once.
SHARD_BYTES = 1 << 20
#: Hashes with more different runs than this are settled by counting string hashes,
HOT_RUNS = 2048
#: in parts of about so many strings, whatever the number of runs.
PART_STRINGS = 1 << 19
SEEN = 200_000


def text_key(text: bytes) -> tuple[int, int]:
    """128 bits of a text as two signed longs; equals key_columns."""
    d = hashlib.md5(text).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def key_columns(text: Column) -> tuple[Column, Column]:
    d = F.md5(text)
    return tuple(F.conv(F.substring(d, i, 16), 16, -10).cast("long") for i in (1, 17))


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Least of a[i:i + width] for each i with a whole window."""
    n = len(a)
    if n < width:
        return np.zeros(0, a.dtype)
    rows = -(-n // width)
    block = np.full(rows * width, np.iinfo(a.dtype).max, a.dtype)
    block[:n] = a
    block = block.reshape(rows, width)
    head = np.minimum.accumulate(block, axis=1).ravel()
    tail = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def runs_of(data: np.ndarray, off: np.ndarray, span: int = PASSAGE, gram: int = GRAM, reach: int = SPAN) -> dict[str, np.ndarray]:
    """Runs of string starts with one least gram hash: row, p0, p1 (in the text), p2 (the end of
    the last string of ``reach`` bytes, or of the text), h, s (hash of the bytes p0 to p2) and
    twice (the least gram is in the run twice)."""
    h = prefix_hash(data)
    at = np.arange(max(0, len(data) - gram + 1))
    grams = range_hash(h, at, at + gram)
    width = span - gram + 1
    least = _sliding_min(grams, width)
    size = np.diff(off)
    rows = np.flatnonzero(size >= span)
    if not len(rows):
        none = np.zeros(0, np.int64)
        return {"row": none, "p0": none, "p1": none, "p2": none, "h": none.view(np.uint64), "s": none.view(np.uint64), "twice": none.astype(bool)}
    count = size[rows] - span + 1
    row = np.repeat(rows, count)
    start = np.repeat(off[rows] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    value = least[start]
    new = np.append(True, (value[1:] != value[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(new)
    p0, p1 = start[first], start[np.append(first[1:], len(start)) - 1]
    key, owner = value[first], row[first]
    p2 = np.minimum(p1 + reach, off[owner + 1])
    # places of least grams: equal to the largest least hash of the windows around them
    most = np.iinfo(np.uint64).max
    pad = np.full(width - 1, most, np.uint64)
    top = most - _sliding_min(np.concatenate([pad, most - least, pad]), width)
    places = np.flatnonzero(top[: len(grams)] == grams)
    lo, hi = np.searchsorted(places, p0), np.searchsorted(places, p1 + width)
    run = np.repeat(np.arange(len(first)), hi - lo)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    own = grams[places[np.repeat(lo, hi - lo) + nth]] == key[run]
    twice = np.bincount(run, own, len(first)) > 1
    return {
        "row": owner,
        "p0": p0 - off[owner],
        "p1": p1 - off[owner],
        "p2": p2 - off[owner],
        "h": key,
        "s": range_hash(h, p0, p2),
        "twice": twice,
    }


def _emit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once a task to its runs."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        data, off = flat(batch.column(0))
        for _, _, d, o in chunks(data, off):
            raw = d.tobytes()
            size = np.diff(o)
            keys = np.zeros((len(size), 2), np.int64)
            skip = np.zeros(len(size), bool)
            for r in np.flatnonzero(size >= PASSAGE):
                k = text_key(raw[o[r] : o[r + 1]])
                keys[r] = k
                skip[r] = k in seen
                if len(seen) < SEEN:
                    seen.add(k)
            run = runs_of(d, o)
            keep = ~skip[run["row"]]
            row = run["row"][keep]
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run["h"][keep].view(np.int64)), pa.array(run["s"][keep].view(np.int64)), pa.array(keys[row, 0]), pa.array(keys[row, 1]),
                     pa.array(run["p0"][keep].astype(np.int32)), pa.array(run["p1"][keep].astype(np.int32)),
                     pa.array(run["p2"][keep].astype(np.int32)), pa.array(run["twice"][keep])],
                    names=["h", "s", "k1", "k2", "p0", "p1", "p2", "twice"],
                )


RUN_SCHEMA = "h long, s long, k1 long, k2 long, p0 int, p1 int, p2 int, twice boolean"


def _texts(active):  # noqa: ANN001, ANN202
    """Texts that the filter lets through, with their keys, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = filter_words(active.value)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            data, off = flat(batch.column(0))
            size = np.diff(off)
            take, k1, k2 = [], [], []
            for r in np.flatnonzero(size >= PASSAGE):
                k = text_key(data[off[r] : off[r + 1]].tobytes())
                if k in seen or not in_filter(words, k[0]):
                    continue
                if len(seen) < SEEN:
                    seen.add(k)
                take.append(r)
                k1.append(k[0])
                k2.append(k[1])
            if take:
                text = batch.column(0).take(pa.array(take))
                yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), text.cast(pa.string())], names=["k1", "k2", "text"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text, runs) to the bytes of each run and the number of its starts."""
    for batch in batches:
        text = batch.column(2).cast(pa.binary()).to_pylist()
        k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[tuple] = []
        for a, b, t, runs in zip(k1, k2, text, batch.column(3).to_pylist(), strict=True):
            for h, p0, p1, p2, parts in {(r["h"], r["p0"], r["p1"], r["p2"], r["parts"]) for r in runs}:
                out.append((h, a, b, p0, p1 - p0 + 1, parts, t[p0:p2]))
            if len(out) > 2000:
                yield _pieces(out)
                out = []
        if out:
            yield _pieces(out)


PIECE_SCHEMA = "h long, k1 long, k2 long, p0 int, n int, parts int, bytes binary"


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "k1", "k2", "p0", "n", "parts", "bytes"])


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by hash to (k1, k2, span, lo, hi): bytes of repeated strings."""
    held: list[tuple] = []
    seen: set[tuple[int, int, int]] = set()
    size, last = 0, None
    for batch in batches:
        for h, a, b, p0, n, _, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if h != last:
                if size >= SHARD_BYTES:
                    yield from _shard(held)
                    held, size = [], 0
                seen.clear()
                last = h
            if (a, b, p0) not in seen:  # the same text from several tasks
                seen.add((a, b, p0))
                held.append((a, b, p0, n, raw, h))
                size += len(raw)
    if held:
        yield from _shard(held)


def _alike(held: list[tuple]) -> list[tuple]:
    """The runs that may hold a string of another one, or one twice.

    A string of PASSAGE bytes reaches from each least gram in it half of the other
    bytes to the right, or as far to the left; one of these two blocks is there again
    wherever the string is.
    """
    off = np.concatenate([[0], np.cumsum([len(x[4]) for x in held])])
    h = prefix_hash(np.frombuffer(b"".join([x[4] for x in held]), np.uint8))
    at = np.arange(off[-1] - GRAM + 1)
    least = np.repeat(np.array([x[5] for x in held]), np.diff(off))[: len(at)]
    q = np.flatnonzero(range_hash(h, at, at + GRAM).view(np.int64) == least)
    row = np.searchsorted(off, q, side="right") - 1
    side = (PASSAGE - GRAM) // 2
    right, left = q + GRAM + side <= off[row + 1], (q - side >= off[row]) & (q + GRAM <= off[row + 1])
    block = np.concatenate([range_hash(h, q[right], q[right] + GRAM + side), range_hash(h, q[left] - side, q[left] + GRAM)])
    row = np.concatenate([row[right], row[left]])
    order = np.argsort(block)
    same = np.flatnonzero(block[order[1:]] == block[order[:-1]])
    stay = np.zeros(len(held), bool)
    stay[row[order[same]]] = stay[row[order[same + 1]]] = True
    return [held[i] for i in np.flatnonzero(stay)]


def _shard(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    held = _alike(held)
    found = repeated_starts([x[4] for x in held], [PASSAGE, SPAN], [x[3] for x in held])
    out: list[tuple] = []
    for span, all_starts in zip((PASSAGE, SPAN), found, strict=True):
        for (a, b, p0, *_), starts in zip(held, all_starts, strict=True):
            out += _intervals(a, b, span, starts + p0)
    if out:
        yield _found(out)


def _intervals(a: int, b: int, span: int, starts: np.ndarray) -> list[tuple]:
    """Ascending starts of repeated strings of one text to the bytes they cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > span)
    return [(a, b, span, lo, hi + span) for lo, hi in zip(starts[np.append(0, gap + 1)].tolist(), starts[np.append(gap, len(starts) - 1)].tolist(), strict=True)]


FOUND_SCHEMA = "k1 long, k2 long, span int, lo int, hi int"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["k1", "k2", "span", "lo", "hi"])


#: A string of PASSAGE bytes (two hashes), the one of SPAN bytes there (a hash, 0 where the text ends before), and the place.
STRING = np.dtype([("w1", "<u8"), ("w2", "<u8"), ("v", "<u8"), ("p", "<i4")])
STRINGS_SCHEMA = "h long, part int, k1 long, k2 long, strings binary"


def _string_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of hot hashes to one row a run and part: its strings that belong to the part."""
    for batch in batches:
        out: list[tuple] = []
        for key, a, b, p0, count, parts, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            d = np.frombuffer(raw, np.uint8)
            h = prefix_hash(d)
            at = np.arange(max(0, min(count, len(d) - PASSAGE + 1)))
            half = PASSAGE // 2
            x = np.zeros(len(at), STRING)
            x["w1"] = range_hash(h, at, at + PASSAGE)
            x["w2"] = mix(range_hash(h, at, at + half) * np.uint64(3) + range_hash(h, at + half, at + PASSAGE))
            long = at[: max(0, len(d) - SPAN + 1)]
            x["v"][: len(long)] = range_hash(h, long, long + SPAN)
            x["p"] = at + p0
            part = (x["w1"] % np.uint64(parts)).astype(np.int64)
            x = x[np.argsort(part, kind="stable")]
            cut = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
            out += [(key, i, a, b, x[cut[i] : cut[i + 1]].tobytes()) for i in np.flatnonzero(np.diff(cut)).tolist()]
            if len(out) > 2000:
                yield _strings(out)
                out = []
        if out:
            yield _strings(out)


def _strings(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "part", "k1", "k2", "strings"])


def _count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings sorted by hash and part to (k1, k2, span, lo, hi): bytes of repeated strings."""
    held: list[tuple] = []
    last = None
    for batch in batches:
        for h, part, a, b, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (h, part) != last:
                if held:
                    yield from _count(held)
                held, last = [], (h, part)
            held.append((a, b, raw))
    if held:
        yield from _count(held)


def _count(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    texts: dict[tuple[int, int], int] = {}
    number = np.array([texts.setdefault(x[:2], len(texts)) for x in held])
    x = np.frombuffer(b"".join([x[2] for x in held]), STRING)
    place = np.repeat(number, [len(x[2]) // STRING.itemsize for x in held]) << 32 | x["p"]
    place, once = np.unique(place, return_index=True)  # the same text from several tasks
    x = x[once]
    order = np.lexsort((x["v"], x["w2"], x["w1"]))
    x = x[order]
    same = (x["w1"][1:] == x["w1"][:-1]) & (x["w2"][1:] == x["w2"][:-1])
    keys = list(texts)
    out: list[tuple] = []
    for span, again in ((PASSAGE, same), (SPAN, same & (x["v"][1:] == x["v"][:-1]) & (x["v"][1:] != 0))):
        hit = np.append(False, again) | np.append(again, False)
        at = np.sort(place[order[hit]])
        for starts in np.split(at, np.flatnonzero(np.diff(at >> 32)) + 1):
            if len(starts):
                out += _intervals(*keys[starts[0] >> 32], span, starts & 0xFFFFFFFF)
    if out:
        yield _found(out)


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def n_words(text: bytes) -> int:
    """Words [^\\x20\\x09-\\x0D]+ of a text (str.split would also part at 0x1C to 0x1F)."""
    return len(_WORD.findall(text))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def spans_of(text: bytes, found: list[dict]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Maximal runs of repeated SPAN-byte strings, and repeated passages."""
    long = merged([(x["lo"], x["hi"]) for x in found if x["span"] == SPAN])
    short = merged([(x["lo"], x["hi"]) for x in found if x["span"] == PASSAGE])
    return long, [(lo, hi) for lo, hi in short if n_words(text[lo:hi]) >= PASSAGE_WORDS]


def _finish(batches: Iterator[pa.RecordBatch], keep_text: bool, passages: bool) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text, intervals) to what is left of each text."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32()))]
    for batch in batches:
        rows = []
        for a, b, t, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
            spans, known = spans_of(t, found)
            if passages:
                spans = merged(spans + known)
            left, at = [], 0
            for lo, hi in spans:
                left.append(t[at:lo])
                at = hi
            kept = b"".join([*left, t[at:]])
            more = (kept.decode("utf-8", "ignore"), [list(x) for x in spans]) if keep_text else (None, None)
            rows.append((a, b, len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), len(known), sum(hi - lo for lo, hi in known), *more))
        if rows:
            names = ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes", "kept_text", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def repeated_intervals(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(k1, k2, span, lo, hi) of repeated bytes by text key, for strings of PASSAGE and SPAN
    bytes, and (k1, k2) of texts that occur twice whole."""
    texts = docs.select(F.col(text).alias("text")).where(F.octet_length("text") >= PASSAGE)
    k1, k2 = key_columns(F.col("text"))
    whole = durable(texts.select(k1.alias("k1"), k2.alias("k2")).groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2"))

    runs = durable(texts.mapInArrow(tidied(_emit_runs), RUN_SCHEMA))
    # rows of one text repeat its places; different places of one text count like those of two texts
    place = F.xxhash64("k1", "k2", "p0")
    ends = [F.min("_p").alias("_first"), F.max("_p").alias("_last"), F.max("twice").alias("twice")]
    shared = runs.select("h", place.alias("_p"), "twice").groupBy("h").agg(*ends).where("twice or _first < _last").select("h")
    near = durable(runs.join(shared, "h"))
    starts = F.max(F.col("p1") - F.col("p0") + 1).alias("_starts")
    by_bytes = near.select("h", "s", place.alias("_p"), "twice", "p0", "p1").groupBy("h", "s").agg(*ends, starts)
    same = by_bytes.select("h", "s", "_first", (F.col("_first") < F.col("_last")).alias("multi"))
    kinds = by_bytes.groupBy("h").agg(F.count("*").alias("_n"), F.max("twice").alias("_twice"), F.sum("_starts").alias("_starts"))
    parts = F.ceil(F.col("_starts") / PART_STRINGS).cast("int").alias("parts")
    many = kinds.where("_n > 1 or _twice").select("h", (F.col("_n") > HOT_RUNS).alias("hot"), parts)
    state = near.join(same, ["h", "s"])
    short = F.struct(F.lit(PASSAGE).alias("span"), F.col("p0").alias("lo"), (F.col("p1") + PASSAGE).alias("hi"))
    last = F.least("p1", F.col("p2") - SPAN)  # start of the last whole string of SPAN bytes
    long = F.when(last >= F.col("p0"), F.struct(F.lit(SPAN).alias("span"), F.col("p0").alias("lo"), (last + SPAN).alias("hi")))
    settled = state.where("multi").select("k1", "k2", F.explode(F.array_compact(F.array(short, long))).alias("x")).select("k1", "k2", "x.*").distinct()
    todo = durable(state.where(place == F.col("_first")).select("h", "k1", "k2", "p0", "p1", "p2").join(many, "h"))

    def cut(some: DataFrame) -> DataFrame:
        lists = some.groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "p0", "p1", "p2", "parts")).alias("runs"))
        active = membership_filter(some.select("k1").distinct(), "k1")
        bodies = texts.mapInArrow(tidied(_texts(active)), "k1 long, k2 long, text string")
        return bodies.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "runs").mapInArrow(tidied(_cut), PIECE_SCHEMA)

    by_hash = cut(todo.where("not hot")).repartition("h").sortWithinPartitions("h")
    found = settled.unionByName(by_hash.mapInArrow(tidied(_sort_shards), FOUND_SCHEMA))
    if not todo.where("hot").isEmpty():
        strings = cut(todo.where("hot")).mapInArrow(tidied(_string_hashes), STRINGS_SCHEMA)
        by_part = strings.repartition("h", "part").sortWithinPartitions("h", "part")
        found = found.unionByName(by_part.mapInArrow(tidied(_count_parts), FOUND_SCHEMA))
    return durable(found), whole


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, passages: bool = False) -> DataFrame:
    """What is left of every row of ``docs`` without repeated strings of SPAN bytes.

    With ``passages``, runs of repeated PASSAGE-byte strings that hold
    PASSAGE_WORDS words or more are cut as well; they are counted in any case.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages,
    passage_bytes and, with ``keep_text``, kept_text (undecodable bytes at cuts
    dropped), spans and the text's key k1, k2. Null
    texts are empty; texts under PASSAGE bytes stay; of equal rows or texts of
    SPAN bytes or more nothing stays; other columns are not read; an empty table
    gives an empty result. Matches never cross documents.
    """
    found, whole = repeated_intervals(docs, text)
    body = F.coalesce(F.col(text), F.lit(""))
    k1, k2 = key_columns(body)
    words = F.expr(f"regexp_count(coalesce(`{text}`, ''), '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+')")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), (words >= PASSAGE_WORDS).alias("_wordy"),
        k1.alias("k1"), k2.alias("k2"), F.sha2(body, 256).alias("_all"),
    )
    partial = found.join(whole, ["k1", "k2"], "left_anti").groupBy("k1", "k2").agg(F.collect_list(F.struct("span", "lo", "hi")).alias("found"))
    partial = durable(partial)
    active = membership_filter(partial.select("k1"), "k1")
    texts = docs.select(F.col(text).alias("text")).where(F.octet_length("text") >= PASSAGE)
    bodies = texts.mapInArrow(tidied(_texts(active)), "k1 long, k2 long, text string")
    schema = "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long, kept_text string, spans array<array<int>>"
    cleaned = bodies.join(partial, ["k1", "k2"]).select("k1", "k2", "text", "found").mapInArrow(tidied(lambda it: _finish(it, keep_text, passages)), schema)
    cleaned = durable(cleaned if keep_text else cleaned.drop("kept_text", "spans")).dropDuplicates(["k1", "k2"])
    out = rows.join(cleaned, ["k1", "k2"], "left").join(whole.withColumn("_whole", F.lit(True)), ["k1", "k2"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    again = F.coalesce("_whole", F.lit(False))
    told = again & F.col("_wordy")
    gone = again & ((F.col("n_bytes") >= SPAN) | (F.col("_wordy") if passages else F.lit(False)))
    cols = [
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "_all")).alias("kept_sha256"),
        F.when(told, F.lit(1)).otherwise(F.coalesce("n_passages", F.lit(0))).cast("long").alias("n_passages"),
        F.when(told, F.col("n_bytes")).otherwise(F.coalesce("passage_bytes", F.lit(0))).cast("long").alias("passage_bytes"),
    ]
    if keep_text:
        cols += [F.when(gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"), "spans", "k1", "k2"]
    return out.select(*cols)


def clean_documents(docs: DataFrame, text: str = "text", count: str = "n_chars") -> DataFrame:
    """``docs`` with repeated strings and passages cut out of the texts; ``count``, if there, follows.

    All rows and columns stay; texts without repeats, null ones among them, as they are.
    """
    names = [f"`{c}`" for c in docs.columns]
    left = remove_repeats(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text")), keep_text=True, passages=True)
    own = [f"__repeats_{x}" for x in ("a", "b", "c", "d", "kept")]  # clash with no column of a table
    left = left.where("n_removed > 0").select(F.col("k1").alias(own[2]), F.col("k2").alias(own[3]), F.col("kept_text").alias(own[4])).dropDuplicates(own[2:4])
    k1, k2 = key_columns(F.coalesce(F.col(text), F.lit("")))
    joined = docs.withColumns({own[0]: k1, own[1]: k2}).join(left, (F.col(own[0]) == F.col(own[2])) & (F.col(own[1]) == F.col(own[3])), "left")
    kept = F.col(own[4])
    new = {text: F.when(kept.isNotNull(), kept).otherwise(F.col(text))}
    if count in docs.columns:
        new[count] = F.when(kept.isNotNull(), F.length(kept).cast("long")).otherwise(F.col(count))
    return joined.withColumns(new).select(*names)
