"""Operator 8, n-gram Jaccard join over whole documents.

Documents with equal shingle sets form a class; classes are compared. Two
classes can only be similar if they share a shingle among the rarest 30 % of
each (prefix filter, with one global order: shingles of frequent words later,
shingles that many documents share last). Classes that
share one meet in size-banded tiles, where hashed bitmap signatures bound the
overlap from above by bit counts. What passes is grouped into candidate
components, and only there are whole sorted shingle arrays intersected, each
pair of classes once. Pairs are never emitted; links are counted and
components are kept as stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import LOWER, chunks, durable, flat, mix, prefix_hash, range_hash, release, shingles, tidied, words_of
from palimpsest.llm.graph import components

PERCENT = 70
WIDTH = 3
#: Rows of one side of a tile.
TILE = 1024
#: A shingle that this many documents of one slice share is reported as heavy.
HEAVY_IN_SLICE = 8
SLICE_BYTES = 16 << 20
#: The table of heavy shingles, which only orders prefixes, has at most so many rows.
HEAVY_ROWS = 1 << 18
#: Classes that a task remembers, so as to describe each once.
SEEN = 200_000
#: Hashed words whose frequency classes are known; the table is 1 MiB.
WORD_SLOTS = 1 << 20
WORD_IN_TASK = 64
#: A shingle is a frequency class (8 bits, from its words) above 56 bits of hash, so
#: that the order of shingles as numbers has the rarer ones first.
CLASS_BITS, MAX_CLASS = 56, 84
#: Bits of the fixed-size filter of classes that need their whole arrays.
ACTIVE_BITS = 1 << 26


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the words of each text, ASCII case folded."""
    low = LOWER[data]
    starts, ends, rows = words_of(low, off)
    return range_hash(prefix_hash(low), starts, ends), rows


def shingle_sets(data: np.ndarray, off: np.ndarray, classes: np.ndarray | None = None) -> list[np.ndarray]:
    """Sorted distinct shingles of each text, ASCII case folded.

    A text of fewer than WIDTH words has its whole word sequence as its only
    shingle; one without words has none. ``classes`` has the frequency class of
    each word slot; the sum over a shingle's words is its class, so that the
    likely rarer shingles come first.
    """
    n = len(off) - 1
    words, rows = word_hashes(data, off)
    h, hrow, first = shingles(words, rows, n, WIDTH)
    h >>= np.uint64(64 - CLASS_BITS)
    if classes is not None and len(h):
        of_word = classes[(words & np.uint64(WORD_SLOTS - 1)).astype(np.int64)].astype(np.uint64)
        h |= (of_word[first] + of_word[first + 1] + of_word[first + 2]) << np.uint64(CLASS_BITS)
    cut = np.searchsorted(hrow, np.arange(n + 1))
    at = np.searchsorted(rows, np.arange(n + 1))
    out = []
    for i in range(n):
        a, b = cut[i], cut[i + 1]
        if b > a:
            s = np.sort(h[a:b])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        else:
            w = words[at[i] : at[i + 1]]
            whole = np.uint64(len(w))
            with np.errstate(over="ignore"):
                for x in w:
                    whole = mix(whole * np.uint64(0x9FB21C651E98DF25) + x)
            out.append(np.array([whole >> np.uint64(64 - CLASS_BITS)], np.uint64) if len(w) else np.zeros(0, np.uint64))
    return out


def class_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set of hashes, as two signed longs."""
    a = np.add.reduce(mix(s + np.uint64(0xA0761D6478BD642F))) if len(s) else np.uint64(0)
    b = np.bitwise_xor.reduce(mix(s ^ np.uint64(0xE7037ED1A0B428DB))) if len(s) else np.uint64(0)
    with np.errstate(over="ignore"):
        b = b * np.uint64(0x8EBC6AF09C88C6E3) + np.uint64(len(s))
    return int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def level_of(n: int) -> int:
    """log2 of the bits of the signature of a set of n: twice its size or more."""
    return max(6, int(2 * n - 1).bit_length())


def signature(s: np.ndarray, level: int) -> bytes:
    bits = np.zeros(1 << level, np.uint8)
    bits[(s & np.uint64((1 << level) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(what, key, n): heavy shingles of each slice (0) and frequent word slots of the task (1)."""
    slots = np.zeros(WORD_SLOTS, np.int64)

    def report(what: int, k: np.ndarray, n: np.ndarray, least: int) -> pa.RecordBatch:
        k, n = k[n >= least], n[n >= least]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), what, np.int32)), pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], names=["what", "key", "n"])

    held, size = [], 0
    for batch in batches:
        data, off = flat(batch.column(0))
        for _, _, d, o in chunks(data, off):
            words, _ = word_hashes(d, o)
            slots += np.bincount((words & np.uint64(WORD_SLOTS - 1)).astype(np.int64), minlength=WORD_SLOTS)
            held += shingle_sets(d, o)
            size += len(d)
            if size >= SLICE_BYTES:
                yield report(0, *np.unique(np.concatenate(held), return_counts=True), HEAVY_IN_SLICE)
                held, size = [], 0
    if held:
        yield report(0, *np.unique(np.concatenate(held), return_counts=True), HEAVY_IN_SLICE)
    yield report(1, np.arange(WORD_SLOTS), slots, WORD_IN_TASK)


def word_classes(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Four classes a doubling of the count; slots that are nowhere frequent have class 0."""
    out = np.zeros(WORD_SLOTS, np.uint8)
    out[keys] = np.minimum(MAX_CLASS, np.round(4 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)
    return out


def _describe(heavy):  # noqa: ANN001, ANN202
    """(doc_id, text) to (doc_id, n, k1, k2, prefix keys, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, slots, slot_counts = heavy.value
        classes = word_classes(slots, slot_counts)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            data, off = flat(batch.column(1))
            n, k1, k2, prefixes, marks = [], [], [], [], []
            for _, _, d, o in chunks(data, off):
                for s in shingle_sets(d, o, classes):
                    n.append(len(s))
                    key = class_key(s)
                    k1.append(key[0])
                    k2.append(key[1])
                    if not len(s) or key in seen:
                        prefixes.append(None)
                        marks.append(None)
                        continue
                    if len(seen) < SEEN:
                        seen.add(key)
                    prefixes.append(_prefix(s, key[0], keys, counts))
                    marks.append(signature(s, level_of(len(s))))
            ends = np.cumsum([0, *[0 if p is None else len(p) for p in prefixes]]).astype(np.int32)
            values = np.concatenate([p for p in prefixes if p is not None] or [np.zeros(0, np.int64)])
            mask = pa.array([p is None for p in prefixes], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=mask), pa.array(marks, pa.binary())],
                names=["doc_id", "n", "k1", "k2", "prefix", "mark"],
            )

    return run


def _prefix(s: np.ndarray, k1: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Group keys under which a class is filed: its rarest shingles, heavy ones by tile.

    A heavy shingle of c documents has c / TILE tiles; the class goes to every
    pair of tiles that holds its own, so that no group outgrows two tiles.
    """
    p = prefix_length(len(s))
    if len(keys):
        bare = s & np.uint64((1 << CLASS_BITS) - 1)
        at = np.minimum(np.searchsorted(keys, bare), len(keys) - 1)
        hot = keys[at] == bare
        if hot.any():
            light = s[~hot]
            if len(light) >= p:
                return light[:p].view(np.int64)
            order = np.lexsort((s[hot], counts[at[hot]]))
            chosen, size = s[hot][order][: p - len(light)], counts[at[hot]][order][: p - len(light)]
            out = [light]
            for token, c in zip(chosen, size, strict=True):
                tiles = int(c) // TILE + 1
                mine = k1 % tiles
                pairs = np.array([[min(mine, t), max(mine, t)] for t in range(tiles)], np.uint64)
                out.append(token + mix(pairs[:, 0] * np.uint64(1 << 32) + pairs[:, 1]) if tiles > 1 else np.array([token]))
            return np.concatenate(out).view(np.int64)
    return s[:p].view(np.int64)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, k1), sorted, all of a token in one task, to (bucket, k1).

    A token's classes go to the bucket of the least of them, which comes first:
    only it and the token are carried from batch to batch, however many rows a
    token has. Copies with edits share many tokens, but these have few different
    least classes, so that a class is in few buckets; any two classes of a token
    are in one of them.
    """
    token = least = last = None
    told = False  # whether the carried token's first class has been sent to its bucket
    for b in batches:
        t, c = np.asarray(b.column(0)), np.asarray(b.column(1))
        if not len(t):
            continue
        start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        size = np.diff(np.append(start, len(t)))
        first = c[start].copy()
        on = token is not None and t[0] == token
        if on:
            first[0] = least
        bucket = np.repeat(first, size)
        other = c != bucket
        if on:
            other[0] &= c[0] != last  # a row like the one before it
        other[1:] &= (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        shared = np.add.reduceat(other.astype(np.int64), start) > 0
        own = shared.copy()
        if on and told:
            own[0] = False
        pairs = np.concatenate([np.stack([bucket[other], c[other]], 1), np.stack([first[own], first[own]], 1)])
        told = bool(shared[-1]) or (on and len(start) == 1 and told)
        token, least, last = t[-1], first[-1], c[-1]
        if len(pairs):
            pairs = np.unique(pairs, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["bucket", "k1"])


def _fold(mark: bytes, level: int) -> np.ndarray:
    """Words of a signature, halved by OR until it has 2**level bits."""
    w = np.frombuffer(mark, np.uint64)
    while len(w) > 1 << (level - 6):
        half = len(w) // 2
        w = w[:half] | w[half:]
    return w


def bounded_pairs(n: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """(i, j) pairs, i < j, whose size band and bit counts leave a link possible."""
    order = np.argsort(n, kind="stable")
    levels = np.array([len(m) * 8 for m in marks]).astype(np.int64)
    out = []
    for bits in np.unique(levels):
        level = int(bits).bit_length() - 1
        # pairs whose smaller signature has this many bits; a size band of 1/0.7 spans two levels
        rows = order[(levels[order] == bits) | (levels[order] == 2 * bits)]
        own = levels[rows] == bits
        w = np.array([_fold(marks[r], level) for r in rows])
        size = n[rows]
        count = np.bitwise_count(w).sum(1, dtype=np.int64)
        for i in np.flatnonzero(own):
            j0, j1 = i + 1, int(np.searchsorted(size, size[i] * 100 // PERCENT + 1, side="right"))
            if j1 <= j0:
                continue
            both = np.bitwise_count(w[i] & w[j0:j1]).sum(1, dtype=np.int64)
            bound = np.minimum(size[i] - (count[i] - both), size[j0:j1] - (count[j0:j1] - both))
            ok = (100 + PERCENT) * bound >= PERCENT * (size[i] + size[j0:j1])
            j = np.flatnonzero(ok) + j0
            if len(j):
                out.append(np.stack([np.full(len(j), rows[i]), rows[j]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def stars(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n rows over ``pairs``."""
    root = np.arange(n)
    if not len(pairs):
        return root
    while True:
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        np.minimum.at(new, root[pairs[:, 0]], low)
        np.minimum.at(new, root[pairs[:, 1]], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal leading columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        cols = [np.asarray(b.column(i)) for i in range(n_keys)]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            k = tuple(c[i] for c in cols)
            if held and k != key:
                yield pa.Table.from_batches(held)
                held = []
            key = k
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (bucket, a, b, k1, n, mark) to star edges (u, v) of pairs that pass the bound."""
    u, v = [], []
    for t in _groups(batches, 3):
        if t.num_rows < 2:
            continue
        k, n = t.column(3).to_numpy(), t.column(4).to_numpy()
        root = stars(len(k), bounded_pairs(n, t.column(5).to_pylist()))
        far = np.flatnonzero(root != np.arange(len(k)))
        if len(far):
            u.append(k[far])
            v.append(k[root[far]])
        if len(u) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])
            u, v = [], []
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])


def _arrays(active, heavy):  # noqa: ANN001, ANN202
    """Texts to (k1, k2, set) of classes that the filter lets through, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = active.value
        classes = word_classes(*heavy.value[2:])
        have = np.zeros(ACTIVE_BITS // 64, np.uint64)
        have[words] = bits
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            data, off = flat(batch.column(0))
            for _, _, d, o in chunks(data, off):
                k1, k2, sets = [], [], []
                for s in shingle_sets(d, o, classes):
                    if not len(s):
                        continue
                    key = class_key(s)
                    bit = key[0] % ACTIVE_BITS
                    if not int(have[bit // 64]) >> (bit % 64) & 1 or key in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(key)
                    k1.append(key[0])
                    k2.append(key[1])
                    sets.append(s.tobytes())
                if k1:
                    yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sets, pa.binary())], names=["k1", "k2", "tokens"])

    return run


def exact_links(sets: list[np.ndarray], side: np.ndarray | None = None) -> np.ndarray:
    """(i, j) pairs, i < j, with 100 * intersection >= PERCENT * union.

    With ``side``, only pairs of rows on different sides. Each sorted array is
    met by all later ones at once over the ranks of its hashes in the tile.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    ranks = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    cut = np.concatenate([[0], np.cumsum(size[order])])
    flag = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, np.int32)
    ordered = size[order]
    out = []
    for i in range(n - 1):
        end = int(np.searchsorted(ordered, ordered[i] * 100 // PERCENT, side="right"))
        if end <= i + 1:
            continue
        mine = ranks[cut[i] : cut[i + 1]]
        flag[mine] = 1
        common = np.add.reduceat(flag[ranks[cut[i + 1] : cut[end]]], cut[i + 1 : end] - cut[i + 1])
        flag[mine] = 0
        ok = (100 + PERCENT) * common.astype(np.int64) >= PERCENT * (ordered[i] + ordered[i + 1 : end])
        if side is not None:
            ok &= side[order[i]] != side[order[i + 1 : end]]
        j = np.flatnonzero(ok) + i + 1
        if len(j):
            a, b = np.full(len(j), order[i]), order[j]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (comp, a, b, tile, k1, k2, copies, tokens) to (node, other, links) rows."""
    for t in _groups(batches, 3):
        a, b = t.column(1)[0].as_py(), t.column(2)[0].as_py()
        k1, k2 = t.column(4).to_numpy(), t.column(5).to_numpy()
        # a class may come from several tasks
        _, first = np.unique(np.stack([k1, k2], 1), axis=0, return_index=True)
        t, k1, k2 = t.take(pa.array(first)), k1[first], k2[first]
        copies = t.column(6).to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column(7).to_pylist()]
        pairs = exact_links(sets, None if a == b else t.column(3).to_numpy())
        links = np.zeros(len(k1), np.int64)
        np.add.at(links, pairs[:, 0], copies[pairs[:, 1]])
        np.add.at(links, pairs[:, 1], copies[pairs[:, 0]])
        root = stars(len(k1), pairs)
        rows = np.flatnonzero(links > 0)
        if len(rows):
            name = [f"{x & (2**64 - 1):016x}{y & (2**64 - 1):016x}" for x, y in zip(k1.tolist(), k2.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name[i] for i in rows]), pa.array([name[root[i]] for i in rows]), pa.array(links[rows])],
                names=["node", "other", "links"],
            )


def _tiled(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``rows`` with tile, a and b: a group of more than TILE rows becomes tiles, and
    each row goes to every pair (a, b) of tiles with its own, so that no task
    holds more than two tiles of a group however large it is."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / TILE).cast("int").alias("_tiles"))
    own = rows.join(sizes, group).withColumn("tile", F.pmod(F.xxhash64(key), F.col("_tiles")).cast("int"))
    every = own.select("*", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_other"))
    return every.withColumns({"a": F.least("tile", "_other"), "b": F.greatest("tile", "_other")}).drop("_tiles", "_other")


def _candidates(described: DataFrame) -> DataFrame:
    """(node, root): classes that may be similar, by candidate component."""
    posts = described.where("prefix is not null").select(F.explode("prefix").alias("token"), "k1")
    met = posts.repartition("token").sortWithinPartitions("token", "k1").mapInArrow(tidied(_meet), "bucket long, k1 long").distinct()
    marks = described.where("mark is not null").select("k1", "k2", "n", "mark").dropDuplicates(["k1", "k2"]).select("k1", "n", "mark")
    placed = _tiled(met, "bucket", "k1")
    tiles = placed.join(marks, "k1").select("bucket", "a", "b", "k1", "n", "mark").repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    return durable(components(tiles.mapInArrow(tidied(_bound), "u long, v long").distinct()))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Similar documents and component of every row of ``docs``.

    Returns doc_id, n_shingles, n_similar, component_id and class_id (the least
    doc_id with an equal set; rows without shingles are their own class). Null, empty
    and blank texts have no shingles, link with nothing and are their own
    component; repeated rows count as documents of their own; a null doc_id
    names a component only if no other id is in it; other columns are not read;
    an empty table gives an empty result. Texts are read whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    heavy = durable(rows.select("text").mapInArrow(tidied(_heavy), "what int, key long, n long").groupBy("what", "key").agg(F.sum("n").alias("n")))

    def columns(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        t = df.toArrow()
        k, n = (np.asarray(t.column(c).combine_chunks()) if t.num_rows else np.zeros(0, np.int64) for c in ("key", "n"))
        order = np.argsort(k)
        return k[order], n[order]

    keys, counts = columns(heavy.where("what = 0").orderBy(F.desc("n"), "key").limit(HEAVY_ROWS))
    shared = spark.sparkContext.broadcast((keys.view(np.uint64), counts, *columns(heavy.where("what = 1"))))  # at most WORD_SLOTS rows
    described = durable(rows.mapInArrow(tidied(_describe(shared)), f"doc_id {kind}, n long, k1 long, k2 long, prefix array<long>, mark binary"))

    candidate = _candidates(described)
    release(spark)

    bit = F.pmod(F.col("node"), F.lit(ACTIVE_BITS))
    have = candidate.select(F.floor(bit / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(node, {ACTIVE_BITS}) % 64 as int))").alias("b"))
    have = have.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most ACTIVE_BITS / 64 rows
    words, bits = (np.asarray(have.column(c).combine_chunks()) if have.num_rows else np.zeros(0, np.int64) for c in ("w", "b"))
    active = spark.sparkContext.broadcast((words, bits.view(np.uint64)))
    sets = rows.select("text").mapInArrow(tidied(_arrays(active, shared)), "k1 long, k2 long, tokens binary")

    classes = described.where("n > 0").groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    member = candidate.join(classes, candidate["node"] == classes["k1"]).select(F.col("root").alias("comp"), "k1", "k2", "copies")
    placed = _tiled(member, "comp", "k1")
    work = placed.join(sets, ["k1", "k2"]).select("comp", "a", "b", "tile", "k1", "k2", "copies", "tokens")
    work = work.repartition("comp", "a", "b").sortWithinPartitions("comp", "a", "b")
    found = durable(work.mapInArrow(tidied(_verify), "node string, other string, links long"))

    del sets, placed, work
    release(spark)
    roots = components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    name = F.format_string("%016x%016x", "k1", "k2")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.withColumn("node", name)
    least = named.join(roots, "node").groupBy("root").agg(F.min("least").alias("_first"))
    known = named.join(linked, "node", "left").join(roots, "node", "left").join(least, "root", "left")
    known = known.select(
        "k1", "k2",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_similar"),
        F.coalesce("_first", "least").alias("_component"), F.col("least").alias("_class"),
    )
    out = described.select("doc_id", "n", "k1", "k2").join(known, ["k1", "k2"], "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("_similar", F.lit(0)).cast("long").alias("n_similar"),
        F.coalesce("_component", "doc_id").alias("component_id"),
        F.coalesce("_class", "doc_id").alias("class_id"),
    )
