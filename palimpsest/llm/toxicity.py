"""Operator 9, toxicity by weak supervision.

Lexicons of words and word beginnings are drawn from labelled texts; lexicon
and pattern voters built on them vote on every text. A generative label model
over all vote patterns of the whole table estimates each voter's accuracy and
the correlation of every two voters, exactly, since patterns are few. Its
posteriors train a linear classifier over lexicon entries, which scores texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import LOWER, chunks, durable, flat, held_out, per_row, prefix_hash, range_hash, tidied

#: Hashed entries of each family: words, and beginnings of 4, 5 and 6 bytes.
SLOTS = 1 << 19
PREFIXES = (4, 5, 6)
FAMILIES = 1 + len(PREFIXES)
#: Labelled texts of each label that lexicons and classifier are fitted on.
PER_LABEL = 5000
MAX_ENTRIES = 4096
MIN_SUPPORT, MIN_Z, STRONG = 3, 3.0, 0.9
#: Voters: bits of a pattern, so at most 2**12 patterns exist.
VOTERS = 12
THRESHOLD = 0.7

#: Words are runs of letters, digits and bytes beyond ASCII here, so that punctuation falls off.
_OUTSIDE = np.array([not (chr(b).isalnum() or b >= 128) if b < 128 else False for b in range(256)])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>!@")] = True


def entries_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries of each word, one column a family, -1 where too short; row of each word)."""
    low = LOWER[data]
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = ~_OUTSIDE[low]
    inside_cut = inside.copy()
    step = np.diff(inside_cut)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cut = np.unique(off[1:-1])
    cut = cut[(cut > 0) & (cut < len(low))]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    if len(cut):
        starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
    row = np.searchsorted(off, starts, side="right") - 1
    h = prefix_hash(low)
    out = np.full((len(starts), FAMILIES), -1, np.int32)
    mask = np.uint64(SLOTS - 1)
    out[:, 0] = (range_hash(h, starts, ends) & mask).astype(np.int32)
    for f, n in enumerate(PREFIXES, 1):
        long = np.flatnonzero(ends - starts >= n)
        out[long, f] = (range_hash(h, starts[long], starts[long] + n) & mask).astype(np.int32) + f * SLOTS
    return out, row


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (entry, texts labelled 0, texts labelled 1)."""
    total = np.zeros((2, FAMILIES * SLOTS), np.int32)
    any_row = False
    for batch in batches:
        label = batch.column(0).to_numpy()
        data, off = flat(batch.column(1))
        for i, j, d, o in chunks(data, off):
            e, row = entries_of(d, o)
            for r in range(j - i):
                a, b = np.searchsorted(row, [r, r + 1])
                u = np.unique(e[a:b])
                total[int(label[i + r]), u[u >= 0]] += 1
                any_row = True
    if any_row:
        k = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[0, k].astype(np.int64)), pa.array(total[1, k].astype(np.int64))], names=["entry", "n0", "n1"])


class Lexicon:
    """Chosen entries, sorted, and whether each is strong (precise)."""

    def __init__(self, entries: np.ndarray, strong: np.ndarray) -> None:
        self.entries, self.strong = entries, strong
        self.index: np.ndarray | None = None

    def lookup(self) -> np.ndarray:
        if self.index is None:
            self.index = np.full(FAMILIES * SLOTS + 1, -1, np.int32)
            self.index[self.entries] = np.arange(len(self.entries))
        return self.index


def votes_of(lex: Lexicon, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Vote pattern and distinct lexicon entries of each text."""
    n = len(off) - 1
    e, row = entries_of(data, off)
    hit = lex.lookup()[e]  # -1 of a short word reads the spare last place
    word, fam = np.nonzero(hit >= 0)
    which = hit[word, fam]
    owner = row[word]
    strong = lex.strong[which] if len(lex.strong) else np.zeros(len(which), bool)
    key = np.unique(owner.astype(np.int64) * (MAX_ENTRIES + 1) + which)
    u_row, u_hit = key // (MAX_ENTRIES + 1), key % (MAX_ENTRIES + 1)
    u_fam = lex.entries[u_hit] // SLOTS if len(lex.entries) else np.zeros(0, np.int64)
    u_strong = lex.strong[u_hit] if len(lex.strong) else np.zeros(0, bool)
    pattern = np.zeros(n, np.int32)
    for f in range(FAMILIES):
        some = np.bincount(u_row[(u_fam == f) & u_strong], minlength=n)
        weak = np.bincount(u_row[u_fam == f], minlength=n)
        pattern |= (some >= 1).astype(np.int32) << f
        pattern |= ((some >= 2) | (weak >= 4)).astype(np.int32) << (FAMILIES + f)
    words = np.bincount(row, minlength=n)
    uses = np.bincount(owner[strong & (fam == 1)], minlength=n) if len(owner) else np.zeros(n, np.int64)
    chars = np.maximum(1, np.diff(off))
    symbols = per_row(_SYMBOL[data].astype(np.int8), off)
    capitals = per_row(((data >= 65) & (data <= 90)).astype(np.int8), off)
    pattern |= (1000 * uses >= 5 * np.maximum(1, words)).astype(np.int32) * (uses > 0) << 8
    pattern |= (uses >= 3).astype(np.int32) << 9
    pattern |= (20 * symbols >= chars).astype(np.int32) << 10
    pattern |= (2 * capitals >= chars).astype(np.int32) << 11
    cut = np.searchsorted(u_row, np.arange(n + 1))
    return pattern, [u_hit[cut[i] : cut[i + 1]].astype(np.int32) for i in range(n)]


def _vote(lexicon):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, strong = lexicon.value
        lex = Lexicon(entries, strong)
        for batch in batches:
            data, off = flat(batch.column(2))
            patterns, hits = [np.zeros(0, np.int32)], []
            for _, _, d, o in chunks(data, off):
                p, h = votes_of(lex, d, o)
                patterns.append(p)
                hits += h
            ends = np.cumsum([0, *map(len, hits)]).astype(np.int32)
            values = np.concatenate([*hits, np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.concatenate(patterns)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
                names=["doc_id", "held_out", "pattern", "hits"],
            )

    return run


class LabelModel:
    """P(votes, label) with an accuracy for each voter and a correlation for each two.

    log P = label * (b + votes . accuracy) + votes . rate + pairs . correlation - log Z,
    summed exactly over all 2**VOTERS patterns. Fitted to the patterns of the
    whole table, label unknown, and to labelled patterns; the latter say which
    of the two classes is which.
    """

    def __init__(self) -> None:
        states = np.arange(1 << VOTERS)
        self.votes = ((states[:, None] >> np.arange(VOTERS)) & 1).astype(np.float64)
        i, j = np.triu_indices(VOTERS, 1)
        self.pairs = self.votes[:, i] * self.votes[:, j]
        self.rate = np.zeros(VOTERS)
        self.accuracy = np.zeros(VOTERS)
        self.correlation = np.zeros(len(i))
        self.b = 0.0

    def fit(self, counts: np.ndarray, labelled: np.ndarray, rounds: int = 400, step: float = 0.3, decay: float = 2e-3) -> LabelModel:
        """``counts`` by pattern; ``labelled`` by label and pattern."""
        mass = counts / max(1.0, counts.sum())
        known = labelled / max(1.0, labelled.sum())
        if labelled[1].sum() and labelled[0].sum():
            p1 = (labelled[1] @ self.votes + 0.5) / (labelled[1].sum() + 1)
            p0 = (labelled[0] @ self.votes + 0.5) / (labelled[0].sum() + 1)
            self.accuracy = np.log(p1 / (1 - p1)) - np.log(p0 / (1 - p0))
            self.rate = np.log(p0 / (1 - p0))
            self.b = float(np.log(labelled[1].sum() / labelled[0].sum()) + np.log((1 - p1) / (1 - p0)).sum())
        theta = np.concatenate([[self.b], self.accuracy, self.rate, self.correlation])
        first, m, v = theta.copy(), np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, rounds + 1):
            self._set(theta)
            joint, post = self._joint()
            want1 = mass * post + known[1]  # label 1, by pattern
            want0 = mass * (1 - post) + known[0]
            total = want1.sum() + want0.sum()
            d1, d0 = want1 - total * joint[1], want0 - total * joint[0]
            g = np.concatenate([[d1.sum()], d1 @ self.votes, (d1 + d0) @ self.votes, (d1 + d0) @ self.pairs])
            g -= decay * np.concatenate([theta[: 1 + 2 * VOTERS] - first[: 1 + 2 * VOTERS], theta[1 + 2 * VOTERS :]])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + step * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-4) * 0.1
        self._set(theta)
        return self

    def _set(self, theta: np.ndarray) -> None:
        self.b, self.accuracy, self.rate, self.correlation = theta[0], theta[1 : 1 + VOTERS], theta[1 + VOTERS : 1 + 2 * VOTERS], theta[1 + 2 * VOTERS :]

    def _joint(self) -> tuple[np.ndarray, np.ndarray]:
        base = self.votes @ self.rate + self.pairs @ self.correlation
        raw = np.stack([base, base + self.b + self.votes @ self.accuracy])
        raw = np.exp(raw - raw.max())
        joint = raw / raw.sum()
        return joint, joint[1] / np.maximum(joint.sum(0), 1e-300)

    def posterior(self) -> np.ndarray:
        z = self.b + self.votes @ self.accuracy
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(hits: list[np.ndarray], target: np.ndarray, size: int, rounds: int = 900, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression of soft targets on which entries a text has."""
    w, b = np.zeros(size), 0.0
    n = len(target)
    if not n:
        return w, -10.0
    flat_hits = np.concatenate([*hits, np.zeros(0, np.int32)])
    row = np.repeat(np.arange(n), [len(h) for h in hits])
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[flat_hits], n)
        d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(flat_hits, d[row], size) / n + decay * w, d.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.2 * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _score(model):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            hits = batch.column(2).values.to_numpy()
            total = np.concatenate([[0.0], np.cumsum(w[hits])])
            z = b + total[ends[1:]] - total[ends[:-1]]
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Labels are read only of ids that aren't held out; null ids and labels are
    ignored, of several labels of an id the largest counts. At most PER_LABEL
    texts of each label are fitted on. Null and empty texts score as texts
    without any lexicon entry; without labels of both kinds every score is 0;
    repeated rows score alike; other columns are not read; an empty table gives
    an empty result. Texts are read whole and never shuffled; lexicon (4096
    entries at most) and weights are broadcast.
    """
    spark = docs.sparkSession
    ids = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
    ids = ids.where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    u = F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(1 << 30))
    sizes = {r["_y"]: r["n"] for r in ids.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("_y") == y, float(PER_LABEL) / n * (1 << 30)).otherwise(share)
    chosen = durable(ids.where(u < share).orderBy("_y", u, "_id").limit(3 * PER_LABEL))  # the limit is above any likely draw
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    few = F.broadcast(chosen)  # 3 * PER_LABEL ids at most
    sample = rows.join(few, rows["doc_id"] == chosen["_id"]).select("_y", "text")
    total = sample.mapInArrow(tidied(_count_entries), "entry int, n0 long, n1 long").groupBy("entry").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    t0, t1 = float(min(sizes.get(0, 0), PER_LABEL)), float(min(sizes.get(1, 0), PER_LABEL))
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    odds = F.log(a / F.greatest(t1 - F.col("n1") + 1, F.lit(0.5))) - F.log(b / F.greatest(t0 - F.col("n0") + 1, F.lit(0.5)))
    z = odds / F.sqrt(1 / a + 1 / b)
    rate = (a / max(t1, 1.0)) / (a / max(t1, 1.0) + b / max(t0, 1.0))
    picked = total.where((F.col("n1") >= MIN_SUPPORT) & (z >= MIN_Z)).select("entry", (rate >= STRONG).alias("strong"), z.alias("z"))
    table = picked.orderBy(F.desc("z"), "entry").limit(MAX_ENTRIES).toArrow()
    order = np.argsort(np.array(table.column("entry").to_pylist(), np.int64))
    entries = np.array(table.column("entry").to_pylist(), np.int64)[order]
    strong = np.array(table.column("strong").to_pylist(), bool)[order]

    out = held_out(F.col("doc_id"))
    votes = rows.select("doc_id", out.alias("held_out"), "text").mapInArrow(
        _vote(spark.sparkContext.broadcast((entries, strong))), f"doc_id {kind}, held_out boolean, pattern int, hits array<int>"
    )
    votes = durable(votes)
    counts, labelled = np.zeros(1 << VOTERS), np.zeros((2, 1 << VOTERS))
    for r in votes.groupBy("pattern").agg(F.count("*").alias("n")).collect():  # at most 2**VOTERS rows
        counts[r["pattern"]] = r["n"]
    seen = votes.join(few, votes["doc_id"] == chosen["_id"]).dropDuplicates(["_id"]).select("_id", "_y", "pattern", "hits").orderBy("_id").collect()
    for r in seen:
        labelled[r["_y"], r["pattern"]] += 1
    if sizes.get(0) and sizes.get(1) and len(entries) and seen:
        # the sample holds both labels at different rates; weigh them as the labels do
        for y in (0, 1):
            labelled[y] *= sizes[y] / max(1.0, labelled[y].sum())
        post = LabelModel().fit(counts, labelled).posterior()
        model = fit_linear([np.array(r["hits"], np.int32) for r in seen], np.array([post[r["pattern"]] for r in seen]), len(entries))
    else:
        model = (np.zeros(max(1, len(entries))), -1e9)
    return votes.select("doc_id", "held_out", "hits").mapInArrow(tidied(_score(spark.sparkContext.broadcast(model))), f"doc_id {kind}, held_out boolean, score double, predicted int")
