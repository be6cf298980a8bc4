"""Operator 1, quality rules: base word rules and N-gram perplexity bands.

The model is a modified Kneser-Ney model of order five over the bytes of all
texts, case and all. Spark counts the 5-grams, counts continuations of shorter
ones, and joins the orders; the probabilities lie in files of sorted key arrays
in the shared folder, as many as the corpus has different 5-grams. A worker
looks up the different grams of a block of texts in one file after the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACE, chunks, durable, flat, mix, per_row, prefix_hash, range_hash, shared_folder, shingles, tidied, words_of

ORDER = 5
#: 5-grams in one file of the model.
SHARD = 1 << 20
#: Files that a task keeps in memory (12 bytes a gram); others are read again for each block.
HELD = 16
#: Bytes of texts whose grams are looked up together.
BLOCK = 4 << 20
#: Different grams that a task counts before it passes them on.
PENDING = 1 << 20
MIN_WORDS = 50
#: Bands: this many interquartile ranges beyond the quartiles of log perplexity.
BAND = 3.0
#: Short texts scatter more: bands are wider by sqrt(1 + SHORT / n_words).
SHORT = 60.0
#: Junk mixed into prose can leave the mean as it is but not the spread of a text's
#: log probabilities, which may exceed the median by this many deviations (MAD, scaled).
SPREAD_BAND = 4.0


def keys_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The packed 5-gram that ends at each byte; zeros before a text."""
    key = data.astype(np.int64)
    for k in range(1, ORDER):
        key[k:] |= data[:-k].astype(np.int64) << (8 * k)
    rows = np.flatnonzero(np.diff(off) > 0)
    for k in range(1, ORDER):  # keep only bytes of the same text
        at = off[rows] + k - 1
        at = at[at < off[rows + 1]]
        key[at] &= (1 << (8 * k)) - 1
    return key


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(count, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = base = 0
    for batch in batches:
        data, off = flat(batch.column(0))
        for _, _, d, o in chunks(data, off):
            if len(d):
                k, n = np.unique(keys_of(d, o), return_counts=True)
                keys.append(k)
                counts.append(n)
                held += len(k)
            if held > 2 * base + PENDING // 2:  # merge as often as the sum doubles
                k, n = _summed(keys, counts)
                keys, counts, held = [k], [n], len(k)
                base = held
                if held > PENDING:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])
                    keys, counts, held, base = [], [], 0, 0
    if keys:
        k, n = _summed(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])


def count_grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, n) of all 5-grams over all texts, summed up by each task before they move."""
    partial = docs.select(F.col(text).alias("text")).mapInArrow(tidied(_count), "key long, n long")
    return partial.groupBy("key").agg(F.sum("n").alias("n"))


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """D1, D2 and D3+ of modified Kneser-Ney from the counts of counts."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9
    return tuple(min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.95, 2.95), strict=True))


def kneser_ney(grams: DataFrame) -> tuple[DataFrame, int]:
    """(key, p) of every counted 5-gram: p(last byte | four before), and their number.

    Lower orders use continuation counts; the unigram is mixed with a uniform
    one. A context has at most 256 followers, so no group is large.
    """
    levels = {ORDER: grams.select("key", F.col("n").alias("c"))}
    for n in range(ORDER - 1, 0, -1):  # different bytes before each shorter gram
        shorter = F.col("key").bitwiseAND((1 << 8 * n) - 1)
        levels[n] = durable(levels[n + 1].groupBy(shorter.alias("key")).agg(F.count("*").alias("c")))
    seen = None
    for n, level in levels.items():
        part = level.groupBy(F.least("c", F.lit(5)).alias("c")).agg(F.count("*").alias("m")).select(F.lit(n).alias("level"), "c", "m")
        seen = part if seen is None else seen.unionByName(part)
    often = {(r.level, r.c): r.m for r in seen.collect()}  # 25 rows at most
    p = None
    for n in range(1, ORDER + 1):
        d = discounts(*(float(often.get((n, k), 0)) for k in (1, 2, 3, 4)))
        take = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = Window.partitionBy("_ctx")
        level = levels[n].select("key", "c", take.alias("_d"), F.shiftright("key", 8).alias("_ctx"))
        level = level.select("key", "_d", "c", F.sum("c").over(context).alias("_total"), F.sum("_d").over(context).alias("_spare"))
        if p is None:
            lower = level.withColumn("_p", F.lit(1 / 256))
        else:
            lower = level.withColumn("_low", F.col("key").bitwiseAND((1 << 8 * (n - 1)) - 1)).join(p.select(F.col("key").alias("_low"), F.col("p").alias("_p")), "_low")
        p = lower.select("key", ((F.col("c") - F.col("_d")) / F.col("_total") + F.col("_spare") / F.col("_total") * F.col("_p")).alias("p"))
    return p, sum(m for (n, _), m in often.items() if n == ORDER)


def store_model(grams: DataFrame) -> list[str]:
    """Files of the model's sorted arrays (key, log p), each with its own range of keys."""
    p, size = kneser_ney(grams)
    folder = f"{shared_folder(grams.sparkSession)}/grams-{uuid.uuid4().hex}"
    shards = p.select("key", F.log("p").cast("float").alias("logp")).repartitionByRange(max(1, -(-size // SHARD)), "key").sortWithinPartitions("key")
    shards.write.option("compression", "lz4").parquet(folder)
    return sorted(grams.sparkSession.read.parquet(folder).inputFiles()) if size else []


class GramFiles:
    """Sorted arrays of the model, read by file and kept while there is room."""

    def __init__(self, files: list[str]) -> None:
        self.files = files
        self.held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def _arrays(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        if name not in self.held:
            system, path = pa.fs.FileSystem.from_uri(name)
            table = pq.read_table(path, filesystem=system)
            arrays = np.asarray(table.column("key").combine_chunks()), np.asarray(table.column("logp").combine_chunks())
            if len(self.held) >= HELD:
                return arrays
            self.held[name] = arrays
        return self.held[name]

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log p of sorted different keys, all of which were counted."""
        out = np.zeros(len(keys), np.float32)
        for name in self.files:
            have, logp = self._arrays(name)
            if not len(have):
                continue
            i, j = np.searchsorted(keys, have[0]), np.searchsorted(keys, have[-1], side="right")
            out[i:j] = logp[np.searchsorted(have, keys[i:j])]
        return out


def base_rules(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(off) - 1
    starts, ends, rows = words_of(data, off)
    cont = (data & 0xC0) == 0x80
    chars = per_row((~SPACE[data] & ~cont).astype(np.int8), off)
    symbols = per_row(_SYMBOL[data].astype(np.int8), off)
    h = prefix_hash(data)
    # lines: a text ends its last line
    cut = np.flatnonzero(data == 0x0A)
    lo = np.sort(np.concatenate([off[:-1], cut + 1]))
    hi = np.sort(np.concatenate([cut, off[1:]]))
    counts = per_row((data == 0x0A).astype(np.int8), off) + 1
    line_row = np.repeat(np.arange(n), counts)
    visible = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=visible[1:])
    real = visible[hi] > visible[lo]
    lo, hi, line_row = lo[real], hi[real], line_row[real]
    key = range_hash(h, lo, hi) + mix(line_row.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[1:] = key[order][1:] == key[order][:-1]
    dup = np.bincount(line_row[order[again]], minlength=n)
    # words in 3-word windows that occur twice or more
    g, grow, first = shingles(range_hash(h, starts, ends), rows, n)
    key = g + mix(grow.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(starts) + 3, bool)
    at = first[twice]
    for k in range(3):
        covered[at + k] = True
    repeat = np.bincount(rows, covered[: len(rows)], n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)
    return {
        "n_words": np.bincount(rows, minlength=n).astype(np.int64),
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup.astype(np.int64),
        "n_repeat_words": repeat,
    }


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def mean_and_spread(model: GramFiles, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of -log p of each text's bytes; 0 for empty texts."""
    mean, spread = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
    for i, j, block, b_off in chunks(data, off, BLOCK):
        parts = []
        for x, y, d, o in chunks(block, b_off):
            if len(d):
                k, back = np.unique(keys_of(d, o), return_inverse=True)
                parts.append((i + x, i + y, o, k, back.astype(np.int32)))
        if not parts:
            continue
        keys = np.unique(np.concatenate([p[3] for p in parts]))
        logs = model.logs(keys)
        for x, y, o, k, back in parts:
            log = logs[np.searchsorted(keys, k)][back].astype(np.float64)
            n = np.maximum(1, np.diff(o))
            mean[x:y] = -per_row(log, o) / n
            spread[x:y] = np.sqrt(np.maximum(0, per_row(log * log, o) / n - mean[x:y] ** 2))
        del parts
    return mean, spread


def _score(files: list[str]):  # noqa: ANN202
    """Batches of (doc_id, lang, text) to base rules, mean and spread of log perplexity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = GramFiles(files)  # of this task: a worker that lives on for other stages holds nothing
        for batch in batches:
            data, off = flat(batch.column(2))
            parts = [base_rules(d, o) for _, _, d, o in chunks(data, off)]
            if parts:
                scores = mean_and_spread(model, data, off)
                cols = [pa.array(np.concatenate([p[m] for p in parts])) for m in METRICS] + [pa.array(x) for x in scores]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "lang", *METRICS, "log_ppl", "spread"])

    return run


#: Quantiles are read off histograms with bins this wide.
BIN = 0.001


def quantiles(rows: DataFrame, by: str, value: Column, at: dict[str, float]) -> DataFrame:
    """Quantiles of ``value`` for each ``by``: the least bin with that share of the rows up to it.

    Counted in bins of BIN, so that the result depends on the rows alone, and
    the bins (of logarithms of probabilities, some 30,000 at most) are few.
    """
    bins = rows.groupBy(by, F.round(value / BIN).cast("long").alias("_bin")).agg(F.count("*").alias("_m"))
    upto = Window.partitionBy(by).orderBy("_bin")
    bins = bins.withColumns({"_upto": F.sum("_m").over(upto), "_all": F.sum("_m").over(Window.partitionBy(by))})
    return bins.groupBy(by).agg(*(F.min(F.when(F.col("_upto") >= share * F.col("_all"), F.col("_bin") * BIN)).alias(name) for name, share in at.items()))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Base rules and perplexity verdict of every row of ``docs``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, log_ppl, low, high, spread, spread_high. Null and empty texts have no words and
    fail the base rules; null languages share the bands of ``und``; repeated
    rows are judged alike; other columns are not read; an empty table gives an
    empty result. Very long texts are read whole.

    A language's bands come from the quartiles of log perplexity of its texts
    that pass the base rules: BAND interquartile ranges (more for short texts)
    below the lower and above the upper quartile. The standard deviation of a text's
    log probabilities has an upper limit from the median and the median deviation,
    which junk cannot move far unless most of a language is junk. The model's files are named after this run and left in
    the shared folder for the plan that reads them.
    """
    files = store_model(durable(count_grams(docs, text)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, lang string, " + ", ".join(f"{m} long" for m in METRICS) + ", log_ppl double, spread double"
    scored = durable(rows.mapInArrow(tidied(_score(files)), schema))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fit = scored.where(~failed)
    q = quantiles(fit, "lang", F.col("log_ppl"), {"_q1": 0.25, "_q3": 0.75}).join(quantiles(fit, "lang", F.col("spread"), {"_mid": 0.5}), "lang")
    q = durable(q)  # a row for each language
    away = quantiles(fit.join(q.select("lang", "_mid"), "lang"), "lang", F.abs(F.col("spread") - F.col("_mid")), {"_away": 0.5})
    bands = q.join(away, "lang").withColumns({"_w": F.greatest(F.col("_q3") - F.col("_q1"), F.lit(0.01)), "_dev": F.greatest(1.4826 * F.col("_away"), F.lit(0.01))})
    wider = F.sqrt(1 + SHORT / F.greatest(F.col("n_words"), F.lit(1)))
    reach = BAND * F.col("_w") * wider
    out = scored.join(bands, "lang", "left").withColumn("base_failed", failed)
    out = out.withColumns({"low": F.col("_q1") - reach, "high": F.col("_q3") + reach, "spread_high": F.col("_mid") + SPREAD_BAND * F.col("_dev") * wider})
    inside = F.col("log_ppl").between(F.col("low"), F.col("high")) & (F.col("spread") <= F.col("spread_high"))
    return out.select(
        "doc_id", *METRICS, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), "log_ppl", "low", "high", "spread", "spread_high",
    )
