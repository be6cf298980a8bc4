"""Operators on small tables: brute force, and nulls, empties, repeats, extra columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import contamination, graph, langid, licences, near, pieces, quality, repeats, shards, toxicity, urls
from palimpsest.llm.common import flat
from palimpsest.llm.queries import PIECE_MODEL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, h string, n string, held_out string, canon string"


def _words(r, lang, n):
    base = {"en": ["the", "of", "thing", "and", "with", "erness"], "de": ["der", "und", "ßkeit", "über", "nicht", "schaft"], "fr": ["le", "être", "çon", "eaux", "qui", "ment"]}[lang]
    return " ".join(r.choice(base) + (r.choice(base) if r.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(8)
    rows = []
    for i in range(120):
        lang = r.choice(["en", "de", "fr"])
        rows.append((i, _words(r, lang, r.randint(60, 200)), lang, "s"))
    passage = _words(r, "en", 90)
    for i in (3, 50, 77):
        rows[i] = (i, rows[i][1] + " " + passage + " " + rows[i][1][:50], rows[i][2], "s")
    for i in range(100, 110):  # copies with an edit each
        w = rows[5][1].split()
        w[(i * 7) % len(w)] = f"edit{i}"
        rows[i] = (i, " ".join(w), rows[5][2], "s")
    rows[110] = (110, rows[5][1], rows[5][2], "s")
    rows += [(200, None, None, None), (201, "", "en", "s"), (202, "  \n ", "en", "s"), (203, "Two words", "en", "s"), (204, "123 456", "en", "s"), (None, "orphan text of no id", None, None)]
    rows += [(205, "ab " * 4000, "en", "s")]
    rows += [rows[7], rows[7], (201, "", "en", "s")]
    return spark.createDataFrame([(*x, len(x[1] or ""), "k", "h", "n", "o", "c") for x in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _rows(df):
    return df.orderBy(*[c for c, t in df.dtypes if not t.startswith(("array", "map"))]).collect()


def test_quality(docs, empty):
    out = _rows(quality.judge(docs))
    assert len(out) == docs.count()
    texts = collections.defaultdict(list)
    for x in docs.collect():
        texts[x.doc_id].append(x.text or "")
    for x in out:
        n = {len(WORD.findall(t)) for t in texts[x.doc_id]}
        assert x.n_words in n
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
        assert not (x.base_failed and x.kept)
    assert sum(x.kept for x in out) > 100
    assert quality.judge(empty).count() == 0


def test_quality_rejects_noise_and_keeps_prose(spark, docs):
    r = random.Random(9)
    noise = [(900 + i, " ".join("".join(r.choice("qxzjkvw") for _ in range(8)) for _ in range(120)), "en") for i in range(5)]
    both = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(noise, "doc_id long, text string, lang string"))
    kept = {x.doc_id for x in quality.judge(both).where("kept").collect()}
    assert not kept & {900 + i for i in range(5)}


def test_quality_rejects_symbol_noise_and_tables_in_each_language(spark):
    r = random.Random(32)
    base = {
        "en": "the of thing and with house where people under river always morning because after window",
        "de": "der und über nicht schaft Haus wohnen Leute unter Fluss immer Morgen weil nach Fenster",
        "fr": "le être çon eaux qui maison où gens sous rivière toujours matin parce après fenêtre",
        "es": "el ser ción aguas que casa donde gente bajo río siempre mañana porque después ventana",
    }
    rows, junk = [], set()
    for lang, words in base.items():
        w = words.split()
        make = lambda n, w=w: [r.choice(w) + (r.choice(w) if r.random() < 0.3 else "") + (r.choice(".,") if r.random() < 0.1 else "") for _ in range(n)]
        rows += [(len(rows) + i, " ".join(make(r.randint(80, 250))), lang) for i in range(60)]
        for _ in range(3):
            noisy = " ".join(x + (r.choice("*#%&$") * 3 if r.random() < 0.25 else "") for x in make(200))
            table = "\n".join(" | ".join(make(4)) for _ in range(40))
            for t in (noisy, table):
                junk.add(len(rows))
                rows.append((len(rows), t, lang))
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert not [x.doc_id for x in out if x.kept and x.doc_id in junk]
    assert sum(x.kept for x in out) >= 0.97 * (len(rows) - len(junk))


def test_url_filter(spark):
    r = random.Random(10)
    hosts = ["a.net", "example.net", "x.example.net", "example.com", "www.example.com", "m.news.org", "org", "spam-farm.org", "b.spam-farm.org", "notexample.com"]
    rows = [(i, f"{r.choice(['http', 'https'])}://{r.choice(hosts)}{r.choice(['', '/', '/en/1', '/de/2.html', '/fr/3/', '/de/2?x=1', '/EN/1#f'])}", "h") for i in range(400)]
    rows += [(None, None, "h"), (500, "", "h"), (501, "no scheme", "h"), (502, "HTTP://Example.COM/de/", "h"), (503, "x://a.net?q/", "h"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    got = _rows(urls.filter_urls(pages, urls.spam_list(pages)))
    assert len(got) == len(rows)
    parts = {}
    for i, u, _ in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        parts[i] = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    canon = {i: re.sub(r"^(www|m|blog)\.", "", h) + re.sub(r"(\.html|/+)$", "", p) for i, (h, p) in parts.items()}
    listed = {canon[i] for i, (h, _) in parts.items() if "spam-farm" in h.split(".")}
    for x in got:
        h, p = parts[x.page_id]
        fit = [q for q in urls.RULES if (h == q.host or h.endswith("." + q.host)) and p.startswith(q.path)]
        best = max(fit, key=lambda q: len(q.text), default=None)
        assert (x.host, x.path, x.rule) == (h, p, best.text if best else None)
        assert x.verdict == (best.verdict if best else "block" if h and canon[x.page_id] in listed else "allow")
    assert urls.filter_urls(pages.limit(0), urls.spam_list(pages.limit(0))).count() == 0


def test_bloom_passes_every_listed_key(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), F.col("id")).alias("canon"))
    table = urls.bloom(keys, "canon", 16)
    probe = keys.select("*", F.pmod(F.xxhash64(F.lit(1), "canon"), F.lit(16)).alias("_block"), F.xxhash64(F.lit(2), "canon").alias("_b")).join(table, "_block")
    hit = F.lit(True)
    for k, m in enumerate(urls._bits("_b")):
        hit = hit & (F.col(f"w{k}").bitwiseAND(m) != 0)
    assert probe.where(hit).count() == 500
    assert urls.block_count(10**9) == urls.MAX_BLOCKS


def test_language(docs, empty):
    out = langid.identify(docs)
    rows = out.join(docs.select("doc_id", "lang", "text").dropDuplicates(["doc_id"]), "doc_id").collect()
    assert out.count() == docs.count()
    for x in rows:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1)
        assert 0 <= x.score <= 1
        if x.text is None or not re.search(r"[^\W\d_]", x.text):
            assert x.lang_pred == "und"
    good = [x.lang == x.lang_pred for x in rows if x.held_out and x.doc_id < 120]
    assert sum(good) / len(good) > 0.9
    assert langid.identify(empty).count() == 0
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {x.lang_pred for x in none.collect()} == {"und"}


def test_leaks(spark, docs, empty):
    text = docs.where("doc_id = 20").first().text
    items = [(1, text[30:180]), (2, re.sub("[a-z]", lambda m: m[0].upper(), text[30:180]).replace(" ", "\n ")), (3, None), (4, ""), (5, "short"), (6, "nothing like this is in any of the texts at all, surely")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = _rows(contamination.find_leaks(docs, bench))
    assert {(x.doc_id, x.item_id, x.edits) for x in got} == {(20, 1, 0), (20, 2, 0)}
    assert all(text.encode()[x.start_byte : x.end_byte].decode() == text[30:180].strip() for x in got)
    assert 20 not in {x.doc_id for x in contamination.without_leaks(docs, bench).collect()}
    assert contamination.without_leaks(docs, bench).count() == docs.count() - 1
    assert contamination.find_leaks(empty, bench).count() == 0
    assert contamination.find_leaks(docs, bench.limit(0)).count() == 0


def test_leaks_in_blocks(spark, docs, monkeypatch):
    texts = [x.text for x in docs.where("doc_id < 30").orderBy("doc_id").collect()]
    bench = spark.createDataFrame([(i, t[10:140]) for i, t in enumerate(texts)], "item_id long, text string")
    one = {tuple(x) for x in contamination.find_leaks(docs, bench).collect()}
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 1500)
    assert {tuple(x) for x in contamination.find_leaks(docs, bench).collect()} == one


def test_licences(spark, docs, empty):
    extra = spark.createDataFrame([(900, "Some words\nReleased under the MIT License.\nmore", "en"), (901, "All rights reserved.", "de"), (902, "We met the general public.", "en")], "doc_id long, text string, lang string")
    out = licences.scan(docs.select("doc_id", "text", "lang").unionByName(extra)).where("confirmed").collect()
    assert {(x.doc_id, x.line, x.family) for x in out} == {(900, 1, "mit"), (901, 0, "proprietary")}
    assert licences.scan(empty).count() == 0


def test_pieces_on_tables(spark, docs, empty):
    out = pieces.encode(docs, PIECE_MODEL)
    assert out.count() == docs.count()
    assert out.where("not round_trip").count() == 0
    assert out.where("n_ids <> size(ids)").count() == 0
    assert pieces.encode(empty, PIECE_MODEL).count() == 0
    back = pieces.decode(out, PIECE_MODEL).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id")
    assert back.where("decoded <> coalesce(text, '')").count() == 0


def _kneser_ney(texts):
    """The textbook model in plain Python: p(last byte | four before) of a gram."""
    order = quality.ORDER
    levels = {order: collections.Counter()}
    for t in texts:
        padded = bytes(order - 1) + t
        levels[order].update(padded[i : i + order] for i in range(len(t)))
    for n in range(order - 1, 0, -1):
        levels[n] = collections.Counter(g[1:] for g in levels[n + 1])
    found = {}

    def p(gram):
        if not gram:
            return 1 / 256
        if gram not in found:
            level = levels[len(gram)]
            often = collections.Counter(level.values())
            d = quality.discounts(*(float(often[k]) for k in (1, 2, 3, 4)))
            followers = {g: c for g, c in level.items() if g[:-1] == gram[:-1]}
            total = sum(followers.values())
            spare = sum(d[min(c, 3) - 1] for c in followers.values())
            c = level[gram]
            found[gram] = ((c - d[min(c, 3) - 1]) if c else 0) / total + spare / total * p(gram[1:])
        return found[gram]

    return p


def _quantile(values, share):
    bins = sorted(round(v / quality.BIN) for v in values)
    return bins[max(0, math.ceil(share * len(bins)) - 1)] * quality.BIN


@pytest.mark.parametrize("held", [16, 0])
def test_perplexity_verdict_equals_plain_python(spark, monkeypatch, held):
    monkeypatch.setattr(quality, "HELD", held)
    monkeypatch.setattr(quality, "SHARD", 200)  # several files
    monkeypatch.setattr(quality, "PENDING", 500)
    r = random.Random(8)
    word = lambda s: "".join(r.choice(s) for _ in range(r.randint(1, 7)))
    texts = [(i, " ".join(word("etaoin") for _ in range(r.randint(50, 70))), r.choice(["x", "y"])) for i in range(24)]
    texts += [(90, " ".join(word("#*$zqQ") for _ in range(60)), "x"), (91, "e " * 8, "y"), (92, "", "x"), (93, None, "y"), (94, " ".join(word("etaoiné") for _ in range(55)), None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    out = {x.doc_id: x for x in quality.judge(docs).collect()}
    p = _kneser_ney([(t or "").encode() for _, t, _ in texts])
    mean, spread = {}, {}
    for i, t, _ in texts:
        padded = bytes(quality.ORDER - 1) + (t or "").encode()
        logs = [-math.log(p(padded[k : k + quality.ORDER])) for k in range(len(padded) - quality.ORDER + 1)]
        mean[i] = sum(logs) / max(1, len(logs))
        spread[i] = math.sqrt(max(0, sum(x * x for x in logs) / max(1, len(logs)) - mean[i] ** 2))
        assert out[i].log_ppl == pytest.approx(mean[i], abs=1e-5) and out[i].spread == pytest.approx(spread[i], abs=1e-4)
    for lang in ("x", "y", "und"):
        own = [i for i, _, x in texts if (x or "und") == lang]
        fit = [i for i in own if not out[i].base_failed]
        q1, q3 = (_quantile([out[i].log_ppl for i in fit], x) for x in (0.25, 0.75))
        mid = _quantile([out[i].spread for i in fit], 0.5)
        dev = max(0.01, 1.4826 * _quantile([abs(out[i].spread - mid) for i in fit], 0.5))
        for i in own:
            wide = math.sqrt(1 + quality.SHORT / max(1, out[i].n_words))
            reach = quality.BAND * max(0.01, q3 - q1) * wide
            inside = q1 - reach <= out[i].log_ppl <= q3 + reach and out[i].spread <= mid + quality.SPREAD_BAND * dev * wide
            assert (out[i].low, out[i].high) == pytest.approx((q1 - reach, q3 + reach), abs=1e-6)
            assert out[i].kept == (not out[i].base_failed and inside)
    assert not out[90].kept and sum(x.kept for x in out.values()) > 15


def _brute_repeats(texts, span):
    count = collections.Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if count[t[i : i + span]] > 1:
                cover[i : i + span] = b"\1" * span
        kept = bytes(c for c, x in zip(t, cover, strict=True) if not x)
        spans = sum(1 for i, x in enumerate(cover) if x and (i == 0 or not cover[i - 1]))
        out.append((len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _brute_passages(texts, only_spans=False):
    """Runs of repeated PASSAGE-byte strings with PASSAGE_WORDS words: number and bytes, or places."""
    span = repeats.PASSAGE
    count = collections.Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        runs = repeats.merged([(i, i + span) for i in range(len(t) - span + 1) if count[t[i : i + span]] > 1])
        runs = [(a, b) for a, b in runs if len(re.findall(rb"[^\x20\x09-\x0D]+", t[a:b])) >= repeats.PASSAGE_WORDS]
        out.append(runs if only_spans else (len(runs), sum(b - a for a, b in runs)))
    return out


@pytest.mark.parametrize("hot", [10_000, 1])
def test_repeated_passages_shorter_than_a_span(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_RUNS", hot)
    r = random.Random(47)
    prose = lambda n: " ".join("".join(r.choice("etaoinsh") for _ in range(r.choice([2, 3, 4, 5, 9]))) for _ in range(n))
    mid, few = prose(55), "x" * 20 + prose(20) + "y" * 200  # 55 words are under SPAN bytes; few words stay
    assert repeats.PASSAGE < len(mid) < repeats.SPAN and len(few) > repeats.PASSAGE
    texts = [f"{prose(90)}. {mid}\n{prose(80)}" for _ in range(4)] + [f"{prose(60)} {few} {prose(9)}" for _ in range(2)]
    texts += [mid, mid, prose(60)[:300], few + "z" * 300, prose(300), "", f"{mid} {prose(40)} {mid}"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    raw = [t.encode() for t in texts]
    want = [(i, *x, *y) for i, (x, y) in enumerate(zip(_brute_repeats(raw, repeats.SPAN), _brute_passages(raw), strict=True))]
    assert sorted(map(tuple, repeats.remove_repeats(docs).collect())) == want
    assert all(x[5] for x in want[:4]) and not any(x[2] for x in want[:4])
    left = {x.doc_id: x.text for x in repeats.clean_documents(docs).collect()}
    for i, (t, runs) in enumerate(zip(raw, _brute_passages(raw, True), strict=True)):
        cover = repeats.merged(runs + [(j, j + repeats.SPAN) for j in range(len(t) - repeats.SPAN + 1) if sum(u.count(t[j : j + repeats.SPAN]) for u in raw) > 1])
        kept = bytes(c for j, c in enumerate(t) if not any(a <= j < b for a, b in cover))
        assert left[i] == kept.decode()


@pytest.mark.parametrize("hot", [10_000, 1])
def test_repeats(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_RUNS", hot)
    source = docs.collect()
    want = collections.Counter((x.doc_id, *y) for x, y in zip(source, _brute_repeats([(x.text or "").encode() for x in source], repeats.SPAN), strict=True))
    result = repeats.remove_repeats(docs).collect()
    assert collections.Counter(tuple(x)[:5] for x in result) == want
    passages = collections.Counter((x.doc_id, *y) for x, y in zip(source, _brute_passages([(x.text or "").encode() for x in source]), strict=True))
    assert collections.Counter((x.doc_id, x.n_passages, x.passage_bytes) for x in result) == passages
    if hot == 1:
        assert repeats.remove_repeats(empty).count() == 0
        clean = repeats.clean_documents(docs)
        assert clean.columns == docs.columns
        assert clean.count() == docs.count()


@pytest.mark.parametrize("hot", [10_000, 1])
def test_repeats_far_apart_in_one_text(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_RUNS", hot)
    r = random.Random(31)
    alone = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    x, y, line = alone(450), alone(400), alone(368) + "\n"
    texts = [alone(500) + x + alone(900) + x, y + alone(400) + y, alone(100) + line * 5 + alone(100), "".join(alone(400) + line for _ in range(5)), alone(2000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = sorted(tuple(x)[:5] for x in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    want = [(i, *x) for i, x in enumerate(_brute_repeats([t.encode() for t in texts], repeats.SPAN))]
    assert got == want
    assert [x[2] > 0 for x in got] == [True, True, True, False, False]
    clean = {x.doc_id: x.text for x in repeats.clean_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert x not in clean[0] and y not in clean[1] and clean[4] == texts[4]


@pytest.mark.parametrize("strings", [1 << 19, 60])
def test_repeats_of_hot_hashes_are_moved_by_run_not_by_string(spark, monkeypatch, strings):
    monkeypatch.setattr(repeats, "HOT_RUNS", 2)
    monkeypatch.setattr(repeats, "PART_STRINGS", strings, raising=False)
    r = random.Random(53)
    prose = lambda n: " ".join("".join(r.choice("etaoinsh") for _ in range(r.choice([2, 3, 5, 9]))) for _ in range(n))
    notice, long = prose(60), prose(140)
    texts = [f"{prose(60)} {notice} {prose(r.randint(1, 90))}" for _ in range(9)] + [f"{prose(70)} {long}{prose(40)}" for _ in range(9)] + [f"{long} {prose(9)} {long}", prose(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = repeats.repeated_intervals(docs)[0].collect()
    if strings > 60:  # small parts cut intervals up
        assert 0 < len(found) < 1000  # 19 texts of some hundreds of repeated strings each
    raw = [t.encode() for t in texts]
    want = [(i, *x, *y) for i, (x, y) in enumerate(zip(_brute_repeats(raw, repeats.SPAN), _brute_passages(raw), strict=True))]
    assert sorted(map(tuple, repeats.remove_repeats(docs).collect())) == want
    assert all(x[2] for x in want[9:19]) and all(x[5] for x in want[:19])


def _brute_near(rows):
    sets = []
    for t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)] if w else []))
    links = collections.defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            c = len(a & sets[j])
            if a and 100 * c >= 70 * (len(a) + len(sets[j]) - c):
                links[i].add(j)
                links[j].add(i)
    return sets, links


@pytest.mark.parametrize("tile", [1024, 3])
def test_near_duplicates(docs, empty, monkeypatch, tile):
    monkeypatch.setattr(near, "TILE", tile)
    source = docs.collect()
    sets, links = _brute_near([x.text for x in source])
    root = list(range(len(source)))
    for _ in source:
        for i in links:
            for j in links[i]:
                root[i] = root[j] = min(root[i], root[j])
    least = collections.defaultdict(list)
    for i, x in enumerate(source):
        if x.doc_id is not None:
            least[root[i]].append(x.doc_id)
    want = collections.Counter((x.doc_id, len(sets[i]), len(links[i]), min(least[root[i]], default=None)) for i, x in enumerate(source))
    got = collections.Counter(tuple(x)[:4] for x in near.near_duplicates(docs).collect())
    assert got == want
    if tile == 3:
        assert near.near_duplicates(empty).count() == 0


def test_components(spark):
    r = random.Random(11)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert got == {n: x for n, x in root.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_toxicity(spark, docs, empty):
    r = random.Random(12)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = _words(r, r.choice(["en", "de", "fr"]), r.randint(30, 120)).split()
        for _ in range(3 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["vilewort", "nastig,", "scumbly", "vilething"]))
        rows.append((1000 + i, " ".join(w)))
        labels.append((1000 + i, int(bad)))
    rows += [(None, "no id"), (5000, None), (5001, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (1001, None)], "doc_id long, toxic int")
    out = {x.doc_id: x for x in toxicity.score(table, marks).collect()}
    assert len(out) == len(rows)
    held = [(out[i].predicted, y) for i, y in labels if out[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in out.values())
    assert out[5001].predicted == 0
    assert toxicity.score(empty, marks).count() == 0
    assert max(x.score for x in toxicity.score(table, marks.limit(0)).collect()) < 1e-9


def test_shards(docs, empty):
    n = 7
    out = shards.shard_documents(docs, [1.0] * n).collect()
    assert len(out) == docs.count()
    source = collections.Counter((x.doc_id, len((x.text or "").encode()) + 16, zlib.crc32((x.text or "").encode())) for x in docs.collect())
    assert collections.Counter((x.doc_id, x["size"], x.text_crc32) for x in out) == source
    slots = collections.defaultdict(list)
    for x in out:
        key = "" if x.doc_id is None else str(x.doc_id)
        draw = lambda k: [(hashlib.md5(f"{key}#{s}".encode()).hexdigest()[:13], -s) for s in range(k)]
        assert x.shard == -max(draw(n))[1]
        assert x.grown_shard == -max(draw(n + 1))[1]
        assert x.grown_shard in (x.shard, n)
        slots[x.shard].append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.shard_documents(empty, [1.0] * 3).count() == 0


def test_weighted_shards(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    by = {x.shard: x["count"] for x in shards.shard_documents(ids, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert 0.22 < by[0] / 4000 < 0.28
    with pytest.raises(ValueError):
        shards.shard_documents(ids, [1.0, 0.0])


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    text = docs.where("doc_id = 20").first().text
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text[20:180])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "sentencepiece_ids"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [now.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/out{k}"
        stage(spark, now, str(tmp_path)).write.parquet(out)
        before, now = now, spark.read.parquet(out)
        sizes.append(now.count())
        if k < 4:
            assert now.columns == before.columns
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] == sizes[4] + 1 == sizes[5] + 1
    ids = {x.doc_id for x in now.collect()}
    assert 20 not in ids and not ids & set(range(100, 111)) and 200 not in ids
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids


def test_pipeline_stages_decide_by_row(spark, docs, tmp_path):
    """Empty tables, clashing columns, null and repeated ids, repeated rows, and a null in every column."""
    import corpus_pipeline

    text, other = (docs.where(f"doc_id = {i}").first().text for i in (20, 21))
    spark.createDataFrame([(1, other[20:180]), (2, None), (3, ""), (4, "a")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kind = "doc_id long, text string, lang string, source string, n_chars long, __row0 string, _kept string, kept boolean, _bad long, component_id long, k1 long"
    more = ("x", "y", True, 5, 6, 7)
    rows = [(None, text, "en", "s", 1, *more), (None, "", None, None, None, None, None, None, None, None, None), (7, None, None, None, None, None, None, None, None, None, None)]
    rows += [(8, text[:200] + " another end", "en", "s", 1, *more), (8, other, "en", "s", 1, *more)] + [(9, other + " " + text, "en", "s", 1, *more)] * 2
    rows += [(100 + i, x.text, x.lang, "s", 1, *more) for i, x in enumerate(docs.where("doc_id between 22 and 60").collect())]
    table, empty = spark.createDataFrame(rows, kind).repartition(2), spark.createDataFrame([], kind)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, empty, str(tmp_path))
        assert none.count() == 0
        if name != "sentencepiece_ids":
            assert none.columns == table.columns
    out = [tuple(x) for x in corpus_pipeline.quality_stage(spark, table, str(tmp_path)).collect()]
    assert {x[0] for x in out} >= {None, 9} and (8, other, "en", "s", 1, *more) in out and not [x for x in out if not x[1]]
    near_ = corpus_pipeline.near_copy_stage(spark, table, str(tmp_path)).collect()
    assert len([x for x in near_ if x.doc_id == 9]) == 1 and len([x for x in near_ if not x.text]) == 2
    copies = spark.createDataFrame([(None, text, "en", "s", 1, *more), (30, text, "en", "s", 1, *more), (30, text, "fr", "s", 1, *more), (31, text + " end", "en", "s", 1, *more), (None, other, "en", "s", 1, *more)], kind)
    kept = corpus_pipeline.near_copy_stage(spark, copies, str(tmp_path)).collect()
    assert sorted((x.doc_id is None, x.doc_id, x.text == other) for x in kept) == [(False, 30, False), (True, None, True)]
    clean = corpus_pipeline.repeat_stage(spark, table, str(tmp_path))
    assert clean.count() == len(rows) and clean.where("text is null").count() == 1
    safe = corpus_pipeline.leak_stage(spark, table, str(tmp_path)).collect()
    assert len(safe) == len(rows) - 3 and len([x for x in safe if x.doc_id == 8]) == 1
    assert corpus_pipeline.token_stage(spark, table, str(tmp_path)).where("round_trip").count() == len(rows)


def test_language_scores_equal_a_plain_forward_pass(docs):
    """Windows, filters, pooling and softmax one at a time."""
    langs, net = langid.train(docs)
    out = {(x.doc_id, x.lang_pred): x.score for x in langid.identify(docs).collect()}
    for row in docs.where("doc_id < 12 or doc_id = 205").collect():
        raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), row.text.encode())
        total = np.zeros(len(langs))
        for at in range(0, len(raw), langid.WINDOW):
            window = raw[at : at + langid.WINDOW]
            padded = window + bytes(langid.WINDOW - len(window) + max(langid.WIDTHS))
            hidden = []
            for i, width in enumerate(langid.WIDTHS):
                for f in range(i * langid.FILTERS, (i + 1) * langid.FILTERS):
                    w = net.filt[: width * langid.DIM, f].reshape(width, langid.DIM)
                    each = sum(net.embed[list(padded[k : k + langid.WINDOW])] @ w[k] for k in range(width))
                    hidden.append(max(0.0, float(each.max()) + net.bias[f]))
            z = np.array(hidden) @ net.dense + net.base
            p = np.exp(z - z.max())
            total += p / p.sum() * len(window)
        best = int(total.argmax())
        assert out[row.doc_id, langs[best]] == pytest.approx(total[best] / total.sum(), abs=1e-3)


def test_licence_lines_equal_a_plain_scan():
    """Lines one at a time: weights added up, softmax, threshold, and templates by a plain common subsequence."""
    net = licences.train([f"plain line number {i} about rivers and hills".encode() for i in range(300)])
    lines = [t for f in licences.TEMPLATES.values() for t in f] + ["The general assembly met on Monday.", "", "rivers and hills", "Licensed under nothing at all"]
    lines += [" ".join(x.split()[:-2]).upper() for x in lines[:6]]
    texts = [None, "", "\n".join(lines), lines[0] + "\n" + lines[0]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    got = [r for b in licences._scan(types.SimpleNamespace(value=net))(iter([batch])) for r in b.to_pylist()]
    want = []
    for doc, text in enumerate(texts):
        at = 0
        for nth, line in enumerate((text or "").split("\n")):
            slot, _ = licences._grams_of_lines([line.encode()])
            if len(slot):
                z = [sum(float(net.weights[x, k]) for x in slot) / len(slot) ** 0.5 + float(net.bias[k]) for k in range(len(net.families))]
                e = [math.exp((x - max(z)) / net.temperature) for x in z]
                p = [x / sum(e) for x in e]
                k = max(range(len(p)), key=p.__getitem__)
                if k and p[k] >= net.least:
                    words = licences.template_words(line)
                    want.append((doc, nth, at, at + len(line.encode()), net.families[k], p[k], max(_common(words, licences.template_words(t)) for t in licences.TEMPLATES[net.families[k]])))
            at += len(line.encode()) + 1
    assert [(r["doc_id"], r["line"], r["start_byte"], r["end_byte"], r["family"]) for r in got] == [x[:5] for x in want]
    for r, x in zip(got, want, strict=True):
        assert r["probability"] == pytest.approx(x[5], abs=1e-4) and r["similarity"] == pytest.approx(x[6])
        assert r["confirmed"] == (x[6] >= licences.CLOSE)
    assert sum(r["confirmed"] for r in got) >= len(licences.TEMPLATES)


def _common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1] / len(b) if b else 0.0


def test_label_model_posterior_equals_enumeration():
    r = np.random.default_rng(4)
    counts = r.integers(0, 50, 1 << toxicity.VOTERS).astype(float)
    labelled = r.integers(0, 3, (2, 1 << toxicity.VOTERS)).astype(float)
    model = toxicity.LabelModel().fit(counts, labelled, rounds=20)
    post = model.posterior()
    i, j = np.triu_indices(toxicity.VOTERS, 1)
    for state in r.integers(0, 1 << toxicity.VOTERS, 60):
        v = [(int(state) >> k) & 1 for k in range(toxicity.VOTERS)]
        base = sum(x * y for x, y in zip(v, model.rate, strict=True)) + sum(v[a] * v[b] * c for a, b, c in zip(i, j, model.correlation, strict=True))
        one, none = math.exp(base + model.b + sum(x * y for x, y in zip(v, model.accuracy, strict=True))), math.exp(base)
        assert post[state] == pytest.approx(one / (one + none), rel=1e-6, abs=1e-12)


def test_votes_of_many_texts_equal_those_of_each():
    r = random.Random(6)
    texts = ["", "VILEWORT vilething, vilely nasty", "### $$ !! a", "QUITE LOUD"] + [" ".join(r.choice(["vilewort", "nastig", "plain", "words", "Of"]) for _ in range(r.randint(1, 40))) for _ in range(40)]
    data, off = flat(pa.array(texts))
    entries = np.unique(toxicity.entries_of(*flat(pa.array(["vilewort nastig vilething"])))[0])
    lex = toxicity.Lexicon(entries[entries >= 0], np.array(r.choices([True, False], k=int((entries >= 0).sum()))))
    pattern, hits = toxicity.votes_of(lex, data, off)
    for k, t in enumerate(texts):
        one, own = toxicity.votes_of(lex, *flat(pa.array([t])))
        assert one[0] == pattern[k] and own[0].tolist() == hits[k].tolist()
        chars = max(1, len(t.encode()))
        assert bool(pattern[k] >> 10 & 1) == (20 * sum(c in "#*$%&|<>!@" for c in t) >= chars)
        assert bool(pattern[k] >> 11 & 1) == (2 * sum("A" <= c <= "Z" for c in t) >= chars)


def test_very_long_texts(spark, docs):
    """Texts beyond a chunk, on one line and in one word, through all ten operators."""
    r = random.Random(3)
    tail = _words(r, "en", 90)
    long = _words(r, "en", 170_000) + " " + tail
    word = "".join(r.choice("etaoin") for _ in range(1_200_000))
    assert min(len(long), len(word)) > 1 << 20
    more = [(901, long), (902, _words(r, "de", 60) + " " + tail), (903, word), (904, word[:600_000] + "z" + word[600_000:])]
    rows = docs.where("doc_id < 40").select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(i, t, "en") for i, t in more], "doc_id long, text string, lang string")).repartition(2)
    ruled = {x.doc_id: x for x in quality.judge(rows).collect()}
    assert (ruled[901].n_words, ruled[903].n_words, ruled[903].word_chars) == (len(long.split()), 1, len(word))
    assert {x.doc_id: x.lang_pred for x in langid.identify(rows).collect()}[901] == "en"
    found = contamination.find_leaks(rows, spark.createDataFrame([(1, tail[5:300])], "item_id long, text string")).collect()
    assert {(x.doc_id, x.edits) for x in found} == {(901, 0), (902, 0)} and max(x.end_byte for x in found) > len(long) - 500
    assert licences.scan(rows).where("doc_id = 903").count() == 0
    coded = {x.doc_id: x for x in pieces.encode(rows, PIECE_MODEL).where("doc_id > 900").collect()}
    assert all(x.round_trip for x in coded.values()) and coded[903].n_ids > 100_000
    cut = {x.doc_id: x for x in repeats.remove_repeats(rows).collect()}
    assert cut[903].n_removed == len(word) and cut[904].n_removed == len(word) and cut[904].n_spans == 2
    assert cut[901].n_removed >= len(tail) - 5 and cut[902].n_removed >= len(tail)
    same = {x.doc_id: x for x in near.near_duplicates(rows).collect()}
    assert same[901].n_similar == same[903].n_similar == 0 and same[903].n_shingles == 1
    scores = {x.doc_id: x.score for x in toxicity.score(rows, spark.createDataFrame([(1, 0), (2, 1), (3, 0), (5, 1)], "doc_id long, toxic int")).collect()}
    assert set(scores) >= {901, 902, 903, 904}
    assert {x.doc_id: x["size"] for x in shards.shard_documents(rows, [1.0] * 5).collect()}[903] == len(word) + 16
