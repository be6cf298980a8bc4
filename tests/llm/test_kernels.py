"""The numpy kernels against plain Python on random and awkward inputs."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import contamination, langid, licences, near, quality, repeats, suffix, toxicity
from palimpsest.llm.common import chunks, flat

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = ["", " ", "\n\n", "a", "ab cd", "a b a b a b", "x\nx\r\nx\ny", "é b é b é b ", "Ünï cödé", "a" * 900, "#*$ %&| <>", "\x00a\x00", None]


def _flat(texts):
    return flat(pa.array(texts, pa.string()))


def _random_texts(n, seed):
    r = random.Random(seed)
    vocabulary = ["the", "of", "é", "und", "A,", "b.", "#", "xx"]
    return ["".join(r.choice(vocabulary) + r.choice([" ", "  ", "\n", "\t"]) for _ in range(r.randint(0, 40))) for _ in range(n)]


def _base(text):
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = [False] * len(w)
    for i in range(len(w) - 2):
        if c[w[i], w[i + 1], w[i + 2]] > 1:
            covered[i : i + 3] = [True] * 3
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), dup, sum(covered)


def test_base_rules():
    texts = AWKWARD + _random_texts(300, 1)
    data, off = _flat(texts)
    got = []
    for _, _, d, o in chunks(data, off, 200):
        r = quality.base_rules(d, o)
        got += list(zip(*[r[m].tolist() for m in quality.METRICS], strict=True))
    assert got == [_base(t or "") for t in texts]


def test_gram_keys_see_no_other_text():
    texts = ["", "a", "bc", "", "defgh", "i"]
    data, off = _flat(texts)
    alone = [quality.keys_of(*_flat([t])).tolist() for t in texts]
    assert quality.keys_of(data, off).tolist() == [k for x in alone for k in x]


def test_suffix_array_and_common_prefixes():
    r = random.Random(3)
    for _ in range(150):
        letters = r.choice([b"ab", b"abc", b"a", bytes(range(97, 123)), b"\x00a\xf4"])
        pieces = [bytes(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 5))]
        pieces += [pieces[0] + pieces[-1]] * r.randint(0, 1)
        s, _ = suffix.join_pieces(pieces)
        b = s.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        sa = suffix.suffix_array(s)
        assert sa.tolist() == want
        lcp = suffix.permuted_lcp(s, sa)
        for i, j in zip(want[1:], want, strict=False):
            k = 0
            while i + k < len(b) and j + k < len(b) and b[i + k] == b[j + k]:
                k += 1
            assert lcp[i] == k
        span = r.randint(1, 6)
        count = collections.Counter(p[i : i + span] for p in pieces for i in range(len(p) - span + 1))
        for p, got in zip(pieces, suffix.repeated_starts(pieces, [span])[0], strict=True):
            assert got.tolist() == [i for i in range(len(p) - span + 1) if count[p[i : i + span]] > 1]
        own = [r.randint(0, len(p)) for p in pieces]
        spans = [span, span + 2]
        for width, found in zip(spans, suffix.repeated_starts(pieces, spans, own), strict=True):
            count = collections.Counter(p[i : i + width] for p, n in zip(pieces, own, strict=True) for i in range(min(n, len(p) - width + 1)))
            for p, n, got in zip(pieces, own, found, strict=True):
                assert got.tolist() == [i for i in range(min(n, len(p) - width + 1)) if count[p[i : i + width]] > 1]


def test_suffix_array_of_a_large_shard_of_prose_with_near_copies():
    r = random.Random(17)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.choice([1, 2, 3, 5, 7, 8, 15]))) for _ in range(300)]
    pieces = [" ".join(r.choice(words) for _ in range(r.randint(40, 160))).encode() for _ in range(700)]
    for i in range(400):  # copies with one word changed, and runs of exactly 8 and 16 symbols
        p = bytearray(pieces[i])
        at = r.randrange(len(p))
        p[at : at + 3] = b"xyz"
        pieces.append(bytes(p) + r.choice([b"abababab", b"abcdefghabcdefgh", b""]))
    s, _ = suffix.join_pieces(pieces)
    assert len(s) > 500_000
    sa = suffix.suffix_array(s)
    assert np.array_equal(np.sort(sa), np.arange(len(s)))
    b = s.tobytes()
    assert all(b[i : i + 4000] < b[j : j + 4000] or b[i:] < b[j:] for i, j in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True))


def test_runs_without_a_repeated_string_are_not_sorted():
    r = random.Random(29)
    alone = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    gram, block, mid = alone(60), alone(600), alone(250)
    texts = [alone(300) + gram + alone(300) for _ in range(30)] + [alone(200) + block + alone(r.randint(0, 200)) for _ in range(5)]
    texts += [alone(r.randint(0, 90)) + mid + alone(r.randint(0, 90)) for _ in range(4)] + [alone(9) + mid + alone(700) + mid, "ab" * 400, block + "of " * 300]
    raw = [t.encode() for t in texts]
    run = repeats.runs_of(*_flat(texts))
    held = [
        (i, 0, p0, p1 - p0 + 1, raw[i][p0:p2], h)
        for i, p0, p1, p2, h in zip(run["row"].tolist(), run["p0"].tolist(), run["p1"].tolist(), run["p2"].tolist(), run["h"].view(np.int64).tolist(), strict=True)
    ]
    kept = repeats._alike(held)
    count = collections.Counter(t[i : i + repeats.PASSAGE] for t in raw for i in range(len(t) - repeats.PASSAGE + 1))
    repeated = [x for x in held if any(count[x[4][i : i + repeats.PASSAGE]] > 1 for i in range(x[3]))]
    assert set(repeated) <= set(kept)
    assert not any(x[0] < 30 for x in kept)  # 40 to 60 bytes in common are too few
    assert len(kept) < len(held) / 2


def test_runs_cover_every_start_once_and_equal_strings_share_a_hash():
    r = random.Random(4)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 90))) for _ in range(40)] + ["aaaa" * 20]
    data, off = _flat(texts)
    run = repeats.runs_of(data, off, span=20, gram=5, reach=30)
    hashes = collections.defaultdict(set)
    starts = collections.Counter()
    for row, p0, p1, h in zip(run["row"], run["p0"], run["p1"], run["h"].tolist(), strict=True):
        for p in range(p0, p1 + 1):
            starts[int(row), p] += 1
            hashes[texts[row][p : p + 20]].add(h)
    assert set(starts) == {(i, p) for i, t in enumerate(texts) for p in range(len(t) - 19)}
    assert set(starts.values()) <= {1}
    assert all(len(x) == 1 for x in hashes.values())


def test_shingle_sets():
    texts = AWKWARD + _random_texts(100, 5)
    data, off = _flat(texts)
    sets = near.shingle_sets(data, off)
    seen = {}
    for t, s in zip(texts, sets, strict=True):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        want = frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)] if w else [])
        assert len(s) == len(want)
        assert seen.setdefault(want, near.class_key(s)) == near.class_key(s)
    assert len({near.class_key(s) for s in sets}) == len(seen)


def test_bit_counts_bound_the_overlap_and_links_are_exact():
    r = np.random.default_rng(6)
    pool = r.integers(0, 1 << 62, 400, dtype=np.uint64)
    sets = []
    for _ in range(80):
        base = np.unique(r.choice(pool[:100], r.integers(1, 60)))
        for _ in range(r.integers(1, 4)):
            extra = r.choice(pool, r.integers(0, 6))
            sets.append(np.unique(np.append(base, extra)))
    n = np.array([len(s) for s in sets])
    marks = [near.signature(s, near.level_of(len(s))) for s in sets]
    want = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 70 * (n[i] + n[j] - common):
                want.add((i, j))
    bound = {tuple(sorted(x)) for x in near.bounded_pairs(n, marks).tolist()}
    assert want <= bound
    assert {tuple(x) for x in near.exact_links(sets).tolist()} == want
    side = np.arange(len(sets)) % 2
    assert {tuple(x) for x in near.exact_links(sets, side).tolist()} == {p for p in want if side[p[0]] != side[p[1]]}
    for i, j in want:  # the prefix filter loses no link
        a, b = (set(near._prefix(sets[k], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)).tolist()) for k in (i, j))
        assert a & b


def _edit_distance_within(pattern, text):
    d = list(range(len(pattern) + 1))
    best = d[-1]
    for ch in text:
        last, d[0] = d[0], 0
        for i, p in enumerate(pattern, 1):
            last, d[i] = d[i], min(d[i] + 1, d[i - 1] + 1, last + (p != ch))
        best = min(best, d[-1])
    return best


def test_qgram_filter_finds_all_within_budget():
    r = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "zeta", "kappa"]
    items = [" ".join(r.choice(words) for _ in range(r.randint(8, 40))).encode() for _ in range(12)]
    index = contamination.Passages(items)
    for _ in range(120):
        j = r.randrange(len(items))
        p = bytearray(index.texts[j].tobytes())
        for _ in range(r.randint(0, int(index.k[j]) + 3)):
            i = r.randrange(len(p))
            kind = r.random()
            if kind < 0.34:
                p[i] = r.randrange(97, 123)
            elif kind < 0.67:
                del p[i]
            else:
                p.insert(i, r.randrange(97, 123))
        pad = " ".join(r.choice(words) for _ in range(r.randint(0, 20)))
        raw = np.frombuffer((pad + " ").encode() + bytes(p) + b" tail", np.uint8)
        f, fo, _ = contamination.fold(raw, np.array([0, len(raw)]))
        found = contamination.best_places(index.verify(f, fo, index.candidates(f, fo))).tolist()
        for t in range(len(items)):
            true = _edit_distance_within(index.texts[t].tobytes(), f.tobytes())
            mine = [x for x in found if x[1] == t]
            assert bool(mine) == (true <= index.k[t])
            if mine:
                assert min(x[4] for x in mine) == true


def test_classes_of_a_token_meet_in_the_bucket_of_the_least():
    """However the sorted rows are cut into batches, and if one token has nearly all of them."""
    r = random.Random(3)
    for n in (1, 30, 200):
        rows = sorted((r.choice([5, 5, 5, 5, r.randrange(20)]), r.randrange(12)) for _ in range(n))
        want = set()
        for t in {t for t, _ in rows}:
            classes = {c for x, c in rows if x == t}
            if len(classes) > 1:
                want |= {(min(classes), c) for c in classes}
        for cut in (1, 2, 7, 500):
            batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows[i : i + cut]], pa.int64()), pa.array([x[1] for x in rows[i : i + cut]], pa.int64())], names=["token", "k1"]) for i in range(0, n, cut)]
            got = {p for b in near._meet(iter(batches)) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
            assert got == want


@pytest.mark.parametrize("slice_", [1 << 21, 40])
def test_short_passages_keep_their_budget(monkeypatch, slice_):
    """Grams shrink with the passage; what many passages share is counted in slices."""
    monkeypatch.setattr(contamination, "SLICE", slice_)
    r = random.Random(12)
    items = [bytes(r.choice(b"abcd ") for _ in range(n)) for n in (1, 3, 5, 9, 10, 14, 19, 20, 27, 31, 39, 40, 48, 48)] + [b"common words of all " * 3] * 3
    folded = [contamination.fold(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tobytes().strip() for t in items]
    indexes = [p for p in (contamination.Passages(items, q=q) for q in range(1, contamination.Q + 1)) if len(p.m)]
    assert sorted(i for p in indexes for i in p.own) == [i for i, f in enumerate(folded) if f] and len(indexes) > 2
    for n in range(60):
        p = bytearray(folded[n % len(items)])
        for _ in range(r.randint(0, len(p) // 10 + 1)):
            if p:
                p[r.randrange(len(p))] = r.choice(b"abcd")
        raw = np.frombuffer(b"common words of " * (n % 3) + b"zz " + bytes(p) + b" yy", np.uint8)
        f, fo, _ = contamination.fold(raw, np.array([0, len(raw)]))
        found = {}
        for index in indexes:
            for x in contamination.best_places(index.verify(f, fo, index.candidates(f, fo))).tolist():
                found.setdefault(index.own[x[1]], []).append(x[4])
        for i, t in enumerate(folded):
            if t:
                true = _edit_distance_within(t, f.tobytes())
                assert (min(found[i]) == true) if true <= int(0.1 * len(t)) else i not in found


def test_windows_hold_every_byte():
    texts = [t for t in AWKWARD if t is not None] + ["x" * 700]
    data, off = _flat(texts)
    x, row, length = langid.windows_of(data, off, 64)
    for i, t in enumerate(texts):
        raw = b"".join(w[:n].tobytes() for w, r, n in zip(x, row, length, strict=True) if r == i)
        assert raw == re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())


def test_byte_network_gradient():
    net = langid.ByteNet(3, seed=2)
    r = np.random.default_rng(0)
    x, y = r.integers(1, 255, (4, 32)).astype(np.uint8), np.array([0, 1, 2, 1])
    for name in ("filt", "dense", "embed", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))

    def loss():
        return float(-np.log(net.probabilities(x)[np.arange(4), y]).mean())

    g = net._gradients(x, y)
    for name in ("dense", "filt", "embed"):
        w = getattr(net, name)
        at = np.unravel_index(np.abs(g[name]).argmax(), w.shape)
        old = w[at]
        w[at] = old + 1e-5
        up = loss()
        w[at] = old - 1e-5
        down = loss()
        w[at] = old
        assert (up - down) / 2e-5 == pytest.approx(g[name][at], rel=0.02, abs=1e-5)


def test_label_model_recovers_voters():
    r = np.random.default_rng(1)
    y = r.random(20_000) < 0.2
    hit, false = np.linspace(0.9, 0.4, toxicity.VOTERS), np.linspace(0.02, 0.2, toxicity.VOTERS)
    votes = np.where(y[:, None], r.random((len(y), toxicity.VOTERS)) < hit, r.random((len(y), toxicity.VOTERS)) < false)
    votes[:, 1] = votes[:, 0]  # a copy, which a model without correlations would count twice
    pattern = (votes << np.arange(toxicity.VOTERS)).sum(1)
    counts = np.bincount(pattern, minlength=1 << toxicity.VOTERS).astype(float)
    labelled = np.zeros((2, 1 << toxicity.VOTERS))
    np.add.at(labelled, (y[:1500].astype(int), pattern[:1500]), 1)
    post = toxicity.LabelModel().fit(counts, labelled).posterior()
    assert ((post[pattern] > 0.5) == y).mean() > 0.97


def test_licence_classifier():
    background = [f"plain line number {i} about rivers and hills".encode() for i in range(300)]
    net = licences.train(background)
    for family, texts in licences.TEMPLATES.items():
        for t in texts:
            slot, owner = licences._grams_of_lines([t.encode()])
            p = net.probabilities(slot, owner, 1)[0]
            assert net.families[p.argmax()] == family
            assert licences.best_template(t, family) == 1.0
    slot, owner = licences._grams_of_lines([b"The general assembly met on Monday."])
    p = net.probabilities(slot, owner, 1)[0]
    assert p[1:].max() < net.least or licences.best_template("The general assembly met on Monday.", net.families[p[1:].argmax() + 1]) < licences.CLOSE
