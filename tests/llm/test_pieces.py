"""Piece encoding against the library, a full Viterbi and exact round trips."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import pieces
from palimpsest.llm.queries import PIECE_MODEL


@pytest.fixture(scope="module")
def model():
    with open(PIECE_MODEL, "rb") as f:
        return pieces.PieceModel(f.read())


def _texts():
    r = random.Random(1)
    alphabet = "ab the\n  inger  é漢😀.,1<s>"
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(400)]
    return [*out, "", "  ", "a" * 500, " " * 40 + "x", " " * 17, "don't stop\tit", "ontionretioninonly thththth"]


def _encoded(encoder, texts):
    ids, ends, same = pieces.encode_texts(encoder, pa.array(texts))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)], same.tolist()


@pytest.mark.parametrize("few", [0, 3, 40])
def test_ids_equal_the_library(model, monkeypatch, few):
    import sentencepiece

    monkeypatch.setattr(pieces, "FEW", few)  # how many are walked one by one

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    want = [library.encode(t) for t in _texts()]
    small = pieces.Encoder(model, capacity=8)  # hardly remembers anything
    for encoder in (pieces.Encoder(model), small):
        assert _encoded(encoder, _texts())[0] == want
        assert [_encoded(encoder, [t])[0][0] for t in _texts()] == want
    assert len(small.key) <= 8 and len(small.ids) == small.size.sum()


def test_streaming_commits_the_same_ids(model):
    whole, _ = _encoded(pieces.Encoder(model), _texts())
    for t, want in zip(_texts(), whole, strict=True):
        v, s, out = pieces.StreamingViterbi(model), ("▁" + t if t else "").replace(" ", "▁"), []
        for i in range(0, len(s), 7):
            out += v.feed(s[i : i + 7])
        assert out + v.finish() == want
        assert len(v.nodes) <= 6 * model.longest + 1


def test_streaming_window_stays_short_in_very_long_texts(model):
    """One segment of 200,000 characters: ids leave as they become certain."""
    import sentencepiece

    r = random.Random(5)
    s = "".join(r.choice("etaoinshr") for _ in range(200_000))
    v, out, most = pieces.StreamingViterbi(model), [], 0
    for i in range(0, len(s), 1000):
        out += v.feed(("▁" if i == 0 else "") + s[i : i + 1000])
        most = max(most, len(v.nodes), len(v.text) - 1000)
    assert most <= 6 * model.longest + 1
    assert out + v.finish() == sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL).encode(s)


def test_round_trip(model):
    ids, same = _encoded(pieces.Encoder(model), [*_texts(), None, "a▁b"])
    assert [model.decode(x) for x in ids] == [*_texts(), "", "a b"]
    assert same == [True] * (len(same) - 1) + [False]


def test_unigram_window_equals_full_viterbi(model):
    """The same class with unigram rules against all segmentations of short strings."""
    toy = pieces.PieceModel.__new__(pieces.PieceModel)
    toy.bpe, toy.dummy_prefix, toy.bytes_, toy.unknown = False, False, {}, 0
    toy.scores = {"a": -3.0, "b": -3.1, "ab": -4.0, "ba": -4.3, "aab": -4.9, "abab": -6.0, "bb": -7.5}
    toy.ids = {p: i + 1 for i, p in enumerate(toy.scores)}
    toy.longest, toy.low = 4, -20.0

    def best(s):
        table = {0: (0.0, [])}
        for i in range(1, len(s) + 1):
            for j in range(max(0, i - 4), i):
                p = s[j:i]
                if j in table and (p in toy.scores or i - j == 1):
                    score = table[j][0] + toy.scores.get(p, toy.low)
                    if i not in table or score > table[i][0] + 1e-12:
                        table[i] = (score, [*table[j][1], p])
        return table[len(s)]

    r = random.Random(2)
    for _ in range(200):
        s = "".join(r.choice("abx") for _ in range(r.randint(1, 80)))
        v = pieces.StreamingViterbi(toy)
        ids = v.feed(s) + v.finish()
        lanes = pieces.Lanes(toy)
        codes, _ = lanes.walk(np.array([ord(c) for c in s + s[:9]]), np.array([0, len(s), len(s) + len(s[:9])]))
        assert [c if c < lanes.n_ids else 0 for c in codes.tolist()][: len(ids)] == ids
        score, path = best(s)
        names = {i: p for p, i in toy.ids.items()}
        at, mine = 0, 0.0
        for i in ids:
            mine += toy.scores[names[i]] if i else toy.low
            at += len(names[i]) if i else 1
        assert at == len(s)
        assert mine == pytest.approx(score)
