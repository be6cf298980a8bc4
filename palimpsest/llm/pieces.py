"""Operator 6, SentencePiece encoding and decoding by streaming Viterbi.

A lattice of pieces is walked from left to right. A boundary between two
characters keeps one surviving path: for a unigram model the best-scoring one;
for a BPE model the one path that the merge order leaves stable, that is, whose
every two neighbouring pieces are what merging their joined text gives (so ids
equal those of the library that trained the model). Only boundaries no further
back than the longest piece can still be extended; when the back-pointers of
all of them meet in one boundary, everything before it is final and committed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import flat, mix, per_row, prefix_hash, range_hash, tidied

MARK = "▁"
#: Segments remembered by one Python worker; beyond, those unused for longest go.
CACHE = 600_000
#: Pairs of pieces remembered by one Python worker.
PAIRS = 2_000_000
#: Columns between two commits of the lanes, and spare columns of their ring.
STRIDE = 32
#: Segments walked side by side.
LANES = 40_000
#: Characters that a walk is fed at once.
FEED = 4096
#: The longest segments of a batch are walked one by one: side by side, so few would cost more.
FEW = 40
UNKNOWN_PENALTY = 10.0
BATCH_BYTES = 2 << 20


class PieceModel:
    """Pieces, scores and byte fallback of a SentencePiece model file."""

    _heads: dict[str, bool] | None = None

    def __init__(self, serialized: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(serialized)
        self.bpe = proto.trainer_spec.model_type == 2
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes_: dict[int, int] = {}
        self.unknown = 0
        self.surface: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.bytes_[int(p.piece[3:5], 16)] = i
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (1, 4):
                self.ids[p.piece], self.scores[p.piece] = i, p.score
                self.surface.append(p.piece.replace(MARK, " ").encode())
            else:
                self.unknown = i if p.type == 2 else self.unknown
                self.surface.append(b"")
        self.longest = max(map(len, self.ids), default=1)
        self.low = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        order = sorted(self.scores, key=lambda x: -self.scores[x])
        self.rank = {x: i for i, x in enumerate(order)}
        #: the last merge of a piece: its two halves
        self._halves: dict[str, tuple[str, str]] = {}
        self._tied = len(set(self.scores.values())) < len(self.scores)
        self._own: dict[str, bool] = {}
        self._young: dict[tuple[str, str], bool] = {}
        self._older: dict[tuple[str, str], bool] = {}
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        starts_only = not any(MARK in p.lstrip(MARK) for p in self.ids)
        # where no piece spans a boundary all paths meet: texts part there at once
        self.parted = starts_only and "\n" not in joined
        sizes = np.array([len(x) for x in self.surface], np.int64)
        self.surface_at = np.concatenate([[0], np.cumsum(sizes)])
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by the merge order, best pair first, leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def own(self, piece: str) -> bool:
        ok = self._own.get(piece)
        if ok is None:
            ok = self._own[piece] = len(piece) == 1 or self.merged(piece) == [piece]
        return ok

    def halves(self, piece: str) -> tuple[str, str]:
        out = self._halves.get(piece)
        if out is None:
            parts = list(piece)
            while len(parts) > 2:
                best, at = None, 0
                for i in range(len(parts) - 1):
                    s = self.scores.get(parts[i] + parts[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out = self._halves[piece] = (parts[0], parts[1])
        return out

    def stable(self, a: str, b: str) -> bool:
        """Whether merging the text of two pieces gives the two pieces.

        Merges are undone from the latest to the earliest; before each, the pieces
        that then met at the boundary must not have merged first. Pieces of equal
        score (runs of spaces) have no such order; their text is merged anew.
        """
        ok = self._young.get((a, b))
        if ok is None:
            ok = self._older.get((a, b))
            if ok is None:
                ok = self.merged(a + b) == [a, b] if self._tied and MARK + MARK in a + b else self._unmerged(a, b)
            if len(self._young) >= PAIRS // 32:  # the older half goes
                self._older, self._young = self._young, {}
            self._young[a, b] = ok
        return ok

    def _unmerged(self, a: str, b: str) -> bool:
        rank, limit = self.rank, len(self.rank)
        while True:
            c = rank.get(a + b)
            if c is not None and c < limit:
                return False
            ra = rank[a] if len(a) > 1 else -1
            rb = rank[b] if len(b) > 1 else -1
            if ra > rb:
                limit, a = ra, self.halves(a)[1]
            elif rb >= 0:  # of equal merges the left one comes first
                limit, b = rb + 1, self.halves(b)[0]
            else:
                return True

    def heads(self) -> dict[str, bool]:
        """Every beginning of a piece; True where it is one that merging alone gives."""
        if self._heads is None:
            out: dict[str, bool] = {}
            for p in self.ids:
                for i in range(1, len(p)):
                    out.setdefault(p[:i], False)
                out[p] = not self.bpe or self.own(p)
            self._heads = out
        return self._heads

    def emit(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        if self.bytes_:
            return [self.bytes_[b] for b in piece.encode()]
        return [self.unknown]

    def decode(self, ids) -> str:  # noqa: ANN001
        """The text of ``ids``; exact but for a literal U+2581, which gives a space."""
        raw = b"".join([self.surface[i] for i in ids])
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", errors="replace")


class StreamingViterbi:
    """Encodes prepared text fed in parts; the window never exceeds what can still change.

    Boundaries are walked from left to right. Each hands its path on over every
    piece that starts there; once walked, only boundaries up to the longest
    piece ahead are alive, and what all their paths share is committed.
    """

    def __init__(self, model: PieceModel) -> None:
        self.m = model
        self.text = ""  # from boundary `base` on
        self.base = 0
        self.at = 0  # next boundary to walk
        self.nodes: dict[int, tuple[int, str, float]] = {0: (-1, "", 0.0)}
        self.done = 0

    def feed(self, text: str) -> list[int]:
        self.text += text
        return self._walk(self.base + len(self.text) - self.m.longest)

    def finish(self) -> list[int]:
        out = self._walk(self.base + len(self.text))
        return out + self._upto(self.base + len(self.text))

    def _walk(self, limit: int) -> list[int]:
        m, nodes, base, text = self.m, self.nodes, self.base, self.text
        heads, longest, bpe = m.heads(), m.longest, m.bpe
        n = base + len(text)
        out: list[int] = []
        stop = self.done + 4 * longest
        for j in range(self.at, limit):
            node = nodes.get(j)
            if node is None:
                continue
            if j > stop:
                self.at = j
                out += self._commit()
                stop = j + 4 * longest
            last, score = node[1], node[2]
            for i in range(j + 1, min(n, j + longest) + 1):
                piece = text[j - base : i - base]
                whole = heads.get(piece)
                if whole is None and i > j + 1:
                    break
                if not whole and i > j + 1:  # a character outside the vocabulary stands alone
                    continue
                if bpe:  # the longer piece came first
                    if i not in nodes and (not last or m.stable(last, piece)):
                        nodes[i] = (j, piece, 0.0)
                else:
                    value = score + m.scores.get(piece, m.low)
                    if i not in nodes or value > nodes[i][2]:
                        nodes[i] = (j, piece, value)
        self.at = max(self.at, limit)
        if self.at - self.base > 4 * longest:
            out += self._commit()
            self.text, self.base = text[self.done - base :], self.done
        return out

    def _commit(self) -> list[int]:
        """Ids up to the boundary through which every live path runs."""
        live = {i for i in self.nodes if i >= self.at}
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(max(self.nodes[far][0], self.done))
        return self._upto(live.pop()) if live else []

    def _upto(self, end: int) -> list[int]:
        path, i, nodes = [], end, self.nodes
        while i > self.done:
            node = nodes[i]
            path.append(node[1])
            i = node[0]
        self.done = end
        for k in [k for k in nodes if k < end]:
            del nodes[k]
        emit = self.m.emit
        return [x for p in reversed(path) for x in emit(p)]


class Lanes:
    """The streaming walk of many segments side by side, a boundary of all of them at a time.

    Paths lie in a ring of columns. Every STRIDE columns the back-pointers of the
    boundaries alive are followed until they meet in one, all before it is
    committed, and its columns are free again; where they don't meet in time the
    ring grows.
    """

    def __init__(self, model: PieceModel) -> None:
        self.m, self.longest = model, model.longest
        self.n_ids = 1 + max(model.ids.values(), default=0)
        self.names = {i: p for p, i in model.ids.items()}
        heads = model.heads()
        number = {"": 0}
        for p in sorted(heads, key=len):
            number[p] = len(number)
        keys = np.array([number[p[:-1]] << 21 | ord(p[-1]) for p in number if p], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]  # (node, character)
        self.child = (order + 1).astype(np.int64)
        self.piece = np.full(len(number), -1, np.int32)  # of a node that may be part of a path
        for p, whole in heads.items():
            if whole or len(p) == 1 and p in model.ids:
                self.piece[number[p]] = model.ids[p]
        self.score = np.full(self.n_ids, model.low)
        self.score[list(model.ids.values())] = list(model.scores.values())
        self.pairs, self.verdicts = np.zeros(0, np.int64), np.zeros(0, bool)

    def _name(self, code: int) -> str:
        return self.names[code] if code < self.n_ids else chr(code - self.n_ids)

    def _stable(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        key = last.astype(np.int64) << 32 | piece
        out, todo = np.zeros(len(key), bool), np.ones(len(key), bool)
        for pairs, verdicts in ((self.pairs, self.verdicts), (self.new, self.new_verdicts)):
            if len(pairs):
                slot = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
                have = pairs[slot] == key
                out[have] = verdicts[slot[have]]
                todo &= ~have
        if todo.any():
            fresh, back = np.unique(key[todo], return_inverse=True)
            told = np.array([self.m.stable(self._name(k >> 32), self._name(k & 0xFFFFFFFF)) for k in fresh.tolist()], bool)
            out[todo] = told[back]
            where = np.searchsorted(self.new, fresh)
            self.new, self.new_verdicts = np.insert(self.new, where, fresh), np.insert(self.new_verdicts, where, told)
        return out

    def walk(self, chars: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pieces of each segment and their number; a code from n_ids on is a lone character."""
        m, longest = self.m, self.longest
        self.new, self.new_verdicts = np.zeros(0, np.int64), np.zeros(0, bool)
        order = np.argsort(-np.diff(off), kind="stable")
        size, begin = np.diff(off)[order], off[:-1][order]
        n = len(size)
        ring = 1 << int(np.ceil(np.log2(2 * longest + 2 * STRIDE)))
        code, step = np.full((n, ring), -1, np.int32), np.zeros((n, ring), np.int16)
        score = None if m.bpe else np.zeros((n, ring))
        done = np.zeros(n, np.int64)
        lanes_out: list[np.ndarray] = []
        ends_out: list[np.ndarray] = []
        codes_out: list[np.ndarray] = []

        def commit(lane: np.ndarray, upto: np.ndarray) -> None:
            at, who = upto, lane
            while True:
                open_ = at > done[who]
                if not open_.any():
                    break
                at, who = at[open_], who[open_]
                lanes_out.append(who)
                ends_out.append(at)
                codes_out.append(code[who, at % ring])
                at = at - step[who, at % ring]
            done[lane] = upto

        active, finished = n, n
        for j in range(int(size[0]) if n else 0):
            active = int(np.searchsorted(-size, -j, side="left"))  # longer than j
            code[:active, (j + longest) % ring] = -1
            at = j % ring
            lane = np.flatnonzero(code[:active, at] >= 0) if j else np.arange(active)
            last = code[lane, at]
            state = np.zeros(len(lane), np.int64)
            for s in range(1, longest + 1):
                fits = size[lane] >= j + s
                if not fits.all():
                    lane, last, state = lane[fits], last[fits], state[fits]
                if not len(lane):
                    break
                ch = chars[begin[lane] + (j + s - 1)]
                key = state << 21 | ch
                slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[slot] == key
                state = self.child[slot]
                piece = np.where(found, self.piece[state], -1)
                if s == 1:
                    piece = np.where(piece < 0, self.n_ids + ch, piece).astype(np.int32)
                target = (j + s) % ring
                if m.bpe:
                    take = np.flatnonzero((piece >= 0) & (code[lane, target] < 0))
                    if j and len(take):
                        take = take[self._stable(last[take], piece[take])]
                else:
                    value = np.where(piece < self.n_ids, self.score[np.minimum(piece, self.n_ids - 1)], m.low) + (score[lane, at] if j else 0.0)
                    take = np.flatnonzero((piece >= 0) & ((code[lane, target] < 0) | (value > score[lane, target])))
                    score[lane[take], target] = value[take]
                code[lane[take], target], step[lane[take], target] = piece[take], s
                if not found.all():
                    lane, last, state = lane[found], last[found], state[found]
            if (j + 1) % STRIDE == 0 or j + 1 == size[0]:
                alive = int(np.searchsorted(-size, -(j + 1), side="left"))
                over = np.arange(alive, finished)  # ended since the last commit
                commit(over, size[over])
                finished = alive
                if alive:
                    commit(np.arange(alive), self._met(code, step, ring, done, j, alive, size))
                    if j + STRIDE + longest - int(done[:alive].min()) >= ring:
                        columns = np.arange(int(done[:alive].min()), j + longest + 1)
                        wide = []
                        for old, empty in ((code, -1), (step, 0), *(() if score is None else ((score, 0.0),))):
                            new = np.full((n, 2 * ring), empty, old.dtype)
                            new[:, columns % (2 * ring)] = old[:, columns % ring]
                            wide.append(new)
                        code, step, score, ring = wide[0], wide[1], None if m.bpe else wide[2], 2 * ring
        self._remember()
        lane = order[np.concatenate(lanes_out)] if lanes_out else np.zeros(0, np.int64)
        end = np.concatenate(ends_out) if ends_out else lane
        codes = np.concatenate(codes_out) if codes_out else np.zeros(0, np.int32)
        by = np.argsort(off[:-1][lane] + end, kind="stable")
        return codes[by], np.bincount(lane, minlength=n)

    def _met(self, code, step, ring, done, j, alive, size) -> np.ndarray:  # noqa: ANN001
        """The boundary through which all paths of each lane run that are alive after column j."""
        ahead = j + 1 + np.arange(self.longest)
        rows = np.arange(alive)[:, None]
        live = (code[:alive][:, ahead % ring] >= 0) & (ahead <= size[:alive, None])
        least = np.where(live, ahead, np.iinfo(np.int64).max).min(1)
        place = np.where(live, ahead, least[:, None])
        while True:
            far = place.max(1, keepdims=True)
            todo = far[:, 0] > place.min(1)
            if not todo.any():
                return place[:, 0]
            move = (place == far) & todo[:, None] & (place > done[:alive, None])
            place = np.where(move, np.maximum(place - step[rows, place % ring], done[:alive, None]), place)

    def _remember(self) -> None:
        where = np.searchsorted(self.pairs, self.new)
        self.pairs, self.verdicts = np.insert(self.pairs, where, self.new), np.insert(self.verdicts, where, self.new_verdicts)
        if len(self.pairs) > PAIRS:  # any half; what goes is found out anew
            self.pairs, self.verdicts = self.pairs[::2], self.verdicts[::2]


class Encoder:
    """Piece ids of many texts at once: every different segment is walked once.

    Segments are told apart by 128 bits of hash; their ids lie in flat arrays.
    """

    def __init__(self, model: PieceModel, capacity: int = CACHE) -> None:
        self.m, self.lanes, self.capacity, self.round = model, Lanes(model), capacity, 0
        self.key = np.zeros(0, np.uint64)  # sorted
        self.check = np.zeros(0, np.uint64)
        self.used = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _starts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where segments start: rows, line feeds, what follows them, first spaces."""
        if not len(data):
            return np.zeros(0, np.int64)
        begins = off[:-1][np.diff(off) > 0]
        if not self.m.parted:
            return begins
        feed, mark = data == 0x0A, data == 0x20
        new = feed | mark
        new[1:] &= feed[1:] | feed[:-1] | ~mark[:-1]
        new[1:] |= feed[:-1]
        new[begins] = True
        return np.flatnonzero(new)

    def _walked(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each segment and the ids."""
        raw = data[_ranges(start, end - start)]
        chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        chars[chars == 0x20] = ord(MARK)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        off = heads[np.concatenate([[0], np.cumsum(end - start)])]
        length = np.diff(off)
        alone = np.zeros(len(length), bool)
        alone[np.argsort(-length, kind="stable")[:FEW]] = True
        size = np.zeros(len(length), np.int64)
        found = []
        for some, walk in ((~alone, self._side_by_side), (alone, self._one_by_one)):
            own = length[some]
            size[some], ids = walk(chars[_ranges(off[:-1][some], own)], np.concatenate([[0], np.cumsum(own)]))
            found.append((some, ids))
        at = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.int32)
        for some, ids in found:
            out[_ranges(at[some], size[some])] = ids
        return size, out

    def _one_by_one(self, chars: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, ids = [], []
        text = chars.astype("<u4").tobytes().decode("utf-32-le")
        for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            v, n = StreamingViterbi(self.m), len(ids)
            for k in range(i, j, FEED):
                ids += v.feed(text[k : min(k + FEED, j)])
            ids += v.finish()
            size.append(len(ids) - n)
        return np.array(size, np.int64), np.array(ids, np.int32)

    def _side_by_side(self, chars: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, n = self.m, len(off) - 1
        blocks = [self.lanes.walk(chars[off[i] : off[min(i + LANES, n)]], off[i : i + LANES + 1] - off[i]) for i in range(0, n, LANES)]
        codes, size = (np.concatenate(x) for x in zip(*blocks, strict=True)) if blocks else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        lone = np.flatnonzero(codes >= self.lanes.n_ids)
        if not len(lone):
            return size, codes
        # a character outside the vocabulary: its bytes, or the unknown piece
        spelt = [m.emit(chr(c - self.lanes.n_ids)) for c in codes[lone].tolist()]
        many = np.ones(len(codes), np.int64)
        many[lone] = [len(x) for x in spelt]
        ids = np.repeat(codes, many)
        ids[_ranges((np.cumsum(many) - many)[lone], many[lone])] = [i for x in spelt for i in x]
        return per_row(many, np.concatenate([[0], np.cumsum(size)])), ids

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their offsets by row of prepared texts (a space in front where the model wants it)."""
        starts = self._starts(data, off)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        ends = np.append(starts[1:], off[-1])
        h = prefix_hash(data)
        hashes = range_hash(h, starts, ends)
        key, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        a, b = starts[first], ends[first]
        middle = (a + b) // 2
        check = mix(range_hash(h, a, middle) * np.uint64(5) + range_hash(h, middle, b))
        slot = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        known = (self.key[slot] == key) & (self.check[slot] == check) if len(self.key) else np.zeros(len(key), bool)
        self.round += 1
        self.used[slot[known]] = self.round
        fresh = np.flatnonzero(~known)
        size, ids = self._walked(data, a[fresh], b[fresh])
        pool = np.concatenate([self.ids, ids])
        at, count = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        if len(self.key):
            at[known], count[known] = self.at[slot[known]], self.size[slot[known]]
        at[fresh] = len(self.ids) + np.cumsum(size) - size
        count[fresh] = size
        n = count[back]
        out = pool[_ranges(at[back], n)]
        self._keep(key[fresh], check[fresh], at[fresh], size, pool)
        total = np.concatenate([[0], np.cumsum(n)])
        return out, total[np.searchsorted(starts, off)]

    def _keep(self, key: np.ndarray, check: np.ndarray, at: np.ndarray, size: np.ndarray, pool: np.ndarray) -> None:
        if not len(key):
            return
        where = np.searchsorted(self.key, key)
        self.key, self.check = np.insert(self.key, where, key), np.insert(self.check, where, check)
        self.at, self.size = np.insert(self.at, where, at), np.insert(self.size, where, size)
        self.used, self.ids = np.insert(self.used, where, self.round), pool
        if len(self.key) > self.capacity:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: self.capacity // 4 * 3])
            self.key, self.check, self.used = self.key[keep], self.check[keep], self.used[keep]
            at, self.size = self.at[keep], self.size[keep]
            self.ids = pool[_ranges(at, self.size)]
            self.at = np.cumsum(self.size) - self.size


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (size[0] of them), at[1], ..."""
    return np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())


def prepared(model: PieceModel, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space in front of each that isn't empty, if the model wants one."""
    if not model.dummy_prefix:
        return data, off
    some = np.diff(off) > 0
    new = off + np.concatenate([[0], np.cumsum(some)])
    out = np.empty(new[-1], np.uint8)
    front = np.zeros(len(out), bool)
    front[new[:-1][some]] = True
    out[front], out[~front] = 0x20, data
    return out, new


def decoded(model: PieceModel, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the ids of each row stand for, and their offsets."""
    at, size = model.surface_at[ids], np.diff(model.surface_at)[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    return model.surface_bytes[_ranges(at, size)], total[ends]


def _equal_rows(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> np.ndarray:
    same = np.diff(a_off) == np.diff(b_off)
    if same.all():
        bad = np.concatenate([[0], np.cumsum(a != b)])
        return bad[a_off[1:]] == bad[a_off[:-1]]
    for r in np.flatnonzero(same):
        same[r] = np.array_equal(a[a_off[r] : a_off[r + 1]], b[b_off[r] : b_off[r + 1]])
    return same


_LOADED: dict[bytes, Encoder] = {}


def loaded(serialized: bytes) -> Encoder:
    """The model and its segments, kept by a Python worker from task to task."""
    if serialized not in _LOADED:
        _LOADED.clear()
        _LOADED[serialized] = Encoder(PieceModel(serialized))
    return _LOADED[serialized]


def encode_texts(encoder: Encoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, their offsets by text and whether decoding them gives the text."""
    lossy = np.asarray(pc.fill_null(pc.match_substring(texts, MARK), False))
    if lossy.any():  # a literal U+2581 is encoded like a space
        texts = pc.replace_substring(texts, MARK, " ")
    data, off = prepared(encoder.m, *flat(texts))
    ids, ends = encoder.encode(data, off)
    return ids, ends, _equal_rows(*decoded(encoder.m, ids, ends), data, off) & ~lossy


def _encode(model_bytes):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(model_bytes.value)
        for batch in batches:
            _, off = flat(batch.column(1))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(off, off[i] + BATCH_BYTES, side="right")) - 1)
                part = batch.slice(i, j - i)
                ids, ends, same = encode_texts(encoder, part.column(1))
                values = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends)), values, pa.array(same)], names=["doc_id", "n_ids", "ids", "round_trip"])
                i = j

    return run


def encode(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids and round_trip (decoding gives the text) of every row.

    Null and empty texts have no ids and round_trip true; repeated rows are
    encoded alike; other columns are not read; an empty table gives an empty
    result; very long texts are encoded whole. No shuffle. The model file (read
    on the driver, some hundred kilobytes) is the only thing broadcast.
    """
    with open(model_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(tidied(_encode(shared)), f"doc_id {kind}, n_ids long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``; null ids give a null text."""
    with open(model_file, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(shared.value).m
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            texts = [None if x is None else model.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(tidied(run), f"{fields}, decoded string")
