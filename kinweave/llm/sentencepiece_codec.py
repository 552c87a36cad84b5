"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut into units: between two characters that no piece holds side by side
no piece can reach across. The distinct units of a batch are laid end to end
and indexed by a suffix array; every piece is found by binary search as a range of
it, and each place in a range is an edge of the lattice. The edges are sorted by
position and relaxed in that order: for a BPE model an edge may follow the best
path to its start only if the two last pieces would not have merged otherwise,
which leaves exactly one path, the model's own segmentation; for a unigram model
the path with the highest score wins. A worker remembers the pieces of units by a
64-bit hash, so a unit is indexed once and then looked up for whole batches.

Characters that are no piece of their own become byte pieces, or the unknown piece
where the model has none; unknown pieces in a row are one. A null text, like an
empty one, has no tokens. Decoding inverts encoding except that a space mark in a
text comes back as a space. Texts and units of any length are taken in windows:
memory holds a window's edges, and 4 bytes a character of the longest unit. Rows
are coded one by one, so ties, repeated rows and repeated ids change nothing;
other columns are carried as they are. Models with a character map for
normalisation, with user-defined or with unused pieces are refused.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinweave.llm import kernels as K
from kinweave.llm.piece_model import BPE, BYTE, NORMAL, SPACE, UNKNOWN, UNUSED, USER_DEFINED, PieceModel
from kinweave.llm.ppm import Lookup
from kinweave.llm.suffix_array import pack, suffix_array

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units a worker remembers before it starts afresh; two workers share an executor.
REMEMBERED = 1 << 19
#: Bytes of text taken at a time, and characters of one window of a longer text.
BATCH_BYTES = 1 << 19
WINDOW = 1 << 19
#: Characters of new units that are indexed together: every one of them has several edges.
INDEX_CHARS = 100_000
#: Edges of one position over all units below which they are relaxed one by one.
FEW = 100
#: Pairs of pieces whose verdict is remembered.
PAIRS = 1 << 17
NEVER = np.int64(1) << 40
#: What an unknown character costs in a unigram model, below its lowest score (fixed value of the model type).
UNKNOWN_PENALTY = 10.0


def pack_rows(grid: np.ndarray, bits: int) -> np.ndarray:
    """Each row's codes as one number, first code highest."""
    key = np.zeros(len(grid), np.int64)
    for column in grid.T:
        key = (key << bits) | column
    return key


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run, one after the other."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class UnitTable:
    """Pieces of units by the units' hashes: an open-addressing table that grows by whole arrays."""

    def __init__(self, limit: int):
        self.limit, bits = limit, max(4, (2 * limit - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slot = np.full(1 << bits, -1, np.int32)
        self.clear()

    def clear(self) -> None:
        self.slot[:] = -1
        self.n = self.used = 0
        self.key, self.at = np.zeros(1024, np.uint64), np.zeros(1025, np.int64)
        self.ids = np.zeros(4096, np.int32)

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slot = self._start(keys)
        row = self.slot[slot]
        other = np.flatnonzero((row >= 0) & (self.key[row] != keys))
        while len(other):
            slot[other] = at = (slot[other] + 1) & self.mask
            row[other] = self.slot[at]
            other = other[(row[other] >= 0) & (self.key[row[other]] != keys[other])]
        return row

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct new keys and their pieces."""
        n, used = self.n + len(keys), self.used + len(ids)
        for name, need in (("key", n), ("at", n + 1), ("ids", used)):
            have = getattr(self, name)
            if len(have) < need:
                setattr(self, name, np.concatenate((have, np.zeros(max(need, 2 * len(have)) - len(have), have.dtype))))
        self.key[self.n : n], self.ids[self.used : used] = keys, ids
        self.at[self.n + 1 : n + 1] = self.used + np.cumsum(sizes)
        todo, slot = np.arange(self.n, n, dtype=np.int32), self._start(keys)
        self.n, self.used = n, used
        while len(todo):
            free = self.slot[slot] < 0
            s, t = slot[free], todo[free]
            self.slot[s] = t
            lost = self.slot[s] != t
            todo = np.concatenate((todo[~free], t[lost]))
            slot = (np.concatenate((slot[~free], s[lost])) + 1) & self.mask


class Codec:
    """Encodes and decodes with one model; everything it needs is derived from the model file."""

    def __init__(self, data: bytes, remembered: int = REMEMBERED, window: int = WINDOW):
        model = self.model = PieceModel.parse(data)
        if model.charsmap:
            raise ValueError("models with a normalisation map are not supported")
        if any(t in (USER_DEFINED, UNUSED) for t in model.types):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.window = window
        self.usable = [i for i, t in enumerate(model.types) if t == NORMAL]
        self.byte = {int(model.pieces[i][1:-1], 16): i for i, t in enumerate(model.types) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(model.types) if t == UNKNOWN), 0)
        self.size = len(model.pieces)
        # Characters that occur in pieces only are pieces of our own, past the model's; they come out as unknown.
        self.pieces = list(model.pieces)
        self.scores = [float(x) for x in model.scores]
        known = sorted({c for i in self.usable for c in model.pieces[i]})
        single = {model.pieces[i] for i in self.usable if len(model.pieces[i]) == 1}
        worst = min((self.scores[i] for i in self.usable), default=0.0) - UNKNOWN_PENALTY
        for c in known:
            if c not in single:
                self.usable.append(len(self.pieces))
                self.pieces.append(c)
                self.scores.append(worst)
        self.id = {self.pieces[i]: i for i in self.usable}
        self.char = {c: i + 1 for i, c in enumerate(known)}
        raw = [p.replace(SPACE, " ").encode() for p in model.pieces]
        for b, i in self.byte.items():
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.table = UnitTable(remembered)
        self._characters()
        self._prepare()

    def _characters(self) -> None:
        """Per code point: its code, its hash, and its number among those that stand beside others in pieces."""
        points = 0x110000
        self.code = np.zeros(points, np.int32)
        for c, i in self.char.items():
            self.code[ord(c)] = i
        beside = {(a, b) for i in self.usable for a, b in zip(self.pieces[i], self.pieces[i][1:], strict=False)}
        number = {c: k + 1 for k, c in enumerate(sorted({c for pair in beside for c in pair}))}
        self.number = np.zeros(points, np.int32)
        for c, k in number.items():
            self.number[ord(c)] = k
        self.n_numbers = len(number) + 1
        self.joins = np.zeros(self.n_numbers**2, bool)
        for a, b in beside:
            self.joins[number[a] * self.n_numbers + number[b]] = True
        self.char_hash = K.mix64(np.arange(1, points + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        if self.model.escape_whitespaces:
            for table in (self.code, self.number, self.char_hash):
                table[0x20] = table[ord(SPACE)]

    def _prepare(self) -> None:
        """Ranks, the last merge of each piece, and the pairs that merge."""
        scores, pieces = self.scores, self.pieces
        order = sorted(self.usable, key=lambda i: (-scores[i], i))
        self.rank = np.full(len(pieces), -1, np.int64)
        for r, i in enumerate(order):
            if len(pieces[i]) > 1:
                self.rank[i] = r
        self.left, self.right = np.full(len(pieces), -1, np.int64), np.full(len(pieces), -1, np.int64)
        pairs: dict[int, int] = {}
        for p, i in self.id.items():
            for k in range(1, len(p)):
                a, b = self.id.get(p[:k]), self.id.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * len(pieces) + b] = int(self.rank[i])
        self.merge_rank, self.pair_fine = pairs, {}
        matched = []
        for i in self.usable:
            if self.model.model_type == BPE and len(pieces[i]) > 1:
                steps = self._merge(pieces[i])
                if steps is None or steps[-1][2] != i:
                    continue
                self.left[i], self.right[i] = steps[-1][:2]
            matched.append(i)
        self.walk = (self.rank.tolist(), self.left.tolist(), self.right.tolist())
        self.pair_key = Lookup(np.array(list(pairs), np.uint64))
        self.pair_rank = np.array([*pairs.values(), NEVER], np.int64)
        self.matched = np.array(matched, np.int64)
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.score = np.array(scores)
        self.width = int(self.length[self.matched].max()) if matched else 1
        self.bits = max(1, len(self.char).bit_length())
        self.per_key = 62 // self.bits
        self.keys = -(-self.width // self.per_key)
        grid = np.zeros((len(matched), self.keys * self.per_key), np.int64)
        for row, i in enumerate(matched):
            grid[row, : len(pieces[i])] = [self.char[c] for c in pieces[i]]
        self.piece_keys = [pack_rows(grid[:, k * self.per_key : (k + 1) * self.per_key], self.bits) for k in range(self.keys)]

    def _merge(self, text: str) -> list[tuple[int, int, int]] | None:
        """The merges (left, right, result) of plain BPE on a text of known characters, if they end in one piece."""
        now = [self.id.get(c, -1) for c in text]
        if min(now) < 0:
            return None
        steps, v = [], len(self.pieces)
        while len(now) > 1:
            best = min(((self.merge_rank.get(a * v + b, NEVER), k) for k, (a, b) in enumerate(zip(now, now[1:], strict=False))))
            if best[0] == NEVER:
                return None
            k = best[1]
            made = self.id[self.pieces[now[k]] + self.pieces[now[k + 1]]]
            steps.append((now[k], now[k + 1], made))
            now[k : k + 2] = [made]
        return steps

    def stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b, side by side, are what BPE makes of their text.

        Walks back through the merges that made the right edge of a and the left
        edge of b, latest first. Two parts that stood side by side would have merged
        if their merge ranks before the merges that took each of them further; the
        left one goes first among equals.
        """
        a, b = a.copy(), b.copy()
        fine = np.ones(len(a), bool)
        end_a, end_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        live = np.arange(len(a))
        v = np.uint64(len(self.pieces))
        while len(live):
            x, y = a[live], b[live]
            merge = self.pair_rank[self.pair_key.find(x.astype(np.uint64) * v + y.astype(np.uint64))]
            bad = (merge < end_a[live]) & (merge <= end_b[live]) & (merge < NEVER)
            fine[live[bad]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            on = ~bad & ((rank_x >= 0) | (rank_y >= 0))
            live, x, y, rank_x, rank_y = live[on], x[on], y[on], rank_x[on], rank_y[on]
            back_a = rank_x > rank_y
            i, j = live[back_a], live[~back_a]
            end_a[i], a[i] = rank_x[back_a], self.right[x[back_a]]
            end_b[j], b[j] = rank_y[~back_a], self.left[y[~back_a]]
        return fine

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece, by suffix array and binary search."""
        sa = suffix_array(codes, self.keys * self.per_key)
        packed = np.concatenate((pack(codes, self.per_key, self.bits), np.zeros(self.keys * self.per_key + 1, np.int64)))
        size, n = self.length[self.matched], len(codes)

        def bound(upper: bool) -> np.ndarray:
            lo, hi = np.zeros(len(size), np.int64), np.full(len(size), n, np.int64)
            while True:
                todo = np.flatnonzero(lo < hi)
                if not len(todo):
                    return lo
                mid = (lo[todo] + hi[todo]) >> 1
                at = sa[mid]
                sign = np.zeros(len(todo), np.int64)
                for k in range(self.keys):
                    drop = np.clip((k + 1) * self.per_key - size[todo], 0, self.per_key) * self.bits
                    d = np.sign((packed[at + k * self.per_key] >> drop) - (self.piece_keys[k][todo] >> drop))
                    sign = np.where(sign == 0, d, sign)
                right = (sign <= 0) if upper else (sign < 0)
                lo[todo] = np.where(right, mid + 1, lo[todo])
                hi[todo] = np.where(right, hi[todo], mid)

        first, last = bound(False), bound(True)
        count = last - first
        some = np.flatnonzero(count)
        count = count[some]
        return sa[spread(first[some], count)], np.repeat(self.matched[some], count)

    def _stays_one(self, a: int, b: int) -> bool:
        """:meth:`stays` for one pair, remembered."""
        v = len(self.pieces)
        key = a * v + b
        known = self.pair_fine.get(key)
        if known is not None:
            return known
        end_a = end_b = never = int(NEVER)
        rank, left, right = self.walk
        fine = True
        while True:
            merge = self.merge_rank.get(a * v + b, never)
            if merge < end_a and merge <= end_b and merge < never:
                fine = False
                break
            rank_a, rank_b = rank[a], rank[b]
            if rank_a < 0 and rank_b < 0:
                break
            if rank_a > rank_b:
                end_a, a = rank_a, right[a]
            else:
                end_b, b = rank_b, left[b]
        if len(self.pair_fine) > PAIRS:
            self.pair_fine.clear()
        self.pair_fine[key] = fine
        return fine

    def segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of units of known characters and their number in each unit, relaxed over the sorted edges of all at once."""
        points = np.frombuffer("\0".join(units).encode("utf-32-le") + bytes(4), np.uint32)
        codes = self.code[points].astype(np.int64)
        lengths = np.array([len(u) for u in units], np.int64)
        unit_start = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        codes[unit_start + lengths] = 0
        last, best = self._relaxed(codes, np.repeat(unit_start, lengths + 1))
        # Walk back from the ends of all units, once to count their pieces and once to write them.
        sizes = np.zeros(len(units), np.int64)
        for write in (False, True):
            out = np.zeros(sizes.sum(), np.int32) if write else None
            put = np.cumsum(sizes)
            who, at = np.arange(len(units)), unit_start + lengths
            while len(who):
                piece = last[at]
                if write:
                    put[who] -= 1
                    out[put[who]] = piece
                else:
                    sizes[who] += 1
                at = at - self.length[piece]
                more = at > unit_start[who]
                who, at = who[more], at[more]
        return out, sizes

    def _relaxed(self, codes: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last piece of the best path to each place of units laid end to end, and the path's score."""
        start, piece = self.edges(codes)
        length = self.length[piece]
        end = start + length
        level = end - origin[start]
        # by position in the unit; of edges that end together the longest first
        order = np.argsort((level * (len(codes) + 1) + end) * (self.width + 1) + self.width - length)
        start, piece, end, level = start[order], piece[order], end[order], level[order]
        last = np.full(len(codes) + 1, -1, np.int32)
        best = np.zeros(len(codes) + 1)
        cuts = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1], [True]))) if len(level) else np.zeros(1, np.int64)
        wide = np.flatnonzero(np.diff(cuts) > FEW)
        single = int(wide[-1]) + 1 if len(wide) else 0
        for lo, hi in zip(cuts[:single], cuts[1 : single + 1], strict=True):
            s, p, e = start[lo:hi], piece[lo:hi], end[lo:hi]
            whole = s == origin[s]
            ok = whole | (last[s] >= 0)
            s, p, e, whole = s[ok], p[ok], e[ok], whole[ok]
            if self.model.model_type != BPE:
                value = np.where(whole, 0.0, best[s]) + self.score[p]
                top = np.lexsort((-value, e))
                top = top[np.concatenate(([True], e[top][1:] != e[top][:-1]))] if len(top) else top
                last[e[top]], best[e[top]] = p[top], value[top]
                continue
            while len(s):  # the first candidate of each end, then the next of those that failed
                head = np.concatenate(([True], e[1:] != e[:-1]))
                hs, hp, he, hw = s[head], p[head], e[head], whole[head]
                good = hw.copy()
                check = np.flatnonzero(~hw)
                if len(check):
                    pair, back = np.unique(last[hs[check]].astype(np.int64) * len(self.length) + hp[check], return_inverse=True)
                    good[check] = self.stays(pair // len(self.length), pair % len(self.length))[back]
                last[he[good]] = hp[good]
                rest = ~head & (last[e] < 0)
                s, p, e, whole = s[rest], p[rest], e[rest], whole[rest]
        for lo in range(int(cuts[single]), len(start), INDEX_CHARS):
            hi = lo + INDEX_CHARS
            self._one_by_one(start[lo:hi], piece[lo:hi], end[lo:hi], origin, last, best)
        return last, best

    def _one_by_one(self, start, piece, end, origin, last, best) -> None:
        """Relaxes sorted edges singly: for what is left of a few units longer than all others."""
        bpe = self.model.model_type == BPE
        for s, p, e, o in zip(start.tolist(), piece.tolist(), end.tolist(), origin[start].tolist(), strict=True):
            if s != o and last[s] < 0:
                continue
            if bpe:
                if last[e] < 0 and (s == o or self._stays_one(int(last[s]), p)):
                    last[e] = p
            else:
                value = (0.0 if s == o else best[s]) + self.scores[p]
                if last[e] < 0 or value > best[e]:
                    last[e], best[e] = p, value

    def _long(self, unit: str) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`segment` of one unit of any length: the edges of one window at a time."""
        n = len(unit)
        last, best = np.full(n + 1, -1, np.int32), np.zeros(n + 1)
        for at in range(0, n, INDEX_CHARS):
            points = np.frombuffer(unit[at : at + INDEX_CHARS + self.width].encode("utf-32-le") + bytes(4), np.uint32)
            start, piece = self.edges(self.code[points].astype(np.int64))
            own = (start < INDEX_CHARS) & (start + self.length[piece] < len(points))
            start, piece = start[own] + at, piece[own]
            # by start, so that all paths to a place are known when edges leave it
            order = np.lexsort((piece, start))
            start, piece = start[order], piece[order]
            self._forward(start, piece, last, best)
        out, at = [], n
        while at:
            out.append(int(last[at]))
            at -= int(self.length[out[-1]])
        return np.array(out[::-1], np.int32), np.array([len(out)])

    def _forward(self, start, piece, last, best) -> None:
        bpe = self.model.model_type == BPE
        for s, p, size in zip(start.tolist(), piece.tolist(), self.length[piece].tolist(), strict=True):
            before, e = int(last[s]), s + size
            if s and before < 0:
                continue
            if bpe:
                if not s or self._stays_one(before, p):
                    last[e] = p
            else:
                value = best[s] + self.scores[p]
                if last[e] < 0 or value > best[e]:
                    last[e], best[e] = p, value

    def _outside(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unknown]

    def _finish(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replaces our own pieces, of characters the model has only inside pieces."""
        strange = np.flatnonzero(ids >= self.size)
        if not len(strange):
            return ids, sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        parts, count, at = [], np.ones(len(ids), np.int64), 0
        for k in strange.tolist():
            real = self._outside(self.pieces[ids[k]])
            parts += [ids[at:k], np.array(real, np.int32)]
            count[k], at = len(real), k + 1
        return np.concatenate([*parts, ids[at:]]), np.bincount(owner, count, len(sizes)).astype(np.int64)

    def learn(self, keys: np.ndarray, units: list[str]) -> None:
        """Remembers the pieces of units not met before."""
        known, size = [], 0
        outside = [k for k, u in enumerate(units) if not self.code[ord(u[0])]]
        if outside:  # characters that no piece has are units of their own
            found = [self._outside(units[k]) for k in outside]
            self.table.add(keys[outside], np.concatenate([np.array(x, np.int32) for x in found]), np.array([len(x) for x in found]))
        away = set(outside)
        for k, u in enumerate(units):
            if k in away:
                continue
            if len(u) > INDEX_CHARS:
                self.table.add(keys[[k]], *self._finish(*self._long(u)))
                continue
            known.append(k)
            size += len(u)
            if size > INDEX_CHARS:
                self.table.add(keys[known], *self._finish(*self.segment([units[i] for i in known])))
                known, size = [], 0
        if known:
            self.table.add(keys[known], *self._finish(*self.segment([units[i] for i in known])))

    def _cuts(self, points: np.ndarray) -> np.ndarray:
        """Whether a unit begins at each place."""
        number = self.number[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.joins[number[:-1] * self.n_numbers + number[1:]]
        return cut

    def _encode_part(self, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of texts laid end to end, and the number of each text's pieces."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        cut = self._cuts(points)
        edge = np.cumsum(sizes) - sizes
        cut[edge[sizes > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self.char_hash[points] * K.powers(K.BASE, len(points)), out=sums[1:])
        key = K.span_hashes(sums, start, end)
        row = self.table.find(key)
        new = np.flatnonzero(row < 0)
        if len(new):
            fresh, first = np.unique(key[new], return_index=True)
            if self.table.n + len(fresh) > self.table.limit and self.table.n:
                self.table.clear()
                fresh, first, new = *np.unique(key, return_index=True), np.arange(len(key))
            if len(fresh) > self.table.limit:
                self.table = UnitTable(2 * len(fresh))
            at = new[first]
            self.learn(fresh, [text[i:j] for i, j in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            row[new] = self.table.find(key[new])
        first = self.table.at[row]
        count = self.table.at[row + 1] - first
        ids = self.table.ids[spread(first, count)]
        before = np.concatenate(([0], np.cumsum(count)))
        return ids, np.diff(before[np.searchsorted(start, np.append(edge, len(points)))])

    def _prepared(self, text: str) -> str:
        if self.model.remove_extra_whitespaces:
            text = " ".join(x for x in text.split(" ") if x)
        return " " + text if text and self.model.add_dummy_prefix else text

    def _windows(self, text: str) -> Iterator[str]:
        """The text in parts that no piece reaches across, of about the window's size or a longer unit."""
        at, size = 0, self.window
        while at < len(text):
            part = text[at : at + size]
            if at + size < len(text):
                cut = np.flatnonzero(self._cuts(np.frombuffer(part.encode("utf-32-le"), np.uint32)))
                if cut[-1] == 0:
                    size *= 2
                    continue
                part = part[: int(cut[-1])]
            yield part
            at, size = at + len(part), self.window

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts, one after the other, and their offsets."""
        sizes, out = np.zeros(len(texts), np.int64), []
        held, owner, total = [], [], 0

        def code() -> None:
            ids, n = self._encode_part("".join(held), np.array([len(x) for x in held], np.int64))
            out.append(ids)
            np.add.at(sizes, owner, n)
            held.clear()
            owner.clear()

        for k, t in enumerate(texts):
            t = self._prepared(t)
            for part in self._windows(t) if len(t) > self.window else [t]:
                if total + len(part) > self.window and held:
                    code()
                    total = 0
                held.append(part)
                owner.append(k)
                total += len(part)
        if held:
            code()
        ids = np.concatenate(out) if out else np.zeros(0, np.int32)
        at = np.concatenate(([0], np.cumsum(sizes)))
        if not self.byte and len(ids):
            first = np.zeros(len(ids) + 1, bool)
            first[at] = True
            keep = np.ones(len(ids), bool)
            keep[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown) | first[1:-1]
            kept = np.concatenate(([0], np.cumsum(keep)))
            ids, at = ids[keep], kept[at]
        return ids, at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, at = self.encode_flat(texts)
        return [ids[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]

    def decode_flat(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts, and their offsets."""
        size = self.raw_size[ids]
        data = self.raw[spread(self.raw_at[ids], size)]
        off = np.concatenate(([0], np.cumsum(size)))[at]
        if self.model.add_dummy_prefix and len(data):
            head = off[:-1][off[1:] > off[:-1]]
            head = head[data[head] == 0x20]
            keep = np.ones(len(data), bool)
            keep[head] = False
            data, off = data[keep], off - np.searchsorted(head, off)
        return data, off

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_flat(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace")

    def round_trips(self, texts: list[str], ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which texts decoding gives back."""
        want = "".join(t.replace(SPACE, " ") if SPACE in t else t for t in texts).encode()
        size = np.array([len((t.replace(SPACE, " ") if SPACE in t else t).encode()) for t in texts], np.int64)
        data, off = self.decode_flat(ids, at)
        if len(want) == len(data) and (np.diff(off) == size).all() and want == data.tobytes():
            return np.ones(len(texts), bool)
        start = np.cumsum(size) - size
        return np.array([want[i : i + n] == data[a:b].tobytes() for i, n, a, b in zip(start, size, off[:-1], off[1:], strict=True)])


_codecs: dict[str, Codec] = {}

def _codec(name: str, shared) -> Codec:
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(shared.value)
    return _codecs[name]


def encode(documents: DataFrame, carry: list[str], model: str = MODEL, digest: bool = False) -> DataFrame:
    """``carry`` columns, n_tokens, and the token ids - or, as a digest, their CRC-32 and whether decoding gives the text back."""
    with open(model, "rb") as f:  # the driver reads the file; executors get its bytes
        shared, name = documents.sparkSession.sparkContext.broadcast(f.read()), uuid.uuid4().hex
    fields = [documents.schema[c] for c in carry] + [T.StructField("n_tokens", T.LongType())]
    if digest:
        fields += [T.StructField("n_bytes", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    else:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    names = [f.name for f in fields]
    if len(set(names)) < len(names):
        raise ValueError(f"carried columns may not be named like the results: {names}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, shared)
        for b in batches:
            for lo, hi, _, off in K.chunks(b.column(len(carry)), BATCH_BYTES):
                part = b.slice(lo, hi - lo)
                texts = [t or "" for t in part.column(len(carry)).to_pylist()]
                ids, at = codec.encode_flat(texts)
                cols = [part.column(i) for i in range(len(carry))]
                cols.append(pa.array(np.diff(at)))
                if digest:
                    raw = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
                    cols.append(pa.array(np.diff(off)))
                    cols.append(pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()))
                    cols.append(pa.array(codec.round_trips(texts, ids, at)))
                else:
                    cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32())))
                yield pa.record_batch(cols, names=names)
        K.tidy()

    return documents.select(*carry, "text").mapInArrow(run, T.StructType(fields))


def decode(tokens: DataFrame, carry: list[str], model: str = MODEL) -> DataFrame:
    """``carry`` columns and the text of each row's ``ids``; null ids give a null text."""
    with open(model, "rb") as f:
        shared, name = tokens.sparkSession.sparkContext.broadcast(f.read()), uuid.uuid4().hex
    schema = T.StructType([tokens.schema[c] for c in carry] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, shared)
        for b in batches:
            rows = b.column(len(carry)).to_pylist()
            text = pa.array([None if r is None else codec.decode(np.array(r, np.int32)) for r in rows], pa.string())
            yield pa.record_batch([*(b.column(i) for i in range(len(carry))), text], names=schema.names)

    return tokens.select(*carry, "ids").mapInArrow(run, schema)


def encode_query(documents: DataFrame) -> DataFrame:
    return encode(documents, ["doc_id"], digest=True)
