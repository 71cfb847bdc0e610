"""SentencePiece encoding and decoding by a batched Viterbi over numpy arrays.

Words of equal length advance together, one end position at a time. Hashes of all substrings
that end there probe the sorted piece keys, and the maximum over the pieces that end there is
stored with its back pointer. For a unigram model the maximum is that of the summed scores. For
a BPE model it is taken over the pieces that merging could leave side by side, of which exactly
one remains at each end: pieces s and t stay apart just when merging their joint text gives s
and t again, and a sequence is the model's own just when all its neighbours stay apart.

Longer words are cut where no piece holds the two characters around the cut, and filled up to a
common length, which changes nothing before the filling. Very long ones become many rows of equal
length that overlap: what ends at a position depends on the last few ends before it alone, so two
rows that agree on those agree from there on. Where they don't, the later row is computed again
from the earlier one's ends.

Not supported, load() raises: a normalisation map, removal of extra white space (both defaults of
trained models), no dummy prefix, unescaped white space or white space as suffix, user-defined
pieces, and pieces that cross words.

Defined results: null and empty texts have no ids and decode to the empty text; characters
outside the vocabulary become byte pieces, or the unknown id where a model has none; strings of
control pieces in a text are ordinary text; no begin or end ids are added; repeated rows are
encoded each; columns other than id and text are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices
from .counts import default_model, pretokens, splits_safely
from .kernel import mix

SPACE = "▁"
#: Words in a worker's cache; longer words are encoded each time.
CACHE, LONGEST = 160_000, 64
#: Words up to EXACT characters advance with those of equal length, others with those of a similar one.
EXACT, GROWTH = 20, 1.15
#: Longer words are computed in overlapping rows: own characters of a row, and those before them in
#: multiples of the longest piece.
STEP, OVERLAP = 480, 6
#: Rows computed at a time.
ROWS = 2048
_NONE, _FILL = -1, 0x10FFFF + 1
_EMPTY = np.empty(0, np.int32)
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    with np.errstate(over="ignore"):
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(max(n, 2), b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x)[:n])
    return out[0], out[1]


def _weights(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(0xABCDEF))


@dataclass
class Pieces:
    """A vocabulary as arrays. left, right: the last merge that makes a piece, or -1."""

    pieces: list[str]
    scores: np.ndarray
    bpe: bool
    byte_ids: np.ndarray
    unknown: int
    dummy_prefix: bool
    keys: np.ndarray
    key_ids: np.ndarray
    longest: int
    left: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    right: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    rank: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    usable: np.ndarray = field(default_factory=lambda: np.empty(0, bool))
    pair_keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    pair_ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    odd: np.ndarray = field(default_factory=lambda: np.empty(0, bool))
    inner: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # neighbours inside pieces, sorted


def hash_strings(texts: list[str]) -> np.ndarray:
    out = np.empty(len(texts), np.uint64)
    pow_, _ = _powers(max(map(len, texts), default=1) + 1)
    with np.errstate(over="ignore"):
        for k, t in enumerate(texts):
            c = _weights(np.frombuffer(t.encode("utf-32-le"), np.uint32))
            out[k] = (c * pow_[: len(c)]).sum(dtype=np.uint64)
    return out


def merge(text: str, rank: dict[str, int]) -> tuple[list[str], dict[str, tuple[str, str]]]:
    """Plain BPE of a short text: the best pair, leftmost of equals, until none is a piece."""
    parts, made = list(text), {}
    while len(parts) > 1:
        best, at = None, -1
        for k in range(len(parts) - 1):
            r = rank.get(parts[k] + parts[k + 1])
            if r is not None and (best is None or r < best):
                best, at = r, k
        if best is None:
            break
        made[parts[at] + parts[at + 1]] = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts, made


def load(path: str) -> Pieces:
    """Read a model file and work out how its pieces come about."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models without normalisation, and with a dummy prefix, are supported")
    kinds = pb.ModelProto.SentencePiece
    pieces, scores = [p.piece for p in proto.pieces], np.array([p.score for p in proto.pieces])
    normal = np.array([p.type in (kinds.NORMAL, kinds.USER_DEFINED) for p in proto.pieces])
    if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
        raise ValueError("user-defined pieces aren't supported")
    byte_ids = np.full(256, -1, np.int64)
    for k, p in enumerate(proto.pieces):
        if p.type == kinds.BYTE:
            byte_ids[int(p.piece[3:5], 16)] = k
    if not splits_safely([x for x, ok in zip(pieces, normal) if ok]):
        raise ValueError("a piece of this model crosses words")
    ids = np.flatnonzero(normal)
    keys = hash_strings([pieces[k] for k in ids])
    order = np.argsort(keys)
    bpe = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
    out = Pieces(pieces, scores, bpe, byte_ids, proto.trainer_spec.unk_id, spec.add_dummy_prefix, keys[order], ids[order], max(len(pieces[k]) for k in ids))
    if bpe:
        _merges(out, ids)
    pairs = {ord(a) << 21 | ord(b) for k in ids for a, b in zip(pieces[k], pieces[k][1:])}
    out.inner = np.array(sorted(pairs), np.int64)
    return out


def _merges(v: Pieces, ids: np.ndarray) -> None:
    n = len(v.pieces)
    of = {v.pieces[k]: int(k) for k in ids}
    # Rank by score, best first; single characters are there from the start.
    order = ids[np.lexsort((ids, -v.scores[ids]))]
    v.rank = np.full(n + 1, -1, np.int64)
    v.rank[order] = np.arange(len(order))
    rank = {v.pieces[k]: int(v.rank[k]) for k in ids}
    v.left, v.right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    v.usable, v.odd = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    pairs = []
    for text, k in of.items():
        for c in range(1, len(text)):
            a, b = of.get(text[:c]), of.get(text[c:])
            if a is not None and b is not None:
                pairs.append((a << 20 | b, k))
        parts, made = merge(text, rank)
        v.usable[k] = len(parts) == 1
        if len(text) > 1 and len(parts) == 1:
            a, b = made[text]
            v.left[k], v.right[k] = of[a], of[b]
            # Merges must come later than those below them for the walk in stay_apart().
            v.odd[k] = any(len(x) > 1 and (v.rank[of[x]] > v.rank[k] or v.odd[of[x]]) for x in (a, b))
    for text, k in sorted(of.items(), key=lambda x: len(x[0])):
        v.odd[k] |= any(x >= 0 and v.odd[x] for x in (v.left[k], v.right[k]))
        if len(text) == 1:
            v.rank[k] = -1
    pairs.sort()
    v.pair_keys, v.pair_ids = (np.array([p[c] for p in pairs], np.int64) for c in (0, 1))


def stay_apart(v: Pieces, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether merging the joint text of the pieces s and t gives s and t again.

    Undoes the later of the two last merges again and again, and looks whether the pieces that
    then face each other would have merged before they were used up.
    """
    a, b = s.copy(), t.copy()
    never = np.int64(1 << 40)
    lim_a, lim_b = np.full(len(s), never), np.full(len(s), never)
    ok, live = np.ones(len(s), bool), np.flatnonzero((s >= 0) & (t >= 0))
    while len(live):
        key = a[live] << 20 | b[live]
        at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
        hit = v.pair_keys[at] == key
        r = np.where(hit, _piece_rank(v, v.pair_ids[at]), never)
        bad = hit & (r < lim_a[live]) & (r <= lim_b[live])
        ok[live[bad]] = False
        live = live[~bad]
        ra, rb = v.rank[a[live]], v.rank[b[live]]
        done = (ra < 0) & (rb < 0)
        live, ra, rb = live[~done], ra[~done], rb[~done]
        first = ra > rb  # on a tie the right one merged later
        i, j = live[first], live[~first]
        lim_a[i] = v.rank[a[i]]
        a[i] = v.right[a[i]]
        lim_b[j] = v.rank[b[j]]
        b[j] = v.left[b[j]]
    for k in np.flatnonzero(v.odd[s] | v.odd[t]):
        if s[k] >= 0 and t[k] >= 0:
            ok[k] = _apart_plainly(v, int(s[k]), int(t[k]))
    return ok


def _piece_rank(v: Pieces, ids: np.ndarray) -> np.ndarray:
    return v.rank[ids]


def _apart_plainly(v: Pieces, s: int, t: int) -> bool:
    rank = {p: int(r) for p, r in zip(v.pieces, v.rank[:-1]) if r >= 0}
    return merge(v.pieces[s] + v.pieces[t], rank)[0] == [v.pieces[s], v.pieces[t]]


class _PairCache:
    """stay_apart() with a direct-mapped memory of earlier answers."""

    def __init__(self, v: Pieces, bits: int = 19):
        self.v, self.bits = v, bits
        self.keys, self.answers = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool)

    def ask(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        key = s << 20 | t
        slot = (mix(key.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != key)
        out = self.answers[slot]
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            got = stay_apart(self.v, new >> 20, new & ((1 << 20) - 1))
            out[miss] = got[back]
            at = slot[miss]
            self.keys[at], self.answers[at] = key[miss], out[miss]
            # Two keys of one slot: keep the answer that belongs to the key that stayed.
            self.answers[at] = np.where(self.keys[at] == key[miss], out[miss], self.answers[at])
            clash = self.keys[at] != key[miss]
            if clash.any():
                self.keys[at[clash]] = -1
        return out


class Encoder:
    """Ids of words, many at a time."""

    def __init__(self, v: Pieces):
        self.v, self.pairs = v, _PairCache(v) if v.bpe else None
        # The upper bits of the keys rule out most substrings before the search.
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(v.keys >> np.uint64(44)).astype(np.int64)] = True

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word. A word is a string of characters with spaces as SPACE."""
        done: list[np.ndarray] = [_EMPTY] * len(words)
        exact: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            exact.setdefault(min(len(w), EXACT + 1), []).append(k)
        longer = exact.pop(EXACT + 1, [])
        exact.pop(0, None)
        for n, rows in exact.items():
            step = (1 << 20) // n
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                codes = np.frombuffer("".join([words[k] for k in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
                for k, ids in zip(part, self._trace(codes, np.full(len(part), n), *self._ends(codes))):
                    done[k] = ids
        for k, ids in zip(longer, self._longer([words[k] for k in longer])):
            done[k] = ids
        return done

    def _longer(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of more than EXACT characters."""
        out: list[list[np.ndarray]] = [[] for _ in words]
        by_size: dict[int, list[tuple[int, int]]] = {}
        for k, w in enumerate(words):
            for part in self._cut(np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)):
                if len(part):
                    at = len(out[k])
                    out[k].append(part)
                    by_size.setdefault(self._room(len(part)), []).append((k, at))
        for n, rows in by_size.items():
            if n > 2 * STEP:
                for k, at in rows:
                    out[k][at] = self._long(out[k][at])
                continue
            step = max(1, (1 << 20) // n)
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                codes = np.full((len(part), n), _FILL, np.uint32)
                size = np.array([len(out[k][at]) for k, at in part])
                codes[np.arange(n) < size[:, None]] = np.concatenate([out[k][at] for k, at in part])
                last, back = self._ends(codes)
                for (k, at), ids in zip(part, self._trace(codes, size, last, back)):
                    out[k][at] = ids
        # Characters without a piece are one unknown id where several meet, also over a cut.
        return [self._join(x) for x in out]

    @staticmethod
    def _room(n: int) -> int:
        return n if n <= EXACT else int(np.ceil(EXACT * GROWTH ** np.ceil(np.log(n / EXACT) / np.log(GROWTH) - 1e-9)))

    def _cut(self, codes: np.ndarray) -> list[np.ndarray]:
        """The word in parts that no piece joins."""
        pair = codes[:-1].astype(np.int64) << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.v.inner, pair), len(self.v.inner) - 1)
        free = self.v.inner[at] != pair if len(self.v.inner) else np.ones(len(pair), bool)
        # Short parts stay together: only every cut after EXACT characters is made.
        cuts, edge = [0], 0
        for c in (np.flatnonzero(free) + 1).tolist():
            if c - edge >= EXACT:
                cuts.append(c)
                edge = c
        return [codes[a:b] for a, b in zip(cuts, [*cuts[1:], len(codes)])]

    def _join(self, parts: list[np.ndarray]) -> np.ndarray:
        if len(parts) < 2:
            return parts[0] if parts else np.empty(0, np.int32)
        ids = np.concatenate(parts)
        if self.v.byte_ids[0] < 0:
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == self.v.unknown) & (ids[:-1] == self.v.unknown)
            ids = ids[~again]
        return ids

    def _long(self, codes: np.ndarray) -> np.ndarray:
        """Ids of one long word, by overlapping rows of equal length."""
        v, n = self.v, len(codes)
        over, deep = OVERLAP * v.longest, v.longest
        if not v.bpe:  # sums of scores don't settle in this way
            last, back = self._ends(codes[None])
            return self._trace(codes[None], np.array([n]), last, back)[0]
        rows = -(-max(n - over, 1) // STEP)

        def computed(first: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
            """ROWS rows from the first on, each begun `shift` characters early."""
            table = np.full((min(ROWS, rows - first), STEP + over + shift), _FILL, np.uint32)
            for k in range(len(table)):
                at = (first + k) * STEP
                part = codes[max(0, at - shift) : at + STEP + over]
                table[k, : len(part)] = part
            return self._ends(table)

        def agrees(last: np.ndarray, k: int, shift: int) -> bool:
            edge = over + shift + 1
            return np.array_equal(last[edge - deep : edge], ends[k * STEP + over + 1 - deep : k * STEP + over + 1])

        ends, starts, done = np.empty(n + 1, np.int32), np.empty(n + 1, np.int32), {}
        for k in range(rows):
            if k % ROWS == 0:
                first, done = k, {0: computed(k, 0)}
            lo, hi = (0 if k == 0 else over + 1), min(STEP + over, n - k * STEP)
            shift = next((s for s in done if not k or agrees(done[s][0][:, k - first], k, s)), None)
            if shift is None:  # runs of one pattern agree when begun at its own places
                tries = np.stack([np.concatenate((codes[k * STEP - s : k * STEP + over], np.full(deep - s, _FILL, np.uint32))) for s in range(deep)])
                last, _ = self._ends(tries)
                shift = next((s for s in range(deep) if s not in done and agrees(last[:, s], k, s)), None)
                if shift is not None:
                    done[shift] = computed(first, shift)
            if shift is None:
                last, back = self._ends(codes[None, k * STEP : k * STEP + STEP + over], ends[k * STEP : k * STEP + over + 1])
                mine, from_, shift = last[:, 0], back[:, 0], 0
            else:
                done = {shift: done.pop(shift)} | done  # the one that served last comes first
                mine, from_ = (x[:, k - first] for x in done[shift])
            ends[k * STEP + lo : k * STEP + hi + 1] = mine[lo + shift : hi + shift + 1]
            starts[k * STEP + lo : k * STEP + hi + 1] = from_[lo + shift : hi + shift + 1] + (k * STEP - shift)
        return self._trace(codes[None], np.array([n]), ends[:, None], starts[:, None])[0]

    def _ends(self, codes: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each end position and row the piece that ends there, and where it starts.

        known: what ends at the first positions of the only row, which then goes on from there.
        """
        v, (rows, n) = self.v, codes.shape
        pow_, inv = _powers(n + 1)
        run = np.zeros((n + 1, rows), np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((_weights(codes.ravel()).reshape(rows, n) * pow_[:n]).T, axis=0, out=run[1:])
        last = np.full((n + 1, rows), _NONE, np.int64)  # the piece that ends here; _NONE: bytes
        back = np.zeros((n + 1, rows), np.int32)
        best = np.full((n + 1, rows), -np.inf)
        best[0] = 0
        floor = float(v.scores.min()) - 10
        begin = 1
        if known is not None:
            begin = len(known)
            last[:begin, 0] = known
            best[:begin] = 0
        for end in range(begin, n + 1):
            top = np.full(rows, -np.inf)
            for size in range(min(end, v.longest), 0, -1):
                start = end - size
                with np.errstate(over="ignore"):
                    h = (run[end] - run[start]) * inv[start]
                found = np.flatnonzero(self.likely[h >> np.uint64(44)])
                at = np.minimum(np.searchsorted(v.keys, h[found]), len(v.keys) - 1)
                hit = v.keys[at] == h[found]
                found, at = found[hit], at[hit]
                if not len(found):
                    continue
                ids = v.key_ids[at]
                if v.bpe:
                    open_ = v.usable[ids] & (top[found] == -np.inf)
                    found, ids = found[open_], ids[open_]
                    before = last[start, found]
                    fits = np.ones(len(found), bool)
                    if start:
                        ask = np.flatnonzero(before >= 0)
                        fits[ask] = self.pairs.ask(before[ask], ids[ask])
                    value = np.where(fits, 0.0, -np.inf)
                else:
                    value = best[start, found] + v.scores[ids]
                more = value > top[found]
                rows_, ids = found[more], ids[more]
                top[rows_] = value[more]
                last[end, rows_] = ids
                back[end, rows_] = start
            lone = np.flatnonzero(top == -np.inf)  # a character that no piece holds
            if not v.bpe:
                weak = best[end - 1] + floor > top
                lone = np.flatnonzero(weak)
            if len(lone):
                top[lone] = best[end - 1, lone] + (0 if v.bpe else floor)
                last[end, lone] = _NONE
                back[end, lone] = end - 1
            best[end] = top
        return last, back

    def _trace(self, codes: np.ndarray, size: np.ndarray, last: np.ndarray, back: np.ndarray) -> list[np.ndarray]:
        rows, n = codes.shape
        path = np.full((n, rows), -2, np.int64)  # ids at the positions where they end
        at, live = size.copy(), np.arange(rows)
        if rows == 1:  # one long word: a step for each piece
            ends, starts, e = last[:, 0].tolist(), back[:, 0].tolist(), int(size[0])
            while e > 0:
                path[e - 1, 0], e = ends[e], starts[e]
            live = live[:0]
        while len(live):
            path[at[live] - 1, live] = last[at[live], live]
            at[live] = back[at[live], live]
            live = live[at[live] > 0]
        plain = (path != _NONE).all(axis=0)
        columns = np.ascontiguousarray(path.T)
        used = columns != -2
        all_ids, bounds = columns[used].astype(np.int32), np.concatenate(([0], np.cumsum(used.sum(axis=1)))).tolist()
        out = [all_ids[a:b] for a, b in zip(bounds, bounds[1:])]
        for k in np.flatnonzero(~plain).tolist():
            flat: list[int] = []
            for e, i in zip(np.flatnonzero(used[k]).tolist(), out[k].tolist()):
                flat += [i] if i != _NONE else self._bytes(chr(codes[k, e]), flat)
            out[k] = np.array(flat, np.int32)
        return out

    def _bytes(self, c: str, before: list[int]) -> list[int]:
        v = self.v
        if v.byte_ids[0] >= 0:
            return [int(v.byte_ids[b]) for b in c.encode("utf-8", "surrogatepass")]
        # Neighbouring unknown characters are one id.
        return [] if before and before[-1] == v.unknown else [v.unknown]


class Decoder:
    """Texts of ids."""

    def __init__(self, v: Pieces):
        self.parts = [p.replace(SPACE, " ").encode() for p in v.pieces]
        for b in range(256):
            if v.byte_ids[b] >= 0:
                self.parts[v.byte_ids[b]] = bytes([b])
        self.parts[v.unknown] = " ⁇ ".encode()
        self.dummy, self.raw = v.dummy_prefix, frozenset(v.byte_ids[v.byte_ids >= 0].tolist())

    def text(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.parts.__getitem__, ids.tolist()))
        if self.dummy and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _as_word(key: str) -> str:
    """The characters that a pre-token stands for, with its leading space back."""
    return key.replace(" ", SPACE) if key[:1] == "\n" else SPACE + key.replace(" ", SPACE)


class _Cache(dict):
    """Ids of pre-tokens as bytes of 32-bit numbers, in two generations of bounded size."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def texts(self, texts: list[str]) -> list[bytes]:
        parts = [pretokens(t) for t in texts]
        new = set().union(*parts).difference(self)
        if len(self) + len(new) > CACHE:
            self.older = dict(self)
            self.clear()
            new = set().union(*parts)
        again = [k for k in new if k in self.older]
        self.update(zip(again, map(self.older.__getitem__, again)))
        fresh = list(new.difference(again))
        self.update(zip(fresh, (x.tobytes() for x in self.encoder.words([_as_word(k) for k in fresh]))))
        out = [b"".join(map(self.__getitem__, p)) for p in parts]
        for k in fresh:
            if len(k) > LONGEST:
                del self[k]
        return out


_workers: dict[str, tuple[_Cache, Decoder]] = {}


def _tools(key: str, v: Pieces) -> tuple[_Cache, Decoder]:
    if key not in _workers:
        _workers.clear()
        _workers[key] = (_Cache(Encoder(v)), Decoder(v))
    return _workers[key]


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every whole text."""
    return _run(docs, model, id_col, text_col, False).select("doc_id", "ids")


def round_trip(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256, and whether decoding the ids gave the text back."""
    return _run(docs, model, id_col, text_col, True)


def _run(docs: DataFrame, model: str | None, id_col: str, text_col: str, decode_too: bool) -> DataFrame:
    bound_batches(docs.sparkSession)
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(load(model or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, decoder = _tools(key, sent.value)
        for batch in slices(batches, "text", 6 << 20):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            ids = cache.texts(texts)
            sizes = np.array([len(x) // 4 for x in ids])
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            cols = [batch.column(batch.schema.get_field_index("doc_id")), pa.ListArray.from_arrays(offsets, flat), pa.array(sizes)]
            if decode_too:
                back = [decoder.text(np.frombuffer(x, np.int32)) for x in ids]
                cols += [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]), pa.array([a.replace(SPACE, " ") == b for a, b in zip(texts, back)])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256", "exact"][: len(cols)])

    kinds = "doc_id long, ids array<int>, n_tokens long" + ", ids_sha256 string, decoded_sha256 string, exact boolean" * decode_too
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kinds)


def decode(rows: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every list of ids; a null list gives the empty text."""
    sent = rows.sparkSession.sparkContext.broadcast(load(model or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            texts = [decoder.text(np.asarray(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else np.empty(0, np.int32)) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
