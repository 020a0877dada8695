"""SentencePiece encoding and decoding: the n best segmentations of a text.

The lattice of a text has an edge for each vocabulary piece that occurs in it, and one for each
character that is no piece itself, made of byte pieces. No piece reaches over the place before a
run of spaces, nor over a character that no longer piece has, so that the lattice falls into units
that repeat all through a corpus; those of a slice are solved together and once. A forward Viterbi
pass gives each place's best score; together with the backward one it also tells how much a unit's
second best path loses. The n - 1 units of a text that lose least can change in its n best paths
and no others: for these an A-star search runs backward through the unit's lattice, with the forward
scores as its exact heuristic, and sums of the losses rank the text's segmentations.

Spaces are U+2581 inside, with one in front of the text, as the vocabulary wants it.

A unigram model's file has log probabilities, and they are what paths sum up. A BPE model's file has
the ranks of its merges instead, whose sums mean nothing: there a piece of rank r counts as having the
probability (r + SHIFT) ** -1 / Z, Zipf's law over the ranks, so that a path's score is a log
probability, few pieces beat many, and frequent ones beat rare ones. Nothing is trained on the texts. The library's own
encoder follows the merges greedily; the best path agrees with it on most words, not on all.

Defined cases: null and empty texts have no pieces, score 0 and no alternatives; U+2581 in a text
decodes as a space; invalid ids decode to nothing; of equally good paths the one with the longest
last pieces comes first; repeated rows are encoded each; extra columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches
from .textbatch import BYTE_VALUES, mix, powers, slices, tidy

SPACE = "▁".encode()
_P, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_TABLE_BITS = 21
NONE = -1e18
#: Rank 0 is so much less frequent than a bare power law has it.
SHIFT = 100.0
#: Paths of units up to this many bytes are kept.
KEPT_BYTES = 256


def is_ranks(scores: np.ndarray) -> bool:
    """Whether the scores are whole numbers, none twice but for the pieces that no merge makes."""
    merged = scores[scores > -1e8]
    return bool((merged == np.round(merged)).all() and len(np.unique(merged)) == len(merged) > 1)


def zipf(ranks: np.ndarray) -> np.ndarray:
    """Log probabilities by Zipf's law."""
    weight = 1 / (ranks + SHIFT)
    return np.log(weight / weight.sum())


class Vocabulary:
    """Pieces by hash, in tables that whole arrays of substrings are looked up in."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.byte_id = np.zeros(256, np.int32)
        self.surface: list[bytes] = [b""] * self.size
        self.ids: dict[bytes, int] = {}
        self.scores = np.zeros(self.size)
        for i in range(self.size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[value] = i
                self.surface[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i).encode()
                self.surface[i], self.ids[piece], self.scores[i] = piece, i, model.get_score(i)
        own = np.array(sorted(self.ids.values()), np.int64)
        if len(own) and is_ranks(self.scores[own]):
            ranks = -self.scores[own]
            last = ranks[ranks < 1e8].max() + 1
            self.scores[own] = zipf(np.minimum(ranks, last))
        #: n-best paths of units that came before
        self.known: dict[tuple[bytes, int], list] = {}
        low = self.scores[own].min() if len(own) else 0.0
        self.fallback = low - 10.0
        self.longest = max(map(len, self.ids), default=1)
        # bytes that a longer piece may hold; at others a text can be cut
        self.inside = np.zeros(256, bool)
        for piece in self.ids:
            if len(piece) > 1:
                self.inside[list(piece)] = True
        self._tables()
        sizes = np.fromiter(map(len, self.surface), np.int64, self.size)
        self.out_at, self.out_n = np.cumsum(sizes) - sizes, sizes
        self.out = np.frombuffer(b"".join(self.surface), np.uint8)

    def _tables(self) -> None:
        prefixes: dict[bytes, int] = {}
        for piece, i in self.ids.items():
            for n in range(1, len(piece)):
                prefixes.setdefault(piece[:n], -1)
            prefixes[piece] = i
        keys = hash_of(list(prefixes))
        assert len(np.unique(keys)) == len(keys), "two prefixes share a hash"
        self.key = np.zeros(1 << _TABLE_BITS, np.uint64)
        self.piece = np.full(1 << _TABLE_BITS, -2, np.int32)
        spot = (keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        values = np.fromiter(prefixes.values(), np.int32, len(prefixes))
        left = np.arange(len(keys))
        while len(left):  # linear probing, all keys at once
            at = spot[left]
            free = self.piece[at] == -2
            one = np.unique(at[free], return_index=True)[1]
            put = left[free][one]
            self.key[spot[put]], self.piece[spot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put)
            spot[left] = np.where(self.piece[spot[left]] != -2, (spot[left] + 1) % (1 << _TABLE_BITS), spot[left])

    def nbest(self, unit: bytes, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """`nbest_unit`, kept for short units: most come again."""
        got = self.known.get((unit, n))
        if got is None:
            got = nbest_unit(unit, n, self)
            if len(unit) <= KEPT_BYTES:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[unit, n] = got
        return got

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Id of each substring; -1 for a mere prefix of a piece, -2 for none."""
        spot = (keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        out = self.piece[spot]
        open_ = np.flatnonzero((out != -2) & (self.key[spot] != keys))
        while len(open_):
            spot[open_] = (spot[open_] + 1) % (1 << _TABLE_BITS)
            out[open_] = self.piece[spot[open_]]
            open_ = open_[(out[open_] != -2) & (self.key[spot[open_]] != keys[open_])]
        return out


def _sums(buf: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[buf] * powers(_P, len(buf)), out=sums[1:])
    return sums


def hash_of(strings: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b"".join(strings), np.uint8)
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    end = np.cumsum(n)
    return mix((_sums(buf)[end] - _sums(buf)[end - n]) * powers(_INVERSE, len(buf) + 1)[end - n])


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary_at(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def nbest_unit(unit: bytes, n: int, v: Vocabulary) -> list[tuple[float, tuple[int, ...]]]:
    """The n best (score, ids) of one unit: Viterbi forward, A-star backward."""
    size = len(unit)
    into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
    best = [NONE] * (size + 1)
    best[0] = 0.0
    for a in range(size):
        if unit[a] & 0xC0 == 0x80 or best[a] == NONE:
            continue
        one = a + 1
        while one < size and unit[one] & 0xC0 == 0x80:
            one += 1
        edges = [(b, float(v.scores[i]), (i,)) for b in range(a + 1, min(size, a + v.longest) + 1) if (i := v.ids.get(unit[a:b])) is not None]
        if not any(b == one for b, _, _ in edges):
            edges.append((one, v.fallback * (one - a), tuple(int(v.byte_id[c]) for c in unit[a:one])))
        for b, score, ids in edges:
            into[b].append((a, score, ids))
            best[b] = max(best[b], best[a] + score)
    found, tick = [], 0
    # among equals, but for rounding, what is nearest to the start goes first: ties are never all opened
    heap = [(-round(best[size], 8), size, 0, 0.0, None)]
    while heap and len(found) < n:
        _, at, _, behind, path = heapq.heappop(heap)
        if at == 0:
            ids: list[int] = []
            while path:
                ids += path[0]
                path = path[1]
            found.append((behind, tuple(ids)))
            continue
        for a, score, ids in sorted(into[at]):
            tick += 1
            heapq.heappush(heap, (-round(best[a] + score + behind, 8), a, tick, score + behind, (ids, path)))
    return found


def lattice(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, v: Vocabulary):
    """Edges (start, end, id or -1 for bytes, score) of all units, which lie apart in `buf`."""
    sums = _sums(buf)
    inverse = powers(_INVERSE, len(buf) + 1)
    last = np.repeat(ends, ends - begins)
    pos = np.concatenate([[0], np.cumsum(ends - begins)])[:-1]
    pos = np.arange(int((ends - begins).sum())) - np.repeat(pos - begins, ends - begins)
    first_byte = (buf[pos] & 0xC0) != 0x80
    pos, last = pos[first_byte].astype(np.int32), last[first_byte].astype(np.int32)
    lead = buf[pos]
    width = np.minimum(1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), last - pos)
    alone = np.zeros(len(buf), bool)
    parts = []
    act, act_last = pos, last
    for n in range(1, v.longest + 1):
        fits = act + n <= act_last
        act, act_last = act[fits], act_last[fits]
        if not len(act):
            break
        got = v.look_up(mix((sums[act + n] - sums[act]) * inverse[act]))
        piece = got >= 0
        parts.append((act[piece], act[piece] + n, got[piece]))
        alive = got != -2
        act, act_last = act[alive], act_last[alive]
    start, end, ids = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32),) * 3
    wide = np.zeros(len(buf), np.int32)
    wide[pos] = width
    alone[start[end - start == wide[start]]] = True
    bare = pos[~alone[pos]]
    start = np.concatenate((start, bare))
    end = np.concatenate((end, bare + wide[bare]))
    score = np.concatenate((v.scores[ids], v.fallback * wide[bare]))
    ids = np.concatenate((ids, np.full(len(bare), -1, np.int32)))
    return start, end.astype(np.int32), ids.astype(np.int32), score


def _passes(key: np.ndarray, other: np.ndarray, score: np.ndarray, step: np.ndarray, n: int, roots: np.ndarray, edges: bool = True):
    """Best score to each place `key` from `other`, in rounds of `step`; with `edges` the edge that gives it."""
    order = np.argsort(step * np.int64(n) + key, kind="stable")
    key, other, score, step = key[order], other[order], score[order], step[order]
    best = np.full(n, NONE)
    best[roots] = 0.0
    by = np.full(n, -1, np.int64)
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    bounds = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1], [True]))) if len(key) else np.zeros(1, np.int64)
    head_cut = np.searchsorted(head, bounds)
    for r in range(len(bounds) - 1):
        a, b = bounds[r], bounds[r + 1]
        h = head[head_cut[r] : head_cut[r + 1]] - a
        cand = best[other[a:b]] + score[a:b]
        top = np.maximum.reduceat(cand, h)
        spot = key[a:b]
        best[spot[h]] = top
        if not edges:
            continue
        size = np.diff(np.append(h, b - a))
        hit = np.flatnonzero(cand == np.repeat(top, size))
        by[spot[hit[::-1]]] = order[a:b][hit[::-1]]
    return best, by


def solve(units: list[bytes], v: Vocabulary):
    """Best path of each unit: (ids, where each unit's begin, score, loss of the second best path)."""
    if not units:
        return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0), np.zeros(0)
    size = np.fromiter(map(len, units), np.int64, len(units))
    buf = np.frombuffer(b"\0".join(units) + b"\0", np.uint8)
    begins = np.cumsum(size + 1) - size - 1
    ends = begins + size
    start, end, ids, score = lattice(buf, begins, ends, v)
    # longer pieces first among equals
    order = np.argsort(start - end, kind="stable")
    start, end, ids, score = start[order], end[order], ids[order], score[order]
    base = np.zeros(len(buf) + 1, np.int32)
    base[:-1] = np.repeat(begins, size + 1)
    tail = np.zeros(len(buf) + 1, np.int32)
    tail[:-1] = np.repeat(ends, size + 1)
    fore, by = _passes(end, start, score, end - base[start], len(buf) + 1, begins)
    back, _ = _passes(start, end, score, tail[start] - start, len(buf) + 1, ends, edges=False)
    on_path = np.zeros(len(start), bool)
    at = ends[size > 0]
    unit = np.flatnonzero(size > 0)
    owners, edges = [], []
    while len(at):
        edge = by[at]
        on_path[edge] = True
        owners.append(unit)
        edges.append(edge)
        at = start[edge]
        more = at > begins[unit]
        at, unit = at[more], unit[more]
    owners, edges = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, edges))
    order = np.lexsort((start[edges], owners))
    owners, edges = owners[order], edges[order]
    top = fore[ends]
    loss = np.full(len(units), np.inf)
    unit_of = np.zeros(len(buf) + 1, np.int32)
    unit_of[:-1] = np.repeat(np.arange(len(units)), size + 1)
    off = np.flatnonzero(~on_path & (fore[start] > NONE / 2) & (back[end] > NONE / 2))
    owner = unit_of[start[off]]
    np.minimum.at(loss, owner, top[owner] - fore[start[off]] - score[off] - back[end[off]])
    # an edge of bytes stands for as many ids as it has bytes
    got = ids[edges]
    many = np.where(got < 0, end[edges] - start[edges], 1)
    cut = np.cumsum(many) - many
    flat = np.repeat(got, many).astype(np.int64)
    bytes_at = np.flatnonzero(flat < 0)
    within = bytes_at - np.repeat(cut, many)[bytes_at]
    flat[bytes_at] = v.byte_id[buf[np.repeat(start[edges], many)[bytes_at] + within]]
    count = np.bincount(owners, many, len(units)).astype(np.int64)
    return flat.astype(np.int32), np.concatenate(([0], np.cumsum(count))), top, np.maximum(loss, 0)


def units_of(texts: list[bytes], v: Vocabulary):
    """(buffer, unit begins, ends, where each text's units begin and at last their number)."""
    ready = [SPACE + t.replace(b" ", SPACE) if t else b"" for t in texts]
    size = np.fromiter(map(len, ready), np.int64, len(ready))
    starts = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(ready) + b"\0", np.uint8)
    n = len(buf) - 1
    cut = np.zeros(n + 1, bool)
    cut[starts] = cut[n] = True
    if n:
        space = np.zeros(n + 1, bool)
        space[: n - 2] = (buf[: n - 2] == SPACE[0]) & (buf[1 : n - 1] == SPACE[1]) & (buf[2:n] == SPACE[2]) if n > 2 else False
        after = np.zeros(n + 1, bool)
        after[3:] = space[:-3]
        cut |= space & ~after
        alone = ~v.inside[buf[:n]] & (buf[:n] < 0x80)  # a character no longer piece has
        cut[:n] |= alone
        cut[1:] |= alone
    at = np.flatnonzero(cut)
    begins, ends = at[:-1], at[1:]
    return buf, begins, ends, np.append(np.searchsorted(begins, starts), len(begins))


def ranked(options: list[list[tuple[float, tuple[int, ...]]]], n: int):
    """The n best (loss, choice per option list); each list is sorted and starts with its best."""
    out = [(0.0, ())]
    for own in options:
        out = sorted(((loss + own[0][0] - x[0], (*picks, k)) for loss, picks in out for k, x in enumerate(own)), key=lambda y: y[0])[:n]
    return out


def segment(texts: list[bytes], n: int, v: Vocabulary):
    """For each text: (ids, score, alternatives); all ids in one array with where each text's begin."""
    buf, begins, ends, cut = units_of(texts, v)
    sums, inverse = _sums(buf), powers(_INVERSE, len(buf) + 1)
    keys = mix((sums[ends] - sums[begins]) * inverse[begins])
    import pandas as pd

    code, _ = pd.factorize(keys)
    first = np.zeros(code.max() + 1 if len(code) else 0, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    raw = buf.tobytes()
    units = [raw[a:b] for a, b in zip(begins[first].tolist(), ends[first].tolist())]
    ids, at, top, loss = solve(units, v)
    count = np.diff(at)[code] if len(code) else np.zeros(0, np.int64)
    flat_at = np.concatenate(([0], np.cumsum(count)))
    flat = ids[np.arange(flat_at[-1]) - np.repeat(flat_at[:-1] - at[code], count)] if len(code) else np.zeros(0, np.int32)
    scores = np.array([top[code[a:b]].sum() for a, b in zip(cut[:-1], cut[1:])])
    more = []
    for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
        own = loss[code[a:b]] if b > a else np.zeros(0)
        k = min(n - 1, len(own))
        picks = np.sort(np.argpartition(own, k - 1)[:k]) if k > 0 else []
        picks = [int(p) for p in picks if own[p] < np.inf]
        options = []
        for p in picks:
            options.append(v.nbest(units[code[a + p]], n))
        begin = flat_at[a]
        more.append(
            [
                {
                    "score": float(scores[i] - lost),
                    "edits": [
                        {"at": int(flat_at[a + p] - begin), "removed": int(count[a + p]), "ids": list(options[j][c][1])}
                        for j, (p, c) in enumerate(zip(picks, choice))
                        if c
                    ],
                }
                for lost, choice in ranked(options, n)[1:]
            ]
        )
    return flat, flat_at[cut], scores, more


def decode(ids: np.ndarray, cut: np.ndarray, v: Vocabulary) -> list[bytes]:
    """The texts of lists of ids that begin at `cut`."""
    ids = np.where((ids >= 0) & (ids < v.size), ids, 0)
    n = v.out_n[ids]
    end = np.cumsum(n)
    out = v.out[np.arange(end[-1] if len(end) else 0) - np.repeat(end - n - v.out_at[ids], n)].tobytes()
    at = np.concatenate(([0], end))[cut].tolist()
    return [out[a:b].replace(SPACE, b" ")[1:] for a, b in zip(at[:-1], at[1:])]


ALTERNATIVES = "array<struct<score: double, edits: array<struct<at: int, removed: int, ids: array<int>>>>>"
_EDIT = pa.struct([("at", pa.int32()), ("removed", pa.int32()), ("ids", pa.list_(pa.int32()))])
_ALTERNATIVES = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(_EDIT))]))


def encode_pieces(docs: DataFrame, model: str, n: int = 3) -> DataFrame:
    """Per row: doc_id, n_pieces, score, ids of the best segmentation, the n - 1 next ones, round_trip.

    An alternative is told by its edits: at `at`, `removed` ids of the best give way to `ids`.
    `model`: path of a SentencePiece model on every executor.
    """

    def run(batches):
        v = vocabulary_at(model)
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for first, end, texts in slices(batch, limit=3 << 19):
                flat, cut, score, more = segment(texts, n, v)
                back = decode(flat, cut, v)
                same = [a == b.replace(SPACE, b" ") for a, b in zip(back, texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, end - first),
                        pa.array(np.diff(cut)),
                        pa.array(score, pa.float64()),
                        pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat, pa.int32())),
                        pa.array(more, _ALTERNATIVES),
                        pa.array(same, pa.bool_()),
                    ],
                    names=["doc_id", "n_pieces", "score", "ids", "alternatives", "round_trip"],
                )

    return small_batches(docs).select("doc_id", "text").mapInArrow(tidy(run), f"doc_id long, n_pieces long, score double, ids array<int>, alternatives {ALTERNATIVES}, round_trip boolean")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id and the text; null ids give an empty text."""

    def run(batches):
        v = vocabulary_at(model)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            cut = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
            texts = decode(np.concatenate(lists) if lists else np.zeros(0, np.int64), cut, v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["doc_id", "text"])

    return small_batches(encoded).select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")
