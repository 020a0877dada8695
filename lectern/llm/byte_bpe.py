"""Byte-level BPE encoding and decoding, with an index of the places of each pair.

A slice of texts is cut into units (contractions, letters, numbers, other signs, white space). Units not
met before in the task are laid out one after another as symbols with links to both neighbours. An index
maps each mergeable pair, by its rank, to all its places in the slice. The active ranks, those that have places,
are taken in ascending order from a heap; a rank's merges are done at all its places at once, and only
the lists of the pairs beside them are extended. Merges make symbols that take part in later ranks only,
so ascending ranks over the slice give what unit after unit would give; a place that a merge has changed
since it was listed is told by its symbols. A unit without spaces of a million characters takes a
logarithmic factor more than linear time.

Decoding gathers the bytes of the ids and reads them as UTF-8, what isn't UTF-8 as U+FFFD.

Null texts count as empty and give no ids; null ids give an empty text. Ids that the vocabulary doesn't have are skipped.
Rows are dealt with one by one: repeated rows and ids, null doc_ids and columns of any other name make no
difference. An empty table gives no rows. No shuffle; a slice is 3 MB of texts, or one text.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from array import array
from collections import defaultdict
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textbatch import slices, tidy

#: How the vocabulary cuts texts into units; fixed, as its merges were learned on such units. `cuts_of` cuts so.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Contractions after an apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
#: Places up to which a rank's merges are done one by one; arrays pay off beyond.
FEW = 24
#: Bytes of texts whose places are indexed together.
SLICE = 3 << 20
#: Bytes of units that a task remembers at most.
KNOWN_BYTES = 4 << 20


def byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary's pieces: itself if it shows, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


@lru_cache(1)
def _newer() -> frozenset[str]:
    """Letters and numbers that this Python's tables don't know: libraries differ on what they are."""
    unknown = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    return frozenset(regex.findall(r"[\p{L}\p{N}]", unknown))


@lru_cache(1)
def _kinds() -> np.ndarray:
    """1 for letters, 2 for numbers, 3 for white space, 0 for all else, by code point."""
    out, every = np.zeros(sys.maxunicode + 1, np.uint8), "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))
    for kind, what in enumerate((r"\p{L}", r"\p{N}", r"\s"), 1):
        out[list(map(ord, regex.findall(what, every)))] = kind
    return out


def cuts_of(text: str) -> np.ndarray:
    """Where the units of a text begin, as UNITS finds them, and the text's end.

    Units are runs of one kind, before which a space goes along. Of white space before another run the last
    character stands alone, or goes along if it is a space. An apostrophe that begins a unit takes a contraction's letters.
    """
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n, kinds = len(points), _kinds()[points]
    starts = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
    word = starts[kinds[starts] != 3]
    spaced = (word > 0) & (points[word - 1] == 32)
    after_space = word[(word > 0) & ~spaced & (kinds[word - 1] == 3)] - 1  # white space that stands alone
    short = word[(points[word] == 39) & ~spaced]
    short = short[(short + 1 < n)]
    short = short[kinds[short + 1] == 1]
    moved, gone = [], []
    for p in short.tolist():  # few: apostrophes between letters
        for x in SUFFIXES:
            if text.startswith(x, p + 1):
                gone.append(p + 1)
                if p + 1 + len(x) < n and kinds[p + 1 + len(x)] == 1:
                    moved.append(p + 1 + len(x))
                break
    begins = np.zeros(n + 1, bool)
    begins[starts] = True
    begins[word[spaced]] = False
    begins[word[spaced] - 1] = begins[after_space] = True
    begins[gone] = False
    begins[moved] = True
    begins[n] = True
    return np.flatnonzero(begins)


class ByteBPE:
    """A vocabulary file's merges and pieces, with what the task has encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        vocab, merges = made["model"]["vocab"], made["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        letters = byte_letters()
        self.specials = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.of_byte = np.array([vocab[c] for c in letters], np.intc)
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): r for r, (a, b, _) in reversed(list(enumerate(self.merges)))}
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(self.rank.values()), np.int64)[order]
        byte_of = {c: i for i, c in enumerate(letters)}
        pieces = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for piece, i in [*vocab.items(), *self.specials.items()]:
            pieces[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.library = None
        self.path = path
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.unit_ids, self.unit_sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def units(self, text: str) -> list[str]:
        if not text.isascii() and not _newer().isdisjoint(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        if not text:
            return []
        at = cuts_of(text).tolist()
        return [text[a:b] for a, b in pairwise(at)]

    def _ranks_at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, -1 where there is none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, one after another, and how many each has); units aren't empty."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(units) else 0
        # arrays of the standard library, which plain code reads fast, under numpy's views
        symbols = array("i", self.of_byte[np.frombuffer(b"".join(units), np.uint8)].tobytes())
        after, before = np.arange(1, n + 1, dtype=np.intc), np.arange(-1, n - 1, dtype=np.intc)
        after[ends - 1], before[ends - lengths] = -1, -1
        after, before = array("i", after.tobytes()), array("i", before.tobytes())
        sym, nxt, prv = (np.frombuffer(x, np.intc) if n else np.zeros(0, np.intc) for x in (symbols, after, before))

        places: defaultdict[int, list[int]] = defaultdict(list)
        first = np.flatnonzero(nxt >= 0)
        ranks = self._ranks_at(sym[first], sym[nxt[first]])
        first, ranks = first[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        first, ranks = first[order], ranks[order]
        turns = np.flatnonzero(np.diff(ranks, prepend=-1))
        for r, own in zip(ranks[turns].tolist(), np.split(first, turns[1:])):
            places[r] = own.tolist()
        heap = list(places)
        heapq.heapify(heap)
        rank_of = self.rank.get
        while heap:
            r = heapq.heappop(heap)
            own = places.pop(r)
            left, right, new = self.merges[r]
            if len(own) <= FEW:
                touched = []
                for p in sorted(set(own)):
                    q = after[p]
                    if symbols[p] != left or q < 0 or symbols[q] != right:
                        continue
                    symbols[p], symbols[q] = new, -1
                    q = after[p] = after[q]
                    if q >= 0:
                        before[q] = p
                        touched.append(p)
                    if before[p] >= 0:
                        touched.append(before[p])
                for p in touched:
                    q = after[p]
                    got = rank_of((symbols[p], symbols[q])) if q >= 0 else None
                    if got is not None:
                        if got not in places:
                            heapq.heappush(heap, got)
                        places[got].append(p)
                continue
            at = _distinct(np.array(own, np.int64))
            there = (sym[at] == left) & (nxt[at] >= 0)
            at = at[there]
            at = at[sym[nxt[at]] == right]
            if left == right and len(at):  # of places in a row every other one, from the left
                starts = np.flatnonzero(np.append(True, nxt[at[:-1]] != at[1:]))
                at = at[(np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))) % 2 == 0]
            gone = nxt[at]
            sym[at], sym[gone] = new, -1
            far = nxt[gone]
            nxt[at] = far
            prv[far[far >= 0]] = at[far >= 0]
            beside = prv[at]
            touched = _distinct(np.concatenate((at[far >= 0], beside[beside >= 0])))
            touched = touched[nxt[touched] >= 0]
            got = self._ranks_at(sym[touched], sym[nxt[touched]])
            for g, p in zip(got[got >= 0].tolist(), touched[got >= 0].tolist()):
                if g not in places:
                    heapq.heappush(heap, g)
                places[g].append(p)
        live = sym >= 0
        return sym[live].astype(np.int32), np.diff(np.concatenate(([0], np.cumsum(live)[ends - 1])))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another, and how many each text has)."""
        if self.held > KNOWN_BYTES:
            self._forget()
        known, parts, sizes, counts = self.known, [], [], []
        for text in texts:
            count = 0
            for part in self.cuts.split(text) if self.cuts else [text]:
                special = self.specials.get(part)
                parts.append([] if special is not None else self.units(part))
                sizes.append(-1 - special if special is not None else len(parts[-1]))
                count += 1 if special is not None else sizes[-1]
            counts.append(count)
        fresh = [u for u in set(chain.from_iterable(parts)) if u not in known]
        if fresh:
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            own = [u.encode() for u in fresh]
            self.held += sum(map(len, own))
            ids, made = self.encode_units(own)
            self.unit_ids, self.unit_sizes = np.concatenate((self.unit_ids, ids)), np.concatenate((self.unit_sizes, made))
        plain = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64)
        at = np.append(0, np.cumsum(np.maximum(sizes, 0)))
        marks = np.insert(plain, at[:-1][np.array(sizes) < 0], [x for x in sizes if x < 0]) if min(sizes, default=0) < 0 else plain
        special = np.flatnonzero(marks < 0)
        unit_sizes = np.append(self.unit_sizes, 1)  # one place for a special token
        sizes = unit_sizes[np.where(marks < 0, len(known), marks)]
        starts = (np.cumsum(unit_sizes) - unit_sizes)[np.where(marks < 0, len(known), marks)]
        ids = gathered(np.append(self.unit_ids, np.int32(0)), starts, sizes)
        ids[(np.cumsum(sizes) - sizes)[special]] = -1 - marks[special]
        return ids, np.diff(np.append(0, np.append(0, np.cumsum(sizes))[np.cumsum(counts, dtype=np.int64)]))

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        return gathered(self.bytes, self.starts[ids], self.sizes[ids]).tobytes().decode("utf-8", "replace")


def _distinct(values: np.ndarray) -> np.ndarray:
    values.sort()
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] for each start, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(2)
def vocabulary_of(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_bpe(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) of the whole texts of `docs`; special tokens written in a text are read as such."""
    docs = small_batches(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches):
        own = vocabulary_of(vocabulary)
        for batch in batches:
            for first, end, texts in slices(batch, limit=SLICE):
                ids, counts = own.encode([t.decode() for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), lists], ["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_bpe(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, decoded) of `encoded` (doc_id, ids)."""
    encoded = small_batches(encoded.select("doc_id", "ids"))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches):
        own = vocabulary_of(vocabulary)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = row.column("ids").flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([own.decode(ids)], pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to."""
    got = decode_bpe(encode_bpe(docs, vocabulary), vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
