"""Token-id output: an adaptive context-mixing range coder in independent, checksummed blocks.

The probability of an id is a mixture of three adaptive distributions. Order 0 holds the counts of
all ids so far; order 1 and order 2 hold, for each context of one or two ids (the latter hashed),
its two leading ids with counts. The weights of the three are learned: each set of weights, chosen
by how sure the two contexts are, moves to the share that each order had in what came true. The
mixture is a distribution over all 2**16 ids, so that a range coder codes every id directly; no id
is coded flat. All arithmetic is on integers.

A block holds the ids of whole documents, BLOCK of them or a little more, dealt to lanes that are coded side by side, one
array operation a step for all lanes; lanes share the block's model, which learns after each step.
Each block starts from nothing and can be read alone.

Format. A container is a Parquet table with a row a block: part and block order the blocks, doc_ids
and sizes list the documents, and data holds the ids: magic "LTK2", u32 number of ids, u32 number of
lanes, u32 crc32 of the ids as little-endian u32, u32 number of 16-bit words of each lane, then the
words. Lanes hold the ids in order, the first lanes one id more where they don't divide evenly.

Defined cases: null and empty texts have the end id only; rows without id come first; rows that
repeat an id follow each other, by the hash of their texts; an empty table gives an empty
container; extra columns are not read; a block that doesn't match its checksum raises ValueError;
so do ids of 2**16 and more, and a vocabulary that doesn't part words at white space.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, small_batches
from .textbatch import WHITE, buffer_of, per_text, slices, tidy

MAGIC = b"LTK2"
BLOCK = 1 << 22
LANES = 4096
#: Steps that a block has at least, so that a small one still learns.
STEPS = 256
VALUES = 1 << 16

#: The mixture's probabilities are parts of 2**26, those of order 0 parts of 2**22.
TOTAL_BITS, ZERO_BITS = 26, 22
TOTAL, ZERO = 1 << TOTAL_BITS, 1 << ZERO_BITS
#: Orders 1 and 2 together have at most this much, so that each id keeps a part of order 0.
MOST = TOTAL - ZERO
PAIR_BITS = 20
COUNT_BITS = 5
_TOP, _LOW = np.uint64(1 << 48), np.uint64(1 << 32)
_U16, _U48, _UTOTAL = np.uint64(16), np.uint64(48), np.uint64(TOTAL_BITS)


def _count_tables():
    """What follows from the counts (first, second) of a context, the high and low half of the index.

    What it tells: a class of eight for how sure it is from bit 32 on, then its second id's share in
    2**10 from bit 16 on, then its first id's. And what it becomes after its first id, its second id or
    another came, three tables in a row: the next counts from bit 32 on, then 16 bits that are set where
    the second id is replaced, then 16 where the two swap.
    """
    first, second = np.divmod(np.arange(1 << (2 * COUNT_BITS)), 1 << COUNT_BITS)
    whole = 2 * (first + second) + 1
    share = np.stack((2 * first, 2 * second)) * 1024 // whole
    level = np.digitize(first, (1, 2, 4, 10))
    sure = np.where(level < 2, level, 2 * level - 2 + (3 * second > first))
    swap, replace = 0xFFFF, 0xFFFF << 16
    join = lambda a, b: (a << COUNT_BITS | b) << 32
    full = (1 << COUNT_BITS) - 1
    over = first == full
    hit = join(np.where(over, first // 2 + 1, first + 1), np.where(over, second // 2, second))
    grown = np.minimum(second + 1, full)
    other = np.where(grown > first, join(grown, first) | swap, join(first, grown))
    kept = np.where(second <= 1, join(first, 1) | replace, join(first, np.maximum(second - 1, 0)))
    miss = np.where(first == 0, join(np.ones_like(first), 0 * first) | swap | replace, kept)
    return sure << 32 | share[1] << 16 | share[0], np.concatenate((hit, other, miss))


TOLD, NEXT = _count_tables()


class _Model:
    """The three orders and their weights: one for all lanes of a block.

    What is below 2**31 is kept in 32 bits, which numpy works through about twice as fast.
    """

    def __init__(self):
        # a context's two ids, and above them their counts; contexts of one id come first
        self.slots = np.zeros(VALUES + (1 << PAIR_BITS), np.int64)
        self.counts = np.zeros(VALUES, np.int64)
        self.new, self.waiting, self.seen = [], 0, 0
        self.part = np.tile(np.array([[1 << 14], [1 << 14], [1 << 15]], np.int64), 64)
        self._weigh()
        self._count()

    def _weigh(self):
        self.weights = (self.part[:2] * (MOST >> 10) // self.part.sum(axis=0)).astype(np.int32)

    def _count(self):
        if self.new:
            self.counts += np.bincount(np.concatenate(self.new), minlength=VALUES)
        self.seen, self.new, self.waiting = self.seen + self.waiting, [], 0
        # each id has a sixteenth of a count from the start, and one part of ZERO at least
        each = (16 * self.counts + 1) * ((ZERO - VALUES) / (16 * self.seen + VALUES))
        self.zero = np.zeros(VALUES + 1, np.int64)
        np.cumsum(each.astype(np.int64) + 1, out=self.zero[1:])
        self.zero[-1] = ZERO
        self.first = None
        self.due = min(max(self.seen // 8, 1), 32 * LANES)

    def predict(self, a, b):
        """Mixture after the ids a, b of each lane, kept for `interval`, `found` and `learn`."""
        k = len(a)
        self.at = at = np.empty((2, k), np.int64)
        np.bitwise_and((a * 0x9E3779B1 + b * 0x85EBCA6B) >> 12, (1 << PAIR_BITS) - 1, out=at[0])
        at[0] += VALUES
        at[1] = b
        held = self.slots.take(at)
        self.q = q = held >> 32
        both = held.astype(np.int32)
        self.ids = ids = np.empty((4, k), np.int32)
        np.bitwise_and(both, 0xFFFF, out=ids[:2])
        both >>= 16
        np.bitwise_and(both, 0xFFFF, out=ids[2:])
        told = TOLD.take(q)
        sure = told >> 32
        self.set = sure[0] << 3 | sure[1]
        both = told.astype(np.int32)
        weights = self.weights.take(self.set, axis=1)
        self.mass = mass = np.empty((4, k), np.int32)
        np.multiply(both & 0xFFFF, weights, out=mass[:2])
        both >>= 16
        np.multiply(both, weights, out=mass[2:])
        self.rest = (TOTAL - (mass[0] + mass[1] + mass[2] + mass[3])).astype(np.int64)

    def interval(self, x):
        """(low, width) of the ids x in 2**26."""
        mass = self.mass
        self.x = few = x.astype(np.int32)
        self.hit = self.ids == few
        own = mass * self.hit
        self.two, self.one = own[0] + own[2], own[1] + own[3]
        less = mass * (self.ids < few)
        low = self.zero.take(x)
        low *= self.rest
        low >>= ZERO_BITS
        self.width = width = self.zero.take(x + 1)
        width *= self.rest
        width >>= ZERO_BITS
        width -= low
        width += self.two + self.one
        low += less[0] + less[1] + less[2] + less[3]
        return low, width

    def found(self, value):
        """The ids whose intervals hold the values."""
        key = self.ids.astype(np.int64)
        key <<= 32
        key |= self.mass
        for i, j in ((0, 1), (2, 3), (0, 2), (1, 3), (1, 2)):  # sorts the four of each lane
            low = np.minimum(key[i], key[j])
            np.maximum(key[i], key[j], out=key[j])
            key[i] = low
        mass = key.astype(np.int32)
        key >>= 32
        rest = self.rest
        begin = self.zero.take(key)
        begin *= rest
        begin >>= ZERO_BITS
        ids = key.astype(np.int32)
        key += 1
        end = self.zero.take(key)
        end *= rest
        end >>= ZERO_BITS
        begin, end, wanted = begin.astype(np.int32), end.astype(np.int32), value.astype(np.int32)
        below = np.zeros(len(value), np.int32)  # where ids are equal, one ends where the next begins
        for i in range(4):
            begin[i] += below
            below += mass[i]
            end[i] += below
        past = end <= wanted
        inside = (begin <= wanted) > past
        mass *= past
        plain = value - (mass[0] + mass[1] + mass[2] + mass[3])
        # quotients below 2**22 of numbers below 2**49: exact in doubles
        spot = np.minimum(((((plain + 1) << ZERO_BITS) - 1) / rest).astype(np.int64), ZERO - 1)
        if self.first is None:
            # the last id that begins at or below each 64th part
            begins = np.bincount((self.zero + 63) >> 6, minlength=(ZERO >> 6) + 1)
            self.first = np.cumsum(begins) - 1
        x = self.first.take(spot >> 6)
        far = np.flatnonzero(self.zero.take(x + 1) <= spot)
        x[far] = np.searchsorted(self.zero, spot[far], side="right") - 1
        ids *= inside  # of one lane all that are left are equal
        np.copyto(x, ids[0] | ids[1] | ids[2] | ids[3], where=inside[0] | inside[1] | inside[2] | inside[3])
        return x

    def learn(self, x):
        """Take in the ids x, whose `interval` was asked last."""
        # a part of the lanes tells the weights enough; sums of doubles run in a fixed order on both sides
        few = slice(0, max(len(x) // 8, 64))
        sets, width = self.set[few], self.width[few]
        n = np.bincount(sets, minlength=64)
        two, one = (np.bincount(sets, w[few] / width, 64) for w in (self.two, self.one))
        part = self.part
        part -= part >> 6
        part += (np.stack((two, one, n - two - one)) * 4096).astype(np.int64)
        np.maximum(part, 64, out=part)
        self._weigh()
        first, second = self.ids[:2], self.ids[2:]
        hit = self.hit.view(np.int8)
        what = (2 - 2 * hit[:2] - hit[2:]).astype(np.int64)
        what <<= 2 * COUNT_BITS
        what |= self.q
        what = NEXT.take(what)
        turns = what.astype(np.int32)
        # ids have 16 bits, so that they mask what stands above
        new = second ^ ((second ^ self.x) & (turns >> 16))
        turn = (first ^ new) & turns
        new ^= turn
        new <<= 16
        new |= first ^ turn
        what >>= 32
        what <<= 32
        what |= new.view(np.uint32)
        self.slots[self.at] = what
        self.new.append(x)
        self.waiting += len(x)
        if self.waiting >= self.due:
            self._count()


class _Coder:
    """Range coders that move 16 bits at a time, without carries."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, (1 << 64) - 1, np.uint64)

    def narrow(self, low, width):
        """Take the interval [low, low + width) of 2**26 in the first lanes."""
        l, r = self.low[: len(low)], self.range[: len(low)]
        part = r >> _UTOTAL
        l += part * low.view(np.uint64)
        np.multiply(part, width.view(np.uint64), out=r)
        while True:
            same = (l ^ (l + r)) < _TOP
            go = same | (r < _LOW)
            at = np.flatnonzero(go)
            if not len(at):
                return
            cut = np.flatnonzero(go > same)
            if len(cut):
                r[cut] = (~l[cut] + np.uint64(1)) & (_LOW - np.uint64(1))
            self.move(at, l)
            by = go * _U16
            l <<= by
            r <<= by


class _Writer(_Coder):
    def __init__(self, lanes: int, steps: int):
        super().__init__(lanes)
        self.out = np.zeros((lanes, 2 * steps + 8), np.uint16)
        self.n = np.zeros(lanes, np.int64)

    def move(self, go, low):
        n = self.n[go]
        self.out[go, n] = low[go] >> _U48
        self.n[go] = n + 1

    def finish(self) -> tuple[np.ndarray, bytes]:
        """(words of each lane, all words): 48 bits more a lane name a value in its range."""
        last = self.low + np.uint64(0xFFFF)
        lanes = np.arange(len(self.n))
        for _ in range(3):
            self.out[lanes, self.n] = last >> _U48
            self.n += 1
            last <<= _U16
        used = np.arange(self.out.shape[1]) < self.n[:, None]
        return self.n, self.out[used].astype("<u2").tobytes()


class _Reader(_Coder):
    def __init__(self, sizes: np.ndarray, words: bytes):
        super().__init__(len(sizes))
        self.words = np.concatenate((np.frombuffer(words, "<u2"), np.zeros(8, "<u2")))
        self.n = np.cumsum(sizes) - sizes
        self.code = np.zeros(len(sizes), np.uint64)
        for _ in range(4):
            self.code = (self.code << _U16) | self.words[self.n].astype(np.uint64)
            self.n += 1

    def value(self, k: int) -> np.ndarray:
        """Where in 2**26 the codes of the first lanes lie."""
        at = (self.code[:k] - self.low[:k]) // (self.range[:k] >> _UTOTAL)
        return np.minimum(at, np.uint64(TOTAL - 1)).astype(np.int64)

    def move(self, go, low):
        # a broken block may ask for more words than there are; its checksum tells
        n = self.n[go]
        self.code[go] = (self.code[go] << _U16) | self.words.take(n, mode="clip").astype(np.uint64)
        self.n[go] = n + 1


def _dealt(n: int) -> tuple[int, int, int]:
    """(lanes, whole steps of all lanes, lanes with one id more) of a block of n ids."""
    lanes = min(max(n // STEPS, 1), LANES)
    return lanes, *divmod(n, lanes)


def encode_block(ids: np.ndarray) -> bytes:
    """The bytes of a block of ids below 2**16."""
    ids = np.ascontiguousarray(ids, np.int64)
    n = len(ids)
    if n and (ids.min() < 0 or ids.max() >= VALUES):
        raise ValueError("ids must be in 0 .. 65535")
    lanes, steps, more = _dealt(n)
    starts = np.arange(lanes) * steps + np.minimum(np.arange(lanes), more)
    model, coder = _Model(), _Writer(lanes, steps + 1)
    a = b = np.zeros(lanes, np.int64)
    for t in range(steps + (more > 0)):
        k = lanes if t < steps else more
        x = ids[starts[:k] + t]
        model.predict(a[:k], b[:k])
        coder.narrow(*model.interval(x))
        model.learn(x)
        a, b = b, x
    sizes, words = coder.finish()
    return MAGIC + struct.pack("<III", n, lanes, zlib.crc32(ids.astype("<u4").tobytes())) + sizes.astype("<u4").tobytes() + words


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block; ValueError if it is broken."""
    if data[:4] != MAGIC or len(data) < 16:
        raise ValueError("not a token block")
    n, lanes, crc = struct.unpack_from("<III", data, 4)
    sizes = np.frombuffer(data, "<u4", lanes, 16).astype(np.int64) if len(data) >= 16 + 4 * lanes else np.zeros(0, np.int64)
    if (lanes, *divmod(n, max(lanes, 1))) != _dealt(n) or 16 + 4 * lanes + 2 * int(sizes.sum()) != len(data):
        raise ValueError("broken head of a token block")
    lanes, steps, more = _dealt(n)
    starts = np.arange(lanes) * steps + np.minimum(np.arange(lanes), more)
    model, coder = _Model(), _Reader(sizes, data[16 + 4 * lanes :])
    ids = np.zeros(n, np.int64)
    a = b = np.zeros(lanes, np.int64)
    for t in range(steps + (more > 0)):
        k = lanes if t < steps else more
        model.predict(a[:k], b[:k])
        x = model.found(coder.value(k))
        coder.narrow(*model.interval(x))
        model.learn(x)
        ids[starts[:k] + t] = x
        a, b = b, x
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block doesn't match its checksum")
    return ids


class WordEncoder:
    """Ids of texts under a vocabulary that parts words at white space: each piece is encoded once.

    The encoder drops white space, so that a text's ids are those of its words in a row. Words are cut
    further where Latin-1 letters, ASCII digits and signs meet, apostrophes apart, if the encoder cuts there too.
    """

    KEPT = 1_200_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.forget()
        # ids that end a word, where the vocabulary marks them
        spec = json.loads(self.encoder.to_str())
        mark = spec["model"].get("end_of_word_suffix")
        vocab = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for word, i in vocab.items() if mark and word.endswith(mark)]] = True
        # for lower-case Latin-1 letters, which need no rules: the same model without them
        self.light = self.encoder
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [x["type"] for x in steps] == ["Split", "ByteLevel"] and not steps[1]["use_regex"]:
            spec["normalizer"], steps[0] = None, {"type": "WhitespaceSplit"}
            self.light = Tokenizer.from_str(json.dumps(spec))
        ids = lambda text: self.encoder.encode(text, add_special_tokens=False).ids
        words = ["don't", "a1b23", "x,y", "\u00e9!", "--Ab", "we'll.", "\u65e5\u672c", "e\u0301", "'s", "\u00c9t\u00e9,"]
        for gap in (" ", "\t", "\n", "\v", "\f", "\r", " \n "):
            if ids(gap + gap.join(words) + gap) != [i for w in words for i in ids(w)]:
                raise ValueError(f"{path} doesn't part words at white space")
        self.fine = True
        text = " ".join(words) + " Ab12,x.Y-3/(z)='q' \u00e9a,\u0301b"
        self.fine = self.encode([text.encode()])[0].tolist() == ids(text)

    def forget(self) -> None:
        self.where: dict[str, int] = {}
        self.ids, self.cuts, self.known = np.zeros(1 << 20, np.int32), np.zeros(1 << 16, np.int64), 0

    def pieces(self, texts: list[bytes]):
        """(pieces of all texts as an array of strings, where each text's begin and at last their number)."""
        buf, starts = buffer_of(texts)
        kind = (KINDS if self.fine else GAPS)[buf]
        if self.fine:  # U+00C0 to U+00FF but two signs are letters like those of ASCII
            lead = np.flatnonzero(buf == 0xC3)
            lead = lead[LATIN[buf[lead + 1]]]
            kind[lead] = kind[lead + 1] = 1
        gap = kind == 0
        turn = (kind[1:] != kind[:-1]) & ((kind[1:] | kind[:-1]) < 4)
        turn |= gap[1:] != gap[:-1]
        begins = np.flatnonzero(np.concatenate((~gap[:1], turn & ~gap[1:])))
        solid = ~gap
        # a piece's bytes stand between its begin and the next one's, with gaps only behind them
        cuts = np.zeros(len(begins) + 1, np.int32)
        if len(begins):
            np.cumsum(np.add.reduceat(solid.view(np.int8), begins, dtype=np.int32), out=cuts[1:])
        data = pa.py_buffer(buf[solid])
        return pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(cuts), data]), per_text(starts, begins)

    def _singly(self, words: list[str]):
        """(ids, number of ids of each word)."""
        lists = [e.ids for e in self.encoder.encode_batch_fast(words, add_special_tokens=False)] if words else []
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int32, int(n.sum())), n

    def _together(self, words: list[str], encoder, text: str):
        """The same from one call for all words as one text, where each of them is one match of the encoder."""
        if not words or not self.ends.any():
            return self._singly(words)
        (got,) = encoder.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(got.ids, np.int32)
        end = np.flatnonzero(self.ends[ids]) + 1
        # what the encoder and this module take for letters may differ in a rare script
        return (ids, np.diff(end, prepend=0)) if len(end) == len(words) and end[-1] == len(ids) else self._singly(words)

    def _keep(self, words: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        self.where.update(zip(words, range(self.known, self.known + len(words))))
        first, last = self.known, self.known + len(words)
        used = int(self.cuts[first])
        self.cuts = _room(self.cuts, last + 1)
        self.cuts[first + 1 : last + 1] = used + np.cumsum(n)
        self.ids = _room(self.ids, used + len(ids))
        self.ids[used : used + len(ids)] = ids
        self.known = last

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and at last their number)."""
        pieces, cut = self.pieces(texts)
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        coded = pieces.dictionary_encode()
        if self.known > self.KEPT:
            self.forget()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = np.fromiter(map(self.where.get, names, repeat(-1)), np.int64, len(names))
        unmet = np.flatnonzero(which < 0)
        new = [names[i] for i in unmet.tolist()]
        letters, plain, other = [], [], []
        for name in new:
            if self.fine and LETTERS(name):
                letters.append(name)
            else:
                (plain if self.fine and _one_match(name) else other).append(name)
        self._keep(letters, *self._together(letters, self.light, " ".join(letters).lower()))
        self._keep(plain, *self._together(plain, self.encoder, " ".join(plain)))
        self._keep(other, *self._singly(other))
        which[unmet] = np.fromiter(map(self.where.__getitem__, new), np.int64, len(new))
        which = which[coded.indices.to_numpy()]
        at = self.cuts[which]
        n = self.cuts[which + 1] - at
        end = np.cumsum(n)
        flat = self.ids[np.arange(end[-1]) + np.repeat(at - end + n, n)]
        return flat, np.concatenate(([0], end))[cut]


def _one_match(piece: str) -> bool:
    """Whether the encoder sees letters only, which it doesn't part, or one ASCII sign or digit."""
    if piece.isascii():
        return piece.isalpha() or len(piece) == 1
    return unicodedata.normalize("NFC", piece).lower().isalpha()


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """`x` with room for `n` values."""
    return x if n <= len(x) else np.concatenate((x, np.zeros(max(len(x), n - len(x)), x.dtype)))


def _kinds() -> np.ndarray:
    """0 white space, 1 letters, 2 digits, 3 signs; 4 what is never cut off: apostrophes and, here, non-ASCII bytes."""
    out = np.full(256, 3, np.uint8)
    out[list(range(65, 91)) + list(range(97, 123))] = 1
    out[48:58] = 2
    out[WHITE] = 0
    out[128:] = 4
    out[ord("'")] = 4
    return out


KINDS = _kinds()
#: Second bytes of what stands for a letter behind a byte C3, and names of such and ASCII letters.
LATIN = np.ones(256, bool)
LATIN[[0x97, 0xB7]] = False
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
GAPS = (~WHITE).astype(np.uint8)

_ENCODERS: dict[str, WordEncoder] = {}


ROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("before", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])


def word_encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None) -> str:
    """Encode and write `docs` in ascending doc_id order; the place of the container."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    if not 0 <= end_id < VALUES or word_encoder(vocabulary).encoder.get_vocab_size() > VALUES:
        raise ValueError("ids must be in 0 .. 65535")

    def run(batches):
        from pyspark import TaskContext

        encoder, part = word_encoder(vocabulary), TaskContext.get().partitionId()
        held, names, sizes, total, block, before = [], [], [], 0, 0, 0

        def flush():
            nonlocal held, names, sizes, total, block, before
            row = {"part": part, "block": block, "doc_ids": names, "sizes": sizes, "before": before, "n_ids": total, "data": encode_block(np.concatenate(held))}
            held, names, sizes, total, block, before = [], [], [], 0, block + 1, before + total
            return pa.RecordBatch.from_pylist([row], schema=ROW)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, end, texts in slices(batch, limit=8 << 20):
                flat, cut = encoder.encode(texts)
                flat = np.insert(flat, cut[1:], end_id)
                cut = cut + np.arange(len(cut))
                a = 0
                while a < len(texts):  # a block ends with a document
                    b = int(np.searchsorted(cut, cut[a] + BLOCK - total))
                    b = min(max(b, a + 1), len(texts))
                    held.append(flat[cut[a] : cut[b]])
                    names += ids[first + a : first + b]
                    sizes += np.diff(cut[a : b + 1]).tolist()
                    total += int(cut[b] - cut[a])
                    a = b
                    if total >= BLOCK:
                        yield flush()
        if names:
            yield flush()

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    out = ordered.mapInArrow(tidy(run), "part int, block int, doc_ids array<long>, sizes array<long>, before long, n_ids long, data binary")
    out.write.option("compression", "none").parquet(path)
    return path


def read_tokens(spark, path: str) -> DataFrame:
    """Per document of a container: doc_id, start (ids of all before it), ids (array<int>)."""
    return _read(spark, path, "ids array<int>", lambda ids: pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))


def read_digests(spark, path: str) -> DataFrame:
    """Per document of a container: doc_id, start, n_tokens, ids_crc32."""
    crcs = lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
    return _read(spark, path, "ids_crc32 long", crcs)


def _read(spark, path: str, last: str, made) -> DataFrame:
    blocks = spark.read.parquet(path)
    # a row a part, of which there are as many as tasks that wrote; blocks know what stands before them in their part
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    name = last.split()[0]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                names, sizes = batch.column("doc_ids")[row].values, batch.column("sizes")[row].values.to_numpy()
                ids = decode_block(batch.column("data")[row].as_py())
                cut = np.concatenate(([0], np.cumsum(sizes)))
                start = batch.column("start")[row].as_py() + cut[:-1]
                yield pa.RecordBatch.from_arrays([names.cast(pa.int64()), pa.array(start), pa.array(sizes), made([ids[a:b] for a, b in zip(cut[:-1], cut[1:])])], names=["doc_id", "start", "n_tokens", name])

    placed = blocks.join(F.broadcast(starts), "part").select("doc_ids", "sizes", "data", (F.col("start") + F.col("before")).alias("start"))
    return placed.mapInArrow(tidy(run), f"doc_id long, start long, n_tokens long, {last}")
