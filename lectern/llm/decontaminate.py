"""Benchmark decontamination by spaced seeds.

Tokens are runs of ASCII letters, digits and other non-ASCII bytes, A-Z lower-cased. Each fixed mask
looks at some positions of a token window and ignores the rest, so that a hash of what it sees
survives substitutions at the others. Hashes of the benchmark's windows are joined with those of the
documents' windows; around each hit the whole item is laid on the document along the hit's diagonal,
and the longest stretch with at least `share` of its tokens equal decides: it must have at least
`overlap` tokens, or all of a shorter item.

Defined cases: null and empty texts, or items, have no tokens and no hits; items of fewer
than 13 tokens have masks of their own length, which any fifth of substitutions leaves one of; items with equal texts report the smallest item_id; repeated
rows are judged each by its own text; rows and items without id work alike (an item without id is
left out of the list, but counts); empty tables give clean documents; extra columns are kept by
`drop_leaks` and not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITMAP_BITS, bitmap_slot, in_bitmap, membership_bitmap, row_key, small_batches, without, written
from .textbatch import GOLD, LOWER, buffer_of, mix, per_text, signed, slices, tidy, word_hashes, words_of

# Seven positions each: in every stretch of 13 to 20 tokens one of them meets no substitution,
# wherever a fifth of the tokens is substituted.
MASKS = ("11110111", "110100010111", "110011001101", "10101101011", "1111010011", "1100101000111", "1110000100111")
SPAN = 13
#: Items that one list of candidates of a row holds, about.
ITEMS = 1000

_GAPS = np.ones(256, bool)
_GAPS[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts, where each text's begin and at last their number)."""
    buf, starts = buffer_of(texts)
    buf = LOWER[buf]
    begins, ends = words_of(buf, _GAPS)
    return word_hashes(buf, begins, ends), per_text(starts, begins)


def window_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """What `mask` sees at each place, hashed; places run over the borders of texts."""
    n = max(len(tokens) - len(mask) + 1, 0)
    out = np.full(n, len(mask), np.uint64)
    for j, seen in enumerate(mask):
        if seen == "1":
            out += tokens[j : j + n] * (mix(np.full(1, j + 1, np.uint64)) | np.uint64(1))
    return mix(out + mix(np.full(1, int(mask, 2), np.uint64) * GOLD))


def windows(texts: list[bytes], masks: list[str]):
    """For each mask: (text number, place in the text, hash) of its windows."""
    tokens, cut = tokens_of(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(cut))
    for mask in masks:
        h = window_hashes(tokens, mask)
        at = np.flatnonzero(owner[: len(h)] == owner[len(mask) - 1 :][: len(h)])
        yield owner[at], at - cut[owner[at]], h[at]


def _benchmark(items: DataFrame) -> DataFrame:
    """(item, text, key): texts once each; the key names the text."""
    one = items.where("text IS NOT NULL").groupBy("text").agg(F.min("item_id").cast("long").alias("item"))
    return one.select("item", "text", F.unhex(F.md5("text")).alias("item_key"))


def short_masks(n: int) -> list[str]:
    """Masks of n tokens, of which a fifth of substitutions, wherever they stand, leaves one whole.

    Positions are dealt to groups; each mask leaves out as many groups as there may be substitutions.
    """
    out = n // 5
    groups = min(n, out and out + 2)
    return ["".join("0" if j % max(groups, 1) in gone else "1" for j in range(n)) for gone in combinations(range(groups), out)]


def _short_masks(bench: DataFrame) -> list[str]:
    """Masks for the lengths of items that are shorter than SPAN tokens."""

    def lengths(batches):
        for batch in batches:
            got = [np.diff(tokens_of(texts)[1]) for _, _, texts in slices(batch)]
            n = np.unique(np.concatenate(got)) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(n[(n > 0) & (n < SPAN)].astype(np.int64))], names=["n"])

    return [mask for r in bench.select("text").mapInArrow(tidy(lengths), "n long").distinct().orderBy("n").collect() for mask in short_masks(r["n"])]


def _hashed(rows: DataFrame, key: str, masks: list[str], bits: np.ndarray | None) -> DataFrame:
    """(key, place, hash) of all windows; with `bits`, of those whose two slots are set.

    Without `bits` texts are items, and those of fewer tokens than SPAN have masks of their length only.
    """

    def run(batches):
        for batch in batches:
            keys = batch.column(key).cast(pa.binary())
            for first, _, texts in slices(batch):
                size = np.diff(tokens_of(texts)[1]) if bits is None else None
                for mask, (owner, place, h) in zip(masks, windows(texts, masks)):
                    h = signed(h)
                    if bits is None:
                        own = size[owner] >= SPAN if mask in MASKS else size[owner] == len(mask)
                        owner, place, h = owner[own], place[own], h[own]
                    if bits is not None:
                        slots = h & ((1 << BITMAP_BITS) - 1), (h >> BITMAP_BITS) & ((1 << BITMAP_BITS) - 1)
                        keep = in_bitmap(bits, slots[0])
                        keep[keep] = in_bitmap(bits, slots[1][keep])
                        owner, place, h = owner[keep], place[keep], h[keep]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(first + owner)), pa.array(place.astype(np.int64)), pa.array(h)], names=[key, "place", "hash"])

    return rows.select(key, "text").mapInArrow(tidy(run), f"{key} binary, place long, hash long")


def longest_stretch(equal: np.ndarray, share: float) -> tuple[int, int]:
    """(length, equal tokens) of the longest stretch of which at least `share` is equal."""
    part = Fraction(share).limit_denominator(10_000)
    counts = np.concatenate(([0], np.cumsum(equal, dtype=np.int64)))
    sums = counts * part.denominator - np.arange(len(counts)) * part.numerator
    # the last place from which on no sum is as high as at the begin
    above = -np.maximum.accumulate(sums[::-1])[::-1]
    end = np.searchsorted(above, -sums, side="right") - 1
    begin = int(np.argmax(end - np.arange(len(end))))
    return int(end[begin]) - begin, int(counts[end[begin]] - counts[begin])


def _confirmed(rows: DataFrame, overlap: int, share: float) -> DataFrame:
    """(row_key, item_key, item, length) of the candidates in the list `hits` that hold on the text.

    A candidate is an item with its text and the diagonals `ats` on which windows met.
    """

    def run(batches):
        for batch in batches:
            hits = batch.column("hits")
            out = []
            for first, end, texts in slices(batch):
                tokens, cut = tokens_of(texts)
                for i in range(first, end):
                    doc = tokens[cut[i - first] : cut[i - first + 1]]
                    for hit in hits[i].as_py():
                        item, longest = tokens_of([hit["item_text"].encode()])[0], 0
                        for at in hit["ats"]:
                            a, b = max(0, -at), min(len(item), len(doc) - at)
                            longest = max(longest, longest_stretch(item[a:b] == doc[a + at : b + at], share)[0])
                        if longest >= max(min(overlap, len(item)), 1):
                            out.append((i, hit["item_key"], hit["item"], longest))
            at, *cols = list(zip(*out)) or [()] * 4
            kinds = (pa.binary(), pa.int64(), pa.int64())
            keys = batch.column("row_key").cast(pa.binary()).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["row_key", "item_key", "item", "length"])

    return rows.mapInArrow(tidy(run), "row_key binary, item_key binary, item long, length long")


def leaks(keyed: DataFrame, items: DataFrame, overlap: int, share: float) -> DataFrame:
    """(row_key, items, n_items, longest) of the rows (row_key, text) that hold benchmark passages."""
    bench = written(_benchmark(small_batches(items)), "leaks-bench")
    masks = [*MASKS, *_short_masks(bench)]
    seeds = written(_hashed(bench, "item_key", masks, None).withColumnRenamed("place", "item_place"), "leaks-seeds")
    low = F.col("hash").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    high = F.shiftright("hash", BITMAP_BITS).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    bits = membership_bitmap(seeds.select(F.explode(F.array(low, high)).alias("slot")))
    # the bitmap of fixed size only screens; this join decides
    found = _hashed(keyed, "row_key", masks, bits).join(seeds, "hash")
    hits = found.select("row_key", "item_key", (F.col("place") - F.col("item_place")).alias("at"))
    hits = hits.groupBy("row_key", "item_key").agg(F.collect_set("at").alias("ats"))
    # a row that meets very many items is confirmed in several lists, so that none grows with the benchmark
    parts = hits.groupBy("row_key").agg(F.ceil(F.count(F.lit(1)) / ITEMS).alias("parts"))
    hits = written(hits.join(parts, "row_key").withColumn("part", F.pmod(F.xxhash64("item_key"), "parts")).drop("parts"), "leaks-met")
    told = hits.join(bench.select("item_key", "item", F.col("text").alias("item_text")), "item_key")
    lists = written(told.groupBy("row_key", "part").agg(F.collect_list(F.struct("item_key", "item", "item_text", "ats")).alias("hits")), "leaks-hits")
    near = membership_bitmap(lists.select(bitmap_slot(F.col("row_key")).alias("slot")))

    def screen(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(near, batch.column("slot").to_numpy()))).drop_columns(["slot"])

    slotted = keyed.select("row_key", "text", bitmap_slot(F.col("row_key")).alias("slot"))
    rows = slotted.mapInArrow(tidy(screen), "row_key binary, text string").dropDuplicates(["row_key"])
    sure = _confirmed(rows.join(lists, "row_key").select("row_key", "text", "hits"), overlap, share)
    return written(
        sure.groupBy("row_key").agg(
            F.sort_array(F.collect_set("item")).alias("items"),
            F.count_distinct("item_key").alias("n_items"),
            F.max("length").alias("longest"),
        ),
        "leaks",
    )


def find_leaks(docs: DataFrame, items: DataFrame, overlap: int = 13, share: float = 0.8) -> DataFrame:
    """Per row: doc_id, contaminated, n_items, items (their ids, sorted), longest (tokens)."""
    keyed = docs.select("doc_id", "text", row_key().alias("row_key"))
    found = leaks(keyed, items, overlap, share)
    return keyed.select("doc_id", "row_key").join(found, "row_key", "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("longest", F.lit(0).cast("long")).alias("longest"),
    )


def drop_leaks(docs: DataFrame, items: DataFrame, overlap: int = 13, share: float = 0.8) -> DataFrame:
    """The rows of `docs` that hold no benchmark passage, with the columns of `docs`."""
    keyed = docs.select("text", row_key().alias("row_key"))
    return without(docs, leaks(keyed, items, overlap, share).select("row_key"))
