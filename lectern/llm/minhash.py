"""MinHash near-dedup: one-permutation hashing with optimal densification, bands and stars.

A document's set holds its distinct five-word shingles (white-space words, A-Z lower-cased). One
hash of each shingle goes to one of BANDS * ROWS bins, whose minima form the sketch; an empty bin
takes the minimum of a bin that a hash of its number and of the attempt picks. Documents with equal
sets form a class and are compared once. Classes that share a band's bucket are candidates: every
bucket is a star, each member paired with the centre only, the one that meets most others, and pairs
are verified on full sets. Where a verified star leaves a bucket in several components, further stars
follow around the members outside the bucket's largest component, from FIRST a bucket on and MORE
times as many in each round, until every bucket is one component or all its cross-component pairs
have been compared, or ruled out: by the triangle inequality over the distances to the bucket's
centre, by the number of a set's shingles that other components hold at all, or by sketches that
differ in more bins than those of linked sets do but for a chance of 3e-7 (none of the last with
`sigmas` None). Nothing is capped.

Defined cases: null, empty and blank texts have an empty set, n_shingles 0, and link with nothing;
fewer than five words form one shingle; repeated rows and equal sets share a component; rows
without id take part with the ids of the others and have kept false, component_id null if no member
has an id; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BITMAP_BITS, in_bitmap, membership_bitmap, row_key, small_batches, without, written
from .textbatch import GOLD, LOWER, buffer_of, mix, per_text, signed, slices, tidy, word_hashes, words_of

WORDS = 5
BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
#: How far beyond the mean of linked sets' sketches a pair's must differ to be ruled out unseen.
SIGMAS = 5.0
#: Stars of a bucket in the first round after its centre's, and how many times as many in each further one.
FIRST, MORE = 4, 8
#: Rows of a table of names that is sent to all tasks rather than shuffled, at most: about 2 MB.
FEW = 20_000
#: Members of a bucket that one task compares with its strays, about.
SPLIT = 1000
_STEP = mix(np.arange(1, WORDS + 1, dtype=np.uint64))
_ROW = mix(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's sorted, distinct shingle hashes."""
    buf, starts = buffer_of(texts)
    buf = LOWER[buf]
    begins, ends = words_of(buf)
    words = word_hashes(buf, begins, ends)
    cut = per_text(starts, begins)
    n = max(len(words) - WORDS + 1, 0)
    run = np.zeros(n, np.uint64)
    for j in range(WORDS):
        run += words[j : j + n] * (_STEP[j] | np.uint64(1))
    run = mix(run)
    out, none = [], np.zeros(0, np.uint64)
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a >= WORDS:
            out.append(np.unique(run[a : b - WORDS + 1]))
        elif b > a:
            few = words[a:b]
            out.append(mix((few * (_STEP[: b - a] | np.uint64(1))).sum(keepdims=True) + _STEP[b - a]))
        else:
            out.append(none)
    return out


def _attempts(t: int) -> np.ndarray:
    """The bin that each bin asks at attempt t."""
    return (mix(np.arange(BINS, dtype=np.uint64) * GOLD + np.full(1, t + 1, np.uint64) * _STEP[0]) % np.uint64(BINS)).astype(np.int64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Bin minima of each non-empty set, with the empty bins filled."""
    sketch = np.zeros((len(sets), BINS), np.uint64)
    full = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        spot = ((s >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)  # keeps the order of s
        first = np.flatnonzero(np.concatenate(([True], spot[1:] != spot[:-1])))
        at = spot[first].astype(np.int64)
        sketch[i, at], full[i, at] = s[first], True
    left = np.argwhere(~full)
    t = 0
    while len(left):
        ask = _attempts(t)[left[:, 1]]
        found = full[left[:, 0], ask]
        hit = left[found]
        sketch[hit[:, 0], hit[:, 1]] = sketch[hit[:, 0], ask[found]]
        left = left[~found]
        t += 1
    return sketch


def bands_of(sketch: np.ndarray) -> np.ndarray:
    """A key for each band of each sketch; the band's number is part of it."""
    part = mix(sketch).reshape(len(sketch), BANDS, ROWS) * _ROW
    return signed(mix(part.sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * GOLD))


def marks_of(sketch: np.ndarray) -> np.ndarray:
    """Four bits of each bin of each sketch, sixteen bins to a long."""
    four = (mix(sketch) & np.uint64(15)).reshape(len(sketch), BINS // 16, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return signed(np.bitwise_or.reduce(four, axis=2))


def _unlike(a, b):
    """In how many bins two marks differ."""
    def differing(x, y):
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda total, x: total + x)


def _most_unlike(n, percent: int, sigmas: float = SIGMAS):
    """Bins in which sets of `n` or more shingles that are alike enough differ at most, but for a chance of 3e-7.

    Three things spread the share of equal bins: a sketch samples a part of the shingles only, and
    none twice; filled bins repeat others; and marks of four bits may be equal by chance.
    """
    alike = percent / 100
    drawn = BINS * (1 - F.exp(-n / BINS))
    union = 2 * n / (1 + alike)
    missed = 1 - BINS * (1 - F.exp(-union / BINS)) / union
    copied = (BINS - drawn) / drawn
    sampled = alike * (1 - alike) / drawn * (missed + copied / ((1 + copied) * (1 + copied)))
    chance = (1 - alike) * 15 / 256 / BINS
    bound = BINS * ((1 - alike) * 15 / 16 + sigmas * F.sqrt(sampled * (225 / 256) + chance))
    return F.when(n < 16, BINS).otherwise(bound)


def class_of(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketched(batches):
    for batch in batches:
        for first, end, texts in slices(batch):
            sets = shingle_sets(texts)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            lists = np.concatenate(([0], np.cumsum(n > 0))).astype(np.int32)
            sketch = sketches([s for s in sets if len(s)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, end - first).cast(pa.int64()),
                    batch.column("key").slice(first, end - first).cast(pa.binary()),
                    pa.array([class_of(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(n),
                    pa.ListArray.from_arrays(pa.array(lists * BANDS), pa.array(bands_of(sketch).ravel())),
                    pa.ListArray.from_arrays(pa.array(lists * (BINS // 16)), pa.array(marks_of(sketch).ravel())),
                ],
                names=["doc_id", "key", "node", "n", "bands", "marks"],
            )


def _slot(node):
    """Slot of a class in a membership bitmap: its name is a hash already."""
    return F.conv(F.hex(F.substring(node, 1, 4)), 16, 10).cast("long") % (1 << BITMAP_BITS)


def _sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set) of the classes in `nodes`, once each.

    A bitmap of fixed size screens classes before sets leave a task, and a task sends a class once.
    """
    bits = membership_bitmap(nodes.select(_slot(F.col("node")).alias("slot")))

    def make(batches):
        sent = set()
        for batch in batches:
            for _, _, texts in slices(batch):
                named = [(class_of(s), s) for s in shingle_sets(texts) if len(s)]
                slot = np.fromiter((int.from_bytes(k[:4], "big") for k, _ in named), np.int64, len(named)) % (1 << BITMAP_BITS)
                named = [x for x, wanted in zip(named, in_bitmap(bits, slot)) if wanted]
                named = [x for x in dict(named).items() if x[0] not in sent]
                sent.update(k for k, _ in named)
                sets = [s for _, s in named]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in named], pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)),
                            pa.array(signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)),
                        ),
                    ],
                    names=["node", "set"],
                )

    rows = docs.select("text").mapInArrow(tidy(make), "node binary, set array<long>")
    return rows.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the exact sizes of intersection and union of their sets."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("of_b"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.select("a", "b", common.alias("common"), (F.size("of_a") + F.size("of_b") - common).alias("union"))


def _links(distances: DataFrame, percent: int) -> DataFrame:
    return distances.where(100 * F.col("common") >= percent * F.col("union")).select("a", "b")


def _shared(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, shared): how many of its shingles stand in another component's nodes as well."""
    rows = sets.join(parts, "node").select("node", "part", F.explode("set").alias("shingle"))
    common = rows.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("shingle")
    counts = rows.join(common, "shingle").groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    return written(parts.select("node").join(counts, "node", "left").na.fill(0, ["shared"]), "near-shared")


def _sent(df: DataFrame) -> DataFrame:
    """`df`, a written table of names, to be joined: where it has few rows no shuffle is needed."""
    return F.broadcast(df) if df.count() <= FEW else df


def _joined(links: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, part) after merging the parts that links connect: each takes the smallest name.

    Links first become pairs of parts. Every part then points at the smallest part next to it, and
    pointers are shortened and links carried to what they point at until no link is left.
    """
    name = lambda x, y: parts.select(F.col("node").alias(x), F.col("part").alias(y))
    live = links.join(name("a", "pa"), "a").join(name("b", "pb"), "b").where("pa <> pb")
    live = written(live.select(F.least("pa", "pb").alias("low"), F.greatest("pa", "pb").alias("high")).distinct(), "near-live")
    while not live.isEmpty():
        # each part but local minima points down, so that pointers have no cycle
        points = written(live.groupBy("high").agg(F.min("low").alias("low")).select(F.col("high").alias("part"), F.col("low").alias("to")), "near-points")
        onward = points.select(F.col("part").alias("to"), F.col("to").alias("further"))
        while True:
            step = written(points.join(_sent(onward), "to", "left").select("part", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "near-points")
            points = step.select("part", "to")
            if step.where("moved").isEmpty():
                break
            onward = points.select(F.col("part").alias("to"), F.col("to").alias("further"))
        new = _sent(points.withColumnRenamed("to", "new"))
        parts = written(parts.join(new, "part", "left").select("node", F.coalesce("new", "part").alias("part")), "near-parts")
        to = lambda c: new.select(F.col("part").alias(c), F.col("new").alias(f"{c}_to"))
        moved = live.join(to("low"), "low", "left").join(to("high"), "high", "left")
        low, high = F.coalesce("low_to", "low"), F.coalesce("high_to", "high")
        live = written(moved.select(F.least(low, high).alias("low"), F.greatest(low, high).alias("high")).where("low <> high").distinct(), "near-live")
    return parts


def near_groups(docs: DataFrame, percent: int = 75, sigmas: float | None = SIGMAS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. With `sigmas` None no sketch rules a pair out: all left are compared."""
    return _grouped(docs.select("doc_id", "text"), F.lit(None).cast("binary"), percent, sigmas).drop("key")


def _grouped(docs: DataFrame, key, percent: int, sigmas: float | None) -> DataFrame:
    """`near_groups` with the column `key`, which names a row."""
    schema = "doc_id long, key binary, node binary, n long, bands array<long>, marks array<long>"
    rows = written(small_batches(docs).select("doc_id", "text", key.alias("key")).mapInArrow(tidy(_sketched), schema), "near-rows")
    one = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    spread = one.select("node", "n", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    members = _centred(written(spread.join(shared, "bucket"), "near-shared-buckets"))
    out = rows.select("doc_id", "key", "node", F.col("n").alias("n_shingles"))
    nodes = written(one.select("node", "bands", "marks").join(members.select("node").distinct(), "node"), "near-nodes")
    ids = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    if nodes.isEmpty():
        parts = nodes.select("node", F.col("node").alias("part"))
    else:
        parts = _components(docs, members, nodes, percent, sigmas)
    # names of parts are nodes; rows of other classes stand alone in their class
    named = ids.join(parts, "node", "left").select("node", F.coalesce("part", "node").alias("part"), "least")
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = named.join(least, "part").select("node", "component_id")
    alone = out.where("node IS NULL").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"))
    joined = out.where("node IS NOT NULL").join(named, "node").select("doc_id", "key", "n_shingles", "component_id")
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _centred(members: DataFrame) -> DataFrame:
    """(bucket, node, n, low): low is the bucket's centre, the member that meets most others.

    Of edited copies the least edited meets the others most often, so its star links most of them.
    """
    meets = members.groupBy("node").agg(F.sum("held").alias("meets"))
    rows = members.select("bucket", "node", "n").join(meets, "node")
    centre = rows.groupBy("bucket").agg(F.max_by("node", F.struct("meets", "node")).alias("low"))
    return written(members.select("bucket", "node", "n").join(centre, "bucket"), "near-members")


def _components(docs: DataFrame, members: DataFrame, nodes: DataFrame, percent: int, sigmas: float | None = SIGMAS) -> DataFrame:
    """(node, part) of the candidate classes."""
    sets = written(_sets_of(docs, nodes.select("node")), "near-sets")
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    size_of = members.select(F.col("node").alias("low"), F.col("n").alias("low_n")).distinct()
    spokes = members.where("node <> low").select("low", "node", "n").distinct().join(size_of, "low")
    spokes = written(spokes.select(F.col("low").alias("a"), F.col("node").alias("b"), "n", "low_n"), "near-spokes")
    met = written(_distances(spokes.where(fits(F.col("n"), F.col("low_n"))).select("a", "b"), sets), "near-met")
    parts = _joined(written(_links(met, percent), "near-links"), nodes.select("node", F.col("node").alias("part")))
    # Jaccard distance is a metric: how far a member is from its centre bounds how near two members
    # can be. Where sizes alone ruled a link out, they give a lower bound.
    far = spokes.join(met, ["a", "b"], "left").select(
        F.col("a").alias("low"),
        F.col("b").alias("node"),
        F.coalesce(1 - F.col("common") / F.col("union"), 1 - F.least("n", "low_n") / F.greatest("n", "low_n")).alias("from_"),
        F.coalesce(1 - F.col("common") / F.col("union"), F.lit(1.0)).alias("to"),
    )
    # members but the centre, which has met all of its bucket
    rest = members.where("node <> low").join(far, ["low", "node"]).select("bucket", "node", "n", "from_", "to")
    reach = 1 - percent / 100 + 1e-9
    centres, known = FIRST, None
    while True:
        now = rest.join(parts, "node")
        sizes = now.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("held"))
        mixed = sizes.groupBy("bucket").agg(F.max_by("part", F.struct("held", "part")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("held").alias("rows")).where("parts > 1").select("bucket", "main", "rows")
        now = written(now.join(mixed, "bucket"), "near-mixed")
        strays = now.where("part <> main").select("bucket", "rows", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("part").alias("a_part"), F.col("from_").alias("a_from"), F.col("to").alias("a_to"))
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("a"))
        # a stray that is among the first of one bucket is a centre of all buckets in which it is a stray, and done there
        chosen = strays.withColumn("rank", rank).where(F.col("rank") <= centres).select("a").distinct()
        strays = written(strays.join(chosen, "a"), "near-strays")
        if strays.isEmpty():
            return parts
        if known is None:
            # later rounds meet these nodes only, in parts that have merged: what parts share can but shrink
            known = nodes.join(_shared(now.select("node", "part").distinct(), sets), "node")
        told = strays.select("bucket", "a")
        rest = now.select("bucket", "node", "n", "from_", "to").join(told.withColumnRenamed("a", "node"), ["bucket", "node"], "left_anti")
        strays = strays.join(known.select(*[F.col(c).alias(f"a_{c}") for c in known.columns]).withColumnRenamed("a_node", "a"), "a")
        now = now.join(known, "node")
        once = F.array_min(F.array_intersect("bands", "a_bands")) == F.col("bucket")
        like = F.lit(True) if sigmas is None else _unlike(F.col("marks"), F.col("a_marks")) <= _most_unlike(F.least("n", "a_n"), percent, sigmas)
        # an intersection has at most the shingles that other components hold too
        enough = (100 + percent) * F.least("shared", "a_shared") >= percent * (F.col("n") + F.col("a_n"))
        near = (F.col("from_") - F.col("a_to") <= reach) & (F.col("a_from") - F.col("to") <= reach)
        # the members of a large bucket are dealt to several tasks, and its strays go to each of them
        parts_of = F.ceil(F.col("rows") / SPLIT).cast("int")
        dealt = now.withColumn("deal", F.pmod(F.xxhash64("node"), parts_of).cast("int")).drop("rows")
        strays = strays.withColumn("deal", F.explode(F.sequence(F.lit(0), parts_of - 1)))
        pairs = strays.join(dealt, ["bucket", "deal"]).where((F.col("part") != F.col("a_part")) & fits(F.col("n"), F.col("a_n")) & enough & near & once & like)
        pairs = written(pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), "near-pairs")
        parts = _joined(written(_links(_distances(pairs, sets), percent), "near-links"), parts)
        centres *= MORE


def drop_near(docs: DataFrame, percent: int = 75, sigmas: float | None = SIGMAS) -> DataFrame:
    """One row of each component stays, with the columns of `docs`; so do rows without id.

    A row goes by its id and text: another text under the same id stays.
    """
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    return without(docs, _grouped(named, row_key(), percent, sigmas).where(~F.col("kept")).select("key"))
