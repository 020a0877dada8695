"""Line dedup: sharded cuckoo filters before exact reference-count tables.

A line's key is the line without white space at both ends, A-Z lower-cased; only keys of at least
`shortest` code points count. `LineIndex` keeps, as Parquet tables in the shared folder,

- postings (key, doc): which documents hold a key, once each;
- refs (key, shard, n_docs, last_doc): the exact reference counts;
- filters (shard, cells): a cuckoo filter a shard over the keys that have a count.

An insert asks the filters first: keys that they don't know are new and skip the join with the
counts. A delete takes a document's postings out, lowers the counts and, where one reaches zero,
takes the key's fingerprint out of its filter: the index is then what it was before the insert.
A key held by `least` documents or more is a repeat: its lines go, but in the largest doc_id.

Defined cases: null and empty texts are one empty line; a key several times in a document counts
once, and each of its lines goes or stays; rows that repeat an id count as documents of their own in
the counts; rows without id count too, and rank below every id; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .textbatch import slices, tidy

WHITE = b" \t\n\x0b\x0c\r"
SLOTS = 4
SHARD_KEYS = 1 << 16
#: The repeats' filters go to every task up to this size; beyond it lines go to the join unscreened.
SCREEN_BYTES = 8 << 20


class Cuckoo:
    """A cuckoo filter: 16-bit fingerprints of 128-bit keys, four to a bucket, with deletion."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells.reshape(-1, SLOTS)
        self.mask = len(self.cells) - 1

    @classmethod
    def for_keys(cls, n: int) -> Cuckoo:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(n, 1) / (0.85 * SLOTS)))))
        return cls(np.zeros(buckets * SLOTS, np.uint16))

    @classmethod
    def of(cls, keys: list[bytes]) -> Cuckoo:
        """A filter of all keys: arrays fill free slots at each key's two places, the few left over are moved about."""
        n = len(keys)
        while True:
            new = cls.for_keys(n)
            if all(new.insert(keys[i]) for i in new._fill(keys).tolist()):
                return new
            n *= 2

    def _fill(self, keys: list[bytes]) -> np.ndarray:
        """Put keys into an empty filter where they have a free slot; the numbers of the others."""
        raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
        mark = np.maximum(np.ascontiguousarray(raw[:, :2]).view("<u2").ravel(), 1).astype(np.int64)
        one = np.ascontiguousarray(raw[:, 2:10]).view("<u8").ravel() & np.uint64(self.mask)
        one = one.astype(np.int64)
        used = np.zeros(len(self.cells), np.int64)
        left = np.arange(len(keys))
        for spot in (one, one ^ (mark * 0x5BD1E995 & self.mask)):
            at = spot[left]
            order = np.argsort(at, kind="stable")
            at = at[order]
            first = np.searchsorted(at, at)
            slot = used[at] + np.arange(len(at)) - first
            fits = slot < SLOTS
            self.cells[at[fits], slot[fits]] = mark[left[order[fits]]]
            np.add.at(used, at[fits], 1)
            left = left[order[~fits]]
        return left

    def _spots(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        one = int.from_bytes(key[2:10], "little") & self.mask
        return mark, one, one ^ (mark * 0x5BD1E995 & self.mask)

    def insert(self, key: bytes) -> bool:
        """False if no room was found; the filter must then be built anew, and larger."""
        mark, one, two = self._spots(key)
        for b in (one, two):
            free = np.flatnonzero(self.cells[b] == 0)
            if len(free):
                self.cells[b, free[0]] = mark
                return True
        b = two
        for turn in range(500):
            slot = turn % SLOTS
            mark, self.cells[b, slot] = int(self.cells[b, slot]), mark
            b ^= mark * 0x5BD1E995 & self.mask
            free = np.flatnonzero(self.cells[b] == 0)
            if len(free):
                self.cells[b, free[0]] = mark
                return True
        return False

    def holds(self, key: bytes) -> bool:
        mark, one, two = self._spots(key)
        return bool((self.cells[one] == mark).any() or (self.cells[two] == mark).any())

    def delete(self, key: bytes) -> None:
        mark, one, two = self._spots(key)
        for b in (one, two):
            there = np.flatnonzero(self.cells[b] == mark)
            if len(there):
                self.cells[b, there[0]] = 0
                return


def key_of(line: bytes, shortest: int) -> bytes | None:
    """128 bits that name the line's key; None if the key is too short to count."""
    key = line.strip(WHITE).lower()  # of bytes: A-Z only
    if len(key) < shortest or len(key) < 4 * shortest and len(key.decode("utf-8", "replace")) < shortest:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_keys(docs: DataFrame, shortest: int) -> DataFrame:
    """(key, doc): each key once a row."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for first, _, texts in slices(batch):
                rows, keys = [], []
                for i, text in enumerate(texts, first):
                    own = {key_of(line, shortest) for line in text.split(b"\n")}
                    own.discard(None)
                    rows += [i] * len(own)
                    keys += own
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), ids.take(pa.array(rows, pa.int64()))], names=["key", "doc"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(tidy(run), "key binary, doc long")


def _shard(n: int):
    """Shard of a key among n, by bits that the filters don't use."""
    return (F.conv(F.hex(F.substring("key", 12, 4)), 16, 10).cast("long") % n).cast("int")


class LineIndex:
    """Reference counts of lines, insert by insert and delete by delete."""

    def __init__(self, spark, shards: int, shortest: int = 40):
        self.shards, self.shortest = shards, shortest
        self.postings = spark.createDataFrame([], "key binary, doc long")
        self.refs = spark.createDataFrame([], "key binary, shard int, n_docs long, last_doc long")
        self.filters = spark.createDataFrame([], "shard int, cells binary")

    def save(self, path: str) -> None:
        """Write the index below `path`, where `open` finds it, in this session or another."""
        for name in ("postings", "refs", "filters"):
            getattr(self, name).write.parquet(f"{path}/{name}")
        # last: an index without it isn't whole
        self.postings.sparkSession.createDataFrame([(self.shards, self.shortest)], "shards int, shortest int").write.parquet(f"{path}/settings")

    @classmethod
    def open(cls, spark, path: str) -> LineIndex:
        settings = spark.read.parquet(f"{path}/settings").first()
        index = cls(spark, settings["shards"], settings["shortest"])
        index.postings, index.refs, index.filters = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "refs", "filters"))
        return index

    def _counted(self, postings: DataFrame) -> DataFrame:
        return postings.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc")).select("key", _shard(self.shards).alias("shard"), "n_docs", "last_doc")

    def _hold(self, keys: int) -> None:
        """Raise the number of shards where `keys` keys would make them too large; a task takes one whole."""
        want = -(-keys // SHARD_KEYS)
        if want <= self.shards:
            return
        self.shards = max(want, 2 * self.shards)
        if not self.filters.isEmpty():
            self.refs = written(self.refs.withColumn("shard", _shard(self.shards)), "lines-refs")
            self.filters = written(_built(self.refs), "lines-filters")

    def insert(self, docs: DataFrame) -> None:
        fresh = not self.filters.isEmpty()
        new = line_keys(docs, self.shortest)
        delta = written(self._counted(new), "lines-delta")
        self._hold(self.refs.count() + delta.count())
        delta = delta.withColumn("shard", _shard(self.shards))
        self.postings = self.postings.unionByName(new) if not fresh else written(self.postings.unionByName(new), "lines-postings")
        if not fresh:
            self.refs = delta
            self.filters = written(_built(delta), "lines-filters")
            return
        asked = written(_asked(delta, self.filters), "lines-asked")
        known = asked.where("known").drop("known")
        both = self.refs.unionByName(known).groupBy("key").agg(F.first("shard").alias("shard"), F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        self.refs = written(both.unionByName(asked.where("NOT known").drop("known")), "lines-refs")
        added = asked.join(self.refs.select("key", F.col("n_docs").alias("now")), "key").where("now = n_docs")
        self.filters = written(_changed(self.filters, added.select("key", "shard", F.lit(True).alias("add")), self.refs), "lines-filters")

    def delete(self, ids: DataFrame) -> None:
        """Take the documents of `ids` (doc_id) out again."""
        ids = ids.select(F.col("doc_id").cast("long").alias("doc")).distinct()
        gone = written(self.postings.join(ids, "doc", "left_semi").select("key", "doc"), "lines-gone")
        touched = written(gone.select("key").distinct(), "lines-touched")
        self.postings = written(self.postings.join(ids, "doc", "left_anti").select("key", "doc"), "lines-postings")
        again = self._counted(self.postings.join(touched, "key", "left_semi"))
        self.refs = written(self.refs.join(touched, "key", "left_anti").unionByName(again), "lines-refs")
        zero = touched.join(self.refs, "key", "left_anti").select("key", _shard(self.shards).alias("shard"), F.lit(False).alias("add"))
        self.filters = written(_changed(self.filters, zero, self.refs), "lines-filters")

    def repeats(self, least: int) -> DataFrame:
        return self.refs.where(F.col("n_docs") >= least)

    def kept(self, docs: DataFrame, least: int = 5) -> DataFrame:
        """Per row of `docs`: doc_id, n_lines, n_dropped, kept (the text that stays)."""
        repeats = written(self.repeats(least).select("key", "shard", "last_doc"), "lines-repeats")
        filters = written(_built(repeats), "lines-screens")
        size = filters.agg(F.sum(F.length("cells")).alias("n")).first()["n"] or 0
        screens = {r["shard"]: bytes(r["cells"]) for r in filters.collect()} if size <= SCREEN_BYTES else None
        split = written(_screened(docs, screens, self.shards, self.shortest), "lines-split")
        asked = split.where("keys IS NOT NULL").select("row", "doc_id", F.explode("keys").alias("key")).join(repeats, "key")
        drops = asked.where("last_doc IS NOT NULL AND (doc_id IS NULL OR doc_id < last_doc)").groupBy("row").agg(F.collect_list("key").alias("drops"))
        open_ = split.where("keys IS NOT NULL").join(drops, "row", "left").select("doc_id", "text", "drops")
        done = split.where("keys IS NULL").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("drops"))
        return open_.unionByName(done).mapInArrow(tidy(_dropper(self.shortest)), "doc_id long, n_lines long, n_dropped long, kept string")


def _built(refs: DataFrame) -> DataFrame:
    """A filter for each shard of the keys in `refs`."""

    def build(key, rows):
        made = Cuckoo.of(rows.column("key").to_pylist())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([made.cells.tobytes()], pa.binary())})

    return refs.select("shard", "key").groupBy("shard").applyInArrow(build, "shard int, cells binary")


def _filter_in(rows: pa.Table) -> Cuckoo:
    cells = rows.column("cells").to_pylist()
    return Cuckoo(np.frombuffer(cells[0], np.uint16).copy()) if cells else Cuckoo.for_keys(1)


def _asked(delta: DataFrame, filters: DataFrame) -> DataFrame:
    """`delta` with known: whether a key's shard may hold it. A shard has SHARD_KEYS keys on average at most, by `_hold`."""

    def ask(rows, cells):
        there = _filter_in(cells)
        return rows.append_column("known", pa.array([there.holds(k) for k in rows.column("key").to_pylist()], pa.bool_()))

    return delta.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(ask, "key binary, shard int, n_docs long, last_doc long, known boolean")


def _changed(filters: DataFrame, changes: DataFrame, refs: DataFrame) -> DataFrame:
    """The filters after adding and deleting keys; a shard that overflows is built anew from `refs`."""

    def change(rows, cells):
        there, full = _filter_in(cells), False
        for k, add in zip(rows.column("key").to_pylist(), rows.column("add").to_pylist()):
            if not add:
                there.delete(k)
            elif not there.insert(k):
                full = True
                break
        shard = (rows if len(rows) else cells).column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int32()), "cells": pa.array([there.cells.tobytes()], pa.binary()), "full": pa.array([full])})

    got = written(changes.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(change, "shard int, cells binary, full boolean"), "lines-changed")
    again = _built(refs.join(got.where("full").select("shard"), "shard", "left_semi"))
    return got.where("NOT full").select("shard", "cells").unionByName(again)


def _screened(docs: DataFrame, screens: dict[int, bytes] | None, shards: int, shortest: int) -> DataFrame:
    """(row, doc_id, text, keys): keys that may be repeats, null if there are none."""

    def run(batches):
        filters = {k: Cuckoo(np.frombuffer(v, np.uint16)) for k, v in (screens or {}).items()}

        def may(key: bytes) -> bool:
            there = filters.get(int.from_bytes(key[11:15], "big") % shards)
            return screens is None or there is not None and there.holds(key)

        for batch in batches:
            for first, end, texts in slices(batch):
                keys = []
                for text in texts:
                    own = {key_of(line, shortest) for line in text.split(b"\n")}
                    own.discard(None)
                    keys.append([k for k in own if may(k)] or None)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id").cast(pa.int64()), part.column("text").cast(pa.string()), pa.array(keys, pa.list_(pa.binary()))], names=["row", "doc_id", "text", "keys"])

    rows = docs.select("doc_id", "text").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    return rows.mapInArrow(tidy(run), "row long, doc_id long, text string, keys array<binary>")


def _dropper(shortest: int):
    def run(batches):
        for batch in batches:
            drops = batch.column("drops").to_pylist()
            for first, end, texts in slices(batch):
                n, gone, kept = [], [], []
                for text, out in zip(texts, drops[first:end]):
                    lines = text.split(b"\n")
                    out = set(out or ())
                    stay = [x for x in lines if key_of(x, shortest) not in out] if out else lines
                    n.append(len(lines))
                    gone.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return run


def dedup_lines(docs: DataFrame, least: int = 5, shortest: int = 40) -> DataFrame:
    """Index all of `docs`, then tell per row: doc_id, n_lines, n_dropped, kept."""
    index = LineIndex(docs.sparkSession, shards=4, shortest=shortest)
    index.insert(docs)
    return index.kept(docs, least)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), r AS (
  SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT l.*, coalesce(l.doc_id < r.last_doc, false) AS dropped FROM l LEFT JOIN r USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
