"""Dedup within a batch: entries in order against the entries that stand for those before them.

An entry is a duplicate of the first slot whose entry has the same stripped URL, the same host and
path, a title or a summary's beginning with enough common tokens. It takes the slot if it is more
complete, and goes otherwise. Likeness isn't transitive and slots change hands, so the order counts;
but an entry only ever meets entries of its own connected component. Components come from joins;
each of up to BLOCK entries is then folded in one ordered pass.

A larger component is taken in rounds, BLOCK of its entries in order at a time. What came before counts only
by the entries that now stand in slots, so a round's entries meet each other and those of the standing ones
that are like one of them. The links among these fall into components of their own, as links over entries that
went are gone; each is folded by a task, from its standing entries on. No task holds more than BLOCK entries
and the standing ones next to them.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import config as C
from lectern.functions import text as T
from lectern.functions import urls as U
from lectern.operators.batch import alike_pairs
from lectern.operators.folds import components, cut, in_order
from lectern.operators.scans import BLOCK as BLOCK_COLUMN
from lectern.operators.scans import in_blocks, running

#: Entries of a component that are folded by one task.
BLOCK = 100_000


def _keyed(entries: DataFrame) -> DataFrame:
    """What the rule looks at: two keys, two token sets and how complete an entry is."""
    prefix = F.substring("summary", 1, C.SUMMARY_PREFIX)
    whole = F.struct(F.col("published").isNotNull().alias("dated"), F.length("summary").alias("size"), (~F.col("low_confidence")).alias("sure"))
    return entries.select(
        "pos",
        T.stripped(F.col("url")).alias("url"),
        U.host_path(F.col("url")).alias("host_path"),
        F.array_sort(T.tokens(F.col("title"))).alias("title"),
        F.array_sort(T.tokens(prefix)).alias("summary"),
        whole.alias("whole"),
    )


def _stars(rows: DataFrame, key: str) -> DataFrame:
    """Links (a, b) from the first row of each value of `key` to the others."""
    first = rows.groupBy(key).agg(F.min("pos").alias("a"))
    return rows.join(first, key).where("pos <> a").select("a", F.col("pos").alias("b"))


def duplicate_links(entries: DataFrame) -> dict[str, DataFrame]:
    """Links (a, b), a < b, by each of the four rules; equal values are linked to the first of them only."""
    rows = _keyed(entries)
    alike = lambda column, percent: alike_pairs(rows.select("pos", F.col(column).alias("tokens")), percent)
    return {
        "url": _stars(rows, "url"),
        "host_path": _stars(rows, "host_path"),
        "title": alike("title", C.TITLE_ALIKE_PERCENT),
        "summary": alike("summary", C.SUMMARY_ALIKE_PERCENT),
    }


def _head(tokens: list[str], percent: int) -> list[str]:
    """The tokens of which two alike sets share at least one, in any fixed order of tokens."""
    return tokens[: len(tokens) - math.ceil(len(tokens) * percent / 100) + 1]


class _Slots:
    """Slots of a component with their present entries, findable by whatever may make a duplicate."""

    RULES = (("title", C.TITLE_ALIKE_PERCENT), ("summary", C.SUMMARY_ALIKE_PERCENT))

    def __init__(self):
        self.entries: list[dict] = []
        self.first: list[int] = []
        self.where: dict[tuple, set[int]] = {}

    def _marks(self, row: dict):
        yield "url", row["url"]
        yield "host_path", row["host_path"]
        for name, percent in self.RULES:
            for token in _head(row[name], percent):
                yield name, token

    def _alike(self, a: dict, b: dict) -> bool:
        if a["url"] == b["url"] or a["host_path"] == b["host_path"]:
            return True
        for name, percent in self.RULES:
            common = len(set(a[name]).intersection(b[name]))
            if common and 100 * common >= percent * (len(a[name]) + len(b[name]) - common):
                return True
        return False

    def stand(self, slot: int, row: dict) -> None:
        """An entry that stands in a slot already; slots come in order."""
        self.put(len(self.entries), row)
        self.first[-1] = slot

    def match(self, row: dict) -> int | None:
        near = set().union(*(self.where.get(mark, ()) for mark in self._marks(row)))
        return next((i for i in sorted(near) if self._alike(row, self.entries[i])), None)

    def put(self, i: int, row: dict) -> None:
        if i == len(self.entries):
            self.entries.append(row)
            self.first.append(row["pos"])
        else:
            for mark in self._marks(self.entries[i]):
                self.where[mark].discard(i)
            self.entries[i] = row
        for mark in self._marks(row):
            self.where.setdefault(mark, set()).add(i)


def _step(slots: _Slots, row: dict):
    if row["slot"] is not None:
        slots.stand(row["slot"], row)
        return ()
    i = slots.match(row)
    if i is None:
        slots.put(len(slots.entries), row)
    elif tuple(row["whole"].values()) > tuple(slots.entries[i]["whole"].values()):
        slots.put(i, row)
    return ()


_KEPT = pa.schema([("slot", pa.int64()), ("pos", pa.int64())])


def _folded(rows: DataFrame, key: str) -> DataFrame:
    """(slot, pos) after the fold of each key's rows: those with a slot first, in its order, then the others by pos."""
    ordered = rows.withColumn("late", F.col("slot").isNull()).withColumn("at", F.coalesce("slot", "pos"))
    return in_order(ordered, key, ["late", "at"], _KEPT, _Slots, _step, lambda slots: [(first, row["pos"]) for first, row in zip(slots.first, slots.entries)])


_KINDS = ("url", "host_path", "title", "summary")


def _classes(rows: DataFrame) -> DataFrame:
    """(pos, kind, class) of the rows: a class is named by the first entry of the batch with that value; no tokens, no class."""
    out = None
    for kind in _KINDS:
        own = rows.select("pos", F.col(kind).alias("value"))
        own = own.where(F.size("value") > 0) if kind in ("title", "summary") else own
        # equal values meet by a digest, and their number is reduced before the shuffle
        own = own.select("pos", F.sha2(F.to_json(F.struct("value")), 256).alias("value"))
        first = own.groupBy("value").agg(F.min("pos").alias("class"))
        own = own.join(first, "value").select("pos", F.lit(kind).alias("kind"), "class")
        out = own if out is None else out.unionByName(own)
    return out


def _units(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pos, unit) of members (pos, kind, class): what is connected by classes, or by pairs (kind, a, b) of classes, among them."""
    first = cut(members.groupBy("kind", "class").agg(F.min("pos").alias("first")))
    equal = members.join(first, ["kind", "class"]).where("pos <> first").select(F.col("first").alias("a"), F.col("pos").alias("b"))
    end = lambda name, to: first.select("kind", F.col("class").alias(name), F.col("first").alias(to))
    alike = pairs.join(end("a", "x"), ["kind", "a"]).join(end("b", "y"), ["kind", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = components(equal.unionByName(alike).where("a <> b")).select(F.col("node").alias("pos"), F.col("component").alias("unit"))
    return members.select("pos").distinct().join(found, "pos", "left").select("pos", F.coalesce("unit", "pos").alias("unit"))


def _in_rounds(rows: DataFrame, links: dict[str, DataFrame], block: int) -> DataFrame:
    """(slot, pos) for rows of components (component, pos, ...) too large for one fold."""
    numbered = running(in_blocks(rows, ["component"], ["pos"]), ["component"], ["pos"], rank=("sum", F.lit(1).cast("long"), 0))
    rows = cut(numbered.withColumn("turn", F.floor((F.col("rank") - 1) / block)).drop("rank", "component", BLOCK_COLUMN))
    classes = cut(_classes(rows))
    names = classes.select("kind", "class").distinct()
    # likeness of classes: the links between those that are first of their kind
    alike = links["title"].withColumn("kind", F.lit("title")).unionByName(links["summary"].withColumn("kind", F.lit("summary")))
    for end in ("a", "b"):
        alike = alike.join(names.withColumnRenamed("class", end), ["kind", end], "left_semi")
    pairs = cut(alike.select("kind", "a", "b"))
    both = pairs.unionByName(pairs.select("kind", F.col("b").alias("a"), F.col("a").alias("b")))
    standing = None
    for turn in range((rows.agg(F.max("turn")).first()[0] or 0) + 1):
        fresh = rows.where(F.col("turn") == turn).select(F.lit(None).cast("long").alias("slot"), "pos")
        if standing is None:
            now = fresh
        else:
            own = classes.join(fresh.select("pos"), "pos", "left_semi").select("kind", "class").distinct()
            asked = own.unionByName(own.withColumnRenamed("class", "a").join(both, ["kind", "a"]).select("kind", F.col("b").alias("class"))).distinct()
            near = classes.join(standing.select("pos"), "pos", "left_semi").join(asked, ["kind", "class"], "left_semi").select("pos").distinct()
            near = cut(standing.join(near, "pos", "left_semi").select("slot", "pos"))
            now = fresh.unionByName(near)
        now = cut(now)
        units = _units(classes.join(now.select("pos"), "pos", "left_semi"), pairs)
        got = _folded(rows.drop("turn").join(now, "pos").join(units, "pos"), "unit")
        standing = cut(got if standing is None else standing.join(now.select("pos"), "pos", "left_anti").unionByName(got))
    return standing


def dedup_same_batch(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, pos): the entry that stays in each slot; a slot is named by the entry that opened it.

    `entries` has pos, url, title, summary, published and low_confidence.
    """
    rows = _keyed(entries)
    links = duplicate_links(entries)
    edges = links["url"].unionByName(links["host_path"]).unionByName(links["title"]).unionByName(links["summary"])
    found = components(edges).withColumnRenamed("node", "pos")
    alone = rows.join(found, "pos", "left_anti").select(F.col("pos").alias("slot"), "pos")
    # names of the large ones, of which there are at most rows / block
    large = cut(found.groupBy("component").count().where(F.col("count") > block).select("component"))
    some = rows.join(found, "pos").withColumn("slot", F.lit(None).cast("long"))
    kept = _folded(some.join(large, "component", "left_anti"), "component").unionByName(alone)
    if large.isEmpty():
        return kept
    return kept.unionByName(_in_rounds(some.drop("slot").join(large, "component", "left_semi"), links, block))
