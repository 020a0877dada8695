"""Conversation structure repair: the cheapest edits that make turns alternate, and the repaired turns.

A conversation's rows, in order of turn (nulls first; rows of one turn by role, then text), are edited
so that the initials of their roles give `(s?(ua)+)?`. Keep (K) costs 0, rerole to user or assistant (R)
1, delete (D) 2, insert an empty turn of user or assistant (I) 5; a truncated row that stays costs 5
more. Blank rows and repeats of an earlier role and text must go. Of equally cheap edits the string of
initials that is least in ASCII order is taken.

The search is a forward Viterbi pass over four states: nothing yet, after the system turn, after a user's,
after an assistant's. Each state carries its least (cost, audit); a row's layer is closed by at most two
inserts, as two reach every state that inserts can reach without a circle. State, letter and row fix
the next state, so an audit tells the edits. Of two audits of one cost and one number of rows none begins the
other (what is longer holds more inserts), so least prefixes give least wholes.

No conversation is one task's work: rows are sorted by ranges, so that a long one spreads over tasks. Each
(conversation, range) gives the least (cost, audit) from each state to each; these are joined in order.
Audits lose what all states have in common as the pass goes on, so that it takes linear time.
The joined audit is one value by contract; SHA-256 of a conversation is sequential, so `digests` streams
each conversation's turns through one task, a batch at a time.

Null roles and texts count as one space, a null conversation is a conversation of its own. A role that is
empty has no initial and is reroled or deleted. Equal rows of one turn are counted first and travel as
one row. Tables without rows give none. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import os.path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

WHITE = " \t\n\x0b\x0c\r"
#: Next state by role initial and state; None where the grammar has no such turn.
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The role that an insert or a rerole gives in each state.
GIVEN = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
RANK = {"Keep": 0, "Rerole": 1, "Delete": 2, "Insert": 5, "Truncated": 5}
EMPTY = hashlib.sha256().hexdigest()
#: Length from which audits lose their common beginning.
LONG = 64


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that crc32 of `conv_id:turn`, modulo 20, chooses; nulls are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    return conversations.where(kind != 0).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(part("role")).alias("role"),
        text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def in_ranges(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, n) as a table with their place: `part`, and `pos` over all."""
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    # boundaries are sampled by the driver: they hold beginnings of texts, not whole ones
    ranges = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 40), F.substring("text", 1, 100))
    return written(ranges.sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("pos", F.monotonically_increasing_id()).withColumn("part", F.shiftright("pos", 33)), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """What the pass needs of each row, without its text: role's initial, whether blank, first of its kind, truncated."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    name = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = turns.select(
        "conv_id", "part", "pos", "turn", "n", name.alias("name"), F.substring("role", 1, 1).alias("initial"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    first = rows.groupBy("conv_id", "name").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    return rows.drop("name").join(first, "pos", "left").withColumn("first", F.coalesce("first", F.lit(False)))


class _Pass:
    """The least (cost, audit) from each starting state to each state, fed row by row."""

    def __init__(self, starts):
        self.starts = starts
        self.done = {s: [] for s in starts}
        self.layers = {s: self._closed([(0, "") if q == s else None for q in range(4)]) for s in starts}

    @staticmethod
    def _closed(layer):
        for _ in range(2):
            for q in range(4):
                if layer[q] is not None:
                    more = (layer[q][0] + RANK["Insert"], layer[q][1] + "I")
                    to = AFTER[q]
                    if layer[to] is None or more < layer[to]:
                        layer[to] = more
        return layer

    def row(self, initial: str, must_go: bool, truncated: bool, n: int = 1) -> None:
        """A row, of whose `n` copies all but the first must go."""
        keeps, stay = NEXT.get(initial), RANK["Truncated"] if truncated else 0
        for s in self.starts:
            old, new = self.layers[s], [None] * 4
            for q in range(4):
                if old[q] is None:
                    continue
                cost, audit = old[q]
                ways = [(q, cost + RANK["Delete"], "D")]
                if not must_go:
                    ways.append((AFTER[q], cost + stay + RANK["Rerole"], "R"))
                    if keeps and keeps[q] is not None:
                        ways.append((keeps[q], cost + stay, "K"))
                for to, price, letter in ways:
                    if new[to] is None or (price, audit + letter) < new[to]:
                        new[to] = (price, audit + letter)
            if n > 1:
                new = [x and (x[0] + RANK["Delete"] * (n - 1), x[1] + "D" * (n - 1)) for x in self._closed(new)]
            self.layers[s] = new = self._closed(new)
            if max(len(x[1]) for x in new if x) > LONG:
                shared = os.path.commonprefix([x[1] for x in new if x])
                self.done[s].append(shared)
                self.layers[s] = [x and (x[0], x[1][len(shared) :]) for x in new]

    def end(self):
        """[(start, end, cost, audit)]"""
        return [(s, q, x[0], "".join(self.done[s]) + x[1]) for s in self.starts for q, x in enumerate(self.layers[s]) if x]


_WAY = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_STAT = [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "least", "most", "turns")]
_ENDS = [("head", pa.string()), ("tail", pa.string())]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _runs(batches, width: int):
    """Rows that agree in their first `width` values, one iterator after another; the rows must come in that order."""
    from itertools import groupby

    return groupby(_rows(batches), key=lambda r: r[:width])


def _sent(rows, schema, size: int = 2000):
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += sum(len(x) for x in row if isinstance(x, (str, list)))
        if len(out) >= size or held > 4 << 20:
            yield _table(out, schema)
            out, held = [], 0
    yield _table(out, schema)


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _part_ways(key_type):
    schema = pa.schema([("conv_id", key_type), ("part", pa.int64()), ("ways", pa.list_(_WAY)), *_STAT, *_ENDS])

    def run(batches):
        def made():
            for (conv, part, split), rows in _runs(batches, 3):
                way = _Pass(range(4) if split else (0,))
                blank = duplicate = truncated = illegal = turns = 0
                head = tail = least = most = None
                for *_, _pos, turn, n, initial, is_blank, is_cut, first in rows:
                    blank += n * is_blank
                    duplicate += 0 if is_blank else n - first
                    truncated += not is_blank and first and is_cut
                    if tail is not None:
                        illegal += not _legal(tail, initial)
                    illegal += (n - 1) * (not _legal(initial, initial))
                    head, tail = initial if head is None else head, initial
                    if turn is not None and turn != most:  # in order: a new turn is a larger one
                        least, most, turns = turn if least is None else least, turn, turns + 1
                    way.row(initial, is_blank or not first, is_cut, n)
                ways = [dict(zip(("start", "end", "cost", "audit"), w)) for w in way.end()]
                yield conv, part, ways, blank, duplicate, truncated, illegal, least, most, turns, head, tail

        yield from _sent(made(), schema, 500)

    return run


def _joined(key_type):
    totals = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    schema = pa.schema([("conv_id", key_type), ("part", pa.int64()), ("state", pa.int32()), ("piece", pa.string()), *totals, ("audit", pa.string())])

    def run(batches):
        def made():
            for (conv,), rows in _runs(batches, 1):
                layer = {0: (0, "", None)}  # state: cost, audit, the ways taken as a linked list
                parts, stats, last, most, least, turns = [], [0] * 4, None, None, None, 0
                for _, part, ways, *counts, low, high, own, head, tail in rows:
                    new = {}
                    for w in ways:
                        if w["start"] in layer:
                            cost, audit, taken = layer[w["start"]]
                            to = (cost + w["cost"], audit + w["audit"], (taken, w["start"], w["audit"]))
                            if w["end"] not in new or to[:2] < new[w["end"]][:2]:
                                new[w["end"]] = to
                    layer = new
                    parts.append(part)
                    stats = [a + b for a, b in zip(stats, counts)]
                    if last is not None and not _legal(last, head):
                        stats[3] += 1
                    last = tail
                    if low is not None:
                        turns += own - (low == most)
                        least, most = low if least is None else least, high
                cost, audit, taken = min(layer[q] for q in (0, 3) if q in layer)
                pieces = []
                while taken:
                    taken, state, piece = taken
                    pieces.append((state, piece))
                gaps = 0 if least is None else most - least + 1 - turns
                for i, (part, (state, piece)) in enumerate(zip(parts, reversed(pieces))):
                    yield (conv, part, state, piece, *((gaps, *stats, cost, audit) if i == 0 else (None,) * 7))

        yield from _sent(made(), schema, 500)

    return run


def _ddl(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def plan_repairs(turns: DataFrame) -> DataFrame:
    """(conv_id, part, state, piece, and with the first part the conversation's figures): each part's edits."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, name = to_arrow_type(turns.schema["conv_id"].dataType), _ddl(turns, "conv_id")
    spans = turns.select("conv_id", "part").distinct()
    # a conversation in several ranges is the last of one and the first of the next: fewer than there are ranges
    split = spans.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("c"), F.lit(True).alias("split"))
    rows = faults(turns)
    rows = rows.join(F.broadcast(split), rows["conv_id"].eqNullSafe(F.col("c")), "left")
    rows = rows.select("conv_id", "part", F.coalesce("split", F.lit(False)).alias("split"), "pos", "turn", "n", "initial", "blank", "truncated", "first")
    stats = ", ".join(f"{c} long" for c, _ in _STAT)
    ways = rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos").mapInArrow(
        _part_ways(kind), f"conv_id {name}, part long, ways array<struct<start: int, end: int, cost: long, audit: string>>, {stats}, head string, tail string"
    )
    return ways.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        _joined(kind), f"conv_id {name}, part long, state int, piece string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    )


def repaired_turns(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, part, at, role, text): the turns after the edits, in order of part and at."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, name = to_arrow_type(turns.schema["conv_id"].dataType), _ddl(turns, "conv_id")
    schema = pa.schema([("conv_id", kind), ("part", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    null = lambda t: F.lit(None).cast(t)
    both = turns.select("conv_id", "part", "pos", "role", "text", "n", null("int").alias("state")).unionByName(
        plan.select("conv_id", "part", null("long").alias("pos"), null("string").alias("role"), F.col("piece").alias("text"), null("long").alias("n"), "state")
    )

    def run(batches):
        def made():
            for (conv, part), rows in _runs(batches, 2):
                *_, letters, _n, state = next(rows)  # the edits have no place and come first
                i = at = 0
                for *_, role, text, n, _state in rows:
                    for _ in range(n):
                        while letters[i] == "I":
                            yield conv, part, at, GIVEN[state], ""
                            i, at, state = i + 1, at + 1, AFTER[state]
                        if letters[i] != "D":
                            role, state = (role, NEXT[role[0]][state]) if letters[i] == "K" else (GIVEN[state], AFTER[state])
                            yield conv, part, at, role, text
                            at += 1
                        i += 1
                for _ in letters[i:]:
                    yield conv, part, at, GIVEN[state], ""
                    at, state = at + 1, AFTER[state]

        yield from _sent(made(), schema)

    ordered = both.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("pos"))
    return ordered.mapInArrow(run, f"conv_id {name}, part long, at long, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the turns as `role:text`, joined by newlines."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, name = to_arrow_type(repaired.schema["conv_id"].dataType), _ddl(repaired, "conv_id")
    schema = pa.schema([("conv_id", kind), ("repaired_sha256", pa.string())])

    def run(batches):
        def made():
            for (conv,), rows in _runs(batches, 1):
                own, gap = hashlib.sha256(), b""
                for _, _part, _at, role, text in rows:
                    own.update(gap + f"{role}:{text}".encode())
                    gap = b"\n"
                yield conv, own.hexdigest()

        yield from _sent(made(), schema)

    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at").mapInArrow(run, f"conv_id {name}, repaired_sha256 string")


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs rows (conv_id, turn, role, text, n): figures a conversation, and its turns after the edits.

    Figures: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; turns as of `repaired_turns`.
    `n` counts copies of a row.
    """
    turns = in_ranges(small_batches(rows))
    plan = written(plan_repairs(turns), "repairs")
    figures = plan.where("audit IS NOT NULL").drop("part", "state", "piece")
    return figures, repaired_turns(turns, plan)


def repair_report(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of the table: the figures of its damaged rows' repair and the digest of what results."""
    figures, turns = repair_conversations(damaged(conversations))
    everyone = conversations.select(F.col("conv_id").alias("own")).distinct()
    figures = everyone.join(figures, F.col("own").eqNullSafe(figures["conv_id"]), "left").drop("conv_id")
    hashes = digests(turns)
    out = figures.join(hashes, F.col("own").eqNullSafe(hashes["conv_id"]), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("own").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))
