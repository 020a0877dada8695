"""Hard negatives by inner product: a distributed nearest-neighbour join over Voronoi cells.

Rows get a coordinate more, sqrt(M^2 - |x|^2) with M the largest norm, anchors a zero: then an inner
product is |a|^2 + M^2 less the squared distance, halved, and high scores are near neighbours. Pivots
are `pivots` rows, chosen by a hash of their ids; every row is assigned to its nearest pivot, and keeps its
distance to it. Anchors of neighbouring cells make a group of about GROUP; large cells make several. What an
anchor seeks lies in a ring around it: no farther than what the pivots themselves already offer, no
nearer than its score's ceiling. For each group and cell the triangle inequality turns the rings into bounds
of a row's distance to its pivot, and rows go to those groups only whose bounds they meet. Pivots decide
how many rows are sent, never which results there are.

A group's rows are dealt to slices by a hash, so that neither a hot cell, label, nor vector is one
task's. Each slice streams its rows past the group's anchors, holding the best so far of each; the slices' best
meet in a window by anchor. Positives are joined within their label, then negatives, in the rings that their
scores give. On vectors without clusters bounds rule little out: each row then meets each group once.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors
of different lengths are filled up with zeros. Repeated rows count as rows; rows with an anchor's own id
are never its partners. Anchors that repeat are mined once, those that share an id but not label and vector each
on their own; positives that repeat are mined once. Squared norms must stay below 2^58, else ValueError. Tables
without rows or anchors give none. Columns of any other name are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

PIVOTS = 128
GROUP = 1024
SLICE_ROWS = 32_768
#: Labels are dealt to so many buckets for the bounds of positives; rows of other labels are left out in the slices.
BUCKETS = 64
POSITIVES, NEGATIVES = 5, 10
#: Rows compared at once, times anchors.
BLOCK = 2 << 20
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank,
    s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def whole_vectors(embeddings: DataFrame, labelled=None) -> DataFrame:
    """(vec_id, label, vector): rows that take part, components as floor(256 * x); `labelled` gives the label."""
    x = F.col("embedding")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(fit, F.lit(False)))
    label = F.col("label") if labelled is None else labelled
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("double")).alias("vector"))


class _Space:
    """Pivots, the largest norm and how components are stored; goes to every task, a few dozen KB."""

    def __init__(self, pivots: list, labels: list, ids: list, dims: int, most: float):
        limits = ((2.0**24, np.float32), (2.0**53, np.float64), (2.0**58, np.int64))
        self.type = next((t for limit, t in limits if most < limit), None)
        if self.type is None:
            raise ValueError("vectors are too long: nine times a score may leave 64 bits")
        self.dims, self.most = dims, most
        self.labels, self.ids = np.array(labels, np.int64), np.array(ids, np.int64)
        self.raw = self.matrix(pivots)
        self.pivots = self.lifted(self.raw)
        self.slack = 1e-6 * (1 + math.sqrt(most))

    def matrix(self, vectors) -> np.ndarray:
        out = np.zeros((len(vectors), self.dims), self.type)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def read(self, column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.type).reshape(-1, self.dims) if self.dims else np.zeros((len(column), 0), self.type)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack((x, np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))))

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        """Distances of points with their last coordinate to the pivots."""
        square = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def anchors_to_pivots(self, x: np.ndarray) -> np.ndarray:
        return self.to_pivots(np.column_stack((x.astype(np.float64), np.zeros(len(x)))))

    def chain(self) -> list[int]:
        """The pivots, each followed by the nearest that is left."""
        far = self.to_pivots(self.pivots)
        order, left = [0], set(range(1, len(self.pivots)))
        while left:
            order.append(min(left, key=lambda j: (far[order[-1], j], j)))
            left.remove(order[-1])
        return order

    def radius(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far rows of that score are from anchors of that squared norm."""
        return np.sqrt(np.maximum(square + self.most - 2 * score, 0))


def _placed(rows: DataFrame, space: _Space) -> DataFrame:
    """(vec_id, label, bucket, vec, cell, dist, name): each row with its nearest pivot; `name` tells rows of one id apart."""

    def run(batches):
        for batch in batches:
            x = space.matrix(batch.column("vector").to_pylist())
            far = space.to_pivots(space.lifted(x))
            cell = far.argmin(1) if len(x) else np.zeros(0, np.int64)
            blobs = [row.tobytes() for row in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(blobs, pa.binary()), pa.array(cell, pa.int32()), pa.array(far[np.arange(len(x)), cell], pa.float64())],
                ["vec_id", "label", "vec", "cell", "dist"],
            )

    made = small_batches(rows).mapInArrow(run, "vec_id long, label long, vec binary, cell int, dist double")
    return made.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")).withColumn("name", F.xxhash64("label", "vec"))


def _grouped(anchors: DataFrame, space: _Space, by_label: bool) -> DataFrame:
    """`anchors` with `grp`: cells along the chain, packed to about GROUP anchors; a larger cell is dealt by id."""
    bucket = F.col("bucket") if by_label else F.lit(-1)
    anchors = anchors.withColumn("ask_bucket", bucket)
    counts = {(r["ask_bucket"], r["cell"]): r["count"] for r in anchors.groupBy("ask_bucket", "cell").count().collect()}  # pivots x buckets at most
    spot = {cell: i for i, cell in enumerate(space.chain())}
    rows, now, held, last = [], -1, 0, None
    for (b, cell), n in sorted(counts.items(), key=lambda x: (x[0][0], spot[x[0][1]])):
        if n > GROUP:
            parts = -(-n // GROUP)
            rows.append((b, cell, now + 1, parts))
            now, held, last = now + parts, GROUP, b
            continue
        if b != last or held + n > GROUP:
            now, held = now + 1, 0
        rows.append((b, cell, now, 1))
        held, last = held + n, b
    table = anchors.sparkSession.createDataFrame(rows, "ask_bucket int, cell int, base int, parts int")
    return anchors.join(F.broadcast(table), ["ask_bucket", "cell"]).withColumn("grp", F.col("base") + F.pmod(F.xxhash64("vec_id", "name"), F.col("parts")).cast("int")).drop("base", "parts")


def _bounds(anchors: DataFrame, space: _Space, positives: int, negatives: int) -> DataFrame:
    """(grp, ask_bucket, cell, lo, hi): how far from its pivot a row of the cell must be to serve an anchor of the group."""

    def run(batches):
        for batch in batches:
            x, ids, labels = space.read(batch.column("vec")), *(batch.column(c).to_numpy() for c in ("vec_id", "label"))
            groups, buckets = (batch.column(c).to_numpy() for c in ("grp", "ask_bucket"))
            far, square = space.anchors_to_pivots(x), (x.astype(np.float64) ** 2).sum(1)
            scores = (x @ space.raw.T).astype(np.float64)
            other = ids[:, None] != space.ids
            if "asks" not in batch.schema.names:
                offers = np.where(other & (labels[:, None] == space.labels), scores, -np.inf)
                low, owner = _nth_best(offers, positives), np.arange(len(x))
                inner = np.zeros(len(x))
            else:
                asks = batch.column("asks").to_pylist()
                owner = np.repeat(np.arange(len(x)), [len(a) for a in asks])
                wanted = np.array([s["score"] for a in asks for s in a], np.int64)
                top, bottom = _band(wanted)
                offers = np.where((other & (labels[:, None] != space.labels))[owner] & (scores[owner] <= top[:, None]), scores[owner], -np.inf)
                low = np.maximum(_nth_best(offers, negatives), bottom)
                inner = space.radius(square[owner], top.astype(np.float64))
            with np.errstate(invalid="ignore"):
                outer = space.radius(square[owner], low)
            lo = np.maximum(far[owner] - outer[:, None], inner[:, None] - far[owner]) - space.slack
            hi = far[owner] + outer[:, None] + space.slack
            for g in np.unique(groups[owner]):
                own = groups[owner] == g
                n = far.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, g), pa.int32()), pa.array(np.full(n, buckets[owner][own][0]), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(lo[own].min(0)), pa.array(hi[own].max(0))],
                    ["grp", "ask_bucket", "cell", "lo", "hi"],
                )

    parts = anchors.mapInArrow(run, "grp int, ask_bucket int, cell int, lo double, hi double")
    return parts.groupBy("grp", "ask_bucket", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _nth_best(offers: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each row, minus infinity where there are fewer."""
    if offers.shape[1] < n:
        return np.full(len(offers), -np.inf)
    return np.partition(offers, offers.shape[1] - n, 1)[:, -n]


def _band(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and least score s of a negative: 30 * positive <= 100 * s <= 90 * positive."""
    return 9 * positive // 10, -(-3 * positive // 10)


class _Best:
    """The `n` best (score, smaller id first) of each of many queries, of rows that come in blocks."""

    def __init__(self, queries: int, n: int, least: np.ndarray):
        self.n, self.least, self.held = n, least, []
        self.queries, self.size = queries, 0

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((query, score.astype(np.int64), ids))
        self.size += len(query)
        if self.size > max(4 * self.queries * self.n, 1 << 16):
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, ...]:
        query, score, ids = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, np.arange(self.queries))
        rank = np.arange(len(query)) - first[query]
        full = query[rank == self.n - 1]
        self.least[full] = np.maximum(self.least[full], score[rank == self.n - 1])
        self.held = [(query[rank < self.n], score[rank < self.n], ids[rank < self.n])]
        self.size = len(self.held[0][0])
        return self.held[0]


_FOUND = "anchor_id long, name long, positive_id long, positive_score long, id long, score long"


def _compared(anchors: list[dict], space: _Space, n: int):
    """A sink for blocks of rows (ids, labels, vectors) and the best of each query at the end."""
    x = space.matrix([np.frombuffer(a["vec"], space.type) for a in anchors])
    ids, labels = (np.array([a[c] for a in anchors], np.int64) for c in ("vec_id", "label"))
    asks = [[(None, None)] if a["asks"] is None else [(s["id"], s["score"]) for s in a["asks"]] for a in anchors]
    owner = np.repeat(np.arange(len(anchors)), [len(a) for a in asks])
    flat = [s for a in asks for s in a]
    negative = bool(flat) and flat[0][0] is not None
    if negative:
        top, bottom = _band(np.array([s for _, s in flat], np.int64))
    best = _Best(len(owner), n, bottom if negative else np.full(len(owner), -(1 << 62)))

    def offer(row_ids, row_labels, rows):
        scores = x @ rows.T  # anchors by rows
        fit = ids[:, None] != row_ids
        fit &= (labels[:, None] != row_labels) if negative else (labels[:, None] == row_labels)
        if negative:
            scores, fit = scores[owner], fit[owner]
            fit &= scores <= top[:, None].astype(scores.dtype)
        fit &= scores >= best.least[:, None].astype(scores.dtype)  # exact: both are whole numbers that the type holds
        q, r = np.nonzero(fit)
        best.offer(q, scores[q, r], row_ids[r])

    def end():
        q, score, found = best.shrink()
        each = lambda values: pa.array([values[i] for i in q.tolist()], pa.int64())
        own = [anchors[i] for i in owner]
        columns = [each([a["vec_id"] for a in own]), each([a["name"] for a in own]), each([s for s, _ in flat]), each([s for _, s in flat]), pa.array(found, pa.int64()), pa.array(score, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["anchor_id", "name", "positive_id", "positive_score", "id", "score"])

    return offer, end


def _best_of(rows: DataFrame, anchors: DataFrame, bounds: DataFrame, space: _Space, slices: int, n: int) -> DataFrame:
    """The best `n` rows for each anchor, or for each of its `asks`: _FOUND of every (group, slice)."""
    spot = F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int")
    sent = rows.join(bounds.withColumnRenamed("cell", "of"), (F.col("cell") == F.col("of")) & F.col("dist").between(F.col("lo"), F.col("hi")) & ((F.col("ask_bucket") == F.col("bucket")) | (F.col("ask_bucket") == -1)))
    asks = F.col("asks") if "asks" in anchors.columns else F.lit(None).cast("array<struct<id: long, score: long>>")
    both = anchors.select("grp", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "vec_id", "name", "label", "vec", asks.alias("asks")).unionByName(
        sent.select("grp", spot.alias("slice"), F.lit(1).alias("kind"), "vec_id", F.lit(0).cast("long").alias("name"), "label", "vec", F.lit(None).cast("array<struct<id: long, score: long>>").alias("asks"))
    )

    def run(batches):
        now, anchors, sink, waiting, held = None, [], None, [], 0

        def flush():
            nonlocal waiting, held
            if waiting:
                sink[0](*(np.concatenate(c) for c in zip(*waiting)))
            waiting, held = [], 0

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("grp", "slice", "kind"))))
            turns = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(turns, turns[1:]):
                part = batch.slice(a, b - a)
                if keys[a][:2] != now:
                    if sink:
                        flush()
                        yield sink[1]()
                    now, anchors, sink = keys[a][:2], [], None
                if keys[a][2] == 0:
                    anchors += part.select(["vec_id", "name", "label", "vec", "asks"]).to_pylist()
                    continue
                sink = sink or _compared(anchors, space, n)
                waiting.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy(), space.read(part.column("vec"))))
                held += b - a
                queries = sum(len(a["asks"] or "1") for a in anchors) if held >= 256 else 0
                if held * queries >= BLOCK:
                    flush()
        if sink:
            flush()
            yield sink[1]()

    found = both.repartition("grp", "slice").sortWithinPartitions("grp", "slice", "kind").mapInArrow(run, _FOUND)
    order = Window.partitionBy("anchor_id", "name", "positive_id", "positive_score").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, pivots: int = PIVOTS) -> DataFrame:
    """Rows of SCHEMA for `rows` (vec_id, label, vector of whole numbers): see the module.

    `is_anchor` is a condition on vec_id.
    """
    spark = rows.sparkSession
    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("most"), F.max(F.size("vector")).alias("dims")).first()
    if not about["n"]:
        return spark.createDataFrame([], SCHEMA)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    space = _Space([r["vector"] for r in chosen], [r["label"] for r in chosen], [r["vec_id"] for r in chosen], about["dims"], about["most"])
    placed = written(_placed(rows, space), "placed")
    slices = -(-about["n"] // SLICE_ROWS)
    anchors = placed.where(is_anchor).dropDuplicates(["vec_id", "label", "vec"])

    asking = _grouped(anchors, space, by_label=True)
    near = _best_of(placed, asking, _bounds(asking, space, positives, negatives), space, slices, positives)
    asks = near.groupBy(F.col("anchor_id").alias("vec_id"), "name").agg(F.array_sort(F.collect_set(F.struct("id", "score"))).alias("asks"))
    asks = written(anchors.join(asks, ["vec_id", "name"]), "asks")  # at most `positives` an anchor

    asking = _grouped(asks, space, by_label=False)
    got = _best_of(placed, asking, _bounds(asking, space, positives, negatives), space, slices, negatives)
    return got.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the table: labels of ids divisible by 7 are shifted, ids divisible by 100 are anchors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(whole_vectors(embeddings, label), F.col("vec_id") % 100 == 0)
