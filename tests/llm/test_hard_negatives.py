"""Hard negatives against comparing every anchor with every row."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import hard_negatives as H
from lectern.llm.queries import op11_hard_negatives


def plain(rows, relabel=True):
    """Results by loops over (vec_id, label, vector)."""
    kept = []
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((i, (label + 1) % 10 if relabel and i % 7 == 0 else label, tuple(math.floor(256 * x) for x in vector)))
    out = set()
    for anchor in {r for r in kept if r[0] % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(anchor[2], v)), i, label) for i, label, v in kept if i != anchor[0])
        for s, p, _ in [x for x in scored if x[2] == anchor[1]][:5]:
            fit = [x for x in scored if x[2] != anchor[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out |= {(anchor[0], p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fit, 1)}
    return out


def results(df):
    rows = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_whole_query(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = duckdb.sql(f"SELECT vec_id, label, embedding FROM '{path}/embeddings.parquet'").fetchall()
    assert results(op11_hard_negatives(spark, path)) == plain(rows)


def test_small_groups_slices_and_clusters(spark, monkeypatch):
    """Many groups and slices, large cells, ties, one hot label and one hot vector; bounds leave rows out."""
    monkeypatch.setattr(H, "GROUP", 4)
    monkeypatch.setattr(H, "SLICE_ROWS", 300)
    monkeypatch.setattr(H, "BLOCK", 1)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6)) * 3
    rows = []
    for i in range(2400):
        c = 0 if i % 3 == 0 else int(rng.integers(12))
        v = centres[c] + rng.normal(size=6) * (0 if i % 5 == 0 else 0.05)
        rows.append((i, 1 if i % 3 else c % 10, [round(float(x), 2) for x in v]))
    rows += rows[:50] + [(100, 3, [1.0] * 6), (7, 2, [1.0, 2.0]), (200_000, 4, []), (300_000, 5, [1e3])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert results(H.mined(frame)) == plain([(i, c, v + [0.0] * (6 - len(v))) for i, c, v in rows])
    # in clusters, rows go to few groups
    space_rows = H.whole_vectors(frame.where("vec_id < 2400"))
    chosen = space_rows.orderBy(F.xxhash64("vec_id")).limit(64).collect()
    most = space_rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))).first()[0]
    space = H._Space([r.vector for r in chosen], [r.label for r in chosen], [r.vec_id for r in chosen], 6, most)
    placed = H._placed(space_rows, space).cache()
    asking = H._grouped(placed.where("vec_id % 100 = 0"), space, True).cache()
    bounds = H._bounds(asking, space, 5, 10)
    sent = placed.join(bounds, (placed.cell == bounds.cell) & (placed.bucket == bounds.ask_bucket) & placed.dist.between(F.col("lo"), F.col("hi"))).count()
    every = placed.join(asking.select("grp", F.col("ask_bucket").alias("bucket")).distinct(), "bucket").count()
    assert sent < 0.6 * every


@pytest.mark.parametrize("scale", [1, 3e4, 5e5])  # floats of 32 bits, of 64 bits, whole numbers
def test_exact_at_any_size(spark, scale):
    rng = random.Random(9)
    rows = [(i, rng.randrange(3), [rng.uniform(-1, 1) * scale for _ in range(5)]) for i in range(0, 6000, 20)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert results(H.mined(frame)) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.4]), (2, 2, [0.3, 0.3]), (3, None, [0.1, 0.1]), (4, 1, None), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (8, 2, [None, 1.0]), (None, 2, [0.4, 0.4])]
    rows += [(100, 7, [0.2, 0.2]), (200, 1, [0.0, 0.0]), (200, 1, [0.0, 0.0])]
    schema = "vec_id long, label int, embedding array<float>, cell string, dist string, name string, grp int"
    frame = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], schema)
    exact = [(i, c, v and [x if x is None else float(np.float32(x)) for x in v]) for i, c, v in rows]
    assert results(H.mined(frame)) == plain(exact)
    assert H.mined(frame.limit(0)).count() == 0
    assert H.mined(frame.where("vec_id = 1")).count() == 0  # no anchors
    with pytest.raises(ValueError):
        H.mined(spark.createDataFrame([(0, 1, [1e200])], "vec_id long, label int, embedding array<double>"))
