"""Scans along blocks against plain loops; no source or slug is one task's."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import batch as B
from lectern.operators import pages as P
from lectern.operators.scans import BLOCK, in_blocks, running


@pytest.fixture
def many_blocks(spark):
    """Ranges stay apart on small tables, too."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_running(spark, many_blocks):
    rng = random.Random(1)
    rows = [(rng.choice([None, "hot", "hot", "hot", f"k{i % 9}"]), i, rng.choice([None, *range(-5, 6)])) for i in range(3000)]
    frame = in_blocks(spark.createDataFrame(rows, "k string, i long, x long"), ["k"], ["i"], 7)
    x = F.col("x")
    got = {(r.k, r.i): (r.s, r.least, r.most) for r in running(frame, ["k"], ["i"], s=("sum", x, 0), least=("min", x, 99), most=("max", x, -99)).collect()}
    seen = {}
    for k, i, v in rows:
        own = seen.setdefault(k, [])
        if v is not None:
            own.append(v)
        assert got.pop((k, i)) == (sum(own), min([99, *own]), max([-99, *own]))
    assert not got
    sizes = [r["count"] for r in frame.where("k = 'hot'").groupBy(BLOCK).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 0.5 * sum(sizes)


def test_one_source_has_nearly_all_attempts(spark, many_blocks):
    rng = random.Random(2)
    day = dt.datetime(2026, 7, 5)
    rows = [(rng.choice(["one"] * 30 + ["two", None]), day + dt.timedelta(seconds=i // 3), i, rng.random() < 0.25) for i in range(4000)]
    got = {r.seq: (r.failures, r.state) for r in B.source_health(spark.createDataFrame(rows, "source_name string, ts timestamp, seq long, success boolean")).collect()}
    now = {}
    for name, _, seq, good in rows:
        now[name] = 0 if good else now.get(name, 0) + 1
        assert got[seq] == (now[name], "dead" if now[name] >= 3 else "degraded" if now[name] else "alive")
    assert len(got) == len(rows)


def ids(rows, taken):
    used, out = set(taken), {}
    for pos, ts, slug in sorted(rows):
        at = ts.replace(second=0)
        while f"{at:%Y%m%d%H%M}-{slug}" in used:
            at += dt.timedelta(minutes=1)
        out[pos] = f"{at:%Y%m%d%H%M}-{slug}"
        used.add(out[pos])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_note_ids_in_any_order(spark, many_blocks, seed):
    """Rows come in an order that isn't that of their minutes, minutes are taken, runs touch."""
    rng = random.Random(seed)
    begin = dt.datetime(2026, 7, 5, 22, 0)
    rows = [(p, begin + dt.timedelta(minutes=rng.randrange(900), seconds=rng.randrange(60)), rng.choice(["hot"] * 8 + ["a", "b-c"])) for p in range(600)]
    taken = {f"{begin + dt.timedelta(minutes=rng.randrange(900)):%Y%m%d%H%M}-{rng.choice(['hot', 'a', 'z'])}" for _ in range(150)}
    held = spark.createDataFrame([(x,) for x in [*taken, "topic-1", "x"]], "note_id string")
    got = {r.pos: r.note_id for r in P.note_ids(spark.createDataFrame(rows, "pos long, ts timestamp, slug string"), held).collect()}
    assert got == ids(rows, taken)


def test_a_slug_falls_into_pieces(spark, many_blocks):
    rows = spark.createDataFrame([(m, "hot") for m in range(0, 9000, 3) for _ in range(2)], "minute long, slug string")
    pieces = P._pieces(rows, rows.limit(0))
    assert pieces.count() == 3000 and pieces.select("piece").distinct().count() == 3000
    chain = spark.createDataFrame([(0, "s"), (0, "s"), (0, "s"), (1, "s"), (4, "s"), (6, "s")], "minute long, slug string")
    assert {(r.minute, r.piece) for r in P._pieces(chain, chain.limit(0)).collect()} == {(0, 0), (1, 0), (4, 4), (6, 6)}


def test_no_free_minute_is_an_error(spark):
    rows = spark.createDataFrame([(p, dt.datetime(2026, 7, 5), "a") for p in range(62)], "pos long, ts timestamp, slug string")
    with pytest.raises(Exception, match="no free id"):
        P.note_ids(rows, spark.createDataFrame([], "note_id string")).collect()
