"""Rules whose result depends on the order of rows, and the groups within which it does."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a fold gives out at once.
OUT_ROWS = 10_000
#: Narrow rows that a task groups, sorts or joins, about.
PART_ROWS = 500_000
#: Rows with whole texts that go to a task's Python at once.
TEXT_ROWS = 500


def in_order(rows: DataFrame, key: str, order: list[str], schema: pa.Schema, begin: Callable, step: Callable, end: Callable | None = None) -> DataFrame:
    """One pass over each key's rows in order: what `step(state, row)` and `end(state)` give, as rows.

    `begin()` makes a key's state. Spark deals the keys to tasks and sorts them there, spilling where
    it must; a task then holds one state and one batch, never a key's rows. `step` and `end` yield
    tuples that fit `schema`.
    """

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, some, out = None, None, False, []
        for batch in batches:
            for row in batch.to_pylist():
                if not some or row[key] != now:
                    if some and end:
                        out += end(state)
                    state, now, some = begin(), row[key], True
                out += step(state, row)
                if len(out) >= OUT_ROWS:
                    yield made(out)
                    out = []
        if some and end:
            out += end(state)
        yield made(out)

    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}
    ddl = ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, ddl)


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, whose rows hold whole texts, after the session's Arrow batches were bounded, so that Python holds few of them.

    The bound stays in the session, as plans read it when they run; a smaller one is left as it is.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXT_ROWS:
        conf.set(name, str(TEXT_ROWS))
    return df


def parts_for(spark: SparkSession, rows: int) -> int:
    """In how many parts so many narrow rows are grouped, sorted or joined, so that a task's share doesn't grow with them."""
    return max(spark.sparkContext.defaultParallelism, rows // PART_ROWS + 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; one of its own in sessions of one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/") if named else _own()


@lru_cache(1)
def _own() -> str:
    return tempfile.mkdtemp(prefix="lectern-", dir="/tmp")


def cut(df: DataFrame) -> DataFrame:
    """`df` from a checkpoint: its lineage ends there. A folder of its own only in sessions of one process."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of the edges (a, b): the smallest node that can be reached.

    Each round takes the smallest component next to a node, then that component's own component, so
    that chains shorten by half; hot nodes are reduced before the shuffle.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    now = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")))
    while True:
        near = both.join(now.toDF("b", "near"), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        low = now.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        onward = low.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = cut(low.join(onward, "component").select("node", "old", F.least("component", "further").alias("component")))
        now = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return now
