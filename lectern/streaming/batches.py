"""Streaming forms of the two rules that keep state: source health and the index of URLs seen.

State is a table beside the output, one version a micro-batch, and each batch is a DataFrame job over
its rows and the version before. A batch that runs again reads the same version and overwrites its own
output, so results are whole after a restart or a lost executor. Old versions may be deleted once a
later batch is committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lectern import config as C
from lectern.operators import batch as B
from lectern.operators.store import expire_index

_FAILURES = "source_name string, failures bigint"
_INDEX = "normalized_url string, first_seen_date date, raw_summary_excerpt string, kept_in_daily array<string>, zettel_id string"


def _before(batch: DataFrame, folder: str, number: int, schema: str) -> DataFrame:
    """The state that the batch before left; none before the first."""
    spark = batch.sparkSession
    return spark.read.schema(schema).parquet(f"{folder}/state/{number - 1}") if number else spark.createDataFrame([], schema)


def _put(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)


def health_of_batch(attempts: DataFrame, carried: DataFrame) -> DataFrame:
    """After each attempt: failures since the last success, those of earlier batches included."""
    own = B.failures_so_far(attempts.withColumn("source_name", F.col("source_name").cast("string")))
    rows = own.join(carried.withColumnRenamed("failures", "carried"), "source_name", "left")
    failures = F.col("failures") + F.when(F.col("succeeded"), 0).otherwise(F.coalesce("carried", F.lit(0)))
    return rows.select("source_name", "ts", "seq", failures.alias("failures"), B.health_state(failures).alias("state"))


def source_health(attempts: DataFrame, folder: str) -> DataStreamWriter:
    """Health after each attempt of a stream (source_name, ts, seq, success), in `folder`/out/<batch>."""

    def one(batch: DataFrame, number: int) -> None:
        carried = _before(batch, folder, number, _FAILURES)
        _put(health_of_batch(batch, carried), f"{folder}/out/{number}")
        got = batch.sparkSession.read.parquet(f"{folder}/out/{number}")
        last = got.groupBy("source_name").agg(F.max_by("failures", F.struct("ts", "seq")).alias("failures"))
        _put(carried.join(last, "source_name", "left_anti").unionByName(last), f"{folder}/state/{number}")

    return attempts.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/progress")


def next_index(index: DataFrame, rows: DataFrame, decisions: DataFrame, as_of, batch_name: str) -> DataFrame:
    """The index after a batch: kept keys append its name, new ones come in, expired ones go."""
    live = expire_index(index, as_of)
    kept = decisions.where("decision <> 'drop'")
    again = kept.where("decision <> 'new'").groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    added = F.array_repeat(F.lit(batch_name), F.coalesce("times", F.lit(0)).cast("int"))
    old = live.join(again.withColumnRenamed("key", "normalized_url"), "normalized_url", "left")
    old = old.withColumn("kept_in_daily", F.concat("kept_in_daily", added)).drop("times")
    new = kept.where("decision = 'new'").join(rows.select("pos", "summary"), "pos").join(again, "key", "left")
    new = new.select(
        F.col("key").alias("normalized_url"),
        as_of.alias("first_seen_date"),
        F.substring("summary", 1, C.EXCERPT_CHARS).alias("raw_summary_excerpt"),
        F.concat(F.array(F.lit(batch_name)), added).alias("kept_in_daily"),
        F.lit(None).cast("string").alias("zettel_id"),
    )
    return old.unionByName(new)


def cross_day(entries: DataFrame, folder: str) -> DataStreamWriter:
    """Decisions against the index for a stream of entries with a `run_date`, in `folder`/out/<batch>.

    A micro-batch is one run: its latest run_date is the day it is judged at.
    """

    def one(batch: DataFrame, number: int) -> None:
        day = batch.agg(F.max("run_date")).first()[0]
        if day is None:  # nothing to judge, no day to expire by: the state goes on as it is
            _put(_before(batch, folder, number, _INDEX), f"{folder}/state/{number}")
            return
        as_of = F.lit(day).cast("date")
        index = _before(batch, folder, number, _INDEX)
        _put(B.dedup_cross_day(batch, index, as_of), f"{folder}/out/{number}")
        decisions = batch.sparkSession.read.parquet(f"{folder}/out/{number}")
        _put(next_index(index, batch, decisions, as_of, f"{day}"), f"{folder}/state/{number}")

    return entries.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/progress")
