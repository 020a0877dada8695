"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what spark.checkpoint.dir names.

    Where nothing is named a temporary folder serves a session of one process (tests); on a cluster,
    whose executors would each write their own, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="lectern-", dir="/tmp")
    return _LOCAL["dir"]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"


#: Lists of the tables that `written` makes, the innermost `temporary` last.
_MADE: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _MADE:
        _MADE[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession):
    """Tables written inside are deleted at the end: what was made of them must be written by then.

    Yields a function that keeps a table: the enclosing `temporary`, if any, then deletes it.
    """
    made: list[str] = []
    kept: set[str] = set()
    _MADE.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.update(f.rsplit("/", 2)[-2] for f in df.inputFiles())
        return df

    try:
        yield keep
    finally:
        _MADE.pop()
        for path in made:
            if path.rsplit("/", 1)[-1] not in kept:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            elif _MADE:
                _MADE[-1].append(path)


def row_key():
    """128 bits that name a row by its id and text, as a Column; null and empty texts count as one."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(part("doc_id"), F.lit("\n"), part("text"))))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose `row_key` isn't in `gone`, one column; columns of any name are kept."""
    rows = docs.select(row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(gone.toDF("key"), "key", "left_anti").select("row.*")


#: Bits of a membership bitmap: 2**25 bits are 4 MB whatever the number of keys.
BITMAP_BITS = 25


def bitmap_slot(key, bits: int = BITMAP_BITS):
    """Slot of a key in a membership bitmap, as a Column of longs."""
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def membership_bitmap(slots: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of fixed size over the one long column of `slots`.

    Executors build it in pieces of 4 KB; what reaches the driver is 2**bits / 8 bytes at most,
    however many rows there are. It only screens: a full bitmap lets every row pass to the exact
    join that follows.
    """
    (name,) = slots.columns
    spot = F.col(name).cast("long")
    pieces = (
        slots.where(F.col(name).isNotNull())
        .groupBy(F.bitmap_bucket_number(spot).alias("piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))
        .toLocalIterator()
    )
    out = np.zeros((1 << bits) // 8 + 4096, np.uint8)
    for piece, blob in pieces:
        # bucket 1 holds slots 1..32768; slot 0 falls in bucket 0 with position 0
        if piece >= 0:
            at = max(piece - 1, 0) * 4096
            got = np.frombuffer(bytes(blob), np.uint8)
            out[at : at + len(got)] |= got if piece else np.where(np.arange(len(got)) == 0, got & 1, 0).astype(np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots are set, given the layout of `membership_bitmap` (slot s sits at bit s-1)."""
    at = np.maximum(slots.astype(np.int64) - 1, 0)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


#: Rows that go to a task's Python at once; a batch of texts then takes a few MB, not tens.
BATCH_ROWS = 1000
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, after the session's Arrow batches were bounded: whole texts make wide rows.

    The bound stays in the session, as plans read it when they run; a smaller one is left as it is.
    The tasks' Python is told where this package is, for drivers that run elsewhere.
    """
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df
