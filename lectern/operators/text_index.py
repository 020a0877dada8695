"""A positional index of texts: for each word and document the places where it stands, by hashed word.

`folder` holds three tables. `postings` (term, id, at, words) has a row for each word of each document, `at` its
places and `words` the document's length; it is partitioned by batch and by a hash of the word, and sorted by
word, so that a search opens the files of the words asked for and Parquet's statistics skip the rest of
them. A word that all documents hold makes many rows, dealt over tasks by document, never a long one.
`docs` (id, words) has every document. `gone` (id, batch) names what later batches replace: it is filled
when a batch comes in, so that a search reads no list of all documents for it.

A batch may be added again: it replaces itself. Documents whose text is null are never found, and replace what
was there; of rows with one id in a batch one counts, the least by text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.folds import small_batches
from lectern.operators.search import parts, words

BUCKETS = 64
#: Words that are sorted at once.
WORDS = 1 << 20
#: Tasks over which the rows of a word are dealt.
SPREAD = 16
#: Parts in which a batch's rows are sorted, at least: small ones, so that no sort spills.
PARTS = 192
#: Ids given more than once that are sent to all tasks, at most; texts of more are joined by a shuffle.
REPEATS = 10_000


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _places(docs: DataFrame) -> DataFrame:
    """(term, id, at, words) of docs (id, own): one pass over the documents' words, without a shuffle."""

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column("own")
        sizes = own.value_lengths().to_numpy().astype(np.int64)
        coded = own.flatten().dictionary_encode()
        codes, n = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
        doc = np.repeat(np.arange(len(own)), sizes)
        order = np.argsort(doc * n + codes, kind="stable")
        keys = (doc * n + codes)[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        at = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)), pa.int32()), pa.array(at, pa.int32()))
        whose = keys[first] // n
        return pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(keys[first] % n)), batch.column("id").take(pa.array(whose)), lists, pa.array(sizes[whose])], ["term", "id", "at", "words"]
        )

    def run(batches):
        for batch in batches:
            ends = np.cumsum(batch.column("own").value_lengths().to_numpy())
            at = 0
            while at < batch.num_rows:  # documents of about WORDS words, or one
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + WORDS)))
                yield listed(batch.slice(at, to - at))
                at = to

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"term string, id {kind}, at array<int>, words long")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:  # nothing is there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def _put(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _one_text(docs: DataFrame) -> DataFrame:
    """(id, text): the least text of each id, nulls aside. Only texts whose id comes again are shuffled."""
    docs = docs.where("text IS NOT NULL")
    counted = docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    again = counted.limit(REPEATS + 1).collect()
    if not again:
        return docs
    ids = counted if len(again) > REPEATS else F.broadcast(docs.sparkSession.createDataFrame(again, counted.schema))
    least = docs.join(ids, docs["id"].eqNullSafe(ids["id"]), "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    return docs.join(ids, docs["id"].eqNullSafe(ids["id"]), "left_anti").unionByName(least)


def add_batch(folder: str, docs: DataFrame, batch: int) -> None:
    """Adds documents (id, text) as batch number `batch`; what they replace is of smaller numbers."""
    spark = docs.sparkSession
    one = small_batches(_one_text(docs.select("id", "text"))).select("id", words(F.col("text")).alias("own"))
    bucket, salt = bucket_of(F.col("term")), F.pmod(F.xxhash64("id"), F.lit(SPREAD))
    dealt = max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the bucket is made anew after the shuffle; the batch is in the path, as the write would else sort again, by batch and bucket alone
    rows = _places(one).repartition(dealt, bucket, salt).withColumn("bucket", bucket).sortWithinPartitions("bucket", "term", "id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{folder}/postings/batch={batch}")
    _put(one.select("id", F.size("own").cast("long").alias("words"), F.lit(batch).alias("batch")), f"{folder}/docs", "batch")
    before = spark.read.parquet(f"{folder}/docs").where(F.col("batch") < batch).select("id", "batch")
    replaced = before.join(docs.select("id").distinct(), "id", "left_semi")
    _put(replaced.select("id", F.col("batch").alias("old"), F.lit(batch).alias("batch")), f"{folder}/gone", "batch")


def _live(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    if gone is None:
        return rows
    return rows.join(gone.select("id", F.col("old").alias("batch")).distinct(), ["id", "batch"], "left_anti")


def lists_of(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """The postings of `terms`: only their buckets' files are opened."""
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"))).distinct().collect()]
    rows = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    return rows.select("term", "id", "at", "words", "batch")


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def find(spark: SparkSession, folder: str, asked: str) -> DataFrame:
    """(id, hits, words): the documents that the search string finds, as `search.search` over their texts does."""
    alternatives = parts(asked)
    terms = sorted({w for own in alternatives for _, x in own for w in x})
    sought = {w for own in alternatives for wanted, x in own if wanted for w in x}
    docs, gone = spark.read.parquet(f"{folder}/docs"), _stored(spark, f"{folder}/gone")
    if not terms:
        return docs.limit(0).select("id", F.lit(0).cast("long").alias("hits"), "words")
    # a document's lists of the words asked for: as many as the string has words, at most
    lists = [F.first(F.when(F.col("term") == t, F.col("at")), True).alias(f"t{i}") for i, t in enumerate(terms)]
    rows = lists_of(spark, folder, terms).groupBy("id", "batch").agg(F.first("words").alias("words"), *lists)
    if not all(any(wanted for wanted, _ in own) for own in alternatives):
        # what only excludes is met by documents that hold none of the words
        rows = docs.select("id", "batch", "words").join(rows.drop("words"), ["id", "batch"], "left")
    at = {t: F.col(f"t{i}") for i, t in enumerate(terms)}

    def there(own: list[str]) -> Column:
        if len(own) == 1:
            return at[own[0]].isNotNull()
        # places where the phrase would begin, by each of its words
        begins = [_moved(at[w], k) for k, w in enumerate(own)]
        return F.coalesce(F.size(reduce(F.array_intersect, begins)) > 0, F.lit(False))

    met = [reduce(Column.__and__, [there(x) if wanted else ~there(x) for wanted, x in own]) for own in alternatives]
    hits = reduce(Column.__add__, [F.coalesce(F.size(at[t]), F.lit(0)) if t in sought else F.lit(0) for t in terms])
    found = rows.where(reduce(Column.__or__, met)).select("id", "batch", hits.cast("long").alias("hits"), "words")
    return _live(found, gone).select("id", "hits", "words")
