"""The tables of a collection cut into buckets by a hash of their keys, so that a batch rewrites what it touches.

A batch goes in by three steps, each whole before the next: the new rows of the touched buckets are written beside
the tables (`staged`), a mark says that they are ready, they take the buckets' places, and a second mark says
that they have. A run killed before the first mark has changed nothing and is made again; one killed
after it is finished from what is staged, never computed from half-changed tables. A batch
that is done does nothing when it comes again, so steps that add (a note's id, a link) happen once.

One writer at a time. Frames read before a batch went in must be read again after it. Rows without a key aren't kept. Of
records with one id the last `version` counts (of equal ones the greatest row), but the links of all are added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import urls as U
from lectern.operators import store as K

#: The column by which each table is cut.
KEYS = {"documents": "doc_id", "tags": "doc_id", "links": "from_id", "url_index": "normalized_url"}


class BucketStore:
    """`buckets` is fixed for a folder: at 100 TB some thousands, so that one bucket is some tens of GB at most."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def create(self, tables: dict[str, DataFrame]) -> None:
        for name, key in KEYS.items():
            self._put(tables[name].where(F.col(key).isNotNull()), name, f"{self.folder}/{name}", range(self.buckets))

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets: other files aren't opened."""
        rows = self.spark.read.parquet(f"{self.folder}/{name}")
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(list(buckets)))
        return rows.where(F.col(KEYS[name]).isNotNull()).drop("bucket")

    def write(self, batch: str, records: DataFrame) -> bool:
        """Writes a batch's records; False if it was done before.

        `records` has the documents' columns, among them `doc_id` and `frontmatter` (JSON), and `version`, `tags` and `link_targets`. A
        record whose frontmatter names a source_url and a related_zettel_id gives that URL's row in the index its note.
        """
        self.recover()
        if not self._marks().where(F.col("batch") == batch).isEmpty():
            return False
        self._stage(batch, records)
        self._mark(batch, "ready")
        self.recover()
        return True

    def recover(self) -> None:
        """Finishes a batch that is ready and not done; there is one at most, as each write begins with this."""
        steps = self._marks().groupBy("batch").agg(F.array_contains(F.collect_set("step"), "done").alias("done"))
        for row in steps.where("NOT done").collect():
            self._apply(row["batch"])
            self._mark(row["batch"], "done")

    def dangling(self, batch: str) -> DataFrame:
        """Links (from_id, to_id) of a batch that weren't added, as nothing has the id they lead to."""
        return self.spark.read.parquet(f"{self.folder}/staged/{batch}/dangling")

    def _apply(self, batch: str) -> None:
        for name in KEYS:
            form = self.spark.read.parquet(f"{self.folder}/{name}").schema  # a batch that touches no bucket of a table stages no file
            _overwrite(self.spark.read.schema(form).parquet(f"{self.folder}/staged/{batch}/{name}"), f"{self.folder}/{name}", "dynamic")

    def _stage(self, batch: str, records: DataFrame) -> None:
        records = records.where("doc_id IS NOT NULL")
        documents = self.table("documents")
        last = records.groupBy("doc_id").agg(F.max(F.struct("version", F.struct(*[c for c in records.columns if c not in ("doc_id", "version")]).alias("row"))).alias("x"))
        last = last.select("doc_id", "x.version", "x.row.*")
        at = self._touched(records.select("doc_id"))
        self._rewrite(batch, "documents", at, lambda old: K.upsert(old, last.select(*documents.columns, "version"), "doc_id"))
        self._rewrite(batch, "tags", at, lambda old: K.replace_tags(old, last.select("doc_id", "tags")))

        wanted = records.select(F.col("doc_id").alias("from_id"), F.explode("link_targets").alias("to_id")).where("to_id IS NOT NULL").distinct()
        ends = self._touched(wanted.select("to_id"))
        ids = self.table("documents", ends).select("doc_id").unionByName(records.select("doc_id")).distinct().withColumnRenamed("doc_id", "to_id")
        sound = wanted.join(ids, "to_id", "left_semi")
        self._rewrite(batch, "links", self._touched(sound.select("from_id")), lambda old: old.unionByName(sound.select(*old.columns)).distinct())
        wanted.join(ids, "to_id", "left_anti").select("from_id", "to_id").write.mode("overwrite").parquet(f"{self.folder}/staged/{batch}/dangling")

        of = lambda field: F.get_json_object("frontmatter", f"$.{field}")
        named = records.select(U.index_key(of("source_url")).alias("normalized_url"), of("related_zettel_id").alias("zettel_id"), "version", "doc_id", of("source_url").alias("url"))
        named = named.where("url <> '' AND zettel_id <> ''")
        notes = named.groupBy("normalized_url").agg(F.max_by("zettel_id", F.struct("version", "doc_id", "zettel_id")).alias("zettel_id"))
        self._rewrite(batch, "url_index", self._touched(notes.select("normalized_url")), lambda old: K.set_once(old, notes, "normalized_url", "zettel_id"))

    def _rewrite(self, batch: str, name: str, at: list[int], rule) -> None:
        self._put(rule(self.table(name, at)), name, f"{self.folder}/staged/{batch}/{name}", at)

    def _touched(self, keys: DataFrame) -> list[int]:
        """Numbers of the buckets of `keys`, a table of one column: `buckets` of them at most."""
        return sorted(r[0] for r in keys.select(self._bucket(keys.columns[0])).distinct().collect())

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int").alias("bucket")

    def _put(self, rows: DataFrame, name: str, path: str, at) -> None:
        """A row without a key for each bucket, so that one that was emptied is written as well."""
        marks = self.spark.range(self.buckets).select(F.col("id").cast("int").alias("bucket")).where(F.col("bucket").isin(list(at)))
        full = rows.select("*", self._bucket(KEYS[name])).unionByName(marks, allowMissingColumns=True)
        _overwrite(full, path, "static")

    def _marks(self) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.folder}/marks")
        except AnalysisException as e:  # no batch came yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.range(0).select(F.lit("").alias("batch"), F.lit("").alias("step"))

    def _mark(self, batch: str, step: str) -> None:
        self.spark.range(0, 1, 1, 1).select(F.lit(batch).alias("batch"), F.lit(step).alias("step")).write.mode("append").parquet(f"{self.folder}/marks")


def _overwrite(rows: DataFrame, path: str, mode: str) -> None:
    """By bucket, one too large for a task in several files. A bucket is replaced when all tasks have written."""
    rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(path)


def rows_of(store: BucketStore) -> DataFrame:
    """All that a store holds in one form (part, a, b): documents' titles, tags, links and the notes of URLs."""
    shapes = {"documents": ("doc_id", "title"), "tags": ("doc_id", "tag"), "links": ("from_id", "to_id"), "url_index": ("normalized_url", "zettel_id")}
    parts = [store.table(name).select(F.lit(name).alias("part"), F.col(a).alias("a"), F.col(b).alias("b")) for name, (a, b) in shapes.items()]
    return reduce(DataFrame.unionByName, parts)
