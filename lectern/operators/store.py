"""Merges as whole-table expressions: what the tables hold after a batch of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import config as C
from lectern.functions import text as T
from lectern.operators.folds import parts_for


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key; of new rows with one key the last `version` counts."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), "version").alias("_row")).select("_row.*").drop("version")
    return old.join(last.select(key), key, "left_anti").unionByName(last.select(*old.columns))


def upsert_articles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Articles by URL: all columns of a new row replace the old one's, and its status is `enriched`."""
    texts = [f.name for f in new.schema.fields if f.dataType.simpleString() == "string" and f.name != "url"]
    clean = new.withColumns({c: T.strip_nul(F.col(c)) for c in texts}).withColumn("status", F.lit("enriched"))
    return upsert(old, clean, "url")


def backfill_candidates(documents: DataFrame, articles: DataFrame, tags: DataFrame, cutoff: Column) -> DataFrame:
    """Originals from `cutoff` on whose article waits for its full text: what a refresh must keep.

    `documents` has id, doc_type, doc_date and frontmatter (JSON); `articles` url, title and pending,
    which may be null and then isn't waited for; `tags` doc_id and tag. Documents without tags have [].
    """
    of = lambda field: F.get_json_object("frontmatter", f"$.{field}").alias(field)
    own = tags.groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    rows = documents.where((F.col("doc_type") == "original") & (F.col("doc_date") >= cutoff)).select("id", "doc_date", of("source_url"), of("topic_slug"), of("related_zettel_id"))
    waiting = articles.where(F.coalesce("pending", F.lit(False))).select(F.col("url").alias("source_url"), "title")
    got = rows.join(waiting, "source_url").join(own, "id", "left")
    return got.select("id", "doc_date", F.col("source_url").alias("url"), "topic_slug", "related_zettel_id", "title", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def refreshed(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """Records of originals whose full text has come since: (id, title, body, doc_date, topic_slug, related_zettel_id, tags).

    `candidates` are those of `backfill_candidates`, `articles` (url, title, translated, original) what was read
    anew. Only title and body come from the article; an article's own date, even a missing one, moves nothing.
    A candidate without an article gives no record, so that its document stays; of two articles with one URL
    the greatest counts.
    """
    one = articles.groupBy("url").agg(F.max(F.struct("translated", "original", F.col("title").alias("new_title"))).alias("now"))
    rows = candidates.join(one, "url")
    title = T.strip_nul(F.coalesce(F.nullif("now.new_title", F.lit("")), F.col("title")))
    body = T.strip_nul(T.original_body(F.col("now.translated"), F.col("now.original")))
    return rows.select("id", title.alias("title"), body.alias("body"), "doc_date", "topic_slug", "related_zettel_id", "tags")


def refresh(documents: DataFrame, records: DataFrame) -> DataFrame:
    """`documents` with the title and body that `records` of `refreshed` have for them; no row is added, no other column changes."""
    new = records.select("id", F.struct("title", "body").alias("_new"))
    rows = documents.join(new, "id", "left")
    changed = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(*[changed(c) if c in ("title", "body") else c for c in documents.columns])


def members(rows: DataFrame, key: str, ids: list | DataFrame) -> DataFrame:
    """Rows whose key is one of `ids`, a short list or a table of one column; none for an empty list."""
    if isinstance(ids, DataFrame):
        return rows.join(ids.toDF(key).distinct(), key, "left_semi")
    return rows.where(F.col(key).isin(ids)) if ids else rows.limit(0)


def replace_tags(old: DataFrame, records: DataFrame) -> DataFrame:
    """Tags of the documents in `records` (doc_id, tags) are replaced whole; an empty list clears them."""
    fresh = records.select("doc_id", F.explode("tags").alias("tag")).distinct()
    return old.join(records.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh.select(*old.columns))


def add_links(old: DataFrame, new: DataFrame, documents: DataFrame, parts: int | None = None) -> DataFrame:
    """Links are only ever added; both ends must exist. `parts`, as `parts_for` has it, bounds what a task holds of many links."""
    ids = documents.select("id").distinct()
    dealt = lambda rows, *keys: rows.repartition(parts, *keys) if parts else rows
    sound = dealt(new, "from_id").join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    sound = dealt(sound, "to_id").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return dealt(old.unionByName(sound.select(*old.columns)), "from_id", "to_id").distinct()


def upsert_index(index: DataFrame, seen: DataFrame, batch: Column) -> DataFrame:
    """Keys seen again append the batch to kept_in_daily and change nothing else; new keys come in."""
    now = seen.select("normalized_url").distinct().withColumn("now", F.lit(True))
    joined = index.withColumn("known", F.lit(True)).join(now, "normalized_url", "full_outer")
    again = F.concat("kept_in_daily", F.array(batch))
    kept = F.when(F.col("known").isNull(), F.array(batch)).when(F.col("now"), again).otherwise(F.col("kept_in_daily"))
    return joined.select("normalized_url", "first_seen_date", kept.alias("kept_in_daily"))


def expire_index(index: DataFrame, as_of: Column, days: int = C.INDEX_TTL_DAYS) -> DataFrame:
    return index.where(F.col("first_seen_date") >= F.date_sub(as_of, days))


def set_once(index: DataFrame, notes: DataFrame, key: str, column: str) -> DataFrame:
    """Fill one column by key, where a value comes in; all else stays."""
    came = notes.groupBy(key).agg(F.max(column).alias("_new"))
    rows = index.join(came, key, "left")
    return rows.select(*[F.coalesce("_new", column).alias(column) if c == column else F.col(c) for c in index.columns])


def write_batch(tables: dict[str, DataFrame], records: DataFrame, folder: str) -> dict[str, DataFrame]:
    """A batch's records into documents, tags and links, in that order; the new versions.

    `records` has the documents' columns, `version`, `tags` and `link_targets`. Each table is written
    below `folder` and read again, so that links see the documents of the same batch; a second run of
    a batch writes the same. Links with an end that doesn't exist aren't added: `dangling` has them.
    """
    spark = records.sparkSession

    def put(name: str, frame: DataFrame) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    documents, tags, links = (tables[n] for n in ("documents", "tags", "links"))
    last = records.groupBy("doc_id").agg(F.max_by(F.struct(*records.columns), "version").alias("_row")).select("_row.*")
    now = put("documents", upsert(documents, last.select(*documents.columns, "version"), "doc_id"))
    own = put("tags", replace_tags(tags, last.select("doc_id", "tags")))
    wanted = last.select(F.col("doc_id").alias("from_id"), F.explode("link_targets").alias("to_id")).where("from_id <> to_id").distinct()
    ids = now.select(F.col("doc_id").alias("id"))
    both = put("links", add_links(links, wanted, ids, parts_for(spark, links.count())))
    dangling = put("dangling", wanted.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select("from_id", "to_id"))
    return {"documents": now, "tags": own, "links": both, "dangling": dangling}
