"""Plans before changes: documents of an older folder, and originals to fetch again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import urls as U

NOTE_ID = r"^\d{12}-.+"
DAY_ID = r"^\d{4}-\d{2}-\d{2}$"
DAY = r"^## (\d{4}-\d{2}-\d{2})"


def topic_blocks(topics: DataFrame) -> DataFrame:
    """(slug, day, block): the dated blocks of topic pages (slug, body), a row each."""
    block = F.explode(T.topic_sections(F.col("body")))
    rows = topics.select("slug", block.alias("block"))
    inside = F.regexp_replace(F.regexp_replace("block", r"\A[^\n]*\n?", ""), r"\A\n+|\n+\z", "")
    return rows.select("slug", F.regexp_extract("block", DAY, 1).alias("day"), inside.alias("block"))


def migrate_plan(legacy: DataFrame, documents: DataFrame, index: DataFrame, as_of: Column) -> DataFrame:
    """(kind, old_id, new_id, action, doc_date, gist) for each row of an older folder.

    `legacy`: kind (original, zettel, topic, daily, digest), old_id, source_url, dated (as written), body.
    `documents`: id, body. `index`: normalized_url, zettel_id. What exists wins: action is `skip`
    for an id that is there, and for a note whose source has one. Originals get the id of their URL and
    are left out without one; ids of notes and days must look like such. Topics that exist are `merge`d
    where they lack days, and skipped where they don't.
    """
    there = documents.select(F.col("id").alias("new_id"), F.lit(True).alias("there"))
    noted = index.where("zettel_id IS NOT NULL").select("normalized_url", F.lit(True).alias("noted")).dropDuplicates(["normalized_url"])
    kind = F.col("kind")
    sound = F.when(kind == "original", F.coalesce("source_url", F.lit("")) != "").when(kind == "zettel", F.col("old_id").rlike(NOTE_ID)).when(kind.isin("daily", "digest"), F.col("old_id").rlike(DAY_ID)).otherwise(True)
    rows = legacy.where(sound).withColumn("new_id", F.when(kind == "original", T.original_id(F.col("source_url"))).otherwise(F.col("old_id")))
    rows = rows.withColumn("normalized_url", U.index_key(F.col("source_url"))).join(there, "new_id", "left").join(noted, "normalized_url", "left")
    missing = missing_blocks(legacy.where("kind = 'topic'").select(F.col("old_id").alias("slug"), "body"), documents).groupBy(F.col("slug").alias("new_id")).agg(F.count(F.lit(1)).alias("lacks"))
    rows = rows.join(missing, "new_id", "left")
    exists = F.coalesce("there", F.lit(False))
    action = (
        F.when((kind == "topic") & exists & F.col("lacks").isNotNull(), "merge")
        .when(exists | ((kind == "zettel") & F.coalesce("noted", F.lit(False))), "skip")
        .otherwise("create")
    )
    bare = T.without_title_block(F.col("body"))
    gist = F.when(kind.isin("original", "zettel"), T.legacy_gist(F.when(kind == "original", bare).otherwise(F.col("body"))))
    return rows.select("kind", "old_id", "new_id", action.alias("action"), T.legacy_date(F.col("dated"), as_of).alias("doc_date"), gist.alias("gist"))


def missing_blocks(topics: DataFrame, documents: DataFrame) -> DataFrame:
    """(slug, day, block) that the older topic pages have and the documents (id, body) of the same name lack."""
    have = topic_blocks(documents.select(F.col("id").alias("slug"), "body")).select("slug", "day")
    return topic_blocks(topics).join(have, ["slug", "day"], "left_anti")


def merged_topics(topics: DataFrame, documents: DataFrame) -> DataFrame:
    """(slug, body) of topic pages after the plan: what is there stays, missing days follow, newest first."""
    lines = F.array_sort(F.collect_list(F.struct("day", "block")), lambda a, b: F.when(a["day"] > b["day"], -1).when(a["day"] < b["day"], 1).otherwise(0))
    block = lambda x: F.concat(F.lit("## "), x["day"], F.lit("\n\n"), x["block"], F.lit("\n"))
    more = missing_blocks(topics, documents).groupBy("slug").agg(lines.alias("own")).select("slug", F.array_join(F.transform("own", block), "\n").alias("more"))
    old = documents.select(F.col("id").alias("slug"), F.regexp_replace("body", r"\n+$", "").alias("old"))
    return more.join(old, "slug", "left").select("slug", F.when(F.col("old").isNull(), F.col("more")).otherwise(F.concat("old", F.lit("\n\n"), "more")).alias("body"))


def refetch_plan(documents: DataFrame, source: DataFrame, fetched: DataFrame, name: str) -> DataFrame:
    """(id, status, title, doc_date, topic_slug, body, word_count): originals of source `name` that were not fetched again yet.

    `documents`: id, doc_type, source_name, source_url, title, doc_date, topic_slug, body, migrated,
    refetched. `source` (source_url): what the source still has. `fetched` (source_url, body): new texts.
    status is `not_found` where the source lacks it, `pending` without a new text, else `updated`: then
    body and word_count are new; title, date and topic never change. What is done once is left out.
    """
    open_ = documents.where((F.col("doc_type") == "original") & (F.col("source_name") == name) & ~F.coalesce("migrated", F.lit(False)) & ~F.coalesce("refetched", F.lit(False)))
    there = source.select("source_url", F.lit(True).alias("there")).dropDuplicates(["source_url"])
    new = fetched.groupBy("source_url").agg(F.max("body").alias("new_body"))
    rows = open_.join(there, "source_url", "left").join(new, "source_url", "left")
    status = F.when(F.col("there").isNull(), "not_found").when(F.col("new_body").isNull(), "pending").otherwise("updated")
    body = F.when(status == "updated", F.col("new_body")).otherwise(F.col("body"))
    return rows.select("id", status.alias("status"), "title", "doc_date", "topic_slug", body.alias("body"), T.word_count(body).alias("word_count"))
