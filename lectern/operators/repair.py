"""What documents taken over from an older folder should hold, where they differ, and the documents put right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import pages as P

FIELDS = ["doc_date", "word_count", "gist", "article_count", "articles_processed", "topics_touched", "body"]


def _files(files: DataFrame) -> DataFrame:
    """(id, doc_type, file): of the files of one document the one whose name comes last; originals without a URL go."""
    kind = F.col("kind")
    own = F.when(kind == "original", T.original_id(F.nullif("source_url", F.lit("")))).when(kind == "digest", F.concat(F.lit("digest-"), "name")).when(kind == "daily", F.col("name"))
    rows = files.select(own.alias("id"), kind.alias("doc_type"), F.struct("name", "dated", "body").alias("file")).where("id IS NOT NULL")
    return rows.groupBy("id", "doc_type").agg(F.max("file").alias("file"))


def recomputed(files: DataFrame, documents: DataFrame, renamed: DataFrame, as_of: Column) -> DataFrame:
    """Migrated documents as they should be, with the columns of `documents`; other documents are left out.

    `files`: kind (original, daily, digest), name, source_url, dated (as written), body. `documents`: id, doc_type,
    migrated, entry_count, topics and FIELDS. `renamed`: old_id, new_id.

    Originals: body without its title block, the date written, counted words, gist. Topics: entries counted in
    their own body. Days and digests: body without title block and with renamed links; days without the figures
    of the newer form get them from entry_count and topics. A document whose file is gone keeps its text.
    """
    held = F.col("file").isNotNull()
    bare = T.without_title_block(F.coalesce("file.body", F.lit("")))
    rows = documents.where(F.coalesce("migrated", F.lit(False))).join(_files(files), ["id", "doc_type"], "left").withColumn("_bare", F.when(held, bare))
    linked = P.rewrite_wikilinks(rows.where("doc_type IN ('daily', 'digest') AND file IS NOT NULL").select("id", F.col("_bare").alias("body")), renamed)
    rows = rows.join(linked.select("id", F.col("body").alias("_linked")), "id", "left")
    kind = F.col("doc_type")
    original = (kind == "original") & held
    older = (kind == "daily") & F.col("articles_processed").isNull()
    right = {
        "doc_date": F.when(original, T.legacy_date(F.col("file.dated"), as_of)),
        "word_count": F.when(original, T.word_count(F.col("_bare")).cast("long")),
        "gist": F.when(original, T.legacy_gist(F.col("_bare"))),
        "article_count": F.when(kind == "topic", T.article_count(F.coalesce("body", F.lit(""))).cast("long")),
        "articles_processed": F.when(older, F.col("entry_count")),
        "topics_touched": F.when(older, F.coalesce(F.array_size("topics"), F.lit(0)).cast("long")),
        "body": F.when(original, F.col("_bare")).when(kind.isin("daily", "digest"), F.col("_linked")),
    }
    return rows.select(*[F.coalesce(right[c], F.col(c)).alias(c) if c in right else c for c in documents.columns])


def repair_plan(documents: DataFrame, right: DataFrame) -> DataFrame:
    """(id, field, stored, recomputed) for what `recomputed` would change; bodies by their SHA-256, so that a report stays small."""
    told = lambda rows: rows.withColumn("body", F.sha2("body", 256))
    return P.repair_diff(told(documents), told(right), "id", FIELDS)


def repaired(documents: DataFrame, right: DataFrame) -> DataFrame:
    """`documents` after the plan: what `right` has replaces its row, the others stay. A second plan is empty."""
    return documents.join(right.select("id"), "id", "left_anti").select(*documents.columns).unionByName(right)
