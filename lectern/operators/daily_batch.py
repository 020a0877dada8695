"""A batch from entries to records: what is new is judged and written, what is known is taken as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import urls as U
from lectern.operators import annotate as A
from lectern.operators import batch as B
from lectern.operators import pages as P
from lectern.operators.folds import cut


def aggregate_batch(entries: DataFrame, documents: DataFrame, index: DataFrame, as_of: Column, annotator: A.Annotator = A.offline) -> dict[str, DataFrame]:
    """`records`, `links` and `context` of a batch; running it again on what it wrote adds no record.

    `entries`: pos, url, title, summary, published, ts. `documents`: id, doc_type, topic_slug,
    zettel_id (an original's note), updated. `index`: normalized_url, first_seen_date, zettel_id.

    An entry whose original exists keeps that document's topic and note and makes no record. The
    others are judged: topics by the annotator and the granularity rule, notes taken up by index or
    slug, or made under a free id. `context` has a row an entry: pos, id, topic_slug, note_id,
    is_new_note, is_recap. Of entries with one URL the first counts.
    """
    first = B.first_of(entries, ["url"], "pos").withColumn("id", T.original_id(F.col("url"))).withColumn("normalized_url", U.index_key(F.col("url")))
    seen = index.select("normalized_url", F.col("first_seen_date").alias("seen"), F.col("zettel_id").alias("index_note"))
    rows = cut(first.join(seen, "normalized_url", "left").withColumn("is_recap", F.coalesce(F.col("seen") != as_of, F.lit(False))))
    originals = documents.where("doc_type = 'original'").select("id", "topic_slug", F.col("zettel_id").alias("note_id"))
    known = rows.join(originals, "id").select("pos", "id", "topic_slug", "note_id", F.lit(False).alias("is_new_note"), "is_recap")
    new = rows.join(originals.select("id"), "id", "left_anti")

    asked = new.select("url", "title", F.col("summary").alias("gist"))
    told = cut(A.assigned(asked, A.answers(asked, annotator)))
    topics = documents.where("doc_type = 'topic'").select(F.col("id").alias("topic_slug"))
    # one row a URL: the rule names rows by `id`
    sized = B.granularity(told.select(F.col("url").alias("id"), "topic_slug"), topics).select(F.col("id").alias("url"), "topic_slug", "is_new")
    judged = cut(new.drop("topic_slug").join(sized, "url").join(told.select("url", "zettel_worthy"), "url").withColumn("slug", T.slugify(F.col("title"), F.col("id"))))

    worthy = judged.where("zettel_worthy")
    notes = documents.where("doc_type = 'zettel'").select("id", "updated")
    decided = P.decide_notes(worthy.select("pos", "slug", F.col("index_note").alias("zettel_id")), notes)
    made = P.note_ids(worthy.join(decided.where("reused IS NULL"), "pos").select("pos", "ts", "slug"), notes.select(F.col("id").alias("note_id")))
    noted = decided.join(made.select("pos", "note_id"), "pos", "left").select("pos", F.coalesce("reused", "note_id").alias("note_id"), F.col("reused").isNull().alias("is_new_note"))
    full = cut(judged.join(noted, "pos", "left").withColumn("is_new_note", F.coalesce("is_new_note", F.lit(False))))

    gist = T.truncate_blurb(F.col("summary"))
    day = F.coalesce("published", as_of)
    record = lambda rows, id_, kind, title, date, body: rows.select(id_.alias("id"), F.lit(kind).alias("doc_type"), title.alias("title"), date.alias("doc_date"), "topic_slug", body.alias("body"))
    note_body = F.concat(F.lit("# "), "title", F.lit("\n\n"), gist, F.lit("\n\n[["), "id", F.lit("]]"))
    lines = full.select("topic_slug", F.col("pos").alias("seq"), "id", F.concat(F.lit("- [["), F.coalesce("note_id", "id"), F.lit("]] "), gist).alias("line"))
    sections = P.topic_days(lines.select("topic_slug", as_of.alias("entry_date"), "seq", F.col("id").alias("link_id"), "line")).select("topic_slug", "section")
    records = (
        record(full, F.col("id"), "original", F.col("title"), day, F.coalesce("summary", F.lit("")))
        .unionByName(record(full.where("is_new_note"), F.col("note_id"), "zettel", F.col("title"), as_of, note_body))
        .unionByName(record(sections, F.col("topic_slug"), "topic", T.humanize_slug(F.col("topic_slug")), as_of, F.col("section")))
    )
    links = full.where("note_id IS NOT NULL").select(F.explode(F.array(F.struct(F.col("id").alias("from_id"), F.col("note_id").alias("to_id")), F.struct(F.col("note_id").alias("from_id"), F.col("id").alias("to_id")))).alias("x")).select("x.*")
    links = links.unionByName(full.select(F.col("topic_slug").alias("from_id"), F.coalesce("note_id", "id").alias("to_id"))).distinct()
    context = known.unionByName(full.select("pos", "id", "topic_slug", "note_id", "is_new_note", "is_recap"))
    return {"records": records, "links": links, "context": context}


def day_figures(context: DataFrame, existing_topics: DataFrame) -> DataFrame:
    """One row: entries of a day, its topics and those of them that are new, notes made and taken up."""
    known = existing_topics.select("topic_slug", F.lit(True).alias("known")).distinct()
    rows = context.join(known, "topic_slug", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_distinct("topic_slug").alias("topics"),
        F.count_distinct(F.when(F.col("known").isNull(), F.col("topic_slug"))).alias("new_topics"),
        F.count_if(F.col("is_new_note")).alias("notes_created"),
        F.count_if(F.col("note_id").isNotNull() & ~F.col("is_new_note")).alias("notes_reused"),
    )
