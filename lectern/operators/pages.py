"""Pages made of many rows: topics, days, charts, links. Fact tables are the truth; text is the last step."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import config as C
from lectern.functions import text as T
from lectern.operators.batch import first_of
from lectern.operators.folds import in_order
from lectern.operators.scans import in_blocks, running


def _lines(order: Column, line: Column, between: str = "\n") -> Column:
    """Lines of a group in order: an aggregate."""
    own = F.array_sort(F.collect_list(F.struct(order.alias("order"), line.alias("line"))))
    return F.array_join(F.transform(own, lambda x: x["line"]), between)


def add_topic_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries (topic_slug, link_id, entry_date, seq, line) that a topic lacks come in, once; none change."""
    key = ["topic_slug", "link_id"]
    first = first_of(new.select(*old.columns), key, "seq").select(*old.columns)
    return old.unionByName(first.join(old.select(*key), key, "left_anti"))


def topic_days(entries: DataFrame) -> DataFrame:
    """A topic's dated sections: a row each, `place` 1 for the newest, so that a page reads only its own."""
    days = entries.groupBy("topic_slug", "entry_date").agg(F.count(F.lit(1)).alias("entry_count"), _lines(F.col("seq"), F.col("line")).alias("lines"))
    place = F.row_number().over(Window.partitionBy("topic_slug").orderBy(F.col("entry_date").desc()))
    section = F.concat(F.lit("## "), F.date_format("entry_date", "yyyy-MM-dd"), F.lit("\n\n"), "lines")
    return days.select("topic_slug", "entry_date", "entry_count", place.alias("place"), section.alias("section"))


def lines_in_parts(rows: DataFrame, keys: list[str], order: list[str], line: str, most: int = C.SECTION_LINES) -> DataFrame:
    """(*keys, part, line_count, lines): each key's lines in order, `most` to a row, parts from 1.

    A hot key's lines are numbered in blocks, so that no row and no task holds all of them. `order` tells a key's rows apart.
    """
    numbered = running(in_blocks(rows.select(*keys, *order, F.col(line).alias("_line")), keys, order), keys, order, n=("sum", F.lit(1).cast("long"), 0))
    part = (F.floor((F.col("n") - 1) / most) + 1).cast("int").alias("part")
    return numbered.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("line_count"), _lines(F.col("n"), F.col("_line")).alias("lines"))


def topic_day_parts(entries: DataFrame, most: int = C.SECTION_LINES) -> DataFrame:
    """`topic_days` for days of any size: a section falls into rows of at most `most` lines, the first with the heading.

    A section's text is its parts in order, joined by newlines.
    """
    parts = lines_in_parts(entries, ["topic_slug", "entry_date"], ["seq", "link_id"], "line", most)
    head = F.when(F.col("part") == 1, F.concat(F.lit("## "), F.date_format("entry_date", "yyyy-MM-dd"), F.lit("\n\n"))).otherwise("")
    return parts.select("topic_slug", "entry_date", "part", "line_count", F.concat(head, "lines").alias("section"))


def topic_heads(entries: DataFrame, topics: DataFrame) -> DataFrame:
    """Front matter of topics that got entries: created_date of known ones stays, counts are counted anew."""
    got = entries.groupBy("topic_slug").agg(F.min("entry_date").alias("first"), F.max("entry_date").alias("last_updated_date"), F.count(F.lit(1)).alias("article_count"))
    known = topics.select("topic_slug", F.col("created_date").alias("known_date"))
    return got.join(known, "topic_slug", "left").select("topic_slug", T.humanize_slug(F.col("topic_slug")).alias("title"), F.coalesce("known_date", "first").alias("created_date"), "last_updated_date", "article_count")


def daily_sections(rows: DataFrame, days: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Sections of each day's page, in order of (part, topic_slug): highlights, look back, topics, figures.

    `rows` (doc_date, pos, topic_slug, link_id, gist); `days` (doc_date) are pages there are already.
    `chosen` (doc_date, place, gist) are the highlights that a selector named; without it a day's first ones are taken.
    """
    order = Window.partitionBy("doc_date").orderBy("pos")
    top = chosen if chosen is not None else rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= C.HIGHLIGHTS)
    head = lambda title, body: F.concat(F.lit(f"## {title}\n\n"), body)
    section = lambda frame, part, slug, text: frame.select("doc_date", F.lit(part).alias("part"), slug.alias("topic_slug"), text.alias("section"))
    gists = top.groupBy("doc_date").agg(_lines(F.col("place"), F.concat(F.lit("- "), "gist")).alias("lines"))
    own = rows.select("doc_date").distinct()
    before = own.join(days.select(F.date_add("doc_date", 1).alias("doc_date")).distinct(), "doc_date", "left_semi")
    topics = rows.groupBy("doc_date", "topic_slug").agg(_lines(F.col("pos"), F.concat(F.lit("- [["), "link_id", F.lit("]] "), "gist")).alias("lines"))
    figures = rows.groupBy("doc_date").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("topic_slug").alias("topics"))
    none = F.lit("")
    return (
        section(gists, 1, none, head("TL;DR", F.col("lines")))
        .unionByName(section(before, 2, none, head("昨日回顾", F.concat(F.lit("[["), F.date_format(F.date_sub("doc_date", 1), "yyyy-MM-dd"), F.lit("]]")))))
        .unionByName(section(topics, 3, F.col("topic_slug"), F.concat(T.topic_heading(F.col("topic_slug")), F.lit("\n\n"), "lines")))
        .unionByName(section(figures, 4, none, head("本日数据统计", F.format_string("- 收录：%d\n- 话题：%d", "n", "topics"))))
    )


def volume_chart(counts: DataFrame, title: str) -> DataFrame:
    """Counts a day (doc_date, n) of a window as one bar chart; no row for no days."""
    label = F.concat(F.lit('"'), F.date_format("doc_date", "MM-dd"), F.lit('"'))
    got = counts.agg(_lines(F.col("doc_date"), label, ", ").alias("labels"), _lines(F.col("doc_date"), F.col("n").cast("string"), ", ").alias("bars"), F.max("n").alias("top"))
    above = (F.col("top") + F.greatest(F.lit(1), F.floor(F.col("top") / 5))).cast("string")
    code = F.concat(F.lit(f'```mermaid\nxychart-beta\n    title "{title}"\n    x-axis ['), "labels", F.lit(']\n    y-axis "原文数" 0 --> '), above, F.lit("\n    bar ["), "bars", F.lit("]\n```"))
    return got.where(F.col("top").isNotNull()).select(code.alias("chart"))


def share_chart(topics: DataFrame, title: str) -> DataFrame:
    """Topics (topic_slug, total_count) as one pie; a caller limits how many there are."""
    name = F.coalesce(T.topic_mark(F.col("topic_slug")), F.lit("📌"))
    label = F.coalesce(T.topic_label(F.col("topic_slug")), F.col("topic_slug"))
    line = F.concat(F.lit('    "'), name, F.lit(" "), label, F.lit('" : '), F.col("total_count").cast("string"))
    got = topics.agg(_lines(F.struct(-F.col("total_count"), "topic_slug"), line).alias("lines"), F.count(F.lit(1)).alias("n"))
    return got.where("n > 0").select(F.concat(F.lit(f"```mermaid\npie showData\n    title {title}\n"), "lines", F.lit("\n```")).alias("chart"))


def trend_points(topics: DataFrame, days: int) -> DataFrame:
    """Where each topic lies: share of the window's days, and of the largest topic's count."""
    top = topics.agg(F.max("total_count").alias("top"))
    both = topics.join(F.broadcast(top))  # one row
    x, y = T.chart_coordinate(F.col("active_days") / days), T.chart_coordinate(F.col("total_count") / F.col("top"))
    return both.select("topic_slug", F.concat(F.lit("["), x, F.lit(", "), y, F.lit("]")).alias("point"))


def relationship_chart(edges: DataFrame) -> DataFrame:
    """Edges (page, pos, from_id, from_title, to_id, to_title, relation, label) as a flow chart a page.

    Nodes are named by their first appearance; charts that aren't sound go.
    """
    end = lambda which, i: F.struct((F.col("pos") * 2 + i).alias("at"), F.col(f"{which}_id").alias("id"), F.col(f"{which}_title").alias("title"))
    ends = edges.select("page", F.explode(F.array(end("from", 0), end("to", 1))).alias("end")).select("page", "end.*")
    nodes = ends.groupBy("page", "id").agg(F.min(F.struct("at", "title")).alias("first"))
    number = F.row_number().over(Window.partitionBy("page").orderBy("first.at")) - 1
    nodes = nodes.select("page", "id", "first", F.concat(F.lit("n"), number.cast("string")).alias("alias"))
    alias = lambda which: nodes.select("page", F.col("id").alias(f"{which}_id"), F.col("alias").alias(f"{which}_alias"))
    drawn = edges.join(alias("from"), ["page", "from_id"]).join(alias("to"), ["page", "to_id"])
    agree = F.col("relation") == "corroborates"
    arrow = F.concat(F.when(agree, ' -->|"✅ ').otherwise(' -.->|"⚡ '), T.chart_label(F.col("label")), F.lit('"| '))
    arrows = drawn.groupBy("page").agg(_lines(F.col("pos"), F.concat(F.lit("    "), "from_alias", arrow, F.col("to_alias"))).alias("arrows"))
    box = F.concat(F.lit("    "), "alias", F.lit('["'), T.chart_label(F.col("first.title"), C.NODE_CHARS), F.lit('"]'))
    boxes = nodes.groupBy("page").agg(_lines(F.col("first.at"), box).alias("boxes"))
    code = F.concat(F.lit("```mermaid\nflowchart LR\n"), "boxes", F.lit("\n"), "arrows", F.lit("\n```"))
    return boxes.join(arrows, "page").select("page", code.alias("chart")).where(T.chart_is_sound(F.col("chart")))


def rewrite_wikilinks(pages: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, body) with link targets replaced by the mapping (old_id, new_id); others and all else stay.

    The targets alone join the mapping; a page meets its own new targets by id, and is put together where it is.
    """
    parts = F.split("body", r"\[\[", -1)
    target = lambda part: F.regexp_extract(part, r"(?s)^([^\]|#]+)(?=[\]|#])", 1)
    after = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    asked = pages.select("id", F.explode(F.array_distinct(F.transform(after, target))).alias("old_id")).where("old_id <> ''")
    known = mapping.select("old_id", "new_id").dropDuplicates(["old_id"]).where("new_id IS NOT NULL")
    found = asked.join(F.broadcast(known) if known.count() <= 10_000 else known, "old_id").distinct()
    own = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("old_id", "new_id"))).alias("_new"))
    moved = lambda part: F.concat(F.try_element_at("_new", target(part)), F.substring(part, F.length(target(part)) + 1, F.length(part)))
    body = F.array_join(F.transform(parts, lambda part, i: F.when(i > 0, F.coalesce(moved(part), part)).otherwise(part)), "[[")
    return pages.select("id", "body").join(own, "id", "left").select("id", F.when(F.col("_new").isNull(), F.col("body")).otherwise(body).alias("body"))


def repair_diff(stored: DataFrame, recomputed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, stored, recomputed) where a field's value isn't what it should be; nulls equal nulls."""
    both = stored.select(key, F.struct(*fields).alias("a")).join(recomputed.select(key, F.struct(*fields).alias("b")), key)
    own = [F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("stored"), F.col(f"b.{f}").cast("string").alias("recomputed")) for f in fields]
    return both.select(key, F.explode(F.array(*own)).alias("d")).select(key, "d.*").where(~F.col("stored").eqNullSafe(F.col("recomputed")))


def _pieces(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(slug, minute, piece): stretches of a slug's minutes that no row is moved out of, so that each can be dealt with alone.

    Free minutes are numbered; in order of minutes, whoever asks gets the number of its minute or the one after
    the last given, so that what is given out runs as a maximum of (number - rows before). Who gets which
    depends on `pos`, how far rows are moved at all doesn't. A piece begins where nothing reaches over.
    """
    both = asked.select("slug", "minute", F.lit(1).alias("asks"), F.lit(0).alias("held")).unionByName(held.select("slug", "minute", F.lit(0).alias("asks"), F.lit(1).alias("held")))
    keys, order = ["slug"], ["minute"]
    minutes = in_blocks(both.groupBy("slug", "minute").agg(F.sum("asks").alias("asks"), F.max("held").alias("held")), keys, order)
    ran = running(minutes, keys, order, asked_now=("sum", F.col("asks"), 0), held_now=("sum", F.col("held"), 0))
    number = F.col("minute") - (F.col("held_now") - F.col("held"))
    lead = F.when(F.col("asks") > 0, number - (F.col("asked_now") - F.col("asks")))
    least = -(1 << 40)
    ran = running(ran.withColumn("lead", lead), keys, order, most=("max", F.col("lead"), least))
    ran = running(ran, keys, order, piece=("max", F.when(F.col("lead") == F.col("most"), F.col("minute")), least))
    return ran.select("slug", "minute", "piece")


def note_ids(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Ids `yyyyMMddHHmm-slug` for rows (pos, ts, slug): the first free minute from the row's own on, in order of pos.

    Ids in `taken` (note_id) and of earlier rows aren't free. No id within NOTE_ID_MINUTES is an error.
    A slug with many rows falls into pieces of minutes that don't touch; each is one fold in order.
    """
    minute = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60)
    parts = F.split("note_id", "-", 2)
    held = taken.where(F.col("note_id").rlike(r"^\d{12}-")).select(F.floor(F.unix_seconds(F.to_timestamp(parts[0], "yyyyMMddHHmm")) / 60).alias("minute"), parts[1].alias("slug")).distinct()
    asked = rows.select("pos", minute.alias("minute"), "slug")
    held = held.join(asked.select("slug").distinct(), "slug", "left_semi")
    both = held.select(F.lit(None).cast("long").alias("pos"), "minute", "slug").unionByName(asked).join(_pieces(asked, held), ["slug", "minute"])
    both = both.select("pos", "minute", "slug", F.concat_ws("@", F.col("piece").cast("string"), "slug").alias("key"))

    def step(used: set, row: dict):
        at = row["minute"]
        if row["pos"] is not None:
            last = at + C.NOTE_ID_MINUTES
            while at in used and at <= last:
                at += 1
            if at > last:
                raise ValueError(f"no free id for {row['slug']} within {C.NOTE_ID_MINUTES} minutes")
            yield row["pos"], at, row["slug"]
        used.add(at)

    schema = pa.schema([("pos", pa.int64()), ("minute", pa.int64()), ("slug", pa.string())])
    # nulls come first: what is taken is known before the first row asks
    got = in_order(both, "key", ["pos", "minute"], schema, set, step)
    name = F.concat(F.date_format(F.timestamp_seconds(F.col("minute") * 60), "yyyyMMddHHmm"), F.lit("-"), "slug")
    return got.select("pos", "slug", name.alias("note_id"))


def decide_notes(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """(pos, reused): the note that each row (pos, slug, zettel_id) takes up; null where one is to be made.

    First the id that the index names, if that note exists; then of the notes (id, updated) that end in
    `-slug` the one changed last. A slug is a run of an id's last parts, so that ends join by equality.
    """
    known = notes.select(F.col("id").alias("zettel_id"), F.lit(True).alias("there"))
    parts = F.split("id", "-")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "-"))
    each = notes.where(F.size(parts) > 1).select("id", "updated", F.explode(ends).alias("slug"))
    last = each.join(rows.select("slug").distinct(), "slug", "left_semi").groupBy("slug").agg(F.max_by("id", F.struct("updated", "id")).alias("latest"))
    got = rows.join(known, "zettel_id", "left").join(last, "slug", "left")
    return got.select("pos", F.when(F.col("there"), F.col("zettel_id")).otherwise(F.col("latest")).alias("reused"))
