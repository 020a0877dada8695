"""Weekly and monthly reports as rows of sections, and images put in place. A page is its sections in order of `part`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import config as C
from lectern.functions import text as T
from lectern.functions import urls as U
from lectern.operators import batch as B
from lectern.operators import pages as P


def weekly_sections(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """(part, topic_slug, section) of the report on the rows (id, doc_date, topic_slug, title) of a window.

    Charts come first: volume by day, shares of the trending topics, and where they lie if there are two
    or more. Then a section a trending topic, its newest representatives under it, and the figures. At
    most TREND_TOP topics and REPRESENTATIVES of each: what the report shows, whatever the window holds.
    """
    own = rows.where(F.col("doc_date").between(first, last))
    top = B.trends(own).orderBy(F.col("total_count").desc(), "topic_slug").limit(C.TREND_TOP)
    part = lambda frame, n, slug, text: frame.select(F.lit(n).alias("part"), slug.alias("topic_slug"), text.alias("section"))
    none = F.lit("")
    counts = B.daily_counts(own, first, last)
    points = P.trend_points(top, 7)
    point = F.concat(F.lit("    "), F.coalesce(T.topic_label(F.col("topic_slug")), F.col("topic_slug")), F.lit(": "), "point")
    drawn = points.agg(F.array_sort(F.collect_list(F.struct("topic_slug", point.alias("line")))).alias("own")).where(F.size("own") >= 2)
    quadrant = F.concat(F.lit("```mermaid\nquadrantChart\n    title 话题热度\n    x-axis 偶发 --> 持续\n    y-axis 低 --> 高\n"), F.array_join(F.transform("own", lambda x: x["line"]), "\n"), F.lit("\n```"))
    shown = B.top_by_date(own.join(top.select("topic_slug"), "topic_slug"), "topic_slug", C.REPRESENTATIVES)
    lines = shown.groupBy("topic_slug").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- [["), "id", F.lit("]] "), "title").alias("line")))).alias("own"))
    hint = T.length_tier(F.col("total_count"), C.WEEKLY_TIERS)
    text = F.concat(T.topic_heading(F.col("topic_slug")), F.lit("\n\n"), F.format_string("%d 篇，%d 天，%s", "total_count", "active_days", hint), F.lit("\n\n"), F.array_join(F.transform("own", lambda x: x["line"]), "\n"))
    span = F.concat(F.date_format(first, "yyyy-MM-dd"), F.lit(" ~ "), F.date_format(last, "yyyy-MM-dd"))
    total = own.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("topic_slug").alias("topics"))
    figures = F.concat(F.lit("## 本周数据统计\n\n- 窗口范围："), span, F.format_string("\n- 原文总数：%d\n- 话题：%d", "n", "topics"))
    return (
        part(P.volume_chart(counts.where(F.lit(True)), "每日产出量").join(F.broadcast(total.where("n > 0"))), 1, none, F.col("chart"))  # one row each
        .unionByName(part(P.share_chart(top, "话题占比"), 2, none, F.col("chart")))
        .unionByName(part(drawn, 3, none, quadrant))
        .unionByName(part(top.join(lines, "topic_slug"), 4, F.col("topic_slug"), text))
        .unionByName(part(total, 5, none, figures))
    )


def monthly_sections(rows: DataFrame, clusters: DataFrame, first: Column, last: Column) -> DataFrame:
    """(topic_slug, part, place, section, cited) of the reports on topics that a month has enough of.

    `clusters` (topic_slug, place, heading, ids, analysis) are a topic's lines, sound already; `cited` are
    those of a cluster's own ids that its analysis links to, in their order. Topics without clusters say so.
    """
    own = rows.where(F.col("doc_date").between(first, last))
    due = B.trends(own, C.MONTH_COUNT, C.MONTH_DAYS)
    heads = clusters.groupBy("topic_slug").agg(F.array_sort(F.collect_list(F.struct("place", "heading"))).alias("own"))
    named = F.array_join(F.transform("own", lambda x: F.concat(F.lit("「"), x["heading"], F.lit("」"))), "、")
    label = F.coalesce(T.topic_label(F.col("topic_slug")), F.col("topic_slug"))
    toc = F.concat(F.lit("本月「"), label, F.lit("」识别出 "), F.size("own").cast("string"), F.lit(" 条主要线索："), named, F.lit("。"))
    start = F.concat(T.topic_heading(F.col("topic_slug")), F.lit("\n\n"), F.when(F.col("own").isNotNull(), toc).otherwise("本月没有可归纳的子主题。"))
    nothing = F.array().cast("array<string>")
    links = T.wikilinks(F.col("analysis"))
    figures = F.format_string("## 本月数据统计\n\n- 原文总数：%d\n- 活跃天数：%d", "total_count", "active_days")
    part = lambda frame, n, place, text, cited: frame.select("topic_slug", F.lit(n).alias("part"), place.cast("long").alias("place"), text.alias("section"), cited.alias("cited"))
    lines = clusters.join(due.select("topic_slug"), "topic_slug", "left_semi")
    return (
        part(due.join(heads, "topic_slug", "left"), 1, F.lit(0), start, F.array("topic_slug"))
        .unionByName(part(lines, 2, F.col("place"), F.concat(F.lit("### "), "heading", F.lit("\n\n"), "analysis"), F.array_intersect("ids", links)))
        .unionByName(part(due, 3, F.lit(0), figures, nothing))
    )


def image_uses(pages: DataFrame) -> DataFrame:
    """(id, at, src, alt, use) of every image tag in pages (id, base_url, html); use is skip, video or image.

    Tags without a source, dots, icons and trackers are skipped.
    """
    rows = pages.select("id", "base_url", F.posexplode(T.images(F.col("html"))).alias("at", "image"))
    src = U.resolved(F.col("base_url"), F.col("image.src"))
    host = U.host(F.col("src"))
    tracker = F.lit(False)
    for d in C.TRACKING_DOMAINS:
        tracker = tracker | (host == d) | F.endswith(host, F.lit(f".{d}"))
    path = F.lower(F.regexp_replace("src", r"[?#].*$", ""))
    skip = ~F.col("image.shown") | F.col("src").rlike("(?i)" + "|".join(C.ICON_PATHS)) | tracker
    use = F.when(F.coalesce(skip, F.lit(True)), "skip").when(path.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in C.VIDEO_ENDINGS) + ")$"), "video").otherwise("image")
    return rows.withColumn("src", src).select("id", "at", "src", F.col("image.alt").alias("alt"), use.alias("use"))


def with_images(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, html) with each image tag replaced by what `stored` (src, path) has of it.

    A stored image is shown from its path; one that isn't there leaves a note with a link, as does a
    film; skipped tags go. Pages are cut at their tags, the sources join, and the parts are put together.
    """
    kept = stored.groupBy("src").agg(F.max("path").alias("path"))
    used = image_uses(pages).join(kept, "src", "left")
    safe = lambda x: F.replace(F.replace(F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    alt = lambda other: safe(F.coalesce(F.nullif("alt", F.lit("")), F.lit(other)))
    link = lambda words: F.concat(F.lit('<a href="'), safe(F.col("src")), F.lit(f'">{words}</a></p>'))
    shown = (
        F.when(F.col("use") == "skip", "")
        .when(F.col("use") == "video", F.concat(F.lit("<p>🎬 "), alt("演示视频"), F.lit("（演示视频未归档）"), link("查看视频")))
        .when(F.col("path").isNotNull(), F.concat(F.lit('<img src="'), safe(F.col("path")), F.lit('" alt="'), safe(F.col("alt")), F.lit('"/>')))
        .otherwise(F.concat(F.lit("<p>📷 "), alt("配图"), F.lit(" "), link("查看原图")))
    )
    tags = used.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", shown.alias("tag")))), lambda x: x["tag"]).alias("tags"))
    parts = F.split("html", T.IMAGE_TAG, -1)
    put = F.zip_with(parts, F.coalesce("tags", F.array().cast("array<string>")), lambda p, t: F.concat(p, F.coalesce(t, F.lit(""))))
    return pages.join(tags, "id", "left").select("id", F.array_join(put, "").alias("html"))
