"""Inputs of the queries, derived from the provided tables; and the same in SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import config as C
from lectern.operators.folds import parts_for

AS_OF = datetime.date(2026, 7, 5)
DAY_ONE = datetime.date(2024, 1, 1)
PAPERS = ["source-0", "source-1"]
CANONICAL = ".example.com"


def as_of():
    return F.lit(AS_OF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark, sf_dir) -> DataFrame:
    p = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        p.alias("pos"),
        "url",
        F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.when(p % 9 == 4, " webinar").otherwise(""), F.when(p % 18 == 4, " open source").otherwise("")).alias("title"),
        F.regexp_extract("html", "<p>([^<]+)</p>", 1).alias("summary"),
        F.concat(F.lit("source-"), (p % 7).cast("string")).alias("source_name"),
        F.when(p % 11 != 0, F.date_sub(as_of(), (p % 25).cast("int"))).alias("published"),
        (p % 13 == 0).alias("low_confidence"),
    )


def originals(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    topics = F.array(*[F.lit(t) for t in (*C.TOPICS, C.OVERFLOW_TOPIC)])
    types = F.array(*[F.lit(t) for t in C.DOC_TYPES])
    return table(spark, sf_dir, "documents").select(
        d.cast("string").alias("id"),
        F.date_add(F.lit(DAY_ONE), (d % 31).cast("int")).alias("doc_date"),
        F.element_at(topics, (d % 11 + 1).cast("int")).alias("topic_slug"),
        F.element_at(types, (d % 6 + 1).cast("int")).alias("doc_type"),
        F.col("source").alias("source_name"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.substring("text", 1, C.EXCERPT_CHARS).alias("gist"),
        "text",
    )


def rich(spark, sf_dir) -> DataFrame:
    """Documents with code, links, Chinese text, references and wiki links; some of nothing else."""
    d, text = F.col("doc_id"), F.col("text")
    s = d.cast("string")
    body = (
        F.when(d % 20 == 4, F.concat(F.lit("12 34\n-- 56 --\n\n"), s, F.lit("\n99")))
        .when(d % 20 == 8, F.concat(F.lit("[37] A. Author (2019) et al.\n-\n[38] arXiv preprint 1901\n\ndoi: 10.1/"), s))
        .when(d % 20 == 12, F.concat(F.lit("这是一段完整的中文译文 其中没有别的语言\n\n![图](media-store://a/"), s, F.lit(".png)\n对齐 开源")))
        .when(d % 20 == 16, F.concat(F.lit("\n- [[note-"), s, F.lit("]] a\n- [[note-1]] b\n\n```\nlong code block\nof lines\n```")))
        .when(d % 4 == 0, text)
        .when(d % 4 == 1, F.concat(text, F.lit("\n```\ncode "), s, F.lit("\n```\nsee https://example.org/p/"), s, F.lit("\n[[note-"), (d % 40).cast("string"), F.lit("|Note]] and ![i](x.png) [link](y)\n12 34\n<td >")))
        .when(d % 4 == 2, F.concat(F.lit("模型发布 安全对齐\n"), text, F.lit("\n12 34 56\n[37] Author: Title (2020) et al.\n[[topic-"), (d % 7).cast("string"), F.lit("#part]]")))
        .otherwise(F.concat(F.lit("这是一段关于模型的中文正文。开源 论文，对齐\n\n"), text, F.lit("\n\n"), text))
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), body.alias("body"))


def links(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"))
    return rows.repartition(parts_for(spark, rows.count()), "from_id", "to_id").distinct()


def tags(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("tag"))


def attempts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source_name"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("success"))


def url_index(spark, sf_dir) -> DataFrame:
    from lectern.functions.urls import index_key

    p = F.col("pos")
    rows = entries(spark, sf_dir).where(p % 3 == 0).select(
        index_key(F.col("url")).alias("normalized_url"),
        F.date_sub(as_of(), (p % 41).cast("int")).alias("first_seen_date"),
        F.when(p % 5 != 0, F.substring("summary", 1, C.EXCERPT_CHARS)).otherwise("").alias("raw_summary_excerpt"),
        F.array(F.concat(F.lit("batch-"), (p % 4).cast("string"))).alias("kept_in_daily"),
        F.when(p % 2 == 0, F.concat(F.lit("note-"), p.cast("string"))).alias("zettel_id"),
        "pos",
    )
    from lectern.operators.batch import first_of

    return first_of(rows, ["normalized_url"], "pos").drop("pos")


_PARTS = r"'^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)'"
KEY = lambda c: f"regexp_replace(regexp_extract(lower({c}), {_PARTS}, 2), '^www\\.', '') || regexp_replace(regexp_replace(regexp_extract(lower({c}), {_PARTS}, 3), ';[^/]*$', ''), '/+$', '')"
HOST = lambda c: f"lower(regexp_extract({c}, {_PARTS}, 2))"
HOST_PATH = lambda c: f"lower(regexp_extract({c}, {_PARTS}, 1)) || '://' || {HOST(c)} || regexp_replace(regexp_replace(regexp_extract({c}, {_PARTS}, 3), ';[^/]*$', ''), '/+$', '')"
quoted = lambda items: ", ".join("'" + x.replace("'", "''") + "'" for x in items)

ENTRIES = """entries AS (SELECT page_id AS pos, url, regexp_extract(html, '<title>([^<]*)</title>', 1) || CASE WHEN page_id % 9 = 4 THEN ' webinar' ELSE '' END || CASE WHEN page_id % 18 = 4 THEN ' open source' ELSE '' END AS title,
 regexp_extract(html, '<p>([^<]+)</p>', 1) AS summary, 'source-' || (page_id % 7) AS source_name,
 CASE WHEN page_id % 11 <> 0 THEN DATE '2026-07-05' - CAST(page_id % 25 AS INTEGER) END AS published,
 page_id % 13 = 0 AS low_confidence FROM pages)"""
ORIGINALS = f"""originals AS (SELECT CAST(doc_id AS VARCHAR) AS id, DATE '2024-01-01' + CAST(doc_id % 31 AS INTEGER) AS doc_date,
 ([{quoted((*C.TOPICS, C.OVERFLOW_TOPIC))}])[doc_id % 11 + 1] AS topic_slug, ([{quoted(C.DOC_TYPES)}])[doc_id % 6 + 1] AS doc_type,
 source AS source_name, split_part(text, chr(10), 1) AS title, substr(text, 1, 200) AS gist, text FROM documents)"""
RICH = """rich AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE
 WHEN doc_id % 20 = 4 THEN E'12 34\\n-- 56 --\\n\\n' || doc_id || E'\\n99'
 WHEN doc_id % 20 = 8 THEN E'[37] A. Author (2019) et al.\\n-\\n[38] arXiv preprint 1901\\n\\ndoi: 10.1/' || doc_id
 WHEN doc_id % 20 = 12 THEN E'这是一段完整的中文译文 其中没有别的语言\\n\\n![图](media-store://a/' || doc_id || E'.png)\\n对齐 开源'
 WHEN doc_id % 20 = 16 THEN E'\\n- [[note-' || doc_id || E']] a\\n- [[note-1]] b\\n\\n```\\nlong code block\\nof lines\\n```'
 ELSE CASE doc_id % 4 WHEN 0 THEN text
 WHEN 1 THEN text || E'\\n```\\ncode ' || doc_id || E'\\n```\\nsee https://example.org/p/' || doc_id || E'\\n[[note-' || (doc_id % 40) || E'|Note]] and ![i](x.png) [link](y)\\n12 34\\n<td >'
 WHEN 2 THEN E'模型发布 安全对齐\\n' || text || E'\\n12 34 56\\n[37] Author: Title (2020) et al.\\n[[topic-' || (doc_id % 7) || '#part]]'
 ELSE E'这是一段关于模型的中文正文。开源 论文，对齐\\n\\n' || text || E'\\n\\n' || text END END AS body FROM documents)"""
LINKS = "links AS (SELECT DISTINCT l_orderkey AS from_id, l_partkey AS to_id FROM lineitem)"
TAGS = "tags AS (SELECT o_orderkey AS doc_id, o_orderpriority AS tag FROM orders)"
ATTEMPTS = "attempts AS (SELECT user_id AS source_name, ts, event_id AS seq, event_type <> 'error' AS success FROM events)"
URL_INDEX = f"""url_index AS (SELECT normalized_url, DATE '2026-07-05' - CAST(pos % 41 AS INTEGER) AS first_seen_date,
 CASE WHEN pos % 5 <> 0 THEN substr(summary, 1, 200) ELSE '' END AS raw_summary_excerpt, ['batch-' || (pos % 4)] AS kept_in_daily,
 CASE WHEN pos % 2 = 0 THEN 'note-' || pos END AS zettel_id
 FROM (SELECT *, {KEY("url")} AS normalized_url FROM entries WHERE pos % 3 = 0 QUALIFY row_number() OVER (PARTITION BY {KEY("url")} ORDER BY pos) = 1))"""
