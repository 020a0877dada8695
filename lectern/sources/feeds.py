"""Readers of landed feeds: one row a fetched payload in, one row an entry out.

Fetching is outside; a payload table (source_name, url, payload) holds what came. A payload that
can't be read gives no entries and shows in `unreadable`. Entries have title, url, source_name,
published, summary, low_confidence and guid.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern import config as C

_ITEM = "title string, link string, description string, guid string, pubDate string, encoded string"
_RSS = f"channel struct<item: array<struct<{_ITEM}>>>"
_ATOM = "entry array<struct<id: string, title: string, summary: string, published: string>>"
_PAPERS = "array<struct<paper: struct<id: string, title: string, summary: string, publishedAt: string, upvotes: bigint>>>"
_XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """HTML character references as characters."""
    return texts.map(html.unescape, na_action="ignore")


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(_filled(text), r"(?U)\s+", " "))


def utc_date(raw: Column) -> Column:
    """The UTC day of an RFC 822 or ISO time, whatever the session's zone; null if there is none."""
    rfc, iso = r"(\d{1,2}) +([A-Za-z]{3})[a-z]* +(\d{4})", r"(\d{4}-\d{2}-\d{2})"
    part = lambda p, i: F.regexp_extract(raw, p, i)
    number = lambda p, i: F.coalesce(part(p, i).try_cast("int"), F.lit(0))
    day = F.coalesce(
        F.try_to_timestamp(F.concat_ws(" ", part(rfc, 1), part(rfc, 2), part(rfc, 3)), F.lit("d MMM yyyy")).cast("date"),
        part(iso, 1).try_cast("date"),
    )
    clock, zone = r"(\d{1,2}):(\d{2})", r"([+-])(\d{2}):?(\d{2})\s*$"
    ahead = F.when(part(r"\d{1,2}:\d{2}.*" + zone, 1) == "-", -1).otherwise(1) * (60 * number(r":\d{2}.*" + zone, 2) + number(r":\d{2}.*" + zone, 3))
    minute = 60 * number(clock, 1) + number(clock, 2) - ahead
    return F.date_add(day, F.floor(minute / 1440).cast("int"))


def _doubtful(published: Column, *texts: Column) -> Column:
    missing = published.isNull()
    for x in texts:
        missing = missing | (x == "")
    return missing


def _entries(rows: DataFrame, title: Column, url: Column, published: Column, summary: Column, doubt: Column, guid: Column, *more: Column) -> DataFrame:
    return rows.select("source_name", title.alias("title"), url.alias("url"), published.alias("published"), summary.alias("summary"), doubt.alias("low_confidence"), guid.alias("guid"), *more)


def _items(landed: DataFrame) -> DataFrame:
    return landed.select("source_name", F.explode(F.from_xml("payload", _RSS, _XML)["channel"]["item"]).alias("item"))


def rss(landed: DataFrame, as_of: Column) -> DataFrame:
    """Items of RSS payloads. Doubtful: title, link, description or date missing, or a date after tomorrow."""
    item = lambda n: _filled(F.col(f"item.{n}"))
    day = utc_date(F.col("item.pubDate"))
    doubt = _doubtful(day, item("link"), item("title"), item("description")) | F.coalesce(day > F.date_add(as_of, 1), F.lit(False))
    return _entries(_items(landed), item("title"), item("link"), day, item("description"), doubt, item("guid"))


def atom_papers(landed: DataFrame) -> DataFrame:
    """Entries of Atom payloads; runs of white space in title and summary become one space."""
    rows = landed.select("source_name", F.explode(F.from_xml("payload", _ATOM, _XML)["entry"]).alias("item"))
    title, summary, url = _spaced(F.col("item.title")), _spaced(F.col("item.summary")), F.trim(_filled(F.col("item.id")))
    day = F.substring("item.published", 1, 10).try_cast("date")
    return _entries(rows, title, url, day, summary, _doubtful(day, url, title, summary), F.lit(""))


def json_papers(landed: DataFrame, label: str, prefix: str) -> DataFrame:
    """Papers of JSON payloads (source_name, query_date, payload): of each source the first day that has any.

    Entries are labelled `label`, the source whose pages they link to; votes stay in `upvotes`.
    """
    days = landed.select("source_name", "query_date", F.from_json("payload", _PAPERS).alias("papers")).where(F.size("papers") > 0)
    first = days.groupBy("source_name").agg(F.min("query_date").alias("query_date"))
    rows = days.join(first, ["source_name", "query_date"]).select(F.explode("papers.paper").alias("item"))
    name, title, summary = (_filled(F.col(f"item.{n}")) for n in ("id", "title", "summary"))
    url = F.when(name != "", F.concat(F.lit(prefix), name)).otherwise("")
    day = F.substring("item.publishedAt", 1, 10).try_cast("date")
    got = rows.select(F.lit(label).alias("source_name"), "item")
    votes = F.coalesce("item.upvotes", F.lit(0)).alias("upvotes")
    return _entries(got, title, url, day, summary, _doubtful(day, url, title, summary), F.lit(""), votes)


def mirror_feed(landed: DataFrame, host: str = C.MIRROR_HOST) -> DataFrame:
    """Items whose content holds the direct link; without one the feed's own link stays, as doubtful."""
    body = _filled(F.col("item.encoded"))
    direct = F.regexp_extract(body, host.replace(".", r"\.") + r"""/s\?[^"'<\s]+""", 0)
    url = F.when(direct != "", unescaped(F.concat(F.lit("https://"), F.substring_index(direct, "#", 1)))).otherwise(_filled(F.col("item.link")))
    title, day = _filled(F.col("item.title")), utc_date(F.col("item.pubDate"))
    summary = F.substring(_spaced(F.regexp_replace(body, "<[^>]+>", " ")), 1, C.MIRROR_SUMMARY_CHARS)
    return _entries(_items(landed), title, url, day, summary, _doubtful(day, title, direct), _filled(F.col("item.guid")))


def listed(landed: DataFrame, details: DataFrame, host: str, most: int = C.LIST_ENTRIES) -> DataFrame:
    """The first `most` links of each list page, dated from their detail pages (url, payload).

    A page is cut at its feed items; each gives its first link to `host` that isn't a listing itself.
    Equal links count once, at the first place.
    """
    blocks = F.split("payload", r"<div [^>]*data-feed-item[^>]*>", -1)
    rows = landed.select("source_name", F.posexplode(blocks).alias("pos", "block")).where("pos > 0")
    rows = rows.select("source_name", "pos", F.substring("block", 1, C.LIST_BLOCK_CHARS).alias("block"))
    link = F.regexp_replace(F.regexp_extract("block", rf'<a href="(https?://{host.replace(".", "[.]")}/[^"]+)"', 1), "/+$", "")
    rows = rows.withColumn("url", link).where((F.col("url") != "") & ~F.col("url").rlike("|".join(C.LIST_SKIPPED)))
    first = rows.groupBy("source_name", "url").agg(F.min(F.struct("pos", "block")).alias("own"))
    kept = first.withColumn("place", F.row_number().over(Window.partitionBy("source_name").orderBy("own.pos"))).where(F.col("place") <= most)
    anchor = F.concat(F.lit('(?s)<a href="\\Q'), F.col("url"), F.lit('\\E/?"[^>]*>\\s*(.+?)\\s*</a>'))
    title = unescaped(_spaced(F.try_element_at(F.regexp_extract_all("own.block", anchor, F.lit(1)), F.lit(1))))
    dated = details.select("url", utc_date(F.regexp_extract("payload", r'"datePublished":\s*"([^"]+)"', 1)).alias("published"))
    got = kept.select("source_name", "url", title.alias("title")).join(dated, "url", "left")
    return _entries(got, F.col("title"), F.col("url"), F.col("published"), F.lit(""), _doubtful(F.col("published"), F.col("title")), F.lit(""))


def front_matter(text: Column) -> Column:
    """A note's leading `key: value` lines as a map. Values keep further colons; quotes around them go."""
    head = F.regexp_extract(text, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[\w-]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[\w-]+:(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + F.lit(2), F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def note_body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files below a folder: name, meta, body. A file is one row."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1)
    return files.select(name.alias("name"), front_matter(F.col("value")).alias("meta"), note_body(F.col("value")).alias("body"))


def unreadable(landed: DataFrame, as_xml: bool = True) -> DataFrame:
    """Payloads that give nothing to read, as failed attempts for the sources' health."""
    if as_xml:
        read = F.from_xml("payload", f"{_RSS}, {_ATOM}", _XML)
        sound = read["channel"].isNotNull() | read["entry"].isNotNull()
    else:
        sound = F.from_json("payload", _PAPERS).isNotNull()
    return landed.where(~F.coalesce(sound, F.lit(False))).select("source_name")


def entries(landed: DataFrame, as_of: Column, papers: str, prefix: str) -> DataFrame:
    """Entries of payloads of any kind: `reader` is rss, atom, json or mirror; another one is an error.

    Each reader scans the payloads of its own kind only, where the table is laid out by `reader`.
    """
    kinds = ("rss", "atom", "json", "mirror")
    of = lambda kind: landed.where(F.col("reader") == kind)
    # a branch of its own, so that no pushed filter hides a row of an unknown kind
    unknown = landed.where(~F.coalesce(F.col("reader").isin(*kinds), F.lit(False)))
    error = F.raise_error(F.concat(F.lit("unknown reader: "), F.coalesce("reader", F.lit("none"))))
    empty, none = F.lit(""), F.lit(None).cast("date")
    failed = _entries(unknown.where(error.cast("boolean")), empty, empty, none, empty, F.lit(True), empty)
    got = rss(of("rss"), as_of).unionByName(atom_papers(of("atom"))).unionByName(mirror_feed(of("mirror")))
    return got.unionByName(json_papers(of("json"), papers, prefix).drop("upvotes")).unionByName(failed)


def demoted(found: DataFrame, health: DataFrame, registry: DataFrame) -> DataFrame:
    """Entries of degraded sources are doubtful: the state seen in use (`state`) goes before the registry's."""
    known = registry.select("source_name", "reliability").join(health.select("source_name", "state"), "source_name", "full_outer")
    bad = known.select("source_name", (F.coalesce("state", "reliability") == "degraded").alias("bad"))
    rows = found.join(bad, "source_name", "left")
    return rows.withColumn("low_confidence", F.col("low_confidence") | F.coalesce("bad", F.lit(False))).drop("bad")
