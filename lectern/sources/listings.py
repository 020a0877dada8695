"""Listing pages read by an extractor, payloads of every kind together, and figures of how reading went."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import config as C
from lectern.functions import text as T
from lectern.functions import urls as U
from lectern.sources import feeds as R

#: From pages (source_name, url, text) to items (source_name, url, pos, title, link, published_raw).
Extractor = Callable[[DataFrame], DataFrame]


def cleaned(html: Column, most: int = C.LISTING_CHARS) -> Column:
    """A page without scripts, styles, noscript and drawings, cut to what an extractor is shown."""
    return F.substring(F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)\b[^>]*>.*?</\1>", ""), 1, most)


def _shown(part: Column) -> Column:
    return F.trim(F.regexp_replace(R.unescaped(F.regexp_replace(part, r"<[^>]*>", " ")), r"(?U)\s+", " "))


def anchors(pages: DataFrame) -> DataFrame:
    """The offline extractor: each link is an item, the words up to the next link are where its date may be."""
    parts = pages.select("source_name", "url", F.posexplode(F.split("text", r"(?i)(?=<a\s)", -1)).alias("pos", "part"))
    link = r"""(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>(.*)$"""
    of = lambda i: F.regexp_extract("part", link, i)
    links = parts.where(F.col("part").rlike(link))  # an anchor that only has a name isn't one
    return links.select("source_name", "url", "pos", _shown(of(2)).alias("title"), R.unescaped(of(1)).alias("link"), F.substring(_shown(of(3)), 1, C.LISTING_DATE_CHARS).alias("published_raw"))


def listing(landed: DataFrame, as_of: Column, extractor: Extractor = anchors) -> DataFrame:
    """Entries of listing pages (source_name, url, payload): links made absolute, dates read from what the page says.

    Doubtful: no link, title or date. A page without payload or items gives nothing; an item without a link
    stands for the page itself. What `extractor` leaves null counts as empty.
    """
    found = extractor(landed.where(F.col("payload").isNotNull()).select("source_name", "url", cleaned(F.col("payload")).alias("text")))
    filled = lambda name: F.trim(F.coalesce(name, F.lit("")))
    link, title = filled("link"), filled("title")
    url = F.when(link == "", F.coalesce("url", F.lit(""))).otherwise(F.coalesce(U.resolved(F.col("url"), link), link))
    day = T.flexible_date(filled("published_raw"), as_of)
    rows = found.select("source_name", title.alias("title"), url.alias("url"), day.alias("published"))
    doubt = (F.col("url") == "") | (F.col("title") == "") | F.col("published").isNull()
    return rows.select("source_name", "title", "url", "published", F.lit("").alias("summary"), doubt.alias("low_confidence"), F.lit("").alias("guid"))


def dispatched(landed: DataFrame, details: DataFrame, as_of: Column, papers: str, prefix: str, host: str, extractor: Extractor = anchors) -> DataFrame:
    """Entries of payloads (source_name, reader, url, query_date, payload) of all kinds; an unknown `reader` is an error.

    `page` is a listing page that `extractor` reads, `list` one whose items are dated from `details` (url, payload).
    """
    own = F.coalesce(F.col("reader").isin("page", "list"), F.lit(False))
    got = R.entries(landed.where(~own), as_of, papers, prefix)
    got = got.unionByName(listing(landed.where("reader = 'page'"), as_of, extractor))
    return got.unionByName(R.listed(landed.where("reader = 'list'"), details, host))


def mirror_stats(entries: DataFrame, host: str = C.MIRROR_HOST) -> DataFrame:
    """A mirror source's entries: how many there are, how many have the direct link and how many the feed's own."""
    direct = F.coalesce(F.contains("url", F.lit(host)), F.lit(False))
    return entries.groupBy("source_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(direct).alias("with_direct_link"), F.count_if(~direct).alias("fallback_link"))


def list_stats(entries: DataFrame) -> DataFrame:
    """A list source's entries: how many the list gave, how many got a date from their own page and how many didn't."""
    dated = F.col("published").isNotNull()
    return entries.groupBy("source_name").agg(F.count(F.lit(1)).alias("list_parsed"), F.count_if(dated).alias("detail_fetched"), F.count_if(~dated).alias("detail_failed"))
