"""Queries of the feed readers: payloads are made from the provided pages, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans import views as V
from lectern.plans.queries import query
from lectern.sources import feeds as R
from lectern.sources import listings as L

c = F.col
_escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
_tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
_COLUMNS = ["source_name", "title", "url", "published", "summary", "low_confidence", "guid"]
_T, _S = "trim(regexp_replace(title, '\\s+', ' ', 'g'))", "trim(regexp_replace(summary, '\\s+', ' ', 'g'))"


def _landed(spark, sf_dir, payload):
    return V.entries(spark, sf_dir).select(c("pos").cast("string").alias("source_name"), payload.alias("payload"))


@query("src_rss", f"SELECT CAST(pos AS VARCHAR) AS source_name, trim(title) AS title, url, published + 1 AS published, trim(summary) AS summary, trim(title) = '' OR url = '' OR trim(summary) = '' OR published IS NULL AS low_confidence, 'g' || pos AS guid FROM entries", V.ENTRIES)
def _(spark, sf_dir):
    """The feed's time is 23:30 two hours west of Greenwich, so the UTC day is the next."""
    time = F.concat(F.lit("Mon, "), F.date_format("published", "dd MMM yyyy"), F.lit(" 23:30:00 -0200"))
    guid = F.concat(F.lit('<guid isPermaLink="false">g'), c("pos").cast("string"), F.lit("</guid>"))
    item = F.concat(_tag("title", _escaped(c("title"))), _tag("link", _escaped(c("url"))), _tag("description", _escaped(c("summary"))), guid, F.coalesce(_tag("pubDate", time), F.lit("")))
    return R.rss(_landed(spark, sf_dir, F.concat(F.lit('<rss version="2.0"><channel><title>all</title>'), _tag("item", item), F.lit("</channel></rss>"))), V.as_of()).select(*_COLUMNS)


@query("src_atom_papers", f"SELECT CAST(pos AS VARCHAR) AS source_name, {_T} AS title, url, published, {_S} AS summary, {_T} = '' OR url = '' OR {_S} = '' OR published IS NULL AS low_confidence, '' AS guid FROM entries", V.ENTRIES)
def _(spark, sf_dir):
    time = F.coalesce(_tag("published", F.concat(F.date_format("published", "yyyy-MM-dd"), F.lit("T10:00:00Z"))), F.lit(""))
    wide = lambda x: F.replace(_escaped(x), F.lit(" "), F.lit("\n  "))
    entry = F.concat(_tag("id", _escaped(c("url"))), _tag("title", wide(c("title"))), _tag("summary", wide(c("summary"))), time)
    return R.atom_papers(_landed(spark, sf_dir, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), _tag("entry", entry), F.lit("</feed>")))).select(*_COLUMNS)


@query("src_json_papers", "SELECT 'papers' AS source_name, title, 'https://papers.example.org/abs/' || pos || CASE WHEN pos % 3 = 0 THEN '-today' ELSE '-before' END AS url, published, summary, title = '' OR summary = '' OR published IS NULL AS low_confidence, pos AS upvotes FROM entries", V.ENTRIES)
def _(spark, sf_dir):
    """Each source has a payload of yesterday and of today; every third of yesterday's is empty."""
    day = lambda n, mark: F.struct(F.date_sub(V.as_of(), n).alias("query_date"), F.lit(mark).alias("mark"))
    rows = V.entries(spark, sf_dir).withColumn("day", F.explode(F.array(day(1, "-before"), day(0, "-today"))))
    paper = F.struct(F.concat(c("pos").cast("string"), "day.mark").alias("id"), "title", "summary", F.date_format("published", "yyyy-MM-dd'T'00:00:00'Z'").alias("publishedAt"), c("pos").alias("upvotes"))
    none = (c("pos") % 3 == 0) & (c("day.mark") == "-before")
    payload = F.when(none, "[]").otherwise(F.to_json(F.array(F.struct(paper.alias("paper")))))
    landed = rows.select(c("pos").cast("string").alias("source_name"), "day.query_date", payload.alias("payload"))
    return R.json_papers(landed, "papers", "https://papers.example.org/abs/").drop("guid")


@query("src_mirror_feed", f"SELECT CAST(pos AS VARCHAR) AS source_name, trim(title) AS title, CASE WHEN pos % 4 = 0 THEN url ELSE 'https://mp.weixin.qq.com/s?a=1&b=' || pos END AS url, published, trim(substr(trim(regexp_replace(title || ' go', '\\s+', ' ', 'g')), 1, 200)) AS summary, trim(title) = '' OR published IS NULL OR pos % 4 = 0 AS low_confidence FROM entries", V.ENTRIES)
def _(spark, sf_dir):
    link = F.when(c("pos") % 4 == 0, F.lit("<p>go</p>")).otherwise(F.concat(F.lit('<a href="http://mp.weixin.qq.com/s?a=1&amp;b='), c("pos").cast("string"), F.lit('#rd">go</a>')))
    content = F.concat(F.lit("<p>"), "title", F.lit("</p>"), link)
    item = F.concat(_tag("title", _escaped(c("title"))), _tag("link", _escaped(c("url"))), _tag("content:encoded", _escaped(content)), F.coalesce(_tag("pubDate", F.concat(F.date_format("published", "dd MMM yyyy"), F.lit(" 08:00:00 GMT"))), F.lit("")))
    head = '<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'
    return R.mirror_feed(_landed(spark, sf_dir, F.concat(F.lit(head), _tag("item", item), F.lit("</channel></rss>")))).drop("guid")


@query(
    "src_list_detail",
    "SELECT source_name, 'Post ' || k || ' & more' AS title, 'https://news.example.com/p' || k AS url, CASE WHEN k % 3 <> 0 THEN DATE '2026-01-01' + CAST(k AS INTEGER) END AS published, k % 3 = 0 AS low_confidence FROM (SELECT source_name, pos % 50 AS k, row_number() OVER (PARTITION BY source_name ORDER BY min(pos)) AS n FROM entries WHERE pos % 10 <> 1 GROUP BY 1, 2) WHERE n <= 20",
    V.ENTRIES,
)
def _(spark, sf_dir):
    """A list page a source; links repeat, and some are listings."""
    k = (c("pos") % 50).cast("string")
    url = F.when(c("pos") % 10 == 1, F.lit("https://news.example.com/tag/x")).otherwise(F.concat(F.lit("https://news.example.com/p"), k))
    block = F.concat(F.lit('<div class="c" data-feed-item="1"><a href="'), url, F.lit('/">\n Post '), k, F.lit(" &amp;  more </a></div>"))
    pages = V.entries(spark, sf_dir).groupBy("source_name").agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("block")))).alias("own"))
    landed = pages.select("source_name", F.concat(F.lit("<html>"), F.array_join(F.transform("own", lambda x: x["block"]), "")).alias("payload"))
    n = F.col("id")
    when = F.concat(F.lit('{"datePublished": "'), F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), n.cast("int")), "yyyy-MM-dd"), F.lit('T01:00:00+00:00"}'))
    details = spark.range(50).select(F.concat(F.lit("https://news.example.com/p"), n.cast("string")).alias("url"), F.when(n % 3 != 0, when).otherwise("{}").alias("payload"))
    return R.listed(landed, details, "news.example.com").drop("summary", "guid")


@query("src_vault_md", "SELECT pos, 'A: ' || pos AS title, '[x, y]' AS tags, sha256(summary) AS body FROM entries", V.ENTRIES)
def _(spark, sf_dir):
    text = F.concat(F.lit('---\ntitle: "A: '), c("pos").cast("string"), F.lit('"\ntags: [x, y]\nbroken line\n---\n'), "summary")
    meta = R.front_matter(text)
    return V.entries(spark, sf_dir).select("pos", meta["title"].alias("title"), meta["tags"].alias("tags"), F.sha2(R.note_body(text), 256).alias("body"))


# --- listing pages, all kinds of payloads together, figures of readers
_PLAIN = lambda x: f"trim(regexp_replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_SHOWN_PAGES = """shown AS (SELECT page_id, url, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN page_id % 3 = 0 THEN replace(html, '</a></li>', '</a> ' || (page_id % 9) || ' days ago</li>') ELSE html END,
 '(?is)<script\\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style>', '', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript>', '', 'g'), '(?is)<svg\\b[^>]*>.*?</svg>', '', 'g'), 1, 40000) AS html FROM pages)"""
_PARTS = "parts AS (SELECT page_id, url, unnest(string_split(html, '<a ')[2:]) AS p FROM shown)"
_ITEMS = f"""items AS (SELECT page_id, {_PLAIN("regexp_extract(p, '(?s)^[^>]*>(.*?)</a>', 1)")} AS title, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || replace(regexp_extract(p, '^href="([^"]*)"', 1), '&amp;', '&') AS url,
 CASE WHEN page_id % 3 = 0 AND regexp_matches(p, '</a> \\d days ago</li>') THEN DATE '2026-07-05' - CAST(page_id % 9 AS INTEGER) END AS published FROM parts)"""


@query("src_listing_links", "SELECT CAST(page_id AS VARCHAR) AS source_name, title, url, published, title = '' OR published IS NULL AS low_confidence FROM items", _SHOWN_PAGES, _PARTS, _ITEMS)
def _(spark, sf_dir):
    """The links of the provided pages; a third of the pages say how old each is."""
    p = c("page_id")
    dated = F.replace("html", F.lit("</a></li>"), F.concat(F.lit("</a> "), (p % 9).cast("string"), F.lit(" days ago</li>")))
    landed = V.table(spark, sf_dir, "pages").select(p.cast("string").alias("source_name"), "url", F.when(p % 3 == 0, dated).otherwise(c("html")).alias("payload"))
    return L.listing(landed, V.as_of()).drop("summary", "guid")


def _mixed(spark, sf_dir):
    """A payload an entry, of five kinds in turn; every fifth list item has no date on its own page."""
    p, s = c("pos"), c("pos").cast("string")
    j = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    link = j("https://mixed.example/p/", s)
    rss = j("<rss><channel><item><title>t", s, "</title><link>", link, "</link><description>d</description><pubDate>Sat, 04 Jul 2026 10:00:00 GMT</pubDate></item></channel></rss>")
    atom = j("<feed><entry><id>", link, "</id><title>t", s, "</title><summary>d</summary><published>2026-07-03T00:00:00Z</published></entry></feed>")
    direct = F.when(p % 2 == 0, j('&lt;a href="http://mp.weixin.qq.com/s?b=', s, '"&gt;go&lt;/a&gt;')).otherwise("none")
    mirror = j('<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><item><title>t', s, "</title><link>", link, "</link><content:encoded>", direct, "</content:encoded><pubDate>Thu, 02 Jul 2026 10:00:00 GMT</pubDate></item></channel></rss>")
    page = j('<nav></nav><ul><li><a class="x" href="/p/', s, '"><b>t', s, "</b></a> yesterday</li></ul>")
    listed = j('<div data-feed-item><a href="', link, '/">t', s, "</a></div>")
    kind = F.element_at(F.array(*map(F.lit, ("rss", "atom", "mirror", "page", "list"))), (p % 5 + 1).cast("int"))
    payload = F.when(p % 5 == 0, rss).when(p % 5 == 1, atom).when(p % 5 == 2, mirror).when(p % 5 == 3, page).otherwise(listed)
    rows = V.entries(spark, sf_dir)
    landed = rows.select(F.concat_ws("-", kind, s).alias("source_name"), kind.alias("reader"), F.lit("https://mixed.example/all?x=1").alias("url"), F.lit(None).cast("date").alias("query_date"), payload.alias("payload"))
    details = rows.where(p % 5 == 4).select(link.alias("url"), F.when(p % 25 != 4, '{"datePublished": "2026-07-01T01:00:00+00:00"}').otherwise("{}").alias("payload"))
    return L.dispatched(landed, details, V.as_of(), "papers", "https://papers.example.org/abs/", "mixed.example")


_MIXED = """mixed AS (SELECT (['rss', 'atom', 'mirror', 'page', 'list'])[pos % 5 + 1] AS kind, pos, 't' || pos AS title, CASE WHEN pos % 5 = 2 AND pos % 2 = 0 THEN 'https://mp.weixin.qq.com/s?b=' || pos ELSE 'https://mixed.example/p/' || pos END AS url,
 CASE WHEN pos % 25 <> 4 THEN ([DATE '2026-07-04', DATE '2026-07-03', DATE '2026-07-02', DATE '2026-07-04', DATE '2026-07-01'])[pos % 5 + 1] END AS published FROM entries)"""


@query("src_dispatch", "SELECT kind || '-' || pos AS source_name, title, url, published, published IS NULL OR (kind = 'mirror' AND pos % 2 <> 0) AS low_confidence FROM mixed", V.ENTRIES, _MIXED)
def _(spark, sf_dir):
    return _mixed(spark, sf_dir).drop("summary", "guid")


def _by_kind(spark, sf_dir, kind):
    return _mixed(spark, sf_dir).where(F.startswith("source_name", F.lit(kind))).withColumn("source_name", F.lit(kind))


@query("script_stats_mirror", "SELECT kind AS source_name, count(*) AS total, count(*) FILTER (pos % 2 = 0) AS with_direct_link, count(*) FILTER (pos % 2 <> 0) AS fallback_link FROM mixed WHERE kind = 'mirror' GROUP BY 1", V.ENTRIES, _MIXED)
def _(spark, sf_dir):
    return L.mirror_stats(_by_kind(spark, sf_dir, "mirror"))


@query("script_stats_list", "SELECT kind AS source_name, count(*) AS list_parsed, count(published) AS detail_fetched, count(*) FILTER (published IS NULL) AS detail_failed FROM mixed WHERE kind = 'list' GROUP BY 1", V.ENTRIES, _MIXED)
def _(spark, sf_dir):
    return L.list_stats(_by_kind(spark, sf_dir, "list"))
