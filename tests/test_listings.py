"""Listing pages, payloads of all kinds, figures of readers, refreshed originals and sections in parts, on made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern.operators import pages as P
from lectern.operators import store as K
from lectern.sources import listings as L

DAY = dt.date(2026, 7, 5)
LANDED = "source_name string, reader string, url string, query_date date, payload string"


def landed(spark, *rows):
    return spark.createDataFrame([(n, "page", u, None, p) for n, u, p in rows], LANDED)


def test_listing_rules(spark):
    page = """<script>var a = '<a href="/no">no</a> today';</script><nav>5 days ago</nav>
    <A class="c" data-href="/wrong" HREF='../up?x=1&amp;y=2'>One <b>&amp; two</b>
    </A> posted 3 days ago <a name="anchor">no link</a><a href="https://o.org/z">Z</a><span>2026-06-30</span>
    <a href="//cdn.org/q">Q</a> some day <a href="">self</a> 昨天<a href="/blank"> </a> today<article>no item</article>"""
    got = L.listing(landed(spark, ("s", "https://h.org/a/list.html", page), ("none", "https://h.org/", None), ("empty", "https://h.org/", "")), F.lit(DAY)).collect()
    assert {(r.title, r.url, r.published, r.low_confidence) for r in got} == {
        ("One & two", "https://h.org/a/../up?x=1&y=2", dt.date(2026, 7, 2), False),
        ("Z", "https://o.org/z", dt.date(2026, 6, 30), False),
        ("Q", "https://cdn.org/q", None, True),
        ("self", "https://h.org/a/list.html", dt.date(2026, 7, 4), False),
        ("", "https://h.org/blank", DAY, True),
    }
    assert {r.source_name for r in got} == {"s"} and {r.summary for r in got} == {""}


def test_listing_with_another_extractor(spark):
    def told(pages):
        """An extractor that leaves parts out, and sees neither scripts nor what lies beyond the cut."""
        seen = pages.select("source_name", "url", F.length("text").alias("n"))
        return seen.select("source_name", "url", F.lit(0).alias("pos"), F.concat(F.lit("n"), "n").alias("title"), F.lit(None).cast("string").alias("link"), F.lit(None).cast("string").alias("published_raw"))

    page = "<style>x</style>" + "y" * 50_000
    row = L.listing(landed(spark, ("s", "https://h.org/", page)), F.lit(DAY), told).first()
    assert (row.title, row.url, row.published, row.low_confidence) == ("n40000", "https://h.org/", None, True)


def test_all_kinds(spark):
    feed = "<rss><channel><item><title>a</title><link>u</link><description>d</description><pubDate>05 Jul 2026 00:00:00 GMT</pubDate></item></channel></rss>"
    rows = [
        ("r", "rss", "https://h.org/", None, feed),
        ("p", "page", "https://h.org/", None, '<a href="/x">X</a> today'),
        ("l", "list", "https://h.org/", None, '<div data-feed-item><a href="https://h.org/one/">One</a><div data-feed-item><a href="https://h.org/two">Two</a>'),
    ]
    details = spark.createDataFrame([("https://h.org/one", '{"datePublished": "2026-07-01"}')], "url string, payload string")
    got = L.dispatched(spark.createDataFrame(rows, LANDED), details, F.lit(DAY), "papers", "https://p/", "h.org")
    assert sorted((r.source_name, r.title, r.url, r.low_confidence) for r in got.collect()) == [("l", "One", "https://h.org/one", False), ("l", "Two", "https://h.org/two", True), ("p", "X", "https://h.org/x", False), ("r", "a", "u", False)]
    assert [tuple(r) for r in L.list_stats(got.where("source_name = 'l'")).collect()] == [("l", 2, 1, 1)]
    for reader in ("fax", None):
        bad = spark.createDataFrame([*rows, ("b", reader, "https://h.org/", None, "")], LANDED)
        with pytest.raises(Exception, match="unknown reader"):
            L.dispatched(bad, details, F.lit(DAY), "papers", "https://p/", "h.org").collect()
    none = L.dispatched(spark.createDataFrame([], LANDED), details, F.lit(DAY), "papers", "https://p/", "h.org")
    assert none.collect() == []


def test_mirror_figures(spark):
    rows = [("m", "https://mp.weixin.qq.com/s?a=1"), ("m", "https://other.org/"), ("m", None), ("n", "https://mp.weixin.qq.com/s?b=1")]
    got = L.mirror_stats(spark.createDataFrame(rows, "source_name string, url string")).collect()
    assert sorted(map(tuple, got)) == [("m", 3, 1, 2), ("n", 1, 1, 0)]


def test_refreshed_originals(spark):
    front = '{"source_url": "%s", "topic_slug": "agents", "related_zettel_id": "n"}'
    old, new = dt.date(2026, 6, 1), dt.date(2026, 7, 1)
    docs = [("a", "original", new), ("b", "original", old), ("c", "original", new), ("d", "zettel", new), ("e", "original", new)]
    documents = spark.createDataFrame([(i, kind, day, front % f"u/{i}", f"t{i}", f"old {i}") for i, kind, day in docs], "id string, doc_type string, doc_date date, frontmatter string, title string, body string")
    articles = spark.createDataFrame([(f"u/{i}", f"t{i}", i != "c") for i in "abcde"], "url string, title string, pending boolean")
    tags = spark.createDataFrame([("a", "y"), ("a", "x")], "doc_id string, tag string")
    waiting = K.backfill_candidates(documents, articles, tags, F.date_sub(F.lit(DAY), 14))
    come = spark.createDataFrame([("u/a", "", "", "full\x00 a"), ("u/b", "T", "tr", "o"), ("u/c", "T", "tr", "o"), ("u/d", "T", "tr", "o"), ("u/z", "T", "tr", "o")], "url string, title string, translated string, original string")
    records = K.refreshed(waiting, come)
    assert [(r.id, r.title, r.body, r.doc_date, r.topic_slug, r.related_zettel_id, r.tags) for r in records.collect()] == [("a", "ta", "full a", new, "agents", "n", ["x", "y"])]
    after = K.refresh(documents, records)
    assert after.columns == documents.columns
    before = {r.id: r for r in documents.collect()}
    for r in after.collect():
        want = before[r.id].asDict() | ({"body": "full a"} if r.id == "a" else {})
        assert r.asDict() == want
    assert K.refresh(documents, records.limit(0)).count() == 5


def test_sections_in_parts(spark):
    rows = [("hot", f"n{i:05}", DAY, i // 2, f"- line {i}") for i in range(2500)] + [("cold", "x", DAY, 0, "- only"), ("hot", "y", dt.date(2026, 7, 4), 9, "- other")]
    entries = spark.createDataFrame(rows, "topic_slug string, link_id string, entry_date date, seq long, line string").repartition(7)
    got = {(r.topic_slug, r.entry_date, r.part): r for r in P.topic_day_parts(entries).collect()}
    assert {(k[0], k[1].day, k[2]): r.line_count for k, r in got.items()} == {("hot", 5, 1): 1000, ("hot", 5, 2): 1000, ("hot", 5, 3): 500, ("cold", 5, 1): 1, ("hot", 4, 1): 1}
    text = "\n".join(got[("hot", DAY, i)].section for i in (1, 2, 3))
    assert text == "## 2026-07-05\n\n" + "\n".join(f"- line {i}" for i in range(2500))
    whole = {(r.topic_slug, r.entry_date): r.section for r in P.topic_days(entries.where("topic_slug = 'cold'")).collect()}
    assert got[("cold", DAY, 1)].section == whole[("cold", DAY)]
    assert P.topic_day_parts(entries.limit(0)).collect() == []
