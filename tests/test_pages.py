"""Cuts, pages, charts, feeds and the streaming rules on made rows."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import blocks as K
from lectern.functions import text as T
from lectern.operators import batch as B
from lectern.operators import pages as P
from lectern.plans.catalog import QUERIES
from lectern.sources import feeds as R
from lectern.streaming import batches as Z


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab`\n", max_size=30), max_size=12), st.integers(4, 25))
def test_chunks_hold_the_text(parts, most):
    text = "\n\n".join(parts)
    got = K.packed(text, most)
    whole = all(len(p) <= most for p in text.split("\n\n"))
    if whole:
        assert "\n\n".join(got) == text
        # greedy: no chunk could take the next one's first paragraph
        for a, b in zip(got, got[1:]):
            counted = sum(len(p) + 2 for p in a.split("\n\n"))
            assert counted + len(b.split("\n\n")[0]) + 2 > most
    assert all(len(c) <= most + 8 for c in got)


def test_slices_close_their_fences():
    got = K.sliced("```\n" + "x" * 30 + "\n```\nend", 10)
    assert all(s.count("```") % 2 == 0 for s in got)
    assert got[1] == "```\n" + "x" * 10 + "\n```"
    assert K.sliced("y" * 25, 10) == ["y" * 10, "y" * 10, "y" * 5]


def test_blocks_stay_whole():
    text = "intro\n\n| a |\n| b |\nafter\n```\ncode\n\n| c |\n```\ntail"
    assert K.whole_blocks(text) == ["intro\n", "| a |\n| b |", "after\n```\ncode\n\n| c |\n```", "tail"]
    assert K.halves("| a |\n| b |") is None
    assert K.halves("") is None
    assert K.halves("one\n\ntwo") == ["one", "two"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["| x |", "```", "word", "", "  "]), max_size=15))
def test_blocks_lose_no_line(lines):
    kept = [x for b in K.whole_blocks("\n".join(lines)) for x in b.split("\n") if x.strip()]
    assert kept == [x for x in lines if x.strip()]


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


def test_images(spark):
    html = '<img src="data:a" srcset="https://h/x.webp 2x, https://h/y 1x" alt="t"><IMG width="1" height="1" src=\'https://h/p.gif\'><img>'
    got = one(spark, T.images(F.col("h")), h=html)
    assert [(g.src, g.alt, g.ending, g.shown) for g in got] == [("https://h/x.webp", "t", ".webp", True), ("https://h/p.gif", "", ".gif", False), (None, "", ".bin", False)]


def test_chart_rules(spark):
    sound = lambda s: one(spark, T.chart_is_sound(F.col("s")), s=s)
    assert sound("```mermaid\npie showData\n\"a\" : 1\n```")
    assert not sound("```mermaid\npie [x\n```")
    assert not sound("```mermaid\nquadrantChart\n\"a\" : [0.5, 1.0]\n```")
    assert not sound("pie") and not sound("")
    assert one(spark, T.chart_label(F.col("s")), s='e[n]"d') == "end "
    assert one(spark, T.chart_label(F.col("s")), s=" a #1|b ") == "a ＃1b"


def test_relationship_chart(spark):
    edges = spark.createDataFrame(
        [("p", 0, "x-1", "X", "y-1", "Y", "corroborates", "same"), ("p", 1, "y-1", "Y", "z-1", "(", "conflicts", "no"), ("q", 0, "a", "A", "b", "B", "conflicts", "no")],
        "page string, pos long, from_id string, from_title string, to_id string, to_title string, relation string, label string",
    )
    got = {r.page: r.chart for r in P.relationship_chart(edges).collect()}
    assert got == {"q": '```mermaid\nflowchart LR\n    n0["A"]\n    n1["B"]\n    n0 -.->|"⚡ no"| n1\n```'}  # the other has an open bracket


def test_note_ids_skip_taken_minutes(spark):
    t = dt.datetime(2026, 7, 5, 23, 59, 30)
    rows = spark.createDataFrame([(1, t, "a"), (2, t, "a"), (3, t, "b")], "pos long, ts timestamp, slug string")
    taken = spark.createDataFrame([("202607060000-a",)], "note_id string")
    got = {r.pos: r.note_id for r in P.note_ids(rows, taken).collect()}
    assert got == {1: "202607052359-a", 2: "202607060001-a", 3: "202607052359-b"}


def test_rewrite_keeps_all_else(spark):
    pages = spark.createDataFrame([(1, "a [[x]] [[x|y]] [[x#h]] [[xx]] [[x"), (2, "")], "id long, body string")
    mapping = spark.createDataFrame([("x", "long")], "old_id string, new_id string")
    got = {r.id: r.body for r in P.rewrite_wikilinks(pages, mapping).collect()}
    assert got == {1: "a [[long]] [[long|y]] [[long#h]] [[xx]] [[x", 2: ""}


def test_utc_date(spark):
    raw = ["Mon, 06 Jul 2026 23:30:00 -0200", "6 July 2026 00:10 +0100", "2026-07-06T23:59:00Z", "2026-07-06", "2026-07-06T01:00:00+02:00", "soon", "", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = [r[0] for r in rows.select("i", R.utc_date(F.col("raw")).alias("d")).orderBy("i").select("d").collect()]
    day = lambda n: dt.date(2026, 7, n)
    assert got == [day(7), day(5), day(6), day(6), day(5), None, None, None]


def test_bad_payloads_give_nothing(spark):
    good = '<rss><channel><item><title>a</title><link>u</link></item><item><title>b</title></item></channel></rss>'
    landed = spark.createDataFrame([("s", good), ("bad", "<rss><chan"), ("none", None), ("empty", "")], "source_name string, payload string")
    got = R.rss(landed, F.lit(dt.date(2026, 7, 5)))
    assert sorted((r.source_name, r.title, r.low_confidence) for r in got.collect()) == [("s", "a", True), ("s", "b", True)]
    assert sorted(r[0] for r in R.unreadable(landed).collect()) == ["bad", "empty", "none"]


def test_notes_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "n1.md").write_text("---\ntitle: 'x: y'\ntitle: last: one\n---\nbody\nmore")
    (tmp_path / "n2.md").write_text("no head")
    got = {r.name: (r.meta, r.body) for r in R.notes(spark, str(tmp_path)).collect()}
    assert got == {"n1": ({"title": "last: one"}, "body\nmore"), "n2": ({}, "no head")}


def test_streamed_health_equals_the_batch(spark, tmp_path):
    rows = [(f"s{i % 3}", dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i), i, i % 7 == 0) for i in range(60)]
    schema = "source_name string, ts timestamp, seq long, success boolean"
    for n in range(3):
        spark.createDataFrame(rows[20 * n : 20 * n + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        Z.source_health(stream, str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    cols = ["source_name", "seq", "failures", "state"]
    got = spark.read.parquet(*[str(tmp_path / "s" / "out" / str(n)) for n in range(3)]).select(*cols)
    want = B.source_health(spark.createDataFrame(rows, schema)).select(*cols)
    assert sorted(got.collect()) == sorted(want.collect())


def test_streamed_index(spark, tmp_path):
    schema = "pos long, url string, summary string, run_date date"
    words = "alpha beta gamma delta"
    runs = [
        [(1, "https://h.org/a", words, dt.date(2026, 1, 1)), (2, "http://www.h.org/a/", words, dt.date(2026, 1, 1))],
        [(3, "https://h.org/a", "quite other words here", dt.date(2026, 1, 3)), (4, "https://h.org/b", words, dt.date(2026, 1, 3))],
        [(5, "https://h.org/a", words, dt.date(2026, 1, 20))],
        [(6, "https://h.org/a", words, dt.date(2026, 2, 15))],
    ]
    for run in runs:
        spark.createDataFrame(run, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        Z.cross_day(stream, str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(*[str(tmp_path / "s" / "out" / str(n)) for n in range(4)])
    assert {r.pos: r.decision for r in got.collect()} == {1: "new", 2: "drop", 3: "re_coverage", 4: "new", 5: "later", 6: "new"}
    index = {r.normalized_url: r.kept_in_daily for r in spark.read.parquet(str(tmp_path / "s" / "state" / "2")).collect()}
    assert index == {"h.org/a": ["2026-01-01", "2026-01-03", "2026-01-20"], "h.org/b": ["2026-01-03"]}


def test_readers_by_kind(spark):
    feed = "<rss><channel><item><title>a</title><link>u</link><description>d</description><pubDate>05 Jul 2026 00:00:00 GMT</pubDate></item></channel></rss>"
    atom = "<feed><entry><id>i</id><title>t</title><summary>s</summary><published>2026-07-01</published></entry></feed>"
    rows = [("s1", "rss", feed, None), ("s2", "atom", atom, None), ("s3", "json", "[]", dt.date(2026, 7, 4)), ("s3", "json", '[{"paper": {"id": "9", "title": "p"}}]', dt.date(2026, 7, 5)), ("s4", "mirror", feed, None)]
    schema = "source_name string, reader string, payload string, query_date date"
    day = F.lit(dt.date(2026, 7, 5))
    got = R.entries(spark.createDataFrame(rows, schema), day, "papers", "https://p/").collect()
    assert sorted((r.source_name, r.url, r.low_confidence) for r in got) == [("papers", "https://p/9", True), ("s1", "u", False), ("s2", "i", False), ("s4", "u", True)]
    bad = R.entries(spark.createDataFrame([*rows, ("s5", "fax", "", None)], schema), day, "papers", "https://p/")
    try:
        bad.collect()
        raise AssertionError("an unknown reader passed")
    except Exception as error:  # noqa: BLE001
        assert "unknown reader: fax" in str(error)


def test_degraded_sources_are_doubtful(spark):
    found = spark.createDataFrame([("a", False), ("b", False), ("c", False), ("d", True)], "source_name string, low_confidence boolean")
    registry = spark.createDataFrame([("a", "degraded"), ("b", "stable")], "source_name string, reliability string")
    health = spark.createDataFrame([("a", "alive"), ("b", "degraded")], "source_name string, state string")
    got = {r.source_name: r.low_confidence for r in R.demoted(found, health, registry).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": True}


def test_only_public_addresses(spark):
    from lectern.sources.guard import allowed

    hop = lambda *a, url="https://h.org/x": {"url": url, "addresses": list(a)}
    rows = [
        (0, [hop("93.184.216.34")]), (1, [hop("93.184.216.34"), hop("10.0.0.1")]), (2, [hop("93.184.216.34", "127.0.0.1")]), (3, [hop()]),
        (4, [hop("93.184.216.34", url="file:///etc/x")]), (5, [hop("169.254.1.1")]), (6, [hop("::ffff:10.0.0.1")]), (7, [hop("224.0.0.1")]),
        (8, [hop("93.184.216.34")] * 7), (9, []), (10, [hop("nonsense")]), (11, None),
    ]
    frame = spark.createDataFrame(rows, "i int, hops array<struct<url: string, addresses: array<string>>>")
    assert [r.i for r in frame.where(allowed(F.col("hops"))).collect()] == [0]


def test_write_batch(spark, tmp_path):
    from lectern.operators import store as S

    doc = "doc_id string, title string"
    tables = {
        "documents": spark.createDataFrame([("a", "old"), ("b", "b")], doc),
        "tags": spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, tag string"),
        "links": spark.createDataFrame([("b", "a")], "from_id string, to_id string"),
    }
    records = spark.createDataFrame([("a", "mid", 1, ["q"], ["gone"]), ("a", "new", 2, [], ["c", "a", "lost"]), ("c", "c", 1, ["z", "z"], ["a"])], f"{doc}, version int, tags array<string>, link_targets array<string>")
    for _ in range(2):  # a second run writes the same
        got = S.write_batch(tables, records, str(tmp_path / "v1"))
        rows = {n: sorted(map(tuple, f.collect())) for n, f in got.items()}
        assert rows == {"documents": [("a", "new"), ("b", "b"), ("c", "c")], "tags": [("b", "y"), ("c", "z")], "links": [("a", "c"), ("b", "a"), ("c", "a")], "dangling": [("a", "lost")]}


def test_topic_entries_come_once(spark):
    schema = "topic_slug string, link_id string, entry_date date, seq long, line string"
    d = dt.date(2026, 7, 5)
    old = spark.createDataFrame([("t", "a", d, 1, "- [[a]]")], schema)
    new = spark.createDataFrame([("t", "a", d, 5, "x"), ("t", "b", d, 7, "second"), ("t", "b", d, 6, "first"), ("u", "a", d, 8, "other")], schema)
    got = sorted((r.topic_slug, r.link_id, r.line) for r in P.add_topic_entries(old, new).collect())
    assert got == [("t", "a", "- [[a]]"), ("t", "b", "first"), ("u", "a", "other")]


def test_links_of_texts_that_no_shuffle_gathers(spark):
    """Texts without links and targets that aren't mapped meet no common key: nothing but ids and targets is dealt by target."""
    pages = spark.createDataFrame([(1, "a [[x|y]] b"), (2, None), (3, ""), (4, "[[x]][[y#z]][[x"), (5, "[[]] [[n|[[x]]"), (5, "other [[y]]")], "id long, body string")
    mapping = spark.createDataFrame([("x", "new x"), ("y", "$1\\"), ("n", None)], "old_id string, new_id string")
    got = P.rewrite_wikilinks(pages, mapping)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "a [[new x|y]] b"), (2, None), (3, ""), (4, "[[new x]][[$1\\#z]][[x"), (5, "[[]] [[n|[[new x]]"), (5, "other [[$1\\]]")], key=str
    )
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_python_holds_few_texts(spark):
    """Queries that hand whole texts to Python bound its batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for query in ("chunk_paragraphs", "atomic_blocks", "safe_split"):
            spark.conf.set(name, "10000")
            QUERIES[query](spark, "/root/testdata/sf0.001")
            assert int(spark.conf.get(name)) <= 500
    finally:
        spark.conf.set(name, before)
