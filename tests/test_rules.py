"""Rules on small, made rows: the cases that the provided tables don't hold."""

import datetime
import itertools
import random

from pyspark.sql import functions as F

from lectern import config as C
from lectern.functions import text as T
from lectern.functions import urls as U
from lectern.operators import batch as B
from lectern.operators import store as K

TODAY = datetime.date(2026, 7, 5)


def values(spark, made, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").orderBy("i").select(made(F.col("x"))).collect()]


def test_urls(spark):
    urls = ("HTTPS://WWW.Example.org/A/b/?q=1#top", "http://example.org", "", "example.org/x;p/", "https://e.org/P;a/q;b")
    assert values(spark, U.index_key, *urls) == ["example.org/a/b", "example.org", "", "example.org/x;p", "e.org/p;a/q"]
    assert values(spark, U.host_path, *urls[:2]) == ["https://www.example.org/A/b", "http://example.org"]


def test_jaccard(spark):
    pairs = [("the cat sat", "cat sat"), ("", "x"), ("模型发布会", "模型发布了"), ("same words here", "same words here"), ("the of", "the of")]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    got = [r[0] for r in frame.select(T.jaccard(T.tokens(F.col("a")), T.tokens(F.col("b")))).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and 0 < got[2] < 1 and got[3] == 1.0 and got[4] == 0.0


def test_lines(spark):
    assert values(spark, T.noise_line, "12 34 | 5", "中文 说明", "an English line", "  ") == [True, False, False, False]
    assert values(spark, T.reference_line, "Z [1996a]", "[37] A: T", "doi: 10.1", "see arXiv:1", "A et al. said", "plain prose", "-", "(2020)") == [True] * 5 + [False, False, True]
    assert values(spark, T.noise_share, "1\n2\n3\nwords here", "1\n2\n3\n4", "") == [0.75, 1.0, 0.0]


def test_word_count_and_code(spark):
    assert values(spark, T.word_count, "hello", "hello```\nx = 1\n```", "hello https://example.org/a/very/long/url", "a　b") == [5, 5, 5, 2]
    heavy, light, empty = values(spark, T.code_fraction, "ab```" + "x" * 50 + "```", "prose only", "")
    assert heavy > C.CODE_SHARE and light == 0.0 and empty == 0.0


def test_blurb(spark):
    long = "字" * 60 + "。" + "字" * 100
    got = values(spark, T.truncate_blurb, "short", long, "x" * 130, "a **bold " + "y" * 130, "。" + "z" * 130)
    assert got == ["short", "字" * 60 + "。", "x" * 120 + "…", "a …", "。" + "z" * 119 + "…"]


def test_dates(spark):
    raw = ("3 天前", "30 hours ago", "5 hours ago", "Yesterday", "今天", "on 2026-07-01", "2001-01-01", "", "soon", "2026-13-45")
    got = values(spark, lambda x: T.flexible_date(x, F.lit(TODAY)), *raw)
    ago = lambda n: TODAY - datetime.timedelta(days=n)
    assert got == [ago(3), ago(1), ago(0), ago(1), ago(0), datetime.date(2026, 7, 1), None, None, None, None]


def test_tail_of_chunks(spark):
    frame = spark.createDataFrame([(["head", "the end", "[1] A\n[2] B"],), (["head", "[1] A"],), (["head"],)], "c array<string>")
    assert [r[0] for r in frame.select(T.fallback_tail(F.col("c"))).collect()] == ["the end", None, None]


def test_noise(spark):
    rows = [("https://x.org", "We're hiring now"), ("https://a.github.com/x", "join our team"), ("https://x.org", "plain"), ("https://x.org", "webinar on a benchmark")]
    frame = spark.createDataFrame(rows, "u string, t string")
    assert [r[0] for r in frame.select(B.noise(F.col("u"), F.col("t"))).collect()] == [True, False, False, False]


def test_papers(spark):
    rows = [(1, "https://a.org/1", "One  Title!", "p"), (2, "https://canon.org/1", "one title", "q"), (3, "https://canon.org/1", "One Title", "p"), (4, "u", "One title", "other"), (5, "https://canon.org/2", "Two", "p")]
    frame = spark.createDataFrame(rows, "pos long, url string, title string, source_name string")
    assert sorted((r["pos"], r["slot"]) for r in B.dedup_papers(frame, ["p", "q"], "canon.org").collect()) == [(2, 1), (4, 4), (5, 5)]


def test_cross_day(spark):
    entries = spark.createDataFrame([(0, "http://x/a", "new words"), (1, "https://x/a", "new words"), (2, "http://x/b", "some text"), (3, "http://x/c", "alike text"), (4, "http://x/d", "quite another story"), (5, "http://x/e", "t"), (6, "http://x/f", "t")], "pos long, url string, summary string")
    day = lambda n: TODAY - datetime.timedelta(days=n)
    index = spark.createDataFrame([("x/b", day(8), "z"), ("x/c", day(7), "alike text"), ("x/d", day(0), "old tale"), ("x/e", day(31), "t"), ("x/f", day(3), None)], "normalized_url string, first_seen_date date, raw_summary_excerpt string")
    got = {r["pos"]: r["decision"] for r in B.dedup_cross_day(entries, index, F.lit(TODAY)).collect()}
    assert got == {0: "new", 1: "drop", 2: "later", 3: "drop", 4: "re_coverage", 5: "new", 6: "drop"}


def test_alike_pairs_against_all_pairs(spark):
    rng = random.Random(4)
    sets = [sorted(rng.sample("abcdefghijkl", rng.randint(1, 10))) for _ in range(60)]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sets)] + [(99, [])], "pos long, tokens array<string>")
    got = {(r["a"], r["b"]) for r in B.alike_pairs(frame, 75).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    want = set()
    for a, b in itertools.combinations(range(60), 2):
        x, y = set(sets[a]), set(sets[b])
        if x == y:
            if first[tuple(sets[a])] == a:
                want.add((a, b))
        elif 100 * len(x & y) >= 75 * len(x | y) and first[tuple(sets[a])] == a and first[tuple(sets[b])] == b:
            want.add((a, b))
    assert got == want


def test_health(spark):
    ran = "SFFFSF"
    frame = spark.createDataFrame([("s", datetime.datetime(2026, 1, 1), i, x == "S") for i, x in enumerate(ran)], "source_name string, ts timestamp, seq long, success boolean")
    got = [r["state"] for r in B.source_health(frame).orderBy("seq").collect()]
    assert got == ["alive", "degraded", "degraded", "dead", "alive", "degraded"]


def test_daily_classes(spark):
    frame = spark.createDataFrame([(True, "n", "d"), (True, None, "d"), (False, "n", "placeholder"), (False, "n", "d"), (False, None, "placeholder")], "r boolean, z string, ch string")
    got = [r[0] for r in frame.select(B.classify_daily(F.col("r"), F.col("z"), F.col("ch"))).collect()]
    assert got == ["recap_with_zettel", "recap_not_upgraded", "has_zettel_original_missing", "has_zettel_has_original", "no_zettel_has_original"]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, version int")
    once = K.upsert(old, new, "id")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "d"), (3, "e")] == sorted(map(tuple, K.upsert(once, new, "id").collect()))


def test_links_stay_and_tags_are_replaced(spark):
    docs = spark.createDataFrame([(1,), (2,)], "id long")
    links = spark.createDataFrame([(1, 2)], "from_id long, to_id long")
    new = spark.createDataFrame([(2, 1), (2, 9), (1, 2)], "from_id long, to_id long")
    assert sorted(map(tuple, K.add_links(links, new, docs).collect())) == [(1, 2), (2, 1)]
    tags = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, tag string")
    got = K.replace_tags(tags, spark.createDataFrame([(1, [])], "doc_id long, tags array<string>"))
    assert list(map(tuple, got.collect())) == [(2, "b")]


def test_latest_file_with_equal_names(spark):
    """Of files with one name the first row stays, however the rows are dealt."""
    rows = [("a", pos, f"page-{pos % 5}.md") for pos in range(40)] + [("b", 7, None)]
    for n in (1, 2, 7):
        for order in (rows, rows[::-1]):
            got = B.latest_file(spark.createDataFrame(order, "source_name string, pos long, file string").repartition(n), "source_name", "file")
            assert sorted(tuple(r) for r in got.collect()) == [("a", 4, "page-4.md"), ("b", 7, None)]


def test_flexible_date_of_any_number(spark):
    """Numbers of six digits and more count; what no int holds gives null."""
    made = lambda raw: T.flexible_date(raw, F.lit(TODAY))
    back = lambda n: TODAY - datetime.timedelta(days=n)
    got = values(spark, made, "99999 days ago", "100000 days ago", "128202 天前", "2400047 hours ago", "2400048小时前", "99999999999 days ago", "9" * 30 + " hours ago", "7 days ago")
    assert got == [back(99999), back(100000), back(128202), back(100001), back(100002), None, None, back(7)]


def test_links_are_dealt_by_their_number(spark, monkeypatch):
    """A task's share of the links stays as it is where there are more of them."""
    from lectern.operators import folds
    from lectern.plans import views as V

    sf_dir = "/root/testdata/sf0.001"
    monkeypatch.setattr(folds, "PART_ROWS", 50)
    rows = V.table(spark, sf_dir, "lineitem").count()
    assert V.links(spark, sf_dir).rdd.getNumPartitions() == folds.parts_for(spark, rows) == rows // 50 + 1
    links = spark.createDataFrame([(a, a + 1) for a in range(300)] * 2, "from_id long, to_id long")
    got = K.add_links(links, links.selectExpr("to_id AS from_id", "from_id AS to_id"), spark.range(200), folds.parts_for(spark, 600))
    assert got.rdd.getNumPartitions() >= 13
    assert sorted(map(tuple, got.collect())) == sorted({(a, a + 1) for a in range(300)} | {(a + 1, a) for a in range(199)})
