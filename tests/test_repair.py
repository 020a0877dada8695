"""Documents taken over from an older folder: what is wrong, and that a second plan is empty."""

import datetime as dt

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import repair as W

FILES = "kind string, name string, source_url string, dated string, body string"
HELD = "id string, doc_type string, migrated boolean, doc_date date, word_count long, gist string, article_count long, entry_count long, topics array<string>, articles_processed long, topics_touched long, body string"
ODD, DAY = dt.date(2026, 7, 5), dt.date(2024, 3, 2)


def row(name, kind, migrated=True, day=DAY, words=None, gist=None, entries=None, processed=None, touched=None, body="", count=None, topics=None):
    return (name, kind, migrated, day, words, gist, count, entries, topics, processed, touched, body)


def test_repairs(spark):
    first = spark.range(1).select(T.original_id(F.lit("u"))).first()[0]
    files = [
        ("original", "a-1", "u", "2020-01-01", "old words"), ("original", "a-2", "u", "2024-03-02 08:00:00", "# T\n> meta\n> more\n\nnew words"),
        ("original", "b", "", "2024-03-02", "no address"), ("original", "c", None, None, None), ("original", "d", "unknown", "2024-03-02", "x"),
        ("daily", "2024-03-02", None, None, "# D\n\nsee [[gone|x]] [[stays]]"), ("digest", "2024-03-02", None, None, "[[gone#p]]"), ("daily", "2024-03-05", None, None, None),
    ]
    held = [
        row(first, "original", day=ODD, words=0, body="> meta\n\nnew words"),
        row("2024-03-02", "daily", entries=7, topics=["a", "b"], body="see [[gone|x]] [[stays]]"),
        row("digest-2024-03-02", "digest", body="[[here#p]]"),
        row("t", "topic", count=9, body="intro\n- [[a]] x\n- [[b]]"),
        row("e", "topic", count=0, body=None),
        row("2024-03-03", "daily", processed=4, touched=1, body="file is gone [[gone]]"),
        row("2024-03-04", "daily", migrated=False, entries=3, body="not taken over"),
        row("2024-03-05", "daily", migrated=None, entries=3, body=None),
        row("original-unheld", "original", words=5, gist="g", body="file is gone"),
    ]
    documents = spark.createDataFrame(held, HELD)
    renamed = spark.createDataFrame([("gone", "here"), ("gone", "here")], "old_id string, new_id string")
    args = spark.createDataFrame(files, FILES), documents, renamed, F.lit(ODD)
    right = W.recomputed(*args)
    plan = {(r.id, r.field): (r.stored, r.recomputed) for r in W.repair_plan(documents, right).collect()}
    assert {k for k in plan if k[1] == "body"} == {(first, "body"), ("2024-03-02", "body")}
    assert {k: v for k, v in plan.items() if k[1] != "body"} == {
        (first, "doc_date"): ("2026-07-05", "2024-03-02"), (first, "word_count"): ("0", "8"), (first, "gist"): (None, "new words"),
        ("2024-03-02", "articles_processed"): (None, "7"), ("2024-03-02", "topics_touched"): (None, "2"), ("t", "article_count"): ("9", "2"),
    }
    after = W.repaired(documents, right)
    assert after.columns == documents.columns
    got = {r.id: r for r in after.collect()}
    assert len(got) == len(held)
    assert got[first].body == "new words" and got["2024-03-02"].body == "see [[here|x]] [[stays]]"
    for name in ("2024-03-03", "2024-03-04", "2024-03-05", "e", "original-unheld", "digest-2024-03-02"):
        assert tuple(got[name]) == next(x for x in held if x[0] == name)
    again = W.recomputed(args[0], after, renamed, F.lit(ODD))
    assert W.repair_plan(after, again).collect() == []
    assert W.repair_plan(documents.limit(0), W.recomputed(args[0], documents.limit(0), renamed, F.lit(ODD))).collect() == []
