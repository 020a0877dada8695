"""What a day's page shows first, on made rows."""

import datetime as dt

import pytest

from lectern.operators import annotate as A
from lectern.operators import pages as P

A_DAY, B_DAY, C_DAY, D_DAY = (dt.date(2026, 7, i) for i in (1, 2, 3, 4))


def test_highlights(spark):
    rows = [(A_DAY, i, str(i), "t", f"g{i}") for i in (4, 2, 1)] + [(B_DAY, i, str(i), None, f"g{i}") for i in range(100)]
    rows += [(C_DAY, i, str(3 * i + 1), "t", "g") for i in range(7)] + [(D_DAY, 9, "1", "t", "later"), (D_DAY, 1, "1", "t", "first"), (D_DAY, 2, "2", "t", None)]
    frame = spark.createDataFrame(rows, "doc_date date, pos long, link_id string, title string, gist string").repartition(5)
    for size in (6, 40, 200):
        got = A.highlights(frame, size=size)
        own = {}
        for r in sorted(got.collect()):
            own.setdefault(r.doc_date, []).append((r.place, r.link_id, r.gist))
        assert own == {
            A_DAY: [(1, "1", "g1"), (2, "2", "g2"), (3, "4", "g4")],
            B_DAY: [(i + 1, str(x), f"g{x}") for i, x in enumerate((99, 96, 93, 90, 87))],
            D_DAY: [(1, "1", "first"), (2, "2", None)],
        }
    days = frame.select("doc_date")
    topics = frame.selectExpr("*", "'agents' AS topic_slug")
    tldr = {r.doc_date: r.section for r in P.daily_sections(topics, days, A.highlights(frame)).where("part = 1").collect()}
    assert tldr[B_DAY] == "## TL;DR\n\n- g99\n- g96\n- g93\n- g90\n- g87" and C_DAY not in tldr
    twice = lambda shown: [shown[1]["link_id"], "gone", shown[1]["link_id"], shown[0]["link_id"]]
    assert [(r.place, r.link_id) for r in A.highlights(frame.where("day(doc_date) = 3"), twice).orderBy("place").collect()] == [(1, "4"), (2, "1")]
    assert A.highlights(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        A.highlights(frame, size=5)
