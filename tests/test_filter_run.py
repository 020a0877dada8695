"""Each filter gets its entries, figures add up, and a lost row raises."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern.operators import filter_run as R
from lectern.plans import views as V

D = dt.date(2026, 7, 5)
SCHEMA = "pos long, url string, title string, summary string, source_name string, published date, low_confidence boolean"
# a title key is told apart by its letters: titles share no words unless a filter should meet them
ROWS = [
    (1, "https://a.example/1", "Alpha quantum network", "one summary about networks", "s", D, False),
    (2, "https://a.example/1", "Alpha quantum network", "one summary about networks", "s", D, True),  # same URL
    (3, "https://b.example/3", "Bright paper on proteins", "folding of chains", "p1", D, False),
    (4, "https://arxiv.org/abs/4", "Bright Paper on Proteins!", "biology wholly otherwise", "p2", D, False),
    (5, "https://c.example/5", "Cold storage archive", "frozen tapes", "s", D - dt.timedelta(days=40), False),
    (6, "https://d.example/6", "Join our webinar", "sales talk", "s", D, False),
    (7, "https://e.example/7", "Echo chamber study", "words seen before", "s", None, False),
    (8, "https://f.example/8", None, None, "s", D, None),
]
INDEX = [("e.example/7", D - dt.timedelta(days=1), "words seen before")]


def told(spark, rows=ROWS):
    entries = spark.createDataFrame(rows, SCHEMA)
    index = spark.createDataFrame(INDEX, "normalized_url string, first_seen_date date, raw_summary_excerpt string")
    return entries, R.fates(entries, index, F.lit(D), ["p1", "p2"], "arxiv.org").cache()


def test_fates_and_figures(spark):
    entries, got = told(spark)
    fates = {r.pos: r.fate for r in got.collect()}
    assert fates.pop(3) in ("same_batch", "papers")
    assert fates == {1: "kept", 2: "same_batch", 4: "kept", 5: "stale", 6: "noise", 7: "cross_day", 8: "kept"}
    row = R.audited(entries, got).first().asDict()
    assert row["total"] == 8 == row["kept"] + sum(row[s] for s in R.STAGES) and row["kept"] == 3
    attempts = spark.createDataFrame([("s", False), ("s", True), ("p1", False), ("p2", None)], "source_name string, success boolean")
    enriched = got.where("fate = 'kept'").select("pos", (F.col("pos") != 8).alias("ok"))
    figures = R.run_figures(attempts, entries, got, enriched, entries.limit(2)).first()
    assert tuple(figures) == (3, 2, 8, 3, 1, 2)
    with pytest.raises(Exception, match="1 entries were kept and not enriched"):
        R.run_figures(attempts, entries, got, enriched.where("pos <> 1"), entries).collect()


@pytest.mark.parametrize("harm", [lambda x: x.where("pos <> 4"), lambda x: x.unionByName(x.where("pos = 1")), lambda x: x.withColumn("pos", F.when(F.col("pos") == 2, 99).otherwise(F.col("pos"))), lambda x: x.withColumn("fate", F.lit("lost"))])
def test_what_does_not_add_up_raises(spark, harm):
    entries = spark.createDataFrame(ROWS, SCHEMA)
    sound = entries.select("pos", F.lit("kept").alias("fate"))
    assert R.audited(entries, sound).first()["total"] == 8
    with pytest.raises(Exception, match="exactly one fate"):
        R.audited(entries, harm(sound)).collect()


def test_no_entries(spark):
    entries, got = told(spark, [])
    assert tuple(R.audited(entries, got).first()) == (0,) * 7


def test_whole_batch_adds_up(spark):
    from lectern.plans.queries import QUERIES
    import lectern.plans.batches  # noqa: F401

    row = QUERIES["run_figures"](spark, "/root/testdata/sf0.001").first()
    assert row["fetched"] == V.entries(spark, "/root/testdata/sf0.001").count() > row["kept"] > 0
