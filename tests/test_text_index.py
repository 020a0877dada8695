"""The index finds what reading every text finds, opens only the files it needs, and takes batches again."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import search as S
from lectern.operators import text_index as I
from lectern.plans.queries import text_index

ASKED = ["the", "the of", '"of the"', 'the -of', "-the", '"in the of" or "of the" -and', "license UNDER or -the -of", '-"of the" the', "nowhere", "nowhere or of", "", "or", "-", '"the the"', "日本 or ünï"]


def found(df):
    rows = [tuple(r) for r in df.select("id", "hits", "words").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("asked", ASKED)
def test_against_all_texts(spark, asked):
    sf_dir = "/root/testdata/sf0.01"
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    assert found(I.find(spark, text_index(spark, sf_dir), asked)) == found(S.search(texts, asked))


def test_batches_replace_and_repeat(spark, tmp_path):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice(["ab", "cd", "Ef", "x9", "ünï", "日本"]) + rng.choice(["", ",", "\n"]) for _ in range(rng.randrange(12)))
    folder, now = str(tmp_path / "index"), {}
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    for batch in range(3):
        rows = [(rng.randrange(40), rng.choice([None, "", line(), line(), line()])) for _ in range(25)]
        rows = list({i: (i, t) for i, t in rows}.values())
        if batch == 1:  # a run that was stopped had other rows
            I.add_batch(folder, frame([(i, "stopped ab cd") for i, _ in rows]), batch)
        I.add_batch(folder, frame(rows), batch)
        now |= dict(rows)
        for asked in ("ab", '"ab cd"', "-ab", "cd -ef or 日本", "stopped"):
            assert found(I.find(spark, folder, asked)) == found(S.search(frame(list(now.items())), asked)), (batch, asked)


def test_files_read(spark):
    """A search for one word opens the files of its bucket in each batch, a small part of all."""
    folder = text_index(spark, "/root/testdata/sf0.01")

    def opened(df):
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().finalPhysicalPlan().collectLeaves() if "Adaptive" in df._jdf.queryExecution().executedPlan().nodeName() else df._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))

    every = opened(spark.read.parquet(f"{folder}/postings").select("term"))
    got = opened(I.lists_of(spark, folder, ["license"]))
    assert 1 <= got <= 2 * I.SPREAD and got * 50 < every
    assert opened(I.lists_of(spark, folder, ["license", "of"])) <= 4 * I.SPREAD
    plan = I.find(spark, folder, "license")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan or "PushedFilters: [EqualTo(term" in plan or "IsNotNull(term)" in plan


def test_one_cut_a_text(spark):
    """Reading every text, the words are cut once."""
    texts = spark.createDataFrame([(1, "a b c")], "id long, text string")
    plan = S.search(texts, 'a "b c" -d')._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_texts_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Only texts whose id comes again are grouped; many such ids or few, the least text counts."""
    rows = [(i, f"ab {i}") for i in range(30)] + [(3, "aa first"), (3, None), (4, "zz last"), (None, "none b"), (None, "none a"), (31, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    plain = docs.groupBy("id").agg(F.min("text").alias("text")).where("text IS NOT NULL")
    want = sorted(map(str, plain.collect()))
    for most in (I.REPEATS, 1):
        monkeypatch.setattr(I, "REPEATS", most)
        assert sorted(map(str, I._one_text(docs).collect())) == want
    plan = I._one_text(docs.where("id > 9"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_sorts_are_small(spark, tmp_path):
    """A batch's rows are sorted in many parts, by word, without a second sort for the write."""
    folder = str(tmp_path / "index")
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 50))) for i in range(200)], "id long, text string")
    I.add_batch(folder, docs, 0)
    store = spark.read.parquet(f"{folder}/postings")
    assert store.groupBy(F.input_file_name()).count().count() > I.BUCKETS / 2
    for name in [r[0] for r in store.select(F.input_file_name()).distinct().limit(5).collect()]:
        terms = [r.term for r in spark.read.parquet(name).collect()]
        assert terms == sorted(terms)
