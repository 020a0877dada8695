"""The pipeline: order, columns, each stage's decisions against brute force, odd and empty tables."""

import re

import corpus_pipeline
import duckdb
import pytest
import test_operators as brute

from lectern.llm import pieces
from lectern.llm.queries import table, vocabulary

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "pieces"]


def test_each_stage_works_on_what_the_one_before_kept(spark):
    docs = table(spark, SF, "documents")
    bench = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    words = lambda t: f" {' '.join(re.findall('[a-z0-9\u0080-\U0010ffff]+', brute.lower(t or '')))} "
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        rows = {r["doc_id"]: r for r in out.collect()}
        if name == "pieces":
            v = pieces.vocabulary_at(vocabulary("piece_bpe_32k.model"))
            assert rows.keys() == before.keys() and all(r["round_trip"] for r in rows.values())
            for i, r in rows.items():
                assert b"".join(v.surface[k] for k in r["ids"]).decode().replace("▁", " ")[1:] == (before[i] or "").replace("▁", " ")
            break
        assert out.columns == docs.columns and rows.keys() <= before.keys()
        gone = before.keys() - rows.keys()
        if name == "quality":
            assert not any(labels.get(i) == 1 for i in gone)
        if name == "exact_dedup":
            norm = {i: re.sub(brute.SPACES, " ", t or "") for i, t in before.items()}
            assert gone == {i for i, t in norm.items() if any(j < i and u == t for j, u in norm.items())}
        if name == "near_dedup":
            assert gone == {i for i, _, _, kept in brute.brute_near(sorted(before.items())) if not kept}
        if name == "decontaminate":
            held = {i for i, t in before.items() if any(words(b) in words(t) for (b,) in bench)}
            assert held <= gone
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_run_gives_what_the_stages_give(spark):
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert got == {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, empty):
    rows = [(i, t, None, "s", None, "x") for i, t in brute.ODD]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long, key string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "pieces":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        else:
            assert out.count() == docs.count()
    assert empty or docs.where("doc_id IN (1, 4, 6, 8)").count() == 4
