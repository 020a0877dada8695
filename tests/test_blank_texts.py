"""Queries over texts that are empty, white space alone, or have odd white space, against their SQL."""

import duckdb
import pytest

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.plans.catalog import QUERIES, SQL

WHITE = ("", " ", " \n \n", "\n", "\n\n\n", "\t", "\r", "\r\n", "\f", "\v", "\x1c", "\x85", "\u00a0", "\u2003", "\u2028", "\u3000")
TEXTS = (None, "## one\n\ntwo", "one\n## two\nthree", "one\n\n##", *WHITE, *(f"{w}one{w}two{w}" for w in WHITE), *(f"a b\n{w}\n" for w in WHITE))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with `documents`, each text under three ids, and DuckDB over it."""
    folder = str(tmp_path_factory.mktemp("blank"))
    rows = [(3 * i + k, text, "en", "web", len(text or "")) for i, text in enumerate(TEXTS) for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return folder, con


def same_rows(spark, tables, name):
    folder, con = tables
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, folder).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall())) and got


def values(spark, made, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").orderBy("i").select(made(F.col("x"))).collect()]


def test_abs_cleanup(spark, tables):
    same_rows(spark, tables, "abs_cleanup")


def test_abstract_page_without_an_abstract(spark):
    head = "# Computer Science > Language\n\n [Submitted on 3 Jan 2024]\n\n#    Title: T\n\n    View PDF\nAbstract:"
    bar = "\n\n    Full-text links:\nAccess the paper"
    got = values(spark, T.clean_abstract, head + "  " + bar, head + " \n \n" + bar, head + "\u3000of it\u00a0" + bar, head + "\n one\n\n two \n" + bar, "plain " + bar, head)
    assert got == ["", "", "of it", "one\n\n two", "plain", ""]
    # a run of new lines is passed once
    run = "a" + "\n" * 20_000 + "b"
    assert values(spark, T.clean_abstract, run, run + " \n \n\n \nFull-text links: x\n") == [run, run]


def test_fts_headline(spark, tables):
    same_rows(spark, tables, "fts_headline")


def test_headline_of_a_text_that_ends_with_the_word(spark):
    made = lambda x: T.headline(x, ["zzzz"], 3)
    got = values(spark, made, "one Zzzz, ", "one Zzzz,", "Zzzz two three four ", "", "one \u00bdzzzz", "one\u3000(ZZZZ)\ntwo \u2028")
    assert got == ["<mark>Zzzz,</mark> ", "<mark>Zzzz,</mark>", "<mark>Zzzz</mark> two three", "", "one \u00bdzzzz", "<mark>(ZZZZ)</mark> two "]


def test_legacy_gist(spark, tables):
    same_rows(spark, tables, "legacy_gist")


def test_gist_of_an_empty_section(spark):
    head = "x\n## 概念 / 事件\n"
    got = values(spark, T.legacy_gist, head + "## y\nz", head + "\n \n## y\nz", head + "\n", head + "\n\u3000\n## y", "## y\nz ")
    assert got == ["", "", "", "", "## y z"]
    got = values(spark, T.legacy_gist, head + "\n one\ntwo\u3000\n## y", head + "\n### Part\none\n### Other", head + "##", head + "\none", head + "\n" + "a" * 250)
    assert got == ["one two", "### Part one", "##", "one", "a" * 200 + "…"]
