"""Stages that drop rows: by row, not by id, and whatever the other columns are called."""

import pytest

from lectern.llm import common, decontaminate, exact_dedup, minhash, quality

NAMES = (
    "key row gone_id _gone_id _leaking _lang _cost _bytes _mean _limit _trusted _labelled node bands marks n h norm text_sha256 slice hash "
    "cost mean limit rejected perplexity max_perplexity row_key item_key hits part slot kept component_id keep_id group_size trusted counted low high"
).split()
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


@pytest.fixture(scope="module")
def wide(spark):
    """Rows that repeat ids, with a column for each name that the operators use inside."""
    rows = [(1, "a b c"), (5, "a  b c"), (5, "another text"), (7, LONG), (8, LONG + " more"), (8, "own words of eight"), (9, None), (None, "a b c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang")
    return frame.selectExpr("*", *[f"'{n}' AS `{n}`" for n in NAMES])


def pairs(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


def test_exact_copies_go_by_row(wide):
    kept = exact_dedup.drop_exact(wide)
    assert kept.columns == wide.columns
    assert pairs(kept) == pairs(wide.where("NOT (doc_id <=> 5 AND text = 'a  b c')"))


def test_near_copies_go_by_row(wide):
    kept = minhash.drop_near(wide)
    assert kept.columns == wide.columns
    assert pairs(kept) == pairs(wide.where("doc_id IS NULL OR text IS NULL OR NOT (doc_id = 8 AND text LIKE '%more') AND NOT (doc_id = 5 AND text LIKE 'a  b%')"))


def test_leaks_go_by_row(spark, wide):
    items = spark.createDataFrame([(1, LONG), (2, "own words of eight")], "item_id long, text string").selectExpr("*", *[f"1 AS `{n}`" for n in NAMES])
    kept = decontaminate.drop_leaks(wide, items)
    assert kept.columns == wide.columns and pairs(kept) == pairs(wide.where("coalesce(doc_id, 0) NOT IN (7, 8)"))
    assert kept.select(*NAMES).distinct().collect() == [tuple(NAMES)]


def test_good_rows_keep_their_columns(spark, wide):
    labels = spark.createDataFrame([(i, 1) for i in range(1, 8)], "doc_id long, quality int")
    kept = quality.keep_good(wide, labels)
    assert kept.columns == wide.columns and pairs(kept) == pairs(wide)


def test_leaks_of_many_items_in_several_lists(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(15))) for i in range(9)]
    docs = [(1, " and ".join(t for _, t in items)), (2, (items[3][1] + " ") * 30), (3, "nothing of it")]
    got = {r["doc_id"]: (r["items"], r["n_items"]) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: (list(range(9)), 9), 2: ([3], 1), 3: ([], 0)}


def test_temporary_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    with common.temporary(spark) as keep:
        first = common.written(spark.range(3).toDF("x"), "one")
        kept = keep(common.written(first.selectExpr("x + 1 AS x"), "two"))
    assert sorted(r["x"] for r in kept.collect()) == [1, 2, 3]
    assert [p.name.split("-")[0] for p in (tmp_path / "lectern").iterdir()] == ["two"]


def test_clusters_need_a_shared_folder():
    class Conf:
        get = staticmethod(lambda name, default: default)

    class Session:
        conf, sparkContext = Conf, type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Session)
