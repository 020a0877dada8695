"""Every query with SQL against DuckDB on the smallest tables; the entry module without its optional part."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from lectern.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
#: Empty only where the data can't trigger the rule; a new query must not join them unseen.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    def opened(folder):
        con = duckdb.connect()
        for f in glob.glob(f"{folder}/*.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        return con

    return {folder: opened(folder) for folder in (SF, "/root/testdata/sf0.01")}


def rows(cols, fetched):
    return sorted(str(tuple(r)) for r in fetched)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name, sf):
    folder = f"/root/testdata/{sf}"
    frame = QUERIES[name](spark, folder)
    cols = sorted(frame.columns)
    want = duck[folder].sql(SQL[name])
    assert sorted(want.columns) == cols
    got = rows(cols, frame.select(*cols).collect())
    assert got == rows(cols, want.select(*[f'"{c}"' for c in cols]).fetchall())
    assert got or sf == "sf0.001" or name in MAY_BE_EMPTY


def test_names_are_not_given_twice():
    from lectern.plans.queries import query

    with pytest.raises(ValueError):
        query("topic_trends", None)


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name in ("dedup_papers", "dedup_cross_day", "sim_self_join", "granularity", "source_health"):
            seen = set()
            for n in ("1", "7"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                seen.add(str(sorted(map(str, QUERIES[name](spark, SF).collect()))))
            assert len(seen) == 1, name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_part():
    code = "import sys; sys.modules['lectern.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op1') for k in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
