"""A batch changes the buckets it touches, once, whatever kills the run that writes it."""

import json
import os
import random
import re

import pytest

from lectern.operators import bucket_store as M
from lectern.operators.bucket_store import KEYS, BucketStore, rows_of

DOC = "doc_id string, title string, frontmatter string"
SCHEMAS = {"documents": DOC, "tags": "doc_id string, tag string", "links": "from_id string, to_id string", "url_index": "normalized_url string, zettel_id string"}
RECORD = f"{DOC}, version int, tags array<string>, link_targets array<string>"


def front(url=None, note=None):
    return json.dumps({"source_url": url, "related_zettel_id": note})


def made(spark, folder, rows, buckets=4):
    store = BucketStore(spark, str(folder), buckets)
    store.create({n: spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()})
    return store


def held(store):
    return sorted((tuple(r) for r in rows_of(store).collect()), key=str)


def files(store, name):
    root = f"{store.folder}/{name}"
    return {f for d, _, names in os.walk(root) for f in (os.path.join(d, n) for n in names) if f.endswith(".parquet")}


def played(state, records):
    """The batch record by record, in order of version."""
    for doc_id, title, text, _, tags, _ in sorted(records, key=lambda r: r[3]):
        state["documents"][doc_id] = title
        state["tags"][doc_id] = set(tags or ())
        named = json.loads(text)
        if named["source_url"] and named["related_zettel_id"]:
            key = named["source_url"].removeprefix("https://")
            if key in state["url_index"]:
                state["url_index"][key] = named["related_zettel_id"]
    for doc_id, *_, targets in records:
        state["links"] |= {(doc_id, t) for t in targets or () if t in state["documents"]}


def flat(state):
    rows = [("documents", *x) for x in state["documents"].items()] + [("tags", d, t) for d, ts in state["tags"].items() for t in ts]
    return sorted(rows + [("links", *x) for x in state["links"]] + [("url_index", *x) for x in state["url_index"].items()], key=str)


def test_batches_against_a_loop(spark, tmp_path):
    rng = random.Random(4)
    start = {"documents": [(f"d{i}", "t", "{}") for i in range(20)], "tags": [(f"d{i}", "x") for i in range(20)], "url_index": [(f"e.example/{i}", None) for i in range(9)]}
    store = made(spark, tmp_path, start)
    state = {"documents": {d: t for d, t, _ in start["documents"]}, "tags": {d: {t} for d, t in start["tags"]}, "links": set(), "url_index": dict(start["url_index"])}
    for batch in range(2):
        ids = lambda: f"d{rng.randrange(40)}"
        records = [
            (ids(), f"title {n}", front(rng.choice([None, "", f"https://e.example/{rng.randrange(12)}"]), rng.choice([None, f"note {n}"])), n, rng.choice([None, [], ["x", "y", "y"]]), rng.choice([None, [], [ids(), ids()]]))
            for n in range(15)
        ]
        frame = spark.createDataFrame(records, RECORD)
        assert store.write(f"b{batch}", frame)
        played(state, records)
        assert held(store) == flat(state)
        assert not store.write(f"b{batch}", frame)
        assert held(store) == flat(state)


def test_other_buckets_keep_their_files(spark, tmp_path):
    store = made(spark, tmp_path, {"documents": [(f"d{i}", "t", "{}") for i in range(100)]}, buckets=32)
    before = {n: files(store, n) for n in KEYS}
    store.write("b", spark.createDataFrame([("d1", "new", front(), 1, ["z"], ["d2", "lost"])], RECORD))
    for name, changed in (("documents", 1), ("tags", 1), ("links", 1), ("url_index", 0)):
        assert len(before[name] - files(store, name)) == changed, name
    assert [tuple(r) for r in store.dangling("b").collect()] == [("d1", "lost")]
    plan = store.table("documents", [3])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan)


def test_the_last_tag_of_a_bucket_goes(spark, tmp_path):
    store = made(spark, tmp_path, {"documents": [("a", "t", "{}")], "tags": [("a", "x")]})
    store.write("b", spark.createDataFrame([("a", "t", front(), 1, [], None)], RECORD))
    assert store.table("tags").collect() == []


KILLED = [("a", "new", front("https://e.example/1", "n"), 1, ["z"], ["b", "a"]), ("b", "b", front(), 1, None, ["gone"])]
START = {"documents": [("a", "t", "{}")], "tags": [("a", "x")], "url_index": [("e.example/1", None)]}
WHOLE = [("documents", "a", "new"), ("documents", "b", "b"), ("links", "a", "a"), ("links", "a", "b"), ("tags", "a", "z"), ("url_index", "e.example/1", "n")]


def kill(monkeypatch, store, records, step, instead):
    with monkeypatch.context() as m:
        m.setattr(BucketStore, step, instead)
        with pytest.raises(KeyboardInterrupt):
            store.write("b", records)


@pytest.mark.parametrize("step", ["_stage", "_apply"])
def test_a_killed_run_is_made_again(spark, tmp_path, monkeypatch, step):
    records = spark.createDataFrame(KILLED, RECORD)
    store = made(spark, tmp_path, START, 2)
    right = getattr(BucketStore, step)

    def killed(self, *args):
        right(self, *args)
        raise KeyboardInterrupt

    kill(monkeypatch, store, records, step, killed)
    again = BucketStore(spark, store.folder, 2)
    again.write("b", records)
    assert held(again) == WHOLE


def test_killed_between_two_tables(spark, tmp_path, monkeypatch):
    """The batch that comes next finds the first one finished."""
    records = spark.createDataFrame(KILLED, RECORD)
    store = made(spark, tmp_path, START, 2)

    def half(self, batch):
        for name in ("documents", "tags"):
            M._overwrite(spark.read.parquet(f"{self.folder}/staged/{batch}/{name}"), f"{self.folder}/{name}", "dynamic")
        raise KeyboardInterrupt

    kill(monkeypatch, store, records, "_apply", half)
    store.write("c", records.limit(0))
    assert held(store) == WHOLE


def test_no_records(spark, tmp_path):
    store = made(spark, tmp_path, {})
    assert store.write("b", spark.createDataFrame([], RECORD)) and held(store) == []
