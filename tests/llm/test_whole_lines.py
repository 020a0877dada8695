"""Shards of the line index follow the number of its keys."""

import numpy as np

from lectern.llm import line_dedup


def test_shards_follow_the_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    line = lambda a, b: "\n".join(f"line number {i} of the text" for i in range(a, b))
    frame = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = line_dedup.LineIndex(spark, shards=1, shortest=3)
    index.insert(frame((1, line(0, 100))))
    for n, more in ((100, None), (300, frame((2, line(50, 300))))):
        if more is not None:
            index.insert(more)
        refs = index.refs.collect()
        assert len(refs) == n and index.shards >= n / 16
        shards = {r["shard"]: line_dedup.Cuckoo(np.frombuffer(bytes(r["cells"]), np.uint16)) for r in index.filters.collect()}
        assert len(shards) > n / 32 and all(shards[r["shard"]].holds(bytes(r["key"])) for r in refs)
    assert sum(r["n_docs"] for r in refs) == 350
