"""Languages with few trusted documents."""

import numpy as np

from lectern.llm import quality


def test_scarce_languages_are_not_judged_by_others(spark):
    rng = np.random.default_rng(2)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(60))
    rows = [(i, text("abcd"), "en") for i in range(80)] + [(100 + i, text("жшщюя"), "ru") for i in range(60)]
    rows += [(200 + i, text("жшщюя"), None) for i in range(20)] + [(300 + i, text("őűŐŰ"), "hu") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(80)] + [(100, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    # all were rejected before; the tail beyond a scaled quantile still is
    assert sum(r["rejected"] for i, r in got.items() if 100 <= i < 200) <= 3
    assert not any(r["rejected"] for i, r in got.items() if i >= 200)
    assert all((got[i]["max_perplexity"] is None) == (i >= 200) for i in got)
    assert quality.keep_good(docs, labels).where("doc_id >= 200").count() == 25
