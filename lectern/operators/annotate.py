"""Judgements that a model would give, and what is made of them.

An annotator takes a list of rows, as dictionaries, and returns a list of answers; it may leave rows
out, answer twice or invent some. The offline one answers by fixed rules, so that everything after
it can be run and tested without a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern import config as C
from lectern.operators.folds import cut
from lectern.operators.scans import in_blocks, running

Annotator = Callable[[list[dict]], list[dict]]
ANSWER = "url string, topic_slug string, zettel_worthy boolean, rationale string"
_ANSWER = pa.schema([("url", pa.string()), ("topic_slug", pa.string()), ("zettel_worthy", pa.bool_()), ("rationale", pa.string())])


def offline(rows: list[dict]) -> list[dict]:
    """A topic by the URL's length, worthy by the title's; URLs whose length is a multiple of seven get no answer."""
    out = [
        {"url": r["url"], "topic_slug": C.TOPICS[len(r["url"]) % len(C.TOPICS)], "zettel_worthy": len(r["title"]) % 5 == 0, "rationale": "by rule"}
        for r in rows
        if len(r["url"]) % 7
    ]
    return [*out, {"url": "https://invented.example/", "topic_slug": "agents", "zettel_worthy": True, "rationale": "of no row"}]


def answers(rows: DataFrame, annotator: Annotator = offline, size: int = C.ANNOTATED_ROWS) -> DataFrame:
    """All that the annotator says of rows (url, title, gist), asked `size` at a time within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                yield pa.RecordBatch.from_pylist(annotator(batch.slice(first, size).to_pylist()), schema=_ANSWER)

    return rows.select("url", "title", "gist").mapInArrow(run, ANSWER)


def assigned(rows: DataFrame, came: DataFrame) -> DataFrame:
    """(url, topic_slug, zettel_worthy, rationale) of each URL in `rows`.

    Answers to unknown URLs go; of several the greatest counts; what has no answer gets the overflow topic.
    """
    best = came.groupBy("url").agg(F.max(F.struct("topic_slug", "zettel_worthy", "rationale")).alias("x"))
    got = rows.select("url").distinct().join(best, "url", "left")
    return got.select(
        "url",
        F.coalesce("x.topic_slug", F.lit(C.OVERFLOW_TOPIC)).alias("topic_slug"),
        F.coalesce("x.zettel_worthy", F.lit(False)).alias("zettel_worthy"),
        F.coalesce("x.rationale", F.lit("no answer")).alias("rationale"),
    )


#: Takes a day's rows (link_id, title, gist), as dictionaries, and returns the link_ids it would show, best first.
Selector = Callable[[list[dict]], list[str]]


def by_third(rows: list[dict]) -> list[str]:
    """The offline selector: of ids that are multiples of three the largest come first; and one of no row."""
    return ["of no row", *sorted((r["link_id"] for r in rows if int(r["link_id"]) % 3 == 0), key=int, reverse=True)]


def highlights(rows: DataFrame, selector: Selector = by_third, most: int = C.HIGHLIGHTS, size: int = C.SELECTED_ROWS) -> DataFrame:
    """(doc_date, place, pos, link_id, gist): what a day's page shows first. `rows`: doc_date, pos, link_id, title, gist.

    A day of at most `most` rows shows them all, in order of pos, and the selector isn't asked. Of what it says
    for others the first `most` that the day has count; a link named twice counts once, and it may name
    fewer or none. It is shown at most `size` rows at a time: a day with more is dealt to several calls, and
    what they choose to further ones, until one call sees all that is left. Of rows with one link the first counts.
    """
    if size <= most:
        raise ValueError("a call must see more rows than it may choose")
    keys, order = ["doc_date"], ["pos", "link_id"]
    fields = ["doc_date", "pos", "link_id", "title", "gist"]
    first = rows.groupBy("doc_date", "link_id").agg(F.min(F.struct("pos", "title", "gist")).alias("x")).select("doc_date", "x.pos", "link_id", "x.title", "x.gist")
    counts = first.groupBy("doc_date").agg(F.count(F.lit(1)).alias("held"))
    left = cut(first.join(counts, "doc_date"))
    small = left.where(F.col("held") <= most)
    place = F.row_number().over(Window.partitionBy("doc_date").orderBy("pos", "link_id"))
    shown = small.select("doc_date", place.alias("place"), "pos", "link_id", "gist")
    left = left.where(F.col("held") > most).select(*fields)

    def chosen(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["pos", "link_id"])
        own = group.set_index("link_id", drop=False)
        named = [x for x in dict.fromkeys(selector(group[["link_id", "title", "gist"]].to_dict("records"))) if x in own.index][:most]
        out = own.loc[named].reset_index(drop=True)
        out["place"] = range(1, len(out) + 1)
        return out[[*fields, "place"]]

    schema = f"{', '.join(f'{n} {t}' for n, t in left.dtypes)}, place int"
    while True:
        numbered = cut(running(in_blocks(left, keys, order), keys, order, n=("sum", F.lit(1).cast("long"), 0)).withColumn("call", F.floor((F.col("n") - 1) / size)))
        got = cut(numbered.groupBy("doc_date", "call").applyInPandas(lambda g: chosen(g), schema))
        if numbered.where("call > 0").isEmpty():
            return shown.unionByName(got.select("doc_date", "place", "pos", "link_id", "gist"))
        left = got.select(*fields)


def sound_clusters(clusters: DataFrame, valid: DataFrame) -> DataFrame:
    """(page, cluster, ids): ids that the page's `valid` rows (page, id) have, in their order `pos`; empty clusters go.

    `clusters` has page, cluster and id, a row each. A page whose clusters are all empty gets one of all its ids.
    """
    real = clusters.select("page", "cluster", "id").distinct().join(valid, ["page", "id"])
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    own = real.groupBy("page", "cluster").agg(ids.alias("ids"))
    rest = valid.join(own.select("page").distinct(), "page", "left_anti").groupBy("page").agg(ids.alias("ids"))
    return own.unionByName(rest.select("page", F.lit(0).cast("long").alias("cluster"), "ids"))


def sound_edges(edges: DataFrame, valid: DataFrame) -> DataFrame:
    """Edges (page, from_id, to_id, ...) between two different ids of the page."""
    end = lambda name: valid.select("page", F.col("id").alias(name))
    return edges.where("from_id <> to_id").join(end("from_id"), ["page", "from_id"], "left_semi").join(end("to_id"), ["page", "to_id"], "left_semi")
