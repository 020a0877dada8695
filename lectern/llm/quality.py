"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, by sharded count joins.

The model is over characters, unfolded, with n-grams of ORDER. Half of the trusted documents, by a
hash of their ids, are counted; the other half sets the limits, so that no limit rests on texts that
the model has seen. Counts, continuation counts, context totals and back-off weights are tables
keyed by n-gram and joined with each other; none of them goes to the driver or to every task, and
all grow with the corpus.

Documents meet the tables in slices: a slice is some 16 MB of whole texts, written compressed, with
the distinct n-grams that it holds. Distinct n-grams of all slices are joined with the tables level
by level, which gives each its cost, the negative log of its probability; costs are joined with the
slices' n-grams and go back to the slices, both as tables bucketed by slice, so that texts aren't
shuffled. A text's cost is the sum over its places.

A document is rejected where its cost a character is above its language's limit: the `quantile` of
the held-out trusted documents, or what lies `reach` times as far above their median as their
lower tenth lies below it, whichever is higher; few documents tell a high quantile badly.

Defined cases: null and empty texts have perplexity null and aren't rejected; so does a corpus
without trusted text; a language with fewer than `least` held-out trusted documents takes median and
lower tenth from its own documents; where it has fewer than `least` documents, or no language is
named and held out, they aren't judged: max_perplexity is null and rejected false; rows without id
are scored but never trusted; rows repeated are counted and scored again; NUL counts as U+FFFD;
extra columns, of any name, are kept by `keep_good` and not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, row_key, small_batches, without, written
from .textbatch import mix, tidy

ORDER = 4
PAD = "\x02"
#: Bytes of text in a slice, unless one text is longer; a block is what arrays are made for at once.
SLICE, BLOCK = 16 << 20, 1 << 20
#: Trusted ids up to this number, 8 bytes each, may go to every task; more are joined by shuffles.
FEW_IDS = 1 << 20
_STEP = mix(np.arange(1, ORDER + 1, dtype=np.uint64)) | np.uint64(1)


def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(n-gram hashes, n-grams as rows of code points, numbers of texts, n-grams of each) of blocks.

    A text longer than a block is in several, each with the characters before as context.
    """
    held: list[tuple[int, str, int]] = []
    size, pad = 0, PAD * (ORDER - 1)
    for i, text in enumerate(texts):
        for a in range(0, len(text), BLOCK):  # none of an empty text
            body = (pad + text[:BLOCK]) if a == 0 else text[a - ORDER + 1 : a + BLOCK]
            held.append((i, body, len(body) - ORDER + 1))
            size += len(body)
            if size >= BLOCK:
                yield _block(held)
                held, size = [], 0
    if held:
        yield _block(held)


def _block(held: list[tuple[int, str, int]]):
    n = np.array([k for _, _, k in held], np.int64)
    points = np.frombuffer("".join(body for _, body, _ in held).encode("utf-32-le"), np.uint32)
    points = np.where(points == 0, np.uint32(0xFFFD), points)
    grams = np.lib.stride_tricks.sliding_window_view(points, ORDER)
    hashes = np.zeros(len(grams), np.uint64)
    for j in range(ORDER):
        hashes += points[j : j + len(grams)] * _STEP[j]
    # those that begin in one text and end in the next
    own = np.ones(len(grams), bool)
    ends = np.cumsum(n + ORDER - 1)[:-1]
    own[(ends[:, None] - np.arange(1, ORDER)).ravel()] = False
    at = np.flatnonzero(own)
    return mix(hashes[at]), grams[at], np.array([i for i, _, _ in held], np.int64), n


def distinct(hashes: np.ndarray):
    """(place of each distinct hash's first, how often it comes, number of each place's hash)."""
    import pandas as pd

    code, names = pd.factorize(hashes)
    at = np.zeros(len(names), np.int64)
    at[code[::-1]] = np.arange(len(code))[::-1]
    return at, np.bincount(code, minlength=len(names)), code


def strings(grams: np.ndarray) -> list[str]:
    return np.ascontiguousarray(grams).view(f"<U{ORDER}").ravel().tolist()


def counted(batches):
    """(gram, n) of a task's texts, added up before they leave."""
    total: dict[str, int] = {}

    def out():
        made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])
        total.clear()
        return made

    for batch in batches:
        for hashes, grams, _, _ in blocks([t or "" for t in batch.column("text").to_pylist()]):
            at, n, _ = distinct(hashes)
            for gram, k in zip(strings(grams[at]), n.tolist()):
                total[gram] = total.get(gram, 0) + k
            if len(total) > 1 << 19:
                yield out()
    yield out()


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts, four numbers."""
    row = counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(row[f"n{k}"], 1) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), top) for d, top in zip((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), (0.95, 1.95, 2.95)))


def model(texts: DataFrame) -> list[tuple[DataFrame, DataFrame]] | None:
    """For n-grams of 1 to ORDER: (gram, own) and (context, spare); None without text.

    own is what an n-gram's discounted count gives it, spare the weight its context leaves to the next
    lower order. Counts of the full order are how often an n-gram stands in the text; those of lower
    orders how many different characters precede it.
    """
    level = written(texts.mapInArrow(tidy(counted), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "quality-counts")
    if level.isEmpty():
        return None
    tables = []
    for k in range(ORDER, 0, -1):
        d1, d2, d3 = discounts(level)
        n = F.col("n")
        cut = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        rows = level.select("gram", "n", cut.alias("cut"), F.substring("gram", 1, k - 1).alias("context"))
        totals = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("held"))
        own = rows.join(totals, "context").select("gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"))
        tables.append((written(own, f"quality-own{k}"), written(totals.select("context", (F.col("held") / F.col("total")).alias("spare")), f"quality-spare{k}")))
        if k > 1:
            level = written(level.groupBy(F.substring("gram", 2, k - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"quality-level{k - 1}")
    return tables[::-1]


def probabilities(grams: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """`grams` (with the column gram) with p, by joins from the lowest order up."""
    letters = tables[0][0].count() + 1  # and one for all others
    out = grams.withColumn("p", F.lit(1.0 / letters))
    for k, (own, spare) in enumerate(tables, 1):
        out = out.join(own.withColumnRenamed("gram", "tail"), F.substring("gram", ORDER - k + 1, k) == F.col("tail"), "left")
        out = out.join(spare, F.substring("gram", ORDER - k + 1, k - 1) == F.col("context"), "left")
        p = F.coalesce("own", F.lit(0.0)) + F.coalesce("spare", F.lit(1.0)) * F.col("p")
        out = out.select(*grams.columns, p.alias("p"))
    return out


_SLICE = "slice long, texts binary, sizes array<long>, names array<struct<key: binary, doc_id: long, lang: string>>, hashes array<long>, grams array<string>"


def _sliced(batches):
    """A row a slice: its texts compressed, what names its rows, and its distinct n-grams."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    codec = pa.Codec("zstd", compression_level=6)
    names, texts, size = [], [], 0

    def out():
        nonlocal names, texts, size, number
        known: dict[int, str] = {}
        for hashes, grams, _, _ in blocks(texts):
            at, _, _ = distinct(hashes)
            known.update(zip(hashes[at].view(np.int64).tolist(), strings(grams[at])))
        raw = [t.encode() for t in texts]
        row = {
            "slice": part << 32 | number, "texts": codec.compress(b"".join(raw), asbytes=True), "sizes": [len(t) for t in raw], "names": names,
            "hashes": list(known), "grams": list(known.values()),
        }
        names, texts, size, number = [], [], 0, number + 1
        return pa.RecordBatch.from_pylist([row], schema=schema)

    name = pa.struct([("key", pa.binary()), ("doc_id", pa.int64()), ("lang", pa.string())])
    schema = pa.schema([("slice", pa.int64()), ("texts", pa.binary()), ("sizes", pa.list_(pa.int64())), ("names", pa.list_(name)), ("hashes", pa.list_(pa.int64())), ("grams", pa.list_(pa.string()))])
    for batch in batches:
        named = batch.select(["key", "doc_id", "lang"]).to_pylist()
        for own, text in zip(named, batch.column("text").to_pylist()):
            text = text or ""
            if texts and size + len(text) > SLICE:
                yield out()
            names.append(own)
            texts.append(text)
            size += len(text)
    if texts:
        yield out()


def _told(batches):
    """(key, doc_id, lang, cost, n) of each row of the slices, from their n-grams' costs."""
    codec = pa.Codec("zstd")
    for batch in batches:
        for i in range(batch.num_rows):
            sizes = batch.column("sizes")[i].values.to_numpy()
            raw = codec.decompress(batch.column("texts")[i].as_py(), int(sizes.sum()), asbytes=True)
            ends = np.cumsum(sizes)
            texts = [raw[a:b].decode() for a, b in zip((ends - sizes).tolist(), ends.tolist())]
            costs = batch.column("costs")[i]
            known = costs.values.field(0).to_numpy() if costs.is_valid else np.zeros(0, np.int64)
            worth = costs.values.field(1).to_numpy() if costs.is_valid else np.zeros(0)
            order = np.argsort(known)
            known, worth = known[order], worth[order]
            cost, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for hashes, _, owner, n in blocks(texts):
                at, _, code = distinct(hashes)
                each = worth[np.searchsorted(known, hashes[at].view(np.int64))]
                sums = np.concatenate(([0.0], np.cumsum(each[code])))
                np.add.at(cost, owner, np.diff(sums[np.concatenate(([0], np.cumsum(n)))]))
                np.add.at(count, owner, n)
            names = batch.column("names")[i].values
            cols = [names.field(0), names.field(1), names.field(2), pa.array(cost), pa.array(count)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "doc_id", "lang", "cost", "n"])


def _bucketed(df: DataFrame, name: str, buckets: int) -> tuple[DataFrame, str]:
    """`df` as a table in the shared folder bucketed by slice, and the table's name."""
    spark = df.sparkSession
    table = f"lectern_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "slice").option("path", fresh_path(spark, table)).option("compression", "zstd").saveAsTable(table)
    return spark.table(table), table


def scored(docs: DataFrame, tables: list[tuple[DataFrame, DataFrame]] | None) -> DataFrame:
    """(key, doc_id, lang, cost, n) of all rows: the sum of the negative log probabilities of n characters."""
    rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    if tables is None:
        return rows.select("key", "doc_id", "lang", F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("n"))
    spark = docs.sparkSession
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = int(min(max(size // SLICE, 4), 10_000))
    slices, one = _bucketed(rows.mapInArrow(tidy(_sliced), _SLICE), "slices", buckets)
    asked = slices.select(F.explode(F.arrays_zip("hashes", "grams")).alias("x")).groupBy(F.col("x.hashes").alias("hash")).agg(F.first("x.grams").alias("gram"))
    costs = written(probabilities(written(asked, "quality-asked"), tables).select("hash", (-F.log("p")).alias("cost")), "quality-costs")
    held = slices.select("slice", F.explode("hashes").alias("hash")).join(costs, "hash")
    # a list has the distinct n-grams of one slice
    # dealt as the buckets are, so that no second shuffle follows
    told = held.repartition(buckets, "slice").groupBy("slice").agg(F.collect_list(F.struct("hash", "cost")).alias("costs"))
    back, two = _bucketed(told, "costs", buckets)
    both = slices.select("slice", "texts", "sizes", "names").join(back, "slice", "left")
    out = written(both.select("texts", "sizes", "names", "costs").mapInArrow(tidy(_told), "key binary, doc_id long, lang string, cost double, n long"), "quality-scores")
    for df, table in ((slices, one), (back, two)):
        place = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0].rsplit("/", 1)[0])
        spark.sql(f"DROP TABLE {table}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(trusted, counted): ids of trusted documents, and whether the model counts them or they set the limits."""
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("trusted")).distinct()
    return ids.withColumn("counted", F.crc32(F.col("trusted").cast("string")) % 2 == 0)


def _with_ids(rows: DataFrame, ids: DataFrame, key) -> DataFrame:
    return rows.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, key == F.col("trusted"), "left_semi")


def limits(scores: DataFrame, ids: DataFrame, quantile: float, least: int, prior: int, reach: float) -> DataFrame:
    """(lang, mean, limit) of the languages that can be judged.

    A text's cost a character is taken together with `prior` characters of the language's median, so
    that chance doesn't decide on short texts.
    """
    some = scores.where("n > 0 AND lang <> ''")
    known = written(_with_ids(scores.where("n > 0"), ids.where("NOT counted"), F.col("doc_id")).select("lang", "cost", "n"), "quality-held-out")
    middle = lambda rows: rows.groupBy("lang").agg(F.percentile_approx(F.try_divide("cost", "n"), 0.5, 10_000).alias("mean"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least).select("lang", "mean")
    trusted = middle(known)
    scarce = middle(some.join(trusted.select("lang"), "lang", "left_anti"))
    level = (F.col("cost") + prior * F.col("mean")) / (F.col("n") + prior)
    marks = F.percentile_approx(level, [0.1, 0.5, quantile], 100_000)
    tail = F.col("x")[1] + reach * (F.col("x")[1] - F.col("x")[0])
    spread = lambda rows, means: rows.join(means, "lang").groupBy("lang").agg(F.first("mean").alias("mean"), marks.alias("x"))
    of_trusted = spread(known, trusted).select("lang", "mean", F.greatest(F.col("x")[2], tail).alias("limit"))
    of_scarce = spread(some, scarce).select("lang", "mean", tail.alias("limit"))
    return written(of_trusted.unionByName(of_scarce), "quality-limits")


def assess(docs: DataFrame, labels: DataFrame, quantile: float, least: int, prior: int, reach: float) -> DataFrame:
    """(key, doc_id, perplexity, max_perplexity, rejected) of all rows."""
    ids = written(trusted_ids(labels), "quality-ids")
    texts = small_batches(docs).where("doc_id IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scores = scored(docs, model(_with_ids(texts, ids.where("counted"), F.col("doc_id")).select("text")))
    found = limits(scores, ids, quantile, least, prior, reach)
    level = (F.col("cost") + prior * F.col("mean")) / (F.col("n") + prior)
    return scores.join(found, "lang", "left").select(
        "key",
        "doc_id",
        F.when(F.col("n") > 0, F.exp(F.try_divide("cost", "n"))).alias("perplexity"),
        F.exp("limit").alias("max_perplexity"),
        F.coalesce((F.col("n") > 0) & (level > F.col("limit")), F.lit(False)).alias("rejected"),
    )


def score_quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, least: int = 20, prior: int = 64, reach: float = 2.5) -> DataFrame:
    """Per row: doc_id, perplexity a character, max_perplexity (before the short-text prior) and rejected."""
    return assess(docs, labels, quantile, least, prior, reach).drop("key")


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, least: int = 20, prior: int = 64, reach: float = 2.5) -> DataFrame:
    """The rows of `docs` that aren't rejected, with the columns of `docs`."""
    return without(docs, assess(docs, labels, quantile, least, prior, reach).where("rejected").select("key").distinct())
