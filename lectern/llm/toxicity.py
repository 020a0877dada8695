"""Toxicity: a linear model over character n-grams, scaled by naive Bayes log-count ratios.

Features are hashed byte n-grams of the lower-cased text, within a word and its borders. Each
feature has the ratio r = log(p/q), p and q its smoothed shares among toxic and other texts; the
model learns one weight a feature on r, so that rare but telling n-grams weigh as they should. A
text's score takes the excess of each of its distinct n-grams, and so doesn't fade with length.

Defined cases: null and empty texts have no n-grams and get the model's base score; labels that
are null count as no label; a document labelled twice counts twice; with no label of either kind
every score is the smoothed base rate; rows without id are scored and count as not held out; extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textbatch import GOLD, LOWER, WHITE, buffer_of, mix, slices, tidy

BITS = 20
LENGTHS = (4, 5, 6)
FOLDS = 5

_GAPS = WHITE.copy()
for _c in b".,;:!?|\"'()[]{}#%&*$-_/\\+=<>~`^@":
    _GAPS[_c] = True


def grams(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs, sorted, as two arrays; `wanted`: flags of features to keep."""
    buf, starts = buffer_of(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(np.append(starts, len(buf))))
    buf = np.concatenate((np.full(1, 32, np.uint8), buf))  # so owner[i] owns the byte after place i
    low = LOWER[buf].astype(np.uint64)
    low[_GAPS[buf]] = 32
    n = len(low)
    gap = np.cumsum(low == 32)
    keys = []
    for k in LENGTHS:
        if n < k:
            continue
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h = h * np.uint64(257) + low[j : n - k + 1 + j]
        # a gap may stand at the first and the last place only
        inner = gap[k - 2 : n - 1] == gap[: n - k + 1]
        at = np.flatnonzero(inner)
        slot = (mix(h[at] * GOLD + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)
        if wanted is not None:
            told = wanted[slot]
            at, slot = at[told], slot[told]
        keys.append((owner[at] << BITS) | slot)
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> BITS, (key & ((1 << BITS) - 1)).astype(np.int32)


def fit(rows: np.ndarray, features: np.ndarray, labels: np.ndarray, steps: int = 200, ridge: float = 3e-4):
    """(weight per feature, bias) of a logistic model over ratio-scaled, binary features."""
    n = len(labels)
    toxic = labels == 1
    w = np.zeros(1 << BITS)
    if toxic.all() or not toxic.any():
        share = (toxic.sum() + 1) / (n + 2)
        return w.astype(np.float32), float(np.log(share / (1 - share)))
    yes = np.bincount(features[toxic[rows]], minlength=1 << BITS)
    all_ = np.bincount(features, minlength=1 << BITS)
    no = all_ - yes
    ratio = np.log((yes + 0.5) / (toxic.sum() + 1)) - np.log((no + 0.5) / (n - toxic.sum() + 1))
    ratio[(all_ < 3)] = 0
    ratio[np.abs(ratio) < 1.0] = 0  # what both kinds share tells nothing and only adds noise by length
    keep = ratio[features] != 0
    rows, features = rows[keep], features[keep]
    x = ratio[features]
    used, spot = np.unique(features, return_inverse=True)
    v = np.zeros(len(used))
    bias = float(np.log(toxic.sum() / (n - toxic.sum())))
    y = toxic.astype(float)
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (n - toxic.sum()))
    m1, m2, b1, b2 = np.zeros_like(v), np.zeros_like(v), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam on the whole sample
        z = np.bincount(rows, x * v[spot], n) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        gv = np.bincount(spot, x * g[rows], len(used)) + ridge * v / len(used) ** 0.5
        gb = g.sum()
        m1, b1 = 0.9 * m1 + 0.1 * gv, 0.9 * b1 + 0.1 * gb
        m2, b2 = 0.99 * m2 + 0.01 * gv**2, 0.99 * b2 + 0.01 * gb**2
        up = 1 / (1 - 0.9**t)
        down = 1 / (1 - 0.99**t)
        v -= 0.02 * m1 * up / (np.sqrt(m2 * down) + 1e-9)
        bias -= 0.02 * b1 * up / (np.sqrt(b2 * down) + 1e-9)
    w[used] = v * ratio[used]
    return w.astype(np.float32), bias


def scores(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    rows, features = grams(texts, weights != 0)
    z = np.bincount(rows, weights[features], len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(doc_id):
    """Whether a row is in the fold that no label is learnt from; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 2500):
    """(weights, bias) from at most `per_label` labelled rows of each kind, none of them held out.

    The sample is the rows whose hashed id is smallest. Tasks make the features; the driver gets
    those of the sample only, fewer than 2**20 for a text.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = [known.where(F.col("toxic") == k).orderBy(*order).limit(per_label) for k in (0, 1)]
    picked = sample[0].unionByName(sample[1]).select(F.col("doc_id").alias("_labelled"), "toxic")
    # 2 * per_label rows of two numbers: a fixed bound
    rows = small_batches(docs).select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_labelled"))

    def featured(batches):
        for batch in batches:
            for first, end, texts in slices(batch):
                owner, features = grams(texts)
                cut = np.searchsorted(owner, np.arange(end - first + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("toxic").slice(first, end - first).cast(pa.int32()),
                        pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(features, pa.int32())),
                    ],
                    names=["toxic", "features"],
                )

    got = rows.select("text", "toxic").mapInArrow(tidy(featured), "toxic int, features array<int>").toArrow()
    lists = got.column("features").combine_chunks()
    cut = lists.offsets.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(cut) - 1, dtype=np.int32), np.diff(cut))
    features = lists.values.to_numpy()[cut[0] : cut[-1]] if len(lists) else np.zeros(0, np.int32)
    return fit(owner, features, got.column("toxic").to_numpy())


def score_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 2500) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on)."""
    weights, bias = train(docs, labels, per_label)

    def score(batches):
        for batch in batches:
            got = [scores(texts, weights, bias) for _, _, texts in slices(batch)]
            score = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    out = docs.select("doc_id", "text").mapInArrow(tidy(score), "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
