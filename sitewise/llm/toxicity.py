"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Counts of training texts that hold each hashed n-gram, toxic or not, come from all labelled training rows. The
ratio of the two smoothed counts scales the n-gram's presence; the n-grams whose counts differ most significantly
are the features of a logistic regression, which is fitted on a bounded sample of different training texts of each
class; its bias is set back to how common the classes are.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import buckets, chunks, presence
from .words import lists, slices

SIZES = (3, 4, 5)
BITS = 18
FEATURES = 4096
# Rows in the fit, the bound of what reaches the driver: half of them of each class at most.
FIT_ROWS = 20_000
SMOOTH = 1.0
PENALTY = 2.0
# Labels sent to all tasks; with more of them, texts and labels meet in a shuffle.
SENT_LABELS = 1_000_000


@dataclass
class Toxic:
    place: np.ndarray  # feature of each bucket, -1 if none
    weights: np.ndarray
    bias: float


def _features(texts, place):
    """(text, feature) of every feature present, once each, sorted."""
    width = int(place.max()) + 2
    for first, points, owner in chunks(texts):
        found = []
        for bucket, own in buckets(points, owner, SIZES, BITS):
            at = place[bucket]
            hit = np.flatnonzero(at >= 0)
            found.append((own[hit].astype(np.int64) + first) * width + at[hit])
        yield np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def present(texts: list[str | None], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature of every presence. Parts of a long text are joined, so each counts once."""
    width = int(place.max()) + 2
    pairs = list(_features(texts, place))
    flat = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return flat // width, flat % width


def fit(labelled: DataFrame, label: str = "toxic", text: str = "text") -> Toxic | None:
    """Rows without a label are left out; null texts are empty. None unless both classes are there."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), (F.col(label) > 0).alias("y")).where("y is not null")

    def count(batches):
        total = np.zeros((2, 1 << BITS), np.int64)
        n = np.zeros(2, np.int64)
        for batch in slices(batches):
            texts, y = batch.column("text").to_pylist(), batch.column("y").to_numpy(zero_copy_only=False).astype(bool)
            n += [(~y).sum(), y.sum()]
            for part, matrix in presence(texts, SIZES, BITS):
                held = np.flatnonzero(matrix)
                who, what = held >> BITS, held & ((1 << BITS) - 1)
                toxic = y[part][who]
                for k, own in enumerate((what[~toxic], what[toxic])):
                    if len(own):
                        total[k] += np.bincount(own, minlength=1 << BITS)
        used = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[0][used], n[0])), pa.array(np.append(total[1][used], n[1]))],
                                         names=["bucket", "other", "toxic"])

    # one row per bucket at most: the table has a fixed size
    counts = rows.mapInArrow(count, "bucket long, other long, toxic long").groupBy("bucket").agg(
        F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()
    bucket, other, toxic = (counts[c].to_numpy() for c in ("bucket", "other", "toxic"))
    whole = bucket == -1
    if not whole.any() or not other[whole][0] or not toxic[whole][0]:
        return None
    q, p = int(other[whole][0]), int(toxic[whole][0])
    bucket, other, toxic = bucket[~whole], other[~whole], toxic[~whole]
    ratio = np.log((toxic + SMOOTH) / (p + 2 * SMOOTH)) - np.log((other + SMOOTH) / (q + 2 * SMOOTH))
    pooled = (toxic + other + 1) / (p + q + 2)
    significance = np.abs(toxic / p - other / q) / np.sqrt(pooled * (1 - pooled) * (1 / p + 1 / q) + 1e-12)
    chosen = np.lexsort((bucket, -significance))[:FEATURES]
    place = np.full(1 << BITS, -1, np.int64)
    place[bucket[chosen]] = np.arange(len(chosen))
    scale = ratio[chosen]
    # different texts of each class, so that copies do not crowd out the others
    keyed = rows.withColumn("h", F.xxhash64("text", F.lit(4)))
    different = {r["y"]: r["n"] for r in keyed.groupBy("y").agg(F.count_distinct("h").alias("n")).collect()}
    shares = {k: min(1.0, FIT_ROWS / 2 / n) for k, n in different.items()}

    def sample(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            who, what = present(texts, place)
            ends = np.searchsorted(who, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), lists([what[ends[i]:ends[i + 1]] for i in range(len(texts))])],
                                             names=["h", "y", "found"])

    draw = F.col("h").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    drawn = keyed.where(draw < F.when(F.col("y"), shares[True]).otherwise(shares[False]))
    got = (drawn.mapInArrow(sample, "h long, y boolean, found array<long>").groupBy("h", "y").agg(F.first("found").alias("found"))
           .orderBy("h", "y").limit(2 * FIT_ROWS).toArrow())
    y = got["y"].to_numpy().astype(np.float64)
    found = got["found"].combine_chunks()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    what = found.flatten().to_numpy()
    who = np.repeat(np.arange(len(y)), np.diff(found.offsets.to_numpy()))
    weights, bias = _logistic(who, what, scale, y)
    # the fit saw the classes at other shares than all rows have
    bias += float(np.log(p / q) - np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    return Toxic(place, weights * scale, bias)


def _logistic(who, what, scale, y, rounds: int = 300):
    """Weights of scaled presence features by accelerated gradient steps, with a squared penalty."""
    n, k = len(y), len(scale)
    value = scale[what]
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    w, bias = np.zeros(k), float(np.log(rate / (1 - rate)))
    if not n:
        return w, bias
    # a bound of the curvature by power iteration
    v = np.ones(k) / np.sqrt(k)
    top = 1.0
    for _ in range(15):
        v = np.bincount(what, value * np.bincount(who, value * v[what], minlength=n)[who], minlength=k)
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1 / (0.25 * top + PENALTY)
    ahead, before = w.copy(), w.copy()
    for t in range(rounds):
        z = np.bincount(who, value * ahead[what], minlength=n) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gradient = np.bincount(what, value * error[who], minlength=k) + PENALTY * ahead
        w = ahead - step * gradient
        bias -= float(error.mean()) * 2
        ahead = w + t / (t + 3) * (w - before)
        before = w
    return w, bias


def score(docs: DataFrame, model: Toxic | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name``, the probability of the label 1; 0 for all without a model. Null texts are empty; an
    empty text gets the classifier's bias. Columns are kept, one called like the new one is replaced."""
    docs = docs.drop(name)
    if model is None:
        return docs.withColumn(name, F.lit(0.0))

    names = docs.columns

    def predict(batches):
        for batch in slices(batches):
            texts = batch.column("_text").to_pylist()
            who, what = present(texts, model.place)
            z = np.bincount(who, model.weights[what], minlength=len(texts)) + model.bias
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                                             names=[*names, name])

    schema = docs.schema.simpleString()[len("struct<"):-1]
    return docs.withColumn("_text", F.col(text).cast("string")).mapInArrow(predict, f"{schema}, {name} double")


def labelled_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", text: str = "text") -> DataFrame:
    """(text, label) of documents with a label; a document with several counts as toxic if one of them says so."""
    once = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    if once.count() <= SENT_LABELS:
        once = F.broadcast(once)
    return docs.select(key, text).join(once, key).select(F.col(text), F.col("_label").alias(label))
