"""Identify languages with a string kernel.

The kernel of two texts is the number of character n-grams (of all lengths of a spectrum, counted once each, hashed)
that both hold, divided by the root of the product of their own numbers. A few training texts are landmarks; the
Nyström map turns kernel values with them into features, and one ridge regression per language against the rest is
fitted on those. A batch of texts is scored by two matrix products: presence by landmarks, then by the weights.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewise.session import settle

from .chars import presence
from .words import slices

SPECTRUM = (1, 2, 3)
BITS = 15
# Training texts and landmarks per language, the bound of the fit: 4 kB each reach the driver.
FIT_PER_LABEL = 600
LANDMARKS_PER_LABEL = 24
# All languages together; more languages than that have one text and one landmark each.
FIT_ROWS = 12_000
LANDMARK_ROWS = 480
# Texts unpacked at once on the driver, 128 kB each.
FIT_SLICE = 256
# Cells of a batch's matrix: the product needs them as floats, 8 MB in each worker.
SCORE_CELLS = 1 << 21
RIDGE = 1e-3


@dataclass
class Kernel:
    labels: list[str]
    landmarks: np.ndarray  # bucket x landmark, 0 or 1
    norms: np.ndarray
    weights: np.ndarray  # landmark x label
    bias: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """text x label: near 1 for a label that fits, near -1 for others."""
        out = np.zeros((len(texts), len(self.labels)))
        for part, matrix in presence(texts, SPECTRUM, BITS, SCORE_CELLS):
            own = np.maximum(matrix.sum(1), 1)
            kernel = (matrix.astype(np.float32) @ self.landmarks) / np.sqrt(own[:, None] * self.norms[None, :])
            out[part] = kernel @ self.weights + self.bias
        return out


def fit(labelled: DataFrame, label: str = "lang", text: str = "text") -> Kernel | None:
    """Fit on at most FIT_PER_LABEL different texts of each label, those with the smallest hashes; copies count once,
    and labels with fewer texts give all. Null labels and texts are left out. None if no label is there."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label")).where(
        "label is not null and text is not null")
    draw = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    rows = rows.withColumn("draw", draw)
    # hashes only: no group of copies is larger than one row after this
    texts = settle(rows.select("label", "draw").distinct())
    count = texts.select("label").distinct().count()
    if not count:
        return None
    per = max(1, min(FIT_PER_LABEL, FIT_ROWS // count))
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw"))
    drawn = settle(texts.withColumn("_n", place).where(F.col("_n") <= per).drop("_n"))
    small = count * per <= max(FIT_ROWS, LANDMARK_ROWS)
    rows = rows.join(F.broadcast(drawn) if small else drawn, ["label", "draw"]).dropDuplicates(["label", "draw"])

    def pack(batches):
        for batch in slices(batches):
            bits = []
            for _, matrix in presence(batch.column("text").to_pylist(), SPECTRUM, BITS, SCORE_CELLS):
                bits += [m.tobytes() for m in np.packbits(matrix, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("draw"), pa.array(bits, pa.binary())], names=["label", "draw", "bits"])

    got = rows.mapInArrow(pack, "label string, draw long, bits binary").toPandas().sort_values(["label", "draw", "bits"])
    got = got.drop_duplicates(["label", "bits"])
    if got.empty:
        return None
    labels = sorted(got["label"].unique())
    packed = got["bits"].tolist()

    def unpacked(rows) -> np.ndarray:
        bits = np.frombuffer(b"".join(packed[i] for i in rows), np.uint8).reshape(len(rows), -1)
        return np.unpackbits(bits, axis=1).astype(np.float32)

    marks = max(1, min(LANDMARKS_PER_LABEL, LANDMARK_ROWS // len(labels)))
    chosen = np.flatnonzero((got.groupby("label").cumcount() < marks).to_numpy())
    landmarks = np.ascontiguousarray(unpacked(chosen).T)
    norms = np.ones(len(got), np.float32)
    kernel = np.empty((len(got), len(chosen)), np.float32)
    # the bits take 32 times their packed size once they are floats: the driver unpacks FIT_SLICE texts at a time
    for start in range(0, len(got), FIT_SLICE):
        part = np.arange(start, min(start + FIT_SLICE, len(got)))
        x = unpacked(part)
        norms[part] = np.maximum(x.sum(1), 1)
        kernel[part] = x @ landmarks
    kernel /= np.sqrt(norms[:, None] * norms[chosen][None, :])
    values, vectors = np.linalg.eigh(kernel[chosen].astype(np.float64))
    kept = values > 1e-6 * values.max()
    nystroem = vectors[:, kept] / np.sqrt(values[kept])
    z = kernel @ nystroem
    y = np.where(got["label"].to_numpy()[:, None] == np.array(labels)[None, :], 1.0, -1.0)
    middle, target = z.mean(0), y.mean(0)
    zc = z - middle
    ridge = np.linalg.solve(zc.T @ zc + RIDGE * len(z) * np.eye(z.shape[1]), zc.T @ (y - target))
    return Kernel(labels, landmarks, norms[chosen].astype(np.float64), nystroem @ ridge, target - middle @ ridge)


def identify(docs: DataFrame, model: Kernel | None, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with ``name`` and ``score`` (0 to 1).

    Texts that are null or hold no letter get `und` and 0, and so does every text if there is no model. Ties go to
    the first label. Columns of ``docs`` are kept, except that one called like a new one is replaced.
    """
    docs = docs.drop(name, score)
    lettered = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.withColumns({name: F.lit("und"), score: F.lit(0.0)})

    names = docs.columns

    def predict(batches):
        for batch in slices(batches):
            found = model.scores(batch.column(body).to_pylist())
            best = found.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], batch.column("_lettered"), pa.array([model.labels[b] for b in best], pa.string()),
                 pa.array(np.clip((found[np.arange(len(best)), best] + 1) / 2, 0, 1))], names=[*names, "_lettered", name, score])

    schema = docs.schema.simpleString()[len("struct<"):-1]
    # the text travels once, unless it is no string yet
    body = text if dict(docs.dtypes)[text] == "string" else "_text"
    out = docs.withColumns({"_lettered": lettered, body: F.col(text).cast("string")}).mapInArrow(
        predict, f"{schema}, _lettered boolean, {name} string, {score} double")
    return out.withColumns({name: F.when(F.col("_lettered"), F.col(name)).otherwise("und"),
                            score: F.when(F.col("_lettered"), F.col(score)).otherwise(0.0)}).drop("_lettered")
