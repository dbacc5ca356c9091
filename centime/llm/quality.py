"""Compression classifier for text quality.

Two zstandard dictionaries hold labelled good and bad text. The difference between a text's compressed sizes under the two,
divided by the larger, is the raw measure; a logistic curve fitted on other labelled rows turns it into a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, crc_mod, hashed_sample, map_rows, texts_of
from .compression import Sizer, raw_dictionary, slice_of

#: The bound on labelled rows of each class that a model is fitted on, and how they are used.
SAMPLE_PER_CLASS, DICTIONARY_BYTES, SLICE_BYTES, CHUNK, LEVEL = 1200, 65_536, 300, 512, 9
THRESHOLD = 0.3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float = 0.0
    intercept: float = 0.0

    def measure(self):
        """A function from a text's bytes to its normalised size difference; 0 for an empty text."""
        good, bad = (Sizer(d, CHUNK, LEVEL) for d in (self.good, self.bad))

        def of(data: bytes) -> float:
            g, b = good(data), bad(data)
            return (b - g) / max(b, g, 1)

        return of

    def score(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * x + self.intercept))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton steps for a one-variable logistic regression with a weak prior on the slope."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - 1e-3 * w
        w = w + np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), gradient)
    return w[0] / scale, w[1]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    """Fit on ``docs`` (doc_id, text) by ``labels`` (doc_id, quality 0 or 1): at most ``per_class`` documents a class.

    Every second one makes the dictionaries, the others the curve, weighted to the classes' true shares. What reaches the driver
    is a slice of SLICE_BYTES of each of the former, of which a dictionary takes the first that fit into DICTIONARY_BYTES (about
    218), and a number for each of the latter, measured in tasks on whole texts. With a class missing, every score is the share
    of class 1 (0.5 without rows). Null ids, texts and labels are left out; of an id's repeated rows the least text is taken.
    """
    known = labels.where("quality in (0, 1)").select("doc_id", "quality")
    ids = checkpointed(docs.where("text is not null").select("doc_id").join(known, "doc_id").distinct())
    totals = {r[0]: r[1] for r in ids.groupBy("quality").count().collect()}
    n = sum(totals.values())
    if len(totals) < 2:
        p = min(max(totals.get(1, 0) / n, 0.001), 0.999) if n else 0.5
        return QualityModel(b"-", b"-", 0.0, math.log(p / (1 - p)))
    halves = {k: (v[::2], v[1::2] or v) for k, v in hashed_sample(ids, "doc_id", "quality", per_class).items()}
    texts = checkpointed(texts_of(docs, [i for pair in halves.values() for half in pair for i in half]))
    kind = texts.schema["doc_id"].dataType.simpleString()
    wanted = texts.where(F.col("doc_id").isin(*(i for pair in halves.values() for i in pair[0])))
    slices = {r[0]: bytes(r[1]) for r in map_rows(wanted, lambda: lambda r: (_plain(r[0]), slice_of(r[1], SLICE_BYTES)), f"doc_id {kind}, slice binary").collect()}
    model = QualityModel(*(raw_dictionary([slices[i] for i in halves[k][0]], DICTIONARY_BYTES) or b"-" for k in (1, 0)))
    others = texts.where(F.col("doc_id").isin(*(i for pair in halves.values() for i in pair[1])))
    measures = {r[0]: r[1] for r in score(others, model).select("doc_id", "size_difference").collect()}
    x = {k: [measures[i] for i in pair[1]] for k, pair in halves.items()}
    weight = np.concatenate([np.full(len(x[k]), totals[k] / n * (len(x[0]) + len(x[1])) / max(len(x[k]), 1)) for k in (0, 1)])
    model.slope, model.intercept = _logistic(np.array(x[0] + x[1]), np.repeat([0.0, 1.0], [len(x[0]), len(x[1])]), weight)
    return model


def _plain(key):
    return key.decode() if isinstance(key, bytes) else key


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score, size_difference) for every row, from its whole text alone. Null counts as empty; repeated rows stay."""

    def make():
        measure = model.measure()

        def one(r):
            x = measure(r[1] or b"")
            return r[0], model.score(x), x

        return one

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double, size_difference double")


def held_out(column):
    return F.coalesce(crc_mod(column, 5) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): fitted on labelled rows that are not held out, applied to all rows."""
    known = labels.select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    model = fit(docs, known)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
