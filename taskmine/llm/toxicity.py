"""Toxicity of texts: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of 3 to 5 code points of the lower-cased text, hashed
into 2**18 columns. Training rows are a bounded sample, at most ``MAX_LABELS`` of each
class. The workers count in how many toxic and in how many other texts of it each feature
stands; the log of the ratio of the smoothed rates scales the feature. A logistic
regression on the scaled, length-normalised rows is fitted on at most ``max_rows`` of each
class, the least by a hash of the row.

Null and empty texts have no features and get the score of the intercept. Repeated rows
count as often as they stand there. With one class only, or no training row, the scores
come from the smoothed share of toxic rows. Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from taskmine.sources.stages import staged

BITS, SIZES, MAX_ROWS = 18, (3, 4, 5), 1500
MAX_LABELS = 8000  # labelled rows of each class that a classifier is trained on
MIN_TEXTS, MIN_RATIO = 5, 0.5  # of a feature that counts
_FACTOR = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)


def features(text: str | None) -> np.ndarray:
    """Hashed n-grams of a text, with repetitions."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    out, h = [], points * _FACTOR
    for k in range(1, SIZES[-1]):
        if len(points) <= k:
            break
        h = (h[:-1] ^ points[k:]) * _FACTOR
        if k + 1 in SIZES:
            out.append((h * _SPREAD) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class Model:
    """Squared scales and weights (scale times coefficient) of the features, and the intercept.

    A text is the vector of its scaled features, brought to length 1.
    """

    squares: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        seen = np.zeros(1 << BITS, bool)
        margin = np.empty(len(texts))
        for i, text in enumerate(texts):
            own = features(text)
            seen[own] = True
            own = np.flatnonzero(seen) if len(own) > 20_000 else np.unique(own)
            seen[own] = False
            length = np.sqrt(self.squares[own].sum())
            margin[i] = self.intercept + (self.weights[own].sum() / length if length > 0 else 0.0)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _distinct(texts: list[str | None]):
    return [np.unique(features(text)) for text in texts]


def _class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of each class there are, and in how many each feature stands; a fixed-size vector per class."""
    def run(batches):
        counts, total = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for own, label in zip(_distinct(batch.column(0).to_pylist()), batch.column(1).to_pylist()):
                counts[label, own] += 1
                total[label] += 1
        for label in (0, 1):
            at = np.flatnonzero(counts[label])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at) + 1, label, np.int32)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[label][at], total[label]))],
                names=["label", "feature", "n"])

    summed = rows.mapInArrow(run, "label int, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n"))
    counts, total = np.zeros((2, 1 << BITS)), np.zeros(2)
    for label, feature, n in summed.toLocalIterator():  # at most 2**18 features of each class
        if feature < 0:
            total[label] = n
        else:
            counts[label, feature] = n
    return total, counts


def _fitted(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, penalty: float, rate: float, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression with balanced classes on the scaled, normalised rows, by gradient steps with momentum."""
    used, flat = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    own = scale[used]
    value = own[flat]
    value /= np.sqrt(np.maximum(np.bincount(row, value ** 2, len(rows)), 1e-12))[row]
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    w, b, speed, shift = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    for _ in range(steps):
        margin = np.bincount(row, w[flat] * value, len(rows)) + b
        error = share * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels)
        speed = 0.9 * speed - rate * (np.bincount(flat, error[row] * value, len(used)) + penalty * w)
        shift = 0.9 * shift - 0.1 * rate * error.sum()
        w, b = w + speed, b + shift
    return used, w * own, b


def sample_of(labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic", max_labels: int = MAX_LABELS) -> DataFrame:
    """At most ``max_labels`` rows (doc_id, label) of each class, the least by a hash of the id: small enough to broadcast. Runs a job when called."""
    rows = labels.select(doc_id, label)
    parts = [rows.where(F.col(label) == value).orderBy(F.xxhash64(doc_id), doc_id).limit(max_labels) for value in (0, 1)]
    return staged(parts[0].unionByName(parts[1]), "toxicity-sample")


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, penalty: float = 1e-6, rate: float = 8, steps: int = 300) -> Model:
    """Fit on rows of text and label (0 or 1; others are left out). Runs jobs when called; the labelled texts are written once as a stage table."""
    mark = F.xxhash64(*labelled.columns)
    rows = staged(labelled.where(F.col(label).isin(0, 1)).select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("label"), mark.alias("mark")), "toxicity-labelled")
    total, counts = _class_counts(rows)
    prior = float(np.log((total[1] + 0.5) / (total[0] + 0.5)))
    if not total.all():
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), prior)
    share = (counts + 1) / (total[:, None] + 2)
    ratio = np.log(share[1] / share[0])
    ratio[(counts.sum(0) < MIN_TEXTS) | (np.abs(ratio) < MIN_RATIO)] = 0  # too rare or too even to tell

    def hashed(batches):
        for batch in batches:
            own = _distinct(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([x[ratio[x] != 0].astype(np.int32) for x in own], pa.list_(pa.int32())), batch.column(1)],
                                             names=["features", "label"])

    sample, labels = [], []
    schema = StructType([StructField("features", ArrayType(IntegerType())), StructField("label", IntegerType())])
    for value in (0, 1):
        own_class = rows.where(F.col("label") == value)
        bound = own_class.select("mark").orderBy("mark").limit(max_rows).agg(F.max("mark")).first()[0]
        few = own_class.where(F.col("mark") <= bound).limit(max_rows)
        for own, _ in few.select("text", "label").mapInArrow(hashed, schema).toLocalIterator():
            sample.append(np.array(own, np.int32))
            labels.append(value)
    used, weights, b = _fitted(sample, np.array(labels), ratio, penalty, rate, steps)
    out = np.zeros(1 << BITS)
    out[used] = weights
    return Model(ratio ** 2, out, b)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 weights
    kept = [f for f in docs.schema.fields if f.name != "score"]

    def run(batches):
        for batch in batches:
            scores = shared.value.scores(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [pa.array(scores)],
                                             names=[f.name for f in kept] + ["score"])

    return docs.mapInArrow(run, StructType(kept + [StructField("score", DoubleType())]))
