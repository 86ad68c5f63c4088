"""Quality classifier learned from trusted positives and unlabelled text.

The non-negative risk  prior * E+[loss(z)] + max(0, E[loss(-z)] - prior * E+[loss(-z)])  is minimised over all rows: E+ is
the mean over trusted positives, E the mean over unlabelled web text, the loss is logistic and z is linear in features of
a text's shape. Its minimum makes 1 / (1 + exp(-z)) the probability that a text of the web is good, so scores need no
further calibration. Every step sums gradient and curvature over all rows in Spark; the driver solves a small system.
The best of a bounded number of steps is taken. It lowers the risk but need not reach its minimum, above all on few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattaudit.llm.base import slices, stored, texts

#: Rows and bytes of texts that are held at a time.
ROWS, BYTES = 1000, 4 << 20
#: Most steps of the search and the gain below which it ends.
STEPS, GAIN = 25, 1e-6
#: The ridge on standardised weights is the first plus the second divided by the number of positives: few say little.
RIDGE, RIDGE_ROWS = 0.02, 40
#: The part of the risk that must not be negative may fall this far below zero before it is corrected.
SLACK = 0.0

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"|<>{}[]\\/=_~^`", b"#$%&*@+", b".", b",;:", b"\n", b" \t", b"'\"()-"]
_RATIOS = 22
#: Ratios come as they are and squeezed by these constants, so that traces of junk and plenty of it both tell.
_SQUEEZE = (0.01, 0.1)
N_FEATURES = _RATIOS * (1 + len(_SQUEEZE)) + 3

_class_of = np.full(256, len(_CLASSES), np.int64)
for _i, _chars in enumerate(_CLASSES):
    _class_of[list(_chars)] = _i
_class_of[128:] = len(_CLASSES) + 1


def features(text: bytes | None) -> np.ndarray:
    """Features of the shape of a whole text; null counts as empty. Any length gives the same few numbers."""
    text = text or b""
    size = max(len(text), 1)
    shares = np.bincount(_class_of, np.bincount(np.frombuffer(text, np.uint8), minlength=256), len(_CLASSES) + 2) / size
    found = text.split()
    n = max(len(found), 1)
    lines = text.split(b"\n")
    lower = text.lower().split()
    upper = sum(w.isupper() for w in found)
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:" for w in found)
    stops = sum(w[-1:] in b".!?" for w in found)
    short = sum(len(w) == 1 for w in found)
    ratios = np.array([
        *shares,  # 12 classes of characters
        1 - len(set(lower)) / n,
        sum(map(eq, lower, lower[1:])) / n,
        sum(map(eq, lower, lower[2:])) / n,
        1 - len(set(lines)) / len(lines),
        upper / n,
        marked / n,
        stops / n,
        short / n,
        len(lines) / (n + 1),
        min(1.0, max(map(len, found), default=0) / 100),
    ])
    squeezed = [ratios / (ratios + c) for c in _SQUEEZE]
    return np.concatenate([ratios, *squeezed, [np.log1p(len(found)) / 10, min(1.0, len(text) / n / 20), float(not found)]])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the constant
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    good = batch.column(0).to_numpy(zero_copy_only=False)
    return good, batch.column(1).flatten().to_numpy().reshape(len(good), N_FEATURES).astype(np.float64)


def _summed(table: DataFrame, step: object) -> np.ndarray:
    """Sum over all batches of the vectors that ``step(good, x)`` gives; Spark adds them up entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = step(*_rows(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    found = table.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v")).collect()
    out = np.zeros(len(found))
    for i, v in found:
        out[i] = v
    return out


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), both already without held-out rows.

    Positives are the documents labelled 1, the unlabelled set is every document, whatever its label. The class prior
    is the share of 1 among the labels. Labels are read once per doc_id (the smallest, if they differ); null labels and
    labels without document count nothing. Without positives or documents every text gets the prior as score.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total, ones = known.agg(F.count("*"), F.sum((F.col("quality") == 1).cast("long"))).first()
    prior = min(0.99, max(0.01, ones / total)) if total else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ROWS, BYTES):
                x = np.array([features(t) for t in texts(batch, 1)], np.float32).reshape(-1, N_FEATURES)
                values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "x"])

    shaped = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<float>")
    shaped = stored(shaped, "shapes")
    positive = known.where("quality = 1").select("doc_id", F.lit(True).alias("good"))
    table = stored(shaped.join(positive, "doc_id", "left").select(F.coalesce("good", F.lit(False)).alias("good"), "x"), "features")
    n = N_FEATURES
    sums = _summed(table, lambda good, x: np.concatenate([[len(good), good.sum()], x.sum(0), (x * x).sum(0)]))
    if not len(sums) or not sums[1]:
        return Model(np.zeros(n), np.ones(n), np.append(np.zeros(n), np.log(prior / (1 - prior))), prior)
    count, goods = sums[:2]
    mean = sums[2 : n + 2] / count
    scale = np.sqrt(np.maximum(sums[n + 2 :] / count - mean**2, 0))
    scale[scale < 1e-6] = 1.0
    weights = np.append(np.zeros(n), np.log(prior / (1 - prior)))
    best, least, strength = weights, np.inf, RIDGE + RIDGE_ROWS / goods
    for _ in range(STEPS):

        def step(good: np.ndarray, x: np.ndarray, w: np.ndarray = weights) -> np.ndarray:
            x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
            z = np.clip(x @ w, -500, 500)
            p = 1 / (1 + np.exp(-z))
            plus, minus = np.logaddexp(0, -z), np.logaddexp(0, z)
            curve = (x * (p * (1 - p))[:, None]).T @ x
            return np.concatenate([
                [plus[good].sum(), minus[good].sum(), minus.sum()], ((p - 1)[good, None] * x[good]).sum(0),
                (p[good, None] * x[good]).sum(0), (p[:, None] * x).sum(0), curve.reshape(-1),
            ])

        s = _summed(table, step)
        g = s[3:].reshape(-1, n + 1)
        from_plus, from_minus, from_all, curve = prior * g[0] / goods, prior * g[1] / goods, g[2] / count, g[3:] / count
        negative = s[2] / count - prior * s[1] / goods
        ridge = strength * np.append(weights[:-1], 0)
        risk = prior * s[0] / goods + max(0.0, negative) + strength / 2 * (weights[:-1] ** 2).sum()
        if risk < least:
            gain, best, least = least - risk, weights, risk
            if gain < GAIN:
                break
        # Where the estimated risk on negatives is below zero, step back along it; otherwise follow the whole risk.
        slope = from_plus + from_all - from_minus if negative >= -SLACK else from_minus - from_all
        move = np.linalg.solve(curve + strength * np.eye(n + 1), slope + ridge)
        weights = weights - move * min(1.0, 4 / max(1e-12, np.abs(move).max()))
    return Model(mean, scale, best, prior)


def predict(docs: DataFrame, model: Model, threshold: float = 0.7, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, of the whole text; null counts as empty) and ``predicted`` (1 if score >= threshold).

    Other columns stay; these two are replaced. Equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.drop(score, predicted)
    at = given.columns.index("text")
    schema = given.withColumn(score, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ROWS, BYTES):
                x = np.array([features(t) for t in texts(batch, at)]).reshape(-1, N_FEATURES)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(x))], schema.fieldNames())

    return given.mapInArrow(run, schema).withColumn(predicted, (F.col(score) >= threshold).cast("int"))
