"""Bounded labelled samples, and small numeric helpers of the trained operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The most characters of a text in the sample.
MOST = 200_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, per_class: int, extra=None) -> tuple[pa.Table, float]:
    """At most ``per_class`` rows of either label whose id fulfils ``usable``, by order of a hash of the id, and the
    share of label 1 among all of these rows.  Only the sample's texts come to the driver, whole;
    a text of more than ``MOST`` characters is not learnt from, so the sample has a bound in bytes.  Scoring reads all."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where(usable(F.col("doc_id")))
    share = known.agg(F.avg("y")).first()[0]
    order = F.xxhash64("doc_id", F.lit(17))
    picked = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    # at most 2 * per_class ids: the broadcast has that bound
    ids = picked[0].union(picked[1])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.where(F.length(text) <= MOST).select("doc_id", F.struct(text.alias("text"), (F.lit(0.0) if extra is None else extra).alias("extra")).alias("own")).join(F.broadcast(ids), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min("own").alias("own"), F.first("y").alias("y")).orderBy("doc_id")
    return one.select("doc_id", "own.text", "own.extra", "y").toArrow(), 0.5 if share is None else float(share)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Adam on a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.p, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-7) + self.rate * self.decay * self.p[k]


def platt(raw: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of a logistic fit of labels to raw scores, with classes weighed to ``share`` of label 1."""
    if len(np.unique(y)) < 2:
        return 1.0, 0.0
    share = min(max(share, 1e-3), 1 - 1e-3)
    w = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = sigmoid(a * raw + b)
        g = np.array([(w * (p - y) * raw).sum() + 1e-3 * (a - 1), (w * (p - y)).sum() + 1e-3 * b])
        s = w * p * (1 - p)
        h = np.array([[(s * raw * raw).sum() + 1e-3, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        step = min(1.0, 3.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
    return float(max(a, 1e-3)), float(b)
