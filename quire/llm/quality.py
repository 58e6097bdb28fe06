"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The raw score is w0 + sum(w_i x_i) + sum over pairs <v_i, v_j> x_i x_j.  The pair term is taken as half of
(square of sums - sum of squares) in each of ``rank`` factors, so a document costs time linear in its words.
Words are hashed into ``2**bits`` rows and carry 1/sqrt(n) each; the dense part holds structure statistics
of the text and, as metadata, the table's own ``n_chars`` where there is one.

The model is trained in numpy on the driver on at most ``per_class`` labelled rows of either label (2 * 1,500),
and calibrated to the share of label 1 among all usable labels.

Defined results: a null text is scored as an empty one; repeated rows are scored alike; without labels of both
kinds every score is the known share; columns called score or predicted in the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.rules import _repeated_lines, _repeated_words
from quire.llm.shared import as_out, boxed, fold, text_of, unboxed
from quire.llm.textkernel import Block, Words, blocks, per_doc
from quire.llm.training import Adam, labelled_sample, platt, sigmoid

_CLASS = np.zeros(256, np.int64)  # 0: white space
_CLASS[0x21:0x7F] = 5  # punctuation
_CLASS[0x80:0xC0] = 7  # bytes within a character
_CLASS[0xC0:] = 6  # first byte of a character beyond ASCII
_CLASS[0x30:0x3A] = 3
_CLASS[0x41:0x5B] = 1
_CLASS[0x61:0x7B] = 2
_CLASS[[ord(c) for c in "#*$%&<>"]] = 4
_CLASS[ord("|")] = 8
_CLASS[ord("!")] = 9
_CLASS[[ord("."), ord(",")]] = 10
_CLASS[0x0A] = 11
KINDS, DENSE = 12, 20


def structure(block: Block, words: Words, n_chars: np.ndarray) -> np.ndarray:
    """Dense features of a block's documents; ``words`` keep their case."""
    size = np.maximum(block.end - block.begin, 0)
    where = np.repeat(np.arange(block.n), size + 1)
    body = block.buf[1 : block.size]
    count = np.bincount(where * KINDS + _CLASS[body], minlength=block.n * KINDS).reshape(block.n, KINDS).astype(float)
    n = np.diff(words.bounds).astype(float)
    chars = np.maximum(count[:, 1:].sum(1), 1)
    letters = np.maximum(count[:, 1] + count[:, 2], 1)
    some = np.maximum(n, 1)
    lines = count[:, 11] + 1
    cols = [np.log1p(n), chars / some / 10, count[:, 1] / letters, *(count[:, k] / chars for k in (2, 3, 4, 5, 6, 7)), *(np.minimum(count[:, k] / some, 2) for k in (4, 8, 9, 10))]
    cols += [np.log1p(some / lines), _repeated_words(words) / some, _repeated_lines(block, words) / lines]
    same = np.zeros(len(words), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    cols.append(per_doc(same, words.bounds) / some)
    cols += [np.log1p(np.maximum(n_chars, 0)), (n < 20).astype(float), (n == 0).astype(float)]
    return np.stack(cols, 1)


def features(texts: pa.Array, n_chars: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By block: hashed words, their bounds by document, dense features."""
    for block in blocks(texts):
        words = Words(block, lower=False)
        yield (words.hash >> np.uint64(64 - bits)).astype(np.int64), words.bounds, structure(block, words, n_chars[block.first : block.first + block.n])


class Machine:
    def __init__(self, bits: int = 16, rank: int = 4, seed: int = 5):
        r = np.random.default_rng(seed)
        self.bits, self.rank = bits, rank
        self.p = {
            "w": np.zeros((1 << bits, 1 + rank), np.float32),
            "d": np.zeros((DENSE, 1 + rank), np.float32),
            "w0": np.zeros(1, np.float32),
        }
        self.p["w"][:, 1:] = r.normal(0, 0.01, (1 << bits, rank))
        self.p["d"][:, 1:] = r.normal(0, 0.05, (DENSE, rank))
        self.mean, self.sd = np.zeros(DENSE), np.ones(DENSE)
        self.slope, self.shift = 1.0, 0.0

    def raw(self, ids: np.ndarray, bounds: np.ndarray, dense: np.ndarray) -> tuple:
        """Scores, with what the gradient needs."""
        x = np.clip((dense - self.mean) / self.sd, -4, 4).astype(np.float32)
        n = np.diff(bounds)
        unit = (1 / np.sqrt(np.maximum(n, 1))).astype(np.float32)
        rows = self.p["w"][ids]
        sums = np.zeros((len(n), 1 + self.rank), np.float32)
        squares = np.zeros((len(n), self.rank), np.float32)
        full = np.flatnonzero(n)
        if len(full):
            sums[full] = np.add.reduceat(rows, bounds[:-1][full], 0)
            squares[full] = np.add.reduceat(rows[:, 1:] ** 2, bounds[:-1][full], 0)
        sums *= unit[:, None]
        squares *= unit[:, None] ** 2
        total = sums + x @ self.p["d"]
        f = total[:, 1:]
        pairs = 0.5 * (f**2 - squares - (x**2) @ (self.p["d"][:, 1:] ** 2)).sum(1)
        return self.p["w0"] + total[:, 0] + pairs, rows, unit, x, f

    def fit(self, sample: pa.Table, share: float, epochs: int, n_chars: np.ndarray) -> Machine:
        y = np.array(sample["y"].to_pylist(), np.float32)
        parts = list(features(sample["text"].combine_chunks(), n_chars, self.bits))
        if len(np.unique(y)) < 2:
            self.slope, self.shift = 0.0, float(np.log(min(max(share, 1e-6), 1 - 1e-6) / (1 - min(max(share, 1e-6), 1 - 1e-6))))
            return self
        dense = np.concatenate([d for _, _, d in parts])
        self.mean, self.sd = dense.mean(0), np.maximum(dense.std(0), 1e-3)
        docs = [ids[b[i] : b[i + 1]] for ids, b, _ in parts for i in range(len(b) - 1)]
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        r, adam = np.random.default_rng(11), Adam(self.p, 0.02, 1e-3)
        out_of_fold = np.zeros(len(y))
        held = r.permutation(len(y)) % 5 == 0
        train = np.flatnonzero(~held)
        for _ in range(epochs):
            for at in np.array_split(r.permutation(train), max(1, len(train) // 128)):
                ids = np.concatenate([docs[i] for i in at])
                bounds = np.concatenate(([0], np.cumsum([len(docs[i]) for i in at])))
                raw, rows, unit, x, f = self.raw(ids, bounds, dense[at])
                g = (weight[at] * (sigmoid(raw) - y[at]) / len(at)).astype(np.float32)
                n = np.diff(bounds)
                gw = np.zeros_like(self.p["w"])
                each = np.repeat(g * unit, n)
                gw[:, 0] = np.bincount(ids, each, len(gw))
                of = np.repeat(f, n, 0) - rows[:, 1:] * np.repeat(unit, n)[:, None]
                for k in range(self.rank):
                    gw[:, 1 + k] = np.bincount(ids, each * of[:, k], len(gw))
                gd = np.empty_like(self.p["d"])
                gd[:, 0] = x.T @ g
                gd[:, 1:] = (x * g[:, None]).T @ f - ((x**2).T @ g)[:, None] * self.p["d"][:, 1:]
                adam.step({"w": gw, "d": gd, "w0": np.array([g.sum()], np.float32)})
        for i in np.array_split(np.arange(len(y)), max(1, len(y) // 256)):
            bounds = np.concatenate(([0], np.cumsum([len(docs[j]) for j in i])))
            out_of_fold[i] = self.raw(np.concatenate([docs[j] for j in i]), bounds, dense[i])[0]
        use = held if len(np.unique(y[held])) > 1 and held.sum() > 100 else np.ones(len(y), bool)
        self.slope, self.shift = platt(out_of_fold[use], y[use], share)
        return self

    def score(self, texts: pa.Array, n_chars: np.ndarray) -> np.ndarray:
        out = [sigmoid(self.slope * self.raw(*part)[0].astype(float) + self.shift) for part in features(texts, n_chars, self.bits)]
        return np.concatenate(out) if out else np.zeros(0)


def usable(doc_id):
    """Rows to learn from: those whose crc32 modulo 5 is not 0."""
    return fold(doc_id, 5) != 0


def _n_chars(docs: DataFrame):
    """The table's own n_chars, 0 where it is null or missing: the same number in training and in scoring."""
    return F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)) if "n_chars" in docs.columns else F.lit(0.0)


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, epochs: int = 8) -> Machine:
    sample, share = labelled_sample(docs, labels, label, usable, per_class, _n_chars(docs))
    return Machine().fit(sample, share, epochs, sample["extra"].to_numpy())


def score_quality(docs: DataFrame, model: Machine, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits * (1 + rank) numbers: 1.3 MB
    mine = ("score", "predicted")
    given = docs.select(boxed(docs, *mine), text_of(docs), _n_chars(docs).alias("n"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.score(b.column("t"), np.asarray(b.column("n")))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(s, pa.float64())], ["row", "score"])

    scored = given.mapInArrow(score, as_out(given.drop("n"), "score double"))
    return scored.select(*unboxed(docs, *mine), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Machine, threshold: float = 0.3) -> DataFrame:
    """The documents that the model accepts, with their own columns only, whatever their names."""
    scored = score_quality(docs.select(boxed(docs).alias("mine"), text_of(docs).alias("text"), _n_chars(docs).alias("n_chars")), model, threshold)
    return scored.where("predicted = 1").select(*(F.col(f"mine.c.`{c}`").alias(c) for c in docs.columns))
