"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Words enter as the sum of a word vector (for words of the training vocabulary, by exact 64-bit hash) and the
mean vector of their character trigrams (hashed).  Windows of ``SPAN`` words, ``STEP`` apart, so that each word
but those at the ends lies in two, are read in both directions by gated recurrent units; attention over the
states gives a window's logit.  A document's score is that of its worst window, calibrated on training rows.

Training takes at most ``per_class`` labelled rows of either label (2 * 800).  Labels belong to documents, so
each round scores all windows of these documents and learns from the worst of each.

Defined results: a null or empty text has one empty window; repeated rows are scored alike; without labels of
both kinds every score is the known share; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import as_out, boxed, fold, text_of, unboxed
from quire.llm.textkernel import ALNUM, Words, blocks
from quire.llm.training import Adam, labelled_sample, platt, sigmoid

SPAN, STEP = 32, 16
H, E, CHAR_BITS, TOGETHER = 8, 8, 13, 4096


def _trigrams(w: Words, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the words ``one``, their separators included, and the words' bounds."""
    size = w.end[one] - w.start[one]
    bounds = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(bounds[-1]) + np.repeat(w.start[one] - 1 - bounds[:-1], size)
    b = np.where(ALNUM[w.buf], w.buf, 0x20).astype(np.uint32)
    h = b[at] * np.uint32(0x9E3779B1) + b[at + 1] * np.uint32(0x85EBCA6B) + b[at + 2] * np.uint32(0xC2B2AE35)
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - CHAR_BITS)).astype(np.int64), bounds


class Inputs:
    """The distinct words of a block, with each word's place among them, and its windows."""

    def __init__(self, w: Words):
        self.kinds, first, self.word = np.unique(w.hash, return_index=True, return_inverse=True)
        self.grams, self.gram_bounds = _trigrams(w, first)
        n = np.diff(w.bounds)
        count = np.maximum(1, -(-(n - (SPAN - STEP)) // STEP))
        self.doc = np.repeat(np.arange(len(n)), count)
        self.window_bounds = np.concatenate(([0], np.cumsum(count)))
        k = np.arange(len(self.doc)) - np.repeat(self.window_bounds[:-1], count)
        self.start = w.bounds[:-1][self.doc] + STEP * k
        self.size = np.clip(w.bounds[1:][self.doc] - self.start, 0, SPAN)


class Net:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *s, x=0.3: r.normal(0, x, s).astype(np.float32)
        self.vocab = np.zeros(0, np.uint64)
        self.p = {"word": np.zeros((1, E), np.float32), "char": f(1 << CHAR_BITS, E, x=0.05), "att": f(2 * H), "out": f(2 * H), "bias": np.full(1, -1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": f(E, 3 * H), f"h{d}": f(H, 3 * H), f"c{d}": np.zeros(3 * H, np.float32)}
        self.slope, self.shift = 1.0, 0.0

    def known(self, kinds: np.ndarray) -> np.ndarray:
        """Rows of the word table; the last row, always zero, is for unknown words."""
        if not len(self.vocab):
            return np.zeros(len(kinds), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, kinds), len(self.vocab) - 1)
        return np.where(self.vocab[at] == kinds, at, len(self.vocab))

    def vectors(self, x: Inputs) -> np.ndarray:
        v = self.p["word"][self.known(x.kinds)]
        if len(v):
            v = v + np.add.reduceat(self.p["char"][x.grams], x.gram_bounds[:-1], 0) / np.diff(x.gram_bounds)[:, None].astype(np.float32)
        return np.concatenate((v, np.zeros((1, E), np.float32)))

    def read(self, word: np.ndarray, inputs: dict[str, np.ndarray], keep: bool = False) -> tuple:
        """Logits of windows of word places (windows x SPAN, -1 after the end)."""
        live = (word >= 0).astype(np.float32)
        states, trace = np.empty((SPAN, len(word), 2 * H), np.float32), {}
        for d, part in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            h = np.zeros((len(word), H), np.float32)
            for t in range(SPAN) if d == "f" else reversed(range(SPAN)):
                x, g = inputs[d][word[:, t]], h @ self.p[f"h{d}"]
                zr = 1 / (1 + np.exp(-(x[:, : 2 * H] + g[:, : 2 * H])))
                z, q = zr[:, :H], zr[:, H:]
                n = np.tanh(x[:, 2 * H :] + q * g[:, 2 * H :])
                new = (n + z * (h - n)) * live[:, t : t + 1]
                if keep:
                    trace[d, t] = (h, z, q, n, g[:, 2 * H :])
                states[t, :, part] = h = new
        e = states @ self.p["att"]
        e = np.exp(np.clip(e, -20, 20)) * live.T
        a = e / np.maximum(e.sum(0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", a, states)
        return pooled @ self.p["out"] + self.p["bias"], states, a, pooled, live, trace

    def places(self, x: Inputs, at: np.ndarray) -> np.ndarray:
        k = np.arange(SPAN)
        inside = k < x.size[at][:, None]
        return np.where(inside, x.word[np.minimum(x.start[at][:, None] + k, len(x.word) - 1)] if len(x.word) else -1, -1)

    def project(self, v: np.ndarray) -> dict[str, np.ndarray]:
        return {d: v @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"}

    def logits(self, x: Inputs) -> np.ndarray:
        inputs = self.project(self.vectors(x))
        return np.concatenate([self.read(self.places(x, at), inputs)[0] for at in np.array_split(np.arange(len(x.doc)), max(1, len(x.doc) // TOGETHER))])

    def gradient(self, x: Inputs, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        word, v = self.places(x, at), self.vectors(x)
        inputs = self.project(v)
        logit, states, a, pooled, live, trace = self.read(word, inputs, keep=True)
        p = sigmoid(logit)
        dl = (weight * (p - y) / weight.sum()).astype(np.float32)
        g = {"out": pooled.T @ dl, "bias": np.array([dl.sum()], np.float32)}
        dpool = dl[:, None] * self.p["out"]
        ds = a[:, :, None] * dpool
        da = np.einsum("tbh,bh->tb", states, dpool)
        de = a * (da - (a * da).sum(0))
        g["att"] = np.einsum("tb,tbh->h", de, states)
        ds = ds + de[:, :, None] * self.p["att"]
        dv = np.zeros_like(v)
        for d, part in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            dh, gx, gh = np.zeros((len(word), H), np.float32), np.zeros_like(inputs[d]), np.zeros_like(self.p[f"h{d}"])
            for t in reversed(range(SPAN)) if d == "f" else range(SPAN):
                h, z, q, n, gn = trace[d, t]
                dn_ = (dh + ds[t][:, part]) * live[:, t : t + 1]
                dz = dn_ * (h - n) * z * (1 - z)
                dn = dn_ * (1 - z) * (1 - n * n)
                dq = dn * gn * q * (1 - q)
                pre = np.concatenate((dz, dq, dn * q), 1)
                gh += h.T @ pre
                np.add.at(gx, word[:, t], np.concatenate((dz, dq, dn), 1))
                dh = dn_ * z + pre @ self.p[f"h{d}"].T
            gx[-1] = 0
            g[f"h{d}"], g[f"x{d}"], g[f"c{d}"] = gh, v.T @ gx, gx.sum(0)
            dv += gx @ self.p[f"x{d}"].T
        g["word"] = np.zeros_like(self.p["word"])
        np.add.at(g["word"], self.known(x.kinds), dv[:-1])
        g["word"][-1] = 0
        used = np.flatnonzero(np.abs(dv[:-1]).sum(1))
        size = np.diff(x.gram_bounds)
        g["char"] = np.zeros_like(self.p["char"])
        for i in used:
            np.add.at(g["char"], x.grams[x.gram_bounds[i] : x.gram_bounds[i + 1]], dv[i] / size[i])
        return g, float(-(weight * np.where(y == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum() / weight.sum())

    def fit(self, sample: pa.Table, share: float, epochs: int) -> Net:
        y = np.array(sample["y"].to_pylist(), np.float32)
        if len(np.unique(y)) < 2:
            share = min(max(share, 1e-6), 1 - 1e-6)
            self.slope, self.shift = 0.0, float(np.log(share / (1 - share)))
            return self
        parts, words = [], []
        for block in blocks(sample["text"].combine_chunks(), 1 << 18):
            w = Words(block, kind=ALNUM)
            parts.append((block.first, Inputs(w)))
            words += [np.unique(w.hash[w.bounds[i] : w.bounds[i + 1]]) for i in range(block.n)]
        held = np.random.default_rng(1).permutation(len(y)) % 5 == 0
        self._start(words, y, ~held)
        r, adam = np.random.default_rng(2), Adam(self.p, 0.02, 1e-4)
        n1, n0 = (y[~held] == 1).sum(), (y[~held] == 0).sum()
        weight = np.where(y == 1, 0.5 / max(n1, 1), 0.5 / max(n0, 1)).astype(np.float32)
        for _ in range(epochs):
            for i in r.permutation(len(parts)):
                first, x = parts[i]
                worst = self._worst(x)
                use = ~held[first : first + len(worst)]
                for at in np.array_split(worst[use], max(1, use.sum() // 64)):
                    if len(at):
                        d = x.doc[at] + first
                        adam.step(self.gradient(x, at, y[d], weight[d])[0])
        raw = np.concatenate([np.maximum.reduceat(self.logits(x), x.window_bounds[:-1]) for _, x in parts])
        use = held if len(np.unique(y[held])) > 1 and held.sum() > 100 else np.ones(len(y), bool)
        self.slope, self.shift = platt(raw[use].astype(float), y[use], share)
        return self

    def _worst(self, x: Inputs) -> np.ndarray:
        """Each document's window of the highest logit, the first of equals."""
        logit = self.logits(x)
        best = np.maximum.reduceat(logit, x.window_bounds[:-1])
        hit = np.flatnonzero(logit == best[x.doc])
        return hit[np.unique(x.doc[hit], return_index=True)[1]]

    def _start(self, words: list[np.ndarray], y: np.ndarray, use: np.ndarray) -> None:
        """Word vectors start from the words' shrunk log odds between the labels."""
        kinds, place = np.unique(np.concatenate([w for w, u in zip(words, use, strict=True) if u]), return_inverse=True)
        label = np.repeat(y[use], [len(w) for w, u in zip(words, use, strict=True) if u])
        one, all_ = np.bincount(place, label, len(kinds)), np.bincount(place, minlength=len(kinds))
        n1, n = y[use].sum(), use.sum()
        odds = np.log((one + 0.5) / (n1 + 1)) - np.log((all_ - one + 0.5) / (n - n1 + 1))
        keep = all_ >= 3
        self.vocab = kinds[keep]
        table = np.random.default_rng(4).normal(0, 0.05, (keep.sum() + 1, E)).astype(np.float32)
        table[:-1, 0] += (odds * all_ / (all_ + 4))[keep]
        table[-1] = 0
        self.p["word"] = table

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, windows, and the first word of the worst window of each text."""
        out = []
        for block in blocks(texts):
            w = Words(block, kind=ALNUM)
            x = Inputs(w)
            logit = self.logits(x).astype(float)
            best = np.maximum.reduceat(logit, x.window_bounds[:-1])
            hit = np.flatnonzero(logit == best[x.doc])
            worst = hit[np.unique(x.doc[hit], return_index=True)[1]]
            out.append((sigmoid(self.slope * best + self.shift), np.diff(x.window_bounds), x.start[worst] - w.bounds[:-1]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0), np.zeros(0, int), np.zeros(0, int))


def usable(doc_id):
    """Rows to learn from: those whose crc32 modulo 4 is not 2."""
    return fold(doc_id, 4) != 2


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 800, epochs: int = 6) -> Net:
    sample, share = labelled_sample(docs, labels, label, usable, per_class)
    return Net().fit(sample, share, epochs)


def score_toxicity(docs: DataFrame, model: Net, threshold: float = 0.3) -> DataFrame:
    """``docs`` without text, with ``score``, ``n_windows``, ``worst_start`` (words) and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary of a bounded sample
    mine = ("text", "score", "n_windows", "worst_start", "predicted")
    given = docs.select(boxed(docs, *mine), text_of(docs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, n, at = sent.value.score(b.column("t"))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(s, pa.float64()), pa.array(n, pa.int32()), pa.array(at, pa.int32())], ["row", *mine[1:4]])

    scored = given.mapInArrow(score, as_out(given, "score double, n_windows int, worst_start int"))
    return scored.select(*unboxed(docs, *mine), *mine[1:4], (F.col("score") >= threshold).cast("int").alias("predicted"))
