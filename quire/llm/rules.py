"""Quality rules with host-level verdicts.

Per document, in one pass over the bytes of the text, the counts of the rules are taken.  Failures are
then summed by host (``source``), each host's rate is shrunk with a beta prior whose two parameters are
fitted to the hosts' rates by the method of moments, and the verdict goes back to the host's documents.

Defined results: a null or empty text has no words and fails the base rules; a null host is a host of
its own, and so is any other value; repeated rows count as often as they occur; an empty table
gives an empty result; other columns pass by untouched, whatever their names, and columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import as_out, boxed, save, skew_join, text_of, unboxed
from quire.llm.textkernel import Words, blocks, mix, per_doc, slices_hash, windows

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of each text of a column."""
    out: dict[str, list[np.ndarray]] = {k.split()[0]: [] for k in COUNTS.split(", ")}
    for block in blocks(column):
        words = Words(block, lower=False)
        heads = np.concatenate(([0], np.cumsum((words.buf & 0xC0) != 0x80)))
        out["n_words"].append(np.diff(words.bounds))
        out["word_chars"].append(per_doc(heads[words.end] - heads[words.start], words.bounds))
        signs = np.concatenate(([0], np.cumsum(_SYMBOL[words.buf])))
        out["n_symbols"].append(signs[block.end] - signs[block.begin])
        out["n_dup_lines"].append(_repeated_lines(block, words))
        out["n_repeat_words"].append(_repeated_words(words))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def _repeated_lines(block, words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the document."""
    breaks = np.flatnonzero(block.buf[: block.size] == 0x0A)
    start = np.sort(np.concatenate((block.begin, breaks + 1)))
    end = np.append(start[1:] - 1, block.size - 1)
    doc = np.searchsorted(block.begin, start, "right") - 1
    end = np.minimum(end, block.end[doc])
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[has], end[has], doc[has]
    key = mix(slices_hash(block.buf, start, end) ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), np.int64)
    again[first] = 0
    return np.bincount(doc, again, block.n).astype(np.int64)


def _repeated_words(words: Words) -> np.ndarray:
    """Words in windows of three that occur twice or more in the document."""
    at, h = windows(words, 3)
    hit = np.zeros(len(words), bool)
    if len(at):
        key = h ^ mix(words.doc[at].astype(np.uint64) + np.uint64(7))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for i in range(3):
            hit[at[twice] + i] = True
    return per_doc(hit, words.bounds)


def beta_prior(x: float, n: float, k: int, sq: float, nn: float) -> tuple[float, float]:
    """A beta prior from k hosts with x failures in n documents: the mean of all documents, and as weight
    what the variance between hosts leaves (sq: sum of x*x/n by host, nn: sum of n*n)."""
    if not n:
        return 0.5, 0.5
    mean = min(max(x / n, 1e-6), 1 - 1e-6)
    within = mean * (1 - mean)
    between = sq - n * mean**2 - (k - 1) * within
    rho = min(max(between / max(n - nn / n - (k - 1), 1e-9) / within, 1e-4), 0.999)
    return mean * (1 / rho - 1), (1 - mean) * (1 / rho - 1)


def host_rules(docs: DataFrame, host: str = "source", min_words: int = 50, max_repeat_pct: int = 50, max_symbol_pct: int = 10, host_limit: float = 0.6) -> DataFrame:
    """``docs`` without its text, with the counts, the rule failures, the host's shrunk rate and ``kept``.

    A document fails when it has fewer than ``min_words`` words or more than ``max_repeat_pct`` per
    cent repeated words (``base_failed``), or when symbols make up more than ``max_symbol_pct``
    per cent of its word characters.  ``host_rate`` is (failed + a) / (documents + a + b).  A host
    whose rate is above ``host_limit`` loses all its documents; of the others only those that fail
    the base rules go.
    """
    names = [k.split()[0] for k in COUNTS.split(", ")]
    mine = (*names, "text", "base_failed", "rule_failed", "host_rate", "kept")
    key = F.coalesce(F.concat(F.lit("h"), F.col(f"`{host}`").cast("string")), F.lit("n"))
    given = docs.select(boxed(docs, *mine), key.alias("host_key"), text_of(docs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = text_counts(b.column("t"))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("host_key"), *(pa.array(c[k], pa.int64()) for k in c)], ["row", "host_key", *c])

    counted = given.mapInArrow(count, as_out(given, COUNTS))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    # the text is read once; the slim table feeds both the sums by host and the verdicts
    judged = counted.withColumns({"base_failed": base, "rule_failed": base | (100 * F.col("n_symbols") > max_symbol_pct * F.col("word_chars"))})
    judged = save(judged, "rules")
    # one row per host; partial sums leave each task, so a host with a third of the rows is no heavier
    hosts = judged.groupBy("host_key").agg(F.count("*").alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("x"))
    hosts = save(hosts, "hosts")
    m = hosts.agg(
        F.sum("x").alias("x"), F.sum("n").alias("n"), F.count("*").alias("k"),
        F.sum(F.col("x") * F.col("x") / F.col("n")).alias("sq"), F.sum(F.col("n").cast("double") ** 2).alias("nn"),
    ).first()
    a, b = beta_prior(m["x"] or 0, m["n"] or 0, m["k"], m["sq"] or 0.0, m["nn"] or 0.0)
    rates = hosts.select("host_key", ((F.col("x") + a) / (F.col("n") + a + b)).alias("host_rate"), F.col("n").alias("c"))
    out = skew_join(judged, rates, "host_key")
    kept = ~F.col("base_failed") & (F.col("host_rate") <= host_limit)
    return out.select(*unboxed(docs, *mine), *names, "base_failed", "rule_failed", "host_rate", kept.alias("kept"))
