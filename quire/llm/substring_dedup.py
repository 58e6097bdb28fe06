"""Substring dedup by sliding sentence spans.

A text is cut into sentences after ``. ! ? ; : ,`` or a line break (fine cuts, so that a shared passage that starts
inside a sentence has whole ones soon after its start).  From every sentence a span runs over the next sentences until it
has at least two of them and ``min_words`` words; its hash is taken over its lower-cased words.  Equal hashes
are joined over the whole corpus, the smallest (doc_id, text, place) of each is the first, and every sentence
that a non-first span covers is removed.

Sentences depend on stops and on what stands around a passage, so passages are met a second way that depends on their
words alone: of every ``START`` consecutive places the one with the smallest hash of the next ``RUN`` words is chosen, and
chosen runs are joined like spans.  Two places that share ``LEAST`` words share chosen runs that cover ``LEAST - RUN -
START + 2`` words of them without a gap; stretches of non-first runs that are as long are removed.  What may stay of a
passage that no sentence span covers is up to ``START - 1`` words at its start and ``RUN - 1`` at its end.  Here a
character of a script that is written without spaces is a word.

The shuffles carry a span's hash and place, not texts.  Spans that occur once leave after a partial count in each task;
a passage that a third of all documents hold is one row a task there, and in the join back the places of such passages stay
where they are (``skew_join``).

Defined results: a null or empty text has no sentences and comes back empty; rows equal in id and text are one document
and share its result; an empty table gives an empty result; other columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import as_out, boxed, save, skew_join, text_key, text_of, unboxed
from quire.llm.textkernel import PLAIN, U, Block, Words, blocks, lists, mix, run_hasher, slices_hash

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;:,\n"]] = True
#: A run of words has -1 as its last and its first word, counted in its document, as its first.
SPANS = "h long, doc_id long, tkey long, first int, last int"
RUN, START, LEAST = 16, 16, 50
#: First two bytes of characters of scripts without spaces: Thai to Tibetan, Myanmar, Khmer, Han and kana, full-width forms, rarer Han.
_DENSE = np.zeros(1 << 16, bool)
for _a, _b in ((0xE0B8, 0xE0BF), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE380, 0xE9BF), (0xEFBC, 0xEFBE), (0xF0A0, 0xF0B3)):
    _DENSE[_a : _b + 1] = True


class Sentences:
    """The sentences with a word of a block: words and bytes where they begin, document, bounds by document."""

    def __init__(self, block: Block):
        self.words = w = Words(block)
        ends = w.end - 1
        # a word closes a sentence when its last byte is a stop or a line break comes before the next word
        breaks = np.concatenate(([0], np.cumsum(block.buf[: block.size] == 0x0A)))
        nxt = np.append(w.start[1:], block.size)[: len(w)]
        close = _STOP[w.buf[ends]] | (breaks[nxt] > breaks[w.end])
        last = np.zeros(len(w), bool)
        last[w.bounds[1:][np.diff(w.bounds) > 0] - 1] = True
        stop = np.flatnonzero(close | last)
        self.first_word = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else stop
        self.last_word = stop
        self.doc = w.doc[stop]
        self.bounds = np.searchsorted(self.doc, np.arange(block.n + 1))


class Tokens:
    """The words of a block, cut further at characters of scripts without spaces; as ``Words``."""

    def __init__(self, w: Words):
        buf, size = w.buf, w.block.size
        at = np.flatnonzero(buf[:size] >= 0xE0)
        at = at[_DENSE[(buf[at].astype(np.int32) << 8) | buf[at + 1]]]
        self.start, self.end, self.bounds, self.hash = w.start, w.end, w.bounds, w.hash
        if len(at):
            cut = np.zeros(size + 8, bool)
            cut[at] = True
            cut[at + np.where(buf[at] >= 0xF0, 4, 3)] = True
            inside = np.flatnonzero(cut[1:size] & PLAIN[buf[: size - 1]] & PLAIN[buf[1:size]]) + 1
            self.start, self.end = np.sort(np.concatenate((w.start, inside))), np.sort(np.concatenate((w.end, inside)))
            self.bounds = np.searchsorted(self.start, np.append(w.block.begin, size))
            self.hash = slices_hash(buf, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def chosen_runs(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and first word (in its document) of the chosen runs."""
    n = np.maximum(np.diff(t.bounds) - RUN + 1, 0)
    n[n < START] = 0
    doc = np.repeat(np.arange(len(n)), n)
    if not len(doc):
        return np.zeros(0, np.int64), doc, doc
    first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = first + t.bounds[doc]
    h = mix(run_hasher(t.hash)(at, at + RUN) ^ U(0x5851F42D4C957F2D))
    # the last of the smallest of every START places of one document
    low = np.arange(START - 1, len(h)) - np.lib.stride_tricks.sliding_window_view(h, START)[:, ::-1].argmin(axis=1)
    low = np.unique(low[doc[: len(low)] == doc[START - 1 :]])
    return h[low].view(np.int64), doc[low], first[low]


def spans(s: Sentences, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last sentence (in the block) of the span that starts at each sentence, where there is one."""
    w, n = s.words, len(s.first_word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.arange(n)
    reach = np.searchsorted(s.last_word, s.first_word + min_words - 1)  # the sentence with the min_words-th word
    last = np.maximum(reach, first + 1)
    ok = last < s.bounds[1:][s.doc]
    first, last = first[ok], last[ok]
    a, b = s.first_word[first], s.last_word[last] + 1
    return run_hasher(w.hash)(a, b).view(np.int64), first, last


def _keyed(docs: DataFrame, *other) -> DataFrame:
    """(doc_id, tkey, t, ...): ``tkey`` tells texts of one id apart: their hash, or 0 where an id has one text only.

    The hash would be a quarter of what every span carries through the shuffles."""
    ids = docs.select(F.col("doc_id").cast("long").alias("i"), text_key().alias("h"))
    many = save(ids.groupBy("i").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select(F.col("i").alias("many")), "many")
    n = many.count()
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tkey"), text_of(docs), *other)
    if not n:
        return given.withColumn("tkey", F.lit(0).cast("long"))
    side = (F.broadcast(many) if n < 100_000 else many).withColumn("met", F.lit(True))
    met = given.join(side, F.col("doc_id").eqNullSafe(F.col("many")), "left")
    return met.withColumn("tkey", F.when(F.col("met"), F.col("tkey")).otherwise(0)).drop("many", "met")


def repeated_spans(docs: DataFrame, min_words: int = 16) -> DataFrame:
    """(doc_id, tkey, first, last): sentence ranges of the non-first spans, and places of the non-first runs, that repeat."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0), b.column(1)
            for block in blocks(b.column(2)):
                s = Sentences(block)
                h, first, last = spans(s, min_words)
                d = s.doc[first]
                more, own, place = chosen_runs(Tokens(s.words))
                at = pa.array(np.concatenate((d, own)) + block.first)
                first = np.concatenate((first - s.bounds[d], place)).astype(np.int32)
                last = np.concatenate((last - s.bounds[d], np.full(len(own), -1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((h, more))), ids.take(at), keys.take(at), pa.array(first), pa.array(last)], [c.split()[0] for c in SPANS.split(", ")])

    all_ = save(_keyed(docs).mapInArrow(build, SPANS), "spans")
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tkey", "first")
    twice = save(all_.groupBy("h").agg(F.count("*").alias("c"), F.min(place).alias("p")).where("c > 1"), "twice")
    other = ~(F.col("p.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("p.tkey") == F.col("tkey")) & (F.col("p.first") == F.col("first")))
    return skew_join(all_, twice, "h").where(other).select("doc_id", "tkey", "first", "last")


def dedup_substrings(docs: DataFrame, min_words: int = 16) -> DataFrame:
    """``docs`` with its cleaned ``text``, ``n_sentences``, ``n_removed`` and ``removed`` (flat first-last pairs of sentences that
    repeated spans cover), and ``cut_words``, the words that left with these or in repeated runs."""
    found = repeated_spans(docs, min_words)
    # ranges meet in their document only: their number is bounded by its sentences and words
    ranges = found.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("first", "last")).alias("r"))
    ranges = save(ranges.select(F.col("doc_id").alias("d"), F.col("tkey").alias("k"), "r"), "ranges")
    mine = ("text", "n_sentences", "n_removed", "removed", "cut_words")
    keyed = _keyed(docs, boxed(docs, *mine))
    met = keyed.join(ranges, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k")), "left")
    given = met.select("t", F.coalesce("r", F.expr("array()").cast("array<struct<first:int,last:int>>")).alias("r"), "row")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, gone, cut, left = [], [], [], [], []
            begin = b.column(1).offsets.to_numpy()
            pairs = b.column(1).values
            firsts, lasts = pairs.field("first").to_numpy(), pairs.field("last").to_numpy()
            for block in blocks(b.column(0)):
                s = Sentences(block)
                t = Tokens(s.words)
                for d in range(block.n):
                    own = slice(begin[block.first + d], begin[block.first + d + 1])
                    first, last = firsts[own], lasts[own]
                    run = last < 0
                    count = int(s.bounds[d + 1] - s.bounds[d])
                    out = _covered(count, first[~run], last[~run] + 1)
                    words, size = _cut_words(s, t, d, out, first[run])
                    texts.append(_without(block, t, d, words))
                    n.append(count)
                    gone.append(int(out.sum()))
                    left.append(size)
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0]))))
                    edge[1::2] -= 1
                    cut.append(edge.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(gone, pa.int32()), lists(cut, pa.int32()), pa.array(left, pa.int32())], ["row", *mine])

    cleaned = given.mapInArrow(clean, as_out(given.select("row"), "text string, n_sentences int, n_removed int, removed array<int>, cut_words int"))
    return cleaned.select(*unboxed(docs, *mine), *mine)


def _covered(count: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``count`` places the ranges cover."""
    hit = np.bincount(first, minlength=count + 1) - np.bincount(end, minlength=count + 1)
    return np.cumsum(hit)[:count] > 0


def _cut_words(s: Sentences, t: Tokens, d: int, out: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, int]:
    """Which words of a document leave: those of its sentences in ``out`` and of long stretches of runs; their number."""
    a, b = t.bounds[d], t.bounds[d + 1]
    words = np.zeros(b - a, bool)
    if len(runs):
        words = _covered(b - a, runs, runs + RUN)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], words.astype(np.int8), [0]))))
        for i, j in zip(edge[::2], edge[1::2], strict=True):
            words[i:j] = j - i >= LEAST - RUN - START + 2
    if out.any():
        starts = s.words.start[s.first_word[s.bounds[d] : s.bounds[d + 1]]]
        words |= out[np.searchsorted(starts, t.start[a:b], "right") - 1]
    return words, int(words.sum())


def _without(block: Block, t: Tokens, d: int, out: np.ndarray) -> str:
    a, b = int(block.begin[d]), int(block.end[d])
    raw = block.buf
    if not out.any():
        return raw[a:b].tobytes().decode()
    # a word takes along the space up to the next one
    begin = np.append(t.start[t.bounds[d] : t.bounds[d + 1]], b)
    begin[0] = a
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (~out).astype(np.int8), [0]))))
    return b"".join(raw[begin[i] : begin[j]].tobytes() for i, j in zip(edge[::2], edge[1::2], strict=True)).decode()
