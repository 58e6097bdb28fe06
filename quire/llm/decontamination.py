"""Benchmark decontamination with suffix arrays.

The words of each shard of training text become ids in the benchmark's vocabulary (0: not in it).  A
suffix that does not begin with at least as many known words as the shortest window can match
no window, so the shard's suffix array holds the others, all of them, ordered by prefix doubling.  Every
suffix of every benchmark item is then binary-searched in it, all suffixes of a page at once and a word at a time; those
that reach a window's length keep a range of the suffix array.  Equal windows have equal ranges, so ranges are
opened once: they give the hit words and the items.  The longest verbatim match and its place are then found
by bisection over its length, so a text that repeats one word a thousand times costs little more than its length.

The benchmark is read in pages of at most ``page_words`` words, each page broadcast by itself, so that
what goes to the executors has that bound however large the benchmark is.

Defined results: a null text has no words; benchmark rows without words or with a null id are passed
over; rows that share an item id are one item; repeated documents are judged alike; empty tables
give empty results or clean documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm.shared import boxed, text_of, unboxed
from quire.llm.textkernel import ALNUM, Words, blocks, lists, run_hasher

WINDOW = 13
#: Words of the benchmark that travel to the executors together.
PAGE_WORDS = 2_000_000
FOUND = "n_words long, spans array<int>, items array<string>, longest int, longest_at int, longest_item string"


class Page:
    """A page of the benchmark: vocabulary, items as ids, and the window length of each item."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        self.window = window
        hashes = []
        for block in blocks(pa.array(texts, pa.string())):
            w = Words(block, kind=ALNUM)
            hashes += [w.hash[w.bounds[d] : w.bounds[d + 1]] for d in range(block.n)]
        self.vocab = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        self.ids = [i for i, h in zip(ids, hashes, strict=True) if len(h)]
        self.items = [np.searchsorted(self.vocab, h).astype(np.int64) + 1 for h in hashes if len(h)]
        self.least = min((min(window, len(x)) for x in self.items), default=0)
        # all suffixes of at least a window: their words, item and window length
        length = np.array([len(x) for x in self.items], np.int64)
        self.begin = np.cumsum(length) - length
        self.words = np.concatenate([*self.items, np.zeros(window, np.int64)])
        item = np.repeat(np.arange(len(length)), length)
        size = np.minimum(length, window)[item]
        at = np.arange(len(item))
        self.suffix = at[at + size <= (self.begin + length)[item]] if len(item) else at
        self.item, self.size = item[self.suffix], size[self.suffix]

    def encode(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocab):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at + 1, 0)


def suffix_array(text: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """``start`` ordered by the ``depth`` ids from there on; ``text`` ends with ``depth`` zeros."""
    if not len(start):
        return start
    rank, width = text.astype(np.int64), 1
    while width < depth:
        pair = rank * (rank.max() + 1)
        pair[:-width] += rank[width:]
        rank, width = np.unique(pair, return_inverse=True)[1], 2 * width
    return start[np.argsort(rank[start], kind="stable")]


def _bound(text: np.ndarray, order: np.ndarray, k: int, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """In each range lo:hi of ``order`` the first suffix whose k-th word is not below ``want`` (right: is above it)."""
    lo, hi = lo.copy(), hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        word = text[order[mid] + k]
        up = word <= want[live] if right else word < want[live]
        lo[live[up]] = mid[up] + 1
        hi[live[~up]] = mid[~up]
        live = live[lo[live] < hi[live]]
    return lo


def search(text: np.ndarray, order: np.ndarray, page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The page's suffixes that occur with their whole window, and the range of ``order`` where each does."""
    at = np.arange(len(page.suffix))
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(order))
    for k in range(page.window):
        go = page.size[at] > k
        want = page.words[page.suffix[at[go]] + k]
        a, b = lo[go], hi[go]
        lo[go] = _bound(text, order, k, a, b, want, False)
        hi[go] = _bound(text, order, k, lo[go], b, want, True)
        some = lo < hi
        at, lo, hi = at[some], lo[some], hi[some]
    return at, lo, hi


def scan(page: Page, column: pa.Array) -> Iterator[tuple]:
    """Per text: number of words, disjoint hit ranges, items, longest match with place and item."""
    for block in blocks(column):
        w = Words(block, kind=ALNUM)
        n = np.diff(w.bounds)
        hit: dict[int, list] = {}
        if page.least and len(w):
            ids = page.encode(w.hash)
            # a zero after each document keeps matches inside it
            text = np.zeros(len(ids) + block.n + 16 + page.window, np.int64)
            place = np.arange(len(ids)) + w.doc
            text[place] = ids
            known = text > 0
            run = known.copy()
            for k in range(1, page.least):
                run[:-k] &= known[k:]
            start = np.flatnonzero(run)
            if len(start):
                _search_page(page, text, start, w, hit)
        for d in range(block.n):
            yield (int(n[d]), *hit.get(d, ([], [], 0, -1, None)))


def _search_page(page: Page, text: np.ndarray, start: np.ndarray, w: Words, hit: dict) -> None:
    # only the neighbourhoods of the suffixes need ranks
    near = np.zeros(len(text), bool)
    for k in range(page.window):
        near[np.minimum(start + k, len(text) - 1)] = True
    compact = np.flatnonzero(near)
    keep = np.zeros(len(compact) + 2 * page.window + 16, np.int64)
    keep[: len(compact)] = text[compact]
    order = suffix_array(keep, np.searchsorted(compact, start), page.window)
    at, lo, hi = search(keep, order, page)
    if not len(at):
        return
    doc_at = w.bounds[:-1] + np.arange(w.block.n)  # place of each document's first word in text
    # hit words: every distinct range once
    ranges = np.unique(np.stack((lo, hi, page.size[at])), axis=1)
    real, size = compact[order[_opened(ranges[0], ranges[1])]], np.repeat(ranges[2], ranges[1] - ranges[0])
    cover = np.bincount(real, minlength=len(text)) - np.bincount(real + size, minlength=len(text))[: len(text)]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8), [0]))))
    # items: every distinct range of an item once
    ranges = np.unique(np.stack((page.item[at], lo, hi)), axis=1)
    places = compact[order[_opened(ranges[1], ranges[2])]]
    item, doc = np.repeat(ranges[0], ranges[2] - ranges[1]), np.searchsorted(doc_at, places, "right") - 1
    pairs = np.unique(np.stack((doc, item)), axis=1)
    by_doc = np.argsort(doc, kind="stable")
    cut, own, spans = np.searchsorted(doc[by_doc], np.arange(w.block.n + 1)), np.searchsorted(pairs[0], np.arange(w.block.n + 1)), np.searchsorted(edge, np.append(doc_at, len(text)))
    hasher, item_hasher = run_hasher(text.astype(np.uint64)), run_hasher(page.words.astype(np.uint64))
    for d in np.unique(doc):
        mine = pairs[1, own[d] : own[d + 1]]
        starts = np.unique(places[by_doc[cut[d] : cut[d + 1]]])
        length, place, best = _longest(page, mine, starts, len(text), hasher, item_hasher)
        hit[int(d)] = ((edge[spans[d] : spans[d + 1]] - doc_at[d]).tolist(), sorted({page.ids[i] for i in mine}), length, int(place - doc_at[d]), best)


def _opened(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges lo:hi, one range after the other."""
    n = hi - lo
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _longest(page: Page, items: np.ndarray, starts: np.ndarray, end: int, hasher, item_hasher) -> tuple[int, int, str]:
    """The longest run of words of a document that one of ``items`` has, its first place, and the last such item by id.

    A shorter run is there wherever a longer one is, so its length is found by bisection.  ``starts`` are the places where
    windows occur: a run of an item's window length or more begins at one of them."""
    begin = page.begin[items]
    length = np.array([len(page.items[i]) for i in items], np.int64)
    least = np.minimum(length, page.window)

    def runs(n: int) -> tuple[np.ndarray, np.ndarray]:
        fit = np.flatnonzero((length >= n) & (least <= n))
        at = _opened(begin[fit], begin[fit] + length[fit] - n + 1)
        return item_hasher(at, at + n), np.repeat(items[fit], length[fit] - n + 1)

    def found(n: int) -> np.ndarray:
        here = starts[starts + n <= end]
        return here[np.isin(hasher(here, here + n), runs(n)[0])]

    # windows of whole short items reach no further than the item
    short = [int(n) for n in np.unique(least[least < page.window])]
    best = max((n for n in short if len(found(n))), default=0)
    lo, hi = page.window - 1, int(length.max())
    while lo < hi:
        mid = (lo + hi + 1) >> 1
        lo, hi = (mid, hi) if len(found(mid)) else (lo, mid - 1)
    best = lo if lo >= page.window else best
    place = found(best)[0]
    h, of = runs(best)
    return best, int(place), max(page.ids[i] for i in np.unique(of[h == hasher(np.array([place]), np.array([place + best]))[0]]))


def merge(flat: list[int]) -> list[int]:
    """Disjoint ranges, as a flat list of starts and ends, of any ranges."""
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _pages(benchmark: DataFrame, window: int, page_words: int) -> Iterator[Page]:
    ids, texts, size, made = [], [], 0, 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text")
    for item, text in rows.toLocalIterator():
        ids.append(item)
        texts.append(text)
        size += 1 + len(text) // 4
        if size > page_words:
            yield Page(ids, texts, window)
            ids, texts, size, made = [], [], 0, made + 1
    if ids or not made:
        yield Page(ids, texts, window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, page_words: int = PAGE_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (ids with occurring windows, sorted), the longest
    match (words, place in words, item) and ``contaminated``: a hit, and 20 hits or more in 400 words.  Columns of ``docs`` named like these are replaced."""
    return _found(docs, benchmark, window, page_words).select(*unboxed(docs, *_MINE), *(F.col(c) for c in _MINE))


_MINE = ["n_words", "spans", "items", "longest", "longest_at", "longest_item", "n_hit", "contaminated"]


def _found(docs: DataFrame, benchmark: DataFrame, window: int, page_words: int) -> DataFrame:
    """All columns of ``docs`` in one struct ``row``, and what was found, so that no name of theirs meets one of these."""
    spark = docs.sparkSession
    out = docs.select(boxed(docs), text_of(docs))
    fields = StructType(out.schema.fields + StructType.fromDDL(FOUND).fields)
    for i, page in enumerate(_pages(benchmark, window, page_words)):
        sent = spark.sparkContext.broadcast(page)

        def found(batches: Iterator[pa.RecordBatch], sent=sent, first=not i) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = list(scan(sent.value, b.column(1)))
                if not first:
                    before = [b.column(b.schema.get_field_index(c)).to_pylist() for c in _MINE[1:6]]
                    rows = [_both(r, old) for r, old in zip(rows, zip(*before, strict=True), strict=True)]
                cols = [pa.array([r[0] for r in rows], pa.int64()), lists([np.array(r[1], np.int32) for r in rows], pa.int32())]
                cols += [pa.array([r[k] for r in rows], t) for k, t in ((2, pa.list_(pa.string())), (3, pa.int32()), (4, pa.int32()), (5, pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["row", "t", *_MINE[:6]])

        out = out.mapInArrow(found, fields)
    n_hit = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 0, -x, x)), 0, (a, x) -> a + x)").cast("long")
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _both(new: tuple, old: tuple) -> tuple:
    best = max((new[3:], old[2:]), key=lambda f: (f[0], -f[1], f[2] or ""))
    return (new[0], merge([*new[1], *old[0]]), sorted({*new[2], *old[1]}), *best)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their own columns only."""
    return _found(docs, benchmark, window, PAGE_WORDS).where(~F.col("contaminated")).select(*unboxed(docs))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
