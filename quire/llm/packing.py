"""Packing of documents into token windows by multiway differencing.

A document's ids are cut into full windows; what is left over, in pieces of at most ``piece`` ids, is
balanced over as few windows as can hold it by Karmarkar-Karp differencing: every piece starts as a
partial partition of its own, and the two partial partitions with the largest imbalance are merged,
the heaviest window of one with the lightest of the other.  If a window comes out above capacity the
window count rises by one and the differencing starts again.

Each task packs its own documents, a group of ``group`` windows at a time, so nothing is shuffled, memory
is bounded by the group, and a lost task is simply run again with the same result.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; an empty
table gives no pieces.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class Tokenizer:
    """The ids of ``tokenizers``' vocabulary file.  Texts without special tokens take the faster encoder over
    the same ranks, which gives the same ids; the others go to ``tokenizers`` itself."""

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer as Slow

        self.slow = Slow.from_file(vocabulary)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def difference(sizes: list[int], k: int) -> tuple[np.ndarray, list[list[int]]]:
    """Karmarkar-Karp differencing of sizes into k windows: the windows' sums and members."""
    left: list[int] = []
    right: list[int] = []
    heap = []
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], nodes[0] = s, i
        heap.append((-s, i, sums, nodes))
    heapq.heapify(heap)
    m = tick = len(sizes)
    while len(heap) > 1:
        _, _, s1, n1 = heapq.heappop(heap)
        _, _, s2, n2 = heapq.heappop(heap)
        s, n2 = s1 + s2[::-1], n2[::-1]
        nodes = np.where(n1 < 0, n2, n1)
        both = np.flatnonzero((n1 >= 0) & (n2 >= 0))
        nodes[both] = m + len(left) + np.arange(len(both))
        left += n1[both].tolist()
        right += n2[both].tolist()
        order = np.argsort(-s, kind="stable")
        s, nodes = s[order], nodes[order]
        heapq.heappush(heap, (-int(s[0] - s[-1]), tick, s, nodes))
        tick += 1
    _, _, sums, nodes = heap[0]
    members = []
    for node in nodes.tolist():
        stack, own = [node] if node >= 0 else [], []
        while stack:
            x = stack.pop()
            if x < m:
                own.append(x)
            else:
                stack += (left[x - m], right[x - m])
        members.append(sorted(own))
    return sums, members


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """Members of windows of at most ``capacity``; the window count rises until all fit."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sums, members = difference(sizes, k)
        if sums.max() <= capacity:
            return [m for m in members if m]
        k += 1


def pack(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, capacity: int = 2048, end: int = 1, piece: int = 512, group: int = 192) -> DataFrame:
    """One row per piece: document, ids before it, length, crc32 of its ids, ids of the document, sequence,
    offset there, and the sequence's ids in all."""
    state: dict[str, Tokenizer] = {}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "t" not in state:
            state["t"] = Tokenizer(vocabulary, ranks, pattern)
        encode = state["t"].ids
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        rest: list[tuple] = []  # pieces that wait: doc_id, start, length, crc, doc_tokens
        waiting = 0

        def close() -> None:
            nonlocal sequence, waiting
            for members in windows_for([r[2] for r in rest], capacity):
                total, at = sum(rest[i][2] for i in members), 0
                for i in members:
                    rows.append((*rest[i], sequence, at, total))
                    at += rest[i][2]
                sequence += 1
            rest.clear()
            waiting = 0

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                n, at = len(ids), 0
                while n - at >= capacity:
                    rows.append((doc, at, capacity, zlib.crc32(ids[at : at + capacity].tobytes()), n, sequence, 0, capacity))
                    sequence += 1
                    at += capacity
                while at < n:
                    size = min(piece, n - at)
                    rest.append((doc, at, size, zlib.crc32(ids[at : at + size].tobytes()), n))
                    waiting += size
                    at += size
                if waiting >= group * capacity:
                    close()
            if len(rows) > 50_000:
                yield _batch(rows)
                rows.clear()
        close()
        if rows:
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
