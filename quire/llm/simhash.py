"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has a bit set where it is set in over half of the 64-bit hashes of its word shingles.  Fingerprints
link when at most ``radius`` bits differ.  The bits are dealt into parts, correlated bits into the same part; part i gets
``e_i`` with the sum ``radius + 1``.  Of two fingerprints that link, at least one part i differs in fewer than ``e_i`` bits
(else ``radius + 1`` bits would differ), so a part with ``e_i = 0`` is not probed at all, one with 1 by its value, one with 2 by its value
and all values that differ in one bit.  ``plan`` estimates the pairs that each part meets at each ``e_i`` from the joint
counts of all pairs of bits over all fingerprints (a Markov chain along the part), and finds the cheapest parts and ``e_i``
by dynamic programming.  The plan only decides the cost; every choice finds every link, and all candidates are verified.

Only distinct fingerprints meet, so copies are one row.  A bucket in which more than ``MANY`` pairs would meet is not joined:
its rows are probed again on the bits that are left, with the bits that the bucket's probe has spent taken off the
radius, until the buckets are small or no bits are left.  So no bucket is ever all pairs of a hot group, and no link is lost.

Defined results: a null text is empty; texts without words have fingerprint zero, and link like any other; a null id is not the smallest id
of a component unless all its ids are null; repeated rows each get their row; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.shared import drop, save, skew_join
from quire.llm.textkernel import U, Words, blocks

BITS = 64
#: Pairs that a bucket may have for its rows to be joined; beyond it the bucket is probed again on the other bits.
MANY = 1 << 20
#: What a shuffled row costs, in comparisons of two fingerprints that lie side by side.
ROW_COST = 30.0

_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << U(k)) | (x >> U(64 - k))


def _lane(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of slices of a buffer that has eight spare bytes, all slices a step at a time."""
    wide = np.ndarray(len(buf) - 7, "<u8", buf, 0, (1,))
    size, at = (end - start).astype(np.int64), start.astype(np.int64)
    h = np.full(len(at), U(seed) + _P5, U)
    long = np.flatnonzero(size >= 32)
    if len(long):
        with np.errstate(over="ignore"):
            acc = [np.full(len(long), v, U) for v in (U(seed) + _P1 + _P2, U(seed) + _P2, U(seed), U(seed) - _P1)]
        live, k = np.arange(len(long)), 0
        while len(live):
            p = at[long[live]] + 32 * k
            for i in range(4):
                acc[i][live] = _lane(acc[i][live], wide[p + 8 * i])
            k += 1
            live = live[size[long[live]] >= 32 * (k + 1)]
        x = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
        for a in acc:
            x = (x ^ _lane(np.zeros(len(a), U), a)) * _P1 + _P4
        h[long] = x
    h += size.astype(U)
    at = at + (size & ~31)
    left = size & 31
    for k in range(3):
        live = np.flatnonzero(left >= 8 * (k + 1))
        h[live] = _turn(h[live] ^ _lane(np.zeros(len(live), U), wide[at[live] + 8 * k]), 27) * _P1 + _P4
    at, left = at + (left & ~7), left & 7
    live = np.flatnonzero(left >= 4)
    h[live] = _turn(h[live] ^ ((wide[at[live]] & U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at, left = at + (left & 4), left & 3
    for k in range(3):
        live = np.flatnonzero(left > k)
        h[live] = _turn(h[live] ^ (buf[at[live] + k].astype(U) * _P5), 11) * _P1
    h ^= h >> U(33)
    h *= _P2
    h ^= h >> U(29)
    h *= _P3
    return h ^ (h >> U(32))


def _shingle_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every run of ``n`` words of a document joined by single spaces (of all its words where it has fewer), and each document's
    first place among them."""
    size = words.end - words.start
    at = np.concatenate(([0], np.cumsum(size + 1)))
    joined = words.buf[np.repeat(words.start - at[:-1], size + 1) + np.arange(at[-1])]
    joined[at[1:] - 1] = 0x20
    joined = np.concatenate((joined, np.zeros(8, np.uint8)))
    count = np.diff(words.bounds)
    shingles = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate(([0], np.cumsum(shingles)))
    doc = np.repeat(np.arange(len(count)), shingles)
    head = words.bounds[doc] + np.arange(first[-1]) - first[doc]
    last = head + np.minimum(n, count[doc]) - 1
    return xxh64(joined, at[head], at[last] + size[last]), first


def fingerprints(column: pa.Array, shingle: int = 3, step: int = 1 << 17) -> np.ndarray:
    """The fingerprint of each text of a column: a bit is set where it is set in over half of the shingles' hashes."""
    out = [np.zeros(0, U)]
    for block in blocks(column):
        h, first = _shingle_hashes(Words(block, hashed=False), shingle)
        ones = np.zeros((block.n, 64), np.int64)
        for a in range(0, len(h), step):
            part = h[a : a + step]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            d0, d1 = np.searchsorted(first, [a, a + len(part) - 1], "right") - 1
            cut = np.clip(first[d0 : d1 + 1] - a, 0, None)
            full = np.diff(np.append(cut, len(part))) > 0
            ones[np.arange(d0, d1 + 1)[full]] += np.add.reduceat(bits, cut[full], axis=0, dtype=np.int64)
        over = 2 * ones > np.diff(first)[:, None]
        out.append(np.packbits(over, axis=1, bitorder="little").view(U).ravel())
    return np.concatenate(out)


def _long(x: int) -> int:
    """The signed 64-bit integer with the bits of ``x``."""
    return x - (1 << 64) if x >> 63 else x


def _mask(bits) -> int:
    return sum(1 << int(b) for b in bits)


def bit_counts(prints: DataFrame) -> np.ndarray:
    """How many fingerprints have both bit i and bit j set; the 64 x 64 sums are made in the tasks and added by key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            bits = np.unpackbits(np.asarray(b.column(0)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            both += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS), pa.int32()), pa.array(both.ravel())], ["at", "n"])

    sums = prints.select("fp").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BITS * BITS, np.int64)
    out[sums["at"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(BITS, BITS)


class BitModel:
    """How often bits of two fingerprints agree, by the joint counts of pairs of bits."""

    def __init__(self, both: np.ndarray, n: int):
        n = max(n, 1)
        one = np.diag(both) / n
        p11 = both / n
        p10, p01 = one[:, None] - p11, one[None, :] - p11
        self.same = one**2 + (1 - one) ** 2
        self.both_same = np.clip(p11**2 + p10**2 + p01**2 + (1 - p11 - p10 - p01) ** 2, 0, 1)
        self.tie = np.abs(p11 - one[:, None] * one[None, :])
        self.n = n

    def parts(self, bits: list[int], m: int) -> list[list[int]]:
        """The bits in ``m`` chains of nearly one length, each bit followed by the free one that depends on it most."""
        free, out = set(bits), []
        for i in range(m):
            size = len(bits) * (i + 1) // m - len(bits) * i // m
            chain = [max(sorted(free), key=lambda b: max((self.tie[b, c] for c in free if c != b), default=0))]
            free.discard(chain[0])
            while len(chain) < size:
                chain.append(max(sorted(free), key=lambda b: self.tie[chain[-1], b]))
                free.discard(chain[-1])
            out.append(chain)
        return out

    def within(self, chain: list[int], most: int) -> list[float]:
        """Estimated shares of pairs of fingerprints that differ in at most 0, 1, ... ``most`` bits of a chain."""
        state = np.zeros((2, most + 2))  # by whether the last bit differs, and by differing bits so far; the last column is beyond
        state[0, 0], state[1, min(1, most + 1)] = self.same[chain[0]], 1 - self.same[chain[0]]
        for a, b in zip(chain, chain[1:], strict=False):
            ss = self.both_same[a, b]
            stay = np.array([[ss, max(self.same[a] - ss, 0)], [max(self.same[b] - ss, 0), max(1 - self.same[a] - self.same[b] + ss, 0)]])
            stay /= np.maximum(stay.sum(1, keepdims=True), 1e-12)
            moved = np.zeros_like(state)
            moved[0] = state.T @ stay[:, 0]
            far = state.T @ stay[:, 1]
            moved[1, 1:] = far[:-1]
            moved[1, -1] += far[-1]
            state = moved
        return list(np.cumsum(state.sum(0))[: most + 1])

    def cost(self, chain: list[int], e: int, radius: int) -> float:
        """Rows sent and pairs met when a part is probed to fewer than ``e`` differing bits."""
        if e == 0:
            return 0.0
        if len(chain) < e:
            return math.inf
        rows = sum(math.comb(len(chain), t) / (2 if t else 1) for t in range(e))
        return ROW_COST * self.n * rows + self.n * self.n / 2 * self.within(chain, radius)[e - 1]


def allocate(model: BitModel, parts: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """The cheapest ``e_i`` with the sum ``radius + 1``, by dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for chain in parts:
        now: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, e) in best.items():
            for x in range(radius + 2 - spent):
                c = cost + model.cost(chain, x, radius)
                if c < now.get(spent + x, (math.inf, []))[0]:
                    now[spent + x] = (c, [*e, x])
        best = now
    return best.get(radius + 1, (math.inf, []))


def plan(model: BitModel, bits: list[int], radius: int) -> list[tuple[list[int], int]]:
    """Parts of ``bits`` with their ``e_i``, parts that are not probed left out; a single part where there are too few bits to split."""
    best = (math.inf, [])
    for m in range(2, min(len(bits), 2 * (radius + 1)) + 1):
        parts = model.parts(bits, m)
        cost, e = allocate(model, parts, radius)
        if cost < best[0]:
            best = (cost, [(p, x) for p, x in zip(parts, e, strict=True) if x])
    return best[1] or [(list(bits), min(radius + 1, len(bits) + 1))]


def _probes(rows: DataFrame, parts: list[tuple[list[int], int]], bits: list[int], radius: int) -> list[tuple[DataFrame, list[int], int]]:
    """For every part and number t of flipped bits the rows (grp, side, fp), with the bits and the radius that are left.

    Rows of side S meet all rows of their group; rows of side A only those of side B.  A row is found by its own
    value and finds others by flipped values; of two rows on side S only that whose lowest flipped bit is 0 does."""
    out = []
    for i, (part, e) in enumerate(parts):
        left = [b for b in bits if b not in part]
        key = lambda fp, t, i=i, part=part: F.xxhash64("grp", F.lit(i), F.lit(t), fp.bitwiseAND(F.lit(_long(_mask(part)))))
        fp = F.col("fp")
        for t in range(e):
            if t == 0:
                out.append((rows.select(key(fp, 0).alias("grp"), "side", "fp"), left, radius))
                continue
            flips = [(_long(_mask(c)), _long(1 << min(c))) for c in combinations(sorted(part), t)]
            each = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(low).alias("low")) for m, low in flips)))
            own = rows.where("side <> 'B'").select(key(fp, t).alias("grp"), F.lit("A").alias("side"), "fp")
            flipped = rows.where("side <> 'A'").select("grp", "side", "fp", each.alias("x")).where("side = 'B' or fp & x.low = 0")
            flipped = flipped.select(key(fp.bitwiseXOR(F.col("x.m")), t).alias("grp"), F.lit("B").alias("side"), "fp")
            out.append((own.union(flipped), left, radius - t))
    return out


def close_pairs(prints: DataFrame, radius: int, model: BitModel | None = None, many: int = MANY) -> DataFrame:
    """(a, b): all pairs a < b of ``prints`` (fp, distinct) that differ in at most ``radius`` bits, each once."""
    model = model or BitModel(bit_counts(prints), prints.count())
    rows = prints.select(F.lit(0).cast("long").alias("grp"), F.lit("S").alias("side"), "fp")
    level, found, made = [(rows, list(range(BITS)), radius)], [], []
    n = lambda s: F.count(F.when(F.col("side") == s, 1))
    while level:
        probed = [x for given, bits, r in level for x in _probes(given, plan(model, bits, r), bits, r)]
        every = reduce(DataFrame.union, [x.withColumn("kind", F.lit(k)) for k, (x, _, _) in enumerate(probed)])
        sized = every.groupBy("grp", "kind").agg(n("S").alias("s"), n("A").alias("a"), n("B").alias("b"))
        sized = sized.withColumn("pairs", F.expr("s * (s - 1) / 2 + a * cast(b as double)")).where("pairs > 0").select("grp", "kind", "pairs")
        met = save(every.join(sized, ["grp", "kind"]), "buckets")
        made.append(met)
        found.append(_met(met.where(F.col("pairs") <= many), radius))
        level = []
        for k in sorted(x["kind"] for x in met.where(F.col("pairs") > many).select("kind").distinct().collect()):
            hot = met.where((F.col("pairs") > many) & (F.col("kind") == k)).select("grp", "side", "fp")
            if probed[k][1]:
                level.append((hot, probed[k][1], probed[k][2]))
            else:  # no bits are left: all that meet are links, as many as there are
                found.append(_met(hot, radius))
    links = save(reduce(DataFrame.union, found).distinct(), "links")
    drop(*made)
    return links


def _met(rows: DataFrame, radius: int) -> DataFrame:
    a = rows.where("side <> 'B'").select("grp", F.col("side").alias("s1"), F.col("fp").alias("x"))
    b = rows.where("side <> 'A'").select("grp", F.col("side").alias("s2"), F.col("fp").alias("y"))
    met = a.join(b, "grp").where(f"((s1 = 'S' and s2 = 'S' and x < y) or (s1 = 'A' and s2 = 'B')) and bit_count(x ^ y) <= {radius} and x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def text_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1), shingle).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(build, "doc_id long, fp long")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``: a component is what links of fingerprints reach, named by its
    smallest id."""
    prints = save(text_fingerprints(docs, shingle), "prints")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id")).alias("own")
    kinds = save(prints.groupBy("fp").agg(one, F.count("*").alias("size")), "kinds")
    links = close_pairs(kinds.select("fp"), radius)
    root = save(components(links), "root")
    named = save(kinds.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    best = save(named.groupBy("root").agg(F.min("own").alias("best"), F.count("*").alias("c")), "best")
    of = save(skew_join(named.select("fp", "root", "size"), best, "root").select("fp", F.col("best.doc_id").alias("component_id"), F.col("size").alias("c")), "of")
    drop(links, root, kinds, named, best)
    return skew_join(prints, of, "fp").select("doc_id", hex_print(F.col("fp")).alias("fingerprint"), "component_id")
