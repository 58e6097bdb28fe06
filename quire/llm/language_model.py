"""Scoring with a bigram language model in Elias-Fano tries.

p(w | u) = (c(u, w) + mu * p(w)) / (c(u) + mu), with p(w) = (c(w) + 1) / (N + V + 1): a Dirichlet-smoothed bigram over a
smoothed unigram, both summing to 1 with one class for unknown words.  The log of a text is then a sum of terms
that belong to one predicted word each: log(c(u, w) + mu * p(w)) for w after u, and -log(c(w) + mu) for w as
context of what follows.  So all counts that a term needs meet in the shard of its word, and
the corpus is read twice: once for N, V and the hottest words, once for everything else.

Shards.  Documents are cut into packets.  A packet's bigrams are sorted and told to the shards of their words, one row a shard
that has any, so at most one a distinct word of the packet, however many shards there are.  Shards come one
after the other in the sorted partitions of a shuffle, so a task holds one shard at a time.  The shard adds up the training
counts, lays them into a trie (words, then the contexts of each word: monotone sequences in Elias-Fano form, values quantised
to 1/64 of a decade) in an anonymous memory map, looks up every bigram it was sent, and answers each row with a count a
word and a value a bigram.  The packet's documents travel beside it as they are, and meet the answers where its sums are taken.

Words above 1 / (4 * shards) of all tokens, so fewer than 4 * shards and at most ``HOT_MOST`` of them, are dealt over all shards
by their contexts, with their counts known from the first pass.  The number of shards grows with the tokens, so memory does not.

Words are told apart by 64-bit hashes, contexts of one word by 48 bits of theirs.

Defined results: a null or empty text is the end token alone; repeated rows count and are scored each; a null id counts
as the empty text in the fold; an empty table gives an empty result.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import drop, fold, save
from quire.llm.textkernel import U, Words, blocks, mix, return_memory

START, END = U(0x5354415254), U(0x454E44)
GRID = 64
#: Tokens a shard, bytes of text a packet, and words whose counts are told to all tasks (16 bytes each).
SHARD_TOKENS, PACKET, HOT_MOST = 500_000, 3 << 20, 1_000_000
#: ``body`` asks a shard (words, runs of contexts, contexts, training counts), ``echo`` passes it by (times and documents of bigrams).
_PACKET = "shard int, block long, doc_ids array<long>, n_tokens array<int>, held binary, sizes array<int>, body binary, echo binary"
_ANSWER = "block long, doc_ids array<long>, n_tokens array<int>, held binary, sizes array<int>, body binary, echo binary"


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers: low bits packed, high bits in unary, in one buffer that can
    be a memory map."""

    def __init__(self, buffer):
        head = np.frombuffer(buffer, "<u8", 3)
        self.n, self.low_bits, upper = (int(x) for x in head)
        width = -(-self.n * self.low_bits // 8) + 8
        self.low = np.frombuffer(buffer, np.uint8, width, 24)
        self.upper = np.frombuffer(buffer, np.uint8, upper, 24 + width)
        self.size = 24 + width + upper

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        v = values.astype(U)
        n = len(v)
        top = int(v[-1]) if n else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        body = np.concatenate([np.zeros(0, np.uint8), *(_low_bits(v[i : i + 65536], low) for i in range(0, n, 65536))])
        high = (v >> U(low)).astype(np.int64)
        unary = np.zeros(n + (int(high[-1]) if n else 0) + 1, np.uint8)
        unary[high + np.arange(n)] = 1
        upper = np.packbits(unary, bitorder="little")
        width = -(-n * low // 8) + 8
        return np.array([n, low, len(upper)], "<u8").tobytes() + body.tobytes() + bytes(width - len(body)) + upper.tobytes()

    def opened(self) -> EliasFano:
        """Decodes the starts of the high parts, for get() and find()."""
        bits = np.unpackbits(self.upper, bitorder="little")
        ones = np.flatnonzero(bits)[: self.n]
        self.high = ones - np.arange(self.n)
        self.wide = np.ndarray(len(self.low) - 7, "<u8", self.low, 0, (1,))
        self.starts = np.searchsorted(self.high, np.arange((int(self.high[-1]) if self.n else 0) + 2))
        return self

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        bit = i.astype(np.int64) * self.low_bits
        x = self.wide[bit >> 3] >> (bit & 7).astype(U)
        if self.low_bits > 57:
            over = (bit & 7) + self.low_bits > 64
            x[over] |= self.low[(bit[over] >> 3) + 8].astype(U) << (U(64) - (bit[over] & 7).astype(U))
        return x & ((U(1) << U(self.low_bits)) - U(1))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.high[i].astype(U) << U(self.low_bits)) | self.lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of numbers, -1 where absent: a search among those of the same high part."""
        x = x.astype(U)
        high = x >> U(self.low_bits)
        inside = high < U(len(self.starts) - 1)
        h = np.where(inside, high, U(0)).astype(np.int64)
        lo, hi = (self.starts[h], self.starts[h + 1]) if self.n else (np.zeros(len(x), int),) * 2
        lo, hi = lo.copy(), np.where(inside, hi, lo)
        end, want = hi.copy(), x & ((U(1) << U(self.low_bits)) - U(1))
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.lows(mid) < want[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        ok = np.flatnonzero(lo < end)
        out = np.full(len(x), -1, np.int64)
        out[ok] = np.where(self.lows(lo[ok]) == want[ok], lo[ok], -1)
        return out


def _low_bits(v: np.ndarray, low: int) -> np.ndarray:
    """The low bits of numbers end to end; of a multiple of eight numbers they fill whole bytes."""
    raw = np.ascontiguousarray(v.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :low].reshape(-1), bitorder="little")


class Trie:
    """Two levels: words; and under each word the contexts it was seen after, as word * contexts + context."""

    @staticmethod
    def pack(words: np.ndarray, contexts: np.ndarray, pair_word: np.ndarray, pair_context: np.ndarray, value: np.ndarray) -> bytes:
        parts = [EliasFano.pack(words), EliasFano.pack(contexts), EliasFano.pack(pair_word.astype(U) * U(max(1, len(contexts))) + pair_context.astype(U)), value.astype("<i2").tobytes()]
        return np.array([len(p) for p in parts], "<u8").tobytes() + b"".join(parts)

    def __init__(self, buffer):
        sizes = np.frombuffer(buffer, "<u8", 4).astype(int)
        at = 32 + np.concatenate(([0], np.cumsum(sizes)))
        view = memoryview(buffer)
        self.words, self.contexts, self.pairs = (EliasFano(view[at[k] : at[k + 1]]).opened() for k in range(3))
        self.value = np.frombuffer(view[at[3] : at[4]], "<i2")

    def lookup(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Quantised logs of pairs given by places; NaN for pairs that were not seen."""
        ok = (word >= 0) & (context >= 0)
        at = np.full(len(word), -1, np.int64)
        at[ok] = self.pairs.find(word[ok].astype(U) * U(max(1, self.contexts.n)) + context[ok].astype(U))
        out = np.full(len(word), np.nan)
        out[at >= 0] = self.value[at[at >= 0]] / GRID
        return out


def _sequences(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By block: first row, tokens, the token before each, and each document's tokens."""
    for block in blocks(column):
        w = Words(block)
        n = np.diff(w.bounds) + 1
        stop = np.cumsum(n) - 1
        tok = np.empty(int(n.sum()), U)
        tok[np.arange(len(w)) + w.doc] = w.hash
        tok[stop] = END
        before = np.concatenate((np.array([START], U), tok[:-1]))
        before[stop[:-1] + 1] = START
        yield block.first, tok, before, n


def _given(docs: DataFrame, held) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))


def _totals(given: DataFrame) -> tuple[int, int, int, dict[int, int], int]:
    """Training tokens and types, training documents, hot words with their counts, and the number of shards."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_memory()
        held, size = [], 0

        def out() -> pa.RecordBatch:
            kinds, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for b in batches:
            skip = np.asarray(b.column(1).fill_null(False).cast(pa.int8())).astype(bool)
            for first, tok, _, n in _sequences(b.column(2)):
                use = tok[~np.repeat(skip[first : first + len(n)], n)]
                held.append(use)
                size += len(use)
                if size > 2_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    kinds = given.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    kinds = save(kinds, "types")
    got = kinds.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = got["n"] or 0, got["v"]
    shards = max(4, n // SHARD_TOKENS + 1)
    often = kinds.where(F.col("n") > n // (4 * shards)).orderBy(F.desc("n"), "h").limit(HOT_MOST).toArrow()
    hot = dict(zip(often["h"].to_pylist(), often["n"].to_pylist(), strict=True))
    end = int(END.view(np.int64))
    docs = hot.get(end) or (kinds.where(F.col("h") == end).select("n").first() or [0])[0]
    drop(kinds)
    return n, v, docs, hot, shards


def _packets(given: DataFrame, hot: dict[int, int], shards: int) -> DataFrame:
    hot_words = np.sort(np.array(list(hot), np.int64).view(U))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_memory()
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            skip = np.asarray(b.column(1).fill_null(False).cast(pa.int8())).astype(np.uint8)
            parts: list[tuple] = []
            size = 0
            for first, tok, before, n in _sequences(b.column(2)):
                parts.append((tok, before, n))
                start = first + len(n) - sum(len(p[2]) for p in parts)
                size += len(tok)
                docs = first + len(n) - start
                if size * 6 > PACKET or docs > 40_000 or first + len(n) == len(b):
                    yield from _packet(number, parts, skip[start : start + docs], b.column(0).slice(start, docs), hot_words, shards)
                    number += 1
                    parts, size = [], 0

    return given.mapInArrow(send, _PACKET)


def _packet(number: int, parts: list[tuple], skip: np.ndarray, ids: pa.Array, hot: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    tok, before, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
    kinds, rank = np.unique(np.concatenate((tok, np.array([START], U), before)), return_inverse=True)
    r2, r1 = rank[: len(tok)], rank[len(tok) + 1 :]
    route = mix(kinds)[r2]
    if len(hot):
        spread = np.isin(kinds, hot)[r2]
        route[spread] = mix(route[spread] ^ mix(kinds[r1[spread]]))
    shard = ((route >> U(32)) * U(shards)) >> U(32)
    m = len(kinds)
    key = (shard.astype(np.int64) * m + r2) * m + r1
    order = np.argsort(key, kind="stable")
    key = key[order]
    doc = np.repeat(np.arange(len(n), dtype=np.uint16), n)[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    times = np.diff(np.append(head, len(key))).astype("<u4")
    train = np.add.reduceat((skip == 0)[doc].astype("<u4"), head).astype("<u4")
    two, one = (key[head] // m), key[head] % m
    of = two // m
    cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))  # the shards that have any
    tight = zstandard.ZstdCompressor(level=1)
    rows = [{"shard": number % shards, "block": number, "doc_ids": ids.to_pylist(), "n_tokens": n.tolist(), "held": skip.tobytes()}]
    for a, b in zip(cut, np.append(cut[1:], len(of)), strict=True):
        w = two[a:b] % m
        new = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        words = kinds[w[new]].astype("<u8")
        context = (kinds[one[a:b]] >> U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        runs = np.diff(np.append(new, b - a)).astype("<u4")
        body = words.tobytes() + runs.tobytes() + context.tobytes() + train[a:b].tobytes()
        echo = times[a:b].tobytes() + doc[head[a] : head[b] if b < len(head) else len(key)].astype("<u2").tobytes()
        rows.append({"shard": int(of[a]), "block": number, "sizes": [len(words), b - a], "body": tight.compress(body), "echo": tight.compress(echo)})
    schema = pa.schema([("shard", pa.int32()), *_ROW])
    for i in range(0, len(rows), 1000):
        yield pa.RecordBatch.from_pylist(rows[i : i + 1000], schema)


_ROW = [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("held", pa.binary()), ("sizes", pa.list_(pa.int32())), ("body", pa.binary()), ("echo", pa.binary())]


def _split(raw: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """Arrays laid end to end: their types and lengths; what is left over is the last one, where its length is -1."""
    out, at = [], 0
    for kind, n in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def _answers(rows: list[dict], hot: dict[int, int], n: int, v: int, mu: float) -> Iterator[dict]:
    """Builds the trie of one shard's training bigrams, looks all bigrams up, and answers every row."""
    loose = zstandard.ZstdDecompressor()
    asked = []
    for r in rows:
        words, runs, context, train = _split(loose.decompress(r.pop("body")), ("<u8", r["sizes"][0]), ("<u4", r["sizes"][0]), ("u1", 6 * r["sizes"][1]), ("<u4", r["sizes"][1]))
        wide = np.zeros((len(train), 8), np.uint8)
        wide[:, :6] = context.reshape(-1, 6)
        asked.append((words, runs, wide.view("<u8")[:, 0], train))
    kinds, place = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    runs = np.concatenate([a[1] for a in asked])
    w = np.repeat(place, runs)
    contexts, c = np.unique(np.concatenate([a[2] for a in asked]), return_inverse=True)
    train = np.concatenate([a[3] for a in asked])
    del asked
    count = np.bincount(w, train, len(kinds)).astype(np.int64)
    for k in np.flatnonzero(np.isin(kinds.view(np.int64), np.fromiter(hot, np.int64, len(hot)))):
        count[k] = hot[int(kinds.view(np.int64)[k])]
    share = mu * (count + 1) / (n + v + 1)
    seen = np.flatnonzero(train)
    pairs, at = np.unique(w[seen] * max(1, len(contexts)) + c[seen], return_inverse=True)
    both = np.bincount(at, train[seen], len(pairs))
    pw, pc = pairs // max(1, len(contexts)), pairs % max(1, len(contexts))
    raw = Trie.pack(kinds, contexts, pw, pc, np.round(GRID * np.log10(both + share[pw])))
    del seen, pairs, at, both, pw, pc, train
    level = mmap.mmap(-1, len(raw))
    level.write(raw)
    trie = Trie(level)
    unseen = np.round(GRID * np.log10(share))
    tight = zstandard.ZstdCompressor(level=1)
    at = word = 0
    for r in rows:
        a, b = r["sizes"]
        own, cs = w[at : at + b], c[at : at + b]
        # the search that a reader of a stored trie makes: by hash to places, then context-relative
        got = GRID * trie.lookup(trie.words.find(kinds[own]), trie.contexts.find(contexts[cs]))
        value = np.where(np.isnan(got), unseen[own], got).astype("<i2")
        mine = kinds[place[word : word + a]]
        end = np.flatnonzero(mine == END)
        body = count[place[word : word + a]].astype("<i8").tobytes() + runs[word : word + a].astype("<u4").tobytes() + value.tobytes()
        yield {"block": r["block"], "sizes": [a, b, int(end[0]) if len(end) else -1], "body": tight.compress(body), "echo": r["echo"]}
        at, word = at + b, word + a


def score_texts(docs: DataFrame, held_out=None, mu: float = 100.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram), score (bigram), both log10.

    ``held_out`` is the column that marks rows to score without learning from them."""
    held = fold(F.col("doc_id"), 7) == 2 if held_out is None else F.coalesce(held_out, F.lit(False))
    given = _given(docs, held)
    n, v, n_docs, hot, shards = _totals(given)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_memory()
        now, held_rows = None, []
        for b in batches:
            for i in range(len(b)):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if r["body"] is None:
                    yield pa.RecordBatch.from_pylist([r], pa.schema(_ROW))
                    continue
                if r["shard"] != now and held_rows:
                    yield pa.RecordBatch.from_pylist(list(_answers(held_rows, hot, n, v, mu)), pa.schema(_ROW))
                    held_rows = []
                now = r["shard"]
                held_rows.append(r)
        if held_rows:
            yield pa.RecordBatch.from_pylist(list(_answers(held_rows, hot, n, v, mu)), pa.schema(_ROW))

    def gather(table: pa.Table) -> pa.Table:
        meta = table.filter(table["doc_ids"].is_valid()).to_pylist()[0]
        tokens = np.array(meta["n_tokens"], np.int64)
        sums, known = np.zeros((2, len(tokens))), np.zeros(len(tokens), np.int64)
        loose = zstandard.ZstdDecompressor()
        for i in range(len(table)):
            r = {c: table[c][i].as_py() for c in ("sizes", "body", "echo")}
            if r["body"] is None:
                continue
            a, b, end = r["sizes"]
            count, runs, value = _split(loose.decompress(r["body"]), ("<i8", a), ("<u4", a), ("<i2", b))
            times, doc = _split(loose.decompress(r["echo"]), ("<u4", b), ("<u2", -1))
            as_context = np.log10(count + mu)
            if end >= 0:
                as_context[end] = 0.0
            log = np.repeat(value / GRID - np.repeat(as_context, runs), times)
            sums[0] += np.bincount(doc, log, len(tokens))
            each = np.repeat(np.repeat(np.arange(a), runs), times)
            sums[1] += np.bincount(doc, np.log10(count + 1)[each], len(tokens))
            known += np.bincount(doc, (count > 0)[each], len(tokens)).astype(np.int64)
        cols = [pa.array(meta["doc_ids"], pa.int64()), pa.array(np.frombuffer(meta["held"], np.uint8).astype(bool)), pa.array(tokens), pa.array(known), pa.array(np.full(len(tokens), n))]
        cols += [pa.array(sums[1] - tokens * np.log10(n + v + 1)), pa.array(sums[0] - np.log10(n_docs + mu))]
        return pa.Table.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    sent = _packets(given, hot, shards).repartition("shard").sortWithinPartitions("shard")
    return sent.mapInArrow(score, _ANSWER).groupBy("block").applyInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
