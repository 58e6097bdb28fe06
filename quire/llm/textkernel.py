"""Vectorised text kernels shared by the operators of this subpackage.

All of them work on one Arrow string column at a time, on the UTF-8 bytes in place: a batch is cut
into blocks of whole documents of about ``BLOCK`` bytes, and every step inside a block is a numpy
operation over bytes or words.  Hashes are 64 bits wide and depend on content only, so they agree
between executors and between runs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20
U = np.uint64


def return_memory() -> None:
    """From now on arrays of a megabyte and more go back to the system when they are freed: a worker that lives for many tasks
    holds what it uses, not what it once used.  It costs time, so only operators with large arrays ask for it."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words: anything but ASCII white space.
PLAIN = ~_SPACE
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
#: Bytes of lower-cased words made of ASCII digits, letters and anything beyond ASCII.
ALNUM = _ALNUM
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Block:
    """Whole documents laid out in one byte buffer, a space before, between and after them."""

    def __init__(self, parts: list[np.ndarray], first: int):
        self.first, self.n = first, len(parts)
        lens = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        self.begin = np.concatenate(([0], np.cumsum(lens + 1)))[:-1] + 1
        self.end = self.begin + lens
        buf = np.full(int(lens.sum()) + len(parts) + 1 + 8, 0x20, np.uint8)
        for p, b, e in zip(parts, self.begin, self.end, strict=True):
            buf[b:e] = p
        self.buf = buf
        self.size = len(buf) - 8


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """The documents of a column, nulls as empty texts, in blocks of about ``limit`` bytes."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield Block([raw[at[k] : at[k + 1]] for k in range(i, min(j, n))], i)
        i = min(j, n)


class Words:
    """The words of a block: start and end bytes, document, 64-bit hash; ``bounds[d]`` to
    ``bounds[d + 1]`` are the words of document d."""

    def __init__(self, block: Block, lower: bool = True, kind: np.ndarray = PLAIN, hashed: bool = True):
        self.block = block
        self.buf = LOWER[block.buf] if lower else block.buf
        is_word = kind[self.buf]
        edge = np.diff(is_word.view(np.int8))
        self.start = np.flatnonzero(edge == 1) + 1
        self.end = np.flatnonzero(edge == -1) + 1
        self.bounds = np.searchsorted(self.start, np.append(block.begin, block.size))
        self.doc = np.repeat(np.arange(block.n), np.diff(self.bounds))
        if hashed:
            self.hash = slices_hash(self.buf, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def slices_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of slices of a buffer that has eight spare bytes, eight bytes a step."""
    wide = np.ndarray(len(buf) - 7, "<u8", buf, 0, (1,))
    size = (end - start).astype(np.int64)
    h = size.astype(U) * U(0x9E3779B97F4A7C15)
    live, k = np.arange(len(start)), 0
    while len(live):
        left = size[live] - 8 * k
        x = wide[start[live] + 8 * k]
        cut = left < 8
        if cut.any():
            x[cut] &= (U(1) << (U(8) * left[cut].astype(U))) - U(1)
        h[live] = mix(h[live] * U(0xD6E8FEB86659FD93) + x + U(k + 1))
        k += 1
        live = live[left > 8]
    return h


_MULT = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows of ``n`` words inside one document, and the windows' hashes."""
    w = words.hash
    if len(w) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(words.doc[: len(w) - n + 1] == words.doc[n - 1 :])
    h = np.zeros(len(at), U)
    for i in range(n):
        h = h * _MULT[7] + w[at + i] * _MULT[i % 7]
    return at, mix(h)


def run_hasher(words: np.ndarray):
    """Hashes of runs of words a to b - 1: a polynomial, taken as a difference of running sums and scaled to its start."""
    odd = U(0x9E3779B97F4A7C15)
    power = np.full(len(words) + 1, odd, U)
    power[0] = 1
    power = np.cumprod(power)
    back = np.full(len(words) + 1, U(pow(int(odd), -1, 1 << 64)), U)
    back[0] = 1
    back = np.cumprod(back)
    run = np.concatenate((np.zeros(1, U), np.cumsum(mix(words) * power[:-1])))
    return lambda a, b: mix((run[b] - run[a]) * back[a] + mix((b - a).astype(U)))


def shingle_sets(words: Words, n: int = 5) -> list[np.ndarray]:
    """Each document's sorted distinct shingles; a document of fewer words has its sequence as one."""
    at, h = windows(words, n)
    cut = np.searchsorted(at, words.bounds)
    out = []
    for d in range(words.block.n):
        a, b = cut[d], cut[d + 1]
        if b > a:
            out.append(np.unique(h[a:b]))
        elif words.bounds[d + 1] > words.bounds[d]:
            s = U(0x51ED270B * (int(words.bounds[d + 1] - words.bounds[d])))
            for x in words.hash[words.bounds[d] : words.bounds[d + 1]]:
                s = mix(np.array([s ^ x], U) + _MULT[3])[0]
            out.append(np.array([s], U))
        else:
            out.append(np.zeros(0, U))
    return out


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive values between bounds."""
    c = np.concatenate(([0], np.cumsum(values)))
    return c[bounds[1:]] - c[bounds[:-1]]


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    off = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    if flat.dtype == U:
        flat = flat.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))
