"""Fill-in-the-middle by a two-pass streaming matcher.

A text is cut into units by a pattern whose matches cover it.  The first pass counts the units; two ranks drawn from a hash of the
document's id say after which units the prefix and the middle end.  The second pass advances one lazy match iterator
to the smaller rank and on to the larger one, and notes where it stands.  No array of units exists at any time: besides
the text and the output a task holds one match.

Defined results: a null text is empty, and plain; a text that contains a sentinel is plain; a null id counts as the empty text
in the hash, so rows without an id are cut alike; repeated rows each get their row; an empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of outputs that leave a task at once.
OUT = 1 << 20
FIELDS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Middle:
    """How texts are turned: the units, the three sentinels, the hash's seed, per cent of texts that are turned, and of these per cent in
    the order suffix, prefix, middle."""

    unit: str = r"[^\n]*\n|[^\n]+"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 7
    rate: int = 100
    spm_rate: int = 50

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        for a in marks:
            # the first place of a sentinel in an output is then its own, whatever stands beside it
            if not a or any(a != b and a in b for b in marks) or any(a[:k] == b[-k:] for b in marks for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError("no sentinel may be empty, or begin as one ends")
        if len(set(marks)) < 3:
            raise ValueError("the sentinels must differ")

    def draws(self, doc_id: int | None) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]

    def turn(self, doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
        """Units, form, code points of prefix and middle, and output of one text."""
        units = re.compile(self.unit)
        n = sum(1 for _ in units.finditer(text))
        h1, h2, h3, h4 = self.draws(doc_id)
        if not text or self.prefix in text or self.suffix in text or self.middle in text or h3 % 100 >= self.rate:
            return n, "plain", None, None, text
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        lazy = units.finditer(text)
        a = _advance(lazy, low, 0)
        b = _advance(lazy, high - low, a)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < self.spm_rate:
            return n, "spm", a, b - a, f"{self.suffix}{suffix}{self.prefix}{prefix}{self.middle}{middle}"
        return n, "psm", a, b - a, f"{self.prefix}{prefix}{self.suffix}{suffix}{self.middle}{middle}"

    def restore(self, output: str, form: str) -> str:
        """The text that an output was made of."""
        if form == "plain":
            return output
        first, second = (self.prefix, self.suffix) if form == "psm" else (self.suffix, self.prefix)
        one, _, rest = output[len(first) :].partition(second)
        two, _, middle = rest.partition(self.middle)
        return one + middle + two if form == "psm" else two + middle + one


def _advance(matches: Iterator[re.Match], k: int, at: int) -> int:
    """Where the k-th further match ends; ``at`` where k is 0."""
    last = deque(islice(matches, k), maxlen=1)
    return last[0].end() if last else at


def fill_in_middle(docs: DataFrame, how: Middle | None = None) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``; no shuffle."""
    how = how or Middle()

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows.append((doc_id, *how.turn(doc_id, text.as_py() or "")))
                chars += len(rows[-1][-1])
                if chars > OUT:
                    yield _batch(rows)
                    rows, chars = [], 0
        if rows:
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(turned, FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if kind == "string" else pa.int64()) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [f[0] for f in fields])


def restored(turned: DataFrame, how: Middle | None = None) -> DataFrame:
    """``turned`` with the texts rebuilt from output and form alone, as column ``restored``; in DataFrame functions, apart from the matcher."""
    how = how or Middle()
    form, out = F.col("form"), F.col("output")
    first = F.when(form == "psm", how.prefix).otherwise(how.suffix)
    second = F.when(form == "psm", how.suffix).otherwise(how.prefix)
    rest = F.substring(out, F.length(first) + 1, F.length(out))
    cut = F.instr(rest, second)
    one = F.substring(rest, F.lit(1), cut - 1)
    tail = F.substring(rest, cut + F.length(second), F.length(rest))
    mid = F.instr(tail, F.lit(how.middle))
    two, middle = F.substring(tail, F.lit(1), mid - 1), F.substring(tail, mid + len(how.middle), F.length(tail))
    text = F.when(form == "plain", out).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return turned.withColumn("restored", text)
