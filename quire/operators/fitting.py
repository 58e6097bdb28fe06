"""Texts shrunk until they fit their box: a wrap by measured width, and the largest font size whose lines fit.

The height of wrapped lines does not fall as the font grows, so the size is found by bisection over the steps; widths are summed once a text, and each
line's last word is found in the running sums, so a wrap costs a look-up a line.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Advances of a common sans-serif font (Helvetica's metrics), in 1/1000 of the font size, by characters that share one.
ADVANCES = (
    (191, "'"), (222, "ijl"), (260, "|"), (278, " !,./:;I[\\]ft"), (333, "()-`r"), (334, "{}"), (355, '"'), (389, "*"), (469, "^"), (500, "Jcksvxyz"), (556, "#$0123456789?L_abdeghnopqu"),
    (584, "+<=>~"), (611, "FTZ"), (667, "&ABEKPSVXY"), (722, "CDHNRUw"), (778, "GOQ"), (833, "Mm"), (889, "%"), (944, "W"), (1015, "@"),
)
#: The advance of other characters, and of East Asian ones.
OTHER, FULL = 556, 1000
_TABLE = {c: a for a, chars in reversed(ADVANCES) for c in chars}
LINE_HEIGHT = 1.2


def advance(c: str) -> int:
    known = _TABLE.get(c)
    return known if known is not None else FULL if "⺀" <= c <= "￯" and not "｡" <= c <= "ￜ" else OTHER


class Measured:
    """A text's paragraphs with the running sums of their words' widths, in 1/1000 of the font size."""

    def __init__(self, text: str):
        self.paragraphs: list[tuple[list[str], list[int], list[int]]] = []
        self.plain = text.split("\n")
        widths: dict[str, int] = {}
        for part in self.plain:
            words = part.split()
            for w in words:
                if w not in widths:
                    widths[w] = sum(map(advance, w))
            # ends[j]: where word j ends if all stood on one line; begins[i]: where word i begins there
            ends = list(accumulate((widths[w] + _TABLE[" "] for w in words), initial=0))[1:]
            self.paragraphs.append((words, [0, *ends], [e - _TABLE[" "] for e in ends]))

    def breaks(self, limit: float) -> list[list[int]]:
        """By paragraph the first words of its lines of at most ``limit``; a longer word stands alone, a paragraph without words is a line."""
        out = []
        for words, begins, ends in self.paragraphs:
            at, i = [0], 0
            while words:
                i = max(bisect_right(ends, begins[i] + limit), i + 1)
                if i >= len(words):
                    break
                at.append(i)
            out.append(at)
        return out

    def lines(self, limit: float) -> list[str]:
        return [" ".join(words[a:b]) for (words, *_), at in zip(self.paragraphs, self.breaks(limit), strict=True) for a, b in zip(at, [*at[1:], len(words)], strict=True)]


def fit(text: str, width: float, height: float, size: float, least: float = 6.0, step: float = 0.5) -> tuple[float, bool, list[str]]:
    """The largest of the sizes ``size``, ``size - step``, ... down to ``least`` whose lines fit the box, else ``least``; whether they fit; the lines.
    A box without width does not wrap."""
    m = Measured(text)
    count = lambda s: len(m.plain) if width <= 0 else sum(map(len, m.breaks(width * 1000 / s)))
    fits = lambda s: count(s) * s * LINE_HEIGHT <= height
    last = int((size - least) / step) if size >= least else -1
    low, high = 0, last + 1  # the first step that fits is in here; last + 1: none
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(size - mid * step) else (mid + 1, high)
    best = size - low * step if low <= last else least
    return best, fits(best), m.plain if width <= 0 else m.lines(width * 1000 / best)


def fitted(texts: DataFrame, least: float = 6.0, step: float = 0.5) -> DataFrame:
    """``texts`` (text, box_width, box_height, start_size) with ``fit``: (font_size, fits, lines).  A null text is empty, a null size or side 0."""

    @F.pandas_udf("font_size double, fits boolean, lines array<string>")
    def fit_all(text: pd.Series, width: pd.Series, height: pd.Series, size: pd.Series) -> pd.DataFrame:
        rows = [fit(t, w, h, s, least, step) for t, w, h, s in zip(text, width, height, size, strict=True)]
        return pd.DataFrame(rows, columns=["font_size", "fits", "lines"])

    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return texts.withColumn("fit", fit_all(F.coalesce("text", F.lit("")), number("box_width"), number("box_height"), number("start_size")))
