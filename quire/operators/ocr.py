"""Repair, filtering and assembly of recognised text boxes.

A box is a row (page, element_id, ord, x, y, width, height, text, confidence).  Null texts count as empty; ties are broken by
``ord``; an empty table gives an empty result.  Greedy choices look at one page in one task: a page is a slide or a sheet,
and ``PAGE_LIMIT`` rows of it are the most that a task takes before it fails loudly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.folds import PAGE_LIMIT, bounded, rows_by_running_mean
from quire.operators.forms import CONTINUING, strip
from quire.operators.layout import islands
from quire.operators.spatial import touching
from quire.sources.elements import PAGE

#: Letters that are misread digits, and the signs of figures.
SUBSTITUTES = {"OoQq": "0", "Iil": "1", "Ss": "5", "B": "8"}
FIGURE_SIGNS = "$€£¥%.,+-/* "
#: Texts and patterns of program windows, and lone icons.
WINDOW_TEXTS = (
    "Menu", "Create", "All tools", "Edit", "Convert", "E-Sign", "Find text or tools", "Share", "Ask AI Assistant", "Ask Al Assistant", "View Summary", "Export a PDF", "Edit a PDF",
    "Create a PDF", "Combine files", "Organize pages", "AI Assistant", "Al Assistant", "Generative summary", "Request e-signatures", "Scan & OCR", "Protect a PDF", "Free trial", "Sign in",
    "Sign `", "All Bookmarks", "New Tab", "PM", "AM",
)
WINDOW_PATTERNS = (
    r"^[0-9]{1,2}:[0-9]{2}\s*(AM|PM)$", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$", r"^[0-9]+%$", r"^Sign\s", r"^By using this service", r"^This appears to be a long", r"^Convert[;,] edit", r"terms of use",
    r"privacy policy", r"save time by reading", r"e-sign pdf forms",
)
ICONS = ("@", "G", "E", "X", "×")
#: Short texts that are values of their own.
VALUES = ("TBD", "N/A", "Yes", "No")


def steps(column: Column, *each: Callable[[Column], Column]) -> Column:
    """Applies steps one after the other; a lambda between them keeps each step's input from being computed twice."""
    return reduce(lambda c, step: F.element_at(F.transform(F.array(c), step), 1), each, column)


def currency_repair(column: Column) -> Column:
    """Amounts as they were printed: dollar signs read as S, 5 or 8, zeros read as o or C, ranges read with underscores."""
    sub = lambda pattern, to: lambda t: F.regexp_replace(t, pattern, to)
    lead = lambda pattern: lambda t: F.when(t.rlike(pattern), F.concat(F.lit("$"), F.substr(t, F.lit(2)))).otherwise(t)

    def zeros(t: Column) -> Column:
        fixed = reduce(lambda c, p: F.regexp_replace(c, p, "0"), (r"(?<=[0-9])[oO](?=[0-9])", r"(?<=[0-9])[oO](?=[,.])", r"(?<=[,.])[oO](?=[0-9])"), t)
        return F.when(t.rlike(r"^[S$0-9]"), fixed).otherwise(t)

    def spaced(t: Column) -> Column:
        tight = F.concat(F.lit("$"), F.substr(F.translate(t, "oO ", "00"), F.lit(2)))
        return F.when(t.rlike(r"^[S5][0-9]{2},\s*[0-9]"), tight).otherwise(t)

    six = lambda t: F.when(F.startswith(t, F.lit("Ss")), F.concat(F.lit("$6"), F.substr(t, F.lit(3)))).otherwise(t)
    return steps(
        strip(F.coalesce(column, F.lit(""))), sub(r"^[S5]([0-9]{1,3}(?:[,. ][0-9]{3})+)$", r"\$$1"), zeros, lead(r"^5[0-9]{2,3},[0-9]{3}"), lead("^S[0-9]"), spaced,
        lead("^8[0-9]{3},[0-9]{3}$"), sub(r"(?<=[0-9])[Cc](?=[0-9])", "0"), six, sub(r"\s*_\s*", " – "),
    )


def numeric_repair(column: Column) -> Column:
    """Letters that stand for digits, replaced beside figures in texts that are mostly figures; other texts stay as they are."""
    letters = "".join(SUBSTITUTES)
    digits = "".join(to * len(k) for k, to in SUBSTITUTES.items())
    beside = lambda c: F.coalesce(c.rlike("^[0-9.,$%]$"), F.lit(False))

    def fix(t: Column) -> Column:
        chars = F.split(t, "(?!^)")
        count = lambda keep: F.length(F.regexp_replace(t, keep, ""))
        known, unsure = count(r"[^0-9$€£¥%.,+\-/* ]"), count(f"[^{letters}]")
        all_ = (F.length(t) <= 5) & (known + unsure == F.length(t))
        one = lambda c, i: F.when(all_ | beside(F.get(chars, i - 1)) | beside(F.get(chars, i + 1)), F.translate(c, letters, digits)).otherwise(c)
        return F.when(known + 2 * unsure > F.length(t), F.array_join(F.transform(chars, one), ""))

    return F.coalesce(steps(strip(column), fix), column)


def window_text(column: Column) -> Column:
    """Whether a text belongs to a program's window and not to the page."""
    t = strip(F.coalesce(column, F.lit("")))
    return t.isin(*WINDOW_TEXTS) | t.rlike("(?i)" + "|".join(WINDOW_PATTERNS)) | t.isin(*ICONS)


def column_positions(boxes: DataFrame, tolerance: float) -> DataFrame:
    """(page, column_no, position, members): centres in x, a new column where the gap to the one before is larger; all count in the mean."""
    at = boxes.select(*PAGE, "ord", (F.col("x") + F.col("width") / 2).alias("cx"))
    by = Window.partitionBy(*PAGE).orderBy("cx", "ord")
    cut = islands(at.withColumn("before", F.lag("cx").over(by)), PAGE, ["cx", "ord"], F.expr(f"cx - before > {tolerance}D"), "column_no")
    return cut.groupBy(*PAGE, "column_no").agg(F.avg("cx").alias("position"), F.count("*").alias("members"))


def table_from_boxes(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """(page, row, col, text): low boxes with a text as a table, of pages with six of them, three rows and two columns.

    Rows are runs around a running mean, columns are ``column_positions``; a box goes to the nearest column unless that is
    a twentieth of the width away, and shares its cell with boxes before it."""
    low = boxes.withColumn("text", strip(F.coalesce("text", F.lit("")))).where((F.col("text") != "") & (F.col("height") < 0.05 * height))
    low = low.withColumn("boxes", F.count("*").over(Window.partitionBy(*PAGE))).where("boxes >= 6")
    rows = low.join(rows_by_running_mean(low, 0.02 * height), [*PAGE, "element_id"]).withColumn("rows", F.max("row").over(Window.partitionBy(*PAGE))).where("rows >= 3")
    cols = column_positions(rows, 0.03 * width).withColumn("columns", F.count("*").over(Window.partitionBy(*PAGE))).where("columns >= 2")
    cols = cols.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("column_no", "position"))).alias("cols"))
    met = rows.join(cols, PAGE).withColumn("cx", F.col("x") + F.col("width") / 2)
    near = F.array_min(F.transform("cols", lambda c: F.struct(F.abs(F.col("cx") - c["position"]).alias("d"), c["column_no"].alias("col"))))
    met = met.withColumn("near", near).where(F.col("near.d") < 0.05 * width)
    cell = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((F.col("y") + F.col("height") / 2).alias("cy"), "ord", "text"))), lambda s: s["text"]), " ")
    return met.groupBy(*PAGE, "row", F.col("near.col").alias("col")).agg(cell.alias("text"))


def dedup_boxes(boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """(page, element_id) of the boxes that stay: from first to last, a box takes out every later one that it covers by more
    than ``share`` of the smaller and that it is not less sure than, and leaves at the first that is surer; what it took out stays out."""

    sure = boxes.withColumn("confidence", F.col("confidence").cast("double"))
    both = "greatest(0D, least(a_x + a_width, b_x + b_width) - greatest(a_x, b_x)) * greatest(0D, least(a_y + a_height, b_y + b_height) - greatest(a_y, b_y))"
    pairs = touching(sure, ("element_id", "ord", "x", "y", "width", "height", "confidence")).where(f"a_ord < b_ord and {both} > {share} * least(a_width * a_height, b_width * b_height)")
    given = pairs.select(*PAGE, "a_ord", "b_ord", F.expr("b_confidence > a_confidence").alias("surer"), F.col("a_element_id").alias("a"), F.col("b_element_id").alias("b"))

    def out(page: pd.DataFrame) -> pd.DataFrame:
        """Only covering pairs come here: what leaves, from first to last."""
        gone: dict = {}
        for at, own in page.sort_values(["a_ord", "b_ord"]).groupby("a_ord", sort=True):
            if at in gone:
                continue
            for r in own.itertuples():
                if r.b_ord in gone:
                    continue
                if r.surer:
                    gone[at] = r.a
                    break
                gone[r.b_ord] = r.b
        return pd.DataFrame({**{c: [page[c].iloc[0]] * len(gone) for c in PAGE}, "element_id": list(gone.values())})

    left = boxes.select(*PAGE, "element_id")
    return left.join(given.groupBy(*PAGE).applyInPandas(out, left.schema), [*PAGE, "element_id"], "left_anti")


def continues(a: str, b: str) -> bool:
    """Whether text ``b`` goes on with text ``a``; the rule of ``forms.continues``, for texts that grow while they are merged."""
    a, b = a.strip(), b.strip()
    figure = lambda t: bool(t) and t[1 if t[0] in "$S5" and len(t) > 1 and t[1].isdigit() else 0].isdigit()
    if len(a) < 12 and len(b) < 12 and ((figure(a) and figure(b)) or a in VALUES or b in VALUES):
        return False
    if a and a[-1] not in ".!?:" and b and b[0].islower():
        return True
    words = a.split()
    return bool(words) and words[-1].lower() in CONTINUING


def merge_fragments(boxes: DataFrame, consume: bool = True) -> DataFrame:
    """Boxes on one line that continue each other, as one box (first_id, text, x, y, width, height, confidence, parts).

    From (y, x) order, a box looks for later ones that overlap it in y by half of the lower, start behind its end by less than
    three of its heights, and continue its text.  ``consume`` keeps merged fragments from standing again on their own."""

    def merge(page: pd.DataFrame) -> pd.DataFrame:
        page = bounded(page.sort_values(["y", "x", "ord"], ignore_index=True))
        rows, used = page.to_dict("records"), [False] * len(page)
        out = []
        for i, r in enumerate(rows):
            if used[i]:
                continue
            text, end, own = r["text"], r["x"] + r["width"], [r]
            top, low, size = r["y"], r["y"] + r["height"], r["height"]
            for j in range(i + 1, len(rows)):
                n = rows[j]
                if n["y"] >= low:
                    break
                least = min(size, n["height"]) if min(size, n["height"]) > 0 else 1
                both = (min(low, n["y"] + n["height"]) - max(top, n["y"])) / least
                if not used[j] and both > 0.5 and 0 < n["x"] - end < 3 * size and continues(text, n["text"]):
                    own.append(n)
                    used[j] = consume
                    end, text = n["x"] + n["width"], text + " " + n["text"]
            x, y = min(o["x"] for o in own), min(o["y"] for o in own)
            out.append({
                **{c: r[c] for c in PAGE}, "first_id": r["element_id"], "text": " ".join(o["text"] for o in own), "x": x, "y": y, "width": max(o["x"] + o["width"] for o in own) - x,
                "height": max(o["y"] + o["height"] for o in own) - y, "confidence": min(o["confidence"] for o in own), "parts": len(own),
            })
        return pd.DataFrame(out)

    given = boxes.select(*PAGE, "element_id", "ord", "x", "y", "width", "height", F.coalesce("text", F.lit("")).alias("text"), F.col("confidence").cast("double").alias("confidence"))
    kind = dict(given.dtypes)
    return given.groupBy(*PAGE).applyInPandas(merge, ", ".join(f"{c} {kind[c]}" for c in PAGE) + f", first_id {kind['element_id']}, text string, x double, y double, width double, height double, confidence double, parts long")


def not_mostly_text(shapes: DataFrame, texts: DataFrame, share: float = 0.45) -> DataFrame:
    """Shapes of which no text of their page covers more than ``share`` of the smaller box."""
    s = shapes.select(*PAGE, "element_id", "x", "y", "width", "height").alias("s")
    t = texts.select(*PAGE, F.col("element_id").alias("text_id"), *(F.col(c).alias(f"t_{c}") for c in ("x", "y", "width", "height"))).alias("t")
    wide = "least(x + width, t_x + t_width) - greatest(x, t_x)"
    high = "least(y + height, t_y + t_height) - greatest(y, t_y)"
    hit = f"text_id <> element_id and {wide} > 0 and {high} > 0 and ({wide}) * ({high}) > {share}D * least(width * height, t_width * t_height)"
    on = [F.col(f"s.{c}") == F.col(f"t.{c}") for c in PAGE]
    return s.join(t, [*on, F.expr(hit)], "left_anti")


__all__ = ["PAGE_LIMIT", "column_positions", "currency_repair", "dedup_boxes", "merge_fragments", "not_mostly_text", "numeric_repair", "table_from_boxes", "window_text"]
