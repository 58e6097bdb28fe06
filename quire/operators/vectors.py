"""Lines and checkboxes among the drawings of a page.

Segments are rows (page, drawing, segment, x1, y1, x2, y2, stroke_width, color), rectangles rows (page, drawing, x0, y0, x1, y1, color), in the units of the
page; ``scale`` turns them to pixels.  A null width is 1; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.spatial import touching
from quire.sources.elements import PAGE


def half_even(value: Column, digits: int) -> Column:
    """A double rounded to ``digits``, ties to even, in doubles alone: what counts as a tie is the scaled double, not the shortest decimal that stands for
    it (277.94850000000002 * 1000 is a tie, its decimal is not)."""
    return F.rint(value * float(10**digits)) / float(10**digits)


def vector_lines(segments: DataFrame, scale: float) -> DataFrame:
    """Every segment as a line element: its ends, its box (as thick as the stroke at least), its stroke of a pixel at least."""
    at = {c: half_even(F.col(c) * scale, 3) for c in ("x1", "y1", "x2", "y2")}
    width = F.expr("if(coalesce(stroke_width, 0) = 0, 1D, cast(stroke_width as double))")
    s = segments.withColumn("sw", width).withColumns(at)
    return s.select(
        *PAGE, F.concat_ws("_", F.lit("vector_line"), F.col("slide_number"), F.col("drawing"), F.col("segment")).alias("element_id"), F.expr("least(x1, x2)").alias("x"), F.expr("least(y1, y2)").alias("y"),
        F.expr("greatest(abs(x2 - x1), sw)").alias("width"), F.expr("greatest(abs(y2 - y1), sw)").alias("height"), "x1", "y1", "x2", "y2", F.expr(f"greatest(1D, sw * {scale}D)").alias("stroke_width"), F.col("color").alias("stroke_color"),
    )


def vector_checkboxes(rectangles: DataFrame, scale: float, low: float = 6, high: float = 25) -> DataFrame:
    """Small squares among the rectangles, checked where another drawing, not one just like it, covers a part of it.  Overlaps are found by cells."""
    r = rectangles.select(*PAGE, F.col("drawing").alias("element_id"), F.col("drawing").alias("ord"), F.lit("shape").alias("element_type"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.expr("x1 - x0").alias("width"), F.expr("y1 - y0").alias("height"), "color", "x1", "y1")
    w, h = f"(width * {scale}D)", f"(height * {scale}D)"
    box = r.where(f"{w} between {low} and {high} and {h} between {low} and {high} and {w} / {h} between 0.8 and 1.25")
    pairs = touching(r, ("element_id", "ord", "x", "y", "width", "height", "color", "x1", "y1"))
    cover = "least(a_x1, b_x1) > greatest(a_x, b_x) and least(a_y1, b_y1) > greatest(a_y, b_y)"
    same = "a_x = b_x and a_y = b_y and a_x1 = b_x1 and a_y1 = b_y1 and a_color <=> b_color"
    met = pairs.where(f"{cover} and not ({same})").select(*PAGE, F.col("a_element_id").alias("element_id"), F.lit(True).alias("checked")).distinct()
    out = box.join(met, [*PAGE, "element_id"], "left")
    return out.select(
        *PAGE, F.concat_ws("_", F.lit("vector_cb"), F.col("slide_number"), F.col("element_id")).alias("element_id"), F.expr(f"x * {scale}D").alias("x"), F.expr(f"y * {scale}D").alias("y"), F.expr(w).alias("width"), F.expr(h).alias("height"),
        F.coalesce("checked", F.lit(False)).alias("checked"), F.col("color").alias("stroke_color"),
    )
