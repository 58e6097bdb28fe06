"""Tables from ruled lines: a lattice of snapped rules, their crossings, the cells between them and the texts inside.

Rules and texts are rows of a page (document_id, slide_number); a page's rules meet in buckets of its width, so crossings cost what there is to
find.  Rules that touch, directly or by others, are one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.graphs import connected
from quire.sources.elements import PAGE
from quire.sources.tables import kept

#: Width of a bucket in which rules, cells and texts of a page meet, in points.
BUCKET = 100.0


def _buckets(low: str, high: str):
    return F.explode(F.expr(f"sequence(cast(floor(({low}) / {BUCKET}) as int), cast(floor(({high}) / {BUCKET}) as int))"))


def straight_lines(segments: DataFrame, slack: float = 2.0) -> DataFrame:
    """(page, direction, at, lo, hi): segments (page, x1, y1, x2, y2) that are horizontal or vertical, with less than ``slack`` between their ends."""
    kind = F.expr(f"case when abs(y1 - y2) < {slack} then 'horizontal' when abs(x1 - x2) < {slack} then 'vertical' end")
    h = F.col("direction") == "horizontal"
    pick = lambda a, b: F.when(h, F.expr(a)).otherwise(F.expr(b))
    out = segments.withColumn("direction", kind).where("direction is not null")
    return out.select(*PAGE, "direction", pick("(y1 + y2) / 2", "(x1 + x2) / 2").alias("at"), pick("least(x1, x2)", "least(y1, y2)").alias("lo"), pick("greatest(x1, x2)", "greatest(y1, y2)").alias("hi"))


def grid_size(segments: DataFrame) -> DataFrame:
    """(page, rows, columns): the horizontal and the vertical lines of a page."""
    return straight_lines(segments).groupBy(*PAGE).agg(F.count_if(F.col("direction") == "horizontal").alias("rows"), F.count_if(F.col("direction") == "vertical").alias("columns"))


def rules(segments: DataFrame, snap: float = 3.0) -> DataFrame:
    """(page, rule, direction, at, lo, hi): straight lines, those of nearly one place put on their mean place, and those that meet or overlap there made one;
    ``rule`` numbers a page's rules."""
    by = Window.partitionBy(*PAGE, "direction").orderBy("at")
    lines = straight_lines(segments)
    lines = lines.withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(by) > snap).cast("int"), F.lit(1)))
    lines = lines.withColumn("place", F.sum("new").over(by.rangeBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*PAGE, "direction", "place").orderBy("lo", "hi")
    reach = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("new", F.when(F.col("lo") - reach <= snap, 0).otherwise(1)).withColumn("part", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("at", F.avg("at").over(Window.partitionBy(*PAGE, "direction", "place")))
    out = lines.groupBy(*PAGE, "direction", "place", "part").agg(F.first("at").alias("at"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    name = F.row_number().over(Window.partitionBy(*PAGE).orderBy("direction", "place", "part")).cast("long")
    return out.select(*PAGE, name.alias("rule"), "direction", "at", "lo", "hi")


def crossings(lines: DataFrame, snap: float = 3.0) -> DataFrame:
    """(page, h, v, x, y, right, down): where rules cross or touch, and whether they go on to the right and down from there."""
    h = lines.where("direction = 'horizontal'").select(*PAGE, F.col("rule").alias("h"), F.col("at").alias("y"), F.col("lo").alias("h1"), F.col("hi").alias("h2"), _buckets(f"lo - {snap}", f"hi + {snap}").alias("bucket"))
    v = lines.where("direction = 'vertical'").select(*PAGE, F.col("rule").alias("v"), F.col("at").alias("x"), F.col("lo").alias("v1"), F.col("hi").alias("v2"), F.expr(f"cast(floor(at / {BUCKET}) as int)").alias("bucket"))
    met = h.join(v, [*PAGE, "bucket"]).where(f"x between h1 - {snap} and h2 + {snap} and y between v1 - {snap} and v2 + {snap}")
    return met.select(*PAGE, "h", "v", "x", "y", F.expr(f"h2 > x + {snap}").alias("right"), F.expr(f"v2 > y + {snap}").alias("down"))


def cells(segments: DataFrame, snap: float = 3.0) -> DataFrame:
    """(page, table_id, row, col, row_span, col_span, x, y, width, height): the smallest rectangle that each crossing is the upper left corner of.

    It ends where on the way right a rule first leads down, and on the way down one first leads right, if those two rules cross.
    ``table_id`` is the table's first rule; rows and columns count its places from the top and from the left."""
    at = kept(crossings(kept(rules(segments, snap), "rules"), snap), "crossings")
    along, below = Window.partitionBy(*PAGE, "h").orderBy("x"), Window.partitionBy(*PAGE, "v").orderBy("y")
    ahead = (1, Window.unboundedFollowing)
    # dealt out by page once, for the windows along and below
    corner = at.repartition(*PAGE).withColumns({
        "r": F.first(F.when(F.col("down"), F.struct("v", "x")), ignorenulls=True).over(along.rowsBetween(*ahead)),
        "d": F.first(F.when(F.col("right"), F.struct("h", "y")), ignorenulls=True).over(below.rowsBetween(*ahead)),
        # the last rule to the right leads nowhere further down, the last one below nowhere further right
        "r_end": F.last(F.struct("v", "x")).over(along.rowsBetween(*ahead)), "d_end": F.last(F.struct("h", "y")).over(below.rowsBetween(*ahead)),
    }).where("right and down")
    corner = corner.withColumns({"r": F.coalesce("r", "r_end"), "d": F.coalesce("d", "d_end")}).where("r is not null and d is not null")
    closed = at.select(*PAGE, F.col("h").alias("h2"), F.col("v").alias("v2"))
    boxes = corner.select(*PAGE, "h", "x", "y", F.col("r.v").alias("v2"), F.col("r.x").alias("x2"), F.col("d.h").alias("h2"), F.col("d.y").alias("y2")).join(closed, [*PAGE, "h2", "v2"])
    table = connected(at.select(*PAGE, F.col("h").alias("a"), F.col("v").alias("b")), list(PAGE)).select(*PAGE, F.col("node").alias("h"), "root")
    first = table.groupBy(*PAGE, "root").agg(F.min("h").alias("table_id"))
    boxes = kept(boxes.join(table, [*PAGE, "h"]).join(first, [*PAGE, "root"]).select(*PAGE, "table_id", "x", "y", "x2", "y2"), "boxes")
    for low, high, index, span in (("y", "y2", "row", "row_span"), ("x", "x2", "col", "col_span")):
        places = boxes.select(*PAGE, "table_id", F.explode(F.array(low, high)).alias("place")).distinct()
        places = places.withColumn("n", F.row_number().over(Window.partitionBy(*PAGE, "table_id").orderBy("place")) - 1)
        for c, name in ((low, index), (high, f"{index}_end")):
            boxes = boxes.join(places.select(*PAGE, "table_id", F.col("place").alias(c), F.col("n").alias(name)), [*PAGE, "table_id", c])
        boxes = boxes.withColumn(span, F.col(f"{index}_end") - F.col(index))
    return boxes.select(*PAGE, "table_id", "row", "col", "row_span", "col_span", "x", "y", F.expr("x2 - x").alias("width"), F.expr("y2 - y").alias("height"))


def filled_cells(segments: DataFrame, texts: DataFrame, snap: float = 3.0) -> DataFrame:
    """``cells`` with ``text``: the texts (page, ord, x, y, width, height, text) whose centre is inside, in order of y, x and ord, trimmed, with spaces between."""
    found = kept(cells(segments, snap), "cells")
    spots = texts.where("trim(text) <> ''").select(*PAGE, "ord", F.expr("trim(text)").alias("text"), F.expr("x + width / 2").alias("cx"), F.expr("y + height / 2").alias("cy"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    wide = found.select(*PAGE, "table_id", "row", "col", "x", "y", "width", "height", _buckets("x", "x + width").alias("bucket"))
    inside = wide.join(spots.withColumn("bucket", F.expr(f"cast(floor(cx / {BUCKET}) as int)")), [*PAGE, "bucket"]).where("cx >= x and cx < x + width and cy >= y and cy < y + height")
    said = inside.groupBy(*PAGE, "table_id", "row", "col").agg(F.expr("array_join(transform(array_sort(collect_list(struct(ty, tx, ord, text))), s -> s.text), ' ')").alias("text"))
    return found.join(said, [*PAGE, "table_id", "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def string_matrix(filled: DataFrame) -> DataFrame:
    """(page, table_id, row, texts): a table's rows as lists of strings, empty where a slot belongs to a cell that begins elsewhere or to none."""
    size = filled.groupBy(*PAGE, "table_id").agg(F.max(F.expr("row + row_span")).alias("rows"), F.max(F.expr("col + col_span")).alias("columns"))
    slots = size.withColumn("row", F.explode(F.expr("sequence(0, rows - 1)"))).select(*PAGE, "table_id", "row", "columns")
    own = filled.groupBy(*PAGE, "table_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("by"))
    return slots.join(own, [*PAGE, "table_id", "row"], "left").select(*PAGE, "table_id", "row", F.expr("transform(sequence(0, columns - 1), c -> coalesce(by[c], ''))").alias("texts"))
