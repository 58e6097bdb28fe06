"""The form page: page geometry in pixels, elements in draw order, cells and grid lines of tables.

Pixels are CSS pixels: points times 96 / 72, EMU divided by 9,525, or the given unit itself.  Lengths are rounded half to even at
three places and clamped at 0.  Nulls count as missing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.classify import first_of, tick_state
from quire.operators.ocr import numeric_repair
from quire.sources.elements import PAGE

#: Pixels a point, EMU a pixel, words of signature lines.
PER_POINT, EMU = 96.0 / 72.0, 9525.0
SIGNATURE_WORDS = ("signature", "sign here", "initials", "authorized signature", "approval")


def _r(c: Column) -> Column:
    return F.bround(c, 3)


def page_geometry(pages: DataFrame) -> DataFrame:
    """(page, page_width, page_height, scale, orientation, rotation, dpi) of pages with rect_width and rect_height (points), slide_width and slide_height
    (EMU), reach_x and reach_y (what their elements reach) and rotation: the first size that is there decides the unit."""
    rect = (F.coalesce("rect_width", F.lit(0.0)) != 0) & (F.coalesce("rect_height", F.lit(0.0)) != 0)
    slide = (F.coalesce("slide_width", F.lit(0.0)) != 0) & (F.coalesce("slide_height", F.lit(0.0)) != 0)
    size = lambda a, b, c: _r(F.when(rect, F.col(a) * PER_POINT).when(slide, F.col(b) / EMU).otherwise(F.coalesce(c, F.lit(1.0))))
    scale = F.when(rect, PER_POINT).when(slide, 1.0 / EMU).otherwise(1.0)
    out = pages.select(*PAGE, size("rect_width", "slide_width", "reach_x").alias("page_width"), size("rect_height", "slide_height", "reach_y").alias("page_height"), scale.alias("scale"), F.coalesce("rotation", F.lit(0.0)).alias("rotation"))
    shape = F.when(F.abs(F.col("page_width") - F.col("page_height")) < 0.01, "square").when(F.col("page_width") > F.col("page_height"), "landscape").otherwise("portrait")
    return out.withColumns({"orientation": shape, "dpi": F.bround(72.0 * F.col("scale"), 2)})


def form_elements(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Elements of pages with geometry, in draw order (z_order, y, x): pixel boxes, type, line ends, check state, layer, shares of the page.

    Thin shapes become lines through their middle; texts that are a check box become one; figures are repaired."""
    order = Window.partitionBy(*PAGE).orderBy(F.coalesce("z_order", F.lit(0)), "y", "x", "ord")
    e = elements.withColumn("reading_order", F.row_number().over(order) - 1).join(pages.select(*PAGE, "page_width", "page_height", "scale"), PAGE)
    box = {f"p{c}": _r(F.greatest(F.lit(0.0), F.col(c) * F.col("scale"))) for c in ("x", "y", "width", "height")}
    e = e.withColumns(box).withColumn("text", numeric_repair(F.col("text")))
    kind, w, h = F.col("element_type"), F.col("pwidth"), F.col("pheight")
    real = (kind == "shape") & (w > 0) & (h > 0)
    flat = real & (h <= F.greatest(F.lit(3.0), w * 0.08))
    tall = real & ~flat & (w <= F.greatest(F.lit(3.0), h * 0.08))
    tick = F.when(kind.isin("text_box", "text"), tick_state(F.coalesce("text", F.lit(""))))
    e = e.withColumns({
        "type": F.when(flat | tall, "line").when(tick.isNotNull(), "checkbox").otherwise(kind), "checked": tick,
        "x1": F.when(tall, _r(F.col("px") + w / 2)).when(flat | (kind == "line"), F.col("px")), "y1": F.when(flat, _r(F.col("py") + h / 2)).when(tall | (kind == "line"), F.col("py")),
        "x2": F.when(tall, _r(F.col("px") + w / 2)).when(flat | (kind == "line"), _r(F.col("px") + w)), "y2": F.when(flat, _r(F.col("py") + h / 2)).when(tall | (kind == "line"), _r(F.col("py") + h)),
        "stroke_width": F.when(flat, F.greatest(F.lit(1.0), h)).when(tall, F.greatest(F.lit(1.0), w)).when(kind == "line", F.greatest(F.lit(1.0), F.least(w, h))),
        "filled": F.when(kind.isin("text_field", "signature", "stamp", "seal"), F.coalesce("text", F.lit("")) != ""),
    })
    share = w * h / (F.col("page_width") * F.col("page_height"))
    small = (F.col("type") == "shape") & (w < 48) & (h < 48)
    area = F.col("type").isin("shape", "rectangle", "group")
    layer = first_of([
        ("Images", F.col("type") == "image"), ("Tables", F.col("type") == "table"), ("Lines", F.col("type").isin("line", "connector")), ("Text", F.col("type").isin("text_box", "text")), ("Icons", small),
        ("Background", area & (share > 0.8)), ("Large panels", area & (share > 0.25)),
    ], "Shapes")
    part = lambda c, total: F.when(F.col(total) > 0, F.bround(F.col(c) / F.col(total), 5)).otherwise(0.0)
    return e.select(
        *PAGE, "element_id", "type", "reading_order", F.coalesce(F.col("z_order"), F.col("reading_order")).cast("long").alias("z_order"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pwidth").alias("width"), F.col("pheight").alias("height"),
        "text", "checked", "filled", "x1", "y1", "x2", "y2", "stroke_width", layer.alias("layer"), part("px", "page_width").alias("x_share"), part("py", "page_height").alias("y_share"),
        part("pwidth", "page_width").alias("width_share"), part("pheight", "page_height").alias("height_share"),
    )


def signature_boxes(form: DataFrame) -> DataFrame:
    """A field above every text of a form that names a signature."""
    text = F.lower(F.coalesce("text", F.lit("")))
    found = form.where(F.col("type").isin("text_box", "text") & text.rlike("|".join(SIGNATURE_WORDS)))
    return found.select(
        *PAGE, F.concat(F.lit("sig_field_"), F.col("slide_number").cast("string"), F.lit("_"), F.col("element_id").cast("string")).alias("field_id"), "x", F.greatest(F.lit(0.0), F.col("y") - 30).alias("y"),
        F.greatest(F.lit(120.0), F.col("width")).alias("width"), F.lit(25.0).alias("height"), (F.col("z_order") + 1).alias("z_order"), F.lit(0.9).alias("confidence"),
    )


def first_merges(merges: DataFrame) -> DataFrame:
    """(table_id, row, col, row_span, col_span) of merges from several sources (bucket, ord): of one origin the first."""
    first = Window.partitionBy("table_id", "row", "col").orderBy("bucket", "ord")
    return merges.withColumn("k", F.row_number().over(first)).where("k = 1").select("table_id", "row", "col", "row_span", "col_span")


def _covered(merges: DataFrame) -> DataFrame:
    rows = merges.select("table_id", F.col("row").alias("r0"), F.col("col").alias("c0"), "col_span", F.explode(F.expr("sequence(row, row + row_span - 1)")).alias("row"))
    return rows.select("table_id", "r0", "c0", "row", F.explode(F.expr("sequence(c0, c0 + col_span - 1)")).alias("col")).where("row <> r0 or col <> c0").select("table_id", "row", "col").distinct()


def _sizes(given: str, total: str, count: str) -> Column:
    even = F.array_repeat(F.bround(F.col(total) / F.col(count), 3), F.col(count).cast("int"))
    return F.when(F.size(given) == F.col(count), F.col(given)).otherwise(even)


def cell_geometry(tables: DataFrame, cells: DataFrame, merges: DataFrame) -> DataFrame:
    """(table_id, row, col, row_span, col_span, x, y, width, height, text): cells that no merge covers, with the box of their span.

    tables: (table_id, x, y, width, height, n_rows, n_cols, row_heights, column_widths); sizes that are null or too few are even."""
    t = tables.withColumns({"hs": _sizes("row_heights", "height", "n_rows"), "ws": _sizes("column_widths", "width", "n_cols")}).select("table_id", F.col("x").alias("tx"), F.col("y").alias("ty"), "hs", "ws")
    own = cells.join(_covered(merges), ["table_id", "row", "col"], "left_anti").join(merges, ["table_id", "row", "col"], "left").join(t, "table_id")
    own = own.withColumns({"row_span": F.coalesce("row_span", F.lit(1)), "col_span": F.coalesce("col_span", F.lit(1))})
    total = lambda a, b, n: F.expr(f"aggregate(slice({a}, {b} + 1, {n}), 0D, (s, v) -> s + v)")
    ahead = lambda a, n: F.expr(f"aggregate(slice({a}, 1, {n}), 0D, (s, v) -> s + v)")
    return own.select(
        "table_id", "row", "col", "row_span", "col_span", _r(F.col("tx") + ahead("ws", "col")).alias("x"), _r(F.col("ty") + ahead("hs", "row")).alias("y"),
        _r(total("ws", "col", "col_span")).alias("width"), _r(total("hs", "row", "row_span")).alias("height"), numeric_repair(F.col("text")).alias("text"),
    )


def grid_lines(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_id, x1, y1, x2, y2, stroke_width, stroke_color): the cells' own borders where any cell of a table has one (columns border_top,
    border_bottom, border_left, border_right: struct<width, color>), else a line at every edge of a cell across the table."""
    sides = ("border_top", "border_bottom", "border_left", "border_right")
    given = [c for c in sides if c in cells.columns]
    has = " or ".join(f"{c} is not null" for c in given) or "false"
    own = cells.withColumn("own", F.max(F.expr(has).cast("int")).over(Window.partitionBy("table_id")))
    ends = {"border_top": "x, y, x + width, y", "border_bottom": "x, y + height, x + width, y + height", "border_left": "x, y, x, y + height", "border_right": "x + width, y, x + width, y + height"}
    line = lambda c: f"if({c} is null, null, named_struct('at', array({ends[c]}), 'w', coalesce({c}.width, 1D), 'c', coalesce({c}.color, '#000000')))"
    plain = cells.select("table_id", F.explode(F.expr("array(struct('v' as k, bround(x, 3) as p), struct('v' as k, bround(x + width, 3) as p), struct('h' as k, bround(y, 3) as p), struct('h' as k, bround(y + height, 3) as p))")).alias("l"))
    plain = plain.select("table_id", "l.k", "l.p").distinct().join(own.where("own = 1").select("table_id").distinct(), "table_id", "left_anti")
    box = tables.select("table_id", _r(F.col("x")).alias("l"), _r(F.col("x") + F.col("width")).alias("r"), _r(F.col("y")).alias("t"), _r(F.col("y") + F.col("height")).alias("b"))
    across = lambda v, h: F.expr(f"if(k = 'v', {v}, {h})")
    out = plain.join(box, "table_id").select("table_id", across("p", "l").alias("x1"), across("t", "p").alias("y1"), across("p", "r").alias("x2"), across("b", "p").alias("y2"), F.lit(1.0).alias("stroke_width"), F.lit(None).cast("string").alias("stroke_color"))
    if not given:
        return out
    drawn = own.where("own = 1").select("table_id", F.explode(F.expr(f"filter(array({', '.join(line(c) for c in given)}), l -> l is not null)")).alias("l"))
    return out.unionByName(drawn.select("table_id", *(F.col("l.at")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), F.col("l.w").alias("stroke_width"), F.col("l.c").alias("stroke_color")))


def table_report(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_id, slots, spanned, complete, cells, empty, merged): whether the spans of a table's cells fill its grid, and its empty and merged cells."""
    n = cells.groupBy("table_id").agg(F.sum(F.col("row_span") * F.col("col_span")).alias("spanned"), F.count("*").alias("cells"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"), F.count_if((F.col("row_span") > 1) | (F.col("col_span") > 1)).alias("merged"))
    t = tables.select("table_id", (F.col("n_rows") * F.col("n_cols")).cast("long").alias("slots")).join(n, "table_id", "left").na.fill(0)
    return t.select("table_id", "slots", F.col("spanned").cast("long").alias("spanned"), (F.col("slots") == F.col("spanned")).alias("complete"), "cells", "empty", "merged")


def header_semantics(cells: DataFrame) -> DataFrame:
    """(table_id, header, sub_header, columns, rows): the texts of the first two rows, and distinct rows and columns."""
    texts = lambda r: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("row") == r, F.struct("col", "text")))), lambda s: s["text"]), " | ")
    return cells.groupBy("table_id").agg(texts(0).alias("header"), texts(1).alias("sub_header"), F.countDistinct("col").alias("columns"), F.countDistinct("row").alias("rows"))
