"""Inventories, classifiers, orders and one-dimensional clustering of elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.elements import PAGE

def _page() -> Window:
    return Window.partitionBy(*PAGE)


def regions(elements: DataFrame, canvas_width: float = 12192000, canvas_height: float = 6858000) -> DataFrame:
    """Header, footer, body_left or body_right by the element's centre."""
    cx, cy = F.expr("x + width / 2"), F.expr("y + height / 2")
    region = F.when(cy < 0.18 * canvas_height, "header").when(cy > 0.85 * canvas_height, "footer").when(cx < 0.5 * canvas_width, "body_left").otherwise("body_right")
    return elements.select(*PAGE, "element_id", region.alias("region"))


def zones(elements: DataFrame, canvas_width: float = 12192000, canvas_height: float = 6858000) -> DataFrame:
    """Horizontal and vertical thirds, nine-grid label, and the box in per mille of the canvas, rounded half to even."""
    part = lambda v, total, a, b: F.when(v / total < 0.33, a).when(v / total > 0.66, b).otherwise("center")
    cx, cy = F.expr("x + width / 2"), F.expr("y + height / 2")
    h, v = part(cx, canvas_width, "left", "right"), part(cy, canvas_height, "top", "bottom")
    grid = F.when((h == "center") & (v == "center"), "center").otherwise(F.concat_ws("-", v, h))
    per = lambda c, total: F.bround(F.col(c) / total, 6)
    return elements.select(*PAGE, "element_id", h.alias("zone_x"), v.alias("zone_y"), grid.alias("grid"), per("x", canvas_width).alias("x_pct"), per("y", canvas_height).alias("y_pct"))


def pixel_boxes(elements: DataFrame, emu: float = 9525.0) -> DataFrame:
    """Boxes in pixels, clamped at 0, rounded half to even at three places; thin boxes as lines."""
    px = {c: F.bround(F.greatest(F.lit(0.0), F.col(c) / emu), 3) for c in ("x", "y", "width", "height")}
    out = elements.select(*PAGE, "element_id", *(e.alias(c) for c, e in px.items()))
    line = F.expr("case when height <= greatest(3D, 0.08D * width) then 'horizontal' when width <= greatest(3D, 0.08D * height) then 'vertical' end")
    return out.withColumn("line", line)


def layers(elements: DataFrame, canvas_area: float = 12192000.0 * 6858000.0) -> DataFrame:
    """The drawing layer of each element."""
    share = F.expr("width * height") / canvas_area
    layer = (
        F.when(F.col("element_type") == "image", "Images").when(F.col("element_type") == "table", "Tables").when(F.col("element_type") == "connector", "Lines")
        .when(F.col("element_type") == "text_box", "Text").when(F.col("element_type") == "icon", "Icons").when(share > 0.8, "Background").when(share > 0.25, "Large panels").otherwise("Shapes")
    )
    return elements.select(*PAGE, "element_id", layer.alias("layer"))


def union_boxes(elements: DataFrame, keys: list[str]) -> DataFrame:
    """The union of the boxes of each group."""
    return elements.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.expr("x + width")) - F.min("x")).alias("width"), (F.max(F.expr("y + height")) - F.min("y")).alias("height"), F.count("*").alias("members"))


def proximity_groups(elements: DataFrame, cell_x: int = 2500000, cell_y: int = 1600000) -> DataFrame:
    """Elements that share a cell of a coarse grid, with the box of the group."""
    g = elements.withColumns({"cell_x": F.floor(F.expr("x + width / 2") / cell_x), "cell_y": F.floor(F.expr("y + height / 2") / cell_y)})
    return union_boxes(g, [*PAGE, "cell_x", "cell_y"]).where("members >= 2")


def reading_order(elements: DataFrame) -> DataFrame:
    """Place in reading order and the element read next."""
    w = _page().orderBy("y", "x", "z_order", "ord")
    return elements.select(*PAGE, "element_id", F.row_number().over(w).alias("position"), F.lead("element_id").over(w).alias("next_id"))


def largest(elements: DataFrame, k: int = 3) -> DataFrame:
    """The k largest elements of each page, as visual hierarchy."""
    rank = F.row_number().over(_page().orderBy(F.expr("width * height").desc(), "ord"))
    level = F.element_at(F.array(F.lit("primary"), F.lit("secondary"), F.lit("tertiary")), F.least("rank", F.lit(3)))
    return elements.withColumn("rank", rank).where(F.col("rank") <= k).select(*PAGE, "element_id", "rank", level.alias("level"))


def islands(rows: DataFrame, keys: list[str], order: list, starts: Column, name: str) -> DataFrame:
    """Numbers runs of ordered rows: a run starts where ``starts`` (over the window ``w`` of the rows) is true or null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _gap(expr: str, keys: list[str], order: list) -> Column:
    return F.lag(F.expr(expr)).over(Window.partitionBy(*keys).orderBy(*order))


def row_islands(elements: DataFrame, tolerance: float = 150000) -> DataFrame:
    """Rows: elements by top, a new row where the centre is further than the tolerance from the one before."""
    order = ["y", "x", "ord"]
    rows = elements.withColumn("cy", F.expr("y + height / 2")).withColumn("before", _gap("y + height / 2", PAGE, order))
    return islands(rows, PAGE, order, F.expr(f"abs(cy - before) > {tolerance}"), "row_id").select(*PAGE, "element_id", "row_id")


def gap_splits(elements: DataFrame, gaps=(("y", "height", 400000), ("x", "width", 500000), ("y", "height", 150000))) -> DataFrame:
    """Clusters by edge gaps, cut three times: by y, by x, by y again, each within the clusters so far."""
    keys, rows = list(PAGE), elements
    for i, (at, size, gap) in enumerate(gaps):
        order = [at, "ord"]
        rows = rows.withColumn("before", _gap(f"{at} + {size}", keys, order))
        rows = islands(rows, keys, order, F.expr(f"{at} - before > {gap}"), f"split_{i + 1}")
        keys = [*keys, f"split_{i + 1}"]
    return rows.select(*PAGE, "element_id", "split_1", "split_2", "split_3")


def coordinate_clusters(elements: DataFrame, tolerance: float = 80000) -> DataFrame:
    """Grid lines: distinct x edges, merged while the gap is within the tolerance, at their mean."""
    edges = elements.select(*PAGE, F.explode(F.array("x", F.expr("x + width"))).alias("v")).distinct()
    rows = edges.withColumn("before", _gap("v", PAGE, ["v"]))
    return islands(rows, PAGE, ["v"], F.expr(f"v - before > {tolerance}"), "cluster").groupBy(*PAGE, "cluster").agg(F.bround(F.avg("v"), 3).alias("position"), F.count("*").alias("edges"))


def panels(elements: DataFrame, gap: float = 500000) -> DataFrame:
    """Pages with exactly one gap in x between consecutive texts: the elements left and right of it."""
    t = elements.where("element_type = 'text_box'")
    order = ["x", "ord"]
    cut = islands(t.withColumn("before", _gap("x + width", PAGE, order)), PAGE, order, F.expr(f"x - before > {gap}"), "panel")
    return cut.withColumn("panels", F.max("panel").over(_page())).where("panels = 2").select(*PAGE, "element_id", F.expr("if(panel = 1, 'Left panel', 'Right panel')").alias("panel"))


def alignment(elements: DataFrame, tolerance: float = 500000) -> DataFrame:
    """Left alignment by the spread of x, spacing by the mean of the positive gaps in y."""
    gaps = elements.withColumn("gap", F.expr("y") - _gap("y + height", PAGE, ["y", "ord"]))
    a = gaps.groupBy(*PAGE).agg(F.stddev_pop("x").alias("sd"), F.expr("avg(gap) filter (where gap > 0)").alias("gap"))
    space = F.expr("case when gap is null then 'unknown' when gap < 200000 then 'compact' when gap < 600000 then 'moderate' else 'spacious' end")
    return a.select(*PAGE, F.when(F.col("sd") < tolerance, "left-aligned").otherwise("mixed").alias("alignment"), space.alias("spacing"))


def violations(elements: DataFrame, canvas_width: float = 12192000, canvas_height: float = 6858000, slack: float = 10) -> DataFrame:
    """Integrity violations: out of bounds, repeated boxes with the same text."""
    out = elements.where(F.expr(f"x < -{slack} or y < -{slack} or x + width > {canvas_width} + {slack} or y + height > {canvas_height} + {slack}")).select(*PAGE, "element_id", F.lit("out_of_bounds").alias("violation"))
    ids = elements.groupBy(*PAGE, "element_id").agg(F.count("*").alias("c")).where("c > 1").select(*PAGE, "element_id", F.lit("duplicate_id").alias("violation"))
    again = elements.groupBy(*PAGE, "x", "y", "text").agg(F.count("*").alias("c"), F.min("element_id").alias("element_id")).where("c > 1").select(*PAGE, "element_id", F.lit("duplicate_text").alias("violation"))
    return out.unionByName(ids).unionByName(again)
