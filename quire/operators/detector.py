"""Tables and charts that are drawn with loose texts: rows, tables, grids, merged cells and chart regions.

Distances are in EMU and are parameters, as pages in other units need others.  A null text counts as empty; ties are broken by
``ord``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.classify import first_of
from quire.operators.folds import merge_spans
from quire.operators.forms import strip
from quire.operators.layout import islands
from quire.sources.elements import PAGE

TABLE = [*PAGE, "table_no"]
#: Words of charts, and of texts that are none.
CHART_WORDS = ("interest", "factors", "pursuing", "path", "level", "score", "rate", "index", "agree", "disagree")
NO_CHART = ("@", "copyright", "all rights reserved")
TYPES = (("bar_chart", "bar|%"), ("line_chart", "line|trend"), ("pie_chart", "pie|share"), ("box_plot", "box|whisker"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def text_rows(elements: DataFrame, tolerance: float = 150_000, gap: float = 600_000) -> DataFrame:
    """The texts of pages with three of them, in rows (centres within ``tolerance`` of the one before, by top) and tables (rows
    that start at most ``gap`` below the lowest end of the row before); pages with one row have none."""
    t = elements.withColumn("text", F.coalesce("text", F.lit(""))).where((F.col("element_type") == "text_box") & (strip(F.col("text")) != ""))
    t = t.withColumn("texts", F.count("*").over(Window.partitionBy(*PAGE))).where("texts >= 3")
    by = Window.partitionBy(*PAGE).orderBy("y", "ord")
    t = islands(t.withColumn("before", F.lag(F.expr("y + height / 2")).over(by)), PAGE, ["y", "ord"], F.expr(f"abs(y + height / 2 - before) > {tolerance}D"), "row_no")
    rows = t.groupBy(*PAGE, "row_no").agg(F.min("y").alias("top"), F.max(F.expr("y + height")).alias("bottom"))
    rows = rows.withColumns({"rows": F.count("*").over(Window.partitionBy(*PAGE)), "before": F.lag("bottom").over(Window.partitionBy(*PAGE).orderBy("row_no"))}).where("rows >= 2")
    rows = islands(rows, PAGE, ["row_no"], F.expr(f"top - before > {gap}D"), "table_no")
    return t.select(*PAGE, "element_id", "ord", "x", "y", "width", "height", "text", "row_no").join(rows.select(*PAGE, "row_no", "table_no"), [*PAGE, "row_no"])


def visual_tables(elements: DataFrame) -> DataFrame:
    """(page, table_no, n_rows, n_cells, x, y, width, height): tables of two rows, a row of two cells and four cells that are not a small set of figures."""
    t = text_rows(elements).withColumn("in_row", F.count("*").over(Window.partitionBy(*TABLE, "row_no")))
    figure = lambda w: F.contains(w, F.lit("%")) | (F.replace(w, F.lit("."), F.lit("")).rlike("^[0-9]+$") & (F.length(w) <= 3))
    t = t.withColumns({"words": F.size(_words(F.col("text"))), "figures": F.size(F.filter(_words(F.col("text")), figure))})
    a = t.groupBy(*TABLE).agg(
        F.countDistinct("row_no").alias("n_rows"), F.count("*").alias("n_cells"), F.max("in_row").alias("widest"), F.sum("words").alias("words"), F.sum("figures").alias("figures"),
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.expr("x + width")) - F.min("x")).alias("width"), (F.max(F.expr("y + height")) - F.min("y")).alias("height"),
    )
    kept = a.where("n_rows >= 2 and widest > 1 and n_cells >= 4 and not (figures / words > 0.7 and n_cells < 12)")
    return kept.select(*TABLE, "n_rows", "n_cells", "x", "y", "width", "height")


def _lines(cells: DataFrame, at: str, size: str, tolerance: float) -> DataFrame:
    edges = cells.select(*TABLE, F.explode(F.array(F.col(at), F.col(at) + F.col(size))).alias("v")).distinct()
    by = Window.partitionBy(*TABLE).orderBy("v")
    cut = islands(edges.withColumn("before", F.lag("v").over(by)), TABLE, ["v"], F.expr(f"v - before > {tolerance}D"), "k")
    mean = cut.groupBy(*TABLE, "k").agg(F.avg("v").alias("v"))
    return mean.groupBy(*TABLE).agg(F.sort_array(F.collect_list("v")).alias(f"g{at}"))


def _slot(grid: str, centre: str) -> Column:
    """The first interval of a grid that holds a value, else the one with the nearest middle."""
    inside = F.expr(f"nullif(array_position(transform(sequence(0, size({grid}) - 2), i -> {grid}[i] <= {centre} and {centre} <= {grid}[i + 1]), true), 0) - 1")
    near = F.expr(f"array_min(transform(sequence(0, size({grid}) - 2), i -> struct(abs({centre} - ({grid}[i] + {grid}[i + 1]) / 2) as d, i as i))).i")
    return F.coalesce(inside.cast("int"), near)


def grid_cells(elements: DataFrame, tolerance: float = 80_000) -> DataFrame:
    """Spans of the visual tables, merged where they touch, with their slot in the grid of their tables' edges:
    (page, table_no, row, col, first_id, text, x, y, width, height, gx, gy)."""
    found = text_rows(elements).join(visual_tables(elements).select(*TABLE), TABLE)
    spans = merge_spans(found, keys=TABLE)
    grid = _lines(spans, "x", "width", tolerance).join(_lines(spans, "y", "height", tolerance), TABLE).where("size(gx) > 1 and size(gy) > 1")
    met = spans.join(grid, TABLE).withColumns({"cx": F.expr("x + width / 2"), "cy": F.expr("y + height / 2")})
    return met.select(*TABLE, _slot("gy", "cy").alias("row"), _slot("gx", "cx").alias("col"), "first_id", strip(F.col("text")).alias("text"), "x", "y", "width", "height", "gx", "gy")


def grid_texts(cells: DataFrame) -> DataFrame:
    """(page, table_no, row, col, text, n_rows, n_cols): the texts of a slot by place, one a line."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "first_id", "text"))), lambda s: s["text"])
    return cells.groupBy(*TABLE, "row", "col").agg(F.array_join(lines, "\n").alias("text"), F.first(F.size("gy") - 1).alias("n_rows"), F.first(F.size("gx") - 1).alias("n_cols"))


def grid_merges(cells: DataFrame, slack: float = 50_000) -> DataFrame:
    """(page, table_no, row, col, row_span, col_span): spans over several slots, in order of place, without those whose origin one before covers."""
    first = lambda g, at, size: F.expr(f"if({g}[0] <= {at} + {slack}D, nullif(array_position(transform(sequence(0, size({g}) - 2), i -> {g}[i + 1] >= {at} + {size} - {slack}D), true), 0) - 1, null)").cast("int")
    last = lambda g, at, end: F.expr(f"array_max(filter(sequence(0, {end}), i -> {g}[i] <= {at} + {slack}D))")
    c = cells.withColumns({"re": first("gy", "y", "height"), "ce": first("gx", "x", "width")}).where("re is not null and ce is not null")
    c = c.withColumns({"rs": last("gy", "y", "re"), "cs": last("gx", "x", "ce")}).where("re > rs or ce > cs")
    listed = c.groupBy(*TABLE).agg(F.sort_array(F.collect_list(F.struct("y", "x", "first_id", "rs", "cs", (F.col("re") - F.col("rs") + 1).alias("h"), (F.col("ce") - F.col("cs") + 1).alias("w")))).alias("l"))
    empty = "cast(array() as array<struct<row:int,col:int,row_span:int,col_span:int>>)"
    covered = "exists(z, k -> m.rs between k.row and k.row + k.row_span - 1 and m.cs between k.col and k.col + k.col_span - 1)"
    fold = f"aggregate(l, {empty}, (z, m) -> if({covered}, z, concat(z, array(named_struct('row', m.rs, 'col', m.cs, 'row_span', m.h, 'col_span', m.w)))))"
    return listed.select(*TABLE, F.expr(f"inline({fold})"))


def refined_lines(clusters: DataFrame, coordinates: DataFrame, reach: float = 150_000) -> DataFrame:
    """(page, position): each cluster's position as the mean of the raw coordinates within ``reach``; equal ones once."""
    c = clusters.select(*PAGE, "cluster", "position").alias("c")
    met = c.join(coordinates.select(*PAGE, "v"), PAGE).where(F.abs(F.col("v") - F.col("position")) < reach)
    mean = met.groupBy(*PAGE, "cluster").agg(F.avg("v").alias("mean"))
    return clusters.join(mean, [*PAGE, "cluster"], "left").select(*PAGE, F.bround(F.coalesce("mean", "position"), 3).alias("position")).distinct()


def chart_regions(elements: DataFrame) -> DataFrame:
    """(page, split_1, split_2, split_3, members, text, chart_type, x, y, width, height): clusters of texts, images and charts by edge gaps that read like a chart, with a margin."""
    picture = F.col("element_type").isin("image", "chart")
    keys, rows = list(PAGE), elements.withColumn("text", F.coalesce("text", F.lit(""))).where(picture | ((F.col("element_type") == "text_box") & (F.col("text") != "")))
    for i, (at, size, gap) in enumerate((("y", "height", 400_000), ("x", "width", 500_000), ("y", "height", 150_000)), 1):
        by = Window.partitionBy(*keys).orderBy(at, "ord")
        rows = islands(rows.withColumn("before", F.lag(F.expr(f"{at} + {size}")).over(by)), keys, [at, "ord"], F.expr(f"{at} - before > {gap}D"), f"split_{i}")
        keys = [*keys, f"split_{i}"]
    texts = F.transform(F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("y", "ord", "text")))), lambda s: s["text"])
    a = rows.groupBy(*keys).agg(
        F.lower(F.array_join(texts, " ")).alias("text"), F.max(picture).alias("pictured"), F.count("*").alias("members"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.expr("x + width")).alias("x1"), F.max(F.expr("y + height")).alias("y1"),
    )
    a = a.withColumns({"digits": F.length(F.regexp_replace("text", "[^0-9]", "")), "percent": F.contains("text", F.lit("%")), "words": F.size(_words(F.col("text")))})
    none = F.col("text").rlike("|".join(NO_CHART))
    some = F.col("percent") | F.col("pictured") | (F.col("digits") >= 3) | F.col("text").rlike("|".join(CHART_WORDS))
    kept = a.where(F.expr("(digits >= 2 or percent or pictured) and (words >= 3 or pictured)") & ~none & some).withColumn("pad", F.expr("if(x1 - x0 < 2000000D, 60000D, 30000D)"))
    kind = first_of([(n, F.col("text").rlike(p)) for n, p in TYPES], "chart")
    return kept.select(*keys, "members", "text", kind.alias("chart_type"), F.expr("greatest(0D, x0 - pad)").alias("x"), F.expr("greatest(0D, y0 - pad)").alias("y"), F.expr("x1 - x0 + 2 * pad").alias("width"), F.expr("y1 - y0 + 2 * pad").alias("height"))
