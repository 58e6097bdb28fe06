"""Table operators over long cells: (table_id, row, col, text), one row per slot, blank slots as empty texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of financial tables, and markers of section rows.
FINANCIAL = ("revenue", "ebitda", "profit", "budget", "cost", "total", "variance")
SECTION_MARKERS = ("DoD", "BoP", "TOTAL", "VA", "IHS", "FAR", "DFARS", "SUBTOTAL", "SECTION", "APPENDIX", "SUMMARY")


def _filled(column: str = "text") -> Column:
    return F.trim(column) != ""


def table_rows(cells: DataFrame) -> DataFrame:
    """One row per table row: its filled cells in order, their distinct number, digits, and the table's size."""
    row = cells.groupBy("table_id", "row").agg(
        F.sort_array(F.collect_list(F.struct("col", "text"))).alias("slots"),
        F.count_distinct(F.when(_filled(), F.col("text"))).alias("distinct_filled"),
        F.count_if(F.col("text").rlike("[0-9]")).alias("numeric"),
        F.max("col").alias("last_col"),
    )
    by = Window.partitionBy("table_id")
    row = row.withColumns({"n_rows": F.max("row").over(by) + 1, "n_cols": F.max("last_col").over(by) + 1, "all": F.transform("slots", lambda s: s["text"])})
    return row.withColumn("filled", F.filter("all", lambda t: F.trim(t) != ""))


def header_depth(rows: DataFrame) -> DataFrame:
    """``rows`` with ``depth``: leading rows, four at most and never the last, with fewer distinct filled cells than
    half the columns."""
    miss = F.when((F.col("row") >= 4) | (F.col("row") >= F.col("n_rows") - 1) | (2 * F.col("distinct_filled") >= F.col("n_cols")), F.col("row"))
    return rows.withColumn("depth", F.coalesce(F.min(miss).over(Window.partitionBy("table_id")), F.least("n_rows", F.lit(4))))


def table_profile(cells: DataFrame) -> DataFrame:
    """Structure of each table: header depth, pivot, section rows, finance, numbers, totals, archetype."""
    rows = header_depth(table_rows(cells)).withColumn("joined", F.lower(F.array_join("all", "")))
    body = F.col("row") >= F.col("depth")
    first = F.col("slots")[0]
    named = body & (first["col"] == 0) & (F.trim(first["text"]) != "")
    section = body & (F.size("filled") == 1) & (F.col("row") < F.col("n_rows") - 1)
    words = "|".join(FINANCIAL)
    one = rows.groupBy("table_id").agg(
        F.first("n_rows").alias("n_rows"), F.first("n_cols").alias("n_cols"), F.first("depth").alias("depth"),
        F.count_if(named).alias("named"), F.count_if(section).alias("section_rows"), F.sum("numeric").alias("numeric"),
        F.bool_or(F.lower(F.array_join("all", " ")).rlike(words)).alias("is_financial"),
        F.bool_or(F.contains("joined", F.lit("subtotal"))).alias("has_subtotals"),
        F.bool_or(F.contains("joined", F.lit("total")) & ~F.contains("joined", F.lit("subtotal"))).alias("has_totals"),
    )
    pivot = (F.col("n_rows") > 1) & (F.col("n_cols") > 1) & (10 * F.col("named") > 8 * (F.col("n_rows") - F.col("depth")))
    kind = (
        F.when(F.col("is_pivot") & (F.col("depth") > 1), "complex_cross_tab").when(F.col("section_rows") > 0, "sectioned_report")
        .when(F.col("is_pivot"), "matrix_comparison").when(F.col("is_financial"), "financial_statement").otherwise("standard_list")
    )
    return one.withColumn("is_pivot", pivot).select(
        "table_id", "n_rows", "n_cols", F.greatest("depth", F.lit(1)).alias("header_depth"), "is_pivot", "section_rows", "is_financial",
        (10 * F.col("numeric") > 4 * F.col("n_rows") * F.col("n_cols")).alias("numeric_density"), "has_subtotals", "has_totals", kind.alias("archetype"),
    )


def section_headers(cells: DataFrame) -> DataFrame:
    """Rows that head a section: those with a marker word, and those after the first with one filled cell."""
    rows = table_rows(cells).withColumn("joined", F.trim(F.array_join("all", " ")))
    marked = F.col("joined").rlike(r"(?i)\b(" + "|".join(SECTION_MARKERS) + r")\b")
    label = F.when(marked, F.col("joined")).when((F.size("filled") == 1) & (F.col("row") > 0), F.trim(F.col("filled")[0]))
    return rows.withColumn("label", label).where("label is not null").select("table_id", "row", "label", F.col("n_cols").alias("columns_spanned"))


def connector_relation(label: Column) -> Column:
    """What the label of a connector says of the edge."""
    t = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return (
        F.when(t.isin("yes", "no"), "decision").when(t.isin("next", "continue"), "process_flow").when(F.contains(t, F.lit("cause")), "cause_effect")
        .when(F.contains(t, F.lit("approve")) | F.contains(t, F.lit("reject")), "decision").otherwise("flow")
    )


def cell_model(cells: DataFrame, width: float, row_height: float) -> DataFrame:
    """Cells with role and place: header rows first, then the first column; columns share the width evenly."""
    depth = header_depth(table_rows(cells)).groupBy("table_id").agg(F.greatest(F.first("depth"), F.lit(1)).alias("depth"), F.first("n_cols").alias("n_cols"))
    role = F.when(F.col("row") < F.col("depth"), "header").when(F.col("col") == 0, "row_header").otherwise("data")
    own = width / F.col("n_cols")
    return cells.join(depth, "table_id").select(
        "table_id", "row", "col", role.alias("role"), F.trim("text").alias("text"), (F.col("col") * own).alias("x"), (F.col("row") * F.lit(row_height)).alias("y"),
        own.alias("width"), F.lit(row_height).alias("height"),
    )


def likely_tables(cells: DataFrame) -> DataFrame:
    """Whether rows of filled cells are a table: two rows, one with two cells, four cells, and not a small set that is mostly figures."""
    rows = table_rows(cells).withColumn("words", F.filter(F.split(F.array_join("filled", " "), "[\\t\\n ]+"), lambda w: w != ""))
    figure = F.filter("words", lambda w: F.contains(w, F.lit("%")) | (F.replace(w, F.lit("."), F.lit("")).rlike("^[0-9]+$") & (F.length(w) <= 3)))
    t = rows.groupBy("table_id").agg(F.first("n_rows").alias("n_rows"), F.max(F.size("filled")).alias("widest"), F.sum(F.size("filled")).alias("n_cells"), F.sum(F.size("words")).alias("n"), F.sum(F.size(figure)).alias("k"))
    chart = (10 * F.col("k") > 7 * F.col("n")) & (F.col("n_cells") < 12)
    return t.select("table_id", "n_cells", ((F.col("n_rows") >= 2) & (F.col("widest") > 1) & (F.col("n_cells") >= 4) & ~chart).alias("likely"))


def series_by_category(points: DataFrame) -> DataFrame:
    """A value for every series and category of a chart; "0" where there is none.  A chart's categories go to its series as one array."""
    every = points.groupBy("series").agg(F.lit(1).alias("one")).join(points.agg(F.collect_set("category").alias("all")).withColumn("one", F.lit(1)), "one")
    return every.select("series", F.explode("all").alias("category")).join(points, ["series", "category"], "left").select("series", "category", F.coalesce("value", F.lit("0")).alias("value"))


def reconstruction(cells: DataFrame, width: float, row_height: float) -> DataFrame:
    """A table's profile with all that draws it again: its cells (row, col, role, text, box) in order and its section rows (row, label), empty where it has none."""
    model = cell_model(cells, width, row_height)
    drawn = model.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("row", "col", "role", "text", "x", "y", "width", "height"))).alias("cells"))
    heads = section_headers(cells).groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("row", "label"))).alias("sections"))
    whole = table_profile(cells).join(drawn, "table_id").join(heads, "table_id", "left")
    return whole.withColumn("sections", F.coalesce("sections", F.array().cast("array<struct<row:int,label:string>>")))
