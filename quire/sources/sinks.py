"""Sinks: records of pages as JSON lines, summaries and reports, tables as Markdown, stage logs by page.

A record is built where its page's rows meet, and nothing passes the driver; nulls are left out of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.elements import PAGE


def page_records(elements: DataFrame) -> DataFrame:
    """One JSON text per page: its elements in input order."""
    fields = [c for c in elements.columns if c not in PAGE]
    body = F.sort_array(F.collect_list(F.struct("ord", F.struct(*fields).alias("element"))))
    return elements.groupBy(*PAGE).agg(F.transform(body, lambda s: s["element"]).alias("elements")).select(*PAGE, F.to_json(F.struct(*PAGE, "elements")).alias("record"))


def records(rows: DataFrame, order: str, name: str) -> DataFrame:
    """One JSON text per page: its rows in ``order``, as the list ``name``."""
    fields = [c for c in rows.columns if c not in PAGE]
    body = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.to_json(F.struct(*fields)).alias("row"))))
    listed = F.concat(F.lit("["), F.array_join(F.transform(body, lambda s: s["row"]), ","), F.lit("]"))
    head = F.concat(*(x for c in PAGE for x in (F.lit(f'"{c}":'), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit(","))))
    return rows.groupBy(*PAGE).agg(listed.alias("list")).select(*PAGE, F.concat(F.lit("{"), head, F.lit(f'"{name}":'), "list", F.lit("}")).alias("record"))


#: Lists of a form record, with the types that they hold.
FORM_LISTS = (
    ("lines", ("line",)), ("rectangles", ("rectangle", "shape")), ("tables", ("table",)), ("checkboxes", ("checkbox",)), ("radio_buttons", ("radio_button",)), ("signature_fields", ("signature",)), ("images", ("image",)),
    ("text_blocks", ("text_box", "text")),
)


def form_records(form: DataFrame, geometry: DataFrame) -> DataFrame:
    """One JSON text per form page: its geometry, its elements in draw order, and the same by kind."""
    row = F.struct("reading_order", F.struct(*(c for c in form.columns if c not in PAGE)).alias("e"))
    every = F.sort_array(F.collect_list(row))
    kinds = [F.sort_array(F.collect_list(F.when(F.lower("type").isin(*types), row))).alias(n) for n, types in FORM_LISTS]
    bare = lambda c: F.transform(c, lambda s: s["e"]).alias(c)
    g = form.groupBy(*PAGE).agg(every.alias("elements"), *kinds).join(geometry, PAGE)
    order = F.transform("elements", lambda s: s["e"]["element_id"]).alias("order")
    own = [c for c in geometry.columns if c not in PAGE]
    return g.select(*PAGE, F.to_json(F.struct(*PAGE, *own, F.lit("pixels").alias("units"), order, bare("elements"), *(bare(n) for n, _ in FORM_LISTS))).alias("record"))


def statistics(elements: DataFrame) -> DataFrame:
    """(document_id, pages, elements, with_text, largest_page, types): what a run found in each document."""
    page = elements.groupBy(*PAGE).agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("t"))
    kinds = elements.groupBy("document_id", "element_type").agg(F.count("*").alias("n")).groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("element_type", "n"))), lambda s: F.concat(s["element_type"], F.lit("="), s["n"].cast("string"))), ",").alias("types"))
    return page.groupBy("document_id").agg(F.count("*").alias("pages"), F.sum("n").alias("elements"), F.sum("t").alias("with_text"), F.max("n").alias("largest_page")).join(kinds, "document_id")


def summaries(facts: DataFrame, points: DataFrame, most: int = 3) -> DataFrame:
    """(page, summary): a page's title, layout and counts (page, title, layout, images, tables, charts) and its first points (page, point_no, text) in sentences."""
    first = points.where(F.col("point_no") <= most).groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("point_no", "text"))), lambda s: s["text"]), "; ").alias("points"))
    some = F.concat_ws(", ", *(F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {c[:-1]}(s)"))) for c in ("images", "tables", "charts")))
    named = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("This slide, titled '"), "title", F.lit("', explains key concepts on this topic."))).otherwise(F.concat(F.lit("This slide presents information in a "), "layout", F.lit(" layout.")))
    shown = F.when(some != "", F.concat(F.lit("The slide utilizes a visual layout featuring "), some, F.lit(" to support the explanation."))).otherwise(F.concat(F.lit("The layout is structured as a "), "layout", F.lit(" presentation.")))
    told = F.when(F.coalesce("points", F.lit("")) != "", F.concat(F.lit("It covers the following points: "), "points", F.lit(".")))
    return facts.join(first, PAGE, "left").select(*PAGE, F.concat_ws(" ", named, shown, told).alias("summary"))


def write_pages(elements: DataFrame, path: str) -> None:
    """Page records as JSON lines; a page is built where its elements meet, nothing passes the driver."""
    page_records(elements).select("record").write.mode("overwrite").text(path)


def read_pages(spark, path: str, schema) -> DataFrame:
    """The elements of pages that write_pages() wrote; ``schema`` is that of the elements."""
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    inner = ", ".join(f"`{n}`: {t}" for n, t in kinds.items() if n not in PAGE)
    given = spark.read.schema(", ".join(f"`{c}` {kinds[c]}" for c in PAGE) + f", elements array<struct<{inner}>>").json(path)
    return given.select(*PAGE, F.inline("elements")).select(*kinds)


def reread(records: DataFrame, name: str, rows: DataFrame) -> DataFrame:
    """The rows of the list ``name`` of JSON records (record), with the columns and types of ``rows``: what a reader of the records gets."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    inner = ", ".join(f"`{n}`: {t}" for n, t in kinds.items() if n not in PAGE)
    given = records.select(F.from_json("record", ", ".join(f"`{c}` {kinds[c]}" for c in PAGE) + f", `{name}` array<struct<{inner}>>").alias("r"))
    return given.select(*(F.col(f"r.{c}").alias(c) for c in PAGE), F.inline(F.col(f"r.{name}"))).select(*kinds)


def stage_records(rows: DataFrame, stage: str) -> DataFrame:
    """(page, stage, record): a stage's rows as JSON texts, to be written by page and stage; stages of unlike columns go in one log."""
    return rows.select(*PAGE, F.lit(stage).alias("stage"), F.to_json(F.struct(*(c for c in rows.columns if c not in PAGE))).alias("record"))


def write_stage(df: DataFrame, path: str, stage: str) -> None:
    """A stage's rows, by document, page and stage."""
    df.withColumn("stage", F.lit(stage)).write.mode("append").partitionBy(*PAGE, "stage").json(path)


def markdown(cells: DataFrame) -> DataFrame:
    """Long cells (table_id, row, col, text) as one Markdown text a table: line breaks and bars escaped, short rows padded."""
    safe = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|"))
    wide = cells.withColumn("cols", F.max("col").over(Window.partitionBy("table_id")) + 1)
    row = wide.groupBy("table_id", "row", "cols").agg(F.map_from_entries(F.collect_list(F.struct("col", safe.alias("t")))).alias("at"))
    line = F.expr("concat('| ', array_join(transform(sequence(0, cols - 1), c -> coalesce(at[c], '')), ' | '), ' |')")
    rule = F.expr("concat('| ', array_join(array_repeat('---', cols), ' | '), ' |')")
    row = row.withColumn("line", line).groupBy("table_id", "cols").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda s: s["line"]).alias("lines"))
    return row.select("table_id", F.array_join(F.concat(F.slice("lines", 1, 1), F.array(rule), F.expr("slice(lines, 2, greatest(size(lines) - 1, 0))")), "\n").alias("markdown"))
