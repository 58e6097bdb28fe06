"""Small joins and limits by id, place in order, text and region.

Null texts count as empty; ties are broken by ``ord``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from quire.operators.forms import SLIDE_HEIGHT, SLIDE_WIDTH
from quire.sources.elements import PAGE

#: How many of a list are kept.
CAPS = {"points": 15, "keywords": 12, "categories": 10, "colors": 8, "row_items": 6, "texts": 4, "concepts": 3}
#: Keys that hold pictures, and keys that a payload's metadata leaves out.
PICTURES = ("image_data", "image_hash", "image_base64", "image_type", "image_bytes", "__image_bytes", "embedded_images", "screenshots", "raster_images")
BLOBS = ("image_data", "image_base64", "raw_bytes", "text")


def with_intelligence(tables: DataFrame, answers: DataFrame) -> DataFrame:
    """Tables with what a model said of them (page, table_id, said); null where it said nothing."""
    return tables.join(answers.select(*PAGE, "table_id", "said"), [*PAGE, "table_id"], "left")


def regions_of(elements: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, element_id, name): the regions (page, name, element_ids) that list an element."""
    listed = regions.select(*PAGE, "name", F.explode("element_ids").alias("element_id"))
    return elements.select(*PAGE, "element_id").join(listed, [*PAGE, "element_id"])


def _bare(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def first_enrichment(texts: DataFrame, enrichments: DataFrame) -> DataFrame:
    """(page, element_id, enrichment_id): the first enrichment (page, enrichment_id, ord, original) whose text equals, holds or lies in a text, but for spaces and case."""
    t = texts.select(*PAGE, "element_id", _bare(F.col("text")).alias("t")).where("t <> ''")
    e = enrichments.select(*PAGE, "enrichment_id", F.col("ord").alias("e_ord"), _bare(F.col("original")).alias("o"))
    return t.join(e, PAGE).where("contains(o, t) or contains(t, o)").groupBy(*PAGE, "element_id").agg(F.min_by("enrichment_id", "e_ord").alias("enrichment_id"))


def zipped(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of two tables of one key, paired by their place in ``order``; the longer one's rest is left out."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return left.withColumn("place", place).join(right.withColumn("place", place).withColumnRenamed(order, f"other_{order}"), [key, "place"])


def merged_extraction(found: DataFrame, base: DataFrame) -> DataFrame:
    """The base's elements, then those found elsewhere whose id it has not: (page, element_id, element_type, source)."""
    more = found.join(base.select(*PAGE, "element_id"), [*PAGE, "element_id"], "left_anti")
    cols = lambda df, name: df.select(*PAGE, "element_id", "element_type", F.lit(name).alias("source"))
    return cols(base, "base").unionByName(cols(more, "found"))


def capped(items: Column, kind: str) -> Column:
    """The first items of a list, as many as its kind keeps."""
    return F.slice(items, 1, CAPS[kind])


def frequent_colors(pixels: DataFrame, key: str, step: int = 24, k: int = 10, least: float = 0.01, most: float = 0.8) -> DataFrame:
    """(key, color, n): of an image's colours, cut to multiples of ``step``, the ``k`` most frequent that cover between a hundredth and four fifths of it."""
    cut = F.format_string("#%02x%02x%02x", *(F.expr(f"cast({c} div {step} * {step} as int)") for c in "rgb"))
    n = pixels.groupBy(key, cut.alias("color")).agg(F.count("*").alias("n"))
    rank = Window.partitionBy(key).orderBy(F.desc("n"), "color")
    n = n.withColumns({"rank": F.row_number().over(rank), "all": F.sum("n").over(Window.partitionBy(key))})
    return n.where(f"rank <= {k} and n >= {least} * all and n <= {most} * all").select(key, "color", "n")


def image_rows(elements: DataFrame) -> DataFrame:
    """(page, image_number, element_id, style, colors, composition): the images of a page in order; summary is what is known of an image."""
    i = elements.where("element_type = 'image'").withColumn("image_number", F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord")))
    colors = F.concat_ws(", ", F.expr("nullif(fill_color, '')"), F.expr("nullif(text_color, '')"))
    known = F.coalesce("summary", F.lit("")) != ""
    return i.select(
        *PAGE, "image_number", "element_id", F.when(known, "contextual illustration").otherwise("photographic").alias("style"), F.when(colors != "", colors).otherwise("inherited from slide palette").alias("colors"),
        F.concat(F.lit("Positioned in the slide layout at element "), F.col("element_id").cast("string")).alias("composition"),
    )


def texts_to_rewrite(objects: DataFrame) -> DataFrame:
    """(page, element_id, source_text, role, parent, x, y, width, height): objects with a text, as a rewriter gets them."""
    return objects.where("characters > 0").select(*PAGE, "element_id", F.trim("text").alias("source_text"), "role", "parent", "x", "y", "width", "height")


def markdown_list(tables: DataFrame) -> DataFrame:
    """(page, markdowns, n): the Markdown of a page's tables in order, empty ones left out."""
    t = tables.where(F.coalesce("markdown", F.lit("")) != "")
    return t.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "markdown"))), lambda s: s["markdown"]), "\n\n").alias("markdowns"), F.count("*").alias("n"))


def inventory_sentence(inventory: DataFrame) -> DataFrame:
    """(page, sentence, archetype): a page's counters in words, and its archetype by them."""
    parts = [F.concat(F.col(c).cast("string"), F.lit(f" {words}")) for c, words in (("total", "total elements"), ("text_boxs", "text boxes"), ("shapes", "shapes"), ("arrows", "arrows"), ("images", "images"), ("tables", "tables"), ("charts", "charts"))]
    kind = F.expr("case when arrows + connectors > 3 then 'flowchart' when tables > 0 then 'table_slide' when charts > 0 then 'chart_slide' when images > 3 then 'image_heavy' else 'general' end")
    return inventory.select(*PAGE, F.concat(F.concat_ws(", ", *parts), F.lit(".")).alias("sentence"), kind.alias("archetype"))


#: Fixed value: what a reader of a table's payload is told, by its archetype and header depth.
GUIDE = (
    "LOSSLESS RECONSTRUCTION GUIDE: Use the 'cells' array for content and visual metadata. "
    "Refer to 'row_span' and 'column_span' for merged regions. Archetype: %s. Hierarchy: %d-level header."
)


def grid_summary(cells: DataFrame) -> DataFrame:
    """(table_id, row_count, column_count, layout_type, summary, table_category, confidence): a table seen as a plain grid."""
    rows = cells.groupBy("table_id", "row").agg(F.count("*").alias("n"))
    n = rows.groupBy("table_id").agg(F.count("*").alias("row_count"), F.max("n").alias("column_count"))
    return n.select("*", F.lit("grid").alias("layout_type"), F.format_string("%d rows detected", "row_count").alias("summary"), F.lit("consulting_framework").alias("table_category"), F.lit(0.8).alias("confidence"))


def guides(profile: DataFrame) -> DataFrame:
    """(table_id, guide): how to rebuild a table, by its profile (archetype, header_depth)."""
    return profile.select("table_id", F.format_string(GUIDE, F.coalesce("archetype", F.lit("standard")), F.coalesce("header_depth", F.lit(1))).alias("guide"))


def position_map(elements: DataFrame) -> DataFrame:
    """(page, element_id, element_type, x, y, width, height)."""
    return elements.select(*PAGE, "element_id", "element_type", "x", "y", "width", "height")


def canvas_record(pages: DataFrame) -> DataFrame:
    """(page, width, height, unit and axes, aspect_ratio, background): the canvas of each page (page, slide_width, slide_height, background_color); a missing or zero size is a wide slide's."""
    size = lambda c, d: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(float(d)))
    p = pages.select(*PAGE, size("slide_width", SLIDE_WIDTH).alias("width"), size("slide_height", SLIDE_HEIGHT).alias("height"), F.col("background_color").alias("fill_color"))
    known = {"coordinate_unit": "EMU_or_source_units", "origin": "top_left", "x_axis": "left_to_right", "y_axis": "top_to_bottom", "theme_role": "slide_background"}
    return p.withColumns({"aspect_ratio": F.bround(F.col("width") / F.col("height"), 6), "preserve_exactly": F.lit(True), **{k: F.lit(v) for k, v in known.items()}})


def public_keys(metadata: Column) -> Column:
    """A map without its private keys, those that begin with two underscores; empty for a null one."""
    return F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: ~F.startswith(k, F.lit("__")))


def light_keys(metadata: Column) -> Column:
    """A map without what holds pictures, bytes or the text."""
    return F.map_filter(metadata, lambda k, _: ~k.isin(*BLOBS))


def _without(c: Column, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        kept = [_without(c[f.name], f.dataType).alias(f.name) for f in kind if f.name not in PICTURES]
        return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None).cast("string")
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _without(x, kind.elementType))
    if isinstance(kind, MapType):
        own = F.map_filter(c, lambda k, _: ~k.isin(*PICTURES)) if isinstance(kind.keyType, StringType) else c
        return F.transform_values(own, lambda _, v: _without(v, kind.valueType))
    return c


def without_pictures(df: DataFrame) -> DataFrame:
    """``df`` without the columns, fields and map keys that hold pictures, at any depth; an unnamed depth of nothing else is null."""
    return df.select(*(_without(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema if f.name not in PICTURES))
