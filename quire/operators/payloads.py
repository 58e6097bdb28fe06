"""Payloads for drawing and for models, and the checks that they must pass.

Null texts count as empty; ties are broken by ``ord``; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.classify import first_of
from quire.operators.content import similarity
from quire.operators.forms import SLIDE_HEIGHT, SLIDE_WIDTH, strip
from quire.operators.semantics import plain_rewrite
from quire.sources.elements import PAGE

#: Drawing layers in their order, with the types that they hold, and the keys of a page's integrity record.
LAYERS = (
    ("images", ("image",)), ("lines", ("line", "connector", "arrow")), ("fills", ("rectangle", "shape", "group")), ("grid", ("table",)), ("text", ("text_box", "text", "title", "placeholder")),
    ("checkboxes", ("checkbox", "radio_button")), ("signatures", ("signature",)), ("stamps", ("stamp", "seal")),
)
INTEGRITY = ("document_id", "page_number", "image_hash", "processing_timestamp", "pipeline_version")


def fidelity_objects(elements: DataFrame, emu: float = 9525.0) -> DataFrame:
    """One row an object: class, role, box in pixels (one place) and per cent of the slide (two places), colours and font with their defaults."""
    px = lambda c: F.bround(F.col(c) / emu, 1).alias(f"{c}_px")
    pct = lambda c, total: F.bround(100 * F.col(c) / total, 2).alias(f"{c}_pct")
    kind, bold = F.col("element_type"), F.coalesce("bold", F.lit(False))
    role = first_of([("title", bold & (F.col("y") < 100)), *((t, kind == t) for t in ("checkbox", "table", "chart"))], "body")
    text = F.coalesce("text", F.lit(""))
    said = text != ""
    return elements.select(
        *PAGE, "element_id", "element_type", F.lower(F.coalesce(F.expr("nullif(shape_type, '')"), kind)).alias("class"), role.alias("role"), px("x"), px("y"), px("width"), px("height"), pct("x", SLIDE_WIDTH), pct("y", SLIDE_HEIGHT),
        pct("width", SLIDE_WIDTH), pct("height", SLIDE_HEIGHT), F.col("fill_color"), F.when(kind.isin("arrow", "connector"), F.col("text_color")).alias("border_color"), text.alias("text"),
        F.when(said, F.coalesce("font_family", F.lit("Arial"))).alias("font_family"), F.when(said, F.coalesce("font_size", F.lit(12.0))).alias("font_size"), F.when(said, F.when(bold, "bold").otherwise("normal")).alias("font_weight"),
    )


def model_elements(elements: DataFrame) -> DataFrame:
    """One row an element for a model: text on one line, and its box in per cent (two places) of the canvas that the page's elements reach."""
    reach = elements.groupBy(*PAGE).agg(F.greatest(F.lit(float(SLIDE_WIDTH)), F.max(F.expr("x + width"))).alias("cw"), F.greatest(F.lit(float(SLIDE_HEIGHT)), F.max(F.expr("y + height"))).alias("ch"))
    pct = lambda c, total: F.bround(F.col(c) / F.col(total) * 100, 2)
    return elements.join(reach, PAGE).select(
        *PAGE, "element_id", "element_type", F.replace(strip(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit(" ")).alias("content"), pct("x", "cw").alias("left"), pct("y", "ch").alias("top"),
        pct("width", "cw").alias("width"), pct("height", "ch").alias("height"), F.coalesce("z_order", F.lit(0)).alias("z_order"),
    )


def visual_objects(elements: DataFrame, canvases: DataFrame) -> DataFrame:
    """One row an object for a blueprint: rewritten text, box in per cent (two places) of its page's canvas, and style with the defaults of what is missing."""
    pct = lambda c, total: F.when(F.col(total) > 0, F.bround(F.col(c) / F.col(total) * 100, 2)).otherwise(0.0)
    shape = F.expr("nullif(shape_type, '')")
    return elements.join(canvases, PAGE).select(
        *PAGE, "element_id", "element_type", F.coalesce(shape, F.lit("rectangle")).alias("shape_type"), F.when(F.col("text") != "", F.nullif(plain_rewrite(F.col("text")), F.lit(""))).alias("text"),
        pct("x", "canvas_width").alias("left_pct"), pct("y", "canvas_height").alias("top_pct"), pct("width", "canvas_width").alias("width_pct"), pct("height", "canvas_height").alias("height_pct"),
        F.coalesce("z_order", F.lit(0)).alias("z_order"), F.lit("top-left").alias("anchor"), F.col("parent"), F.col("group_id"), F.col("fill_color"), F.coalesce("font_family", F.lit("Arial")).alias("font_family"),
        F.coalesce("font_size", F.lit(12.0)).alias("font_size"), F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("text_color", F.lit("#000000")).alias("color"),
        F.concat(F.lit("Visual object representing a "), "element_type", F.lit(" of type "), F.coalesce(shape, F.lit("rect")), F.lit(".")).alias("semantic_meaning"),
    )


def connector_instructions(relations: DataFrame) -> DataFrame:
    """(page, source_element_id, target_element_id, instruction): how to draw each relation again; an empty label is none."""
    said = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit(" with visible label '"), "label", F.lit("'"))).otherwise("")
    line = F.concat(F.lit("Draw a connector from "), F.col("source_element_id").cast("string"), F.lit(" to "), F.col("target_element_id").cast("string"), said, F.lit("."))
    return relations.select(*PAGE, "source_element_id", "target_element_id", line.alias("instruction"))


def page_purpose(flow: Column, summary: Column, title: Column) -> Column:
    """What a page is drawn again for: its flow's summary, else the first line of its own, else its title, else a general sentence."""
    first = F.trim(F.replace(F.split(F.trim(summary), "\n")[0], F.lit("#"), F.lit("")))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    general = "Recreate the presentation slide from extracted visual and semantic structure."
    return F.when(some(flow), flow).when(some(summary), first).when(some(title), F.concat(F.lit("Recreate a slide explaining "), title, F.lit("."))).otherwise(general)


def draw_list(form: DataFrame) -> DataFrame:
    """(page, seq, layer, element_id): a form's elements (page, element_id, type, reading_order), each id once, layer by layer."""
    kind = F.lower("type")
    rank = first_of([(str(i), kind.isin(*types)) for i, (_, types) in enumerate(LAYERS)], None).cast("int")
    name = F.element_at(F.array(*(F.lit(n) for n, _ in LAYERS)), F.col("rank") + 1)
    first = form.withColumn("k", F.row_number().over(Window.partitionBy(*PAGE, "element_id").orderBy("reading_order"))).where("k = 1").withColumn("rank", rank).where("rank is not null")
    seq = F.row_number().over(Window.partitionBy(*PAGE).orderBy("rank", "reading_order", "element_id"))
    return first.select(*PAGE, seq.alias("seq"), name.alias("layer"), "element_id")


def clamp_boxes(boxes: DataFrame, slack: float = 100.0) -> DataFrame:
    """(page, element_id, verdict, x, y, width, height): boxes (with type, text, page_width, page_height) that are negative or further than ``slack`` outside
    are rejected, repeated texts in one place are dropped, the others are moved inside."""
    right, low = F.col("x") + F.col("width") - F.col("page_width"), F.col("y") + F.col("height") - F.col("page_height")
    bad = (F.col("type") != "line") & ((F.col("width") < 0) | (F.col("height") < 0))
    far = (F.col("x") < -slack) | (F.col("y") < -slack) | (F.col("x") > F.col("page_width") + slack) | (F.col("y") > F.col("page_height") + slack)
    same = Window.partitionBy(*PAGE, "text", *(F.bround(c, 2) for c in ("x", "y", "width", "height"))).orderBy("ord")
    again = (F.coalesce("text", F.lit("")) != "") & (F.row_number().over(same) > 1)
    at = lambda v, over: F.when(over > 0, F.when(F.col(v) >= over, F.col(v) - over).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.col(v)))
    size = lambda v, at_, over, total: F.when((over > 0) & (F.col(at_) < over), F.col(total)).otherwise(F.col(v))
    return boxes.select(
        *PAGE, "element_id", F.when(bad, "negative_size").when(far, "out_of_bounds").when(again, "repeated").otherwise("ok").alias("verdict"), at("x", right).alias("x"), at("y", low).alias("y"),
        size("width", "x", right, "page_width").alias("width"), size("height", "y", low, "page_height").alias("height"),
    )


def cells_outside(tables: DataFrame, cells: DataFrame, slack: float = 20.0) -> DataFrame:
    """(table_id, row, col, verdict, x, y): cells further than ``slack`` outside their table are rejected, those nearer are moved inside."""
    t = tables.select("table_id", *(F.col(c).alias(f"t{c}") for c in ("x", "y", "width", "height")))
    c = cells.join(t, "table_id")
    out = lambda s: F.expr(f"x < tx - {s} or y < ty - {s} or x + width > tx + twidth + {s} or y + height > ty + theight + {s}")
    move = lambda v, s: F.when(out(0), F.expr(f"greatest(t{v}, least({v}, t{v} + t{s} - {s}))")).otherwise(F.col(v))
    return c.select("table_id", "row", "col", F.when(out(slack), "rejected").when(out(0), "moved").otherwise("ok").alias("verdict"), move("x", "width").alias("x"), move("y", "height").alias("y"))


def final_violations(form: DataFrame, tables: DataFrame, order: DataFrame, slack: float = 10.0) -> DataFrame:
    """(page, violation, subject): pages without a size, repeated ids, tables (page, element_id, x, y, n_rows, n_cols) and texts in one place, boxes further than
    ``slack`` outside, and ids in the reading order (page, element_id) that no element has."""
    one = lambda df, name, subject: df.select(*PAGE, F.lit(name).alias("violation"), subject.cast("string").alias("subject"))
    size = one(form.where("page_width <= 0 or page_height <= 0").select(*PAGE).distinct(), "page_size", F.lit(""))
    ids = one(form.groupBy(*PAGE, "element_id").count().where("count > 1"), "duplicate_id", F.col("element_id"))
    again = one(tables.groupBy(*PAGE, "x", "y", "n_rows", "n_cols").agg(F.count("*").alias("c"), F.min("element_id").alias("element_id")).where("c > 1"), "duplicate_table", F.col("element_id"))
    text = one(form.where(F.col("type").isin("text_box", "text")).groupBy(*PAGE, "x", "y", "text").agg(F.count("*").alias("c"), F.min("element_id").alias("element_id")).where("c > 1"), "duplicate_text", F.col("element_id"))
    far = one(form.where(f"x < -{slack} or y < -{slack} or x > page_width + {slack} or y > page_height + {slack}"), "out_of_bounds", F.col("element_id"))
    lost = one(order.join(form.select(*PAGE, "element_id"), [*PAGE, "element_id"], "left_anti"), "unknown_in_order", F.col("element_id"))
    return size.unionByName(ids).unionByName(again).unionByName(text).unionByName(far).unionByName(lost)


def integrity(records: DataFrame) -> DataFrame:
    """(page, violation): the keys of a page's integrity record that are missing in a stage or change between stages; records: (page, stage, key, value)."""
    n = records.groupBy(*PAGE).agg(F.countDistinct("stage").alias("stages"))
    k = records.where(F.col("key").isin(*INTEGRITY)).groupBy(*PAGE, "key").agg(F.countDistinct("stage").alias("seen"), F.countDistinct("value").alias("values"))
    want = n.select(*PAGE, "stages", F.explode(F.array(*(F.lit(x) for x in INTEGRITY))).alias("key"))
    met = want.join(k, [*PAGE, "key"], "left")
    return met.select(*PAGE, "key", F.when(F.coalesce("seen", F.lit(0)) < F.col("stages"), "missing").when(F.col("values") > 1, "changed").alias("violation")).where("violation is not null")


def image_hash_violations(images: DataFrame) -> DataFrame:
    """Images (key, image_data in base64, image_hash) whose hash is not that of their bytes."""
    return images.where((F.col("image_data") != "") & (F.col("image_hash") != "") & (F.coalesce(F.sha2(F.try_to_binary("image_data", F.lit("base64")), 256), F.lit("")) != F.col("image_hash")))


def consistent(a: Column, b: Column, least: float = 0.4) -> Column:
    """Whether two readings of a page have enough words in common."""
    return similarity(a, b) >= least


def consumed_spans(spans: DataFrame, tables: DataFrame, slack: float = 500.0) -> DataFrame:
    """(page, element_id, table_id, first): texts that start in a table's box, and whether they are the first there."""
    t = tables.select(*PAGE, F.col("element_id").alias("table_id"), F.col("ord").alias("t_ord"), *(F.col(c).alias(f"t_{c}") for c in ("x", "y", "width", "height")))
    met = spans.join(t, PAGE).where(f"x between t_x - {slack} and t_x + t_width + {slack} and y between t_y - {slack} and t_y + t_height + {slack}")
    return met.select(*PAGE, "element_id", "table_id", (F.row_number().over(Window.partitionBy(*PAGE, "table_id").orderBy("ord")) == 1).alias("first"))


def background_at(boxes: DataFrame, drawings: DataFrame, least: float = 10.0) -> DataFrame:
    """(page, element_id, background): the colour of the last drawing that is filled, not white, and shares more than ``least`` with a box."""
    d = drawings.where("fill_color <> '' and lower(fill_color) <> '#ffffff'").select(*PAGE, F.col("ord").alias("d_ord"), "fill_color", *(F.col(c).alias(f"d_{c}") for c in ("x", "y", "width", "height")))
    met = boxes.select(*PAGE, "element_id", "x", "y", "width", "height").join(d, PAGE)
    wide, high = "(least(x + width, d_x + d_width) - greatest(x, d_x))", "(least(y + height, d_y + d_height) - greatest(y, d_y))"
    met = met.where(f"{wide} > 0 and {high} > 0 and {wide} * {high} > {least}")
    return met.groupBy(*PAGE, "element_id").agg(F.max_by("fill_color", "d_ord").alias("background"))


def boxes_without_text(boxes: DataFrame, texts: DataFrame, slack: float = 5.0) -> DataFrame:
    """Boxes in whose middle no text stands."""
    t = texts.select(*PAGE, *(F.col(c).alias(f"t_{c}") for c in ("x", "y", "width", "height")))
    inside = f"x + width / 2 between t_x - {slack} and t_x + t_width + {slack} and y + height / 2 between t_y - {slack} and t_y + t_height + {slack}"
    b, t = boxes.alias("b"), t.alias("t")
    return b.join(t, [*(F.col(f"b.{c}") == F.col(f"t.{c}") for c in PAGE), F.expr(inside)], "left_anti")


def inside_crop(boxes: DataFrame, crops: DataFrame) -> DataFrame:
    """(page, element_id, x, y): boxes whose middle lies in their page's crop (page, x, y, width, height), in its coordinates."""
    c = crops.select(*PAGE, *(F.col(k).alias(f"c_{k}") for k in ("x", "y", "width", "height")))
    met = boxes.join(c, PAGE).where("x + width / 2 between c_x and c_x + c_width and y + height / 2 between c_y and c_y + c_height")
    return met.select(*PAGE, "element_id", (F.col("x") - F.col("c_x")).alias("x"), (F.col("y") - F.col("c_y")).alias("y"))


def append_new(*lists: DataFrame) -> DataFrame:
    """Elements of several extractors, of one id on a page the first."""
    every = None
    for i, part in enumerate(lists):
        part = part.withColumn("source_no", F.lit(i))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    k = F.row_number().over(Window.partitionBy(*PAGE, "element_id").orderBy("source_no", "ord"))
    return every.withColumn("k", k).where("k = 1").drop("k")


def suppressed_cells(cells: DataFrame, texts: DataFrame, reach: float = 400.0) -> DataFrame:
    """(page, table_id, row, col, element_id): cells whose text a loose text of their page has too: by row and column each takes the nearest text that equals, holds
    or lies in its own without spaces and case, if that is nearer than ``reach``; a text is taken once."""
    squeeze = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    square = lambda c: f"cast(floor({c} / {reach * 1.001}) as long)"
    middle = {"cx": F.expr("x + width / 2"), "cy": F.expr("y + height / 2")}
    c = cells.where(F.coalesce("text", F.lit("")) != "").withColumns(middle).select(*PAGE, "table_id", "row", "col", "cx", "cy", squeeze(F.col("text")).alias("t"), F.monotonically_increasing_id().alias("cell"))
    t = texts.withColumns(middle).select(*PAGE, "element_id", "x", "y", F.col("cx").alias("tx"), F.col("cy").alias("ty"), squeeze(F.col("text")).alias("u"))
    # a cell looks for texts in the nine squares around it
    c = c.withColumn("i", F.explode(F.expr(f"transform(sequence(-1L, 1L), d -> {square('cx')} + d)"))).withColumn("j", F.explode(F.expr(f"transform(sequence(-1L, 1L), d -> {square('cy')} + d)")))
    met = c.join(t.withColumns({"i": F.expr(square("tx")), "j": F.expr(square("ty"))}), [*PAGE, "i", "j"]).withColumn("d", F.expr("sqrt((cx - tx) * (cx - tx) + (cy - ty) * (cy - ty))"))
    met = met.where(F.col("d") < reach).where(F.contains("u", F.col("t")) | F.contains("t", F.col("u")))
    met = met.select(*PAGE, "table_id", "row", "col", "cell", "element_id", "d", "y", "x")

    def match(page: pd.DataFrame) -> pd.DataFrame:
        """Only pairs that could match come here, the nearest of a cell first."""
        page = page.sort_values(["row", "col", "table_id", "cell", "d", "y", "x", "element_id"])
        used, done, take = set(), set(), []
        for at, r in enumerate(page.itertuples()):
            if r.cell not in done and r.element_id not in used:
                done.add(r.cell)
                used.add(r.element_id)
                take.append(at)
        return page.iloc[take][[*PAGE, "table_id", "row", "col", "element_id"]]

    return met.groupBy(*PAGE).applyInPandas(match, met.select(*PAGE, "table_id", "row", "col", "element_id").schema)


def wrapped_lines(texts: DataFrame, key: str, width: int) -> DataFrame:
    """(key, line_no, line): words put on lines of at most ``width`` characters, a longer word alone; a text without words has one empty line."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    start = "named_struct('done', cast(array() as array<string>), 'line', cast(null as string))"
    step = f"if(z.line is null, named_struct('done', z.done, 'line', w), if(length(z.line) + 1 + length(w) <= {width}, named_struct('done', z.done, 'line', concat(z.line, ' ', w)), named_struct('done', concat(z.done, array(z.line)), 'line', w)))"
    lines = f"aggregate(words, {start}, (z, w) -> {step}, z -> concat(z.done, array(coalesce(z.line, ''))))"
    return texts.select(key, words.alias("words")).select(key, F.posexplode(F.expr(lines)).alias("line_no", "line"))
