"""Lines, blocks and sections of a page's texts, with their roles and content.

Distances are for a canvas of 1,920 pixels; they grow with the canvas where it is in EMU.  A null text counts as empty; ties are
broken by ``ord``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.classify import first_of
from quire.operators.forms import key_values, strip
from quire.operators.layout import islands
from quire.sources.elements import PAGE

#: Vertical bands of a page, and words of panels, tasks, scenes and letters.
TITLE_BAND, HEADER_BAND, FOOTER_BAND = 0.12, 0.25, 0.88
PANEL, TASK, SCENE, LETTER = ("mapped skills", "success indicators"), ("learner task", "activity", "task"), ("workplace context", "scenario"), ("dear ", "sincerely", "regards")
BODIES = ("body_section", "task_content", "numbered_list", "bulleted_list", "letter_content")


def canvas(elements: DataFrame) -> DataFrame:
    """(page, canvas_width, canvas_height, aspect): EMU where an element reaches beyond 100,000, else pixels of at least 1920 x 1080."""
    r = elements.groupBy(*PAGE).agg(F.max(F.expr("x + width")).alias("mx"), F.max(F.expr("y + height")).alias("my"))
    size = lambda v, emu, px: F.when(F.col("mx") > 100_000, F.greatest(F.col(v), F.lit(emu))).otherwise(F.greatest(F.col(v), F.lit(px)))
    r = r.withColumns({"canvas_width": size("mx", 12_192_000.0, 1920.0), "canvas_height": size("my", 6_858_000.0, 1080.0)}).withColumn("ratio", F.col("canvas_width") / F.col("canvas_height"))
    near = lambda a, b: F.abs(F.col("ratio") - a / b) < 0.1
    aspect = F.when(near(16, 9), "16:9").when(near(4, 3), "4:3").otherwise(F.format_string("%.2f:1", "ratio"))
    return r.select(*PAGE, "canvas_width", "canvas_height", aspect.alias("aspect"))


def text_elements(elements: DataFrame) -> DataFrame:
    """Elements but images with two characters that are no space, their text stripped."""
    e = elements.withColumn("text", strip(F.coalesce("text", F.lit(""))))
    return e.where((F.col("element_type") != "image") & (F.length(F.regexp_replace("text", r"\s+", "")) >= 2))


def card_of(elements: DataFrame) -> DataFrame:
    """(page, element_id, card_id): the first shape whose box holds an element's centre."""
    at = elements.select(*PAGE, "element_id", F.expr("x + width / 2").alias("cx"), F.expr("y + height / 2").alias("cy"))
    card = elements.where(F.col("element_type").isin("shape", "rectangle")).select(*PAGE, F.col("element_id").alias("card_id"), F.col("ord").alias("card_ord"), "x", "y", "width", "height")
    met = at.join(card, PAGE).where("cx >= x and cx <= x + width and cy >= y and cy <= y + height")
    return met.groupBy(*PAGE, "element_id").agg(F.min_by("card_id", "card_ord").alias("card_id"))


def text_lines(elements: DataFrame) -> DataFrame:
    """(page, line_no, text, x, y, width, height, font, bold, font_size, fill_color, text_color, card_id, parts): texts by place, a new line where the centre is
    further than 20 pixels from the one before or the card is another; in a line from left to right.  The style is that of its first element."""
    card = card_of(elements)
    t = text_elements(elements).join(canvas(elements), PAGE).join(card, [*PAGE, "element_id"], "left")
    t = t.withColumn("scale", F.when(F.col("canvas_width") > 100_000, F.col("canvas_width") / 1920).otherwise(1.0)).withColumn("cy", F.expr("y + height / 2"))
    by = Window.partitionBy(*PAGE).orderBy("y", "x", "ord")
    t = t.withColumns({"cy0": F.lag("cy").over(by), "card0": F.lag("card_id").over(by)})
    t = islands(t, PAGE, ["y", "x", "ord"], F.expr("abs(cy - cy0) > 20 * scale or not (card_id <=> card0)"), "line_no")
    item = F.struct("x", "y", "ord", "text", "bold", "font_size", "fill_color", "text_color", "card_id")
    g = t.groupBy(*PAGE, "line_no").agg(
        F.sort_array(F.collect_list(item)).alias("l"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.expr("x + width")) - F.min("x")).alias("width"),
        (F.max(F.expr("y + height")) - F.min("y")).alias("height"), F.avg(F.coalesce(F.expr("nullif(font_size, 0)"), F.col("height"))).alias("font"), F.first("scale").alias("scale"), F.count("*").alias("parts"),
    )
    first = lambda c: F.col("l")[0][c].alias(c)
    return g.select(*PAGE, "line_no", F.array_join(F.transform("l", lambda s: s["text"]), " ").alias("text"), "x", "y", "width", "height", "font", *(first(c) for c in ("bold", "font_size", "fill_color", "text_color", "card_id")), "scale", "parts")


def text_blocks(lines: DataFrame, canvases: DataFrame) -> DataFrame:
    """(page, block_no, text, x_pct, y_pct, width_pct, height_pct, font, lines, bold, ...): lines that follow within 40 pixels, overlap in x by three tenths of
    the narrower and lie in one card.  The style is that of the line with the largest font."""
    by = Window.partitionBy(*PAGE).orderBy("line_no")
    before = {f"{c}0": F.lag(c).over(by) for c in ("x", "y", "width", "height", "card_id")}
    rows = lines.withColumns(before)
    apart = "y - y0 - height0 > 40 * scale or not (least(x0 + width0, x + width) - greatest(x0, x) > 0.3 * least(width0, width)) or not (card_id <=> card_id0)"
    rows = islands(rows, PAGE, ["line_no"], F.expr(f"x0 is null or ({apart})"), "block_no")
    best = F.max_by(F.struct("bold", "font_size", "fill_color", "text_color"), F.struct("font", -F.col("line_no"))).alias("s")
    g = rows.groupBy(*PAGE, "block_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("line_no", "text")))), lambda s: s["text"]), "\n").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"),
        F.max(F.expr("x + width")).alias("x1"), F.max(F.expr("y + height")).alias("y1"), F.avg("font").alias("font"), F.count("*").alias("lines"), best,
    ).join(canvases, PAGE)
    pct = lambda v, total: F.bround(100 * v / F.col(total), 1)
    return g.select(
        *PAGE, "block_no", "text", pct(F.col("x"), "canvas_width").alias("x_pct"), pct(F.col("y"), "canvas_height").alias("y_pct"), pct(F.col("x1") - F.col("x"), "canvas_width").alias("width_pct"),
        pct(F.col("y1") - F.col("y"), "canvas_height").alias("height_pct"), F.bround("font", 1).alias("font"), "lines", F.col("s.bold").alias("bold"), F.col("s.fill_color").alias("fill_color"), F.col("s.text_color").alias("text_color"),
    )


def block_role() -> Column:
    """A block's role by its band, its style and its words."""
    low, t, at = F.lower(strip(F.col("text"))), F.col("text"), F.col("y_pct") / 100.0
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    has = lambda *of: low.rlike("|".join(of))
    bold = F.coalesce("bold", F.lit(False))
    top, head = at < TITLE_BAND, at < HEADER_BAND
    return first_of([
        ("title", top & ((F.col("font") > 18) | bold)), ("subtitle", top), ("footer", at > FOOTER_BAND), ("metadata_row", head & F.contains(t, F.lit(":")) & (F.length(t) < 200)), ("heading", head & bold & (F.length(t) < 100)),
        ("skills_panel", has(*PANEL)), ("task_heading", has(*TASK) & (bold | (words(low) < 6))), ("task_content", has(*TASK)), ("context_section", has(*SCENE)), ("letter_content", has(*LETTER)),
        ("numbered_list", strip(t).rlike(r"^[0-9]+\.\s")), ("bulleted_list", strip(t).rlike("^[•-]")), ("heading", bold & (words(t) < 8)),
    ], "body_section")


def sections(blocks: DataFrame) -> DataFrame:
    """(page, section_no, role, heading, text, y_pct): blocks with roles; a heading and the body after it are one section."""
    b = blocks.withColumn("role", block_role())
    by = Window.partitionBy(*PAGE).orderBy("block_no")
    heads = F.col("role").isin("heading", "task_heading")
    b = b.withColumns({"takes": heads & F.coalesce(F.lead("role").over(by).isin(*BODIES), F.lit(False)), "next_text": F.lead("text").over(by)})
    b = b.withColumn("taken", F.coalesce(F.lag("takes").over(by), F.lit(False))).where("not taken")
    role = F.when(F.col("takes") & (F.col("role") == "task_heading"), "task_section").when(F.col("takes"), "content_section").otherwise(F.col("role"))
    return b.select(*PAGE, F.col("block_no").alias("section_no"), role.alias("role"), F.when(F.col("takes"), F.col("text")).alias("heading"), F.when(F.col("takes"), F.col("next_text")).otherwise(F.col("text")).alias("text"), "y_pct")


def section_meaning(sections: DataFrame) -> DataFrame:
    """Sections of all sources in order of place (missing places first), with purpose, visual role, importance and semantic role."""
    r = F.lower("role")
    has = lambda *of: r.rlike("|".join(of))
    order = Window.partitionBy(*PAGE).orderBy(F.coalesce("y_pct", F.lit(0.0)), "section_no")
    return sections.select(
        *PAGE, "section_no", "role", F.row_number().over(order).alias("reading_order"),
        first_of([("Title", has("title")), ("Introduction", has("header")), ("Comparison", has("table")), ("Summary", has("chart")), ("Process", has("flowchart", "process"))], "Explanation").alias("purpose"),
        first_of([("Title", has("title")), ("Table", has("table")), ("Infographic", has("chart"))], "Card").alias("visual_role"),
        F.when(has("title", "heading", "chart"), "high").otherwise("medium").alias("importance"),
        first_of([("Title", has("title")), ("Numbered process", has("process", "step")), ("Callout", has("callout", "alert"))], "Explanation").alias("semantic_role"),
    )


def section_pairs(sections: DataFrame) -> DataFrame:
    """(key, n, label, value): label-and-value lines of sections that may hold them."""
    kept = sections.where(F.col("role").isin("metadata_row", "info_card", "body_section"))
    return key_values(kept.withColumn("key", F.concat_ws("/", *(F.col(c).cast("string") for c in (*PAGE, "section_no")))), "key")


def font_levels(elements: DataFrame) -> DataFrame:
    """(page, title, heading, body): the largest, second and, of three or more, smallest font size; 24, 18 and 12 where there is none."""
    s = elements.groupBy(*PAGE).agg(F.sort_array(F.collect_set(F.expr("nullif(font_size, 0)")), False).alias("s"))
    n = F.size("s")
    return s.select(*PAGE, F.when(n == 0, 24.0).otherwise(F.get("s", F.lit(0))).alias("title"), F.when(n == 0, 18.0).otherwise(F.get("s", F.lit(1))).alias("heading"), F.when(n == 0, 12.0).when(n >= 3, F.get("s", n - 1)).alias("body"))


def verbatim(elements: DataFrame, garbled: Column) -> DataFrame:
    """(page, texts): every text of a page once, in order of place, but for garbled ones."""
    t = text_elements(elements).where(~garbled).groupBy(*PAGE, "text").agg(F.min(F.struct("y", "x", "ord")).alias("at"))
    return t.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), " | ").alias("texts"))
