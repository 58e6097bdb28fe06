"""Projections and rules over one page's elements, and over their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.elements import PAGE

#: The default slide in EMU, and words that mark a decision.
SLIDE_WIDTH, SLIDE_HEIGHT = 12_192_000, 6_858_000
DECISION_WORDS = ("decision", "approve", "reject", "valid", "invalid", "yes", "no")
#: Words after which a line goes on.
CONTINUING = (
    "the", "a", "an", "of", "in", "for", "and", "or", "to", "with", "from", "by", "on", "at", "is", "are", "was", "were", "will", "shall", "not", "its", "their", "our", "this", "that",
)
SPACE = r"^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def canvas(elements: DataFrame) -> DataFrame:
    """Width and height of each page (the slide, or what its elements reach), ratio and aspect label."""
    reach = elements.groupBy(*PAGE).agg(
        F.greatest(F.lit(float(SLIDE_WIDTH)), F.max(F.col("x") + F.col("width"))).alias("canvas_width"),
        F.greatest(F.lit(float(SLIDE_HEIGHT)), F.max(F.col("y") + F.col("height"))).alias("canvas_height"),
    )
    ratio = F.col("canvas_width") / F.col("canvas_height")
    near = lambda wide, high: F.abs(ratio - wide / high) < 0.05
    label = F.when(near(16, 9), "16:9").when(near(4, 3), "4:3").when(near(16, 10), "16:10").otherwise("other")
    return reach.withColumns({"ratio": ratio, "aspect": label})


def relative_boxes(elements: DataFrame) -> DataFrame:
    """Boxes as shares of their page, and importance by area."""
    e = elements.join(canvas(elements), PAGE)
    share = F.col("width") * F.col("height") / (F.col("canvas_width") * F.col("canvas_height"))
    return e.select(
        *PAGE, "element_id", F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord")).alias("element_number"),
        F.bround(F.col("x") / F.col("canvas_width"), 6).alias("x_share"), F.bround(F.col("y") / F.col("canvas_height"), 6).alias("y_share"),
        F.when(share > 0.2, "high").when(share > 0.05, "medium").otherwise("low").alias("importance"),
    )


def compass(elements: DataFrame) -> DataFrame:
    """Top, bottom, left, right or centre of the default slide by the element's centre; rows first."""
    across = (F.col("x") + F.col("width") / 2) / SLIDE_WIDTH
    down = (F.col("y") + F.col("height") / 2) / SLIDE_HEIGHT
    label = F.when(down < 0.2, "top").when(down > 0.8, "bottom").when(across < 0.4, "left").when(across > 0.6, "right").otherwise("center")
    return elements.select(*PAGE, "element_id", label.alias("region"))


def next_in_order(elements: DataFrame) -> DataFrame:
    """An edge from each element to the one read after it."""
    by = Window.partitionBy(*PAGE).orderBy("y", "x", "z_order", "ord")
    return elements.select(*PAGE, F.col("element_id").alias("source_element_id"), F.lead("element_id").over(by).alias("target_element_id")).where("target_element_id is not null")


def decision_nodes(elements: DataFrame) -> DataFrame:
    """Boxes that ask, or that hold a decision word anywhere in their text."""
    t = F.lower(F.coalesce("text", F.lit("")))
    return elements.where(F.col("element_type").isin("shape", "text_box") & t.rlike(r"\?|" + "|".join(DECISION_WORDS))).select(*PAGE, "element_id")


def page_text(elements: DataFrame) -> DataFrame:
    """Text of each page in reading order, its hash, and rough numbers of words and lines."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "ord", "text"))), lambda s: s["text"]), " ")
    words = F.size(F.split("page_text", " +"))
    return elements.where("trim(text) <> ''").groupBy(*PAGE).agg(text.alias("page_text")).select(
        *PAGE, "page_text", F.sha2("page_text", 256).alias("page_sha256"), words.alias("n_words"), F.greatest(F.lit(1), F.expr("cast(size(split(page_text, ' +')) div 12 as int)")).alias("n_lines"),
    )


def panel_of(elements: DataFrame, panels: tuple = ("shape", "image", "table")) -> DataFrame:
    """The smallest panel of the page that holds the centre of each other element."""
    at = elements.select(*PAGE, "element_id", (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"), (F.col("width") * F.col("height")).alias("own"))
    over = elements.where(F.col("element_type").isin(*panels)).select(*PAGE, F.col("element_id").alias("panel_id"), F.col("ord").alias("panel_ord"), "x", "y", "width", "height")
    holds = (F.col("panel_id") != F.col("element_id")) & F.col("cx").between(F.col("x"), F.col("x") + F.col("width")) & F.col("cy").between(F.col("y"), F.col("y") + F.col("height"))
    met = at.join(over, PAGE).where(holds & (F.col("width") * F.col("height") > F.col("own")))
    return met.groupBy(*PAGE, "element_id").agg(F.min_by("panel_id", F.struct(F.col("width") * F.col("height"), "panel_ord")).alias("panel_id"))


def first_by_text(elements: DataFrame) -> DataFrame:
    """Of the elements of a page with one text the first."""
    return elements.groupBy(*PAGE, "text").agg(F.min_by("element_id", "ord").alias("element_id"), F.count("*").alias("copies"))


def payload_boxes(elements: DataFrame, width: float, height: float, slack: float = 100.0) -> DataFrame:
    """Boxes for drawing: negative sizes and boxes beyond the page and its slack are rejected, the others are cut to the page."""
    right, low = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    bad = (F.col("width") < 0) | (F.col("height") < 0)
    far = (F.col("x") < -slack) | (F.col("y") < -slack) | (right > width + slack) | (low > height + slack)
    return elements.select(
        *PAGE, "element_id", F.when(bad, "negative_size").when(far, "out_of_bounds").otherwise("ok").alias("verdict"),
        F.greatest(F.lit(0.0), F.least(F.col("x"), F.lit(width))).alias("x1"), F.greatest(F.lit(0.0), F.least(F.col("y"), F.lit(height))).alias("y1"),
        F.greatest(F.lit(0.0), F.least(right, F.lit(width))).alias("x2"), F.greatest(F.lit(0.0), F.least(low, F.lit(height))).alias("y2"),
    )


def color_profile(colors: DataFrame) -> DataFrame:
    """Channels, luminance, contrasting text colour and darkness of ``color`` (#rrggbb)."""
    part = lambda i: F.conv(F.substring("color", i, 2), 16, 10).cast("int")
    c = colors.withColumns({"r": part(2), "g": part(4), "b": part(6)})
    return c.withColumn("light", F.expr("299 * r + 587 * g + 114 * b")).select(
        *colors.columns, "r", "g", "b", "light", F.when(F.col("light") < 130_000, "#FFFFFF").otherwise("#000000").alias("text_color"), (F.col("light") < 127_500).alias("dark"),
    )


def _lines(docs: DataFrame, key: str) -> DataFrame:
    at = docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw"))
    return at.select(key, "pos", strip(F.col("raw")).alias("line")).where("line <> ''")


def key_values(docs: DataFrame, key: str) -> DataFrame:
    """(key, n, label, value) of the texts whose first line has the form ``label: value``; later lines without that form go on the value before."""
    form = r"(?s)^([^:]{2,40}):[\t\n\x0B\f\r ]*(.*)$"
    by = Window.partitionBy(key).orderBy("pos")
    line = _lines(docs, key).withColumn("is_pair", F.col("line").rlike(form))
    line = line.withColumn("n", F.sum(F.col("is_pair").cast("long")).over(by)).withColumn("opens", F.min_by("is_pair", "pos").over(Window.partitionBy(key)))
    part = F.when(F.col("is_pair"), strip(F.regexp_extract("line", form, 2))).otherwise(F.col("line"))
    label = F.max(F.when(F.col("is_pair"), strip(F.regexp_extract("line", form, 1))))
    value = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", part.alias("part")))), lambda s: s["part"]), " ")
    return line.where("opens").groupBy(key, "n").agg(label.alias("label"), value.alias("value"))


def list_items(docs: DataFrame, key: str) -> DataFrame:
    """Lines without their leading number or bullet."""
    clean = F.regexp_replace(F.regexp_replace("line", r"^[0-9]+[.)][\t ]*", ""), r"^[•*-][\t ]*", "")
    return _lines(docs, key).withColumn("item", clean).where("item <> line").select(key, "pos", "item")


def text_figures(docs: DataFrame, key: str) -> DataFrame:
    """Distinct questions and percentages of each text, and the number of its lines that name categories."""
    t = F.coalesce(F.col("text"), F.lit(""))
    # pieces between stops, up to their last question mark: one pass, however long a text without stops is
    tail = lambda p: F.substring_index(p, "?", -1)
    pieces = F.transform(F.filter(F.split(t, r'[.\n"]'), lambda p: F.contains(p, F.lit("?"))), lambda p: F.substr(p, F.lit(1), F.length(p) - F.length(tail(p))))
    asked = F.array_distinct(F.transform(F.filter(pieces, lambda p: F.length(p) > 1), strip))
    categories = F.size(F.filter(F.transform(F.split(t, "\n"), strip), lambda x: (F.length(x) > 3) & ~x.rlike("[0-9]")))
    return docs.select(
        key, F.size(asked).alias("n_questions"), F.array_join(asked, "|").alias("questions"),
        F.array_join(F.regexp_extract_all(t, F.lit(r"(?<![0-9])[0-9]++(?:\.[0-9]++)?+%"), 0), ",").alias("percents"), categories.alias("n_categories"),
    )


def legend(docs: DataFrame, key: str) -> DataFrame:
    """(key, color, label) of ``#rrggbb: label`` and ``label (#rrggbb)``; of one colour the last label, the second form after the first."""
    found = lambda form, c, t, late: F.transform(F.regexp_extract_all("text", F.lit(form), 0), lambda m, i: F.struct(F.lit(late).alias("late"), i.alias("i"), F.upper(F.regexp_extract(m, form, c)).alias("color"), strip(F.regexp_extract(m, form, t)).alias("label")))
    ahead = found(r"(#[0-9A-Fa-f]{6})[\t\n\x0B\f\r ]*[:-][\t\n\x0B\f\r ]*([^,\n.]+)", 1, 2, 0)
    after = found(r"([^,\n.]+)[\t\n\x0B\f\r ]*\((#[0-9A-Fa-f]{6})\)", 2, 1, 1)
    each = docs.select(key, F.inline(F.concat(ahead, after)))
    return each.groupBy(key, "color").agg(F.max_by("label", F.struct("late", "i")).alias("label"))


def continues(docs: DataFrame, key: str) -> DataFrame:
    """Pairs of consecutive lines, and whether the second goes on with the first."""
    by = Window.partitionBy(key).orderBy("pos")
    pair = _lines(docs, key).withColumn("b", F.lead("line").over(by)).where("b is not null").withColumnRenamed("line", "a")
    short = (F.length("a") < 12) & (F.length("b") < 12)
    figure, fixed = r"^[$S5]?[0-9]", ("TBD", "N/A", "Yes", "No")
    values = short & ((F.col("a").rlike(figure) & F.col("b").rlike(figure)) | F.col("a").isin(*fixed) | F.col("b").isin(*fixed))
    on = (~F.col("a").rlike(r"[.!?:]$") & F.col("b").rlike("^[a-z]")) | F.lower("a").rlike(r"(^|[\t ])(" + "|".join(CONTINUING) + ")$")
    return pair.select(key, "pos", (~values & on).alias("continues"))
