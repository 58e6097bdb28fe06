"""What tables, pictures and pages say in sentences, and JSON out of a model's answer.

Cells are rows (table_id, row, col, text).  Null texts count as empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.classify import first_of
from quire.operators.flows import labels
from quire.operators.forms import strip
from quire.operators.tables import table_profile, table_rows
from quire.sources.elements import PAGE

#: Families of tables by their words, in order; verbs that a picture's texts may hold; kinds of files by content type.
FAMILIES = (
    ("financial_table", ("revenue", "ebitda", "profit", "budget", "cost", "total", "balance sheet", "income statement", "cash flow", "audited", "financials")),
    ("procurement_table", ("procurement", "supply", "quantity", "unit price", "part number", "part no", "manufacturer", "supplier", "line item", "invoice")),
    ("inventory_table", ("inventory", "stock", "warehouse", "sku", "qty", "reorder", "bin number", "serial number")),
    ("regulatory_table", ("compliance", "regulation", "standard", "clause", "requirement", "policy", "law", "statute", "iso", "fda", "epa", "osha")),
    ("technical_table", ("specification", "technical", "parameter", "range", "tolerance", "min", "max", "output", "voltage", "current", "system requirement")),
    ("form_table", ("first name", "last name", "address", "phone", "email", "date of birth", "ssn", "signature", "checkbox", "fill in", "applicant")),
    ("schedule_table", ("schedule", "agenda", "time", "date", "speaker", "session", "milestone", "deadline", "duration")),
    ("matrix_table", ("evaluation", "criteria", "weight", "score", "rating", "matrix", "pivot")),
)
ACTIONS = ("open", "close", "start", "stop", "create", "delete", "get", "send", "receive", "process")
CONTENT_TYPES = ((".pptx", ("presentation", "powerpoint")), (".pdf", ("pdf",)), (".png", ("image/png",)), (".jpg", ("image/jpeg", "image/jpg")))
PARITY = "Apply the specific background colors and text weights defined in the 'cells' metadata to ensure visual parity."


def table_class(cells: DataFrame) -> DataFrame:
    """(table_id, table_class): the first family with a word anywhere in a table's texts, a matrix by its shape, else a simple table."""
    said = table_rows(cells).groupBy("table_id").agg(F.lower(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", F.array_join("all", " ").alias("t")))), lambda s: s["t"]), " ")).alias("t"))
    met = said.join(table_profile(cells).select("table_id", "is_pivot"), "table_id")
    rules = [(name, F.col("t").rlike("|".join(words))) for name, words in FAMILIES]
    return met.select("table_id", first_of([*rules, ("matrix_table", F.col("is_pivot"))], "simple_table").alias("table_class"))


def table_words(cells: DataFrame) -> DataFrame:
    """(table_id, title, summary, reading_order, strategy, insights, interpretation): a table by its profile, its headers and its row names."""
    rows = table_rows(cells)
    p = table_profile(cells)
    head = F.max(F.when(F.col("row") == 0, F.transform(F.filter("all", lambda t: F.trim(t) != ""), lambda t: F.trim(t)))).alias("headers")
    first = F.trim(F.col("all")[0])
    names = F.slice(F.transform(F.sort_array(F.collect_list(F.when((F.col("row") > 0) & (first != "") & ~F.lower(first).rlike("total|sum"), F.struct("row", first.alias("t"))))), lambda s: s["t"]), 1, 6).alias("names")
    section = (F.col("row") >= F.col("depth")) & (F.size("filled") == 1) & (F.col("row") < F.col("n_rows") - 1)
    depth = p.select("table_id", F.col("header_depth").alias("depth"))
    own = rows.join(depth, "table_id").groupBy("table_id").agg(head, names, F.array_join(F.transform(F.sort_array(F.collect_list(F.when(section, F.col("row")))), lambda r: r.cast("string")), ", ").alias("sections"))
    t = p.join(own, "table_id").withColumn("headers", F.coalesce("headers", F.array().cast("array<string>")))
    text = lambda c: F.col(c).cast("string")
    some = F.size("headers") > 0
    insight = F.concat_ws(
        " ", F.when(some, F.concat(F.lit("The table contains "), F.size("headers").cast("string"), F.lit(" key dimensions."))), F.when(F.col("n_rows") > 1, F.concat(F.lit("The table compares "), (F.col("n_rows") - 1).cast("string"), F.lit(" entities."))),
        F.when(F.col("is_financial"), F.lit("The table contains financial reporting information.")),
    )
    strategy = F.concat_ws(
        " ", F.when(F.col("archetype") == "complex_cross_tab", F.concat(F.lit("Recreate as a multi-tier hierarchical matrix. Map the top "), text("header_depth"), F.lit(" rows as spanning headers."))),
        F.when(F.col("is_pivot"), F.lit("The first column contains primary row identifiers; treat as Y-axis headers.")),
        F.when(F.col("sections") != "", F.concat(F.lit("This table contains mid-table section headers at rows ["), "sections", F.lit("]. These should span the full width."))), F.lit(PARITY),
    )
    t = t.withColumn("insights", insight)
    interpretation = F.concat_ws(
        " ", F.when(F.col("is_financial"), F.lit("This is a audit-style financial table.")).otherwise("This is a standard table."), F.when(some, F.concat(F.lit("It contains columns for: "), F.array_join("headers", ", "), F.lit("."))),
        F.when(F.col("has_subtotals"), F.lit("The table contains subtotal rows for intermediate sums.")), F.when(F.col("has_totals"), F.lit("The table contains overall totals or summary rows.")),
        F.when(F.size("names") > 0, F.concat(F.lit("Row items include: "), F.array_join("names", ", "), F.lit("."))), F.when(F.col("insights") != "", F.concat(F.lit("Key insights: "), "insights")),
    )
    return t.select(
        "table_id", F.when(some, F.concat(F.lit("Table showing "), F.array_join(F.slice("headers", 1, 3), ", "))).otherwise("Untitled Table").alias("title"),
        F.concat(F.lit("A "), "archetype", F.lit(" with "), text("n_rows"), F.lit(" rows and "), text("n_cols"), F.lit(" columns.")).alias("summary"), F.when(F.col("is_pivot"), "column-major").otherwise("row-major").alias("reading_order"),
        strategy.alias("strategy"), "insights", interpretation.alias("interpretation"),
    )


def render_cells(cells: DataFrame) -> DataFrame:
    """Every slot of a table's grid as it is drawn without more knowledge: the first row is a header and bold."""
    n = cells.groupBy("table_id").agg(F.max("row").alias("r"), F.max("col").alias("c"))
    grid = n.select("table_id", F.explode(F.sequence(F.lit(0), "r")).alias("row"), "c").select("table_id", "row", F.explode(F.sequence(F.lit(0), "c")).alias("col"))
    met = grid.join(cells, ["table_id", "row", "col"], "left")
    return met.select("table_id", "row", "col", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("row") == 0, "header").otherwise("data").alias("cell_type"), (F.col("row") == 0).alias("bold"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"))


def table_sections(cells: DataFrame) -> DataFrame:
    """(table_id, headers, n_rows, n_cols, rows): a table as a section: its first row, and the others joined."""
    rows = table_rows(cells)
    line = F.array_join("all", " | ")
    return rows.groupBy("table_id").agg(
        F.max(F.when(F.col("row") == 0, line)).alias("headers"), F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("row") > 0, F.struct("row", line.alias("l"))))), lambda s: s["l"]), "\n").alias("rows"),
    )


def picture_facts(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, image_type, scene, actions): pages with title, is_flowchart, is_diagram; their kind, a description by the first four texts, and the texts that hold a verb of action, once a verb."""
    t = strip(F.coalesce("text", F.lit("")))
    verbs = F.filter(F.array(*(F.when(F.contains(F.lower(t), F.lit(v)), F.struct("ord", F.lit(i).alias("i"), F.col("text"))) for i, v in enumerate(ACTIONS))), lambda v: v.isNotNull())
    e = elements.withColumns({"t": t, "verbs": F.when(t != "", verbs)})
    told = F.slice(F.transform(F.sort_array(F.collect_list(F.when((F.col("t") != "") & (F.col("element_type") != "image"), F.struct("ord", "t")))), lambda s: s["t"]), 1, 4)
    a = e.groupBy(*PAGE).agg(
        told.alias("told"), F.count_if(F.col("element_type") == "image").alias("images"), F.count_if(F.col("element_type").isin("shape", "text_box", "placeholder", "freeform", "image")).alias("visuals"),
        F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list("verbs"))), lambda s: s["text"]), "; ").alias("actions"),
    ).join(pages, PAGE)
    yes = lambda c: F.coalesce(c, F.lit(False))
    title = F.coalesce(F.expr("nullif(title, '')"), F.lit("Untitled Slide"))
    scene = F.when(F.size("told") > 0, F.concat(F.lit("Slide '"), title, F.lit("': "), F.array_join("told", "; "))).otherwise(F.concat(F.lit("Slide titled '"), title, F.lit("' contains "), F.col("images").cast("string"), F.lit(" image(s) and "), F.col("visuals").cast("string"), F.lit(" visual element(s).")))
    kind = first_of([("flowchart", yes("is_flowchart")), ("diagram", yes("is_diagram")), ("image_based_slide", F.col("images") > 0)], "content_slide")
    return a.select(*PAGE, kind.alias("image_type"), scene.alias("scene"), "actions")


def plain_flow(elements: DataFrame, order: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, flow, story): what a page shows in one sentence, by the first that is there: its plain summary, the ends of its reading order (page, element_id, position), words of
    abstraction, its interpretation, its title; and how it tells it.  pages: title, plain, interpretation, is_flowchart, layout_type."""
    own = labels(elements)
    read = order.join(own, [*PAGE, "element_id"]).where(~F.startswith("label", F.lit("["))).groupBy(*PAGE).agg(F.min_by("label", "position").alias("a"), F.max_by("label", "position").alias("z"), F.count("*").alias("n"))
    said = own.groupBy(*PAGE).agg(F.max(F.lower("label").rlike("abstraction|agent|decision|state|temporal")).alias("abstract"))
    p = pages.join(read, PAGE, "left").join(said, PAGE, "left")
    sentence = lambda c: strip(F.substring_index(F.coalesce(c, F.lit("")), ".", 1))
    plain, interpretation = sentence("plain"), sentence("interpretation")
    low = F.concat(F.lower(F.substring(plain, 1, 1)), F.substr(plain, F.lit(2)))
    title = F.coalesce(F.expr("nullif(title, '')"), F.lit("the slide content"))
    flow = (
        F.when(plain != "", F.concat(F.lit("The slide shows "), low, F.lit("."))).when(F.col("n") >= 2, F.concat(F.lit("The slide shows a progression from "), "a", F.lit(" → "), "z"))
        .when(F.col("n") == 1, F.concat(F.lit("The slide focuses on "), "a", F.lit("."))).when(F.coalesce("abstract", F.lit(False)), "The slide shows a transformation from low-level environment representation → high-level reasoning")
        .when(interpretation != "", F.concat(interpretation, F.lit("."))).otherwise(F.concat(F.lit("The slide presents and explains "), title, F.lit(".")))
    )
    story = (
        F.when(F.coalesce("is_flowchart", F.lit(False)), "chronological/process flow showing step-by-step progress").when(F.col("layout_type") == "two_column", "comparison/contrast layout between left and right sections")
        .otherwise("hierarchical presentation of title and supporting details")
    )
    return p.select(*PAGE, flow.alias("flow"), story.alias("story"))


def concept_layers(elements: DataFrame, titles: DataFrame) -> DataFrame:
    """(page, element_id, layer): texts but the title: several lines as a heading and its body, short ones with a capital as a concept."""
    e = elements.join(titles, PAGE, "left").withColumn("t", strip(F.coalesce("text", F.lit("")))).where((F.col("t") != "") & (F.col("t") != F.coalesce("title", F.lit(""))))
    body = F.replace(strip(F.regexp_replace("t", r"(?s)^[^\n]*\n", "")), F.lit("\n"), F.lit(" "))
    layer = F.when(F.contains("t", F.lit("\n")), F.concat(strip(F.substring_index("t", "\n", 1)), F.lit(": "), body)).when((F.length("t") < 80) & F.col("t").rlike("^[A-Z]"), F.concat("t", F.lit(": Key concept illustrated on this slide.")))
    return e.select(*PAGE, "element_id", layer.alias("layer")).where("layer is not null")


def json_block(answer: Column) -> Column:
    """What stands between the first and the last brace of a text, with quotes, brackets and braces closed that were left open; null where no brace is."""
    from quire.operators.ocr import steps

    start = F.instr(answer, "{")
    last = F.length(answer) - F.length(F.substring_index(answer, "}", -1))
    block = F.when((start > 0) & (last >= start) & F.contains(answer, F.lit("}")), F.substr(answer, start, last - start + 1)).when(start > 0, F.substr(answer, start))

    def repair(t: Column) -> Column:
        bare = F.regexp_replace(t, r"\\.", "")
        # outside of quotes: what is left when closed strings, and one that stays open, are taken out
        out = F.regexp_replace(F.regexp_replace(bare, '"[^"]*"', ""), '(?s)".*$', "")
        count = lambda c, s: F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))
        quote = F.when(count(bare, '"') % 2 == 1, '"').otherwise("")
        # what is open, innermost last
        push = lambda z, b: F.when(b == "[", F.concat(z, F.lit("]"))).when(b == "{", F.concat(z, F.lit("}"))).otherwise(F.left(z, F.length(z) - 1))
        left = F.aggregate(F.regexp_extract_all(out, F.lit(r"[\[\]{}]"), F.lit(0)), F.lit(""), push)
        return F.concat(t, quote, F.reverse(left))

    whole = lambda t: F.when(F.try_parse_json(t).isNotNull(), t).otherwise(repair(strip(F.regexp_replace(t, r",\s*$", ""))))
    return steps(block, whole)


def chart_model(answers: DataFrame, key: str) -> DataFrame:
    """(key, chart_type, title, categories, series): charts out of model answers (key, answer); an answer that is no JSON has type unknown_chart."""
    kind = "chart_type string, title string, categories array<string>, series array<struct<name:string,values:array<string>,color:string>>"
    a = answers.select(key, F.from_json(json_block(F.coalesce("answer", F.lit(""))), kind).alias("c"))
    names = F.array_join(F.transform("c.series", lambda s: F.concat(F.coalesce(s["name"], F.lit("")), F.lit("="), F.array_join(F.coalesce(s["values"], F.array().cast("array<string>")), ","))), ";")
    return a.select(key, F.coalesce("c.chart_type", F.lit("unknown_chart")).alias("chart_type"), F.col("c.title").alias("title"), F.coalesce(F.array_join("c.categories", ","), F.lit("")).alias("categories"), F.coalesce(names, F.lit("")).alias("series"))


def file_kind(path: Column, content_type: Column) -> Column:
    """The kind of a file: what its content type says, else the end of its path without query, in lower case."""
    said = F.lower(F.coalesce(content_type, F.lit("")))
    end = F.lower(F.regexp_extract(F.regexp_replace(path, "[?#].*$", ""), r"(\.[A-Za-z0-9]+)$", 1))
    return F.coalesce(*(F.when(said.rlike("|".join(words)), F.lit(kind)) for kind, words in CONTENT_TYPES), end)


def fidelity(scores: DataFrame, least: float = 0.8) -> DataFrame:
    """(key, table, passed): scores (key, width, height, ssim, layout, border, checkbox) of a drawn page: their mean, for wide pages the first alone."""
    wide = F.col("width") / F.col("height") > 1.2
    table = F.when(wide, F.col("ssim")).otherwise(F.greatest("border", "layout") * 0.95 + F.col("ssim") * 0.05)
    mean = F.when(wide, F.col("ssim")).otherwise((F.col("ssim") + F.col("layout") + F.col("border") + F.col("checkbox") + table) / 5)
    return scores.select("key", F.bround(table, 6).alias("table"), (mean >= least).alias("passed"))


def median_colors(pixels: DataFrame, cell: int = 2) -> DataFrame:
    """(image_id, cell_x, cell_y, r, g, b): the median of each channel in a grid of ``cell`` by ``cell`` over an image's pixels (image_id, x, y, width, height, r, g, b)."""
    at = {"cell_x": F.floor(F.col("x") * cell / F.col("width")).cast("int"), "cell_y": F.floor(F.col("y") * cell / F.col("height")).cast("int")}
    return pixels.withColumns(at).groupBy("image_id", "cell_x", "cell_y").agg(*(F.expr(f"percentile({c}, 0.5)").alias(c) for c in "rgb"))


def next_titles(pages: DataFrame) -> DataFrame:
    """Pages (document_id, slide_number, title) with the last title before them: what a page without one is read against."""
    by = Window.partitionBy("document_id").orderBy("slide_number").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("title_before", F.last(F.expr("nullif(title, '')"), ignorenulls=True).over(by))
