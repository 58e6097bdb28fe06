"""What a page, a text or a picture is, by rules over counts, places and words.  The first rule that holds decides.

Null texts and titles count as empty; ties are broken by ``ord``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.classify import first_of
from quire.operators.forms import SLIDE_HEIGHT, SLIDE_WIDTH, strip
from quire.functions.naming import is_metric
from quire.sources.elements import PAGE

#: Words of charts, kinds of documents, domains, sections, and intents by title.
CHART_CUES = (
    "chart", "plot", "axis", "legend", "series", "data points", "centralization", "shared services", "fragmentation", "labor cost", "soc", "span of control", "fte", "funding type", "horizontal bar",
    "stacked bar", "pie", "donut", "ring", "survey result", "percentage of respondents", "agree", "disagree",
)
CHART_PHRASES = (
    "chart showing", "graph showing", "percentage of", "historical trend", "projected growth", "year-over-year", "y-o-y", "survey results", "respondent profile", "market share %", "revenue growth",
    "performance metrics", "kpi dashboard", "donut chart", "ring chart", "circular chart",
)
FINANCIAL = ("audit", "financial", "revenue", "profit", "ebitda", "consolidated")
RESEARCH = ("methodology", "research", "abstract", "literature", "findings")
CONSULTING = ("recommendation", "roadmap", "strategy", "deliverable", "proposal")
DOMAINS = (("technology", ("code", "algorithm", "software", "api")), ("business", ("revenue", "market", "business", "sales")), ("academic", ("research", "study", "data", "analysis")))
SECTIONS = {
    "cover_page": "Title Section", "executive_summary": "Executive Summary Section", "methodology": "Methodology Section", "architecture_diagram": "Architecture & Structure Section",
    "process_flow": "Process & Workflow Section", "infographic": "Visual Overview Section", "comparison": "Comparison Section", "research_report": "Research Details Section",
    "findings": "Findings & Data Section", "recommendations": "Recommendations Section", "conclusion": "Conclusion Section", "appendix": "Appendix Section", "dashboard": "Dashboard & Metrics Section",
}
INTENTS = (("executive_summary", ("summary", "takeaway")), ("recommendations", ("recommend", "next step", "roadmap")), ("appendix", ("appendix", "supplement")), ("comparison", ("compare", "vs")))
CATEGORIES = {"title_slide": "introductory", "content_slide": "informational", "flowchart": "process", "diagram": "conceptual", "image_slide": "visual", "data_table": "data", "chart_slide": "analytical"}
#: What a text of a role is for.
TEXT_GOALS = {
    "title": "Establish the primary subject and frame the slide's content", "heading": "Introduce and organize a thematic section of the slide",
    "subheading": "Provide secondary categorization within a section", "body": "Deliver detailed information, explanation, or context", "bullet": "Present a specific point, item, or supporting detail",
    "label": "Identify or annotate a field, value, or data point", "badge": "Provide quick categorical classification or status indicator", "footer": "Supply reference, attribution, or navigational information",
}
TEXT_INTENTS = {
    "title": "Understand the overarching topic and scope of this slide", "heading": "Recognize the key theme or category being discussed in this section",
    "subheading": "Recognize the key theme or category being discussed in this section", "bullet": "Absorb a specific fact, action item, or supporting detail",
    "label": "Identify what information a particular field or value represents", "footer": "Note source attribution, copyright, or reference information",
}
REGION_PURPOSES = (
    ("header", "Provides the title or heading for the slide content"), ("footer", "Contains reference, attribution, or navigation metadata"), ("body_left", "Primary content area presenting the main information"),
    ("body_right", "Secondary content area providing complementary or contrasting information"), ("body", "Main content area delivering the core message of the slide"),
)
#: Counters of the inventory.
COUNTED = ("text_box", "shape", "arrow", "connector", "image", "table", "group", "chart", "placeholder", "unknown", "title", "header", "footer", "figure", "icon")
HEADER_END, FOOTER_START, TITLE_END = 820_000, 6_030_000, 500_000


def _has(text: Column, words) -> Column:
    return text.rlike("|".join(words))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _mapped(key: Column, values: dict, default) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key], default if isinstance(default, Column) else F.lit(default))


def full_inventory(elements: DataFrame) -> DataFrame:
    """All fifteen counters of a page and its slide type.  An unknown type counts as unknown, a diagram as a figure too, an icon twice."""
    kind = F.col("element_type")
    n = {k: F.count_if(kind == k) for k in COUNTED}
    n["unknown"] = F.count_if((kind == "unknown") | ~kind.isin(*COUNTED))
    n["figure"] = F.count_if(kind.isin("figure", "smartart", "diagram"))
    n["icon"] = 2 * F.count_if(kind == "icon")
    counts = elements.groupBy(*PAGE).agg(F.count("*").alias("total"), *(c.alias(f"{k}s") for k, c in n.items()))
    kind = first_of([("table_slide", F.expr("tables > 0")), ("chart_slide", F.expr("charts > 0")), ("flowchart", F.expr("arrows + connectors > 3")), ("image_heavy", F.expr("images > 3"))], "general")
    return counts.withColumn("slide_type", kind)


def layout_by_content(elements: DataFrame, width: float = SLIDE_WIDTH, height: float = SLIDE_HEIGHT) -> DataFrame:
    """(page, layout_type): a flowchart of two boxes and an arrow, a title with two texts at most, two columns, a diagram with more figures than texts, else one column."""
    text = strip(F.coalesce("text", F.lit(""))) != ""
    kind, cx, cy = F.col("element_type"), F.expr("x + width / 2"), F.expr("y + height / 2")
    body = (cy >= 0.18 * height) & (cy <= 0.85 * height)
    n = F.count_if
    a = elements.groupBy(*PAGE).agg(
        n(kind.isin("shape", "text_box", "placeholder", "unknown")).alias("boxes"), n(kind.isin("arrow", "connector", "freeform")).alias("arrows"), n(text).alias("texts"), n(kind.isin("table", "image")).alias("objects"),
        n(body & (cx < 0.5 * width)).alias("l"), n(body & (cx >= 0.5 * width)).alias("r"), n(kind.isin("image", "shape", "chart")).alias("figures"),
    )
    rules = [("flowchart", "boxes >= 2 and arrows >= 1"), ("title_slide", "texts <= 2 and objects = 0"), ("two_column", "l > 0 and r > 0"), ("diagram", "figures > texts")]
    return a.select(*PAGE, first_of([(k, F.expr(c)) for k, c in rules], "single_column").alias("layout_type"))


def visual_class(elements: DataFrame) -> DataFrame:
    """(page, element_id, visual_class, confidence, element_type): what an element shows by its words, its per cent and dollar signs; elements
    that show a chart become one.  ``name`` is the element's own name."""
    t, name, kind = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.coalesce("name", F.lit(""))), F.col("element_type")
    signs = F.length(F.regexp_replace(t, "[^%$]", ""))
    cued = _has(t, CHART_CUES) | _has(name, CHART_CUES)
    survey = F.contains(t, F.lit("percentage selecting")) | F.contains(t, F.lit(" respondents ")) | F.contains(t, F.lit("agree"))
    tabular = (kind == "table") | F.contains(t, F.lit("table"))
    grid = (signs >= 2) | _has(t, ("percent", "survey")) | _has(t, ("axis", "legend", "series"))
    seen = first_of([
        ("chart:0.8", (kind == "image") & (_has(name, CHART_CUES) | (signs > 2))), ("chart:0.9", (kind == "image") & (cued | ((signs > 3) & survey))), ("chart:0.9", tabular & grid), ("table:0.8", tabular),
        ("dashboard:0.7", F.contains(t, F.lit("dashboard"))), ("diagram:0.7", _has(t, ("diagram", "flow"))),
    ], "mixed_content:0.5")
    part = F.split(seen, ":")
    return elements.select(*PAGE, "element_id", part[0].alias("visual_class"), part[1].cast("double").alias("confidence"), F.when(part[0] == "chart", "chart").otherwise(kind).alias("element_type"))


def chart_test(elements: DataFrame) -> DataFrame:
    """(page, element_id, is_chart, chart_type): texts that speak of a chart with figures, or elements with bars and axes.  Facts: visual_class, contains_bars,
    contains_axes, given_type, stacked, legend_count, orientation."""
    t = F.lower(F.coalesce("text", F.lit("")))
    speaks = ~_has(t, ("@", "phone:")) & (F.length(t) >= 20) & _has(t, CHART_PHRASES) & F.contains(t, F.lit("%")) & t.rlike("[0-9]")
    barred = ~_has(t, ("@", "phone:")) & (F.length(t) >= 20) & F.coalesce(F.col("contains_bars") & F.col("contains_axes"), F.lit(False))
    kind = F.coalesce(F.expr("nullif(given_type, '')"), first_of([
        ("pie_chart", F.contains(t, F.lit("pie"))), ("line_chart", _has(t, ("line", "trend", "forecast"))), ("scatter_plot", F.contains(t, F.lit("scatter"))),
        ("stacked_bar_chart", F.contains(t, F.lit("stacked")) | F.coalesce("stacked", F.lit(False))), ("grouped_bar_chart", F.coalesce("legend_count", F.lit(0)) > 1),
        ("horizontal_bar_chart", F.col("orientation").eqNullSafe("horizontal")), ("vertical_bar_chart", F.col("orientation").eqNullSafe("vertical")),
    ], "bar_chart"))
    is_chart = F.col("visual_class").eqNullSafe("chart") | speaks | barred
    return elements.select(*PAGE, "element_id", is_chart.alias("is_chart"), F.when(is_chart, kind).alias("chart_type"))


def native_chart_type(name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return first_of([("bar_chart", _has(n, ("bar", "column"))), ("line_chart", F.contains(n, F.lit("line"))), ("pie_chart", _has(n, ("pie", "doughnut"))), ("stacked_chart", F.contains(n, F.lit("stacked")))], "bar_chart")


def archetype_confidence(archetype: Column, title: Column) -> Column:
    """How sure a page's archetype is: it was read from its title, counted, or nothing held."""
    counted = archetype.isin("dashboard_slide") & ~_has(F.lower(F.coalesce(title, F.lit(""))), ("dashboard", "kpi", "metrics", "status"))
    sure = archetype.isin("agenda_slide", "operating_model", "roadmap", "executive_summary", "recommendation_slide")
    return F.when(archetype == "hybrid_slide", 0.4).when(counted, 0.6).when(sure, 0.8).otherwise(0.7)


def intent(pages: DataFrame) -> DataFrame:
    """(page, intent, section): pages with is_flowchart, layout_type and title."""
    t = F.lower(F.coalesce("title", F.lit("")))
    i = first_of([("process_flow", F.coalesce("is_flowchart", F.lit(False))), ("cover_page", F.col("layout_type").eqNullSafe("title_slide")), *((n, _has(t, w)) for n, w in INTENTS)], "findings")
    return pages.withColumn("intent", i).select(*PAGE, "intent", _mapped(F.col("intent"), SECTIONS, "Findings & Data Section").alias("section"))


def document_structure(intents: DataFrame, elements: DataFrame) -> DataFrame:
    """(document_id, role, slides, sections, summary_slides, findings_slides, recommendation_slides, narrative): a document's kind by its words, its sections as runs of
    one section name, and slide numbers by intent."""
    low = F.lower(F.coalesce("text", F.lit("")))
    words = elements.groupBy("document_id").agg(*(F.max(_has(low, w)).alias(n) for n, w in (("financial", FINANCIAL), ("consulting", CONSULTING), ("research", RESEARCH))))
    by = Window.partitionBy("document_id").orderBy("slide_number")
    rows = intents.withColumns({"idx": F.row_number().over(by), "before": F.lag("section").over(by)})
    rows = rows.withColumn("run", F.sum(F.when(F.col("before").eqNullSafe(F.col("section")), 0).otherwise(1)).over(by))
    run = rows.groupBy("document_id", "run").agg(F.first("section").alias("section"), F.min("idx").alias("a"), F.max("idx").alias("b"))
    span = F.when(F.col("a") == F.col("b"), F.concat(F.lit("Slide "), "a")).otherwise(F.concat(F.lit("Slides "), "a", F.lit("-"), "b"))
    told = run.groupBy("document_id").agg(
        F.count("*").alias("sections"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", F.concat(F.lit("It features a "), "section", F.lit(" in "), span, F.lit(".")).alias("s")))), lambda s: s["s"]), " ").alias("told"),
    )
    listed = lambda *of: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("intent").isin(*of), F.col("slide_number")))), lambda n: n.cast("string")), ",")
    lists = intents.groupBy("document_id").agg(F.count("*").alias("slides"), listed("executive_summary").alias("summary_slides"), listed("findings", "dashboard", "comparison", "research_report").alias("findings_slides"), listed("recommendations").alias("recommendation_slides"))
    role = first_of([("Financial Audit Report", F.coalesce("financial", F.lit(False))), ("Consulting Report", F.coalesce("consulting", F.lit(False))), ("Research Paper / Report", F.coalesce("research", F.lit(False)))], "Enterprise Presentation")
    met = lists.join(told, "document_id").join(words, "document_id", "left").withColumn("role", role)
    start = F.concat(F.lit("This document is classified as a "), "role", F.lit(" consisting of "), F.col("slides").cast("string"), F.lit(" slides. "))
    return met.select("document_id", "role", "slides", "sections", "summary_slides", "findings_slides", "recommendation_slides", F.concat(start, "told").alias("narrative"))


def slide_facts(pages: DataFrame) -> DataFrame:
    """(page, slide_type, category, purpose, mood, background, domain) of pages with is_flowchart, is_diagram, images, text_boxes, tables, charts, texts, summary, colors and flow."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind = first_of([
        ("flowchart", yes("is_flowchart")), ("diagram", yes("is_diagram")), ("image_slide", F.expr("images > 0 and text_boxes <= 1")), ("data_table", F.expr("tables > 0")), ("chart_slide", F.expr("charts > 0")),
        ("title_slide", F.expr("texts <= 1")),
    ], "content_slide")
    first = strip(F.substring_index(F.coalesce("summary", F.lit("")), ".", 1))
    purpose = F.when(yes("is_flowchart"), "Illustrate a process or workflow through connected stages").when(yes("is_diagram"), "Visualize relationships between concepts or components").when(first != "", first).otherwise("Present information through visual and textual elements")
    mood = F.when(yes("is_flowchart"), "structured, analytical").when(yes("is_diagram"), "conceptual, educational").otherwise("professional, informative")
    flow = F.lower(F.coalesce("flow", F.lit("")))
    return pages.withColumn("slide_type", kind).select(
        *PAGE, "slide_type", _mapped(F.col("slide_type"), CATEGORIES, "informational").alias("category"), purpose.alias("purpose"), mood.alias("mood"),
        F.when(F.col("colors") >= 2, "gradient").otherwise("solid").alias("background"), first_of([(n, _has(flow, w)) for n, w in DOMAINS], "general").alias("domain"),
    )


def text_roles(elements: DataFrame, regions: DataFrame, titles: DataFrame) -> DataFrame:
    """(page, element_id, line_no, text, role, tone, goal, intent, words, lines): every line of a page's texts; regions: (page, element_id, region), titles: (page, title)."""
    e = elements.join(regions, [*PAGE, "element_id"], "left").join(titles, PAGE, "left")
    e = e.select("*", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw")).withColumn("line", strip(F.col("raw"))).where("line <> ''")
    title = strip(F.lower(F.coalesce("title", F.lit(""))))
    n, region = F.length("line"), F.lower(F.coalesce("region", F.lit("")))
    role = first_of([
        ("title", (F.col("element_type") == "title") | ((title != "") & (F.lower("line") == title)) | F.contains(F.lower(F.coalesce("shape_type", F.lit(""))), F.lit("title"))),
        ("heading", F.contains(region, F.lit("header"))), ("footer", F.contains(region, F.lit("footer"))), ("heading", F.coalesce("bold", F.lit(False)) & (n < 60)), ("heading", (F.coalesce("font_size", F.lit(0.0)) >= 18) & (n < 80)),
        ("label", (n < 30) & F.contains("line", F.lit(":"))), ("badge", n < 15),
    ], "body")
    words = F.size(_words(F.col("line")))
    tone = F.when(F.col("role").isin("title", "heading", "subheading"), "professional").when(F.col("role") == "badge", "concise").when(F.col("role") == "footer", "neutral").otherwise("instructional")
    line_no = F.row_number().over(Window.partitionBy(*PAGE, "element_id").orderBy("pos"))
    return e.withColumn("role", role).select(
        *PAGE, "element_id", line_no.alias("line_no"), F.col("line").alias("text"), "role", tone.alias("tone"), _mapped(F.col("role"), TEXT_GOALS, "Convey information to the reader").alias("goal"),
        _mapped(F.col("role"), TEXT_INTENTS, "Gain understanding of the detailed content and its implications").alias("intent"), words.alias("words"), F.greatest(F.lit(1), F.floor(words / 12).cast("int")).alias("lines"),
    )


def region_purpose(region: Column) -> Column:
    return first_of([(says, F.contains(F.lower(region), F.lit(name))) for name, says in REGION_PURPOSES], "Content section contributing to the overall slide message")


def header_footer(elements: DataFrame) -> DataFrame:
    """(page, header, footer, slide_number_text) by place, in order of input: the first number that ends below, the first text that starts above, and the first
    that ends below among the texts that did not become the header."""
    t = elements.withColumn("t", strip(F.coalesce("text", F.lit("")))).where("t <> ''").withColumn("low", F.expr("y + height"))
    number = F.min(F.when((F.col("low") > FOOTER_START) & F.col("t").rlike("^[0-9]+$"), F.struct("ord", "t")))
    head = F.min(F.when(F.col("y") < HEADER_END, F.struct("ord", "t")))
    a = t.groupBy(*PAGE).agg(head.alias("h"), number.alias("n"))
    foot = t.join(a.select(*PAGE, F.col("h.ord").alias("h_ord")), PAGE).where((F.col("low") > FOOTER_START) & ~F.col("ord").eqNullSafe(F.col("h_ord")))
    f = foot.groupBy(*PAGE).agg(F.min(F.struct("ord", "t")).alias("f"))
    return a.join(f, PAGE, "left").select(*PAGE, F.col("h.t").alias("header"), F.col("f.t").alias("footer"), F.col("n.t").alias("slide_number_text"))


def furniture(elements: DataFrame, placeholders: DataFrame) -> DataFrame:
    """(page, header, footer, slide_number_text, date_text): by placeholders (page, level, ord, type, text, y) of slide, layout and master (levels 0, 1, 2), the first filled
    one of each type; a title is the header only near the top. What they leave open is found by place, as in :func:`header_footer`."""
    p = placeholders.withColumn("t", strip(F.coalesce("text", F.lit("")))).where("t <> ''")
    first = lambda kind, near=F.lit(True): F.min(F.when((F.col("type") == kind) & near, F.struct("level", "ord", "t")))["t"]
    said = p.groupBy(*PAGE).agg(first("title", F.col("y") < TITLE_END).alias("p_header"), first("ftr").alias("p_footer"), first("sldNum").alias("p_number"), first("dt").alias("p_date"))
    low = elements.withColumn("t", strip(F.coalesce("text", F.lit("")))).where(f"t <> '' and y + height > {FOOTER_START}").groupBy(*PAGE).agg(F.min_by("t", "ord").alias("lowest"))
    a = elements.select(*PAGE).unionByName(placeholders.select(*PAGE)).distinct().join(header_footer(elements), PAGE, "left").join(said, PAGE, "left").join(low, PAGE, "left")
    return a.select(
        *PAGE, F.coalesce("p_header", "header").alias("header"), F.coalesce("p_footer", F.when(F.col("p_header").isNotNull(), F.col("lowest")).otherwise(F.col("footer"))).alias("footer"),
        F.coalesce("p_number", "slide_number_text").alias("slide_number_text"), F.col("p_date").alias("date_text"),
    )


def image_role(width: Column, height: Column, canvas_area: float = float(SLIDE_WIDTH) * SLIDE_HEIGHT) -> Column:
    """Background above four fifths of the page, icon below 48 points in both directions, else illustration."""
    return F.when(width * height / canvas_area > 0.8, "background").when((width / 12700 < 48) & (height / 12700 < 48), "icon").otherwise("illustration")


def title_from_boxes(boxes: DataFrame, height: float) -> DataFrame:
    """(page, title): the text of two words in the upper two fifths that is no figure and scores highest by its size, width, place and words."""
    b = boxes.withColumn("t", strip(F.coalesce("text", F.lit("")))).withColumns({"cy": F.expr("y + height / 2"), "words": F.size(_words(F.col("t")))})
    b = b.where((F.length("t") >= 3) & (F.col("cy") <= height * 0.4) & (F.col("words") >= 2) & ~F.col("t").rlike(r"^[$S5]?[0-9]"))
    score = F.col("height") * 2 + F.col("width") * 0.5 + (1 - F.col("cy") / height) * 100 + F.col("words") * 10
    return b.withColumn("score", score).groupBy(*PAGE).agg(F.max_by("t", F.struct("score", -F.col("ord"))).alias("title"))


def title_by_font(blocks: DataFrame, height: float) -> DataFrame:
    """(page, title): of the texts that start in the upper three quarters the first, by place, with seven tenths of the largest font."""
    b = blocks.withColumn("t", strip(F.coalesce("text", F.lit("")))).where((F.col("t") != "") & (F.col("y") <= 0.75 * height)).withColumn("size", F.coalesce("font_size", F.lit(0.0)))
    b = b.withColumn("top", F.max("size").over(Window.partitionBy(*PAGE))).where("size >= 0.7 * top")
    return b.groupBy(*PAGE).agg(F.replace(F.min_by("t", F.struct("y", "x", "ord")), F.lit("\n"), F.lit(" ")).alias("title"))


def visual_hierarchy(elements: DataFrame, titles: DataFrame) -> DataFrame:
    """(page, primary, secondary, tertiary, attention): the title, the largest other text, the next three, and the first six texts in reading order."""
    e = elements.join(titles, PAGE, "left").withColumns({"t": F.coalesce("text", F.lit("")), "title": F.coalesce("title", F.lit(""))}).where("t <> ''")
    other = e.where(strip(F.col("t")) != strip(F.col("title"))).withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.expr("width * height").desc(), "ord")))
    ids = F.col("element_id").cast("string")
    second = other.where("rank <= 4").groupBy(*PAGE).agg(
        F.max(F.when(F.col("rank") == 1, F.concat_ws(": ", "element_type", "t"))).alias("secondary"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", F.concat("element_type", F.lit("("), ids, F.lit(")")).alias("s"))))), lambda s: s["s"]), ", ").alias("tertiary"),
    )
    read = e.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y", "x", "ord"))).where("place <= 6")
    read = read.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", ids.alias("s")))), lambda s: s["s"]), " → ").alias("attention"))
    first = e.groupBy(*PAGE).agg(F.max("title").alias("title")).select(*PAGE, F.when(F.col("title") != "", F.concat(F.lit("Title: "), "title")).otherwise("").alias("primary"))
    return first.join(second, PAGE, "left").join(read, PAGE, "left").na.fill("", ["secondary", "tertiary", "attention"])


def title_typography(elements: DataFrame) -> DataFrame:
    """(page, title_style, body_style): how the first bold or large text is set, and the first element that is not both."""
    part = lambda c, words, end="": F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(words), F.col(c).cast("string"), F.lit(end)))
    size, bold = F.coalesce("font_size", F.lit(0.0)), F.coalesce("bold", F.lit(False))
    styled = elements.withColumns({
        "as_title": F.concat_ws(", ", part("font_family", "font: "), part("font_size", "size: ", "pt"), F.when(bold, "bold"), part("text_color", "color: ")),
        "as_body": F.concat_ws(", ", part("font_family", "font: "), part("font_size", "size: ", "pt"), part("text_color", "color: ")),
    })
    title = (F.coalesce("text", F.lit("")) != "") & (bold | (size >= 18))
    body = ~(bold & (size >= 18)) & ((F.coalesce("font_family", F.lit("")) != "") | (size > 0))
    a = styled.groupBy(*PAGE).agg(F.min_by("as_title", F.when(title, F.col("ord"))).alias("t"), F.min_by("as_body", F.when(body, F.col("ord"))).alias("b"))
    return a.select(*PAGE, F.coalesce(F.expr("nullif(t, '')"), F.lit("default title typography")).alias("title_style"), F.coalesce("b", F.lit("default body typography")).alias("body_style"))


def color_usage(elements: DataFrame, most: int = 4) -> DataFrame:
    """(page, color, used_for, n): the first labels that a background colour is used for."""
    label = F.coalesce(F.expr("nullif(substring(replace(trim(coalesce(text, '')), '\n', ' '), 1, 50), '')"), F.col("element_id").cast("string"))
    ids = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("ord", label.alias("label")))), 1, most), lambda s: F.concat(F.lit("'"), s["label"], F.lit("'")))
    return elements.where("fill_color <> ''").groupBy(*PAGE, F.col("fill_color").alias("color")).agg(F.array_join(ids, ", ").alias("used_for"), F.count("*").alias("n"))


def shape_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy(*PAGE, F.coalesce("shape_type", "element_type").alias("shape")).agg(F.count("*").alias("n"))


def text_points(elements: DataFrame) -> DataFrame:
    """(page, element_id, point_no, text): the lines of a page's texts in order of place, stripped, without blank ones."""
    rows = elements.select(*PAGE, "element_id", "y", "x", "ord", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw")).withColumn("text", strip(F.col("raw"))).where("text <> ''")
    by = Window.partitionBy(*PAGE).orderBy("y", "x", "ord", "pos")
    return rows.select(*PAGE, "element_id", F.row_number().over(by).alias("point_no"), "text")


def dashboard(elements: DataFrame, titles: DataFrame) -> DataFrame:
    """(page, element_id, kind, value): panels (charts, tables, wide shapes) and scalar metrics of pages that speak of a dashboard or have two charts."""
    low = F.lower(F.coalesce("text", F.lit("")))
    gate = elements.join(titles, PAGE, "left").groupBy(*PAGE).agg(F.max(F.contains(low, F.lit("dashboard")) | F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("dashboard"))).alias("says"), F.count_if(F.col("element_type") == "chart").alias("charts"))
    e = elements.join(gate.where("says or charts >= 2").select(*PAGE), PAGE)
    panel = F.col("element_type").isin("chart", "table") | ((F.col("element_type") == "shape") & (F.col("width") > 2_000_000))
    kinds = F.array(F.when(panel, F.struct(F.lit("panel").alias("kind"), F.coalesce("text", F.lit("Panel")).alias("value"))), F.when(is_metric(F.col("text")), F.struct(F.lit("metric").alias("kind"), strip(F.col("text")).alias("value"))))
    return e.select(*PAGE, "element_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select(*PAGE, "element_id", "k.kind", "k.value")


def capability_map(elements: DataFrame) -> DataFrame:
    """(page, element_id, kind, name): wide shapes are domains, other texts and shapes of at most that width capabilities."""
    wide = F.col("width") > 2_000_000
    kind = F.when((F.col("element_type") == "shape") & wide, "domain").when(F.col("element_type").isin("text_box", "shape") & ~wide, "capability")
    name = F.coalesce(F.expr("nullif(text, '')"), F.initcap("kind"))
    return elements.withColumn("kind", kind).where("kind is not null").select(*PAGE, "element_id", "kind", name.alias("name"))


def process_sequence(elements: DataFrame) -> DataFrame:
    """(page, sequence): texts and shapes from left to right."""
    e = elements.where(F.col("element_type").isin("text_box", "shape"))
    return e.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "ord", "element_id"))), lambda s: s["element_id"].cast("string")), ",").alias("sequence"))


def span_of_control(elements: DataFrame, reach: float = 500_000) -> DataFrame:
    """(page, layer_id, layer, data): texts that name a layer, with the texts with figures near their height, from top to bottom."""
    e = elements.where((F.coalesce("text", F.lit("")) != "") & F.col("element_type").isin("text_box", "shape")).withColumn("low", F.lower("text"))
    layer = e.where(F.contains("low", F.lit("layer"))).select(*PAGE, F.col("element_id").alias("layer_id"), F.col("text").alias("layer"), F.col("y").alias("ly"))
    figure = e.where(~F.contains("low", F.lit("layer")) & F.col("text").rlike("[0-9]")).select(*PAGE, "y", "ord", strip(F.col("text")).alias("value"))
    met = layer.join(figure, PAGE, "left").withColumn("near", F.abs(F.col("ly") - F.col("y")) < reach)
    return met.groupBy(*PAGE, "layer_id", "layer").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("near"), F.struct("y", "ord", "value")))), lambda s: s["value"]), ",").alias("data"))


def payload_counts(elements: DataFrame) -> DataFrame:
    """How many elements of a page have a text, a style and a place, and how many of each type, joined as ``type=n``."""
    kinds = elements.groupBy(*PAGE, "element_type").agg(F.count("*").alias("n")).groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("element_type", "n"))), lambda s: F.concat(s["element_type"], F.lit("="), s["n"].cast("string"))), ",").alias("types"))
    a = elements.groupBy(*PAGE).agg(F.count("*").alias("n"), F.count_if(strip(F.coalesce("text", F.lit(""))) != "").alias("with_text"), F.count_if(F.col("font_size").isNotNull() | F.col("fill_color").isNotNull()).alias("with_style"), F.count_if((F.col("width") > 0) & (F.col("height") > 0)).alias("placed"))
    return a.join(kinds, PAGE)


def group_titles(elements: DataFrame, reach: float = 1_500_000, least: int = 15) -> DataFrame:
    """(page, seed_id, members, title): charts around a seed (the first that is in no group yet), with the first text longer than ``least``."""
    charts = elements.where(F.col("element_type") == "chart")
    listed = charts.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("ord", "element_id", "x", "y", strip(F.coalesce("text", F.lit(""))).alias("t")))).alias("l"))
    kind = dict(charts.dtypes)["element_id"]
    fold = f"""aggregate(l, cast(array() as array<struct<id:{kind},x:double,y:double,n:int,title:string>>), (z, c) -> if(exists(z, g -> abs(g.x - c.x) < {reach}D and abs(g.y - c.y) < {reach}D),
      transform(z, (g, i) -> if(i = array_position(transform(z, h -> abs(h.x - c.x) < {reach}D and abs(h.y - c.y) < {reach}D), true) - 1,
        named_struct('id', g.id, 'x', g.x, 'y', g.y, 'n', g.n + 1, 'title', coalesce(g.title, if(length(c.t) > {least}, c.t, null))), g)),
      concat(z, array(named_struct('id', c.element_id, 'x', c.x, 'y', c.y, 'n', 1, 'title', if(length(c.t) > {least}, c.t, null))))))"""
    return listed.select(*PAGE, F.explode(F.expr(fold)).alias("g")).select(*PAGE, F.col("g.id").alias("seed_id"), F.col("g.n").alias("members"), F.coalesce("g.title", F.lit("Untitled Chart")).alias("title"))
