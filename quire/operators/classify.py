"""Rule classifiers: the first rule that holds decides.  A null text counts as empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.elements import PAGE

#: Words in a page's title and what they make of it, before and after the rules on its counts.
TITLE_FIRST = (("agenda_slide", ("agenda", "contents")),)
TITLE_WORDS = (
    ("capability_map", ("capability", "maturity", "framework")),
    ("governance_model", ("governance", "committee", "structure", "reporting")),
    ("operating_model", ("operating model", "target state")),
    ("process_flow", ("process", "flow", "workflow", "step")),
    ("roadmap", ("roadmap", "timeline", "horizon", "plan")),
    ("dashboard_slide", ("dashboard", "kpi", "metrics", "status")),
    ("scorecard_slide", ("scorecard", "assessment")),
)
TITLE_LAST = (("executive_summary", ("executive summary", "key observations")), ("recommendation_slide", ("recommendation", "next steps", "opportunity")))
#: Words in a chart's text and its type.
CHART_WORDS = (("pie_chart", ("pie",)), ("line_chart", ("line", "trend", "forecast")), ("scatter_plot", ("scatter",)), ("stacked_bar_chart", ("stacked",)))
#: Colours by channel, high above 200 (black: below 50), low below 100.
COLORS = (
    ("Red", "r > 200 and g < 100 and b < 100"), ("Green", "g > 200 and r < 100 and b < 100"), ("Blue", "b > 200 and r < 100 and g < 100"), ("Yellow", "r > 200 and g > 200 and b < 100"),
    ("Magenta", "r > 200 and b > 200 and g < 100"), ("Cyan", "g > 200 and b > 200 and r < 100"), ("Black", "r < 50 and g < 50 and b < 50"), ("White", "r > 200 and g > 200 and b > 200"),
)
UNTICKED, TICKED = ("[ ]", "[]", "☐"), ("[x]", "[X]", "☑", "☒")


def first_of(rules, default) -> Column:
    """The name of the first (name, condition) that holds."""
    return reduce(lambda rest, rule: F.when(rule[1], rule[0]).otherwise(rest), reversed(list(rules)), F.lit(default))


def _words(text: Column, families):
    return [(name, text.rlike("|".join(words))) for name, words in families]


def page_archetype(pages: DataFrame, title_marks: tuple[str, ...] = ()) -> DataFrame:
    """What a page is for, by its title and its charts and tables; pages: document_id, slide_number, title, charts, tables."""
    t = F.lower(F.coalesce("title", F.lit("")))
    opening = (F.col("slide_number") == 1) | (t.rlike("|".join(title_marks)) if title_marks else F.lit(False))
    rules = [
        *_words(t, TITLE_FIRST), ("title_slide", opening), *_words(t, TITLE_WORDS), ("dashboard_slide", F.col("charts") > 0),
        ("matrix_slide", (F.col("tables") > 0) & t.rlike("matrix|comparison")), ("table-centric_slide", F.col("tables") > 0), *_words(t, TITLE_LAST),
    ]
    return pages.select(*PAGE, first_of(rules, "hybrid_slide").alias("archetype"))


def complexity(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """Low, medium or high by the numbers of elements and relations of a page."""
    n = elements.groupBy(*PAGE).agg(F.count("*").alias("n_elements"))
    k = edges.groupBy(*PAGE).agg(F.count("*").alias("k"))
    both = n.join(k, PAGE, "left").withColumn("n_edges", F.coalesce("k", F.lit(0)).cast("long"))
    return both.select(*PAGE, "n_elements", "n_edges", first_of([("low", F.expr("n_elements <= 3 and n_edges = 0")), ("medium", F.expr("n_elements <= 8 and n_edges <= 3"))], "high").alias("complexity"))


def color_meaning(profiled: DataFrame) -> DataFrame:
    """Name and purpose of colours with their channels (see color_profile)."""
    purpose = first_of([("background", F.col("light") > 240_000), ("text", F.col("light") < 30_000)], "series_mapping")
    return profiled.withColumns({"name": first_of([(n, F.expr(c)) for n, c in COLORS], "Custom"), "purpose": purpose})


def pixel_class(elements: DataFrame, width: float, height: float, emu: float = 9525.0) -> DataFrame:
    """Line, panel, icon or rectangle by the pixels of a box."""
    e = elements.select(*PAGE, "element_id", *(F.floor(F.col(c) / emu).alias(c[0]) for c in ("width", "height")))
    line = F.expr("h <= 4 or w <= 4 or w / greatest(h, 1) > 12 or w / greatest(h, 1) < 0.08")
    rules = [("line", line), ("panel", F.col("w") * F.col("h") > 0.04 * width * height), ("pixel_icon", F.greatest("w", "h") < 0.08 * max(width, height))]
    return e.select(*PAGE, "element_id", first_of(rules, "rect").alias("pixel_class"))


def rewritable(text: Column) -> Column:
    """Texts longer than two characters that are no bare figure."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) > 2) & ~F.trim(F.translate(t, "$%,.MK", "")).rlike("^[0-9]+$")


def tick_state(text: Column) -> Column:
    """Whether a text that is a check box is ticked; null for other texts."""
    t = F.trim(text)
    return F.when(t.isin(*UNTICKED), False).when(t.isin(*TICKED), True)


def chart_type(text: Column) -> Column:
    return first_of(_words(F.lower(F.coalesce(text, F.lit(""))), CHART_WORDS), "bar_chart")
