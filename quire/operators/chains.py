"""Fallback chains of a page's meaning, and the text that tells a model what is on a page.

Pages are rows (page, title, ...), elements as elsewhere; ``order`` is a reading order (page, element_id, position).  What is missing, null or empty
passes to the next rule; lists keep their order; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.assembly import Part, assembled
from quire.operators.flows import labels
from quire.operators.forms import SLIDE_HEIGHT, SLIDE_WIDTH, strip
from quire.sources.elements import PAGE

#: Sentences and words of the chain.
PROCESS, PROGRESS, FOCUS = "The slide shows the process flow: ", "The slide shows a progression from ", "The slide focuses on "
TRANSFORMATION = "The slide shows a transformation from low-level environment representation → high-level reasoning"
ABSTRACT = "abstraction|agent|decision|state|temporal"
BREAKS = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85  ]"


def _given(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _first_line(section: Column) -> Column:
    """What the first line that tells a sequence or has an arrow says; null where none does."""

    def told(line: Column) -> Column:
        t = strip(F.regexp_replace(strip(line), "^-+", ""))
        rest = F.when(F.contains(t, F.lit(":")), F.substr(t, F.instr(t, ":") + 1)).otherwise(t)
        sequence = F.when(F.lower(t).rlike("flow sequence|reading order") & (strip(rest) != ""), F.concat(F.lit(PROCESS), strip(rest)))
        steps = F.filter(F.split(t, r"\s*-->\s*|\s*→\s*"), lambda p: strip(p) != "")
        steps = F.transform(steps, lambda p: F.btrim(F.regexp_replace(p, r"^Step \d+:\s*", ""), F.lit("[] ")))
        arrow = F.when(t.rlike("-->|→") & (F.size(steps) >= 2), F.concat(F.lit(PROGRESS), F.element_at(steps, 1), F.lit(" → "), F.element_at(steps, -1)))
        return F.coalesce(sequence, arrow)

    return F.get(F.filter(F.transform(F.split(section, BREAKS), told), lambda s: s.isNotNull()), F.lit(0))


def overall_flow(pages: DataFrame, elements: DataFrame, order: DataFrame) -> DataFrame:
    """(page, flow, step): a page in one sentence, by the first of eight steps that has one: its plain summary, its section on flow, the ends of its reading
    order, the steps of its diagram, the diagram's own words, words of abstraction, its interpretation, its title.

    ``pages``: title, plain, flow_section, flow_description, summaries, interpretation."""
    own = labels(elements)
    read = order.join(own, [*PAGE, "element_id"], "left").withColumn("label", F.coalesce("label", F.col("element_id").cast("string"))).where(~F.startswith("label", F.lit("[")))
    first, last = F.min_by("label", "position"), F.max_by("label", "position")
    ends = read.groupBy(*PAGE).agg(F.when(F.count("*") >= 2, F.concat(F.lit(PROGRESS), first, F.lit(" → "), last)).otherwise(F.concat(F.lit(FOCUS), first, F.lit("."))).alias("ends"))
    said = own.groupBy(*PAGE).agg(F.max(F.lower("label").rlike(ABSTRACT)).alias("abstract"))
    p = assembled([Part("page", pages, many=False), Part("read", ends, many=False), Part("said", said, many=False)]).where("page is not null")
    p = p.select(*PAGE, "page.*", "read.ends", F.coalesce(F.col("said.abstract"), F.lit(False)).alias("abstract"))
    sentence = lambda c: strip(F.substring_index(strip(_given(c)), ".", 1))
    plain, interpretation = sentence("plain"), strip(F.substring_index(_given("interpretation"), ".", 1))
    low = F.concat(F.lower(F.substring(plain, 1, 1)), F.substr(plain, F.lit(2)))
    steps = F.filter(F.transform(F.regexp_extract_all("flow_description", F.lit("Step [0-9]+: ([^→]+)"), F.lit(1)), strip), lambda s: s != "")
    diagram = F.when(_given("flow_description") != "", F.when(F.size(steps) >= 2, F.concat(F.lit(PROGRESS), F.element_at(steps, 1), F.lit(" → "), F.element_at(steps, -1))))
    rules = (
        F.when(plain != "", F.concat(F.lit("The slide shows "), low, F.lit("."))), _first_line(_given("flow_section")), F.col("ends"), diagram, F.expr("nullif(flow_description, '')"),
        F.when(F.col("abstract") | F.lower(_given("summaries")).rlike(ABSTRACT), TRANSFORMATION), F.when(interpretation != "", F.concat(interpretation, F.lit("."))),
        F.concat(F.lit("The slide presents and explains "), F.coalesce(F.expr("nullif(title, '')"), F.lit("the slide content")), F.lit(".")),
    )
    step = F.coalesce(*(F.when(r.isNotNull(), F.lit(k)) for k, r in enumerate(rules, 1)))
    return p.select(*PAGE, F.coalesce(*rules).alias("flow"), step.alias("step"))


def _quoted(c: str) -> Column:
    return F.concat(F.lit('"'), F.col(c), F.lit('"'))


def page_contexts(elements: DataFrame, relations: DataFrame, regions: DataFrame, flowcharts: DataFrame, diagrams: DataFrame) -> DataFrame:
    """(page, context): what is known of a page's structure as one text, its sections apart by empty lines: the diagram's flow, the flowchart with its boxes and
    flows, regions with their number of elements, connectors between labels, and every element but arrows with its style and place.

    ``relations``: source_element_id, target_element_id, label; ``regions``: element_id, region; ``flowcharts``: is_flowchart, boxes, arrows; ``diagrams``:
    flow_description.  A section's lines are put together by page, and then the sections: no section passes through another's join."""
    own = labels(elements).select(*PAGE, "element_id", "label")
    ends = lambda c: own.select(*PAGE, F.col("element_id").alias(f"{c}_element_id"), F.col("label").alias(c))
    named = relations.join(ends("source"), [*PAGE, "source_element_id"], "left").join(ends("target"), [*PAGE, "target_element_id"], "left")
    named = named.withColumns({c: F.coalesce(c, F.col(f"{c}_element_id").cast("string")) for c in ("source", "target")})
    arrow = F.concat(F.lit("  "), _quoted("source"), F.lit(" → "), _quoted("target"), F.when(_given("label") != "", F.concat(F.lit(" [connector label: "), "label", F.lit("]"))).otherwise(""))
    at = ("source_element_id", "target_element_id")
    lines = [named.select(*PAGE, F.lit(4).alias("no"), F.struct(*(F.col(c).cast("long").alias(c) for c in at)).alias("at"), arrow.alias("line"))]
    pct = lambda c, total: F.format_string("%.1f%%", F.bround(F.expr(f"100 * {c} / {total}D"), 1))
    some = lambda c, text: F.when(_given(c) != "", F.concat(F.lit(f"\n    {text}: "), c)).otherwise("")
    font = F.when(_given("font_family") != "", F.concat(F.lit("\n    font: "), "font_family", F.when(F.coalesce("font_size", F.lit(0.0)) > 0, F.concat(F.lit(" "), F.col("font_size").cast("string"), F.lit("pt"))).otherwise(""))).otherwise("")
    place = F.concat(F.lit("\n    position: left "), pct("x", SLIDE_WIDTH), F.lit(", top "), pct("y", SLIDE_HEIGHT), F.lit(", width "), pct("width", SLIDE_WIDTH), F.lit(", height "), pct("height", SLIDE_HEIGHT))
    detail = F.concat(F.lit("  - ["), "element_type", F.lit("] "), _quoted("label"), some("fill_color", "fill"), some("text_color", "text colour"), font, F.when(F.col("bold"), "\n    bold: yes").otherwise(""), some("shape_type", "shape"), place)
    shown = elements.where("element_type not in ('arrow', 'connector')").join(own, [*PAGE, "element_id"])
    none = F.lit(0).cast("long")
    lines.append(shown.select(*PAGE, F.lit(5).alias("no"), F.struct(F.col("ord").cast("long").alias(at[0]), none.alias(at[1])).alias("at"), detail.alias("line")))
    sizes = regions.groupBy(*PAGE, "region").agg(F.count("*").alias("n"))
    rank = F.struct(F.expr("row_number() over (partition by document_id, slide_number order by region)").cast("long").alias(at[0]), none.alias(at[1]))
    lines.append(sizes.select(*PAGE, F.lit(3).alias("no"), rank.alias("at"), F.concat(F.lit("  Region '"), "region", F.lit("': "), F.col("n").cast("string"), F.lit(" element(s)")).alias("line")))
    flow = F.concat(F.lit("Flowchart: "), F.col("boxes").cast("string"), F.lit(" box(es), "), F.col("arrows").cast("string"), F.lit(" arrow(s)"))
    lines.append(flowcharts.where("is_flowchart").select(*PAGE, F.lit(2).alias("no"), F.struct(none.alias(at[0]), none.alias(at[1])).alias("at"), flow.alias("line")))
    lines.append(diagrams.where("coalesce(flow_description, '') <> ''").select(*PAGE, F.lit(1).alias("no"), F.struct(none.alias(at[0]), none.alias(at[1])).alias("at"), F.col("flow_description").alias("line")))
    every = lines[0]
    for x in lines[1:]:
        every = every.unionByName(x)
    head = F.element_at(F.array(*(F.lit(f"--- {h} ---\n") for h in HEADS)), F.col("no"))
    sections = assembled([Part("lines", every.select(*PAGE, "no", "at", "line"), ("at", "line"))], [*PAGE, "no"])
    sections = sections.select(*PAGE, "no", F.concat(head, F.array_join(F.transform("lines", lambda s: s["line"]), "\n")).alias("text"))
    return assembled([Part("sections", sections, ("no",))]).select(*PAGE, F.array_join(F.transform("sections", lambda s: s["text"]), "\n\n").alias("context"))


#: The heads of the sections.
HEADS = ("Diagram Flow Description", "Flowchart Structure", "Layout Regions", "Connector Relationships", "Element Visual Details (position, style, shape)")
