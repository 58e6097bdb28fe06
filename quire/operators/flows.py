"""Edges and nodes of a page in words: labels, flowcharts, diagrams, graphs, and regions that stand out.

``relations`` are rows (page, source_element_id, target_element_id, relationship_type, label, confidence).  Null texts count as empty; ties are
broken by ``ord``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.forms import SLIDE_HEIGHT, SLIDE_WIDTH, compass, strip
from quire.operators.graphs import climb
from quire.sources.elements import PAGE

#: Types of flowchart boxes and arrows, and the families of panels by their words.
BOXES, ARROWS = ("shape", "text_box", "placeholder", "unknown"), ("arrow", "connector", "freeform")
PANELS = (
    ("findings_panel", ("finding", "result", "observation", "metrics")), ("recommendation_panel", ("recommend", "next step", "proposal", "should", "action item")),
    ("executive_summary_panel", ("executive summary", "key takeaway", "summary", "overview")),
)


def _ordered(struct: Column, part: str, separator: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(struct)), lambda s: s[part]), separator)


def labels(elements: DataFrame) -> DataFrame:
    """(page, element_id, label): an element's text on one line, else its id in brackets."""
    text = F.replace(strip(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit(" "))
    return elements.select(*PAGE, "element_id", "ord", F.when(text != "", text).otherwise(F.concat(F.lit("["), F.col("element_id").cast("string"), F.lit("]"))).alias("label"))


def labelled(relations: DataFrame, elements: DataFrame) -> DataFrame:
    """``relations`` with from and to: the labels of their ends, or their ids where a label is not known."""
    known = labels(elements).drop("ord")
    end = lambda c, to: known.select(*PAGE, F.col("element_id").alias(c), F.col("label").alias(to))
    met = relations.join(end("source_element_id", "a"), [*PAGE, "source_element_id"], "left").join(end("target_element_id", "b"), [*PAGE, "target_element_id"], "left")
    return met.withColumns({"from": F.coalesce("a", F.col("source_element_id").cast("string")), "to": F.coalesce("b", F.col("target_element_id").cast("string"))}).drop("a", "b")


def flowchart(elements: DataFrame, relations: DataFrame) -> DataFrame:
    """(page, is_flowchart, boxes, arrows, edges): two boxes and an arrow make a flowchart; edges count where both ends are boxes."""
    n = elements.groupBy(*PAGE).agg(F.count_if(F.col("element_type").isin(*BOXES)).alias("boxes"), F.count_if(F.col("element_type").isin(*ARROWS)).alias("arrows"))
    k = box_edges(elements, relations).groupBy(*PAGE).agg(F.count("*").alias("k"))
    return n.join(k, PAGE, "left").select(*PAGE, F.expr("boxes >= 2 and arrows >= 1").alias("is_flowchart"), "boxes", "arrows", F.coalesce("k", F.lit(0)).cast("long").alias("edges"))


def box_edges(elements: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations whose ends are both boxes."""
    box = elements.where(F.col("element_type").isin(*BOXES)).select(*PAGE, "element_id")
    for c in ("source_element_id", "target_element_id"):
        relations = relations.join(box.withColumnRenamed("element_id", c), [*PAGE, c], "left_semi")
    return relations


def relation_texts(relations: DataFrame, elements: DataFrame) -> DataFrame:
    """Every relation as a sentence: mapping, cause and effect, description with its confidence, and arrow."""
    r = labelled(relations, elements)
    ids = lambda c: F.col(c).cast("string")
    label = F.coalesce("label", F.lit(""))
    return r.select(
        *PAGE, "source_element_id", "target_element_id", F.concat_ws(" -> ", "from", "to").alias("mapping"),
        F.concat(F.when(label != "", F.concat(label, F.lit(": "))).otherwise(""), F.col("from"), F.lit(" → "), F.col("to")).alias("chain"),
        F.concat(ids("source_element_id"), F.lit(" → "), ids("target_element_id"), F.lit(" ["), F.col("relationship_type"), F.lit(", confidence: "), F.format_string("%.2f", F.col("confidence").cast("double")), F.lit("]"), F.when(label != "", F.concat(F.lit(" (label: '"), label, F.lit("')"))).otherwise("")).alias("description"),
        F.concat(F.lit("Arrow connection: '"), ids("source_element_id"), F.lit("' points to '"), ids("target_element_id"), F.lit("'"), F.when(label != "", F.concat(F.lit(" labeled '"), label, F.lit("'"))).otherwise("")).alias("arrow"),
    )


def relation_counts(relations: DataFrame) -> DataFrame:
    return relations.groupBy(*PAGE, "relationship_type").agg(F.count("*").alias("n"))


def outgoing(relations: DataFrame) -> DataFrame:
    """(page, element_id, targets, n): what each element points at, in order of id."""
    return relations.groupBy(*PAGE, F.col("source_element_id").alias("element_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("target_element_id")), lambda t: t.cast("string")), ",").alias("targets"), F.count("*").alias("n"))


def process_summary(order: DataFrame, elements: DataFrame) -> DataFrame:
    """(page, summary): the labels of the boxes of a page in their order (page, element_id, position), where there are two."""
    box = labels(elements.where(F.col("element_type").isin(*BOXES)))
    g = order.join(box, [*PAGE, "element_id"]).groupBy(*PAGE).agg(_ordered(F.struct("position", "label"), "label", " -> ").alias("s"), F.count("*").alias("n"))
    return g.where("n >= 2").select(*PAGE, F.concat(F.lit("Process flow: "), F.col("s")).alias("summary"))


def diagram(elements: DataFrame, relations: DataFrame) -> DataFrame:
    """(page, is_diagram, nodes, edges): pages with shapes, images or charts; nodes are what is no arrow, connector or group; edges are the
    connector edges, or all where there are none."""
    n = elements.groupBy(*PAGE).agg(F.max(F.col("element_type").isin("shape", "image", "chart")).alias("is_diagram"), F.count_if(~F.col("element_type").isin("arrow", "connector", "group")).alias("nodes"))
    k = relations.groupBy(*PAGE).agg(F.count("*").alias("all"), F.count_if(F.col("relationship_type") == "connector").alias("links"))
    return n.join(k, PAGE, "left").select(*PAGE, "is_diagram", "nodes", F.coalesce(F.expr("if(links > 0, links, `all`)"), F.lit(0)).cast("long").alias("edges"))


def decision_edges(elements: DataFrame, relations: DataFrame) -> DataFrame:
    """(page, element_id, decision, branches): texts with a question mark, and where they lead."""
    asks = labels(elements.where(F.contains(F.coalesce("text", F.lit("")), F.lit("?"))))
    to = labelled(relations, elements).select(*PAGE, F.col("source_element_id").alias("element_id"), "target_element_id", F.concat(F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.col("label"), F.lit(" → "))).otherwise("→ "), F.col("to")).alias("branch"))
    return asks.join(to, [*PAGE, "element_id"], "left").groupBy(*PAGE, "element_id", F.col("label").alias("decision")).agg(_ordered(F.when(F.col("branch").isNotNull(), F.struct("target_element_id", "branch")), "branch", "; ").alias("branches"))


def standout_regions(elements: DataFrame) -> DataFrame:
    """(page, name, role, element_id): callouts and highlighted boxes, sidebars, and panels by their words."""
    t = strip(F.coalesce("text", F.lit("")))
    e = elements.withColumn("t", t).where("t <> ''")
    reach = elements.groupBy(*PAGE).agg(F.greatest(F.lit(float(SLIDE_WIDTH)), F.max(F.expr("x + width"))).alias("cw"), F.greatest(F.lit(float(SLIDE_HEIGHT)), F.max(F.expr("y + height"))).alias("ch"))
    filled = F.coalesce(~F.lower("fill_color").isin("#ffffff", "#000000", "none", ""), F.lit(False))
    form = F.lower(F.coalesce("shape_type", F.lit("")))
    callout = form.rlike("callout|balloon")
    first = e.where(F.col("element_type").isin("shape", "text_box", "placeholder") & (callout | (filled & (F.length("t") < 150)))).select(*PAGE, "element_id", F.when(callout, "callout_box").otherwise("highlighted_region").alias("role"))
    side = e.join(reach, PAGE).where("width / cw < 0.35 and height / ch > 0.4 and (x / cw < 0.25 or x / cw > 0.65)").select(*PAGE, "element_id", F.lit("sidebar").alias("role"))
    role = F.coalesce(*(F.when(F.lower("t").rlike("|".join(words)), F.lit(name)) for name, words in PANELS))
    panel = e.select(*PAGE, "element_id", role.alias("role")).where("role is not null")
    every = first.unionByName(side).unionByName(panel)
    return every.select(*PAGE, F.concat_ws("_", "role", F.col("element_id").cast("string")).alias("name"), "role", "element_id")


def layout_graph(elements: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, source, target, relation): regions contain their element, elements precede the next in reading order."""
    by = Window.partitionBy(*PAGE).orderBy("y", "x", "ord")
    text = F.col("element_id").cast("string")
    read = elements.select(*PAGE, text.alias("source"), F.lead(text).over(by).alias("target"), F.lit("precedes_in_reading_order").alias("relation")).where("target is not null")
    return regions.select(*PAGE, F.concat(F.lit("region_"), F.col("name")).alias("source"), text.alias("target"), F.lit("contains").alias("relation")).unionByName(read)


def layout_words(elements: DataFrame) -> DataFrame:
    """(page, layout): labels of a page's elements by the region of their centre."""
    own = labels(elements.where(~F.col("element_type").isin("arrow", "connector"))).where(~F.startswith("label", F.lit("[")))
    met = own.join(compass(elements), [*PAGE, "element_id"])
    part = met.groupBy(*PAGE, "region").agg(_ordered(F.struct("ord", "label"), "label", "; ").alias("items"))
    rank = F.array_position(F.array(*(F.lit(r) for r in ("left", "right", "top", "bottom", "center"))), F.col("region"))
    line = F.concat(F.initcap("region"), F.lit(" section: "), F.col("items"))
    return part.select(*PAGE, rank.alias("rank"), line.alias("line")).groupBy(*PAGE).agg(_ordered(F.struct("rank", "line"), "line", "; ").alias("layout"))


def location_texts(elements: DataFrame) -> DataFrame:
    """(page, element_id, location, inventory): where an element is in per cent of the canvas, and what it is."""
    reach = elements.groupBy(*PAGE).agg(F.greatest(F.lit(float(SLIDE_WIDTH)), F.max(F.expr("x + width"))).alias("cw"), F.greatest(F.lit(float(SLIDE_HEIGHT)), F.max(F.expr("y + height"))).alias("ch"))
    pct = lambda c, total: F.format_string("%.1f%%", F.bround(F.col(c) / F.col(total) * 100, 1))
    text = F.replace(strip(F.col("text")), F.lit("\n"), F.lit(" "))
    some = lambda c, words, end="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(words), c, F.lit(end))).otherwise("")
    return elements.join(reach, PAGE).select(
        *PAGE, "element_id", F.concat(F.lit("Element '"), F.col("element_id").cast("string"), F.lit("' ("), F.col("element_type"), F.lit(") is positioned at: left: "), pct("x", "cw"), F.lit(", top: "), pct("y", "ch"), F.lit(", width: "), pct("width", "cw"), F.lit(", height: "), pct("height", "ch")).alias("location"),
        F.concat(F.lit("ID: "), F.col("element_id").cast("string"), F.lit(" | Type: "), F.col("element_type"), F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit(" | Text content: '"), text, F.lit("'"))).otherwise(""),
                 some(F.col("fill_color"), " | Background color: "), some(F.col("text_color"), " | Text color: ")).alias("inventory"),
    )


def contained(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """(page, element_id, root, level): containment edges (page, source_element_id, target_element_id) as a forest of any depth: every element with the
    outermost one that holds it and the steps to it.  An element's holder is its last source; below a cycle of holders root and level are null."""
    up = edges.groupBy(*PAGE, F.col("target_element_id").alias("node")).agg(F.max("source_element_id").alias("parent"))
    found = climb(up, list(PAGE)).select(*PAGE, F.col("node").alias("element_id"), F.struct("root", "level").alias("held"))
    own = F.struct(F.col("element_id").alias("root"), F.lit(0).cast("long").alias("level"))
    return elements.join(found, [*PAGE, "element_id"], "left").select(*PAGE, "element_id", F.coalesce("held", own).alias("held")).select(*PAGE, "element_id", "held.*")
