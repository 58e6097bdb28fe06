"""Objects of a page with role, place, groups and graph, and the rules that name and rewrite them.

Input is the ``elements`` relation with font_size, bold, fill_color, text_color, font_family, shape_type, group_id and parent.  A
null text counts as empty, a null size as 0; ties are broken by ``ord``; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.classify import first_of
from quire.operators.forms import SLIDE_HEIGHT, SLIDE_WIDTH, strip
from quire.operators.ocr import steps
from quire.operators.spatial import overlap_pairs, smallest_container
from quire.sources.elements import PAGE

#: Types, and the sentences that go with a role.
CONNECTORS = ("arrow", "connector", "line")
GOALS = {
    "title": "Introduce the slide topic.", "heading": "Label a section or key idea.", "body": "Explain supporting information.", "bullet": "Present one item in a list.",
    "question": "Prompt the audience to consider or answer something.", "footer": "Provide supporting slide metadata.", "flow_connector": "Show directional or logical flow between objects.",
    "chart": "Communicate data relationships visually.", "table": "Organize information into rows and columns.", "supporting_visual": "Support the message through visual evidence or decoration.",
}
TOPIC_ROLES, TEXT_ROLES = ("title", "heading"), ("body", "bullet", "workflow_step")
#: Labels that stay, whole phrases, words in the order in which they are replaced, words of fragments, labels before a colon.
UNIVERSAL = ("email", "phone", "video call", "instant messaging", "face-to-face", "face to face")
PHRASES = {
    "best for: urgent matters, nuanced conversations": "Recommended when immediate discussion and contextual understanding are required.",
    "avoid for: detailed instructions - follow up in writing": "Not suitable for lengthy procedural guidance; provide written documentation afterward.",
    "avoid for: detailed instructions — follow up in writing": "Not suitable for lengthy procedural guidance; provide written documentation afterward.",
    "best for: sensitive topics, conflicts, complex discussions": "Ideal for confidential conversations, conflict resolution and complex decision-making.",
    "avoid for: urgent messages, emotional topics": "Should not be used for time-critical or emotionally sensitive communication.",
    "how urgent is the message?": "What level of urgency does this communication require?",
    "does this need a record/paper trail?": "Should this communication be formally documented?",
    "what does the receiver prefer or have access to?": "Which communication method is most accessible and preferred by the recipient?",
}
REPLACED = (
    ("Best for", "Recommended for"), ("Avoid for", "Not suitable for"), ("Urgent matters", "time-critical issues"), ("nuanced conversations", "discussions requiring context"),
    ("Detailed instructions", "lengthy procedural guidance"), ("follow up in writing", "provide written documentation afterward"), ("Sensitive topics", "confidential conversations"),
    ("conflicts", "conflict resolution"), ("complex discussions", "complex decision-making"), ("Urgent messages", "time-critical communication"), ("emotional topics", "emotionally sensitive matters"),
    ("Quick", "Short"), ("quick", "short"), ("Informal", "Casual"), ("informal", "casual"), ("communication", "team communication"), ("Overview of", "Introduction to"), ("Overview", "Introduction"),
    ("Summary", "Key Takeaways"), ("Benefits", "Advantages"), ("Challenges", "Difficulties"), ("Important", "Key"), ("Use", "Apply"), ("Create", "Build"), ("Build", "Create"), ("Improve", "Enhance"),
    ("Support", "Enable"), ("Process", "Workflow"), ("Goal", "Objective"),
)
FRAGMENTS = (("message", "communication"), ("receiver", "recipient"), ("need", "require"), ("prefer", "find preferable"), ("access to", "available to them"))
LABELS = {"what": "meaning", "why": "rationale", "how": "method", "key point": "main point", "example": "illustration"}
#: Whole texts by what they contain, and words, of the plain rewriter.
SENTENCES = (
    ("spot the ai errors", "Identify Mistakes Made by AI"), ("below is an ai-generated workplace memo", "The following workplace memo was produced using AI."),
    ("find and flag all the problems", "Review the memo carefully and identify every issue."),
)
SYNONYMS = {
    "errors": "inaccuracies", "error": "mistake", "errors.": "mistakes.", "problems": "issues", "problems.": "issues.", "below": "the following", "find": "identify", "flag": "mark",
    "workplace": "office", "memo": "memorandum", "ai-generated": "AI-produced",
}


def _text() -> Column:
    return strip(F.coalesce("text", F.lit("")))


def normal_type(kind: Column, text: Column) -> Column:
    """Shapes with a text are text, pictures are images."""
    return F.when((text != "") & kind.isin("shape", "unknown"), "text").when(kind.isin("picture", "graphic"), "image").otherwise(kind)


def semantic_role(height: float = SLIDE_HEIGHT) -> Column:
    """What an element is for, by its type, place, size and words."""
    t, kind, size, at = _text(), F.col("element_type"), F.coalesce("font_size", F.lit(0.0)), F.col("y") / height
    low = F.lower(t)
    return first_of([
        ("flow_connector", kind.isin(*CONNECTORS)), ("icon_or_decorative_symbol", kind == "icon"), ("container", (kind == "shape") & (t == "") & F.col("shape_type").eqNullSafe("panel")),
        ("decorative_or_structural_shape", (kind == "shape") & (t == "")), ("table", kind == "table"), ("chart", kind == "chart"), ("supporting_visual", kind == "image"), ("footer", at > 0.88),
        ("title", (at < 0.16) & ((size >= 18) | (F.length(t) < 90))), ("question", low.endswith("?")), ("warning", low.rlike("^(warning|caution|note)")), ("workflow_step", low.rlike("^(step|phase) ")),
        ("recommendation", low.rlike("^(best for|ideal for|use when)")), ("bullet", t.rlike(r"^[-*•]\s+")), ("heading", (size >= 16) | (F.length(t) <= 45)),
    ], "body")


def layout_role() -> Column:
    kind = F.col("element_type")
    wide = (F.col("height") < 80_000) | (F.col("width") > 8_000_000)
    return first_of([("connector", kind.isin(*CONNECTORS)), ("table", kind == "table"), ("data_visualization", kind == "chart"), ("visual_asset", kind == "image"), ("divider_or_bar", wide)], "content_object")


def importance(role: Column) -> Column:
    return F.when(role.isin("title", "chart", "table", "question"), "high").when(role == "footer", "low").otherwise("medium")


def _mapped(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]


def meaning(objects: DataFrame) -> DataFrame:
    """``objects`` with goal, intent, importance, objective, summary and purpose of their role."""
    role, kind = F.col("role"), F.col("element_type")
    thing = lambda a, b: F.concat(F.lit(a), kind, F.lit(b))
    return objects.withColumns({
        "goal": F.coalesce(_mapped(role, GOALS), thing("Serve as a ", " element in the slide composition.")),
        "intent": F.concat(F.lit("Preserve the "), role, F.lit(" role and its relationship to nearby "), kind, F.lit(" objects.")),
        "importance": importance(role),
        "objective": F.when(role.isin(*TOPIC_ROLES), "Understand the topic or section being introduced.").when(role.isin(*TEXT_ROLES), "Retain the stated meaning while wording changes.").otherwise("Understand this object's contribution to the slide."),
        "summary": F.when(_text() != "", F.concat(F.lit("This "), role, F.lit(" communicates the same idea as the source text without requiring verbatim wording."))).otherwise(thing("This ", " object contributes visual structure, hierarchy, or meaning to the slide.")),
        "purpose": F.when(kind.isin(*CONNECTORS), "Indicates flow, direction, or relationship.").when(role.isin(*TOPIC_ROLES, "body", "bullet"), "Carries textual meaning at its exact visual location.").otherwise("Preserves visible slide composition and hierarchy."),
    })


def objects(elements: DataFrame, width: float = SLIDE_WIDTH, height: float = SLIDE_HEIGHT) -> DataFrame:
    """One row an element: type, parent (given, or the smallest container), shares of the canvas, insets, zones, roles and text facts."""
    t = _text()
    zone = lambda v, total: F.when(v / total < 0.33, "start").when(v / total > 0.66, "end").otherwise("center")
    share = lambda c, total: F.bround(F.col(c) / total, 6)
    holder = smallest_container(elements.withColumn("element_type", normal_type(F.col("element_type"), t))).withColumnRenamed("parent_id", "holder")
    lines = F.size(F.filter(F.split(t, "\n"), lambda x: strip(x) != ""))
    return elements.join(holder, [*PAGE, "element_id"]).select(
        *PAGE, "element_id", "ord", "element_type", normal_type(F.col("element_type"), t).alias("type"), F.coalesce(F.col("shape_type"), F.col("element_type")).alias("subtype"),
        F.coalesce("parent", "holder").alias("parent"), "group_id", "x", "y", "width", "height", F.coalesce("stacking_order", "ord").alias("z_index"), "text", "font_size", "font_family", "fill_color", "text_color",
        share("x", width).alias("x_share"), share("y", height).alias("y_share"), share("width", width).alias("width_share"), share("height", height).alias("height_share"),
        (F.lit(float(width)) - F.col("x") - F.col("width")).alias("right_inset"), (F.lit(float(height)) - F.col("y") - F.col("height")).alias("bottom_inset"),
        zone(F.expr("x + width / 2"), width).alias("zone_x"), zone(F.expr("y + height / 2"), height).alias("zone_y"), semantic_role(height).alias("role"), layout_role().alias("layout_role"),
        F.when(t != "", F.substring(F.sha2(t, 256), 1, 16)).alias("fingerprint"), F.length(t).alias("characters"), lines.alias("lines"),
    )


def container_tree(objects: DataFrame) -> DataFrame:
    """Children of each parent in order, as one text; parent null is the page itself."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("z_index", "ord", "element_id"))), lambda s: s["element_id"].cast("string"))
    return objects.groupBy(*PAGE, "parent").agg(F.array_join(ids, ",").alias("children"), F.count("*").alias("n"))


def visual_groups(objects: DataFrame, cell_x: int = 2_500_000, cell_y: int = 1_600_000) -> DataFrame:
    """Groups that are named (group_id, else parent) and groups of two or more in one cell of a coarse grid that are no named group's members:
    (page, group_id, kind, members, x, y, width, height, confidence)."""
    key = F.coalesce(F.col("group_id"), F.col("parent").cast("string"))
    box = [F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.expr("x + width")) - F.min("x")).alias("width"), (F.max(F.expr("y + height")) - F.min("y")).alias("height")]
    members = F.sort_array(F.collect_list("element_id")).alias("members")
    named = objects.withColumn("group_id", key).where("group_id is not null").groupBy(*PAGE, "group_id").agg(members, *box)
    cell = objects.withColumns({"cx": F.floor(F.expr("x + width / 2") / cell_x), "cy": F.floor(F.expr("y + height / 2") / cell_y)})
    first = F.min(F.struct("z_index", "ord")).alias("first")
    near = cell.groupBy(*PAGE, "cx", "cy").agg(members, *box, first)
    near = near.withColumn("group_id", F.concat(F.lit("visual_region_"), F.row_number().over(Window.partitionBy(*PAGE).orderBy("first")))).where(F.size("members") >= 2)
    near = near.join(named.select(*PAGE, "members"), [*PAGE, "members"], "left_anti")
    shape = lambda g, kind, sure: g.select(*PAGE, "group_id", F.lit(kind).alias("kind"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "x", "y", "width", "height", F.lit(sure).alias("confidence"))
    return shape(named, "explicit_group", 1.0).unionByName(shape(near, "proximity_group", 0.65))


def group_purpose(objects: DataFrame, groups: DataFrame) -> DataFrame:
    """(page, group_id, roles, purpose): the roles of a group's members, and what they make of it."""
    member = groups.select(*PAGE, "group_id", F.explode(F.split("members", ",")).alias("member"))
    role = objects.select(*PAGE, F.col("element_id").cast("string").alias("member"), "role")
    of = member.join(role, [*PAGE, "member"]).groupBy(*PAGE, "group_id").agg(F.sort_array(F.collect_set("role")).alias("r"))
    has = lambda *names: F.arrays_overlap("r", F.array(*(F.lit(n) for n in names)))
    purpose = first_of([("Introduce and organize the slide message.", has("title")), ("Present structured data or evidence.", has("chart", "table")), ("Explain a process or relationship flow.", has("flow_connector"))], "Group visually related slide elements.")
    return of.select(*PAGE, "group_id", F.array_join("r", ",").alias("roles"), purpose.alias("purpose"))


def alternative_layout(objects: DataFrame, groups: DataFrame, width: float = SLIDE_WIDTH) -> DataFrame:
    """(page, layout): by tables, charts, connectors, groups, and what lies left and right of the middle."""
    cx = F.expr("x + width / 2")
    n = lambda c: F.count_if(c)
    a = objects.groupBy(*PAGE).agg(
        F.count("*").alias("n"), n(F.col("type") == "table").alias("tables"), n(F.col("type") == "chart").alias("charts"), n(F.col("type").isin(*CONNECTORS)).alias("links"),
        n((F.col("type") != "line") & (cx < 0.45 * width)).alias("left"), n((F.col("type") != "line") & (cx > 0.55 * width)).alias("right"), n(F.col("type") != "line").alias("placed"),
    )
    a = a.join(groups.groupBy(*PAGE).agg(F.count("*").alias("g")), PAGE, "left")
    rules = [("table", "tables > 0"), ("dashboard", "charts > 0 and n > 6"), ("chart_slide", "charts > 0"), ("workflow", "links > 0"), ("card_grid", "g >= 3"), ("blank", "placed = 0"), ("two_column", "left > 0 and right > 0")]
    return a.select(*PAGE, first_of([(k, F.coalesce(F.expr(c), F.lit(False))) for k, c in rules], "single_column").alias("layout"))


def layout_edges(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """Given relations (source_element_id, target_element_id, relationship_type, confidence), containment by parent where it is not given, and
    the step to the object read next."""
    given = relations.select(*PAGE, F.col("source_element_id").alias("source"), F.col("target_element_id").alias("target"), F.col("relationship_type").alias("relation"), F.col("confidence").cast("double").alias("confidence"))
    inside = objects.where("parent is not null").select(*PAGE, F.col("parent").alias("source"), F.col("element_id").alias("target"), F.lit("contains").alias("relation"), F.lit(1.0).alias("confidence"))
    inside = inside.join(given, [*PAGE, "source", "target", "relation"], "left_anti")
    by = Window.partitionBy(*PAGE).orderBy("y", "x", "z_index", "ord")
    read = objects.select(*PAGE, F.col("element_id").alias("source"), F.lead("element_id").over(by).alias("target"), F.lit("reading_order_next").alias("relation"), F.lit(0.8).alias("confidence")).where("target is not null")
    return given.unionByName(inside).unionByName(read)


def content_flow(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """(page, source, target, kind): consecutive objects in reading order, and given connector, flow and hierarchy edges."""
    by = Window.partitionBy(*PAGE).orderBy("y", "x", "z_index", "ord")
    read = objects.select(*PAGE, F.col("element_id").alias("source"), F.lead("element_id").over(by).alias("target"), F.lit("reading_order").alias("kind")).where("target is not null")
    given = relations.where(F.col("relationship_type").isin("connector", "flow", "hierarchy"))
    return read.unionByName(given.select(*PAGE, F.col("source_element_id").alias("source"), F.col("target_element_id").alias("target"), F.col("relationship_type").alias("kind")))


def graph_nodes(objects: DataFrame, groups: DataFrame) -> DataFrame:
    """The page, its objects and its groups as nodes (page, id, type, role)."""
    root = objects.select(*PAGE).distinct().select(*PAGE, F.lit("slide_root").alias("id"), F.lit("slide").alias("type"), F.lit("slide_canvas").alias("role"))
    own = objects.select(*PAGE, F.col("element_id").cast("string").alias("id"), "type", "role")
    return root.unionByName(own).unionByName(groups.select(*PAGE, F.col("group_id").alias("id"), F.lit("visual_group").alias("type"), F.col("kind").alias("role")))


def graph_edges(objects: DataFrame, groups: DataFrame, edges: DataFrame) -> DataFrame:
    """What the page contains itself, the layout edges, and the members of groups (page, source, target, relation, confidence)."""
    text = lambda c: F.col(c).cast("string").alias(c)
    root = objects.where("parent is null").select(*PAGE, F.lit("slide_root").alias("source"), F.col("element_id").cast("string").alias("target"), F.lit("contains").alias("relation"), F.lit(1.0).alias("confidence"))
    member = groups.select(*PAGE, F.col("group_id").alias("source"), F.explode(F.split("members", ",")).alias("target"), F.lit("groups").alias("relation"), "confidence")
    return root.unionByName(edges.select(*PAGE, text("source"), text("target"), "relation", "confidence")).unionByName(member)


def overlaps(objects: DataFrame) -> DataFrame:
    """Every pair of overlapping objects in both directions; see ``spatial.overlap_pairs``."""
    return overlap_pairs(objects.withColumn("z_order", F.col("z_index")))


def design_system(objects: DataFrame) -> DataFrame:
    """Colours and fonts of a page in the order in which they are first seen, joined to texts."""
    rows = objects.select(*PAGE, "z_index", "ord", F.posexplode(F.array("fill_color", "text_color")).alias("k", "color")).where("color <> ''")
    seen = rows.groupBy(*PAGE, "color").agg(F.min(F.struct("z_index", "ord", "k")).alias("at"))
    listed = lambda df, c: df.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", c))), lambda s: s[c]), ",").alias(f"{c}s"))
    fonts = objects.where("font_family <> ''").groupBy(*PAGE, F.col("font_family").alias("font")).agg(F.min(F.struct("z_index", "ord")).alias("at"))
    return objects.select(*PAGE).distinct().join(listed(seen, "color"), PAGE, "left").join(listed(fonts, "font"), PAGE, "left")


def typography(objects: DataFrame) -> DataFrame:
    """Texts by falling size, then place: (page, rank, element_id, font_size, role)."""
    by = Window.partitionBy(*PAGE).orderBy(F.coalesce("font_size", F.lit(0.0)).desc(), "y", "x", "ord")
    return objects.where("characters > 0").select(*PAGE, F.row_number().over(by).alias("rank"), "element_id", "font_size", "role")


def regions_or_page(pages: DataFrame, regions: DataFrame, width: float = SLIDE_WIDTH, height: float = SLIDE_HEIGHT) -> DataFrame:
    """A page's regions (page, name, x, y, width, height), or the whole page where it has none."""
    whole = pages.select(*PAGE).distinct().join(regions, PAGE, "left_anti").select(*PAGE, F.lit("full_slide").alias("name"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(float(width)).alias("width"), F.lit(float(height)).alias("height"))
    return regions.select(*PAGE, "name", "x", "y", "width", "height").unionByName(whole)


def merge_update(objects: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``objects`` with the values of ``updates`` (page, element_id, keys) that are neither null nor empty, and where their text was rewritten."""
    new = updates.select(*PAGE, "element_id", *(F.col(k).alias(f"new_{k}") for k in keys))
    met = objects.join(new, [*PAGE, "element_id"], "left")
    given = {k: F.coalesce(F.when(F.col(f"new_{k}").cast("string") != "", F.col(f"new_{k}")), F.col(k)) for k in keys}
    return met.withColumns(given).drop(*(f"new_{k}" for k in keys))


def checks(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """The checklist of a page's extraction: one column a check, and whether all hold."""
    ids = objects.select(*PAGE, F.col("element_id").alias("target"), F.lit(True).alias("known"))
    lost = edges.where("relation = 'contains'").join(ids, [*PAGE, "target"], "left").groupBy(*PAGE).agg(F.count_if(F.col("known").isNull()).alias("lost"))
    a = objects.groupBy(*PAGE).agg(
        F.count("*").alias("n"), F.count_if(F.col("role").isNull() | (F.col("role") == "")).alias("roleless"), F.count_if((F.col("characters") > 0) & (F.coalesce("rewritten", F.lit("")) == "")).alias("unwritten"),
        F.count_if(F.col("x").isNull() | F.col("y").isNull() | F.col("width").isNull() | F.col("height").isNull()).alias("placeless"), F.countDistinct("element_id").alias("ids"),
    ).join(lost, PAGE, "left")
    made = {
        "objects_extracted": F.col("n") > 0, "texts_rewritten": F.col("unwritten") == 0, "children_known": F.coalesce("lost", F.lit(0)) == 0, "reading_order_complete": F.col("ids") == F.col("n"),
        "structure_complete": F.col("placeless") == 0, "roles_complete": F.col("roleless") == 0,
    }
    return a.select(*PAGE, *(c.alias(k) for k, c in made.items())).withColumn("passed", reduce(lambda a, b: a & b, (F.col(k) for k in made)))


def _words(t: Column, pairs, flags: str = "") -> Column:
    return reduce(lambda c, pair: F.regexp_replace(c, rf"{flags}\b{pair[0]}\b", pair[1]), pairs, t)


def rewrite(text: Column, role: Column) -> Column:
    """The wording of a text without a model: labels that stay, known phrases, words in order, and else a changed label, title or fragment."""

    def fragment(t: Column) -> Column:
        return steps(t, lambda f: steps(_words(f, FRAGMENTS, "(?i)"), lambda g: F.when(g == f, F.concat(F.lit("Professionally restated: "), f)).otherwise(g)))

    def label(t: Column) -> Column:
        return F.coalesce(_mapped(F.lower(t), LABELS), F.concat(t, F.lit(" restated")))

    def unchanged(t: Column) -> Column:
        head, tail = strip(F.substring_index(t, ":", 1)), strip(F.regexp_replace(t, r"(?s)^[^:]*:", ""))
        words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
        turned = F.concat_ws(" ", F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 1, 1))
        return F.when(F.contains(t, F.lit(":")), F.concat(label(head), F.lit(": "), fragment(tail))).when((role == "title") & F.contains(t, F.lit(" ")), turned).otherwise(fragment(t))

    def reworded(t: Column) -> Column:
        shaped = lambda r: (
            F.when(F.startswith(r, F.lit("Recommended for:")), F.concat(F.lit("Recommended when "), strip(F.regexp_replace(r, r"(?s)^[^:]*:", ""))))
            .when(F.startswith(r, F.lit("Not suitable for:")), F.concat(F.lit("Not suitable for "), strip(F.regexp_replace(r, r"(?s)^[^:]*:", "")))).otherwise(r)
        )
        return steps(_words(t, REPLACED), shaped, lambda r: F.when(r == t, unchanged(t)).otherwise(r))

    def whole(t: Column) -> Column:
        known = _mapped(F.lower(F.regexp_replace(t, r"\s+", " ")), PHRASES)
        return F.when((t == "") | F.lower(t).isin(*UNIVERSAL), t).otherwise(F.coalesce(known, reworded(t)))

    return steps(strip(F.coalesce(text, F.lit(""))), whole)


def plain_rewrite(text: Column) -> Column:
    """Known sentences, else synonyms word by word with their capital; a text of one word stays."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    low = F.lower(F.trim(text))

    def one(w: Column) -> Column:
        new = _mapped(F.lower(w), SYNONYMS)
        capital = F.concat(F.upper(F.substring(new, 1, 1)), F.lower(F.substr(new, F.lit(2))))
        return F.when(new.isNull(), w).when(F.substring(w, 1, 1).rlike("^[A-Z]"), capital).otherwise(new)

    known = reduce(lambda c, pair: F.when(F.contains(low, F.lit(pair[0])), pair[1]).otherwise(c), reversed(SENTENCES), F.array_join(F.transform(words, one), " "))
    return F.when(F.size(words) <= 1, text).otherwise(known)

