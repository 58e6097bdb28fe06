"""Queries over whole records of pages and over texts in their boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import assembly, fitting, spatial, vectors
from quire.plans import blueprint_queries, content_queries, fact_queries, flow_queries, form_queries, page_queries, payload_queries
from quire.plans.content_queries import read
from quire.plans.semantic_queries import _ENDS
from quire.sources import sinks
from quire.sources.elements import ELEMENTS_SQL, PAGE, STYLED_SQL, elements_from_events, styled_elements

_PARTS = (
    ("canvas", form_queries, "canvas_by_page"), ("style", content_queries, "palette"), ("layout", page_queries, "alignment_spacing"), ("purpose", payload_queries, "page_purposes"), ("hierarchy", fact_queries, "visual_hierarchy"),
    ("regions", flow_queries, "standout_regions"), ("relations", payload_queries, "connector_instructions"),
)


def page_payloads(spark, sf_dir):
    """The record of each page, its lists as lines of text."""
    place = page_queries.QUERIES["reading_order"](spark, sf_dir).select(*PAGE, "element_id", "position")
    elements = payload_queries.model_elements(spark, sf_dir).join(place, [*PAGE, "element_id"], "left")
    p = assembly.page_payload(elements, **{part: module.QUERIES[query](spark, sf_dir) for part, module, query in _PARTS})
    told = lambda c, e, sep="\\n": F.expr(f"array_join(transform({c}, s -> {e}), '{sep}')")
    return p.select(
        *PAGE, "canvas.canvas_width", "canvas.aspect", "style.colors", "style.theme", "layout.alignment", "layout.spacing", "purpose.purpose", "hierarchy.primary",
        told("reading_order", "cast(s.element_id as string)", ",").alias("reading_order"),
        told("elements", "concat_ws(':', s.element_id, s.element_type, cast(bround(s.left * 100) as long), cast(bround(s.top * 100) as long), s.content)").alias("elements"),
        told("relations", "s.instruction").alias("relations"), told("regions", "s.name", ",").alias("regions"),
    )


def fitted_texts(spark, sf_dir):
    """Texts of elements in their boxes, in pixels less a margin."""
    e = styled_elements(spark, sf_dir).where("text <> ''")
    e = e.selectExpr(*PAGE, "element_id", "text", "width / 9525 - 8 as box_width", "height / 9525 / 4 as box_height", "coalesce(font_size, 40D) as start_size")
    return fitting.fitted(e).select(*PAGE, "element_id", "fit.font_size", "fit.fits", F.size("fit.lines").alias("n_lines"), F.array_join("fit.lines", "\n").alias("lines"))


def fitted_documents(spark, sf_dir):
    """Whole documents on one page of 800 by 1,000."""
    d = read(spark, sf_dir, "documents").selectExpr("doc_id", "text", "800D as box_width", "1000D as box_height", "24D as start_size")
    return fitting.fitted(d).select("doc_id", "fit.font_size", "fit.fits", F.size("fit.lines").alias("n_lines"), F.sha2(F.array_join("fit.lines", "\n"), 256).alias("sha256"))


def _pages(spark, sf_dir):
    """Pages of which every third has a picture of its own, a broken one among them, and every fourth a drawn one."""
    p = styled_elements(spark, sf_dir).select(*PAGE).distinct()
    own = "case when slide_number % 3 = 0 then concat('data:image/png;base64,', base64(cast(concat('page ', slide_number) as binary))) when slide_number % 7 = 1 then 'data:image/png;base64,no base64 *' end"
    return p.selectExpr(*PAGE, "if(slide_number % 2 = 0, concat('A \"title\" of ', slide_number), null) as title", f"{own} as page_image", "if(slide_number % 4 = 0, cast('drawn' as binary), null) as raster")


def page_hashes(spark, sf_dir):
    return assembly.page_hashes(_pages(spark, sf_dir), styled_elements(spark, sf_dir))


def page_pictures(spark, sf_dir):
    e = elements_from_events(spark, sf_dir).withColumn("image_data", F.expr("if(slide_number % 5 < 2 and ord % 2 = 0, base64(cast(concat('image ', ord) as binary)), '')"))
    return assembly.page_pictures(_pages(spark, sf_dir), e).select(*PAGE, F.sha2("picture", 256).alias("sha256"), "source")


def _drawings(spark, sf_dir):
    """Elements as small rectangles, in points."""
    e = elements_from_events(spark, sf_dir)
    return e.selectExpr(*PAGE, "ord as drawing", "x / 16000 as x0", "y / 16000 as y0", "x / 16000 + 3 + ord % 20 as x1", "y / 16000 + 3 + ord * 7 % 20 as y1", "if(ord % 4 = 0, null, '#112233') as color")


def vector_checkboxes(spark, sf_dir):
    return vectors.vector_checkboxes(_drawings(spark, sf_dir), 1.5)


def vector_lines(spark, sf_dir):
    d = _drawings(spark, sf_dir).selectExpr(*PAGE, "drawing", "color", "if(drawing % 5 = 0, null, drawing % 3) as stroke_width", "inline(array(struct(0 as segment, x0 as x1, y1, x1 as x2, y0 as y2), struct(1 as segment, x1, y0 as y1, x1 as x2, y1 as y2)))")
    return vectors.vector_lines(d, 1.5)


def blueprint_records(spark, sf_dir):
    """The sections of a page's blueprint as a reader of its JSON record gets them, with the canvas that the record has above them."""
    sections = blueprint_queries.blueprint_sections(spark, sf_dir)
    canvas = form_queries.QUERIES["canvas_by_page"](spark, sf_dir)
    made = assembly.assembled([assembly.Part("canvas", canvas, many=False), assembly.Part("sections", sections, ("section_no",))])
    record = made.select(F.to_json(F.struct(*PAGE, "canvas", "sections")).alias("record"))
    kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in sections.schema.fields if f.name not in PAGE)
    read_ = record.select(F.from_json("record", f"document_id bigint, slide_number bigint, canvas struct<canvas_width: double, aspect: string>, sections array<struct<{kinds}>>").alias("r"))
    return read_.select("r.document_id", "r.slide_number", "r.canvas.canvas_width", "r.canvas.aspect", F.inline("r.sections"))


def stage_logs(spark, sf_dir):
    """The log of two stages, read by what both have in common and what only one has."""
    e = styled_elements(spark, sf_dir).select(*PAGE, "element_id", "element_type", "text")
    r = spatial.connector_targets(styled_elements(spark, sf_dir)).selectExpr(*PAGE, "connector_id as element_id", "source_element_id", "target_element_id", "direction")
    log = sinks.stage_records(e, "elements").unionByName(sinks.stage_records(r, "relations"))
    own = F.from_json("record", "element_id bigint, element_type string, text string, source_element_id bigint, target_element_id bigint, direction string")
    return log.select(*PAGE, "stage", own.alias("r")).select(*PAGE, "stage", "r.*")


QUERIES = {f.__name__: f for f in (page_payloads, fitted_texts, fitted_documents, page_hashes, page_pictures, vector_checkboxes, vector_lines, blueprint_records, stage_logs)}

_PAGE = "document_id, slide_number"
_NO_TARGETS = "NULL::BIGINT AS source_element_id, NULL::BIGINT AS target_element_id, NULL::VARCHAR AS direction"
_SQL = {part: f"({module.ORACLES[query]})" for part, module, query in _PARTS}
_PAGES = f"""{ELEMENTS_SQL}, {STYLED_SQL}, pg AS (SELECT DISTINCT {_PAGE}, CASE WHEN slide_number % 2 = 0 THEN 'A \\\"title\\\" of ' || slide_number END AS title, CASE WHEN slide_number % 3 = 0 THEN 'page ' || slide_number END AS own FROM st)"""
_DRAWN = f"{ELEMENTS_SQL}, dr AS (SELECT {_PAGE}, ord AS drawing, x / 16000 AS x0, y / 16000 AS y0, x / 16000 + 3 + ord % 20 AS x1, y / 16000 + 3 + ord * 7 % 20 AS y1, CASE WHEN ord % 4 <> 0 THEN '#112233' END AS color FROM el)"
_ALL = " UNION ".join(f"SELECT {_PAGE} FROM {sql}" for sql in (*_SQL.values(), f"({payload_queries.ORACLES['model_elements']})"))

ORACLES = {
    "page_payloads": f"""WITH pg AS ({_ALL}),
pl AS ({page_queries.ORACLES["reading_order"]}), me AS ({payload_queries.ORACLES["model_elements"]}),
o AS (SELECT {_PAGE}, string_agg(CAST(element_id AS VARCHAR), ',' ORDER BY position) AS reading_order FROM pl GROUP BY ALL),
e AS (SELECT {_PAGE}, string_agg(concat_ws(':', element_id, element_type, CAST(round_even("left" * 100, 0) AS BIGINT), CAST(round_even(top * 100, 0) AS BIGINT), content), chr(10) ORDER BY element_id) AS elements FROM me GROUP BY ALL),
r AS (SELECT {_PAGE}, string_agg(instruction, chr(10) ORDER BY source_element_id, target_element_id, instruction) AS relations FROM {_SQL["relations"]} GROUP BY ALL),
g AS (SELECT {_PAGE}, string_agg(name, ',' ORDER BY name) AS regions FROM {_SQL["regions"]} GROUP BY ALL)
SELECT {_PAGE}, canvas_width, aspect, colors, theme, alignment, spacing, purpose, "primary", coalesce(reading_order, '') AS reading_order, coalesce(elements, '') AS elements, coalesce(relations, '') AS relations, coalesce(regions, '') AS regions
FROM pg LEFT JOIN {_SQL["canvas"]} USING ({_PAGE}) LEFT JOIN {_SQL["style"]} USING ({_PAGE}) LEFT JOIN {_SQL["layout"]} USING ({_PAGE}) LEFT JOIN {_SQL["purpose"]} USING ({_PAGE})
  LEFT JOIN {_SQL["hierarchy"]} USING ({_PAGE}) LEFT JOIN o USING ({_PAGE}) LEFT JOIN e USING ({_PAGE}) LEFT JOIN r USING ({_PAGE}) LEFT JOIN g USING ({_PAGE})""",
    "page_hashes": f"""WITH {_PAGES}, e AS (SELECT {_PAGE}, string_agg('{{"id": "' || element_id || '", "text": ' || coalesce('"' || replace(text, chr(10), chr(92) || 'n') || '"', 'null') || ', "type": "' || element_type || '"}}', ', ' ORDER BY ord) AS rows
  FROM st GROUP BY {_PAGE}) SELECT {_PAGE}, sha256(coalesce(own, '{{"elements": [' || rows || '], "slide_number": ' || slide_number || ', "title": ' || coalesce('"' || title || '"', 'null') || '}}')) AS page_hash FROM pg JOIN e USING ({_PAGE})""",
    "page_pictures": f"""WITH {_PAGES}, f AS (SELECT {_PAGE}, min(ord) AS o FROM el WHERE element_type = 'image' AND slide_number % 5 < 2 AND ord % 2 = 0 GROUP BY {_PAGE}),
s AS (SELECT {_PAGE}, CASE WHEN own IS NOT NULL THEN own WHEN o IS NOT NULL THEN 'image ' || o WHEN slide_number % 4 = 0 THEN 'drawn' END AS t, CASE WHEN own IS NOT NULL THEN 'page' WHEN o IS NOT NULL THEN 'element' WHEN slide_number % 4 = 0 THEN 'raster' END AS source
  FROM pg LEFT JOIN f USING ({_PAGE})) SELECT {_PAGE}, sha256(t) AS sha256, source FROM s""",
    "vector_checkboxes": f"""WITH {_DRAWN}, b AS (SELECT * FROM dr WHERE (x1 - x0) * 1.5 BETWEEN 6 AND 25 AND (y1 - y0) * 1.5 BETWEEN 6 AND 25 AND (x1 - x0) / (y1 - y0) BETWEEN 0.8 AND 1.25)
SELECT {_PAGE}, 'vector_cb_' || slide_number || '_' || drawing AS element_id, x0 * 1.5 AS x, y0 * 1.5 AS y, (x1 - x0) * 1.5 AS width, (y1 - y0) * 1.5 AS height, color AS stroke_color,
  EXISTS (SELECT 1 FROM dr d WHERE d.document_id = b.document_id AND d.slide_number = b.slide_number AND d.drawing <> b.drawing AND least(b.x1, d.x1) > greatest(b.x0, d.x0) AND least(b.y1, d.y1) > greatest(b.y0, d.y0)
    AND NOT (b.x0 = d.x0 AND b.y0 = d.y0 AND b.x1 = d.x1 AND b.y1 = d.y1 AND b.color IS NOT DISTINCT FROM d.color)) AS checked FROM b""",
    "vector_lines": f"""WITH {_DRAWN}, s AS (SELECT {_PAGE}, drawing, color, CASE WHEN drawing % 5 = 0 OR drawing % 3 = 0 THEN 1.0 ELSE drawing % 3 END AS sw, segment, round_even(a * 1.5, 3) AS x1, round_even(b * 1.5, 3) AS y1, round_even(c * 1.5, 3) AS x2, round_even(d * 1.5, 3) AS y2 FROM (
  SELECT *, 0 AS segment, x0 AS a, y1 AS b, x1 AS c, y0 AS d FROM dr UNION ALL SELECT *, 1, x1, y0, x1, y1 FROM dr))
SELECT {_PAGE}, 'vector_line_' || slide_number || '_' || drawing || '_' || segment AS element_id, least(x1, x2) AS x, least(y1, y2) AS y, greatest(abs(x2 - x1), sw) AS width, greatest(abs(y2 - y1), sw) AS height, x1, y1, x2, y2,
  greatest(1.0, sw * 1.5)::DOUBLE AS stroke_width, color AS stroke_color FROM s""",
    "blueprint_records": f"""SELECT s.*, canvas_width, aspect FROM ({blueprint_queries.ORACLES["blueprint_sections"]}) s JOIN {_SQL["canvas"]} c USING ({_PAGE})""",
    "stage_logs": f"""WITH {ELEMENTS_SQL}, {STYLED_SQL}, {_ENDS}, w AS (SELECT {_PAGE}, element_id, end_x - begin_x AS dx, end_y - begin_y AS dy FROM st WHERE element_type IN ('connector', 'arrow'))
SELECT {_PAGE}, 'elements' AS stage, element_id, element_type, text, {_NO_TARGETS} FROM st UNION ALL
SELECT {_PAGE}, 'relations', element_id, NULL, NULL, s, d, CASE WHEN abs(dx) > abs(dy) THEN CASE WHEN dx > 0 THEN 'left_to_right' ELSE 'right_to_left' END ELSE CASE WHEN dy > 0 THEN 'top_to_bottom' ELSE 'bottom_to_top' END END
FROM cx JOIN w USING ({_PAGE}, element_id) WHERE s <> d""",
}
