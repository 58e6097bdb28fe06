"""Queries of payloads, draw lists and checks, with the same in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import naming
from quire.operators import blueprint, enrich, pagefacts, payloads, semantics, spatial
from quire.plans.content_queries import read
from quire.plans.formpage_queries import _FORM, _MERGES, _form, _tables
from quire.plans.formpage_queries import ORACLES as FORM_PAGES
from quire.plans.semantic_queries import _ENDS, OBJECTS
from quire.plans.semantic_queries import ORACLES as SEMANTIC
from quire.sources import sinks
from quire.sources.elements import ELEMENTS_SQL, PAGE, STYLED_SQL, styled_elements

_PAGE = "document_id, slide_number"


def fidelity_objects(spark, sf_dir):
    return payloads.fidelity_objects(styled_elements(spark, sf_dir).withColumn("y", F.expr("if(ord % 40 = 3, 50D, y)")))


def model_elements(spark, sf_dir):
    return payloads.model_elements(styled_elements(spark, sf_dir))


def visual_objects(spark, sf_dir):
    e = styled_elements(spark, sf_dir)
    return payloads.visual_objects(e, blueprint.canvas(e))


def connector_instructions(spark, sf_dir):
    r = spatial.connector_targets(styled_elements(spark, sf_dir))
    return payloads.connector_instructions(r.withColumn("label", F.expr("case source_element_id % 3 when 0 then 'if late' when 1 then '' end")))


def page_purposes(spark, sf_dir):
    p = styled_elements(spark, sf_dir).groupBy(*PAGE).agg(F.max(F.when(F.col("text") != "", F.col("text"))).alias("t"))
    p = p.selectExpr(*PAGE, "if(slide_number % 4 = 0, concat('Flow of ', t), '') as flow", "if(slide_number % 4 = 1, concat('  ## ', t, '\\nmore'), null) as summary", "if(slide_number % 4 = 2, t, null) as title")
    return p.select(*PAGE, payloads.page_purpose(F.col("flow"), F.col("summary"), F.col("title")).alias("purpose"))


def draw_list(spark, sf_dir):
    return payloads.draw_list(_form(spark, sf_dir))


def _boxes(spark, sf_dir):
    """Pixel boxes of which some are negative, far outside, or repeated."""
    return styled_elements(spark, sf_dir).selectExpr(
        *PAGE, "element_id", "ord", "if(ord % 12 = 1, 'line', element_type) as type", "if(ord % 4 = 0, 'same', text) as text", "960D as page_width", "720D as page_height",
        "if(ord % 4 = 0, 10D, cast(ord * 37 % 1300 - 150 as double)) as x", "if(ord % 4 = 0, 20D, cast(ord * 53 % 900 - 90 as double)) as y", "if(ord % 25 = 6, -5D, cast(ord % 3 * 100 as double)) as width", "cast(ord % 2 * 60 as double) as height",
    )


def clamped_boxes(spark, sf_dir):
    return payloads.clamp_boxes(_boxes(spark, sf_dir))


def cells_outside(spark, sf_dir):
    from quire.operators import formpage

    tables, cells, merges = _tables(spark, sf_dir)
    made = formpage.cell_geometry(tables, cells, merges)
    return payloads.cells_outside(tables, made.withColumn("x", F.expr("x + case (table_id + row) % 5 when 1 then 10 when 2 then -15 when 3 then 200 else 0 end")))


def final_violations(spark, sf_dir):
    form = _boxes(spark, sf_dir).withColumn("page_width", F.expr("if(slide_number % 6 = 1, 0D, page_width)"))
    form = form.withColumn("type", F.expr("if(ord % 4 = 0, 'text', type)"))
    tables = form.where("type = 'table'").selectExpr(*PAGE, "element_id", "cast(ord % 3 as double) as x", "0D as y", "2 as n_rows", "3 as n_cols")
    order = form.selectExpr(*PAGE, "if(ord % 50 = 11, element_id + 100000000, element_id) as element_id")
    return payloads.final_violations(form, tables, order)


def integrity_violations(spark, sf_dir):
    """Records of four stages; on some pages a key is missing in one, on some it changes."""
    pages = styled_elements(spark, sf_dir).select(*PAGE).distinct()
    keys = F.explode(F.array(*(F.lit(k) for k in payloads.INTEGRITY))).alias("key")
    r = pages.select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("stage")).select("*", keys).withColumn("value", F.expr("if(slide_number % 4 = 1 and stage = 3 and key = 'image_hash', 'other', concat(key, slide_number))"))
    return payloads.integrity(r.where("not (slide_number % 5 = 2 and stage = 2 and key = 'pipeline_version')"))


def image_hash_violations(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.base64(F.col("text").cast("binary")).alias("image_data"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    d = d.withColumn("image_hash", F.expr("case when doc_id % 5 = 0 then reverse(h) when doc_id % 7 = 0 then '' else h end")).withColumn("image_data", F.expr("if(doc_id % 11 = 3, 'no base64 *', replace(image_data, '\\r\\n', ''))"))
    return payloads.image_hash_violations(d).select("doc_id", "image_hash")


def consistent_readings(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.expr("if(doc_id % 2 = 0, substr(text, 1, cast(length(text) * (doc_id % 10) / 10 as int)), text)").alias("other"))
    return d.select("doc_id", payloads.consistent(F.col("text"), F.col("other")).alias("consistent"))


def consumed_spans(spark, sf_dir):
    e = styled_elements(spark, sf_dir)
    return payloads.consumed_spans(e.where("element_type = 'text_box'"), e.where("element_type = 'table'"))


def background_colors(spark, sf_dir):
    e = styled_elements(spark, sf_dir)
    return payloads.background_at(e.where("element_type = 'text_box'"), e.where("element_type = 'shape'"))


def boxes_without_text(spark, sf_dir):
    e = styled_elements(spark, sf_dir)
    return payloads.boxes_without_text(e.where("element_type = 'shape'"), e.where("element_type = 'text_box'").withColumn("width", F.expr("width / 4"))).select(*PAGE, "element_id")


def boxes_in_crop(spark, sf_dir):
    e = styled_elements(spark, sf_dir)
    crops = e.select(*PAGE).distinct().selectExpr(*PAGE, "1000000D as x", "500000D as y", "6000000D as width", "3000000D as height")
    return payloads.inside_crop(e, crops)


def appended_elements(spark, sf_dir):
    """Elements, lines found again with ids that half of them have already, and boxes with ids of their own."""
    e = styled_elements(spark, sf_dir).select(*PAGE, "element_id", "ord", "element_type")
    again = e.where("ord % 7 = 0").selectExpr(*PAGE, "if(ord % 2 = 0, element_id, element_id + 1000000) as element_id", "ord", "'line' as element_type")
    boxes = e.where("ord % 11 = 0").selectExpr(*PAGE, "if(ord % 3 = 0, element_id + 1000000, element_id + 2000000) as element_id", "ord", "'checkbox' as element_type")
    return payloads.append_new(e, again, boxes).select(*PAGE, "element_id", "element_type", "source_no")


def suppressed_cells(spark, sf_dir):
    e = styled_elements(spark, sf_dir).withColumn("x", F.expr("x / 9525")).withColumn("y", F.expr("y / 9525")).withColumn("width", F.expr("width / 9525")).withColumn("height", F.expr("height / 9525"))
    cells = e.where("element_type = 'table'").selectExpr(*PAGE, "element_id as table_id", "cast(ord % 3 as int) as row", "cast(ord % 2 as int) as col", "x", "y", "width", "height", "text")
    return payloads.suppressed_cells(cells, e.where("element_type = 'text_box' and text <> ''"))


def wrapped_lines(spark, sf_dir):
    return payloads.wrapped_lines(read(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", 40)


def run_statistics(spark, sf_dir):
    return sinks.statistics(styled_elements(spark, sf_dir))


def page_summaries(spark, sf_dir):
    e = styled_elements(spark, sf_dir)
    n = lambda t: F.count_if(F.col("element_type") == t)
    facts = e.groupBy(*PAGE).agg(n("image").alias("images"), n("table").alias("tables"), n("chart").alias("charts")).selectExpr(*PAGE, "if(slide_number % 4 = 0, 'Overview', null) as title", "if(slide_number % 3 = 0, 'two_column', 'diagram') as layout",
        "if(slide_number % 5 = 0, 0, images) as images", "if(slide_number % 5 = 0, 0, tables) as tables", "if(slide_number % 5 < 2, 0, charts) as charts")
    points = pagefacts.text_points(e).withColumn("text", naming.concept(F.col("text")))
    return sinks.summaries(facts, points)


def form_records(spark, sf_dir):
    """The elements of a form page as its JSON record has them."""
    from quire.operators import formpage
    from quire.plans.formpage_queries import _pages

    form = _form(spark, sf_dir)
    return sinks.reread(sinks.form_records(form, formpage.page_geometry(_pages(spark, sf_dir))), "elements", form)


def reconstruction_records(spark, sf_dir):
    """The high-fidelity objects of a page as its JSON record has them."""
    objects = fidelity_objects(spark, sf_dir)
    return sinks.reread(sinks.records(objects, "element_id", "objects"), "objects", objects)


def ruled_answers(spark, sf_dir):
    """Rewritten texts without a model: the rule's answers stand."""
    o = semantics.objects(styled_elements(spark, sf_dir)).where("characters > 0").groupBy("role").agg(F.min("text").alias("text"))
    return enrich.enrich(o, "role", "text", F.upper("text"))


QUERIES = {
    f.__name__: f
    for f in (fidelity_objects, model_elements, visual_objects, connector_instructions, page_purposes, draw_list, clamped_boxes, cells_outside, final_violations, integrity_violations, image_hash_violations, consistent_readings, consumed_spans, background_colors, boxes_without_text,
              boxes_in_crop, appended_elements, suppressed_cells, wrapped_lines, run_statistics, page_summaries, form_records, reconstruction_records, ruled_answers)
}

_ST = f"{ELEMENTS_SQL}, {STYLED_SQL}"
_TRIM = lambda c: rf"regexp_replace({c}, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')"
_R = lambda v, n: f"CAST(round_even(CAST(CAST({v} AS VARCHAR) AS DECIMAL(38, 20)), {n}) AS DOUBLE)"
_BX = f"""{_ST}, bx AS (SELECT {_PAGE}, element_id, ord, CASE WHEN ord % 12 = 1 THEN 'line' ELSE element_type END AS type, CASE WHEN ord % 4 = 0 THEN 'same' ELSE text END AS text, 960.0::DOUBLE AS pw, 720.0::DOUBLE AS ph,
  CASE WHEN ord % 4 = 0 THEN 10.0 ELSE ord * 37 % 1300 - 150 END::DOUBLE AS x, CASE WHEN ord % 4 = 0 THEN 20.0 ELSE ord * 53 % 900 - 90 END::DOUBLE AS y, CASE WHEN ord % 25 = 6 THEN -5.0 ELSE ord % 3 * 100 END::DOUBLE AS width, (ord % 2 * 60)::DOUBLE AS height FROM st)"""
_RANK = "CASE " + " ".join(f"WHEN lower(type) IN ({', '.join(repr(t) for t in types)}) THEN {i}" for i, (_, types) in enumerate(payloads.LAYERS)) + " END"
_WORDS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9_]+'))"

ORACLES = {
    "fidelity_objects": f"""WITH {_ST}, f AS (SELECT * REPLACE (CASE WHEN ord % 40 = 3 THEN 50.0 ELSE y END AS y) FROM st)
SELECT {_PAGE}, element_id, element_type, lower(coalesce(shape_type, element_type)) AS class, CASE WHEN bold AND y < 100 THEN 'title' WHEN element_type IN ('checkbox', 'table', 'chart') THEN element_type ELSE 'body' END AS role,
  {', '.join(f"{_R(f'{c} / 9525.0', 1)} AS {c}_px" for c in ('x', 'y', 'width', 'height'))}, {', '.join(f"{_R(f'100 * {c} / {t}', 2)} AS {c}_pct" for c, t in (('x', '12192000.0'), ('y', '6858000.0'), ('width', '12192000.0'), ('height', '6858000.0')))},
  fill_color, CASE WHEN element_type IN ('arrow', 'connector') THEN text_color END AS border_color, coalesce(text, '') AS text, CASE WHEN coalesce(text, '') <> '' THEN coalesce(font_family, 'Arial') END AS font_family,
  CASE WHEN coalesce(text, '') <> '' THEN coalesce(font_size, 12.0) END AS font_size, CASE WHEN coalesce(text, '') <> '' THEN CASE WHEN bold THEN 'bold' ELSE 'normal' END END AS font_weight FROM f""",
    "model_elements": f"""WITH {_ST}, rc AS (SELECT {_PAGE}, greatest(12192000.0, max(x + width)) AS cw, greatest(6858000.0, max(y + height)) AS ch FROM st GROUP BY {_PAGE})
SELECT {_PAGE}, element_id, element_type, replace({_TRIM("coalesce(text, '')")}, chr(10), ' ') AS content, {_R('x / cw * 100', 2)} AS "left", {_R('y / ch * 100', 2)} AS top, {_R('width / cw * 100', 2)} AS width, {_R('height / ch * 100', 2)} AS height, z_order FROM st JOIN rc USING ({_PAGE})""",
    "visual_objects": f"""WITH {_ST}, r AS (SELECT {_PAGE}, max(x + width) AS mx, max(y + height) AS my FROM st GROUP BY {_PAGE}),
c AS (SELECT {_PAGE}, CASE WHEN mx > 100000 THEN greatest(mx, 12192000.0) ELSE greatest(mx, 1920.0) END AS cw, CASE WHEN mx > 100000 THEN greatest(my, 6858000.0) ELSE greatest(my, 1080.0) END AS ch FROM r),
pl AS (SELECT DISTINCT text AS said, plain FROM ({SEMANTIC['rewritten_texts']}))
SELECT {_PAGE}, element_id, element_type, coalesce(shape_type, 'rectangle') AS shape_type, CASE WHEN text <> '' THEN nullif(plain, '') END AS text, {_R('x / cw * 100', 2)} AS left_pct, {_R('y / ch * 100', 2)} AS top_pct,
  {_R('width / cw * 100', 2)} AS width_pct, {_R('height / ch * 100', 2)} AS height_pct, coalesce(z_order, 0) AS z_order, 'top-left' AS anchor, parent, group_id, fill_color, coalesce(font_family, 'Arial') AS font_family,
  coalesce(font_size, 12.0) AS font_size, coalesce(bold, false) AS bold, coalesce(text_color, '#000000') AS color, 'Visual object representing a ' || element_type || ' of type ' || coalesce(shape_type, 'rect') || '.' AS semantic_meaning
FROM st JOIN c USING ({_PAGE}) LEFT JOIN pl ON st.text = pl.said""",
    "connector_instructions": f"""WITH {_ST}, {_ENDS} SELECT {_PAGE}, source AS source_element_id, target AS target_element_id,
  'Draw a connector from ' || source || ' to ' || target || CASE WHEN source % 3 = 0 THEN concat(' with visible label ', chr(39), 'if late', chr(39)) ELSE '' END || '.' AS instruction FROM rl""",
    "page_purposes": f"""WITH {_ST}, p AS (SELECT {_PAGE}, max(text) FILTER (text <> '') AS t FROM st GROUP BY {_PAGE})
SELECT {_PAGE}, CASE WHEN t IS NULL THEN 'Recreate the presentation slide from extracted visual and semantic structure.' WHEN slide_number % 4 = 0 THEN 'Flow of ' || t WHEN slide_number % 4 = 1 THEN trim(replace(split_part(t, chr(10), 1), '#', ''))
  WHEN slide_number % 4 = 2 THEN 'Recreate a slide explaining ' || t || '.' ELSE 'Recreate the presentation slide from extracted visual and semantic structure.' END AS purpose FROM p""",
    "draw_list": f"""WITH {_FORM}, d AS (SELECT {_PAGE}, element_id, reading_order, {_RANK} AS rank FROM form) SELECT {_PAGE}, CAST(row_number() OVER (PARTITION BY {_PAGE} ORDER BY rank, reading_order, element_id) AS INT) AS seq,
  ([{', '.join(repr(n) for n, _ in payloads.LAYERS)}])[rank + 1] AS layer, element_id FROM d WHERE rank IS NOT NULL""",
    "clamped_boxes": f"""WITH {_BX}, o AS (SELECT *, x + width - pw AS ox, y + height - ph AS oy, row_number() OVER (PARTITION BY {_PAGE}, text, x, y, width, height ORDER BY ord) AS k FROM bx)
SELECT {_PAGE}, element_id, CASE WHEN type <> 'line' AND (width < 0 OR height < 0) THEN 'negative_size' WHEN x < -100 OR y < -100 OR x > pw + 100 OR y > ph + 100 THEN 'out_of_bounds' WHEN coalesce(text, '') <> '' AND k > 1 THEN 'repeated' ELSE 'ok' END AS verdict,
  CASE WHEN ox > 0 THEN CASE WHEN x >= ox THEN x - ox ELSE 0 END ELSE greatest(0, x) END AS x, CASE WHEN oy > 0 THEN CASE WHEN y >= oy THEN y - oy ELSE 0 END ELSE greatest(0, y) END AS y,
  CASE WHEN ox > 0 AND x < ox THEN pw ELSE width END AS width, CASE WHEN oy > 0 AND y < oy THEN ph ELSE height END AS height FROM o""",
    "cells_outside": f"""WITH {_MERGES}, m AS (SELECT cg.table_id, cg."row", cg.col, cg.x + CASE (cg.table_id + cg."row") % 5 WHEN 1 THEN 10 WHEN 2 THEN -15 WHEN 3 THEN 200 ELSE 0 END AS x, cg.y, cg.width, cg.height, tb.x AS tx, tb.y AS ty, tb.width AS tw, tb.height AS th FROM cg JOIN tb USING (table_id)),
o AS (SELECT *, x < tx OR y < ty OR x + width > tx + tw OR y + height > ty + th AS o FROM m)
SELECT table_id, "row", col, CASE WHEN x < tx - 20 OR y < ty - 20 OR x + width > tx + tw + 20 OR y + height > ty + th + 20 THEN 'rejected' WHEN o THEN 'moved' ELSE 'ok' END AS verdict,
  CASE WHEN o THEN greatest(tx, least(x, tx + tw - width)) ELSE x END AS x, CASE WHEN o THEN greatest(ty, least(y, ty + th - height)) ELSE y END AS y FROM o""",
    "final_violations": f"""WITH {_BX}, f AS (SELECT * REPLACE (CASE WHEN slide_number % 6 = 1 THEN 0.0 ELSE pw END AS pw, CASE WHEN ord % 4 = 0 THEN 'text' ELSE type END AS type) FROM bx)
SELECT DISTINCT {_PAGE}, 'page_size' AS violation, '' AS subject FROM f WHERE pw <= 0 UNION ALL SELECT {_PAGE}, 'duplicate_table', CAST(min(element_id) AS VARCHAR) FROM f WHERE type = 'table' GROUP BY {_PAGE}, ord % 3 HAVING count(*) > 1
UNION ALL SELECT {_PAGE}, 'duplicate_text', CAST(min(element_id) AS VARCHAR) FROM f WHERE type IN ('text_box', 'text') GROUP BY {_PAGE}, x, y, text HAVING count(*) > 1
UNION ALL SELECT {_PAGE}, 'out_of_bounds', CAST(element_id AS VARCHAR) FROM f WHERE x < -10 OR y < -10 OR x > pw + 10 OR y > ph + 10 UNION ALL SELECT {_PAGE}, 'unknown_in_order', CAST(element_id + 100000000 AS VARCHAR) FROM f WHERE ord % 50 = 11""",
    "integrity_violations": f"""WITH {ELEMENTS_SQL}, p AS (SELECT DISTINCT {_PAGE} FROM el) SELECT {_PAGE}, 'pipeline_version' AS key, 'missing' AS violation FROM p WHERE slide_number % 5 = 2 UNION ALL SELECT {_PAGE}, 'image_hash', 'changed' FROM p WHERE slide_number % 4 = 1""",
    "image_hash_violations": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN reverse(sha256(text)) ELSE sha256(text) END AS image_hash FROM documents WHERE text <> '' AND ((doc_id % 5 = 0 AND reverse(sha256(text)) <> sha256(text)) OR (doc_id % 11 = 3 AND (doc_id % 7 <> 0 OR doc_id % 5 = 0)))""",
    "consistent_readings": f"""WITH d AS (SELECT doc_id, {_WORDS('text')} AS x, {_WORDS("CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, CAST(trunc(length(text) * (doc_id % 10) / 10) AS INT)) ELSE text END")} AS y FROM documents)
SELECT doc_id, CASE WHEN greatest(len(x), len(y)) = 0 THEN true ELSE len(list_intersect(x, y)) / greatest(len(x), len(y)) >= 0.4 END AS consistent FROM d""",
    "consumed_spans": f"""WITH {_ST} SELECT s.document_id, s.slide_number, s.element_id, t.element_id AS table_id, row_number() OVER (PARTITION BY s.document_id, s.slide_number, t.element_id ORDER BY s.ord) = 1 AS first
FROM st s JOIN st t ON s.document_id = t.document_id AND s.slide_number = t.slide_number AND s.element_type = 'text_box' AND t.element_type = 'table' AND s.x BETWEEN t.x - 500 AND t.x + t.width + 500 AND s.y BETWEEN t.y - 500 AND t.y + t.height + 500""",
    "background_colors": f"""WITH {_ST}, m AS (SELECT s.document_id, s.slide_number, s.element_id, d.ord, d.fill_color, least(s.x + s.width, d.x + d.width) - greatest(s.x, d.x) AS w, least(s.y + s.height, d.y + d.height) - greatest(s.y, d.y) AS h
  FROM st s JOIN st d ON s.document_id = d.document_id AND s.slide_number = d.slide_number AND s.element_type = 'text_box' AND d.element_type = 'shape' AND d.fill_color <> '' AND lower(d.fill_color) <> '#ffffff')
SELECT {_PAGE}, element_id, arg_max(fill_color, ord) AS background FROM m WHERE w > 0 AND h > 0 AND w * h > 10 GROUP BY ALL""",
    "boxes_without_text": f"""WITH {_ST} SELECT {_PAGE}, element_id FROM st b WHERE element_type = 'shape' AND NOT EXISTS (SELECT 1 FROM st t WHERE t.element_type = 'text_box' AND t.document_id = b.document_id AND t.slide_number = b.slide_number
  AND b.x + b.width / 2 BETWEEN t.x - 5 AND t.x + t.width / 4 + 5 AND b.y + b.height / 2 BETWEEN t.y - 5 AND t.y + t.height + 5)""",
    "boxes_in_crop": f"WITH {_ST} SELECT {_PAGE}, element_id, x - 1000000 AS x, y - 500000 AS y FROM st WHERE x + width / 2 BETWEEN 1000000 AND 7000000 AND y + height / 2 BETWEEN 500000 AND 3500000",
    "appended_elements": f"""WITH {_ST}, a AS (SELECT {_PAGE}, element_id, ord, element_type, 0 AS source_no FROM st UNION ALL SELECT {_PAGE}, CASE WHEN ord % 2 = 0 THEN element_id ELSE element_id + 1000000 END, ord, 'line', 1 FROM st WHERE ord % 7 = 0
  UNION ALL SELECT {_PAGE}, CASE WHEN ord % 3 = 0 THEN element_id + 1000000 ELSE element_id + 2000000 END, ord, 'checkbox', 2 FROM st WHERE ord % 11 = 0)
SELECT {_PAGE}, element_id, element_type, source_no FROM a QUALIFY row_number() OVER (PARTITION BY {_PAGE}, element_id ORDER BY source_no, ord) = 1""",
    "run_statistics": f"""WITH {_ST}, k AS (SELECT document_id, element_type, count(*) AS n FROM st GROUP BY ALL), t AS (SELECT document_id, string_agg(element_type || '=' || n, ',' ORDER BY element_type) AS types FROM k GROUP BY document_id),
p AS (SELECT {_PAGE}, count(*) AS n, count(*) FILTER (trim(coalesce(text, '')) <> '') AS t FROM st GROUP BY {_PAGE})
SELECT document_id, count(*) AS pages, CAST(sum(n) AS BIGINT) AS elements, CAST(sum(t) AS BIGINT) AS with_text, max(n) AS largest_page, first(types) AS types FROM p JOIN t USING (document_id) GROUP BY document_id""",
    "page_summaries": rf"""WITH {_ST}, f AS (SELECT {_PAGE}, slide_number % 4 = 0 AS titled, CASE WHEN slide_number % 3 = 0 THEN 'two_column' ELSE 'diagram' END AS layout, CASE WHEN slide_number % 5 = 0 THEN 0 ELSE count(*) FILTER (element_type = 'image') END AS i,
  CASE WHEN slide_number % 5 = 0 THEN 0 ELSE count(*) FILTER (element_type = 'table') END AS t, CASE WHEN slide_number % 5 < 2 THEN 0 ELSE count(*) FILTER (element_type = 'chart') END AS c FROM st GROUP BY {_PAGE}),
l AS (SELECT {_PAGE}, y, x, ord, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM st),
p AS (SELECT {_PAGE}, {_TRIM('raw')} AS text, row_number() OVER (PARTITION BY {_PAGE} ORDER BY y, x, ord, pos) AS n FROM l WHERE {_TRIM('raw')} <> ''),
q AS (SELECT {_PAGE}, string_agg(CASE WHEN length(text) > 80 THEN array_to_string(([w FOR w IN regexp_split_to_array(text, '\s+') IF w <> ''])[1:8], ' ') || '...' ELSE text END, '; ' ORDER BY n) AS points FROM p WHERE n <= 3 GROUP BY {_PAGE}),
s AS (SELECT f.*, points, concat_ws(', ', CASE WHEN i > 0 THEN i || ' image(s)' END, CASE WHEN t > 0 THEN t || ' table(s)' END, CASE WHEN c > 0 THEN c || ' chart(s)' END) AS shown FROM f LEFT JOIN q USING ({_PAGE}))
SELECT {_PAGE}, concat_ws(' ', CASE WHEN titled THEN 'This slide, titled ''Overview'', explains key concepts on this topic.' ELSE 'This slide presents information in a ' || layout || ' layout.' END,
  CASE WHEN shown <> '' THEN 'The slide utilizes a visual layout featuring ' || shown || ' to support the explanation.' ELSE 'The layout is structured as a ' || layout || ' presentation.' END, 'It covers the following points: ' || points || '.') AS summary FROM s""",
    "ruled_answers": f"WITH {OBJECTS} SELECT role, min(text) AS text, upper(min(text)) AS answer, 'rule' AS answered_by FROM ob WHERE characters > 0 GROUP BY role",
}

# what a reader of the records gets is what went in
ORACLES["reconstruction_records"] = ORACLES["fidelity_objects"]
ORACLES["form_records"] = FORM_PAGES["form_elements"]
ORACLES["wrapped_lines"] = r"""WITH RECURSIVE w AS (SELECT item_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '\s+') IF x <> ''] AS w FROM benchmark),
g(item_id, i, line_no, line) AS (SELECT item_id, 1, 0, coalesce(w[1], '') FROM w UNION ALL
  SELECT g.item_id, i + 1, CASE WHEN length(line) + 1 + length(w[i + 1]) <= 40 THEN line_no ELSE line_no + 1 END, CASE WHEN length(line) + 1 + length(w[i + 1]) <= 40 THEN line || ' ' || w[i + 1] ELSE w[i + 1] END FROM g JOIN w USING (item_id) WHERE i < len(w))
SELECT item_id, line_no, arg_max(line, i) AS line FROM g GROUP BY 1, 2"""
_TIGHT = lambda c: rf"regexp_replace(lower(coalesce({c}, '')), '\s+', '', 'g')"
ORACLES["suppressed_cells"] = f"""WITH RECURSIVE {_ST}, e AS (SELECT *, x / 9525 + width / 9525 / 2 AS cx, y / 9525 + height / 9525 / 2 AS cy, {_TIGHT("text")} AS t FROM st),
c AS (SELECT *, CAST(ord % 3 AS INT) AS r, CAST(ord % 2 AS INT) AS col FROM e WHERE element_type = 'table' AND coalesce(text, '') <> ''),
m AS (SELECT c.document_id, c.slide_number, c.element_id AS table_id, r, col, list(l.element_id ORDER BY sqrt((c.cx - l.cx) * (c.cx - l.cx) + (c.cy - l.cy) * (c.cy - l.cy)), l.y, l.x, l.element_id) AS l
  FROM c JOIN e l ON l.document_id = c.document_id AND l.slide_number = c.slide_number AND l.element_type = 'text_box' AND l.text <> '' AND (contains(l.t, c.t) OR contains(c.t, l.t))
    AND sqrt((c.cx - l.cx) * (c.cx - l.cx) + (c.cy - l.cy) * (c.cy - l.cy)) < 400 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY {_PAGE} ORDER BY r, col, table_id) AS k FROM m),
z(document_id, slide_number, k, used, table_id, r, col, take) AS (SELECT DISTINCT {_PAGE}, CAST(0 AS BIGINT), [CAST(-1 AS BIGINT)], CAST(NULL AS BIGINT), 0, 0, CAST(NULL AS BIGINT) FROM n UNION ALL
  SELECT {_PAGE}, k, CASE WHEN len(free) > 0 THEN list_append(used, free[1]) ELSE used END, table_id, r, col, free[1]
  FROM (SELECT n.*, z.used, list_filter(n.l, lambda q: NOT list_contains(z.used, q)) AS free FROM z JOIN n ON n.document_id = z.document_id AND n.slide_number = z.slide_number AND n.k = z.k + 1))
SELECT {_PAGE}, table_id, r AS "row", col, take AS element_id FROM z WHERE take IS NOT NULL"""
