"""Queries of small joins and limits, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import matching, pagefacts, semantics, tables
from quire.plans.content_queries import read
from quire.plans.semantic_queries import OBJECTS
from quire.plans.table_queries import ORACLES as TABLES
from quire.plans.table_queries import cells_from_orders
from quire.plans.wording_queries import _pixels
from quire.sources.elements import ELEMENTS_SQL, PAGE, STYLED_SQL, styled_elements

_PAGE = "document_id, slide_number"


def table_intelligence(spark, sf_dir):
    t = styled_elements(spark, sf_dir).where("element_type = 'table'").selectExpr(*PAGE, "element_id as table_id")
    return matching.with_intelligence(t, t.where("table_id % 3 = 0").withColumn("said", F.concat(F.lit("about "), F.col("table_id").cast("string"))))


def element_regions(spark, sf_dir):
    e = styled_elements(spark, sf_dir)
    half = e.groupBy(*PAGE, F.expr("if(x < 6000000, 'left', 'right')").alias("name")).agg(F.collect_list("element_id").alias("element_ids"))
    big = e.where("width * height > 2e12").groupBy(*PAGE, F.lit("big").alias("name")).agg(F.collect_list("element_id").alias("element_ids"))
    return matching.regions_of(e.where("ord % 2 = 0"), half.unionByName(big))


def first_enrichments(spark, sf_dir):
    e = styled_elements(spark, sf_dir)
    said = e.where("ord % 4 = 1 and text <> ''").selectExpr(*PAGE, "element_id as enrichment_id", "ord", "if(ord % 3 = 0, substr(text, 1, 6), concat('  ', upper(text))) as original")
    return matching.first_enrichment(e, said)


def zipped_turns(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return matching.zipped(c.where("role = 'user'").select("conv_id", "turn"), c.where("role = 'assistant'").select("conv_id", "turn"), "conv_id", "turn").select("conv_id", F.col("place").cast("long").alias("place"), "turn", "other_turn")


def merged_extraction(spark, sf_dir):
    e = styled_elements(spark, sf_dir).select(*PAGE, "element_id", "element_type")
    return matching.merged_extraction(e.where("element_id % 3 <> 1").withColumn("element_type", F.lit("line")), e.where("element_id % 2 = 0"))


def capped_lists(spark, sf_dir):
    e = styled_elements(spark, sf_dir).groupBy(*PAGE).agg(F.sort_array(F.collect_list("element_id")).alias("ids"))
    return e.select(*PAGE, *(F.array_join(F.transform(matching.capped(F.col("ids"), k), lambda i: i.cast("string")), ",").alias(k) for k in matching.CAPS))


def frequent_colors(spark, sf_dir):
    return matching.frequent_colors(_pixels(spark, sf_dir), "image_id")


def image_rows(spark, sf_dir):
    return matching.image_rows(styled_elements(spark, sf_dir).withColumn("summary", F.expr("if(ord % 3 = 0, 'a tree', null)")))


def texts_to_rewrite(spark, sf_dir):
    return matching.texts_to_rewrite(semantics.objects(styled_elements(spark, sf_dir)))


def markdown_lists(spark, sf_dir):
    e = styled_elements(spark, sf_dir).where("element_type = 'table'")
    return matching.markdown_list(e.withColumn("markdown", F.expr("case ord % 3 when 0 then concat('| ', element_id, ' |') when 1 then '' end")))


def inventory_sentences(spark, sf_dir):
    return matching.inventory_sentence(pagefacts.full_inventory(styled_elements(spark, sf_dir)))


def grid_summaries(spark, sf_dir):
    return matching.grid_summary(cells_from_orders(spark, sf_dir))


def table_guides(spark, sf_dir):
    return matching.guides(tables.table_profile(cells_from_orders(spark, sf_dir)))


def position_map(spark, sf_dir):
    return matching.position_map(styled_elements(spark, sf_dir))


def canvas_records(spark, sf_dir):
    p = styled_elements(spark, sf_dir).select(*PAGE).distinct()
    return matching.canvas_record(p.selectExpr(*PAGE, "case slide_number % 3 when 0 then 0 when 1 then 9144000 end as slide_width", "if(slide_number % 2 = 0, 5143500, null) as slide_height", "if(slide_number % 4 = 0, '#ffffff', null) as background_color"))


def public_metadata(spark, sf_dir):
    """Keys of maps and nested fields that payloads keep, as JSON."""
    p = read(spark, sf_dir, "pages").selectExpr(
        "page_id", "map('__raw', url, 'text', left(html, 40), 'url', url) as metadata",
        "named_struct('url', url, 'image_hash', html, 'elements', array(named_struct('id', page_id, 'image_data', url), null), 'metadata', map('image_type', html, 'title', left(html, 40))) as page", "url as screenshots",
    )
    p = matching.without_pictures(p).withColumns({"public": F.to_json(matching.public_keys(F.col("metadata"))), "light": F.to_json(matching.light_keys(F.col("metadata")))})
    return p.select("page_id", "public", "light", F.to_json("page").alias("page"), F.lit("screenshots" in p.columns).alias("kept"))


QUERIES = {f.__name__: f for f in (table_intelligence, element_regions, first_enrichments, zipped_turns, merged_extraction, capped_lists, frequent_colors, image_rows, texts_to_rewrite, markdown_lists, inventory_sentences, grid_summaries, table_guides, position_map, canvas_records, public_metadata)}

_ST = f"{ELEMENTS_SQL}, {STYLED_SQL}"
_BARE = lambda c: rf"lower(trim(regexp_replace({c}, '[\s\x0B]+', ' ', 'g')))"
_N = lambda k: f"count(*) FILTER (element_type = '{k}')"

ORACLES = {
    "table_intelligence": f"WITH {_ST} SELECT {_PAGE}, element_id AS table_id, CASE WHEN element_id % 3 = 0 THEN 'about ' || element_id END AS said FROM st WHERE element_type = 'table'",
    "element_regions": f"""WITH {_ST} SELECT {_PAGE}, element_id, CASE WHEN x < 6000000 THEN 'left' ELSE 'right' END AS name FROM st WHERE ord % 2 = 0 UNION ALL SELECT {_PAGE}, element_id, 'big' FROM st WHERE ord % 2 = 0 AND width * height > 2e12""",
    "first_enrichments": f"""WITH {_ST}, t AS (SELECT {_PAGE}, element_id, {_BARE("coalesce(text, '')")} AS t FROM st WHERE {_BARE("coalesce(text, '')")} <> ''),
e AS (SELECT {_PAGE}, element_id AS i, ord, {_BARE("CASE WHEN ord % 3 = 0 THEN substr(text, 1, 6) ELSE '  ' || upper(text) END")} AS o FROM st WHERE ord % 4 = 1 AND text <> '')
SELECT t.document_id, t.slide_number, t.element_id, arg_min(i, ord) AS enrichment_id FROM t JOIN e ON t.document_id = e.document_id AND t.slide_number = e.slide_number AND (contains(o, t) OR contains(t, o)) GROUP BY ALL""",
    "zipped_turns": """WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'assistant')
SELECT conv_id, place, u.turn, a.turn AS other_turn FROM u JOIN a USING (conv_id, place)""",
    "merged_extraction": f"WITH {_ST} SELECT {_PAGE}, element_id, element_type, 'base' AS source FROM st WHERE element_id % 2 = 0 UNION ALL SELECT {_PAGE}, element_id, 'line', 'found' FROM st WHERE element_id % 2 = 1 AND element_id % 3 <> 1",
    "capped_lists": f"""WITH {_ST}, l AS (SELECT {_PAGE}, list(CAST(element_id AS VARCHAR) ORDER BY element_id) AS l FROM st GROUP BY {_PAGE}) SELECT {_PAGE}, {', '.join(f"array_to_string(l[1:{n}], ',') AS {k}" for k, n in matching.CAPS.items())} FROM l""",
    "frequent_colors": """WITH p AS (SELECT user_id AS image_id, '#' || printf('%02x', CAST(event_id * 31 % 256 // 24 * 24 AS INT)) || printf('%02x', CAST(event_id * 17 % 256 // 24 * 24 AS INT)) || printf('%02x', CAST(event_id % 256 // 24 * 24 AS INT)) AS color FROM events),
n AS (SELECT image_id, color, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, color) AS k, sum(n) OVER (PARTITION BY image_id) AS a FROM n)
SELECT image_id, color, n FROM r WHERE k <= 10 AND n >= 0.01 * a AND n <= 0.8 * a""",
    "image_rows": f"""WITH {_ST}, i AS (SELECT *, concat_ws(', ', nullif(fill_color, ''), nullif(text_color, '')) AS c FROM st WHERE element_type = 'image')
SELECT {_PAGE}, CAST(row_number() OVER (PARTITION BY {_PAGE} ORDER BY ord) AS INT) AS image_number, element_id, CASE WHEN ord % 3 = 0 THEN 'contextual illustration' ELSE 'photographic' END AS style, CASE WHEN c <> '' THEN c ELSE 'inherited from slide palette' END AS colors,
  'Positioned in the slide layout at element ' || element_id AS composition FROM i""",
    "texts_to_rewrite": f"WITH {OBJECTS} SELECT {_PAGE}, element_id, trim(text) AS source_text, role, parent, x, y, width, height FROM ob WHERE characters > 0",
    "markdown_lists": f"WITH {_ST} SELECT {_PAGE}, string_agg('| ' || element_id || ' |', chr(10) || chr(10) ORDER BY ord) AS markdowns, count(*) AS n FROM st WHERE element_type = 'table' AND ord % 3 = 0 GROUP BY {_PAGE}",
    "inventory_sentences": f"""WITH {_ST} SELECT {_PAGE}, count(*) || ' total elements, ' || {_N('text_box')} || ' text boxes, ' || {_N('shape')} || ' shapes, ' || {_N('arrow')} || ' arrows, ' || {_N('image')} || ' images, ' || {_N('table')} || ' tables, ' || {_N('chart')} || ' charts.' AS sentence,
  CASE WHEN {_N('arrow')} + {_N('connector')} > 3 THEN 'flowchart' WHEN {_N('table')} > 0 THEN 'table_slide' WHEN {_N('chart')} > 0 THEN 'chart_slide' WHEN {_N('image')} > 3 THEN 'image_heavy' ELSE 'general' END AS archetype FROM st GROUP BY {_PAGE}""",
    "grid_summaries": "SELECT o_custkey AS table_id, count(*) AS row_count, CAST(4 AS BIGINT) AS column_count, 'grid' AS layout_type, count(*) || ' rows detected' AS summary, 'consulting_framework' AS table_category, CAST(0.8 AS DOUBLE) AS confidence FROM orders GROUP BY o_custkey",
    "table_guides": f"SELECT table_id, replace(replace('{matching.GUIDE.replace(chr(39), chr(39) * 2)}', '%s', archetype), '%d', CAST(header_depth AS VARCHAR)) AS guide FROM ({TABLES['table_profile']})",
    "position_map": f"WITH {_ST} SELECT {_PAGE}, element_id, element_type, x, y, width, height FROM st",
    "canvas_records": f"""WITH {_ST}, p AS (SELECT DISTINCT {_PAGE}, CASE WHEN slide_number % 3 = 1 THEN 9144000.0::DOUBLE ELSE 12192000.0 END AS width, CASE WHEN slide_number % 2 = 0 THEN 5143500.0::DOUBLE ELSE 6858000.0 END AS height FROM st)
SELECT {_PAGE}, width, height, CASE WHEN slide_number % 4 = 0 THEN '#ffffff' END AS fill_color, CAST(round_even(width / height, 6) AS DOUBLE) AS aspect_ratio, true AS preserve_exactly, 'EMU_or_source_units' AS coordinate_unit, 'top_left' AS origin, 'left_to_right' AS x_axis,
  'top_to_bottom' AS y_axis, 'slide_background' AS theme_role FROM p""",
    "public_metadata": """SELECT page_id, '{"text":' || to_json(left(html, 40)) || ',"url":' || to_json(url) || '}' AS public, '{"__raw":' || to_json(url) || ',"url":' || to_json(url) || '}' AS light,
  '{"url":' || to_json(url) || ',"elements":[{"id":' || page_id || '},null],"metadata":{"title":' || to_json(left(html, 40)) || '}}' AS page, false AS kept FROM pages""",
}
