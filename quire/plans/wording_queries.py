"""Queries of sentences about tables and pages and of JSON in answers, with the same in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import wording
from quire.plans.content_queries import read
from quire.plans.fact_queries import _ST, _TITLES, _titles
from quire.plans.table_queries import _ROWS, ORACLES as TABLES, cells_from_orders
from quire.sources.elements import PAGE, styled_elements

_PAGE = "document_id, slide_number"


def table_classes(spark, sf_dir):
    return wording.table_class(cells_from_orders(spark, sf_dir))


def table_words(spark, sf_dir):
    return wording.table_words(cells_from_orders(spark, sf_dir))


def render_cells(spark, sf_dir):
    return wording.render_cells(cells_from_orders(spark, sf_dir).where("not (row % 3 = 1 and col = 3)"))


def table_sections(spark, sf_dir):
    return wording.table_sections(cells_from_orders(spark, sf_dir))


def picture_facts(spark, sf_dir):
    pages = _titles(spark, sf_dir).withColumn("is_flowchart", F.expr("slide_number % 7 = 0")).withColumn("is_diagram", F.expr("if(slide_number % 3 = 0, true, null)"))
    return wording.picture_facts(styled_elements(spark, sf_dir).withColumn("text", F.expr("if(slide_number % 4 = 2, null, text)")), pages)


def plain_flow(spark, sf_dir):
    e = styled_elements(spark, sf_dir)
    order = e.where("slide_number % 3 = 1 and element_type = 'text_box'").selectExpr(*PAGE, "element_id", "ord as position").where("slide_number % 2 = 0 or element_id % 61 = 5")
    pages = _titles(spark, sf_dir).selectExpr("*", "if(slide_number % 5 = 0, 'Sales grow. Fast.', null) as plain", "if(slide_number % 4 = 0, ' It means more. ', '') as interpretation", "slide_number % 6 = 0 as is_flowchart", "if(slide_number % 2 = 0, 'two_column', 'diagram') as layout_type")
    return wording.plain_flow(e, order, pages)


def concept_layers(spark, sf_dir):
    return wording.concept_layers(styled_elements(spark, sf_dir), _titles(spark, sf_dir))


def chart_answers(spark, sf_dir):
    """Answers of a model about charts: clean, wrapped in talk, cut off, or no JSON."""
    o = read(spark, sf_dir, "orders").selectExpr("o_orderkey", """concat(case when o_orderkey % 3 = 1 then 'Here is it: ' else '' end,
      case when o_orderkey % 7 = 5 then 'no data' else concat('{"chart_type": "', if(o_orderkey % 2 = 0, 'bar', 'pie'), '", "title": "', o_orderpriority, '", "categories": ["a", "b"], "series": [{"name": "s', o_orderkey % 4, '", "values": [1, ', o_orderkey % 9) end,
      case when o_orderkey % 7 = 5 then '' when o_orderkey % 5 = 2 then ']' else ']}]}' end, case when o_orderkey % 3 = 1 and o_orderkey % 5 <> 2 then ' Hope this helps' else '' end) as answer""")
    return wording.chart_model(o, "o_orderkey")


def file_kinds(spark, sf_dir):
    p = read(spark, sf_dir, "pages").selectExpr("page_id", "concat(url, case page_id % 5 when 0 then '/deck.PPTX?x=1' when 1 then '/a.pdf' when 2 then '/b.jpeg#top' else '' end) as path", "case page_id % 7 when 3 then 'application/vnd.ms-powerpoint' when 4 then 'image/png' when 5 then 'text/html' end as content_type")
    return p.select("page_id", wording.file_kind(F.col("path"), F.col("content_type")).alias("kind"))


def fidelity_scores(spark, sf_dir):
    o = read(spark, sf_dir, "orders").selectExpr("o_orderkey as key", "cast(100 + o_orderkey % 90 as double) as width", "100D as height", "o_orderkey % 11 / 10 as ssim", "o_orderkey % 7 / 6 as layout", "o_orderkey % 5 / 4 as border", "1D as checkbox")
    return wording.fidelity(o, 0.8)


def _pixels(spark, sf_dir):
    return read(spark, sf_dir, "events").selectExpr("user_id as image_id", "cast(event_id % 16 as int) as x", "cast(event_id div 16 % 9 as int) as y", "16 as width", "9 as height", "cast(event_id * 31 % 256 as int) as r", "cast(event_id * 17 % 256 as int) as g", "cast(event_id % 256 as int) as b")


def median_colors(spark, sf_dir):
    return wording.median_colors(_pixels(spark, sf_dir))


def titles_before(spark, sf_dir):
    return wording.next_titles(_titles(spark, sf_dir))


QUERIES = {f.__name__: f for f in (table_classes, table_words, render_cells, table_sections, picture_facts, plain_flow, concept_layers, chart_answers, file_kinds, fidelity_scores, median_colors, titles_before)}

_TRIM = lambda c: rf"regexp_replace({c}, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')"
_PROFILE = f"({TABLES['table_profile']}) p"
_LABEL = f"CASE WHEN {_TRIM('coalesce(text, chr(32))')} <> '' THEN replace({_TRIM('text')}, chr(10), ' ') ELSE '[' || element_id || ']' END"

ORACLES = {
    "table_classes": f"""WITH {_ROWS}, t AS (SELECT table_id, lower(string_agg(array_to_string(c, ' '), ' ' ORDER BY r)) AS t FROM rs GROUP BY table_id)
SELECT t.table_id, CASE {' '.join(f"WHEN regexp_matches(t, '{'|'.join(w)}') THEN '{n}'" for n, w in wording.FAMILIES)} WHEN is_pivot THEN 'matrix_table' ELSE 'simple_table' END AS table_class FROM t JOIN {_PROFILE} ON p.table_id = t.table_id""",
    "table_words": f"""WITH {_ROWS}, o AS (SELECT rs.table_id, first([trim(x) FOR x IN c IF trim(x) <> '']) FILTER (r = 0) AS headers, coalesce(list(trim(c[1]) ORDER BY r) FILTER (r > 0 AND trim(c[1]) <> '' AND NOT regexp_matches(lower(c[1]), 'total|sum')), []) AS names,
  coalesce(string_agg(CAST(r AS VARCHAR), ', ' ORDER BY r) FILTER (r >= header_depth AND len(f) = 1 AND r < rs.n_rows - 1), '') AS sections FROM rs JOIN {_PROFILE} ON p.table_id = rs.table_id GROUP BY rs.table_id),
j AS (SELECT p.*, coalesce(headers, []) AS headers, names[1:6] AS names, sections FROM {_PROFILE} JOIN o ON o.table_id = p.table_id),
k AS (SELECT *, concat_ws(' ', CASE WHEN len(headers) > 0 THEN 'The table contains ' || len(headers) || ' key dimensions.' END, CASE WHEN n_rows > 1 THEN 'The table compares ' || (n_rows - 1) || ' entities.' END,
  CASE WHEN is_financial THEN 'The table contains financial reporting information.' END) AS insights FROM j)
SELECT table_id, CASE WHEN len(headers) > 0 THEN 'Table showing ' || array_to_string(headers[1:3], ', ') ELSE 'Untitled Table' END AS title, 'A ' || archetype || ' with ' || n_rows || ' rows and ' || n_cols || ' columns.' AS summary,
  CASE WHEN is_pivot THEN 'column-major' ELSE 'row-major' END AS reading_order, concat_ws(' ', CASE WHEN archetype = 'complex_cross_tab' THEN 'Recreate as a multi-tier hierarchical matrix. Map the top ' || header_depth || ' rows as spanning headers.' END,
  CASE WHEN is_pivot THEN 'The first column contains primary row identifiers; treat as Y-axis headers.' END, CASE WHEN sections <> '' THEN 'This table contains mid-table section headers at rows [' || sections || ']. These should span the full width.' END,
  '{wording.PARITY.replace("'", "''")}') AS strategy, insights,
  concat_ws(' ', CASE WHEN is_financial THEN 'This is a audit-style financial table.' ELSE 'This is a standard table.' END, CASE WHEN len(headers) > 0 THEN 'It contains columns for: ' || array_to_string(headers, ', ') || '.' END,
  CASE WHEN has_subtotals THEN 'The table contains subtotal rows for intermediate sums.' END, CASE WHEN has_totals THEN 'The table contains overall totals or summary rows.' END,
  CASE WHEN len(names) > 0 THEN 'Row items include: ' || array_to_string(names, ', ') || '.' END, CASE WHEN insights <> '' THEN 'Key insights: ' || insights END) AS interpretation FROM k""",
    "render_cells": f"""WITH {_ROWS}, u AS (SELECT table_id, r, unnest([0, 1, 2, 3]) AS col, c FROM rs), b AS (SELECT table_id, max(col) FILTER (NOT (r % 3 = 1 AND col = 3)) AS m FROM u GROUP BY table_id)
SELECT table_id, r AS "row", col, CASE WHEN r % 3 = 1 AND col = 3 THEN '' ELSE c[col + 1] END AS text, CASE WHEN r = 0 THEN 'header' ELSE 'data' END AS cell_type, r = 0 AS bold, 1 AS row_span, 1 AS col_span FROM u JOIN b USING (table_id) WHERE col <= m""",
    "table_sections": f"""WITH {_ROWS}, l AS (SELECT table_id, r, n_rows, array_to_string(c, ' | ') AS l FROM rs)
SELECT table_id, max(l) FILTER (r = 0) AS headers, max(n_rows) AS n_rows, 4 AS n_cols, coalesce(string_agg(l, chr(10) ORDER BY r) FILTER (r > 0), '') AS rows FROM l GROUP BY table_id""",
    "picture_facts": f"""WITH {_ST}, {_TITLES}, e AS (SELECT * REPLACE (CASE WHEN slide_number % 4 = 2 THEN NULL ELSE text END AS text) FROM st), t AS (SELECT *, {_TRIM("coalesce(text, '')")} AS t FROM e),
v AS (SELECT {_PAGE}, ord, text, i, v FROM t, (SELECT unnest(range(10)) AS i, unnest([{', '.join(repr(a) for a in wording.ACTIONS)}]) AS v) WHERE t <> '' AND contains(lower(t), v)),
a AS (SELECT {_PAGE}, string_agg(text, '; ' ORDER BY ord, i) AS actions FROM v GROUP BY {_PAGE}),
k AS (SELECT {_PAGE}, list(t ORDER BY ord) FILTER (t <> '' AND element_type <> 'image') AS told, count(*) FILTER (element_type = 'image') AS images, count(*) FILTER (element_type IN ('shape', 'text_box', 'placeholder', 'freeform', 'image')) AS visuals FROM t GROUP BY {_PAGE})
SELECT {_PAGE}, CASE WHEN slide_number % 7 = 0 THEN 'flowchart' WHEN slide_number % 3 = 0 THEN 'diagram' WHEN images > 0 THEN 'image_based_slide' ELSE 'content_slide' END AS image_type,
  CASE WHEN told IS NOT NULL THEN 'Slide ''' || coalesce(title, 'Untitled Slide') || ''': ' || array_to_string(told[1:4], '; ') ELSE 'Slide titled ''' || coalesce(title, 'Untitled Slide') || ''' contains ' || images || ' image(s) and ' || visuals || ' visual element(s).' END AS scene,
  coalesce(actions, '') AS actions FROM k JOIN ti USING ({_PAGE}) LEFT JOIN a USING ({_PAGE})""",
    "plain_flow": f"""WITH {_ST}, {_TITLES}, lb AS (SELECT *, {_LABEL} AS label FROM st),
r AS (SELECT {_PAGE}, arg_min(label, ord) AS a, arg_max(label, ord) AS z, count(*) AS n FROM lb WHERE slide_number % 3 = 1 AND element_type = 'text_box' AND (slide_number % 2 = 0 OR element_id % 61 = 5) AND NOT starts_with(label, '[') GROUP BY {_PAGE}),
s AS (SELECT {_PAGE}, bool_or(regexp_matches(lower(label), 'abstraction|agent|decision|state|temporal')) AS ab FROM lb GROUP BY {_PAGE})
SELECT {_PAGE}, CASE WHEN slide_number % 5 = 0 THEN 'The slide shows sales grow.' WHEN n >= 2 THEN 'The slide shows a progression from ' || a || ' → ' || z WHEN n = 1 THEN 'The slide focuses on ' || a || '.'
  WHEN ab THEN 'The slide shows a transformation from low-level environment representation → high-level reasoning' WHEN slide_number % 4 = 0 THEN 'It means more.' ELSE 'The slide presents and explains ' || coalesce(title, 'the slide content') || '.' END AS flow,
  CASE WHEN slide_number % 6 = 0 THEN 'chronological/process flow showing step-by-step progress' WHEN slide_number % 2 = 0 THEN 'comparison/contrast layout between left and right sections' ELSE 'hierarchical presentation of title and supporting details' END AS story
FROM ti LEFT JOIN r USING ({_PAGE}) LEFT JOIN s USING ({_PAGE})""",
    "concept_layers": f"""WITH {_ST}, {_TITLES}, t AS (SELECT {_PAGE}, element_id, {_TRIM("coalesce(text, '')")} AS t, coalesce(title, '') AS title FROM st LEFT JOIN ti USING ({_PAGE})),
l AS (SELECT *, CASE WHEN contains(t, chr(10)) THEN {_TRIM("string_split(t, chr(10))[1]")} || ': ' || replace({_TRIM("substr(t, position(chr(10) IN t) + 1)")}, chr(10), ' ') WHEN length(t) < 80 AND regexp_matches(t, '^[A-Z]') THEN t || ': Key concept illustrated on this slide.' END AS layer FROM t WHERE t <> '' AND t <> title)
SELECT {_PAGE}, element_id, layer FROM l WHERE layer IS NOT NULL""",
    "chart_answers": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 5 THEN 'unknown_chart' WHEN o_orderkey % 2 = 0 THEN 'bar' ELSE 'pie' END AS chart_type, CASE WHEN o_orderkey % 7 <> 5 THEN o_orderpriority END AS title, CASE WHEN o_orderkey % 7 = 5 THEN '' ELSE 'a,b' END AS categories,
  CASE WHEN o_orderkey % 7 = 5 THEN '' ELSE 's' || (o_orderkey % 4) || '=1,' || (o_orderkey % 9) END AS series FROM orders""",
    "file_kinds": r"""WITH p AS (SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '/deck.PPTX?x=1' WHEN 1 THEN '/a.pdf' WHEN 2 THEN '/b.jpeg#top' ELSE '' END AS path FROM pages)
SELECT page_id, CASE page_id % 7 WHEN 3 THEN '.pptx' WHEN 4 THEN '.png' ELSE lower(regexp_extract(regexp_replace(path, '[?#].*$', ''), '(\.[A-Za-z0-9]+)$', 1)) END AS kind FROM p""",
    "fidelity_scores": """WITH o AS (SELECT o_orderkey AS key, (100 + o_orderkey % 90) / 100 > 1.2 AS wide, o_orderkey % 11 / 10 AS s, o_orderkey % 7 / 6 AS l, o_orderkey % 5 / 4 AS b FROM orders), t AS (SELECT *, CASE WHEN wide THEN s ELSE greatest(b, l) * 0.95 + s * 0.05 END AS t FROM o)
SELECT key, round_even(t, 6)::DOUBLE AS "table", CASE WHEN wide THEN s ELSE (s + l + b + 1 + t) / 5 END >= 0.8 AS passed FROM t""",
    "median_colors": """SELECT user_id AS image_id, CAST(event_id % 16 * 2 // 16 AS INT) AS cell_x, CAST(event_id // 16 % 9 * 2 // 9 AS INT) AS cell_y, median(event_id * 31 % 256) AS r, median(event_id * 17 % 256) AS g, median(event_id % 256) AS b FROM events GROUP BY ALL""",
    "titles_before": f"""WITH {_ST}, {_TITLES} SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY slide_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS title_before FROM ti""",
}
