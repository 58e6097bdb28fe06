"""Queries of the form page and its tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import formpage
from quire.plans.table_queries import _ROWS, cells_from_orders
from quire.sources.elements import ELEMENTS_SQL, PAGE, STYLED_SQL, styled_elements

_PAGE = "document_id, slide_number"


def _pages(spark, sf_dir):
    """A third of the pages have a size in points, a third in EMU, the others what their elements reach; some are turned."""
    e = styled_elements(spark, sf_dir).groupBy(*PAGE).agg(F.max(F.expr("x + width")).alias("reach_x"), F.max(F.expr("y + height")).alias("reach_y"))
    return e.selectExpr(
        "*", "if(slide_number % 3 = 0, 612D, null) as rect_width", "if(slide_number % 3 = 0, 792D, null) as rect_height", "if(slide_number % 3 = 1, 12192000D, null) as slide_width",
        "if(slide_number % 3 = 1, 6858000D, null) as slide_height", "if(slide_number % 5 = 0, 90D, null) as rotation",
    )


def page_geometry(spark, sf_dir):
    return formpage.page_geometry(_pages(spark, sf_dir))


def _form(spark, sf_dir):
    e = styled_elements(spark, sf_dir).withColumn("text", F.expr("case ord % 19 when 3 then '[ ]' when 5 then ' [x] ' when 7 then 'Sign here please' when 9 then 'Authorized signature' else text end"))
    e = e.withColumn("height", F.expr("if(ord % 9 = 2, 20000D, height)")).withColumn("width", F.expr("if(ord % 9 = 5, 20000D, width)"))
    return formpage.form_elements(e, formpage.page_geometry(_pages(spark, sf_dir)))


def form_elements(spark, sf_dir):
    return _form(spark, sf_dir)


def form_signatures(spark, sf_dir):
    return formpage.signature_boxes(_form(spark, sf_dir))


def _tables(spark, sf_dir):
    cells = cells_from_orders(spark, sf_dir)
    size = cells.groupBy("table_id").agg((F.max("row") + 1).alias("n_rows"), F.lit(4).alias("n_cols"))
    tables = size.selectExpr(
        "table_id", "cast(table_id % 300 as double) as x", "cast(table_id % 200 as double) as y", "960D as width", "n_rows * 24.5D as height", "n_rows", "n_cols", "cast(null as array<double>) as row_heights",
        "if(table_id % 4 = 0, array(100D, 200D, 300D, 360D), null) as column_widths",
    )
    found = size.selectExpr("table_id", "n_rows", """inline(array(
      named_struct('bucket', 0, 'ord', 0, 'row', 0, 'col', 0, 'row_span', 1, 'col_span', if(table_id % 5 = 0, 2, 1)), named_struct('bucket', 1, 'ord', 0, 'row', 0, 'col', 0, 'row_span', 1, 'col_span', 4),
      named_struct('bucket', 1, 'ord', 1, 'row', 1, 'col', 1, 'row_span', 2, 'col_span', 2)))""")
    return tables, cells, formpage.first_merges(found.where("row + row_span <= n_rows"))


def first_merges(spark, sf_dir):
    return _tables(spark, sf_dir)[2]


def cell_geometry(spark, sf_dir):
    return formpage.cell_geometry(*_tables(spark, sf_dir))


def _bordered(spark, sf_dir):
    tables, cells, merges = _tables(spark, sf_dir)
    made = formpage.cell_geometry(tables, cells, merges)
    top = "if(table_id % 6 = 0 and col = 0, named_struct('width', 2D, 'color', '#ff0000'), null) as border_top"
    left = "if(table_id % 6 = 0 and row = 0, named_struct('width', cast(null as double), 'color', cast(null as string)), null) as border_left"
    return tables, made.selectExpr("*", top, left)


def grid_lines(spark, sf_dir):
    return formpage.grid_lines(*_bordered(spark, sf_dir))


def table_report(spark, sf_dir):
    tables, cells, merges = _tables(spark, sf_dir)
    return formpage.table_report(tables, formpage.cell_geometry(tables, cells, merges))


def header_semantics(spark, sf_dir):
    return formpage.header_semantics(cells_from_orders(spark, sf_dir))


QUERIES = {f.__name__: f for f in (page_geometry, form_elements, form_signatures, first_merges, cell_geometry, grid_lines, table_report, header_semantics)}

_GEO = f"""pg AS (SELECT {_PAGE}, CASE slide_number % 3 WHEN 0 THEN 816.0 WHEN 1 THEN 1280.0 ELSE round_even(max(x + width), 3) END::DOUBLE AS page_width,
  CASE slide_number % 3 WHEN 0 THEN 1056.0 WHEN 1 THEN 720.0 ELSE round_even(max(y + height), 3) END::DOUBLE AS page_height,
  CASE slide_number % 3 WHEN 0 THEN 96.0::DOUBLE / 72 WHEN 1 THEN 1.0::DOUBLE / 9525 ELSE 1.0::DOUBLE END AS scale, CASE WHEN slide_number % 5 = 0 THEN 90.0 ELSE 0.0 END::DOUBLE AS rotation FROM st GROUP BY {_PAGE})"""
#: Half to even on the shortest decimal form of a number.
_FIVE = lambda v: f"CAST(round_even(CAST(CAST({v} AS VARCHAR) AS DECIMAL(30, 20)), 5) AS DOUBLE)"
_THREE = lambda v: f"CAST(round_even(CAST(CAST({v} AS VARCHAR) AS DECIMAL(38, 20)), 3) AS DOUBLE)"
_TRIM = lambda c: rf"regexp_replace({c}, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')"


def _repaired(c: str) -> str:
    """The texts of the form hold one that is mostly figures; the others stay as they are."""
    from quire.operators import ocr

    letters, digits = "".join(ocr.SUBSTITUTES), "".join(v * len(k) for k, v in ocr.SUBSTITUTES.items())
    t = _TRIM(c)
    known, unsure = rf"length(regexp_replace({t}, '[^0-9$€£¥%.,+\-/* ]', '', 'g'))", f"length(regexp_replace({t}, '[^{letters}]', '', 'g'))"
    beside = lambda i: f"regexp_matches(coalesce(string_split({t}, '')[{i}], ''), '^[0-9.,$%]$')"
    one = f"CASE WHEN (length({t}) <= 5 AND {known} + {unsure} = length({t})) OR {beside('i - 1')} OR {beside('i + 1')} THEN translate(x, '{letters}', '{digits}') ELSE x END"
    return f"CASE WHEN {known} + 2 * {unsure} > length({t}) THEN array_to_string(list_transform(string_split({t}, ''), lambda x, i: {one}), '') ELSE {c} END"


_FORM = f"""{ELEMENTS_SQL}, {STYLED_SQL}, {_GEO}, fe AS (SELECT * REPLACE (CASE ord % 19 WHEN 3 THEN '[ ]' WHEN 5 THEN ' [x] ' WHEN 7 THEN 'Sign here please' WHEN 9 THEN 'Authorized signature' ELSE text END AS text,
  CASE WHEN ord % 9 = 2 THEN 20000.0 ELSE height END::DOUBLE AS height, CASE WHEN ord % 9 = 5 THEN 20000.0 ELSE width END::DOUBLE AS width) FROM st),
fs AS (SELECT fe.*, page_width, page_height, CAST(row_number() OVER (PARTITION BY {_PAGE} ORDER BY z_order, y, x, ord) - 1 AS INT) AS reading_order, {_THREE('greatest(0, x * scale)')} AS px, {_THREE('greatest(0, y * scale)')} AS py,
  {_THREE('greatest(0, width * scale)')} AS w, {_THREE('greatest(0, height * scale)')} AS h FROM fe JOIN pg USING ({_PAGE})),
fl AS (SELECT * REPLACE ({_repaired('text')} AS text), element_type = 'shape' AND w > 0 AND h > 0 AND h <= greatest(3.0, w * 0.08) AS flat FROM fs),
ft AS (SELECT *, element_type = 'shape' AND w > 0 AND h > 0 AND NOT flat AND w <= greatest(3.0, h * 0.08) AS tall, CASE WHEN element_type IN ('text_box', 'text') AND trim(text) IN ('[ ]', '[]', '☐') THEN false
  WHEN element_type IN ('text_box', 'text') AND trim(text) IN ('[x]', '[X]', '☑', '☒') THEN true END AS checked FROM fl),
fm AS (SELECT *, CASE WHEN flat OR tall THEN 'line' WHEN checked IS NOT NULL THEN 'checkbox' ELSE element_type END AS type, w * h / (page_width * page_height) AS share FROM ft),
form AS (SELECT {_PAGE}, element_id, type, reading_order, CAST(z_order AS BIGINT) AS z_order, px AS x, py AS y, w AS width, h AS height, text, checked, CAST(NULL AS BOOLEAN) AS filled,
  CASE WHEN tall THEN {_THREE('px + w / 2')} WHEN flat THEN px END AS x1, CASE WHEN flat THEN {_THREE('py + h / 2')} WHEN tall THEN py END AS y1, CASE WHEN tall THEN {_THREE('px + w / 2')} WHEN flat THEN {_THREE('px + w')} END AS x2,
  CASE WHEN flat THEN {_THREE('py + h / 2')} WHEN tall THEN {_THREE('py + h')} END AS y2, CASE WHEN flat THEN greatest(1.0, h) WHEN tall THEN greatest(1.0, w) END AS stroke_width,
  CASE WHEN type = 'image' THEN 'Images' WHEN type = 'table' THEN 'Tables' WHEN type IN ('line', 'connector') THEN 'Lines' WHEN type IN ('text_box', 'text') THEN 'Text' WHEN type = 'shape' AND w < 48 AND h < 48 THEN 'Icons'
    WHEN type IN ('shape', 'rectangle', 'group') AND share > 0.8 THEN 'Background' WHEN type IN ('shape', 'rectangle', 'group') AND share > 0.25 THEN 'Large panels' ELSE 'Shapes' END AS layer,
  {_FIVE('px / page_width')} AS x_share, {_FIVE('py / page_height')} AS y_share, {_FIVE('w / page_width')} AS width_share, {_FIVE('h / page_height')} AS height_share FROM fm)"""
_MERGES = f"""{_ROWS}, sz AS (SELECT table_id, CAST(max(r) + 1 AS INT) AS n_rows FROM rs GROUP BY table_id),
mg AS (SELECT table_id, 0 AS "row", 0 AS col, 1 AS row_span, CASE WHEN table_id % 5 = 0 THEN 2 ELSE 1 END AS col_span FROM sz UNION ALL SELECT table_id, 1, 1, 2, 2 FROM sz WHERE n_rows >= 3),
tb AS (SELECT table_id, CAST(table_id % 300 AS DOUBLE) AS x, CAST(table_id % 200 AS DOUBLE) AS y, 960.0::DOUBLE AS width, n_rows * 24.5::DOUBLE AS height, n_rows,
  CASE WHEN table_id % 4 = 0 THEN [100.0::DOUBLE, 200.0, 300.0, 360.0] ELSE [240.0::DOUBLE, 240.0, 240.0, 240.0] END AS ws, round_even(n_rows * 24.5::DOUBLE / n_rows, 3) AS h FROM sz),
sl AS (SELECT table_id, r AS "row", u - 1 AS col, c[u] AS text FROM rs, (SELECT unnest([1, 2, 3, 4]) AS u)),
cg AS (SELECT s.table_id, s."row", CAST(s.col AS INT) AS col, coalesce(m.row_span, 1) AS row_span, coalesce(m.col_span, 1) AS col_span, round_even(t.x + coalesce(list_sum(ws[1:s.col]), 0), 3) AS x, round_even(t.y + s."row" * h, 3) AS y,
  round_even(list_sum(ws[s.col + 1:s.col + coalesce(m.col_span, 1)]), 3) AS width, round_even(h * coalesce(m.row_span, 1), 3) AS height, {_repaired('s.text')} AS text
  FROM sl s JOIN tb t ON s.table_id = t.table_id LEFT JOIN mg m ON m.table_id = s.table_id AND m."row" = s."row" AND m.col = s.col
  WHERE NOT EXISTS (SELECT 1 FROM mg k WHERE k.table_id = s.table_id AND s."row" BETWEEN k."row" AND k."row" + k.row_span - 1 AND s.col BETWEEN k.col AND k.col + k.col_span - 1 AND (s."row" <> k."row" OR s.col <> k.col)))"""

ORACLES = {
    "page_geometry": f"""WITH {ELEMENTS_SQL}, {STYLED_SQL}, {_GEO} SELECT *, CASE WHEN abs(page_width - page_height) < 0.01 THEN 'square' WHEN page_width > page_height THEN 'landscape' ELSE 'portrait' END AS orientation, round_even(72.0 * scale, 2) AS dpi FROM pg""",
    "form_elements": f"WITH {_FORM} SELECT * FROM form",
    "form_signatures": f"""WITH {_FORM} SELECT {_PAGE}, 'sig_field_' || slide_number || '_' || element_id AS field_id, x, greatest(0.0, y - 30) AS y, greatest(120.0, width) AS width, 25.0::DOUBLE AS height, z_order + 1 AS z_order, 0.9::DOUBLE AS confidence
  FROM form WHERE type IN ('text_box', 'text') AND regexp_matches(lower(coalesce(text, '')), '{"|".join(formpage.SIGNATURE_WORDS)}')""",
    "first_merges": f'WITH {_MERGES} SELECT table_id, "row", col, row_span, col_span FROM mg',
    "cell_geometry": f"WITH {_MERGES} SELECT * FROM cg",
    "grid_lines": f"""WITH {_MERGES}, ed AS (SELECT DISTINCT table_id, unnest([('v', round_even(x, 3)), ('v', round_even(x + width, 3)), ('h', round_even(y, 3)), ('h', round_even(y + height, 3))]) AS l FROM cg WHERE table_id % 6 <> 0)
SELECT table_id, CASE WHEN l[1] = 'v' THEN l[2] ELSE x END AS x1, CASE WHEN l[1] = 'v' THEN y ELSE l[2] END AS y1, CASE WHEN l[1] = 'v' THEN l[2] ELSE x + width END AS x2, CASE WHEN l[1] = 'v' THEN y + height ELSE l[2] END AS y2,
  1.0::DOUBLE AS stroke_width, CAST(NULL AS VARCHAR) AS stroke_color FROM ed JOIN tb USING (table_id)
UNION ALL SELECT table_id, x, y, x + width, y, 2.0, '#ff0000' FROM cg WHERE table_id % 6 = 0 AND col = 0 UNION ALL SELECT table_id, x, y, x, y + height, 1.0, '#000000' FROM cg WHERE table_id % 6 = 0 AND "row" = 0""",
    "table_report": f"""WITH {_MERGES} SELECT table_id, CAST(first(n_rows) * 4 AS BIGINT) AS slots, CAST(sum(row_span * col_span) AS BIGINT) AS spanned, sum(row_span * col_span) = first(n_rows) * 4 AS complete, count(*) AS cells,
  count(*) FILTER (trim(text) = '') AS empty, count(*) FILTER (row_span > 1 OR col_span > 1) AS merged FROM cg JOIN sz USING (table_id) GROUP BY table_id""",
    "header_semantics": f"""WITH {_MERGES} SELECT table_id, string_agg(text, ' | ' ORDER BY col) FILTER ("row" = 0) AS header, coalesce(string_agg(text, ' | ' ORDER BY col) FILTER ("row" = 1), '') AS sub_header,
  count(DISTINCT col) AS columns, count(DISTINCT "row") AS rows FROM sl GROUP BY table_id""",
}
