"""Queries of the detector of drawn tables and charts, with the same in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import detector, layout
from quire.sources.elements import ELEMENTS_SQL, PAGE, STYLED_SQL, elements_from_events, styled_elements

_PAGE = "document_id, slide_number"


def _texts(spark, sf_dir):
    """The events' elements at a fifth of their height, so that rows and gaps between tables occur."""
    return elements_from_events(spark, sf_dir).withColumn("height", F.expr("height / 5")).withColumn("y", F.expr("y * 3"))


def visual_rows(spark, sf_dir):
    return detector.text_rows(_texts(spark, sf_dir)).select(*PAGE, "element_id", "row_no", "table_no")


def visual_tables(spark, sf_dir):
    return detector.visual_tables(_texts(spark, sf_dir))


def visual_grid(spark, sf_dir):
    return detector.grid_texts(detector.grid_cells(_texts(spark, sf_dir)))


def visual_merges(spark, sf_dir):
    return detector.grid_merges(detector.grid_cells(_texts(spark, sf_dir)))


def refined_lines(spark, sf_dir):
    e = elements_from_events(spark, sf_dir)
    return detector.refined_lines(layout.coordinate_clusters(e), e.select(*PAGE, F.explode(F.array("x", F.expr("x + width"))).alias("v")))


def chart_regions(spark, sf_dir):
    e = styled_elements(spark, sf_dir).withColumn("width", F.expr("width / 4")).withColumn("height", F.expr("height / 4"))
    return detector.chart_regions(e)


QUERIES = {f.__name__: f for f in (visual_rows, visual_tables, visual_grid, visual_merges, refined_lines, chart_regions)}

_OVER = f"(PARTITION BY {_PAGE} ORDER BY y, ord)"
_VIS = rf"""{ELEMENTS_SQL}, tx AS (SELECT * REPLACE (height / 5 AS height, y * 3 AS y) FROM el WHERE element_type = 'text_box' AND trim(text) <> '' QUALIFY count(*) OVER (PARTITION BY {_PAGE}) >= 3),
tb AS (SELECT *, lag(y + height / 2) OVER {_OVER} AS b FROM tx),
tr AS (SELECT *, sum(CASE WHEN b IS NULL OR abs(y + height / 2 - b) > 150000 THEN 1 ELSE 0 END) OVER (PARTITION BY {_PAGE} ORDER BY y, ord ROWS UNBOUNDED PRECEDING) AS row_no FROM tb),
ra AS (SELECT {_PAGE}, row_no, min(y) AS top, max(y + height) AS bottom FROM tr GROUP BY {_PAGE}, row_no QUALIFY count(*) OVER (PARTITION BY {_PAGE}) >= 2),
rb AS (SELECT *, lag(bottom) OVER (PARTITION BY {_PAGE} ORDER BY row_no) AS b FROM ra),
rt AS (SELECT {_PAGE}, row_no, sum(CASE WHEN b IS NULL OR top - b > 600000 THEN 1 ELSE 0 END) OVER (PARTITION BY {_PAGE} ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS table_no FROM rb),
vt AS (SELECT tr.*, table_no FROM tr JOIN rt USING ({_PAGE}, row_no))"""
_SPLIT = lambda k, at, size, gap, keys, rows: (
    f"b{k} AS (SELECT *, lag({at} + {size}) OVER (PARTITION BY {keys} ORDER BY {at}, ord) AS b{k} FROM {rows}), "
    f"s{k} AS (SELECT *, sum(CASE WHEN b{k} IS NULL OR {at} - b{k} > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY {at}, ord ROWS UNBOUNDED PRECEDING) AS split_{k} FROM b{k})"
)

ORACLES = {
    "visual_rows": f"WITH {_VIS} SELECT {_PAGE}, element_id, CAST(row_no AS BIGINT) AS row_no, CAST(table_no AS BIGINT) AS table_no FROM vt",
    "visual_tables": rf"""WITH {_VIS}, w AS (SELECT *, count(*) OVER (PARTITION BY {_PAGE}, table_no, row_no) AS in_row, [x FOR x IN regexp_split_to_array(text, '\s+') IF x <> ''] AS w FROM vt),
a AS (SELECT {_PAGE}, table_no, count(DISTINCT row_no) AS n_rows, count(*) AS n_cells, max(in_row) AS widest, sum(len(w)) AS words,
  sum(len([x FOR x IN w IF contains(x, '%') OR (regexp_matches(replace(x, '.', ''), '^[0-9]+$') AND length(x) <= 3)])) AS figures, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height
  FROM w GROUP BY {_PAGE}, table_no)
SELECT {_PAGE}, CAST(table_no AS BIGINT) AS table_no, n_rows, n_cells, x, y, width, height FROM a WHERE n_rows >= 2 AND widest > 1 AND n_cells >= 4 AND NOT (figures / words > 0.7 AND n_cells < 12)""",
    "refined_lines": f"""WITH {ELEMENTS_SQL}, e AS (SELECT {_PAGE}, unnest([x, x + width]) AS v FROM el), d AS (SELECT DISTINCT * FROM e), b AS (SELECT *, lag(v) OVER (PARTITION BY {_PAGE} ORDER BY v) AS b FROM d),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR v - b > 80000 THEN 1 ELSE 0 END) OVER (PARTITION BY {_PAGE} ORDER BY v ROWS UNBOUNDED PRECEDING) AS k FROM b),
c AS (SELECT {_PAGE}, k, round_even(avg(v), 3) AS position FROM i GROUP BY {_PAGE}, k),
m AS (SELECT c.document_id, c.slide_number, c.k, avg(e.v) AS m FROM c JOIN e ON c.document_id = e.document_id AND c.slide_number = e.slide_number AND abs(e.v - position) < 150000 GROUP BY ALL)
SELECT DISTINCT {_PAGE}, round_even(coalesce(m, position), 3) AS position FROM c LEFT JOIN m USING ({_PAGE}, k)""",
    "chart_regions": rf"""WITH {ELEMENTS_SQL}, {STYLED_SQL}, r0 AS (SELECT * REPLACE (coalesce(text, '') AS text, width / 4 AS width, height / 4 AS height) FROM st WHERE element_type IN ('image', 'chart') OR (element_type = 'text_box' AND coalesce(text, '') <> '')),
{_SPLIT(1, 'y', 'height', 400000, _PAGE, 'r0')}, {_SPLIT(2, 'x', 'width', 500000, _PAGE + ', split_1', 's1')}, {_SPLIT(3, 'y', 'height', 150000, _PAGE + ', split_1, split_2', 's2')},
a AS (SELECT {_PAGE}, split_1, split_2, split_3, lower(coalesce(string_agg(text, ' ' ORDER BY y, ord, text) FILTER (text <> ''), '')) AS text, bool_or(element_type IN ('image', 'chart')) AS p, count(*) AS members, min(x) AS x0, min(y) AS y0,
  max(x + width) AS x1, max(y + height) AS y1 FROM s3 GROUP BY {_PAGE}, split_1, split_2, split_3),
k AS (SELECT *, length(regexp_replace(text, '[^0-9]', '', 'g')) AS d, contains(text, '%') AS pc, len([x FOR x IN regexp_split_to_array(text, '\s+') IF x <> '']) AS w, CASE WHEN x1 - x0 < 2000000 THEN 60000 ELSE 30000 END AS pad FROM a)
SELECT {_PAGE}, CAST(split_1 AS BIGINT) AS split_1, CAST(split_2 AS BIGINT) AS split_2, CAST(split_3 AS BIGINT) AS split_3, members, text,
  CASE WHEN regexp_matches(text, 'bar|%') THEN 'bar_chart' WHEN regexp_matches(text, 'line|trend') THEN 'line_chart' WHEN regexp_matches(text, 'pie|share') THEN 'pie_chart' WHEN regexp_matches(text, 'box|whisker') THEN 'box_plot' ELSE 'chart' END AS chart_type,
  greatest(0, x0 - pad) AS x, greatest(0, y0 - pad) AS y, x1 - x0 + 2 * pad AS width, y1 - y0 + 2 * pad AS height FROM k
WHERE (d >= 2 OR pc OR p) AND (w >= 3 OR p) AND NOT regexp_matches(text, '{"|".join(detector.NO_CHART)}') AND (pc OR p OR d >= 3 OR regexp_matches(text, '{"|".join(detector.CHART_WORDS)}'))""",
}

_TABLE = f"{_PAGE}, table_no"


def _grid(c: str, size: str) -> str:
    """The grid lines of a table: its spans' edges in clusters, as the list g{c}."""
    return f"""e{c} AS (SELECT DISTINCT {_TABLE}, unnest([{c}, {c} + {size}]) AS v FROM sp), q{c} AS (SELECT *, lag(v) OVER (PARTITION BY {_TABLE} ORDER BY v) AS b FROM e{c}),
k{c} AS (SELECT *, sum(CASE WHEN b IS NULL OR v - b > 80000 THEN 1 ELSE 0 END) OVER (PARTITION BY {_TABLE} ORDER BY v ROWS UNBOUNDED PRECEDING) AS k FROM q{c}),
g{c} AS (SELECT {_TABLE}, list(v ORDER BY v) AS g{c} FROM (SELECT {_TABLE}, k, avg(v) AS v FROM k{c} GROUP BY {_TABLE}, k) GROUP BY {_TABLE})"""


def _slot(g: str, c: str) -> str:
    return f"""coalesce(nullif(list_position([{g}[i] <= {c} AND {c} <= {g}[i + 1] FOR i IN range(1, len({g}))], true), 0) - 1,
  list_min([{{'d': abs({c} - ({g}[i] + {g}[i + 1]) / 2), 'i': i - 1}} FOR i IN range(1, len({g}))]).i)"""


_STRIP = rf"regexp_replace(text, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')"
_SPAN = "{{'i': {p}i, 'x': {p}x, 'y': {p}y, 'w': {p}w, 'h': {p}h, 't': {p}t}}"
_CELLS = f"""{_VIS}, vk AS (SELECT {_TABLE} FROM ({ORACLES["visual_tables"]})),
sl AS (SELECT {_TABLE}, list({{'i': element_id, 'x': x, 'y': y, 'w': width, 'h': height, 't': text, 'd': list_value({_SPAN.format(p="").replace(": i", ": element_id").replace(": w", ": width").replace(": h", ": height").replace(": t}", ": text}")})[2:]}} ORDER BY y, x, ord) AS l
  FROM vt JOIN vk USING ({_TABLE}) GROUP BY {_TABLE}),
sf AS (SELECT {_TABLE}, list_reduce(l, lambda a, b: CASE WHEN abs(b.y - a.y) < 20000 AND b.x - (a.x + a.w) < 40000 THEN {{'i': a.i, 'x': a.x, 'y': a.y, 'w': b.x + b.w - a.x, 'h': a.h, 't': a.t || b.t, 'd': a.d}}
  ELSE {{'i': b.i, 'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h, 't': b.t, 'd': list_append(a.d, {_SPAN.format(p="a.")})}} END) AS r FROM sl),
su AS (SELECT {_TABLE}, unnest(list_append(r.d, {_SPAN.format(p="r.")})) AS s FROM sf), sp AS (SELECT {_TABLE}, s.i AS first_id, s.x AS x, s.y AS y, s.w AS w, s.h AS h, s.t AS text FROM su),
{_grid("x", "w")}, {_grid("y", "h")},
gc AS (SELECT sp.*, x + w / 2 AS cx, y + h / 2 AS cy, gx, gy FROM sp JOIN gx USING ({_TABLE}) JOIN gy USING ({_TABLE}) WHERE len(gx) > 1 AND len(gy) > 1),
cl AS (SELECT *, {_slot("gy", "cy")} AS "row", {_slot("gx", "cx")} AS col, {_STRIP} AS t FROM gc)"""
_FIRST = lambda g, at, size: f"CASE WHEN {g}[1] <= {at} + 50000 THEN nullif(list_position([{g}[i + 1] >= {at} + {size} - 50000 FOR i IN range(1, len({g}))], true), 0) - 1 END"
_LAST = lambda g, at, end: f"list_max([i FOR i IN range(0, {end} + 1) IF {g}[i + 1] <= {at} + 50000])"
_FREE = "len(list_filter(z.l, lambda q: m.rs BETWEEN q.r AND q.r + q.h - 1 AND m.cs BETWEEN q.c AND q.c + q.w - 1)) = 0"
_MERGE = "{'r': m.rs, 'c': m.cs, 'h': m.re - m.rs + 1, 'w': m.ce - m.cs + 1}"

ORACLES["visual_grid"] = f"""WITH {_CELLS} SELECT {_PAGE}, CAST(table_no AS BIGINT) AS table_no, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, string_agg(t, chr(10) ORDER BY y, x, first_id, t) AS text,
  CAST(any_value(len(gy)) - 1 AS INT) AS n_rows, CAST(any_value(len(gx)) - 1 AS INT) AS n_cols FROM cl GROUP BY {_TABLE}, "row", col"""
ORACLES["visual_merges"] = f"""WITH RECURSIVE {_CELLS}, m0 AS (SELECT *, {_FIRST("gy", "y", "h")} AS re, {_FIRST("gx", "x", "w")} AS ce FROM cl),
m1 AS (SELECT *, {_LAST("gy", "y", "re")} AS rs, {_LAST("gx", "x", "ce")} AS cs FROM m0 WHERE re IS NOT NULL AND ce IS NOT NULL),
m2 AS (SELECT *, row_number() OVER (PARTITION BY {_TABLE} ORDER BY y, x, first_id) AS k FROM m1 WHERE re > rs OR ce > cs),
z(document_id, slide_number, table_no, k, l) AS (SELECT {_TABLE}, k, [{_MERGE}] FROM m2 m WHERE k = 1 UNION ALL
  SELECT m.document_id, m.slide_number, m.table_no, m.k, CASE WHEN {_FREE} THEN list_append(z.l, {_MERGE}) ELSE z.l END FROM z JOIN m2 m ON m.document_id = z.document_id AND m.slide_number = z.slide_number AND m.table_no = z.table_no AND m.k = z.k + 1),
u AS (SELECT {_TABLE}, unnest(arg_max(l, k)) AS s FROM z GROUP BY {_TABLE})
SELECT {_PAGE}, CAST(table_no AS BIGINT) AS table_no, CAST(s.r AS INT) AS "row", CAST(s.c AS INT) AS col, CAST(s.h AS INT) AS row_span, CAST(s.w AS INT) AS col_span FROM u"""
