"""Queries over text, tables, charts and graphs, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import content, spatial
from quire.sources.elements import ELEMENTS_SQL, elements_from_events


def read(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(spark, sf_dir):
    return content.text_lines(read(spark, sf_dir, "documents"))


def garbled_lines(spark, sf_dir):
    lines = content.text_lines(read(spark, sf_dir, "documents"))
    return lines.withColumn("garbled", content.garbled(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("garbled").alias("garbled_lines"))


def keywords(spark, sf_dir):
    return content.keywords(read(spark, sf_dir, "documents"))


def text_similarity(spark, sf_dir):
    return content.best_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def fingerprints(spark, sf_dir):
    return content.fingerprints(read(spark, sf_dir, "documents"))


def doc_sections(spark, sf_dir):
    return content.sections(read(spark, sf_dir, "conversations"))


def nested_turns(spark, sf_dir):
    return content.last_user_turn(read(spark, sf_dir, "conversations"))


def chart_profile(spark, sf_dir):
    month = F.date_format("l_shipdate", "yyyy-MM")
    sums = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series"), month.alias("category")).agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("value"))
    return content.chart_profile(sums.withColumn("idx", F.expr("cast(replace(category, '-', '') as int)")))


def _edges(spark, sf_dir):
    e = elements_from_events(spark, sf_dir)
    return e, spatial.connector_targets(e)


def flow_degree(spark, sf_dir):
    e, edges = _edges(spark, sf_dir)
    return content.degrees(edges, spatial.boxes(e))


def flow_type(spark, sf_dir):
    return content.flow_type(_edges(spark, sf_dir)[1])


def palette(spark, sf_dir):
    e = elements_from_events(spark, sf_dir)
    return content.palette(e.select("document_id", "slide_number", F.format_string("#%06x", F.expr("cast((element_id % 40) * 409600 % 16777216 as int)")).alias("color")))


def merged_cell_grid(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    cells = o.selectExpr("o_orderkey div 24 as table_id", "cast(o_orderkey % 24 div 4 as int) as row", "cast(o_orderkey % 4 as int) as col", "cast(1 + if(o_orderkey % 7 = 0, 1, 0) as int) as row_span", "cast(1 + if(o_orderkey % 5 = 0, 1, 0) as int) as col_span").distinct()
    return content.merged_cells(cells)


def multipage_stitch(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc"), F.expr("cast(year(o_orderdate) as int)").alias("page")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("headers"))
    ragged = F.transform("headers", lambda h, i: F.when(F.col("page") % 2 == 0, F.upper(F.concat(F.lit(" "), h))).otherwise(h))
    return content.multipage_tables(o.withColumns({"ord": F.lit(0), "columns": F.size("headers"), "headers": ragged}))


QUERIES = {
    f.__name__: f
    for f in (text_lines, garbled_lines, keywords, text_similarity, fingerprints, doc_sections, nested_turns, chart_profile, flow_degree, flow_type, palette, merged_cell_grid, multipage_stitch)
}

_LINES = r"""ln AS (SELECT doc_id, p, regexp_replace(line, '^[ \t\r]+|[ \t\r]+$', '', 'g') AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents)),
lines AS (SELECT * FROM ln WHERE line <> '')"""
_PG = "a.document_id = b.document_id AND a.slide_number = b.slide_number"
_D = lambda x, y: f"sqrt((b.x + b.width / 2 - {x}) * (b.x + b.width / 2 - {x}) + (b.y + b.height / 2 - {y}) * (b.y + b.height / 2 - {y}))"
_EDGES = f"""{ELEMENTS_SQL}, bx AS (SELECT * FROM el WHERE element_type <> 'connector'), ed AS (
  SELECT document_id, slide_number, s AS source_element_id, t AS target_element_id FROM (
    SELECT a.document_id, a.slide_number, a.element_id, arg_min(b.element_id, ({_D("a.begin_x", "a.begin_y")}, b.ord)) AS s,
      arg_min(b.element_id, ({_D("a.end_x", "a.end_y")}, b.ord)) AS t FROM el a JOIN bx b ON {_PG} WHERE a.element_type = 'connector' AND a.begin_x IS NOT NULL GROUP BY 1, 2, 3) WHERE s <> t)"""
_LUM = lambda c: f"(0.299 * CAST('0x' || substr({c}, 2, 2) AS INT) + 0.587 * CAST('0x' || substr({c}, 4, 2) AS INT) + 0.114 * CAST('0x' || substr({c}, 6, 2) AS INT))"

ORACLES = {
    "text_lines": f"WITH {_LINES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) AS INT) AS line_no, line FROM lines",
    "garbled_lines": rf"""WITH {_LINES}, g AS (SELECT doc_id, CASE WHEN length(line) < 3 THEN TRUE WHEN length(regexp_replace(line, '[^A-Za-z]', '', 'g')) = 0 THEN FALSE
  ELSE coalesce(list_sum([length(r) FOR r IN regexp_extract_all(line, '[^aeiouAEIOU\s\d]{{4,}}')]), 0) / length(regexp_replace(line, '[^A-Za-z]', '', 'g')) > 0.45 END AS garbled FROM lines)
SELECT doc_id, count(*) AS lines, count(*) FILTER (garbled) AS garbled_lines FROM g GROUP BY 1""",
    "keywords": """WITH w AS (SELECT doc_id, k, p FROM (SELECT doc_id, unnest(l) AS k, generate_subscripts(l, 1) AS p FROM (
  SELECT doc_id, [lower(x) FOR x IN regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{2,}')] AS l FROM documents))),
f AS (SELECT doc_id, k, min(p) AS p FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n FROM f)
SELECT d.doc_id, coalesce(s, '') AS keywords FROM documents d LEFT JOIN (SELECT doc_id, string_agg(k, ',' ORDER BY n) AS s FROM r WHERE n <= 12 GROUP BY 1) q ON q.doc_id = d.doc_id""",
    "text_similarity": """WITH p AS (SELECT doc_id, item_id, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9_]+')) AS x, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9_]+')) AS y FROM documents d CROSS JOIN benchmark b),
s AS (SELECT doc_id, item_id, CAST(CASE WHEN greatest(len(x), len(y)) = 0 THEN 1.0 ELSE round_even(len(list_intersect(x, y)) / greatest(len(x), len(y)), 6) END AS DOUBLE) AS similarity FROM p)
SELECT doc_id, -arg_max(-item_id, (similarity, -item_id)) AS item_id, max(similarity) AS similarity FROM s GROUP BY doc_id""",
    "fingerprints": r"""SELECT doc_id, substr(sha256(text), 1, 16) AS fingerprint, CAST(len(regexp_extract_all(text, '[^ \t\r\n]+')) AS INT) AS words,
  CAST(greatest(1, len(regexp_extract_all(text, '[^ \t\r\n]+')) // 12) AS INT) AS lines FROM documents""",
    "doc_sections": """WITH l AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM l)
SELECT conv_id, section, role, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns FROM r GROUP BY 1, 2, 3""",
    "nested_turns": """SELECT conv_id, turn, parent_turn FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS parent_turn FROM conversations) WHERE role <> 'user'""",
    "chart_profile": """WITH s AS (SELECT l_returnflag AS series, strftime(l_shipdate, '%Y-%m') AS category, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, CAST(replace(category, '-', '') AS INT) AS idx, avg(value) OVER w AS mu, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY series))
SELECT series, round_even(first(mu), 2) AS mean, round_even(first(sd), 2) AS deviation, arg_max(category, (value, -idx)) AS peak, arg_min(category, (value, idx)) AS low,
  count(*) FILTER (n >= 3 AND abs(value - mu) > 2 * sd) AS anomalies,
  CASE WHEN arg_max(value, idx) > arg_min(value, idx) * 1.05 THEN 'increasing' WHEN arg_max(value, idx) < arg_min(value, idx) * 0.95 THEN 'decreasing' ELSE 'stable' END AS trend FROM p GROUP BY series""",
    "flow_degree": f"""WITH {_EDGES}, o AS (SELECT document_id, slide_number, source_element_id AS element_id, count(*) AS c FROM ed GROUP BY 1, 2, 3),
i AS (SELECT document_id, slide_number, target_element_id AS element_id, count(*) AS c FROM ed GROUP BY 1, 2, 3)
SELECT document_id, slide_number, element_id, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) AS in_degree, coalesce(i.c, 0) = 0 AND coalesce(o.c, 0) > 0 AS is_start, coalesce(o.c, 0) = 0 AND coalesce(i.c, 0) > 0 AS is_end
FROM bx LEFT JOIN o USING (document_id, slide_number, element_id) LEFT JOIN i USING (document_id, slide_number, element_id)""",
    "flow_type": f"""WITH {_EDGES}, o AS (SELECT document_id, slide_number, source_element_id, count(*) AS o FROM ed GROUP BY 1, 2, 3),
m AS (SELECT document_id, slide_number, max(o) AS most, CAST(sum(o) AS BIGINT) AS edges FROM o GROUP BY 1, 2),
n AS (SELECT document_id, slide_number, count(DISTINCT x) AS nodes FROM (SELECT document_id, slide_number, unnest([source_element_id, target_element_id]) AS x FROM ed) GROUP BY 1, 2)
SELECT document_id, slide_number, edges, nodes, CASE WHEN most > 1 THEN 'branching' WHEN edges >= nodes THEN 'cyclic' ELSE 'linear' END AS flow_type FROM m JOIN n USING (document_id, slide_number)""",
    "palette": f"""WITH {ELEMENTS_SQL}, c AS (SELECT document_id, slide_number, format('#{{:06x}}', (element_id % 40) * 409600 % 16777216) AS color FROM el),
a AS (SELECT document_id, slide_number, list_sort(list(DISTINCT color)) AS c, count(*) FILTER ({_LUM("color")} < 127.5) AS d, count(*) AS n FROM c GROUP BY 1, 2)
SELECT document_id, slide_number, array_to_string(c, ',') AS colors, CASE WHEN d > n / 2 THEN 'dark' ELSE 'light' END AS theme, CASE WHEN {_LUM("c[1]")} < 130 THEN '#ffffff' ELSE '#000000' END AS contrast FROM a""",
    "merged_cell_grid": """WITH c AS (SELECT DISTINCT o_orderkey // 24 AS table_id, CAST(o_orderkey % 24 // 4 AS INT) AS "row", CAST(o_orderkey % 4 AS INT) AS col,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS INT) AS row_span, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS INT) AS col_span FROM orders)
SELECT table_id, "row", col, row_span, col_span FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.table_id = c.table_id AND (o."row" <> c."row" OR o.col <> c.col)
  AND c."row" BETWEEN o."row" AND o."row" + o.row_span - 1 AND c.col BETWEEN o.col AND o.col + o.col_span - 1)""",
    "multipage_stitch": """WITH t AS (SELECT o_custkey AS doc, CAST(year(o_orderdate) AS INT) AS page, list_sort(list(DISTINCT o_orderpriority)) AS headers FROM orders GROUP BY 1, 2),
n AS (SELECT *, lead(page) OVER w AS next_page, lead(headers) OVER w AS nh FROM t WINDOW w AS (PARTITION BY doc ORDER BY page))
SELECT doc, page, next_page FROM n WHERE next_page = page + 1 AND len(headers) = len(nh) AND len(list_intersect(nh, headers)) / len(nh) > 0.8""",
}
