"""Queries over tables made of orders, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import tables
from quire.sources import sinks
from quire.sources.elements import ELEMENTS_SQL, elements_from_events


def cells_from_orders(spark, sf_dir: str):
    """A table per customer, a row per order in key order, four columns; some slots are blank by integer arithmetic."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey is not null")
    # the rows are numbered before the slots are made: a generator beside a window runs first
    o = o.withColumn("row", F.expr("cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int)"))
    return o.selectExpr(
        "o_custkey as table_id", "row",
        """posexplode(array(if(o_orderkey % 3 = 0, '', o_orderpriority), if(o_orderkey % 4 < 2, '', o_orderstatus),
          if(o_orderkey % 5 < 3, '', cast(o_orderkey as string)), if(o_orderkey % 11 = 0, 'Total', if(o_orderkey % 13 = 0, 'Subtotal cost', '')))) as (col, text)""",
    )


def table_profile(spark, sf_dir):
    return tables.table_profile(cells_from_orders(spark, sf_dir))


def section_rows(spark, sf_dir):
    return tables.section_headers(cells_from_orders(spark, sf_dir))


def connector_relations(spark, sf_dir):
    """Relations by label, here every word of the documents and a few that matter."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", "[ \n]")).alias("label"))
    few = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("element_at(array('Yes', ' no', 'next', 'root cause', 'approved', 'reject it', 'note', null), cast(o_orderkey % 8 + 1 as int)) as label")
    return words.unionByName(few).groupBy("label").agg(F.count("*").alias("n")).select("label", tables.connector_relation(F.col("label")).alias("relation"), "n")


def table_markdown(spark, sf_dir):
    return sinks.markdown(cells_from_orders(spark, sf_dir))


def cell_model(spark, sf_dir):
    return tables.cell_model(cells_from_orders(spark, sf_dir), 960.0, 24.0)


def likely_tables(spark, sf_dir):
    return tables.likely_tables(cells_from_orders(spark, sf_dir))


def series_values(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    points = li.groupBy(F.col("l_returnflag").alias("series"), F.date_format("l_shipdate", "yyyy-MM").alias("category")).agg(F.count("*").cast("string").alias("value"))
    return tables.series_by_category(points)


def page_records(spark, sf_dir):
    return sinks.page_records(elements_from_events(spark, sf_dir).select("document_id", "slide_number", "ord", "element_type", "text"))


def table_reconstruction(spark, sf_dir):
    """Tables with all that draws them again, their cells and sections as text."""
    t = tables.reconstruction(cells_from_orders(spark, sf_dir), 960.0, 24.0)
    cell = F.transform("cells", lambda c: F.concat_ws(":", c["row"], c["col"], c["role"], c["text"]))
    section = F.transform("sections", lambda s: F.concat_ws(":", s["row"], s["label"]))
    return t.select("table_id", "archetype", "header_depth", "n_rows", "n_cols", F.array_join(cell, "|").alias("cells"), F.array_join(section, "|").alias("sections"))


QUERIES = {f.__name__: f for f in (table_profile, section_rows, connector_relations, table_markdown, cell_model, likely_tables, series_values, page_records, table_reconstruction)}

_ROWS = """cells AS (SELECT o_custkey AS table_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS r,
  [CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END, CASE WHEN o_orderkey % 4 < 2 THEN '' ELSE o_orderstatus END,
   CASE WHEN o_orderkey % 5 < 3 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END,
   CASE WHEN o_orderkey % 11 = 0 THEN 'Total' WHEN o_orderkey % 13 = 0 THEN 'Subtotal cost' ELSE '' END] AS c FROM orders WHERE o_orderkey IS NOT NULL),
rs AS (SELECT *, [x FOR x IN c IF trim(x) <> ''] AS f, CAST(count(*) OVER (PARTITION BY table_id) AS INT) AS n_rows FROM cells)"""

ORACLES = {
    "table_profile": f"""WITH {_ROWS},
d AS (SELECT *, coalesce(min(CASE WHEN r >= 4 OR r >= n_rows - 1 OR 2 * len(list_distinct(f)) >= 4 THEN r END) OVER (PARTITION BY table_id), least(n_rows, 4)) AS depth FROM rs),
t AS (SELECT table_id, first(n_rows) AS n_rows, first(depth) AS depth, count(*) FILTER (r >= depth AND trim(c[1]) <> '') AS named,
  count(*) FILTER (r >= depth AND len(f) = 1 AND r < n_rows - 1) AS section_rows, sum(len([x FOR x IN c IF regexp_matches(x, '[0-9]')])) AS num,
  bool_or(regexp_matches(lower(array_to_string(c, ' ')), 'revenue|ebitda|profit|budget|cost|total|variance')) AS is_financial,
  bool_or(contains(lower(array_to_string(c, '')), 'subtotal')) AS has_subtotals,
  bool_or(contains(lower(array_to_string(c, '')), 'total') AND NOT contains(lower(array_to_string(c, '')), 'subtotal')) AS has_totals FROM d GROUP BY 1),
p AS (SELECT *, n_rows > 1 AND 10 * named > 8 * (n_rows - depth) AS is_pivot FROM t)
SELECT table_id, n_rows, 4 AS n_cols, greatest(depth, 1) AS header_depth, is_pivot, section_rows, is_financial, 10 * num > 4 * n_rows * 4 AS numeric_density, has_subtotals, has_totals,
  CASE WHEN is_pivot AND depth > 1 THEN 'complex_cross_tab' WHEN section_rows > 0 THEN 'sectioned_report' WHEN is_pivot THEN 'matrix_comparison' WHEN is_financial THEN 'financial_statement' ELSE 'standard_list' END AS archetype FROM p""",
    "section_rows": rf"""WITH {_ROWS},
l AS (SELECT *, CASE WHEN regexp_matches(array_to_string(c, ' '), '\b(DoD|BoP|TOTAL|VA|IHS|FAR|DFARS|SUBTOTAL|SECTION|APPENDIX|SUMMARY)\b', 'i') THEN trim(array_to_string(c, ' '))
  WHEN len(f) = 1 AND r > 0 THEN trim(f[1]) END AS label FROM rs)
SELECT table_id, r AS "row", label, 4 AS columns_spanned FROM l WHERE label IS NOT NULL""",
    "connector_relations": """WITH l AS (SELECT unnest(regexp_split_to_array(text, '[ \n]')) AS label FROM documents UNION ALL SELECT (['Yes', ' no', 'next', 'root cause', 'approved', 'reject it', 'note', NULL])[o_orderkey % 8 + 1] FROM orders),
g AS (SELECT label, count(*) AS n, lower(trim(coalesce(label, ''))) AS t FROM l GROUP BY label)
SELECT label, CASE WHEN t IN ('yes', 'no') THEN 'decision' WHEN t IN ('next', 'continue') THEN 'process_flow' WHEN contains(t, 'cause') THEN 'cause_effect' WHEN contains(t, 'approve') OR contains(t, 'reject') THEN 'decision' ELSE 'flow' END AS relation, n FROM g""",
    "table_markdown": f"""WITH {_ROWS}, l AS (SELECT table_id, r, '| ' || array_to_string(c, ' | ') || ' |' AS line FROM rs)
SELECT table_id, string_agg(CASE WHEN r = 0 THEN line || chr(10) || '| --- | --- | --- | --- |' ELSE line END, chr(10) ORDER BY r) AS markdown FROM l GROUP BY 1""",
    "cell_model": f"""WITH {_ROWS},
d AS (SELECT *, greatest(1, coalesce(min(CASE WHEN r >= 4 OR r >= n_rows - 1 OR 2 * len(list_distinct(f)) >= 4 THEN r END) OVER (PARTITION BY table_id), least(n_rows, 4))) AS depth FROM rs),
u AS (SELECT *, unnest([0, 1, 2, 3]) AS col FROM d)
SELECT table_id, r AS "row", col, CASE WHEN r < depth THEN 'header' WHEN col = 0 THEN 'row_header' ELSE 'data' END AS role, trim(c[col + 1]) AS text, col * 240.0::DOUBLE AS x, r * 24.0::DOUBLE AS y, 240.0::DOUBLE AS width, 24.0::DOUBLE AS height FROM u""",
    "likely_tables": f"""WITH {_ROWS}, w AS (SELECT table_id, n_rows, f, [x FOR x IN string_split(array_to_string(f, ' '), ' ') IF x <> ''] AS w FROM rs),
t AS (SELECT table_id, first(n_rows) AS n_rows, max(len(f)) AS widest, CAST(sum(len(f)) AS BIGINT) AS cells, sum(len(w)) AS words,
  sum(len([x FOR x IN w IF contains(x, '%') OR (regexp_matches(replace(x, '.', ''), '^[0-9]+$') AND length(x) <= 3)])) AS figures FROM w GROUP BY 1)
SELECT table_id, cells AS n_cells, n_rows >= 2 AND widest > 1 AND cells >= 4 AND NOT (10 * figures > 7 * words AND cells < 12) AS likely FROM t""",
    "series_values": """WITH p AS (SELECT l_returnflag AS series, strftime(l_shipdate, '%Y-%m') AS category, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT s.series, c.category, coalesce(CAST(n AS VARCHAR), '0') AS value FROM (SELECT DISTINCT series FROM p) s CROSS JOIN (SELECT DISTINCT category FROM p) c LEFT JOIN p ON p.series = s.series AND p.category = c.category""",
    "page_records": f"""WITH {ELEMENTS_SQL} SELECT document_id, slide_number, '{{"document_id":' || document_id || ',"slide_number":' || slide_number || ',"elements":[' ||
  string_agg('{{"ord":' || ord || ',"element_type":"' || element_type || '","text":"' || text || '"}}', ',' ORDER BY ord) || ']}}' AS record FROM el GROUP BY 1, 2""",
}
ORACLES["table_reconstruction"] = f"""WITH m AS (SELECT table_id, string_agg("row" || ':' || col || ':' || role || ':' || text, '|' ORDER BY "row", col) AS cells FROM ({ORACLES['cell_model']}) GROUP BY table_id),
s AS (SELECT table_id, string_agg("row" || ':' || label, '|' ORDER BY "row") AS sections FROM ({ORACLES['section_rows']}) GROUP BY table_id)
SELECT table_id, archetype, header_depth, n_rows, n_cols, cells, coalesce(sections, '') AS sections FROM ({ORACLES['table_profile']}) JOIN m USING (table_id) LEFT JOIN s USING (table_id)"""
