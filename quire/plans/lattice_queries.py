"""Queries over tables that are drawn with ruled lines, with the same in SQL.

Every order is a table of its lines, two orders on a page: four columns of 80 points, rows of 20, rules a little off their place; in every third row the
last two columns are one cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import lattice

_COLUMNS = ("l_returnflag", "l_linestatus", "cast(l_suppkey as string)", "cast(cast(l_quantity as int) as string)")


def _lines(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = rows.selectExpr("l_orderkey", "l_linenumber", f"array({', '.join(_COLUMNS)}) as c").groupBy("l_orderkey", "l_linenumber").agg(F.min("c").alias("c"))
    rank = F.expr("row_number() over (partition by l_orderkey order by l_linenumber) - 1")
    return rows.withColumn("r", rank).selectExpr("l_orderkey div 20 as document_id", "l_orderkey div 2 as slide_number", "l_orderkey % 2 * 400D as left", "r", "r * 20D as top", "c")


def drawn_rules(spark, sf_dir) -> DataFrame:
    """Segments: above and below every row, and beside every cell but those inside a joined one."""
    across = "struct(left as x1, top + 0.3 as y1, left + 320 as x2, top + 0.3 as y2), struct(left as x1, top + 19.5 as y1, left + 320 as x2, top + 20.5 as y2)"
    down = "transform(filter(array(0, 1, 2, 3, 4), c -> c <> 3 or r % 3 <> 1), c -> struct(left + c * 80 - 0.4 as x1, top as y1, left + c * 80 + 0.4 as x2, top + 20 as y2))"
    return _lines(spark, sf_dir).select("document_id", "slide_number", F.expr(f"inline(concat(array({across}), {down}))"))


def drawn_texts(spark, sf_dir) -> DataFrame:
    e = _lines(spark, sf_dir).selectExpr("document_id", "slide_number", "left", "top", "r", "posexplode(c) as (k, text)")
    return e.selectExpr("document_id", "slide_number", "r * 4 + k as ord", "left + k * 80 + 5 as x", "top + 4 as y", "60D as width", "12D as height", "text")


def ruled_cells(spark, sf_dir):
    c = lattice.filled_cells(drawn_rules(spark, sf_dir), drawn_texts(spark, sf_dir))
    return c.select("document_id", "slide_number", F.expr("if(x < 390, 0, 1)").alias("side"), "row", "col", "row_span", "col_span", "text", F.bround("width", 0).alias("width"), F.bround("height", 0).alias("height"))


def ruled_matrix(spark, sf_dir):
    m = lattice.string_matrix(lattice.filled_cells(drawn_rules(spark, sf_dir), drawn_texts(spark, sf_dir)))
    return m.groupBy("document_id", "slide_number", "table_id", "row").agg(F.first(F.array_join("texts", "|")).alias("line")).drop("table_id")


def ruled_lines(spark, sf_dir):
    return lattice.grid_size(drawn_rules(spark, sf_dir))


QUERIES = {f.__name__: f for f in (ruled_cells, ruled_matrix, ruled_lines)}

_SQL_COLUMNS = "l_returnflag, l_linestatus, CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS INT) AS VARCHAR)"
_ROWS = f"""rw AS (SELECT l_orderkey // 20 AS document_id, l_orderkey // 2 AS slide_number, l_orderkey % 2 AS side, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS r, c
  FROM (SELECT l_orderkey, l_linenumber, min([{_SQL_COLUMNS}]) AS c FROM lineitem GROUP BY 1, 2))"""

#: What was drawn, said without the drawing.
ORACLES = {
    "ruled_cells": f"""WITH {_ROWS} SELECT document_id, slide_number, CAST(side AS INT) AS side, CAST(r AS INT) AS "row", CAST(k AS INT) AS col, 1 AS row_span, CASE WHEN k = 2 AND r % 3 = 1 THEN 2 ELSE 1 END AS col_span,
  trim(c[k + 1]) || CASE WHEN k = 2 AND r % 3 = 1 THEN ' ' || c[4] ELSE '' END AS text, CASE WHEN k = 2 AND r % 3 = 1 THEN 160.0 ELSE 80.0 END::DOUBLE AS width, 20.0::DOUBLE AS height
FROM rw, range(4) t(k) WHERE NOT (k = 3 AND r % 3 = 1)""",
    "ruled_matrix": f"""WITH {_ROWS} SELECT document_id, slide_number, CAST(r AS INT) AS "row", CASE WHEN r % 3 = 1 THEN c[1] || '|' || c[2] || '|' || trim(c[3]) || ' ' || c[4] || '|' ELSE c[1] || '|' || c[2] || '|' || trim(c[3]) || '|' || c[4] END AS line FROM rw""",
    "ruled_lines": f"WITH {_ROWS} SELECT document_id, slide_number, 2 * count(*) AS rows, sum(CASE WHEN r % 3 = 1 THEN 4 ELSE 5 END)::BIGINT AS columns FROM rw GROUP BY 1, 2",
}
