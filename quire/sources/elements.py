"""The ``elements`` relation: one row per positioned, typed element of a page.

Columns: document_id, slide_number (the page key), element_id, ord (input order, the last key of every ordering),
element_type, x, y, width, height (doubles, top-left origin), text, z_order, stacking_order, and begin_x, begin_y,
end_x, end_y: where a connector starts and ends (null where that is not known).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = ["document_id", "slide_number"]
TYPES = {"view": "text_box", "click": "shape", "purchase": "image", "signup": "table", "error": "connector"}
#: Ends of connectors at corners of their boxes: turned left to right in every second, upside down in every third, unknown in every eleventh.
ENDS = {
    "begin_x": "x + if(event_id % 2 = 1, width, 0D)", "begin_y": "y + if(event_id % 3 = 1, height, 0D)",
    "end_x": "x + if(event_id % 2 = 1, 0D, width)", "end_y": "y + if(event_id % 3 = 1, 0D, height)",
}


def elements_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements derived from the ``events`` table by integer arithmetic: a page per user, an element per event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    kind: Column = F.lit("unknown")
    for event, element in TYPES.items():
        kind = F.when(F.col("event_type") == event, element).otherwise(kind)
    at = lambda step, size, least=0: F.expr(f"cast({least} + (event_id * {step}) % {size} as double)")
    return e.select(
        "event_id", F.expr("user_id div 10").alias("document_id"), F.col("user_id").alias("slide_number"),
        F.col("event_id").alias("element_id"), F.col("event_id").alias("ord"), kind.alias("element_type"),
        at(7919, 11000000).alias("x"), at(104729, 6000000).alias("y"),
        at(1299709, 3000000, 200000).alias("width"), at(15485863, 1500000, 100000).alias("height"),
        F.concat_ws(" ", "event_type", F.expr("cast(event_id % 100 as string)")).alias("text"),
        F.expr("event_id % 7").alias("z_order"), F.expr("event_id % 7").alias("stacking_order"),
    ).select(
        "*", *(F.expr(f"if(event_id % 11 = 0, null, {at})").alias(name) for name, at in ENDS.items()),
    ).drop("event_id")


#: The same relation for DuckDB.
ELEMENTS_SQL = """el AS (
  SELECT user_id // 10 AS document_id, user_id AS slide_number, event_id AS element_id, event_id AS ord,
    CASE event_type WHEN 'view' THEN 'text_box' WHEN 'click' THEN 'shape' WHEN 'purchase' THEN 'image'
      WHEN 'signup' THEN 'table' WHEN 'error' THEN 'connector' ELSE 'unknown' END AS element_type,
    CAST((event_id * 7919) % 11000000 AS DOUBLE) AS x, CAST((event_id * 104729) % 6000000 AS DOUBLE) AS y,
    CAST(200000 + (event_id * 1299709) % 3000000 AS DOUBLE) AS width, CAST(100000 + (event_id * 15485863) % 1500000 AS DOUBLE) AS height,
    event_type || ' ' || CAST(event_id % 100 AS VARCHAR) AS text, event_id % 7 AS z_order, event_id % 7 AS stacking_order,
    CASE WHEN event_id % 11 <> 0 THEN x + CASE WHEN event_id % 2 = 1 THEN width ELSE 0 END END AS begin_x,
    CASE WHEN event_id % 11 <> 0 THEN y + CASE WHEN event_id % 3 = 1 THEN height ELSE 0 END END AS begin_y,
    CASE WHEN event_id % 11 <> 0 THEN x + CASE WHEN event_id % 2 = 1 THEN 0 ELSE width END END AS end_x,
    CASE WHEN event_id % 11 <> 0 THEN y + CASE WHEN event_id % 3 = 1 THEN 0 ELSE height END END AS end_y
  FROM events)"""

#: Texts, types and styles of ``styled_elements`` by integer arithmetic over ord.
TEXTS = (
    "Overview of goals", "What is next?", "Warning: do not open", "Step 2 of the plan", "Best for: Urgent matters", "- one item", None, "", "Key point: Use it, then follow up in writing",
    " Status : open ", "Email", "The committee reads the summary and the results of every survey before it approves what the next steps should be, and it publishes the metrics afterwards.",
    "Sales 45% and $20 and 30% of respondents agree", "Confidential draft", "Spot the AI errors below and find problems.", "1. First\n2. Second\nplain",
)
KINDS = {3: "chart", 5: "icon", 7: "arrow", 9: "group", 11: "placeholder", 13: "smartart"}
FILLS = ("#ffffff", "#1F2937", None, "#ff0000", "#4169e1", "")
INKS = ("#000000", "#336699", None)
FONTS = ("Arial", None, "Calibri", "Georgia")


def _among(values, key: str) -> str:
    quoted = ", ".join("null" if v is None else "'" + v.replace("'", "''").replace("\n", "\\n") + "'" for v in values)
    return f"element_at(array({quoted}), cast({key} % {len(values)} as int) + 1)"


def styled_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of the events with texts, types and styles of every kind, and the columns font_size, bold, fill_color, text_color,
    font_family, shape_type, group_id and parent."""
    e = elements_from_events(spark, sf_dir)
    kind = "case ord % 17 " + " ".join(f"when {k} then '{v}'" for k, v in KINDS.items()) + " else element_type end"
    return e.withColumns({
        "text": F.expr(_among(TEXTS, "ord")), "element_type": F.expr(kind), "font_size": F.expr("if(ord % 6 = 0, null, cast(8 + ord % 5 * 4 as double))"), "bold": F.expr("ord % 3 = 0"),
        "fill_color": F.expr(_among(FILLS, "ord div 3")), "text_color": F.expr(_among(INKS, "ord div 2")), "font_family": F.expr(_among(FONTS, "ord div 5")),
        "shape_type": F.expr("case when ord % 8 = 0 then 'panel' when ord % 29 = 4 then 'wedgeCallout' end"), "group_id": F.expr("if(ord % 10 = 0, concat('g', ord % 3), null)"),
        "parent": F.lit(None).cast("long"),
    })


def _listed(values, key: str) -> str:
    quoted = ", ".join("NULL" if v is None else " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in v.split("\n")) for v in values)
    return f"([{quoted}])[{key} % {len(values)} + 1]"


#: The same for DuckDB, after ELEMENTS_SQL.
STYLED_SQL = f"""st AS (SELECT * REPLACE ({_listed(TEXTS, 'ord')} AS text, CASE ord % 17 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in KINDS.items())} ELSE element_type END AS element_type),
  CASE WHEN ord % 6 = 0 THEN NULL ELSE CAST(8 + ord % 5 * 4 AS DOUBLE) END AS font_size, ord % 3 = 0 AS bold, {_listed(FILLS, '(ord // 3)')} AS fill_color, {_listed(INKS, '(ord // 2)')} AS text_color,
  {_listed(FONTS, '(ord // 5)')} AS font_family, CASE WHEN ord % 8 = 0 THEN 'panel' WHEN ord % 29 = 4 THEN 'wedgeCallout' END AS shape_type, CASE WHEN ord % 10 = 0 THEN 'g' || (ord % 3) END AS group_id,
  CAST(NULL AS BIGINT) AS parent FROM el)"""
