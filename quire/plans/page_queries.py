"""Queries over elements of pages, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.operators import layout, spatial
from quire.sources.elements import ELEMENTS_SQL, elements_from_events


def over_elements(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(elements_from_events(spark, sf_dir))


def grouped_neighbours(elements: DataFrame) -> DataFrame:
    return spatial.nearest_neighbours(elements, spatial.smallest_container(elements))


QUERIES = {
    "region_by_element": over_elements(layout.regions),
    "zones": over_elements(layout.zones),
    "pixel_boxes": over_elements(layout.pixel_boxes),
    "layers": over_elements(layout.layers),
    "union_box_by_type": over_elements(lambda e: layout.union_boxes(e, ["document_id", "slide_number", "element_type"])),
    "proximity_groups": over_elements(layout.proximity_groups),
    "reading_order": over_elements(layout.reading_order),
    "area_topk": over_elements(layout.largest),
    "row_islands": over_elements(layout.row_islands),
    "gap_splits": over_elements(layout.gap_splits),
    "coord_clusters": over_elements(layout.coordinate_clusters),
    "panel_split": over_elements(layout.panels),
    "alignment_spacing": over_elements(layout.alignment),
    "json_violations": over_elements(layout.violations),
    "relationship_edges": over_elements(spatial.relationship_edges),
    "containment_edges": over_elements(lambda e: spatial.relationship_edges(e).where("relationship_type = 'contains'")),
    "hierarchy_edges": over_elements(lambda e: spatial.relationship_edges(e).where("relationship_type = 'hierarchy'")),
    "proximity_edges": over_elements(lambda e: spatial.relationship_edges(e).where("relationship_type = 'proximity'")),
    "overlap_pairs": over_elements(spatial.overlap_pairs),
    "smallest_container": over_elements(spatial.smallest_container),
    "nearest_neighbours": over_elements(spatial.nearest_neighbours),
    "nearest_among_siblings": over_elements(grouped_neighbours),
    "connector_targets": over_elements(spatial.connector_targets),
    "text_in_card": over_elements(spatial.text_in_card),
}


def _sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([ELEMENTS_SQL, *ctes])} {body}"


_REGION = """CASE WHEN y + height / 2 < 0.18 * 6858000 THEN 'header' WHEN y + height / 2 > 0.85 * 6858000 THEN 'footer'
  WHEN x + width / 2 < 0.5 * 12192000 THEN 'body_left' ELSE 'body_right' END"""
_BOX = "bx AS (SELECT * FROM el WHERE element_type NOT IN ('connector', 'arrow'))"
_IN = lambda o, i: f"{i}.x >= {o}.x AND {i}.y >= {o}.y AND {i}.x + {i}.width <= {o}.x + {o}.width AND {i}.y + {i}.height <= {o}.y + {o}.height"
_MID = lambda p: (f"({p}.x + {p}.width / 2)", f"({p}.y + {p}.height / 2)")
(_AX, _AY), (_BX, _BY) = _MID("a"), _MID("b")
_PG = "a.document_id = b.document_id AND a.slide_number = b.slide_number"
_EDGES = f"""pr AS (
  SELECT a.document_id, a.slide_number, a.element_id AS ai, b.element_id AS bi,
    CASE WHEN {_IN("a", "b")} THEN 1 WHEN {_IN("b", "a")} THEN 2 WHEN abs({_AX} - {_BX}) < 100000 AND b.y > a.y THEN 3
      WHEN abs({_AX} - {_BX}) < 100000 AND a.y > b.y THEN 4
      WHEN ({_AX} - {_BX}) * ({_AX} - {_BX}) + ({_AY} - {_BY}) * ({_AY} - {_BY}) < 500000.0 * 500000.0 THEN 5 END AS k
  FROM bx a JOIN bx b ON {_PG} AND a.ord < b.ord),
edges AS (
  SELECT document_id, slide_number, CASE WHEN k <= 2 THEN 'contains' WHEN k <= 4 THEN 'hierarchy' ELSE 'proximity' END AS relationship_type,
    CASE WHEN k IN (2, 4) THEN bi ELSE ai END AS source_element_id, CASE WHEN k IN (2, 4) THEN ai ELSE bi END AS target_element_id,
    CAST(CASE WHEN k <= 2 THEN 0.9 WHEN k <= 4 THEN 0.8 ELSE 0.7 END AS DOUBLE) AS confidence
  FROM pr WHERE k IS NOT NULL)"""
_W = "(least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x))"
_H = "(least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))"
_PARENT = f"""pa AS (
  SELECT a.document_id, a.slide_number, a.element_id, arg_min(b.element_id, (b.width * b.height, b.ord)) AS parent_id
  FROM el a JOIN el b ON {_PG} AND a.ord <> b.ord AND b.element_type IN ('group', 'shape', 'table', 'chart', 'image')
    AND {_IN("b", "a")} AND (b.width * b.height > a.width * a.height OR b.ord < a.ord) GROUP BY 1, 2, 3)"""
_NEAR = """SELECT {keys} AS element_id, {pick} FROM {rows} GROUP BY 1, 2, 3"""
_PICK = ", ".join(f"arg_min(bi, (dx * dx + dy * dy, bo)) FILTER (WHERE {w}) AS {n}" for w, n in (("dx < 0", "left_id"), ("dx > 0", "right_id"), ("dy < 0", "above_id"), ("dy > 0", "below_id")))


def _near(extra: str) -> str:
    return f"""nn AS (SELECT a.document_id, a.slide_number, a.element_id AS ai, b.element_id AS bi, b.ord AS bo, {_BX} - {_AX} AS dx, {_BY} - {_AY} AS dy
  FROM {extra}), got AS (SELECT document_id, slide_number, ai AS element_id, {_PICK} FROM nn GROUP BY 1, 2, 3)"""


_NEAR_BODY = "SELECT document_id, slide_number, element_id, left_id, right_id, above_id, below_id FROM el LEFT JOIN got USING (document_id, slide_number, element_id)"
_ISLAND = "sum(CASE WHEN {gap} OR {lag} IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
_PAGE = "document_id, slide_number"


def _split(source: str, name: str, keys: str, at: str, size: str, gap: int, out: str) -> str:
    return f"""{name}_l AS (SELECT *, lag({at} + {size}) OVER (PARTITION BY {keys} ORDER BY {at}, ord) AS bf FROM {source}),
{name} AS (SELECT * EXCLUDE (bf), CAST(sum(CASE WHEN bf IS NULL OR {at} - bf > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY {at}, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS {out} FROM {name}_l)"""


_DIST = lambda x, y: f"sqrt(({_BX} - {x}) * ({_BX} - {x}) + ({_BY} - {y}) * ({_BY} - {y}))"
_EDGE_COLUMNS = "document_id, slide_number, relationship_type, source_element_id, target_element_id, confidence"

ORACLES = {
    "region_by_element": _sql(f"SELECT document_id, slide_number, element_id, {_REGION} AS region FROM el"),
    "zones": _sql(
        "SELECT document_id, slide_number, element_id, zone_x, zone_y, CASE WHEN zone_x = 'center' AND zone_y = 'center' THEN 'center' ELSE zone_y || '-' || zone_x END AS grid, x_pct, y_pct FROM z",
        """z AS (SELECT *, CASE WHEN (x + width / 2) / 12192000 < 0.33 THEN 'left' WHEN (x + width / 2) / 12192000 > 0.66 THEN 'right' ELSE 'center' END AS zone_x,
      CASE WHEN (y + height / 2) / 6858000 < 0.33 THEN 'top' WHEN (y + height / 2) / 6858000 > 0.66 THEN 'bottom' ELSE 'center' END AS zone_y,
      round_even(x / 12192000, 6) AS x_pct, round_even(y / 6858000, 6) AS y_pct FROM el)""",
    ),
    "pixel_boxes": _sql(
        """SELECT *, CASE WHEN height <= greatest(3.0, 0.08 * width) THEN 'horizontal' WHEN width <= greatest(3.0, 0.08 * height) THEN 'vertical' END AS line FROM p""",
        "p AS (SELECT document_id, slide_number, element_id, round_even(greatest(0, x / 9525.0), 3) AS x, round_even(greatest(0, y / 9525.0), 3) AS y, round_even(greatest(0, width / 9525.0), 3) AS width, round_even(greatest(0, height / 9525.0), 3) AS height FROM el)",
    ),
    "layers": _sql(
        """SELECT document_id, slide_number, element_id, CASE element_type WHEN 'image' THEN 'Images' WHEN 'table' THEN 'Tables' WHEN 'connector' THEN 'Lines' WHEN 'text_box' THEN 'Text' WHEN 'icon' THEN 'Icons'
      ELSE CASE WHEN width * height / (12192000.0 * 6858000.0) > 0.8 THEN 'Background' WHEN width * height / (12192000.0 * 6858000.0) > 0.25 THEN 'Large panels' ELSE 'Shapes' END END AS layer FROM el"""
    ),
    "union_box_by_type": _sql("SELECT document_id, slide_number, element_type, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, count(*) AS members FROM el GROUP BY 1, 2, 3"),
    "proximity_groups": _sql(
        """SELECT document_id, slide_number, CAST(floor((x + width / 2) / 2500000) AS BIGINT) AS cell_x, CAST(floor((y + height / 2) / 1600000) AS BIGINT) AS cell_y,
      min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, count(*) AS members FROM el GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2"""
    ),
    "reading_order": _sql("SELECT document_id, slide_number, element_id, row_number() OVER w AS position, lead(element_id) OVER w AS next_id FROM el WINDOW w AS (PARTITION BY document_id, slide_number ORDER BY y, x, z_order, ord)"),
    "area_topk": _sql(
        "SELECT document_id, slide_number, element_id, rank, ['primary', 'secondary', 'tertiary'][rank] AS level FROM r WHERE rank <= 3",
        "r AS (SELECT *, row_number() OVER (PARTITION BY document_id, slide_number ORDER BY width * height DESC, ord) AS rank FROM el)",
    ),
    "row_islands": _sql(
        f"SELECT document_id, slide_number, element_id, CAST(sum(CASE WHEN bf IS NULL OR abs(y + height / 2 - bf) > 150000 THEN 1 ELSE 0 END) OVER (PARTITION BY {_PAGE} ORDER BY y, x, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row_id FROM l",
        f"l AS (SELECT *, lag(y + height / 2) OVER (PARTITION BY {_PAGE} ORDER BY y, x, ord) AS bf FROM el)",
    ),
    "gap_splits": _sql(
        "SELECT document_id, slide_number, element_id, split_1, split_2, split_3 FROM s3",
        _split("el", "s1", _PAGE, "y", "height", 400000, "split_1"), _split("s1", "s2", f"{_PAGE}, split_1", "x", "width", 500000, "split_2"), _split("s2", "s3", f"{_PAGE}, split_1, split_2", "y", "height", 150000, "split_3"),
    ),
    "coord_clusters": _sql(
        "SELECT document_id, slide_number, cluster, round_even(avg(v), 3) AS position, count(*) AS edges FROM i GROUP BY 1, 2, 3",
        f"e AS (SELECT DISTINCT document_id, slide_number, unnest([x, x + width]) AS v FROM el), l AS (SELECT *, lag(v) OVER (PARTITION BY {_PAGE} ORDER BY v) AS bf FROM e)",
        f"i AS (SELECT *, CAST(sum(CASE WHEN bf IS NULL OR v - bf > 80000 THEN 1 ELSE 0 END) OVER (PARTITION BY {_PAGE} ORDER BY v ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM l)",
    ),
    "panel_split": _sql(
        f"SELECT document_id, slide_number, element_id, CASE WHEN panel = 1 THEN 'Left panel' ELSE 'Right panel' END AS panel FROM s QUALIFY max(panel) OVER (PARTITION BY {_PAGE}) = 2",
        "t AS (SELECT * FROM el WHERE element_type = 'text_box')", _split("t", "s", _PAGE, "x", "width", 500000, "panel"),
    ),
    "alignment_spacing": _sql(
        """SELECT document_id, slide_number, CASE WHEN stddev_pop(x) < 500000 THEN 'left-aligned' ELSE 'mixed' END AS alignment,
      CASE WHEN avg(gap) FILTER (gap > 0) IS NULL THEN 'unknown' WHEN avg(gap) FILTER (gap > 0) < 200000 THEN 'compact' WHEN avg(gap) FILTER (gap > 0) < 600000 THEN 'moderate' ELSE 'spacious' END AS spacing FROM g GROUP BY 1, 2""",
        f"g AS (SELECT *, y - lag(y + height) OVER (PARTITION BY {_PAGE} ORDER BY y, ord) AS gap FROM el)",
    ),
    "json_violations": _sql(
        """SELECT document_id, slide_number, element_id, 'out_of_bounds' AS violation FROM el WHERE x < -10 OR y < -10 OR x + width > 12192010 OR y + height > 6858010
      UNION ALL SELECT document_id, slide_number, element_id, 'duplicate_id' FROM el GROUP BY 1, 2, 3 HAVING count(*) > 1
      UNION ALL SELECT document_id, slide_number, min(element_id), 'duplicate_text' FROM el GROUP BY document_id, slide_number, x, y, text HAVING count(*) > 1"""
    ),
    "relationship_edges": _sql(f"SELECT {_EDGE_COLUMNS} FROM edges", _BOX, _EDGES),
    "containment_edges": _sql(f"SELECT {_EDGE_COLUMNS} FROM edges WHERE relationship_type = 'contains'", _BOX, _EDGES),
    "hierarchy_edges": _sql(f"SELECT {_EDGE_COLUMNS} FROM edges WHERE relationship_type = 'hierarchy'", _BOX, _EDGES),
    "proximity_edges": _sql(f"SELECT {_EDGE_COLUMNS} FROM edges WHERE relationship_type = 'proximity'", _BOX, _EDGES),
    "overlap_pairs": _sql(
        f"""SELECT a.document_id, a.slide_number, a.element_id, b.element_id AS other_id, round_even({_W} * {_H} / least(a.width * a.height, b.width * b.height), 6) AS overlap_ratio,
      CASE WHEN b.z_order > a.z_order THEN 'above' WHEN b.z_order < a.z_order THEN 'below' ELSE 'same' END AS z_relation FROM el a JOIN el b ON {_PG} AND a.ord <> b.ord AND {_W} > 0 AND {_H} > 0"""
    ),
    "smallest_container": _sql("SELECT document_id, slide_number, element_id, parent_id FROM el LEFT JOIN pa USING (document_id, slide_number, element_id)", _PARENT),
    "nearest_neighbours": _sql(_NEAR_BODY, _near(f"el a JOIN el b ON {_PG} AND a.ord <> b.ord")),
    "nearest_among_siblings": _sql(
        _NEAR_BODY, _PARENT, "ep AS (SELECT el.*, coalesce(CAST(parent_id AS VARCHAR), 'root') AS parent FROM el LEFT JOIN pa USING (document_id, slide_number, element_id))", _near(f"ep a JOIN ep b ON {_PG} AND a.parent = b.parent AND a.ord <> b.ord")
    ),
    "connector_targets": _sql(
        """SELECT document_id, slide_number, connector_id, source_element_id, target_element_id,
      CASE WHEN abs(dx) > abs(dy) THEN CASE WHEN dx > 0 THEN 'left_to_right' ELSE 'right_to_left' END ELSE CASE WHEN dy > 0 THEN 'top_to_bottom' ELSE 'bottom_to_top' END END AS direction,
      CAST(0.95 AS DOUBLE) AS confidence FROM t WHERE source_element_id <> target_element_id""",
        _BOX,
        f"""t AS (SELECT a.document_id, a.slide_number, a.element_id AS connector_id, a.end_x - a.begin_x AS dx, a.end_y - a.begin_y AS dy,
      arg_min(b.element_id, ({_DIST("a.begin_x", "a.begin_y")}, b.ord)) AS source_element_id, arg_min(b.element_id, ({_DIST("a.end_x", "a.end_y")}, b.ord)) AS target_element_id
      FROM el a JOIN bx b ON {_PG} WHERE a.element_type = 'connector' AND a.begin_x IS NOT NULL GROUP BY 1, 2, 3, 4, 5)""",
    ),
    "text_in_card": _sql(
        "SELECT document_id, slide_number, element_id, card_id FROM el LEFT JOIN c USING (document_id, slide_number, element_id) WHERE element_type = 'text_box'",
        f"""c AS (SELECT a.document_id, a.slide_number, a.element_id, arg_min(b.element_id, b.ord) AS card_id FROM el a JOIN el b ON {_PG} AND b.element_type = 'shape' AND a.element_type = 'text_box'
      AND {_AX} BETWEEN b.x AND b.x + b.width AND {_AY} BETWEEN b.y AND b.y + b.height GROUP BY 1, 2, 3)""",
    ),
}
