"""Queries over edges, labels, flowcharts and graphs of pages, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import flows, folds, spatial
from quire.plans.form_queries import kahn
from quire.plans.page_queries import _EDGES
from quire.plans.semantic_queries import _ENDS
from quire.sources.elements import ELEMENTS_SQL, PAGE, STYLED_SQL, styled_elements

_PAGE = "document_id, slide_number"


def _relations(spark, sf_dir):
    """Connectors with the boxes at their ends; every third has a label, one is a flow of another type."""
    r = spatial.connector_targets(styled_elements(spark, sf_dir))
    return r.withColumn("label", F.expr("case connector_id % 3 when 0 then 'Yes' when 1 then '' end")).withColumn("relationship_type", F.expr("if(connector_id % 4 = 0, 'flow', 'connector')"))


def element_labels(spark, sf_dir):
    return flows.labels(styled_elements(spark, sf_dir)).drop("ord")


def relation_texts(spark, sf_dir):
    return flows.relation_texts(_relations(spark, sf_dir), styled_elements(spark, sf_dir)).groupBy(*PAGE, "source_element_id", "target_element_id", "mapping", "chain", "description", "arrow").agg(F.count("*").alias("n"))


def flowchart_pages(spark, sf_dir):
    return flows.flowchart(styled_elements(spark, sf_dir), _relations(spark, sf_dir))


def relation_counts(spark, sf_dir):
    return flows.relation_counts(_relations(spark, sf_dir))


def outgoing_edges(spark, sf_dir):
    return flows.outgoing(_relations(spark, sf_dir))


def process_summary(spark, sf_dir):
    """Boxes of pages in topological order, as a sentence."""
    e = styled_elements(spark, sf_dir)
    box = e.where(F.col("element_type").isin(*flows.BOXES))
    return flows.process_summary(folds.topological_order(box, flows.box_edges(e, _relations(spark, sf_dir))), e)


def diagram_pages(spark, sf_dir):
    return flows.diagram(styled_elements(spark, sf_dir), _relations(spark, sf_dir))


def decision_edges(spark, sf_dir):
    return flows.decision_edges(styled_elements(spark, sf_dir), _relations(spark, sf_dir))


def standout_regions(spark, sf_dir):
    return flows.standout_regions(_tall(spark, sf_dir))


def _tall(spark, sf_dir):
    """Styled elements, some as high as half a page, so that there are sidebars."""
    return styled_elements(spark, sf_dir).withColumn("height", F.expr("if(ord % 5 = 0, height * 4, height)"))


def layout_graph(spark, sf_dir):
    e = _tall(spark, sf_dir)
    return flows.layout_graph(e, flows.standout_regions(e))


def layout_words(spark, sf_dir):
    return flows.layout_words(styled_elements(spark, sf_dir))


def location_texts(spark, sf_dir):
    return flows.location_texts(styled_elements(spark, sf_dir))


def containment_forest(spark, sf_dir):
    e = styled_elements(spark, sf_dir)
    return flows.contained(spatial.relationship_edges(e).where("relationship_type = 'contains'"), spatial.boxes(e))


QUERIES = {
    f.__name__: f
    for f in (element_labels, relation_texts, flowchart_pages, relation_counts, outgoing_edges, process_summary, diagram_pages, decision_edges, standout_regions, layout_graph, layout_words, location_texts, containment_forest)
}

_TRIM = lambda c: rf"regexp_replace({c}, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')"
_LABEL = f"CASE WHEN {_TRIM('coalesce(text, chr(32))')} <> '' THEN replace({_TRIM('text')}, chr(10), ' ') ELSE '[' || element_id || ']' END"
_REL = f"""{ELEMENTS_SQL}, {STYLED_SQL}, {_ENDS}, re AS (SELECT document_id, slide_number, s AS source, d AS target, CASE element_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN '' END AS label,
  CASE WHEN element_id % 4 = 0 THEN 'flow' ELSE 'connector' END AS kind FROM cx WHERE s <> d), lb AS (SELECT {_PAGE}, element_id, ord, {_LABEL} AS label FROM st),
rn AS (SELECT re.*, a.label AS f, b.label AS t FROM re JOIN lb a ON a.document_id = re.document_id AND a.slide_number = re.slide_number AND a.element_id = source
  JOIN lb b ON b.document_id = re.document_id AND b.slide_number = re.slide_number AND b.element_id = target)"""
_BOX = f"bo AS (SELECT * FROM st WHERE element_type IN {flows.BOXES})"
_BOTH = f"be AS (SELECT re.* FROM re WHERE ({_PAGE}, source) IN (SELECT ({_PAGE}, element_id) FROM bo) AND ({_PAGE}, target) IN (SELECT ({_PAGE}, element_id) FROM bo))"
_TALL = f"{ELEMENTS_SQL}, {STYLED_SQL}, ta AS (SELECT * REPLACE (CASE WHEN ord % 5 = 0 THEN height * 4 ELSE height END AS height) FROM st)"
_REGION = f"""{_TALL}, rc AS (SELECT {_PAGE}, greatest(12192000.0, max(x + width)) AS cw, greatest(6858000.0, max(y + height)) AS ch FROM ta GROUP BY {_PAGE}),
tt AS (SELECT *, {_TRIM("coalesce(text, '')")} AS t, regexp_matches(lower(coalesce(shape_type, '')), 'callout|balloon') AS co FROM ta WHERE {_TRIM("coalesce(text, '')")} <> ''),
pr AS (SELECT *, {' '.join(f"CASE WHEN regexp_matches(lower(t), '{'|'.join(w)}') THEN '{n}' ELSE" for n, w in flows.PANELS)} NULL {'END ' * len(flows.PANELS)} AS panel FROM tt),
sr AS (SELECT {_PAGE}, element_id, CASE WHEN co THEN 'callout_box' ELSE 'highlighted_region' END AS role FROM tt WHERE element_type IN ('shape', 'text_box', 'placeholder')
    AND (co OR (lower(fill_color) NOT IN ('#ffffff', '#000000', 'none', '') AND length(t) < 150))
  UNION ALL SELECT {_PAGE}, element_id, 'sidebar' FROM tt JOIN rc USING ({_PAGE}) WHERE width / cw < 0.35 AND height / ch > 0.4 AND (x / cw < 0.25 OR x / cw > 0.65)
  UNION ALL SELECT {_PAGE}, element_id, panel FROM pr WHERE panel IS NOT NULL),
st2 AS (SELECT {_PAGE}, role || '_' || element_id AS name, role, element_id FROM sr)"""

ORACLES = {
    "element_labels": f"WITH {ELEMENTS_SQL}, {STYLED_SQL} SELECT {_PAGE}, element_id, {_LABEL} AS label FROM st",
    "relation_texts": f"""WITH {_REL} SELECT {_PAGE}, source AS source_element_id, target AS target_element_id, f || ' -> ' || t AS mapping, CASE WHEN coalesce(label, '') <> '' THEN label || ': ' ELSE '' END || f || ' → ' || t AS chain,
  source || ' → ' || target || ' [' || kind || ', confidence: 0.95]' || CASE WHEN coalesce(label, '') <> '' THEN ' (label: ''' || label || ''')' ELSE '' END AS description,
  'Arrow connection: ''' || source || ''' points to ''' || target || '''' || CASE WHEN coalesce(label, '') <> '' THEN ' labeled ''' || label || '''' ELSE '' END AS arrow, count(*) AS n FROM rn GROUP BY ALL""",
    "flowchart_pages": f"""WITH {_REL}, {_BOX}, {_BOTH}, n AS (SELECT {_PAGE}, count(*) FILTER (element_type IN {flows.BOXES}) AS boxes, count(*) FILTER (element_type IN {flows.ARROWS}) AS arrows FROM st GROUP BY {_PAGE}),
k AS (SELECT {_PAGE}, count(*) AS k FROM be GROUP BY {_PAGE}) SELECT {_PAGE}, boxes >= 2 AND arrows >= 1 AS is_flowchart, boxes, arrows, coalesce(k, 0) AS edges FROM n LEFT JOIN k USING ({_PAGE})""",
    "relation_counts": f"WITH {_REL} SELECT {_PAGE}, kind AS relationship_type, count(*) AS n FROM re GROUP BY {_PAGE}, kind",
    "outgoing_edges": f"WITH {_REL} SELECT {_PAGE}, source AS element_id, string_agg(CAST(target AS VARCHAR), ',' ORDER BY target) AS targets, count(*) AS n FROM re GROUP BY {_PAGE}, source",
    "diagram_pages": f"""WITH {_REL}, n AS (SELECT {_PAGE}, bool_or(element_type IN ('shape', 'image', 'chart')) AS is_diagram, count(*) FILTER (element_type NOT IN ('arrow', 'connector', 'group')) AS nodes FROM st GROUP BY {_PAGE}),
k AS (SELECT {_PAGE}, count(*) AS a, count(*) FILTER (kind = 'connector') AS l FROM re GROUP BY {_PAGE}) SELECT {_PAGE}, is_diagram, nodes, coalesce(CASE WHEN l > 0 THEN l ELSE a END, 0) AS edges FROM n LEFT JOIN k USING ({_PAGE})""",
    "decision_edges": f"""WITH {_REL}, q AS (SELECT st.document_id, st.slide_number, st.element_id, lb.label FROM st JOIN lb USING ({_PAGE}, element_id) WHERE contains(coalesce(text, ''), '?'))
SELECT q.document_id, q.slide_number, q.element_id, q.label AS decision, coalesce(string_agg(CASE WHEN coalesce(rn.label, '') <> '' THEN rn.label || ' → ' ELSE '→ ' END || t, '; '
  ORDER BY target, CASE WHEN coalesce(rn.label, '') <> '' THEN rn.label || ' → ' ELSE '→ ' END || t) FILTER (target IS NOT NULL), '') AS branches
FROM q LEFT JOIN rn ON q.document_id = rn.document_id AND q.slide_number = rn.slide_number AND q.element_id = source GROUP BY ALL""",
    "standout_regions": f"WITH {_REGION} SELECT * FROM st2",
    "layout_graph": f"""WITH {_REGION} SELECT {_PAGE}, 'region_' || name AS source, CAST(element_id AS VARCHAR) AS target, 'contains' AS relation FROM st2 UNION ALL
  SELECT * FROM (SELECT {_PAGE}, CAST(element_id AS VARCHAR), CAST(lead(element_id) OVER (PARTITION BY {_PAGE} ORDER BY y, x, ord) AS VARCHAR) AS n, 'precedes_in_reading_order' FROM ta) WHERE n IS NOT NULL""",
    "layout_words": f"""WITH {ELEMENTS_SQL}, {STYLED_SQL}, l AS (SELECT {_PAGE}, ord, {_LABEL} AS label, CASE WHEN (y + height / 2) / 6858000 < 0.2 THEN 'top' WHEN (y + height / 2) / 6858000 > 0.8 THEN 'bottom'
  WHEN (x + width / 2) / 12192000 < 0.4 THEN 'left' WHEN (x + width / 2) / 12192000 > 0.6 THEN 'right' ELSE 'center' END AS region FROM st WHERE element_type NOT IN ('arrow', 'connector')),
p AS (SELECT {_PAGE}, region, string_agg(label, '; ' ORDER BY ord) AS items FROM l WHERE NOT starts_with(label, '[') GROUP BY {_PAGE}, region)
SELECT {_PAGE}, string_agg(upper(region[1]) || region[2:] || ' section: ' || items, '; ' ORDER BY list_position(['left', 'right', 'top', 'bottom', 'center'], region)) AS layout FROM p GROUP BY {_PAGE}""",
    "location_texts": f"""WITH {ELEMENTS_SQL}, {STYLED_SQL}, rc AS (SELECT {_PAGE}, greatest(12192000.0, max(x + width)) AS cw, greatest(6858000.0, max(y + height)) AS ch FROM st GROUP BY {_PAGE})
SELECT {_PAGE}, element_id, 'Element ''' || element_id || ''' (' || element_type || ') is positioned at: left: ' || printf('%.1f', CAST(round_even(CAST(CAST(x / cw * 100 AS VARCHAR) AS DECIMAL(38, 20)), 1) AS DOUBLE)) || '%, top: ' || printf('%.1f', CAST(round_even(CAST(CAST(y / ch * 100 AS VARCHAR) AS DECIMAL(38, 20)), 1) AS DOUBLE)) || '%, width: ' || printf('%.1f', CAST(round_even(CAST(CAST(width / cw * 100 AS VARCHAR) AS DECIMAL(38, 20)), 1) AS DOUBLE)) ||
  '%, height: ' || printf('%.1f', CAST(round_even(CAST(CAST(height / ch * 100 AS VARCHAR) AS DECIMAL(38, 20)), 1) AS DOUBLE)) || '%' AS location, 'ID: ' || element_id || ' | Type: ' || element_type || CASE WHEN coalesce(text, '') <> '' THEN ' | Text content: ''' || replace({_TRIM('text')}, chr(10), ' ') || '''' ELSE '' END ||
  CASE WHEN coalesce(fill_color, '') <> '' THEN ' | Background color: ' || fill_color ELSE '' END || CASE WHEN coalesce(text_color, '') <> '' THEN ' | Text color: ' || text_color ELSE '' END AS inventory FROM st JOIN rc USING ({_PAGE})""",
    "containment_forest": f"""WITH RECURSIVE {ELEMENTS_SQL}, {STYLED_SQL}, bx AS (SELECT * FROM st WHERE element_type NOT IN ('connector', 'arrow')), {_EDGES},
up AS (SELECT {_PAGE}, target_element_id AS child, max(source_element_id) AS parent FROM edges WHERE relationship_type = 'contains' GROUP BY ALL),
cl AS (SELECT {_PAGE}, element_id, element_id AS root, CAST(0 AS BIGINT) AS level FROM bx
  UNION ALL SELECT cl.document_id, cl.slide_number, cl.element_id, up.parent, level + 1 FROM cl JOIN up ON up.document_id = cl.document_id AND up.slide_number = cl.slide_number AND up.child = cl.root)
SELECT {_PAGE}, element_id, arg_max(root, level) AS root, max(level) AS level FROM cl GROUP BY ALL""",
    "process_summary": f"""WITH RECURSIVE {_REL}, {_BOX}, {_BOTH}, {kahn("bo", "(SELECT document_id, slide_number, source, target FROM be)")}
SELECT {_PAGE}, 'Process flow: ' || string_agg(label, ' -> ' ORDER BY position, label) AS summary FROM od JOIN lb USING ({_PAGE}, element_id) GROUP BY {_PAGE} HAVING count(*) >= 2""",
}
