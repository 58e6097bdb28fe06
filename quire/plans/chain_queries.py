"""Queries over fallback chains and contexts of pages, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import chains, flows
from quire.plans import flow_queries, page_queries
from quire.sources.elements import ELEMENTS_SQL, PAGE, STYLED_SQL, styled_elements

_PAGE = "document_id, slide_number"


def _pages(spark, sf_dir):
    """Pages of nine classes, each with what one step of the chain needs."""
    one = lambda k, text: f"when {k} then '{text}'"
    given = {
        "title": "if(slide_number % 2 = 0, concat('Page ', slide_number), null)", "plain": f"case slide_number % 9 {one(0, 'Sales grow. More of it.')} {one(3, '  ')} end",
        "flow_section": f"case slide_number % 9 {one(1, '- Notes' + chr(92) + 'n- Flow sequence: a, b')} {one(2, 'x' + chr(92) + 'n Step 1: [Start] --> [End]')} {one(3, 'Reading order:' + chr(92) + 'nnothing')} end",
        "flow_description": f"case slide_number % 9 {one(5, 'Step 1: Open → Step 2: Close → Step 3:  Lock ')} {one(6, 'It just flows')} end",
        "summaries": f"case slide_number % 9 {one(7, 'An Agent acts')} end", "interpretation": f"case slide_number % 9 {one(8, ' It means much. Or not')} end",
    }
    return styled_elements(spark, sf_dir).select(*PAGE).distinct().selectExpr(*PAGE, *(f"{e} as {c}" for c, e in given.items()))


def overall_flow(spark, sf_dir):
    e = styled_elements(spark, sf_dir)
    order = e.where("slide_number % 9 = 4 and element_type = 'text_box'").select(*PAGE, "element_id", F.col("ord").alias("position"))
    return chains.overall_flow(_pages(spark, sf_dir), e, order)


def page_contexts(spark, sf_dir):
    e = styled_elements(spark, sf_dir)
    r = flow_queries._relations(spark, sf_dir)
    regions = page_queries.QUERIES["region_by_element"](spark, sf_dir).select(*PAGE, "element_id", "region")
    c = chains.page_contexts(e, r.select(*PAGE, "source_element_id", "target_element_id", "label"), regions, flows.flowchart(e, r), _pages(spark, sf_dir))
    return c.select(*PAGE, F.length("context").alias("characters"), F.explode(F.split("context", "\n")).alias("line")).groupBy(*PAGE, "characters", "line").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (overall_flow, page_contexts)}

_LABEL = flow_queries._LABEL
_PCT = lambda c, total: f"printf('%.1f', round_even(100 * {c} / {total}, 1)) || '%'"

ORACLES = {
    "overall_flow": f"""WITH {ELEMENTS_SQL}, {STYLED_SQL}, pg AS (SELECT DISTINCT {_PAGE}, slide_number % 9 AS k FROM st), lb AS (SELECT {_PAGE}, element_id, ord, element_type, {_LABEL} AS label FROM st),
r AS (SELECT {_PAGE}, arg_min(label, ord) AS a, arg_max(label, ord) AS z, count(*) AS n FROM lb WHERE slide_number % 9 = 4 AND element_type = 'text_box' AND NOT starts_with(label, '[') GROUP BY ALL),
s AS (SELECT {_PAGE}, bool_or(regexp_matches(lower(label), '{chains.ABSTRACT}')) AS ab FROM lb GROUP BY ALL),
q AS (SELECT {_PAGE}, CASE k WHEN 0 THEN 'The slide shows sales grow.' WHEN 1 THEN 'The slide shows the process flow: a, b' WHEN 2 THEN 'The slide shows a progression from Start → End' WHEN 5 THEN 'The slide shows a progression from Open → Lock' WHEN 6 THEN 'It just flows'
  ELSE CASE WHEN n >= 2 THEN 'The slide shows a progression from ' || a || ' → ' || z WHEN n = 1 THEN 'The slide focuses on ' || a || '.' WHEN ab OR k = 7 THEN '{chains.TRANSFORMATION}' WHEN k = 8 THEN 'It means much.'
    ELSE 'The slide presents and explains ' || CASE WHEN slide_number % 2 = 0 THEN 'Page ' || slide_number ELSE 'the slide content' END || '.' END END AS flow,
  CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 5 THEN 4 WHEN 6 THEN 5 ELSE CASE WHEN n >= 1 THEN 3 WHEN ab OR k = 7 THEN 6 WHEN k = 8 THEN 7 ELSE 8 END END AS step
  FROM pg LEFT JOIN r USING ({_PAGE}) LEFT JOIN s USING ({_PAGE})) SELECT * FROM q""",
    "page_contexts": f"""WITH {flow_queries._REL}, fc AS ({flow_queries.ORACLES["flowchart_pages"]}), rg AS ({page_queries.ORACLES["region_by_element"]}),
l AS (SELECT {_PAGE}, 1 AS no, 0 AS a, 0 AS b, CASE slide_number % 9 WHEN 5 THEN 'Step 1: Open → Step 2: Close → Step 3:  Lock ' ELSE 'It just flows' END AS line FROM (SELECT DISTINCT {_PAGE} FROM st) WHERE slide_number % 9 IN (5, 6)
  UNION ALL SELECT {_PAGE}, 2, 0, 0, 'Flowchart: ' || boxes || ' box(es), ' || arrows || ' arrow(s)' FROM fc WHERE is_flowchart
  UNION ALL SELECT {_PAGE}, 3, row_number() OVER (PARTITION BY {_PAGE} ORDER BY region), 0, '  Region ''' || region || ''': ' || count(*) || ' element(s)' FROM rg GROUP BY {_PAGE}, region
  UNION ALL SELECT {_PAGE}, 4, source, target, '  "' || f || '" → "' || t || '"' || CASE WHEN coalesce(label, '') <> '' THEN ' [connector label: ' || label || ']' ELSE '' END FROM rn
  UNION ALL SELECT {_PAGE}, 5, st.ord, 0, '  - [' || element_type || '] "' || label || '"' || CASE WHEN coalesce(fill_color, '') <> '' THEN chr(10) || '    fill: ' || fill_color ELSE '' END
    || CASE WHEN coalesce(text_color, '') <> '' THEN chr(10) || '    text colour: ' || text_color ELSE '' END
    || CASE WHEN coalesce(font_family, '') <> '' THEN chr(10) || '    font: ' || font_family || CASE WHEN font_size > 0 THEN ' ' || font_size || 'pt' ELSE '' END ELSE '' END || CASE WHEN bold THEN chr(10) || '    bold: yes' ELSE '' END
    || CASE WHEN coalesce(shape_type, '') <> '' THEN chr(10) || '    shape: ' || shape_type ELSE '' END || chr(10) || '    position: left ' || {_PCT("x", "12192000.0")} || ', top ' || {_PCT("y", "6858000.0")}
    || ', width ' || {_PCT("width", "12192000.0")} || ', height ' || {_PCT("height", "6858000.0")} FROM st JOIN lb USING ({_PAGE}, element_id) WHERE element_type NOT IN ('arrow', 'connector')),
s AS (SELECT {_PAGE}, no, '--- ' || ([{', '.join(f"'{h}'" for h in chains.HEADS)}])[no] || ' ---' || chr(10) || string_agg(line, chr(10) ORDER BY a, b, line) AS t FROM l GROUP BY {_PAGE}, no),
c AS (SELECT {_PAGE}, string_agg(t, chr(10) || chr(10) ORDER BY no) AS c FROM s GROUP BY {_PAGE})
SELECT {_PAGE}, CAST(length(c) AS INT) AS characters, line, count(*) AS n FROM (SELECT *, unnest(string_split(c, chr(10))) AS line FROM c) GROUP BY ALL""",
}
