"""Queries of the rule classifiers, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import classify, forms, spatial
from quire.plans.content_queries import read
from quire.plans.form_queries import ORACLES as FORMS
from quire.plans.page_queries import ORACLES as PAGES
from quire.sources.elements import ELEMENTS_SQL, elements_from_events


def page_archetype(spark, sf_dir):
    """Pages of the events, titled by integer arithmetic."""
    title = F.expr("element_at(array('Agenda', 'Governance', 'Process flow', 'Road map', 'Roadmap', 'Matrix', 'Next steps', 'Opportunity', null), cast(slide_number % 9 + 1 as int))")
    e = elements_from_events(spark, sf_dir)
    kind = lambda t: F.count_if(F.expr(f"element_type = '{t}'"))
    return classify.page_archetype(e.groupBy("document_id", "slide_number").agg(kind("image").alias("charts"), kind("table").alias("tables")).withColumn("title", title))


def page_complexity(spark, sf_dir):
    e = elements_from_events(spark, sf_dir)
    return classify.complexity(e, spatial.connector_targets(e))


def color_meaning(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.format_string("#%06x", F.expr("cast(p_partkey * 7919 % 16777216 as int)")).alias("color"))
    return classify.color_meaning(forms.color_profile(p))


def pixel_class(spark, sf_dir):
    return classify.pixel_class(elements_from_events(spark, sf_dir), 1280.0, 720.0)


def text_rules(spark, sf_dir):
    """Rules on single texts, here the lines of the documents and a few short ones: what is rewritten, ticked boxes, chart types."""
    short = F.expr("""element_at(array('$1.35M', '45%', ' ok', 'note it', '[x]', ' [ ]', 'Pie of ', 'Trend ', 'stacked', null), cast(o_orderkey % 10 + 1 as int))""")
    lines = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("t")).unionByName(read(spark, sf_dir, "orders").select(short.alias("t")))
    rules = [classify.rewritable(F.col("t")).alias("rewritable"), classify.tick_state(F.col("t")).alias("ticked"), classify.chart_type(F.col("t")).alias("chart_type")]
    return lines.groupBy("t").agg(F.count("*").alias("n")).select(F.sha2(F.coalesce("t", F.lit("null")), 256).alias("line"), *rules, "n")


QUERIES = {f.__name__: f for f in (page_archetype, page_complexity, color_meaning, pixel_class, text_rules)}

_TARGETS = PAGES["connector_targets"]

ORACLES = {
    "page_archetype": f"""WITH {ELEMENTS_SQL}, c AS (SELECT document_id, slide_number, count(*) FILTER (element_type = 'image') AS charts, count(*) FILTER (element_type = 'table') AS tables FROM el GROUP BY 1, 2),
t AS (SELECT *, lower(coalesce(['Agenda', 'Governance', 'Process flow', 'Road map', 'Roadmap', 'Matrix', 'Next steps', 'Opportunity', NULL][slide_number % 9 + 1], '')) AS t FROM c)
SELECT document_id, slide_number, CASE WHEN regexp_matches(t, 'agenda|contents') THEN 'agenda_slide' WHEN slide_number = 1 THEN 'title_slide' WHEN regexp_matches(t, 'capability|maturity|framework') THEN 'capability_map'
  WHEN regexp_matches(t, 'governance|committee|structure|reporting') THEN 'governance_model' WHEN regexp_matches(t, 'operating model|target state') THEN 'operating_model' WHEN regexp_matches(t, 'process|flow|workflow|step') THEN 'process_flow'
  WHEN regexp_matches(t, 'roadmap|timeline|horizon|plan') THEN 'roadmap' WHEN regexp_matches(t, 'dashboard|kpi|metrics|status') THEN 'dashboard_slide' WHEN regexp_matches(t, 'scorecard|assessment') THEN 'scorecard_slide'
  WHEN charts > 0 THEN 'dashboard_slide' WHEN tables > 0 AND regexp_matches(t, 'matrix|comparison') THEN 'matrix_slide' WHEN tables > 0 THEN 'table-centric_slide'
  WHEN regexp_matches(t, 'executive summary|key observations') THEN 'executive_summary' WHEN regexp_matches(t, 'recommendation|next steps|opportunity') THEN 'recommendation_slide' ELSE 'hybrid_slide' END AS archetype FROM t""",
    "page_complexity": f"""WITH t AS ({_TARGETS}), {ELEMENTS_SQL}, n AS (SELECT document_id, slide_number, count(*) AS n_elements FROM el GROUP BY 1, 2),
k AS (SELECT document_id, slide_number, count(*) AS k FROM t GROUP BY 1, 2), j AS (SELECT n.*, coalesce(k, 0) AS n_edges FROM n LEFT JOIN k USING (document_id, slide_number))
SELECT *, CASE WHEN n_elements <= 3 AND n_edges = 0 THEN 'low' WHEN n_elements <= 8 AND n_edges <= 3 THEN 'medium' ELSE 'high' END AS complexity FROM j""",
    "color_meaning": f"""SELECT *, CASE WHEN r > 200 AND g < 100 AND b < 100 THEN 'Red' WHEN g > 200 AND r < 100 AND b < 100 THEN 'Green' WHEN b > 200 AND r < 100 AND g < 100 THEN 'Blue'
  WHEN r > 200 AND g > 200 AND b < 100 THEN 'Yellow' WHEN r > 200 AND b > 200 AND g < 100 THEN 'Magenta' WHEN g > 200 AND b > 200 AND r < 100 THEN 'Cyan' WHEN r < 50 AND g < 50 AND b < 50 THEN 'Black'
  WHEN r > 200 AND g > 200 AND b > 200 THEN 'White' ELSE 'Custom' END AS name, CASE WHEN light > 240000 THEN 'background' WHEN light < 30000 THEN 'text' ELSE 'series_mapping' END AS purpose FROM ({FORMS["color_profile"]})""",
    "pixel_class": f"""WITH {ELEMENTS_SQL}, p AS (SELECT document_id, slide_number, element_id, floor(width / 9525.0) AS w, floor(height / 9525.0) AS h FROM el)
SELECT document_id, slide_number, element_id, CASE WHEN h <= 4 OR w <= 4 OR w / greatest(h, 1) > 12 OR w / greatest(h, 1) < 0.08 THEN 'line' WHEN w * h > 0.04 * 1280 * 720 THEN 'panel'
  WHEN greatest(w, h) < 0.08 * 1280 THEN 'pixel_icon' ELSE 'rect' END AS pixel_class FROM p""",
    "text_rules": """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS t FROM documents UNION ALL SELECT (['$1.35M', '45%', ' ok', 'note it', '[x]', ' [ ]', 'Pie of ', 'Trend ', 'stacked', NULL])[o_orderkey % 10 + 1] FROM orders),
g AS (SELECT t, count(*) AS n, trim(coalesce(t, '')) AS c, lower(coalesce(t, '')) AS low FROM l GROUP BY t)
SELECT sha256(coalesce(t, 'null')) AS line, length(c) > 2 AND NOT regexp_matches(trim(translate(c, '$%,.MK', '')), '^[0-9]+$') AS rewritable, CASE WHEN c IN ('[ ]', '[]', '☐') THEN false WHEN c IN ('[x]', '[X]', '☑', '☒') THEN true END AS ticked,
  CASE WHEN contains(low, 'pie') THEN 'pie_chart' WHEN regexp_matches(low, 'line|trend|forecast') THEN 'line_chart' WHEN contains(low, 'scatter') THEN 'scatter_plot' WHEN contains(low, 'stacked') THEN 'stacked_bar_chart' ELSE 'bar_chart' END AS chart_type, n FROM g""",
}
