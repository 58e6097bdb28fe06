"""Queries of facts about pages, texts and colours, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import naming
from quire.operators import classify, flows, pagefacts
from quire.plans.content_queries import read
from quire.sources.elements import ELEMENTS_SQL, PAGE, STYLED_SQL, styled_elements

_PAGE = "document_id, slide_number"
TITLES = ("Agenda", "Executive summary", "Roadmap and next steps", "Results vs plan", "Overview of goals", None, "Appendix A", "Key metrics", "Team")


def _pick(values, key: str) -> str:
    return f"element_at(array({', '.join('null' if v is None else repr(v) for v in values)}), cast({key} % {len(values)} as int) + 1)"


def _titles(spark, sf_dir):
    return styled_elements(spark, sf_dir).select(*PAGE).distinct().withColumn("title", F.expr(_pick(TITLES, "slide_number")))


def inventory_by_page(spark, sf_dir):
    return pagefacts.full_inventory(styled_elements(spark, sf_dir))


def layout_type_by_page(spark, sf_dir):
    return pagefacts.layout_by_content(styled_elements(spark, sf_dir))


def _named(spark, sf_dir):
    return styled_elements(spark, sf_dir).withColumn("name", F.expr("element_at(array('Picture 1', 'Donut 2', 'Table 3', null), cast(ord % 4 as int) + 1)"))


def visual_class(spark, sf_dir):
    return pagefacts.visual_class(_named(spark, sf_dir))


def chart_test(spark, sf_dir):
    e = _named(spark, sf_dir)
    texts = "case ord % 7 when 1 then 'A chart showing the trend of 45% growth' when 3 then 'Pie: survey results with 12% and more' when 5 then 'call phone: 12% market share %' else text end"
    seen = pagefacts.visual_class(e).select(*PAGE, "element_id", "visual_class")
    facts = {"text": texts, "contains_bars": "ord % 11 = 0", "contains_axes": "if(ord % 22 = 0, true, null)", "given_type": "if(ord % 31 = 0, 'radar', '')", "stacked": "ord % 13 = 0", "legend_count": "cast(ord % 3 as int)",
             "orientation": "case ord % 5 when 0 then 'horizontal' when 1 then 'vertical' end"}
    return pagefacts.chart_test(e.join(seen, [*PAGE, "element_id"]).withColumns({k: F.expr(v) for k, v in facts.items()}))


def native_chart_types(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_type").distinct().select("p_type", pagefacts.native_chart_type(F.regexp_replace("p_type", "^[A-Z]+ ([A-Z])", "LINE $1")).alias("chart_type"))


def archetype_confidence(spark, sf_dir):
    counts = styled_elements(spark, sf_dir).groupBy(*PAGE).agg(F.count_if(F.col("element_type") == "chart").alias("charts"), F.count_if(F.col("element_type") == "table").alias("tables"))
    pages = counts.join(_titles(spark, sf_dir), PAGE)
    a = classify.page_archetype(pages).join(pages.select(*PAGE, "title"), PAGE)
    return a.select(*PAGE, "archetype", pagefacts.archetype_confidence(F.col("archetype"), F.col("title")).alias("confidence"))


def _intents(spark, sf_dir):
    e = styled_elements(spark, sf_dir)
    pages = pagefacts.layout_by_content(e).join(_titles(spark, sf_dir), PAGE).withColumn("is_flowchart", F.expr("slide_number % 11 = 0"))
    return pagefacts.intent(pages.withColumn("layout_type", F.expr("if(slide_number % 13 = 0, 'title_slide', layout_type)")))


def page_intent(spark, sf_dir):
    return _intents(spark, sf_dir)


def document_structure(spark, sf_dir):
    return pagefacts.document_structure(_intents(spark, sf_dir), styled_elements(spark, sf_dir).where("document_id % 3 <> 0 or ord % 16 = 10"))


def slide_facts(spark, sf_dir):
    e = styled_elements(spark, sf_dir)
    n = F.count_if
    a = e.groupBy(*PAGE).agg(
        n(F.col("element_type") == "image").alias("images"), n(F.col("element_type") == "text_box").alias("text_boxes"), n(F.col("element_type") == "table").alias("tables"), n(F.col("element_type") == "chart").alias("charts"),
        n(F.coalesce("text", F.lit("")) != "").alias("texts"), F.countDistinct("fill_color").alias("colors"),
    )
    extra = {"is_flowchart": "slide_number % 7 = 0", "is_diagram": "if(slide_number % 5 = 0, true, null)", "images": "if(slide_number % 4 = 1, images, 0)", "text_boxes": "if(slide_number % 8 = 1, 1, text_boxes)", "tables": "if(slide_number % 6 = 2, tables, 0)",
             "charts": "if(slide_number % 6 = 3, charts, 0)", "texts": "if(slide_number % 9 = 4, 1, texts)", "colors": "if(slide_number % 2 = 0, colors, 1)",
             "summary": "if(slide_number % 3 = 0, ' Shows growth. And more.', null)", "flow": "element_at(array('Market and sales', 'An API for software', 'A study', null), cast(slide_number % 4 as int) + 1)"}
    return pagefacts.slide_facts(a.withColumns({k: F.expr(v) for k, v in extra.items()}))


def text_roles(spark, sf_dir):
    e = styled_elements(spark, sf_dir)
    regions = e.where("ord % 4 < 2").select(*PAGE, "element_id", F.expr("case when y < 900000 then 'header' when y > 5600000 then 'footer' else 'body_left' end").alias("region"))
    return pagefacts.text_roles(e, regions, _titles(spark, sf_dir))


def region_purpose(spark, sf_dir):
    from quire.operators import layout

    r = layout.regions(styled_elements(spark, sf_dir)).groupBy(*PAGE, "region").agg(F.count("*").alias("n"))
    return r.select(*PAGE, "region", "n", pagefacts.region_purpose(F.col("region")).alias("purpose"))


def header_footer(spark, sf_dir):
    e = styled_elements(spark, sf_dir).withColumn("text", F.expr("if(ord % 9 = 4, cast(ord % 50 as string), text)"))
    return pagefacts.header_footer(e).withColumn("mark", naming.confidentiality(F.col("footer")))


def furniture(spark, sf_dir):
    """Header and footer by placeholders, here every seventh element, and by place."""
    e = styled_elements(spark, sf_dir).withColumn("text", F.expr("if(ord % 9 = 4, cast(ord % 50 as string), text)"))
    placed = e.where("ord % 7 = 0 and slide_number % 3 <> 1").withColumns({"level": F.expr("ord % 3"), "type": F.expr("element_at(array('title', 'ftr', 'sldNum', 'dt', 'body'), cast(ord % 5 + 1 as int))"), "y": F.expr("y / 10")})
    return pagefacts.furniture(e, placed)


def image_roles(spark, sf_dir):
    e = styled_elements(spark, sf_dir).where("element_type = 'image'").withColumns({"width": F.expr("case ord % 3 when 0 then width / 10 when 1 then width * 20 else width end"), "height": F.expr("case ord % 3 when 0 then height / 10 when 1 then height * 20 else height end")})
    return e.select(*PAGE, "element_id", pagefacts.image_role(F.col("width"), F.col("height")).alias("role"))


def title_from_boxes(spark, sf_dir):
    return pagefacts.title_from_boxes(styled_elements(spark, sf_dir), 6_858_000.0)


def title_by_font(spark, sf_dir):
    return pagefacts.title_by_font(styled_elements(spark, sf_dir), 6_858_000.0)


def visual_hierarchy(spark, sf_dir):
    return pagefacts.visual_hierarchy(styled_elements(spark, sf_dir), _titles(spark, sf_dir))


def title_typography(spark, sf_dir):
    return pagefacts.title_typography(styled_elements(spark, sf_dir))


def color_usage(spark, sf_dir):
    return pagefacts.color_usage(styled_elements(spark, sf_dir))


def shape_counts(spark, sf_dir):
    return pagefacts.shape_counts(styled_elements(spark, sf_dir))


def text_points(spark, sf_dir):
    return pagefacts.text_points(styled_elements(spark, sf_dir))


def dashboard(spark, sf_dir):
    e = styled_elements(spark, sf_dir).withColumn("text", F.expr("case ord % 8 when 1 then ' 42.5 ' when 3 then '(7)' when 5 then '$3.5M' else text end"))
    return pagefacts.dashboard(e, _titles(spark, sf_dir))


def capability_map(spark, sf_dir):
    return pagefacts.capability_map(styled_elements(spark, sf_dir))


def process_sequence(spark, sf_dir):
    return pagefacts.process_sequence(styled_elements(spark, sf_dir))


def span_of_control(spark, sf_dir):
    return pagefacts.span_of_control(styled_elements(spark, sf_dir).withColumn("text", F.expr("case ord % 5 when 0 then concat('Layer ', ord % 3) when 2 then cast(ord % 40 as string) else text end")))


def payload_counts(spark, sf_dir):
    return pagefacts.payload_counts(styled_elements(spark, sf_dir))


def chart_groups(spark, sf_dir):
    return pagefacts.group_titles(styled_elements(spark, sf_dir))


def _colors(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.expr("cast(p_partkey * 7919 % 16777216 as int)").alias("v"))


def color_names(spark, sf_dir):
    p = _colors(spark, sf_dir).withColumn("given", F.expr(f"case p_partkey % 6 when 0 then {_pick(tuple(naming.COLORS), 'p_partkey div 6')} when 1 then '(1, 0.5, 0)' when 2 then '(10,20,30)' when 3 then '' when 4 then concat(upper(hex(v)), '') else concat('#abcdef', 'ff') end"))
    p = p.withColumn("hex", naming.hex_of_int(F.col("v"))).withColumn("shares", naming.hex_of_shares(F.col("v") % 3 / 2, F.col("v") % 5 / 4, F.col("v") % 9 / 8))
    return p.select("p_partkey", "given", "hex", "shares", naming.normal_color(F.col("given")).alias("normal"), naming.color_name(F.col("given")).alias("name"))


def color_clusters(spark, sf_dir):
    p = _colors(spark, sf_dir).select("p_brand", F.col("p_partkey").alias("ord"), F.format_string("#%02x%02x%02x", F.expr("cast(p_partkey * 37 % 128 as int)"), F.expr("cast(p_partkey * 11 % 64 as int)"), F.expr("cast(p_partkey % 32 as int)")).alias("color"))
    return naming.color_clusters(p, "p_brand")


def chart_colors(spark, sf_dir):
    p = _colors(spark, sf_dir)
    series = p.select("p_brand", F.concat(F.lit("s"), F.expr("p_partkey % 5")).alias("name"), F.expr("if(p_partkey % 3 = 0, '', concat('#', hex(v)))").alias("color"), F.col("p_partkey").alias("ord"))
    legend = p.select("p_brand").distinct().withColumn("label", F.lit("s1")).withColumn("color", F.lit("#111111"))
    return naming.chart_colors(series, legend, "p_brand")


def metric_texts(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]")).alias("word"))
    odd = read(spark, sf_dir, "part").select(F.expr("case p_partkey % 5 when 0 then concat('$', p_partkey % 90, '.5M') when 1 then concat('(', p_partkey, ')') when 2 then concat(p_partkey, '%') when 3 then concat(p_partkey, '.25') else concat('$', p_partkey, 'T') end").alias("word"))
    return words.unionByName(odd).where("word <> ''").groupBy(naming.is_metric(F.col("word")).alias("metric")).agg(F.count("*").alias("n"), F.countDistinct("word").alias("kinds"))


def chart_titles(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.expr("concat(case doc_id % 3 when 0 then 'The chart showing ' when 1 then 'A Figure of ' else 'Graph ' end, text)").alias("text"))
    return d.select("doc_id", naming.chart_title(F.col("text")).alias("title"))


def concepts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", naming.concept(F.col("text")).alias("concept"))


def cleaned_answers(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("""concat(case turn % 4 when 0 then '"Here is the rewritten text: ' when 1 then 'Sure, here is it:\n\n' when 2 then "'Rewritten text: " else '' end, text,
      case turn % 4 when 0 then '"' when 1 then ' Hope this helps.' when 2 then "'" else ' Let me know if you need anything else' end)""").alias("answer"))
    return c.select("conv_id", "turn", naming.clean_answer(F.col("answer")).alias("clean"))


def heading_sections(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.expr("concat(case turn % 4 when 0 then '## 1. Scene Overview' when 1 then '## 7. Text Elements' when 2 then '## Notes ' else 'plain' end, '\n', text)").alias("t")).alias("s"))
    texts = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]), "\n").alias("text"))
    return naming.heading_sections(texts, "conv_id")


def distributed_texts(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    texts = c.groupBy("conv_id").agg(F.max("text").alias("text"))
    return naming.distribute(texts, c.select("conv_id", F.col("turn").alias("ord"), F.expr("if(conv_id % 5 = 0, '', text)").alias("text")), "conv_id")


QUERIES = {
    f.__name__: f
    for f in (inventory_by_page, layout_type_by_page, visual_class, chart_test, native_chart_types, archetype_confidence, page_intent, document_structure, slide_facts, text_roles, region_purpose, header_footer, furniture, image_roles,
              title_from_boxes, title_by_font, visual_hierarchy, title_typography, color_usage, shape_counts, text_points, dashboard, capability_map, process_sequence, span_of_control, payload_counts, chart_groups, color_names,
              color_clusters, chart_colors, metric_texts, chart_titles, concepts, cleaned_answers, heading_sections, distributed_texts)
}

_ST = f"{ELEMENTS_SQL}, {STYLED_SQL}"
_TRIM = lambda c: rf"regexp_replace({c}, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')"
_T = _TRIM("coalesce(text, '')")
_LIST = lambda values: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"
_TITLES = f"ti AS (SELECT DISTINCT {_PAGE}, ({_LIST(TITLES)})[slide_number % {len(TITLES)} + 1] AS title FROM st)"
_RX = lambda c, words: f"regexp_matches({c}, '{'|'.join(words)}')"
_CASE = lambda key, values, default: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in values.items()) + f" ELSE '{default}' END"
_COUNT = lambda k: f"count(*) FILTER (element_type = '{k}')"
_NAMED = f"{_ST}, na AS (SELECT *, (['Picture 1', 'Donut 2', 'Table 3', NULL])[ord % 4 + 1] AS name, lower(coalesce(text, '')) AS t FROM st)"
_CLASS = f"""{_NAMED}, nb AS (SELECT *, lower(coalesce(name, '')) AS nm, length(regexp_replace(t, '[^%$]', '', 'g')) AS signs FROM na),
vc AS (SELECT {_PAGE}, element_id, element_type AS old, CASE WHEN element_type = 'image' AND ({_RX('nm', pagefacts.CHART_CUES)} OR signs > 2) THEN 'chart:0.8'
  WHEN element_type = 'image' AND ({_RX('t', pagefacts.CHART_CUES)} OR {_RX('nm', pagefacts.CHART_CUES)} OR (signs > 3 AND {_RX('t', ('percentage selecting', ' respondents ', 'agree'))})) THEN 'chart:0.9'
  WHEN (element_type = 'table' OR contains(t, 'table')) AND (signs >= 2 OR {_RX('t', ('percent', 'survey', 'axis', 'legend', 'series'))}) THEN 'chart:0.9' WHEN element_type = 'table' OR contains(t, 'table') THEN 'table:0.8'
  WHEN contains(t, 'dashboard') THEN 'dashboard:0.7' WHEN {_RX('t', ('diagram', 'flow'))} THEN 'diagram:0.7' ELSE 'mixed_content:0.5' END AS c FROM nb)"""
_INTENT = f"""{_ST}, {_TITLES}, pi AS (SELECT {_PAGE}, lower(coalesce(title, '')) AS t FROM ti),
lt AS (SELECT {_PAGE}, count(*) FILTER (element_type IN ('shape', 'text_box', 'placeholder', 'unknown')) >= 2 AND count(*) FILTER (element_type IN ('arrow', 'connector', 'freeform')) >= 1 AS fc,
  count(*) FILTER ({_T} <> '') <= 2 AND count(*) FILTER (element_type IN ('table', 'image')) = 0 AS ts FROM st GROUP BY {_PAGE}),
it AS (SELECT {_PAGE}, CASE WHEN slide_number % 11 = 0 THEN 'process_flow' WHEN slide_number % 13 = 0 OR (NOT fc AND ts) THEN 'cover_page' {' '.join(f"WHEN {_RX('t', w)} THEN '{n}'" for n, w in pagefacts.INTENTS)} ELSE 'findings' END AS intent
  FROM pi JOIN lt USING ({_PAGE})), se AS (SELECT *, {_CASE('intent', pagefacts.SECTIONS, 'Findings & Data Section')} AS section FROM it)"""
_CHARS = lambda c: f"[w FOR w IN regexp_split_to_array({c}, '\\s+') IF w <> '']"

def _cleaned() -> str:
    """The steps of the cleaning, one common table expression each."""
    quote = lambda t: t.replace("'", "''")
    parts, gap = "string_split(t, chr(10) || chr(10))", "chr(10) || chr(10)"
    inner, rest = _TRIM("substr(t, 2, length(t) - 2)"), _TRIM(f"array_to_string({parts}[2:], {gap})")
    unquoted = f"CASE WHEN length(t) > 1 AND regexp_matches(t, '(?s)^\".*\"$|^''.*''$') THEN {inner} ELSE t END"
    paragraph = f"CASE WHEN contains(t, {gap}) AND regexp_matches(lower({parts}[1]), 'here is|here''s|rewritten') THEN {rest} ELSE t END"
    drop = [rf"(?i)^\Q{w}\E\s*" for w in naming.BEFORE] + [rf"(?i){w}\.?$" for w in naming.AFTER]
    cut = [_TRIM(f"regexp_replace(t, '{quote(form)}', '', 'g')") for form in drop]
    steps = [f"s{k + 1} AS (SELECT conv_id, turn, {e} AS t FROM s{k})" for k, e in enumerate([unquoted, *cut, paragraph, unquoted])]
    before, after = ('"Here is the rewritten text: ', "Sure, here is it:\n\n", "'Rewritten text: ", ""), ('"', " Hope this helps.", "'", " Let me know if you need anything else")
    pick = lambda texts: "([" + ", ".join(" || chr(10) || ".join(f"'{quote(p)}'" for p in t.split("\n")) for t in texts) + "])[turn % 4 + 1]"
    given = _TRIM(f"coalesce({pick(before)} || text || {pick(after)}, '')")
    return f"WITH s0 AS (SELECT conv_id, turn, {given} AS t FROM conversations), {', '.join(steps)} SELECT conv_id, turn, t AS clean FROM s{len(steps)}"


ORACLES = {
    "inventory_by_page": f"""WITH {_ST}, n AS (SELECT {_PAGE}, count(*) AS total, {', '.join(f'{_COUNT(k)} AS {k}s' for k in pagefacts.COUNTED if k not in ('unknown', 'figure', 'icon'))},
  count(*) FILTER (element_type = 'unknown' OR element_type NOT IN {pagefacts.COUNTED}) AS unknowns, count(*) FILTER (element_type IN ('figure', 'smartart', 'diagram')) AS figures, 2 * {_COUNT('icon')} AS icons FROM st GROUP BY {_PAGE})
SELECT *, CASE WHEN tables > 0 THEN 'table_slide' WHEN charts > 0 THEN 'chart_slide' WHEN arrows + connectors > 3 THEN 'flowchart' WHEN images > 3 THEN 'image_heavy' ELSE 'general' END AS slide_type FROM n""",
    "layout_type_by_page": f"""WITH {_ST}, a AS (SELECT {_PAGE}, count(*) FILTER (element_type IN ('shape', 'text_box', 'placeholder', 'unknown')) AS boxes, count(*) FILTER (element_type IN ('arrow', 'connector', 'freeform')) AS arrows,
  count(*) FILTER ({_T} <> '') AS texts, count(*) FILTER (element_type IN ('table', 'image')) AS objects, count(*) FILTER (y + height / 2 BETWEEN 0.18 * 6858000 AND 0.85 * 6858000 AND x + width / 2 < 6096000) AS l,
  count(*) FILTER (y + height / 2 BETWEEN 0.18 * 6858000 AND 0.85 * 6858000 AND x + width / 2 >= 6096000) AS r, count(*) FILTER (element_type IN ('image', 'shape', 'chart')) AS figures FROM st GROUP BY {_PAGE})
SELECT {_PAGE}, CASE WHEN boxes >= 2 AND arrows >= 1 THEN 'flowchart' WHEN texts <= 2 AND objects = 0 THEN 'title_slide' WHEN l > 0 AND r > 0 THEN 'two_column' WHEN figures > texts THEN 'diagram' ELSE 'single_column' END AS layout_type FROM a""",
    "visual_class": f"WITH {_CLASS} SELECT {_PAGE}, element_id, split_part(c, ':', 1) AS visual_class, CAST(split_part(c, ':', 2) AS DOUBLE) AS confidence, CASE WHEN starts_with(c, 'chart') THEN 'chart' ELSE old END AS element_type FROM vc",
    "chart_test": f"""WITH {_CLASS}, f AS (SELECT na.document_id, na.slide_number, na.element_id, ord, lower(coalesce(CASE ord % 7 WHEN 1 THEN 'A chart showing the trend of 45% growth' WHEN 3 THEN 'Pie: survey results with 12% and more' WHEN 5 THEN 'call phone: 12% market share %' ELSE text END, '')) AS t,
  starts_with(c, 'chart') AS seen FROM na JOIN vc USING ({_PAGE}, element_id)),
g AS (SELECT *, seen OR (NOT {_RX('t', ('@', 'phone:'))} AND length(t) >= 20 AND (({_RX('t', pagefacts.CHART_PHRASES)} AND contains(t, '%') AND regexp_matches(t, '[0-9]')) OR ord % 22 = 0)) AS is_chart FROM f)
SELECT {_PAGE}, element_id, is_chart, CASE WHEN is_chart THEN CASE WHEN ord % 31 = 0 THEN 'radar' WHEN contains(t, 'pie') THEN 'pie_chart' WHEN {_RX('t', ('line', 'trend', 'forecast'))} THEN 'line_chart' WHEN contains(t, 'scatter') THEN 'scatter_plot'
  WHEN contains(t, 'stacked') OR ord % 13 = 0 THEN 'stacked_bar_chart' WHEN ord % 3 > 1 THEN 'grouped_bar_chart' WHEN ord % 5 = 0 THEN 'horizontal_bar_chart' WHEN ord % 5 = 1 THEN 'vertical_bar_chart' ELSE 'bar_chart' END END AS chart_type FROM g""",
    "native_chart_types": """WITH d AS (SELECT DISTINCT p_type, lower(regexp_replace(p_type, '^[A-Z]+ ([A-Z])', 'LINE \\1')) AS n FROM part)
SELECT p_type, CASE WHEN regexp_matches(n, 'bar|column') THEN 'bar_chart' WHEN contains(n, 'line') THEN 'line_chart' WHEN regexp_matches(n, 'pie|doughnut') THEN 'pie_chart' WHEN contains(n, 'stacked') THEN 'stacked_chart' ELSE 'bar_chart' END AS chart_type FROM d""",
    "archetype_confidence": f"""WITH {_ST}, {_TITLES}, c AS (SELECT {_PAGE}, {_COUNT('chart')} AS charts, {_COUNT('table')} AS tables FROM st GROUP BY {_PAGE}),
a AS (SELECT {_PAGE}, lower(coalesce(title, '')) AS t, charts, tables FROM ti JOIN c USING ({_PAGE})),
b AS (SELECT {_PAGE}, t, CASE {' '.join(f"WHEN {_RX('t', w)} THEN '{n}'" for n, w in classify.TITLE_FIRST)} WHEN slide_number = 1 THEN 'title_slide' {' '.join(f"WHEN {_RX('t', w)} THEN '{n}'" for n, w in classify.TITLE_WORDS)}
  WHEN charts > 0 THEN 'dashboard_slide' WHEN tables > 0 AND regexp_matches(t, 'matrix|comparison') THEN 'matrix_slide' WHEN tables > 0 THEN 'table-centric_slide' {' '.join(f"WHEN {_RX('t', w)} THEN '{n}'" for n, w in classify.TITLE_LAST)} ELSE 'hybrid_slide' END AS archetype FROM a)
SELECT {_PAGE}, archetype, CASE WHEN archetype = 'hybrid_slide' THEN 0.4 WHEN archetype = 'dashboard_slide' AND NOT regexp_matches(t, 'dashboard|kpi|metrics|status') THEN 0.6
  WHEN archetype IN ('agenda_slide', 'operating_model', 'roadmap', 'executive_summary', 'recommendation_slide') THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence FROM b""",
    "page_intent": f"WITH {_INTENT} SELECT * FROM se",
    "document_structure": f"""WITH {_INTENT}, w AS (SELECT document_id, bool_or({_RX("lower(coalesce(text, ''))", pagefacts.FINANCIAL)}) AS f, bool_or({_RX("lower(coalesce(text, ''))", pagefacts.CONSULTING)}) AS c,
  bool_or({_RX("lower(coalesce(text, ''))", pagefacts.RESEARCH)}) AS r FROM st WHERE document_id % 3 <> 0 OR ord % 16 = 10 GROUP BY document_id),
i AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY slide_number) AS idx, lag(section) OVER (PARTITION BY document_id ORDER BY slide_number) AS b FROM se),
u AS (SELECT *, sum(CASE WHEN b IS NOT DISTINCT FROM section THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY slide_number ROWS UNBOUNDED PRECEDING) AS run FROM i),
g AS (SELECT document_id, run, first(section) AS section, min(idx) AS a, max(idx) AS b FROM u GROUP BY document_id, run),
n AS (SELECT document_id, count(*) AS sections, string_agg('It features a ' || section || ' in ' || CASE WHEN a = b THEN 'Slide ' || a ELSE 'Slides ' || a || '-' || b END || '.', ' ' ORDER BY run) AS told FROM g GROUP BY document_id),
l AS (SELECT document_id, count(*) AS slides, coalesce(string_agg(CAST(slide_number AS VARCHAR), ',' ORDER BY slide_number) FILTER (intent = 'executive_summary'), '') AS summary_slides,
  coalesce(string_agg(CAST(slide_number AS VARCHAR), ',' ORDER BY slide_number) FILTER (intent IN ('findings', 'dashboard', 'comparison', 'research_report')), '') AS findings_slides,
  coalesce(string_agg(CAST(slide_number AS VARCHAR), ',' ORDER BY slide_number) FILTER (intent = 'recommendations'), '') AS recommendation_slides FROM se GROUP BY document_id),
m AS (SELECT l.*, sections, told, CASE WHEN f THEN 'Financial Audit Report' WHEN c THEN 'Consulting Report' WHEN r THEN 'Research Paper / Report' ELSE 'Enterprise Presentation' END AS role FROM l JOIN n USING (document_id) LEFT JOIN w USING (document_id))
SELECT document_id, role, slides, sections, summary_slides, findings_slides, recommendation_slides, 'This document is classified as a ' || role || ' consisting of ' || slides || ' slides. ' || told AS narrative FROM m""",
    "slide_facts": f"""WITH {_ST}, a AS (SELECT {_PAGE}, {_COUNT('image')} AS i, {_COUNT('text_box')} AS b, {_COUNT('table')} AS t, {_COUNT('chart')} AS c, count(*) FILTER (coalesce(text, '') <> '') AS n, count(DISTINCT fill_color) AS k FROM st GROUP BY {_PAGE}),
f AS (SELECT {_PAGE}, CASE WHEN slide_number % 7 = 0 THEN 'flowchart' WHEN slide_number % 5 = 0 THEN 'diagram' WHEN slide_number % 4 = 1 AND i > 0 AND (slide_number % 8 = 1 OR b <= 1) THEN 'image_slide' WHEN slide_number % 6 = 2 AND t > 0 THEN 'data_table'
  WHEN slide_number % 6 = 3 AND c > 0 THEN 'chart_slide' WHEN slide_number % 9 = 4 OR n <= 1 THEN 'title_slide' ELSE 'content_slide' END AS slide_type, k FROM a)
SELECT {_PAGE}, slide_type, {_CASE('slide_type', pagefacts.CATEGORIES, 'informational')} AS category, CASE WHEN slide_number % 7 = 0 THEN 'Illustrate a process or workflow through connected stages' WHEN slide_number % 5 = 0 THEN 'Visualize relationships between concepts or components'
  WHEN slide_number % 3 = 0 THEN 'Shows growth' ELSE 'Present information through visual and textual elements' END AS purpose, CASE WHEN slide_number % 7 = 0 THEN 'structured, analytical' WHEN slide_number % 5 = 0 THEN 'conceptual, educational' ELSE 'professional, informative' END AS mood,
  CASE WHEN slide_number % 2 = 0 AND k >= 2 THEN 'gradient' ELSE 'solid' END AS background, (['business', 'technology', 'academic', 'general'])[slide_number % 4 + 1] AS domain FROM f""",
    "text_roles": f"""WITH {_ST}, {_TITLES}, li AS (SELECT st.*, title, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM st LEFT JOIN ti USING ({_PAGE})),
l AS (SELECT *, {_TRIM('raw')} AS line, CASE WHEN ord % 4 < 2 THEN CASE WHEN y < 900000 THEN 'header' WHEN y > 5600000 THEN 'footer' ELSE 'body_left' END END AS region FROM li WHERE {_TRIM('raw')} <> ''),
r AS (SELECT *, CASE WHEN coalesce(title, '') <> '' AND lower(line) = lower(title) THEN 'title' WHEN region = 'header' THEN 'heading' WHEN region = 'footer' THEN 'footer' WHEN bold AND length(line) < 60 THEN 'heading' WHEN coalesce(font_size, 0) >= 18 AND length(line) < 80 THEN 'heading'
  WHEN length(line) < 30 AND contains(line, ':') THEN 'label' WHEN length(line) < 15 THEN 'badge' ELSE 'body' END AS role, len({_CHARS('line')}) AS words FROM l)
SELECT {_PAGE}, element_id, CAST(row_number() OVER (PARTITION BY {_PAGE}, element_id ORDER BY pos) AS INT) AS line_no, line AS text, role, CASE WHEN role IN ('title', 'heading', 'subheading') THEN 'professional' WHEN role = 'badge' THEN 'concise' WHEN role = 'footer' THEN 'neutral' ELSE 'instructional' END AS tone,
  {_CASE('role', pagefacts.TEXT_GOALS, 'Convey information to the reader')} AS goal, {_CASE('role', pagefacts.TEXT_INTENTS, 'Gain understanding of the detailed content and its implications')} AS intent, CAST(words AS INT) AS words, CAST(greatest(1, words // 12) AS INT) AS lines FROM r""",
    "region_purpose": f"""WITH {_ST}, r AS (SELECT {_PAGE}, CASE WHEN y + height / 2 < 0.18 * 6858000 THEN 'header' WHEN y + height / 2 > 0.85 * 6858000 THEN 'footer' WHEN x + width / 2 < 0.5 * 12192000 THEN 'body_left' ELSE 'body_right' END AS region FROM st)
SELECT {_PAGE}, region, count(*) AS n, {_CASE('region', dict(pagefacts.REGION_PURPOSES), '')} AS purpose FROM r GROUP BY ALL""",
    "furniture": f"""WITH {_ST}, t AS (SELECT {_PAGE}, ord, y, y + height AS low, {_TRIM("coalesce(CASE WHEN ord % 9 = 4 THEN CAST(ord % 50 AS VARCHAR) ELSE text END, '')")} AS t FROM st), u AS (SELECT * FROM t WHERE t <> ''),
p AS (SELECT {_PAGE}, arg_min(t, [ord % 3, ord]) FILTER (ord % 5 = 0 AND y / 10 < 500000) AS ph, arg_min(t, [ord % 3, ord]) FILTER (ord % 5 = 1) AS pf, arg_min(t, [ord % 3, ord]) FILTER (ord % 5 = 2) AS pn, arg_min(t, [ord % 3, ord]) FILTER (ord % 5 = 3) AS pd
  FROM u WHERE ord % 7 = 0 AND slide_number % 3 <> 1 GROUP BY {_PAGE}),
h AS (SELECT {_PAGE}, min(ord) FILTER (y < 820000) AS h, arg_min(t, ord) FILTER (y < 820000) AS header, arg_min(t, ord) FILTER (low > 6030000 AND regexp_matches(t, '^[0-9]+$')) AS n, arg_min(t, ord) FILTER (low > 6030000) AS lowest FROM u GROUP BY {_PAGE}),
f AS (SELECT u.document_id, u.slide_number, arg_min(t, ord) AS footer FROM u JOIN h USING ({_PAGE}) WHERE low > 6030000 AND ord IS DISTINCT FROM h GROUP BY ALL)
SELECT {_PAGE}, coalesce(ph, header) AS header, coalesce(pf, CASE WHEN ph IS NOT NULL THEN lowest ELSE footer END) AS footer, coalesce(pn, n) AS slide_number_text, pd AS date_text FROM (SELECT DISTINCT {_PAGE} FROM st) LEFT JOIN h USING ({_PAGE}) LEFT JOIN f USING ({_PAGE}) LEFT JOIN p USING ({_PAGE})""",
    "header_footer": f"""WITH {_ST}, t AS (SELECT {_PAGE}, ord, y, y + height AS low, {_TRIM("coalesce(CASE WHEN ord % 9 = 4 THEN CAST(ord % 50 AS VARCHAR) ELSE text END, '')")} AS t FROM st), u AS (SELECT * FROM t WHERE t <> ''),
h AS (SELECT {_PAGE}, min(ord) FILTER (y < 820000) AS h, arg_min(t, ord) FILTER (y < 820000) AS header, arg_min(t, ord) FILTER (low > 6030000 AND regexp_matches(t, '^[0-9]+$')) AS slide_number_text FROM u GROUP BY {_PAGE}),
f AS (SELECT u.document_id, u.slide_number, arg_min(t, ord) AS footer FROM u JOIN h USING ({_PAGE}) WHERE low > 6030000 AND ord IS DISTINCT FROM h GROUP BY ALL)
SELECT {_PAGE}, header, footer, slide_number_text, CASE {' '.join(f"WHEN contains(lower(footer), '{w}') THEN '{w}'" for w in naming.SECRETS)} END AS mark FROM h LEFT JOIN f USING ({_PAGE})""",
    "image_roles": f"""WITH {_ST}, i AS (SELECT {_PAGE}, element_id, CASE ord % 3 WHEN 0 THEN width / 10 WHEN 1 THEN width * 20 ELSE width END AS w, CASE ord % 3 WHEN 0 THEN height / 10 WHEN 1 THEN height * 20 ELSE height END AS h FROM st WHERE element_type = 'image')
SELECT {_PAGE}, element_id, CASE WHEN w * h / (12192000.0 * 6858000.0) > 0.8 THEN 'background' WHEN w / 12700 < 48 AND h / 12700 < 48 THEN 'icon' ELSE 'illustration' END AS role FROM i""",
    "title_from_boxes": f"""WITH {_ST}, b AS (SELECT *, {_T} AS t, y + height / 2 AS cy, len({_CHARS(_T)}) AS w FROM st),
c AS (SELECT *, height * 2 + width * 0.5 + (1 - cy / 6858000) * 100 + w * 10 AS s FROM b WHERE length(t) >= 3 AND cy <= 6858000 * 0.4 AND w >= 2 AND NOT regexp_matches(t, '^[$S5]?[0-9]'))
SELECT {_PAGE}, arg_max(t, (s, -ord)) AS title FROM c GROUP BY {_PAGE}""",
    "title_by_font": f"""WITH {_ST}, b AS (SELECT *, {_T} AS t, coalesce(font_size, 0) AS s FROM st WHERE {_T} <> '' AND y <= 0.75 * 6858000), c AS (SELECT * FROM b QUALIFY s >= 0.7 * max(s) OVER (PARTITION BY {_PAGE}))
SELECT {_PAGE}, replace(arg_min(t, (y, x, ord)), chr(10), ' ') AS title FROM c GROUP BY {_PAGE}""",
    "visual_hierarchy": f"""WITH {_ST}, {_TITLES}, e AS (SELECT st.*, coalesce(title, '') AS title FROM st LEFT JOIN ti USING ({_PAGE}) WHERE coalesce(text, '') <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY {_PAGE} ORDER BY width * height DESC, ord) AS rank FROM e WHERE {_TRIM('text')} <> {_TRIM('title')}),
s AS (SELECT {_PAGE}, max(element_type || ': ' || text) FILTER (rank = 1) AS secondary, string_agg(element_type || '(' || element_id || ')', ', ' ORDER BY rank) FILTER (rank BETWEEN 2 AND 4) AS tertiary FROM o GROUP BY {_PAGE}),
r AS (SELECT *, row_number() OVER (PARTITION BY {_PAGE} ORDER BY y, x, ord) AS place FROM e), a AS (SELECT {_PAGE}, string_agg(CAST(element_id AS VARCHAR), ' → ' ORDER BY place) AS attention FROM r WHERE place <= 6 GROUP BY {_PAGE})
SELECT {_PAGE}, CASE WHEN max(title) <> '' THEN 'Title: ' || max(title) ELSE '' END AS "primary", coalesce(max(secondary), '') AS secondary, coalesce(max(tertiary), '') AS tertiary, coalesce(max(attention), '') AS attention
FROM e LEFT JOIN s USING ({_PAGE}) LEFT JOIN a USING ({_PAGE}) GROUP BY {_PAGE}""",
    "title_typography": f"""WITH {_ST}, p AS (SELECT {_PAGE}, ord, coalesce(text, '') <> '' AND (bold OR coalesce(font_size, 0) >= 18) AS is_t, NOT (bold AND coalesce(font_size, 0) >= 18) AND (coalesce(font_family, '') <> '' OR coalesce(font_size, 0) > 0) AS is_b,
  concat_ws(', ', 'font: ' || font_family, 'size: ' || printf('%.1f', font_size) || 'pt', CASE WHEN bold THEN 'bold' END, 'color: ' || text_color) AS t, concat_ws(', ', 'font: ' || font_family, 'size: ' || printf('%.1f', font_size) || 'pt', 'color: ' || text_color) AS b FROM st)
SELECT {_PAGE}, coalesce(nullif(arg_min(t, ord) FILTER (is_t), ''), 'default title typography') AS title_style, coalesce(arg_min(b, ord) FILTER (is_b), 'default body typography') AS body_style FROM p GROUP BY {_PAGE}""",
    "color_usage": f"""WITH {_ST}, c AS (SELECT {_PAGE}, fill_color AS color, ord, coalesce(nullif(substr(replace(trim(coalesce(text, '')), chr(10), ' '), 1, 50), ''), CAST(element_id AS VARCHAR)) AS label,
  row_number() OVER (PARTITION BY {_PAGE}, fill_color ORDER BY ord) AS k FROM st WHERE fill_color <> '') SELECT {_PAGE}, color, string_agg('''' || label || '''', ', ' ORDER BY ord) FILTER (k <= 4) AS used_for, count(*) AS n FROM c GROUP BY {_PAGE}, color""",
    "shape_counts": f"WITH {_ST} SELECT {_PAGE}, coalesce(shape_type, element_type) AS shape, count(*) AS n FROM st GROUP BY ALL",
    "text_points": f"""WITH {_ST}, l AS (SELECT {_PAGE}, element_id, y, x, ord, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM st)
SELECT {_PAGE}, element_id, CAST(row_number() OVER (PARTITION BY {_PAGE} ORDER BY y, x, ord, pos) AS INT) AS point_no, {_TRIM('raw')} AS text FROM l WHERE {_TRIM('raw')} <> ''""",
    "dashboard": rf"""WITH {_ST}, {_TITLES}, e AS (SELECT st.* REPLACE (CASE ord % 8 WHEN 1 THEN ' 42.5 ' WHEN 3 THEN '(7)' WHEN 5 THEN '$3.5M' ELSE text END AS text), title FROM st LEFT JOIN ti USING ({_PAGE})),
g AS (SELECT {_PAGE} FROM e GROUP BY {_PAGE} HAVING bool_or(contains(lower(coalesce(text, '')), 'dashboard') OR contains(lower(coalesce(title, '')), 'dashboard')) OR count(*) FILTER (element_type = 'chart') >= 2), k AS (SELECT e.* FROM e JOIN g USING ({_PAGE}))
SELECT {_PAGE}, element_id, 'panel' AS kind, coalesce(text, 'Panel') AS value FROM k WHERE element_type IN ('chart', 'table') OR (element_type = 'shape' AND width > 2000000)
UNION ALL SELECT {_PAGE}, element_id, 'metric', {_TRIM('text')} FROM k WHERE regexp_matches({_TRIM("coalesce(text, '')")}, '^([0-9]+(\.[0-9]+)?|\([0-9]+\)|\$[0-9]+(\.[0-9]+)?[KM]?)$')""",
    "capability_map": f"""WITH {_ST}, k AS (SELECT *, CASE WHEN element_type = 'shape' AND width > 2000000 THEN 'domain' WHEN element_type IN ('text_box', 'shape') AND width <= 2000000 THEN 'capability' END AS kind FROM st)
SELECT {_PAGE}, element_id, kind, coalesce(nullif(text, ''), CASE kind WHEN 'domain' THEN 'Domain' ELSE 'Capability' END) AS name FROM k WHERE kind IS NOT NULL""",
    "process_sequence": f"WITH {_ST} SELECT {_PAGE}, string_agg(CAST(element_id AS VARCHAR), ',' ORDER BY x, ord) AS sequence FROM st WHERE element_type IN ('text_box', 'shape') GROUP BY {_PAGE}",
    "span_of_control": f"""WITH {_ST}, e AS (SELECT * REPLACE (CASE ord % 5 WHEN 0 THEN 'Layer ' || (ord % 3) WHEN 2 THEN CAST(ord % 40 AS VARCHAR) ELSE text END AS text) FROM st WHERE element_type IN ('text_box', 'shape')), l AS (SELECT * FROM e WHERE contains(lower(text), 'layer')),
f AS (SELECT *, {_TRIM('text')} AS v FROM e WHERE NOT contains(lower(text), 'layer') AND regexp_matches(text, '[0-9]'))
SELECT l.document_id, l.slide_number, l.element_id AS layer_id, l.text AS layer, coalesce(string_agg(v, ',' ORDER BY f.y, f.ord) FILTER (abs(l.y - f.y) < 500000), '') AS data FROM l LEFT JOIN f ON l.document_id = f.document_id AND l.slide_number = f.slide_number GROUP BY ALL""",
    "payload_counts": f"""WITH {_ST}, k AS (SELECT {_PAGE}, element_type, count(*) AS n FROM st GROUP BY ALL), t AS (SELECT {_PAGE}, string_agg(element_type || '=' || n, ',' ORDER BY element_type) AS types FROM k GROUP BY {_PAGE})
SELECT {_PAGE}, count(*) AS n, count(*) FILTER ({_T} <> '') AS with_text, count(*) FILTER (font_size IS NOT NULL OR fill_color IS NOT NULL) AS with_style, count(*) FILTER (width > 0 AND height > 0) AS placed, first(types) AS types FROM st JOIN t USING ({_PAGE}) GROUP BY {_PAGE}""",
    "color_names": f"""WITH c AS (SELECT p_partkey, p_partkey * 7919 % 16777216 AS v FROM part), g AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN ({_LIST(naming.COLORS)})[(p_partkey // 6) % {len(naming.COLORS)} + 1] WHEN 1 THEN '(1, 0.5, 0)' WHEN 2 THEN '(10,20,30)' WHEN 3 THEN ''
  WHEN 4 THEN printf('%X', v) ELSE '#abcdefff' END AS given FROM c)
SELECT p_partkey, given, printf('#%06x', v) AS hex, '#' || printf('%02x', CAST(floor(v % 3 / 2 * 255) AS INT)) || printf('%02x', CAST(floor(v % 5 / 4 * 255) AS INT)) || printf('%02x', CAST(floor(v % 9 / 8 * 255) AS INT)) AS shares,
  CASE p_partkey % 6 WHEN 1 THEN '#ff7f00' WHEN 2 THEN '#0a141e' WHEN 3 THEN '#000000' WHEN 5 THEN '#abcdef' ELSE given END AS normal, CASE p_partkey % 6 WHEN 0 THEN {_CASE('given', naming.COLORS, '')} || ' (' || given || ')' ELSE given END AS name FROM g""",
    "chart_colors": """WITH s AS (SELECT p_brand, 's' || (p_partkey % 5) AS label, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '#' || printf('%X', p_partkey * 7919 % 16777216) END AS color, p_partkey FROM part)
SELECT DISTINCT p_brand, 's1' AS label, '#111111' AS color FROM part UNION ALL SELECT p_brand, label, arg_min(color, p_partkey) FROM s WHERE color <> '' AND label <> 's1' GROUP BY p_brand, label""",
    "metric_texts": rf"""WITH w AS (SELECT unnest(regexp_split_to_array(text, '[ \n]')) AS word FROM documents UNION ALL SELECT CASE p_partkey % 5 WHEN 0 THEN '$' || (p_partkey % 90) || '.5M' WHEN 1 THEN '(' || p_partkey || ')' WHEN 2 THEN p_partkey || '%' WHEN 3 THEN p_partkey || '.25' ELSE '$' || p_partkey || 'T' END FROM part)
SELECT regexp_matches({_TRIM('word')}, '^([0-9]+(\.[0-9]+)?|\([0-9]+\)|\$[0-9]+(\.[0-9]+)?[KM]?)$') AS metric, count(*) AS n, count(DISTINCT word) AS kinds FROM w WHERE word <> '' GROUP BY 1""",
    "chart_titles": rf"""WITH d AS (SELECT doc_id, lower((['The chart showing ', 'A Figure of ', 'Graph '])[doc_id % 3 + 1] || text) AS t FROM documents),
x AS (SELECT doc_id, regexp_matches(t, '(?:chart|figure|graph)(?:\s+showing|\s+of)?\s+([^.\n]+)') AS m, {_TRIM("regexp_extract(t, '(?:chart|figure|graph)(?:" + chr(92) + "s+showing|" + chr(92) + "s+of)?" + chr(92) + "s+([^." + chr(92) + "n]+)', 1)")} AS t FROM d)
SELECT doc_id, CASE WHEN m THEN upper(substr(t, 1, 1)) || substr(t, 2) END AS title FROM x""",
    "concepts": f"SELECT doc_id, CASE WHEN length(text) > 80 THEN array_to_string(({_CHARS('text')})[1:8], ' ') || '...' ELSE text END AS concept FROM documents",
    "distributed_texts": """WITH t AS (SELECT conv_id, max(text) AS new FROM conversations GROUP BY conv_id), r AS (SELECT conv_id, turn AS ord, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE length(coalesce(text, '')) END AS n FROM conversations),
w AS (SELECT r.*, coalesce(new, '') AS new, sum(n) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY ord) AS k, count(*) OVER (PARTITION BY conv_id) AS last FROM r JOIN t USING (conv_id)),
z AS (SELECT *, CAST(CASE WHEN total = 0 THEN CASE WHEN k = 1 THEN length(new) ELSE 0 END ELSE round_even(n / total * length(new), 0) END AS BIGINT) AS size FROM w),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z)
SELECT conv_id, ord, substr(new, CAST(before + 1 AS BIGINT), CASE WHEN k = last AND (total > 0 OR last = 1) THEN length(new) ELSE size END) AS part FROM b""",
    "heading_sections": f"""WITH t AS (SELECT conv_id, string_agg((['## 1. Scene Overview', '## 7. Text Elements', '## Notes ', 'plain'])[turn % 4 + 1] || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1),
l AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
n AS (SELECT *, starts_with(line, '## ') AS head, sum(CAST(starts_with(line, '## ') AS INT)) OVER (PARTITION BY conv_id ORDER BY pos) AS n FROM l),
b AS (SELECT conv_id, n, {_TRIM("max(substr(line, 4)) FILTER (head)")} AS heading, {_TRIM("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '')")} AS body FROM n WHERE n > 0 GROUP BY 1, 2),
s AS (SELECT conv_id, heading, arg_max(body, n) AS body FROM b WHERE heading <> '' GROUP BY 1, 2),
a(r, new, old) AS (VALUES {', '.join(f"({i}, '{new}', '{old}')" for i, (new, olds) in enumerate(naming.ALIASES) for old in olds)})
SELECT * FROM s UNION ALL SELECT conv_id, old, arg_min(body, r) FROM s JOIN a ON a.new = s.heading WHERE (conv_id, old) NOT IN (SELECT (conv_id, heading) FROM s) GROUP BY 1, 2""",
    "color_clusters": """WITH RECURSIVE c AS (SELECT p_brand, p_partkey AS ord, p_partkey * 37 % 128 AS r, p_partkey * 11 % 64 AS g, p_partkey % 32 AS b, printf('#%02x%02x%02x', CAST(p_partkey * 37 % 128 AS INT), CAST(p_partkey * 11 % 64 AS INT), CAST(p_partkey % 32 AS INT)) AS color,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
z(p_brand, k, heads, ord, color, head) AS (SELECT p_brand, k, [{'r': r, 'g': g, 'b': b, 'c': color}], ord, color, color FROM c WHERE k = 1 UNION ALL
  SELECT p_brand, k, CASE WHEN len(near) > 0 THEN heads ELSE list_append(heads, {'r': r, 'g': g, 'b': b, 'c': color}) END, ord, color, CASE WHEN len(near) > 0 THEN near[1].c ELSE color END
  FROM (SELECT c.*, z.heads, list_filter(z.heads, lambda h: sqrt((h.r - c.r) ** 2 + (h.g - c.g) ** 2 + (h.b - c.b) ** 2) < 30) AS near FROM z JOIN c ON c.p_brand = z.p_brand AND c.k = z.k + 1))
SELECT p_brand, ord, color, head FROM z""",
    "chart_groups": f"""WITH RECURSIVE {_ST}, c AS (SELECT {_PAGE}, element_id, x, y, {_TRIM("coalesce(text, '')")} AS t, row_number() OVER (PARTITION BY {_PAGE} ORDER BY ord) AS k FROM st WHERE element_type = 'chart'),
z(document_id, slide_number, k, seeds, seed_id, t) AS (SELECT {_PAGE}, k, [{{'i': element_id, 'x': x, 'y': y}}], element_id, t FROM c WHERE k = 1 UNION ALL
  SELECT {_PAGE}, k, CASE WHEN len(near) > 0 THEN seeds ELSE list_append(seeds, {{'i': element_id, 'x': x, 'y': y}}) END, CASE WHEN len(near) > 0 THEN near[1].i ELSE element_id END, t
  FROM (SELECT c.*, z.seeds, list_filter(z.seeds, lambda s: abs(s.x - c.x) < 1500000 AND abs(s.y - c.y) < 1500000) AS near FROM z JOIN c ON c.document_id = z.document_id AND c.slide_number = z.slide_number AND c.k = z.k + 1))
SELECT {_PAGE}, seed_id, CAST(count(*) AS INT) AS members, coalesce(arg_min(t, k) FILTER (length(t) > 15), 'Untitled Chart') AS title FROM z GROUP BY {_PAGE}, seed_id""",
    "cleaned_answers": _cleaned(),
}
