"""Queries over lines, blocks and sections of a page's texts, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import blueprint, content
from quire.sources.elements import ELEMENTS_SQL, PAGE, STYLED_SQL, styled_elements

_PAGE = "document_id, slide_number"


def _low(spark, sf_dir):
    """Styled elements at a tenth of their height on a coarse grid in y, so that lines and blocks occur."""
    return styled_elements(spark, sf_dir).withColumn("height", F.expr("height / 10")).withColumn("y", F.expr("cast(floor(y / 200000) * 200000 as double)"))


def blueprint_canvas(spark, sf_dir):
    e = styled_elements(spark, sf_dir)
    return blueprint.canvas(e.selectExpr(*PAGE, *(f"if(slide_number % 4 = 0, {c} / 9525, {c}) as {c}" for c in ("x", "y", "width", "height"))))


def _blocks(spark, sf_dir):
    e = _low(spark, sf_dir)
    return blueprint.text_blocks(blueprint.text_lines(e), blueprint.canvas(e))


def blueprint_lines(spark, sf_dir):
    lines = blueprint.text_lines(_low(spark, sf_dir))
    return lines.select(*PAGE, "line_no", "text", "x", "y", "width", "height", "bold", "font_size", "fill_color", "text_color", "card_id", "parts")


def blueprint_blocks(spark, sf_dir):
    """The mean font decides with the role; as a sum in any order it is no part of the rows."""
    return _blocks(spark, sf_dir).withColumn("role", blueprint.block_role()).drop("font")


def blueprint_sections(spark, sf_dir):
    return blueprint.sections(_blocks(spark, sf_dir))


def section_meaning(spark, sf_dir):
    s = blueprint.sections(_blocks(spark, sf_dir))
    table = styled_elements(spark, sf_dir).where("element_type = 'table'").select(*PAGE, (F.col("ord") + 1_000_000).alias("section_no"), F.lit("table").alias("role"), F.lit(None).cast("double").alias("y_pct"))
    return blueprint.section_meaning(s.select(*PAGE, "section_no", "role", "y_pct").unionByName(table))


def section_pairs(spark, sf_dir):
    return blueprint.section_pairs(blueprint.sections(_blocks(spark, sf_dir)))


def font_levels(spark, sf_dir):
    return blueprint.font_levels(styled_elements(spark, sf_dir))


def verbatim_texts(spark, sf_dir):
    return blueprint.verbatim(styled_elements(spark, sf_dir), content.garbled(F.col("text")))


QUERIES = {f.__name__: f for f in (blueprint_canvas, blueprint_lines, blueprint_blocks, blueprint_sections, section_meaning, section_pairs, font_levels, verbatim_texts)}

_TRIM = lambda c: rf"regexp_replace({c}, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')"
_LINES = rf"""{ELEMENTS_SQL}, {STYLED_SQL}, lo AS (SELECT * REPLACE (height / 10 AS height, floor(y / 200000) * 200000 AS y) FROM st),
cv AS (SELECT {_PAGE}, greatest(max(x + width), 12192000.0) AS cw, greatest(max(y + height), 6858000.0) AS ch FROM lo GROUP BY {_PAGE}),
cd AS (SELECT a.document_id, a.slide_number, a.element_id, arg_min(c.element_id, c.ord) AS card_id FROM lo a JOIN lo c ON a.document_id = c.document_id AND a.slide_number = c.slide_number AND c.element_type = 'shape'
  AND a.x + a.width / 2 BETWEEN c.x AND c.x + c.width AND a.y + a.height / 2 BETWEEN c.y AND c.y + c.height GROUP BY ALL),
te AS (SELECT lo.* REPLACE ({_TRIM("coalesce(text, '')")} AS text), cw, ch, card_id, y + height / 2 AS cy FROM lo JOIN cv USING ({_PAGE}) LEFT JOIN cd USING ({_PAGE}, element_id)
  WHERE element_type <> 'image' AND length(regexp_replace(coalesce(text, ''), '[\s\x0B]+', '', 'g')) >= 2),
tp AS (SELECT *, lag(cy) OVER w AS cy0, lag(card_id) OVER w AS card0 FROM te WINDOW w AS (PARTITION BY {_PAGE} ORDER BY y, x, ord)),
tl AS (SELECT *, sum(CASE WHEN cy0 IS NULL OR abs(cy - cy0) > 20 * (cw / 1920) OR card_id IS DISTINCT FROM card0 THEN 1 ELSE 0 END) OVER (PARTITION BY {_PAGE} ORDER BY y, x, ord ROWS UNBOUNDED PRECEDING) AS line_no FROM tp),
ln AS (SELECT {_PAGE}, line_no, string_agg(text, ' ' ORDER BY x, y, ord) AS text, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, avg(coalesce(nullif(font_size, 0), height)) AS font,
  first(struct_pack(bold := bold, font_size := font_size, fill_color := fill_color, text_color := text_color, card_id := card_id) ORDER BY x, y, ord) AS s, first(cw) AS cw, first(ch) AS ch, count(*) AS parts FROM tl GROUP BY {_PAGE}, line_no)"""
_BLOCKS = rf"""{_LINES}, lp AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lag(width) OVER w AS w0, lag(height) OVER w AS h0, lag(s.card_id) OVER w AS k0 FROM ln WINDOW w AS (PARTITION BY {_PAGE} ORDER BY line_no)),
lb AS (SELECT *, sum(CASE WHEN x0 IS NULL OR y - y0 - h0 > 40 * (cw / 1920) OR NOT least(x0 + w0, x + width) - greatest(x0, x) > 0.3 * least(w0, width) OR s.card_id IS DISTINCT FROM k0 THEN 1 ELSE 0 END)
  OVER (PARTITION BY {_PAGE} ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block_no FROM lp),
bk AS (SELECT {_PAGE}, CAST(block_no AS BIGINT) AS block_no, string_agg(text, chr(10) ORDER BY line_no) AS text, round_even(100 * min(x) / first(cw), 1) AS x_pct, round_even(100 * min(y) / first(ch), 1) AS y_pct,
  round_even(100 * (max(x + width) - min(x)) / first(cw), 1) AS width_pct, round_even(100 * (max(y + height) - min(y)) / first(ch), 1) AS height_pct, round_even(avg(font), 1) AS font, count(*) AS lines,
  arg_max(s, (font, -line_no)) AS s FROM lb GROUP BY {_PAGE}, block_no),
bl AS (SELECT *, lower({_TRIM('text')}) AS low, coalesce(s.bold, false) AS b FROM bk),
br AS (SELECT {_PAGE}, block_no, text, x_pct, y_pct, width_pct, height_pct, font, lines, s.bold AS bold, s.fill_color AS fill_color, s.text_color AS text_color,
  CASE WHEN y_pct / 100.0 < 0.12 THEN CASE WHEN font > 18 OR b THEN 'title' ELSE 'subtitle' END WHEN y_pct / 100.0 > 0.88 THEN 'footer' WHEN y_pct / 100.0 < 0.25 AND contains(text, ':') AND length(text) < 200 THEN 'metadata_row'
    WHEN y_pct / 100.0 < 0.25 AND b AND length(text) < 100 THEN 'heading' WHEN regexp_matches(low, '{"|".join(blueprint.PANEL)}') THEN 'skills_panel'
    WHEN regexp_matches(low, '{"|".join(blueprint.TASK)}') THEN CASE WHEN b OR len([w FOR w IN regexp_split_to_array(low, '\s+') IF w <> '']) < 6 THEN 'task_heading' ELSE 'task_content' END
    WHEN regexp_matches(low, '{"|".join(blueprint.SCENE)}') THEN 'context_section' WHEN regexp_matches(low, '{"|".join(blueprint.LETTER)}') THEN 'letter_content' WHEN regexp_matches(text, '^[0-9]+\.\s') THEN 'numbered_list'
    WHEN regexp_matches(text, '^[•-]') THEN 'bulleted_list' WHEN b AND len([w FOR w IN regexp_split_to_array(text, '\s+') IF w <> '']) < 8 THEN 'heading' ELSE 'body_section' END AS role FROM bl)"""
_SECTIONS = f"""{_BLOCKS}, sp AS (SELECT *, role IN ('heading', 'task_heading') AND coalesce(lead(role) OVER w IN {blueprint.BODIES}, false) AS takes, lead(text) OVER w AS next_text FROM br WINDOW w AS (PARTITION BY {_PAGE} ORDER BY block_no)),
sq AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY {_PAGE} ORDER BY block_no), false) AS taken FROM sp),
sc AS (SELECT {_PAGE}, block_no AS section_no, CASE WHEN takes AND role = 'task_heading' THEN 'task_section' WHEN takes THEN 'content_section' ELSE role END AS role, CASE WHEN takes THEN text END AS heading,
  CASE WHEN takes THEN next_text ELSE text END AS text, y_pct FROM sq WHERE NOT taken)"""
_FORM = r"^([^:]{2,40}):[\t\n\x0B\f\r ]*(.*)$"

ORACLES = {
    "blueprint_canvas": f"""WITH {ELEMENTS_SQL}, r AS (SELECT {_PAGE}, max(CASE WHEN slide_number % 4 = 0 THEN x / 9525 + width / 9525 ELSE x + width END) AS mx, max(CASE WHEN slide_number % 4 = 0 THEN y / 9525 + height / 9525 ELSE y + height END) AS my FROM el GROUP BY {_PAGE}),
c AS (SELECT {_PAGE}, CASE WHEN mx > 100000 THEN greatest(mx, 12192000.0) ELSE greatest(mx, 1920.0) END AS canvas_width, CASE WHEN mx > 100000 THEN greatest(my, 6858000.0) ELSE greatest(my, 1080.0) END AS canvas_height FROM r)
SELECT *, CASE WHEN abs(canvas_width / canvas_height - 16 / 9) < 0.1 THEN '16:9' WHEN abs(canvas_width / canvas_height - 4 / 3) < 0.1 THEN '4:3' ELSE printf('%.2f:1', canvas_width / canvas_height) END AS aspect FROM c""",
    "blueprint_lines": f"WITH {_LINES} SELECT {_PAGE}, CAST(line_no AS BIGINT) AS line_no, text, x, y, width, height, s.bold AS bold, s.font_size AS font_size, s.fill_color AS fill_color, s.text_color AS text_color, s.card_id AS card_id, parts FROM ln",
    "blueprint_blocks": f"WITH {_BLOCKS} SELECT * EXCLUDE (font) FROM br",
    "blueprint_sections": f"WITH {_SECTIONS} SELECT * FROM sc",
    "section_meaning": f"""WITH {_SECTIONS}, al AS (SELECT {_PAGE}, section_no, role, y_pct FROM sc UNION ALL SELECT {_PAGE}, ord + 1000000, 'table', NULL FROM st WHERE element_type = 'table')
SELECT {_PAGE}, section_no, role, CAST(row_number() OVER (PARTITION BY {_PAGE} ORDER BY coalesce(y_pct, 0), section_no) AS INT) AS reading_order,
  CASE WHEN contains(role, 'title') THEN 'Title' WHEN contains(role, 'header') THEN 'Introduction' WHEN contains(role, 'table') THEN 'Comparison' WHEN contains(role, 'chart') THEN 'Summary' WHEN contains(role, 'process') THEN 'Process' ELSE 'Explanation' END AS purpose,
  CASE WHEN contains(role, 'title') THEN 'Title' WHEN contains(role, 'table') THEN 'Table' WHEN contains(role, 'chart') THEN 'Infographic' ELSE 'Card' END AS visual_role,
  CASE WHEN regexp_matches(role, 'title|heading|chart') THEN 'high' ELSE 'medium' END AS importance,
  CASE WHEN contains(role, 'title') THEN 'Title' WHEN regexp_matches(role, 'process|step') THEN 'Numbered process' WHEN regexp_matches(role, 'callout|alert') THEN 'Callout' ELSE 'Explanation' END AS semantic_role FROM al""",
    "section_pairs": rf"""WITH {_SECTIONS}, li AS (SELECT document_id || '/' || slide_number || '/' || section_no AS key, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM sc
  WHERE role IN ('metadata_row', 'info_card', 'body_section')),
l AS (SELECT key, pos, {_TRIM('raw')} AS line FROM li WHERE {_TRIM('raw')} <> ''),
p AS (SELECT *, regexp_matches(line, '{_FORM}') AS pair FROM l),
n AS (SELECT *, sum(CASE WHEN pair THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY pos) AS n, first_value(pair) OVER (PARTITION BY key ORDER BY pos) AS opens FROM p)
SELECT key, CAST(n AS BIGINT) AS n, max({_TRIM(f"CASE WHEN pair THEN regexp_extract(line, '{_FORM}', 1) END")}) AS label,
  string_agg(CASE WHEN pair THEN {_TRIM(f"regexp_extract(line, '{_FORM}', 2)")} ELSE line END, ' ' ORDER BY pos) AS value FROM n WHERE opens GROUP BY key, n""",
    "font_levels": f"""WITH {ELEMENTS_SQL}, {STYLED_SQL}, s AS (SELECT {_PAGE}, coalesce(list(DISTINCT font_size ORDER BY font_size DESC) FILTER (font_size <> 0), []) AS s FROM st GROUP BY {_PAGE})
SELECT {_PAGE}, CASE WHEN len(s) = 0 THEN 24.0 ELSE s[1] END AS title, CASE WHEN len(s) = 0 THEN 18.0 ELSE s[2] END AS heading, CASE WHEN len(s) = 0 THEN 12.0 WHEN len(s) >= 3 THEN s[len(s)] END AS body FROM s""",
    "verbatim_texts": rf"""WITH {ELEMENTS_SQL}, {STYLED_SQL}, t AS (SELECT {_PAGE}, {_TRIM("coalesce(text, '')")} AS text, y, x, ord FROM st WHERE element_type <> 'image' AND length(regexp_replace(coalesce(text, ''), '[\s\x0B]+', '', 'g')) >= 2),
g AS (SELECT {_PAGE}, text, min((y, x, ord)) AS place FROM t WHERE NOT (length(text) < 3 OR (length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0
  AND length(array_to_string(regexp_extract_all(text, '[^aeiouAEIOU\s\d]{{4,}}'), '')) / length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0.45)) GROUP BY {_PAGE}, text)
SELECT {_PAGE}, string_agg(text, ' | ' ORDER BY place, text) AS texts FROM g GROUP BY {_PAGE}""",
}
