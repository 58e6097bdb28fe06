"""Queries over objects of a page, their groups, graph and wording, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import semantics, spatial
from quire.sources.elements import ELEMENTS_SQL, PAGE, STYLED_SQL, styled_elements

_PAGE = "document_id, slide_number"
_WIDE, _HIGH = "12192000.0", "6858000.0"


def _objects(spark, sf_dir):
    return semantics.objects(styled_elements(spark, sf_dir))


def _relations(spark, sf_dir):
    """Connectors with the boxes at their ends."""
    return spatial.connector_targets(styled_elements(spark, sf_dir)).withColumn("relationship_type", F.lit("connector"))


def semantic_objects(spark, sf_dir):
    return _objects(spark, sf_dir).drop("text", "x", "y", "width", "height", "font_size", "font_family", "fill_color", "text_color")


def role_meaning(spark, sf_dir):
    o = semantics.meaning(_objects(spark, sf_dir))
    return o.select(*PAGE, "element_id", "role", "goal", "intent", "importance", "objective", "summary", "purpose")


def container_tree(spark, sf_dir):
    return semantics.container_tree(_objects(spark, sf_dir))


def visual_groups(spark, sf_dir):
    return semantics.visual_groups(_objects(spark, sf_dir))


def group_purpose(spark, sf_dir):
    o = _objects(spark, sf_dir)
    return semantics.group_purpose(o, semantics.visual_groups(o))


def alternative_layout(spark, sf_dir):
    o = _objects(spark, sf_dir)
    return semantics.alternative_layout(o, semantics.visual_groups(o))


def layout_edges(spark, sf_dir):
    return semantics.layout_edges(_objects(spark, sf_dir), _relations(spark, sf_dir))


def content_flow(spark, sf_dir):
    return semantics.content_flow(_objects(spark, sf_dir), _relations(spark, sf_dir))


def semantic_nodes(spark, sf_dir):
    o = _objects(spark, sf_dir)
    return semantics.graph_nodes(o, semantics.visual_groups(o))


def semantic_edges(spark, sf_dir):
    o = _objects(spark, sf_dir)
    return semantics.graph_edges(o, semantics.visual_groups(o), semantics.layout_edges(o, _relations(spark, sf_dir)))


def design_system(spark, sf_dir):
    return semantics.design_system(_objects(spark, sf_dir))


def typography(spark, sf_dir):
    return semantics.typography(_objects(spark, sf_dir))


def regions_or_page(spark, sf_dir):
    e = styled_elements(spark, sf_dir)
    r = e.where("element_type = 'group'").select(*PAGE, F.concat(F.lit("region "), F.col("element_id").cast("string")).alias("name"), "x", "y", "width", "height")
    return semantics.regions_or_page(e, r)


def merged_update(spark, sf_dir):
    """Objects with the answers of a model that answers some, and some with an empty text."""
    o = _objects(spark, sf_dir).select(*PAGE, "element_id", "ord", "role", F.lit("general").alias("domain"))
    update = o.where("ord % 3 = 0").select(*PAGE, "element_id", F.expr("if(ord % 2 = 0, 'body', '')").alias("role"), F.expr("if(ord % 5 = 0, 'finance', null)").alias("domain"))
    return semantics.merge_update(o, update, ["role", "domain"])


def extraction_checks(spark, sf_dir):
    o = _objects(spark, sf_dir).withColumn("rewritten", F.when(F.expr("ord % 97 <> 5"), semantics.rewrite(F.col("text"), F.col("role"))))
    edges = semantics.layout_edges(o, _relations(spark, sf_dir)).unionByName(o.where("ord % 101 = 7").select(*PAGE, F.col("element_id").alias("source"), F.lit(-1).cast("long").alias("target"), F.lit("contains").alias("relation"), F.lit(1.0).alias("confidence")))
    return semantics.checks(o, edges)


def rewritten_texts(spark, sf_dir):
    o = _objects(spark, sf_dir).where("text is not null")
    return o.groupBy("text", "role").agg(F.count("*").alias("n")).select("text", "role", semantics.rewrite(F.col("text"), F.col("role")).alias("rewritten"), semantics.plain_rewrite(F.col("text")).alias("plain"), "n")


QUERIES = {
    f.__name__: f
    for f in (semantic_objects, role_meaning, container_tree, visual_groups, group_purpose, alternative_layout, layout_edges, content_flow, semantic_nodes, semantic_edges, design_system, typography,
              regions_or_page, merged_update, extraction_checks, rewritten_texts)
}

_STRIP = lambda c: rf"regexp_replace({c}, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')"
_LINKS = "('arrow', 'connector', 'line')"
_ROLE = rf"""CASE WHEN element_type IN {_LINKS} THEN 'flow_connector' WHEN element_type = 'icon' THEN 'icon_or_decorative_symbol' WHEN element_type = 'shape' AND t = '' AND shape_type = 'panel' THEN 'container'
  WHEN element_type = 'shape' AND t = '' THEN 'decorative_or_structural_shape' WHEN element_type = 'table' THEN 'table' WHEN element_type = 'chart' THEN 'chart' WHEN element_type = 'image' THEN 'supporting_visual'
  WHEN y / {_HIGH} > 0.88 THEN 'footer' WHEN y / {_HIGH} < 0.16 AND (coalesce(font_size, 0) >= 18 OR length(t) < 90) THEN 'title' WHEN ends_with(lower(t), '?') THEN 'question'
  WHEN regexp_matches(lower(t), '^(warning|caution|note)') THEN 'warning' WHEN regexp_matches(lower(t), '^(step|phase) ') THEN 'workflow_step' WHEN regexp_matches(lower(t), '^(best for|ideal for|use when)') THEN 'recommendation'
  WHEN regexp_matches(t, '^[-*•]\s+') THEN 'bullet' WHEN coalesce(font_size, 0) >= 16 OR length(t) <= 45 THEN 'heading' ELSE 'body' END"""
_ZONE = lambda v, total: f"CASE WHEN {v} / {total} < 0.33 THEN 'start' WHEN {v} / {total} > 0.66 THEN 'end' ELSE 'center' END"
#: The objects of a page.
OBJECTS = f"""{ELEMENTS_SQL}, {STYLED_SQL}, ty AS (SELECT *, {_STRIP("coalesce(text, '')")} AS t, CASE WHEN {_STRIP("coalesce(text, '')")} <> '' AND element_type IN ('shape', 'unknown') THEN 'text' ELSE element_type END AS type FROM st),
pa AS (SELECT e.document_id, e.slide_number, e.element_id, arg_min(c.element_id, (c.width * c.height, c.ord)) AS holder FROM ty e JOIN ty c ON e.document_id = c.document_id AND e.slide_number = c.slide_number AND e.ord <> c.ord
  WHERE c.type IN ('group', 'shape', 'table', 'chart', 'image') AND e.x >= c.x AND e.y >= c.y AND e.x + e.width <= c.x + c.width AND e.y + e.height <= c.y + c.height
  AND (c.width * c.height > e.width * e.height OR c.ord < e.ord) GROUP BY ALL),
ob AS (SELECT ty.* EXCLUDE (parent), holder AS parent, coalesce(shape_type, element_type) AS subtype, stacking_order AS z_index, round_even(x / {_WIDE}, 6) AS x_share, round_even(y / {_HIGH}, 6) AS y_share,
  round_even(width / {_WIDE}, 6) AS width_share, round_even(height / {_HIGH}, 6) AS height_share, {_WIDE} - x - width AS right_inset, {_HIGH} - y - height AS bottom_inset,
  {_ZONE("(x + width / 2)", _WIDE)} AS zone_x, {_ZONE("(y + height / 2)", _HIGH)} AS zone_y, {_ROLE} AS role,
  CASE WHEN element_type IN {_LINKS} THEN 'connector' WHEN element_type = 'table' THEN 'table' WHEN element_type = 'chart' THEN 'data_visualization' WHEN element_type = 'image' THEN 'visual_asset'
    WHEN height < 80000 OR width > 8000000 THEN 'divider_or_bar' ELSE 'content_object' END AS layout_role,
  CASE WHEN t <> '' THEN substr(sha256(t), 1, 16) END AS fingerprint, CAST(length(t) AS INT) AS characters,
  CAST(len([l FOR l IN string_split(t, chr(10)) IF trim(l) <> '']) AS INT) AS lines FROM ty LEFT JOIN pa USING ({_PAGE}, element_id))"""
_GROUPS = f"""nm AS (SELECT {_PAGE}, coalesce(group_id, CAST(parent AS VARCHAR)) AS group_id, list(element_id ORDER BY element_id) AS m, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height
  FROM ob WHERE coalesce(group_id, CAST(parent AS VARCHAR)) IS NOT NULL GROUP BY ALL),
ce AS (SELECT {_PAGE}, floor((x + width / 2) / 2500000) AS cx, floor((y + height / 2) / 1600000) AS cy, list(element_id ORDER BY element_id) AS m, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width,
  max(y + height) - min(y) AS height, min((z_index, ord)) AS f FROM ob GROUP BY {_PAGE}, floor((x + width / 2) / 2500000), floor((y + height / 2) / 1600000)),
cn AS (SELECT *, 'visual_region_' || row_number() OVER (PARTITION BY {_PAGE} ORDER BY f) AS group_id FROM ce),
gr AS (SELECT {_PAGE}, group_id, 'explicit_group' AS kind, m, x, y, width, height, 1.0::DOUBLE AS confidence FROM nm UNION ALL
  SELECT {_PAGE}, group_id, 'proximity_group', m, x, y, width, height, 0.65::DOUBLE FROM cn WHERE len(m) >= 2 AND NOT EXISTS (SELECT 1 FROM nm WHERE nm.document_id = cn.document_id AND nm.slide_number = cn.slide_number AND nm.m = cn.m))"""
_ENDS = f"""bx AS (SELECT * FROM st WHERE element_type NOT IN ('connector', 'arrow')),
cx AS (SELECT c.document_id, c.slide_number, c.element_id, arg_min(b.element_id, (sqrt((b.x + b.width / 2 - c.begin_x) ** 2 + (b.y + b.height / 2 - c.begin_y) ** 2), b.ord)) AS s,
  arg_min(b.element_id, (sqrt((b.x + b.width / 2 - c.end_x) ** 2 + (b.y + b.height / 2 - c.end_y) ** 2), b.ord)) AS d
  FROM st c JOIN bx b ON c.document_id = b.document_id AND c.slide_number = b.slide_number WHERE c.element_type IN ('connector', 'arrow') AND c.begin_x IS NOT NULL GROUP BY ALL),
rl AS (SELECT {_PAGE}, s AS source, d AS target FROM cx WHERE s <> d)"""
_READ = f"rd AS (SELECT {_PAGE}, element_id AS source, lead(element_id) OVER (PARTITION BY {_PAGE} ORDER BY y, x, z_index, ord) AS target FROM ob)"
_EDGES = f"""le AS (SELECT {_PAGE}, source, target, 'connector' AS relation, 0.95::DOUBLE AS confidence FROM rl UNION ALL SELECT {_PAGE}, parent, element_id, 'contains', 1.0 FROM ob WHERE parent IS NOT NULL
  UNION ALL SELECT {_PAGE}, source, target, 'reading_order_next', 0.8 FROM rd WHERE target IS NOT NULL)"""
_MAP = lambda key, values, default: f"CASE {key} " + " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in values.items()) + f" ELSE {default} END"


def _chain(column: str, pairs, flags: str) -> str:
    for word, to in pairs:
        column = f"regexp_replace({column}, '\\b{word}\\b', '{to}', '{flags}')"
    return column


_TAIL = lambda c: _STRIP(f"regexp_replace({c}, '^[^:]*:', '')")
_HEAD = lambda c: _STRIP(f"string_split({c}, ':')[1]")


def _fragment(c: str) -> str:
    changed = _chain(c, semantics.FRAGMENTS, "gi")
    return f"CASE WHEN {changed} = {c} THEN 'Professionally restated: ' || {c} ELSE {changed} END"


_WORDS = r"[w FOR w IN regexp_split_to_array(s, '\s+') IF w <> '']"
_PLAIN = [f"WHEN contains(lower(trim(text)), '{k}') THEN '{v}'" for k, v in semantics.SENTENCES]

ORACLES = {
    "semantic_objects": f"""WITH {OBJECTS} SELECT {_PAGE}, element_id, ord, element_type, type, subtype, parent, group_id, z_index, x_share, y_share, width_share, height_share, right_inset, bottom_inset, zone_x, zone_y, role, layout_role,
  fingerprint, characters, lines FROM ob""",
    "role_meaning": f"""WITH {OBJECTS} SELECT {_PAGE}, element_id, role, {_MAP('role', semantics.GOALS, "'Serve as a ' || element_type || ' element in the slide composition.'")} AS goal,
  'Preserve the ' || role || ' role and its relationship to nearby ' || element_type || ' objects.' AS intent,
  CASE WHEN role IN ('title', 'chart', 'table', 'question') THEN 'high' WHEN role = 'footer' THEN 'low' ELSE 'medium' END AS importance,
  CASE WHEN role IN ('title', 'heading') THEN 'Understand the topic or section being introduced.' WHEN role IN ('body', 'bullet', 'workflow_step') THEN 'Retain the stated meaning while wording changes.'
    ELSE 'Understand this object''s contribution to the slide.' END AS objective,
  CASE WHEN t <> '' THEN 'This ' || role || ' communicates the same idea as the source text without requiring verbatim wording.'
    ELSE 'This ' || element_type || ' object contributes visual structure, hierarchy, or meaning to the slide.' END AS summary,
  CASE WHEN element_type IN {_LINKS} THEN 'Indicates flow, direction, or relationship.' WHEN role IN ('title', 'heading', 'body', 'bullet') THEN 'Carries textual meaning at its exact visual location.'
    ELSE 'Preserves visible slide composition and hierarchy.' END AS purpose FROM ob""",
    "container_tree": f"WITH {OBJECTS} SELECT {_PAGE}, parent, string_agg(CAST(element_id AS VARCHAR), ',' ORDER BY z_index, ord) AS children, count(*) AS n FROM ob GROUP BY {_PAGE}, parent",
    "visual_groups": f"WITH {OBJECTS}, {_GROUPS} SELECT {_PAGE}, group_id, kind, array_to_string(m, ',') AS members, x, y, width, height, confidence FROM gr",
    "group_purpose": f"""WITH {OBJECTS}, {_GROUPS}, me AS (SELECT {_PAGE}, group_id, unnest(m) AS element_id FROM gr),
r AS (SELECT me.document_id, me.slide_number, group_id, list(DISTINCT role ORDER BY role) AS r FROM me JOIN ob ON me.document_id = ob.document_id AND me.slide_number = ob.slide_number AND me.element_id = ob.element_id
  WHERE true GROUP BY me.document_id, me.slide_number, me.group_id)
SELECT {_PAGE}, group_id, array_to_string(r, ',') AS roles, CASE WHEN list_contains(r, 'title') THEN 'Introduce and organize the slide message.' WHEN list_contains(r, 'chart') OR list_contains(r, 'table') THEN 'Present structured data or evidence.'
  WHEN list_contains(r, 'flow_connector') THEN 'Explain a process or relationship flow.' ELSE 'Group visually related slide elements.' END AS purpose FROM r""".replace("SELECT me.document_id, me.slide_number, group_id,", "SELECT me.document_id, me.slide_number, me.group_id,"),
    "alternative_layout": f"""WITH {OBJECTS}, {_GROUPS}, a AS (SELECT {_PAGE}, count(*) AS n, count(*) FILTER (type = 'table') AS tables, count(*) FILTER (type = 'chart') AS charts, count(*) FILTER (type IN {_LINKS}) AS links,
  count(*) FILTER (type <> 'line' AND x + width / 2 < 0.45 * {_WIDE}) AS l, count(*) FILTER (type <> 'line' AND x + width / 2 > 0.55 * {_WIDE}) AS r, count(*) FILTER (type <> 'line') AS placed FROM ob GROUP BY {_PAGE}),
g AS (SELECT {_PAGE}, count(*) AS g FROM gr GROUP BY {_PAGE})
SELECT {_PAGE}, CASE WHEN tables > 0 THEN 'table' WHEN charts > 0 AND n > 6 THEN 'dashboard' WHEN charts > 0 THEN 'chart_slide' WHEN links > 0 THEN 'workflow' WHEN g >= 3 THEN 'card_grid' WHEN placed = 0 THEN 'blank'
  WHEN l > 0 AND r > 0 THEN 'two_column' ELSE 'single_column' END AS layout FROM a LEFT JOIN g USING ({_PAGE})""",
    "layout_edges": f"WITH {OBJECTS}, {_ENDS}, {_READ}, {_EDGES} SELECT * FROM le",
    "content_flow": f"""WITH {OBJECTS}, {_ENDS}, {_READ} SELECT {_PAGE}, source, target, 'reading_order' AS kind FROM rd WHERE target IS NOT NULL UNION ALL SELECT {_PAGE}, source, target, 'connector' FROM rl""",
    "semantic_nodes": f"""WITH {OBJECTS}, {_GROUPS} SELECT DISTINCT {_PAGE}, 'slide_root' AS id, 'slide' AS type, 'slide_canvas' AS role FROM ob UNION ALL SELECT {_PAGE}, CAST(element_id AS VARCHAR), type, role FROM ob
  UNION ALL SELECT {_PAGE}, group_id, 'visual_group', kind FROM gr""",
    "semantic_edges": f"""WITH {OBJECTS}, {_GROUPS}, {_ENDS}, {_READ}, {_EDGES} SELECT {_PAGE}, 'slide_root' AS source, CAST(element_id AS VARCHAR) AS target, 'contains' AS relation, 1.0::DOUBLE AS confidence FROM ob WHERE parent IS NULL
  UNION ALL SELECT {_PAGE}, CAST(source AS VARCHAR), CAST(target AS VARCHAR), relation, confidence FROM le UNION ALL SELECT {_PAGE}, group_id, CAST(unnest(m) AS VARCHAR), 'groups', confidence FROM gr""",
    "design_system": f"""WITH {OBJECTS}, c AS (SELECT {_PAGE}, z_index, ord, 0 AS k, fill_color AS color FROM ob UNION ALL SELECT {_PAGE}, z_index, ord, 1, text_color FROM ob),
s AS (SELECT {_PAGE}, color, min((z_index, ord, k)) AS place FROM c WHERE color <> '' GROUP BY ALL), f AS (SELECT {_PAGE}, font_family AS font, min((z_index, ord)) AS place FROM ob WHERE font_family <> '' GROUP BY ALL)
SELECT {_PAGE}, colors, fonts FROM (SELECT DISTINCT {_PAGE} FROM ob) LEFT JOIN (SELECT {_PAGE}, string_agg(color, ',' ORDER BY place) AS colors FROM s GROUP BY {_PAGE}) USING ({_PAGE})
LEFT JOIN (SELECT {_PAGE}, string_agg(font, ',' ORDER BY place) AS fonts FROM f GROUP BY {_PAGE}) USING ({_PAGE})""",
    "typography": f"WITH {OBJECTS} SELECT {_PAGE}, CAST(row_number() OVER (PARTITION BY {_PAGE} ORDER BY coalesce(font_size, 0) DESC, y, x, ord) AS INT) AS rank, element_id, font_size, role FROM ob WHERE characters > 0",
    "regions_or_page": f"""WITH {ELEMENTS_SQL}, {STYLED_SQL}, r AS (SELECT {_PAGE}, 'region ' || element_id AS name, x, y, width, height FROM st WHERE element_type = 'group')
SELECT * FROM r UNION ALL SELECT DISTINCT {_PAGE}, 'full_slide', 0.0::DOUBLE, 0.0::DOUBLE, {_WIDE}::DOUBLE, {_HIGH}::DOUBLE FROM st WHERE ({_PAGE}) NOT IN (SELECT ({_PAGE}) FROM r)""",
    "merged_update": f"""WITH {OBJECTS} SELECT {_PAGE}, element_id, ord, CASE WHEN ord % 6 = 0 THEN 'body' ELSE role END AS role, CASE WHEN ord % 15 = 0 THEN 'finance' ELSE 'general' END AS domain FROM ob""",
    "extraction_checks": f"""WITH {OBJECTS}, a AS (SELECT {_PAGE}, count(*) FILTER (ord % 101 = 7) AS lost, count(*) FILTER (characters > 0 AND ord % 97 = 5) AS unwritten, count(DISTINCT element_id) = count(*) AS whole FROM ob GROUP BY {_PAGE})
SELECT {_PAGE}, true AS objects_extracted, unwritten = 0 AS texts_rewritten, lost = 0 AS children_known, whole AS reading_order_complete, true AS structure_complete, true AS roles_complete, unwritten = 0 AND lost = 0 AND whole AS passed FROM a""",
    "rewritten_texts": rf"""WITH {OBJECTS}, d AS (SELECT text, role, count(*) AS n, first(t) AS t FROM ob WHERE text IS NOT NULL GROUP BY text, role),
w AS (SELECT *, {_chain('t', semantics.REPLACED, 'g')} AS w FROM d),
s AS (SELECT *, CASE WHEN starts_with(w, 'Recommended for:') THEN 'Recommended when ' || {_TAIL('w')} WHEN starts_with(w, 'Not suitable for:') THEN 'Not suitable for ' || {_TAIL('w')} ELSE w END AS s FROM w),
f AS (SELECT *, {_fragment('s')} AS whole, {_HEAD('s')} AS head, {_TAIL('s')} AS tail, {_WORDS} AS words FROM s),
r AS (SELECT *, {_fragment('tail')} AS part FROM f)
SELECT text, role, n, CASE WHEN t = '' OR lower(t) IN ({', '.join(f"'{u}'" for u in semantics.UNIVERSAL)}) THEN t ELSE coalesce({_MAP("lower(regexp_replace(t, '" + chr(92) + "s+', ' ', 'g'))", semantics.PHRASES, 'NULL')},
  CASE WHEN s <> t THEN s WHEN contains(s, ':') THEN {_MAP('lower(head)', semantics.LABELS, "head || ' restated'")} || ': ' || part
    WHEN role = 'title' AND contains(s, ' ') THEN array_to_string(list_concat(words[2:], words[1:1]), ' ') ELSE whole END) END AS rewritten,
  CASE WHEN len([x FOR x IN regexp_split_to_array(text, '\s+') IF x <> '']) <= 1 THEN text {' '.join(_PLAIN)} ELSE array_to_string([CASE WHEN {_MAP('lower(x)', semantics.SYNONYMS, 'NULL')} IS NULL THEN x
    WHEN regexp_matches(x, '^[A-Z]') THEN upper(substr({_MAP('lower(x)', semantics.SYNONYMS, 'NULL')}, 1, 1)) || lower(substr({_MAP('lower(x)', semantics.SYNONYMS, 'NULL')}, 2)) ELSE {_MAP('lower(x)', semantics.SYNONYMS, 'NULL')} END
    FOR x IN regexp_split_to_array(text, '\s+') IF x <> ''], ' ') END AS plain FROM r""",
}
