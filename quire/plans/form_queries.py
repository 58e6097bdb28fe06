"""Queries over page elements, texts and order-dependent folds, with the same in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import folds, forms, spatial
from quire.plans.content_queries import read
from quire.plans.page_queries import ORACLES as PAGES
from quire.sources.elements import ELEMENTS_SQL, elements_from_events


def canvas_by_page(spark, sf_dir):
    return forms.canvas(elements_from_events(spark, sf_dir))


def relative_boxes(spark, sf_dir):
    return forms.relative_boxes(elements_from_events(spark, sf_dir))


def compass_regions(spark, sf_dir):
    return forms.compass(elements_from_events(spark, sf_dir))


def next_in_order(spark, sf_dir):
    return forms.next_in_order(elements_from_events(spark, sf_dir))


def decision_nodes(spark, sf_dir):
    e = elements_from_events(spark, sf_dir)
    asks = F.when(F.expr("ord % 5 = 0"), F.concat("text", F.lit("?"))).when(F.expr("ord % 7 = 0"), F.concat("text", F.lit(" note"))).otherwise(F.col("text"))
    return forms.decision_nodes(e.withColumn("text", asks))


def page_text(spark, sf_dir):
    return forms.page_text(elements_from_events(spark, sf_dir))


def panel_of_element(spark, sf_dir):
    return forms.panel_of(elements_from_events(spark, sf_dir))


def first_by_text(spark, sf_dir):
    return forms.first_by_text(elements_from_events(spark, sf_dir))


def payload_boxes(spark, sf_dir):
    e = elements_from_events(spark, sf_dir)
    return forms.payload_boxes(e.withColumn("width", F.expr("if(ord % 17 = 0, -width, width)")), 12_000_000.0, 7_000_000.0)


def color_profile(spark, sf_dir):
    return forms.color_profile(read(spark, sf_dir, "part").select("p_partkey", F.format_string("#%06x", F.expr("cast(p_partkey * 7919 % 16777216 as int)")).alias("color")))


def kv_pairs(spark, sf_dir):
    """Labels and values of the documents, each opened by a label of its own."""
    return forms.key_values(read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" Status :  "), "lang", F.lit("\n\n  then \n"), F.coalesce("text", F.lit(""))).alias("text")), "doc_id")


def list_items(spark, sf_dir):
    """List items of the documents, every third line of which is made one."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.expr("array_join(transform(split(text, '\n'), (l, i) -> case i % 3 when 0 then concat(i, '. ', l) when 1 then concat('• ', l) else l end), '\n')").alias("text"))
    return forms.list_items(d, "doc_id")


def text_figures(spark, sf_dir):
    return forms.text_figures(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def line_continuations(spark, sf_dir):
    return forms.continues(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def legend_labels(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    hexes = [F.format_string("#%06x", F.expr(f"cast(p_partkey * {k} % 16777216 as int)")) for k in (7919, 104729)]
    return forms.legend(p.select("p_partkey", F.concat(hexes[0], F.lit(": "), "p_brand", F.lit(", "), "p_type", F.lit(" ("), hexes[1], F.lit(")")).alias("text")), "p_partkey")


def governance_layers(spark, sf_dir):
    return folds.layers_from_start(elements_from_events(spark, sf_dir))


def span_merge(spark, sf_dir):
    return folds.merge_spans(elements_from_events(spark, sf_dir).where("element_type = 'text_box'"), 400_000, 200_000)


def split_numbers(spark, sf_dir):
    """Boxes of 40 units in rows of 12, made of line numbers: half of the amounts are cut at their comma."""
    li = read(spark, sf_dir, "orders").selectExpr(
        "o_custkey as document_id", "o_custkey as slide_number", "o_orderkey as element_id", "o_orderkey as ord", "cast(o_orderkey % 12 * 60 as double) as x",
        "cast(o_orderkey div 12 % 40 * 30 as double) as y", "40D as width", "if(o_orderkey % 2 = 0, concat('$', o_orderkey % 900 + 1, ','), cast(o_orderkey % 900 + 100 as string)) as text",
    )
    return folds.merge_split_numbers(li)


def kept_cards(spark, sf_dir):
    e = elements_from_events(spark, sf_dir).where("element_type = 'shape'").withColumn("area", F.expr("width * height"))
    return folds.greedy_boxes(e, "area", 0.8, "own")


def topo_order(spark, sf_dir):
    e = elements_from_events(spark, sf_dir)
    return folds.topological_order(e.where("element_type <> 'connector'"), spatial.connector_targets(e))


QUERIES = {
    f.__name__: f
    for f in (canvas_by_page, relative_boxes, compass_regions, next_in_order, decision_nodes, page_text, panel_of_element, first_by_text, payload_boxes, color_profile, kv_pairs, list_items,
              text_figures, line_continuations, legend_labels, governance_layers, span_merge, split_numbers, kept_cards, topo_order)
}

_CANVAS = """cv AS (SELECT document_id, slide_number, greatest(12192000.0::DOUBLE, max(x + width)) AS canvas_width, greatest(6858000.0::DOUBLE, max(y + height)) AS canvas_height FROM el GROUP BY 1, 2)"""
_LINE = r"""raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
ln AS (SELECT doc_id, CAST(pos AS INT) AS pos, regexp_replace(raw, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g') AS line FROM raw), lines AS (SELECT * FROM ln WHERE line <> '')"""
_PAGE = "document_id, slide_number"
_TRIM = lambda c: rf"regexp_replace({c}, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')"
_PAIR = r"^([^:]{2,40}):[\t\n\x0B\f\r ]*(.*)$"
_HEX = "'#' || lpad(lower(to_hex({} % 16777216)), 6, '0')"

ORACLES = {
    "canvas_by_page": f"""WITH {ELEMENTS_SQL}, {_CANVAS}, q AS (SELECT *, canvas_width / canvas_height AS ratio FROM cv)
SELECT *, CASE WHEN abs(ratio - 16 / 9) < 0.05 THEN '16:9' WHEN abs(ratio - 4 / 3) < 0.05 THEN '4:3' WHEN abs(ratio - 1.6) < 0.05 THEN '16:10' ELSE 'other' END AS aspect FROM q""",
    "relative_boxes": f"""WITH {ELEMENTS_SQL}, {_CANVAS}, q AS (SELECT *, width * height / (canvas_width * canvas_height) AS share FROM el JOIN cv USING (document_id, slide_number))
SELECT {_PAGE}, element_id, CAST(row_number() OVER (PARTITION BY {_PAGE} ORDER BY ord) AS INT) AS element_number, round_even(x / canvas_width, 6) AS x_share, round_even(y / canvas_height, 6) AS y_share,
CASE WHEN share > 0.2 THEN 'high' WHEN share > 0.05 THEN 'medium' ELSE 'low' END AS importance FROM q""",
    "compass_regions": f"""WITH {ELEMENTS_SQL}, q AS (SELECT *, (x + width / 2) / 12192000 AS ax, (y + height / 2) / 6858000 AS dn FROM el)
SELECT {_PAGE}, element_id, CASE WHEN dn < 0.2 THEN 'top' WHEN dn > 0.8 THEN 'bottom' WHEN ax < 0.4 THEN 'left' WHEN ax > 0.6 THEN 'right' ELSE 'center' END AS region FROM q""",
    "next_in_order": f"""WITH {ELEMENTS_SQL}, q AS (SELECT {_PAGE}, element_id AS source_element_id, lead(element_id) OVER (PARTITION BY {_PAGE} ORDER BY y, x, z_order, ord) AS target_element_id FROM el)
SELECT * FROM q WHERE target_element_id IS NOT NULL""",
    "decision_nodes": f"""WITH {ELEMENTS_SQL} SELECT {_PAGE}, element_id FROM el WHERE element_type IN ('shape', 'text_box') AND (ord % 5 = 0 OR ord % 7 = 0 OR regexp_matches(text, 'decision|approve|reject|valid|yes|no'))""",
    "page_text": f"""WITH {ELEMENTS_SQL}, t AS (SELECT {_PAGE}, string_agg(text, ' ' ORDER BY y, x, ord) AS page_text FROM el GROUP BY 1, 2), n AS (SELECT *, CAST(len(string_split(page_text, ' ')) AS INT) AS n_words FROM t)
SELECT {_PAGE}, page_text, sha256(page_text) AS page_sha256, n_words, greatest(1, n_words // 12) AS n_lines FROM n""",
    "panel_of_element": f"""WITH {ELEMENTS_SQL} SELECT a.document_id, a.slide_number, a.element_id, arg_min(b.element_id, (b.width * b.height, b.ord)) AS panel_id
FROM el a JOIN el b ON a.document_id = b.document_id AND a.slide_number = b.slide_number AND a.element_id <> b.element_id AND b.element_type IN ('shape', 'image', 'table')
AND a.x + a.width / 2 BETWEEN b.x AND b.x + b.width AND a.y + a.height / 2 BETWEEN b.y AND b.y + b.height AND b.width * b.height > a.width * a.height GROUP BY 1, 2, 3""",
    "first_by_text": f"WITH {ELEMENTS_SQL} SELECT {_PAGE}, text, arg_min(element_id, ord) AS element_id, count(*) AS copies FROM el GROUP BY 1, 2, 3",
    "payload_boxes": f"""WITH {ELEMENTS_SQL}, q AS (SELECT {_PAGE}, element_id, x, y, height, CASE WHEN ord % 17 = 0 THEN -width ELSE width END AS width FROM el)
SELECT {_PAGE}, element_id, CASE WHEN width < 0 OR height < 0 THEN 'negative_size' WHEN x < -100 OR y < -100 OR x + width > 12000100 OR y + height > 7000100 THEN 'out_of_bounds' ELSE 'ok' END AS verdict,
greatest(0.0::DOUBLE, least(x, 12000000.0::DOUBLE)) AS x1, greatest(0.0::DOUBLE, least(y, 7000000.0::DOUBLE)) AS y1, greatest(0.0::DOUBLE, least(x + width, 12000000.0::DOUBLE)) AS x2, greatest(0.0::DOUBLE, least(y + height, 7000000.0::DOUBLE)) AS y2 FROM q""",
    "color_profile": f"""WITH c AS (SELECT p_partkey, CAST(p_partkey * 7919 % 16777216 AS INT) AS v FROM part), q AS (SELECT *, v // 65536 AS r, v // 256 % 256 AS g, v % 256 AS b FROM c), l AS (SELECT *, 299 * r + 587 * g + 114 * b AS light FROM q)
SELECT p_partkey, {_HEX.format("p_partkey * 7919")} AS color, r, g, b, light, CASE WHEN light < 130000 THEN '#FFFFFF' ELSE '#000000' END AS text_color, light < 127500 AS dark FROM l""",
    "governance_layers": f"""WITH {ELEMENTS_SQL}, l AS (SELECT {_PAGE}, list(element_id ORDER BY y, ord) AS ids, list({{'y': y, 's': y, 'n': 1, 'o': [1]}} ORDER BY y, ord) AS l FROM el WHERE element_type IN ('text_box', 'shape') GROUP BY {_PAGE}),
f AS (SELECT {_PAGE}, ids, list_reduce(l, lambda a, b: CASE WHEN b.y - a.s > 1000000 THEN {{'y': b.y, 's': b.y, 'n': a.n + 1, 'o': list_append(a.o, a.n + 1)}} ELSE {{'y': b.y, 's': a.s, 'n': a.n, 'o': list_append(a.o, a.n)}} END).o AS o FROM l)
SELECT {_PAGE}, unnest(ids) AS element_id, CAST(unnest(o) AS INT) AS layer FROM f""",
    "span_merge": f"""WITH {ELEMENTS_SQL}, l AS (SELECT {_PAGE}, list({{'i': element_id, 'x': x, 'y': y, 'w': width, 'h': height, 't': text, 'p': 1, 'd': list_value({{'i': element_id, 'x': x, 'y': y, 'w': width, 'h': height, 't': text, 'p': 1}})[2:]}} ORDER BY y, x, ord) AS l
  FROM el WHERE element_type = 'text_box' GROUP BY {_PAGE}),
f AS (SELECT {_PAGE}, list_reduce(l, lambda a, b: CASE WHEN abs(b.y - a.y) < 200000 AND b.x - (a.x + a.w) < 400000 THEN {{'i': a.i, 'x': a.x, 'y': a.y, 'w': b.x + b.w - a.x, 'h': a.h, 't': a.t || b.t, 'p': a.p + 1, 'd': a.d}}
  ELSE {{'i': b.i, 'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h, 't': b.t, 'p': 1, 'd': list_append(a.d, {{'i': a.i, 'x': a.x, 'y': a.y, 'w': a.w, 'h': a.h, 't': a.t, 'p': a.p}})}} END) AS r FROM l),
u AS (SELECT {_PAGE}, unnest(list_append(r.d, {{'i': r.i, 'x': r.x, 'y': r.y, 'w': r.w, 'h': r.h, 't': r.t, 'p': r.p}})) AS s FROM f)
SELECT {_PAGE}, s.i AS first_id, s.x AS x, s.y AS y, s.w AS width, s.h AS height, s.t AS text, s.p AS parts FROM u""",
    "kv_pairs": rf"""WITH raw AS (SELECT doc_id, ' Status :  ' || lang || chr(10) || chr(10) || '  then ' || chr(10) || coalesce(text, '') AS t FROM documents),
li AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM raw), l AS (SELECT doc_id, pos, {_TRIM('raw')} AS line FROM li WHERE {_TRIM('raw')} <> ''),
p AS (SELECT *, regexp_matches(line, '{_PAIR}') AS pair FROM l), n AS (SELECT *, sum(CASE WHEN pair THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS n, first_value(pair) OVER (PARTITION BY doc_id ORDER BY pos) AS opens FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, max({_TRIM(f"CASE WHEN pair THEN regexp_extract(line, '{_PAIR}', 1) END")}) AS label,
  string_agg(CASE WHEN pair THEN {_TRIM(f"regexp_extract(line, '{_PAIR}', 2)")} ELSE line END, ' ' ORDER BY pos) AS value FROM n WHERE opens GROUP BY doc_id, n""",
    "list_items": rf"""WITH raw AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l, i: CASE (i - 1) % 3 WHEN 0 THEN (i - 1) || '. ' || l WHEN 1 THEN '• ' || l ELSE l END) AS l FROM documents),
li AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS pos FROM raw), t AS (SELECT doc_id, CAST(pos AS INT) AS pos, {_TRIM('raw')} AS line FROM li),
c AS (SELECT *, regexp_replace(regexp_replace(line, '^[0-9]+[.)][\t ]*', ''), '^[•*-][\t ]*', '') AS item FROM t WHERE line <> '') SELECT doc_id, pos, item FROM c WHERE item <> line""",
    "text_figures": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
q AS (SELECT doc_id, t, [regexp_replace(m, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g') FOR m IN regexp_extract_all(t, '([^.\n"]+\?)', 1)] AS a FROM t),
d AS (SELECT *, [x FOR x, i IN a IF list_position(a, x) = i] AS u FROM q)
SELECT doc_id, CAST(len(u) AS INT) AS n_questions, array_to_string(u, '|') AS questions, array_to_string(regexp_extract_all(t, '([0-9]+(?:\.[0-9]+)?%)', 1), ',') AS percents,
  CAST(len([x FOR x IN [regexp_replace(l, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g') FOR l IN string_split(t, chr(10))] IF length(x) > 3 AND NOT regexp_matches(x, '[0-9]')]) AS INT) AS n_categories FROM d""",
    "line_continuations": rf"""WITH {_LINE}, p AS (SELECT doc_id, pos, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM lines),
q AS (SELECT *, length(a) < 12 AND length(b) < 12 AND ((regexp_matches(a, '^[$S5]?[0-9]') AND regexp_matches(b, '^[$S5]?[0-9]')) OR a IN ('TBD', 'N/A', 'Yes', 'No') OR b IN ('TBD', 'N/A', 'Yes', 'No')) AS v FROM p WHERE b IS NOT NULL)
SELECT doc_id, pos, NOT v AND ((NOT regexp_matches(a, '[.!?:]$') AND regexp_matches(b, '^[a-z]')) OR regexp_matches(lower(a), '(^|[\t ])({"|".join(forms.CONTINUING)})$')) AS continues FROM q""",
    "legend_labels": rf"""WITH c AS (SELECT p_partkey, {_HEX.format("p_partkey * 7919")} || ': ' || p_brand || ', ' || p_type || ' (' || {_HEX.format("p_partkey * 104729")} || ')' AS t FROM part),
a AS (SELECT p_partkey, 0 AS late, unnest(regexp_extract_all(t, '(#[0-9A-Fa-f]{{6}})\s*[:-]\s*([^,\n.]+)')) AS m FROM c UNION ALL SELECT p_partkey, 1, unnest(regexp_extract_all(t, '([^,\n.]+)\s*\((#[0-9A-Fa-f]{{6}})\)')) FROM c),
e AS (SELECT p_partkey, late, upper(regexp_extract(m, '#[0-9A-Fa-f]{{6}}')) AS color, CASE WHEN late = 0 THEN regexp_extract(m, '#[0-9A-Fa-f]{{6}}\s*[:-]\s*([^,\n.]+)', 1) ELSE regexp_extract(m, '([^,\n.]+)\s*\(#[0-9A-Fa-f]{{6}}\)', 1) END AS label FROM a)
SELECT p_partkey, color, {_TRIM("arg_max(label, late)")} AS label FROM e GROUP BY p_partkey, color""",
}

_COVER = "greatest(0, least(b.x + b.w, c.x + c.width) - greatest(b.x, c.x)) * greatest(0, least(b.y + b.h, c.y + c.height) - greatest(b.y, c.y))"
_CLEAR = f"len(list_filter(boxes, lambda b: {_COVER} > 0.8 * c.width * c.height)) = 0"
ORACLES["kept_cards"] = f"""WITH RECURSIVE {ELEMENTS_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY document_id, slide_number ORDER BY width * height DESC, ord) AS k FROM el WHERE element_type = 'shape'),
g(document_id, slide_number, k, boxes, element_id) AS (SELECT document_id, slide_number, k, [{{'x': x, 'y': y, 'w': width, 'h': height}}], element_id FROM c WHERE k = 1 UNION ALL
  SELECT c.document_id, c.slide_number, c.k, CASE WHEN {_CLEAR} THEN list_append(boxes, {{'x': c.x, 'y': c.y, 'w': c.width, 'h': c.height}}) ELSE boxes END, CASE WHEN {_CLEAR} THEN c.element_id END
  FROM g JOIN c ON c.document_id = g.document_id AND c.slide_number = g.slide_number AND c.k = g.k + 1)
SELECT document_id, slide_number, element_id FROM g WHERE element_id IS NOT NULL"""
ORACLES["split_numbers"] = r"""WITH RECURSIVE b AS (SELECT o_custkey AS document_id, o_custkey AS slide_number, o_orderkey AS id, CAST(o_orderkey % 12 * 60 AS DOUBLE) AS x, CAST(o_orderkey // 12 % 40 * 30 AS DOUBLE) AS y, 40.0::DOUBLE AS width,
  CASE WHEN o_orderkey % 2 = 0 THEN '$' || (o_orderkey % 900 + 1) || ',' ELSE CAST(o_orderkey % 900 + 100 AS VARCHAR) END AS text FROM orders),
o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY y, x, id) AS k FROM b),
n AS (SELECT a.*, c.k IS NOT NULL AND (a.text LIKE '%,' OR regexp_matches(a.text, '^[$][0-9]{1,3},?$')) AND regexp_matches(c.text, '^[0-9]{3}$') AND abs(c.y - a.y) < 50 AND c.x - (a.x + a.width) > 0 AND c.x - (a.x + a.width) < 100 AS fits,
  c.x + c.width - a.x AS w2, a.text || c.text AS t2 FROM o a LEFT JOIN o c ON c.document_id = a.document_id AND c.k = a.k + 1),
g(document_id, k, two) AS (SELECT document_id, k, coalesce(fits, false) FROM n WHERE k = 1 UNION ALL SELECT n.document_id, n.k, coalesce(n.fits, false) FROM g JOIN n ON n.document_id = g.document_id AND n.k = g.k + CASE WHEN two THEN 2 ELSE 1 END)
SELECT n.document_id, n.slide_number, n.id AS first_id, n.x, n.y, CASE WHEN two THEN w2 ELSE width END AS width, CASE WHEN two THEN t2 ELSE text END AS text, CASE WHEN two THEN 2 ELSE 1 END AS parts FROM g JOIN n USING (document_id, k)"""


def kahn(nodes: str, edges: str) -> str:
    """Common table expressions (WITH RECURSIVE) that end in od (page, element_id, position): one step takes the first of a page's queue and adds those
    whose sources are all done.  ``nodes``: page, element_id, x, y, ord; ``edges``: page, source, target."""
    page = "document_id, slide_number"
    return f"""ek AS (SELECT DISTINCT e.* FROM {edges} e JOIN {nodes} a ON a.document_id = e.document_id AND a.slide_number = e.slide_number AND a.element_id = e.source
  JOIN {nodes} b ON b.document_id = e.document_id AND b.slide_number = e.slide_number AND b.element_id = e.target),
tg AS (SELECT {page}, target, list(source) AS src FROM ek GROUP BY ALL),
fo AS (SELECT n.document_id, n.slide_number, n.element_id, coalesce(list({{'t': ek.target, 's': tg.src}} ORDER BY ek.target) FILTER (ek.target IS NOT NULL), []) AS nx FROM {nodes} n
  LEFT JOIN ek ON ek.document_id = n.document_id AND ek.slide_number = n.slide_number AND ek.source = n.element_id
  LEFT JOIN tg ON tg.document_id = n.document_id AND tg.slide_number = n.slide_number AND tg.target = ek.target GROUP BY ALL),
q0 AS (SELECT {page}, coalesce(list(element_id ORDER BY element_id) FILTER ((document_id, slide_number, element_id) NOT IN (SELECT (document_id, slide_number, target) FROM tg)), []) AS q FROM {nodes} GROUP BY {page}),
kz(document_id, slide_number, k, q, done) AS (SELECT {page}, 0, q, CAST([] AS BIGINT[]) FROM q0 UNION ALL
  SELECT z.document_id, z.slide_number, z.k + 1, list_concat(z.q[2:], [v.t FOR v IN list_filter(fo.nx, lambda v: len(list_filter(v.s, lambda s: s <> z.q[1] AND NOT list_contains(z.done, s))) = 0)]), list_append(z.done, z.q[1])
  FROM kz z JOIN fo ON fo.document_id = z.document_id AND fo.slide_number = z.slide_number AND fo.element_id = z.q[1]),
kd AS (SELECT {page}, arg_max(done, k) AS done FROM kz GROUP BY {page}),
od AS (SELECT {page}, unnest(done) AS element_id, generate_subscripts(done, 1) AS position FROM kd UNION ALL
  SELECT n.document_id, n.slide_number, n.element_id, len(kd.done) + row_number() OVER (PARTITION BY n.document_id, n.slide_number ORDER BY y, x, ord) FROM {nodes} n JOIN kd ON kd.document_id = n.document_id AND kd.slide_number = n.slide_number
  WHERE NOT list_contains(kd.done, n.element_id))"""


ORACLES["topo_order"] = f"""WITH RECURSIVE {ELEMENTS_SQL}, kn AS (SELECT * FROM el WHERE element_type <> 'connector'),
ke AS (SELECT document_id, slide_number, source_element_id AS source, target_element_id AS target FROM ({PAGES["connector_targets"]})), {kahn("kn", "ke")}
SELECT document_id, slide_number, element_id, CAST(position AS BIGINT) AS position FROM od"""
