"""Queries over recognised texts and boxes, with the same in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import folds, ocr
from quire.plans.content_queries import read
from quire.sources.elements import ELEMENTS_SQL, elements_from_events

_PAGE = "document_id, slide_number"


def _amounts(spark, sf_dir):
    """Prices as they might be read: with wrong signs, letters for zeros, and ranges."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", F.format_number(F.col("l_extendedprice").cast("bigint"), 0).alias("s"))
    kinds = ("concat('S', s)", "concat('5', s)", "concat('$', translate(s, '0', 'o'))", "concat('8', s)", "concat('Ss', substr(s, 2))", "concat('$', s, ' _ $', s)", "concat('$', translate(s, '0', 'C'))", "concat('Solution ', s, ' So')")
    return li.selectExpr("case l_orderkey % 8 " + " ".join(f"when {i} then {k}" for i, k in enumerate(kinds)) + " end as read").groupBy("read").agg(F.count("*").alias("n"))


def ocr_currency_repair(spark, sf_dir):
    return _amounts(spark, sf_dir).select("read", ocr.currency_repair(F.col("read")).alias("repaired"), "n")


def ocr_numeric_repair(spark, sf_dir):
    """Prices with letters for digits, some with words beside them."""
    li = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "translate(cast(cast(l_extendedprice as bigint) as string), '0158', 'OlSB') as s")
    kinds = ("s", "concat(s, ' pcs')", "concat('Item no ', s)", "concat(' B', s, '% ')", "'IOSB'", "concat('Bills of ', s)", "concat('$', s, '.OO')")
    texts = li.selectExpr("case l_orderkey % 7 " + " ".join(f"when {i} then {k}" for i, k in enumerate(kinds)) + " end as read").groupBy("read").agg(F.count("*").alias("n"))
    return texts.select("read", ocr.numeric_repair(F.col("read")).alias("repaired"), "n")


def window_text_lines(spark, sf_dir):
    """Lines of the documents and of the pages' markup, by whether they belong to a program's window."""
    lines = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).unionByName(read(spark, sf_dir, "pages").select(F.explode(F.split("html", "[<>]")).alias("line")))
    return lines.select("line", ocr.window_text(F.col("line")).alias("window")).groupBy("window").agg(F.count("*").alias("n"), F.countDistinct("line").alias("kinds"))


def column_positions(spark, sf_dir):
    found = ocr.column_positions(elements_from_events(spark, sf_dir), 90_000)
    return found.select(*_PAGE.split(", "), "column_no", F.bround("position", 3).alias("position"), "members")


def ocr_table(spark, sf_dir):
    return ocr.table_from_boxes(elements_from_events(spark, sf_dir), 12_192_000.0, 6_858_000.0)


def _sure(spark, sf_dir):
    return elements_from_events(spark, sf_dir).withColumn("confidence", F.expr("cast((ord * 31) % 100 as double)"))


def ocr_dedup(spark, sf_dir):
    return ocr.dedup_boxes(_sure(spark, sf_dir))


def line_fragments(spark, sf_dir):
    words = F.expr("element_at(array('the sum of', 'all costs', 'Total', 'and so on', '$45', 'N/A'), cast(ord % 6 + 1 as int))")
    return ocr.merge_fragments(_sure(spark, sf_dir).where("element_type = 'text_box'").withColumn("text", words))


def shapes_without_text(spark, sf_dir):
    e = elements_from_events(spark, sf_dir)
    return ocr.not_mostly_text(e.where("element_type = 'shape'"), e.where("element_type = 'text_box'")).select(*_PAGE.split(", "), "element_id")


def running_mean_rows(spark, sf_dir):
    return folds.rows_by_running_mean(elements_from_events(spark, sf_dir))


QUERIES = {f.__name__: f for f in (ocr_currency_repair, ocr_numeric_repair, window_text_lines, column_positions, ocr_table, ocr_dedup, line_fragments, shapes_without_text, running_mean_rows)}


def _fold(rows: str, tolerance: str) -> str:
    """Row numbers by a running mean, for a table of (page, element_id, cy, ord): a fold over each page's sorted list."""
    step = f"""CASE WHEN abs(b.cy - a.s / a.k) > {tolerance} THEN {{'cy': b.cy, 's': b.cy, 'k': 1, 'n': a.n + 1, 'o': list_append(a.o, a.n + 1)}}
      ELSE {{'cy': b.cy, 's': a.s + b.cy, 'k': a.k + 1, 'n': a.n, 'o': list_append(a.o, a.n)}} END"""
    return f"""fl AS (SELECT {_PAGE}, list(element_id ORDER BY cy, ord) AS ids, list({{'cy': cy, 's': cy, 'k': 1, 'n': 1, 'o': [1]}} ORDER BY cy, ord) AS l FROM {rows} GROUP BY ALL),
fo AS (SELECT {_PAGE}, ids, list_reduce(l, lambda a, b: {step}).o AS o FROM fl),
numbered AS (SELECT {_PAGE}, unnest(ids) AS element_id, CAST(unnest(o) AS INT) AS "row" FROM fo)"""


_LEAD = lambda c, p: f"CASE WHEN regexp_matches({c}, '{p}') THEN '$' || substr({c}, 2) ELSE {c} END"
_TWICE = lambda c, p: f"regexp_replace(regexp_replace({c}, '{p}', '\\10\\2', 'g'), '{p}', '\\10\\2', 'g')"
_ZERO = _TWICE("t1", "([0-9])[oO]([0-9])")
_LETTERS, _DIGITS = "".join(ocr.SUBSTITUTES), "".join(v * len(k) for k, v in ocr.SUBSTITUTES.items())
_BESIDE = lambda i: f"regexp_matches(coalesce(c[{i}], ''), '^[0-9.,$%]$')"
_QUOTED = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)

ORACLES = {
    "ocr_currency_repair": rf"""WITH r AS (SELECT CASE l_orderkey % 8 WHEN 0 THEN 'S' || s WHEN 1 THEN '5' || s WHEN 2 THEN '$' || translate(s, '0', 'o') WHEN 3 THEN '8' || s WHEN 4 THEN 'Ss' || substr(s, 2)
  WHEN 5 THEN '$' || s || ' _ $' || s WHEN 6 THEN '$' || translate(s, '0', 'C') ELSE 'Solution ' || s || ' So' END AS read
  FROM (SELECT l_orderkey, format('{{:,}}', CAST(trunc(l_extendedprice) AS BIGINT)) AS s FROM lineitem)),
t0 AS (SELECT read, count(*) AS n, trim(read) AS t0 FROM r GROUP BY read),
t1 AS (SELECT *, regexp_replace(t0, '^[S5]([0-9]{{1,3}}([,. ][0-9]{{3}})+)$', '$\1') AS t1 FROM t0),
t2 AS (SELECT *, CASE WHEN regexp_matches(t1, '^[S$0-9]') THEN regexp_replace(regexp_replace({_ZERO}, '([0-9])[oO]([,.])', '\10\2', 'g'), '([,.])[oO]([0-9])', '\10\2', 'g') ELSE t1 END AS t2 FROM t1),
t3 AS (SELECT *, {_LEAD('t2', '^5[0-9]{2,3},[0-9]{3}')} AS t3 FROM t2), t4 AS (SELECT *, {_LEAD('t3', '^S[0-9]')} AS t4 FROM t3),
t5 AS (SELECT *, CASE WHEN regexp_matches(t4, '^[S5][0-9]{{2}},\s*[0-9]') THEN '$' || substr(translate(t4, 'oO ', '00'), 2) ELSE t4 END AS t5 FROM t4),
t6 AS (SELECT *, {_LEAD('t5', '^8[0-9]{3},[0-9]{3}$')} AS t6 FROM t5), t7 AS (SELECT *, {_TWICE('t6', '([0-9])[Cc]([0-9])')} AS t7 FROM t6),
t8 AS (SELECT *, CASE WHEN starts_with(t7, 'Ss') THEN '$6' || substr(t7, 3) ELSE t7 END AS t8 FROM t7)
SELECT read, regexp_replace(t8, '\s*_\s*', ' – ', 'g') AS repaired, n FROM t8""",
    "ocr_numeric_repair": rf"""WITH r AS (SELECT CASE l_orderkey % 7 WHEN 0 THEN s WHEN 1 THEN s || ' pcs' WHEN 2 THEN 'Item no ' || s WHEN 3 THEN ' B' || s || '% ' WHEN 4 THEN 'IOSB' WHEN 5 THEN 'Bills of ' || s ELSE '$' || s || '.OO' END AS read
  FROM (SELECT l_orderkey, translate(CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS VARCHAR), '0158', 'OlSB') AS s FROM lineitem)),
g AS (SELECT read, count(*) AS n, trim(read) AS t FROM r GROUP BY read),
k AS (SELECT *, string_split(t, '') AS c, length(regexp_replace(t, '[^0-9$€£¥%.,+\-/* ]', '', 'g')) AS known, length(regexp_replace(t, '[^{_LETTERS}]', '', 'g')) AS unsure FROM g)
SELECT read, CASE WHEN known + 2 * unsure > length(t) THEN array_to_string(list_transform(c, lambda x, i: CASE WHEN (length(t) <= 5 AND known + unsure = length(t)) OR {_BESIDE('i - 1')} OR {_BESIDE('i + 1')}
  THEN translate(x, '{_LETTERS}', '{_DIGITS}') ELSE x END), '') ELSE read END AS repaired, n FROM k""",
    "window_text_lines": rf"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT unnest(regexp_split_to_array(html, '[<>]')) FROM pages),
t AS (SELECT line, regexp_replace(line, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g') AS t FROM l)
SELECT t IN ({_QUOTED(ocr.WINDOW_TEXTS + ocr.ICONS)}) OR regexp_matches(t, '(?i){"|".join(ocr.WINDOW_PATTERNS)}') AS "window", count(*) AS n, count(DISTINCT line) AS kinds FROM t GROUP BY 1""",
    "column_positions": f"""WITH {ELEMENTS_SQL}, c AS (SELECT {_PAGE}, ord, x + width / 2 AS cx FROM el), b AS (SELECT *, lag(cx) OVER (PARTITION BY {_PAGE} ORDER BY cx, ord) AS p FROM c),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR cx - p > 90000 THEN 1 ELSE 0 END) OVER (PARTITION BY {_PAGE} ORDER BY cx, ord ROWS UNBOUNDED PRECEDING) AS column_no FROM b)
SELECT {_PAGE}, CAST(column_no AS BIGINT) AS column_no, round_even(avg(cx), 3) AS position, count(*) AS members FROM g GROUP BY {_PAGE}, column_no""",
    "running_mean_rows": f"""WITH {ELEMENTS_SQL}, r AS (SELECT {_PAGE}, element_id, ord, y + height / 2 AS cy FROM el), {_fold('r', '150000')} SELECT * FROM numbered""",
    "ocr_table": f"""WITH {ELEMENTS_SQL}, low AS (SELECT *, y + height / 2 AS cy, x + width / 2 AS cx FROM el WHERE height < 0.05 * 6858000 AND trim(text) <> '' QUALIFY count(*) OVER (PARTITION BY {_PAGE}) >= 6),
{_fold('low', '0.02 * 6858000')}, rw AS (SELECT low.*, numbered."row" FROM low JOIN numbered USING ({_PAGE}, element_id) QUALIFY max("row") OVER (PARTITION BY {_PAGE}) >= 3),
b AS (SELECT {_PAGE}, cx, ord, lag(cx) OVER (PARTITION BY {_PAGE} ORDER BY cx, ord) AS p FROM rw),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR cx - p > 0.03 * 12192000 THEN 1 ELSE 0 END) OVER (PARTITION BY {_PAGE} ORDER BY cx, ord ROWS UNBOUNDED PRECEDING) AS col FROM b),
cols AS (SELECT {_PAGE}, col, avg(cx) AS position FROM g GROUP BY {_PAGE}, col QUALIFY count(*) OVER (PARTITION BY {_PAGE}) >= 2),
near AS (SELECT rw.*, col, abs(cx - position) AS d FROM rw JOIN cols USING ({_PAGE}) QUALIFY row_number() OVER (PARTITION BY {_PAGE}, element_id ORDER BY abs(cx - position), col) = 1)
SELECT {_PAGE}, "row", CAST(col AS BIGINT) AS col, string_agg(trim(text), ' ' ORDER BY cy, ord, text) AS text FROM near WHERE d < 0.05 * 12192000 GROUP BY ALL""",
    "shapes_without_text": f"""WITH {ELEMENTS_SQL} SELECT {_PAGE}, element_id FROM el s WHERE element_type = 'shape' AND NOT EXISTS (SELECT 1 FROM el t WHERE t.element_type = 'text_box' AND t.document_id = s.document_id AND t.slide_number = s.slide_number
  AND least(s.x + s.width, t.x + t.width) > greatest(s.x, t.x) AND least(s.y + s.height, t.y + t.height) > greatest(s.y, t.y)
  AND (least(s.x + s.width, t.x + t.width) - greatest(s.x, t.x)) * (least(s.y + s.height, t.y + t.height) - greatest(s.y, t.y)) > 0.45 * least(s.width * s.height, t.width * t.height))""",
}

#: A page's boxes one after the other, with the list of those that left; a box's later ones that it covers are listed with it.
_BOTH = "(least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * (least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))"
_SURER = "list_position([q.s FOR q IN own], true)"
ORACLES["ocr_dedup"] = f"""WITH RECURSIVE {ELEMENTS_SQL}, e AS (SELECT *, ord * 31 % 100 AS c FROM el),
p AS (SELECT a.document_id, a.slide_number, a.element_id, a.ord, list({{'b': b.element_id, 's': b.c > a.c}} ORDER BY b.ord) AS l FROM e a JOIN e b ON a.document_id = b.document_id AND a.slide_number = b.slide_number AND a.ord < b.ord
  AND least(a.x + a.width, b.x + b.width) > greatest(a.x, b.x) AND least(a.y + a.height, b.y + b.height) > greatest(a.y, b.y) AND {_BOTH} > 0.5 * least(a.width * a.height, b.width * b.height) GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY {_PAGE} ORDER BY ord) AS k FROM p),
z(document_id, slide_number, k, gone) AS (SELECT DISTINCT {_PAGE}, CAST(0 AS BIGINT), [CAST(-1 AS BIGINT)] FROM n UNION ALL
  SELECT {_PAGE}, k, CASE WHEN list_contains(gone, element_id) THEN gone WHEN coalesce({_SURER}, 0) = 0 THEN list_concat(gone, [q.b FOR q IN own]) ELSE list_concat(gone, list_append([q.b FOR q IN own[1:{_SURER} - 1]], element_id)) END
  FROM (SELECT n.document_id, n.slide_number, n.k, z.gone, n.element_id, list_filter(n.l, lambda q: NOT list_contains(z.gone, q.b)) AS own FROM z JOIN n ON n.document_id = z.document_id AND n.slide_number = z.slide_number AND n.k = z.k + 1)),
g AS (SELECT {_PAGE}, unnest(arg_max(gone, k)) AS element_id FROM z GROUP BY {_PAGE})
SELECT {_PAGE}, element_id FROM el ANTI JOIN g USING ({_PAGE}, element_id)"""
