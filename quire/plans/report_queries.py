"""Queries of reports, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import reports
from quire.plans.content_queries import read


def _parts(spark, sf_dir):
    """The lines of the documents as parts of reports, with bullets, numbers, decisions, examples and headings in turn."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "[\\n.]")).alias("ord", "line"))
    return d.selectExpr(
        "doc_id", "ord", "case when ord = 0 then 'flow' when ord = 1 and doc_id % 3 = 0 then 'summary' else element_at(array('step', 'layer', 'design'), cast(ord % 3 + 1 as int)) end as part",
        """concat(element_at(array('', '- Step 2: ', ' * This creates a binary decision node: ', 'then Based on this state: ', '• Topic: one, ', '-Title: a, b.  Example: ', 'It: “x”; example “', '- colour scheme of ', 'shapes ', 'Color scheme', '* ', 'Examples: '),
          cast((ord * 5 + doc_id) % 12 + 1 as int)), line) as text""",
    )


def reader_reports(spark, sf_dir):
    return reports.report(_parts(spark, sf_dir), "doc_id").withColumn("report", F.sha2("report", 256))


QUERIES = {f.__name__: f for f in (reader_reports,)}

_WS = r"[\t\n\x0B\f\r ]"
_STRIP = lambda c: rf"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
_HEAD = {k: "'" + v.replace("\n", "' || chr(10) || '") + "'" for k, v in reports.HEADINGS.items()}
_UNDER = lambda p: f"coalesce(string_agg(l, chr(10) ORDER BY ord, k) FILTER (part = '{p}'), {chr(39) * 2 if p in ('flow', 'summary') else 'NULL'})"
_DESIGN = " ".join(f"WHEN starts_with(lower(d), '{s}') THEN ['{h}']" for s, h in reports.GROUPS.items())

ORACLES = {
    "reader_reports": rf"""WITH w AS (SELECT doc_id, regexp_split_to_array(text, '[\n.]') AS w FROM documents), i AS (SELECT doc_id, unnest(w) AS line, generate_subscripts(w, 1) - 1 AS ord FROM w),
p AS (SELECT doc_id, ord, CASE WHEN ord = 0 THEN 'flow' WHEN ord = 1 AND doc_id % 3 = 0 THEN 'summary' ELSE (['step', 'layer', 'design'])[ord % 3 + 1] END AS part,
  (['', '- Step 2: ', ' * This creates a binary decision node: ', 'then Based on this state: ', '• Topic: one, ', '-Title: a, b.  Example: ', 'It: “x”; example “', '- colour scheme of ', 'shapes ', 'Color scheme', '* ', 'Examples: '])[(ord * 5 + doc_id) % 12 + 1] || line AS t FROM i),
c AS (SELECT *, {_STRIP(rf"regexp_replace(t, '^{_WS}*[-*•]?{_WS}*(Step{_WS}+[0-9]+:)?{_WS}*', '')")} AS s, {_STRIP(rf"regexp_replace(t, '^{_WS}*[-*•]?{_WS}*', '')")} AS y, regexp_replace({_STRIP('t')}, '^[-*•]{_WS}*', '') AS d FROM p),
b AS (SELECT *, {_STRIP("substr(y, strpos(y, ':') + 1)")} AS body, {_STRIP("split_part(y, ':', 1)")} AS title FROM c),
x AS (SELECT *, regexp_matches(body, '(?is)\bexample\b') AS has, regexp_replace({_STRIP("regexp_extract(body, '(?is)^(.*?)" + chr(92) + "bexample" + chr(92) + "b:?(.*)$', 1)")}, '[.,; ]+$', '') AS def, {_STRIP("regexp_extract(body, '(?is)^(.*?)" + chr(92) + "bexample" + chr(92) + "b:?(.*)$', 2)")} AS ex FROM b),
l AS (SELECT doc_id, ord, part, CASE part WHEN 'step' THEN CASE WHEN contains(s, '{reports.DECISION}') THEN ['{reports.DECISION}', {_STRIP(f"substr(s, strpos(s, '{reports.DECISION}') + {len(reports.DECISION)})")}] WHEN contains(s, '{reports.STATE}') THEN ['{reports.STATE}'] ELSE [s] END
  WHEN 'layer' THEN CASE WHEN NOT contains(y, ':') THEN [y] WHEN has THEN [title, def, 'Example:', CASE WHEN regexp_matches(ex, '^[“"]') THEN ex ELSE '“' || ex || '”' END] ELSE [title, body] END
  WHEN 'design' THEN CASE WHEN d = '' THEN [] WHEN lower(d) = 'color scheme' THEN ['Colour scheme:'] {_DESIGN} ELSE [d] END ELSE [t] END AS ls FROM x),
u AS (SELECT doc_id, ord, part, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM l)
SELECT doc_id, sha256(concat_ws(chr(10), {', '.join(f"{h}, {_UNDER(p)}" for p, h in _HEAD.items())})) AS report FROM u GROUP BY doc_id""",
}
