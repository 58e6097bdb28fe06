"""Reports of what a page says, for readers.

Null texts count as empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.forms import strip

#: Headings of a report, of its groups of design lines, and the sentences that steps are known by.
HEADINGS = {"flow": "Semantic Flow", "step": "\nStep-by-step meaning:", "layer": "\nConceptual Layers", "design": "\nVisual Design Details", "summary": "\n3. Plain English Summary"}
GROUPS = {"colour scheme": "Colour scheme:", "shapes": "Shapes:", "structure": "Structure:", "connectors": "Connectors:"}
DECISION, STATE = "This creates a binary decision node:", "Based on this state:"
EXAMPLE = r"(?is)^(.*?)\bexample\b:?(.*)$"


def step_lines(text: Column) -> Column:
    """Lines of a step, without bullet and number; what follows a decision is a line of its own."""
    t = strip(F.regexp_replace(text, r"^\s*[-*•]?\s*(?:Step\s+\d+:)?\s*", ""))
    after = strip(F.substr(t, F.instr(t, DECISION) + len(DECISION)))
    return F.when(F.contains(t, F.lit(DECISION)), F.array(F.lit(DECISION), after)).when(F.contains(t, F.lit(STATE)), F.array(F.lit(STATE))).otherwise(F.array(t))


def layer_lines(text: Column) -> Column:
    """Lines of a layer: title, definition and a quoted example, as far as it has them."""
    t = strip(F.regexp_replace(text, r"^\s*[-*•]?\s*", ""))
    title, body = strip(F.split_part(t, F.lit(":"), F.lit(1))), strip(F.substr(t, F.instr(t, ":") + 1))
    definition, example = F.regexp_replace(strip(F.regexp_extract(body, EXAMPLE, 1)), "[.,; ]+$", ""), strip(F.regexp_extract(body, EXAMPLE, 2))
    quoted = F.when(example.rlike('^[“"]'), example).otherwise(F.concat(F.lit("“"), example, F.lit("”")))
    told = F.when(body.rlike(EXAMPLE), F.array(title, definition, F.lit("Example:"), quoted)).otherwise(F.array(title, body))
    return F.when(F.contains(t, F.lit(":")), told).otherwise(F.array(t))


def design_lines(text: Column) -> Column:
    """The line of a design detail without its bullet, a group's heading in its own spelling; none for an empty one."""
    t = F.regexp_replace(strip(text), r"^[-*•]\s*", "")
    low = F.lower(t)
    c = F.when(low == "color scheme", GROUPS["colour scheme"])
    for start, heading in GROUPS.items():
        c = c.when(F.startswith(low, F.lit(start)), heading)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.array(c.otherwise(t)))


def report(parts: DataFrame, key: str) -> DataFrame:
    """(key, report): the parts (key, part, ord, text) of each page under their headings in order; a missing flow or summary is an empty line."""
    text = F.coalesce("text", F.lit(""))
    lines = F.when(F.col("part") == "step", step_lines(text)).when(F.col("part") == "layer", layer_lines(text)).when(F.col("part") == "design", design_lines(text)).otherwise(F.array(text))
    one = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "part", lines.alias("lines")))).alias("all"))

    def under(part: str) -> Column:
        own = F.flatten(F.transform(F.filter("all", lambda s: s["part"] == part), lambda s: s["lines"]))
        return F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(""))) if part in ("flow", "summary") else own

    return one.select(key, F.array_join(F.flatten(F.array(*(F.concat(F.array(F.lit(h)), under(p)) for p, h in HEADINGS.items()))), "\n").alias("report"))
