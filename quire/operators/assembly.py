"""Records of pages out of many parts, in one shuffle.

Every part is rows of pages; all parts are dealt by page together, each row with one part filled, and a page's rows are put into one record where they meet.
A join a part would deal the growing record again for each, and needs the parts that a page lacks to be told apart."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.elements import PAGE


@dataclass(frozen=True)
class Part:
    """A field of a record: the columns of ``rows``, in ``order`` where there are many; a part that is not ``many`` has the first row."""

    name: str
    rows: DataFrame
    order: tuple[str, ...] = ()
    many: bool = True


def assembled(parts: list[Part], keys: list[str] | None = None) -> DataFrame:
    """One row a page (``keys``) with a column a part: a list of structs, empty where the page has none, or one struct, null where it has none."""
    keys = list(keys or PAGE)

    def one(part: Part) -> DataFrame:
        values = [c for c in part.rows.columns if c not in keys]
        at = F.struct(*(F.col(c) for c in part.order)) if part.order else F.lit(0)
        return part.rows.select(*keys, F.struct(at.alias("at"), F.struct(*values).alias("row")).alias(part.name))

    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(one, parts))
    made = [F.transform(F.array_sort(F.collect_list(p.name)), lambda s: s["row"]).alias(p.name) if p.many else F.min(p.name)["row"].alias(p.name) for p in parts]
    return rows.groupBy(*keys).agg(*made)


def page_payload(elements: DataFrame, relations: DataFrame, canvas: DataFrame, style: DataFrame, layout: DataFrame, purpose: DataFrame, hierarchy: DataFrame, regions: DataFrame) -> DataFrame:
    """What is needed to draw a page again: one row a page with the structs canvas, style, layout, purpose and hierarchy and the lists
    elements (with element_id), reading_order, relations and regions."""
    order = elements.select(*PAGE, "element_id", "position").where("position is not null")
    return assembled([
        Part("canvas", canvas, many=False), Part("style", style, many=False), Part("layout", layout, many=False), Part("purpose", purpose, many=False), Part("hierarchy", hierarchy, many=False),
        Part("elements", elements.drop("position"), ("element_id",)), Part("reading_order", order.select(*PAGE, "position", "element_id"), ("position",)),
        Part("relations", relations, ("source_element_id", "target_element_id", "instruction")), Part("regions", regions, ("name",)),
    ])


def _bytes(data_uri: str) -> Column:
    """The bytes of a data URI or of plain base64; null where there is none or it is none."""
    return F.expr(f"try_to_binary(nullif(element_at(split({data_uri}, ','), -1), ''), 'base64')")


def page_pictures(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """(page, picture, source): the bytes of a page's picture: its own (page_image, a data URI), else that of its first image element with one (image_data), else its
    drawn one (raster)."""
    first = elements.where("element_type = 'image' and coalesce(image_data, '') <> ''").groupBy(*PAGE).agg(F.min_by("image_data", "ord").alias("image_data"))
    p = pages.join(first, PAGE, "left").select(*PAGE, _bytes("page_image").alias("own"), _bytes("image_data").alias("element"), F.col("raster").alias("drawn"))
    source = F.expr("case when own is not null then 'page' when element is not null then 'element' when drawn is not null then 'raster' end")
    return p.select(*PAGE, F.coalesce("own", "element", "drawn").alias("picture"), source.alias("source"))


def _json(c: str) -> Column:
    """A text as a JSON string; characters beyond ASCII stay as they are."""
    out = F.col(c).cast("string")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def page_hashes(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """(page, page_hash): SHA-256 of a page's own picture (page_image), or where it has none of a JSON text of its number, title and elements in input order."""
    one = F.concat(F.lit('{"id": '), _json("element_id"), F.lit(', "text": '), _json("text"), F.lit(', "type": '), _json("element_type"), F.lit("}"))
    own = assembled([Part("page", pages.select(*PAGE, "title", "page_image"), many=False), Part("rows", elements.select(*PAGE, "ord", one.alias("row")), ("ord", "row"))])
    own = own.where("page is not null").select(*PAGE, F.col("page.title").alias("title"), _bytes("page.page_image").alias("picture"), F.expr("array_join(transform(rows, r -> r.row), ', ')").alias("rows"))
    text = F.concat(F.lit('{"elements": ['), "rows", F.lit('], "slide_number": '), F.col("slide_number").cast("string"), F.lit(', "title": '), _json("title"), F.lit("}"))
    return own.select(*PAGE, F.sha2(F.coalesce("picture", text.cast("binary")), 256).alias("page_hash"))
