"""Slide decks as elements: a ``binaryFile`` scan whose packages are read by the standard library's zip and XML parsers.

One task reads whole decks, one at a time; rows leave slide by slide.  Groups are flattened: a child knows its group
(``parent``) and its place is mapped from the group's own coordinates.  A part that is missing or not XML gives no rows;
a shape without a place lies at 0 with no size; an empty folder gives an empty result.  Colours are those given as RGB; colours of the
theme are null, as is every style that a shape takes from its layout.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Namespaces of the format.
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
KINDS = {"sp": "shape", "pic": "image", "cxnSp": "connector", "grpSp": "group", "graphicFrame": "graphic"}
SCHEMA = """document_id string, slide_number int, element_id string, ord int, element_type string, x double, y double, width double, height double,
  text string, z_order int, parent string, placeholder string, slide_width double, slide_height double, table array<array<string>>, rotation double, name string, shape_type string,
  fill_color string, border_color string, border_width double, font_size double, font_family string, bold boolean, italic boolean, underline boolean, text_color string,
  paragraphs array<struct<level:int,text:string,list_type:string,bullet:string,alignment:string>>, begin_x double, begin_y double, end_x double, end_y double,
  merges array<struct<row:int,col:int,row_span:int,col_span:int>>, row_heights array<double>, column_widths array<double>, image_hash string, description string, image_role string,
  chart struct<title:string,chart_type:string,categories:array<string>,series:array<struct<name:string,values:array<string>>>>"""
SLIDES = "document_id string, slide_number int, title string, background_type string, background_color string, slide_width double, slide_height double, author string, presentation_title string, subject string, created string, modified string, document_hash string"
EMU_POINT = 12_700


def _parse(deck: zipfile.ZipFile, name: str):
    try:
        return ElementTree.fromstring(deck.read(name))
    except (KeyError, ElementTree.ParseError):
        return None


def slide_parts(deck: zipfile.ZipFile) -> list[str]:
    """Parts of the slides in the order of the presentation."""
    root, rels = _parse(deck, "ppt/presentation.xml"), _parse(deck, "ppt/_rels/presentation.xml.rels")
    if root is None or rels is None:
        return sorted((n for n in deck.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    target = {r.get("Id"): posixpath.normpath(posixpath.join("ppt", r.get("Target", ""))).lstrip("/") for r in rels}
    return [target[s.get(f"{R}id")] for s in root.iter(f"{P}sldId") if s.get(f"{R}id") in target]


def _number(node, key: str) -> float:
    return float(node.get(key, 0)) if node is not None else 0.0


def _paragraphs(node) -> str:
    return "\n".join(_line(p) for p in node.iter(f"{A}p"))


def _line(p) -> str:
    return "".join("\n" if t.tag == f"{A}br" else t.text or "" for t in p.iter() if t.tag in (f"{A}t", f"{A}br"))


def _rgb(node) -> str | None:
    """The RGB colour of a solid fill below ``node``."""
    color = node.find(f"{A}solidFill/{A}srgbClr") if node is not None else None
    return f"#{color.get('val', '').lower()}" if color is not None else None


def _lists(body) -> list[dict]:
    """Paragraphs with a text: level, list type, bullet or kind of number, alignment."""
    out = []
    for p in body.findall(f"{A}p"):
        own = p.find(f"{A}pPr")
        char, auto = (own.find(f"{A}buChar"), own.find(f"{A}buAutoNum")) if own is not None else (None, None)
        kind = "bulleted" if char is not None else "numbered" if auto is not None else None
        mark = char.get("char") if char is not None else auto.get("type", "arabicPeriod") if auto is not None else None
        text = _line(p).strip()
        if text:
            out.append({"level": int(own.get("lvl", 0)) if own is not None else 0, "text": text, "list_type": kind, "bullet": mark, "alignment": own.get("algn") if own is not None else None})
    return out


def _font(body) -> dict:
    """The style of a shape's first run."""
    run = next((r for p in body.findall(f"{A}p")[:1] for r in p.findall(f"{A}r")), None)
    own = run.find(f"{A}rPr") if run is not None else None
    if own is None:
        return {}
    face = own.find(f"{A}latin")
    yes = lambda k: own.get(k) in ("1", "true")
    return {"font_size": float(own.get("sz")) / 100 if own.get("sz") else None, "font_family": face.get("typeface") if face is not None else None, "bold": yes("b"), "italic": yes("i"), "underline": own.get("u", "none") != "none", "text_color": _rgb(own)}


def _grid(table) -> dict:
    """Texts, spans and sizes of a table."""
    cells, merges = [], []
    for i, row in enumerate(table.iter(f"{A}tr")):
        cells.append([_paragraphs(c) for c in row.findall(f"{A}tc")])
        for k, c in enumerate(row.findall(f"{A}tc")):
            if int(c.get("rowSpan", 1)) > 1 or int(c.get("gridSpan", 1)) > 1:
                merges.append({"row": i, "col": k, "row_span": int(c.get("rowSpan", 1)), "col_span": int(c.get("gridSpan", 1))})
    return {"table": cells, "merges": merges, "row_heights": [_number(r, "h") for r in table.iter(f"{A}tr")], "column_widths": [_number(c, "w") for c in table.iter(f"{A}gridCol")]}


def chart_data(tree) -> dict:
    """Title, type, categories and series of a chart part."""
    plot = next((n for n in tree.iter() if n.tag.startswith(C) and n.tag.endswith("Chart") and n.tag != f"{C}chart"), None)
    values = lambda node: [v.text or "" for v in node.iter(f"{C}v")] if node is not None else []
    series, categories = [], []
    for s in plot.findall(f"{C}ser") if plot is not None else []:
        categories = categories or values(s.find(f"{C}cat"))
        series.append({"name": (values(s.find(f"{C}tx")) or [""])[0], "values": values(s.find(f"{C}val"))})
    title = tree.find(f"{C}chart/{C}title")
    return {"title": _paragraphs(title) if title is not None else "", "chart_type": plot.tag.rsplit("}", 1)[-1] if plot is not None else "unknown", "categories": categories, "series": series}


def image_role(width: float, height: float, slide: tuple[float, float]) -> str:
    """Background above four fifths of the slide, icon below 48 points, else illustration."""
    if slide[0] * slide[1] > 0 and width * height / (slide[0] * slide[1]) > 0.8:
        return "background"
    return "icon" if width / EMU_POINT < 48 and height / EMU_POINT < 48 else "illustration"


def shapes(tree, scale=(1.0, 0.0, 1.0, 0.0), parent: str | None = None, part=lambda rid: None, slide=(12_192_000.0, 6_858_000.0)) -> Iterator[dict]:
    """Rows of a shape tree in drawing order; ``scale`` maps a group's inner coordinates to the slide's, ``part`` gives the bytes of a related part."""
    for node in tree:
        kind = KINDS.get(node.tag.rsplit("}", 1)[-1]) if node.tag.startswith(P) else None
        if kind is None:
            continue
        own = next((n for n in node.iter(f"{P}cNvPr")), None)
        name = own.get("id", "") if own is not None else ""
        xfrm = node.find(f"{P}xfrm") if kind == "graphic" else node.find(f"{P}{'grpSpPr' if kind == 'group' else 'spPr'}/{A}xfrm")
        off, ext = (xfrm.find(f"{A}off"), xfrm.find(f"{A}ext")) if xfrm is not None else (None, None)
        x, y, w, h = _number(off, "x"), _number(off, "y"), _number(ext, "cx"), _number(ext, "cy")
        ph = next((n for n in node.iter(f"{P}ph")), None) if kind != "group" else None
        table = next((n for n in node.iter(f"{A}tbl")), None) if kind == "graphic" else None
        body = node.find(f"{P}txBody")
        text = _paragraphs(body) if body is not None else ""
        if kind == "shape" and node.find(f"{P}nvSpPr/{P}cNvSpPr") is not None and node.find(f"{P}nvSpPr/{P}cNvSpPr").get("txBox") == "1" or ph is not None:
            kind = "text_box" if kind == "shape" else kind
        kind = ("table" if table is not None else "chart") if kind == "graphic" else kind
        at = (scale[0] * x + scale[1], scale[2] * y + scale[3], scale[0] * w, scale[2] * h)
        props = node.find(f"{P}spPr")
        form, border = (props.find(f"{A}prstGeom"), props.find(f"{A}ln")) if props is not None else (None, None)
        row = {
            "element_id": name, "element_type": kind, "x": at[0], "y": at[1], "width": at[2], "height": at[3], "text": text, "parent": parent, "placeholder": ph.get("type", "body") if ph is not None else None,
            "rotation": _number(xfrm, "rot") / 60_000, "name": own.get("name") if own is not None else None, "description": own.get("descr") if own is not None else None,
            "shape_type": form.get("prst") if form is not None else None, "fill_color": _rgb(props), "border_color": _rgb(border), "border_width": _number(border, "w") / EMU_POINT if border is not None else None,
        }
        if body is not None:
            row |= {**_font(body), "paragraphs": _lists(body)}
        if table is not None:
            row |= _grid(table)
        if kind == "connector":
            right, down = (xfrm is None or xfrm.get("flipH") != "1"), (xfrm is None or xfrm.get("flipV") != "1")
            xs, ys = ((at[0], at[0] + at[2]) if right else (at[0] + at[2], at[0])), ((at[1], at[1] + at[3]) if down else (at[1] + at[3], at[1]))
            row |= {"begin_x": xs[0], "begin_y": ys[0], "end_x": xs[1], "end_y": ys[1]}
        if kind == "image":
            blip = next((n for n in node.iter(f"{A}blip")), None)
            raw = part(blip.get(f"{R}embed")) if blip is not None else None
            row |= {"image_hash": hashlib.sha256(raw).hexdigest() if raw else None, "image_role": image_role(at[2], at[3], slide)}
        if kind == "chart":
            ref = next((n for n in node.iter(f"{C}chart")), None)
            raw = part(ref.get(f"{R}id")) if ref is not None else None
            try:
                row["chart"] = chart_data(ElementTree.fromstring(raw)) if raw else None
            except ElementTree.ParseError:
                row["chart"] = None
        yield row
        if kind == "group":
            inner = (xfrm.find(f"{A}chOff"), xfrm.find(f"{A}chExt")) if xfrm is not None else (None, None)
            sx = w / _number(inner[1], "cx") if _number(inner[1], "cx") else 1.0
            sy = h / _number(inner[1], "cy") if _number(inner[1], "cy") else 1.0
            dx, dy = x - sx * _number(inner[0], "x"), y - sy * _number(inner[0], "y")
            yield from shapes(node, (scale[0] * sx, scale[0] * dx + scale[1], scale[2] * sy, scale[2] * dy + scale[3]), name, part, slide)


def _targets(deck: zipfile.ZipFile, name: str) -> list[tuple[str, str, str]]:
    """Id, kind and part of each relationship of a part."""
    folder, base = posixpath.split(name)
    rels = _parse(deck, f"{folder}/_rels/{base}.rels")
    where = lambda r: posixpath.normpath(posixpath.join(folder, r.get("Target", ""))).lstrip("/")
    return [(r.get("Id"), r.get("Type", "").rsplit("/", 1)[-1], where(r)) for r in rels] if rels is not None else []


def _related(deck: zipfile.ZipFile, name: str):
    """A function from relationship ids of a part to the bytes of what they name."""
    target = {rid: where for rid, _, where in _targets(deck, name)}

    def part(rid: str | None) -> bytes | None:
        try:
            return deck.read(target[rid])
        except KeyError:
            return None

    return part


def placeholders(deck: zipfile.ZipFile, name: str, found: list[dict]) -> Iterator[dict]:
    """Placeholders of a slide (level 0, its rows given), of its layout (1) and of that one's master (2)."""
    for level, kind in enumerate(("slideLayout", "slideMaster", "")):
        for i, r in enumerate(found):
            if r["placeholder"]:
                yield {"level": level, "ord": i, "type": r["placeholder"], "text": r["text"], "y": r["y"]}
        name = next((where for _, k, where in _targets(deck, name) if k == kind), "")
        part = _parse(deck, name) if name else None
        tree = part.find(f"{P}cSld/{P}spTree") if part is not None else None
        found = list(shapes(tree)) if tree is not None else []


def background(slide) -> tuple[str, str | None]:
    """Type and colour of a slide's own background; white where it has none."""
    own = slide.find(f"{P}cSld/{P}bg/{P}bgPr")
    if own is None:
        return "solid", "#ffffff"
    if own.find(f"{A}blipFill") is not None:
        return "picture", None
    if own.find(f"{A}gradFill") is not None:
        first = next((c for c in own.iter(f"{A}srgbClr")), None)
        return "gradient", f"#{first.get('val', '').lower()}" if first is not None else "#ffffff"
    return "solid", _rgb(own) or "#ffffff"


def deck_rows(path: str, content: bytes, pages: frozenset[int] | None = None) -> Iterator[tuple[list[dict], list[dict], Iterator[dict]]]:
    """Rows of a deck's elements, its slide row and its placeholders, slide by slide; only of ``pages``, if given.  A file that is no zip package gives none."""
    try:
        deck = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return
    root, core = _parse(deck, "ppt/presentation.xml"), _parse(deck, "docProps/core.xml")
    size = root.find(f"{P}sldSz") if root is not None else None
    wide, high = _number(size, "cx") or 12_192_000.0, _number(size, "cy") or 6_858_000.0
    said = {n.tag.rsplit("}", 1)[-1]: n.text for n in core} if core is not None else {}
    meta = {"author": said.get("creator"), "presentation_title": said.get("title"), "subject": said.get("subject"), "created": said.get("created"), "modified": said.get("modified"), "document_hash": hashlib.sha256(content).hexdigest()}
    for k, part in enumerate(slide_parts(deck), 1):
        slide = _parse(deck, part) if pages is None or k in pages else None
        tree = slide.find(f"{P}cSld/{P}spTree") if slide is not None else None
        if tree is not None:
            found = list(shapes(tree, part=_related(deck, part), slide=(wide, high)))
            titles = [r["text"].strip() for r in found if r["placeholder"] in ("title", "ctrTitle") and r["text"].strip()] or [r["text"].strip() for r in found if r["text"].strip()]
            kind, color = background(slide)
            base = {"document_id": path, "slide_number": k, "slide_width": wide, "slide_height": high}
            yield [{**base, "ord": i, "z_order": i, **r} for i, r in enumerate(found)], [{**base, "title": titles[0] if titles else None, "background_type": kind, "background_color": color, **meta}], ({**base, **r} for r in placeholders(deck, part, found))


def _read(spark: SparkSession, path: str, fields: str, which: int, pages) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pptx").option("recursiveFileLookup", "true").load(path).select("path", "content")
    kinds = StructType.fromDDL(fields)
    arrow, wanted = to_arrow_schema(kinds), frozenset(pages) if pages is not None else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                for found in deck_rows(name.as_py(), content.as_py(), wanted):
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in found[which]], schema=arrow)

    return files.mapInArrow(scan, kinds)


def read_pptx(spark: SparkSession, path: str, pages=None) -> DataFrame:
    """The elements of every ``.pptx`` file below ``path``; other slides than ``pages`` are not parsed."""
    return _read(spark, path, SCHEMA, 0, pages)


def read_slides(spark: SparkSession, path: str, pages=None) -> DataFrame:
    """One row a slide: title (its placeholder's, else the first text), background, size, and the deck's own data and hash."""
    return _read(spark, path, SLIDES, 1, pages)


def read_placeholders(spark: SparkSession, path: str, pages=None) -> DataFrame:
    """One row a placeholder of a slide, its layout and its master (levels 0, 1, 2)."""
    return _read(spark, path, "document_id string, slide_number int, level int, ord int, type string, text string, y double", 2, pages)
