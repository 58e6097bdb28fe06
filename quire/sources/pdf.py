"""PDF files as elements, read by a small parser of the format.

What is read: page trees with their boxes, content streams that are plain or Flate-compressed (object streams too), text that is shown with
simple fonts (one byte a character, or a ToUnicode map), filled and stroked rectangles and lines, and placed images.  Widths are those of the
font where it gives them, else half the size a character.  Pages that are not asked for are not parsed.  A file that is no PDF, is
encrypted or broken gives no rows for what cannot be read; an empty folder gives an empty result.  Places are points times 12,700, from the top.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCALE = 12_700.0
SCHEMA = """document_id string, slide_number int, element_id string, ord int, element_type string, x double, y double, width double, height double, text string, z_order int,
  font_size double, font_family string, bold boolean, italic boolean, text_color string, fill_color string, border_color string, border_width double, shape_type string, page_width double, page_height double, rotation double"""
_TOKEN = re.compile(
    rb"(?P<space>[\x00\t\n\x0c\r ]+|%[^\r\n]*)|(?P<open><<)|(?P<close>>>)|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<name>/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<arr>[\[\]])|(?P<str>\()|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<other>.)",
    re.S,
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name object."""


class Ref(tuple):
    """A reference to an object: (number, generation)."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            e = data[at : at + 1]
            octal = re.match(rb"[0-7]{1,3}", data[at : at + 3])
            if octal:
                out.append(int(octal.group(), 8) & 255)
                at += len(octal.group())
            else:
                out += b"" if e in (b"\n", b"\r") else _ESCAPES.get(e, e)
                at += 1
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Numbers, names, strings, and words or brackets as bytes, with the place after each."""
    while at < len(data):
        m = _TOKEN.match(data, at)
        at, kind, raw = m.end(), m.lastgroup, m.group()
        if kind in ("space", "other"):
            continue
        if kind == "str":
            raw, at = _string(data, at)
            yield ("s", raw), at
        elif kind == "hex":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
            yield ("s", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())), at
        elif kind == "name":
            yield Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x.group(1), 16)]), raw[1:]).decode("latin-1")), at
        elif kind == "num":
            yield float(raw) if b"." in raw else int(raw), at
        else:
            yield raw, at


def parse(data: bytes, at: int = 0) -> tuple[object, int]:
    """One object: dict, list, string as ("s", bytes), name, number, reference or word."""
    stack: list[list] = [[]]
    kinds: list[bytes] = []
    for token, after in tokens(data, at):
        if token in (b"<<", b"["):
            stack.append([])
            kinds.append(token)
            continue
        if token in (b">>", b"]") and kinds:
            items = stack.pop()
            kinds.pop()
            token = items if token == b"]" else dict(zip(items[::2], items[1::2], strict=False))
        elif token == b"R" and len(stack[-1]) >= 2:
            generation, number = stack[-1].pop(), stack[-1].pop()
            token = Ref((number, generation))
        stack[-1].append(token)
        if not kinds:
            # a reference is three tokens: look ahead
            ahead = re.match(rb"\s+\d+\s+R\b", data[after : after + 24]) if isinstance(token, int) else None
            if not ahead:
                return stack[0][-1], after
    return (stack[0][-1] if stack[0] else None), len(data)


class Pdf:
    """The objects of a file, found by their headers, so that a broken cross-reference table does not matter."""

    def __init__(self, data: bytes):
        self.data, self.at, self.made = data, {}, {}
        for m in re.finditer(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b", data):
            self.at[int(m.group(1))] = m.end()
        for number in list(self.at):
            o = self.get(Ref((number, 0)))
            if isinstance(o, tuple) and isinstance(o[0], dict) and o[0].get("Type") == "ObjStm":
                body, first = self.stream(o), int(self.get(o[0].get("First", 0)))
                head = [t for t, _ in tokens(body[:first])]
                for n, offset in zip(head[::2], head[1::2], strict=False):
                    if n not in self.at:
                        self.made[n] = parse(body, first + offset)[0]

    def get(self, o):
        """What a reference stands for; a stream is (dict, bytes)."""
        if not isinstance(o, Ref):
            return o
        number = o[0]
        if number not in self.made:
            self.made[number] = None
            if number in self.at:
                value, after = parse(self.data, self.at[number])
                m = re.match(rb"\s*stream\r?\n", self.data[after : after + 16])
                if m and isinstance(value, dict):
                    start, size = after + m.end(), self.get(value.get("Length"))
                    end = start + size if isinstance(size, int) and self.data[start + size : start + size + 20].lstrip().startswith(b"endstream") else self.data.find(b"endstream", start)
                    value = (value, self.data[start : end if end >= 0 else len(self.data)])
                self.made[number] = value
        return self.made[number]

    def stream(self, o) -> bytes:
        """The bytes of a stream; empty where its filter is not known."""
        o = self.get(o)
        if not (isinstance(o, tuple) and len(o) == 2 and isinstance(o[0], dict)):
            return b""
        filters = self.get(o[0].get("Filter"))
        raw = o[1]
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if f != "FlateDecode":
                return b""
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error:
                return b""
        return raw

    def pages(self) -> Iterator[dict]:
        """Page dictionaries in order, with what they inherit."""
        root = next((o for n in self.at if isinstance(o := self.get(Ref((n, 0))), dict) and o.get("Type") == "Catalog"), None)
        top = self.get(root.get("Pages")) if root else None
        seen: set[int] = set()

        def walk(node, given: dict) -> Iterator[dict]:
            node = self.get(node)
            if not isinstance(node, dict) or id(node) in seen:
                return
            seen.add(id(node))
            given = given | {k: node[k] for k in ("MediaBox", "Resources", "Rotate") if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    yield from walk(kid, given)
            else:
                yield given | node

        if top is not None:
            yield from walk(top, {})
        else:
            yield from (o for n in sorted(self.at) if isinstance(o := self.get(Ref((n, 0))), dict) and o.get("Type") == "Page")


class Font:
    def __init__(self, pdf: Pdf, o):
        o = pdf.get(o) or {}
        self.name = str(o.get("BaseFont", "")).split("+")[-1]
        self.first, widths = pdf.get(o.get("FirstChar", 0)) or 0, pdf.get(o.get("Widths")) or []
        self.widths = [w if isinstance(w := pdf.get(x), int | float) else 0 for x in widths]
        self.wide, self.map = o.get("Subtype") == "Type0", {}
        for pattern in (rb"beginbfchar(.*?)endbfchar", rb"beginbfrange(.*?)endbfrange"):
            for block in re.findall(pattern, pdf.stream(o.get("ToUnicode")), re.S):
                codes = [t[1] for t, _ in tokens(block) if isinstance(t, tuple)]
                step = 2 if b"bfchar" in pattern else 3
                for row in zip(*(codes[i::step] for i in range(step)), strict=False):
                    text, low = row[-1].decode("utf-16-be", "replace"), int.from_bytes(row[0])
                    for k in range(int.from_bytes(row[1]) - low + 1 if step == 3 else 1):
                        if k < 65_536 and text:
                            self.map[low + k] = text[:-1] + chr(ord(text[-1]) + k)

    def read(self, raw: bytes) -> tuple[str, float]:
        """The text of a string, and its width in thousandths of the size."""
        codes = [int.from_bytes(raw[i : i + 2]) for i in range(0, len(raw), 2)] if self.wide else list(raw)
        text = "".join(self.map.get(c) or ("" if self.wide else bytes([c]).decode("cp1252", "replace")) for c in codes)
        width = sum(self.widths[c - self.first] if 0 <= c - self.first < len(self.widths) else 500 for c in codes)
        return text, width


def _times(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def _hex(parts: list) -> str | None:
    if len(parts) == 1:
        parts = parts * 3
    if len(parts) == 4:
        parts = [(1 - min(1.0, p)) * (1 - min(1.0, parts[3])) for p in parts[:3]]
    return "#{:02x}{:02x}{:02x}".format(*(int(max(0.0, min(1.0, p)) * 255) for p in parts)) if len(parts) == 3 else None


def page_rows(pdf: Pdf, page: dict) -> list[dict]:
    """Texts, drawings and images of a page in drawing order, in points from the upper left."""
    box = [float(x) for x in (pdf.get(page.get("MediaBox")) or [0, 0, 612, 792])]
    res = pdf.get(page.get("Resources")) or {}
    fonts, made = pdf.get(res.get("Font")) or {}, {}
    objects = pdf.get(res.get("XObject")) or {}
    contents = pdf.get(page.get("Contents"))
    data = b"\n".join(pdf.stream(c) for c in (contents if isinstance(contents, list) else [page.get("Contents")]))
    rows: list[dict] = []
    ctm, saved = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), []
    tm = line = ctm
    font, size, leading, space = None, 0.0, 0.0, 0.0
    fill, stroke, wide = "#000000", "#000000", 1.0
    path: list[tuple[float, float]] = []
    args: list = []

    def put(kind: str, points, **more) -> None:
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        rows.append({"element_type": kind, "x": min(xs) - box[0], "y": box[3] - max(ys), "width": max(xs) - min(xs), "height": max(ys) - min(ys), **more})

    def at(x: float, y: float, m) -> tuple[float, float]:
        return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]

    def show(parts) -> None:
        nonlocal tm
        text, start = "", tm
        for p in parts:
            if isinstance(p, tuple):
                said, w = font.read(p[1]) if font else ("", 0)
                text += said
                tm = _times((1, 0, 0, 1, w / 1000 * size + space * len(said), 0), tm)
            elif isinstance(p, int | float):
                text += " " if p < -200 else ""
                tm = _times((1, 0, 0, 1, -p / 1000 * size, 0), tm)
        if text.strip():
            m = _times(start, ctm)
            end = at(0, 0, _times(tm, ctm))
            name = font.name
            put("text_box", [at(0, -0.2 * size, m), at(0, 0.8 * size, m), end], text=text.strip(), font_size=round(abs(size * m[3]), 3), font_family=name, bold="bold" in name.lower(), italic=bool(re.search("italic|oblique", name.lower())), text_color=fill)

    number = lambda k: [float(a) for a in args[-k:]] if len(args) >= k and all(isinstance(a, int | float) for a in args[-k:]) else None
    inside: list | None = None
    for token, _ in tokens(data):
        if token == b"[":
            inside = []
            continue
        if token == b"]":
            args.append(inside or [])
            inside = None
            continue
        if not isinstance(token, bytes):
            (args if inside is None else inside).append(token)
            continue
        op, n2, n3, n4, n6 = token, number(2), number(3), number(4), number(6)
        if op == b"q":
            saved.append((ctm, fill, stroke, wide))
        elif op == b"Q" and saved:
            ctm, fill, stroke, wide = saved.pop()
        elif op == b"cm" and n6:
            ctm = _times(tuple(n6), ctm)
        elif op == b"BT":
            tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        elif op == b"Tf" and len(args) >= 2 and isinstance(args[-1], int | float):
            key, size = args[-2], float(args[-1])
            font = made[key] if key in made else made.setdefault(key, Font(pdf, fonts.get(key)))
        elif op == b"Tm" and n6:
            tm = line = tuple(n6)
        elif op in (b"Td", b"TD") and n2:
            leading = -n2[1] if op == b"TD" else leading
            tm = line = _times((1, 0, 0, 1, *n2), line)
        elif op == b"TL" and number(1):
            leading = number(1)[0]
        elif op == b"Tc" and number(1):
            space = number(1)[0]
        elif op == b"T*":
            tm = line = _times((1, 0, 0, 1, 0, -leading), line)
        elif op in (b"Tj", b"'") and args and isinstance(args[-1], tuple):
            if op == b"'":
                tm = line = _times((1, 0, 0, 1, 0, -leading), line)
            show([args[-1]])
        elif op == b"TJ" and args and isinstance(args[-1], list):
            show(args[-1])
        elif op in (b"rg", b"g", b"k"):
            fill = _hex(number({b"rg": 3, b"g": 1, b"k": 4}[op]) or []) or fill
        elif op in (b"RG", b"G", b"K"):
            stroke = _hex(number({b"RG": 3, b"G": 1, b"K": 4}[op]) or []) or stroke
        elif op == b"w" and number(1):
            wide = number(1)[0]
        elif op == b"re" and n4:
            x, y, w, h = n4
            path += [at(x, y, ctm), at(x + w, y + h, ctm)]
        elif op in (b"m", b"l") and n2:
            path.append(at(*n2, ctm))
        elif op == b"c" and n6:
            path += [at(*n6[4:], ctm)]
        elif op in (b"f", b"F", b"f*", b"S", b"s", b"B", b"B*", b"b", b"b*", b"n"):
            if path and op != b"n":
                filled, lined = op.lower()[:1] in (b"f", b"b"), op[:1] in (b"S", b"s", b"B", b"b")
                flat = max(p[0] for p in path) - min(p[0] for p in path) < 0.01 or max(p[1] for p in path) - min(p[1] for p in path) < 0.01
                put("shape", path, text="", fill_color=fill if filled else None, border_color=stroke if lined else None, border_width=wide if lined else None, shape_type="line" if flat else "rect")
            path = []
        elif op == b"Do" and args:
            o = pdf.get(objects.get(args[-1]))
            if isinstance(o, tuple) and o[0].get("Subtype") == "Image":
                put("image", [at(0, 0, ctm), at(1, 1, ctm)], text="")
        args = []
    return rows


def file_rows(path: str, content: bytes, pages: frozenset[int] | None = None) -> Iterator[list[dict]]:
    """Rows of a file, one list a page; only of ``pages``, if given."""
    if not content.lstrip()[:5].startswith(b"%PDF"):
        return
    pdf = Pdf(content)
    for k, page in enumerate(pdf.pages(), 1):
        if pages is not None and k not in pages:
            continue
        box = [float(x) for x in (pdf.get(page.get("MediaBox")) or [0, 0, 612, 792])]
        base = {"document_id": path, "slide_number": k, "page_width": (box[2] - box[0]) * SCALE, "page_height": (box[3] - box[1]) * SCALE, "rotation": float(pdf.get(page.get("Rotate", 0)) or 0)}
        scaled = [{**r, **{c: r[c] * SCALE for c in ("x", "y", "width", "height")}} for r in page_rows(pdf, page)]
        yield [{**base, "ord": i, "z_order": i + 1, "element_id": f"slide_{k}_{r['element_type']}_{i + 1}", **r} for i, r in enumerate(scaled)]


def read_pdf(spark: SparkSession, path: str, pages=None) -> DataFrame:
    """The elements of every ``.pdf`` file below ``path``; other pages than ``pages`` are not parsed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select("path", "content")
    kinds = StructType.fromDDL(SCHEMA)
    arrow, wanted = to_arrow_schema(kinds), frozenset(pages) if pages is not None else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                for rows in file_rows(name.as_py(), content.as_py(), wanted):
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in rows], schema=arrow)

    return files.mapInArrow(scan, kinds)
