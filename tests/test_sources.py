"""Sources and sinks: a deck made by hand, round trips through files."""

from __future__ import annotations

import zipfile

from quire.operators import pagefacts
from quire.sources import pptx, sinks
from quire.sources.elements import elements_from_events

NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def place(x, y, w, h, more=""):
    return f'<a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/>{more}</a:xfrm>'


def named(tag, i):
    return f'<p:nv{tag}Pr><p:cNvPr id="{i}" name="n"/><p:cNv{tag}Pr txBox="1"/><p:nvPr/></p:nv{tag}Pr>'


def deck(path, *slides):
    with zipfile.ZipFile(path, "w") as z:
        ids = "".join(f'<p:sldId id="{i}" r:id="r{i}"/>' for i in range(len(slides)))
        z.writestr("ppt/presentation.xml", f'<p:presentation {NS}><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="1000" cy="500"/></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="slides/slide{len(slides) - i}.xml"/>' for i in range(len(slides))) + "</Relationships>")
        for i, s in enumerate(slides):
            z.writestr(f"ppt/slides/slide{len(slides) - i}.xml", f"<p:sld {NS}><p:cSld><p:spTree>{s}</p:spTree></p:cSld></p:sld>")


def test_deck(spark, tmp_path):
    text = f"<p:sp>{named('Sp', 2)}<p:spPr>{place(10, 20, 30, 8)}</p:spPr><p:txBody><a:p><a:r><a:t>Exact</a:t></a:r></a:p><a:p><a:r><a:t>line 2</a:t></a:r></a:p></p:txBody></p:sp>"
    inner = f"<p:sp>{named('Sp', 4)}<p:spPr>{place(5, 5, 10, 10)}</p:spPr></p:sp>"
    group = f"<p:grpSp>{named('GrpSp', 3)}<p:grpSpPr>{place(100, 100, 200, 200, '<a:chOff x=\"0\" y=\"0\"/><a:chExt cx=\"20\" cy=\"20\"/>')}</p:grpSpPr>{inner}</p:grpSp>"
    cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = f"<p:graphicFrame>{named('GraphicFrame', 5)}{place(0, 40, 100, 20).replace('a:xfrm', 'p:xfrm')}<a:graphic><a:graphicData><a:tbl><a:tr>{cell('A')}{cell('')}</a:tr><a:tr>{cell('')}{cell('D')}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    deck(tmp_path / "one.pptx", text + group, table)
    (tmp_path / "broken.pptx").write_bytes(b"no zip")
    rows = {(r["slide_number"], r["element_id"]): r for r in pptx.read_pptx(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [(1, "2"), (1, "3"), (1, "4"), (2, "5")]
    r = rows[1, "2"]
    assert (r["element_type"], r["text"], r["x"], r["y"], r["width"], r["height"], r["slide_width"]) == ("text_box", "Exact\nline 2", 10.0, 20.0, 30.0, 8.0, 1000.0)
    r = rows[1, "4"]
    assert (r["parent"], r["x"], r["y"], r["width"]) == ("3", 150.0, 150.0, 100.0)
    assert rows[2, "5"]["element_type"] == "table" and rows[2, "5"]["table"] == [["A", ""], ["", "D"]]


def test_placeholders_of_layout_and_master(spark, tmp_path):
    part = lambda tag, shapes: f"<p:{tag} {NS}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:{tag}>"
    one = lambda i, kind, text, y: f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="n"/><p:cNvSpPr/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr>{place(0, y, 10, 10)}</p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    rel = lambda kind, target: f'<Relationships><Relationship Id="r1" Type="http://x/{kind}" Target="{target}"/></Relationships>'
    deck(tmp_path / "d.pptx", one(2, "title", "Own title", 10) + one(3, "ftr", "", 0))
    with zipfile.ZipFile(tmp_path / "d.pptx", "a") as z:
        z.writestr("ppt/slides/_rels/slide1.xml.rels", rel("slideLayout", "../slideLayouts/l.xml"))
        z.writestr("ppt/slideLayouts/l.xml", part("sldLayout", one(2, "ftr", "Layout footer", 0)))
        z.writestr("ppt/slideLayouts/_rels/l.xml.rels", rel("slideMaster", "../slideMasters/m.xml"))
        z.writestr("ppt/slideMasters/m.xml", part("sldMaster", one(2, "ftr", "Master footer", 0) + one(3, "dt", "May", 0)))
    placed = pptx.read_placeholders(spark, str(tmp_path))
    assert sorted((r["level"], r["type"], r["text"]) for r in placed.collect()) == [(0, "ftr", ""), (0, "title", "Own title"), (1, "ftr", "Layout footer"), (2, "dt", "May"), (2, "ftr", "Master footer")]
    r = pagefacts.furniture(pptx.read_pptx(spark, str(tmp_path)), placed).first()
    assert (r["header"], r["footer"], r["slide_number_text"], r["date_text"]) == ("Own title", "Layout footer", None, "May")


def test_pages_round_trip(spark, tmp_path):
    e = elements_from_events(spark, "/root/testdata/sf0.001")
    sinks.write_pages(e, str(tmp_path / "p"))
    again = sinks.read_pages(spark, str(tmp_path / "p"), e.schema)
    assert e.exceptAll(again).isEmpty() and again.exceptAll(e).isEmpty()


def test_markdown_escapes_and_pads(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a|b"), (1, 0, 1, "x\ny"), (1, 1, 0, None)], "table_id long, row int, col int, text string")
    assert sinks.markdown(cells).first()["markdown"] == "| a\\|b | x<br>y |\n| --- | --- |\n|  |  |"
