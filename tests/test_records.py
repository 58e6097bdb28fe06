"""Records of pages, texts in boxes, drawings, colour regions and arriving pages, against plain Python."""

from __future__ import annotations

import base64
import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import assembly, chains, content, fitting, raster, vectors
from quire.streaming import pages as arriving
from test_raster import dense, flood, mask_rows

WORDS = ["a", "to", "Wide", "iii", "extraordinary", "MMMM", "x-y", "été", "漢字", "(ok)", "1,000"]


def slow_fit(text, width, height, size, least=6.0, step=0.5):
    """A loop over all sizes, each wrapped word by word and measured anew."""

    def wrap(s):
        if width <= 0:
            return text.split("\n")
        out = []
        for part in text.split("\n"):
            words = part.split()
            if not words:
                out.append("")
                continue
            line = words[0]
            for w in words[1:]:
                if sum(map(fitting.advance, f"{line} {w}")) <= width * 1000 / s:
                    line = f"{line} {w}"
                else:
                    out.append(line)
                    line = w
            out.append(line)
        return out

    s = size
    while s >= least:
        if len(wrap(s)) * s * 1.2 <= height:
            return s, True, wrap(s)
        s -= step
    return least, len(wrap(least)) * least * 1.2 <= height, wrap(least)


def test_fitted_texts_equal_a_loop(spark):
    r = random.Random(5)
    rows = [("\n".join(" ".join(r.choices(WORDS, k=r.randrange(0, 12))) for _ in range(r.randrange(1, 4))), float(r.randrange(20, 300)), float(r.randrange(5, 120)), r.choice([5.0, 6.0, 9.5, 12.0, 40.0])) for _ in range(150)]
    rows += [("", 10.0, 10.0, 12.0), ("one two", 0.0, 30.0, 12.0), ("one two\nthree", -1.0, 30.0, 12.0), (" \t\n", 50.0, 50.0, 10.0), ("word " * 3000, 400.0, 300.0, 30.0)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate([*rows, (None, None, 10.0, None)])], "k long, text string, box_width double, box_height double, start_size double")
    got = {x["k"]: (x["fit"]["font_size"], x["fit"]["fits"], x["fit"]["lines"]) for x in fitting.fitted(df).collect()}
    assert [got[k] for k in range(len(rows))] == [slow_fit(*x) for x in rows]
    assert got[len(rows)] == (6.0, True, [""])
    assert fitting.fitted(df.where("false")).count() == 0


def test_every_printable_character_has_one_advance():
    n = Counter(c for _, chars in fitting.ADVANCES for c in chars)
    assert set(n) == {chr(k) for k in range(32, 127)} and set(n.values()) == {1}


PAGES = "document_id long, slide_number long, title string, page_image string, raster binary"
ROWS = "document_id long, slide_number long, element_id string, ord long, element_type string, text string, image_data string"


def test_parts_meet_in_one_record(spark):
    a = spark.createDataFrame([(1, 1, 2, "b"), (1, 1, 1, "z"), (1, 2, 5, None)], "document_id long, slide_number long, k long, v string")
    b = spark.createDataFrame([(1, 1, 0.5), (1, 3, 0.25)], "document_id long, slide_number long, w double")
    out = assembly.assembled([assembly.Part("many", a, ("k",)), assembly.Part("one", b, many=False)])
    got = {r["slide_number"]: ([(x["k"], x["v"]) for x in r["many"]], r["one"] and r["one"]["w"]) for r in out.collect()}
    assert got == {1: ([(1, "z"), (2, "b")], 0.5), 2: ([(5, None)], None), 3: ([], 0.25)}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_page_hashes_and_pictures(spark):
    code = lambda b: base64.b64encode(b).decode()
    p = spark.createDataFrame([(1, 1, 'Say "hi"\n', None, bytearray(b"r")), (1, 2, None, f"data:image/png;base64,{code(b'own')}", None), (1, 3, "t", "data:,", None), (1, 4, "t", code(b"bare"), None), (1, 5, None, None, None)], PAGES)
    rows = [(1, 1, "b", 2, "shape", "back\\slash\ttab", ""), (1, 1, "a", 1, "text_box", None, None), (1, 2, "c", 1, "image", "", code(b"in")), (1, 3, "d", 2, "image", "", code(b"second")), (1, 3, "e", 1, "image", "", code(b"first")), (1, 3, "f", 0, "shape", "", code(b"no image"))]
    e = spark.createDataFrame(rows, ROWS)
    got = {r["slide_number"]: r["page_hash"] for r in assembly.page_hashes(p, e).collect()}

    def said(number, title):
        data = {"slide_number": number, "title": title, "elements": [{"id": r[2], "type": r[4], "text": r[5]} for r in sorted(rows, key=lambda r: r[3]) if r[1] == number]}
        return hashlib.sha256(json.dumps(data, sort_keys=True).encode()).hexdigest()

    assert got == {1: said(1, 'Say "hi"\n'), 2: hashlib.sha256(b"own").hexdigest(), 3: said(3, "t"), 4: hashlib.sha256(b"bare").hexdigest(), 5: said(5, None)}
    shown = {r["slide_number"]: (r["picture"] and bytes(r["picture"]), r["source"]) for r in assembly.page_pictures(p, e).collect()}
    assert shown == {1: (b"r", "raster"), 2: (b"own", "page"), 3: (b"first", "element"), 4: (b"bare", "page"), 5: (None, None)}


def test_vector_checkboxes(spark):
    kind = "document_id long, slide_number long, drawing long, x0 double, y0 double, x1 double, y1 double, color string"
    rows = [(1, 1, 1, 0, 0, 10, 10, "#0"), (1, 1, 2, 2, 2, 8, 4, None), (1, 1, 3, 50, 0, 60, 10, "#0"), (1, 1, 4, 50, 0, 60, 10, "#0"), (1, 1, 5, 60, 0, 70, 10, "#0"), (1, 1, 6, 100, 0, 140, 10, "#0"), (1, 2, 7, 0, 0, 10, 10, "#0")]
    got = {r["element_id"]: (r["width"], r["checked"]) for r in vectors.vector_checkboxes(spark.createDataFrame([(*r[:3], *map(float, r[3:7]), r[7]) for r in rows], kind), 2.0).collect()}
    assert got == {"vector_cb_1_1": (20.0, True), "vector_cb_1_3": (20.0, False), "vector_cb_1_4": (20.0, False), "vector_cb_1_5": (20.0, False), "vector_cb_2_7": (20.0, False)}


def dilated(m, by):
    out = np.zeros(m.shape, bool)
    for y, x in zip(*np.nonzero(m), strict=True):
        out[max(y - by, 0) : y + by + 1, max(x - by, 0) : x + by + 1] = True
    return out


def test_closed_masks_and_colour_regions(spark):
    r = np.random.default_rng(2)
    m = r.random((30, 50)) < 0.1
    got = np.zeros(m.shape, bool)
    for x in raster.closed(raster.runs(mask_rows(spark, {1: m})), 2, 50, 30).collect():
        got[x["y"], x["x1"] : x["x2"] + 1] = True
    assert (got == ~dilated(~dilated(m, 2), 2)).all()
    a = np.full((40, 60, 3), 250, np.uint8)
    a[5:15, 5:25], a[20:35, 30:50], a[25:28, 36:40], a[38, 0:2] = (200, 30, 30), (30, 30, 200), 250, (0, 255, 0)
    want = set()
    q = a // 24
    for c, n in Counter(map(tuple, q.reshape(-1, 3).tolist())).most_common(10):
        if 24 <= n <= 1920:
            want |= {b[:4] for b in flood(~dilated(~dilated((q == c).all(2), 3), 3)) if 9.6 <= b[2] * b[3] <= 2040}
    pixels = dense(spark, {7: a})
    found = raster.color_regions(pixels, 60, 40, by=3)
    assert {(x["x"], x["y"], x["w"], x["h"]) for x in found.collect()} == want and len(want) == 2
    styles = raster.sampled_styles(pixels, spark.createDataFrame([(7, 1, 5, 5, 20, 10), (7, 2, 28, 18, 24, 19)], "image_id long, box_id long, x int, y int, w int, h int"))
    assert {x["box_id"]: (x["fill"], x["stroke"]) for x in styles.collect()} == {1: ("#c81e1e", "#c81e1e"), 2: ("#1e1ec8", "#fafafa")}


def test_a_page_counts_again_only_with_new_content(spark):
    kind = "document_id long, slide_number long, element_id long, text string"
    seen = arriving.page_hashes(spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 1, "b")], kind))
    later = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 1, "changed"), (2, 1, 1, "a"), (2, 2, 1, "a")], kind)
    assert {tuple(r)[:2] for r in arriving.new_pages(later, seen).collect()} == {(1, 2), (2, 1), (2, 2)}


@pytest.mark.parametrize("kind", ["line", "contour"])
def test_classes_of_boxes(spark, kind):
    boxes = [(0, 0, 100, 3), (0, 0, 60, 40), (0, 0, 6, 6), (0, 0, 20, 9), (0, 0, 5, 90)]
    df = spark.createDataFrame([(k, *b, kind) for k, b in enumerate(boxes)], "k long, x long, y long, w long, h long, source string")
    got = [r["shape_type"] for r in raster.classified(df, 160, 90).orderBy("k").collect()]
    assert got == (["line"] * 5 if kind == "line" else ["line", "panel", "pixel_icon", "rect", "line"])


def test_blur_equals_a_loop(spark):
    a = np.random.default_rng(4).integers(0, 256, (7, 9))
    df = spark.createDataFrame([(1, x, y, int(a[y, x])) for y in range(7) for x in range(9)], "image_id long, x int, y int, v int")
    p = np.pad(a, 1, mode="reflect")
    k = np.outer([1, 2, 1], [1, 2, 1])
    want = {(x, y): (int((p[y : y + 3, x : x + 3] * k).sum()) + 8) // 16 for y in range(7) for x in range(9)}
    assert {(r["x"], r["y"]): r["v"] for r in raster.blurred(df).collect()} == want
    assert raster.blurred(df).where(F.col("v").isNull()).count() == 0


def test_items_in_one_page_or_many(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40").select("doc_id", "text")
    items = spark.createDataFrame([(k, " ".join(random.Random(k).choices(["the", "of", "and", "que", "die", "x"], k=5))) for k in range(30)], "item_id long, text string")
    once = sorted(map(tuple, content.best_items(docs, items).collect()))
    assert sorted(map(tuple, content.best_items(docs, items, item_bytes=100).collect())) == once and len(once) == 40


def test_the_chain_of_flows(spark):
    kind = "document_id long, slide_number long, title string, plain string, flow_section string, flow_description string, summaries string, interpretation string"
    none = (None,) * 3
    sections = {
        1: "- Flow Sequence: go: on", 2: "Reading order:\nA --> B", 3: "flow sequence", 4: "→ only\nStep 2: [x] → Step 3: y → Step 4: [ z ]", 5: "nothing\r\n  - reading order : left", 6: "", 7: None,
    }
    want = {
        1: "The slide shows the process flow: go: on", 2: "The slide shows a progression from A → B", 3: "The slide shows the process flow: flow sequence", 4: "The slide shows a progression from x → z",
        5: "The slide shows the process flow: left", 6: "The slide presents and explains the slide content.", 7: "The slide presents and explains the slide content.", 8: "The slide shows 5 Things.", 9: "Step 1: alone", 10: chains.TRANSFORMATION, 11: "So it is.",
        12: "The slide focuses on First.", 13: "The slide shows a progression from First → Last",
    }
    rows = [(1, k, None, None, s, *none) for k, s in sections.items()] + [
        (1, 8, "t", "5 Things. And", "A --> B", *none), (1, 9, "t", None, None, "Step 1: alone", None, None), (1, 10, "t", None, None, None, "temporal", "x"), (1, 11, "t", " ", "", "", "", "So it is. Or"), (1, 12, "t", *none, None, "i"), (1, 13, "t", *none, None, "i"),
    ]
    e = spark.createDataFrame([(1, 12, 1, 1, "First"), (1, 12, 2, 2, None), (1, 13, 3, 1, "First"), (1, 13, 4, 2, "mid"), (1, 13, 5, 3, "Last")], "document_id long, slide_number long, element_id long, ord long, text string")
    order = e.select("document_id", "slide_number", "element_id", F.col("ord").alias("position"))
    assert {r["slide_number"]: r["flow"] for r in chains.overall_flow(spark.createDataFrame(rows, kind), e, order).collect()} == want
