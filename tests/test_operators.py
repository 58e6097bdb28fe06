"""Operators that SQL cannot express, and the fixtures of the form page, against plain loops and small cases."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import naming
from quire.operators import detector, enrich, flows, folds, formpage, ocr, pagefacts, payloads, vectors
from quire.plans import detector_queries, fact_queries, formpage_queries, ocr_queries, payload_queries, registry
from quire.sources import pdf, sinks
from quire.sources.elements import PAGE, styled_elements
from quire.streaming import pages as stream

SF = "/root/testdata/sf0.001"
BOX = "document_id long, slide_number long, element_id string, ord long, element_type string, x double, y double, width double, height double, text string, z_order long, confidence double"


def boxes(spark, *rows):
    return spark.createDataFrame([(1, 1, *r) for r in rows], BOX)


def by_page(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(tuple(r[c] for c in PAGE), []).append(r)
    return out


def area_of_both(a, b):
    w = min(a["x"] + a["width"], b["x"] + b["width"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"])
    return w * h if w > 0 and h > 0 else 0.0


def test_dedup_goes_from_first_to_last(spark):
    """A dropped earlier box still costs what it removed."""
    case = boxes(spark, ("a", 1, "", 0.0, 0.0, 10.0, 10.0, "", 0, 0.5), ("b", 2, "", -4.0, 0.0, 10.0, 10.0, "", 0, 0.4), ("c", 3, "", 4.0, 0.0, 10.0, 10.0, "", 0, 0.9))
    assert [r["element_id"] for r in ocr.dedup_boxes(case).collect()] == ["c"]
    given = ocr_queries._sure(spark, SF).collect()
    want = set()
    for rows in by_page(given).values():
        rows = sorted(rows, key=lambda r: r["ord"])
        keep = [True] * len(rows)
        for i, a in enumerate(rows):
            for j in range(i + 1, len(rows)):
                if not keep[i]:
                    break
                b = rows[j]
                if keep[j] and area_of_both(a, b) > 0.5 * min(a["width"] * a["height"], b["width"] * b["height"]):
                    keep[j if a["confidence"] >= b["confidence"] else i] = False
        want |= {r["element_id"] for r, k in zip(rows, keep, strict=True) if k}
    assert {r["element_id"] for r in ocr_queries.ocr_dedup(spark, SF).collect()} == want
    assert 0 < len(want) < len(given)


def test_fragments_of_a_line(spark):
    case = boxes(
        spark, ("a", 1, "", 0.0, 0.0, 50.0, 10.0, "the sum of", 0, 0.9), ("b", 2, "", 60.0, 0.0, 50.0, 10.0, "All costs", 0, 0.7), ("c", 3, "", 115.0, 0.0, 20.0, 10.0, "and more", 0, 0.8), ("d", 4, "", 400.0, 0.0, 20.0, 10.0, "far", 0, 1.0),
        ("e", 5, "", 0.0, 50.0, 20.0, 10.0, "$45", 0, 1.0), ("f", 6, "", 25.0, 50.0, 20.0, 10.0, "67", 0, 1.0), ("g", 7, "", 50.0, 50.0, 20.0, 10.0, None, 0, 1.0),
    )
    got = {r["first_id"]: (r["text"], r["width"], r["confidence"], r["parts"]) for r in ocr.merge_fragments(case).collect()}
    assert got == {"a": ("the sum of All costs and more", 135.0, 0.7, 3), "d": ("far", 20.0, 1.0, 1), "e": ("$45", 20.0, 1.0, 1), "f": ("67", 20.0, 1.0, 1), "g": ("", 20.0, 1.0, 1)}
    literal = {r["first_id"] for r in ocr.merge_fragments(case, consume=False).collect()}
    assert literal == set("abcdefg")


def test_grid_of_loose_texts(spark):
    """Three columns, three rows, one text over two columns, one in two pieces."""
    at = lambda i, r, c, t, w=900_000.0: (i, int(r * 10 + c), "text_box", c * 1_000_000.0, r * 400_000.0, w, 300_000.0, t, 0, 1.0)
    rows = [at("a", 0, 0, "Name"), at("b", 0, 1, "Wide", 1_900_000.0), at("c", 1, 0, "x"), at("d", 1, 1, "one two three"), at("e", 1, 2, "four"), at("f", 2, 0, "y"), at("g", 2, 1, "five six"), at("h", 2, 2, "seven"), at("i", 2, 2.92, "ty", 10_000.0)]
    e = boxes(spark, *rows)
    assert [tuple(r)[3:5] for r in detector.visual_tables(e).collect()] == [(3, 9)]
    cells = detector.grid_cells(e)
    got = {(r["row"], r["col"]): r["text"] for r in detector.grid_texts(cells).collect()}
    # gaps between the texts are grid intervals of their own
    assert sorted(got.values()) == ["Name", "Wide", "five six", "four", "one two three", "seventy", "x", "y"]
    assert len({r for r, _ in got}) == 3
    merged = [tuple(r)[3:] for r in detector.grid_merges(cells).collect()]
    assert any(w > 1 for _, _, _, w in merged)


def loop_grid(items):
    """Grid lines by a plain loop over one table's merged spans."""
    lines = []
    for at, size in (("x", "width"), ("y", "height")):
        values = sorted({v for r in items for v in (r[at], r[at] + r[size])})
        groups = [[values[0]]]
        for a, b in zip(values, values[1:], strict=False):
            if b - a <= 80_000:
                groups[-1].append(b)
            else:
                groups.append([b])
        lines.append([sum(g) / len(g) for g in groups])
    return lines


def test_grid_slots_equal_a_loop(spark):
    cells = detector.grid_cells(detector_queries._texts(spark, SF)).collect()
    assert cells
    tables: dict = {}
    for r in cells:
        tables.setdefault(tuple(r[c] for c in (*PAGE, "table_no")), []).append(r)
    for items in tables.values():
        gx, gy = loop_grid(items)
        for r in items:
            for grid, own, centre, slot in ((gx, r["gx"], r["x"] + r["width"] / 2, r["col"]), (gy, r["gy"], r["y"] + r["height"] / 2, r["row"])):
                assert own == pytest.approx(grid)
                inside = [i for i in range(len(grid) - 1) if own[i] <= centre <= own[i + 1]]
                assert slot == (inside[0] if inside else min(range(len(grid) - 1), key=lambda i: abs(centre - (grid[i] + grid[i + 1]) / 2)))


E = 9525.0
GEOMETRY = "document_id long, slide_number long, rect_width double, rect_height double, slide_width double, slide_height double, reach_x double, reach_y double, rotation double"


def form(spark, rows, slide=(None, None)):
    reach = (max(r[3] + r[5] for r in rows), max(r[4] + r[6] for r in rows))
    geometry = formpage.page_geometry(spark.createDataFrame([(1, 2, None, None, *slide, *reach, None)], GEOMETRY))
    e = spark.createDataFrame([(1, 2, *r) for r in rows], "document_id long, slide_number long, element_id string, ord long, element_type string, x double, y double, width double, height double, text string, z_order long")
    return geometry.first(), {r["element_id"]: r for r in formpage.form_elements(e, geometry).collect()}


def test_form_page_in_pixels(spark):
    page, got = form(spark, [("title", 0, "text_box", 10 * E, 20 * E, 30 * E, 8 * E, "Exact  text\nline 2", 3), ("table", 1, "table", 0.0, 40 * E, 100 * E, 20 * E, None, 0)], (200 * E, 100 * E))
    assert (page["page_width"], page["page_height"], page["orientation"], page["rotation"]) == (200, 100, "landscape", 0)
    assert (got["title"]["x"], got["title"]["y"], got["title"]["text"], got["title"]["slide_number"]) == (10, 20, "Exact  text\nline 2", 2)
    assert got["table"]["reading_order"] == 0 and got["title"]["reading_order"] == 1
    page, got = form(spark, [("line-1", 0, "line", 5.0, 10.0, 40.0, 1.0, None, 0)])
    r = got["line-1"]
    assert (r["x"], r["y"], r["width"], r["height"], r["x1"], r["y1"], r["x2"], r["y2"], r["stroke_width"]) == (5, 10, 40, 1, 5, 10, 45, 11, 1)
    page, got = form(spark, [("page-image", 0, "image", 0.0, 0.0, 960.0, 1280.0, None, 0), ("cb", 1, "text_box", 1.0, 1.0, 9.0, 9.0, " [x] ", 1), ("thin", 2, "shape", 0.0, 10.0, 100.0, 2.0, None, 2)])
    assert (page["page_width"], page["page_height"], page["orientation"]) == (960, 1280, "portrait")
    assert (got["cb"]["type"], got["cb"]["checked"], got["thin"]["type"], got["thin"]["y1"], got["thin"]["y2"]) == ("checkbox", True, "line", 11, 11)


def test_tables_of_the_form_page(spark):
    t = spark.createDataFrame([(1, 0.0, 40.0, 100.0, 20.0, 2, 2, None, None), (2, 0.0, 0.0, 200.0, 40.0, 2, 2, None, None)], "table_id long, x double, y double, width double, height double, n_rows int, n_cols int, row_heights array<double>, column_widths array<double>")
    cells = spark.createDataFrame([(k, r, c, x) for k, texts in ((1, [["A", ""], ["", "D"]]), (2, [["Title", ""], ["", ""]])) for r, row in enumerate(texts) for c, x in enumerate(row)], "table_id long, row int, col int, text string")
    merges = spark.createDataFrame([(2, 0, 0, 2, 2)], "table_id long, row int, col int, row_span int, col_span int")
    made = formpage.cell_geometry(t, cells, merges)
    got = {k: [r for r in made.orderBy("row", "col").collect() if r["table_id"] == k] for k in (1, 2)}
    assert [r["text"] for r in got[1]] == ["A", "", "", "D"]
    assert [(r["row_span"], r["col_span"], r["width"], r["height"]) for r in got[2]] == [(2, 2, 200, 40)]
    lines = formpage.grid_lines(t, made)
    assert lines.where("table_id = 1").count() == 6 and lines.where("table_id = 2").count() == 4
    assert formpage.table_report(t, made).where("not complete").isEmpty()


def test_cells_lose_texts_that_stand_loose(spark):
    cells = spark.createDataFrame([(1, 1, "t", 0, 0, 0.0, 0.0, 10.0, 10.0, "Total Cost"), (1, 1, "t", 0, 1, 0.0, 0.0, 10.0, 10.0, "total"), (1, 1, "t", 1, 0, 0.0, 0.0, 10.0, 10.0, "none")], "document_id long, slide_number long, table_id string, row int, col int, x double, y double, width double, height double, text string")
    loose = boxes(spark, ("a", 1, "", 5.0, 5.0, 10.0, 10.0, "totalcost", 0, 1.0), ("b", 2, "", 50.0, 5.0, 10.0, 10.0, "Total", 0, 1.0), ("c", 3, "", 5000.0, 5.0, 10.0, 10.0, "none", 0, 1.0))
    assert {(r["row"], r["col"], r["element_id"]) for r in payloads.suppressed_cells(cells, loose).collect()} == {(0, 0, "a"), (0, 1, "b")}


def test_colors_and_charts_gather_around_heads(spark):
    given = fact_queries._colors(spark, SF).select("p_brand", F.col("p_partkey").alias("ord"), F.format_string("#%02x%02x%02x", F.expr("cast(p_partkey * 37 % 128 as int)"), F.expr("cast(p_partkey * 11 % 64 as int)"), F.expr("cast(p_partkey % 32 as int)")).alias("color"))
    rgb = lambda c: np.array([int(c[i : i + 2], 16) for i in (1, 3, 5)])
    heads, want = {}, {}
    for r in sorted(given.collect(), key=lambda r: r["ord"]):
        own = heads.setdefault(r["p_brand"], [])
        near = [h for h in own if np.linalg.norm(rgb(h) - rgb(r["color"])) < 30]
        if not near:
            own.append(r["color"])
        want[r["ord"]] = near[0] if near else r["color"]
    assert {r["ord"]: r["head"] for r in naming.color_clusters(given, "p_brand").collect()} == want
    e = styled_elements(spark, SF)
    seeds, sizes = {}, {}
    for r in sorted(e.where("element_type = 'chart'").collect(), key=lambda r: r["ord"]):
        page = tuple(r[c] for c in PAGE)
        near = [s for s in seeds.get(page, []) if abs(s["x"] - r["x"]) < 1_500_000 and abs(s["y"] - r["y"]) < 1_500_000]
        if not near:
            seeds.setdefault(page, []).append(r)
        sizes[(near or [r])[0]["element_id"]] = sizes.get((near or [r])[0]["element_id"], 0) + 1
    assert {r["seed_id"]: r["members"] for r in pagefacts.group_titles(e).collect()} == sizes


def test_answers_headings_and_lines(spark):
    said = {
        '"Here is the rewritten text: Fine."': "Fine.", "Sure, here is it:\n\nThe text. Hope this helps.": "The text.", "'Rewritten text:  x'": "x", "plain": "plain", None: "", "a\n\nb": "a\n\nb", '"': '"',
        "Let me know if you need anything else": "",
    }
    got = spark.createDataFrame([(k,) for k in said], "t string").select("t", naming.clean_answer(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in got} == said
    text = "before\n## 1. Scene Overview\nline\n\n## Notes\na\n## Notes \n b \n## 6. Summary & Interpretation\nown"
    got = naming.heading_sections(spark.createDataFrame([(1, text), (2, None), (3, "## ")], "k long, text string"), "k")
    assert {(r["k"], r["heading"]): r["body"] for r in got.collect()} == {(1, "1. Scene Overview"): "line", (1, "Notes"): "b", (1, "6. Summary & Interpretation"): "own", (1, "7. Plain-language Summary"): "line"}
    rows = spark.createDataFrame([(1, "aaa bb c dddddd e"), (2, ""), (3, None)], "k long, text string")
    assert [(r["k"], r["line"]) for r in payloads.wrapped_lines(rows, "k", 6).orderBy("k", "line_no").collect()] == [(1, "aaa bb"), (1, "c"), (1, "dddddd"), (1, "e"), (2, ""), (3, "")]
    runs = spark.createDataFrame([(1, 1, "ab"), (1, 2, None), (1, 3, "cdef"), (2, 1, ""), (2, 2, "")], "k long, ord long, text string")
    parts = naming.distribute(spark.createDataFrame([(1, "0123456789"), (2, "xy")], "k long, text string"), runs, "k")
    assert [r["part"] for r in parts.orderBy("k", "ord").collect()] == ["012", "", "3456789", "xy", ""]


def test_what_contains_what(spark):
    e = boxes(spark, *((i, k, "shape", 0.0, 0.0, 1.0, 1.0, "", 0, 1.0) for k, i in enumerate("abcd")))
    edges = spark.createDataFrame([(1, 1, "a", "b"), (1, 1, "b", "c")], "document_id long, slide_number long, source_element_id string, target_element_id string")
    assert {r["element_id"]: (r["root"], r["level"]) for r in flows.contained(edges, e).collect()} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("d", 0)}
    cycle = edges.unionByName(spark.createDataFrame([(1, 1, "c", "a")], edges.schema))
    assert flows.contained(cycle, e).count() == 4


def test_models_answer_or_the_rule_does(spark):
    rows = spark.createDataFrame([(1, "one"), (2, "two"), (3, ""), (4, None)], "k long, t string")
    model = lambda texts: [t.upper() if t == "one" else None for t in texts]
    got = {r["k"]: (r["answer"], r["answered_by"]) for r in enrich.enrich(rows, "k", "t", F.lit("rule"), model).collect()}
    assert got == {1: ("ONE", "model"), 2: ("rule", "rule"), 3: ("rule", "rule"), 4: ("rule", "rule")}

    def broken(texts):
        raise OSError("no server")

    for m, seconds in ((None, 9), (broken, 9), (model, 0)):
        assert {r["answered_by"] for r in enrich.enrich(rows, "k", "t", F.lit("rule"), m, seconds).collect()} == {"rule"}
    a = spark.createDataFrame([(1.5, None, None), (0.7, "slide", 0.9), (0.7, "slide", 0.5)], "a double, m string, s double")
    assert [r[0] for r in a.select(enrich.document_class(F.col("a"), F.col("m"), F.col("s"))).collect()] == ["slide", "slide", "form"]


def test_a_stream_takes_every_page_once(spark, tmp_path):
    e = styled_elements(spark, SF).where("slide_number < 8")
    e.where("slide_number < 5").write.parquet(str(tmp_path / "in/a.parquet"))
    run = lambda: stream.run(spark, str(tmp_path / "in/*.parquet"), e.schema, pagefacts.payload_counts, str(tmp_path / "out"), str(tmp_path / "ck"))
    run()
    e.write.parquet(str(tmp_path / "in/b.parquet"))  # pages 1 to 4 again, others for the first time
    run()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = pagefacts.payload_counts(e)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_form_records_hold_every_kind(spark):
    import json

    records = sinks.form_records(payload_queries._form(spark, SF), formpage.page_geometry(formpage_queries._pages(spark, SF))).collect()
    one = json.loads(records[0]["record"])
    assert one["units"] == "pixels" and [e["element_id"] for e in one["elements"]] == one["order"] and {"lines", "checkboxes", "text_blocks"} <= set(one)
    assert len(one["lines"]) == sum(e["type"] == "line" for e in one["elements"])
    objects = sinks.records(payload_queries.fidelity_objects(spark, SF), "element_id", "objects").collect()
    assert all(json.loads(r["record"])["slide_number"] == r["slide_number"] for r in objects)


def small_pdf(stream_bytes, compress):
    body = zlib.compress(stream_bytes) if compress else stream_bytes
    kind = b"/Filter /FlateDecode " if compress else b""
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 6 0 R] /Count 2 /MediaBox [0 0 200 100] >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< " + kind + b"/Length %d >>\nstream\n" % len(body) + body + b"\nendstream", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /FirstChar 65 /Widths [600 700] >>", b"<< /Type /Page /Parent 2 0 R /Rotate 90 >>",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n"


@pytest.mark.parametrize("compress", [False, True])
def test_pdf_pages(spark, tmp_path, compress):
    content = b"q 1 0 0 rg 10 20 30 40 re f Q BT /F1 10 Tf 0 0 1 rg 1 0 0 1 50 80 Tm (A\\(B\\)) Tj 0 -20 Td [(AB) -300 <4142>] TJ ET 0 0 m 100 0 l S"
    (tmp_path / "one.pdf").write_bytes(small_pdf(content, compress))
    (tmp_path / "no.pdf").write_bytes(b"nothing")
    rows = pdf.read_pdf(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["element_type"], r["text"], r["shape_type"]) for r in rows] == [("shape", "", "rect"), ("text_box", "A(B)", None), ("text_box", "AB AB", None), ("shape", "", "line")]
    box, text = rows[0], rows[1]
    assert [round(box[c] / pdf.SCALE, 3) for c in ("x", "y", "width", "height")] == [10, 40, 30, 40] and box["fill_color"] == "#ff0000"
    assert (text["font_size"], text["font_family"], text["bold"], text["text_color"], round(text["x"] / pdf.SCALE, 3)) == (10.0, "Helvetica-Bold", True, "#0000ff", 50)
    assert round(text["width"] / pdf.SCALE, 3) == round((600 + 500 + 700 + 500) / 100, 3)
    assert (box["page_width"], box["page_height"]) == (200 * pdf.SCALE, 100 * pdf.SCALE)
    assert pdf.read_pdf(spark, str(tmp_path), pages=[2]).count() == 0


def test_image_hashes(spark):
    good = hashlib.sha256(b"abc").hexdigest()
    rows = spark.createDataFrame([(1, "YWJj", good), (2, "YWJj", good[::-1]), (3, "%%%", good), (4, "", good), (5, "YWJj", None)], "k long, image_data string, image_hash string")
    assert {r["k"] for r in payloads.image_hash_violations(rows).collect()} == {2, 3}


def test_pages_beyond_their_bound_fail_loudly():
    import pandas as pd

    with pytest.raises(ValueError, match="more than"):
        folds.bounded(pd.DataFrame({"document_id": np.ones(folds.PAGE_LIMIT + 1), "slide_number": 1}))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_queries_without_sql_have_rows(spark, name):
    assert not registry.QUERIES[name](spark, SF).isEmpty()


def test_empty_tables_give_empty_results(spark):
    e = styled_elements(spark, SF).where("false")
    for op in (pagefacts.header_footer, pagefacts.text_points, flows.labels, flows.layout_words, flows.standout_regions, detector.visual_tables, detector.chart_regions, payloads.fidelity_objects, pagefacts.capability_map):
        assert op(e).isEmpty()


def test_chart_titles_have_one_capital_for_one_letter(spark):
    import duckdb

    want = {"Graph ßheit und mehr": "ẞheit und mehr", "chart of ﬁgures": "ﬁgures", "GRAPH ΑΣ ΣΑΣ.": "Ασ σασ", "figure showing İstanbul": "Istanbul", "graph ᾳx": "ᾼx", "graph ŉx": "ŉx", "chart of éa": "Éa", "graph ": None}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r["t"]: r["c"] for r in df.select("t", naming.chart_title(F.col("t")).alias("c")).collect()} == want
    letters = [chr(c) for c in range(0x80, 0x2000)]
    own = {r["t"]: r["c"] for r in spark.createDataFrame([(c,) for c in letters], "t string").select("t", naming.capital(F.col("t")).alias("c")).collect()}
    sql = dict(duckdb.execute("select t, upper(t) from (select unnest(?) as t)", [letters]).fetchall())
    # letters that are newer than one of the two engines' tables
    assert {c for c in letters if own[c] != sql[c]} <= {"\u019b", "\u0264", "\u1c8a"}


def test_lines_are_rounded_as_doubles(spark):
    import duckdb

    given = [((i * 7919 % 11000000) / 16000 + 3 + i % 20) * 1.5 for i in range(4000)] + [677.0745, 510.77549999999997, -0.0005, -2.0025]
    got = [r["r"] for r in spark.createDataFrame(list(enumerate(given)), "i int, v double").orderBy("i").select(vectors.half_even(F.col("v"), 3).alias("r")).collect()]
    assert got == [r[0] for r in duckdb.execute("select round_even(unnest(?::double[]), 3)", [given]).fetchall()]


def test_a_walk_over_colours_takes_each_once(spark):
    some = ["#000000", "#0a0a0a", None, "#1e1e1e", "#141414"]
    given = spark.range(200_000).selectExpr("id % 2 as k", "id as ord", f"array({', '.join('null' if c is None else repr(c) for c in some)})[cast(id div 2 % 5 as int)] as color")
    out = naming.color_clusters(given, "k")
    got = {(r["k"], r["color"], r["head"], r["n"]) for r in out.groupBy("k", "color", "head").agg(F.count("*").alias("n")).collect()}
    want = {"#000000": "#000000", "#0a0a0a": "#000000", None: None, "#1e1e1e": "#1e1e1e", "#141414": "#1e1e1e"}
    assert got == {(k, c, h, 20_000) for k in (0, 1) for c, h in want.items()}
