"""Order-dependent operators against plain loops over one page."""

from __future__ import annotations

import pytest

from quire.operators import folds
from quire.plans import form_queries
from quire.sources.elements import elements_from_events

SF = "/root/testdata/sf0.001"


def pages(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault((r["document_id"], r["slide_number"]), []).append(r)
    return out


def test_layers_and_rows_equal_a_loop(spark):
    e = elements_from_events(spark, SF)
    layers, rows = set(), set()
    for items in pages(e).values():
        start, n = None, 0
        for r in sorted((r for r in items if r["element_type"] in ("text_box", "shape")), key=lambda r: (r["y"], r["ord"])):
            if start is None or r["y"] - start > 1_000_000:
                start, n = r["y"], n + 1
            layers.add((r["element_id"], n))
        held, n = [], 0
        for cy, _, i in sorted((r["y"] + r["height"] / 2, r["ord"], r["element_id"]) for r in items):
            if not held or abs(cy - sum(held) / len(held)) > 150_000:
                held, n = [], n + 1
            held.append(cy)
            rows.add((i, n))
    assert {(r["element_id"], r["layer"]) for r in folds.layers_from_start(e).collect()} == layers
    assert {(r["element_id"], r["row"]) for r in folds.rows_by_running_mean(e).collect()} == rows


def test_spans_equal_a_loop(spark):
    e = elements_from_events(spark, SF).where("element_type = 'text_box'")
    want = set()
    for items in pages(e).values():
        now = None
        for r in sorted(items, key=lambda r: (r["y"], r["x"], r["ord"])):
            if now and abs(r["y"] - now[2]) < 200_000 and r["x"] - (now[1] + now[3]) < 400_000:
                now = [now[0], now[1], now[2], r["x"] + r["width"] - now[1], now[4] + r["text"], now[5] + 1]
            else:
                want |= {tuple(now)} if now else set()
                now = [r["element_id"], r["x"], r["y"], r["width"], r["text"], 1]
        want.add(tuple(now))
    got = form_queries.span_merge(spark, SF).select("first_id", "x", "y", "width", "text", "parts").collect()
    assert {tuple(r) for r in got} == want
    assert max(r["parts"] for r in got) > 1


def boxes(spark, *rows):
    return spark.createDataFrame([(1, 1, *r) for r in rows], "document_id long, slide_number long, element_id string, ord long, x double, y double, width double, height double, text string, confidence double")


def test_split_numbers(spark):
    b = boxes(spark, ("a", 1, 0.0, 0.0, 40.0, 9.0, "$706,", 1.0), ("b", 2, 60.0, 0.0, 40.0, 9.0, "700", 1.0), ("c", 3, 110.0, 0.0, 40.0, 9.0, "123", 1.0), ("d", 4, 500.0, 0.0, 40.0, 9.0, None, 1.0))
    assert [(r["first_id"], r["text"], r["parts"]) for r in folds.merge_split_numbers(b).collect()] == [("a", "$706,700", 2), ("c", "123", 1), ("d", "", 1)]


def test_greedy_boxes(spark):
    b = boxes(spark, ("a", 1, 0.0, 0.0, 10.0, 10.0, "", 0.5), ("b", 2, 1.0, 0.0, 10.0, 10.0, "", 0.9), ("c", 3, 8.0, 0.0, 10.0, 10.0, "", 0.1))
    assert {r["element_id"] for r in folds.greedy_boxes(b, "confidence").collect()} == {"b", "c"}


@pytest.mark.parametrize(("pairs", "order"), [((("a", "b"), ("b", "c")), "abcd"), ((("b", "a"), ("a", "b")), "cdab"), ((("d", "a"), ("c", "b")), "cdba")])
def test_topological_order(spark, pairs, order):
    b = boxes(spark, *((n, k, 0.0, float(k), 1.0, 1.0, "", 0.0) for k, n in enumerate("abcd")))
    edges = spark.createDataFrame([(1, 1, *p) for p in pairs], "document_id long, slide_number long, source_element_id string, target_element_id string")
    want = order if order != "abcd" else "adbc"
    assert "".join(r["element_id"] for r in folds.topological_order(b, edges).orderBy("position").collect()) == want
