"""Page joins on pages that are cut into cells, against loops over all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import flows, folds, ocr, payloads, spatial

COLUMNS = "document_id long, slide_number long, element_id long, ord long, element_type string, x double, y double, width double, height double, text string, z_order long, begin_x double, begin_y double, end_x double, end_y double"
KINDS = ["text_box", "shape", "image", "connector", "group"]


def elements(spark, pages):
    rows = []
    for page, n, size in pages:
        r = np.random.default_rng(page)
        for k in range(n):
            x, y, w, h = r.integers(0, 12_000_000), r.integers(0, 6_800_000), r.integers(0, size), r.integers(0, size)
            if k % 50 == 0:
                w, h = w * 20, h * 20
            ends = (float(x), float(y + h), float(x + w), float(y)) if k % 7 else (None,) * 4
            rows.append((1, page, k, k, KINDS[int(r.integers(0, 5))], float(x), float(y), float(w), float(h), "", int(r.integers(0, 5)), *ends))
    return spark.createDataFrame(rows, COLUMNS), rows


@pytest.fixture(scope="module")
def large(spark):
    df, rows = elements(spark, [(1, 1500, 300_000), (2, 30, 2_000_000), (3, 600, 60_000)])
    return df.persist(), rows


def by_page(rows):
    for p in sorted({r[1] for r in rows}):
        yield p, [r for r in rows if r[1] == p]


def holds(o, i):
    return i[5] >= o[5] and i[6] >= o[6] and i[5] + i[7] <= o[5] + o[7] and i[6] + i[8] <= o[6] + o[8]


def mid(r):
    return r[5] + r[7] / 2, r[6] + r[8] / 2


def test_edges_overlaps_and_containers(large):
    df, rows = large
    edges, pairs, parents, cards = set(), set(), {}, {}
    for p, page in by_page(rows):
        boxes = [r for r in page if r[4] != "connector"]
        for i, a in enumerate(boxes):
            for b in boxes[i + 1 :]:
                (ax, ay), (bx, by) = mid(a), mid(b)
                if holds(a, b) or holds(b, a):
                    edges.add((p, "contains", *((a[2], b[2]) if holds(a, b) else (b[2], a[2]))))
                elif abs(ax - bx) < 100000 and a[6] != b[6]:
                    edges.add((p, "hierarchy", *((a[2], b[2]) if b[6] > a[6] else (b[2], a[2]))))
                elif (ax - bx) ** 2 + (ay - by) ** 2 < 500000**2:
                    edges.add((p, "proximity", a[2], b[2]))
        for a in page:
            held = [(c[7] * c[8], c[3], c[2]) for c in page if c[4] in spatial.CONTAINERS and c is not a and holds(c, a) and (c[7] * c[8] > a[7] * a[8] or c[3] < a[3])]
            parents[p, a[2]] = min(held)[2] if held else None
            if a[4] == "text_box":
                x, y = mid(a)
                found = [c[3] for c in page if c[4] == "shape" and c[5] <= x <= c[5] + c[7] and c[6] <= y <= c[6] + c[8]]
                cards[p, a[2]] = min(found) if found else None
            for b in page:
                if a is not b and min(a[5] + a[7], b[5] + b[7]) > max(a[5], b[5]) and min(a[6] + a[8], b[6] + b[8]) > max(a[6], b[6]):
                    pairs.add((p, a[2], b[2]))
    got = [(r["slide_number"], r["relationship_type"], r["source_element_id"], r["target_element_id"]) for r in spatial.relationship_edges(df).collect()]
    assert len(got) == len(set(got)) and set(got) == edges
    got = [(r["slide_number"], r["element_id"], r["other_id"]) for r in spatial.overlap_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    assert {(r["slide_number"], r["element_id"]): r["parent_id"] for r in spatial.smallest_container(df).collect()} == parents
    assert {(r["slide_number"], r["element_id"]): r["card_id"] for r in spatial.text_in_card(df).collect()} == cards


def test_nearest_elements(large):
    df, rows = large
    near, ends = {}, {}
    for p, page in by_page(rows):
        at = np.array([mid(r) for r in page])
        for k, a in enumerate(page):
            d, dx, dy = ((at - at[k]) ** 2).sum(1), at[:, 0] - at[k, 0], at[:, 1] - at[k, 1]
            pick = lambda ok: min(((d[i], page[i][3], page[i][2]) for i in np.flatnonzero(ok) if i != k), default=(0, 0, None))[2]  # noqa: B023, E731
            near[p, a[2]] = tuple(pick(ok) for ok in (dx < 0, dx > 0, dy < 0, dy > 0))
            if a[4] == "connector" and a[11] is not None:
                boxes = [b for b in page if b[4] != "connector"]
                s, t = (min(((mid(b)[0] - x) ** 2 + (mid(b)[1] - y) ** 2, b[3], b[2]) for b in boxes)[2] for x, y in ((a[11], a[12]), (a[13], a[14])))
                if s != t:
                    ends[p, a[2]] = (s, t, "left_to_right" if abs(a[7]) > abs(a[8]) and a[7] > 0 else "bottom_to_top")
    assert {(r["slide_number"], r["element_id"]): tuple(r)[3:] for r in spatial.nearest_neighbours(df).collect()} == near
    got = {(r["slide_number"], r["connector_id"]): (r["source_element_id"], r["target_element_id"], r["direction"]) for r in spatial.connector_targets(df).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in ends.items()}
    assert all(v[2] == ends[k][2] for k, v in got.items() if ends[k][2] == "left_to_right")


def test_a_connector_from_lower_left_to_upper_right(spark):
    box = lambda k, i, x, y: (1, 1, k, k, "shape", x, y, 100.0, 100.0, i, 0, None, None, None, None)
    rows = [box(0, "a", 0.0, 900.0), box(1, "b", 900.0, 0.0), box(2, "m", 0.0, 0.0), box(3, "n", 900.0, 900.0)]
    rows += [(1, 1, 4, 4, "connector", 50.0, 50.0, 900.0, 901.0, "", 0, 50.0, 951.0, 950.0, 50.0), (1, 1, 5, 5, "connector", 0.0, 0.0, 9.0, 9.0, "", 0, None, None, None, None), (1, 1, 6, 6, "connector", 50.0, 50.0, 901.0, 3.0, "", 0, 951.0, 50.0, 50.0, 53.0)]
    got = {r["connector_id"]: (r["source_element_id"], r["target_element_id"], r["direction"]) for r in spatial.connector_targets(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {4: (0, 1, "bottom_to_top"), 6: (1, 2, "right_to_left")}


def test_met_pairs_grow_with_the_page_not_its_square(spark):
    """Four times the elements of four times smaller area each: as many neighbours for each of them, so about four times the pairs."""
    met = []
    for n, size in ((3_000, 120_000), (12_000, 60_000)):
        e = spark.range(n).selectExpr(
            "1L as document_id", "1L as slide_number", "id as element_id", "id as ord", "'shape' as element_type", "cast(pmod(xxhash64(id, 1), 12000000) as double) as x", "cast(pmod(xxhash64(id, 2), 6800000) as double) as y",
            f"cast(pmod(xxhash64(id, 3), {size}) as double) as width", f"cast(pmod(xxhash64(id, 4), {size}) as double) as height", "id % 5 as z_order",
        )
        grid = spatial._grid_side(spatial.gridded(e), "a")
        cells = spatial._touched("a", grid)
        met.append(cells.groupBy("cell").count().agg(F.sum(F.expr("count * count"))).first()[0])
        assert spatial.overlap_pairs(e).count() < met[-1] < n * n / 10
    assert met[1] < 6 * met[0]


def test_containment_of_fifty_levels(spark):
    rows = [(1, 1, k, k, "shape", float(k), float(k), 1000.0 - 2 * k, 1000.0 - 2 * k, "", 0, None, None, None, None) for k in range(50)]
    e = spark.createDataFrame(rows, COLUMNS)
    chain = spark.createDataFrame([(1, 1, k, k + 1) for k in range(49)], "document_id long, slide_number long, source_element_id long, target_element_id long")
    assert {r["element_id"]: (r["root"], r["level"]) for r in flows.contained(chain, e).collect()} == {k: (0, k) for k in range(50)}
    ring = chain.union(spark.createDataFrame([(1, 1, 9, 5)], chain.schema)).where("target_element_id <> 5 or source_element_id = 9")
    got = {r["element_id"]: (r["root"], r["level"]) for r in flows.contained(ring, e).collect()}
    assert got[4] == (0, 4) and got[5] == got[49] == (None, None)


@pytest.mark.parametrize("of", ["smaller", "own"])
def test_greedy_boxes_equal_a_loop(large, of):
    df, rows = large
    df = df.where("width > 0 and height > 0").withColumn("sure", F.expr("cast(z_order as double)"))
    want = set()
    for p, page in by_page([r for r in rows if r[7] > 0 and r[8] > 0]):
        stay = []
        for r in sorted(page, key=lambda r: (-r[10], r[3])):
            cover = lambda k: max(0.0, min(r[5] + r[7], k[5] + k[7]) - max(r[5], k[5])) * max(0.0, min(r[6] + r[8], k[6] + k[8]) - max(r[6], k[6]))  # noqa: B023, E731
            if all(cover(k) <= 0.5 * (r[7] * r[8] if of == "own" else min(r[7] * r[8], k[7] * k[8])) for k in stay):
                stay.append(r)
                want.add((p, r[2]))
    assert {(r["slide_number"], r["element_id"]) for r in folds.greedy_boxes(df, "sure", 0.5, of).collect()} == want


def test_readings_of_one_place_equal_a_loop(large):
    df, rows = large
    want = set()
    for p, page in by_page(rows):
        page = sorted(page, key=lambda r: r[3])
        stays = [True] * len(page)
        for i, a in enumerate(page):
            if not stays[i] or a[7] * a[8] <= 0:
                continue
            for j in range(i + 1, len(page)):
                b = page[j]
                both = max(0.0, min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5])) * max(0.0, min(a[6] + a[8], b[6] + b[8]) - max(a[6], b[6]))
                if stays[j] and both > 0.5 * min(a[7] * a[8], b[7] * b[8]) > 0:
                    if b[10] > a[10]:
                        stays[i] = False
                        break
                    stays[j] = False
        want |= {(p, r[2]) for r, s in zip(page, stays, strict=True) if s}
    got = ocr.dedup_boxes(df.withColumn("confidence", F.col("z_order") / 10.0))
    assert {(r["slide_number"], r["element_id"]) for r in got.collect()} == want


def test_cells_take_the_nearest_loose_texts(large):
    _, rows = large
    spark = large[0].sparkSession
    r = np.random.default_rng(8)
    words = ["Total", "total cost", "cost", "a b", "ab", "12", " 1 2 "]
    place = lambda: (float(r.integers(0, 6000)), float(r.integers(0, 4000)), float(r.integers(1, 90)), float(r.integers(1, 30)))
    cells = [(1, p, k % 3, k // 3, k % 4, *place(), words[int(r.integers(0, 7))] if k % 9 else "") for p in (1, 2) for k in range(400)]
    texts = [(1, p, k, *place(), words[int(r.integers(0, 7))]) for p in (1, 2) for k in range(500)]
    kind = "x double, y double, width double, height double, text string"
    got = payloads.suppressed_cells(spark.createDataFrame(cells, f"document_id long, slide_number long, table_id int, row int, col int, {kind}"), spark.createDataFrame(texts, f"document_id long, slide_number long, element_id int, {kind}"))
    squeeze = lambda s: "".join(s.lower().split())
    want = set()
    for p in (1, 2):
        used = set()
        for c in sorted((c for c in cells if c[1] == p and c[9]), key=lambda c: (c[3], c[4], c[2])):
            best = min(
                ((((c[5] + c[7] / 2 - t[3] - t[5] / 2) ** 2 + (c[6] + c[8] / 2 - t[4] - t[6] / 2) ** 2) ** 0.5, t[4], t[3], t[2]) for t in texts if t[1] == p and t[2] not in used and (squeeze(c[9]) in squeeze(t[7]) or squeeze(t[7]) in squeeze(c[9]))),
                default=(400.0,),
            )
            if best[0] < 400:
                used.add(best[3])
                want.add((p, c[2], c[3], c[4], best[3]))
    assert {tuple(x)[1:] for x in got.collect()} == want and len(want) > 100
