"""Pixel operators against numpy loops, ruled tables and palettes against plain Python."""

from __future__ import annotations

import hashlib
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import graphs, lattice, palettes, raster

RNG = np.random.default_rng(7)


def dense(spark, images):
    """{image_id: array (h, w, 3)} as pixel rows."""
    rows = [(i, x, y, *map(int, a[y, x])) for i, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int")


def luma(a):
    a = a.astype(np.int64)
    return (a[..., 0] * 4899 + a[..., 1] * 9617 + a[..., 2] * 1868 + 8192) // 16384


def mask_rows(spark, masks):
    return spark.createDataFrame([(i, int(x), int(y)) for i, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)], "image_id long, x int, y int")


def flood(mask):
    """Boxes, areas and outlines of the 8-connected shapes, by flood fill."""
    seen, out = np.zeros(mask.shape, bool), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        todo, spots = [(y, x)], []
        seen[y, x] = True
        while todo:
            cy, cx = todo.pop()
            spots.append((cy, cx))
            for ny in range(max(cy - 1, 0), min(cy + 2, mask.shape[0])):
                for nx in range(max(cx - 1, 0), min(cx + 2, mask.shape[1])):
                    if mask[ny, nx] and not seen[ny, nx]:
                        seen[ny, nx] = True
                        todo.append((ny, nx))
        ys, xs = zip(*spots, strict=True)
        lines = defaultdict(list)
        for cy, cx in spots:
            lines[cy].append(cx)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(spots), sum(max(v) - min(v) + 1 for v in lines.values())))
    return sorted(map(lambda t: tuple(map(int, t)), out))


def test_shapes_equal_a_flood_fill(spark):
    spiral = np.zeros((40, 75), bool)
    spiral[0, :], spiral[:, 74], spiral[39, 10:], spiral[4:, 10], spiral[4, 10:60], spiral[4:30, 59] = 1, 1, 1, 1, 1, 1
    masks = {1: RNG.random((30, 70)) < 0.3, 2: RNG.random((25, 40)) < 0.45, 3: spiral, 4: np.ones((3, 3), bool), 5: np.zeros((2, 2), bool)}
    got = defaultdict(list)
    for r in raster.shapes(raster.runs(mask_rows(spark, masks))).collect():
        got[r["image_id"]].append(tuple(r[c] for c in ("x", "y", "w", "h", "area", "outline")))
    assert {k: sorted(v) for k, v in got.items()} == {k: flood(m) for k, m in masks.items() if m.any()}


def test_grown_masks(spark):
    m = RNG.random((20, 45)) < 0.05
    rows = raster.grown(raster.runs(mask_rows(spark, {1: m})), 2, 45, 20).collect()
    got = np.zeros(m.shape, int)
    for r in rows:
        got[r["y"], r["x1"] : r["x2"] + 1] += 1
    want = np.zeros(m.shape, bool)
    for y, x in zip(*np.nonzero(m), strict=True):
        want[max(y - 2, 0) : y + 3, max(x - 2, 0) : x + 3] = True
    assert (got == want).all()


def brute_ssim(a, b, size=7):
    a, b, n = a.astype(float), b.astype(float), size * size
    if min(a.shape) < size:
        return 1 - ((a - b) ** 2).mean() / 255**2
    out = []
    for y in range(a.shape[0] - size + 1):
        for x in range(a.shape[1] - size + 1):
            p, q = a[y : y + size, x : x + size].ravel(), b[y : y + size, x : x + size].ravel()
            cov = np.cov(p, q)
            out.append((2 * p.mean() * q.mean() + 6.5025) * (2 * cov[0, 1] + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (cov[0, 0] + cov[1, 1] + 58.5225)))
    return max(0.0, min(1.0, float(np.mean(out))))


def brute_canny(v, low, high):
    """Sobel, maxima across the edge, hysteresis: a loop over pixels."""
    h, w = v.shape
    p = np.pad(v.astype(np.int64), 1, mode="edge")
    gx, gy = np.zeros((h, w), np.int64), np.zeros((h, w), np.int64)
    for y in range(h):
        for x in range(w):
            n = p[y : y + 3, x : x + 3]
            gx[y, x] = n[0, 2] + 2 * n[1, 2] + n[2, 2] - n[0, 0] - 2 * n[1, 0] - n[2, 0]
            gy[y, x] = n[2, 0] + 2 * n[2, 1] + n[2, 2] - n[0, 0] - 2 * n[0, 1] - n[0, 2]
    m = np.pad(abs(gx) + abs(gy), 1)
    some = np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            c, ax, ay = m[y + 1, x + 1], abs(gx[y, x]) * 13573, abs(gy[y, x]) << 15
            if ay < ax:
                top = c > m[y + 1, x] and c >= m[y + 1, x + 2]
            elif ay > ax + (abs(gx[y, x]) << 16):
                top = c > m[y, x + 1] and c >= m[y + 2, x + 1]
            else:
                s = -1 if (gx[y, x] < 0) != (gy[y, x] < 0) else 1
                top = c > m[y, x + 1 - s] and c > m[y + 2, x + 1 + s]
            some[y, x] = top and c > low
    edge = some & (m[1:-1, 1:-1] > high)
    while True:
        wide = np.pad(edge, 1)
        near = sum(wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) > 0
        if ((near & some) == edge).all():
            return edge
        edge = near & some


def scene(seed, h=40, w=32):
    r = np.random.default_rng(seed)
    a = np.full((h, w, 3), 255, np.uint8)
    for _ in range(6):
        x, y = r.integers(0, max(1, w - 6)), r.integers(0, max(1, h - 6))
        a[y : y + r.integers(3, 14), x : x + r.integers(3, 14)] = r.integers(0, 256, 3)
    return a


def test_ssim_and_edges_equal_loops(spark):
    one = {1: scene(1), 2: scene(2), 3: scene(3, 5, 6), 4: scene(4)}
    two = {1: scene(1), 2: scene(9), 3: scene(8, 5, 6), 4: scene(4).copy()}
    two[4][10:14, 5:20] = 0
    a, b = (raster.gray(dense(spark, x)) for x in (one, two))
    got = {r["image_id"]: r["ssim"] for r in raster.ssim(a, b).collect()}
    assert got == pytest.approx({k: brute_ssim(luma(one[k]), luma(two[k])) for k in one}, abs=2e-6)
    assert got[1] == 1.0
    found = defaultdict(set)
    for r in raster.canny(a, 50, 150).collect():
        found[r["image_id"]].add((r["y"], r["x"]))
    assert dict(found) == {k: s for k, v in one.items() if (s := {tuple(map(int, t)) for t in np.argwhere(brute_canny(luma(v), 50, 150))})}


def test_measures_of_equal_and_different_images(spark):
    blank = np.full((60, 60, 3), 255, np.uint8)
    line, boxes = blank.copy(), blank.copy()
    line[30:32, :] = 0
    boxes[10:25, 10], boxes[10:25, 24], boxes[10, 10:25], boxes[24, 10:25] = 0, 0, 0, 0
    a, b = dense(spark, {1: line, 2: line, 3: boxes, 4: blank}), dense(spark, {1: line, 2: blank, 3: blank, 4: blank})
    got = {r["key"]: r for r in raster.fidelity_measures(a, b).collect()}
    assert all(got[i][c] == 1.0 for i in (1, 4) for c in ("ssim", "layout", "border", "checkbox"))
    assert got[2]["border"] == 0 and got[2]["layout"] == 0 and got[2]["ssim"] < 1 and got[2]["checkbox"] == 1.0
    assert got[3]["checkbox"] == 0


def brute_otsu(v):
    best, t = -1.0, None
    for k in sorted(set(v.ravel().tolist()))[:-1]:
        lo, hi = v[v <= k], v[v > k]
        b = len(lo) * len(hi) * (lo.mean() - hi.mean()) ** 2
        if b > best * (1 + 1e-12):
            best, t = b, k
    return t


def test_thresholds_and_colours_of_boxes(spark):
    images = {1: scene(5), 2: np.full((10, 10, 3), 7, np.uint8)}
    boxes = [(1, 1, 0, 0, 32, 40), (1, 2, 3, 4, 9, 9), (1, 3, 31, 39, 1, 1), (2, 4, 2, 2, 5, 5)]
    b = spark.createDataFrame(boxes, "image_id long, box_id long, x int, y int, w int, h int")
    got = {r["box_id"]: r for r in raster.box_colors(dense(spark, images), b).collect()}
    for i, k, x, y, w, h in boxes:
        crop = images[i][y : y + h, x : x + w].astype(int)
        v, t = luma(crop), brute_otsu(luma(crop))
        assert got[k]["t"] == t
        code = lambda m: "#" + "".join(f"{int(c):02x}" for c in crop[m].sum(0) // m.sum())  # noqa: B023, E731
        if t is None:
            assert (got[k]["foreground"], got[k]["background"]) == (None, code(v == v))
            continue
        edge = np.ones(v.shape, bool)
        edge[1:-1, 1:-1] = False
        dark = v <= t
        sides = (code(dark), code(~dark)) if (edge & ~dark).sum() >= (edge & dark).sum() else (code(~dark), code(dark))
        lum = [sum(f * int(c[j : j + 2], 16) for f, j in ((0.299, 1), (0.587, 3), (0.114, 5))) for c in sides]
        assert (got[k]["foreground"], got[k]["background"]) == (sides if abs(lum[0] - lum[1]) >= 40 else (None, None))


def test_a_line_and_a_checkbox_of_a_form(spark):
    a = np.full((100, 200, 3), 255, np.uint8)
    a[20:22, 10:101] = 0
    for box in ((10, 40), (60, 40)):
        x, y = box
        a[y, x : x + 16], a[y + 15, x : x + 16], a[y : y + 16, x], a[y : y + 16, x + 15] = 0, 0, 0, 0
    a[46:52, 64:72] = 0
    a[5:95, 150] = 0
    ink = raster.image_ink(dense(spark, {1: a}))
    lines = {tuple(r)[1:] for r in raster.image_lines(ink.where("ink = 1").select("image_id", "x", "y")).collect()}
    assert lines == {("horizontal", 10, 20, 91, 2), ("vertical", 150, 5, 1, 90)}
    boxes = {(r["x"], r["y"], r["w"], r["h"]): (r["ink"], r["checked"]) for r in raster.image_checkboxes(ink).collect()}
    assert boxes == {(10, 40, 16, 16): (0.0, False), (60, 40, 16, 16): (round(48 / 144, 6), True)}


def test_cards_and_a_page_inside_a_screen(spark):
    a = np.full((90, 160, 3), 250, np.uint8)
    a[15:60, 20:90] = (30, 60, 120)
    a[25:30, 30:60] = 250
    a[70:75, 100:103] = 0
    pixels = dense(spark, {1: a, 2: np.full((90, 160, 3), 200, np.uint8)})
    got = raster.cards(pixels, 160, 90, 1000, 30, 15).collect()
    assert [(r["image_id"], r["color"]) for r in got] == [(1, "#1e3c78")]
    assert all(abs(got[0][c] - v) <= 3 for c, v in (("x", 20), ("y", 15), ("w", 70), ("h", 45)))
    page = raster.page_regions(pixels, 160, 90).collect()
    assert len(page) == 1 and all(abs(page[0][c] - v) <= 12 for c, v in (("x", 20), ("y", 15), ("w", 70), ("h", 45)))


def test_forests_and_components_of_any_depth(spark):
    up = [(1, k, k - 1) for k in range(1, 51)] + [(1, 101, 102), (1, 102, 103), (1, 103, 101), (1, 104, 101), (2, 5, 4)]
    got = {(r["g"], r["node"]): (r["root"], r["level"]) for r in graphs.climb(spark.createDataFrame(up, "g long, node long, parent long"), ["g"]).collect()}
    want = {(1, k): (0, k) for k in range(1, 51)} | {(1, k): (None, None) for k in (101, 102, 103, 104)} | {(2, 5): (4, 1)}
    assert got == want
    order = np.random.default_rng(3).permutation(200)
    edges = [(1, int(a), int(b)) for a, b in zip(order[:120], order[1:120], strict=False)] + [(1, int(order[130]), int(order[140])), (2, 1, 1), (2, 2, 3)]
    roots = defaultdict(set)
    for r in graphs.connected(spark.createDataFrame(edges, "g long, a long, b long"), ["g"]).collect():
        roots[r["g"], r["root"]].add(r["node"])
    assert sorted(map(sorted, roots.values())) == sorted(map(sorted, [{*map(int, order[:120])}, {int(order[130]), int(order[140])}, {1}, {2, 3}]))


def test_components_of_blocks_of_any_size(spark, monkeypatch):
    """What lies within a block is joined without rounds of jobs; what spans several is joined by rounds, to the same smallest node."""
    rng = np.random.default_rng(5)
    edges = [(g, int(a), int(b)) for g in range(40) for a, b in rng.integers(0, 60, (35, 2))]
    want = {}
    for g in range(40):
        near = defaultdict(set)
        for k, a, b in edges:
            if k == g:
                near[a].add(b), near[b].add(a)
        for n in sorted(near):
            todo = [] if (g, n) in want else [n]
            while todo:
                m = todo.pop()
                if want.setdefault((g, m), n) == n:
                    todo += [x for x in near[m] if (g, x) not in want]
    df = spark.createDataFrame(edges, "g long, a long, b long")
    told = []
    real = graphs.climb
    monkeypatch.setattr(graphs, "climb", lambda *a, **b: told.append(1) or real(*a, **b))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        for most in (16, 200, 1 << 18):
            told.clear()
            rows = graphs.connected(df, ["g"], most).collect()
            assert len(rows) == len(want) and {(r["g"], r["node"]): r["root"] for r in rows} == want
            assert bool(told) == (most == 16)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    none = graphs.connected(df.where("false"), ["g"])
    assert none.columns == ["g", "node", "root"] and none.count() == 0


def test_ruled_tables_with_spans_and_loose_rules(spark):
    rule = "document_id long, slide_number long, x1 double, y1 double, x2 double, y2 double"
    lines = [
        (0, 0, 300, 0), (0, 20, 300, 20), (0, 40, 100, 40), (200, 40, 300, 40), (0, 60, 300, 61),  # the middle cell of the second row spans two rows
        (0, 0, 0, 60), (100, 20, 100, 60), (200.5, 20, 200, 60), (300, 0, 300, 60.5),  # the first row is one cell
        (500, 0, 560, 0), (500, 30, 560, 30), (500, 0, 500, 30), (560, 0, 560, 30), (530, 10, 530, 20), (700, 0, 800, 0), (0, 90, 40, 130),
    ]
    texts = [("Title", 120, 5), ("a", 10, 25), ("b1", 110, 25), ("b2", 110, 45), ("c", 210, 25), ("d", 10, 45), ("e", 210, 45), ("  in a box ", 505, 5), ("out", 400, 5), (" ", 505, 20)]
    s = spark.createDataFrame([(1, 1, *map(float, x)) for x in lines], rule)
    t = spark.createDataFrame([(1, 1, k, float(x), float(y), 40.0, 8.0, w) for k, (w, x, y) in enumerate(texts)], "document_id long, slide_number long, ord long, x double, y double, width double, height double, text string")
    cells = lattice.filled_cells(s, t)
    by = defaultdict(set)
    for r in cells.collect():
        by[r["table_id"]].add((r["row"], r["col"], r["row_span"], r["col_span"], r["text"]))
    one, two = sorted(by.values(), key=len, reverse=True)
    assert one == {(0, 0, 1, 3, "Title"), (1, 0, 1, 1, "a"), (1, 1, 2, 1, "b1 b2"), (1, 2, 1, 1, "c"), (2, 0, 1, 1, "d"), (2, 2, 1, 1, "e")}
    assert two == {(0, 0, 1, 1, "in a box")}
    rows = sorted((r["row"], r["texts"]) for r in lattice.string_matrix(cells).collect())
    assert rows == [(0, ["Title", "", ""]), (0, ["in a box"]), (1, ["a", "b1 b2", "c"]), (2, ["d", "", "e"])]
    assert lattice.grid_size(s).collect()[0][2:] == (8, 7)
    assert lattice.filled_cells(s.where("false"), t).count() == 0


def brute_palette(a, k=8, starts=3, rounds=10, seed=42):
    colors, n = np.unique(a.reshape(-1, 3), axis=0, return_counts=True)
    best = None
    for s in range(starts):
        order = sorted(range(len(colors)), key=lambda i: (hashlib.md5(":".join(map(str, (seed, s, *colors[i]))).encode()).hexdigest(), *colors[i]))
        c = colors[order[:k]].astype(float)
        for _ in range(rounds):
            near = ((colors[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
            for j in range(len(c)):
                if (near == j).any():
                    c[j] = (colors[near == j] * n[near == j, None]).sum(0) / n[near == j].sum()
        d = ((colors[:, None, :] - c[None]) ** 2).sum(2)
        cost, size = (d.min(1) * n).sum(), np.bincount(d.argmin(1), n, len(c))
        if best is None or round(cost, 3) < best[0]:
            best = (round(cost, 3), sorted(((int(-m), "#" + "".join(f"{int(np.floor(np.round(v, 9))):02X}" for v in p)) for m, p in zip(size, c, strict=True))))
    return best[1]


def test_palettes_equal_a_loop(spark):
    images = {1: scene(11), 2: RNG.integers(0, 256, (20, 20, 3)).astype(np.uint8), 3: np.full((3, 3, 3), 8, np.uint8)}
    got = defaultdict(list)
    for r in palettes.dominant_colors(dense(spark, images)).collect():
        got[r["image_id"]].append((r["cluster"], r["color"], r["share"]))
    for i, a in images.items():
        want = brute_palette(a)
        assert [c for _, c, _ in sorted(got[i])] == [c for _, c in want]
        assert [s for *_, s in sorted(got[i])] == pytest.approx([-m / a[..., 0].size for m, _ in want], abs=1e-6)


def test_resized_images_equal_a_loop(spark):
    a = np.random.default_rng(9).integers(0, 256, (9, 13, 3))
    sizes = spark.createDataFrame([(1, 13, 9), (2, 7, 5), (3, 20, 11)], "image_id long, width int, height int")
    got = {(r["image_id"], r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in raster.resized(dense(spark, {1: a, 2: a, 3: a}), sizes).collect()}
    for i, w, h in ((1, 13, 9), (2, 7, 5), (3, 20, 11)):
        for y in range(h):
            for x in range(w):
                u, v = min(max((x + 0.5) * 13 / w - 0.5, 0), 12), min(max((y + 0.5) * 9 / h - 0.5, 0), 8)
                x0, y0, p, q = int(u), int(v), u - int(u), v - int(v)
                x1, y1 = min(x0 + 1, 12), min(y0 + 1, 8)
                want = (1 - q) * ((1 - p) * a[y0, x0] + p * a[y0, x1]) + q * ((1 - p) * a[y1, x0] + p * a[y1, x1])
                assert got[i, x, y] == tuple(int(c) for c in np.floor(np.round(want, 6) + 0.5))
    assert all(got[1, x, y] == tuple(a[y, x]) for y in range(9) for x in range(13))


def joins(df):
    return [line.strip(" +-:*()0123456789").split(" ")[0] for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]


def test_drawn_pixels_are_never_sent_whole(spark):
    """A few boxes are many pixels, which Spark takes for as few bytes: a join of them by broadcast would hold them all in the driver."""
    boxes = spark.createDataFrame([(1, 0, -1, 0, 3, 2, False, 1, 2, 3), (1, 1, 0, 0, 4, 3, True, 9, 9, 9), (1, 2, 3, 1, 9, 1, False, 5, 5, 5), (2, 0, 7, 7, 1, 1, False, 0, 0, 0)], "image_id long, z long, x int, y int, w int, h int, outline boolean, r int, g int, b int").coalesce(1)
    drawn = raster.painted(boxes, 5, 4)
    assert not joins(drawn)
    w, a, o, b = (255,) * 3, (1, 2, 3), (9, 9, 9), (5, 5, 5)
    want = [[o, o, o, o, w], [o, a, w, b, b], [o, o, o, o, w], [w] * 5]
    got = {(r["image_id"], r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in drawn.collect()}
    assert got == {(i, x, y): want[y][x] if i == 1 else w for i in (1, 2) for y in range(4) for x in range(5)}
    gray = raster.gray(drawn)
    spots = boxes.selectExpr("image_id", "z as box_id", "0 as x", "0 as y", "2 as w", "2 as h").where("box_id = 0")
    for df in (raster.ssim(gray, gray, 3), raster.box_sums(gray.withColumnRenamed("v", "ink"), spots, "ink"), raster.resized(drawn, spots.selectExpr("image_id", "2 as width", "2 as height"))):
        assert any(j == "SortMergeJoin" for j in joins(df))
    assert joins(raster.gray(drawn).join(raster.apart(gray), ["image_id", "x", "y"])) == ["SortMergeJoin"]


def test_kept_tables_of_many_rows_are_joined_by_a_shuffle(spark):
    from quire.sources import tables

    few, many = (tables.kept(spark.range(n).selectExpr("id % 7 as id", "1 as one"), "rows") for n in (10, tables.MANY + 1))
    assert joins(spark.range(5).join(many, "id")) == ["SortMergeJoin"]
    assert joins(spark.range(5).join(few, "id")) == ["BroadcastHashJoin"]


def test_empty_tables_are_kept(spark):
    from quire.sources import tables

    for none in (spark.range(0), spark.range(5).where("false"), spark.createDataFrame([], "id long"), spark.range(3).join(spark.range(0), "id")):
        assert tables.kept(none, "none").count() == 0


def test_edges_are_looked_for_in_bands_that_travel_once(spark, monkeypatch):
    """An image's edges don't depend on where it is cut, and its pixels are dealt out once, not for every step along rows and columns."""
    a = RNG.integers(0, 256, (23, 17, 1)).repeat(3, axis=2)
    a[5:15, 3:12] = 250
    seen = []
    real = raster.kept
    monkeypatch.setattr(raster, "kept", lambda df, tag: seen.append(df) or real(df, tag))
    pixels = raster.gray(dense(spark, {1: a, 2: a[:9]}))
    edges = lambda: sorted(map(tuple, raster.canny(pixels, 30, 150).collect()))
    whole = edges()
    moves = [line for line in seen[0]._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(moves) == 2  # pixels to the rows of their image, rows to their band
    assert {i for i, *_ in whole} == {1, 2} and len(whole) > 40
    for band in (1, 2, 5):
        monkeypatch.setattr(raster, "BAND", band)
        assert edges() == whole


def test_fidelity_is_measured_once(spark, monkeypatch):
    """The measures of an image are joined with their verdict; the work behind them is in the plan once, not on both sides."""
    from quire.plans import raster_queries

    monkeypatch.setattr(raster_queries, "page_images", lambda *a: None)
    seen = spark.sparkContext.accumulator(0)

    def measured(n):
        seen.add(1)
        return n / 4

    rows = lambda *a, **b: spark.range(1, 4).repartition(3).select(F.col("id").alias("key"), F.lit(2.0).alias("width"), F.lit(1.0).alias("height"), F.udf(measured, "double")("id").alias("ssim"), *(F.lit(1.0).alias(c) for c in ("layout", "border", "checkbox")))
    monkeypatch.setattr(raster_queries.raster, "fidelity_measures", rows)
    got = raster_queries.raster_fidelity(spark, "none").collect()
    assert sorted((r["key"], r["ssim"]) for r in got) == [(1, 0.25), (2, 0.5), (3, 0.75)]
    assert seen.value == 3


def test_shuffle_files_go_when_a_kept_table_is_complete(spark):
    from pathlib import Path

    from quire.sources import tables

    folders = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString())
    files = lambda: {p.name for d in folders for p in Path(d).rglob("shuffle_*.data")}
    option, before = spark.conf.get(tables._CLEANUP, "false"), files()
    sums = tables.kept(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n")), "sums")
    for _ in range(50):
        left = files() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(tables._CLEANUP, "false") == option
    assert {(r["k"], r["n"]) for r in sums.collect()} == {(k, sum(range(k, 1000, 7))) for k in range(7)}


def test_corners_of_ruled_tables_are_found_once(spark, monkeypatch, tmp_path):
    """Crossings are dealt out once for both windows, and rows and columns are counted over kept boxes; three tables on two pages come out as drawn."""
    from quire.plans import lattice_queries

    rows = [(o, n, o * 10 + n, float(n), "A", "F") for o in (40, 41, 43) for n in range(1, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    plans, real = {}, lattice.kept
    monkeypatch.setattr(lattice, "kept", lambda df, tag: plans.setdefault(tag, df) is None or real(df, tag))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lattice_queries.ruled_matrix(spark, str(tmp_path))
        got = sorted((r["slide_number"], r["row"], r["line"]) for r in out.collect())
        boxes, cells = (plans[tag]._jdf.queryExecution().executedPlan().toString() for tag in ("boxes", "cells"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert boxes.count("REPARTITION_BY_COL") == 1 and boxes.count("Window [") == 2
    assert "first(" not in cells and "root#" not in cells
    want = lambda o, r: f"A|F|{o * 10 + r + 1} {r + 1}|" if r % 3 == 1 else f"A|F|{o * 10 + r + 1}|{r + 1}"
    assert got == sorted((o // 2, r, want(o, r)) for o in (40, 41, 43) for r in range(4))
