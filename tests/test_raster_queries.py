"""Queries over drawn pages: what they draw, and how the work is dealt out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quire.operators import drawings, raster
from quire.plans import raster_queries


def events(spark, folder, n=60, pages=3):
    """``n`` events of every type over ``pages`` users."""
    kinds = ("view", "click", "purchase", "signup", "error")
    rows = [(k * 37, k % pages, kinds[k % 5], float(k)) for k in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_objects_are_looked_for_in_whole_pages(spark, monkeypatch, tmp_path):
    """Every element of every page is drawn, not some of the pictures alone."""
    d = events(spark, tmp_path)
    monkeypatch.setattr(raster_queries.raster, "image_objects", lambda pixels, w, h: pixels.withColumn("box_id", F.lit(1)))
    got, want = raster_queries.image_objects(spark, d), raster_queries.page_images(spark, d)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and want.select("image_id").distinct().count() == 3


def boxes(spark, n=60, images=4, width=40, height=30):
    """Boxes and outlines in and around images, some over others, some of one order of drawing, and an image with nothing inside."""
    rng = np.random.default_rng(11)
    rows = [(int(i), int(z), *map(int, rng.integers(-6, (width, height))), *map(int, rng.integers(0, 25, 2)), bool(z % 3 == 0), *map(int, rng.integers(0, 256, 3))) for i in range(images) for z in rng.integers(0, 50, n)]
    rows.append((images, 1, width + 3, 2, 5, 5, False, 1, 2, 3))
    return spark.createDataFrame(rows, "image_id long, z int, x int, y int, w int, h int, outline boolean, r int, g int, b int")


def same(a, b):
    assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()


def test_similarity_of_drawn_images_equals_that_of_their_pixels(spark, monkeypatch):
    """The same for images drawn in the task that measures them, of which only the boxes travel, once, however they fall into batches."""
    a = boxes(spark)
    b = a.where("z % 7 <> 0 and image_id <> 2").unionByName(a.where("image_id = 4"))
    for w, h, size in ((40, 30, 7), (40, 5, 7), (23, 30, 3)):
        same(drawings.ssim(a, b, w, h, size), raster.ssim(raster.gray(raster.painted(a, w, h)), raster.gray(raster.painted(b, w, h)), size))
    plan = drawings.ssim(a, b, 40, 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_COL") == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        same(drawings.ssim(a, b, 40, 30), raster.ssim(raster.gray(raster.painted(a, 40, 30)), raster.gray(raster.painted(b, 40, 30))))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = drawings.ssim(a, b, 40, 30).collect()
    monkeypatch.setattr(drawings, "WHOLE", 100)  # larger images go by their pixels
    assert sorted(drawings.ssim(a, b, 40, 30).collect()) == sorted(want)


def test_pages_are_compared_by_their_boxes(spark, tmp_path):
    """What is dealt out for raster_ssim are boxes, not pixels."""
    plan = raster_queries.raster_ssim(spark, events(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "sequence(" not in plan


def test_colours_of_boxes_of_drawn_images_equal_those_of_their_pixels(spark, monkeypatch, tmp_path):
    """Also of boxes that reach beyond their image; boxes and the colours that each holds are dealt out, once each, and no pixels."""
    a = boxes(spark)
    asked = a.where("w > 0 and h > 0 and z % 4 = 1").selectExpr("image_id", "z as box_id", "x", "y", "w", "h").unionByName(spark.sql("select 99L image_id, 7 box_id, 1 x, 1 y, 5 w, 5 h"))
    want = raster.box_colors(raster.painted(a, 40, 30), asked)
    same(drawings.box_colors(a, asked, 40, 30), want)
    monkeypatch.setattr(drawings, "WHOLE", 1200)  # one image, and the pixels of few boxes, at a time
    same(drawings.box_colors(a, asked, 40, 30), want)
    monkeypatch.undo()
    plan = raster_queries.box_colors(spark, events(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_COL") == 2 and "sequence(" not in plan and "Join" not in plan


def test_fidelity_of_drawn_images_equals_that_of_their_pixels(spark, monkeypatch):
    """Edges, strokes and squares too, with shapes that wind, touch at corners and lie in neighbouring images; only boxes are dealt out, once."""
    a = boxes(spark, images=3).unionByName(spark.createDataFrame([(3, z, x, y, w, h, o, 5, 5, 5) for z, (x, y, w, h, o) in enumerate([(1, 1, 10, 10, True), (11, 11, 9, 9, False), (25, 2, 12, 11, True), (0, 29, 40, 1, False), (39, 0, 1, 30, False)])], "image_id long, z int, x int, y int, w int, h int, outline boolean, r int, g int, b int"))
    b = a.where("z % 5 <> 2 or image_id = 1")
    got = raster.fidelity_measures(a, b, stroke=12, size=(40, 30))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_COL") == 1 and "sequence(" not in plan
    got = sorted(map(tuple, got.collect()))
    assert len(got) == 4 and len({r[4:] for r in got}) > 2
    monkeypatch.setattr(drawings, "WHOLE", 100)  # larger images go by their pixels
    assert sorted(map(tuple, raster.fidelity_measures(a, b, stroke=12, size=(40, 30)).collect())) == got


def test_shapes_of_stacks_equal_those_of_rows(spark):
    rng = np.random.default_rng(5)
    masks = np.stack([rng.random((20, 33)) < p for p in (0.02, 0.3, 0.45, 0.6)])
    masks[0, 2:12, 3:13] = True
    rows = spark.createDataFrame([(int(i), int(x), int(y)) for i, y, x in zip(*np.nonzero(masks), strict=True)], "image_id long, x int, y int")
    count = {r[0]: r[1] for r in raster.shapes(raster.runs(rows)).groupBy("image_id").count().collect()}
    run, root = drawings.labelled(masks)
    for i, m in enumerate(masks):
        assert len(set(root[run[i][m]])) == count[i]
    assert drawings.squares(masks)[0] == 1 and drawings.squares(np.zeros((2, 3, 3), bool)).tolist() == [0, 0]
    want = {tuple(r) for r in raster.strokes(rows, 5).collect()}
    assert {(int(i), int(x), int(y)) for i, y, x in zip(*np.nonzero(drawings.strokes(masks, 5)), strict=True)} == want
