"""Measures over images that are drawn from boxes, in tasks that hold some whole images at a time.

Only boxes travel, dealt out and ordered by Spark; their pixels are drawn where they are measured.  For images of up to ``WHOLE`` pixels;
``raster`` has the same for larger ones, by rows of pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import raster
from quire.operators.graphs import _smallest

#: Pixels of an image that a task may hold whole, and of the images that it draws at once.
WHOLE = 1 << 20


def parts(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, z, x1, x2, y1, y2, c): ``boxes`` as ``raster.painted`` has them, by first and last pixel inside the image, an outline as its four lines, colours as one int."""
    line = lambda x1, x2, y1, y2: f"struct({x1} as x1, {x2} as x2, {y1} as y1, {y2} as y2)"
    r, b = "x + w - 1", "y + h - 1"
    frame = ", ".join((line("x", r, "y", "y"), line("x", r, b, b), line("x", "x", "y + 1", "y + h - 2"), line(r, r, "y + 1", "y + h - 2")))
    some = f"case when w > 0 and h > 0 then if(outline, array({frame}), array({line('x', r, 'y', b)})) else array({line('0', '-1', '0', '-1')}) end"
    color = F.expr("cast(coalesce(r, 255) * 65536 + coalesce(g, 255) * 256 + coalesce(b, 255) as int)")
    out = boxes.where("image_id is not null").select("image_id", F.col("z").cast("long"), color.alias("c"), F.explode(F.expr(some)).alias("p"))
    low, high = (lambda k: f"coalesce(greatest(p.{k}, 0), 0)"), (lambda k, n: f"coalesce(least(p.{k}, {n - 1}), -1)")
    return out.select("image_id", "z", *(F.expr(e).cast("int").alias(k) for k, e in (("x1", low("x1")), ("x2", high("x2", width)), ("y1", low("y1")), ("y2", high("y2", height)))), "c")


def together(*sides: DataFrame) -> DataFrame:
    """The rows of several tables, ``side`` = their place, an image's rows in one task and in the order in which they are drawn."""
    rows = [s.withColumn("side", F.lit(k)) for k, s in enumerate(sides)]
    for s in rows[1:]:
        rows[0] = rows[0].unionByName(s)
    return rows[0].repartition("image_id").sortWithinPartitions("image_id", "side", "z", "x1", "x2", "c")


def whole(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[list, np.ndarray, pd.DataFrame]]:
    """(keys, place, rows): rows in order of image_id, those of up to ``most`` whole images at a time, with the place of each row's image in ``keys``."""
    held: list[pd.DataFrame] = []

    def cut(rows: pd.DataFrame) -> Iterator[tuple[list, np.ndarray, pd.DataFrame]]:
        ids = rows["image_id"].to_numpy()
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        ends = np.r_[starts[1:], len(rows)]
        for k in range(0, len(starts), most):
            some, a, b = starts[k : k + most], starts[k], ends[min(k + most, len(starts)) - 1]
            yield list(ids[some]), np.searchsorted(some, np.arange(a, b), "right") - 1, rows.iloc[a:b]

    for batch in batches:
        if not len(batch):
            continue
        new = (batch["image_id"] != batch["image_id"].iloc[-1]).to_numpy()
        first = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
        if first or (held and held[-1]["image_id"].iloc[-1] != batch["image_id"].iloc[0]):
            yield from cut(pd.concat([*held, batch.iloc[:first]], ignore_index=True))
            held = []
        held.append(batch.iloc[first:])
    if held:
        yield from cut(pd.concat(held, ignore_index=True))


def drawn(n: int, place: np.ndarray, rows: pd.DataFrame, width: int, height: int, white: int) -> np.ndarray:
    """The ``n`` images of ``rows``, as (n, height, width), later rows over earlier ones."""
    out = np.full((n, height, width), white, np.int32)
    ends = {k: (rows[k] + 1).clip(lower=0) for k in ("x2", "y2")}
    for i, x1, x2, y1, y2, c in zip(*(v.tolist() for v in (place, rows["x1"], ends["x2"], rows["y1"], ends["y2"], rows["c"])), strict=True):
        out[i, y1:y2, x1:x2] = c
    return out


def compared(a: DataFrame, b: DataFrame, width: int, height: int, measure: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], fields: str) -> DataFrame:
    """(image_id, fields): what ``measure`` says of the gray images of two tables of boxes; images of one of them alone are missing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, place, rows in whole(batches, max(1, WHOLE // (width * height))):
            two = [(rows["side"] == s).to_numpy() for s in (0, 1)]
            both = np.flatnonzero((np.bincount(place[two[0]], minlength=len(keys)) > 0) & (np.bincount(place[two[1]], minlength=len(keys)) > 0))
            c = rows["c"].to_numpy()
            rows = rows.assign(c=((c >> 16) * 4899 + (c >> 8 & 255) * 9617 + (c & 255) * 1868 + 8192) >> 14)
            images = [drawn(len(keys), place[s], rows[s], width, height, 255)[both] for s in two]
            yield pd.DataFrame({"image_id": [keys[k] for k in both], **measure(*images)})

    kind = a.schema["image_id"].dataType.simpleString()
    return together(*(parts(x, width, height) for x in (a, b))).mapInPandas(run, f"image_id {kind}, {fields}")


def similarity(a: np.ndarray, b: np.ndarray, size: int, peak: float) -> dict[str, np.ndarray]:
    """``s``: the mean structural similarity of each pair of images over all windows, null where there is none, and ``plain``: 1 - mean squared error / peak squared."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    plain = 1 - ((a - b) ** 2).sum((1, 2)) / (a.shape[1] * a.shape[2]) / (peak * peak)
    if min(a.shape[1:]) < size:
        return {"s": np.full(len(a), None), "plain": plain}
    n, c1, c2 = size * size, (0.01 * peak) ** 2, (0.03 * peak) ** 2

    def mean(v: np.ndarray) -> np.ndarray:
        up = np.pad(v, ((0, 0), (1, 0), (1, 0))).cumsum(1).cumsum(2)
        return (up[:, size:, size:] - up[:, :-size, size:] - up[:, size:, :-size] + up[:, :-size, :-size]) / float(n)

    ma, mb = mean(a), mean(b)
    caa, cbb, cab = ((mean(v) - m) * (n / (n - 1)) for v, m in ((a * a, ma * ma), (b * b, mb * mb), (a * b, ma * mb)))
    score = ((2 * ma * mb + c1) * (2 * cab + c2)) / ((ma * ma + mb * mb + c1) * (caa + cbb + c2))
    return {"s": score.mean((1, 2)), "plain": plain}


def ssim(a: DataFrame, b: DataFrame, width: int, height: int, size: int = 7, peak: float = 255.0) -> DataFrame:
    """(image_id, ssim) as ``raster.ssim`` has it, of the images of two tables of boxes."""
    if width * height > WHOLE:
        return raster.ssim(*(raster.gray(raster.painted(x, width, height)) for x in (a, b)), size, peak)
    m = compared(a, b, width, height, lambda x, y: similarity(x, y, size, peak), "s double, plain double")
    return m.select("image_id", F.expr("bround(greatest(0D, least(1D, coalesce(s, plain))), 6)").alias("ssim"))


# -- what the images show, as ``raster`` finds it in rows of pixels: stacks (image, row, column)


def _begin(mask: np.ndarray) -> np.ndarray:
    """The first pixels of the runs of a mask's rows."""
    out = mask.copy()
    out[:, :, 1:] &= ~mask[:, :, :-1]
    return out


def labelled(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, root): the number of each set pixel's run, and the smallest run of each run's shape.  Runs of neighbouring rows touch once for each stretch that they share, or at a corner."""
    start = _begin(mask)
    run = start.ravel().cumsum().reshape(mask.shape) - 1
    up, down = mask[:, :-1], mask[:, 1:]
    a, b = up[:, :, :-1] & ~down[:, :, :-1], up[:, :, 1:] & ~down[:, :, 1:]
    touch = [(_begin(up & down), slice(None), slice(None)), (a & ~up[:, :, 1:] & down[:, :, 1:], slice(0, -1), slice(1, None)), (b & ~up[:, :, :-1] & down[:, :, :-1], slice(1, None), slice(0, -1))]
    links = [(run[:, :-1, u][t], run[:, 1:, v][t]) for t, u, v in touch]
    return run, _smallest(*(np.concatenate(x) for x in zip(*links, strict=True)), int(start.sum()))


def spans(mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """(image, y, x1, x2) of the runs, in order of their numbers."""
    image, y, x1 = np.nonzero(_begin(mask))
    return image, y, x1, np.nonzero(_begin(mask[:, :, ::-1])[:, :, ::-1])[2]


def squares(mask: np.ndarray) -> np.ndarray:
    """How many shapes of each image are nearly square, of 8 to 32 pixels."""
    if not mask.any():
        return np.zeros(len(mask), np.int64)
    root = labelled(mask)[1]
    order = np.argsort(root, kind="stable")
    image, y, x1, x2 = (v[order] for v in spans(mask))
    first = np.flatnonzero(np.r_[True, np.diff(root[order]) > 0])
    w = np.maximum.reduceat(x2, first) - np.minimum.reduceat(x1, first) + 1
    h = np.maximum.reduceat(y, first) - np.minimum.reduceat(y, first) + 1
    some = (w >= 8) & (w <= 32) & (h >= 8) & (h <= 32) & (w / h >= 0.8) & (w / h <= 1.25)
    return np.bincount(image[first][some], minlength=len(mask))


def strokes(mask: np.ndarray, length: int) -> np.ndarray:
    """The set pixels in runs of at least ``length`` along a row or a column."""

    def along(m: np.ndarray) -> np.ndarray:
        _, _, x1, x2 = spans(m)
        return m & (x2 - x1 + 1 >= length)[_begin(m).ravel().cumsum().reshape(m.shape) - 1] if m.any() else m

    return along(mask) | along(mask.transpose(0, 2, 1)).transpose(0, 2, 1)


def _moved(v: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """Of a stack with a border of one pixel, the values beside each pixel inside it."""
    return v[:, 1 + dy : v.shape[1] - 1 + dy, 1 + dx : v.shape[2] - 1 + dx]


def canny(v: np.ndarray, low: int, high: int) -> np.ndarray:
    """The edges of gray images, as ``raster.canny`` finds them."""
    p = np.pad(v, ((0, 0), (1, 1), (1, 1)), "edge")
    side = lambda dx: _moved(p, -1, dx) + 2 * _moved(p, 0, dx) + _moved(p, 1, dx)
    level = lambda dy: _moved(p, dy, -1) + 2 * _moved(p, dy, 0) + _moved(p, dy, 1)
    gx, gy = side(1) - side(-1), level(1) - level(-1)
    m = np.abs(gx) + np.abs(gy)
    at = lambda dy, dx, q=np.pad(m, ((0, 0), (1, 1), (1, 1))): _moved(q, dy, dx)
    ax, ay = np.abs(gx).astype(np.int64) * 13573, np.abs(gy).astype(np.int64) * 32768
    flat, steep = ay < ax, ay > ax + np.abs(gx).astype(np.int64) * 65536
    falls = (gx < 0) != (gy < 0)
    peak = np.where(flat, (m > at(0, -1)) & (m >= at(0, 1)), np.where(steep, (m > at(-1, 0)) & (m >= at(1, 0)), np.where(falls, (m > at(-1, 1)) & (m > at(1, -1)), (m > at(-1, -1)) & (m > at(1, 1)))))
    some = peak & (m > low)
    if not some.any():
        return some
    run, root = labelled(some)
    firm = np.zeros(len(root), bool)
    firm[root[run[some & (m > high)]]] = True
    return some & firm[root][run]


def likeness(a: np.ndarray, b: np.ndarray, bright: int, stroke: int, low: int, high: int) -> dict[str, np.ndarray]:
    """What ``raster.fidelity_measures`` is made of: similarity, the pixels that both and either have of edges and of strokes, and the numbers of squares."""
    out = similarity(a, b, 7, 255.0)
    ink = [v <= bright for v in (a, b)]
    for name, (p, q) in (("layout", [canny(v, low, high) for v in (a, b)]), ("border", [strokes(v, stroke) for v in ink])):
        out |= {f"{name}_both": (p & q).sum((1, 2)), f"{name}_any": (p | q).sum((1, 2))}
    return out | {"n0": squares(ink[0]), "n1": squares(ink[1])}


def fidelity_measures(original: DataFrame, other: DataFrame, width: int, height: int, bright: int, stroke: int, low: int, high: int) -> DataFrame:
    """(image_id, width, height, ssim, layout, border, n0, n1) of images of up to ``WHOLE`` pixels, drawn from two tables of boxes."""
    m = compared(original, other, width, height, lambda x, y: likeness(x, y, bright, stroke, low, high), "s double, plain double, layout_both long, layout_any long, border_both long, border_any long, n0 long, n1 long")
    share = [F.expr(f"{c}_both / nullif({c}_any, 0)").alias(c) for c in ("layout", "border")]
    return m.select("image_id", F.lit(float(width)).alias("width"), F.lit(float(height)).alias("height"), F.expr("bround(greatest(0D, least(1D, coalesce(s, plain))), 6)").alias("ssim"), *share, "n0", "n1")


def colored(images: np.ndarray, place: np.ndarray, boxes: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """(image_id, box_id, c, n, edge): how many pixels of each colour lie in a box of its image, and how many of them on the box's border."""
    high, wide = images.shape[1:]
    x1, x2, y1, y2 = (boxes[k].to_numpy().astype(np.int64) for k in ("x1", "x2", "y1", "y2"))
    left, top = np.maximum(x1, 0), np.maximum(y1, 0)
    w = np.maximum(np.minimum(x2, wide - 1) - left + 1, 0)
    area = w * np.maximum(np.minimum(y2, high - 1) - top + 1, 0)
    for some in np.split(np.arange(len(boxes)), np.flatnonzero(np.diff(np.cumsum(area) // WHOLE)) + 1):
        of, n = np.repeat(some, area[some]), area[some]
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        x, y = left[of] + k % w[of], top[of] + k // w[of]
        edge = (x == x1[of]) | (x == x2[of]) | (y == y1[of]) | (y == y2[of])
        code, at = np.unique((of << 24) + images[place[of], y, x], return_inverse=True)
        box = boxes.iloc[code >> 24]
        yield pd.DataFrame({"image_id": box["image_id"].to_numpy(), "box_id": box["z"].to_numpy(), "c": code & 0xFFFFFF, "n": np.bincount(at, minlength=len(code)), "edge": np.bincount(at, edge, len(code)).astype(np.int64)})


def box_colors(drawing: DataFrame, boxes: DataFrame, width: int, height: int, contrast: float = 40.0) -> DataFrame:
    """What ``raster.box_colors`` says of ``boxes`` (image_id, box_id, x, y, w, h) of images that are drawn from the boxes of ``drawing``."""
    if width * height > WHOLE:
        return raster.box_colors(raster.painted(drawing, width, height), boxes, contrast)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, place, rows in whole(batches, max(1, WHOLE // (width * height))):
            here, asked = ((rows["side"] == s).to_numpy() for s in (0, 1))
            asked &= np.bincount(place[here], minlength=len(keys))[place] > 0  # an image is drawn where it has a box
            if asked.any():
                yield from colored(drawn(len(keys), place[here], rows[here], width, height, 0xFFFFFF), place[asked], rows[asked])

    spots = boxes.where("image_id is not null and w > 0 and h > 0").select("image_id", F.col("box_id").cast("long").alias("z"), *(F.expr(f"cast({e} as int)").alias(k) for k, e in (("x1", "x"), ("x2", "x + w - 1"), ("y1", "y"), ("y2", "y + h - 1"))), F.lit(0).alias("c"))
    kind = [drawing.schema["image_id"].dataType.simpleString(), boxes.schema["box_id"].dataType.simpleString()]
    seen = together(parts(drawing, width, height), spots).mapInPandas(run, f"image_id {kind[0]}, box_id long, c int, n long, edge long").repartition("image_id", "box_id")
    seen = seen.withColumn("box_id", F.col("box_id").cast(kind[1])) if kind[1] != "bigint" else seen
    seen = seen.withColumns({"r": F.expr("c div 65536"), "g": F.expr("c div 256 % 256"), "b": F.expr("c % 256")}).withColumn("v", F.expr(f"cast({raster.GRAY} as int)"))
    return raster.side_colors(seen.groupBy("image_id", "box_id", "v").agg(*(F.sum(c).alias(c) for c in ("n", "edge")), *(F.sum(F.expr(f"{c} * n")).alias(c) for c in "rgb")), contrast)
