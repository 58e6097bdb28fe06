"""Images as rows of pixels.

A dense image has a row (image_id, x, y, r, g, b) for every pixel; a mask has the rows (image_id, x, y) of its set pixels, and ``runs`` turns it
into rows (image_id, y, x1, x2).  Nothing holds a whole image: sums run along rows and then along columns, shapes are grown
from runs of neighbouring rows, and a task meets one row or column of an image at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quire.operators.graphs import connected
from quire.operators.spatial import touching
from quire.sources.tables import kept

#: Pixels of a cell of a row in which runs of neighbouring rows meet.
SPAN = 32
#: Rows of an image that edges are looked for in at once.
BAND = 64
#: The luma weights of 8-bit colours, in 1/16384.
GRAY = "(r * 4899 + g * 9617 + b * 1868 + 8192) div 16384"


def _row(*part: str) -> WindowSpec:
    return Window.partitionBy("image_id", *part, "y").orderBy("x")


def _column(*part: str) -> WindowSpec:
    return Window.partitionBy("image_id", *part, "x").orderBy("y")


def gray(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "x", "y", F.expr(f"cast({GRAY} as int)").alias("v"))


def painted(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Images of ``width`` by ``height`` pixels with the boxes (image_id, z, x, y, w, h, outline, r, g, b) drawn over one another in order of z on
    white; of a box with ``outline`` the border alone.  An image is drawn where it has a box."""
    some = boxes.where(f"x < {width} and y < {height} and x + w > 0 and y + h > 0 and w > 0 and h > 0")
    lines = some.withColumn("py", F.explode(F.expr(f"sequence(greatest(y, 0), least(y + h, {height}) - 1)")))
    part = lambda a, b: f"struct(z, greatest({a}, 0) as x1, least({b}, {width - 1}) as x2, r, g, b)"
    ends = f"if(outline and py not in (y, y + h - 1), array({part('x', 'x')}, {part('x + w - 1', 'x + w - 1')}), array({part('x', 'x + w - 1')}))"
    lines = lines.select("image_id", F.col("py").cast("int").alias("y"), F.explode(F.expr(f"filter({ends}, s -> s.x1 <= s.x2)")).alias("s"))
    # only the parts of boxes in a row of an image travel: the row is cut where one of them begins or ends, and each piece has the colour of the topmost
    empty = boxes.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    rows = lines.unionByName(empty, allowMissingColumns=True).groupBy("image_id", "y").agg(F.collect_list("s").alias("s"))
    rows = rows.withColumn("cut", F.expr(f"array_sort(array_distinct(concat(array(0, {width}), flatten(transform(s, p -> array(cast(p.x1 as int), cast(p.x2 + 1 as int)))))))"))
    top = "array_max(filter(s, p -> p.x1 <= cut[i] and p.x2 >= cut[i]))"
    pieces = rows.select("image_id", "y", F.explode(F.expr(f"transform(sequence(0, size(cut) - 2), i -> struct(cut[i] as x1, cut[i + 1] - 1 as x2, {top} as c))")).alias("p"))
    return pieces.select("image_id", F.explode(F.sequence("p.x1", "p.x2")).alias("x"), "y", *(F.coalesce(F.col(f"p.c.{k}"), F.lit(255)).cast("int").alias(k) for k in "rgb"))


def apart(pixels: DataFrame) -> DataFrame:
    """A table of pixels as a side of a join: it is never sent whole to driver and tasks.  Spark takes a table of boxes for as large when it is drawn out to pixels."""
    return pixels.hint("merge")


# -- summed-area tables


def summed(values: DataFrame, columns: list[str]) -> DataFrame:
    """A dense image's summed-area tables: each column becomes its sum over all pixels up and left of a pixel, itself included."""
    along = values.withColumns({c: F.sum(c).over(_row().rowsBetween(Window.unboundedPreceding, 0)) for c in columns})
    return along.withColumns({c: F.sum(c).over(_column().rowsBetween(Window.unboundedPreceding, 0)) for c in columns})


def window_sums(table: DataFrame, columns: list[str], size: int) -> DataFrame:
    """The sums over every ``size`` by ``size`` window inside an image, at its lower right pixel, as four look-ups in a summed-area table."""
    back = lambda c, w: F.col(c) - F.coalesce(F.lag(c, size).over(w), F.lit(0))
    out = table.withColumns({c: back(c, _row()) for c in columns}).withColumns({c: back(c, _column()) for c in columns})
    return out.where(f"x >= {size - 1} and y >= {size - 1}")


def ssim(a: DataFrame, b: DataFrame, size: int = 7, peak: float = 255.0) -> DataFrame:
    """(image_id, ssim): the mean structural similarity of two gray images (v) of one size over all ``size`` by ``size`` windows, with sample
    covariances, between 0 and 1; of an image smaller than a window 1 - mean squared error / peak squared."""
    both = a.join(apart(b.withColumnRenamed("v", "w")), ["image_id", "x", "y"]).select("image_id", "x", "y", *(F.expr(f"cast({e} as long)").alias(n) for n, e in (("a", "v"), ("b", "w"), ("aa", "v * v"), ("bb", "w * w"), ("ab", "v * w"))))
    columns = ["a", "b", "aa", "bb", "ab"]
    n, c1, c2 = size * size, (0.01 * peak) ** 2, (0.03 * peak) ** 2
    w = window_sums(summed(both, columns), columns, size)
    w = w.select("image_id", F.expr(f"a / {n}D").alias("ma"), F.expr(f"b / {n}D").alias("mb"), *(F.expr(f"({p}{q} / {n}D - ({p} / {n}D) * ({q} / {n}D)) * ({n}D / {n - 1}D)").alias(f"c{p}{q}") for p, q in ("aa", "bb", "ab")))
    score = f"((2 * ma * mb + {c1}D) * (2 * cab + {c2}D)) / ((ma * ma + mb * mb + {c1}D) * (caa + cbb + {c2}D))"
    mean = w.groupBy("image_id").agg(F.avg(F.expr(score)).alias("s"))
    plain = both.groupBy("image_id").agg((1 - F.sum(F.expr("(a - b) * (a - b)")) / F.count("*") / (peak * peak)).alias("p"))
    return plain.join(mean, "image_id", "left").select("image_id", F.expr("bround(greatest(0D, least(1D, coalesce(s, p))), 6)").alias("ssim"))


def box_sums(table: DataFrame, boxes: DataFrame, column: str) -> DataFrame:
    """``boxes`` (image_id, box_id, x, y, w, h, inside their image) with the sum of a summed-area table's column over each: four look-ups."""
    at = [("x + w - 1", "y + h - 1", 1), ("x - 1", "y + h - 1", -1), ("x + w - 1", "y - 1", -1), ("x - 1", "y - 1", 1)]
    corner = F.expr(f"inline(array({', '.join(f'struct(cast({x} as int) as cx, cast({y} as int) as cy, {s} as sign)' for x, y, s in at)}))")
    looks = boxes.select("image_id", "box_id", corner).join(apart(table.select("image_id", F.col("x").alias("cx"), F.col("y").alias("cy"), column)), ["image_id", "cx", "cy"])
    sums = looks.groupBy("image_id", "box_id").agg(F.sum(F.col(column) * F.col("sign")).alias(column))
    return boxes.join(sums, ["image_id", "box_id"], "left").withColumn(column, F.coalesce(column, F.lit(0)))


def filled_boxes(mask: DataFrame, boxes: DataFrame, margin: int = 2, share: float = 0.15) -> DataFrame:
    """``boxes`` with ``ink``, the share of set pixels inside ``margin`` of them, and ``checked`` where it is above ``share``.  ``mask`` is dense: (image_id, x, y, ink 0 or 1)."""
    inner = boxes.withColumns({"x": F.col("x") + margin, "y": F.col("y") + margin, "w": F.col("w") - 2 * margin, "h": F.col("h") - 2 * margin})
    inner = box_sums(summed(mask.withColumn("ink", F.col("ink").cast("long")), ["ink"]), inner.where("w > 0 and h > 0").select("image_id", "box_id", "x", "y", "w", "h"), "ink")
    part = inner.select("image_id", "box_id", F.expr("ink / cast(w * h as double)").alias("ink"))
    out = boxes.join(part, ["image_id", "box_id"], "left").withColumn("ink", F.coalesce("ink", F.lit(0.0)))
    return out.withColumn("checked", F.col("ink") > share).withColumn("ink", F.bround("ink", 6))


# -- runs and shapes


def runs(mask: DataFrame) -> DataFrame:
    """(image_id, y, x1, x2): the runs of set pixels of each row."""
    island = F.col("x") - F.row_number().over(_row())
    return mask.select("image_id", "y", "x", island.alias("i")).groupBy("image_id", "y", "i").agg(F.min("x").alias("x1"), F.max("x").alias("x2")).drop("i")


def turned(mask: DataFrame) -> DataFrame:
    """A mask or runs' boxes with rows and columns exchanged."""
    return mask.withColumns({"x": F.col("y"), "y": F.col("x")})


def grown(rows: DataFrame, by: int, width: int, height: int) -> DataFrame:
    """Runs of a mask whose set pixels are spread to all pixels within ``by`` rows and columns, inside the image."""
    wide = rows.select("image_id", F.explode(F.expr(f"sequence(greatest(y - {by}, 0), least(y + {by}, {height - 1}))")).alias("y"), F.greatest(F.col("x1") - by, F.lit(0)).alias("x1"), F.least(F.col("x2") + by, F.lit(width - 1)).alias("x2"))
    order = Window.partitionBy("image_id", "y").orderBy("x1", "x2")
    reach = F.max("x2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = wide.withColumn("new", F.when(reach >= F.col("x1") - 1, 0).otherwise(1))
    return new.withColumn("i", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("image_id", "y", "i").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).drop("i")


def unset(rows: DataFrame, images: DataFrame, width: int, height: int) -> DataFrame:
    """The runs of the pixels that are not set, in all rows of ``images`` (image_id)."""
    order = Window.partitionBy("image_id", "y").orderBy("x1")
    ends = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"), F.lit(width).alias("x1"), F.lit(width).alias("x2"))
    gaps = rows.select("image_id", "y", "x1", "x2").unionByName(ends).withColumn("from", F.coalesce(F.lag("x2").over(order) + 1, F.lit(0)))
    return gaps.where(F.col("from") < F.col("x1")).select("image_id", "y", F.col("from").alias("x1"), (F.col("x1") - 1).alias("x2"))


def closed(rows: DataFrame, by: int, width: int, height: int) -> DataFrame:
    """Runs of a mask whose gaps of up to twice ``by`` pixels are filled: grown, and what is not set grown back.  What lies beyond the image takes nothing away."""
    images = rows.select("image_id").distinct()
    free = unset(grown(rows, by, width, height), images, width, height)
    return unset(grown(free, by, width, height), images, width, height)


def run_links(rows: DataFrame, reach: int = 1) -> DataFrame:
    """(image_id, a, b): runs (``run`` = their name) that touch a run of the next row, corners included where ``reach`` is 1.  They meet in spans of
    ``SPAN`` pixels, each pair in one of them."""
    spans = lambda a, b: F.explode(F.expr(f"sequence(cast(floor(({a}) / {SPAN}) as int), cast(floor(({b}) / {SPAN}) as int))"))
    upper = rows.select("image_id", (F.col("y") + 1).alias("y"), F.col("run").alias("a"), F.col("x1").alias("a1"), F.col("x2").alias("a2"), spans(f"x1 - {reach}", f"x2 + {reach}").alias("span"))
    lower = rows.select("image_id", "y", F.col("run").alias("b"), F.col("x1").alias("b1"), F.col("x2").alias("b2"), spans("x1", "x2").alias("span"))
    met = upper.join(lower, ["image_id", "y", "span"]).where(f"b1 <= a2 + {reach} and b2 >= a1 - {reach} and span = floor(greatest(a1 - {reach}, b1) / {SPAN})")
    return met.select("image_id", "a", "b")


def shapes(rows: DataFrame, reach: int = 1) -> DataFrame:
    """(image_id, box_id, x, y, w, h, area, outline): the connected shapes of a mask's runs, with their box, their set pixels, and the pixels
    between the first and the last set one of each row.  ``box_id`` numbers an image's shapes by (y, x)."""
    named = kept(rows.withColumn("run", F.expr("y * 16777216L + x1")), "runs")
    root = connected(run_links(named, reach), ["image_id"]).select("image_id", F.col("node").alias("run"), "root")
    of = named.join(root, ["image_id", "run"], "left").withColumn("root", F.coalesce("root", "run"))
    lines = of.groupBy("image_id", "root", "y").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.sum(F.expr("x2 - x1 + 1")).alias("n"))
    out = lines.groupBy("image_id", "root").agg(
        F.min("x1").alias("x"), F.min("y").alias("y"), F.expr("max(x2) - min(x1) + 1").alias("w"), F.expr("max(y) - min(y) + 1").alias("h"), F.sum("n").alias("area"), F.sum(F.expr("x2 - x1 + 1")).alias("outline"),
    )
    return _numbered(out, "root").select("image_id", "box_id", *(F.col(c).cast("long").alias(c) for c in ("x", "y", "w", "h", "area", "outline")))


def _numbered(boxes: DataFrame, *last: str) -> DataFrame:
    return boxes.withColumn("box_id", F.row_number().over(Window.partitionBy("image_id").orderBy("y", "x", *last)).cast("long"))


# -- thresholds


def otsu(histogram: DataFrame, keys: list[str], weight: str = "n") -> DataFrame:
    """(keys, t): the gray value t with the largest variance between the values up to t and those above, the smallest of equals, from a
    histogram (keys, v, n); by running sums of weight and of value along the histogram.  Null where there is one value only."""
    up = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    m = F.col(weight) * F.col("v")
    h = histogram.withColumns({"n0": F.sum(weight).over(up), "s0": F.sum(m).over(up), "n1": F.sum(weight).over(all_), "s1": F.sum(m).over(all_)})
    # in whole numbers but for the last division: (n0 s - s0 n)^2 / (n0 (n - n0))
    d = "cast(s0 * n1 - s1 * n0 as double)"
    h = h.where("n0 < n1").withColumn("between", F.expr(f"{d} * {d} / (cast(n0 as double) * cast(n1 - n0 as double))"))
    best = h.groupBy(*keys).agg(F.expr("min_by(v, struct(-between, v))").alias("t"))
    return histogram.select(*keys).distinct().join(best, keys, "left")


def image_ink(pixels: DataFrame) -> DataFrame:
    """(image_id, x, y, ink): 1 where a pixel is not brighter than its image's own threshold; an image of one gray has no ink."""
    v = gray(pixels)
    t = otsu(v.groupBy("image_id", "v").agg(F.count("*").alias("n")), ["image_id"])
    return v.join(t, "image_id").select("image_id", "x", "y", F.expr("if(v <= t, 1, 0)").alias("ink")).withColumn("ink", F.coalesce("ink", F.lit(0)))


def box_colors(pixels: DataFrame, boxes: DataFrame, contrast: float = 40.0) -> DataFrame:
    """(image_id, box_id, t, foreground, background): the mean colours of the two sides of each box's own threshold, that of most of its border the
    background.  Of a box of one gray the mean is the background; where the two are too alike in luma both are null."""
    cells = boxes.withColumn("py", F.explode(F.expr("sequence(y, y + h - 1)"))).withColumn("px", F.explode(F.expr("sequence(x, x + w - 1)")))
    edge = F.expr("cast(px = x or px = x + w - 1 or py = y or py = y + h - 1 as long)")
    cells = cells.select("image_id", "box_id", edge.alias("edge"), F.col("px").alias("x"), F.col("py").alias("y"))
    seen = cells.join(apart(pixels.withColumn("v", F.expr(f"cast({GRAY} as int)"))), ["image_id", "x", "y"])
    h = seen.groupBy("image_id", "box_id", "v").agg(F.count("*").alias("n"), F.sum("edge").alias("edge"), *(F.sum(c).alias(c) for c in "rgb"))
    return side_colors(h, contrast)


def side_colors(histogram: DataFrame, contrast: float = 40.0) -> DataFrame:
    """What ``box_colors`` says, from (image_id, box_id, v, n, edge, r, g, b): pixels of each gray value of a box, those on its border, and the sums of their colours.
    A box's values meet once, for the threshold and all that follows."""
    box = Window.partitionBy("image_id", "box_id")
    up = box.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = histogram.withColumns({"n0": F.sum("n").over(up), "s0": F.sum(F.expr("n * v")).over(up), "n1": F.sum("n").over(box), "s1": F.sum(F.expr("n * v")).over(box)})
    d = "cast(s0 * n1 - s1 * n0 as double)"
    between = F.expr(f"-({d} * {d} / nullif(cast(n0 as double) * cast(n1 - n0 as double), 0D))")
    h = h.withColumn("t", F.min(F.when(F.expr("n0 < n1"), F.struct(between.alias("between"), "v"))).over(box)["v"])
    dark = F.col("t").isNotNull() & (F.col("v") <= F.col("t"))
    side = h.groupBy("image_id", "box_id", "t", dark.alias("dark")).agg(*(F.sum(c).alias(c) for c in ("n", "edge", "r", "g", "b")))
    mean = F.struct("edge", *(F.expr(f"cast({c} div n as int)").alias(c) for c in "rgb"))
    both = side.groupBy("image_id", "box_id", "t").agg(F.max(F.when(F.col("dark"), mean)).alias("d"), F.max(F.when(~F.col("dark"), mean)).alias("l"))
    both = both.withColumns({"bg": F.expr("if(d is null or l.edge >= d.edge, l, d)"), "fg": F.expr("if(d is null or l.edge >= d.edge, d, l)")})
    luma = lambda c: f"(0.299D * {c}.r + 0.587D * {c}.g + 0.114D * {c}.b)"
    alike = F.expr(f"d is not null and abs({luma('fg')} - {luma('bg')}) < {contrast}")
    code = lambda c: F.when(~alike & F.col(c).isNotNull(), F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(F.col(f"{c}.{k}").cast("long")), 2, "0") for k in "rgb"))))
    return both.select("image_id", "box_id", "t", code("fg").alias("foreground"), code("bg").alias("background"))


# -- lines and checkboxes


def image_lines(mask: DataFrame, length: int = 79, thick: int = 15, least: int = 20) -> DataFrame:
    """(image_id, direction, x, y, w, h): straight lines of a mask: shapes of the runs of at least ``length`` pixels along rows and along columns, longer
    than ``least`` and at most ``thick`` thick.  (Two openings by 40 pixels leave runs of 79.)"""

    def along(m: DataFrame) -> DataFrame:
        long = runs(m).where(f"x2 - x1 + 1 >= {length}")
        return shapes(long).where(f"w > {least} and h <= {thick}").select("image_id", "x", "y", "w", "h")

    down = along(turned(mask)).select("image_id", F.lit("vertical").alias("direction"), F.col("y").alias("x"), F.col("x").alias("y"), F.col("h").alias("w"), F.col("w").alias("h"))
    return along(mask).select("image_id", F.lit("horizontal").alias("direction"), "x", "y", "w", "h").unionByName(down)


def image_checkboxes(ink: DataFrame, low: int = 8, high: int = 32, margin: int = 2, share: float = 0.15) -> DataFrame:
    """(image_id, box_id, x, y, w, h, ink, checked): shapes of dense ``ink`` that are nearly square and of ``low`` to ``high`` pixels, checked where more than ``share`` of their inside is ink."""
    found = shapes(runs(ink.where("ink = 1"))).where(f"w between {low} and {high} and h between {low} and {high} and w / h between 0.8 and 1.25")
    return filled_boxes(ink, found.select("image_id", "box_id", "x", "y", "w", "h"), margin, share)


# -- edges


def _around(column: str, outside: Column | None = None) -> dict[str, Column]:
    """The values left and right of a pixel of a band; beyond the border the pixel's own, or ``outside``."""
    own, row = F.col(column) if outside is None else outside, _row("band")
    return {f"{column}_l": F.coalesce(F.lag(column).over(row), own), f"{column}_r": F.coalesce(F.lead(column).over(row), own)}


def banded(image: DataFrame, beside: int = 2) -> DataFrame:
    """A dense gray image (image_id, x, y, v) with ``band``: every ``BAND`` rows of an image together in a task, with ``beside`` rows above and below them.  A row travels as one list of its values."""
    rows = image.groupBy("image_id", "y").agg(F.min("x").alias("x0"), F.expr("transform(array_sort(collect_list(struct(x, v))), p -> p.v)").alias("vs"))
    rows = rows.withColumn("band", F.explode(F.expr(f"sequence(greatest(y - {beside}, 0) div {BAND}, (y + {beside}) div {BAND})"))).repartition("image_id", "band")
    return rows.select("image_id", "band", "y", "x0", F.posexplode("vs").alias("k", "v")).select("image_id", "band", F.expr("x0 + k").alias("x"), "y", "v")


def canny(image: DataFrame, low: int, high: int) -> DataFrame:
    """The mask of edges of a dense gray image: Sobel gradients (sum of both), the largest across the edge's direction, those above ``high`` and what is connected to them above ``low``."""
    three = lambda c: F.struct(f"{c}_l", c, f"{c}_r")
    column = _column("band")
    v = banded(image).withColumns(_around("v")).withColumn("row", three("v"))
    v = v.withColumns({"up": F.coalesce(F.lag("row").over(column), F.col("row")), "dn": F.coalesce(F.lead("row").over(column), F.col("row"))})
    gx = F.expr("(up.v_r + 2 * v_r + dn.v_r) - (up.v_l + 2 * v_l + dn.v_l)")
    gy = F.expr("(dn.v_l + 2 * dn.v + dn.v_r) - (up.v_l + 2 * up.v + up.v_r)")
    g = v.select("image_id", "band", "x", "y", gx.cast("long").alias("gx"), gy.cast("long").alias("gy")).withColumn("m", F.expr("abs(gx) + abs(gy)"))
    g = g.withColumns(_around("m", F.lit(0).cast("long"))).withColumn("row", three("m"))
    none = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("m_l", "m", "m_r")))
    g = g.withColumns({"up": F.coalesce(F.lag("row").over(column), none), "dn": F.coalesce(F.lead("row").over(column), none)}).where(f"y div {BAND} = band")
    # tan 22.5 and tan 67.5 degrees in 1/32768
    g = g.withColumns({"ax": F.expr("abs(gx) * 13573"), "ay": F.expr("abs(gy) * 32768")})
    peak = F.expr(
        "case when ay < ax then m > m_l and m >= m_r when ay > ax + abs(gx) * 65536 then m > up.m and m >= dn.m "
        "when (gx < 0) <> (gy < 0) then m > up.m_r and m > dn.m_l else m > up.m_l and m > dn.m_r end"
    )
    some = kept(g.where(peak & (F.col("m") > low)).select("image_id", "x", "y", (F.col("m") > high).alias("strong")), "edges")
    name = F.expr("y * 16777216L + x")
    here = some.select("image_id", "x", "y", name.alias("b"))
    # every edge pixel with those to its right and below it, corners included
    moved = [some.select("image_id", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), name.alias("a")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1))]
    links = reduce(DataFrame.union, (m.join(here, ["image_id", "x", "y"]).select("image_id", "a", "b") for m in moved))
    root = connected(links, ["image_id"])
    of = some.withColumn("node", name).join(root, ["image_id", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    firm = of.groupBy("image_id", "root").agg(F.max("strong").alias("firm")).where("firm")
    return of.join(firm.select("image_id", "root"), ["image_id", "root"], "left_semi").select("image_id", "x", "y")


# -- what an image shows


def mask_overlap(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """(image_id, name): the set pixels of both masks over those of either; images that have none in either are missing."""
    both = a.select("image_id", "x", "y", F.lit(1).alias("a")).join(b.select("image_id", "x", "y", F.lit(1).alias("b")), ["image_id", "x", "y"], "full")
    return both.groupBy("image_id").agg((F.count(F.expr("a + b")) / F.count("*")).alias(name))


def strokes(mask: DataFrame, length: int = 25) -> DataFrame:
    """The set pixels in runs of at least ``length`` along a row or a column."""

    def along(m: DataFrame) -> DataFrame:
        return runs(m).where(f"x2 - x1 + 1 >= {length}").select("image_id", "y", F.explode(F.sequence("x1", "x2")).alias("x"))

    return along(mask).select("image_id", "x", "y").union(turned(along(turned(mask))).select("image_id", "x", "y")).distinct()


def fidelity_measures(original: DataFrame, other: DataFrame, bright: int = 200, stroke: int = 25, low: int = 50, high: int = 150, size: tuple[int, int] | None = None) -> DataFrame:
    """(key, width, height, ssim, layout, border, checkbox): how like two dense images of one size are, by structure, by their edges, by long strokes of
    pixels up to ``bright``, and by the number of small squares.  With ``size`` (width, height) the tables are the boxes that the images are drawn from."""
    from quire.operators import drawings  # draws with what is here

    if size and size[0] * size[1] <= drawings.WHOLE:
        return _measured(drawings.fidelity_measures(original, other, *size, bright, stroke, low, high))
    if size:
        original, other = painted(original, *size), painted(other, *size)
    a, b = kept(gray(original), "gray"), kept(gray(other), "gray")
    size = a.groupBy("image_id").agg((F.max("x") + 1).cast("double").alias("width"), (F.max("y") + 1).cast("double").alias("height"))
    ink = [v.where(F.col("v") <= bright).select("image_id", "x", "y") for v in (a, b)]
    layout = mask_overlap(canny(a, low, high), canny(b, low, high), "layout")
    border = mask_overlap(strokes(ink[0], stroke), strokes(ink[1], stroke), "border")
    square = "w between 8 and 32 and h between 8 and 32 and w / h between 0.8 and 1.25"
    n = [shapes(runs(m)).where(square).groupBy("image_id").agg(F.count("*").alias(f"n{k}")) for k, m in enumerate(ink)]
    out = size.join(ssim(a, b), "image_id").join(layout, "image_id", "left").join(border, "image_id", "left").join(n[0], "image_id", "left").join(n[1], "image_id", "left")
    return _measured(out)


def _measured(out: DataFrame) -> DataFrame:
    """Measures (image_id, width, height, ssim, layout, border, n0, n1) as they are told: 1 where neither image has what is compared."""
    ratio = "if(coalesce(n0, 0) = 0 and coalesce(n1, 0) = 0, 1D, least(coalesce(n0, 0), coalesce(n1, 0)) / greatest(coalesce(n0, 0), coalesce(n1, 0)))"
    one = lambda c: F.bround(F.coalesce(c, F.lit(1.0)), 6).alias(c)
    return out.select(F.col("image_id").alias("key"), "width", "height", "ssim", one("layout"), one("border"), F.expr(f"bround({ratio}, 6)").alias("checkbox"))


def edge_shapes(pixels: DataFrame, low: int, high: int, by: int, width: int, height: int) -> DataFrame:
    """The shapes of an image's edges, each edge pixel spread by ``by``."""
    return shapes(grown(runs(canny(gray(pixels), low, high)), by, width, height))


def cards(pixels: DataFrame, width: int, height: int, least: int = 2500, wide: int = 40, high: int = 20, icon: int = 100, fill: float = 0.65) -> DataFrame:
    """(image_id, box_id, x, y, w, h, color): boxes of edge shapes that could be cards: of more than ``least`` pixels and less than the image, no small squares, their outline
    nearly the box; the colour is the median of four pixels inside the corners.  A card lies in no larger one by more than four fifths."""
    s = edge_shapes(pixels, 30, 150, 1, width, height)
    big = s.where(f"w * h > {least} and w * h < {0.95 * width * height} and w > {wide} and h > {high} and not (w < {icon} and h < {icon} and w / h between 0.8 and 1.25) and outline / (w * h) > {fill}")
    inset = big.withColumns({"mx": F.expr("least(15, w div 4)"), "my": F.expr("least(15, h div 4)")})
    spots = inset.select("image_id", "box_id", F.expr("inline(array(" + ", ".join(f"struct({x} as px, {y} as py)" for x in ("x + mx", "x + w - 1 - mx") for y in ("y + my", "y + h - 1 - my")) + "))"))
    seen = spots.select("image_id", "box_id", F.col("px").alias("x"), F.col("py").alias("y")).join(apart(pixels), ["image_id", "x", "y"])
    color = seen.groupBy("image_id", "box_id").agg(*(F.expr(f"cast(percentile({c}, 0.5) as long)").alias(c) for c in "rgb"))
    color = color.select("image_id", "box_id", F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(c), 2, "0") for c in "rgb"))).alias("color"))
    out = big.join(color, ["image_id", "box_id"], "left").select("image_id", "box_id", "x", "y", "w", "h", "color")
    page = out.select(F.col("image_id").alias("document_id"), F.lit(0).alias("slide_number"), F.col("box_id").alias("element_id"), F.col("box_id").alias("ord"), F.lit("shape").alias("element_type"), *(F.col(a).cast("double").alias(b) for a, b in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))))
    inside = touching(page).where("a_width * a_height < b_width * b_height or (a_width * a_height = b_width * b_height and a_ord > b_ord)")
    share = "greatest(0, least(a_x + a_width, b_x + b_width) - greatest(a_x, b_x)) * greatest(0, least(a_y + a_height, b_y + b_height) - greatest(a_y, b_y))"
    inside = inside.where(f"{share} > 0.8 * a_width * a_height").select(F.col("document_id").alias("image_id"), F.col("a_element_id").alias("box_id"))
    return out.join(inside, ["image_id", "box_id"], "left_anti")


def content_rectangles(pixels: DataFrame, width: int, height: int, least: float = 0.15) -> DataFrame:
    """(image_id, x, y, w, h): the largest box of an edge shape that could be a page inside an image of a screen: of at least the share ``least`` of the image and
    less than all of it, between half as wide and three times as wide as high; of equal ones the first by (y, x)."""
    s = edge_shapes(pixels, 30, 100, 4, width, height)
    some = s.where(f"outline >= {least} * {width * height} and w * h < {0.95 * width * height} and w / h > 0.5 and w / h < 3")
    best = some.groupBy("image_id").agg(F.expr("min_by(struct(x, y, w, h), struct(-w * h, box_id))").alias("b"))
    return best.select("image_id", "b.*")


def chrome_bounds(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, x, y, w, h): what is left of an image without bars at its upper, lower and left edge, where they are more than a twentieth of it.

    An image is cut into strips of a hundredth.  A bar above ends where, beyond a twentieth and within a quarter of the height, a strip varies (by more than 30) and
    is unlike the one before (by more than 15); one below begins at the lowest dark strip (below 60) of the last 8 per cent that lies above 95; one at the left
    ends where, beyond a twentieth and within 30 per cent, a strip is unlike the one before by more than 20."""
    s = F.expr("cast(r + g + b as long)")
    n, total = F.count("*"), F.sum(s)

    def strips(key: Column, start: Column) -> DataFrame:
        rows = pixels.groupBy("image_id", key.alias("k")).agg((total / n / 3).alias("mean"), F.sqrt(F.greatest(F.sum(s * s) / n - (total / n) * (total / n), F.lit(0.0)) / 9).alias("std"))
        return rows.withColumn("before", F.lag("mean").over(Window.partitionBy("image_id").orderBy("k"))).withColumn("at", start)

    high, wide = max(1, height // 100), max(1, width // 100)
    k = F.col("k")
    top = strips(F.expr(f"y div {high}"), k * high).where(f"at < {int(height * 0.25)} and at > {height * 0.05} and std > 30 and abs(before - mean) > 15").groupBy("image_id").agg(F.min("at").alias("top"))
    low = strips(F.expr(f"({height - 1} - y) div {high}"), height - (k + 1) * high).where(f"at > {int(height * 0.92)} and at < {height * 0.95} and mean < 60").groupBy("image_id").agg(F.max("at").alias("low"))
    left = strips(F.expr(f"x div {wide}"), k * wide).where(f"at < {int(width * 0.3)} and at > {width * 0.05} and abs(before - mean) > 20").groupBy("image_id").agg(F.min("at").alias("left"))
    out = pixels.select("image_id").distinct()
    for x in (top, low, left):
        out = out.join(x, "image_id", "left")
    out = out.select("image_id", F.coalesce("left", F.lit(0)).alias("x"), F.coalesce("top", F.lit(0)).alias("y"), F.coalesce("low", F.lit(height)).alias("low"))
    out = out.where(f"y * {width} + ({height} - low) * {width} + x * (low - y) > {0.05 * width * height}")
    return out.select("image_id", *(F.expr(e).cast("long").alias(c) for c, e in (("x", "x"), ("y", "y"), ("w", f"{width} - x"), ("h", "low - y"))))


def page_regions(pixels: DataFrame, width: int, height: int, least: float = 0.15) -> DataFrame:
    """(image_id, x, y, w, h): the page that an image of a screen shows: its content rectangle, else what is left without bars; none where that is less than
    ``least`` of the image or nearly all of it."""
    found = kept(content_rectangles(pixels, width, height, least), "rectangles")
    rest = chrome_bounds(pixels, width, height).join(found, "image_id", "left_anti")
    return found.unionByName(rest).where(f"w * h >= {least * width * height} and not (w > {0.95 * width} and h > {0.95 * height})")


def resized(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Dense images in the sizes (image_id, width, height), every new pixel the mean of the four old ones around its centre, weighted by how near
    they are, rounded half up; an image that has its size already comes back as it was."""
    old = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("ow"), (F.max("y") + 1).alias("oh"))
    spots = sizes.join(old, "image_id").withColumn("y", F.explode(F.expr("sequence(0, height - 1)"))).withColumn("x", F.explode(F.expr("sequence(0, width - 1)")))

    def axis(c: str, new: str, size: str) -> str:
        at = f"least(greatest(({c} + 0.5D) * {size} / {new} - 0.5D, 0D), {size} - 1D)"
        return f"filter(array(struct(cast(floor({at}) as int) as at, 1 - ({at} - floor({at})) as part), struct(cast(floor({at}) + 1 as int) as at, {at} - floor({at}) as part)), s -> s.part > 0)"

    spots = spots.withColumn("a", F.explode(F.expr(axis("x", "width", "ow")))).withColumn("b", F.explode(F.expr(axis("y", "height", "oh"))))
    spots = spots.select("image_id", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("a.at").alias("x"), F.col("b.at").alias("y"), F.expr("a.part * b.part").alias("part"))
    seen = spots.join(apart(pixels), ["image_id", "x", "y"])
    mean = [F.expr(f"cast(floor(round(sum({c} * part), 6) + 0.5) as int)").alias(c) for c in "rgb"]
    return seen.groupBy("image_id", F.col("nx").alias("x"), F.col("ny").alias("y")).agg(*mean)


def blurred(image: DataFrame) -> DataFrame:
    """A dense gray image with every pixel the rounded mean of the nine around it, weighted 1 2 1 both ways, mirrored at the border."""
    near = lambda c, w: F.coalesce(F.lag(c).over(w), F.lead(c).over(w), F.col(c)) + 2 * F.col(c) + F.coalesce(F.lead(c).over(w), F.lag(c).over(w), F.col(c))
    both = image.withColumn("v", near("v", _row())).withColumn("v", near("v", _column()))
    return both.select("image_id", "x", "y", F.expr("cast((v + 8) div 16 as int)").alias("v"))


def contour_objects(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, x, y, w, h, source, confidence): boxes of closed edge shapes, from a two-thousandth to most of the image, no hair lines; the confidence is how much of its box an outline fills."""
    edges = closed(runs(canny(blurred(gray(pixels)), 40, 120)), 4, width, height)
    some = shapes(edges).where(f"w * h between {0.0005 * width * height} and {0.92 * width * height} and w >= 3 and h >= 3 and w / h between 0.0125 and 80")
    return some.select("image_id", "x", "y", "w", "h", F.lit("contour").alias("source"), F.expr("bround(least(0.95D, greatest(0.45D, outline / (w * h))), 3)").alias("confidence"))


def color_regions(pixels: DataFrame, width: int, height: int, step: int = 24, most: int = 10, by: int = 8) -> DataFrame:
    """(image_id, x, y, w, h, source, confidence): boxes of closed areas of one of the ``most`` most frequent colours, in steps of ``step``, that cover from a hundredth to four fifths of the image."""
    quantised = pixels.select("image_id", "x", "y", *(F.expr(f"{c} div {step}").alias(c) for c in "rgb"))
    n = quantised.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))
    n = n.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "r", "g", "b"))).where(f"place <= {most} and n between {0.01 * width * height} and {0.8 * width * height}")
    # every colour of an image is a mask of its own
    masks = quantised.join(n, ["image_id", "r", "g", "b"]).select(F.expr(f"image_id * {most} + place - 1").alias("image_id"), "x", "y")
    found = shapes(closed(runs(masks), by, width, height)).where(f"w * h between {0.004 * width * height} and {0.85 * width * height}")
    return found.select(F.expr(f"image_id div {most}").alias("image_id"), "x", "y", "w", "h", F.lit("color_region").alias("source"), F.lit(0.72).alias("confidence"))


def classified(objects: DataFrame, width: int, height: int) -> DataFrame:
    """``objects`` (x, y, w, h, source) with ``element_type`` and ``shape_type``: lines by their form, large panels, small icons, other shapes."""
    line = F.expr("source = 'line' or h <= 4 or w <= 4 or w / h > 12 or w / h < 0.08")
    panel, icon = F.expr(f"w * h / {width * height}D > 0.04"), F.expr(f"greatest(w, h) < {0.08 * max(width, height)}")
    kind = F.when(line, "line").when(panel, "panel").when(icon, "pixel_icon").otherwise("rect")
    of = F.when(line, "line").when(panel, "shape").when(icon, "icon").otherwise("shape")
    return objects.withColumns({"element_type": of, "shape_type": kind})


def sampled_styles(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """``boxes`` (image_id, box_id, x, y, w, h) with ``fill`` and ``stroke``: the medians of their pixels and of those of their border, corners counted twice."""
    cells = boxes.withColumn("py", F.explode(F.expr("sequence(y, y + h - 1)"))).withColumn("px", F.explode(F.expr("sequence(x, x + w - 1)")))
    times = F.expr("cast(px = x as int) + cast(px = x + w - 1 as int) + cast(py = y as int) + cast(py = y + h - 1 as int)")
    cells = cells.select("image_id", "box_id", times.alias("edge"), F.col("px").cast("int").alias("x"), F.col("py").cast("int").alias("y"))
    seen = cells.join(apart(pixels), ["image_id", "x", "y"])
    mid = [F.expr(f"cast(percentile({c}, 0.5) as long)").alias(f"f{c}") for c in "rgb"] + [F.expr(f"cast(percentile({c}, 0.5, edge) as long)").alias(f"s{c}") for c in "rgb"]
    code = lambda p: F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(f"{p}{c}"), 2, "0") for c in "rgb")))
    style = seen.groupBy("image_id", "box_id").agg(*mid).select("image_id", "box_id", code("f").alias("fill"), code("s").alias("stroke"))
    return boxes.join(style, ["image_id", "box_id"], "left")


def image_objects(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The objects that an image shows, by contours and by colours, with their class and style; lines have no fill."""
    every = contour_objects(pixels, width, height).unionByName(color_regions(pixels, width, height)).withColumns({c: F.col(c).cast("int") for c in ("x", "y", "w", "h")})
    every = kept(_numbered(every, "source", "w", "h"), "objects")
    out = sampled_styles(pixels, classified(every, width, height))
    return out.withColumn("fill", F.when(F.col("element_type") != "line", F.col("fill")))
