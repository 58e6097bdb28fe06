"""The main colours of every image, by k-means over all images at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.tables import kept


def dominant_colors(pixels: DataFrame, k: int = 8, starts: int = 3, rounds: int = 10, seed: int = 42) -> DataFrame:
    """(image_id, cluster, color, share): up to ``k`` main colours of each image (image_id, r, g, b).

    Lloyd's rounds for all images and starts in one plan: the colours of an image are counted once, each round gives every colour its nearest centre (the
    first of equals), sums by (image, start, centre), and so moves the centres.  A start takes the ``k`` colours with the smallest MD5 of
    seed, start and colour; an image of fewer colours has as many centres; a centre that gets no colour stays where it is.  Of
    the starts that with the smallest sum of squares counts.  Colours are cut to whole numbers, and come in order of their share."""
    colors = kept(pixels.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n")), "colors")
    begin = colors.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "start", "r", "g", "b").cast("binary"))
    begin = begin.withColumn("place", F.row_number().over(Window.partitionBy("image_id", "start").orderBy(draw, "r", "g", "b"))).where(f"place <= {k}")
    at = F.struct("place", *(F.col(c).cast("double").alias(c) for c in "rgb"))
    centres = begin.groupBy("image_id", "start").agg(F.array_sort(F.collect_list(at)).alias("centres"))

    far = "(c.r - r) * (c.r - r) + (c.g - g) * (c.g - g) + (c.b - b) * (c.b - b)"
    near = F.expr(f"array_min(transform(centres, c -> struct({far} as d, c.place as place)))")

    def given(centres: DataFrame) -> DataFrame:
        return colors.join(centres, "image_id").withColumn("near", near)

    for _ in range(rounds):
        sums = given(centres).groupBy("image_id", "start", F.col("near.place").alias("place")).agg(F.first("centres").alias("centres"), *(F.expr(f"sum({c} * n) / cast(sum(n) as double)").alias(c) for c in "rgb"))
        moved = sums.groupBy("image_id", "start").agg(F.first("centres").alias("centres"), F.map_from_entries(F.collect_list(F.struct("place", F.struct("place", "r", "g", "b")))).alias("new"))
        centres = moved.select("image_id", "start", F.expr("transform(centres, c -> coalesce(new[c.place], c))").alias("centres"))
    centres = kept(centres, "centres")
    last = given(centres).groupBy("image_id", "start", F.col("near.place").alias("place")).agg(F.sum("n").alias("n"), F.sum(F.expr("near.d * n")).alias("d"))
    cost = last.groupBy("image_id", "start").agg(F.bround(F.sum("d"), 3).alias("d"))
    best = cost.groupBy("image_id").agg(F.expr("min_by(start, struct(d, start))").alias("start"))
    own = centres.join(best, ["image_id", "start"]).select("image_id", "start", F.explode("centres").alias("c")).select("image_id", "start", "c.*")
    size = Window.partitionBy("image_id")
    out = own.join(last.select("image_id", "start", "place", "n"), ["image_id", "start", "place"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    code = F.concat(F.lit("#"), *(F.lpad(F.hex(F.floor(F.round(c, 9))), 2, "0") for c in "rgb"))
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), "color", "place")
    out = out.withColumns({"color": code, "share": F.bround(F.col("n") / F.sum("n").over(size), 6)})
    return out.withColumn("cluster", F.row_number().over(order)).select("image_id", "cluster", "color", "share")
