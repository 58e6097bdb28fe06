"""Spatial joins over elements.

Pairs meet on the page key and a cell of the page's grid.  A page of up to a few times ``CELL`` elements is one cell; a larger one is cut
so that a cell holds about ``CELL``, boxes go to every cell they touch, and a pair is reported in one of them only: that of the upper
left corner of what the two boxes share.  So the pairs that meet grow with the page and with the pairs that are found, not with its square.
The nearest element is sought in the cells around a point, then in cells of twice the size, until it is nearer than any cell
not looked at.  First-match rules are ``min_by`` over (measure, ord).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.elements import PAGE
from quire.sources.tables import kept

CONTAINERS = ("group", "shape", "table", "chart", "image")
GEOMETRY = ("element_id", "ord", "element_type", "x", "y", "width", "height")
GRID = ("m", "gx", "gy", "gw", "gh")
#: Elements of a cell, about.
CELL = 64


def side(elements: DataFrame, prefix: str, columns=GEOMETRY) -> DataFrame:
    return elements.select(*PAGE, *(F.col(c).alias(f"{prefix}_{c}") for c in columns))


def contains(outer: str, inner: str) -> Column:
    """The closed box ``inner`` lies in the closed box ``outer``."""
    return F.expr(
        f"{inner}_x >= {outer}_x and {inner}_y >= {outer}_y and {inner}_x + {inner}_width <= {outer}_x + {outer}_width "
        f"and {inner}_y + {inner}_height <= {outer}_y + {outer}_height"
    )


def centre(p: str) -> tuple[Column, Column]:
    return F.expr(f"{p}_x + {p}_width / 2"), F.expr(f"{p}_y + {p}_height / 2")


def boxes(elements: DataFrame) -> DataFrame:
    return elements.where(~F.col("element_type").isin("connector", "arrow"))


def gridded(elements: DataFrame) -> DataFrame:
    """``elements`` with their page's grid: ``m`` by ``m`` cells of ``gw`` by ``gh`` from (gx, gy)."""
    page = elements.groupBy(*PAGE).agg(
        F.expr(f"cast(greatest(1, floor(sqrt(count(*) / {CELL}))) as int)").alias("m"), F.min("x").alias("gx"), F.min("y").alias("gy"),
        F.max(F.expr("x + greatest(width, 0)")).alias("rx"), F.max(F.expr("y + greatest(height, 0)")).alias("ry"),
    )
    page = page.withColumns({"gw": F.expr("greatest((rx - gx) / m, 1e-9)"), "gh": F.expr("greatest((ry - gy) / m, 1e-9)")}).drop("rx", "ry")
    return elements.join(page, PAGE)


def _cell(at: str, origin: str, size: str, m: str = "m") -> str:
    return f"cast(least(greatest(floor(({at} - {origin}) / {size}), 0), {m} - 1) as int)"


def _touched(p: str, rows: DataFrame) -> DataFrame:
    """Every row once for each cell its box touches; a page of one cell needs no geometry."""
    span = lambda at, size, o, g: f"sequence({_cell(f'{p}_{at}', o, g)}, greatest({_cell(f'{p}_{at}', o, g)}, {_cell(f'({p}_{at} + {p}_{size})', o, g)}))"
    grid = f"flatten(transform({span('x', 'width', 'gx', 'gw')}, i -> transform({span('y', 'height', 'gy', 'gh')}, j -> i * m + j)))"
    return rows.withColumn("cell", F.explode(F.expr(f"if(m = 1, array(0), {grid})")))


def _point(p: str, rows: DataFrame, x: str, y: str) -> DataFrame:
    """Every row once, in the cell of a point."""
    return rows.withColumn("cell", F.expr(f"{_cell(x, 'gx', 'gw')} * m + {_cell(y, 'gy', 'gh')}"))


def _grid_side(elements: DataFrame, prefix: str, columns=GEOMETRY) -> DataFrame:
    return elements.select(*PAGE, *(F.col(c).alias(f"{prefix}_{c}") for c in columns), *GRID)


#: The cell in which a pair of boxes is reported.
_SHARED = f"{_cell('greatest(a_x, b_x)', 'gx', 'gw')} * m + {_cell('greatest(a_y, b_y)', 'gy', 'gh')}"


def candidate_edges(elements: DataFrame, column_tolerance: float, proximity: float, anchor: str = "all") -> DataFrame:
    """The pairs of boxes of a page that meet in a cell, a column or a neighbourhood, a_ord < b_ord, with the way (``way``) they met."""
    grid = gridded(boxes(elements))
    a, b = _grid_side(grid, "a"), _grid_side(grid, "b")
    if anchor == "first":
        a = a.join(a.groupBy(*PAGE).agg(F.min("a_ord").alias("first")), PAGE).where("a_ord = first").drop("first")

    def ways(rows: DataFrame, p: str, reach: int) -> DataFrame:
        """Cells touched; on pages of many cells also the column of the centre and the square of the centre, with those around on one side."""
        cx, cy = f"({p}_x + {p}_width / 2)", f"({p}_y + {p}_height / 2)"
        band = f"cast(floor({cx} / {column_tolerance * 1.001}) as long)"
        at = lambda c: f"cast(floor({c} / {proximity * 1.001}) as long)"
        around = f"sequence(-{reach}L, {reach}L)" if reach else "array(0L)"
        touched = _touched(p, rows).select("*", F.lit(0).alias("way"), F.col("cell").cast("long").alias("k1"), F.lit(0).cast("long").alias("k2")).drop("cell")
        large = rows.where("m > 1")
        column = large.select("*", F.lit(1).alias("way"), F.explode(F.expr(f"transform({around}, d -> {band} + d)")).alias("k1"), F.lit(0).cast("long").alias("k2"))
        square = F.explode(F.expr(f"flatten(transform({around}, d -> transform({around}, e -> struct({at(cx)} + d as k1, {at(cy)} + e as k2))))"))
        near = large.withColumn("k", square).select(*rows.columns, F.lit(2).alias("way"), "k.k1", "k.k2")
        return touched.union(column).union(near)

    return ways(a, "a", 0).join(ways(b, "b", 1).drop(*GRID), [*PAGE, "way", "k1", "k2"]).where("a_ord < b_ord")


def relationship_edges(elements: DataFrame, column_tolerance: float = 100000, proximity: float = 500000, anchor: str = "all") -> DataFrame:
    """One edge at most for each unordered pair of boxes, by priority: containment, column hierarchy, proximity.

    ``anchor="first"`` pairs only the first box of each page with the others.
    """
    (ax, ay), (bx, by) = centre("a"), centre("b")
    column = F.abs(ax - bx) < column_tolerance
    near = (ax - bx) * (ax - bx) + (ay - by) * (ay - by) < proximity * proximity
    ab, ba = contains("a", "b"), contains("b", "a")
    lower, upper = column & F.expr("b_y > a_y"), column & F.expr("a_y > b_y")
    kind = F.when(ab | ba, "contains").when(lower | upper, "hierarchy").when(near, "proximity")
    forward = F.when(ab, True).when(ba, False).when(lower, True).when(upper, False).otherwise(True)
    pairs = candidate_edges(elements, column_tolerance, proximity, anchor).withColumns({"relationship_type": kind, "f": forward}).where("relationship_type is not null")
    # a pair that meets in several ways is reported in the way of its kind
    once = f"m = 1 or (way = 0 and relationship_type = 'contains' and k1 = {_SHARED}) or (way = 1 and relationship_type = 'hierarchy') or (way = 2 and relationship_type = 'proximity')"
    return pairs.where(once).select(
        *PAGE, "relationship_type",
        F.expr("if(f, a_element_id, b_element_id)").alias("source_element_id"), F.expr("if(f, b_element_id, a_element_id)").alias("target_element_id"),
        F.expr("case relationship_type when 'contains' then 0.9D when 'hierarchy' then 0.8D else 0.7D end").alias("confidence"),
    )


def touching(elements: DataFrame, columns=GEOMETRY) -> DataFrame:
    """Pairs a, b of different elements of a page whose boxes share a cell, each once if the boxes overlap."""
    grid = gridded(elements)
    a, b = _touched("a", _grid_side(grid, "a", columns)), _touched("b", _grid_side(grid, "b", columns)).drop(*GRID)
    return a.join(b, [*PAGE, "cell"]).where(f"a_ord <> b_ord and cell = {_SHARED}")


def overlap_pairs(elements: DataFrame) -> DataFrame:
    """Both directions of every overlapping pair: intersection over the smaller area, and the other's place in z."""
    w = "(least(a_x + a_width, b_x + b_width) - greatest(a_x, b_x))"
    h = "(least(a_y + a_height, b_y + b_height) - greatest(a_y, b_y))"
    pairs = touching(elements, (*GEOMETRY, "z_order")).where(f"{w} > 0 and {h} > 0")
    ratio = f"{w} * {h} / if(least(a_width * a_height, b_width * b_height) = 0, 1D, least(a_width * a_height, b_width * b_height))"
    above = F.expr("case when b_z_order > a_z_order then 'above' when b_z_order < a_z_order then 'below' else 'same' end")
    return pairs.select(*PAGE, F.col("a_element_id").alias("element_id"), F.col("b_element_id").alias("other_id"), F.expr(f"bround({ratio}, 6)").alias("overlap_ratio"), above.alias("z_relation"))


def smallest_container(elements: DataFrame) -> DataFrame:
    """Each element with the smallest container that holds it (ties by ord), null where there is none.  Of two equal
    boxes the earlier holds the later, so parents form a forest."""
    grid = gridded(elements)
    c = _touched("c", _grid_side(grid.where(F.col("element_type").isin(*CONTAINERS)), "c")).drop(*GRID)
    e = _point("e", _grid_side(grid, "e"), "e_x", "e_y").drop(*GRID)
    strict = F.expr("c_width * c_height > e_width * e_height or c_ord < e_ord")
    inside = e.join(c, [*PAGE, "cell"]).where("e_ord <> c_ord").where(contains("c", "e")).where(strict)
    parent = inside.groupBy(*PAGE, "e_element_id").agg(F.expr("min_by(c_element_id, struct(c_width * c_height, c_ord))").alias("parent_id"))
    return elements.select(*PAGE, "element_id").join(parent.withColumnRenamed("e_element_id", "element_id"), [*PAGE, "element_id"], "left")


def nearest(seekers: DataFrame, points: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """(keys, q, and for each rule its result): the point (b_element_id, b_ord, bx, by) nearest to each seeker (q, q_ord, qx, qy) of those of its
    ``keys`` that a rule over dx, dy lets in; a seeker never finds the point of its own q_ord.  Both sides have their page's grid.

    Round k looks at the nine squares of 2**k cells around a seeker: what is nearer than one square's side is the nearest of
    all, and the others look again, until one square is the whole page."""
    most = points.agg(F.max("m")).first()[0] or 1
    wanted = list(rules)
    found, left, k = None, seekers, 1
    while True:
        size = F.lit(float(k))
        sq = lambda c, o, g: F.floor((F.col(c) - F.col(o)) / (F.col(g) * size)).cast("long")
        whole = F.col("m") <= k
        cell = lambda c, o, g: F.when(whole, F.lit(0).cast("long")).otherwise(sq(c, o, g))
        p = points.withColumns({"i": cell("bx", "gx", "gw"), "j": cell("by", "gy", "gh")}).drop(*GRID)
        near = "if(m <= {k}, array(0L), sequence(-1L, 1L))".replace("{k}", str(k))
        q = left.withColumns({"i0": cell("qx", "gx", "gw"), "j0": cell("qy", "gy", "gh")})
        q = q.withColumn("i", F.explode(F.expr(f"transform({near}, d -> i0 + d)"))).withColumn("j", F.explode(F.expr(f"transform({near}, d -> j0 + d)")))
        met = q.join(p, [*keys, "i", "j"], "left").withColumns({"dx": F.expr("bx - qx"), "dy": F.expr("by - qy")})
        d = "dx * dx + dy * dy"
        ok = lambda rule: f"b_element_id is not null and not (b_ord <=> q_ord) and ({rule})"
        picks = [F.expr(f"min_by(b_element_id, struct({d}, b_ord)) filter (where {ok(r)})").alias(n) for n, r in rules.items()]
        far = [F.expr(f"min({d}) filter (where {ok(r)})").alias(f"d_{n}") for n, r in rules.items()]
        got = met.groupBy(*keys, "q", "q_ord", "qx", "qy", *GRID).agg(*picks, *far)
        if k >= most:
            done = got.select(*keys, "q", *wanted)
            return done if found is None else found.unionByName(done)
        sure = " and ".join(f"coalesce(d_{n} < pow(least(gw, gh) * {k}, 2), false)" for n in wanted)
        got = kept(got.withColumn("sure", F.expr(f"m <= {k} or ({sure})")), "nearest")
        done = got.where("sure").select(*keys, "q", *wanted)
        found = done if found is None else found.unionByName(done)
        left, k = got.where("not sure").select(*seekers.columns), 2 * k


def nearest_neighbours(elements: DataFrame, peers: DataFrame | None = None) -> DataFrame:
    """Nearest element left, right, above and below by centre distance; with ``peers`` (element_id, parent_id) only among
    elements of one parent."""
    grid, keys = gridded(elements), list(PAGE)
    if peers is not None:
        grid = grid.join(peers.select(*PAGE, "element_id", F.coalesce(F.col("parent_id").cast("string"), F.lit("root")).alias("parent")), [*PAGE, "element_id"])
        keys.append("parent")
    cx, cy = F.expr("x + width / 2"), F.expr("y + height / 2")
    q = grid.select(*keys, F.col("element_id").alias("q"), F.col("ord").alias("q_ord"), cx.alias("qx"), cy.alias("qy"), *GRID)
    b = grid.select(*keys, F.col("element_id").alias("b_element_id"), F.col("ord").alias("b_ord"), cx.alias("bx"), cy.alias("by"), *GRID)
    found = nearest(q, b, keys, {"left_id": "dx < 0", "right_id": "dx > 0", "above_id": "dy < 0", "below_id": "dy > 0"})
    found = found.withColumnRenamed("q", "element_id").drop("parent")
    return elements.select(*PAGE, "element_id").join(found, [*PAGE, "element_id"], "left")


def connector_targets(elements: DataFrame) -> DataFrame:
    """Each connector or arrow with the boxes whose centres are nearest to where it begins and ends (begin_x, begin_y, end_x, end_y), and its
    direction; dropped where an end is not known or both ends are at one box."""
    grid = gridded(elements)
    known = "begin_x is not null and begin_y is not null and end_x is not null and end_y is not null"
    c = grid.where("element_type in ('connector', 'arrow')").where(known)
    ends = c.select(*PAGE, "element_id", *GRID, F.expr("inline(array(struct('source' as end, begin_x as qx, begin_y as qy), struct('target' as end, end_x as qx, end_y as qy)))"))
    seekers = ends.select(*PAGE, F.struct("element_id", "end").alias("q"), F.lit(None).cast("long").alias("q_ord"), "qx", "qy", *GRID)
    points = boxes(grid).select(*PAGE, F.col("element_id").alias("b_element_id"), F.col("ord").alias("b_ord"), F.expr("x + width / 2").alias("bx"), F.expr("y + height / 2").alias("by"), *GRID)
    found = nearest(seekers, points, list(PAGE), {"box": "true"})
    at = lambda end: F.expr(f"max(box) filter (where q.end = '{end}')").alias(f"{end}_element_id")
    got = found.groupBy(*PAGE, F.col("q.element_id").alias("connector_id")).agg(at("source"), at("target")).where("source_element_id <> target_element_id")
    way = c.select(*PAGE, F.col("element_id").alias("connector_id"), F.expr("end_x - begin_x").alias("dx"), F.expr("end_y - begin_y").alias("dy"))
    return got.join(way, [*PAGE, "connector_id"]).select(
        *PAGE, "connector_id", "source_element_id", "target_element_id",
        F.expr("case when abs(dx) > abs(dy) then if(dx > 0, 'left_to_right', 'right_to_left') else if(dy > 0, 'top_to_bottom', 'bottom_to_top') end").alias("direction"),
        F.lit(0.95).alias("confidence"),
    )


def text_in_card(elements: DataFrame) -> DataFrame:
    """Each text with the first card (shape) whose box holds its centre; null where there is none."""
    grid = gridded(elements)
    t = _point("t", _grid_side(grid.where("element_type = 'text_box'"), "t"), "(t_x + t_width / 2)", "(t_y + t_height / 2)").drop(*GRID)
    c = _touched("c", _grid_side(grid.where("element_type = 'shape'"), "c")).drop(*GRID)
    tx, ty = centre("t")
    inside = t.join(c, [*PAGE, "cell"]).withColumns({"tx": tx, "ty": ty}).where("tx >= c_x and tx <= c_x + c_width and ty >= c_y and ty <= c_y + c_height")
    card = inside.groupBy(*PAGE, F.col("t_element_id").alias("element_id")).agg(F.expr("min_by(c_element_id, c_ord)").alias("card_id"))
    return elements.where("element_type = 'text_box'").select(*PAGE, "element_id").join(card, [*PAGE, "element_id"], "left")
