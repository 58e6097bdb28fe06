"""Operators whose state depends on the order of a page's elements.

A page is one group: its elements are few by nature (a slide, a sheet), and only they meet in a task.  Folds over one
sorted array stay in the JVM, greedy choices go in rounds over the pairs that matter; the walk over a graph runs in Python per page.
Null texts count as empty; ties are broken by ``ord``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.spatial import touching
from quire.sources.elements import PAGE
from quire.sources.tables import kept

#: The most elements of one page that a task takes in Python.
PAGE_LIMIT = 200_000


def bounded(page: pd.DataFrame) -> pd.DataFrame:
    """The page, if a task may hold it."""
    if len(page) > PAGE_LIMIT:
        raise ValueError(f"page {tuple(page.iloc[0][PAGE])} has {len(page)} elements, more than {PAGE_LIMIT}")
    return page


def _sorted(elements: DataFrame, *fields: str, keys=PAGE) -> DataFrame:
    return elements.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))


def layers_from_start(elements: DataFrame, height: float = 1_000_000) -> DataFrame:
    """Layers of text boxes and shapes: one ends where an element lies more than ``height`` below the layer's first."""
    e = elements.where(F.col("element_type").isin("text_box", "shape"))
    fold = f"""aggregate(items, named_struct('start', items[0].y, 'n', 1, 'out', cast(array() as array<int>)),
      (a, i) -> named_struct('start', if(i.y - a.start > {height}D, i.y, a.start), 'n', if(i.y - a.start > {height}D, a.n + 1, a.n),
        'out', array_append(a.out, if(i.y - a.start > {height}D, a.n + 1, a.n))), a -> a.out)"""
    return _numbered(_sorted(e, "y", "ord", "element_id"), fold, "layer")


def rows_by_running_mean(elements: DataFrame, tolerance: float = 150_000) -> DataFrame:
    """Rows of elements whose centre lies within ``tolerance`` of the mean of the row so far."""
    e = elements.withColumn("cy", F.col("y") + F.col("height") / 2)
    far = f"abs(i.cy - a.sum / a.k) > {tolerance}D"
    fold = f"""aggregate(items, named_struct('sum', items[0].cy, 'k', 0, 'n', 1, 'out', cast(array() as array<int>)),
      (a, i) -> if(a.k = 0, named_struct('sum', i.cy, 'k', 1, 'n', 1, 'out', array_append(a.out, 1)),
        if({far}, named_struct('sum', i.cy, 'k', 1, 'n', a.n + 1, 'out', array_append(a.out, a.n + 1)),
          named_struct('sum', a.sum + i.cy, 'k', a.k + 1, 'n', a.n, 'out', array_append(a.out, a.n)))), a -> a.out)"""
    return _numbered(_sorted(e, "cy", "ord", "element_id"), fold, "row")


def _numbered(pages: DataFrame, fold: str, name: str) -> DataFrame:
    return pages.select(*PAGE, F.expr(f"inline(zip_with(items, {fold}, (i, k) -> named_struct('element_id', i.element_id, '{name}', k)))"))


def merge_spans(elements: DataFrame, gap: float = 40_000, rise: float = 20_000, keys=PAGE, separator: str = "") -> DataFrame:
    """Text spans joined with the span before while they start on its line and not beyond ``gap`` from its end."""
    e = elements.withColumn("text", F.coalesce("text", F.lit("")))
    one = "named_struct('first_id', i.element_id, 'x', i.x, 'y', i.y, 'width', i.width, 'height', i.height, 'text', i.text, 'parts', 1)"
    last = "element_at(a, -1)"
    fits = f"size(a) > 0 and abs(i.y - {last}.y) < {rise}D and i.x - ({last}.x + {last}.width) < {gap}D"
    grown = f"named_struct('first_id', {last}.first_id, 'x', {last}.x, 'y', {last}.y, 'width', i.x + i.width - {last}.x, 'height', {last}.height, 'text', {last}.text || '{separator}' || i.text, 'parts', {last}.parts + 1)"
    empty = "cast(array() as array<struct<first_id:{0},x:double,y:double,width:double,height:double,text:string,parts:int>>)".format(dict(e.dtypes)["element_id"])
    fold = f"aggregate(items, {empty}, (a, i) -> if({fits}, array_append(slice(a, 1, greatest(size(a) - 1, 0)), {grown}), array_append(a, {one})))"
    return _sorted(e, "y", "x", "ord", "element_id", "width", "height", "text", keys=keys).select(*keys, F.expr(f"inline({fold})"))


def merge_split_numbers(boxes: DataFrame) -> DataFrame:
    """Boxes (page, element_id, ord, x, y, width, text) with a number that was cut at its comma put together again: a text
    that ends with a comma or starts an amount takes the next box if that has three digits, less than 50 away in y
    and less than 100 to the right.  A box is used once."""
    order = Window.partitionBy(*PAGE).orderBy("y", "x", "ord")
    b = boxes.select(*PAGE, "element_id", "ord", "x", "y", "width", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    b = b.withColumn("last", F.lag(F.struct("x", "y", "width", "text")).over(order))
    near = "abs(y - last.y) < 50 and x - (last.x + last.width) > 0 and x - (last.x + last.width) < 100"
    goes_on = F.coalesce(F.expr(f"(last.text rlike ',$' or last.text rlike '^[$][0-9]{{1,3}},?$') and text rlike '^[0-9]{{3}}$' and {near}"), F.lit(False))
    # of boxes that each go on with the one before, every second is taken by it: a box is used once
    b = b.withColumn("fits", goes_on).withColumn("run", F.sum((~F.col("fits")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.withColumn("taken", F.row_number().over(Window.partitionBy(*PAGE, "run").orderBy("y", "x", "ord")) % 2 == 0)
    b = b.withColumn("next", F.lead(F.struct("x", "width", "text", "taken")).over(order)).where("not taken")
    two = F.coalesce(F.col("next.taken"), F.lit(False))
    return b.select(
        *PAGE, F.col("element_id").alias("first_id"), "x", "y", F.when(two, F.expr("next.x + next.width - x")).otherwise(F.col("width")).alias("width"), F.when(two, F.concat("text", "next.text")).otherwise(F.col("text")).alias("text"),
        F.when(two, 2).otherwise(1).alias("parts"),
    )


def _schema(elements: DataFrame, extra: str) -> str:
    kind = dict(elements.dtypes)
    return ", ".join(f"{c} {kind[c]}" for c in (*PAGE, "element_id")) + extra


def greedy_boxes(elements: DataFrame, order: str, share: float = 0.5, of: str = "smaller") -> DataFrame:
    """Boxes in falling ``order``, each kept unless more than ``share`` of the smaller box (or of its own area, with
    ``of='own'``) lies in a kept one.

    Only pairs that cover each other that much matter; they are found by cells.  In a round the boxes that no undecided earlier one covers are
    kept, what they cover goes, and so do the pairs of both; no page is ever in one task."""
    cols = tuple(dict.fromkeys(("element_id", "ord", "x", "y", "width", "height", order)))
    both = "greatest(0D, least(a_x + a_width, b_x + b_width) - greatest(a_x, b_x)) * greatest(0D, least(a_y + a_height, b_y + b_height) - greatest(a_y, b_y))"
    size = "b_width * b_height" if of == "own" else "least(a_width * a_height, b_width * b_height)"
    pairs = touching(elements, cols).where(f"{both} > {share} * {size}").where(f"a_{order} > b_{order} or (a_{order} = b_{order} and a_ord < b_ord)")
    pairs = kept(pairs.select(*PAGE, F.col("a_element_id").alias("a"), F.col("b_element_id").alias("b")), "covers")
    gone = []
    while not pairs.isEmpty():
        later = pairs.select(*PAGE, F.col("b").alias("a")).distinct()
        out = kept(pairs.join(later, [*PAGE, "a"], "left_anti").select(*PAGE, "b").distinct(), "covered")
        gone.append(out)
        pairs = pairs.join(out, [*PAGE, "b"], "left_anti").join(out.withColumnRenamed("b", "a"), [*PAGE, "a"], "left_anti")
        pairs = kept(pairs, "covers")
    out = elements.select(*PAGE, "element_id")
    return out.join(reduce(DataFrame.union, gone).withColumnRenamed("b", "element_id"), [*PAGE, "element_id"], "left_anti") if gone else out


def topological_order(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """Kahn's order of each page's elements: sources by id, then first come first served; elements on cycles follow by (y, x)."""
    out = edges.select(*PAGE, F.col("source_element_id").alias("element_id"), F.col("target_element_id").alias("to"))
    out = out.groupBy(*PAGE, "element_id").agg(F.sort_array(F.collect_list("to")).alias("to"))
    given = elements.select(*PAGE, "element_id", "x", "y", "ord").join(out, [*PAGE, "element_id"], "left")

    def walk(page: pd.DataFrame) -> pd.DataFrame:
        page = bounded(page).sort_values(["y", "x", "ord"])
        follow = {r.element_id: [t for t in r.to] if r.to is not None else [] for r in page.itertuples()}
        degree = dict.fromkeys(follow, 0)
        for targets in follow.values():
            for t in targets:
                if t in degree:
                    degree[t] += 1
        queue, done = deque(sorted(n for n, d in degree.items() if d == 0)), []
        while queue:
            done.append(queue.popleft())
            for t in follow[done[-1]]:
                if t in degree:
                    degree[t] -= 1
                    if degree[t] == 0:
                        queue.append(t)
        seen = set(done)
        done += [n for n in page["element_id"] if n not in seen]
        first = page.iloc[0]
        return pd.DataFrame({PAGE[0]: first[PAGE[0]], PAGE[1]: first[PAGE[1]], "element_id": done, "position": range(1, len(done) + 1)})

    return given.groupBy(*PAGE).applyInPandas(walk, _schema(elements, ", position long"))
