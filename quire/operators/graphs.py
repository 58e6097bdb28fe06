"""Forests and components of any depth, by jobs whose number grows with the logarithm of it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.tables import kept

#: Edges that a task holds at once when it joins those of a block.
BLOCK = 1 << 18


def climb(up: DataFrame, keys: list[str], hops: int = 2) -> DataFrame:
    """(keys, node, root, level) for every row (keys, node, parent) of ``up``, one row a node: the last node on the way up and the steps
    to it.  Every hop doubles the steps known, every job makes ``hops``.  Where the way up ends in a cycle, root and level are null."""
    tops = up.select(*keys, F.col("node").alias("parent"), F.lit(True).alias("goes_on"))
    now = up.join(tops, [*keys, "parent"], "left").select(*keys, "node", F.col("parent").alias("at"), F.lit(1).cast("long").alias("level"), F.coalesce("goes_on", F.lit(False)).alias("open"))
    now = kept(now, "climb")
    steps, nodes, left = 1, None, now.where("open").count()
    while left:
        nodes = nodes or now.count()
        if steps > nodes:
            break
        for _ in range(hops):
            further = now.select(*keys, F.col("node").alias("at"), F.col("at").alias("at2"), F.col("level").alias("level2"), F.col("open").alias("open2"))
            on = now.where("open").join(further, [*keys, "at"]).select(*keys, "node", F.col("at2").alias("at"), F.expr("level + level2").alias("level"), F.col("open2").alias("open"))
            now, steps = now.where("not open").unionByName(on), 2 * steps
        now = kept(now, "climb")
        left = now.where("open").count()
    return now.select(*keys, "node", F.expr("if(open, null, at)").alias("root"), F.expr("if(open, null, level)").alias("level"))


def _smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, of nodes 0 to n - 1 and edges (a, b): roots hook on smaller ones, and ways up are halved."""
    up = np.arange(n)
    while True:
        u, v = up[a], up[b]
        if (u == v).all():
            return up
        np.minimum.at(up, np.maximum(u, v), np.minimum(u, v))
        while (up != up[up]).any():
            up = up[up]


def _blocks(parts: Iterable[pd.DataFrame], keys: list[str], most: int) -> Iterator[pd.DataFrame]:
    """Rows in order of their keys, in blocks of about ``most`` at most that end where the keys change, if they do so within that."""
    held: list[pd.DataFrame] = []
    for part in parts:
        if not len(part):
            continue
        held.append(part)
        if sum(map(len, held)) >= most:
            rows = pd.concat(held, ignore_index=True)
            last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = len(rows) if last.all() else int(np.flatnonzero(~last)[-1]) + 1
            yield rows.iloc[:cut]
            held = [rows.iloc[cut:]] if cut < len(rows) else []
    if held:
        yield pd.concat(held, ignore_index=True)


def contracted(edges: DataFrame, keys: list[str], most: int = BLOCK) -> DataFrame:
    """(keys, node, root): for each block of edges (keys, a, b) with the same keys, its nodes with the smallest node that they reach within the block.
    A task holds one block; a node of several blocks has a row in each, its own root there."""

    def joined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _blocks(parts, keys, most):
            group = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            code, values = pd.factorize(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]), sort=True)
            pair, first, at = np.unique(np.concatenate([group, group]) * len(values) + code, return_index=True, return_inverse=True)
            n = len(rows)
            root = _smallest(at[:n], at[n:], len(pair))
            out = rows[keys].iloc[first % n].reset_index(drop=True)
            yield out.assign(node=values[pair % len(values)], root=values[pair[root] % len(values)])

    some = edges.select(*keys, "a", "b")
    kind = some.schema["a"].dataType.simpleString()
    schema = ", ".join(f"`{c}` {t}" for c, t in [*((k, some.schema[k].dataType.simpleString()) for k in keys), ("node", kind), ("root", kind)])
    return some.repartition(*keys).sortWithinPartitions(*keys, "a").mapInPandas(joined, schema)


def connected(edges: DataFrame, keys: list[str], most: int = BLOCK) -> DataFrame:
    """(keys, node, root) for every node of ``edges`` (keys, a, b): root is the smallest node of its component.

    Blocks of ``most`` edges are joined by themselves first.  Only where a node is in several of them, their roots are joined in rounds: every
    root hooks on its smallest smaller neighbour, the trees that this makes are climbed, and edges inside one tree go; what is left joins
    trees.  A round leaves at most half of the trees that have an edge."""
    parts = kept(contracted(edges, keys, most), "blocks")
    nodes = parts.groupBy(*keys, "node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots"))
    other = nodes.where("size(roots) > 1").select(*keys, F.col("root").alias("b"), F.explode("roots").alias("a")).where("a <> b")
    left, rounds = kept(other.select(*keys, "a", "b").distinct(), "edges"), []
    while not left.isEmpty():
        up = left.groupBy(*keys, F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        tree = climb(up, keys).select(*keys, "node", "root")
        rounds.append(tree)
        end = lambda c: tree.select(*keys, F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        both = left.join(end("a"), [*keys, "a"]).join(end("b"), [*keys, "b"], "left").withColumns({"u": F.col("a_root"), "v": F.coalesce("b_root", "b")}).where("u <> v")
        left = kept(both.select(*keys, F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges")
    if not rounds:
        return parts
    nodes = nodes.drop("roots")
    for tree in rounds:
        to = tree.select(*keys, F.col("node").alias("root"), F.col("root").alias("next"))
        nodes = nodes.join(to, [*keys, "root"], "left").select(*keys, "node", F.coalesce("next", "root").alias("root"))
    return nodes
