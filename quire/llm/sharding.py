"""Sharding by a k-d tree over document metadata.

Documents are points in (n_chars, source, lang, doc_id), each scaled to 31 bits.  A node of k shards is split along
its widest dimension at the weighted quantile that gives its left child floor(k / 2) / k of the bytes, until every
leaf is one shard of total / shards bytes.  The quantiles of a level are found by histograms of 65,536 bins in all
that zoom in on the bins of the quantiles, so the driver sees counts of a fixed size and never rows.  31 bits of a text hash
below each coordinate break ties, so a coordinate that a third of all rows share is still split where it must be.

Equal texts take the coordinates of their smallest row and move together.  A group of copies that weighs so much that a cut
beside it would unbalance the shards goes left or right as a whole, and the cut of all other rows is moved by
what that leaves too much or too little; so groups of up to ``group_share`` of a shard stay whole and the shards near equal.
A group that is larger is dealt out in salted parts of that size, since with it no shard could hold anything else.

The law is ``bytes``: sizes near equal.

Defined results: a null text has no bytes; null metadata counts as 0 or the empty string; repeated rows are placed
each; with fewer rows than shards some shards are empty; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import save, skew_join

BINS = 1 << 16
DIMS = ("n_chars", "source", "lang", "doc_id")
#: A group of copies is heavy when it weighs more than this part of a shard.
HEAVY = 0.002


def _coordinate(kinds: dict, name: str, bounds: dict) -> Column:
    if name not in kinds:
        return F.lit(0).cast("long")
    if kinds[name] == "string":
        return F.shiftright(F.crc32(F.coalesce(F.col(name), F.lit("")).cast("binary")), 1).cast("long")
    lo, hi = bounds[name]
    return F.floor((F.coalesce(F.col(name).cast("double"), F.lit(float(lo))) - lo) * (((1 << 31) - 1) / max(hi - lo, 1))).cast("long")


def kd_shards(docs: DataFrame, shards: int = 24, group_share: float = 0.5) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot (gapless in its shard), grown_shard (null)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = {d: dict(docs.dtypes)[d] for d in DIMS if d in docs.columns}
    numbers = [d for d, t in kinds.items() if t != "string"]
    size, crc = F.octet_length(text).cast("long") + 8, F.crc32(text.cast("binary"))
    slim = docs.select(*kinds, size.alias("size"), crc.alias("crc"), F.struct(F.xxhash64(text).alias("h"), crc.alias("crc"), size.alias("size")).alias("g"))
    slim = save(slim.withColumn("uid", F.monotonically_increasing_id()), "slim")
    total = slim.agg(F.count("*").alias("n"), F.sum("size").alias("b"), *(f(F.col(d).cast("double")).alias(f"{d}_{t}") for d in numbers for t, f in (("lo", F.min), ("hi", F.max)))).first()
    bounds = {d: (total[f"{d}_lo"] or 0.0, total[f"{d}_hi"] or 0.0) for d in numbers}
    shard = (total["b"] or 0) / shards
    at = F.struct(*(_coordinate(kinds, d, bounds).alias(f"c{i}") for i, d in reversed(list(enumerate(DIMS)))))
    # the smallest row of a group is found in each task first, so a group of a third of all rows is a few rows
    groups = slim.groupBy("g").agg(F.min(at).alias("at"), F.count("*").alias("c"))
    weight = F.col("c") * F.col("g.size")
    groups = groups.withColumn("parts", F.ceil(weight / max(1.0, shard * group_share))).withColumn("heavy", (F.col("c") > 1) & (weight / F.col("parts") > HEAVY * shard))
    rows = skew_join(slim.select("doc_id", "size", "crc", "g", "uid"), save(groups, "groups"), "g")
    salt = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("uid"), F.col("parts"))).otherwise(0)
    tie = F.shiftrightunsigned(F.xxhash64("g.h", salt), 33)
    # parts of one group are apart in every dimension, else a cut beside one of them would move all
    far = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("g.h", salt, F.lit(3)), F.lit(1 << 31)))
    place = lambda i: F.coalesce(far, F.col(f"at.c{i}"))
    keyed = save(rows.select("doc_id", "size", "crc", "uid", "heavy", *((place(i) * F.lit(1 << 31) + tie).alias(f"k{i}") for i in range(len(DIMS)))), "points")
    placed = keyed.withColumn("shard", _grow(keyed, shards))
    # slots: a row number in buckets of bounded size, and the buckets' offsets in their shard
    buckets = 1 + (total["n"] or 0) // (50_000 * shards)
    placed = placed.withColumn("b", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    count = placed.groupBy("shard", "b").agg(F.count("*").alias("c")).withColumn("base", F.expr("sum(c) over (partition by shard order by b) - c"))
    numbered = placed.withColumn("r", F.expr("row_number() over (partition by shard, b order by doc_id, uid) - 1"))
    return numbered.join(count.drop("c"), ["shard", "b"]).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("r") + F.col("base")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


class Node:
    """Shards first to first + count - 1, with weight, weight of rows in no heavy group, and a box of all its points; after a split the dimension, the cuts
    of heavy groups and of the other rows, and two children."""

    def __init__(self, first: int, count: int, weight: int, light: int, box: list[tuple[int, int]]):
        self.first, self.count, self.weight, self.light, self.box = first, count, weight, light, box
        self.dim = max(range(len(box)), key=lambda i: (box[i][1] - box[i][0], -i)) if box else 0
        self.cut, self.fine, self.kids = 0, 0, ()

    def split(self, cut: tuple[int, int], fine: tuple[int, int], heavy_left: int) -> None:
        """Cuts, each with the weight of the rows below it; without heavy groups both are one."""
        self.cut, self.fine = cut[0], fine[0]
        left, light = (heavy_left + fine[1], fine[1]) if self.cut != self.fine or heavy_left else (cut[1], cut[1])
        lo, hi = self.box[self.dim]
        boxes = [list(self.box), list(self.box)]
        boxes[0][self.dim], boxes[1][self.dim] = (lo, max(lo, max(self.cut, self.fine) - 1)), (min(hi, min(self.cut, self.fine)), hi)
        k = self.count // 2
        self.kids = (Node(self.first, k, left, light, boxes[0]), Node(self.first + k, self.count - k, self.weight - left, self.light - light, boxes[1]))

    def sql(self) -> str:
        if not self.kids:
            return str(self.first)
        cut = f"{self.cut}L" if self.cut == self.fine else f"if(heavy, {self.cut}L, {self.fine}L)"
        return f"if(k{self.dim} < {cut}, {self.kids[0].sql()}, {self.kids[1].sql()})"


def _case(values: dict) -> str:
    return "case node " + " ".join(f"when {n} then {v}" for n, v in values.items()) + " end"


def _grow(keyed: DataFrame, shards: int) -> Column:
    ends = [f(f"k{i}").alias(f"{t}{i}") for i in range(len(DIMS)) for t, f in (("lo", F.min), ("hi", F.max))]
    r = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("w"), F.coalesce(F.sum(F.when(~F.col("heavy"), F.col("size"))), F.lit(0)).alias("light"), *ends).first()
    root = Node(0, shards, r["w"], r["light"], [(r[f"lo{i}"] or 0, r[f"hi{i}"] or 0) for i in range(len(DIMS))])
    heavy, level = r["light"] < r["w"], [root] if shards > 1 else []
    while level:
        rows = keyed.withColumn("node", F.expr(root.sql())).where(F.col("node").isin([n.first for n in level]))
        given = rows.select("node", "size", "heavy", F.expr(_case({n.first: f"k{n.dim}" for n in level})).alias("k"))
        range_ = {n.first: (n.box[n.dim][0], n.box[n.dim][1] + 1) for n in level}
        want = {n.first: n.weight * (n.count // 2) / n.count for n in level}
        cuts = fine = _quantiles(given, range_, want)
        taken: dict[int, int] = {}
        if heavy:
            left = given.where(F.col("heavy") & (F.col("k") < F.expr(_case({n: f"{c[0]}L" for n, c in cuts.items()})))).groupBy("node").agg(F.sum("size").alias("w"))
            taken = {r["node"]: r["w"] for r in left.collect()}  # at most a row a node
            fine = _quantiles(given.where("not heavy"), range_, {n.first: min(max(want[n.first] - taken.get(n.first, 0), 0), n.light) for n in level})
        below = []
        for n in level:
            n.split(cuts[n.first], fine[n.first], taken.get(n.first, 0))
            below += [k for k in n.kids if k.count > 1]
        level = below
    return F.expr(root.sql())


def _quantiles(rows: DataFrame, range_: dict, want: dict) -> dict:
    """By node the key from which on rows go right, so that ``want`` bytes go left, and what goes left; rows: (node, k, size)."""
    open_ = {n: {"lo": lo, "hi": hi, "before": 0, "want": want[n]} for n, (lo, hi) in range_.items()}
    out = {}
    while open_:
        each = BINS // len(open_)
        for o in open_.values():
            o["shift"] = max(0, math.ceil(math.log2(max(1, (o["hi"] - o["lo"]) / each))))
        pick = lambda name: F.expr(_case({n: f"{o[name]}L" for n, o in open_.items()}))
        zoom = rows.select("node", "size", "k", pick("lo").alias("lo"), pick("hi").alias("hi"), pick("shift").cast("int").alias("shift"))
        hist = zoom.where("k >= lo and k < hi").groupBy("node", F.expr("shiftright(k - lo, shift)").alias("bin")).agg(F.sum("size").alias("w")).toArrow()
        bins: dict[int, list] = {}
        for n, b, w in zip(*(hist[c].to_pylist() for c in ("node", "bin", "w")), strict=True):  # at most BINS rows and one a node
            bins.setdefault(n, []).append((b, w))
        for n, o in list(open_.items()):
            at = o["before"]
            for b, w in sorted(bins.get(n, [])):
                if at + w >= o["want"]:
                    break
                at += w
            else:
                b, w = ((o["hi"] - o["lo"]) >> o["shift"]) + 1, 0
            start = o["lo"] + (b << o["shift"])
            if o["shift"] == 0 or w <= 1e-4 * o["want"]:
                out[n] = (start, at) if o["want"] - at < at + w - o["want"] else (start + (1 << o["shift"]), at + w)
                del open_[n]
            else:
                o |= {"lo": start, "hi": start + (1 << o["shift"]), "before": at}
    return out
