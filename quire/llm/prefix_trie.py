"""The prefix trie of rebuilt conversations, family first.

A conversation is rebuilt from the head of its family's base conversation and its own further turns.  Conversations are
cogrouped by base id, rebuilt, and each family's turns become its own small trie: one row per distinct prefix in the family, with the
family's conversations that pass it.  Only these combined rows are shuffled again, by prefix, and merged to the nodes of the whole trie.

A prefix is named by its depth and two 64-bit sums (xor) of hashes of (place, turn), so it needs no chain of jobs, and a long
conversation can be cut: turns are dealt in ranges of (base, conversation, turn), a range knows from the counts and sums of
those before where its part of a conversation starts, and no task ever holds more than a range of a conversation.  The first
turns, that a family shares, stay together as block 0; a later block is a part of a conversation in one range.

Sums over subtrees need no walk from depth to depth either: every node belongs to its smallest conversation, the nodes of one
conversation are the end of its path, and what the node at depth d gives to its ancestors is added up along that path by a
running sum from the end; the sums of all conversations that pass a node are then added by node.

Defined results: rows without a conversation id belong to no conversation; a null turn comes first; rows of one turn are
ordered by the MD5 of role and text; repeated rows are turns of their own; a null role or text is empty; other columns play no
part; an empty table has no root and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import drop, save, skew_join

#: Turns of a range, about; a conversation longer than that is worked on in several tasks.
RANGE = 1_000_000
#: Conversation ids of a node that travel together on their way to the hash of all of them.
IDS = 8
_KEY = ["p", "y1", "y2"]


def _dealt(conversations: DataFrame, family: int, keep: tuple[str, ...]) -> DataFrame:
    """Every turn with its mark, in ranges of (base, conv_id, turn, mark): ``rid``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body = F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    c = F.col("conv_id").cast("long")
    given = conversations.where(c.isNotNull()).select(
        c.alias("conv_id"), (c - c % family).alias("base"), "turn", F.unhex(F.md5(body.cast("binary"))).alias("mark"), F.octet_length(text("text")).cast("long").alias("size"),
        *(text(k).alias(k) for k in keep),
    )
    given = save(given, "turns")
    n = max(int(given.sparkSession.conf.get("spark.sql.shuffle.partitions")), given.count() // RANGE + 1)
    ranges = given.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(n, "base", "conv_id", "turn", "mark", "salt")
    out = save(ranges.drop("salt").withColumn("rid", F.spark_partition_id()), "dealt")
    drop(given)
    return out


def rebuilt_turns(conversations: DataFrame, family: int = 5, head: int = 9, texts: bool = False) -> DataFrame:
    """(base, conv_id, blk, p, length, mark, size): turn p of every rebuilt conversation, with a row p = 0 before its first; with ``texts`` also
    role and text.

    Conversation c takes the first crc32(c) % ``head`` turns of conversation c - c % ``family``, then its own after as many."""
    keep = ("role", "text") if texts else ()
    dealt = _dealt(conversations, family, keep)
    cells = dealt.groupBy("base", "conv_id", "rid").agg(F.count("*").alias("n"))
    conv, kin = Window.partitionBy("base", "conv_id"), Window.partitionBy("base")
    before = F.coalesce(F.sum("n").over(conv.orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.col("conv_id") == F.col("base")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % head
    cells = cells.withColumns({"before": before, "total": F.sum("n").over(conv)})
    cells = cells.withColumn("base_len", F.coalesce(F.max(F.when(own, F.col("total"))).over(kin), F.lit(0)))
    cells = cells.withColumns({"skip": F.when(own, 0).otherwise(h), "copied": F.when(own, 0).otherwise(F.least(h, "base_len"))})
    cells = cells.withColumn("length", F.expr("copied + greatest(total - skip, 0)"))
    # of a family there are at most 2 * family - 1 ids
    members = F.collect_list(F.when((F.col("before") == 0) & ~own, F.struct("conv_id", "copied", "length"))).over(kin)
    cells = save(cells.withColumn("members", members), "cells")

    # the row of a cell stands before its turns and brings the count of those in earlier ranges
    first = cells.select("base", "conv_id", "rid", F.lit(0).alias("own"), F.col("before").alias("k"), "skip", "copied", "length", F.when(own, F.col("members")).alias("members"))
    rows = dealt.withColumns({"own": F.lit(1), "k": F.lit(1).cast("long")}).unionByName(first, allowMissingColumns=True)
    w = Window.partitionBy("base", "rid", "conv_id").orderBy("own", F.asc_nulls_first("turn"), "mark").rowsBetween(Window.unboundedPreceding, 0)
    told = {c: F.first(c).over(w) for c in ("skip", "copied", "length", "members")}
    rows = rows.repartition("base", "rid").withColumns({"pos": F.sum("k").over(w), **told}).where("own = 1")
    mine = F.expr("array(if(pos > skip, struct(conv_id, pos - skip + copied as p, length), null))")
    heads = F.expr(f"if(members is null or pos >= {head}, array(), transform(filter(members, m -> pos <= m.copied), m -> struct(m.conv_id as conv_id, pos as p, m.length as length)))")
    rows = rows.select("base", "rid", "mark", "size", *keep, F.explode(F.concat(mine, heads)).alias("x")).where("x is not null")
    rows = rows.select("base", "x.conv_id", F.expr(f"if(x.p < {head}, 0, rid + 1)").alias("blk"), "x.p", "x.length", "mark", "size", *keep)
    top = cells.where("before = 0").select("base", "conv_id", F.lit(0).alias("blk"), F.lit(0).cast("long").alias("p"), "length", F.lit(0).cast("long").alias("size"))
    return rows.unionByName(top, allowMissingColumns=True)


def _family_tries(turns: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per distinct prefix of a family's block, with the conversations that pass it and those that end there."""
    along = Window.partitionBy("base", "conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    so_far = parts.withColumns({"x1": F.bit_xor("x1").over(along), "x2": F.bit_xor("x2").over(along)}).where("x1 is not null")
    rows = turns.unionByName(so_far.withColumn("p", F.lit(-1).cast("long")), allowMissingColumns=True).repartition("base", "blk")
    w = Window.partitionBy("base", "blk", "conv_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"y1": F.bit_xor("x1").over(w), "y2": F.bit_xor("x2").over(w)}).where("p >= 0")
    return rows.groupBy("base", "blk", *_KEY).agg(
        F.first("x1").alias("x1"), F.first("x2").alias("x2"), F.first("size").alias("size"), F.sort_array(F.collect_list("conv_id")).alias("convs"),
        F.collect_list(F.expr("if(p = length, conv_id, null)")).alias("ends"),
    )


def _id_hashes(tries: DataFrame) -> DataFrame:
    """By node the SHA-256 of the ids that end there, in order.  Ids travel in joined runs and are hashed as they stream by, so that
    a node of any number of ids takes no memory."""
    ids = tries.select(*_KEY, F.explode("ends").alias("c"))
    runs = ids.groupBy(*_KEY, F.expr(f"shiftright(c, {IDS})").alias("run")).agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("ids"))
    runs = runs.repartition(*_KEY).sortWithinPartitions(*_KEY, "run").select(*_KEY, "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            out = []
            for *key, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if key != now:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield _rows(out)
        if now:
            yield _rows([(*now, state.hexdigest())])

    return runs.mapInArrow(digest, "p long, y1 long, y2 long, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [*_KEY, "ends_sha256"])


def prefix_trie(conversations: DataFrame, family: int = 5, head: int = 9) -> DataFrame:
    """One row per node: conv_id (its smallest conversation), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and ``length``, the UTF-8 bytes of its last text.  Turn ``depth`` of ``rebuilt_turns`` of ``conv_id`` is its turn."""
    turns = rebuilt_turns(conversations, family, head)
    hashed = lambda seed: F.when(F.col("p") == 0, 0).otherwise(F.xxhash64(F.lit(seed), "p", "mark")).cast("long")
    turns = save(turns.withColumns({"x1": hashed(1), "x2": hashed(2)}).drop("mark"), "rebuilt")
    parts = save(turns.groupBy("base", "conv_id", "blk").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")), "parts")
    tries = save(_family_tries(turns, parts), "tries")
    drop(turns)

    nodes = tries.groupBy(*_KEY).agg(F.min(F.struct(F.element_at("convs", 1).alias("conv_id"), "base", "blk")).alias("at"), F.sum(F.size("convs").cast("long")).alias("n_convs"), *(F.first(c).alias(c) for c in ("x1", "x2", "size")))
    nodes = save(nodes.select(*_KEY, "at.*", "n_convs", "x1", "x2", "size"), "nodes")
    kids = nodes.where("p > 0").groupBy(F.expr("p - 1").alias("p"), F.expr("y1 ^ x1").alias("y1"), F.expr("y2 ^ x2").alias("y2")).agg(F.count("*").alias("n_children"))
    known = save(nodes.join(kids, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    drop(nodes)

    sums = _subtree_sums(tries, parts, known)
    # the first node of each conversation's own hangs on a node of another one; the rest on the node before
    tops = known.groupBy("conv_id").agg(F.min(F.struct(*_KEY, "x1", "x2")).alias("t")).select("t.*")
    tops = save(tops.select(*_KEY, F.expr("struct(p - 1 as p, y1 ^ x1 as y1, y2 ^ x2 as y2)").alias("up")), "tops")
    over = save(known.where("n_children > 0").select(F.struct(*_KEY).alias("up"), F.col("conv_id").alias("parent"), F.col("n_children").alias("c")), "parents")
    found = skew_join(tops.where("p > 0"), over, "up").select(*_KEY, "parent", F.lit(True).alias("is_top"))
    found = found.union(tops.where("p = 0").select(*_KEY, F.lit(None).cast("long"), F.lit(True)))

    out = known.join(sums, _KEY, "left").join(found, _KEY, "left").join(_id_hashes(tries), _KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", F.col("p").alias("depth"), F.when(F.col("is_top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), F.col("size").alias("length"),
    )


def _subtree_sums(tries: DataFrame, parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """By node the childless nodes of its subtree and the sum of (n_convs - 1) * size over it."""
    own = nodes.select("base", "blk", "conv_id", "p", F.expr("(n_convs - 1) * size").alias("f"), F.expr("if(n_children = 0, 1L, 0L)").alias("g"))
    by_part = own.groupBy("base", "blk", "conv_id").agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
    back = Window.partitionBy("base", "conv_id").orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    later = parts.select("base", "blk", "conv_id").join(by_part, ["base", "blk", "conv_id"], "left")
    later = later.withColumns({"f": F.sum("f").over(back), "g": F.sum("g").over(back)}).where("f > 0 or g > 0")
    later = later.select("base", "blk", "conv_id", F.lit(2**62).alias("p"), "f", "g")
    path = tries.select("base", "blk", F.explode("convs").alias("conv_id"), *_KEY, F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("g"), F.lit(True).alias("path"))
    rows = path.unionByName(own, allowMissingColumns=True).unionByName(later, allowMissingColumns=True).repartition("base", "blk")
    w = Window.partitionBy("base", "blk", "conv_id").orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"f": F.sum("f").over(w), "g": F.sum("g").over(w)}).where("path and (f > 0 or g > 0)")
    mine = rows.groupBy("base", "blk", *_KEY).agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
    return mine.groupBy(*_KEY).agg(F.sum("f").alias("saved_tokens"), F.sum("g").alias("n_leaves"))
