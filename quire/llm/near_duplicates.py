"""N-gram Jaccard join: a grouped prefix join over word shingles.

Texts with the same shingle set are one class.  Shingles have one global order: those of the fewest
documents first.  Two sets of at least the asked similarity share a shingle among the first
``n - ceil(t n) + 1`` of either (its prefix).  Classes with the same prefix and size form one group; groups meet
in the buckets of their prefix shingles; group pairs are filtered by size, by the shingle's place in either set (behind the first
one that they share there must be enough of both) and by 512 parities of the sets, then expanded to their members, filtered by
as many parities as a set has shingles, and the members' whole sets are compared.  The filters lose nothing, whatever the order of the shingles is; the order only decides the cost.

``similar_pairs`` returns every link.  ``near_duplicates`` asks only for components, and a family of n near copies need not
meet in n^2 / 2 pairs for that.  Its rounds are those of a minimum spanning forest: every bucket has a leader, every
group that is not in its leader's component yet is compared with one leader (that of the nearest parities), and what
is linked becomes one component.  A round compares at most one pair a group, buckets of one component leave, and the
rounds end with the first one that links fewer than one in ``QUIET`` of the groups.  All group pairs of unlike components that still share a bucket are then
joined, filtered and compared, so no link between different components is missed, whatever the rounds found.

What travels for a comparison is the text, once for each pair's one side and once for every ``HUB`` pairs of the other.

Defined results: a text without words has an empty set and is linked with nothing (its component is its own id);
rows with the same text are in one component, also where ids repeat; null ids do not count as the smallest id
unless all are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.shared import drop, save, skew_join, text_key
from quire.llm.textkernel import U, Words, blocks, lists, mix, shingle_sets

#: A shingle is common when it is repeated within partitions in at least so many documents, however many there are: else buckets would grow with the
#: corpus.  The commonest are told to all tasks, at most ``COMMON_MOST`` (16 bytes each).  They only order prefixes.
COMMON_LEAST, COMMON_MOST = 8, 500_000
_BLOOM_BITS = 26
#: Comparisons with one text in one task, and pairs of which the keys (at most 100 bytes a pair) are told to all tasks, so that no other texts travel.
HUB, FEW = 512, 50_000
#: A round that links fewer than one in so many of its groups is the last.
QUIET = 50


def _text(docs: DataFrame):
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))


def _common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles with their counts.  Each task counts its own documents and passes on what it saw twice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            kinds, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(kinds[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["s", "c"])

        for b in batches:
            for block in blocks(b.column(0)):
                sets = shingle_sets(Words(block), shingle)
                held += sets
                size += sum(map(len, sets))
                if size > 2_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    found = _text(docs).mapInArrow(count, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON_LEAST)
    found = found.orderBy(F.desc("c"), "s").limit(COMMON_MOST).toArrow()
    kinds = found["s"].to_numpy().view(np.uint64)
    order = np.argsort(kinds)
    return kinds[order], found["c"].to_numpy()[order].astype(np.int64)


def set_id(s: np.ndarray) -> int:
    """64 bits of a whole set."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = mix(s * U(0x9E3779B97F4A7C15) + U(len(s)))
        return int(mix(np.array([x.sum() ^ (mix(s).sum() << U(1))], U))[0].view(np.int64))


def parity(s: np.ndarray) -> np.ndarray:
    """512 parities of a set: two sets differ in at least as many elements as their parities do in bits."""
    bits = np.bincount((s >> U(55)).astype(np.int64), minlength=512).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def wide_parity(s: np.ndarray) -> bytes | None:
    """At least as many parities as a set of more than 512 has elements, a power of two of them."""
    if len(s) <= 512:
        return None
    m = (len(s) - 1).bit_length()
    return np.packbits(np.bincount((s >> U(64 - m)).astype(np.int64), minlength=1 << m).astype(np.uint8) & 1).tobytes()


def wide_apart(a: bytes, b: bytes) -> int:
    """In how many bits two wide parities differ; the longer one is folded to the other's length."""
    x, y = (np.unpackbits(np.frombuffer(p, np.uint8)) for p in (a, b))
    while len(x) != len(y):
        x, y = (y, x) if len(x) < len(y) else (x, y)
        x = x[::2] ^ x[1::2]
    return int((x != y).sum())


def _apart(a: str, b: str) -> str:
    return " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(8))


def _close(a: str, b: str, n1: str, n2: str, num: int, den: int):
    """False only for pairs whose parities differ in more bits than similar sets differ in elements; null parities pass."""
    return F.expr(f"coalesce({_apart(a, b)} <= {n1} + {n2} - 2 * {_enough(n1, n2, num, den)}, true)")


def _enough(n1: str, n2: str, num: int, den: int) -> str:
    """The least intersection of similar sets."""
    return f"(({num}L * ({n1} + {n2}) + {num + den - 1}) div {num + den})"


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _prefixes(docs: DataFrame, shingle: int, num: int, den: int, common) -> DataFrame:
    """By document: set size, class, group, and (for the first of a group in its task) the prefix, in the order of the shingles."""
    sent = docs.sparkSession.sparkContext.broadcast(common)
    given = docs.select(F.col("doc_id").cast("long"), text_key().alias("tkey"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, counts = sent.value
        done: set[int] = set()
        for b in batches:
            n, cls, grp, pre, par, wide = [], [], [], [], [], []
            for block in blocks(b.column(2)):
                for s in shingle_sets(Words(block), shingle):
                    k = len(s)
                    n.append(k)
                    cls.append(set_id(s))
                    par.append(parity(s))
                    wide.append(wide_parity(s))
                    if not k:
                        grp.append(0)
                        pre.append(None)
                        continue
                    p = prefix_size(k, num, den)
                    if len(kinds):
                        at = np.minimum(np.searchsorted(kinds, s), len(kinds) - 1)
                        often = np.where(kinds[at] == s, counts[at], 0)
                        s = s[np.lexsort((s, often))] if often.any() else s
                    s = s[:p]
                    g = set_id(np.append(s, U(k)))
                    grp.append(g)
                    pre.append(None if g in done else s.tobytes())
                    done.add(g)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(cls, pa.int64()), pa.array(grp, pa.int64()), pa.array(pre, pa.binary()), lists(par, pa.int64()), pa.array(wide, pa.binary())],
                ["doc_id", "tkey", "n", "cls", "grp", "prefix", "parity", "wide"],
            )

    return save(given.mapInArrow(build, "doc_id long, tkey long, n int, cls long, grp long, prefix binary, parity array<long>, wide binary"), "prefix")


def _exploded(pref: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.slice(i, 2000)
                sizes = np.array([len(x) // 8 for x in part.column(2).to_pylist()], np.int64)
                flat = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int64)
                place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(flat), *(pa.array(np.repeat(np.asarray(part.column(k)), sizes)) for k in (0, 1)), pa.array(place.astype(np.int32))], ["s", "grp", "n", "place"])

    return pref.where("prefix is not null").select("grp", "n", "prefix").mapInArrow(rows, "s long, grp long, n int, place int")


def _size_fits(a: str, b: str, num: int, den: int):
    return F.expr(f"{den}L * least({a}, {b}) >= {num}L * greatest({a}, {b})")


class _Texts:
    """Texts of the classes that can meet another one, and the exact comparison of their sets."""

    def __init__(self, docs: DataFrame, wanted: DataFrame, shingle: int, num: int, den: int):
        """``wanted``: (cls, tkey), one row a class."""
        self.shingle, self.num, self.den = shingle, num, den
        bloom = docs.sparkSession.sparkContext.broadcast(_bloom(wanted))
        given = docs.select(text_key().alias("tkey"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))

        def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = (np.asarray(b.column(0)).view(np.uint64) >> U(64 - _BLOOM_BITS)).astype(np.int64)
                yield b.filter(pa.array(((bloom.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)))

        once = given.mapInArrow(may, "tkey long, t string").groupBy("tkey").agg(F.first("t").alias("t"))
        self.rows = save(once.join(wanted, "tkey").select("cls", "t"), "texts")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that are similar enough, each given pair once; best where few ``a`` have many ``b``."""
        num, den, shingle = self.num, self.den, self.shingle
        of = pairs.groupBy("a").agg(F.count("*").alias("k")).select("a", F.expr(f"cast((k - 1) div {HUB} as int) + 1").alias("parts"))
        member = pairs.join(of, "a").select(F.col("b").alias("cls"), "a", F.expr("pmod(xxhash64(b), parts)").cast("int").alias("part"), F.lit(1).alias("role"))
        hub = of.select(F.col("a").alias("cls"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
        side = member.union(hub)
        # the number of pairs is checked: beyond it the texts are joined by a shuffle
        few = pairs.count() <= FEW
        rows = self.rows.join(F.broadcast(side) if few else side, "cls").repartition("a", "part").sortWithinPartitions("a", "part", "role")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = np.zeros(0, U)
            for b in batches:
                role, keep = np.asarray(b.column("role")), np.zeros(len(b), bool)
                for block in blocks(b.column("t")):
                    for i, s in enumerate(shingle_sets(Words(block), shingle), block.first):
                        if role[i] == 0:
                            mine = s
                        else:
                            at = np.minimum(np.searchsorted(mine, s), len(mine) - 1)
                            same = int((mine[at] == s).sum())
                            keep[i] = den * same >= num * (len(mine) + len(s) - same)
                keep = pa.array(keep)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("cls").filter(keep)], ["a", "b"])

        return save(rows.select("a", "cls", "role", "t").mapInArrow(compare, "a long, b long"), "links")


def _bloom(wanted: DataFrame) -> np.ndarray:
    """A filter of 2**26 bits (8 MB, at any size of the corpus) over text keys: it spares the shuffle of texts that no
    pair can name; an exact join follows."""
    bit = wanted.select(F.shiftrightunsigned("tkey", 64 - _BLOOM_BITS).alias("bit"))
    byte = bit.selectExpr("shiftright(bit, 3) at", "shiftleft(1, cast(bit % 8 as int)) v")
    table = byte.groupBy("at").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(1 << (_BLOOM_BITS - 3), np.uint8)
    out[table["at"].to_numpy()] = table["v"].to_numpy().astype(np.uint8)
    return out


class _Join:
    """What both joins start with: classes in groups, groups in buckets, texts of those that can meet another, and the
    links inside groups."""

    def __init__(self, docs: DataFrame, shingle: int, num: int, den: int):
        self.num, self.den = num, den
        self.pref = pref = _prefixes(docs, shingle, num, den, _common_shingles(docs, shingle))
        # members of groups, one row a class (equal sets have equal prefixes) with the key of one of its texts; most groups have one
        self.member = save(pref.where("n > 0").groupBy("grp", "cls").agg(F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("wide").alias("wide"), F.min("tkey").alias("tkey")), "members")
        heads = self.member.groupBy("grp").agg(F.min("cls").alias("head"), F.count("*").alias("k"), F.first("n").alias("n"))
        # buckets with at least two groups, each group once
        rows = _exploded(pref)
        shared = rows.groupBy("s").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("s")
        shared = save(shared, "shared")
        self.bucket = save(rows.join(shared, "s").select("s", "grp", "n", "place").distinct(), "buckets")
        drop(shared)
        self.heads = save(heads.join(self.bucket.select("grp").distinct().withColumn("meets", F.lit(True)), "grp", "left"), "heads")
        wanted = self.member.join(self.heads.where("k > 1 or meets").select("grp"), "grp").select("cls", "tkey")
        self.texts = _Texts(docs, wanted, shingle, num, den)

    def inside(self) -> tuple[DataFrame, DataFrame]:
        """Links among the members of one group (all against its head, then those that are not linked to it against all), and
        the members that are not linked to their head."""
        many = self.member.join(self.heads.where("k > 1").select("grp", "head"), "grp")
        star = save(many.where("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b"), "grp", "n", "parity"), "inside")
        got = self.texts.links(star.select("a", "b"))
        far = save(star.join(got, ["a", "b"], "left_anti").select("grp", F.col("b").alias("cls"), "n", "parity"), "inside")
        side = far.select("grp", F.col("cls").alias("far"), F.col("parity").alias("p1"))
        rest = side.join(many.select("grp", "cls", "head", "n", F.col("parity").alias("p2")), "grp").where("far <> cls and cls <> head")
        rest = rest.where(_close("p1", "p2", "n", "n", self.num, self.den))
        rest = save(rest.select(F.least("far", "cls").alias("a"), F.greatest("far", "cls").alias("b")).distinct(), "inside")
        drop(star)
        return save(got.union(self.texts.links(rest)), "links"), far

    def units(self, far: DataFrame) -> DataFrame:
        """(grp, unit, n, parity): the classes that stand for a group, its head with what is linked to it and each of the others."""
        head = self.member.join(self.heads.select("grp", "head"), "grp").where("cls = head").select("grp", "cls", "n", "parity")
        return save(head.union(far).select("grp", F.col("cls").alias("unit"), "n", "parity"), "units")

    def met(self, bucket: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Unlike-labelled groups (g1, g2, n1, n2) that share a bucket, a row for every bucket of other groups that can be the first they share, and the table that they are
        made of.  ``bucket``: (s, grp, n, place, unit, label)."""
        num, den = self.num, self.den
        sign = self.member.groupBy("grp").agg(F.when(F.count("*") == 1, F.first("parity")).alias("parity"))  # of groups of one class
        rows = bucket.select("s", "grp", "n", "place", "label").join(sign, "grp")
        half = lambda seed: F.shiftrightunsigned(F.xxhash64("grp", "label", F.lit(seed)), 32)
        by = rows.groupBy("s", "label").agg(F.count("*").alias("c"), F.sum(half(1)).alias("h1"), F.sum(half(2)).alias("h2"), F.sum("place").alias("at"))
        # of each bucket's commonest label no row need meet another: only rows of the others look for partners
        top = by.groupBy("s").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels"), *(F.sum(c).alias(c) for c in ("c", "h1", "h2", "at"))).where("labels > 1")
        # of buckets of the same groups one is enough, the first in the order of the shingles, which is first in every group
        one = top.groupBy("c", "h1", "h2").agg(F.min(F.struct("at", "s", F.col("top.label").alias("top"))).alias("one")).select("one.s", "one.top")
        rows = save(rows.join(one, "s"), "rest")
        side = lambda k: [F.col(c).alias(a) for c, a in (("grp", f"g{k}"), ("n", f"n{k}"), ("label", f"l{k}"), ("place", f"at{k}"), ("parity", f"p{k}"))]
        met = rows.where("label <> top").select("s", *side(1)).join(rows.select("s", F.col("top").alias("top2"), *side(2)), "s")
        met = met.where(F.expr("l1 <> l2 and g1 <> g2")).where(F.expr("l2 = top2 or g1 < g2"))
        # what sets share lies, in either, at the first shared shingle or behind it
        enough = _enough("n1", "n2", num, den)
        met = met.where(_size_fits("n1", "n2", num, den)).where(F.expr(f"at1 <= n1 - {enough} and at2 <= n2 - {enough}")).where(_close("p1", "p2", "n1", "n2", num, den))
        return met.select(F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2"), F.expr("if(g1 < g2, n1, n2)").alias("n1"), F.expr("if(g1 < g2, n2, n1)").alias("n2")), rows

    def meet(self, bucket: DataFrame) -> DataFrame:
        """Links of all unlike-labelled members of groups that share a bucket.  ``bucket``: (s, grp, n, place, unit, label)."""
        num, den = self.num, self.den
        met, rows = self.met(bucket)
        m = self.member.select("grp", "cls", "parity", "wide")
        pairs = met.distinct().join(m.select(F.col("grp").alias("g1"), F.col("cls").alias("a"), F.col("parity").alias("p1"), F.col("wide").alias("w1")), "g1")
        pairs = pairs.join(m.select(F.col("grp").alias("g2"), F.col("cls").alias("b"), F.col("parity").alias("p2"), F.col("wide").alias("w2")), "g2").where(_close("p1", "p2", "n1", "n2", num, den))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                most, x, y = b.column("most").to_pylist(), b.column("w1"), b.column("w2")
                keep = [not (x[i].is_valid and y[i].is_valid) or wide_apart(x[i].as_py(), y[i].as_py()) <= most[i] for i in range(len(b))]
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w1", "w2", F.expr(f"cast(n1 + n2 - 2 * {_enough('n1', 'n2', num, den)} as long)").alias("most"))
        pairs = save(pairs.mapInArrow(near, "a long, b long").distinct(), "pairs")
        drop(rows)
        return self.texts.links(pairs)

    def drop(self) -> None:
        drop(self.member, self.bucket, self.heads, self.texts.rows)


def similar_pairs(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Every link: (a, b) of classes with a < b, and the classes' rows (doc_id, tkey, n_shingles, cls, n_links).

    The work is in proportion to the pairs that share a bucket and pass the filters, so to the links themselves in a family of
    near copies; ``near_duplicates`` does without."""
    join = _Join(docs, shingle, num, den)
    own, far = join.inside()
    bucket = join.bucket.withColumn("unit", F.col("grp")).withColumn("label", F.col("grp"))
    # links inside a group of members that are linked to its head are still missing
    near = join.member.join(join.heads.where("k > 1").select("grp", "head"), "grp").where("cls <> head").join(far.select("cls"), "cls", "left_anti")
    two = near.select("grp", F.col("cls").alias("a"), "n", F.col("parity").alias("p1")).join(near.select("grp", F.col("cls").alias("b"), F.col("parity").alias("p2")), "grp")
    two = two.where("a < b").where(_close("p1", "p2", "n", "n", num, den)).select("a", "b")
    edges = own.union(join.meet(bucket)).union(join.texts.links(save(two, "pairs")))
    edges = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    degree = edges.select(F.col("a").alias("cls")).union(edges.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("n_links"))
    rows = join.pref.select("doc_id", "tkey", F.col("n").cast("long").alias("n_shingles"), "cls")
    return edges, rows.join(degree, "cls", "left").select("doc_id", "tkey", "n_shingles", "cls", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, tkey, n_shingles, component_id, keep): one row per row of ``docs``.

    Two texts are linked when their shingle sets have ``den`` * intersection >= ``num`` * union; a component is what links
    reach.  ``keep`` marks the rows of each component's smallest id and text.
    """
    join = _Join(docs, shingle, num, den)
    own, far = join.inside()
    links = [own]
    units = join.units(far)
    bucket = save(join.bucket.select("s", "grp", "place").join(units.drop("parity"), "grp").withColumn("label", F.col("unit")), "round")
    n = new = bucket.agg(F.countDistinct("unit")).first()[0]
    r = 0
    while n and new * QUIET >= n:
        found = _round(join, bucket, units, r)
        links.append(found)
        new = found.count()
        label = components(found)
        after = bucket.join(label.select(F.col("node").alias("label"), "root"), "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
        # buckets of one component have nothing left to find
        open_ = after.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("s")
        after = save(after.join(open_, "s", "left_semi"), "round")
        drop(bucket)
        bucket, r = after, r + 1
        n = bucket.agg(F.countDistinct("unit")).first()[0]
    links.append(join.meet(bucket))
    drop(bucket, units)
    edges = links[0].select("a", "b")
    for x in links[1:]:
        edges = edges.union(x.select(*(("ua", "ub") if "ua" in x.columns else ("a", "b"))))
    root = save(components(edges), "root")
    join.drop()
    pref = join.pref
    # by class, then by component: every minimum is taken in each task before it travels
    row = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tkey")
    classes = pref.where("n > 0").groupBy("cls").agg(F.min(row).alias("own"), F.count("*").alias("size"))
    named = classes.join(root.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = save(named, "roots")
    best = save(named.groupBy("root").agg(F.min("own").alias("best"), F.count("*").alias("c")), "best")
    of = save(skew_join(named.select("cls", "root", "size"), best, "root").select("cls", "best", F.col("size").alias("c")), "components")
    drop(named, best)
    out = skew_join(pref.where("n > 0").select("doc_id", "tkey", "n", "cls"), of, "cls")
    keep = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tkey") == F.col("best.tkey"))
    out = out.select("doc_id", "tkey", F.col("n").cast("long").alias("n_shingles"), F.col("best.doc_id").alias("component_id"), keep.alias("keep"))
    empty = pref.where("n = 0").select("doc_id", "tkey", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("keep"))
    return out.union(empty)


def _round(join: _Join, bucket: DataFrame, units: DataFrame, r: int) -> DataFrame:
    """Compares every unit with one leader of another label, and returns the links: labels (a, b) and classes (ua, ub)."""
    first = F.struct(F.xxhash64("unit", F.lit(r)).alias("h"), "unit", "n", "label")
    lead = save(bucket.groupBy("s").agg(F.min(first).alias("lead"), F.count("*").alias("c")), "lead")
    met = skew_join(bucket, lead, "s").where(F.expr("label <> lead.label")).where(_size_fits("n", "lead.n", join.num, join.den))
    met = met.select("unit", "label", F.col("lead.unit").alias("lu"), F.col("lead.label").alias("ll"))
    # of the leaders of a unit's buckets that with the nearest parities
    met = met.groupBy("unit", "label", "lu", "ll").agg(F.count("*").alias("c"))
    sign = units.select("unit", F.col("n").alias("n1"), F.col("parity").alias("p1"))
    met = met.join(sign, "unit").join(sign.select(F.col("unit").alias("lu"), F.col("n1").alias("n2"), F.col("p1").alias("p2")), "lu")
    met = met.where(_close("p1", "p2", "n1", "n2", join.num, join.den)).withColumn("near", F.expr("-(" + _apart("p1", "p2") + ")"))
    pick = met.groupBy("unit", "label").agg(F.max(F.struct("near", "c", "lu", "ll")).alias("x"))
    pick = save(pick.select("unit", "label", "x.lu", "x.ll"), "pick")
    links = join.texts.links(pick.select(F.col("lu").alias("a"), F.col("unit").alias("b")))
    out = save(links.select(F.col("a").alias("ua"), F.col("b").alias("unit")).join(pick, "unit").select(F.col("ll").alias("a"), F.col("label").alias("b"), "ua", F.col("unit").alias("ub")), "found")
    drop(lead, pick, links)
    return out


def distinct_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id.  Rows without words all stay; of rows equal in id
    and text with words one stays.  Columns travel in one struct, whatever their names."""
    found = near_duplicates(docs, **how).where("keep").select(F.col("doc_id").alias("kept_id"), F.col("tkey").alias("kept_key")).distinct()
    words = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key().alias("tkey"), words.alias("words"))
    kept = rows.join(found, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("tkey") == F.col("kept_key")), "left_semi")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.withColumn("alone", F.when(~F.col("words"), F.monotonically_increasing_id())).dropDuplicates(["id", "tkey", "alone"])
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
