"""Personal data: generators of overlapping spans, boosted trees, calibrated thresholds; DataFrame functions only.

Base spans (kinds email, ip, card, phone) come from one pattern each with a check of their digits; they always stay.
Wider generators add candidates that the patterns miss or swallow: runs of digit groups inside a rejected card match
that pass Luhn by themselves, phone numbers without a plus, addresses written with "(at)" or "[.]".  Every base match,
accepted or rejected by its check, is a training row, but for rejected ones that hold such a run.  Its features are small integers for format and context; what the
check itself looks at (digits, Luhn) is not among them, so the trees learn how accepted matches are written
and what stands around them.  All rows of the corpus collapse to counts of at most ``FEATURE_VECTORS`` distinct vectors in
each of two folds of documents (by a hash of the text): boosting runs over three quarters of the documents, and each kind's threshold is the
lowest whose precision on the other quarter reaches ``precision``.  The trees become one SQL expression, so scoring stays in the JVM.

Of candidates that overlap, read from left to right, the likelier stays (the first of equals), and none stays that
overlaps a base span.

Defined results: a null text is empty and has no spans; repeated rows are treated alike; an empty table gives an empty
result and trains no trees (then no candidate passes); where the check accepted every training row of a kind there is
no evidence against its formats, and all its candidates pass; where it accepted none, or no held-out row is sure enough, none does; documents keep their other columns.

Patterns start only where a run of their first class starts or the last match ended, and repeat possessively: this
gives the same leftmost matches as the plain patterns in linear time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import save

#: Fixed values of the contract: kinds in order, with their patterns in linear form.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)[a-z0-9._%+-]++[\x20]?+(?:\(at\)|\[at\])[\x20]?+[a-z0-9-]++(?:(?:[\x20]?+(?:\(dot\)|\[dot\])[\x20]?+|\.)[a-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}",
    "phone": r"(?<![0-9+.-])\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}(?![0-9-])",
}
#: Something that a text with a match must contain; cheaper to look for.
NEEDS = {"email": "@", "phone": "+"}
LOOSE_NEEDS = {"email": r"(?i)[(\[]at[)\]]", "ip": r"\[\.\]", "phone": r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"}
CONTEXT = r"(?:tel|phone|call|fax|mobil|card|visa|pay|mail|contact|host|server|addr)[a-z]*[^a-z]*$"
#: Kind, separators, before, after, context, lead, with the number of their values.
FEATURES = {"kind": 4, "sep": 4, "before": 4, "after": 4, "context": 2, "lead": 4}
FEATURE_VECTORS = math.prod(FEATURES.values())


def _running(steps: str) -> str:
    """Running sums of an array, in blocks of 256 so that long arrays cost little more than their length."""
    block = f"transform(sequence(0, cast((size({steps}) - 1) div 256 as int)), b -> aggregate(slice({steps}, b * 256 + 1, 256), named_struct('s', 0, 'a', cast(array() as array<int>)), (z, x) -> named_struct('s', z.s + x, 'a', concat(z.a, array(z.s + x)))))"
    total = f"aggregate({block}, named_struct('s', 0, 'a', cast(array() as array<int>)), (z, x) -> named_struct('s', z.s + x.s, 'a', concat(z.a, transform(x.a, y -> y + z.s))))"
    return f"if(size({steps}) = 0, cast(array() as array<int>), {total}.a)"


def _luhn(digits: str) -> str:
    step = "cast(substring(lq, li, 1) as int)"
    total = f"aggregate(sequence(1, greatest(1, length(lq))), 0, (la, li) -> la + if(li % 2 = 1, {step}, 2 * {step} - if({step} > 4, 9, 0)))"
    return f"(element_at(transform(array(reverse({digits})), lq -> {total}), 1) % 10 = 0)"


def _side(c: str) -> str:
    return f"case when {c} is null or {c} = '' or {c} rlike '^[\\\\s]$' then 0 when {c} rlike '^[0-9]$' then 2 when {c} rlike '^[A-Za-z]$' then 1 else 3 end"


def _span(kind: str, m: str, start: str, end: str, before: str, after: str, valid: str, wide: str) -> str:
    """A candidate: place, features, label (null where only the trees decide)."""
    sep = f"(if(contains({m}, ' '), 1, 0) + if(contains({m}, '-'), 2, 0))"
    lead = f"case when left({m}, 1) = '+' then 2 when left({m}, 1) = '(' then 3 when {m} rlike '^[3-6]' then 1 else 0 end"
    return (
        f"named_struct('kind', {KINDS.index(kind)}, 'start', {start}, 'end', {end}, 'wide', {wide}, 'valid', {valid}, "
        f"'sep', {sep}, 'before', {_side(f'right({before}, 1)')}, 'after', {_side(f'left({after}, 1)')}, "
        f"'context', cast(lower(right({before}, 24)) rlike '{CONTEXT}' as int), 'lead', {lead})"
    )


def _valid(kind: str, m: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": f"forall(split({m}, '[.]'), p -> coalesce(try_cast(p as bigint) <= 255, length(ltrim('0', p)) = 0))",
        "card": f"if(length({digits}) between 13 and 19, {_luhn(digits)}, false)",
        "phone": f"(length({digits}) between 9 and 15)",
    }[kind]


def _sub_cards() -> str:
    """Runs of digit groups with 13 to 19 digits that pass Luhn inside a rejected card match ``x``, at every start.

    ``x.g`` are the groups, each but the first with the separator before it, and ``x.e`` the running sums of their lengths.  A run has
    at most 19 groups, its digits are counted by running sums, and only runs of the right size are put together, so the work
    is linear in the match."""
    before = "if(i = 1, 0, element_at(x.e, greatest(1, i - 1)) + 1)"  # the separator before the run is not part of it
    digits = f"(element_at(x.e, least(size(x.e), i + k - 1)) - {before} - (k - 1))"
    runs = f"filter(transform(sequence(1, least(19, size(x.g) - i + 1)), k -> named_struct('i', i, 'k', k, 'b', {before}, 'd', {digits})), r -> r.d between 13 and 19 and r.k < size(x.g))"
    grid = f"flatten(transform(sequence(1, size(x.g)), i -> {runs}))"
    text = "ltrim(' -', array_join(slice(x.g, r.i, r.k), ''))"
    made = f"transform({grid}, r -> named_struct('r', r, 'm', {text}))"
    good = f"filter({made}, c -> {_luhn("regexp_replace(c.m, '[^0-9]', '')")})"
    body = _span("card", "c.m", "(x.start + c.r.b)", "(x.start + c.r.b + c.r.d + c.r.k - 1)", "if(c.r.i = 1, x.before, concat(x.before, ' '))", "if(c.r.i + c.r.k > size(x.g), x.after, ' ')", "cast(null as boolean)", "true")
    return f"transform({good}, c -> {body})"


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__spans``: base matches and wider candidates, with features."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("__t", text)
    none = F.expr("cast(array() as array<string>)")
    jobs = [(k, False, PATTERNS[k]) for k in KINDS] + [(k, True, p) for k, p in LOOSE.items()]
    need = {}
    for kind, wide, _ in jobs:
        if wide:
            need[kind, wide] = F.col("__t").rlike(LOOSE_NEEDS[kind])
        elif kind in NEEDS:
            need[kind, wide] = F.contains(F.col("__t"), F.lit(NEEDS[kind]))
        else:
            need[kind, wide] = F.col("__t").rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][\x20-]?[0-9]")
    name = lambda k, w: f"__{k}{'w' if w else ''}"
    out = out.withColumns({f"{name(k, w)}m": F.when(need[k, w], F.regexp_extract_all(F.col("__t"), F.lit(p), F.lit(0))).otherwise(none) for k, w, p in jobs})
    out = out.withColumns({f"{name(k, w)}g": F.when(F.size(f"{name(k, w)}m") > 0, F.split(F.col("__t"), p, -1)).otherwise(none) for k, w, p in jobs})
    ends = {}
    for k, w, _ in jobs:
        c = name(k, w)
        ends[f"{c}s"] = F.expr(f"zip_with(slice({c}g, 1, size({c}m)), {c}m, (a, b) -> char_length(a) + char_length(b))")
    out = out.withColumns(ends)
    out = out.withColumns({f"{name(k, w)}e": F.expr(_running(f"{name(k, w)}s")) for k, w, _ in jobs})
    parts = []
    for k, w, _ in jobs:
        c = name(k, w)
        at = f"element_at({c}m, i)"
        valid = "cast(null as boolean)" if w else _valid(k, at)
        span = _span(k, at, f"element_at({c}e, i) - char_length({at})", f"element_at({c}e, i)", f"element_at({c}g, i)", f"element_at({c}g, i + 1)", valid, str(w).lower())
        # a wide candidate must pass what its kind's check asks for, too
        good = f"filter(sequence(1, greatest(1, size({c}m))), i -> {_valid(k, f"replace(replace({at}, '[', ''), ']', '')")})" if w and k == "ip" else f"sequence(1, greatest(1, size({c}m)))"
        parts.append(F.expr(f"if(size({c}m) = 0, array(), transform({good}, i -> {span}))"))
    chain = F.expr(f"if(size(__cardm) = 0, array(), transform(sequence(1, greatest(1, size(__cardm))), i -> named_struct('m', element_at(__cardm, i), 'start', element_at(__carde, i) - char_length(element_at(__cardm, i)), 'valid', {_valid('card', 'element_at(__cardm, i)')}, 'before', right(element_at(__cardg, i), 24), 'after', left(element_at(__cardg, i + 1), 1))))")
    out = out.withColumn("__plain", F.concat(*parts)).withColumn("__chain", F.filter(chain, lambda x: ~x["valid"] & (F.length(x["m"]) >= 13)))
    # each step is a projection of its own, so that groups and sums are made once a match
    groups = "transform(__chain, x -> named_struct('start', x.start, 'before', x.before, 'after', x.after, 'g', regexp_extract_all(x.m, '[ -]?[0-9]+', 0)))"
    out = out.withColumn("__chain", F.expr(f"filter({groups}, x -> size(x.g) > 1)"))
    out = out.withColumn("__chain", F.expr("transform(__chain, x -> named_struct('x', x, 'l', transform(x.g, y -> length(y))))"))
    sums = _running("y.l")
    out = out.withColumn("__chain", F.expr(f"transform(__chain, y -> named_struct('start', y.x.start, 'before', y.x.before, 'after', y.x.after, 'g', y.x.g, 'e', {sums}))"))
    out = out.withColumn("__sub", F.expr(f"if(size(__chain) = 0, array(), transform(__chain, x -> named_struct('start', x.start, 's', {_sub_cards()})))"))
    # a rejected match that may hold a card is no example of what is none
    fields = ("kind", "start", "end", "wide", "valid", *list(FEATURES)[1:])
    unsure = "s.kind = 2 and not s.valid and array_contains(transform(filter(__sub, x -> size(x.s) > 0), x -> x.start), s.start)"
    same = "named_struct(" + ", ".join(f"'{f}', " + (f"if({unsure}, null, s.valid)" if f == "valid" else f"s.{f}") for f in fields) + ")"
    out = out.withColumn("__plain", F.expr(f"if(size(__sub) = 0, __plain, transform(__plain, s -> {same}))"))
    return out.withColumn("__spans", F.concat("__plain", F.expr("flatten(transform(__sub, x -> x.s))"))).select(*docs.columns, "__t", "__spans")


class Trees:
    """Gradient-boosted regression trees of depth two over integer features, with thresholds by kind."""

    def __init__(self):
        self.trees: list[tuple] = []
        self.start = -9.0
        self.thresholds = [2.0] * len(KINDS)  # above any probability: nothing passes

    def raw(self, x: dict) -> float:
        s = self.start
        for f, c, low, high in self.trees:
            g, d, a, b = low if x[f] <= c else high
            s += a if x[g] <= d else b
        return s

    def sql(self, span: str) -> str:
        s = " + ".join(f"if({span}.{f} <= {c}, if({span}.{lo[0]} <= {lo[1]}, {lo[2]!r}D, {lo[3]!r}D), if({span}.{hi[0]} <= {hi[1]}, {hi[2]!r}D, {hi[3]!r}D))" for f, c, lo, hi in self.trees)
        return f"(1 / (1 + exp(-({self.start!r}D{' + ' if s else ''}{s}))))"

    def fit(self, rows: list[dict], rounds: int, precision: float, rate: float = 0.4) -> Trees:
        """rows: feature vectors with ``n`` rows of which ``y`` are accepted, and of these ``hn`` and ``hy`` in held-out documents."""
        every_n, every_y = sum(r["n"] for r in rows), sum(r["y"] for r in rows)
        if not every_y:
            return self
        if every_y == every_n:
            self.start, self.thresholds = 9.0, [0.0 if any(r["kind"] == k for r in rows) else 2.0 for k in range(len(KINDS))]
            return self
        kept, held = rows, [(r, r["hn"], r["hy"]) for r in rows]
        rows = [r | {"n": r["n"] - r["hn"], "y": r["y"] - r["hy"]} for r in rows]
        self.start = 0.0
        score = [0.0] * len(rows)
        for _ in range(rounds):
            p = [1 / (1 + math.exp(-max(-30, min(30, s)))) for s in score]
            g = [r["y"] - r["n"] * q for r, q in zip(rows, p, strict=True)]
            h = [max(r["n"] * q * (1 - q), 1e-6) for r, q in zip(rows, p, strict=True)]
            every = range(len(rows))
            _, f, c = self._split(rows, every, g, h)
            kids = []
            for side in ([i for i in every if rows[i][f] <= c], [i for i in every if rows[i][f] > c]):
                _, f2, c2 = self._split(rows, side, g, h)
                leaf = [rate * sum(g[i] for i in s) / (sum(h[i] for i in s) + 1.0) for s in ([i for i in side if rows[i][f2] <= c2], [i for i in side if rows[i][f2] > c2])]
                kids.append((f2, c2, round(leaf[0], 6), round(leaf[1], 6)))
            self.trees.append((f, c, *kids))
            score = [s + self._one(self.trees[-1], r) for s, r in zip(score, rows, strict=True)]
        for k in range(len(KINDS)):
            own = sorted(((1 / (1 + math.exp(-self.raw(r))), y, n) for r, n, y in held if r["kind"] == k and n), reverse=True)
            mine = [r for r in kept if r["kind"] == k]
            if mine and all(r["y"] == r["n"] for r in mine):
                self.thresholds[k] = 0.0
                continue
            y = n = 0
            for i, (p, a, b) in enumerate(own):
                y, n = y + a, n + b
                last = i + 1 == len(own) or own[i + 1][0] < p  # equal probabilities pass or fail together
                if last and y >= precision * n and p >= 0.5:
                    self.thresholds[k] = p - 1e-9
        return self

    @staticmethod
    def _one(tree: tuple, r: dict) -> float:
        f, c, low, high = tree
        g, d, a, b = low if r[f] <= c else high
        return a if r[g] <= d else b

    @staticmethod
    def _split(rows, at, g, h) -> tuple[float, str, int]:
        best = (-1.0, "kind", 99)
        sg, sh = sum(g[i] for i in at), sum(h[i] for i in at)
        for f, size in FEATURES.items():
            bg, bh = [0.0] * size, [0.0] * size
            for i in at:
                bg[rows[i][f]] += g[i]
                bh[rows[i][f]] += h[i]
            lg = lh = 0.0
            for c in range(size - 1):
                lg, lh = lg + bg[c], lh + bh[c]
                gain = lg * lg / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1)
                if gain > best[0] + 1e-12:
                    best = (gain, f, c)
        return best


def train_trees(docs: DataFrame, rounds: int = 24, precision: float = 0.95, given: DataFrame | None = None) -> Trees:
    """Trees from the base matches of all documents; what reaches the driver has at most ``FEATURE_VECTORS`` rows."""
    given = candidates(docs.select("text")) if given is None else given
    fold = F.col("__held") if "__held" in given.columns else held_out(F.col("text"))
    span = given.select(fold.alias("held"), F.explode("__spans").alias("s")).where("s.valid is not null").select("held", "s.*")
    one = {"n": F.lit(1), "y": F.col("valid").cast("int")}
    counts = span.groupBy(*FEATURES).agg(*(F.sum(x).alias(k) for k, x in one.items()), *(F.sum(F.when(F.col("held"), x).otherwise(0)).alias(f"h{k}") for k, x in one.items()))
    return Trees().fit([r.asDict() for r in counts.orderBy(*FEATURES).collect()], rounds, precision)


def held_out(text: Column) -> Column:
    """The documents that calibrate: a quarter, by a hash of the text, so that copies are on one side."""
    return F.pmod(F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), F.lit(29)), F.lit(4)) == 0


def find_spans(docs: DataFrame, trees: Trees, given: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, end, p) by kind and start, in code points, ends
    exclusive."""
    given = candidates(docs) if given is None else given
    limit = "case s.kind " + " ".join(f"when {i} then {t!r}D" for i, t in enumerate(trees.thresholds)) + " end"
    one = "named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'p', {p})"
    base = f"transform(filter(__spans, s -> coalesce(s.valid, false)), s -> {one.format(p='1D')})"
    scored = f"filter(transform(filter(__spans, s -> s.wide), s -> named_struct('x', {one.format(p=trees.sql('s'))}, 'limit', {limit})), c -> c.x.p >= c.limit)"
    given = given.withColumn("base", F.expr(base)).withColumn("__more", F.expr(f"transform({scored}, c -> c.x)"))
    # one sweep from left to right: e is the end of the base spans so far, last the candidate that may still give way
    kind = "struct<kind:int,start:int,end:int,p:double>"
    first = "concat(transform(base, b -> named_struct('a', b.start, 'b', 0, 'p', -b.p, 'l', -b.end, 'x', b)), transform(__more, c -> named_struct('a', c.start, 'b', 1, 'p', -c.p, 'l', -c.end, 'x', c)))"
    state = lambda done, last, e: f"named_struct('done', {done}, 'last', {last}, 'e', {e})"
    none, flushed = f"cast(null as {kind})", "if(z.last is null, z.done, concat(z.done, array(z.last)))"
    met = "(z.last is not null and c.x.start < z.last.end)"
    step = (
        f"case when c.b = 0 then {state(f'if({met}, z.done, {flushed})', none, 'greatest(z.e, c.x.end)')} when c.x.start < z.e then z "
        f"when {met} then {state('z.done', 'if(c.x.p > z.last.p, c.x, z.last)', 'z.e')} else {state(flushed, 'c.x', 'z.e')} end"
    )
    sweep = f"aggregate(array_sort({first}), {state(f'cast(array() as array<{kind}>)', none, '0')}, (z, c) -> {step}, z -> {flushed})"
    given = given.withColumn("__more", F.expr(f"if(size(__more) = 0, __more, {sweep})"))
    return given.withColumn("spans", F.expr("array_sort(concat(base, __more))")).withColumn("base", F.expr("array_sort(base)")).drop("__more", "__spans")


def joined(spans: str) -> str:
    """kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat_ws(':', element_at({names}, s.kind + 1), s.start, s.end)), ',')"


def redact(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; columns and rows as before.

    The patterns run once: their candidates are saved.  Other columns travel in one struct, whatever their names."""
    others = F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    inner = docs.select(others.alias("__row"), "text")
    given = save(candidates(inner).drop("__t"), "spans")
    given = given.withColumn("__t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = find_spans(inner, trees or train_trees(inner, given=given), given)
    # spans of different kinds can overlap: ranges merge, the first kind names them
    order = "transform(array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))), s -> s)"
    grow = (
        f"aggregate({order}, named_struct('done', cast(array() as array<struct<start:int,end:int,kind:int>>), 'last', cast(null as struct<start:int,end:int,kind:int>)), "
        "(z, s) -> case when z.last is null then named_struct('done', z.done, 'last', s) "
        "when s.start < z.last.end then named_struct('done', z.done, 'last', named_struct('start', z.last.start, 'end', greatest(z.last.end, s.end), 'kind', z.last.kind)) "
        "else named_struct('done', concat(z.done, array(z.last)), 'last', s) end, z -> if(z.last is null, z.done, concat(z.done, array(z.last))))"
    )
    found = found.withColumn("__m", F.expr(f"if(size(spans) = 0, cast(array() as array<struct<start:int,end:int,kind:int>>), {grow})"))
    # the text in sections of 64 spans, so that no piece is searched for from the text's start
    tag = "concat('[', upper(element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), s.kind + 1)), ']')"
    begin = "if(b = 0, 0, element_at(__m, greatest(1, b * 64)).end)"
    section = f"named_struct('o', {begin}, 't', substring(__t, {begin} + 1, element_at(__m, least(size(__m), b * 64 + 64)).end - {begin}), 'm', slice(__m, b * 64 + 1, 64))"
    sections = f"transform(sequence(0, cast((size(__m) - 1) div 64 as int)), b -> {section})"
    piece = f"array_join(transform(c.m, (s, i) -> concat(substring(c.t, if(i = 0, 0, element_at(c.m, greatest(1, i)).end - c.o) + 1, s.start - if(i = 0, c.o, element_at(c.m, greatest(1, i)).end)), {tag})), '')"
    text = f"if(size(__m) = 0, text, concat(array_join(transform({sections}, c -> {piece}), ''), substring(__t, element_at(__m, -1).end + 1, char_length(__t))))"
    return found.withColumn("text", F.expr(text)).select(*(F.col("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
