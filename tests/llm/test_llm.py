"""Operators of quire.llm against brute-force versions, on small tables with odd rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import decontamination, language_model, near_duplicates, packing, pii, quality, rules, sharding, substring_dedup, textkernel, toxicity
from quire.llm.components import components
from quire.llm.shared import skew_join

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


ODD = [
    (1, "one two three four five six seven", "en", "src0", 10, "x"),
    (2, "One two THREE four five six seven", "en", "src0", 10, None),
    (3, None, None, None, None, "x"),
    (4, "", "en", "src1", 0, "x"),
    (5, "a b", "en", "src1", 3, "x"),
    (6, "a b", "en", "src2", 3, "x"),
    (7, " \n\t ", "en", "src2", 4, "x"),
    (8, "é ü x " * 40 + "end.", "fr", "src2", 300, "x"),
    (9, "w" * 3000 + " " + "long tail " * 3000, "en", "src2", 33001, "x"),
    (9, "w" * 3000 + " " + "long tail " * 3000, "en", "src2", 33001, "x"),
    (None, "one two three four five six seven", "en", "src0", 10, "x"),
    (11, "call 4111 1111 1111 1111 or a.b@c-d.org, 10.0.0.1 and +1 (523) 555-1055.", "en", "src0", 70, "x"),
    (12, "<|endoftext|> is ordinary\r\nwith lines\r\nwith lines\r\n", "en", "src0", 50, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_words_and_hashes_follow_the_contract():
    texts = ["", "A b\tC\x0bd", None, "é x y" * 3, "z" * 100]
    got = []
    for block in textkernel.blocks(pa.array(texts), 8):
        w = textkernel.Words(block)
        got += [[w.buf[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.bounds, w.bounds[1:], strict=False)]
    assert got == [SPACE.findall(lower(t or "")) for t in texts]
    one = textkernel.Words(next(textkernel.blocks(pa.array(["abcdefgh abcdefghi abcdefgh " + "q" * 17 + " " + "q" * 17]))))
    assert one.hash[0] == one.hash[2] != one.hash[1] and one.hash[3] == one.hash[4]


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = SPACE.findall(lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if same and 100 * same >= 80 * (len(a) + len(sets[j]) - same):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted(((d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=str)


def test_jaccard_join_equals_brute_force(docs, odd, empty):
    for table in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        got = near_duplicates.near_duplicates(table).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_components(rows)
    assert near_duplicates.near_duplicates(empty).count() == 0


def families(r):
    """Near copies, with chains whose ends are not similar, beside a shared passage and one prefix with several texts."""
    word = lambda: "w" + str(r.integers(1e9))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(int(r.integers(0, 4))):
            t[int(r.integers(120))] = word()
        texts.append(" ".join(t))
    passage = [word() for _ in range(40)]
    for _ in range(50):
        texts.append(" ".join([word() for _ in range(int(r.integers(0, 60)))] + passage))
    return list(enumerate(texts + texts[:9], 1))


def test_jaccard_join_of_near_copies_that_are_not_linked(spark, monkeypatch):
    """Copies of one text with five edits each are just below the limit: few of them may meet, and not each pair in each bucket."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(400)]

    def edited(d, edits):
        words = list(base)
        for k, at in enumerate(rng.choice(np.arange(6, 394, 6), edits, replace=False)):
            words[at] = f"edit{d}_{k}"
        return " ".join(words)

    rows = [(d, edited(d, 5)) for d in range(60)]
    made, met = [], near_duplicates._Join.met

    def watched(join, bucket):
        out = met(join, bucket)
        made.append(out[0].count())
        return out

    monkeypatch.setattr(near_duplicates._Join, "met", watched)
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = near_duplicates.near_duplicates(table).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_components(rows)
    assert made[0] < 60 * 59 // 2 * 4
    # with an edit fewer all are linked, whatever their order
    edges, _ = near_duplicates.similar_pairs(spark.createDataFrame([(d, edited(d, 4)) for d in range(20)], "doc_id long, text string"))
    assert edges.count() == 20 * 19 // 2


def test_wide_parities_never_exceed_the_difference():
    rng = np.random.default_rng(6)
    for n in (600, 1024, 1025, 5000):
        s = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        for gone, more in ((0, 0), (3, 0), (n // 10, n // 20), (n // 10, 0), (n, n)):
            o = np.union1d(s[gone:], rng.integers(0, 2**63, more, dtype=np.uint64))
            if len(o) > 512:
                apart = near_duplicates.wide_apart(near_duplicates.wide_parity(s), near_duplicates.wide_parity(o))
                assert apart <= len(np.setxor1d(s, o)) and (gone < n or apart > n * 0.4)


def test_jaccard_join_of_crowded_families(spark, monkeypatch):
    """Leaders link most of a family, the last join the rest, and either alone is enough for no link to be lost."""
    rows = families(np.random.default_rng(0))
    table, want = spark.createDataFrame(rows, "doc_id long, text string"), brute_components(rows)
    seen = []
    rounds, meet = near_duplicates._round, near_duplicates._Join.meet

    def watched(*args):
        seen.append(("round", (found := rounds(*args)).count()))
        return found

    def last(join, bucket):
        seen.append(("meet", bucket.select("label").distinct().count()))
        return meet(join, bucket)

    monkeypatch.setattr(near_duplicates, "_round", watched)
    monkeypatch.setattr(near_duplicates._Join, "meet", last)
    for quiet in (50, 10**9, 0):  # as it is; rounds until nothing is linked; no rounds
        monkeypatch.setattr(near_duplicates, "QUIET", quiet)
        seen.clear()
        got = near_duplicates.near_duplicates(table).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted((tuple(x) for x in got), key=str) == want
        assert quiet == 0 or sum(n for kind, n in seen if kind == "round") > 20, seen
    assert seen[0][0] == "meet" and seen[0][1] > 50


def test_every_link_is_counted(spark, docs):
    for rows in (families(np.random.default_rng(1)), [(r["doc_id"], r["text"]) for r in docs.collect()]):
        sets = {}
        for d, t in rows:
            w = SPACE.findall(lower(t or ""))
            sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        kinds = [s for s in set(sets.values()) if s]
        of = Counter()
        for i, x in enumerate(kinds):
            for y in kinds[:i]:
                same = len(x & y)
                if 100 * same >= 80 * (len(x) + len(y) - same) > 0:
                    of[x] += 1
                    of[y] += 1
        edges, classes = near_duplicates.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r["doc_id"]: r["n_links"] for r in classes.collect()} == {d: of[s] for d, s in sets.items()}
        assert 2 * edges.count() == sum(of.values())


def test_one_document_of_each_component_stays(docs, odd):
    want = {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])}
    kept = near_duplicates.distinct_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want and kept.count() == len(want)
    few = near_duplicates.distinct_documents(odd)
    assert sorted(str(r["doc_id"]) for r in few.collect()) == sorted(map(str, (1, 3, 4, 5, 7, 8, 9, 11, 12)))


def test_hot_keys_join_like_others(spark):
    """Keys beyond the share are broadcast, the others shuffled; rows are those of a plain join."""
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, 7, id % 500) as k", "id").withColumn("k", F.when(F.col("id") % 11 == 5, None).otherwise(F.col("k")))
    sized = rows.where("k is not null and k % 5 <> 1").groupBy("k").agg(F.count("*").alias("c"), F.max("id").alias("top"))
    got, want = skew_join(rows, sized, "k"), rows.join(sized.drop("c"), "k")
    assert sized.where("c > 70").count() == 1 and got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()
    assert skew_join(rows, sized.where("k > 7"), "k").exceptAll(rows.join(sized.drop("c").where("k > 7"), "k")).isEmpty()


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (202, 201), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200, 202: 200}


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}
            if ok[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TRICKY = ["a@b.c@d.e x@y", "a@b.co_x@y.com 😀 z@q.io", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3", "5 4111-1111 1111-1111 4111111111111111-", "++12 (3) 456.78-90 +1 +123456789012345678 +44 20 7946 0958-", "4111111111111111 " * 600, "é" * 50 + "user@host.org", "9" * 400, None, ""]


def test_base_spans_equal_the_plain_patterns(spark, odd, docs):
    tricky = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for table in (tricky, odd.select("doc_id", "text"), docs.select("doc_id", "text")):
        found = pii.find_spans(table, pii.Trees()).select("doc_id", "text", F.expr(pii.joined("base")).alias("b"), F.expr(pii.joined("spans")).alias("s"))
        for r in found.collect():
            assert r["b"] == r["s"] == brute_spans(r["text"] or "")


def test_trees_add_what_the_base_swallows(docs, spark, empty):
    trees = pii.train_trees(docs)
    text = "ref 123 4111 1111 1111 1111 and mail me at jane (at) example.org please"
    row = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), trees).first()
    assert not row["base"] and {(s["kind"], text[s["start"] : s["end"]]) for s in row["spans"]} >= {(0, "jane (at) example.org")}
    assert pii.train_trees(empty).trees == [] and pii.redact(empty).count() == 0
    assert trees.sql("s").count("if(") == 3 * len(trees.trees)


def test_added_spans_against_planted_ones(spark):
    """Precision and recall of what the method adds, on spans planted in texts of which the base patterns find none."""
    r = np.random.default_rng(4)

    def card(n=16):
        d = r.integers(0, 10, n - 1).tolist() + [0]
        d[0] = 4
        odd = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        d[-1] = -odd % 10
        s = "".join(map(str, d))
        return " ".join(s[i : i + 4] for i in range(0, n, 4))

    digits = lambda n: "".join(str(x) for x in r.integers(0, 10, n))
    rows, planted, plain = [], {}, set()
    for i in range(400):
        if i % 4 == 0:  # base matches to learn from, accepted and not
            rows.append((i, f"pay by card {card()} or call +1 523 555 {digits(4)} now, not {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(4)}, mail a{i}@b.org"))
        elif i % 4 == 1:
            rows.append((i, f"my card {digits(3)} {card()} is new, jo{i}(at)host.org knows"))
            planted[i] = {"email", "card"}
        elif i % 4 == 2:
            rows.append((i, f"write to ann{i} [at] site.net today"))
            planted[i] = {"email"}
        else:
            rows.append((i, f"the {i} words of this text hold no data at all"))
            plain.add(i)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: {pii.KINDS[s["kind"]] for s in x["spans"]} for x in pii.find_spans(table, pii.train_trees(table)).collect()}
    assert not any(got[i] for i in plain)
    asked = [(i, k) for i, kinds in planted.items() for k in kinds if k == "email"]
    assert np.mean([k in got[i] for i, k in asked]) == 1.0
    cards = [i for i, kinds in planted.items() if "card" in kinds]
    assert np.mean(["card" in got[i] for i in cards]) > 0.9


def test_a_table_of_digit_groups_is_linear(spark):
    import time

    groups = " ".join(f"{(i * 7919) % 9000 + 1000}" for i in range(50_000))
    table = spark.createDataFrame([(1, groups), (2, "x 1.2.3.4 " * 2000)], "doc_id long, text string")
    trees = pii.Trees()
    trees.start, trees.thresholds = 9.0, [0.0] * 4
    pii.find_spans(table.where("doc_id = 2"), trees).count()  # plans and compiles
    began = time.time()
    row = pii.find_spans(table, trees).where("doc_id = 1").first()
    assert time.time() - began < 60
    ends = [(s["start"], s["end"]) for s in row["spans"]]
    assert len(ends) > 1000 and all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    for a, b in ends[:200]:
        d = groups[a:b].replace(" ", "")
        assert 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


CLASHING = ("__t", "__n", "__d", "__r", "__k", "__k0", "host_key", "score", "t", "row", "n", "r", "c", "predicted")


def test_columns_with_clashing_names_pass_by(spark, docs, labels):
    given = docs.select("*", *(F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in CLASHING))
    tox, good = toxicity.train_toxicity(docs, labels, epochs=1), quality.train_quality(docs, labels, epochs=1)
    for out in (quality.score_quality(given, good), toxicity.score_toxicity(given, tox), rules.host_rules(given), near_duplicates.distinct_documents(given), substring_dedup.dedup_substrings(given), pii.redact(given, pii.Trees()), decontamination.find_contamination(given, docs.sparkSession.createDataFrame([(1, "x y z")], "item_id long, text string"))):
        made = {"score", "predicted"} if "score" in out.columns and dict(out.dtypes)["score"] == "double" else set()
        for c in set(CLASHING) - made:
            assert out.where(F.col(f"`{c}`") != F.concat(F.lit(f"{c} "), "doc_id")).isEmpty() and c in out.columns, c


def test_repetitions_cost_decontamination_little(spark):
    import time

    item, text = "very " * 5000 + "odd", "so " + "very " * 6000 + "nice"
    d, b = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item), (8, "very " * 20)], "item_id long, text string")
    began = time.time()
    row = decontamination.find_contamination(d, b).first()
    assert time.time() - began < 30
    assert (row["n_words"], row["n_hit"], row["items"], row["longest"], row["longest_at"], row["longest_item"]) == (6002, 6000, ["7", "8"], 5000, 1, "7")


def test_redaction_replaces_spans_only(spark, odd):
    tricky = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(tricky, pii.Trees()).collect()}
    for i, t in enumerate(TRICKY):
        ranges = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in brute_spans(t or "").split(",") if x))
        if all(x[1] <= y[0] for x, y in zip(ranges, ranges[1:], strict=False)):
            want, at = "", 0
            for a, b, k in ranges:
                want, at = want + t[at:a] + f"[{k.upper()}]", b
            assert got[i] == (None if t is None else want + t[at:])
    assert pii.redact(odd, pii.Trees()).columns == odd.columns


def test_toxicity_learns_and_scores_every_window(docs, labels, odd, empty):
    model = toxicity.train_toxicity(docs, labels, epochs=3)
    got = toxicity.score_toxicity(odd, model)
    assert "score" in got.columns and got.count() == len(ODD)
    assert all(0 <= r["score"] <= 1 and r["n_windows"] >= 1 for r in got.collect())
    words = len(ODD[8][1].split())
    assert next(r["n_windows"] for r in got.collect() if r["doc_id"] == 9) == -(-(words - 16) // 16)
    assert toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.train_toxicity(empty, labels).slope == 0.0


def test_toxicity_gradient_is_that_of_the_loss():
    net = toxicity.Net()
    texts = pa.table({"text": ["you are a fool indeed " * 9, "kind words only " * 12, "fool", ""], "y": [1, 0, 1, 0]})
    w = textkernel.Words(next(textkernel.blocks(texts["text"].combine_chunks())), kind=textkernel.ALNUM)
    x, y, weight = toxicity.Inputs(w), np.array([1, 0, 1, 0], np.float32), np.ones(4, np.float32)
    at = x.window_bounds[:-1]
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    g, _ = net.gradient(x, at, y, weight)
    for name, i in (("hf", (2, 5)), ("hb", (1, 20)), ("xf", (3, 7)), ("cb", (4,)), ("att", (3,)), ("out", (9,)), ("bias", (0,))):
        old = net.p[name][i]
        loss = []
        for d in (1e-4, -1e-4):
            net.p[name][i] = old + d
            loss.append(net.gradient(x, at, y, weight)[1])
        net.p[name][i] = old
        assert g[name][i] == pytest.approx((loss[0] - loss[1]) / 2e-4, abs=2e-4)


def auc(score, label):
    """The share of pairs of unlike labels in their right order."""
    rank = score.rank()
    one = label == 1
    return (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


def test_toxicity_held_out_accuracy(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = d.join(lab, "doc_id").where(~toxicity.usable(F.col("doc_id")))
    got = toxicity.score_toxicity(known.select("doc_id", "text", "toxic"), toxicity.train_toxicity(d, lab)).join(d.select("doc_id", "text"), "doc_id").toPandas()
    # a tenth of the labels of toxic documents is noise: none of the words that the others share stands in them
    insult = got.text.str.lower().str.contains("trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron")
    assert got.predicted[insult & (got.toxic == 1)].mean() == 1 and got.predicted[got.toxic == 1].mean() > 0.87
    assert got.predicted[got.toxic == 0].mean() < 0.04 and auc(got.score, got.toxic) > 0.94


def test_quality_held_out_accuracy(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = d.join(lab, "doc_id").where(~quality.usable(F.col("doc_id"))).select("doc_id", "text", "n_chars", F.col("quality").alias("label"))
    got = quality.score_quality(known, quality.train_quality(d, lab)).toPandas()
    good = got[got.label == 1]
    assert (got.predicted == got.label).mean() > 0.93 and good.predicted.mean() > 0.99 and got.predicted[got.label == 0].mean() < 0.2 and auc(got.score, got.label) > 0.95


def test_quality_pair_term_is_the_sum_over_pairs():
    m = quality.Machine(bits=6, rank=3)
    m.p["w"][:] = np.random.default_rng(0).normal(0, 0.3, m.p["w"].shape)
    ids, bounds = np.array([3, 9, 9, 20]), np.array([0, 4])
    dense = np.random.default_rng(1).normal(0, 1, (1, quality.DENSE))
    x = np.concatenate((np.full(4, 0.5), dense[0]))
    v = np.concatenate((m.p["w"][ids], m.p["d"]))
    want = (v[:, 0] * x).sum() + sum(float(v[i, 1:] @ v[j, 1:]) * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert m.raw(ids, bounds, dense)[0][0] == pytest.approx(want, rel=1e-4)


def test_quality_of_odd_rows(odd, empty, docs, labels):
    model = quality.train_quality(docs, labels, epochs=2)
    got = quality.score_quality(odd, model)
    assert got.count() == len(ODD) and all(0 <= r["score"] <= 1 for r in got.collect())
    assert quality.score_quality(empty, model).count() == 0


def brute_contamination(text, items):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))
    hit, ids = set(), set()
    for item, t in items:
        b = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
        k = min(13, len(b))
        if item is None or not k:
            continue
        windows = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                ids.add(str(item))
    return len(words), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination_equals_brute_force(docs, benchmark, odd, empty, spark):
    own = spark.createDataFrame([(1, "seven six"), (2, "Six, seven"), (None, "a b"), (4, None), (5, "..."), (6, "long tail " * 9), (6, "one two")], "item_id long, text string")
    for table, bench in ((docs, benchmark), (odd, own)):
        items = [(r["item_id"], r["text"]) for r in bench.collect()]
        for pages in (2_000_000, 60):
            for r in decontamination.find_contamination(table, bench, page_words=pages).collect():
                assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == brute_contamination(r["text"], items)
    clean = decontamination.decontaminate(odd, own)
    assert clean.columns == odd.columns
    assert decontamination.find_contamination(empty, own).count() == 0
    assert decontamination.find_contamination(odd, own.where("false")).where("contaminated").count() == 0


def test_longest_match_and_its_place(spark):
    words = [f"w{i}" for i in range(40)]
    d = spark.createDataFrame([(1, " ".join(["x"] * 5 + words[3:30] + ["y"] * 9))], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    r = decontamination.find_contamination(d, b).first()
    assert (r["longest"], r["longest_at"], r["longest_item"], r["n_hit"]) == (27, 5, "7", 27)


def check_shards(rows, got, shards):
    assert len(got) == len(rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(0 <= s < shards for s in sizes) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    return sizes


def test_shards_have_near_equal_bytes(spark, odd, empty):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sizes = check_shards([(r["doc_id"], r["text"]) for r in d.collect()], sharding.kd_shards(d, 24).collect(), 24)
    assert len(sizes) == 24 and max(sizes.values()) < 1.03 * min(sizes.values())
    check_shards([(r["doc_id"], r["text"]) for r in odd.collect()], sharding.kd_shards(odd, 5).collect(), 5)
    assert sharding.kd_shards(empty, 5).count() == 0


def test_groups_of_copies_stay_whole_and_shards_equal(spark):
    """Groups of up to half a shard stay together; one that no shard can take is dealt out."""
    rows = []
    for g, n in enumerate((900, 260, 240, 230, 200, 150, 90, 40, 9, 2)):
        rows += [(g, f"text of group {g} " * 3)] * n
    rows = [(i, t, f"s{i % 3}", 60) for i, (_, t) in enumerate(rows)] + [(9000 + i, f"single text number {i} and some words", "s1", 40 + i % 7) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = sharding.kd_shards(d, 8).collect()
    sizes = check_shards([(r[0], r[1]) for r in rows], got, 8)
    assert max(sizes.values()) < 1.03 * min(sizes.values())
    shards_of = defaultdict(set)
    for r in got:
        if r["doc_id"] < 9000:
            shards_of[r["text_crc32"]].add(r["shard"])
    share = sum(sizes.values()) / 8
    weight = Counter(r["text_crc32"] for r in got if r["doc_id"] < 9000)
    size = {r["text_crc32"]: r["size"] for r in got}
    for c, of in shards_of.items():
        assert len(of) == 1 or weight[c] * size[c] > 0.5 * share, (weight[c], of)


def test_elias_fano_round_trip(tmp_path):
    r = np.random.default_rng(3)
    for v in (np.zeros(0, np.uint64), np.array([0, 0, 7], np.uint64), np.sort(r.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)), np.arange(300, dtype=np.uint64), np.array([2**64 - 1], np.uint64)):
        (tmp_path / "level").write_bytes(language_model.EliasFano.pack(v))
        e = language_model.EliasFano(np.memmap(tmp_path / "level", np.uint8, "r")).opened()
        assert (e.get(np.arange(len(v))) == v).all()
        if len(v):
            assert (v[e.find(v)] == v).all()
        known = set(v.tolist())
        other = np.array([x for x in (1, 5, 2**40, 2**63) if x not in known], np.uint64)
        assert (e.find(other) == -1).all()


def brute_lm(rows, mu):
    docs = [(SPACE.findall(lower(t or "")) + [0], zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2) for d, t in rows]
    c, pairs, n_docs = Counter(), Counter(), 0
    for w, held in docs:
        if not held:
            c.update(w)
            pairs.update(zip([1, *w], w, strict=False))
            n_docs += 1
    n, v = sum(c.values()), len(c)
    out = []
    for w, held in docs:
        base = sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w)
        own = lambda u: n_docs if u == 1 else c[u]
        score = sum(np.log10((pairs[u, x] + mu * (c[x] + 1) / (n + v + 1)) / (own(u) + mu)) for u, x in zip([1, *w], w, strict=False))
        out.append((held, len(w), sum(c[x] > 0 for x in w), n, base, score))
    return out


def test_lm_scores_equal_brute_force(docs, odd, empty, monkeypatch):
    monkeypatch.setattr(language_model, "PACKET", 20_000)
    for table in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        got = sorted((tuple(r) for r in language_model.score_texts(table, mu=50).collect()), key=lambda r: (str(r[0]), r[2]))
        want = sorted(((d, *x) for (d, _), x in zip(rows, brute_lm(rows, 50), strict=True)), key=lambda r: (str(r[0]), r[2]))
        for g, w in zip(got, want, strict=True):
            assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and abs(g[6] - w[6]) <= w[2] * 0.5 / language_model.GRID + 1e-6
    assert language_model.score_texts(empty).count() == 0


def tokenizer():
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def test_packing_is_a_round_trip(docs, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer()["vocabulary"])
    for table in (docs, odd):
        rows = [(r["doc_id"], r["text"] or "") for r in table.collect()]
        got = packing.pack(table, **tokenizer()).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in got:
            pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        want = defaultdict(list)
        for d, text in rows:
            want[d].append([*t.encode(text, add_special_tokens=False).ids, 1])
        for d, copies in want.items():
            assert sum(p[1] for p in pieces[d]) == sum(map(len, copies))
            for start, length, crc, n in pieces[d]:
                assert any(len(ids) == n and zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc for ids in copies)
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(sequences) <= 1.02 * sum(p[1] for v in pieces.values() for p in v) / 2048 + 4
    assert packing.pack(empty, **tokenizer()).count() == 0


def test_differencing_balances():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 512, 300).tolist()
    sums, members = packing.difference(sizes, 20)
    assert sorted(i for m in members for i in m) == list(range(300)) and [sum(sizes[i] for i in m) for m in members] == sums.tolist()
    assert sums.max() - sums.min() <= 8
    assert packing.windows_for([2048, 2048, 1], 2048) and len(packing.windows_for([1500, 1500, 1000], 2048)) == 3


def brute_rules(text):
    words = SPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    rep = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep)


def test_rules_equal_brute_force(docs, odd, empty):
    for table in (docs, odd):
        rows = sorted(((str(r["doc_id"]), *brute_rules(r["text"])) for r in table.collect()))
        got = rules.host_rules(table)
        assert sorted((str(r["doc_id"]), *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in got.collect()) == rows
        for r in got.collect():
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] <= (not r["base_failed"])
    assert rules.host_rules(empty).count() == 0


def test_a_failing_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good + f" x{i}", f"h{i % 9}") for i in range(900)] + [(1000 + i, "bad", "spam") for i in range(95)] + [(2000 + i, good + f" y{i}", "spam") for i in range(5)]
    got = rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["source"] for r in got if not r["kept"]} == {"spam"} and sum(r["kept"] for r in got) == 900


def test_repeated_passages_leave_all_but_their_first_place(spark, docs, odd, empty):
    r = np.random.default_rng(5)
    say = lambda n: " ".join(f"w{x}" for x in r.integers(0, 1e9, n)) + "."
    passage = " ".join(say(9).capitalize() for _ in range(6))
    rows = [(i, " ".join(say(7) for _ in range(5)) + (" " + passage + " " if i % 3 == 0 else " ") + " ".join(say(6) for _ in range(4))) for i in range(12)]
    got = {x["doc_id"]: x for x in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i]["text"] == (t if i % 3 or i == 0 else t.replace(passage + " ", "")), i
        assert (got[i]["n_removed"] > 0) == (i % 3 == 0 and i > 0)
    got = substring_dedup.dedup_substrings(odd)
    assert got.count() == len(ODD) and {r["text"] for r in got.where("doc_id = 5 or doc_id = 6").collect()} == {"a b"}
    assert substring_dedup.dedup_substrings(empty).count() == 0
    # against a brute-force version on the sample
    whole = substring_dedup.dedup_substrings(docs.select("doc_id", "text")).collect()
    assert {x["doc_id"]: x["n_removed"] for x in whole} == brute_removed([(x["doc_id"], x["text"]) for x in docs.collect()], 16)


def brute_removed(rows, least):
    first, own = {}, {}
    for d, text in sorted(rows):
        sentences, now = [], []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", lower(text or "")):
            now.append(m.group())
            rest = re.match(r"[\x20\x09-\x0D]*", text[m.end() :]).group()
            if m.group()[-1] in ".!?;:," or "\n" in rest:
                sentences.append(now)
                now = []
        own[d] = sentences + [now] * bool(now)
    gone = defaultdict(set)
    for d in sorted(own):
        for i in range(len(own[d])):
            j, words = i, list(own[d][i])
            while j < len(own[d]) and (j == i or len(words) < least):
                j += 1
                if j < len(own[d]):
                    words += own[d][j]
            if j < len(own[d]) and len(words) >= least:
                if first.setdefault(tuple(words), (d, i)) != (d, i):
                    gone[d] |= set(range(i, j + 1))
    return {d: len(gone[d]) for d in own}


def windows_of(text, n=50):
    w = SPACE.findall(lower(text or ""))
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


def test_repeated_windows_of_fifty_words_lose_words_anywhere(spark, docs):
    r = np.random.default_rng(8)
    say = lambda n: " ".join(f"w{x}" for x in r.integers(0, 1e9, n))
    plain, line, two = say(60), say(55), say(40) + ". " + say(40)
    han = "".join(chr(0x4E00 + x) for x in r.integers(0, 20000, 120))
    shared = [plain, "\n" + line + "\n", two, han, plain.replace(" ", "\n", 30)]
    rows = [(2 * k + i, say(30 + i) + f" {p} " + say(33 - i)) for k, p in enumerate(shared[:4]) for i in (0, 1)] + [(8, say(9) + " " + shared[4]), (9, say(90))]
    got = {x["doc_id"]: x for x in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["cut_words"] > 0 for i, _ in rows] == [False, True] * 4 + [True, False]
    for k in (0, 1, 2):  # what stays of a passage is its edges, and nothing else goes
        left, p = SPACE.findall(got[2 * k + 1]["text"]), SPACE.findall(shared[k])
        assert sum(w in left for w in p) <= 30 and all(w in left for w in SPACE.findall(rows[2 * k + 1][1]) if w not in p)
    assert got[9]["text"] == rows[9][1] and got[0]["text"] == rows[0][1]
    # texts under one id stay apart
    same = spark.createDataFrame([(1, say(20) + f" {plain} " + say(20)), (1, say(25) + f" {plain} " + say(20)), (None, say(18) + f" {plain}")], "doc_id long, text string")
    assert sorted(x["cut_words"] > 0 for x in substring_dedup.dedup_substrings(same).collect()) == [False, True, True]
    # against brute force: no window of an earlier document stays whole in a later one
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    cut = {x["doc_id"]: x for x in substring_dedup.dedup_substrings(docs.select("doc_id", "text")).collect()}
    seen, held = set(), 0
    for d in sorted(texts):
        own = set(windows_of(texts[d]))
        held += bool(own & seen)
        assert not set(windows_of(cut[d]["text"])) & own & seen, d
        seen |= own
    assert held > 0


def test_pipeline_stages_keep_their_contract(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    now = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == d.columns, name
        rows = after.collect()
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in now.collect()}
        now = spark.createDataFrame(rows, d.schema)
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in now.collect()}


def test_redaction_keeps_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "write to ann@site.org now", "b", "s", "t"), (2, None, None, None, None)], "doc_id long, text string, base string, spans string, __t string")
    got = {r["doc_id"]: tuple(r)[1:] for r in pii.redact(docs).collect()}
    assert got == {1: ("write to [EMAIL] now", "b", "s", "t"), 2: (None, None, None, None)}
