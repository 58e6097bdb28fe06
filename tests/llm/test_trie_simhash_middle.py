"""Operators 11 to 13 against brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from quire.llm import fill_in_middle, prefix_trie, queries, simhash
from quire.llm.fill_in_middle import Middle

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TALK = "conv_id long, turn long, role string, text string, depth string"


def sql_rows(name, views):
    con = duckdb.connect()
    for view, path in views.items():
        con.execute(f"create view {view} as select * from '{path}'")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_fill_in_middle"])
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    names, want = sql_rows(name, {v: f"{SF}/{v}.parquet" for v in ("documents", "conversations")})
    assert sorted(df.columns) == names
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == want


def brute_trie(rows, family=5, head=9):
    """By (conv_id, depth) the other columns of every node, from rows (conv_id, turn, role, text)."""
    talks = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v, key=lambda x: x[:3])] for c, v in talks.items()}
    built = {}
    for c, own in turns.items():
        base, h = int(c - np.fmod(c, family)), zlib.crc32(str(c).encode()) % head
        built[c] = turns.get(base, [])[:h] + own[h:]
    members, ends, size = defaultdict(list), defaultdict(list), {}
    for c, seq in sorted(built.items()):
        key = b""
        for d in range(len(seq) + 1):
            if d:
                key = hashlib.sha256(key + repr(seq[d - 1]).encode()).digest()
            members[d, key].append(c)
            size[d, key] = (len(seq[d - 1][1].encode()) if d else 0, parent if d else None)
            parent = (d, key)
        ends[parent].append(c)
    kids, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, (_, up) in size.items():
        kids[up] += 1
    for node in sorted(members, key=lambda x: -x[0]):
        saved[node] += (len(members[node]) - 1) * size[node][0]
        leaves[node] += node not in kids
        if up := size[node][1]:
            saved[up] += saved[node]
            leaves[up] += leaves[node]
    out = []
    for node, m in members.items():
        up = size[node][1]
        ids = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out.append((m[0], node[0], members[up][0] if up else None, len(m), kids.get(node, 0), leaves[node], saved[node], ids))
    return sorted(out)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(df):
    return sorted(tuple(r[c] for c in NODE) for r in df.collect())


ODD_TALKS = [
    (0, 0, "user", "hi", "x"), (0, 1, "assistant", "é and ü", "x"), (0, None, None, None, "x"), (1, 0, "user", "hi", None), (1, 5, "user", "later", None), (2, 3, "user", "", "x"), (2, 3, "user", "tie a", "x"),
    (2, 3, "user", "tie b", "x"), (2, 3, "user", "tie b", "x"), (3, 0, "a", "bc", "x"), (4, 0, "ab", "c", "x"), (6, 0, "user", "no base", "x"), (7, 0, "user", "no base", "x"), (7, 1, "user", "more", "x"),
    (-3, 0, "user", "hi", "x"), (-5, 0, "user", "hi", "x"), (-7, 0, "user", "hi", "x"), (None, 0, "user", "lost", "x"), (12, 0, "user", "w" * 5000, "x"), (10, 0, "user", "w" * 5000, "x"),
]


def test_trie_of_odd_rows(spark):
    df = spark.createDataFrame(ODD_TALKS, TALK)
    assert trie_rows(prefix_trie.prefix_trie(df)) == brute_trie(ODD_TALKS)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TALK)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_small_alphabets(spark, seed):
    """Few different turns, so that conversations of different families share long prefixes; long ones span many ranges."""
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "bot"]), r.choice("ab"), None) for c in range(60) for t in range(r.choice([1, 2, 3, 12]))]
    rows += [(100, t, "user", "ab"[t % 3 == 0], None) for t in range(300)] + [(101, t, "user", "ab"[t % 3 == 0], None) for t in range(250)]
    rows += [(c, t, "user", "same", None) for c in range(200, 800) for t in range(3)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, TALK).repartition(3)
    assert trie_rows(prefix_trie.prefix_trie(df)) == brute_trie(rows)


def test_rebuilt_turns_have_their_texts(spark):
    df = spark.createDataFrame(ODD_TALKS, TALK)
    built = prefix_trie.rebuilt_turns(df, texts=True).where("conv_id = 0").orderBy("p").collect()
    assert [(r["p"], r["text"]) for r in built] == [(0, None), (1, ""), (2, "hi"), (3, "é and ü")]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_print(text, k=3):
    w = SPACE.findall(lower(text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_vectorised_hash_equals_the_library():
    r = random.Random(1)
    parts = [bytes(r.randrange(256) for _ in range(n)) for n in [*range(140), 1000, 5001]]
    at = np.cumsum([0, *map(len, parts)])
    got = simhash.xxh64(np.frombuffer(b"".join(parts) + bytes(8), np.uint8), at[:-1], at[1:])
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(p, 42) for p in parts]


TEXTS = [None, "", " \n", "One", "one", "one two", "A  b\tC", "a b c d", "é " * 50, "w" * 4000 + " x y z", "long tail " * 3000]


def test_fingerprints_equal_brute_force():
    texts = [*TEXTS, *pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()]
    for step in (1 << 17, 100):
        assert [int(x) for x in simhash.fingerprints(pa.array(texts, pa.string()), step=step)] == [brute_print(t) for t in texts]
    assert len(simhash.fingerprints(pa.array([], pa.string()))) == 0


def brute_classes(ids, prints, radius=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)].append(d)
    return sorted(((d, f"{p:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, p) in enumerate(zip(ids, prints, strict=True))), key=repr)


def test_near_duplicates_equal_brute_force(spark):
    rows = [(r["doc_id"], r["text"], "x") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10_000 + i, t, None) for i, t in enumerate(TEXTS)] + [(None, "One", "x"), (None, "alone among all of these", "x"), (10_001, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in simhash.simhash_duplicates(df).collect()), key=repr)
    assert got == brute_classes([r[0] for r in rows], [brute_print(r[1]) for r in rows])
    assert simhash.simhash_duplicates(df.where("false")).count() == 0


def clustered(seed, n):
    """Fingerprints in a few dense balls with correlated bits, and random ones."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(3)]
    out = set()
    for _ in range(n):
        x = r.choice(centres)
        for b in r.sample(range(20 if r.random() < 0.7 else 64), r.randrange(6)):
            x ^= 1 << b
        out.add(x if r.random() < 0.8 else r.getrandbits(64))
    return sorted(out)


def brute_pairs(prints, radius):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return sorted(tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= radius)


@pytest.mark.parametrize(("radius", "many"), [(0, 1 << 20), (1, 1 << 20), (2, 1 << 20), (3, 1 << 20), (2, 100), (3, 400)])
def test_close_pairs_are_all_pairs_within_the_radius(spark, radius, many):
    prints = clustered(radius + many, 400)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    got = [(r["a"], r["b"]) for r in simhash.close_pairs(df, radius, many=many).collect()]
    assert sorted(got) == brute_pairs(prints, radius)


def test_every_plan_covers_the_radius_and_splits_unevenly_where_that_is_cheaper():
    r = np.random.default_rng(3)
    bits = r.integers(0, 2, (2000, 64))
    bits[:, 32:48] = bits[:, :1] ^ (r.random((2000, 16)) < 0.02)  # sixteen bits that say nearly the same
    for n, want in ((2000, None), (10**9, 2)):
        model = simhash.BitModel((bits.T @ bits) * (n // 2000), n)
        for radius in (1, 2, 3):
            plan = simhash.plan(model, list(range(64)), radius)
            assert sum(e for _, e in plan) == radius + 1
            used = [b for p, _ in plan for b in p]
            assert len(used) == len(set(used))
            if want and radius == 2:
                assert max(e for _, e in plan) >= want  # few long keys and flips, at that size
    chain = list(range(32, 48))
    assert model.within(chain, 2)[0] > 0.1 > 0.001 > model.within(list(range(16)), 2)[0]
    together = next(set(p) for p in model.parts(list(range(64)), 4) if 40 in p)
    assert len(together & {0, *range(32, 48)}) >= 15


CASES = [(1, "a\nb\nc"), (2, "a\nb\nc\n"), (3, "\n\n\n"), (4, "no break"), (5, ""), (6, None), (7, "has <S> inside\nx"), (8, "almost <P\n< P><\n"), (9, "é\nü\n" * 500), (9, "é\nü\n" * 500), (None, "no\nid\nat all"), (11, "<\n>\r\n\r<M\n>")]


def test_middles_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in CASES], "doc_id long, text string, form string")
    got = sorted((tuple(r) for r in fill_in_middle.restored(fill_in_middle.fill_in_middle(df)).collect()), key=repr)
    want = []
    for doc, text in CASES:
        text = text or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert "".join(units) == text
        n = len(units)
        h = [int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
            want.append((doc, n, "plain", None, None, text, text))
        elif h[3] % 100 < 50:
            want.append((doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text))
        else:
            want.append((doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text))
    assert got == sorted(want, key=repr)
    assert {"plain", "spm", "psm"} == {r[2] for r in got}
    assert fill_in_middle.fill_in_middle(df.where("false")).count() == 0


def test_middle_round_trip_of_other_units():
    how = Middle(unit=r"\S+\s*|\s+", prefix="[PRE]", suffix="[SUF]", middle="[MID]", rate=60)
    forms = set()
    for i, t in enumerate(["", "one", " two words", "[PRE", "[PRE][", "x [MID] y", "tail ]\n[" * 30] * 20):
        n, form, _, _, out = how.turn(i, t)
        forms.add(form)
        assert how.restore(out, form) == t and n == len(re.findall(how.unit, t))
    assert forms == {"plain", "psm", "spm"}
    for bad in ("", "<S>", "<S><", ">x"):
        with pytest.raises(ValueError, match="sentinel"):
            Middle(prefix=bad)
