"""Every query that has SQL against DuckDB over the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from quire.operators import classify, layout, ocr, pagefacts, spatial
from quire.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def page(spark, *rows):
    cols = "document_id long, slide_number long, element_id string, ord long, element_type string, x double, y double, width double, height double, text string, z_order long, begin_x double, begin_y double, end_x double, end_y double"
    return spark.createDataFrame([(1, 1, *r, None, None, None, None) for r in rows], cols)


def test_equal_boxes_make_no_cycle(spark):
    e = page(spark, ("a", 1, "shape", 0.0, 0.0, 10.0, 10.0, "", 0), ("b", 2, "shape", 0.0, 0.0, 10.0, 10.0, "", 0))
    assert {r["element_id"]: r["parent_id"] for r in spatial.smallest_container(e).collect()} == {"a": None, "b": "a"}


def test_first_anchor_pairs_the_first_box_only(spark):
    e = page(spark, *((i, k, "shape", 0.0, 100.0 * k, 10.0, 10.0, "", 0) for k, i in enumerate("abc")))
    assert spatial.relationship_edges(e).count() == 3
    assert {r["source_element_id"] for r in spatial.relationship_edges(e, anchor="first").collect()} == {"a"}


def test_empty_page_set(spark):
    e = page(spark, ("a", 1, "shape", 0.0, 0.0, 1.0, 1.0, "", 0)).where("false")
    for op in (pagefacts.full_inventory, layout.row_islands, layout.gap_splits, spatial.relationship_edges, spatial.nearest_neighbours, spatial.connector_targets):
        assert op(e).count() == 0


def test_currency_repair(spark):
    want = {
        "Solution": "Solution", "So": "So", "note": "note", "5295,000": "$295,000", "S305,000": "$305,000", "8720,000": "$720,000", "Ss00,000": "$600,000", "$40,0C0": "$40,000", "$70,000_$100,000": "$70,000 – $100,000",
        "S1,595,000": "$1,595,000", "572, 0o0": "$72,000", "S1o5": "$105", "55,000": "$5,000",
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r["t"]: r["r"] for r in df.select("t", ocr.currency_repair(df.t).alias("r")).collect()} == want


def test_every_document_meets_every_item(spark, tmp_path):
    texts = ["red green blue", "one two", "Red one", ""]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(90, "one two"), (91, "blue red green")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["item_id"], r["similarity"]) for r in registry.QUERIES["text_similarity"](spark, str(tmp_path)).collect()}
    assert got == {0: (91, 1), 1: (90, 1), 2: (90, 0.5), 3: (90, 0)}


def test_complexity_has_all_three_classes(spark):
    rows = [(1, p, f"{p}-{k}") for p, n in ((1, 3), (2, 8), (3, 9), (4, 2)) for k in range(n)]
    e = spark.createDataFrame(rows, "document_id long, slide_number long, element_id string")
    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 4)], "document_id long, slide_number long")
    got = {r["slide_number"]: (r["n_elements"], r["n_edges"], r["complexity"]) for r in classify.complexity(e, edges).collect()}
    assert got == {1: (3, 0, "low"), 2: (8, 2, "medium"), 3: (9, 0, "high"), 4: (2, 1, "medium")}


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
