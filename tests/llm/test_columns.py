"""Stages give other columns back as they were, whatever their names; wide candidates pass the checks of their kind."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.llm import decontamination, near_duplicates, pii, quality

SF = "/root/testdata/sf0.001"
CLASHES = ["score", "predicted", "items", "n_hit", "spans", "n_words", "contaminated", "longest", "row", "t", "k", "c", "mine", "base", "kind", "fp", "cls", "keep", "a.b", "__t", "N_HIT2"]


@pytest.mark.parametrize("stage", ["quality", "near", "benchmark", "pii"])
def test_other_columns_pass_untouched(spark, stage):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    plain = read("documents").where("doc_id < 60")
    docs = plain.select("*", *(F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES))
    if stage == "quality":
        model = quality.train_quality(read("documents"), read("labels"))
        out = quality.accepted(docs, model)
        want = {r["doc_id"] for r in quality.score_quality(plain, model).where("predicted = 1").collect()}
    elif stage == "near":
        out, want = near_duplicates.distinct_documents(docs), {r["doc_id"] for r in near_duplicates.distinct_documents(plain).collect()}
    elif stage == "benchmark":
        out, want = decontamination.decontaminate(docs, read("benchmark")), {r["doc_id"] for r in decontamination.find_contamination(plain, read("benchmark")).where("not contaminated").collect()}
    else:
        out, want = pii.redact(docs), {r["doc_id"] for r in plain.collect()}
    assert out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == want and want
    assert all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in CLASHES)


def test_wide_candidates_that_are_none(spark):
    texts = ["We have lunch (at) noon. Then we walk home.", "999[.]999[.]999[.]999", "serial 123 456 7890 stock", "mail joe (at) site (dot) org or ann[at]b.net", "host 10[.]0[.]0[.]7", "call (523) 555-1055 now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sure = pii.Trees()
    sure.thresholds = [0.0] * 4
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] for r in pii.find_spans(docs, sure).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["joe (at) site (dot) org", "ann[at]b.net"], 4: ["10[.]0[.]0[.]7"], 5: ["(523) 555-1055"]}
