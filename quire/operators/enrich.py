"""Answers of a model with a deterministic rule beneath.

An enricher maps batches of rows (key, text) to answers.  It runs on executors in ``mapInPandas``; where there is none, where it fails or
is late, or where it answers nothing, the rule's answer stands.  Models are not part of the library: an enricher is any callable.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Given a batch of texts, their answers in order (None: no answer).
Enricher = Callable[[list[str]], list[str | None]]


def enrich(rows: DataFrame, key: str, text: str, rule: Column, model: Enricher | None = None, seconds: float = 60.0) -> DataFrame:
    """``rows`` with ``answer`` and ``answered_by`` ("model" or "rule").

    ``seconds`` is what one task's calls may take in all: after that its other rows take the rule's answer.  A batch whose call
    raises takes the rule's answer too, so a lost model server never loses rows."""
    ruled = rows.withColumn("rule_answer", rule)
    if model is None:
        return ruled.withColumn("answer", F.col("rule_answer")).withColumn("answered_by", F.lit("rule")).drop("rule_answer")
    kind = dict(rows.dtypes)[key]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        began = time.monotonic()
        for b in batches:
            answers: list[str | None] = [None] * len(b)
            if time.monotonic() - began < seconds:
                try:
                    answers = list(model(b["text"].tolist()))
                except Exception:  # a failing model is no failing job
                    answers = [None] * len(b)
            yield pd.DataFrame({"model_key": b["key"], "model_answer": answers})

    asked = rows.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("text <> ''").dropDuplicates(["key"])
    said = asked.mapInPandas(ask, f"model_key {kind}, model_answer string").where("model_answer <> ''")
    met = ruled.join(said, F.col(key) == F.col("model_key"), "left")
    by = F.when(F.col("model_answer").isNotNull(), "model").otherwise("rule")
    return met.withColumn("answer", F.coalesce("model_answer", "rule_answer")).withColumn("answered_by", by).drop("model_key", "model_answer", "rule_answer")


def document_class(aspect: Column, answer: Column | None = None, sure: Column | None = None, least: float = 0.7) -> Column:
    """Slide or form: a model's answer that is sure enough, else slide where the page is wider than 1.2 times its height."""
    rule = F.when(aspect > 1.2, "slide").otherwise("form")
    return rule if answer is None else F.when(sure >= least, answer).otherwise(rule)


def image_summary(known: Column, kind: Column, label: Column) -> Column:
    """A summary that is known by the picture's hash, else a sentence of its kind and label."""
    return F.coalesce(known, F.concat(F.lit("An "), kind, F.lit(" element"), F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit(" with the text '"), label, F.lit("'"))).otherwise(""), F.lit(".")))
