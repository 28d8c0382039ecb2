"""Scoring texts for abusive, hateful or sexually explicit language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.machine import Machine, Scorer, learn
from claimloom.llm.mixing import source_key

#: Labelled documents that a machine is fitted on at most; every document is scored all the same.
LABELLED = 20_000


def fit_abuse(documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> Machine:
    """A machine fitted on the labelled documents, at most ``most`` of them (the first in order of a hash).

    A document marked several times has its marks averaged; an even split, a
    null mark or a document without a row in ``documents`` counts for nothing.
    The fit needs cases and other texts; without either, nothing is found.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("mark")).where("mark != 0.5")
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").join(marks, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("mark").alias("mark")).toPandas().sort_values("doc_id")
    return learn([t if isinstance(t, str) else None for t in rows["text"]], (rows["mark"].to_numpy(float) > 0.5).astype(int))


def score_abuse(documents: DataFrame, machine: Machine) -> DataFrame:
    """``(doc_id, score, found)``: the score in [0, 1] of every document, 0 for null and empty texts.

    The whole text is scored, in windows; the score is that of its worst
    window.  ``found`` says whether it reaches the machine's threshold.  A
    repeated ``doc_id`` counts once, with its highest score; a null one is
    kept as a row of its own; extra columns play no part.
    """
    # The machine's size is fixed: BUCKETS x (RANK + 1) numbers.
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            raw = scorer.scores([t if isinstance(t, str) else None for t in batch["text"]])
            score = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": np.where(np.isfinite(raw), score, 0.0), "found": raw >= scorer.machine.threshold})

    scored = documents.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, found boolean")
    return scored.groupBy("doc_id").agg(F.max("score").alias("score"), F.max("found").alias("found"))


def abuse_rates(documents: DataFrame, scored: DataFrame) -> DataFrame:
    """``(source, n_docs, n_found, rate, mean_score)`` of each source, trimmed and lower-cased; documents without one form a row of their own."""
    of = documents.select("doc_id", source_key(F.col("source")).alias("source")).groupBy("doc_id").agg(F.min("source").alias("source"))
    joined = of.join(scored, of["doc_id"].eqNullSafe(scored["doc_id"])).select("source", "score", F.col("found").cast("int").alias("hit"))
    return joined.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("hit").alias("n_found"), F.round(F.avg("hit"), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
