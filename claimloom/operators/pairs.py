"""Pairs of claims that discuss the same subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.session import keep

#: The columns a rule looks at; everything else stays out of the join.
SIDE = ["claim_id", "witness_id", "title", "vintage", "claim_type", "measure_raw", "value", "value_text", "unit_dim", "unit_raw", "value_raw", "period", "period_raw", "basis", "confidence"]


def _sides(framed: DataFrame) -> DataFrame:
    held = framed.where(F.col("lemma_key").isNotNull())
    return held.select("lemma_key", F.col("claim_id").alias("id"), F.col("witness_id").alias("w"), F.col("period.start").alias("starts"), F.struct(*SIDE).alias("side"))


def _two(rows: DataFrame, others: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    a = rows.select("lemma_key", F.col("id").alias("a_id"), F.col("w").alias("a_w"), F.col("starts").alias("a_starts"), F.col("side").alias("a"))
    b = (rows if others is None else others).select("lemma_key", F.col("id").alias("b_id"), F.col("w").alias("b_w"), F.col("starts").alias("b_starts"), F.col("side").alias("b"))
    return a, b


_LATER = "a_id < b_id"
_COMPARABLE = "(a_w <> b_w) or (a_starts <=> b_starts)"


def lemma_pairs(framed: DataFrame) -> DataFrame:
    """``(lemma_key, a, b)``: every two claims of a lemma, the smaller id first.

    Claims of one witness are paired only where their periods start together.
    This is every pair; ``capped_lemma_pairs`` is what large tables need.
    """
    a, b = _two(_sides(framed))
    return a.join(b, "lemma_key").where(_LATER).where(_COMPARABLE).select("lemma_key", "a", "b")


def capped_lemma_pairs(framed: DataFrame, most: int = 400) -> DataFrame:
    """The first ``most`` pairs of each lemma, in order of the two ids.

    The pairs of a large lemma are never all formed.  Only its first
    ``most + 1`` claims can open a pair, unless one of these opens none; then
    all later claims come from one witness, and their pairs are found by
    witness and period.
    """
    # Kept, for it is read several times and costs all the parsing.
    rows = keep(_sides(framed), "sides")
    by_lemma = W.partitionBy("lemma_key").orderBy("id")
    openers = rows.withColumn("nth", F.row_number().over(by_lemma)).where(F.col("nth") <= most + 1).drop("nth")
    a, b = _two(openers, rows)
    early = a.join(b, "lemma_key").where(_LATER).where(_COMPARABLE)
    first = W.partitionBy("lemma_key").orderBy("a_id", "b_id")
    early = early.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most)
    last_opener = openers.groupBy("lemma_key").agg(F.max("id").alias("last"), F.count("*").alias("n")).where(F.col("n") > most)
    filled = early.groupBy("lemma_key").agg(F.count("*").alias("got")).where(F.col("got") == most).select("lemma_key")
    short = last_opener.join(filled, "lemma_key", "left_anti").select("lemma_key", "last")
    tail = rows.join(short, "lemma_key").where(F.col("id") > F.col("last"))
    ta, tb = _two(tail)
    late = ta.join(tb, (ta["lemma_key"] == tb["lemma_key"]) & (ta["a_w"] == tb["b_w"]) & ta["a_starts"].eqNullSafe(tb["b_starts"])).where(_LATER).select(ta["lemma_key"], "a_id", "b_id", "a", "b")
    both = early.select("lemma_key", "a_id", "b_id", "a", "b").unionByName(late)
    return both.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most).select("lemma_key", "a", "b")


def neighbour_pairs(framed: DataFrame, near: DataFrame) -> DataFrame:
    """``(lemma_key, a, b, score)``: claims of neighbouring measures about one entity and period, from different witnesses.

    ``near`` has ``measure_a < measure_b`` and ``score``.  The lemma key joins
    both lemmas; the side of the smaller measure key comes first.
    """
    held = framed.where(F.col("lemma_key").isNotNull()).select("entity_key", "measure_key", "lemma_key", F.col("witness_id").alias("w"), F.col("period.start").alias("starts"), F.struct(*SIDE).alias("side"))
    left = held.select("entity_key", F.col("measure_key").alias("measure_a"), F.col("lemma_key").alias("la"), F.col("w").alias("wa"), F.col("starts").alias("sa"), F.col("side").alias("a"))
    right = held.select("entity_key", F.col("measure_key").alias("measure_b"), F.col("lemma_key").alias("lb"), F.col("w").alias("wb"), F.col("starts").alias("sb"), F.col("side").alias("b"))
    joined = near.join(left, "measure_a").join(right, ["entity_key", "measure_b"]).where("wa <> wb and sa <=> sb")
    return joined.select(F.concat_ws("~", "la", "lb").alias("lemma_key"), "a", "b", "score")
