"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.llm.tokens import count_tokens
from claimloom.session import keep

#: A source is cut into at most this many pieces for each class of size, so no task ever holds a whole source.
SLICES = 64


def source_key(source: Column) -> Column:
    """The source, trimmed of any white space and lower-cased."""
    return F.regexp_replace(F.lower(source), r"(?U)^\s+|\s+$", "")


def plan_shares(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Each target source's available tokens, planned tokens and expected copies of each of its records.

    ``sizes`` has ``source, n_docs, tokens``; ``targets`` has ``source,
    target_share, max_repeats`` (one row a source, so a handful of rows).
    Without ``total_tokens`` the total is the largest at which every source
    that has tokens still reaches its exact share within its cap.  With it,
    sources that hit their cap give all they can and the rest is shared among
    the others in proportion to their targets.  Sources without tokens plan 0
    and the other shares are scaled up to sum to 1.
    """
    known = targets.join(sizes, "source", "left").select(
        "source",
        "target_share",
        F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("tokens", F.lit(0)).alias("available_tokens"),
    )
    usable = (F.col("available_tokens") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    known = known.withColumn("most", F.when(usable, F.col("available_tokens") * F.col("max_repeats")).otherwise(F.lit(0)).cast("double"))
    known = known.withColumn("share", F.when(usable, F.col("target_share")).otherwise(F.lit(0.0)))
    everything = W.partitionBy(F.lit(1))  # over the target table: one row a source
    known = known.withColumn("share", F.col("share") / F.nullif(F.sum("share").over(everything), F.lit(0.0)))
    if total_tokens is None:
        total = F.min(F.when(F.col("share") > 0, F.col("most") / F.col("share"))).over(everything)
        planned = F.coalesce(F.least(total * F.col("share"), F.col("most")), F.lit(0.0))
    else:
        # Sorted by most / share, the sources before some point are capped; the level is the budget left over for the rest, per share.
        order = everything.orderBy("ratio", "source")
        known = known.withColumn("ratio", F.when(F.col("share") > 0, F.col("most") / F.col("share")).otherwise(F.lit(0.0)))
        before = order.rowsBetween(W.unboundedPreceding, -1)
        onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
        level = (F.lit(float(total_tokens)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.nullif(F.sum("share").over(onward), F.lit(0.0))
        known = known.withColumn("level", level)
        open_level = F.max(F.when((F.col("share") > 0) & (F.col("level") <= F.col("ratio")), F.col("level"))).over(everything)
        planned = F.coalesce(F.least(F.col("most"), open_level * F.col("share")), F.col("most"))
    known = known.withColumn("planned_tokens", planned)
    copies = F.when(F.col("available_tokens") > 0, F.col("planned_tokens") / F.col("available_tokens")).otherwise(F.lit(0.0))
    return known.select("source", "target_share", "max_repeats", "n_docs", "available_tokens", "planned_tokens", F.least(copies, F.col("max_repeats").cast("double")).alias("copies"))


def _unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts only."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _sized(documents: DataFrame, vocabulary: str | None) -> DataFrame:
    """One row a document: ``doc_id, source, n_tokens``, kept as a table, for the texts must be encoded only once."""
    docs = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").where(F.col("doc_id").isNotNull())
    sized = count_tokens(docs, ["doc_id", "source"], vocabulary=vocabulary)
    return keep(sized.groupBy("doc_id").agg(F.min_by("source", F.struct("n_tokens", "source")).alias("source"), F.min("n_tokens").alias("n_tokens")), "sizes")


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture ``(doc_id, source, copy, n_tokens)`` and the report of shares.

    ``copy`` counts a document's occurrences from 1; no document occurs more
    often than its source's ``max_repeats``.  Documents without tokens (null
    or empty text), and those whose source is null or has no target, are never
    drawn; the report lists the latter's tokens nowhere, for they have no
    target.  A ``doc_id`` that occurs twice counts once (its smaller size);
    rows with a null ``doc_id`` are ignored; extra columns play no part.  A
    target whose source is repeated counts once (its largest share).  Empty
    inputs give an empty mixture and shares of 0.

    Systematic sampling: within a source the documents stand in order of a
    size class and a hash; the running sum of expected copies, shifted by one
    random offset, crosses as many integers as the document has copies.  The
    order by size makes the token totals as exact as the copies.  The running
    sum comes from counts of (source, size class, slice) plus a rank within
    one slice, so a source that holds most documents is still spread out.
    """
    sized = _sized(documents, vocabulary)
    wanted = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), "max_repeats").where(F.col("source").isNotNull())
    wanted = wanted.groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    totals = sized.where("source is not null and n_tokens > 0").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    plan = keep(plan_shares(totals, wanted, total_tokens), "shares")

    rank = F.xxhash64(F.lit(seed), "doc_id")
    drawn = (
        sized.where("n_tokens > 0")
        .join(plan.where("copies > 0").select("source", "copies"), "source")
        .withColumn("size_class", F.floor(4 * F.log2(F.col("n_tokens").cast("double"))).cast("int"))
        .withColumn("h", rank)
        .withColumn("slice", F.pmod(F.shiftright("h", 48), F.lit(SLICES)).cast("int"))
    )
    # At most sources x size classes x SLICES rows, whatever the number of documents.
    counts = drawn.groupBy("source", "size_class", "slice").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("source").orderBy("size_class", "slice").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("source", "size_class", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = W.partitionBy("source", "size_class", "slice").orderBy("h", "doc_id")
    placed = drawn.withColumn("at", F.row_number().over(within)).join(starts, ["source", "size_class", "slice"])
    upto = (F.col("start") + F.col("at")) * F.col("copies") + _unit(seed, F.col("source"))
    since = (F.col("start") + F.col("at") - 1) * F.col("copies") + _unit(seed, F.col("source"))
    crossed = (F.floor(upto) - F.floor(since)).cast("int")
    mixture = placed.withColumn("times", crossed).where("times > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"), "n_tokens")
    mixture = keep(mixture, "mixture")

    reached = mixture.groupBy("source").agg(F.count("*").alias("drawn"), F.countDistinct("doc_id").alias("distinct_docs"), F.max("copy").alias("most_copies"), F.sum("n_tokens").alias("tokens"))
    everything = W.partitionBy(F.lit(1))  # one row a source
    report = plan.join(reached, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        "n_docs",
        "available_tokens",
        F.coalesce("drawn", F.lit(0)).alias("drawn"),
        F.coalesce("distinct_docs", F.lit(0)).alias("distinct_docs"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
    )
    whole = F.sum("tokens").over(everything)
    return mixture, report.withColumn("reached_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0)))
