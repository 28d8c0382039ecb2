"""Consolidating pairwise matches into groups by randomised graph contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.session import forget, keep


def _hash(vertex: Column, seed: int) -> Column:
    return F.xxhash64(vertex, F.lit(seed))


def group_pairs(pairs: DataFrame, left: str, right: str, member: str = "member", group: str = "group_id", seed: int = 20) -> DataFrame:
    """One row per record that is linked to another: ``(member, group)``.

    ``group`` is the smallest member of the connected component.  Rows with a
    null end or both ends equal link nothing; repeated and reversed rows count
    once; other columns are ignored, whatever their names; without links the
    result is empty.  The ends may be integers or strings (smallest then means
    first in byte order).

    Each round every vertex hooks to the member of its closed neighbourhood
    that comes first in the order of a fresh hash, the edges are relabelled
    and deduplicated, and the round's mapping is kept as a table in the shared
    folder.  A round leaves at most three quarters of the vertices on average,
    so the number of rounds is logarithmic whatever the diameter.  The
    neighbourhood minimum is combined before the shuffle, so a hub costs one
    row per task; nothing but the table sizes reaches the driver.
    """
    both = pairs.select(F.col(left).alias("u"), F.col(right).alias("v"))
    edges = keep(
        both.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
        "edges",
    )
    mappings: list[DataFrame] = []
    while not edges.isEmpty():
        fresh = seed + len(mappings)
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.x", "e.y")
        first = ends.groupBy("x").agg(F.min(F.struct(_hash(F.col("y"), fresh).alias("h"), F.col("y").alias("y"))).alias("m"))
        own = F.struct(_hash(F.col("x"), fresh).alias("h"), F.col("x").alias("y"))
        hooked = keep(first.select("x", F.least(own, F.col("m"))["y"].alias("rep")), "hooks")
        mappings.append(hooked)
        to_u, to_v = (hooked.select(F.col("x").alias(c), F.col("rep").alias(f"r{c}")) for c in "uv")
        contracted = edges.join(to_u, "u").join(to_v, "v").where(F.col("ru") != F.col("rv")).select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        contracted = keep(contracted, "edges")
        forget(edges)
        edges = contracted
    if not mappings:
        return edges.select(F.col("u").alias(member), F.col("v").alias(group))
    final = mappings[-1]
    for earlier in reversed(mappings[:-1]):
        onward = final.select(F.col("x").alias("rep"), F.col("rep").alias("next"))
        # Each step is kept, so that the plan does not grow with the rounds.
        expanded = keep(earlier.join(onward, "rep", "left").select("x", F.coalesce("next", "rep").alias("rep")), "labels")
        forget(final, earlier)
        final = expanded
    smallest = final.groupBy("rep").agg(F.min("x").alias("least"))
    return final.join(smallest, "rep").select(F.col("x").alias(member), F.col("least").alias(group))


def corroboration_groups(verdict: DataFrame) -> DataFrame:
    """``(claim_id, group_id)`` of every claim that some verdict row, trimmed and lower-cased ``corroborates``, links.

    White space of any kind around the word is ignored; a null or other
    verdict neither links nor unlinks.
    """
    said = F.regexp_replace(F.lower(F.col("verdict")), r"(?U)^\s+|\s+$", "")
    return group_pairs(verdict.where(said == "corroborates"), "claim_a", "claim_b", member="claim_id")
