"""Tables that grow by insertion, kept consistent by anti-joins and rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Child tables of a witness and of a claim, and the columns that only lose their value.
CHILDREN = {"page": "witness_id", "block": "witness_id", "passage": "witness_id", "claim": "witness_id", "quarantine": "witness_id", "run_log": "witness_id"}
CLAIM_CHILDREN = {"anchor": ["claim_id"], "verdict": ["claim_a", "claim_b"]}


def insert_or_ignore(existing: DataFrame, fresh: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of ``fresh`` whose keys are new; of rows with equal keys the first in ``order`` (default: all columns).

    Null keys equal each other.
    """
    rank = W.partitionBy(*keys).orderBy(*(order or [F.col(c) for c in fresh.columns if c not in keys] or [F.lit(1)]))
    once = fresh.withColumn("_nth", F.row_number().over(rank)).where("_nth = 1").drop("_nth")
    there = existing.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [once[k].eqNullSafe(there[f"_{k}"]) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return once.join(there, condition, "left_anti")


def store_verdicts(existing: DataFrame, ruled: DataFrame, drift: DataFrame) -> DataFrame:
    """New verdicts, one for each unordered pair; a lemma's ruling wins over a neighbour's, the smaller rule id over the larger."""
    both = ruled.withColumn("_rank", F.lit(0)).unionByName(drift.withColumn("_rank", F.lit(1)))
    turned = both.withColumn("_lo", F.least("claim_a", "claim_b")).withColumn("_hi", F.greatest("claim_a", "claim_b")).drop("claim_a", "claim_b").withColumnsRenamed({"_lo": "claim_a", "_hi": "claim_b"})
    there = existing.select(F.least("claim_a", "claim_b").alias("claim_a"), F.greatest("claim_a", "claim_b").alias("claim_b"))
    return insert_or_ignore(there, turned, ["claim_a", "claim_b"], [F.col("_rank"), F.col("rule_id"), F.col("lemma_key")]).drop("_rank")


def number_rows(rows: DataFrame, order: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """Consecutive numbers, the same on every run: by a hash of ``order``, then by ``order`` itself.

    Buckets of the hash are counted first, so no task sees the whole table.
    Rows that are equal in ``order`` are numbered in any order among themselves.
    """
    parts = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(1 << 16)))
    counts = parts.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(F.lit(1)).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # at most 65,536 rows
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(W.partitionBy("_bucket").orderBy(*order))
    return parts.withColumn("_nth", nth).join(starts, "_bucket").withColumn(name, F.col("_start") + F.col("_nth") + (start - 1)).drop("_bucket", "_nth", "_start")


def delete_witnesses(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the witnesses in ``gone`` (a column ``witness_id``) and what depends on them.

    References that may be empty (``measure.first_seen_in``,
    ``claim.passage_id``) become null instead.
    """
    ids = gone.select("witness_id").distinct()
    out = dict(tables)
    out["witness"] = tables["witness"].join(ids, "witness_id", "left_anti")
    for name, key in CHILDREN.items():
        if name in tables:
            out[name] = tables[name].join(ids, key, "left_anti")
    if "claim" in tables:
        kept = out["claim"].select("claim_id").distinct()
        for name, keys in CLAIM_CHILDREN.items():
            if name in tables:
                for key in keys:
                    out[name] = out[name].join(kept.withColumnRenamed("claim_id", key), key, "left_semi")
        if "passage" in out and "passage_id" in out["passage"].columns:
            there = out["passage"].select("passage_id").distinct().withColumn("_kept", F.lit(True))
            out["claim"] = out["claim"].join(there, "passage_id", "left").withColumn("passage_id", F.when(F.col("_kept"), F.col("passage_id"))).drop("_kept")
    if "measure" in tables:
        lost = ids.select(F.col("witness_id").alias("first_seen_in"), F.lit(True).alias("_lost"))
        out["measure"] = tables["measure"].join(lost, "first_seen_in", "left").withColumn("first_seen_in", F.when(F.col("_lost").isNull(), F.col("first_seen_in"))).drop("_lost")
    return out


def json_or(text: Column, schema: str, default: Column) -> Column:
    """Decoded JSON, or the default where it is empty or malformed."""
    return F.coalesce(F.from_json(F.nullif(F.trim(text), F.lit("")), schema, {"mode": "PERMISSIVE"}), default)


def new_content(rows: DataFrame, known: DataFrame, content: str, key: str) -> DataFrame:
    """``(sha256, key)`` of content that ``known`` (a column ``sha256``) lacks; of equal content the smallest key."""
    hashed = rows.where(F.col(content).isNotNull()).select(F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.col(key))
    first = hashed.groupBy("sha256").agg(F.min(key).alias(key))
    return first.join(known.select("sha256").distinct(), "sha256", "left_anti")
