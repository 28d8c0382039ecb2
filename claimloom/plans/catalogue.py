"""All queries outside the optional subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimloom.plans import claims, general, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**general.QUERIES, **claims.QUERIES, **texts.QUERIES}
SQL: dict[str, str] = {**general.SQL, **claims.SQL, **texts.SQL}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Claims framed, paired by what they are about, and every pair ruled on."""
    return claims.rulings_by_rule(spark, folder)
