"""Queries of the general operators for training data that live in the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.units import common_units, read_quantities, resolve_notations
from claimloom.session import keep
from claimloom.sources.tables import table


def _p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return common_units(table(spark, folder, "claim"))


def _p1_notations(spark: SparkSession, folder: str) -> DataFrame:
    """What each notation means, and how that was found out."""
    return resolve_notations(keep(read_quantities(table(spark, folder, "claim")), "readings"))[0]


def _p1_scales(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of notations that record the same subjects, with their ratio, offset and scatter."""
    links = resolve_notations(keep(read_quantities(table(spark, folder, "claim")), "readings"))[1]
    return links.select("a", "b", "shared", *[F.round(c, 6).alias(c) for c in ("ratio", "scatter", "offset")])


QUERIES = {"p1_found": _p1_found, "p1_notations": _p1_notations, "p1_scales": _p1_scales}
SQL: dict[str, str] = {}
