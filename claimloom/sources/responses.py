"""A cache of provider responses, keyed by what was asked and not by who answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "request_key string, response string"


def request_key(purpose: Column, system: Column, user: Column, schema: Column) -> Column:
    blank = F.lit("")
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(c, blank) for c in (purpose, system, user, schema)]), 256)


def split_cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their cached response, and those that must be asked (each key once).

    A cached response that is no JSON counts as missing.
    """
    sound = cache.where(F.try_parse_json("response").isNotNull()).groupBy("request_key").agg(F.min("response").alias("response"))
    hits = requests.join(sound, "request_key")
    misses = requests.join(sound, "request_key", "left_anti").dropDuplicates(["request_key"])
    return hits, misses


def call_summary(calls: DataFrame) -> DataFrame:
    """``purpose, calls, hits, tokens, mean_ms`` of a call log ``purpose, cache_hit, tokens, latency_ms``."""
    return calls.groupBy("purpose").agg(F.count("*").alias("calls"), F.count_if("cache_hit").alias("hits"), F.sum("tokens").alias("tokens"), F.round(F.avg("latency_ms"), 1).alias("mean_ms"))
