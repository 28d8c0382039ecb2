"""Claims in comparable coordinates: entity, measure, period, basis and unit dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.basis import basis_tokens
from claimloom.functions.binding import let, squeeze
from claimloom.functions.labels import canonical_form, content_key, resolved_name, split_qualifiers
from claimloom.functions.period import parse_period
from claimloom.functions.quantity import parse_quantity
from claimloom.operators.resolve import resolve_entities, resolve_measures
from claimloom.session import keep


def vintage_date(raw: Column) -> Column:
    """A publication date; null unless a full ISO date is stated."""
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.left(raw, F.lit(10)), "yyyy-MM-dd"))


def frame_claims(claim: DataFrame, witness: DataFrame) -> DataFrame:
    """One row a claim with its resolved coordinates; repeated claims once.

    ``lemma_key`` names what a claim is about (canonical entity and content
    words of the measure), null where either is missing; ``frame_key`` adds
    period, basis and dimension.  A self-reference means the witness's
    publisher.  Qualifiers in the measure's name move to the basis.  A claim
    without its witness keeps null title and vintage.
    """
    about = witness.select("witness_id", F.col("title"), vintage_date(F.col("vintage_raw")).alias("vintage"), "publisher", "default_currency")
    # Witnesses are documents: far fewer than claims, but not bounded, so the planner decides how to join them.
    rows = claim.dropDuplicates(["claim_id"]).join(about, "witness_id", "left")
    # Periods repeat a few wordings over and over: each is read once, and the small result is joined back.
    worded = claim.select("period_raw").where("period_raw is not null").distinct()
    rows = rows.join(worded.select("period_raw", parse_period(F.col("period_raw")).alias("period")), "period_raw", "left")
    split = rows.withColumn("m", split_qualifiers(F.col("measure_raw"))).withColumn("q", parse_quantity(F.col("value_raw"), F.col("unit_raw"), F.col("default_currency")))
    quals = F.concat(F.coalesce("qualifiers", F.array().cast("array<string>")), F.coalesce("m.qualifiers", F.array().cast("array<string>")))
    named = split.select(
        "claim_id",
        "witness_id",
        "title",
        "vintage",
        "claim_type",
        "measure_raw",
        "value_raw",
        "unit_raw",
        "period_raw",
        "confidence",
        F.col("m.name").alias("measure_name"),
        resolved_name(F.col("entity_raw"), F.col("publisher")).alias("entity_name"),
        F.col("q.value").alias("value"),
        F.when(F.col("q").isNull(), F.nullif(F.trim("value_raw"), F.lit(""))).alias("value_text"),
        F.col("q.dimension").alias("unit_dim"),
        F.col("q.scale").alias("unit_scale"),
        "period",
        basis_tokens(F.col("basis_raw"), quals).alias("basis"),
    )
    return keyed(named.withColumn("entity_key", entity_key(F.col("entity_name"))).withColumn("measure_key", measure_key(F.col("measure_name"))))


def entity_key(name: Column) -> Column:
    return F.nullif(canonical_form(name), F.lit(""))


def measure_key(name: Column) -> Column:
    return F.nullif(F.array_join(content_key(name), " "), F.lit(""))


def keyed(named: DataFrame) -> DataFrame:
    """The claims with ``lemma_key`` and ``frame_key`` of their entity and measure keys."""
    return named.withColumn("lemma_key", lemma_key(F.col("entity_key"), F.col("measure_key"))).withColumn("frame_key", frame_key(F.col("entity_key"), F.col("measure_key"), F.col("period"), F.col("basis"), F.col("unit_dim")))


def resolve_frames(framed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames whose names are resolved against all others, and the measures they lead to (``measure_key, wording``).

    Entities of nearly one spelling and measures of nearly one meaning share
    the key of the first of them, in order of witness and claim; the lemma
    and frame keys follow.  Names that key nothing stay without a key.
    """
    entities = resolve_entities(framed, "entity_name", ["witness_id", "claim_id"])
    measures = resolve_measures(framed, "measure_name", ["witness_id", "claim_id"])
    entity = entities.select(F.col("phrase").alias("_e"), entity_key(F.col("entity")).alias("_entity"))
    measure = keep(measures.select(F.col("phrase").alias("_m"), measure_key(F.col("measure")).alias("_measure"), F.col("measure").alias("wording")), "measures")
    met = framed.withColumn("_e", F.lower("entity_name")).withColumn("_m", F.lower("measure_name")).join(entity, "_e", "left").join(measure.drop("wording"), "_m", "left")
    named = met.withColumn("entity_key", F.coalesce("_entity", "entity_key")).withColumn("measure_key", F.coalesce("_measure", "measure_key")).drop("_e", "_m", "_entity", "_measure")
    leading = measure.where("_measure is not null").groupBy(F.col("_measure").alias("measure_key")).agg(F.min("wording").alias("wording"))
    return keyed(named).select(framed.columns), leading


def lemma_key(entity: Column, measure: Column) -> Column:
    return F.when(entity.isNotNull() & measure.isNotNull(), F.concat(entity, F.lit(":"), measure))


def frame_key(entity: Column, measure: Column, period: Column, basis: Column, dimension: Column) -> Column:
    """The lemma and its coordinates as one string; the grain of the period is no part of it."""
    span = F.coalesce(F.concat(period["start"].cast("string"), F.lit(".."), period["end"].cast("string")), F.lit("none"))
    tokens = F.coalesce(F.nullif(F.array_join(basis, ","), F.lit("")), F.lit("none"))
    return F.concat_ws("|", lemma_key(entity, measure), span, tokens, F.coalesce(dimension, F.lit("none")))


def unframed(claim: DataFrame, framed: DataFrame) -> DataFrame:
    """Claims that have no frame yet: what an incremental run must resolve."""
    return claim.join(framed.where("frame_key is not null").select("claim_id").distinct(), "claim_id", "left_anti")


def claim_counts(framed: DataFrame, key: str) -> DataFrame:
    """``(key, n_claims)``, derived from the claims and so never counted twice."""
    return framed.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct("claim_id").alias("n_claims"))


def neat(text: Column) -> Column:
    """Lower-case text without extra blanks, for comparing raw cells."""
    return let(F.lower(squeeze(F.coalesce(text, F.lit("")))), lambda t: t)
