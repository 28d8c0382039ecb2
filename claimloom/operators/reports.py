"""Reporting queries over claims, verdicts and witnesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.functions.labels import short_label
from claimloom.operators.frames import neat
from claimloom.session import keep

# Rules in the order in which a report looks for an example that context explains.
EXPLAINED = ["VINTAGE_REVISION", "RESTATEMENT", "BASIS_MISMATCH", "ADJUSTMENT_MISMATCH", "PERIOD_NESTED", "DEFINITION_DRIFT", "PERIOD_DISJOINT"]
WRITTEN_TWICE = ["UNIT_SCALE", "ROUNDING", "EXACT"]

# Rows that a page or export shows.
LEMMAS, QUARANTINED, EXPORTED, ESCALATED = 400, 200, 2000, 40


def verdict_kind(verdict: Column) -> Column:
    """A stored verdict, whatever its case and the blanks around it."""
    return F.regexp_replace(F.lower(verdict), r"(?U)^\s+|\s+$", "")


def with_claims(verdict: DataFrame, claim: DataFrame, columns: list[str]) -> DataFrame:
    """The verdicts beside ``columns`` of both claims, prefixed ``a_`` and ``b_``."""
    once = claim.dropDuplicates(["claim_id"])
    side = lambda s: once.select(F.col("claim_id").alias(f"claim_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    return verdict.join(side("a"), "claim_a").join(side("b"), "claim_b")


def verdict_details(verdict: DataFrame, claim: DataFrame, witness: DataFrame, anchor: DataFrame | None = None) -> DataFrame:
    """Every verdict with both claims and witnesses, and the anchors of those claims that have one."""
    both = with_claims(verdict, claim, ["witness_id", "measure_raw", "value_raw", "unit_raw", "period_raw", "claim_type"])
    for s in "ab":
        about = witness.select(F.col("witness_id").alias(f"{s}_witness_id"), F.col("title").alias(f"{s}_title"), F.col("vintage_date").alias(f"{s}_vintage"))
        both = both.join(about, f"{s}_witness_id")
        if anchor is not None:
            both = both.join(anchor.select(F.col("claim_id").alias(f"claim_{s}"), F.col("page_no").alias(f"{s}_page")), f"claim_{s}", "left")
    return both


def lemma_rows(framed: DataFrame, verdict: DataFrame, kind: str = "all", rule: str = "", search: str = "", most: int = LEMMAS) -> DataFrame:
    """Lemmas that have verdicts, the most discussed first.

    A verdict belongs to the lemma of its first claim.  ``kind`` and ``rule``
    keep lemmas with such a verdict; ``search`` keeps claims whose measure or
    entity contains it, in any letter case.
    """
    held = framed.where(F.col("lemma_key").isNotNull())
    of = held.select(F.col("claim_id").alias("claim_a"), "lemma_key").distinct()
    ruled = verdict.select("claim_a", "rule_id", verdict_kind(F.col("verdict")).alias("kind")).join(of, "claim_a")
    by_lemma = ruled.groupBy("lemma_key").agg(F.count("*").alias("verdicts"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    if search:
        like = "%" + search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        held = held.where(F.col("measure_raw").ilike(like) | F.col("entity_key").ilike(like))
    rolled = held.groupBy("lemma_key").agg(F.min("measure_raw").alias("measure"), F.max("entity_key").alias("entity"), F.count("*").alias("readings"), F.countDistinct("witness_id").alias("witnesses"))
    out = rolled.join(by_lemma, "lemma_key")
    if kind != "all":
        out = out.join(ruled.where(F.col("kind") == kind).select("lemma_key").distinct(), "lemma_key", "left_semi")
    if rule:
        out = out.join(ruled.where(F.col("rule_id") == rule).select("lemma_key").distinct(), "lemma_key", "left_semi")
    return out.orderBy(F.desc("witnesses"), F.desc("verdicts"), F.desc("readings"), "lemma_key").limit(most)


def highlights(verdict: DataFrame, claim: DataFrame, value: Column) -> DataFrame:
    """The most telling verdict of each rule.

    Two witnesses before one, different printed values and units before equal
    ones; then the closest agreement or the widest difference, the larger
    figure, the smaller id.  ``value`` is the numeric value of a claim row.
    """
    valued = claim.withColumn("number", value)
    both = with_claims(verdict, valued, ["witness_id", "measure_raw", "value_raw", "unit_raw", "number"])
    gap = F.abs(F.coalesce("divergence", F.lit(0.0)))
    telling = W.partitionBy("rule_id").orderBy(
        (F.col("a_witness_id") != F.col("b_witness_id")).desc(),
        (F.coalesce("a_value_raw", F.lit("")) != F.coalesce("b_value_raw", F.lit(""))).desc(),
        (neat(F.col("a_unit_raw")) != neat(F.col("b_unit_raw"))).desc(),
        F.when(verdict_kind(F.col("verdict")) == "corroborates", gap).otherwise(-gap),
        F.abs(F.coalesce("a_number", F.lit(0.0))).desc(),
        "verdict_id",
    )
    best = both.withColumn("nth", F.row_number().over(telling)).where("nth = 1")
    return best.select("rule_id", "verdict_id", F.col("a_measure_raw").alias("measure"), (F.col("a_witness_id") != F.col("b_witness_id")).alias("across"))


def example_cases(verdict: DataFrame, claim: DataFrame) -> DataFrame:
    """``case_no, verdict_id, rule_id, across``: the best corroboration, contradiction and explained difference.

    An example across two witnesses beats one within a witness; for explained
    differences the kind of explanation counts first.
    """
    both = with_claims(verdict, claim, ["witness_id", "value_raw", "claim_type"]).withColumn("kind", verdict_kind(F.col("verdict"))).withColumn("across", F.col("a_witness_id") != F.col("b_witness_id"))
    rank = lambda names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col("rule_id"))
    cases = [
        (1, (F.col("kind") == "corroborates") & F.col("rule_id").isin(WRITTEN_TWICE), [F.desc("across"), rank(WRITTEN_TWICE), F.length(F.coalesce("a_value_raw", F.lit(""))).desc()]),
        (2, (F.col("kind") == "contradicts") & (F.col("a_claim_type") == "quantity"), [F.desc("across"), F.coalesce("severity", F.lit(0.0)).desc(), F.coalesce("divergence", F.lit(0.0)).desc()]),
        (3, (F.col("kind") == "reconciled") & F.col("rule_id").isin(EXPLAINED), [rank(EXPLAINED), F.desc("across"), F.coalesce("divergence", F.lit(0.0)).desc()]),
    ]
    out = None
    for no, condition, order in cases:
        top = both.where(condition).orderBy(*order, "verdict_id").limit(1).select(F.lit(no).alias("case_no"), "verdict_id", "rule_id", "across")
        out = top if out is None else out.unionByName(top)
    return out


def verdict_rollup(verdict: DataFrame) -> DataFrame:
    """Counts by verdict and rule, with subtotals (null means all)."""
    kinds = verdict.select(verdict_kind(F.col("verdict")).alias("kind"), "rule_id")
    return kinds.rollup("kind", "rule_id").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def sparse_pages(page: DataFrame, witness: DataFrame) -> DataFrame:
    """Witnesses with sparse pages: how many of how many; repeated pages count once."""
    once = page.select("page_id", "witness_id", "is_sparse").distinct()
    per = once.groupBy("witness_id").agg(F.sum(F.col("is_sparse").cast("int")).alias("sparse"), F.count("*").alias("pages")).where("sparse > 0")
    return per.join(witness.select("witness_id", short_label(F.coalesce("title", "filename")).alias("label")), "witness_id")


def corpus_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """``name, n`` of the rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def rejection_rate(admitted: DataFrame, quarantined: DataFrame) -> DataFrame:
    """``admitted, rejected, rate``; the rate is null without any proposal."""
    a, q = admitted.agg(F.count("*").alias("admitted")), quarantined.agg(F.count("*").alias("rejected"))
    whole = F.col("admitted") + F.col("rejected")
    return a.crossJoin(q).withColumn("rate", F.round(F.col("rejected") / F.nullif(whole, F.lit(0)), 4))


def escalation_queue(verdict: DataFrame, noted: DataFrame | None = None, most: int = ESCALATED) -> DataFrame:
    """The gravest contradictions that have no note yet."""
    open_ = verdict.where(verdict_kind(F.col("verdict")) == "contradicts")
    if noted is not None:
        open_ = open_.join(noted.select("verdict_id"), "verdict_id", "left_anti")
    return open_.orderBy(F.desc_nulls_last("severity"), "verdict_id").limit(most)


def fold_readings(readings: DataFrame) -> DataFrame:
    """Readings of a lemma with repetitions folded: ``..., basis, repeats``.

    ``readings`` has ``lemma_key, claim_id, witness_id, starts, ends, value,
    unit_dim, vintage, basis``.  In order of period, vintage and id, a reading
    repeats the first one with the same witness, period, value and unit if
    either states no basis or both state the same; the first then takes over
    the basis.  A reading that does not fit stays a row of its own, and the
    first keeps the role.  A reading without a value is never folded.
    """
    key = ["lemma_key", "witness_id", "starts", "ends", "value", "unit_dim"]
    readings = keep(readings.select(*key, "claim_id", "vintage", "basis"), "readings")
    lone = readings.where("value is null").select(*key, "claim_id", "basis", F.lit(1).alias("repeats"))
    # Of one key only the basis and the order differ; equal neighbours are counted before they are gathered.
    rows = readings.where("value is not null").groupBy(*key, "basis").agg(F.min(F.struct(F.col("vintage").isNotNull(), "vintage", "claim_id")).alias("at"), F.count("*").alias("n"))
    listed = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "basis", "n"))).alias("all"))
    stated = F.filter("all", lambda r: F.size(r["basis"]) > 0)
    first = F.get(F.col("all"), F.lit(0))
    home = F.when(F.size(first["basis"]) > 0, first["basis"]).otherwise(F.coalesce(F.get(stated, F.lit(0))["basis"], F.array().cast("array<string>")))
    folded = listed.select(*key, first["at"]["claim_id"].alias("claim_id"), home.alias("basis"), "all")
    mine = F.filter("all", lambda r: (F.size(r["basis"]) == 0) | (r["basis"] == F.col("basis")))
    main = folded.select(*key, "claim_id", "basis", F.aggregate(mine, F.lit(0).cast("long"), lambda s, r: s + r["n"]).cast("int").alias("repeats"))
    # Readings whose basis is not the first one's stay rows of their own.
    homes = folded.select(*[F.col(k).alias(f"home_{k}") for k in key], F.col("basis").alias("home"))
    valued = readings.where("value is not null").select(*key, "claim_id", "basis")
    own = valued.join(homes, [F.col(k).eqNullSafe(F.col(f"home_{k}")) for k in key]).where((F.size("basis") > 0) & (F.col("basis") != F.col("home")))
    rest = own.select(*key, "claim_id", "basis", F.lit(1).alias("repeats"))
    return main.unionByName(rest).unionByName(lone)


def frame_diff(verdict: DataFrame, framed: DataFrame) -> DataFrame:
    """``verdict_id, field, a, b, same``: the coordinates of both claims of each verdict, side by side."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    span = F.concat_ws(" to ", text(F.col("period.start")), text(F.col("period.end")))
    fields = framed.select(
        "claim_id",
        F.array(
            F.struct(F.lit("entity").alias("field"), text(F.col("entity_key")).alias("v")),
            F.struct(F.lit("measure").alias("field"), text(F.col("measure_raw")).alias("v")),
            F.struct(F.lit("period").alias("field"), text(F.col("period_raw")).alias("v")),
            F.struct(F.lit("period (resolved)").alias("field"), span.alias("v")),
            F.struct(F.lit("basis").alias("field"), F.coalesce(F.nullif(F.array_join("basis", ", "), F.lit("")), F.lit("-")).alias("v")),
            F.struct(F.lit("unit").alias("field"), F.concat(text(F.col("unit_raw")), F.lit(" ("), text(F.col("unit_dim")), F.lit(")")).alias("v")),
            F.struct(F.lit("value").alias("field"), text(F.col("value_raw")).alias("v")),
            F.struct(F.lit("value (normalised)").alias("field"), F.coalesce(F.format_number("value", 0), F.lit("-")).alias("v")),
            F.struct(F.lit("published").alias("field"), text(F.col("vintage")).alias("v")),
        ).alias("fields"),
    )
    a, b = (fields.select(F.col("claim_id").alias(f"claim_{s}"), F.col("fields").alias(f"f{s}")) for s in "ab")
    both = verdict.select("verdict_id", "claim_a", "claim_b").join(a, "claim_a").join(b, "claim_b")
    pairs = both.select("verdict_id", F.explode(F.arrays_zip("fa", "fb")).alias("p"))
    return pairs.select("verdict_id", F.col("p.fa.field").alias("field"), F.col("p.fa.v").alias("a"), F.col("p.fb.v").alias("b"), (F.col("p.fa.v") == F.col("p.fb.v")).alias("same"))


def export_top(verdict: DataFrame, claim: DataFrame, most: int = EXPORTED) -> DataFrame:
    """The gravest verdicts with both readings nested, ready for a JSON sink."""
    top = verdict.orderBy(F.desc_nulls_last("severity"), "verdict_id").limit(most)
    both = with_claims(top, claim, ["witness_id", "entity_raw", "measure_raw", "value_raw", "unit_raw", "period_raw", "quote"])
    reading = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("witness_id", "entity_raw", "measure_raw", "value_raw", "unit_raw", "period_raw", "quote")])
    return both.select("verdict_id", verdict_kind(F.col("verdict")).alias("verdict"), "rule_id", "explanation", "divergence", "severity", F.array(reading("a"), reading("b")).alias("readings"))


def claim_details(claim: DataFrame, witness: DataFrame, page: DataFrame) -> DataFrame:
    """Every claim once, with its witness and the page it stands on, where it has these."""
    about = witness.select("witness_id", "title", "vintage_date")
    where = page.dropDuplicates(["page_id"]).select("witness_id", "page_no", "page_id", "printed_label", "is_sparse")
    return claim.dropDuplicates(["claim_id"]).join(about, "witness_id", "left").join(where, ["witness_id", "page_no"], "left")


def quarantine_report(quarantine: DataFrame, witness: DataFrame, most: int = QUARANTINED) -> tuple[DataFrame, DataFrame]:
    """How many rejections have each reason, and the latest of them with their witness."""
    reasons = quarantine.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")
    listed = quarantine.join(witness.select("witness_id", short_label(F.coalesce("title", "filename")).alias("label")), "witness_id").orderBy(F.desc("quote_id")).limit(most)
    return reasons, listed
