"""The ordered rules that decide how two claims of one lemma relate.

Each rule is a condition; the first that holds gives the ruling.  The rule is
found in one projection and the sentence is worded in a second one, so neither
grows beyond what the code generator can handle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import period as P
from claimloom.functions.basis import ADJUSTMENT, CONSOLIDATION, family, stage_of, stage_rank
from claimloom.functions.quantity import relative_gap, same_to_figures
from claimloom.operators.frames import neat

# How near two values must be to be the same, and to be a restatement.
ROUNDING, FIGURES, RESTATED = 0.005, 3, 0.15

# The verdict of each rule.
VERDICTS = {
    "DIMENSION_MISMATCH": "distinct",
    "STATE_SUPERSEDED": "reconciled",
    "STATE_CONFLICT": "contradicts",
    "PERIOD_UNSTATED": "distinct",
    "PERIOD_DISJOINT": "reconciled",
    "PERIOD_NESTED": "reconciled",
    "PERIOD_PARTIAL": "reconciled",
    "BASIS_MISMATCH": "reconciled",
    "ADJUSTMENT_MISMATCH": "reconciled",
    "UNIT_SCALE": "corroborates",
    "ROUNDING": "corroborates",
    "EXACT": "corroborates",
    "SIGN_CONVENTION": "reconciled",
    "VINTAGE_REVISION": "reconciled",
    "RESTATEMENT": "reconciled",
    "CONTRADICTS": "contradicts",
    "DEFINITION_DRIFT": "reconciled",
    "NO_RULE": "distinct",
}


def _facts(pairs: DataFrame) -> DataFrame:
    """What the rules compare, each computed once."""
    a, b = F.col("a"), F.col("b")
    state = lambda s: F.lower(F.trim(F.coalesce(F.nullif(s["value_text"], F.lit("")), s["value_raw"], F.lit(""))))
    return pairs.select(
        "*",
        P.relation(a["period"], b["period"]).alias("periods"),
        relative_gap(a["value"], b["value"]).alias("gap"),
        relative_gap(F.abs(a["value"]), F.abs(b["value"])).alias("size_gap"),
        same_to_figures(a["value"], b["value"], FIGURES).alias("same_figures"),
        (neat(a["unit_raw"]) == neat(b["unit_raw"])).alias("same_unit"),
        family(a["basis"], CONSOLIDATION).alias("ca"),
        family(b["basis"], CONSOLIDATION).alias("cb"),
        family(a["basis"], ADJUSTMENT).alias("ja"),
        family(b["basis"], ADJUSTMENT).alias("jb"),
        stage_rank(a["basis"]).alias("ra"),
        stage_rank(b["basis"]).alias("rb"),
        state(a).alias("ta"),
        state(b).alias("tb"),
    )


def _differ(x: str, y: str) -> Column:
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.col(x) != F.col(y))


def _rule() -> Column:
    a, b = F.col("a"), F.col("b")
    numeric = a["value"].isNotNull() & b["value"].isNotNull()
    dated = a["vintage"].isNotNull() & b["vintage"].isNotNull() & (a["vintage"] != b["vintage"])
    states = a["claim_type"].isin("state", "event") & b["claim_type"].isin("state", "event") & (F.col("ta") != "") & (F.col("tb") != "") & (F.col("ta") != F.col("tb"))
    agree = numeric & ((F.col("gap") <= ROUNDING) | F.col("same_figures"))
    opposite = numeric & (a["value"] * b["value"] < 0) & (F.col("size_gap") <= ROUNDING) & (F.coalesce(a["value_raw"].contains("("), F.lit(False)) | F.coalesce(b["value_raw"].contains("("), F.lit(False)))
    late = F.when(a["vintage"] < b["vintage"], b["basis"]).otherwise(a["basis"])
    restated = numeric & dated & (F.col("gap") <= RESTATED) & F.arrays_overlap(late, F.array(F.lit("restated"), F.lit("revised")))
    ladder = [
        (a["unit_dim"].isNotNull() & b["unit_dim"].isNotNull() & (a["unit_dim"] != b["unit_dim"]), "DIMENSION_MISMATCH"),
        (states & dated, "STATE_SUPERSEDED"),
        (states, "STATE_CONFLICT"),
        (F.col("periods") == "unstated", "PERIOD_UNSTATED"),
        (F.col("periods") == "disjoint", "PERIOD_DISJOINT"),
        (F.col("periods") == "nested", "PERIOD_NESTED"),
        (F.col("periods") == "partial", "PERIOD_PARTIAL"),
        (_differ("ca", "cb"), "BASIS_MISMATCH"),
        (_differ("ja", "jb"), "ADJUSTMENT_MISMATCH"),
        (agree & ~F.col("same_unit"), "UNIT_SCALE"),
        (agree & (F.col("gap") > 0), "ROUNDING"),
        (agree, "EXACT"),
        (opposite, "SIGN_CONVENTION"),
        (numeric & F.col("ra").isNotNull() & F.col("rb").isNotNull() & (F.col("ra") != F.col("rb")), "VINTAGE_REVISION"),
        (restated, "RESTATEMENT"),
        (numeric, "CONTRADICTS"),
    ]
    rule = None
    for condition, name in ladder:
        rule = F.when(condition, name) if rule is None else rule.when(condition, name)
    return rule.otherwise("NO_RULE")


def verdict_of(rule: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv]), rule)


def _divergence() -> Column:
    rule = F.col("rule_id")
    return F.when(rule.isin("EXACT", "SIGN_CONVENTION"), F.lit(0.0)).when(rule.isin("UNIT_SCALE", "ROUNDING", "VINTAGE_REVISION", "RESTATEMENT", "CONTRADICTS"), F.col("gap"))


def _severity() -> Column:
    """A contradiction weighs by its gap and the weaker confidence; less within one witness."""
    trust = lambda s: F.coalesce(F.nullif(s["confidence"], F.lit(0.0)), F.lit(0.5))
    a, b = F.col("a"), F.col("b")
    weight = F.least(F.lit(1.0), F.col("gap") * 2) * (0.5 + 0.5 * F.least(trust(a), trust(b)))
    inner = F.when(a["witness_id"] == b["witness_id"], 0.6).otherwise(1.0)
    return F.when(F.col("rule_id") == "CONTRADICTS", F.round(weight * inner, 3)).when(F.col("rule_id") == "STATE_CONFLICT", F.lit(0.6))


def rule_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs with ``rule_id, verdict, divergence, severity``."""
    ruled = _facts(pairs).withColumn("rule_id", _rule())
    return ruled.select("*", verdict_of(F.col("rule_id")).alias("verdict"), _divergence().alias("divergence"), _severity().alias("severity"))


def _where(side: Column) -> Column:
    return F.concat(F.coalesce(side["title"], F.lit("?")), F.lit(" ("), F.coalesce(side["vintage"].cast("string"), F.lit("undated")), F.lit(")"))


def _percent(x: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", x * 100)


def explain_rulings(ruled: DataFrame) -> DataFrame:
    """The rulings with a sentence that names the coordinate behind them."""
    a, b = F.col("a"), F.col("b")
    text = lambda c: F.coalesce(c, F.lit(""))
    said = lambda s: F.trim(F.concat_ws(" ", text(s["value_raw"]), text(s["unit_raw"])))
    span = lambda s: F.coalesce(s["period_raw"], P.format_period(s["period"]), F.lit("no period"))
    older_first = F.coalesce(a["vintage"] <= b["vintage"], F.lit(True))
    by_stage = F.coalesce(F.col("ra") <= F.col("rb"), F.lit(True))
    early = lambda flag: F.when(flag, F.concat(said(a), F.lit(" in "), _where(a))).otherwise(F.concat(said(b), F.lit(" in "), _where(b)))
    late = lambda flag: F.when(flag, F.concat(said(b), F.lit(" in "), _where(b))).otherwise(F.concat(said(a), F.lit(" in "), _where(a)))
    stage = lambda s: F.translate(F.coalesce(stage_of(s["basis"]), F.lit("figure")), "_", " ")
    a_outer = P.contains(a["period"], b["period"])
    sentences = {
        "DIMENSION_MISMATCH": F.concat(F.lit("Measured in "), a["unit_dim"], F.lit(" and in "), b["unit_dim"], F.lit(", so not comparable.")),
        "STATE_SUPERSEDED": F.concat(F.lit("The state changed: first "), early(older_first), F.lit(", later "), late(older_first), F.lit(".")),
        "STATE_CONFLICT": F.concat(F.lit("Different states without an order in time: "), said(a), F.lit(" against "), said(b), F.lit(".")),
        "PERIOD_UNSTATED": F.lit("A claim without a stated period has no place in a frame."),
        "PERIOD_DISJOINT": F.concat(F.lit("Different periods: "), span(a), F.lit(" in "), _where(a), F.lit(" and "), span(b), F.lit(" in "), _where(b), F.lit(".")),
        "PERIOD_NESTED": F.concat(F.when(a_outer, span(b)).otherwise(span(a)), F.lit(" is part of "), F.when(a_outer, span(a)).otherwise(span(b)), F.lit(", so one figure is a component of the other.")),
        "PERIOD_PARTIAL": F.concat(F.lit("The periods differ: "), span(a), F.lit(" and "), span(b), F.lit(".")),
        "BASIS_MISMATCH": F.concat(F.lit("Different reporting bases: "), F.array_join("ca", "/"), F.lit(" and "), F.array_join("cb", "/"), F.lit(".")),
        "ADJUSTMENT_MISMATCH": F.concat(F.lit("Different adjustments: "), F.array_join("ja", "/"), F.lit(" and "), F.array_join("jb", "/"), F.lit(".")),
        "UNIT_SCALE": F.concat(F.lit("One figure in two notations: "), said(a), F.lit(" and "), said(b), F.lit(", both "), F.format_number(a["value"], 0), F.lit(" "), text(a["unit_dim"]), F.lit(".")),
        "ROUNDING": F.concat(F.lit("Equal to "), F.lit(str(FIGURES)), F.lit(" significant figures; "), _percent(F.col("gap"), 2), F.lit(" is rounding.")),
        "EXACT": F.concat(F.lit("Both say "), said(a), F.lit(".")),
        "SIGN_CONVENTION": F.concat(F.lit("The same size with opposite signs, once in brackets: "), said(a), F.lit(" and "), said(b), F.lit(".")),
        "VINTAGE_REVISION": F.concat(F.lit("Successive stages: "), F.when(by_stage, stage(a)).otherwise(stage(b)), F.lit(" "), early(by_stage), F.lit(", then "), F.when(by_stage, stage(b)).otherwise(stage(a)), F.lit(" "), late(by_stage), F.lit(" ("), _percent(F.col("gap")), F.lit(").")),
        "RESTATEMENT": F.concat(F.lit("Restated from "), early(older_first), F.lit(" to "), late(older_first), F.lit(" ("), _percent(F.col("gap")), F.lit(").")),
        "CONTRADICTS": F.concat(F.lit("Same frame, different figures: "), said(a), F.lit(" in "), _where(a), F.lit(" and "), said(b), F.lit(" in "), _where(b), F.lit(", "), _percent(F.col("gap")), F.lit(" apart.")),
    }
    worded = None
    for rule, sentence in sentences.items():
        hit = F.col("rule_id") == rule
        worded = F.when(hit, sentence) if worded is None else worded.when(hit, sentence)
    return ruled.withColumn("explanation", worded.otherwise("No rule applies."))


def adjudicate(pairs: DataFrame) -> DataFrame:
    """``lemma_key, claim_a, claim_b, verdict, rule_id, divergence, severity, explanation`` of pairs ``(lemma_key, a, b)``."""
    ruled = explain_rulings(rule_pairs(pairs))
    return ruled.select("lemma_key", F.col("a.claim_id").alias("claim_a"), F.col("b.claim_id").alias("claim_b"), "verdict", "rule_id", "divergence", "severity", "explanation")


def drift_rulings(pairs: DataFrame) -> DataFrame:
    """Rulings of neighbour pairs: related measures, but not the same one."""
    name = lambda s: F.concat(F.lit('"'), F.coalesce(F.col(s)["measure_raw"], F.lit("")), F.lit('"'))
    text = F.concat(F.lit("Related measures, "), _percent(F.col("score"), 0), F.lit(" alike: "), name("a"), F.lit(" and "), name("b"), F.lit("."))
    none = F.lit(None).cast("double")
    return pairs.select("lemma_key", F.col("a.claim_id").alias("claim_a"), F.col("b.claim_id").alias("claim_b"), F.lit("reconciled").alias("verdict"), F.lit("DEFINITION_DRIFT").alias("rule_id"), none.alias("divergence"), none.alias("severity"), text.alias("explanation"))
