"""Quantities recorded in different units: every value in the common unit of its dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.functions import notation as N
from claimloom.functions.labels import canonical_form, content_key, is_self_reference, split_qualifiers
from claimloom.functions.period import parse_period
from claimloom.session import keep

#: Readings that two notations must share, and how far (in powers of ten) they may scatter, to be linked.
LEAST_SHARED, SCATTER = 3, 0.02
#: Rounds in which a line is fitted again through the readings near it.
TRIMMED = 3

# Ratios of units that an estimate may snap to, besides powers of ten times the factors of the unit table; the last two have an offset.
_POWERS = [10.0**p for p in range(-12, 13)]
_SLOPES = [9 / 5, 5 / 9]


def known_ratios() -> list[float]:
    factors = sorted({f for _, _, f in N.UNITS})
    return sorted({p * f for p in _POWERS for f in factors} | {p / f for p in _POWERS for f in factors} | {*_SLOPES})


def _subject(claim: DataFrame) -> DataFrame:
    """``claim_id, subject`` of a row of claims: what is measured, the same however different sources word it.

    That is the entity without its legal form, the content words of the
    measure and the period; null where one is missing or the entity is only
    "the company".
    """
    # Wordings repeat: each is read once. No filter on what is computed here: it would be pushed down and compute all of it twice.
    read = lambda column, how, name: claim.select(column).where(f"{column} is not null").distinct().select(column, how(F.col(column)).alias(name))
    entity = read("entity_raw", lambda c: F.when(~is_self_reference(c), F.nullif(canonical_form(c), F.lit(""))), "entity")
    measure = read("measure_raw", lambda c: content_key(split_qualifiers(c)["name"]), "measure")
    rows = claim.select("claim_id", "entity_raw", "measure_raw", "period_raw").where("entity_raw is not null and measure_raw is not null and period_raw is not null")
    rows = rows.join(read("period_raw", parse_period, "p"), "period_raw").join(measure, "measure_raw").join(entity, "entity_raw")
    told = F.col("entity").isNotNull() & (F.size("measure") > 0) & F.col("p").isNotNull()
    return rows.select("claim_id", F.when(told, F.xxhash64("entity", "measure", "p.start", "p.end")).alias("subject"))


def read_quantities(claim: DataFrame) -> DataFrame:
    """``claim_id, source, number, notation, subject`` of each quantity claim that holds a number; repeated claims once.

    ``notation`` is what value and unit say besides the number (``value |
    unit``) or, where both are silent, what the quote says beside it.
    ``subject`` identifies what is measured, ``source`` who records it (the
    witness; null where there is no such column).
    """
    source = F.col("witness_id") if "witness_id" in claim.columns else F.lit(None).cast("long")
    rows = claim.where(F.col("claim_type") == "quantity").select("claim_id", source.alias("source"), "value_raw", "unit_raw", "quote", "entity_raw", "measure_raw", "period_raw")
    rows = rows.where("claim_id is not null and value_raw is not null")
    clean = rows.withColumn("clean", N.without_notes(N.tidy(F.col("value_raw"))))
    said = clean.select("claim_id", "source", N.number_in(F.col("clean")).alias("number"), N.words_of(F.col("clean")).alias("inside"), N.unit_words(F.col("unit_raw")).alias("unit"), "value_raw", "quote")
    silent = (F.col("inside") == "") & (F.col("unit") == "")
    noted = F.when(silent, F.coalesce(N.beside_number(F.col("quote"), F.col("value_raw")), F.lit(""))).otherwise(F.concat_ws(" | ", F.nullif("inside", F.lit("")), F.nullif("unit", F.lit(""))))
    # Written before it is filtered and grouped: a filter on a computed column would be pushed down and compute it twice.
    parsed = keep(said.select("claim_id", "source", "number", noted.alias("notation")), "parsed")
    once = parsed.where("number is not null").groupBy("claim_id").agg(F.min(F.struct("number", "notation", "source")).alias("r")).select("claim_id", "r.*")
    subject = _subject(rows).groupBy("claim_id").agg(F.min("subject").alias("subject"))
    return once.join(subject, "claim_id", "left").select("claim_id", "source", "number", "notation", "subject")


def notation_links(readings: DataFrame) -> DataFrame:
    """Pairs of notations that record the same subjects: ``a, b, shared, ratio, offset, scatter``.

    ``b = ratio * a + offset`` for most subjects.  Within a subject every
    notation is linked to one hub (its most used notation), so a subject with
    many readings adds no more rows than it has notations.  The ratio is the
    median one and the scatter the median deviation from it, in powers of ten.
    Where that scatters, a line is tried: first through the medians
    of the smaller and the larger half, then by least squares through the
    readings that lie near it.  It counts, with twice the shared readings, if
    it scatters little, and four times less than the ratio does.
    """
    usable = readings.where("subject is not null and number != 0")
    use = usable.groupBy("notation").agg(F.count("*").alias("uses"))
    each = usable.groupBy("subject", "notation").agg(F.avg("number").alias("number")).join(use, "notation")
    hub = F.max(F.struct("uses", "notation", "number")).over(W.partitionBy("subject"))
    pairs = each.withColumn("hub", hub).where(F.col("hub.notation") != F.col("notation")).select(F.col("notation").alias("a"), F.col("hub.notation").alias("b"), F.col("number").alias("x"), F.col("hub.number").alias("y"))
    pairs = keep(pairs, "pairs")
    median = lambda c: F.percentile_approx(c, 0.5, 1000)
    log = F.when(F.col("x") * F.col("y") > 0, F.log10(F.col("y") / F.col("x")))
    middle = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), median(log).alias("log_ratio"), median(F.col("x")).alias("mid"))
    low, high = F.col("x") < F.col("mid"), F.col("x") >= F.col("mid")
    halves = pairs.join(middle, ["a", "b"]).groupBy("a", "b", "shared", "log_ratio").agg(
        median(F.abs(log - F.col("log_ratio"))).alias("scatter"),
        *[median(F.when(half, F.col(c))).alias(f"{c}_{name}") for name, half in (("low", low), ("high", high)) for c in "xy"],
    )
    sloped = halves.withColumn("slope", (F.col("y_high") - F.col("y_low")) / F.nullif(F.col("x_high") - F.col("x_low"), F.lit(0.0)))
    bent = sloped.where((F.col("shared") >= 2 * LEAST_SHARED) & (F.coalesce("scatter", F.lit(9.0)) > SCATTER / 10) & (F.col("slope") != 0)).select("a", "b", "slope")
    off = keep(pairs.join(bent, ["a", "b"]), "bent")
    line = off.groupBy("a", "b", "slope").agg(median(F.col("y") - F.col("slope") * F.col("x")).alias("offset"))
    for _ in range(TRIMMED):
        rest = off.drop("slope").join(line, ["a", "b"]).withColumn("rest", F.abs(F.col("y") - F.col("slope") * F.col("x") - F.col("offset")))
        near = rest.groupBy("a", "b").agg((3 * median(F.col("rest")) + 1e-9).alias("near"))
        line = keep(rest.join(near, ["a", "b"]).where("rest <= near").groupBy("a", "b").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("offset")), "lines")
    left = off.drop("slope").join(line, ["a", "b"])
    line = left.groupBy("a", "b", "slope", "offset").agg(median(F.abs((F.col("y") - F.col("slope") * F.col("x") - F.col("offset")) / F.col("y")) / 2.302585).alias("line_scatter")).where(F.col("line_scatter") <= SCATTER)
    both = sloped.drop("slope").join(line, ["a", "b"], "left")
    straight = F.col("slope").isNull() | (F.col("scatter") <= 4 * F.col("line_scatter"))
    return both.where("slope is not null or log_ratio is not null").select("a", "b", "shared", F.when(straight, F.pow(F.lit(10.0), F.col("log_ratio"))).otherwise(F.col("slope")).alias("ratio"), F.when(straight, 0.0).otherwise(F.col("offset")).alias("offset"), F.when(straight, F.col("scatter")).otherwise(F.col("line_scatter")).alias("scatter"))


def snap(ratio):
    """The known conversion nearest to a ratio, if within 3 per cent; else null."""
    known = F.array(*[F.lit(r) for r in known_ratios()])
    best = F.array_min(F.transform(known, lambda k: F.struct(F.abs(F.log10(ratio / k)).alias("far"), k.alias("k"))))
    return F.when(best["far"] <= 0.0128, best["k"])


def lexicon(notations: DataFrame) -> DataFrame:
    """``notation, unit, factor, known`` by the fixed tables; the part before the bar is the value's, the part after it the unit's.

    A unit or scale that both parts state counts once, the value's first.
    """
    parts = notations.select("notation", F.posexplode(F.split("notation", r" \| ")).alias("pos", "part"))
    lone_m = F.when(F.col("part").rlike(r"(?<![a-z])m(?![a-z²])"), F.lit(1e6))
    read = parts.select("notation", "pos", N.lexicon_unit(F.col("part")).alias("unit"), N.lexicon_scale(F.col("part")).alias("scale"), lone_m.alias("lone_m"), N.is_known(F.col("part")).alias("known"))
    # An aggregation between the long expressions and what uses them keeps the generated code small.
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    money = F.col("unit.unit").isin("INR", "USD")
    whole = read.groupBy("notation").agg(first("unit").alias("any"), F.min_by("unit", F.when(money, F.col("pos"))).alias("money"), first("scale").alias("scale"), first("lone_m").alias("lone_m"), F.min("known").alias("known"))
    # Beside a currency a lone m is a million, not a metre.
    unit = F.when(F.col("money").isNotNull() & F.col("any.unit").isin("m", "INR", "USD"), F.col("money")).otherwise(F.col("any"))
    scale = F.coalesce("scale", F.when(F.col("money").isNotNull(), F.col("lone_m")), F.lit(1.0))
    return whole.select("notation", F.coalesce(unit["unit"], F.lit("count")).alias("unit"), (F.coalesce(unit["factor"], F.lit(1.0)) * scale).alias("factor"), "known")


#: Joins a notation and the source that uses it.
_AT = "\u0001"


def resolve_notations(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(notation, source, unit, factor, shift, how)`` of every notation, and the links between them.

    A reading is worth ``factor * number + shift`` in ``unit``.  Notations
    whose words are all known mean the same in every source (``source`` null)
    and state their unit; the graph then says whether what they are worth
    beside others bears that out: ``confirmed`` or ``contested`` by most
    of their tight links, else just ``stated``.  The text decides all the same.

    Others are resolved by the graph alone, source by source, for two sources
    may mean different things by one word, and for all sources together.  A
    tight link to a resolved node gives the ratio, which is snapped to a known
    conversion, and the offset; the best supported link wins, and rounds of
    this carry it on (``linked``) until one adds nothing.  What remains is
    read as far as its known words go (``assumed``).
    """
    notations = keep(lexicon(readings.select("notation").distinct()), "notations")
    known = notations.where("known")
    open_ = notations.where("not known")
    unknown = readings.join(open_.select("notation"), "notation", "left_semi")
    of_source = unknown.where("source is not null").withColumn("notation", F.concat_ws(_AT, "notation", F.col("source").cast("string")))
    links = keep(notation_links(readings.unionByName(of_source)), "links")
    tight = links.where((F.col("scatter") <= SCATTER) & (F.col("shared") >= LEAST_SHARED) & (F.col("ratio") > 0))
    ways = tight.select("a", "b", "ratio", "offset", "shared").unionByName(tight.select(F.col("b").alias("a"), F.col("a").alias("b"), (1 / F.col("ratio")).alias("ratio"), (-F.col("offset") / F.col("ratio")).alias("offset"), "shared"))
    ways = keep(ways.withColumn("step", snap(F.col("ratio"))).where("step is not null"), "ways")

    def reached(solved: DataFrame) -> DataFrame:
        """What the links say of their first end, by what is resolved of the second."""
        return ways.join(solved.select(F.col("notation").alias("b"), "unit", "factor", "shift"), "b").select(F.col("a").alias("notation"), "shared", "unit", (F.col("step") * F.col("factor")).alias("factor"), (F.col("factor") * F.col("offset") + F.col("shift")).alias("shift"))

    stated = known.select("notation", "unit", "factor", F.lit(0.0).alias("shift"))
    votes = reached(stated).withColumnsRenamed({"unit": "u", "factor": "f"}).join(stated, "notation")
    same = (F.col("u") == F.col("unit")) & (F.abs(F.log10(F.col("f") / F.col("factor"))) < SCATTER)
    tally = votes.groupBy("notation").agg(F.sum(F.when(same, F.col("shared")).otherwise(-F.col("shared"))).alias("for"))
    solved = stated.join(tally, "notation", "left").select("notation", "unit", "factor", "shift", F.when(F.col("for") > 0, "confirmed").when(F.col("for") < 0, "contested").otherwise("stated").alias("how"))
    nodes = keep(open_.select("notation").unionByName(of_source.select("notation").distinct()), "nodes")
    fresh = stated
    while not nodes.isEmpty():  # each round solves another node, or is the last
        found = reached(fresh).join(nodes, "notation", "left_semi").groupBy("notation").agg(F.max(F.struct("shared", "unit", "factor", "shift")).alias("r"))
        fresh = keep(found.select("notation", "r.unit", "r.factor", "r.shift", F.lit("linked").alias("how")), "linked")
        if fresh.isEmpty():
            break
        solved = solved.unionByName(fresh)
        nodes = keep(nodes.join(fresh, "notation", "left_anti"), "nodes")
    rest = open_.join(solved, "notation", "left_anti").select("notation", "unit", "factor", F.lit(0.0).alias("shift"), F.lit("assumed").alias("how"))
    at = F.split("notation", _AT)
    whole = solved.unionByName(rest).select(at[0].alias("notation"), F.get(at, F.lit(1)).cast("long").alias("source"), "unit", "factor", "shift", "how")
    return whole, links.where(~F.col("a").contains(_AT) & ~F.col("b").contains(_AT))


def common_units(claim: DataFrame) -> DataFrame:
    """``(claim_id, base_unit, base_value)`` of each quantity claim whose value holds a number.

    ``base_unit`` is the common unit of the dimension (INR, USD, bps, count,
    kg, kWh, m, sqm, min), ``base_value`` the value in it, rounded to the
    nearest whole.  Ranges count as their midpoint, bracketed numbers are
    negative, notes and marks of approximation are ignored.  Claims with a
    null id or value, of another type, or without a number are left out;
    repeated claims count once; a silent unit is a count; values beyond the
    range of a long give null; extra columns play no part.
    """
    readings = keep(read_quantities(claim), "readings")
    notations, _ = resolve_notations(readings)
    of_all = notations.where("source is null").drop("source", "how")
    of_one = notations.where("source is not null").select("notation", "source", *[F.col(c).alias(f"own_{c}") for c in ("unit", "factor", "shift")])
    met = readings.join(of_all, "notation").join(of_one, ["notation", "source"], "left")
    value = F.round(F.col("number") * F.coalesce("own_factor", "factor") + F.coalesce("own_shift", "shift"))
    fits = F.abs(value) < 9.2e18
    return met.select("claim_id", F.coalesce("own_unit", "unit").alias("base_unit"), F.when(fits, value).cast("bigint").alias("base_value"))
