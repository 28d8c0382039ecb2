"""Reporting bases: canonical tokens, the ladder of stages and families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.binding import let

# Families of bases; within one, the first pattern found gives the token.
FAMILIES = {
    "consolidation": [(r"\bconsolidat", "consolidated"), (r"\bstandalone|\bseparate financial", "standalone"), (r"\bsegment\b", "segment")],
    "assurance": [(r"\bunaudited|\blimited review", "unaudited"), (r"\baudited", "audited")],
    "stage": [
        (r"\bfirst advance|\badvance estimate", "advance_estimate"),
        (r"\bsecond advance", "second_advance_estimate"),
        (r"\bprovisional", "provisional"),
        (r"\brevised", "revised"),
        (r"\brestated|\bre-?stated", "restated"),
        (r"\bproforma|\bpro\s?forma", "proforma"),
        (r"\bproject|\bforecast|\bprojected", "projected"),
        (r"\bestimate|\bestimated|\be\b", "estimate"),
        (r"\bactual", "actual"),
    ],
    "adjustment": [
        (r"\bseasonally adjusted", "seasonally_adjusted"),
        (r"\bconstant price|\bat constant|\breal terms|\breal\b", "real"),
        (r"\bcurrent price|\bnominal\b", "nominal"),
        (r"\bannualis|\bannualiz", "annualised"),
    ],
    "aggregation": [(r"\bgross\b", "gross"), (r"\bnet\b", "net"), (r"\bper capita", "per_capita")],
}

# Stages from weakest to strongest.
STAGES = "advance_estimate second_advance_estimate estimate projected provisional revised restated actual".split()

# Words of free text that name no basis.
NOISE = (
    "the and for with from that this which were was has have been are its their there value values figure figures number numbers data based including "
    "percent cent year years period memo term total amount level rate growth over under above below assumption assumptions baseline projected medium ion"
).split()

#: Free words shorter than this, and beyond this many, are left out.
LEAST_LETTERS, MOST_WORDS = 5, 2

# Tokens whose difference explains a difference of values.
CONSOLIDATION = ["consolidated", "standalone", "segment"]
ADJUSTMENT = ["real", "nominal", "seasonally_adjusted", "annualised", "per_capita", "gross", "net"]
ASSURANCE = ["audited", "unaudited"]


def basis_tokens(basis_raw: Column, qualifiers: Column) -> Column:
    """Sorted canonical tokens of a basis and its qualifiers, and up to two other words of the basis itself."""
    known = "|".join(p for patterns in FAMILIES.values() for p, _ in patterns)

    def read(t: Column) -> Column:
        found = []
        for patterns in FAMILIES.values():
            token = None
            for pattern, name in patterns:
                token = F.when(t["all"].rlike(pattern), name) if token is None else token.when(t["all"].rlike(pattern), name)
            found.append(token)
        words = F.regexp_extract_all(F.regexp_replace(t["basis"], known, " "), F.lit(r"[a-z][a-z_]{2,}"), F.lit(0))
        free = F.filter(words, lambda w: (F.length(w) >= LEAST_LETTERS) & ~w.isin(*NOISE))
        free = F.slice(F.array_sort(F.array_distinct(free)), 1, MOST_WORDS)
        return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*found)), free)))

    basis = F.lower(F.coalesce(basis_raw, F.lit("")))
    quals = F.lower(F.coalesce(F.array_join(qualifiers, " "), F.lit("")))
    return let(F.struct(F.concat_ws(" ", basis, quals).alias("all"), basis.alias("basis")), read)


def stage_of(tokens: Column) -> Column:
    """The strongest stage among the tokens, null without one."""
    ladder = F.array(*[F.lit(s) for s in reversed(STAGES)])
    return F.get(F.filter(ladder, lambda s: F.array_contains(tokens, s)), F.lit(0))


def stage_rank(tokens: Column) -> Column:
    """Position of the strongest stage, from 0; null without one."""
    ladder = F.array(*[F.lit(s) for s in STAGES])
    return (F.nullif(F.array_position(ladder, stage_of(tokens)), F.lit(0)) - 1).cast("int")


def family(tokens: Column, members: list[str]) -> Column:
    """The tokens of one family, sorted."""
    return F.array_sort(F.array_intersect(tokens, F.array(*[F.lit(m) for m in members])))
