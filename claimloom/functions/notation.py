"""Numbers and units as documents write them: column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of other scripts, and signs that stand for a plain one.
_DIGITS = "०१२३४५६७८९০১২৩৪৫৬৭৮৯٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９" + "．，（）％＄－−‐‑"
_PLAIN = "0123456789" * 5 + ".,()%$----"

# Marks of approximation.
_APPROX = r"(?:\b(?:approximately|approx|about|around|nearly|almost|over|under|circa|some|up to|at least|between)\b\.?|\bc\.|[~≈<>≤≥±])"

_NUMBER = r"(?:[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?|\.[0-9]+)"
_SIGNED = rf"[-+]?\s*{_NUMBER}"
_UNIT_BETWEEN = r"(?:[a-z%$₹.²‰]{1,12}\s*)?"
_RANGE = rf"({_SIGNED})\s*{_UNIT_BETWEEN}(?:-|–|—|to|and)\s*{_UNIT_BETWEEN}({_SIGNED})"

# Words of scale and their powers of ten.
SCALES = {
    "lakh crores?|lac crores?": 12,
    "trillions?|tn": 12,
    "billions?|bn": 9,
    "crores?|crs?": 7,
    "millions?|mn|mio|msf": 6,
    "lakhs?|lacs?": 5,
    "thousands?|k": 3,
}

# Notations of units, the common unit of their dimension and the factor to it. Earlier ones win.
UNITS = [
    (r"us\s?\$|usd|us dollars?|dollars?|\$", "USD", 1.0),
    (r"₹|rs|inr|rupees?|re", "INR", 1.0),
    (r"percentage points?|per ?cent|pct|pc|pp|%", "bps", 100.0),
    (r"per mille?|‰", "bps", 10.0),
    (r"basis points?|basis pts?|bps?", "bps", 1.0),
    (r"sq\.? ?(?:feet|foot|ft)|square (?:feet|foot)|sft|msf|ft²", "sqm", 0.09290304),
    (r"sq\.? ?(?:kms?|kilomet(?:re|er)s?)|square kilomet(?:re|er)s?|km²", "sqm", 1e6),
    (r"sq\.? ?(?:mtrs?|met(?:re|er)s?|m)|square met(?:re|er)s?|sqm|m²", "sqm", 1.0),
    (r"acres?", "sqm", 4046.8564224),
    (r"ha|hectares?", "sqm", 10_000.0),
    (r"kwh|kilowatt[- ]?hours?", "kWh", 1.0),
    (r"mwh|megawatt[- ]?hours?", "kWh", 1e3),
    (r"gwh|gigawatt[- ]?hours?", "kWh", 1e6),
    (r"twh|terawatt[- ]?hours?", "kWh", 1e9),
    (r"gj|gigajoules?", "kWh", 1e9 / 3.6e6),
    (r"mj|megajoules?", "kWh", 1e6 / 3.6e6),
    (r"kilotonnes?|kt", "kg", 1e6),
    (r"metric tonn?e?s?|tonn?e?s?|mt|t", "kg", 1e3),
    (r"quintals?|qtls?", "kg", 100.0),
    (r"lbs?|pounds?(?: weight)?", "kg", 0.45359237),
    (r"kgs?|kilograms?|kilos?", "kg", 1.0),
    (r"grams?|gms?|g", "kg", 1e-3),
    (r"kms?|kilomet(?:re|er)s?", "m", 1e3),
    (r"miles?|mi", "m", 1609.344),
    (r"feet|foot|ft", "m", 0.3048),
    (r"cms?|centimet(?:re|er)s?", "m", 0.01),
    (r"seconds?|secs?|s", "min", 1 / 60),
    (r"minutes?|mins?", "min", 1.0),
    (r"hours?|hrs?|h", "min", 60.0),
    (r"days?|d", "min", 1440.0),
    (r"weeks?", "min", 10_080.0),
]

# Words for a metre, which beside a currency may be a million.
METRES = r"mtrs?|met(?:re|er)s?|m"

# Words of a notation that say no more than that something is counted.
COUNTED = r"nos?|numbers?|units?|pieces?|pcs|persons?|people|employees|shipments?|parcels?|vehicles?|#"

_WORD_START, _WORD_END = r"(?<![a-z0-9])", r"(?![a-z0-9²])"


def _whole(pattern: str) -> str:
    """``pattern`` where no letter or digit touches it; signs may stand next to anything."""
    return rf"(?:{_WORD_START}(?:{pattern}){_WORD_END})"


def tidy(text: Column) -> Column:
    """Lower-case text with plain digits, signs and single blanks; thousands written as '000 become a word, grouping blanks vanish."""
    out = F.lower(F.translate(text, _DIGITS, _PLAIN))
    out = F.regexp_replace(out, r"(?<=[0-9])[    ](?=[0-9]{2,3}(?![0-9]))", "")
    out = F.regexp_replace(out, r"(?<=[0-9]) (?=[0-9]{3}(?![0-9]))", "")
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    return F.regexp_replace(out, r"['’‘`]\s?000s?(?![0-9])|(?<![0-9.,])000s?(?![0-9])", " thousand ")


def without_notes(tidied: Column) -> Column:
    """Tidied text without notes, footnote signs and marks of approximation."""
    out = F.regexp_replace(tidied, r"[\[(]\s*(?:refer|see|note|audited|unaudited|provisional|restated|revised|consolidated|standalone)[^\])]*[\])]|\[[^\]]*\]|\b(?:see|refer)?\s*note\s*[0-9]+", " ")
    out = F.regexp_replace(out, r"[*^†‡§]", " ")
    out = F.regexp_replace(out, r"(?<=[0-9)])\s*#", " ")
    return F.regexp_replace(out, _APPROX, " ")


def number_in(clean: Column) -> Column:
    """The number that a cleaned text holds: a range's midpoint, negative in brackets, null without one."""
    cast = lambda s: F.expr("try_cast(x as double)") if s is None else s.try_cast("double")
    digits = lambda s: cast(F.regexp_replace(s, r"[,\s+]", ""))
    low, high = (digits(F.regexp_extract(clean, _RANGE, g)) for g in (1, 2))
    single = digits(F.regexp_extract(clean, rf"({_SIGNED})", 1))
    value = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).otherwise(single)
    bracketed = clean.rlike(r"^[^0-9(]*\(\s*[^0-9()]*[0-9][^()]*\)")
    return F.when(bracketed, -F.abs(value)).when(clean.rlike(rf"^[^0-9(]*[–—]\s*{_NUMBER}"), -F.abs(value)).otherwise(value)


def words_of(clean: Column) -> Column:
    """What a cleaned text says besides its numbers and signs; empty if nothing."""
    out = F.regexp_replace(clean, _NUMBER, " ")
    out = F.regexp_replace(out, r"\b(?:to|and|in|of)\b|[-+–—()\[\],:;|/=]|(?<![a-z])\.|\.(?![a-z])", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def unit_words(unit: Column) -> Column:
    """A unit cell as a notation; empty if it says nothing."""
    out = F.regexp_replace(F.coalesce(tidy(unit), F.lit("")), r"\b(?:in|of)\b|[()\[\],:;|=]|\.(?![0-9])", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def beside_number(quote: Column, value: Column) -> Column:
    """The notation that stands beside the verbatim ``value`` in ``quote``: a currency before it, a scale and unit after it.

    The same digits may stand elsewhere too, as in a period; the first place
    with a notation beside it counts.
    """
    # The value as a number of its own, not inside another one.
    alone = F.concat(F.lit(r"(?<![0-9])(?<![0-9][.,])\Q"), value, F.lit(r"\E(?![0-9])(?![.,][0-9])"))
    currency = r"((?:(?<![a-z])(?:us\s?\$|usd|us dollars?|inr|rs|rupees?)|₹|\$)\.?)\s*[-+(]*\s*$"
    scale = _whole("|".join(SCALES)) + r"\.?"
    signs = r"%|‰|#"
    words = "|".join(p for p, _, _ in UNITS[2:])
    unit = rf"(?:{signs}|{_whole(words + '|us dollars?|rupees?|' + METRES + '|' + COUNTED)}\.?)"
    follows = rf"^[)*^†‡\s]*(?:in\s+)?((?:{scale})?\s*(?:{unit})?(?:\s*\((?:metric tonnes|million sq ft)\))?)"

    def beside(before: Column, after: Column) -> Column:
        symbol = F.regexp_extract(tidy(F.right(before, F.lit(14))), currency, 1)
        words = F.regexp_extract(tidy(F.left(after, F.lit(40))), follows, 1)
        return F.trim(F.regexp_replace(F.concat_ws(" ", symbol, F.regexp_replace(words, r"[().]", " ")), r"\s+", " "))

    parts = F.split(quote, alone)
    places = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda after, i: beside(parts[i], after))
    return F.when(F.length(value) > 0, F.coalesce(F.get(F.filter(places, lambda p: p != ""), F.lit(0)), F.lit(""))).otherwise(F.lit(""))


def _first(notation: Column, table: list[tuple[str, object]]) -> Column:
    picked = None
    for pattern, result in table:
        hit = notation.rlike(pattern)
        picked = F.when(hit, F.lit(result)) if picked is None else picked.when(hit, F.lit(result))
    return picked


def _unit_pattern(pattern: str) -> str:
    return "|".join(p if p in ("₹", r"\$", "%", "‰") else _whole(p) for p in _split(pattern))


def _split(pattern: str) -> list[str]:
    """The alternatives at the top level of a pattern."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append(pattern[last:i])
            last = i + 1
    return [*parts, pattern[last:]]


def lexicon_unit(notation: Column) -> Column:
    """``struct(unit, factor)`` by the fixed tables: the unit factor of the first unit named, null if none is."""
    tables = [(_unit_pattern(p), (unit, factor)) for p, unit, factor in UNITS]
    # A lone m is a metre; after a currency it is a million, but a currency comes first here.
    tables.append((_whole(METRES), ("m", 1.0)))
    picked = None
    for pattern, (unit, factor) in tables:
        found = F.struct(F.lit(unit).alias("unit"), F.lit(factor).alias("factor"))
        picked = F.when(notation.rlike(pattern), found) if picked is None else picked.when(notation.rlike(pattern), found)
    return picked


def lexicon_scale(notation: Column) -> Column:
    """The scale that a notation states, as a factor; null if it states none."""
    tables = [(_whole(p), float(10**power)) for p, power in SCALES.items()]
    currency = notation.rlike(r"₹|\$|" + _whole("rs|inr|usd|rupees?|dollars?"))
    return F.coalesce(_first(notation, tables), F.when(currency & notation.rlike(_whole("m")), F.lit(1e6)))


def is_known(notation: Column) -> Column:
    """Whether every word of a notation is in the fixed tables."""
    words = "|".join([*(p for p, _, _ in UNITS), *SCALES, COUNTED, METRES, "weight", "metric"])
    return F.trim(F.regexp_replace(F.regexp_replace(notation, r"us\s?\$|[₹$%‰#|]", " "), _whole(words) + r"|[.\s]", "")) == ""
