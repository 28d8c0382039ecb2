"""SQL building blocks: the same readings as the column functions, written independently for DuckDB."""

from __future__ import annotations

CLAIM = "c as (select distinct * from claim)"

# Text cleaned for number parsing, and its parts.
NUMBER = CLAIM + r""",
num00 as (
  select claim_id, translate(value_raw, '०१२३४५६७८९০১২৩৪৫৬৭৮৯٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９', '01234567890123456789012345678901234567890123456789') as value_raw from c
), num0 as (
  select claim_id, value_raw, regexp_extract(trim(value_raw), '^\s*\(\s*(.+?)\s*\)\s*$', 1) as inside from num00
), num1 as (
  select claim_id, inside <> '' as negative,
    trim(regexp_replace(regexp_replace(trim(translate(case when inside <> '' then inside else value_raw end, '−–', '--')), '^[~≈<>≤≥+]+\s*', ''),
      '(?i)(^|\W)(approx\.?|about|around|over|under|nearly)(\W|$)', '\1\3', 'g')) as body
  from num0 where value_raw is not null
), num2 as (
  select *, regexp_extract(body, '^\s*([-+]?\d[\d,]*(?:\.\d+)?)\s*(?:-|—|[tT][oO]|[aA][nN][dD])\s*([-+]?\d[\d,]*(?:\.\d+)?)\s*$', ['a', 'b']) as ends,
    regexp_extract(body, '[-+]?\d[\d,\s\x{202f}\x{a0}]*(?:\.\d+)?', 0) as hit
  from num1
), num3 as (
  select claim_id, negative, try_cast(replace(ends.a, ',', '') as double) as e1, try_cast(replace(ends.b, ',', '') as double) as e2,
    try_cast(regexp_replace(hit, '[,\s\x{202f}\x{a0}]', '', 'g') as double) as one
  from num2
), num as (
  select claim_id, case when e1 is not null and e2 is not null then (e1 + e2) / 2 when negative then -one else one end as value,
    case when e2 is not null then least(e1, e2) end as low, case when e1 is not null then greatest(e1, e2) end as high
  from num3
)"""

_UNIT_TEXT = r"lower(trim(regexp_replace(coalesce(unit_raw, ''), '\s+', ' ', 'g')))"


def _word(column: str, word: str) -> str:
    if word[0].isalpha():
        return rf"regexp_matches({column}, '(^|[^a-z]){word}([^a-z]|$)')"
    return f"contains({column}, '{word}')"


def unit_sql(currencies: dict[str, str], scales: dict[str, float], percent: list[str]) -> str:
    """A CTE ``unit(claim_id, dimension, scale)`` over ``c``."""
    pct = " or ".join(f"contains(u, '{w}')" for w in percent)
    cur = " ".join(f"when {_word('u', w)} then '{code}'" for w, code in currencies.items())
    by_length = sorted(scales, key=lambda w: (-len(w), w))
    scale = " ".join(f"when {_word('u', w)} then {scales[w]!r}" for w in by_length)
    bare = ", ".join(f"'{w}'" for w in [*scales, "cr."])
    return f"""unit as (
  select claim_id,
    case when u = '' then 'count' when {pct} then 'percent' else coalesce(case {cur} end, case when u in ({bare}) then home end, 'count') end as dimension,
    (case when u = '' then 1.0 when {pct} then case when contains(u, 'bps') or contains(u, 'basis point') then 0.01 else 1.0 end
      else coalesce(case {scale} end, 1.0) end)::double as scale
  from (select claim_id, {_UNIT_TEXT} as u, default_currency as home from c left join witness using (witness_id))
)"""


_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\\.?"
_MON = "(1 + (strpos('janfebmaraprmayjunjulaugsepoctnovdec', {m}) - 1) // 3)"


def _try_day(y: str, m: str, d: str) -> str:
    return f"try_cast(lpad(cast({y} as varchar), 4, '0') || '-' || lpad(cast({m} as varchar), 2, '0') || '-' || lpad(cast({d} as varchar), 2, '0') as date)"


def _full(n: str) -> str:
    """A two- or four-digit year."""
    return f"(case when try_cast({n} as int) < 100 then try_cast({n} as int) + 2000 else try_cast({n} as int) end)"


PERIOD = rf"""per0 as (
  select claim_id, lower(trim(regexp_replace(period_raw, '\s+', ' ', 'g'))) as t from c where period_raw is not null
), per1 as (
  select *, regexp_extract(t, '\b(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})\b', ['y', 'm', 'd']) as iso,
    regexp_extract(t, '\b(\d{{1,2}})(?:st|nd|rd|th)? (?:of )?{_MONTH},? (\d{{4}})\b', ['d', 'm', 'y']) as dmy,
    regexp_extract(t, '\b{_MONTH} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})\b', ['m', 'd', 'y']) as mdy,
    regexp_extract(t, '\b{_MONTH},? (?:of )?(\d{{4}})\b', ['m', 'y']) as my,
    regexp_extract(t, '(?:^|[^\d/.-])(?:(?:fy|f\.y\.|fiscal(?: year)?|financial year)\s*)?(\d{{4}}|\d{{2}})\s*[-/–]\s*(\d{{4}}|\d{{2}})(?:$|[^\d\s/–.-]|\s)', ['a', 'b']) as span,
    regexp_extract(t, '\b(?:fy|f\.y\.|fiscal(?: year)?|financial year)\s*['' ]?(\d{{4}}|\d{{2}})\b', 1) as single,
    regexp_extract(t, '\b(?:cy|calendar year)\s*(\d{{4}}|\d{{2}})\b', 1) as cal,
    regexp_extract(t, '\bq([1-4])\b', 1) as q, regexp_extract(t, '\b(h1|h2|1h|2h|9m)\b', 1) as part,
    regexp_extract(t, '\bfirst (one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|\d{{1,2}}) months?\b', 1) as fst
  from per0
), per2 as (
  select *, coalesce({_try_day('iso.y', 'iso.m', 'iso.d')},
      case when dmy.m <> '' then {_try_day('dmy.y', _MON.format(m='dmy.m'), 'dmy.d')} end,
      case when mdy.m <> '' then {_try_day('mdy.y', _MON.format(m='mdy.m'), 'mdy.d')} end) as day,
    case when my.m <> '' then {_try_day('my.y', _MON.format(m='my.m'), '1')} end as month1,
    case when span.a <> '' and {_full('span.b')} = {_full('span.a')} + 1 then {_full('span.b')} end as span_close,
    case when span.a <> '' and {_full('span.b')} > {_full('span.a')} + 1 then {_full('span.a')} end as multi_a,
    case when span.a <> '' and {_full('span.b')} > {_full('span.a')} + 1 then {_full('span.b')} end as multi_b,
    case when single <> '' then {_full('single')} end as single_close,
    case when cal <> '' then {_full('cal')} end as cal_year
  from per1
), per3 as (
  select *, coalesce(span_close, case when multi_a is null then single_close end) as closing,
    greatest(1, least(12, coalesce(list_position(['one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve'], nullif(fst, '')), try_cast(nullif(fst, '') as int)))) as months
  from per2
), per4 as (
  select *, case when multi_a is not null and span_close is null then make_date(multi_a, 4, 1) when closing is not null then make_date(closing - 1, 4, 1) end as fs,
    case when multi_a is not null and span_close is null then make_date(multi_b, 4, 1) when closing is not null then make_date(closing, 4, 1) end as fe
  from per3
), per5 as (
  select claim_id, case
      when day is not null and regexp_matches(t, '\bas (?:at|of|on)\b') then [day, day]
      when day is not null and regexp_matches(t, '\b(?:year|period|twelve months?|12 months?) ended\b')
        then case when month(day) = 3 then [make_date(year(day) - 1, 4, 1), make_date(year(day), 4, 1)] else [(day - interval 12 month)::date, day] end
      when fs is not null then case
        when fst <> '' then [fs, (fs + to_months(months::int))::date]
        when q = '4' then [(fe - interval 3 month)::date, fe]
        when q <> '' then [(fs + to_months(3 * (q::int - 1)))::date, (fs + to_months(3 * q::int))::date]
        when part in ('h1', '1h') then [fs, (fs + interval 6 month)::date]
        when part in ('h2', '2h') then [(fs + interval 6 month)::date, (fs + interval 12 month)::date]
        when part = '9m' then [fs, (fs + interval 9 month)::date]
        else [fs, fe] end
      when cal_year is not null then [make_date(cal_year, 1, 1), make_date(cal_year + 1, 1, 1)]
      when day is not null then [day, day]
      when month1 is not null then [month1, (month1 + interval 1 month)::date]
      when length(t) <= 6 and regexp_matches(t, '^(19|20)\d\d\b.{{0,2}}$') then [make_date(left(t, 4)::int, 1, 1), make_date(left(t, 4)::int + 1, 1, 1)]
    end as span,
    case
      when day is not null and regexp_matches(t, '\bas (?:at|of|on)\b') then 'instant'
      when day is not null and regexp_matches(t, '\b(?:year|period|twelve months?|12 months?) ended\b') then 'year'
      when fs is not null then case when fst <> '' then case when months = 12 then 'year' else 'part' end when q <> '' then 'quarter'
        when part in ('h1', '1h', 'h2', '2h') then 'half' when part = '9m' then 'period' when multi_a is not null and span_close is null then 'multi' else 'year' end
      when cal_year is not null then 'year' when day is not null then 'instant' when month1 is not null then 'month'
      when length(t) <= 6 and regexp_matches(t, '^(19|20)\d\d\b.{{0,2}}$') then 'year'
    end as grain
  from per4
), per as (select claim_id, span[1] as starts, span[2] as ends, grain from per5 where span is not null)"""


def relation_sql(a: str, b: str) -> str:
    """How the periods of two aliases with ``starts, ends, grain`` lie."""
    return f"""case when {a}.starts is null or {b}.starts is null then 'unstated'
      when {a}.starts = {b}.starts and {a}.ends = {b}.ends and {a}.grain = {b}.grain then 'equal'
      when not (case when {a}.starts = {a}.ends or {b}.starts = {b}.ends then {a}.starts = {b}.starts else {a}.starts < {b}.ends and {b}.starts < {a}.ends end) then 'disjoint'
      when ({a}.starts <= {b}.starts and {b}.ends <= {a}.ends) or ({b}.starts <= {a}.starts and {a}.ends <= {b}.ends) then 'nested' else 'partial' end"""


def basis_sql(families: dict[str, list[tuple[str, str]]], noise: list[str], least: int, most: int) -> str:
    """A CTE ``bas(claim_id, tokens)`` over ``c``; ``quals`` of a measure's name come from ``spl``."""
    cases = ", ".join("case " + " ".join(f"when regexp_matches(blob, '{p}') then '{t}'" for p, t in patterns) + " end" for patterns in families.values())
    known = "|".join(p for patterns in families.values() for p, _ in patterns)
    words = ", ".join(f"'{w}'" for w in noise)
    return f"""bas0 as (
  select claim_id, lower(coalesce(basis_raw, '')) as stated,
    lower(coalesce(basis_raw, '')) || ' ' || lower(array_to_string(list_concat(coalesce(qualifiers, []), coalesce(quals, [])), ' ')) as blob
  from c left join spl using (claim_id)
), bas as (
  select claim_id, list_sort(list_distinct(list_concat(list_filter([{cases}], lambda x: x is not null),
    list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(stated, '{known}', ' ', 'g'), '[a-z][a-z_]{{2,}}'), lambda w: length(w) >= {least} and w not in ({words}))))[1:{most}]))) as tokens
  from bas0
)"""


def split_sql(qualifier: str) -> str:
    """A CTE ``spl(claim_id, name, quals)`` over ``c``."""
    return rf"""spl0 as (
  select claim_id, trim(regexp_replace(measure_raw, '[\s\x{{a0}}]+', ' ', 'g')) as t from c where measure_raw is not null
), spl1 as (
  select claim_id, t, list_transform(list_filter(regexp_extract_all(t, '[(\[]([^)\]]{{2,40}})[)\]]', 1), lambda q: regexp_matches(q, '(?i)^\s*{qualifier}\s*$')), lambda q: lower(trim(q))) as quals,
    regexp_replace(trim(regexp_replace(regexp_replace(t, '(?i)[(\[]\s*{qualifier}\s*[)\]]', ' ', 'g'), '\s+', ' ', 'g')), '(?i)(?:\s*[(\[]\s*(?:[ivxlcdm]{{1,5}}|\d{{1,2}}|[a-z])\s*[)\]]\s*)+$', '') as rest
  from spl0
), spl as (
  select claim_id, coalesce(nullif(regexp_replace(rest, '^[ \-–—:,]+|[ \-–—:,]+$', '', 'g'), ''), t) as name, quals from spl1
)"""


def key_sql(text: str, stopwords: list[str]) -> str:
    """The content key of a text expression as a list."""
    stop = ", ".join(f"'{w}'" for w in stopwords)
    stem = "case when length(w) > 4 and w like '%ies' then left(w, length(w) - 3) || 'y' when length(w) > 3 and w like '%s' and w not like '%ss' then left(w, length(w) - 1) else w end"
    return f"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda w: length(w) > 1 and w not in ({stop})), lambda w: {stem})))"


def canonical_sql(text: str) -> str:
    legal = r"\b(?:limited|ltd\.?|private|pvt\.?|inc\.?|incorporated|plc|llp|llc|corp\.?|corporation|company|co\.?|s\.a\.|n\.v\.|gmbh)(\W|$)"
    # The legal form may touch the next one, so it is taken away twice.
    once = f"regexp_replace(lower(coalesce({text}, '')), '{legal}', '\\1', 'g')"
    twice = f"regexp_replace({once}, '{legal}', '\\1', 'g')"
    return f"trim(regexp_replace(regexp_replace({twice}, '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


VERDICT_KIND = r"regexp_replace(lower(verdict), '^\s+|\s+$', '', 'g')"
