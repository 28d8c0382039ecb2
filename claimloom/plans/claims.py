"""Queries of the claim pipeline, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import basis as B
from claimloom.functions import labels as L
from claimloom.functions import period as P
from claimloom.functions import quantity as Q
from claimloom.operators import cascade, pairs, reports, resolve, store
from claimloom.operators.frames import claim_counts, unframed
from claimloom.plans import sql as S
from claimloom.sources.adapters import claims, framed
from claimloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_UNIT = S.unit_sql(Q.CURRENCIES, Q.SCALES, Q.PERCENT)
_SPLIT = S.split_sql(r"(?:consolidated|standalone|separate|audited|unaudited|restated|revised|provisional|estimated|net|gross|nominal|real|annualised|annualized|seasonally\s+adjusted|per\s+capita|excluding[^)\]]*|including[^)\]]*)")
_BASIS = S.basis_sql(B.FAMILIES, B.NOISE, B.LEAST_LETTERS, B.MOST_WORDS)
_PERIOD = S.PERIOD

# Claims with their coordinates, as the frame operator gives them.
_SELF = ", ".join(f"'{w}'" for w in L.SELF_REFERENCE)
_NAME = rf"trim(regexp_replace(coalesce(entity_raw, ''), '[\s\x{{a0}}]+', ' ', 'g'))"
_HINT = r"nullif(trim(regexp_replace(coalesce(publisher, ''), '[\s\x{a0}]+', ' ', 'g')), '')"
_FRAME = (
    f"with {S.NUMBER}, {_UNIT}, {_PERIOD}, {_SPLIT}, {_BASIS}"
    + rf""", ent0 as (
  select claim_id, {_NAME} as n, {_HINT} as hint, title, vintage_raw from c left join witness using (witness_id)
), ent as (
  select claim_id, title, case when regexp_matches(vintage_raw, '^\d{{4}}-\d\d-\d\d') then try_cast(left(vintage_raw, 10) as date) end as vintage,
    nullif({S.canonical_sql("case when n = '' or (regexp_replace(lower(n), '^[ .,]+|[ .,]+$', '', 'g') in (" + _SELF + ") and hint is not null) then coalesce(hint, n) else n end")}, '') as entity
  from ent0
), frm0 as (
  select c.claim_id, c.witness_id, c.claim_type, c.measure_raw, c.value_raw, c.unit_raw, c.period_raw, c.confidence, ent.title, ent.vintage, ent.entity,
    num.value * unit.scale as value, case when num.value is null then nullif(trim(c.value_raw), '') end as value_text, case when num.value is not null then unit.dimension end as dim,
    per.starts, per.ends, per.grain, bas.tokens, nullif(array_to_string({S.key_sql("spl.name", L.STOPWORDS)}, ' '), '') as measure
  from c join ent using (claim_id) left join num using (claim_id) left join unit using (claim_id) left join per using (claim_id) left join spl using (claim_id) left join bas using (claim_id)
), frm as (select *, case when entity is not null and measure is not null then entity || ':' || measure end as lemma_key from frm0)"""
)


@query(f"with {S.NUMBER} select claim_id, round(value, 6) as value, round(low, 6) as low, round(high, 6) as high from num where value is not null")
def parse_number(spark: SparkSession, folder: str) -> DataFrame:
    n = claims(spark, folder).select("claim_id", Q.parse_number(F.col("value_raw")).alias("n")).where("n is not null")
    return n.select("claim_id", *[F.round(f"n.{c}", 6).alias(c) for c in ("value", "low", "high")])


@query(f"with {S.CLAIM}, {_UNIT} select claim_id, dimension, scale from unit")
def parse_unit(spark: SparkSession, folder: str) -> DataFrame:
    rows = claims(spark, folder).join(table(spark, folder, "witness").select("witness_id", "default_currency"), "witness_id", "left")
    return rows.select("claim_id", Q.parse_unit(F.col("unit_raw"), F.col("default_currency")).alias("u")).select("claim_id", "u.dimension", "u.scale")


@query(f"with {S.NUMBER}, {_UNIT} select claim_id, dimension, round(value * scale, 3) as value from num join unit using (claim_id) where value is not null")
def parse_quantity(spark: SparkSession, folder: str) -> DataFrame:
    rows = claims(spark, folder).join(table(spark, folder, "witness").select("witness_id", "default_currency"), "witness_id", "left")
    q = rows.select("claim_id", Q.parse_quantity(F.col("value_raw"), F.col("unit_raw"), F.col("default_currency")).alias("q")).where("q is not null")
    return q.select("claim_id", "q.dimension", F.round("q.value", 3).alias("value"))


_SIG = "round_even(abs({x}) / pow(10.0, floor(log10(abs({x}))) - 2), 0)::bigint"


@query(
    f"""with {S.NUMBER}, {_UNIT}, q as (select claim_id, value * scale as v from num join unit using (claim_id) where value is not null),
    p as (select verdict_id, a.v as va, b.v as vb from verdict join q a on a.claim_id = claim_a join q b on b.claim_id = claim_b),
    s as (select *, {_SIG.format(x="va")} as ma, {_SIG.format(x="vb")} as mb, floor(log10(abs(va))) as ea, floor(log10(abs(vb))) as eb from p where va <> 0 and vb <> 0)
    select verdict_id, round(case when greatest(abs(va), abs(vb)) = 0 then 0 else abs(va - vb) / greatest(abs(va), abs(vb)) end, 6) as gap,
      case when va = 0 or vb = 0 then va = vb else (select sign(va) = sign(vb) and case when ma = 1000 then 100 else ma end = case when mb = 1000 then 100 else mb end
        and case when ma = 1000 then ea + 1 else ea end = case when mb = 1000 then eb + 1 else eb end from s where s.verdict_id = p.verdict_id) end as same from p"""
)
def value_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Relative gap and agreement to three figures of the claims of each verdict."""
    f = framed(spark, folder).where("value is not null").select("claim_id", "value")
    both = reports.with_claims(table(spark, folder, "verdict").select("verdict_id", "claim_a", "claim_b"), f, ["value"])
    return both.select("verdict_id", F.round(Q.relative_gap(F.col("a_value"), F.col("b_value")), 6).alias("gap"), Q.same_to_figures(F.col("a_value"), F.col("b_value")).alias("same"))


@query(f"with {S.CLAIM}, {_PERIOD} select claim_id, starts, ends, grain from per")
def parse_period(spark: SparkSession, folder: str) -> DataFrame:
    p = claims(spark, folder).select("claim_id", P.parse_period(F.col("period_raw")).alias("p")).where("p is not null")
    return p.select("claim_id", F.col("p.start").alias("starts"), F.col("p.end").alias("ends"), "p.grain")


@query(
    f"""with {S.CLAIM}, {_PERIOD}, r as (select verdict_id, claim_a, claim_b from verdict join c a on a.claim_id = claim_a join c b on b.claim_id = claim_b)
    select verdict_id, {S.relation_sql("a", "b")} as relation from r left join per a on a.claim_id = claim_a left join per b on b.claim_id = claim_b"""
)
def period_relation(spark: SparkSession, folder: str) -> DataFrame:
    dated = claims(spark, folder).select("claim_id", P.parse_period(F.col("period_raw")).alias("period"))
    both = reports.with_claims(table(spark, folder, "verdict").select("verdict_id", "claim_a", "claim_b"), dated, ["period"])
    return both.select("verdict_id", P.relation(F.col("a_period"), F.col("b_period")).alias("relation"))


@query(f"with {S.CLAIM}, spl as (select claim_id, []::varchar[] as quals from c), {_BASIS} select claim_id, array_to_string(tokens, ',') as tokens from bas")
def basis_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return claims(spark, folder).select("claim_id", F.array_join(B.basis_tokens(F.col("basis_raw"), F.col("qualifiers")), ",").alias("tokens"))


_LADDER = "[" + ", ".join(f"'{s}'" for s in B.STAGES) + "]"


@query(
    f"""with {S.CLAIM}, spl as (select claim_id, []::varchar[] as quals from c), {_BASIS},
    r as (select claim_id, list_max(list_transform(tokens, lambda t: list_position({_LADDER}, t))) as n from bas)
    select claim_id, {_LADDER}[n] as stage, (n - 1)::int as rank from r where n > 0"""
)
def stage_ranks(spark: SparkSession, folder: str) -> DataFrame:
    t = claims(spark, folder).select("claim_id", B.basis_tokens(F.col("basis_raw"), F.col("qualifiers")).alias("t"))
    return t.select("claim_id", B.stage_of(F.col("t")).alias("stage"), B.stage_rank(F.col("t")).alias("rank")).where("stage is not null")


@query(f"with {S.CLAIM}, {_SPLIT} select claim_id, name, array_to_string(quals, ',') as qualifiers from spl")
def split_qualifiers(spark: SparkSession, folder: str) -> DataFrame:
    s = claims(spark, folder).where("measure_raw is not null").select("claim_id", L.split_qualifiers(F.col("measure_raw")).alias("s"))
    return s.select("claim_id", "s.name", F.array_join("s.qualifiers", ",").alias("qualifiers"))


@query(f"select measure_id, array_to_string({S.key_sql('canonical_label', L.STOPWORDS)}, ' ') as key from measure")
def content_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "measure").select("measure_id", F.array_join(L.content_key(F.col("canonical_label")), " ").alias("key"))


@query(
    f"""with {S.CLAIM}, k as (select claim_id, {S.key_sql("measure_raw", L.STOPWORDS)} as k from c)
    select verdict_id, len(list_filter(a.k, lambda x: not list_contains(b.k, x))) > 0 and len(list_filter(b.k, lambda x: not list_contains(a.k, x))) > 0 as substitutes
    from verdict join k a on a.claim_id = claim_a join k b on b.claim_id = claim_b"""
)
def substituting_measures(spark: SparkSession, folder: str) -> DataFrame:
    keyed = claims(spark, folder).select("claim_id", L.content_key(F.col("measure_raw")).alias("key"))
    both = reports.with_claims(table(spark, folder, "verdict").select("verdict_id", "claim_a", "claim_b"), keyed, ["key"])
    return both.select("verdict_id", L.substitutes(F.col("a_key"), F.col("b_key")).alias("substitutes"))


_SLUG = "coalesce(nullif(left(regexp_replace(regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 60), ''), 'unnamed')"


@query(
    f"""with s as (select measure_id, {_SLUG.format(t="canonical_label")} as b from measure), n as (select *, row_number() over (partition by b order by measure_id) as k from s)
    select measure_id, case when k = 1 then b else b || '_' || k end as slug from n"""
)
def slugs(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.unique_slugs(table(spark, folder, "measure").select("measure_id", "canonical_label"), "canonical_label", ["measure_id"]).select("measure_id", "slug")


@query(f"select entity_raw, {S.canonical_sql('entity_raw')} as form from (select distinct entity_raw from claim where entity_raw is not null)")
def canonical_entities(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "claim").where("entity_raw is not null").select("entity_raw").distinct()
    return names.select("entity_raw", L.canonical_form(F.col("entity_raw")).alias("form"))


_TITLE = r"trim(regexp_replace(coalesce(title, filename), '\s+', ' ', 'g'))"


@query(
    rf"""with t as (select witness_id, {_TITLE} as t from witness), w as (select witness_id, t, trim(regexp_replace(translate(t, ';—', '  '), '\s+', ' ', 'g')) as s from t)
    select witness_id, case when length(t) <= 30 then t else coalesce(nullif(regexp_extract(s, '^(.{{0,30}})(?: |$)', 1), ''), left(t, 30)) end as label from w"""
)
def short_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "witness").select("witness_id", L.short_label(F.coalesce("title", "filename")).alias("label"))


@query(f"{_FRAME} select claim_id, lemma_key, dim as unit_dim, round(value, 3) as value, starts, ends, array_to_string(tokens, ',') as basis, vintage from frm")
def frames(spark: SparkSession, folder: str) -> DataFrame:
    f = framed(spark, folder)
    return f.select("claim_id", "lemma_key", "unit_dim", F.round("value", 3).alias("value"), F.col("period.start").alias("starts"), F.col("period.end").alias("ends"), F.array_join("basis", ",").alias("basis"), "vintage")


@query(f"{_FRAME} select claim_id from frm where lemma_key is null")
def claims_without_frame(spark: SparkSession, folder: str) -> DataFrame:
    f = framed(spark, folder)
    return unframed(claims(spark, folder), f.where("lemma_key is not null")).select("claim_id")


@query(f"{_FRAME} select measure as measure_key, count(*) as n_claims from frm where measure is not null group by 1")
def measure_claim_counts(spark: SparkSession, folder: str) -> DataFrame:
    return claim_counts(framed(spark, folder), "measure_key")


_PAIRS = _FRAME + ", pr as (select a.lemma_key, a.claim_id as claim_a, b.claim_id as claim_b from frm a join frm b on a.lemma_key = b.lemma_key and a.claim_id < b.claim_id and (a.witness_id <> b.witness_id or a.starts is not distinct from b.starts))"


@query(f"{_PAIRS} select lemma_key, claim_a, claim_b from pr")
def lemma_pairs(spark: SparkSession, folder: str) -> DataFrame:
    p = pairs.lemma_pairs(framed(spark, folder))
    return p.select("lemma_key", F.col("a.claim_id").alias("claim_a"), F.col("b.claim_id").alias("claim_b"))


def _capped(most: int) -> str:
    return f"{_PAIRS}, cp as (select *, row_number() over (partition by lemma_key order by claim_a, claim_b) as n from pr)"


@query(f"{_capped(3)} select lemma_key, claim_a, claim_b from cp where n <= 3")
def lemma_pairs_capped(spark: SparkSession, folder: str) -> DataFrame:
    """At most three pairs a lemma, so that the cap matters on small tables too."""
    p = pairs.capped_lemma_pairs(framed(spark, folder), 3)
    return p.select("lemma_key", F.col("a.claim_id").alias("claim_a"), F.col("b.claim_id").alias("claim_b"))


def _family(x: str, members: list[str]) -> str:
    return "list_sort(list_filter(" + x + ".tokens, lambda t: t in (" + ", ".join(f"'{m}'" for m in members) + ")))"


def _clean(x: str) -> str:
    return rf"lower(trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g')))"


_RULED = (
    _capped(400)
    + f""", f0 as (
  select a.claim_id as claim_a, b.claim_id as claim_b, a.witness_id = b.witness_id as inner_, a.dim as da, b.dim as db, a.value as va, b.value as vb, a.vintage as na, b.vintage as nb, a.tokens as ka, b.tokens as kb,
    {S.relation_sql("a", "b")} as periods, {_clean("a.unit_raw")} = {_clean("b.unit_raw")} as same_unit, {_family("a", B.CONSOLIDATION)} as ca, {_family("b", B.CONSOLIDATION)} as cb, {_family("a", B.ADJUSTMENT)} as ja, {_family("b", B.ADJUSTMENT)} as jb,
    a.claim_type in ('state', 'event') and b.claim_type in ('state', 'event') as states, lower(trim(coalesce(nullif(a.value_text, ''), a.value_raw, ''))) as ta, lower(trim(coalesce(nullif(b.value_text, ''), b.value_raw, ''))) as tb,
    coalesce(contains(a.value_raw, '('), false) or coalesce(contains(b.value_raw, '('), false) as bracket, least(coalesce(nullif(a.confidence, 0), 0.5), coalesce(nullif(b.confidence, 0), 0.5)) as trust,
    list_max(list_transform(a.tokens, lambda t: list_position({_LADDER}, t))) as ra, list_max(list_transform(b.tokens, lambda t: list_position({_LADDER}, t))) as rb
  from cp join frm a on a.claim_id = claim_a join frm b on b.claim_id = claim_b where n <= 400
), f1 as (
  select *, case when va is null or vb is null then null when greatest(abs(va), abs(vb)) = 0 then 0 else abs(va - vb) / greatest(abs(va), abs(vb)) end as gap,
    case when va is null or vb is null then null when greatest(abs(va), abs(vb)) = 0 then 0 else abs(abs(va) - abs(vb)) / greatest(abs(va), abs(vb)) end as size_gap,
    case when va <> 0 and vb <> 0 then {_SIG.format(x="nullif(va, 0)")} end as ma, case when va <> 0 and vb <> 0 then {_SIG.format(x="nullif(vb, 0)")} end as mb,
    case when va <> 0 then floor(log10(abs(nullif(va, 0)))) end as ea, case when vb <> 0 then floor(log10(abs(nullif(vb, 0)))) end as eb
  from f0
), f2 as (
  select *, va is not null and vb is not null as numeric_, na is not null and nb is not null and na <> nb as dated,
    case when va = 0 or vb = 0 then va = vb else sign(va) = sign(vb) and case when ma = 1000 then 100 else ma end = case when mb = 1000 then 100 else mb end and case when ma = 1000 then ea + 1 else ea end = case when mb = 1000 then eb + 1 else eb end end as figures
  from f1
), f3 as (
  select *, case
      when da is not null and db is not null and da <> db then 'DIMENSION_MISMATCH'
      when states and ta <> '' and tb <> '' and ta <> tb and dated then 'STATE_SUPERSEDED'
      when states and ta <> '' and tb <> '' and ta <> tb then 'STATE_CONFLICT'
      when periods = 'unstated' then 'PERIOD_UNSTATED' when periods = 'disjoint' then 'PERIOD_DISJOINT' when periods = 'nested' then 'PERIOD_NESTED' when periods = 'partial' then 'PERIOD_PARTIAL'
      when len(ca) > 0 and len(cb) > 0 and ca <> cb then 'BASIS_MISMATCH'
      when len(ja) > 0 and len(jb) > 0 and ja <> jb then 'ADJUSTMENT_MISMATCH'
      when numeric_ and (gap <= 0.005 or figures) and not same_unit then 'UNIT_SCALE'
      when numeric_ and (gap <= 0.005 or figures) and gap > 0 then 'ROUNDING'
      when numeric_ and (gap <= 0.005 or figures) then 'EXACT'
      when numeric_ and va * vb < 0 and size_gap <= 0.005 and bracket then 'SIGN_CONVENTION'
      when numeric_ and ra > 0 and rb > 0 and ra <> rb then 'VINTAGE_REVISION'
      when numeric_ and dated and gap <= 0.15 and (list_contains(case when na < nb then kb else ka end, 'restated') or list_contains(case when na < nb then kb else ka end, 'revised')) then 'RESTATEMENT'
      when numeric_ then 'CONTRADICTS' else 'NO_RULE' end as rule_id
  from f2
)"""
)
_VERDICT = "case rule_id " + " ".join(f"when '{r}' then '{v}'" for r, v in cascade.VERDICTS.items()) + " end"


@query(
    f"""{_RULED} select claim_a, claim_b, rule_id, {_VERDICT} as verdict,
    round(case when rule_id in ('EXACT', 'SIGN_CONVENTION') then 0 when rule_id in ('UNIT_SCALE', 'ROUNDING', 'VINTAGE_REVISION', 'RESTATEMENT', 'CONTRADICTS') then gap end, 6) as divergence,
    round(case when rule_id = 'CONTRADICTS' then least(1.0, gap * 2) * (0.5 + 0.5 * trust) * case when inner_ then 0.6 else 1.0 end when rule_id = 'STATE_CONFLICT' then 0.6 end + 1e-9, 2) as severity from f3"""
)
def adjudicate(spark: SparkSession, folder: str) -> DataFrame:
    r = cascade.rule_pairs(pairs.capped_lemma_pairs(framed(spark, folder)))
    # Severity has three places; two are compared, for a third may round either way.
    trust = lambda s: F.coalesce(F.nullif(F.col(s)["confidence"], F.lit(0.0)), F.lit(0.5))
    weight = F.least(F.lit(1.0), F.col("gap") * 2) * (0.5 + 0.5 * F.least(trust("a"), trust("b"))) * F.when(F.col("a.witness_id") == F.col("b.witness_id"), 0.6).otherwise(1.0)
    severity = F.round(F.when(F.col("rule_id") == "CONTRADICTS", weight).when(F.col("rule_id") == "STATE_CONFLICT", F.lit(0.6)) + 1e-9, 2)
    return r.select(F.col("a.claim_id").alias("claim_a"), F.col("b.claim_id").alias("claim_b"), "rule_id", "verdict", F.round("divergence", 6).alias("divergence"), severity.alias("severity"))


@query(f"{_RULED} select rule_id, {_VERDICT} as verdict, count(*) as n from f3 group by rule_id")
def rulings_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    r = cascade.rule_pairs(pairs.capped_lemma_pairs(framed(spark, folder)))
    return r.groupBy("rule_id", "verdict").agg(F.count("*").alias("n"))


@query()
def rulings_explained(spark: SparkSession, folder: str) -> DataFrame:
    return cascade.adjudicate(pairs.capped_lemma_pairs(framed(spark, folder)))


@query(f"select {S.VERDICT_KIND} as kind, rule_id, count(*) as n, grouping(kind, rule_id)::int as level from (select verdict, rule_id, {S.VERDICT_KIND} as kind from verdict) group by rollup (kind, rule_id)".replace(f"select {S.VERDICT_KIND} as kind, rule_id, count", "select kind, rule_id, count"))
def verdict_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return reports.verdict_rollup(table(spark, folder, "verdict"))


def _drift(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of neighbouring measures about one entity and period."""
    measure = table(spark, folder, "measure")
    keyed = measure.select("measure_id", F.array_join(L.content_key(F.col("canonical_label")), " ").alias("measure_key"), "embedding").where("measure_key <> ''")
    one = keyed.groupBy("measure_key").agg(F.min_by("embedding", "measure_id").alias("embedding"))
    near = resolve.neighbours(one, "measure_key", "embedding").select(F.col("a").alias("measure_a"), F.col("b").alias("measure_b"), "score")
    return cascade.drift_rulings(pairs.neighbour_pairs(framed(spark, folder), near))


@query()
def definition_drift(spark: SparkSession, folder: str) -> DataFrame:
    return _drift(spark, folder)


@query(
    """with u0 as materialized (select measure_id, embedding as e from measure where len(embedding) = 64 and not list_contains(list_transform(embedding, lambda x: x is null), true)),
    u as (select * from u0 where list_sum(list_transform(e, lambda x: abs(x))) > 0),
    s as (select a.measure_id as a, b.measure_id as b, list_cosine_similarity(a.e::double[], b.e::double[]) as score from u a join u b on a.measure_id < b.measure_id)
    select a, b, round(score, 5) as score from s where score >= 0.68 and score < 0.80"""
)
def measure_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    n = resolve.neighbours(table(spark, folder, "measure"), "measure_id", "embedding")
    return n.select("a", "b", F.round("score", 5).alias("score"))


@query(
    f"""with t as (select *, least(claim_a, claim_b) as lo, greatest(claim_a, claim_b) as hi, {S.VERDICT_KIND} as kind from verdict where claim_b is not null and claim_a <> claim_b),
    n as (select *, row_number() over (partition by lo, hi order by created_at, verdict_id) as k from t)
    select lo as claim_a, hi as claim_b, verdict_id, kind from n where k = 1"""
)
def verdict_store(spark: SparkSession, folder: str) -> DataFrame:
    """The first verdict on each unordered pair, inserted into an empty store."""
    v = table(spark, folder, "verdict").where("claim_b is not null and claim_a <> claim_b")
    turned = v.select(F.least("claim_a", "claim_b").alias("claim_a"), F.greatest("claim_a", "claim_b").alias("claim_b"), "verdict_id", reports.verdict_kind(F.col("verdict")).alias("kind"), "created_at")
    return store.insert_or_ignore(turned.where("false"), turned, ["claim_a", "claim_b"], [F.col("created_at"), F.col("verdict_id")]).drop("created_at")


@query(
    f"""{_FRAME}, of as (select claim_id as claim_a, lemma_key from frm where lemma_key is not null), rv as (select lemma_key, {S.VERDICT_KIND} as kind from verdict join of using (claim_a)),
    bl as (select lemma_key, count(*) as verdicts, array_to_string(list_sort(list_distinct(list(kind))), ',') as kinds from rv group by 1),
    rl as (select lemma_key, min(measure_raw) as measure, max(entity) as entity, count(*) as readings, count(distinct witness_id) as witnesses from frm where lemma_key is not null group by 1)
    select lemma_key, measure, entity, readings, witnesses, verdicts, kinds from rl join bl using (lemma_key) order by witnesses desc, verdicts desc, readings desc, lemma_key limit 400"""
)
def lemma_rows(spark: SparkSession, folder: str) -> DataFrame:
    return reports.lemma_rows(framed(spark, folder), table(spark, folder, "verdict"))


@query(
    f"""{_FRAME}, of as (select claim_id as claim_a, lemma_key from frm where lemma_key is not null), rv as (select lemma_key, rule_id, {S.VERDICT_KIND} as kind from verdict join of using (claim_a)),
    bl as (select lemma_key, count(*) as verdicts, array_to_string(list_sort(list_distinct(list(kind))), ',') as kinds from rv group by 1),
    rl as (select lemma_key, min(measure_raw) as measure, max(entity) as entity, count(*) as readings, count(distinct witness_id) as witnesses from frm
      where lemma_key is not null and (measure_raw ilike '%margin%' or entity ilike '%margin%') group by 1)
    select lemma_key, measure, entity, readings, witnesses, verdicts, kinds from rl join bl using (lemma_key)
    where exists (from rv where rv.lemma_key = rl.lemma_key and kind = 'corroborates') and exists (from rv where rv.lemma_key = rl.lemma_key and rule_id = 'UNIT_SCALE')
    order by witnesses desc, verdicts desc, readings desc, lemma_key limit 400"""
)
def lemma_rows_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return reports.lemma_rows(framed(spark, folder), table(spark, folder, "verdict"), kind="corroborates", rule="UNIT_SCALE", search="margin")


@query(
    f"""with {S.NUMBER}, h as (
      select v.*, {S.VERDICT_KIND} as kind, a.witness_id <> b.witness_id as across, a.measure_raw as measure, coalesce(a.value_raw, '') <> coalesce(b.value_raw, '') as v_differs, {_clean("a.unit_raw")} <> {_clean("b.unit_raw")} as u_differs, abs(coalesce(num.value, 0)) as size, abs(coalesce(divergence, 0)) as gap
      from verdict v join c a on a.claim_id = claim_a join c b on b.claim_id = claim_b left join num on num.claim_id = claim_a
    ), n as (select *, row_number() over (partition by rule_id order by across desc, v_differs desc, u_differs desc, case when kind = 'corroborates' then gap else -gap end, size desc, verdict_id) as k from h)
    select rule_id, verdict_id, measure, across from n where k = 1"""
)
def highlights(spark: SparkSession, folder: str) -> DataFrame:
    return reports.highlights(table(spark, folder, "verdict"), table(spark, folder, "claim"), Q.parse_number(F.col("value_raw"))["value"])


_W = "[" + ", ".join(f"'{r}'" for r in reports.WRITTEN_TWICE) + "]"
_E = "[" + ", ".join(f"'{r}'" for r in reports.EXPLAINED) + "]"


@query(
    f"""with {S.CLAIM}, h as (select v.*, {S.VERDICT_KIND} as kind, a.witness_id <> b.witness_id as across, a.value_raw, a.claim_type from verdict v join c a on a.claim_id = claim_a join c b on b.claim_id = claim_b)
    select * from (select 1 as case_no, verdict_id, rule_id, across from h where kind = 'corroborates' and list_contains({_W}, rule_id) order by across desc, list_position({_W}, rule_id), length(coalesce(value_raw, '')) desc, verdict_id limit 1)
    union all select * from (select 2, verdict_id, rule_id, across from h where kind = 'contradicts' and claim_type = 'quantity' order by across desc, coalesce(severity, 0) desc, coalesce(divergence, 0) desc, verdict_id limit 1)
    union all select * from (select 3, verdict_id, rule_id, across from h where kind = 'reconciled' and list_contains({_E}, rule_id) order by list_position({_E}, rule_id), across desc, coalesce(divergence, 0) desc, verdict_id limit 1)"""
)
def example_cases(spark: SparkSession, folder: str) -> DataFrame:
    return reports.example_cases(table(spark, folder, "verdict"), table(spark, folder, "claim"))


@query(
    f"""with {S.CLAIM} select verdict_id, claim_a, claim_b, a.measure_raw as a_measure_raw, b.value_raw as b_value_raw, wa.title as a_title, wb.vintage_date as b_vintage
    from verdict join c a on a.claim_id = claim_a join c b on b.claim_id = claim_b join witness wa on wa.witness_id = a.witness_id join witness wb on wb.witness_id = b.witness_id"""
)
def verdict_details(spark: SparkSession, folder: str) -> DataFrame:
    d = reports.verdict_details(table(spark, folder, "verdict"), table(spark, folder, "claim"), table(spark, folder, "witness"))
    return d.select("verdict_id", "claim_a", "claim_b", "a_measure_raw", "b_value_raw", "a_title", "b_vintage")


def _text(x: str) -> str:
    return f"coalesce(cast({x} as varchar), '-')"


@query(
    f"""{_FRAME}, fd as (select claim_id, unnest([{{'field': 'entity', 'v': {_text("entity")}}}, {{'field': 'measure', 'v': {_text("measure_raw")}}}, {{'field': 'period', 'v': {_text("period_raw")}}},
      {{'field': 'period (resolved)', 'v': {_text("starts")} || ' to ' || {_text("ends")}}}, {{'field': 'basis', 'v': coalesce(nullif(array_to_string(tokens, ', '), ''), '-')}},
      {{'field': 'unit', 'v': {_text("unit_raw")} || ' (' || {_text("dim")} || ')'}}, {{'field': 'value', 'v': {_text("value_raw")}}}, {{'field': 'published', 'v': {_text("vintage")}}}]) as f from frm)
    select verdict_id, a.f.field as field, a.f.v as a, b.f.v as b, a.f.v = b.f.v as same from verdict join fd a on a.claim_id = claim_a join fd b on b.claim_id = claim_b and a.f.field = b.f.field"""
)
def frame_diff(spark: SparkSession, folder: str) -> DataFrame:
    # The normalised value is worded by each engine in its own way and is tested apart.
    return reports.frame_diff(table(spark, folder, "verdict"), framed(spark, folder)).where("field <> 'value (normalised)'")


@query(
    f"""{_FRAME}, r as (select *, row_number() over (partition by lemma_key, witness_id, starts, ends, value, dim order by vintage nulls first, claim_id) as k,
        row_number() over (partition by lemma_key, witness_id, starts, ends, value, dim, len(tokens) > 0 order by vintage nulls first, claim_id) as kb from frm where lemma_key is not null and value is not null),
    h as (select lemma_key, witness_id, starts, ends, value, dim, max(case when k = 1 then claim_id end) as first_id, coalesce(max(case when kb = 1 and len(tokens) > 0 then array_to_string(tokens, ',') end), '') as home from r group by all),
    j as (select r.*, h.first_id, h.home, len(r.tokens) = 0 or array_to_string(r.tokens, ',') = h.home as mine from r join h on r.lemma_key = h.lemma_key and r.witness_id = h.witness_id and r.starts is not distinct from h.starts and r.ends is not distinct from h.ends and r.value = h.value and r.dim is not distinct from h.dim)
    select first_id as claim_id, home as basis, count(*)::int as repeats from j where mine group by all union all select claim_id, array_to_string(tokens, ','), 1 from j where not mine
    union all select claim_id, array_to_string(tokens, ','), 1 from frm where lemma_key is not null and value is null"""
)
def reading_fold(spark: SparkSession, folder: str) -> DataFrame:
    f = framed(spark, folder).where("lemma_key is not null").select("lemma_key", "claim_id", "witness_id", F.col("period.start").alias("starts"), F.col("period.end").alias("ends"), "value", "unit_dim", "vintage", "basis")
    return reports.fold_readings(f).select("claim_id", F.array_join("basis", ",").alias("basis"), "repeats")


@query(
    f"""with {S.CLAIM}, t as (select * from verdict order by severity desc nulls last, verdict_id limit 2000)
    select verdict_id, {S.VERDICT_KIND} as verdict, rule_id, a.value_raw as a_value, b.value_raw as b_value from t join c a on a.claim_id = claim_a join c b on b.claim_id = claim_b"""
)
def export_top(spark: SparkSession, folder: str) -> DataFrame:
    e = reports.export_top(table(spark, folder, "verdict"), table(spark, folder, "claim"))
    return e.select("verdict_id", "verdict", "rule_id", F.col("readings")[0]["value_raw"].alias("a_value"), F.col("readings")[1]["value_raw"].alias("b_value"))


@query(f"select verdict_id from verdict where {S.VERDICT_KIND} = 'contradicts' order by severity desc nulls last, verdict_id limit 40")
def escalation_queue(spark: SparkSession, folder: str) -> DataFrame:
    return reports.escalation_queue(table(spark, folder, "verdict")).select("verdict_id")


@query(
    f"""with {S.CLAIM}, p as (select distinct on (page_id) * from page)
    select claim_id, title, vintage_date, page_id, printed_label from c left join witness using (witness_id) left join p on p.witness_id = c.witness_id and p.page_no = c.page_no"""
)
def claim_details(spark: SparkSession, folder: str) -> DataFrame:
    d = reports.claim_details(table(spark, folder, "claim"), table(spark, folder, "witness"), table(spark, folder, "page"))
    return d.select("claim_id", "title", "vintage_date", "page_id", "printed_label")


_COUNTED = ["witness", "page", "passage", "measure", "claim", "verdict"]


@query(" union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in _COUNTED))
def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return reports.corpus_stats({t: table(spark, folder, t) for t in _COUNTED})


@query(
    """with g as (select witness_id from witness where status = 'segmented'), cl as (select * from claim where witness_id not in (from g)), k as (select distinct claim_id from cl), ps as (select passage_id from passage where witness_id not in (from g))
    select 'witness' as name, count(*) as n, 0 as cleared from witness where witness_id not in (from g)
    union all select 'page', count(*), 0 from page where witness_id not in (from g) union all select 'passage', count(*), 0 from passage where witness_id not in (from g)
    union all select 'claim', count(*), count(*) filter (passage_id is null or passage_id not in (from ps)) from cl
    union all select 'verdict', count(*), 0 from verdict where claim_a in (from k) and claim_b in (from k)
    union all select 'measure', count(*), count(*) filter (first_seen_in is null or first_seen_in in (from g)) from measure"""
)
def deleted_witnesses(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each table without the witnesses that were never finished, and how many references are empty."""
    tables = {t: table(spark, folder, t) for t in _COUNTED}
    left = store.delete_witnesses(tables, tables["witness"].where("status = 'segmented'"))
    empty = {"claim": "passage_id", "measure": "first_seen_in"}
    out = None
    for name in _COUNTED:
        cleared = F.count_if(F.col(empty[name]).isNull()) if name in empty else F.lit(0).cast("long")
        one = left[name].agg(F.count("*").alias("n"), (F.max(cleared) if name not in empty else cleared).alias("cleared")).select(F.lit(name).alias("name"), "n", F.coalesce("cleared", F.lit(0)).alias("cleared"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def resolved_measures(spark: SparkSession, folder: str) -> DataFrame:
    named = claims(spark, folder).select("claim_id", "witness_id", L.split_qualifiers(F.col("measure_raw"))["name"].alias("name"))
    return resolve.resolve_measures(named, "name", ["witness_id", "claim_id"])


@query()
def resolved_entities(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.resolve_entities(claims(spark, folder), "entity_raw", ["witness_id", "claim_id"])
