"""Queries of segmentation, anchoring and loading, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import anchor, reports, segment, store
from claimloom.sources import adapters
from claimloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PAGE = "p as (select distinct on (page_id) * from page)"
_BLOCK = (
    _PAGE
    + r""", bl0 as (select witness_id, page_no, width, unnest(string_split(text, E'\n\n')) as text, generate_subscripts(string_split(text, E'\n\n'), 1) - 1 as pos from p where text <> ''),
    bl as (select witness_id, page_no, width, pos, text, case when text like '|%' then 'table' else 'prose' end as kind, case when pos % 7 = 6 or pos % 2 = 0 then 40.0 else width / 2 + 10 end as x0,
      50.0 + (pos // 2) * 20.0 as y0, case when pos % 7 = 6 or pos % 2 = 1 then width - 40 else width / 2 - 10 end as x1, 65.0 + (pos // 2) * 20.0 as y1 from bl0),
    co as (select witness_id, page_no, count(*) filter (x1 < width / 2 + 8) as l, count(*) filter (not x1 < width / 2 + 8 and x0 > width / 2 - 8) as r, count(*) filter (not x1 < width / 2 + 8 and not x0 > width / 2 - 8) as s from bl group by 1, 2),
    cn as (select witness_id, page_no, case when l + r >= 6 and l >= 2 and r >= 2 and s <= (l + r) * 0.35 then 2 else 1 end as n_columns from co),
    od as (select bl.*, row_number() over (partition by witness_id, page_no order by case when n_columns = 1 or (x0 <= width / 2 - 8 and x1 >= width / 2 + 8) or x1 < width / 2 + 8 then 0 else 1 end, round(y0, 1), x0, pos) - 1 as idx from bl join cn using (witness_id, page_no)),
    ofs as (select *, coalesce(sum(length(text) + 2) over (partition by witness_id, page_no order by idx rows between unbounded preceding and 1 preceding), 0)::int as char_start from od)"""
)


def _ordered(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    pages = adapters.pages(spark, folder)
    return segment.reading_order(adapters.blocks(pages), pages), pages


@query(f"with {_BLOCK} select witness_id, page_no, n_columns from cn")
def page_columns(spark: SparkSession, folder: str) -> DataFrame:
    pages = adapters.pages(spark, folder)
    return segment.page_columns(adapters.blocks(pages), pages)


@query(f"with {_BLOCK} select witness_id, page_no, pos, idx, char_start, (char_start + length(text))::int as char_end from ofs")
def block_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return segment.block_offsets(_ordered(spark, folder)[0]).select("witness_id", "page_no", "pos", "idx", "char_start", "char_end")


@query(f"with {_BLOCK} select witness_id, page_no, md5(string_agg(text, E'\\n\\n' order by idx)) as digest from od group by 1, 2")
def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return segment.page_texts(_ordered(spark, folder)[0]).select("witness_id", "page_no", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    """select r_name, '| key | name |' || E'\\n' || '|---|---|' || E'\\n' || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', E'\\n' order by n_nationkey) as body
    from nation join region on n_regionkey = r_regionkey group by r_name"""
)
def printed_tables(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    cells = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform("rows", lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"])))
    region = table(spark, folder, "region")
    return rows.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", segment.table_text(cells).alias("body"))


_MARK = r"(?i)\(?\s*(?:in\s+)?(?:(?:rs\.?|inr|₹|us\s?\$|usd|\$|€|eur)\s*)?(?:in\s+)?(?:million|billion|trillion|crore|lakhs|lakh|thousand|mn|bn|tn|cr|hundreds)s?\b"
_BASIS = r"(?i)\b(?:consolidated|standalone|unaudited|audited|restated|provisional|revised|pro\s?forma|estimated|projected|annualis?zed|seasonally\s+adjusted)\b"
_FLAT = r"left(trim(regexp_replace({t}, '[\s\x{{a0}}\x{{202f}}\x{{2009}}\x{{3000}}]+', ' ', 'g')), 200)"


@query(
    rf"""with {_BLOCK}, mk as (select witness_id, page_no, pos, y1, {_FLAT.format(t="text")} as header from bl where kind = 'prose' and (regexp_matches(text, '{_MARK}') or regexp_matches(text, '{_BASIS}'))),
    nr as (select t.witness_id, t.page_no, t.pos, m.header, row_number() over (partition by t.witness_id, t.page_no, t.pos order by t.y0 - m.y1, m.pos) as k
      from bl t join p using (witness_id, page_no) join mk m on m.witness_id = t.witness_id and m.page_no = t.page_no and m.y1 <= t.y0 and t.y0 - m.y1 <= p.height / 3 where t.kind = 'table')
    select witness_id, page_no, pos, header from nr where k = 1"""
)
def table_headers(spark: SparkSession, folder: str) -> DataFrame:
    pages = adapters.pages(spark, folder)
    return segment.table_headers(adapters.blocks(pages), pages)


@query(
    rf"""with {_BLOCK}, mk as (select witness_id, page_no, pos, y1, {_FLAT.format(t="text")} as header from bl where kind = 'prose' and (regexp_matches(text, '{_MARK}') or regexp_matches(text, '{_BASIS}'))),
    nr as (select t.witness_id, t.page_no, t.pos, m.header, row_number() over (partition by t.witness_id, t.page_no, t.pos order by t.y0 - m.y1, m.pos) as k
      from bl t join p using (witness_id, page_no) join mk m on m.witness_id = t.witness_id and m.page_no = t.page_no and m.y1 <= t.y0 and t.y0 - m.y1 <= p.height / 3 where t.kind = 'table'),
    th as (select witness_id, page_no, max_by(header, pos) as table_header from nr where k = 1 group by 1, 2),
    pf as (select *, row_number() over (partition by witness_id, page_no order by pos) as nth from bl where kind = 'prose'),
    ph as (select witness_id, page_no, min_by({_FLAT.format(t="text")}, nth) as prose_header from pf where nth <= 4 and regexp_matches(text, '{_MARK}') group by 1, 2)
    select witness_id, page_no, coalesce(table_header, prose_header) as header from th full join ph using (witness_id, page_no) where coalesce(table_header, prose_header) is not null"""
)
def page_headers(spark: SparkSession, folder: str) -> DataFrame:
    pages = adapters.pages(spark, folder)
    return segment.page_headers(adapters.blocks(pages), pages).where("header is not null")


@query(
    rf"""with {_PAGE}, ln as (select page_id, string_split_regex(text, '\r\n|\r|\n') as l from p where text is not null),
    e as (select page_id, list_filter(list_concat(l[1:2], l[greatest(len(l) - 1, 1):len(l)]), lambda x: regexp_matches(trim(x), '(?i)^\s*(?:page\s+)?([0-9]{{1,4}}|[ivxlcdm]{{1,7}})\s*$'))[1] as hit from ln)
    select page_id, regexp_extract(trim(hit), '(?i)^\s*(?:page\s+)?([0-9]{{1,4}}|[ivxlcdm]{{1,7}})\s*$', 1) as label from e where hit is not null"""
)
def printed_labels(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.pages(spark, folder).select("page_id", segment.printed_label(F.col("text")).alias("label")).where("label is not null")


@query(f"with {_PAGE} select page_id, round(length(coalesce(text, '')) / greatest(coalesce(width * height, 1), 1), 6) as density, length(coalesce(text, '')) / greatest(coalesce(width * height, 1), 1) < 0.0035 as sparse from p")
def page_density(spark: SparkSession, folder: str) -> DataFrame:
    size = (F.col("text"), F.col("width"), F.col("height"))
    return adapters.pages(spark, folder).select("page_id", F.round(segment.density(*size), 6).alias("density"), segment.is_sparse(*size).alias("sparse"))


@query(
    r"""with o as (select distinct page_id, witness_id, is_sparse from page), s as (select witness_id, sum(is_sparse::int)::bigint as sparse, count(*) as pages from o group by 1 having sum(is_sparse::int) > 0)
    select witness_id, sparse, pages from s join witness using (witness_id)"""
)
def sparse_pages(spark: SparkSession, folder: str) -> DataFrame:
    return reports.sparse_pages(table(spark, folder, "page"), table(spark, folder, "witness")).select("witness_id", "sparse", "pages")


@query("select witness_id, page_start, page_end, md5(text) as digest from passage")
def passages(spark: SparkSession, folder: str) -> DataFrame:
    """The passages built from the pages; they equal the stored ones."""
    pages = adapters.pages(spark, folder).withColumn("header", F.lit(None).cast("string"))
    return segment.build_passages(pages).select("witness_id", "page_start", "page_end", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("select passage_id, last_value(context_header ignore nulls) over (partition by witness_id order by page_start rows between unbounded preceding and current row) as carried from passage")
def carried_headers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "passage").select("passage_id", "witness_id", F.col("page_start").alias("page_no"), F.col("context_header").alias("header"))
    return segment.carried_headers(rows).select("passage_id", "carried")


@query("select passage_id, sha256(coalesce(context_header, '') || chr(0) || text) as digest from passage where text is not null")
def passage_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "passage").where("text is not null").select("passage_id", segment.passage_hash(F.col("context_header"), F.col("text")).alias("digest"))


_BLANKS = r"[\s\x{a0}\x{202f}\x{2009}\x{3000}\x{200a}\x{2002}\x{2003}\x{2028}]+"
_QUOTE = (
    _PAGE
    + rf""", c as (select distinct * from claim), st0 as (select page_id, witness_id, page_no, unnest(string_split(text, '. ')) as part, generate_subscripts(string_split(text, '. '), 1) - 1 as pos from p where text is not null),
    qt as (select page_id * 100000 + pos as quote_id, witness_id, page_no - 1 as lo, page_no + 1 as hi, page_no + 1 as hint, case when page_no % 2 = 1 then replace(trim(part), ' ', '  ') else trim(part) end as quote,
        'quantity' as claim_type, coalesce(nullif(regexp_extract(part, '([0-9][0-9,.]*[0-9])', 1), ''), '0') as value_raw from st0
      union all select -claim_id, c.witness_id, page_start, page_end, page_no, quote, claim_type, value_raw from c join passage using (passage_id)),
    qu as (select quote_id, witness_id, lo, hi, coalesce(hint, lo) as hint, trim(quote) as quote, trim(regexp_replace(quote, '{_BLANKS}', ' ', 'g')) as tight from qt where length(trim(quote)) >= 12),
    fp as materialized (select witness_id, page_no, text, regexp_replace(text, '{_BLANKS}', ' ', 'g') as flat from p where text is not null),
    nq as (select quote_id, fp.page_no, abs(fp.page_no - hint) as far, strpos(fp.text, quote) as spot, strpos(flat, tight) as loose from qu join fp on fp.witness_id = qu.witness_id and fp.page_no between lo and hi),
    an as (select *, row_number() over (partition by quote_id order by spot = 0, far, page_no) as k from nq where spot > 0 or loose > 0)"""
)


def _quotes(spark: SparkSession, folder: str, pages: DataFrame) -> DataFrame:
    return adapters.quotes(pages, adapters.claims(spark, folder), table(spark, folder, "passage"))


@query(f"with {_QUOTE} select quote_id, page_no, case when spot > 0 then 'exact' else 'whitespace' end as match_kind, case when spot > 0 then (spot - 1)::int end as exact_start from an where k = 1")
def anchors(spark: SparkSession, folder: str) -> DataFrame:
    pages = adapters.pages(spark, folder)
    found = anchor.locate_exact(_quotes(spark, folder, pages), pages)
    return found.select("quote_id", "page_no", "match_kind", F.when(F.col("match_kind") == "exact", F.col("char_start")).alias("exact_start"))


@query(f"with {_QUOTE} select match_kind, count(*) as n from (select case when spot > 0 then 'exact' else 'whitespace' end as match_kind from an where k = 1) group by 1")
def anchor_kinds(spark: SparkSession, folder: str) -> DataFrame:
    pages = adapters.pages(spark, folder)
    return anchor.locate_exact(_quotes(spark, folder, pages), pages).groupBy("match_kind").agg(F.count("*").alias("n"))


@query()
def anchors_near(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes with a word left out are found again by similarity."""
    pages = adapters.pages(spark, folder)
    return anchor.locate(adapters.torn_quotes(pages), pages).select("quote_id", "page_no", "match_kind")


def _placed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ordered, pages = _ordered(spark, folder)
    spans = segment.block_offsets(ordered)
    text = segment.page_texts(ordered)
    laid = pages.drop("text").join(text, ["witness_id", "page_no"])
    asked = _quotes(spark, folder, laid)
    found = anchor.locate_exact(asked, laid).join(asked.select("quote_id", "witness_id"), "quote_id")
    return found, spans, laid


@query()
def anchor_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Where on the page each anchor stands."""
    return anchor.anchor_boxes(*_placed(spark, folder)).select("quote_id", "page_no", "char_start", "char_end", "x0", "y0", "x1", "y1")


@query(
    r"""with c as (select distinct * from claim), v as (select claim_id, replace(lower(coalesce(quote, '')), ',', '') as q, lower(regexp_replace(replace(regexp_replace(trim(coalesce(value_raw, '')), '^[()%]+|[()%]+$', '', 'g'), ',', ''), '^-+', '')) as v from c)
    select claim_id, v = '' or contains(q, v) or coalesce(len(list_filter(regexp_extract_all(q, '-?\d[\d.]*'), lambda t: abs(try_cast(regexp_replace(t, '[.]+$', '') as double) - try_cast(v as double)) < 1e-9)) > 0, false) as present from v"""
)
def values_present(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.claims(spark, folder).select("claim_id", anchor.value_present(F.col("value_raw"), F.col("quote")).alias("present"))


def _gated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    pages = adapters.pages(spark, folder)
    proposed = _quotes(spark, folder, pages)
    return anchor.gate(proposed, anchor.locate_exact(proposed, pages))


_GATE = (
    _QUOTE
    + r""", vq as (select quote_id, claim_type, replace(lower(coalesce(quote, '')), ',', '') as q, lower(regexp_replace(replace(regexp_replace(trim(coalesce(value_raw, '')), '^[()%]+|[()%]+$', '', 'g'), ',', ''), '^-+', '')) as v from qt),
    gt as (select vq.quote_id, case when an.quote_id is null then 'unanchored' when claim_type = 'quantity' and not (v = '' or contains(q, v) or coalesce(len(list_filter(regexp_extract_all(q, '-?\d[\d.]*'), lambda t: abs(try_cast(regexp_replace(t, '[.]+$', '') as double) - try_cast(v as double)) < 1e-9)) > 0, false)) then 'value_not_in_quote' end as reason
      from vq left join an on an.quote_id = vq.quote_id and k = 1)"""
)


@query(f"with {_GATE}, n as (select coalesce(reason, 'admitted') as outcome, count(*) as n from gt group by 1) select outcome, n, round(n / (select sum(n) from n), 4) as share from n")
def gate_stats(spark: SparkSession, folder: str) -> DataFrame:
    return anchor.gate_stats(*_gated(spark, folder))


@query(f"with {_GATE} select quote_id, reason from gt where reason is not null")
def gate_rejections(spark: SparkSession, folder: str) -> DataFrame:
    return _gated(spark, folder)[1].select("quote_id", "reason")


@query("select sha256(text) as sha256, min(doc_id) as doc_id from documents where text is not null group by 1")
def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """New content by hash, against the witnesses that are there already."""
    return store.new_content(table(spark, folder, "documents"), table(spark, folder, "witness"), "text", "doc_id")


@query("select try_cast(json_extract_string(props, '$.k') as int) as k, count(*) as n from events group by 1")
def decoded_props(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "events").select(store.json_or(F.col("props"), "k int", F.struct(F.lit(None).cast("int").alias("k"))).alias("p"))
    return p.groupBy(F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


@query("select count(*) as n, count(*) as ids, 1::bigint as least, count(*) as most from measure")
def numbered_rows(spark: SparkSession, folder: str) -> DataFrame:
    n = store.number_rows(table(spark, folder, "measure").select("measure_id"), ["measure_id"])
    return n.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("least"), F.max("id").alias("most"))
