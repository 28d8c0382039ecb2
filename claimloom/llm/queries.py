"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.abuse import abuse_rates, fit_abuse, score_abuse
from claimloom.llm.canonical import claim_measures
from claimloom.llm.chunking import split_oversized
from claimloom.llm.groups import corroboration_groups
from claimloom.llm.mixing import mix_sources
from claimloom.llm.neighbours import similar_pairs, similar_vectors
from claimloom.llm.tokens import decode_ids, encode_texts
from claimloom.llm.variants import name_entities, variant_pairs
from claimloom.sources.tables import table


def _p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return corroboration_groups(table(spark, folder, "verdict"))


def _p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return claim_measures(table(spark, folder, "claim"), table(spark, folder, "measure"))


def _p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The wordings that name no listed measure, with the number of their claims."""
    claim = table(spark, folder, "claim").select("claim_id", "measure_raw").distinct()
    unmatched = claim_measures(claim, table(spark, folder, "measure")).where("measure_id = -1")
    return claim.join(unmatched, "claim_id").groupBy("measure_raw").agg(F.count("*").alias("n_claims"))


def _p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return variant_pairs(table(spark, folder, "claim"), "entity_raw")


def _p4_entities(spark: SparkSession, folder: str) -> DataFrame:
    return name_entities(table(spark, folder, "claim"), "entity_raw")


def _p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(table(spark, folder, "measure"), "measure_id", "embedding", names=("measure_a", "measure_b"))


def _p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return similar_vectors(table(spark, folder, "measure"), "measure_id", "embedding")


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        split_oversized(table(spark, folder, name), key).select(F.lit(name).alias("item_kind"), F.col(key).alias("item_id"), "piece_no", "char_start", "char_end", "overlap", "cut_kind", "piece")
        for name, key in (("page", "page_id"), ("passage", "passage_id"))
    ]
    return parts[0].unionByName(parts[1])


def _p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """An item is forced if one of its pieces had to be cut where there is no boundary."""
    forced = F.max((F.col("cut_kind") == "forced").cast("int")) == 1
    return _pieces(spark, folder).groupBy("item_kind", "item_id").agg(F.when(forced, "forced").otherwise("natural").alias("cut_kind"))


def _p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"))


def _p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text the ids do not give back (none)."""
    documents = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = decode_ids(encode_texts(documents)).withColumnRenamed("text", "back")
    return documents.join(back, "doc_id").where("text != back").select("doc_id")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_target"))


def _p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def _p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def _scored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents")
    return documents, score_abuse(documents, fit_abuse(documents, table(spark, folder, "review_label")))


def _p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder)[1].where("found").select("doc_id")


def _p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder)[1].select("doc_id", F.round("score", 6).alias("score"))


def _p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse_rates(*_scored(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": _p2_found,
    "p3_found": _p3_found,
    "p3_unmatched": _p3_unmatched,
    "p4_found": _p4_found,
    "p4_entities": _p4_entities,
    "p5_found": _p5_found,
    "p5_neighbours": _p5_neighbours,
    "p6_found": _p6_found,
    "p6_pieces": _pieces,
    "p7_ids": _p7_ids,
    "p7_round_trip": _p7_round_trip,
    "p8_mixture": _p8_mixture,
    "p8_shares": _p8_shares,
    "p9_found": _p9_found,
    "p9_scores": _p9_scores,
    "p9_rates": _p9_rates,
}

SQL: dict[str, str] = {
    "p2_found": """
        with recursive link as (
          select distinct claim_a a, claim_b b from verdict
          where regexp_replace(lower(verdict), '^\\s+|\\s+$', '', 'g') = 'corroborates' and claim_a is not null and claim_b is not null and claim_a <> claim_b
        ), edge as (select a, b from link union select b, a from link),
        reach as (select a, a as b from edge union select r.a, e.b from reach r join edge e on r.b = e.a)
        select a as claim_id, min(b) as group_id from reach group by a
    """,
    "p5_found": """
        with usable as (
          select measure_id, min(embedding) e from measure where len(embedding) = 64 group by 1
        ), unit as (select measure_id, e from usable where list_dot_product(e, e) > 0),
        ranked as (
          select a.measure_id ia, b.measure_id ib, list_cosine_similarity(a.e, b.e) c,
            row_number() over (partition by a.measure_id order by round(list_cosine_similarity(a.e, b.e)::double, 6) desc, b.measure_id) n
          from unit a join unit b on a.measure_id <> b.measure_id
        )
        select distinct least(ia, ib) as measure_a, greatest(ia, ib) as measure_b from ranked where n <= 10 and c >= 0.9
    """,
    "p6_found": """
        with item as (
          select 'page' as item_kind, page_id as item_id, min(text) as text from page where length(text) > 8000 group by page_id
          union all select 'passage', passage_id, min(text) from passage where length(text) > 8000 group by passage_id
        ), run as (select item_kind, item_id, unnest(string_split_regex(text, '[ \\t\\r\\n。]')) as part from item)
        select item_kind, item_id, case when max(length(part)) > 8000 then 'forced' else 'natural' end as cut_kind from run group by 1, 2
    """,
    "p7_round_trip": "select doc_id from documents where false",
}
