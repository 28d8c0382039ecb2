"""The whole way from files to verdicts, and its stages one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.embedding import embed
from claimloom.operators import anchor, reports, segment, store
from claimloom.operators.cascade import adjudicate, drift_rulings
from claimloom.operators.frames import frame_claims, resolve_frames
from claimloom.operators.pairs import capped_lemma_pairs, neighbour_pairs
from claimloom.operators.resolve import neighbours
from claimloom.providers import Adviser, Describer, Extractor, HeadDescriber, Parser, describe_witnesses, extract_claims, front_matter_text, note_verdicts, parse_files
from claimloom.session import keep
from claimloom.sources.files import new_files


def ingest(files: DataFrame, witness: DataFrame, parser: Parser, extractor: Extractor, describer: Describer | None = None, last_claim: int = 0) -> dict[str, DataFrame]:
    """Tables ``witness, page, block, passage, claim, anchor, quarantine`` of files that are new.

    Files are known by their content.  Witnesses go on from the greatest
    number there is, proposals (whose number a claim keeps) from
    ``last_claim``.  ``describer`` reads title, publisher, date and currency
    off the front matter.  A file that cannot be parsed gives a
    witness with status ``failed`` and no pages.  Claims are admitted only if
    their quote stands on a page of their passage and holds their value.
    """
    fresh = new_files(files, witness)
    parsed = keep(parse_files(fresh, parser), "parsed")
    seen = witness.agg(F.max("witness_id")).first()[0] or 0
    numbered = keep(store.number_rows(fresh.select("sha256", "filename"), ["sha256"], "witness_id", seen + 1), "numbered")
    failed = parsed.where("error is not null").select("sha256", F.lit("failed").alias("state"))
    blocks = parsed.where("error is null").join(numbered.select("sha256", "witness_id"), "sha256")
    sizes = blocks.select("witness_id", "page_no", "width", "height").distinct()
    placed = keep(segment.block_offsets(segment.reading_order(blocks.drop("width", "height"), sizes)), "blocks")
    pages = segment.page_texts(placed).join(sizes, ["witness_id", "page_no"]).join(segment.page_headers(placed, sizes), ["witness_id", "page_no"]).withColumn("printed_label", segment.printed_label(F.col("text")))
    pages = keep(pages, "pages")
    front = describe_witnesses(front_matter_text(pages), describer or HeadDescriber())
    plain_title = F.regexp_replace("filename", r"\.[^.]*$", "")
    described = numbered.join(failed, "sha256", "left").join(front, "witness_id", "left")
    witnesses = keep(described.select("witness_id", "sha256", "filename", F.coalesce("title", plain_title).alias("title"), "publisher", "vintage_raw", "default_currency", F.coalesce("state", F.lit("elicited")).alias("status")), "witnesses")
    passages = keep(segment.build_passages(pages), "passages")
    proposed = extract_claims(passages, extractor).join(passages.select("witness_id", "passage_no", F.col("page_start").alias("page_from"), F.col("page_end").alias("page_to")), ["witness_id", "passage_no"])
    proposed = proposed.select("witness_id", "passage_no", "page_from", "page_to", F.lit(None).cast("int").alias("hint_page"), "quote", F.lit("quantity").alias("claim_type"), F.col("entity").alias("entity_raw"), F.col("measure").alias("measure_raw"), F.col("value").alias("value_raw"), F.col("unit").alias("unit_raw"), F.col("period").alias("period_raw"), "error")
    proposed = keep(store.number_rows(proposed, ["witness_id", "passage_no", "quote", "measure_raw", "value_raw"], "quote_id", last_claim + 1), "proposed")
    found = keep(anchor.locate(proposed, pages), "found")
    admitted, quarantine = anchor.gate(proposed, found)
    admitted = keep(admitted, "admitted")
    claims = admitted.withColumnRenamed("quote_id", "claim_id").withColumn("basis_raw", F.lit(None).cast("string")).withColumn("qualifiers", F.array().cast("array<string>")).withColumn("confidence", F.lit(None).cast("double"))
    spots = admitted.select("quote_id", "witness_id", F.col("anchor_page").alias("page_no"), "char_start", "char_end", "match_kind")
    found = anchor.anchor_boxes(spots, placed, sizes).withColumnRenamed("quote_id", "claim_id")
    return {"witness": witnesses, "page": pages, "block": placed, "passage": passages, "claim": claims, "anchor": found, "quarantine": quarantine}


def frame(claim: DataFrame, witness: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Framed claims with their names resolved, and the measures these lead to."""
    framed, measures = resolve_frames(keep(frame_claims(claim, witness), "framed"))
    return keep(framed, "resolved"), measures


def rule(framed: DataFrame, measures: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New verdicts: on pairs of one lemma and, as drift of definition, on pairs of neighbouring measures.

    Pairs that ``existing`` (``claim_a, claim_b``) holds are left alone.
    """
    ruled = adjudicate(capped_lemma_pairs(framed))
    vectors = measures.select("measure_key", embed("wording").alias("vec"))
    near = neighbours(vectors, "measure_key", "vec").select(F.col("a").alias("measure_a"), F.col("b").alias("measure_b"), "score")
    drift = drift_rulings(neighbour_pairs(framed, near))
    none = ruled.select("claim_a", "claim_b").where("false")
    return keep(store.store_verdicts(none if existing is None else existing, keep(ruled, "ruled"), drift), "verdicts")


def escalate(verdict: DataFrame, adviser: Adviser, noted: DataFrame | None = None, most: int = reports.ESCALATED) -> DataFrame:
    """``verdict_id, note, agrees`` of the gravest contradictions that have no note yet; no verdict is changed."""
    return note_verdicts(reports.escalation_queue(verdict, noted, most), adviser)
