"""Views of the stored tables in the shape that an operator expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.frames import frame_claims
from claimloom.sources.tables import table


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """Each claim once."""
    return table(spark, folder, "claim").dropDuplicates(["claim_id"])


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each page once."""
    return table(spark, folder, "page").dropDuplicates(["page_id"])


def framed(spark: SparkSession, folder: str) -> DataFrame:
    return frame_claims(table(spark, folder, "claim"), table(spark, folder, "witness"))


def blocks(page: DataFrame) -> DataFrame:
    """The paragraphs of page texts as blocks laid out in two columns, every seventh across both.

    The stored pages have no boxes; these are made up from the position, so
    that layout operators have something to work on.
    """
    split = page.where(F.col("text") != "").select("witness_id", "page_no", "width", F.posexplode(F.split("text", "\n\n")).alias("pos", "text"))
    across, left = F.pmod("pos", F.lit(7)) == 6, F.pmod("pos", F.lit(2)) == 0
    half = F.col("width") / 2
    top = 50.0 + F.floor(F.col("pos") / 2) * 20.0
    return split.select(
        "witness_id",
        "page_no",
        "pos",
        F.when(F.col("text").startswith("|"), "table").otherwise("prose").alias("kind"),
        "text",
        F.when(across | left, F.lit(40.0)).otherwise(half + 10).alias("x0"),
        top.alias("y0"),
        F.when(across | ~left, F.col("width") - 40).otherwise(half - 10).alias("x1"),
        (top + 15.0).alias("y1"),
    )


def quotes(page: DataFrame, claim: DataFrame, passage: DataFrame) -> DataFrame:
    """What is to be anchored: the quote of every claim that has a passage, and every sentence of every page.

    The stored quotes stand on no page, so the sentences are what is found;
    each is said to be one page off, and on every other page its blanks are
    doubled.  Quotes of claims have negative numbers.
    """
    columns = ["quote_id", "witness_id", "page_from", "page_to", "hint_page", "quote", "claim_type", "value_raw"]
    where = passage.select("passage_id", F.col("page_start").alias("page_from"), F.col("page_end").alias("page_to"))
    stored = claim.join(where, "passage_id").select((-F.col("claim_id")).alias("quote_id"), "witness_id", "page_from", "page_to", F.col("page_no").alias("hint_page"), "quote", "claim_type", "value_raw")
    cut = page.where("text is not null").select("page_id", "witness_id", "page_no", F.posexplode(F.split("text", r"\. ")).alias("pos", "part"))
    text = F.trim("part")
    doubled = F.when(F.pmod("page_no", F.lit(2)) == 1, F.replace(text, F.lit(" "), F.lit("  "))).otherwise(text)
    said = cut.select(
        (F.col("page_id") * 100_000 + F.col("pos")).alias("quote_id"),
        "witness_id",
        (F.col("page_no") - 1).alias("page_from"),
        (F.col("page_no") + 1).alias("page_to"),
        (F.col("page_no") + 1).alias("hint_page"),
        doubled.alias("quote"),
        F.lit("quantity").alias("claim_type"),
        F.coalesce(F.nullif(F.regexp_extract("part", r"([0-9][0-9,.]*[0-9])", 1), F.lit("")), F.lit("0")).alias("value_raw"),
    )
    return stored.select(columns).unionByName(said.select(columns))


def torn_quotes(page: DataFrame) -> DataFrame:
    """70 characters from every page that is long enough, with a word left out, named one page off: what only similarity finds again."""
    text = F.trim(F.substring("text", 31, 70))
    return page.where(F.length("text") >= 150).select(
        F.col("page_id").alias("quote_id"),
        "witness_id",
        (F.col("page_no") - 1).alias("page_from"),
        (F.col("page_no") + 1).alias("page_to"),
        (F.col("page_no") + 1).alias("hint_page"),
        F.regexp_replace(text, r"^(\S+\s+\S+\s+)\S+\s+", "$1").alias("quote"),
    )
