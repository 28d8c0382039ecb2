"""From blocks on pages to ordered page texts and model-sized passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.functions.binding import squeeze

# Marks of scale and basis, and what a page's own number looks like.
SCALE_MARK = r"(?i)\(?\s*(?:in\s+)?(?:(?:rs\.?|inr|₹|us\s?\$|usd|\$|€|eur)\s*)?(?:in\s+)?(?:million|billion|trillion|crore|lakhs|lakh|thousand|mn|bn|tn|cr|hundreds)s?\b"
BASIS_MARK = r"(?i)\b(?:consolidated|standalone|unaudited|audited|restated|provisional|revised|pro\s?forma|estimated|projected|annualis?zed|seasonally\s+adjusted)\b"
PAGE_LABEL = r"(?i)^\s*(?:page\s+)?([0-9]{1,4}|[ivxlcdm]{1,7})\s*$"

# Sizes of a passage, density of a sparse page, tolerance at the middle of a page, share of straddling blocks.
PASSAGE_CHARS, PASSAGE_PAGES = 24_000, 4
SPARSE = 0.0035
MIDDLE, STRADDLING = 8, 0.35

_PAGE = ["witness_id", "page_no"]


def page_columns(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``witness_id, page_no, n_columns`` (1 or 2) of each page that has blocks.

    Two columns need at least six blocks beside the middle, two on either
    side, and few across it.
    """
    mid = F.col("width") / 2
    left = F.col("x1") < mid + MIDDLE
    right = ~left & (F.col("x0") > mid - MIDDLE)
    sided = blocks.join(pages.select(*_PAGE, "width"), _PAGE).groupBy(*_PAGE).agg(F.count_if(left).alias("left"), F.count_if(right).alias("right"), F.count_if(~left & ~right).alias("across"))
    both = F.col("left") + F.col("right")
    two = (both >= 6) & (F.col("left") >= 2) & (F.col("right") >= 2) & (F.col("across") <= both * STRADDLING)
    return sided.select(*_PAGE, F.when(two, 2).otherwise(1).alias("n_columns"))


def reading_order(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """The blocks with ``idx``, their place from 0 in reading order; ties keep the order of ``pos``."""
    laid = blocks.join(page_columns(blocks, pages), _PAGE).join(pages.select(*_PAGE, "width"), _PAGE)
    mid = F.col("width") / 2
    straddles = (F.col("x0") <= mid - MIDDLE) & (F.col("x1") >= mid + MIDDLE)
    column = F.when((F.col("n_columns") == 1) | straddles | (F.col("x1") < mid + MIDDLE), 0).otherwise(1)
    order = W.partitionBy(*_PAGE).orderBy(column, F.bround("y0", 1), "x0", "pos")
    return laid.withColumn("idx", F.row_number().over(order) - 1).drop("n_columns", "width")


def block_offsets(ordered: DataFrame) -> DataFrame:
    """The ordered blocks with ``char_start`` and ``char_end`` in the page text, which joins them by a blank line."""
    before = W.partitionBy(*_PAGE).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("int")
    return ordered.withColumn("char_start", start).withColumn("char_end", (F.col("char_start") + F.length("text")).cast("int"))


def page_texts(ordered: DataFrame) -> DataFrame:
    """``witness_id, page_no, text``: the blocks of a page in order, joined by a blank line."""
    return ordered.groupBy(*_PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda b: b["text"]), "\n\n").alias("text"))


def table_text(rows: Column) -> Column:
    """An array of rows (arrays of cells) as a pipe table with a rule below the first row; short rows are filled up."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cells = lambda r: F.transform(F.sequence(F.lit(1), width), lambda i: F.trim(F.regexp_replace(F.coalesce(F.get(r, i - 1), F.lit("")), "\n", " ")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(cells(r), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    body = F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), line))
    return F.when(F.size(rows) > 0, F.array_join(body, "\n")).otherwise(F.lit(""))


def table_headers(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """For each table block the scoping header above it: ``witness_id, page_no, pos, header``.

    That is the nearest prose block that ends above the table, no further up
    than a third of the page, and carries a mark of scale or basis.
    """
    marked = blocks.where("kind = 'prose'").where(F.col("text").rlike(SCALE_MARK) | F.col("text").rlike(BASIS_MARK))
    above = marked.select(*_PAGE, F.col("y1").alias("bottom"), F.col("pos").alias("prose_pos"), F.left(squeeze(F.col("text")), F.lit(200)).alias("header"))
    tables = blocks.where("kind = 'table'").join(pages.select(*_PAGE, "height"), _PAGE).select(*_PAGE, "pos", F.col("y0").alias("top"), "height")
    near = tables.join(above, _PAGE).where((F.col("bottom") <= F.col("top")) & (F.col("top") - F.col("bottom") <= F.col("height") / 3))
    return near.groupBy(*_PAGE, "pos").agg(F.min_by("header", F.struct(F.col("top") - F.col("bottom"), F.col("prose_pos"))).alias("header"))


def page_headers(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``witness_id, page_no, header``: that of the last table with one, else the first of four prose blocks with a mark of scale."""
    by_table = table_headers(blocks, pages).groupBy(*_PAGE).agg(F.max_by("header", "pos").alias("table_header"))
    first = blocks.where("kind = 'prose'").withColumn("nth", F.row_number().over(W.partitionBy(*_PAGE).orderBy("pos"))).where("nth <= 4").where(F.col("text").rlike(SCALE_MARK))
    by_prose = first.groupBy(*_PAGE).agg(F.min_by(F.left(squeeze(F.col("text")), F.lit(200)), "nth").alias("prose_header"))
    all_ = pages.select(*_PAGE).distinct().join(by_table, _PAGE, "left").join(by_prose, _PAGE, "left")
    return all_.select(*_PAGE, F.coalesce("table_header", "prose_header").alias("header"))


def printed_label(text: Column) -> Column:
    """A page's own number, from its first two or last two lines."""
    lines = F.split(text, "\r\n|\r|\n")
    edge = F.concat(F.slice(lines, 1, 2), F.slice(F.reverse(F.slice(F.reverse(lines), 1, 2)), 1, 2))
    hit = F.get(F.filter(edge, lambda line: F.trim(line).rlike(PAGE_LABEL)), F.lit(0))
    return F.nullif(F.regexp_extract(F.trim(hit), PAGE_LABEL, 1), F.lit(""))


def density(text: Column, width: Column, height: Column) -> Column:
    """Characters per square point."""
    return F.length(F.coalesce(text, F.lit(""))) / F.greatest(F.coalesce(width * height, F.lit(1.0)), F.lit(1.0))


def is_sparse(text: Column, width: Column, height: Column) -> Column:
    return density(text, width, height) < SPARSE


def carried_headers(pages: DataFrame) -> DataFrame:
    """The pages with ``carried``: the last header stated on this or an earlier page of the witness."""
    upto = W.partitionBy("witness_id").orderBy("page_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    return pages.withColumn("carried", F.last("header", ignorenulls=True).over(upto))


def passage_numbers(pages: DataFrame, most_chars: int = PASSAGE_CHARS, most_pages: int = PASSAGE_PAGES) -> DataFrame:
    """``witness_id, page_no, passage_no``: consecutive pages batched until the next would make a passage too large.

    The fold needs only the sizes of a witness's pages, never their texts.
    """
    sizes = pages.groupBy("witness_id").agg(F.array_sort(F.collect_list(F.struct("page_no", F.length(F.coalesce("text", F.lit(""))).alias("size")))).alias("pages"))
    kind = "array<struct<page_no:int,passage_no:int>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.lit(0).alias("no"), F.lit(0).alias("size"), F.lit(0).alias("n"))

    def add(acc: Column, page: Column) -> Column:
        full = (acc["n"] > 0) & ((acc["size"] + page["size"] > most_chars) | (acc["n"] >= most_pages))
        no = acc["no"] + full.cast("int")
        done = F.concat(acc["done"], F.array(F.struct(page["page_no"].cast("int").alias("page_no"), no.alias("passage_no"))))
        return F.struct(done.alias("done"), no.alias("no"), F.when(full, page["size"]).otherwise(acc["size"] + page["size"]).alias("size"), F.when(full, 1).otherwise(acc["n"] + 1).alias("n"))

    folded = sizes.select("witness_id", F.explode(F.aggregate("pages", start, add)["done"]).alias("p"))
    return folded.select("witness_id", "p.page_no", "p.passage_no")


def build_passages(pages: DataFrame, most_chars: int = PASSAGE_CHARS, most_pages: int = PASSAGE_PAGES) -> DataFrame:
    """``witness_id, passage_no, page_start, page_end, text, context_header, hash`` of pages ``witness_id, page_no, text, printed_label, header``.

    A passage's header is the first stated on its pages, else the last stated
    before it.  Blank passages are left out.
    """
    numbered = carried_headers(pages).join(passage_numbers(pages, most_chars, most_pages), ["witness_id", "page_no"])
    mark = F.concat(F.lit("[page "), (F.col("page_no") + 1).cast("string"), F.when(F.coalesce("printed_label", F.lit("")) != "", F.concat(F.lit(" | printed "), "printed_label")).otherwise(F.lit("")), F.lit("]\n"), F.coalesce("text", F.lit("")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", mark.alias("body")))), lambda p: p["body"]), "\n\n")
    built = numbered.groupBy("witness_id", "passage_no").agg(
        F.min("page_no").alias("page_start"),
        F.max("page_no").alias("page_end"),
        body.alias("text"),
        F.coalesce(F.min_by("header", F.when(F.col("header").isNotNull(), F.col("page_no"))), F.min_by("carried", "page_no")).alias("context_header"),
    )
    return built.where(F.trim("text") != "").withColumn("hash", passage_hash(F.col("context_header"), F.col("text")))


def passage_hash(header: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", F.coalesce(header, F.lit("")), text), 256)
