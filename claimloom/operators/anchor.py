"""Proving that a quoted claim stands in its source, and setting aside those that do not."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions.binding import let, squeeze

# Least score of a near match, shortest quote, longest payload kept.
FLOOR, LEAST_CHARS, PAYLOAD = 88.0, 12, 4000


def _candidates(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """Quotes beside the pages of their passage (a few); ``far`` is the distance from the page they name, ``flat`` a page with single blanks."""
    asked = quotes.select("quote_id", "witness_id", "page_from", "page_to", "hint_page", F.trim(F.col("quote")).alias("quote")).where((F.length("quote") >= LEAST_CHARS) & (F.col("page_from") <= F.col("page_to")))
    each = asked.select("quote_id", "witness_id", F.explode(F.sequence("page_from", "page_to")).alias("page_no"), F.coalesce("hint_page", "page_from").alias("hint"), "quote")
    offered = pages.select("witness_id", "page_no", "text").where(F.col("text").isNotNull()).withColumn("flat", squeeze(F.col("text")))
    return each.join(offered, ["witness_id", "page_no"]).withColumn("far", F.abs(F.col("page_no") - F.col("hint")))


@F.pandas_udf(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))
def _loose_span(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """Start and end in ``text`` of the first part that differs from ``quote`` in white space only; null where an argument is, or without one.

    Long quotes would exhaust the stack of a pattern.
    """
    rows = []
    for hay, needle in zip(text, quote):
        at = -1
        if isinstance(hay, str) and isinstance(needle, str):
            flat, back = _flat(hay)
            tight = _flat(needle)[0]
            at = flat.find(tight)
        rows.append((back[at], back[at + len(tight) - 1] + 1) if at >= 0 else (None, None))
    return pd.DataFrame(rows, columns=["s", "e"]).astype("Int32")


def locate_exact(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """``quote_id, page_no, char_start, char_end, match_kind``: the best place of each quote that stands on a page.

    Verbatim beats matches that differ in white space only; then the page
    nearest to the one named, the lower page at equal distance.  Quotes that
    are too short or found nowhere give no row.  Repeated pages count once.
    """
    near = _candidates(quotes, pages)
    found = near.withColumn("at", F.instr("text", F.col("quote")))
    loose = (F.col("at") == 0) & F.col("flat").contains(squeeze(F.col("quote")))
    placed = found.withColumn("span", _loose_span(F.when(loose, F.col("text")), F.when(loose, F.col("quote")))).where("at > 0 or span.s is not null")
    start = F.when(F.col("at") > 0, F.col("at") - 1).otherwise(F.col("span.s"))
    size = F.when(F.col("at") > 0, F.length("quote")).otherwise(F.col("span.e") - F.col("span.s"))
    kind = F.when(F.col("at") > 0, "exact").otherwise("whitespace")
    spans = placed.select("quote_id", "page_no", "far", start.cast("int").alias("char_start"), (start + size).cast("int").alias("char_end"), kind.alias("match_kind"))
    best = W.partitionBy("quote_id").orderBy(F.col("match_kind") != "exact", "far", "page_no", "char_start")
    return spans.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth", "far")


def indel_similarity(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths; bits carry a whole row at once."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def best_window(needle: str, hay: str, floor: float = 0.0) -> tuple[float, int, int]:
    """Score, start and end of the part of ``hay`` (as long as ``needle``, or shorter at its ends) that is most like it.

    Only a part that scores at least ``floor`` is found.  The letters that a
    window shares with the needle, in any order, bound its score, and are
    counted while it slides; most windows are passed over by that alone.
    """
    size, n = len(needle), len(hay)
    best = (0.0, 0, 0)
    if n < size or not size:
        return best
    spare: dict[str, int] = {}
    for c in needle:
        spare[c] = spare.get(c, 0) + 1
    shared = 0
    for start in range(1 - size, n):
        entering, leaving = start + size - 1, start - 1
        if entering < n:
            c = hay[entering]
            left = spare.get(c, 0)
            shared += left > 0
            spare[c] = left - 1
        if leaving >= 0:
            c = hay[leaving]
            left = spare[c]
            shared -= left >= 0
            spare[c] = left + 1
        low, high = max(0, start), min(n, start + size)
        if 200.0 * shared / (size + high - low) < max(floor, best[0] + 1e-9):
            continue
        score = indel_similarity(needle, hay[low:high])
        if score >= floor and score > best[0]:
            best = (score, low, high)
            if score == 100.0:
                break
    return best


def _flat(text: str) -> tuple[str, list[int]]:
    """Text with runs of white space as one blank, and where each character came from."""
    out, back, gap = [], [], False
    for i, c in enumerate(text):
        if c.isspace():
            gap = bool(out)
            continue
        if gap:
            out.append(" ")
            back.append(i - 1)
            gap = False
        out.append(c)
        back.append(i)
    return "".join(out), back


def locate_near(quotes: DataFrame, pages: DataFrame, floor: float = FLOOR) -> DataFrame:
    """As ``locate_exact``, for quotes that stand on no page: the most similar part of a page, if similar enough.

    The strictly best score wins, at equal scores the page nearest to the one
    named.  Pages shorter than the quote are passed over.  This compares in
    Python, so only quotes that the exact passes left over should come here.
    """
    near = _candidates(quotes, pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for quote_id, page_no, far, quote, text in zip(batch["quote_id"], batch["page_no"], batch["far"], batch["quote"], batch["text"]):
                needle = re.sub(r"\s+", " ", quote)
                flat, back = _flat(text)
                score, start, end = best_window(needle, flat, floor)
                if score:
                    rows.append((quote_id, page_no, far, score, back[start], back[end - 1] + 1))
            yield pd.DataFrame(rows, columns=["quote_id", "page_no", "far", "score", "char_start", "char_end"])

    scored = near.select("quote_id", "page_no", "far", "quote", "text").mapInPandas(run, "quote_id long, page_no int, far int, score double, char_start int, char_end int")
    best = W.partitionBy("quote_id").orderBy(F.desc("score"), "far", "page_no")
    return scored.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("quote_id", "page_no", "char_start", "char_end", F.lit("fuzzy").alias("match_kind"))


def locate(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """The place of every quote that has one, by the cheapest pass that finds it."""
    sure = locate_exact(quotes, pages)
    rest = quotes.join(sure.select("quote_id"), "quote_id", "left_anti")
    return sure.unionByName(locate_near(rest, pages))


def anchor_boxes(anchors: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """The anchors with ``x0, y0, x1, y1``: the union of the blocks they touch, else the width of the page."""
    key = ["witness_id", "page_no"]
    spans = blocks.select(*key, F.col("char_start").alias("b_start"), F.col("char_end").alias("b_end"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    touched = anchors.join(spans, key).where("b_start < char_end and b_end > char_start")
    union = touched.groupBy("quote_id").agg(F.min("b_x0").alias("x0"), F.min("b_y0").alias("y0"), F.max("b_x1").alias("x1"), F.max("b_y1").alias("y1"))
    wide = anchors.join(union, "quote_id", "left").join(pages.select(*key, "width").dropDuplicates(key), key, "left")
    return wide.select(*anchors.columns, F.coalesce("x0", F.lit(0.0)).alias("x0"), F.coalesce("y0", F.lit(0.0)).alias("y0"), F.coalesce("x1", "width").alias("x1"), F.coalesce("y1", F.lit(0.0)).alias("y1"))


def value_present(value: Column, quote: Column) -> Column:
    """Whether a quote holds a value: as text, or as an equal number; a blank value always."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"^[()%]+|[()%]+$", ""), ",", "")
    text = F.replace(F.lower(F.coalesce(quote, F.lit(""))), F.lit(","), F.lit(""))

    def check(v: Column) -> Column:
        number = v.try_cast("double")
        tokens = F.regexp_extract_all(text, F.lit(r"-?\d[\d.]*"), F.lit(0))
        same = F.exists(tokens, lambda t: F.abs(F.regexp_replace(t, r"[.]+$", "").try_cast("double") - number) < 1e-9)
        return (v == "") | text.contains(v) | F.coalesce(number.isNotNull() & same, F.lit(False))

    return let(F.lower(F.regexp_replace(bare, r"^-+", "")), check)


def gate(proposed: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admitted claims with their anchors, and quarantined ones with a reason and a payload.

    ``unanchored``: the quote is nowhere; ``value_not_in_quote``: it is, but
    without the value of a quantity; ``passage_failed``: the passage gave an
    error instead of claims (a non-null ``error`` column).
    """
    spots = anchors.select("quote_id", F.col("page_no").alias("anchor_page"), "char_start", "char_end", "match_kind")
    joined = proposed.join(spots, "quote_id", "left")
    failed = F.col("error").isNotNull() if "error" in proposed.columns else F.lit(False)
    missing = (F.col("claim_type") == "quantity") & ~value_present(F.col("value_raw"), F.col("quote"))
    reason = F.when(failed, "passage_failed").when(F.col("match_kind").isNull(), "unanchored").when(missing, "value_not_in_quote")
    judged = joined.withColumn("reason", reason)
    payload = F.left(F.to_json(F.struct(*[c for c in proposed.columns if c != "error"])), F.lit(PAYLOAD))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("quote_id", "witness_id", "reason", payload.alias("payload"))


def gate_stats(admitted: DataFrame, quarantined: DataFrame) -> DataFrame:
    """``outcome, n, share`` of proposals; a failed passage is no proposal."""
    both = admitted.select(F.lit("admitted").alias("outcome")).unionByName(quarantined.select(F.col("reason").alias("outcome")))
    counts = both.groupBy("outcome").agg(F.count("*").alias("n"))
    proposals = counts.where("outcome <> 'passage_failed'").agg(F.sum("n").alias("all"))  # one row
    return counts.crossJoin(F.broadcast(proposals)).select("outcome", "n", F.when(F.col("outcome") != "passage_failed", F.round(F.col("n") / F.col("all"), 4)).alias("share"))
