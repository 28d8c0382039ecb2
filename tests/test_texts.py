import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.operators import anchor, segment

BLOCK = "witness_id long, page_no int, pos int, kind string, text string, x0 double, y0 double, x1 double, y1 double"
PAGE = "witness_id long, page_no int, width double, height double"


def test_two_columns_are_read_one_after_the_other(spark):
    rows = []
    for i in range(4):
        rows += [(1, 0, 2 * i, "prose", f"L{i}", 40.0, 50.0 + 20 * i, 290.0, 60.0 + 20 * i), (1, 0, 2 * i + 1, "prose", f"R{i}", 310.0, 50.0 + 20 * i, 560.0, 60.0 + 20 * i)]
    rows.append((1, 0, 8, "prose", "HEAD", 40.0, 10.0, 560.0, 20.0))
    rows += [(1, 1, 0, "prose", "b", 40.0, 90.0, 560.0, 95.0), (1, 1, 1, "prose", "a", 40.0, 50.0, 560.0, 55.0)]
    blocks, pages = spark.createDataFrame(rows, BLOCK), spark.createDataFrame([(1, 0, 600.0, 800.0), (1, 1, 600.0, 800.0)], PAGE)
    placed = segment.block_offsets(segment.reading_order(blocks, pages))
    texts = {r["page_no"]: r["text"] for r in segment.page_texts(placed).collect()}
    assert texts == {0: "\n\n".join(["HEAD", *[f"L{i}" for i in range(4)], *[f"R{i}" for i in range(4)]]), 1: "a\n\nb"}
    for r in placed.collect():
        assert texts[r["page_no"]][r["char_start"] : r["char_end"]] == r["text"]
    assert segment.reading_order(blocks.limit(0), pages).count() == 0


def test_headers(spark):
    rows = [
        (1, 0, 0, "prose", "Rs in   crore", 40.0, 10.0, 500.0, 20.0),
        (1, 0, 1, "prose", "plain words", 40.0, 100.0, 500.0, 110.0),
        (1, 0, 2, "prose", "Consolidated", 40.0, 150.0, 500.0, 160.0),
        (1, 0, 3, "table", "| a |", 40.0, 200.0, 500.0, 300.0),
        (1, 0, 4, "prose", "Restated below", 40.0, 310.0, 500.0, 320.0),
        (1, 1, 0, "prose", "in million", 40.0, 10.0, 500.0, 20.0),
        (1, 2, 0, "prose", "nothing", 40.0, 10.0, 500.0, 20.0),
    ]
    blocks, pages = spark.createDataFrame(rows, BLOCK), spark.createDataFrame([(1, n, 600.0, 900.0) for n in range(3)], PAGE)
    assert {r["page_no"]: r["header"] for r in segment.page_headers(blocks, pages).collect()} == {0: "Consolidated", 1: "in million", 2: None}


def test_table_text_and_labels(spark):
    row = spark.createDataFrame([([["h1", "h2"], ["a\nb"], [None, " c "]],), ([],)], "t array<array<string>>").select(segment.table_text(F.col("t"))).collect()
    assert [r[0] for r in row] == ["| h1 | h2 |\n|---|---|\n| a b |  |\n|  | c |", ""]
    texts = ["12\nbody", "hello\n\nworld\nPage iv", "no label here", "", None, "aa\nbb\nqq\n7\nyy\nzz"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", segment.printed_label(F.col("t")).alias("l")).orderBy("i").collect()
    assert [r["l"] for r in got] == ["12", "iv", None, None, None, None]


def brute_passages(sizes, most_chars, most_pages):
    out, no, size, n = [], 0, 0, 0
    for s in sizes:
        if n and (size + s > most_chars or n >= most_pages):
            no, size, n = no + 1, 0, 0
        out.append(no)
        size, n = size + s, n + 1
    return out


def test_passages(spark):
    chance = random.Random(1)
    sizes = {w: [chance.randrange(0, 60) for _ in range(chance.randrange(1, 15))] for w in range(5)}
    pages = spark.createDataFrame([(w, i, "x" * s, str(i) if i % 2 else None, "H" if i == 2 else None) for w, ss in sizes.items() for i, s in enumerate(ss)], "witness_id long, page_no int, text string, printed_label string, header string")
    got = {(r["witness_id"], r["page_no"]): r["passage_no"] for r in segment.passage_numbers(pages, 100, 4).collect()}
    for w, ss in sizes.items():
        assert [got[w, i] for i in range(len(ss))] == brute_passages(ss, 100, 4)
    built = segment.build_passages(pages, 100, 4).where("witness_id = 0").orderBy("page_start").collect()
    assert built[0]["text"].startswith("[page 1]\n") and "[page 2 | printed 1]\n" in built[0]["text"]
    assert built[0]["context_header"] == ("H" if built[0]["page_end"] >= 2 else None)


def test_anchoring(spark):
    pages = spark.createDataFrame([(1, 0, "Total income rose to 8,142 crore."), (1, 0, "Total income rose to 8,142 crore."), (1, 1, "Nothing at all on this page, sadly."), (1, 2, "x  Total\nincome  rose to 8,142 crore.  y"), (1, 3, "so " + "very\nlong  " * 30_000)], "witness_id long, page_no int, text string")
    pages = pages.unionByName(spark.createDataFrame([(1, 4, None)], pages.schema))
    rows = [(1, "Total income rose to", 0), (2, "income rose to 8,142", 2), (3, "Nothing at all on that page", 1), (4, "short", 0), (5, "this is quite absent", 0), (6, None, 0), (7, "x Total income rose to", 0), (8, r"a\Eb\Qc.* no such thing", 0), (9, "very long " * 20_000, 0)]
    quotes = spark.createDataFrame([(i, 1, 0, 3, h, q, "c") for i, q, h in rows], "quote_id long, witness_id long, page_from int, page_to int, hint_page int, quote string, text string").drop("text")
    found = {r["quote_id"]: r for r in anchor.locate(quotes, pages).collect()}
    assert {i: (r["page_no"], r["match_kind"]) for i, r in found.items()} == {1: (0, "exact"), 2: (0, "exact"), 3: (1, "fuzzy"), 7: (2, "whitespace"), 9: (3, "whitespace")}
    assert "Total income rose to 8,142 crore."[found[2]["char_start"] : found[2]["char_end"]] == "income rose to 8,142"
    assert "x  Total\nincome  rose to 8,142 crore.  y"[found[7]["char_start"] : found[7]["char_end"]] == "x  Total\nincome  rose to"
    assert anchor.locate(quotes.limit(0), pages).count() == 0


def brute_similarity(a, b):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            d[i, j] = 0 if not i or not j else d[i - 1, j - 1] + 1 if a[i - 1] == b[j - 1] else max(d[i - 1, j], d[i, j - 1])
    return 200 * d[len(a), len(b)] / (len(a) + len(b)) if a and b else 100.0 * (a == b)


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=12), st.text("abcd ", max_size=20))
def test_similarity_and_window(a, b):
    assert abs(anchor.indel_similarity(a, b) - brute_similarity(a, b)) < 1e-9
    if a and len(b) >= len(a):
        want = max(brute_similarity(a, b[max(0, s) : s + len(a)]) for s in range(1 - len(a), len(b)))
        score, low, high = anchor.best_window(a, b)
        assert abs(score - want) < 1e-9 and (not score or abs(brute_similarity(a, b[low:high]) - score) < 1e-9)
        assert anchor.best_window(a, b, 60.0)[0] == (score if score >= 60 else 0)


@pytest.mark.parametrize("value, quote, want", [("8,142", "rose to 8142 now", True), ("(452)", "a loss of 452", True), ("-3.2%", "fell 3.20 points", True), ("7", "none", False), ("", "any", True), (None, None, True), ("Active", "is active", True), ("1e400", "x 5", False), ("5", None, False)])
def test_value_present(spark, value, quote, want):
    assert spark.createDataFrame([(value, quote)], "v string, q string").select(anchor.value_present(F.col("v"), F.col("q"))).first()[0] is want


def test_gate_and_boxes(spark):
    proposed = spark.createDataFrame([(1, 1, "quantity", "5", "has 5 in it", None), (2, 1, "quantity", "6", "has 5 in it", None), (3, 1, "state", "6", "has 5 in it", None), (4, 1, "quantity", "5", "gone", None), (5, 1, None, None, None, "boom")], "quote_id long, witness_id long, claim_type string, value_raw string, quote string, error string")
    anchors = spark.createDataFrame([(i, 0, 0, 5, "exact") for i in (1, 2, 3)], "quote_id long, page_no int, char_start int, char_end int, match_kind string")
    admitted, quarantined = anchor.gate(proposed, anchors)
    assert {r["quote_id"] for r in admitted.collect()} == {1, 3}
    assert {r["quote_id"]: r["reason"] for r in quarantined.collect()} == {2: "value_not_in_quote", 4: "unanchored", 5: "passage_failed"}
    assert {r["outcome"]: (r["n"], r["share"]) for r in anchor.gate_stats(admitted, quarantined).collect()} == {"admitted": (2, 0.5), "value_not_in_quote": (1, 0.25), "unanchored": (1, 0.25), "passage_failed": (1, None)}
    blocks = spark.createDataFrame([(1, 0, 0, 4, 10.0, 10.0, 20.0, 20.0), (1, 0, 4, 9, 5.0, 20.0, 15.0, 30.0), (1, 0, 9, 12, 0.0, 0.0, 99.0, 99.0)], "witness_id long, page_no int, char_start int, char_end int, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(1, 0, 600.0), (1, 7, 500.0)], "witness_id long, page_no int, width double")
    spots = spark.createDataFrame([(1, 1, 0, 2, 6), (2, 1, 7, 0, 3)], "quote_id long, witness_id long, page_no int, char_start int, char_end int")
    boxes = {r["quote_id"]: (r["x0"], r["y0"], r["x1"], r["y1"]) for r in anchor.anchor_boxes(spots, blocks, pages).collect()}
    assert boxes == {1: (5.0, 10.0, 20.0, 30.0), 2: (0.0, 0.0, 500.0, 0.0)}
