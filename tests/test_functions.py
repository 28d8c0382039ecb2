from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.functions import basis as B
from claimloom.functions import labels as L
from claimloom.functions import period as P
from claimloom.functions import quantity as Q
from claimloom.functions.text import edit_distance, fold, is_abbreviation


def one(spark, values, expression, kind="string"):
    """The expression of each value, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


YEAR24 = (date(2023, 4, 1), date(2024, 4, 1))
PERIODS = [
    *[(t, *YEAR24, "year") for t in ("FY24", "FY 24", "FY2024", "fiscal 2024", "FY2023-24", "FY23-24", "2023-24", "F.Y. 24", "financial year 2024")],
    *[(t, date(2024, 4, 1), date(2025, 4, 1), "year") for t in ("FY2024-25", "FY2024/25", "2024-25")],
    ("Q1 FY24", date(2023, 4, 1), date(2023, 7, 1), "quarter"),
    ("Q2 FY24", date(2023, 7, 1), date(2023, 10, 1), "quarter"),
    ("Q3 FY24", date(2023, 10, 1), date(2024, 1, 1), "quarter"),
    ("Q4 FY24", date(2024, 1, 1), date(2024, 4, 1), "quarter"),
    ("H1 FY24", date(2023, 4, 1), date(2023, 10, 1), "half"),
    ("H2 FY24", date(2023, 10, 1), date(2024, 4, 1), "half"),
    ("9M FY24", date(2023, 4, 1), date(2024, 1, 1), "period"),
    ("CY2024", date(2024, 1, 1), date(2025, 1, 1), "year"),
    ("year ended March 31, 2024", *YEAR24, "year"),
    ("year ended 31 December 2023", date(2022, 12, 31), date(2023, 12, 31), "year"),
    ("as at March 31, 2024", date(2024, 3, 31), date(2024, 3, 31), "instant"),
    ("the first eight months of FY25", date(2024, 4, 1), date(2024, 12, 1), "part"),
    ("first 8 months of FY25", date(2024, 4, 1), date(2024, 12, 1), "part"),
    ("first three months of FY24", date(2023, 4, 1), date(2023, 7, 1), "part"),
    ("first twelve months of FY24", *YEAR24, "year"),
    ("March 2024", date(2024, 3, 1), date(2024, 4, 1), "month"),
    ("2024-03-05", date(2024, 3, 5), date(2024, 3, 5), "instant"),
    ("01-02-2024", date(2024, 2, 1), date(2024, 2, 1), "instant"),
    ("2019-2024", date(2019, 4, 1), date(2024, 4, 1), "multi"),
    ("quarter ended June 30, 2023", date(2023, 6, 30), date(2023, 6, 30), "instant"),
    ("year ended 29 February 2024", date(2023, 2, 28), date(2024, 2, 29), "year"),
    ("2024", date(2024, 1, 1), date(2025, 1, 1), "year"),
]


def test_periods(spark):
    found = one(spark, [t for t, *_ in PERIODS], P.parse_period)
    for (text, *want), got in zip(PERIODS, found):
        assert got is not None and list(got) == want, text


def test_nothing_stated_is_null(spark):
    assert one(spark, ["", None, "   ", "in the ordinary course of business", "Q4", "31 February", "may be", "99-99-9999"], P.parse_period) == [None] * 8


RELATIONS = [("2024-25", "FY24", "disjoint"), ("FY2024/25", "2024-25", "equal"), ("FY24", "Q4 FY24", "nested"), ("Q3 FY24", "FY24", "nested"), ("FY22", "FY24", "disjoint"), ("FY25", "the first eight months of FY25", "nested"), ("CY2024", "FY25", "partial"), ("as at 31 March 2024", "FY24", "disjoint"), ("H1 FY24", "first six months of FY24", "nested"), ("", "FY24", "unstated")]


def test_relations(spark):
    rows = spark.createDataFrame(RELATIONS, "a string, b string, r string")
    pair = [P.parse_period(F.col(c)) for c in "ab"]
    for row in rows.select("a", "b", "r", P.relation(*pair).alias("x"), P.describe_difference(*pair).alias("d"), P.contains(*pair).alias("c")).collect():
        assert row["x"] == row["r"], row
        assert (row["d"] is None) == (row["r"] in ("equal", "unstated"))
    whole = {(r["a"], r["b"]): r["c"] for r in rows.select("a", "b", P.contains(*pair).alias("c")).collect()}
    assert whole["FY24", "Q4 FY24"] and not whole["Q3 FY24", "FY24"]


NUMBERS = [("8,142", 8142), ("1,23,456", 123456), ("1,234,567", 1234567), ("6.4", 6.4), ("~6.5", 6.5), ("approx. 12.3", 12.3), ("-3.2", -3.2), ("(452)", -452), ("(1,234.5)", -1234.5), ("१२३", 123), ("12 34", 1234), ("−4", -4)]


def test_numbers(spark):
    assert [r["value"] for r in one(spark, [t for t, _ in NUMBERS], Q.parse_number)] == [v for _, v in NUMBERS]
    assert [tuple(r) for r in one(spark, ["6.3-6.8", "7 to 5", "(5-7)"], Q.parse_number)] == [(6.55, 6.3, 6.8), (6.0, 5.0, 7.0), (6.0, 5.0, 7.0)]
    assert one(spark, ["not applicable", "", "NA", None, "-"], Q.parse_number) == [None] * 5


UNITS = [("Rs Cr", "INR", 1e7), ("₹ crore", "INR", 1e7), ("INR million", "INR", 1e6), ("Rs. in lakhs", "INR", 1e5), ("US$ bn", "USD", 1e9), ("$ billion", "USD", 1e9), ("per cent", "percent", 1), ("%", "percent", 1), ("bps", "percent", 0.01), ("hours", "count", 1), (None, "count", 1), ("crore", "INR", 1e7), ("Mn shipments", "count", 1e6), ("sq m", "count", 1e6), ("lakh crore", "count", 1e7)]


def test_units(spark):
    found = one(spark, [u for u, *_ in UNITS], lambda c: Q.parse_unit(c, F.lit("INR")))
    assert [tuple(r) for r in found] == [(d, s) for _, d, s in UNITS]


@pytest.mark.parametrize("a, b, gap, three, four", [(8.142e10, 8.1424e10, None, True, True), (8.142e10, 8.9e10, None, False, False), (100.0, 110.0, 10 / 110, False, False), (0.0, 0.0, 0.0, True, True), (0.0, 1.0, 1.0, False, False), (999.6, 1000.0, None, True, False), (-5.0, 5.0, 2.0, False, False)])
def test_gap_and_figures(spark, a, b, gap, three, four):
    row = spark.createDataFrame([(a, b)], "a double, b double").select(Q.relative_gap(F.col("a"), F.col("b")), Q.relative_gap(F.col("b"), F.col("a")), Q.same_to_figures(F.col("a"), F.col("b")), Q.same_to_figures(F.col("a"), F.col("b"), 4)).first()
    assert row[0] == row[1] and 0 <= row[0] <= 2 and (row[2], row[3]) == (three, four)
    assert gap is None or abs(row[0] - gap) < 1e-12


def test_basis(spark):
    rows = spark.createDataFrame([("Consolidated, audited", ["at constant prices"]), ("second advance estimate", []), ("Pro forma", None), (None, ["provisional"]), (None, None), ("zebra apple mango kiwifruit", [])], "b string, q array<string>")
    found = [r[0] for r in rows.select(B.basis_tokens(F.col("b"), F.col("q"))).collect()]
    assert found == [["audited", "consolidated", "real"], ["advance_estimate"], ["proforma"], ["provisional"], [], ["apple", "kiwifruit"]]
    ranks = one(spark, [["provisional", "revised"], ["audited"], []], lambda c: F.struct(B.stage_of(c).alias("s"), B.stage_rank(c).alias("r")), "array<string>")
    assert [tuple(r) for r in ranks] == [("revised", 5), (None, None), (None, None)]


def test_labels(spark):
    split = one(spark, ["Revenue from operations (Consolidated) (I)", "Total income [a] (12)", "net - ", None, "(audited)"], L.split_qualifiers)
    assert [(r["name"], r["qualifiers"]) for r in split] == [("Revenue from operations", ["consolidated"]), ("Total income", []), ("net", []), (None, None), ("(audited)", ["audited"])]
    assert one(spark, ["Revenues from the customers", "Total companies", None], L.content_key) == [["customer", "revenue"], ["company"], []]
    assert one(spark, ["A–B  c!", "", "x" * 70], L.slugify) == ["a_b_c", "unnamed", "x" * 60]
    assert one(spark, ["Acme Pvt. Ltd.", "Acme Ltd", "Acme & Sons Company"], L.canonical_form) == ["acme", "acme", "acme sons"]
    assert one(spark, ["a short one", "INDIA 2025 ARTICLE IV CONSULTATION-PRESS RELEASE; STAFF REPORT", "x" * 40], L.short_label) == ["a short one", "INDIA 2025 ARTICLE IV", "x" * 30]
    keys = spark.createDataFrame([(["cash", "financing"], ["cash", "operating"]), (["revenue"], ["contract", "revenue"])], "a array<string>, b array<string>")
    assert [r[0] for r in keys.select(L.substitutes(F.col("a"), F.col("b"))).collect()] == [True, False]
    named = one(spark, ["the Company.", "", None, "Acme"], lambda c: L.resolved_name(c, F.lit("Issuer Ltd")))
    assert named == ["Issuer Ltd", "Issuer Ltd", "Issuer Ltd", "Acme"]


def brute_distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.integers(0, 4))
def test_edit_distance(a, b, limit):
    assert edit_distance(a, b, limit) == min(brute_distance(a, b), limit + 1)


def test_small_text_helpers():
    assert fold("ÉCOLE ﬁn") == "ecole fin" and is_abbreviation("rlys", "railways") and not is_abbreviation("railways", "railways")
