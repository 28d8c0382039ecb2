import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from claimloom.operators import cascade, pairs, reports, resolve, store
from claimloom.operators.frames import frame_claims

SCHEMA = "lemma_key string, claim_id long, witness_id long, title string, vintage date, claim_type string, measure_raw string, value double, value_text string, unit_dim string, unit_raw string, value_raw string, period struct<start:date,end:date,grain:string>, period_raw string, basis array<string>, confidence double"
FY24 = (date(2023, 4, 1), date(2024, 4, 1), "year")


def side(claim_id, witness_id=1, value=100.0, **more):
    base = {
        "lemma_key": "e:m", "claim_id": claim_id, "witness_id": witness_id, "title": f"W{witness_id}", "vintage": None, "claim_type": "quantity", "measure_raw": "m", "value": value,
        "value_text": None, "unit_dim": "INR", "unit_raw": "Rs", "value_raw": str(value), "period": FY24, "period_raw": "FY24", "basis": [], "confidence": 0.8,
    } | more
    return tuple(base.values())


V1, V2 = date(2024, 1, 1), date(2025, 1, 1)
Q1 = (date(2023, 4, 1), date(2023, 7, 1), "quarter")
CASES = [
    ({}, {"unit_dim": "USD"}, "DIMENSION_MISMATCH"),
    ({"claim_type": "state", "value": None, "value_text": "active", "vintage": V1}, {"claim_type": "event", "value": None, "value_text": "resigned", "vintage": V2}, "STATE_SUPERSEDED"),
    ({"claim_type": "state", "value": None, "value_text": "active"}, {"claim_type": "state", "value": None, "value_text": "resigned", "vintage": V2}, "STATE_CONFLICT"),
    ({}, {"period": None}, "PERIOD_UNSTATED"),
    ({}, {"period": (date(2021, 4, 1), date(2022, 4, 1), "year")}, "PERIOD_DISJOINT"),
    ({}, {"period": Q1}, "PERIOD_NESTED"),
    ({}, {"period": (*FY24[:2], "part")}, "PERIOD_NESTED"),
    ({}, {"period": (date(2024, 1, 1), date(2025, 1, 1), "year")}, "PERIOD_PARTIAL"),
    ({"basis": ["consolidated"]}, {"basis": ["standalone"]}, "BASIS_MISMATCH"),
    ({"basis": ["gross"]}, {"basis": ["net"]}, "ADJUSTMENT_MISMATCH"),
    ({}, {"unit_raw": "₹"}, "UNIT_SCALE"),
    ({}, {"value": 100.4}, "ROUNDING"),
    ({"value": 995.0}, {"value": 1000.0}, "ROUNDING"),
    ({}, {}, "EXACT"),
    ({"value": -2491.86, "value_raw": "(2,491.86)"}, {"value": 2491.86}, "SIGN_CONVENTION"),
    ({"value": 50.0, "basis": ["provisional"]}, {"basis": ["revised"]}, "VINTAGE_REVISION"),
    ({"value": 85.0, "vintage": V1}, {"vintage": V2, "basis": ["restated"]}, "RESTATEMENT"),
    ({"value": 84.0, "vintage": V1}, {"vintage": V2, "basis": ["restated"]}, "CONTRADICTS"),
    ({"value": 10.1}, {"value": 26.8}, "CONTRADICTS"),
    ({"claim_type": "identity", "value": None}, {"claim_type": "identity", "value": None}, "NO_RULE"),
]


@pytest.fixture(scope="module")
def ruled(spark):
    rows = [(i, side(1, 1, **a), side(2, 2, **b)) for i, (a, b, _) in enumerate(CASES)]
    struct = f"struct<{','.join(f'{c.strip()}' for c in SCHEMA.replace(' string', ':string').replace(' long', ':long').replace(' double', ':double').replace(' date', ':date').replace(' struct', ':struct').replace(' array', ':array').split(', '))}>"
    pairs_ = spark.createDataFrame(rows, f"i int, a {struct}, b {struct}").withColumn("lemma_key", F.lit("e:m"))
    both = {}
    for name, df in (("ab", pairs_), ("ba", pairs_.withColumnsRenamed({"a": "x"}).withColumnsRenamed({"b": "a"}).withColumnsRenamed({"x": "b"}))):
        both[name] = {r["i"]: r for r in cascade.explain_rulings(cascade.rule_pairs(df)).collect()}
    return both


def test_every_rule(ruled):
    for i, (_, _, want) in enumerate(CASES):
        row = ruled["ab"][i]
        assert row["rule_id"] == want and row["verdict"] == cascade.VERDICTS[want], (i, row["rule_id"], want)
        assert row["explanation"], want
    assert {w for *_, w in CASES} == set(cascade.VERDICTS) - {"DEFINITION_DRIFT"}


def test_rules_do_not_depend_on_the_order(ruled):
    for i in range(len(CASES)):
        assert ruled["ab"][i]["rule_id"] == ruled["ba"][i]["rule_id"]


def test_severity_and_divergence(ruled):
    row = next(r for r in ruled["ab"].values() if r["rule_id"] == "CONTRADICTS" and r["a"]["value"] == 10.1)
    assert abs(row["divergence"] - 16.7 / 26.8) < 1e-9 and row["severity"] == 0.9
    assert all(r["severity"] is None for r in ruled["ab"].values() if r["verdict"] != "contradicts")
    assert all(r["divergence"] == 0 for r in ruled["ab"].values() if r["rule_id"] in ("EXACT", "SIGN_CONVENTION"))


def brute_pairs(rows, most=None):
    out, taken = set(), {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[0] == b[0] and (a[2] != b[2] or a[12] == b[12]) and (most is None or taken.get(a[0], 0) < most):
                taken[a[0]] = taken.get(a[0], 0) + 1
                out.add((a[1], b[1]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_pairs_match_brute_force(spark, seed):
    chance = random.Random(seed)
    rows = []
    for i in range(60):
        lemma = chance.choice(["hot", "hot", "hot", "cold", "lone"])
        # The hot lemma is mostly one witness, which is the case that the cap has to look past.
        witness = 1 if lemma == "hot" and i > 4 else chance.randrange(3)
        rows.append(side(i, witness, lemma_key=lemma, period=chance.choice([FY24, Q1, (date(2020 + i % 5, 1, 1), date(2026, 1, 1), "year"), None])))
    rows.append(side(99, lemma_key=None))
    df = spark.createDataFrame(rows, SCHEMA)
    ids = lambda p: {(r[0], r[1]) for r in p.select("a.claim_id", "b.claim_id").collect()}
    kept = [r if r[12] is None else (*r[:12], r[12][:1], *r[13:]) for r in rows if r[0]]
    assert ids(pairs.lemma_pairs(df)) == brute_pairs(kept)
    for most in (1, 4, 1000):
        # Brute force takes pairs lemma by lemma in the order of both ids.
        want = {p for lemma in ("hot", "cold", "lone") for p in brute_pairs([r for r in kept if r[0] == lemma], most)}
        assert ids(pairs.capped_lemma_pairs(df, most)) == want


def test_frames_of_dirty_claims(spark):
    schema = "claim_id long, witness_id long, claim_type string, measure_raw string, value_raw string, unit_raw string, period_raw string, basis_raw string, qualifiers array<string>, entity_raw string, confidence double, title string"
    rows = [(1, 1, "quantity", "Revenue (Consolidated)", "8,142", "Rs Cr", "FY24", None, ["audited"], "the Company", 0.5, "clash"), (1, 1, "quantity", "Revenue (Consolidated)", "8,142", "Rs Cr", "FY24", None, ["audited"], "the Company", 0.5, "clash"), (2, 9, None, None, None, None, None, None, None, None, None, None), (3, 1, "state", "", "in force", "", "", "", [], "Acme Ltd", None, "x" * 5000)]
    witness = spark.createDataFrame([(1, "T", "2024-05", "Pub Limited", "INR")], "witness_id long, title string, vintage_raw string, publisher string, default_currency string")
    claim = spark.createDataFrame(rows, schema).drop("title")
    found = {r["claim_id"]: r for r in frame_claims(claim, witness).collect()}
    assert len(found) == 3 and found[1]["lemma_key"] == "pub:revenue" and found[1]["basis"] == ["audited", "consolidated"] and found[1]["value"] == 8.142e10 and found[1]["vintage"] is None
    assert found[1]["frame_key"] == "pub:revenue|2023-04-01..2024-04-01|audited,consolidated|INR"
    assert found[2]["lemma_key"] is None and found[2]["frame_key"].endswith("none|none|none") and found[3]["value_text"] == "in force"
    assert frame_claims(claim.limit(0), witness.limit(0)).count() == 0


def test_verdict_store(spark):
    schema = "lemma_key string, claim_a long, claim_b long, verdict string, rule_id string, divergence double, severity double, explanation string"
    old = spark.createDataFrame([("l", 1, 2, "distinct", "NO_RULE", None, None, "")], schema)
    ruled = spark.createDataFrame([("l", 2, 1, "contradicts", "CONTRADICTS", 1.0, 1.0, ""), ("l", 3, 4, "corroborates", "EXACT", 0.0, None, "")], schema)
    drift = spark.createDataFrame([("l~m", 4, 3, "reconciled", "DEFINITION_DRIFT", None, None, ""), ("l~m", 5, 6, "reconciled", "DEFINITION_DRIFT", None, None, "")], schema)
    assert {(r["claim_a"], r["claim_b"], r["rule_id"]) for r in store.store_verdicts(old, ruled, drift).collect()} == {(3, 4, "EXACT"), (5, 6, "DEFINITION_DRIFT")}


def test_number_rows(spark):
    rows = spark.range(1000).selectExpr("id % 300 as k")
    numbers = sorted(r["id"] for r in store.number_rows(rows, ["k"], start=5).collect())
    assert numbers == list(range(5, 1005))


def sequential(places, matches):
    """The clustering as it is defined, one item after the other."""
    leader = {}
    for item in sorted(places, key=places.get):
        options = [(-matches[min(item, o), max(item, o)], places[o], o) for o in leader if leader[o] == o and (min(item, o), max(item, o)) in matches]
        leader[item] = min(options)[2] if options else item
    return leader


@pytest.mark.parametrize("seed", range(4))
def test_leaders_equal_the_sequential_clustering(spark, seed):
    chance = random.Random(seed)
    ids = [f"p{i}" for i in range(40)]
    places = dict(zip(ids, chance.sample(range(100), 40)))
    matches = {tuple(sorted(chance.sample(ids, 2))): round(chance.random(), 1) for _ in range(90)}
    found = resolve.leaders(spark.createDataFrame(list(places.items()), "id string, place int"), spark.createDataFrame([(*k, v) for k, v in matches.items()], "a string, b string, score double"))
    assert {r["id"]: r["leader"] for r in found.collect()} == sequential(places, matches)


def test_leaders_without_matches(spark):
    found = resolve.leaders(spark.createDataFrame([("x", 1)], "id string, place int"), spark.createDataFrame([], "a string, b string, score double"))
    assert [tuple(r) for r in found.collect()] == [("x", "x")]


def test_resolution(spark):
    rows = [(1, "Dalvery Limited"), (2, "dalvery ltd"), (3, "Dalvry Ltd"), (4, "Blue Dart"), (5, None), (6, ""), (7, "Dart Blue")]
    names = spark.createDataFrame(rows, "n int, e string")
    found = {r["phrase"]: r["entity"] for r in resolve.resolve_entities(names, "e", ["n"]).collect()}
    assert found["dalvery limited"] == found["dalvery ltd"] == found["dalvry ltd"] == "Dalvery Limited" and found["blue dart"] == found["dart blue"] == "Blue Dart" and len(found) == 5
    measures = spark.createDataFrame([(1, "Revenue from customers"), (2, "revenues from customers"), (3, "Net cash from financing activities"), (4, "Net cash from operating activities"), (5, "Revenue from customer")], "n int, m string")
    found = {r["phrase"]: r["measure"] for r in resolve.resolve_measures(measures, "m", ["n"]).collect()}
    assert found["revenues from customers"] == found["revenue from customer"] == "Revenue from customers" and found["net cash from financing activities"] != found["net cash from operating activities"]


def test_near_candidates_are_few_and_miss_none(spark):
    rng = random.Random(7)
    part = lambda n: "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(n))
    texts = {f"{part(5)} {rng.choice(['chemicals', 'industries', 'textiles'])}" for _ in range(150)} | {"anana banana an", "banana banana an", "banana anana an"}
    for text in sorted(texts)[:60]:
        for edits in (1, 2, 3):
            letters = [*text]
            for _ in range(edits):
                at = rng.randrange(len(letters))
                letters[at : at + rng.choice((0, 1))] = rng.choice(("", rng.choice("aeiourst")))
            texts.add("".join(letters))
    texts = sorted(texts - {""})
    wanted = {(x, y) for x in texts for y in texts if x < y and resolve.indel_similarity(x, y) >= 90}
    got = [(r["ta"], r["tb"]) for r in resolve.near_candidates(spark.createDataFrame([(x,) for x in texts], "text string"), 0.9).collect()]
    assert len(wanted) > 100 and wanted <= set(got) and len(got) == len(set(got)) <= 2 * len(wanted), (len(wanted), len(got))


def test_near_strings_finds_all(spark):
    chance = random.Random(5)
    words = ["".join(chance.choice("abcdef") for _ in range(chance.randrange(8, 20))) for _ in range(60)]
    words += [w[:3] + chance.choice("abcdef") + w[3:] for w in words[:30]] + [w[:5] + w[6:] for w in words[30:]]
    words = sorted(set(words))
    got = {(r["a"], r["b"]) for r in resolve.near_strings(spark.createDataFrame([(w, w) for w in words], "id string, text string"), 0.9).collect()}
    from claimloom.operators.anchor import indel_similarity

    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if indel_similarity(a, b) >= 90}
    assert got == want and len(want) > 30


def brute_fold(rows):
    prior, out = {}, []
    for r in sorted(rows, key=lambda r: (r["vintage"] is not None, r["vintage"] or date.min, r["claim_id"])):
        key = (r["witness_id"], r["value"])
        p = prior.get(key)
        if p and r["value"] is not None and (not r["basis"] or not p["basis"] or r["basis"] == p["basis"]):
            p["repeats"] += 1
            p["basis"] = p["basis"] or r["basis"]
            continue
        mine = dict(r, repeats=1)
        if p is None:
            prior[key] = mine
        out.append(mine)
    return {(o["claim_id"], ",".join(o["basis"]), o["repeats"]) for o in out}


@pytest.mark.parametrize("seed", range(3))
def test_reading_fold(spark, seed):
    chance = random.Random(seed)
    rows = [{"lemma_key": "l", "claim_id": i, "witness_id": chance.randrange(2), "starts": None, "ends": None, "value": chance.choice([1.0, 2.0, None]), "unit_dim": "INR", "vintage": chance.choice([None, V1, V2]), "basis": chance.choice([[], ["net"], ["gross"]])} for i in range(40)]
    df = spark.createDataFrame(rows, "lemma_key string, claim_id long, witness_id long, starts date, ends date, value double, unit_dim string, vintage date, basis array<string>")
    assert {(r["claim_id"], ",".join(r["basis"]), r["repeats"]) for r in reports.fold_readings(df).collect()} == brute_fold(rows)


def test_deleting_witnesses(spark):
    t = {
        "witness": spark.createDataFrame([(1,), (2,)], "witness_id long"),
        "page": spark.createDataFrame([(1,), (2,)], "witness_id long"),
        "passage": spark.createDataFrame([(10, 1), (20, 2)], "passage_id long, witness_id long"),
        "claim": spark.createDataFrame([(1, 1, 10), (2, 2, 20), (3, 2, 10)], "claim_id long, witness_id long, passage_id long"),
        "anchor": spark.createDataFrame([(1,), (2,)], "claim_id long"),
        "verdict": spark.createDataFrame([(1, 2), (2, 3)], "claim_a long, claim_b long"),
        "measure": spark.createDataFrame([(1, 1), (2, 2), (3, None)], "measure_id long, first_seen_in long"),
    }
    left = store.delete_witnesses(t, t["witness"].where("witness_id = 1"))
    assert {n: left[n].count() for n in t} == {"witness": 1, "page": 1, "passage": 1, "claim": 2, "anchor": 1, "verdict": 1, "measure": 3}
    assert {(r["claim_id"], r["passage_id"]) for r in left["claim"].collect()} == {(2, 20), (3, None)}
    assert {(r["measure_id"], r["first_seen_in"]) for r in left["measure"].collect()} == {(1, None), (2, 2), (3, None)}
