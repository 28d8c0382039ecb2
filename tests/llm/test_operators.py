"""Every operator of the subpackage against brute force, an exact inverse or held-out truth, and on dirty tables."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.llm import abuse, canonical, chunking, graphs, groups, machine, mixing, names, neighbours, tokens, variants

# ---- p2: groups


def components(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            root[find(a)] = find(b)
    out = defaultdict(list)
    for x in root:
        out[find(x)].append(x)
    return {x: min(g) for g in out.values() for x in g}


@pytest.mark.parametrize("seed, kind", [(0, "random"), (1, "chain"), (2, "star"), (3, "strings")])
def test_groups(spark, seed, kind):
    chance = random.Random(seed)
    if kind == "chain":
        links = [(i, i + 1) for i in range(300)]
        chance.shuffle(links)
    elif kind == "star":
        links = [(0, i) for i in range(1, 500)] + [(1000, 1001)]
    else:
        links = [(chance.randrange(200), chance.randrange(200)) for _ in range(150)] + [(None, 3), (5, None), (7, 7), (None, None)]
    if kind == "strings":
        links = [tuple(None if x is None else f"k{x}" for x in p) for p in links]
    t = "string" if kind == "strings" else "long"
    df = spark.createDataFrame([(*p, "x", 1) for p in links + links[:20] + [(b, a) for a, b in links[:20]]], f"a {t}, b {t}, x string, group_id int")
    got = {r["member"]: r["group_id"] for r in groups.group_pairs(df, "a", "b").collect()}
    assert got == components(links)


def test_groups_of_verdicts(spark):
    rows = [(1, 2, "Corroborates "), (2, 3, "\tcorroborates\n"), (4, 5, "contradicts"), (6, 7, None), (8, None, "corroborates"), (9, 9, "corroborates")]
    df = spark.createDataFrame(rows, "claim_a long, claim_b long, verdict string")
    assert {tuple(r) for r in groups.corroboration_groups(df).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert groups.corroboration_groups(df.limit(0)).count() == 0


# ---- p3: canonical list

LABELS = [(1, "Revenue from warehousing"), (2, "Revenue from rail freight"), (3, "Net cash from operating activities"), (4, "Labour force participation rate"), (5, "Total income"), (6, "Interest income"), (7, "Operating cost of warehousing"), (8, "Greenhouse gas emissions"), (9, "Market capitalisation"), (10, "Software services exports")]
WORDINGS = [
    ("REVENUE FROM WAREHOUSING", 1), ("Warehousing - revenue", 1), ("warehousing, Revenue from (note 7)", 1), ("(iii) Reveneu frm w/housing (consolidated)", 1), ("revenue_from_rail_frt", 2), ("Revenues fr. rail frieght *", 2),
    ("Net cash frm operating acts.", 3), ("Net cash from investing activities", -1), ("Net cash from financing activities", -1), ("LFPR", 4), ("Labor force partcpn rate", 4), ("Totalincome", 5), ("of which: Int. income [a]", 6), ("Interest payable on bonds", -1),
    ("Oper. cost of whsing, provisional", 7), ("Rcvenue frm whsnig", 1), ("ooper. cost of w/housing", 7), ("Pension payable", -1), ("Operators", -1), ("GHG emission", 8), ("M-cap", 9), ("Software servies export", 10), ("Revenue from billboard letting", -1), ("as above", -1), ("-", -1), ("???", -1), ("(1)", -1), ("Grand", -1), ("x" * 3000, -1), ("word " * 500, -1), ("Total", -1), ("Zoo visits", -1),
]


def test_wordings():
    matcher = canonical.Matcher(LABELS)
    for text, want in WORDINGS:
        assert matcher.resolve(text) == want, text
    assert canonical.Matcher([]).resolve("anything") == -1
    assert canonical.Matcher([(5, "Net worth"), (2, "net  worth")]).resolve("NET WORTH") == 2


def test_assignment_is_the_cheapest_cover():
    """The only cover leaves words open that are dear to leave until the end, among more than 64 cheaper sets."""
    need = frozenset("abcdefgh")
    words = [[(0.0, []), (0.0, [c])] for c in "abcdefg"] + [[(0.0, []), (0.0, ["h"])]]
    words[0] = [(0.0, []), (5.0, ["a"])]
    assert canonical._assign(words, need) == 5.0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_wording_is_decided(text):
    assert canonical.Matcher(LABELS[:3]).resolve(text) in (-1, 1, 2, 3)


def test_claim_measures(spark):
    measure = spark.createDataFrame([(i, t, "listed") for i, t in LABELS] + [(99, "Zoo visits", "provisional"), (None, "x", "listed"), (98, None, "listed")], "measure_id long, canonical_label string, label_state string")
    rows = [(1, "revenue from WAREHOUSING"), (1, "revenue from WAREHOUSING"), (2, "Revenue from warehousing"), (3, None), (4, ""), (5, "Zoo visits"), (None, "LFPR"), (6, " ")]
    claim = spark.createDataFrame([(*r, "k", 1) for r in rows], "claim_id long, measure_raw string, key string, measure_id int").select("claim_id", "measure_raw", "key", "measure_id")
    assert {tuple(r) for r in canonical.claim_measures(claim, measure).collect()} == {(1, 1), (5, -1), (6, -1)}
    assert canonical.claim_measures(claim.limit(0), measure).count() == 0
    assert {tuple(r) for r in canonical.claim_measures(claim, measure.limit(0)).collect()} == {(1, -1), (2, -1), (5, -1), (6, -1)}


def test_long_lists_are_matched_in_blocks(spark, monkeypatch):
    """More entries than one matcher holds: the same decisions, and aliases, initials and short forms of one's own."""
    entries = spark.createDataFrame(LABELS, "id long, label string")
    said = spark.createDataFrame([(t,) for t, _ in WORDINGS if t] + [("Godown takings",), ("NCFOA",), ("zed income",)], "t string")
    aliases = spark.createDataFrame([(1, "Godown takings"), (77, "no such entry"), (None, "x")], "id long, label string")
    run = lambda: {r["t"]: (r["id"], r["how"]) for r in canonical.map_values(said, "t", entries, "id", "label", aliases, {**canonical.SHORT_FORMS, "zed": "total"}).collect()}
    whole = run()
    monkeypatch.setattr(canonical, "MOST_LABELS", 3)
    monkeypatch.setattr(canonical, "VALUES", 7)
    assert run() == whole
    assert {t: k for t, (k, _) in whole.items()} == {t: k for t, k in WORDINGS if t} | {"Godown takings": 1, "NCFOA": 3, "zed income": 5}
    assert whole["Godown takings"][1] == whole["NCFOA"][1] == "automaton" and whole["GHG emission"][1] == "similar" and whole["-"][1] == "none"


# ---- p4: variants of names

SAME = [
    ["Gunileteshab Textiles Corporation", "GUNILETESHAB TEX. CORP", "Textiles Corpn., Gunileteshab", "M/s Gunileteshab Textiles", "GunileteshabTextiles Corporation", "Guniletesahb Textiles Corporation", "Gunil.eteshab Corporation", "Gunileteshab", "gUNILETESHAB tEXTILES"],
    ["Victoria G. Lochimagidi", "Lochimagidi, V G", "Tori Lochimagidi", "Dr V. Lochimagidi", "VICTORIA LOCHIMGIDI"],
    ["Directorate of Statistics, Libokibeve", "Government of Libokibeve, Dte of Stats", "Libokibeve - Directorate of Statistcs", "Directorate of Statistics (Líbokibeve)"],
    ["Harpreet L. Mavudrenopi", "Happy Mavudrenopi"],
    ["Gurpreet L. Mavudrenopi", "Guri Mavudrenopi"],
    ["Madrabukejo Steel Works LLP", "Madrabukejo Steel Wks L.L.P."],
    ["Madrabukejo Infrastructure LLP", "Madrabukejo Infra LLP"],
    ["Ministry of Commerce, Libokibeve", "Min. of Comm., Govt. of Libokibeve"],
    ["Elena Petrova", "Petrova, Elena", "Elena M. Petrova", "E. Petrova", "Elena Petrovaa"],
    ["Zarnik Voltra Ltd", "Voltra Zarnik Limited", "Zarnik Voltra", "Zarn ik Voltra Ltd", "Varnik Voltra Ltd"],
    ["Zarnik Voltra Hotels", "M/s Hotels Voltra Zarnik"],
    ["T.C.S. Ltd", "TCS Limited", "T. C. S."],
    ["Arun Sharma", "Sharma Arun"],
    ["Arun Pharma Ltd", "Arun Pharmaceuticals"],
    ["Robert A. Kowalik", "Kowalik, Bob A"],
    ["Robert B. Kowalik", "Robert B Kowalik", "KOWALIK, ROBERT B."],
    ["Robert Kowalik"],
    ["Robert Steele"],
    ["Robert Steel Ltd", "Robert Steel"],
    ["Michael Davenport", "Davenport, M."],
    ["Robert James", "James, Bob"],
    ["Ministry of Finance", "Min. of Fin."],
    ["Steel Trading Corporation", "Steel Trdg. Corpn."],
    ["Drapofasure Electricity Commission", "Drapofasure Elec. Comn."],
    ["Quvilonaster Shipping", "QUVILONASTERSHIPPING"],
]
NOBODY = ["the Company", "We", "our Company", "it", "", None, "...", "Group", "The issuer.", "Ltd", "Mr."]


def test_variants(spark):
    rows = [(n, "x") for g in SAME for n in g] + [(n, "x") for n in NOBODY] + [("Gunileteshab", "y")]
    got = {tuple(r) for r in variants.variant_pairs(spark.createDataFrame(rows, "entity_raw string, name string").select("entity_raw", "name"), "entity_raw").collect()}
    want = {tuple(sorted((a, b), key=lambda s: s.encode())) for g in SAME for i, a in enumerate(g) for b in g[i + 1 :]}
    assert got == want, (want - got, got - want)
    assert variants.variant_pairs(spark.createDataFrame([], "entity_raw string"), "entity_raw").count() == 0


def test_no_plan_of_variants_holds_many_joins(spark, monkeypatch):
    held, kept = [], variants.keep

    def counted(df, name="table"):
        held.append((df._jdf.queryExecution().optimizedPlan().toString().count("Join "), name))
        return kept(df, name)

    monkeypatch.setattr(variants, "keep", counted)
    variants.variant_pairs(spark.createDataFrame([("Jon Tamsin Traders",), ("Tamsin Jon Traders",)], "n string"), "n")
    assert len(held) > 10 and max(held)[0] <= 8, max(held)


def test_variants_broadcast_no_table_that_grows(spark, monkeypatch):
    plans, kept = [], variants.keep

    def seen(df, name="table"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, name)

    monkeypatch.setattr(variants, "keep", seen)
    pairs = variants.variant_pairs(spark.createDataFrame([("Jon Tamsin Traders",), ("Tamsin Jon Traders",)], "n string"), "n")
    plans.append(("pairs", pairs._jdf.queryExecution().executedPlan().toString()))
    assert pairs.count() == 1
    assert any("SortMergeJoin" in p for _, p in plans) and not [n for n, p in plans if "BroadcastHashJoin" in p]


def test_near_stems_misses_no_two_edits(spark):
    from claimloom.functions.text import edit_distance

    chance = random.Random(3)
    words = ["".join(chance.choice("bcdfgk") + chance.choice("aeiou") for _ in range(chance.randrange(3, 6))) for _ in range(60)]
    for w in words[:40]:
        for _ in range(chance.randrange(1, 3)):
            i = chance.randrange(len(w))
            w = chance.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "y" + w[i + 1 :]])
        words.append(w)
    words = sorted(set(words))
    got = {(r["a"], r["b"]) for r in variants.near_stems(spark.createDataFrame([(w,) for w in words], "stem string")).collect()}
    sure = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if edit_distance(a, b, 3) <= (1 if max(len(a), len(b)) < 7 else 2)}
    most = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if edit_distance(a, b, 3) <= variants.allowed_edits(max(len(a), len(b)))}
    assert sure <= got <= most and len(sure) > 20


def test_near_stems_finds_swaps_and_three_edits(spark):
    """Beside brute force, with swaps and plain edits up to the limit, and stems of which swaps spoil every q-gram."""
    from claimloom.functions.text import edit_distance

    chance = random.Random(8)

    def edited(w, n):
        for _ in range(n):
            i = chance.randrange(len(w) - 1)
            w = chance.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "y" + w[i + 1 :], *[w[:i] + w[i + 1] + w[i] + w[i + 2 :]] * 3])
        return w

    words = ["".join(chance.choice("bcdfgklmnprst") if i % 2 else chance.choice("aeiou") for i in range(n)) for n in range(3, 17) for _ in range(5)]
    words += [edited(w, n) for w in words for n in range(1, variants.allowed_edits(len(w)) + 1) for _ in range(3)]
    swapped = [("ab", "ba"), ("abcdefg", "bacdegf"), ("abcdefghijk", "bacdegfhikj"), ("abcdefghijk", "bacdexfhikj"), ("abcdefghij", "bacdexfghji"), ("abcdefghijkl", "bacdegfhijlk"), ("abcdef", "bacdfeg")]
    words = sorted({*words, *(w for p in swapped for w in p), "a", "b"})
    got = {(r["a"], r["b"], r["edits"]) for r in variants.near_stems(spark.createDataFrame([(w,) for w in words], "stem string")).collect()}
    want = {(a, b, d) for i, a in enumerate(words) for b in words[i + 1 :] if (d := edit_distance(a, b, (m := variants.allowed_edits(max(len(a), len(b)))))) <= m}
    assert got == want, (want - got, got - want)
    assert sum(d == 3 for *_, d in want) > 20


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_name_is_read(text):
    read = names.read_name(text)
    assert read is None or read.words and len(read.words) == len(read.slips)


def test_variants_of_unknown_names_found_beside_brute_force(spark):
    """Persons and firms whose words no list holds, in any order, misspelt or torn: nearly all pairs are found, and no other."""
    chance = random.Random(12)
    word = lambda n: "".join(chance.choice("bcdfgklmnprstv") + chance.choice("aeiou") for _ in range(n))

    def typed(words):
        words = [*words]
        chance.shuffle(words)
        if (slip := chance.random()) < 0.5:
            i = chance.randrange(len(words))
            w, at = words[i], chance.randrange(1, len(words[i]) - 1)
            words[i] = w[:at] + w[at + 1 :] if slip < 0.15 else w[:at] + "z" + w[at:] if slip < 0.3 else w[:at] + w[at + 1] + w[at] + w[at + 2 :] if slip < 0.4 else w[:at] + " " + w[at:]
        return " ".join(words).title()

    groups_ = [{typed(g) for _ in range(6)} | {" ".join(g).title()} for g in ((word(4), word(5)) if i % 2 else (word(4), word(4), word(5)) for i in range(60))]
    got = {tuple(r) for r in variants.variant_pairs(spark.createDataFrame([(n,) for g in groups_ for n in g], "n string"), "n").collect()}
    want = {tuple(sorted((a, b), key=lambda s: s.encode())) for g in groups_ for a in g for b in g if a < b}
    assert len(got & want) / len(want) >= 0.9 and len(got - want) <= 0.01 * len(want), (len(got & want), len(got - want), len(want))


# ---- p5: nearest vectors


@pytest.mark.parametrize("clusters", [1, 40])
def test_graph_recall(clusters):
    chance = np.random.default_rng(clusters)
    v = chance.normal(size=(3000, 32)) + 2 * chance.normal(size=(clusters, 32))[chance.integers(0, clusters, 3000)]
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    graph, entries = graphs.build_graph(v, 32, 48)
    got, cosine = graphs.nearest(v, graph, entries, v[:500], 10, 48)
    truth = np.argsort(-(v[:500] @ v.T), axis=1)[:, :10]
    assert np.mean([len({*a} & {*b}) / 10 for a, b in zip(got, truth)]) >= 0.9
    assert np.allclose(cosine[:, 0], 1, atol=1e-5) and (graph >= -1).all() and graph.shape[1] <= 32


@pytest.mark.parametrize("held, k", [(3, 11), (40, 3), (1500, 11), (4133, 11)])
def test_shards_are_searched_whole(held, k):
    chance = np.random.default_rng(held)
    v = chance.normal(size=(held, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    places, cosines = neighbours.best_of(v[:700], v, k)
    truth = np.sort(v[:700] @ v.T, axis=1)[:, ::-1][:, :k]
    assert np.allclose(cosines, truth, atol=1e-6) and (np.diff(cosines, axis=1) <= 0).all()
    assert np.allclose(np.take_along_axis(v[:700] @ v.T, places, 1), truth, atol=1e-6)


def test_one_shard_misses_nothing(spark):
    v = np.random.default_rng(11).normal(size=(3000, 64))
    got = neighbours.similar_vectors(spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<float>"), "id", "v", k=10).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert {(i, j) for i, row in enumerate(np.argsort(-s, axis=1)[:, :10]) for j in row} == set(zip(got["id"], got["other"]))


@pytest.mark.parametrize("most_centres", [4096, 5])
def test_sharded_recall(spark, monkeypatch, most_centres):
    """Many centres and split graphs, as on large tables; centres of one level and of two."""
    monkeypatch.setattr(neighbours, "MOST_CENTRES", most_centres)
    monkeypatch.setattr(neighbours, "PER_CENTRE", 300)
    monkeypatch.setattr(neighbours, "MOST", 250)
    chance = np.random.default_rng(7)
    v = chance.normal(size=(2400, 24)) + 2.0 * chance.normal(size=(60, 24))[chance.integers(0, 60, 2400)]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<float>")
    got = neighbours.similar_vectors(df, "id", "v", k=10).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    truth = {(i, j) for i, row in enumerate(np.argsort(-s, axis=1)[:, :10]) for j in row}
    assert len(truth & set(zip(got["id"], got["other"]))) / len(truth) >= 0.9
    assert got.groupby("id").size().max() == 10 and abs(got["cosine"] - s[got["id"], got["other"]]).max() < 1e-4


def test_vectors_with_copies_and_dirt(spark):
    e = lambda *x: [float(y) for y in x]
    rows = [(i, e(1, 0, 0)) for i in range(20)] + [(30, e(0.99, 0.01, 0)), (31, e(0, 1, 0)), (32, e(0, 5, 0.01)), (40, None), (41, []), (42, e(0, 0, 0)), (43, e(1, 0)), (44, [1.0, None, 0.0]), (45, e(float("nan"), 1, 0)), (31, e(0, 1, 0)), (None, e(1, 0, 0))]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "id long, v array<float>, node int, members string")
    got = defaultdict(list)
    for r in neighbours.similar_vectors(df, "id", "v", k=10).orderBy("id", "rank").collect():
        got[r["id"]].append(r["other"])
    assert set(got) == {*range(20), 30, 31, 32}
    assert got[0] == [*range(1, 11)] and got[5] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10] and got[19] == [*range(10)] and got[30] == [*range(10)] and got[31][0] == 32
    pairs = {tuple(r) for r in neighbours.similar_pairs(df, "id", "v").collect()}
    assert (31, 32) in pairs and (0, 19) in pairs and (18, 19) not in pairs and (0, 31) not in pairs
    assert neighbours.similar_vectors(df.limit(0), "id", "v").count() == 0 and neighbours.similar_vectors(df.where("id = 30"), "id", "v").count() == 0


# ---- p6: splitting


def forced(text, most):
    run = best = 0
    for c in text:
        run = 0 if c in chunking.NATURAL else run + 1
        best = max(best, run)
    return best > most


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text("ab", min_size=1, max_size=40), st.sampled_from([" ", "\n\n", ". ", "。", "\t", "é", "🤷"])), max_size=60), st.integers(8, 40), st.integers(0, 12))
def test_pieces(parts, most, overlap):
    text = "".join(parts)
    pieces = chunking.split_text(text, most, overlap)
    assert "".join(text[f:e] for _, f, e, _ in pieces) == text
    assert all(e - s <= most and 0 <= f - s <= overlap for s, f, e, _ in pieces)
    assert [s for s, f, _, _ in pieces][0] == 0 and all(f == p[2] for p, (_, f, _, _) in zip(pieces, pieces[1:]))
    if len(text) > most:
        assert any(k == "forced" for *_, k in pieces) == forced(text, most)


def test_edits_stay_local():
    chance = random.Random(1)
    text = " ".join("".join(chance.choice("abcdefghij") for _ in range(chance.randrange(2, 9))) + ("." if chance.random() < 0.1 else "") for _ in range(20000))
    before = {text[f:e] for _, f, e, _ in chunking.split_text(text)}
    at = len(text) // 2
    edited = text[:at] + " inserted words " + text[at:]
    after = {edited[f:e] for _, f, e, _ in chunking.split_text(edited)}
    assert len(before) > 10 and len(after - before) <= 3


def test_split_table(spark):
    rows = [(1, "word " * 3000), (1, "word " * 3000), (2, "x" * 8001), (3, "short"), (4, None), (5, ""), (6, "y" * 8000), (7, "🤷" * 8001), (None, "w " * 5000)]
    got = chunking.split_oversized(spark.createDataFrame([(*r, 1, "z") for r in rows], "id long, text string, piece_no int, key string"), "id").collect()
    by = defaultdict(list)
    for r in got:
        by[r["id"]].append(r)
    assert set(by) == {1, 2, 7, None}
    for key, text in ((1, "word " * 3000), (2, "x" * 8001), (7, "🤷" * 8001), (None, "w " * 5000)):
        pieces = sorted(by[key], key=lambda r: r["piece_no"])
        assert "".join(p["piece"][p["overlap"] :] for p in pieces) == text and [p["piece_no"] for p in pieces] == [*range(len(pieces))]
        assert all(len(p["piece"]) <= 8000 for p in pieces) and any(p["cut_kind"] == "forced" for p in pieces) == (key in (2, 7))
    assert chunking.split_oversized(spark.createDataFrame([], "id long, text string"), "id").count() == 0


# ---- p7: tokens

TEXTS = ["", None, "Hello  world\n\n  x", "नमस्ते दुनिया", "a" * 30000, "🤷‍♀️ <|endoftext|> \x00\x7f", "don't 12,345.67 ₹", " ", "▁▁ low▁line", "ﬁ ﷽ 漢字。"]


def reference(texts):
    import public_tokenizers
    import tiktoken

    ranks = {t: i for i, t in enumerate(tokens.read_ranks(tokens.default_vocabulary()))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [own.encode_ordinary(t) if t else [] for t in texts]


def test_tokens(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "y"), (None, "Hello", "z")], "doc_id long, text string, ids string")
    rows = tokens.encode_texts(df).collect()
    got = {r["doc_id"]: r["ids"] for r in rows}
    assert len(rows) == len(TEXTS) + 2 and [got[i] for i in range(len(TEXTS))] == reference(TEXTS)
    back = {r["doc_id"]: r["text"] for r in tokens.decode_ids(tokens.encode_texts(df)).collect()}
    assert [back[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]
    sizes = {(r["doc_id"], r["ids"]): r["n_tokens"] for r in tokens.count_tokens(df, ["doc_id", "ids"]).collect()}
    assert sizes[2, "x"] == len(reference([TEXTS[2]])[0]) and sizes[0, "x"] == 0
    assert tokens.encode_texts(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_tokens_of_any_text(text):
    global _encoder
    try:
        _encoder
    except NameError:
        _encoder = tokens.Encoder(tokens.sentencepiece_model(tokens.read_ranks(tokens.default_vocabulary())), tokens.default_pattern())
    ids = next(iter(_encoder.encode([text])))
    assert ids == reference([text])[0] and _encoder.decode(ids) == text


# ---- p8: mixing


def test_mixing(spark):
    chance = random.Random(2)
    rows = [(i, "word " * chance.randrange(1, 60), chance.choice(["Big", "big ", "BIG"])) for i in range(600)] + [(1000 + i, "tiny words here", "small") for i in range(8)] + [(2000, None, "big"), (2001, "", "small"), (2002, "lost text", None), (2003, "no target", "other"), (None, "text", "big"), (1, "word " * 60, "big")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, copy int")
    target = spark.createDataFrame([("Big", 0.8, 2), ("small", 0.15, 4), ("empty", 0.05, 3), ("empty", 0.01, 3)], "source string, target_share double, max_repeats int")
    mixture, shares = mixing.mix_sources(docs, target)
    report = {r["source"]: r for r in shares.collect()}
    assert set(report) == {"big", "small", "empty"} and report["empty"]["tokens"] == 0
    # small fills its cap, and big gets its share beside it.
    assert report["small"]["drawn"] == 32 and report["small"]["most_copies"] == 4
    assert abs(report["small"]["reached_share"] - 0.15 / 0.95) < 0.01 and abs(sum(r["reached_share"] for r in report.values()) - 1) < 1e-9
    drawn = mixture.collect()
    assert all(r["n_tokens"] > 0 and r["source"] in ("big", "small") for r in drawn) and {r["doc_id"] for r in drawn}.isdisjoint({2000, 2001, 2002, 2003, None})
    assert Counter(r["source"] for r in drawn) == {s: r["drawn"] for s, r in report.items() if r["drawn"]}
    per = Counter(r["doc_id"] for r in drawn)
    assert max(per.values()) <= 4 and {(r["doc_id"], r["copy"]) for r in drawn} == {(d, c + 1) for d, n in per.items() for c in range(n)}
    again, _ = mixing.mix_sources(docs, target)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn))
    for a, b in ((docs.limit(0), target), (docs, target.limit(0))):
        empty, report = mixing.mix_sources(a, b)
        assert empty.count() == 0 and all(r["tokens"] == 0 for r in report.collect())


@pytest.mark.parametrize("total", [100.0, 1000.0, 5000.0, 10**7])
def test_shares_by_level(spark, total):
    """With a total, capped sources give all and the others share the rest by their targets."""
    sources = [("a", 0.5, 1, 400), ("b", 0.3, 2, 900), ("c", 0.2, 3, 20), ("d", 0.0, 3, 50)]
    sizes = spark.createDataFrame([(s, 1, n) for s, _, _, n in sources], "source string, n_docs long, tokens long")
    targets = spark.createDataFrame([(s, t, m) for s, t, m, _ in sources], "source string, target_share double, max_repeats int")
    got = {r["source"]: r["planned_tokens"] for r in mixing.plan_shares(sizes, targets, total).collect()}
    most = {s: n * m for s, _, m, n in sources}
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most[s], mid * t) for s, t, _, _ in sources) < min(total, sum(most[s] for s, t, _, _ in sources if t)) else (low, mid)
    for s, t, _, _ in sources:
        assert math.isclose(got[s], min(most[s], high * t), rel_tol=1e-6, abs_tol=1e-6), (s, got)


# ---- p9: abusive language

CALM = ["revenue rose by {} per cent", "the board met in {}", "kill the process {} and restart", "pig iron output reached {} tonnes", "conduct rules forbid calling staff vermin", "a bloody expensive quarter for {}"]
CRUEL = ["you are a worthless moron, {}", "those people of {} are vermin, drive them out", "somebody should beat you up, {}", "send me naked pictures, {}"]


def corpus(n, seed, noise=0.0):
    chance = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        parts = [chance.choice(CALM).format(chance.choice(["Delhi", "Pune", "Agra"]) + str(chance.randrange(100))) for _ in range(chance.randrange(1, 8))]
        bad = chance.random() < 0.2
        if bad:
            parts.insert(chance.randrange(len(parts) + 1), chance.choice(CRUEL).format(chance.choice(["Asha", "Ravi", "Sita"])))
        texts.append(". ".join(parts) + ".")
        labels.append(int(bad) if chance.random() >= noise else 1 - int(bad))
    return texts, np.array(labels)


def test_disguises_are_undone():
    assert "naked" in machine.plain("nаkеd") and "kill yourself" in machine.plain("ki​ll yo­urself") and "vermin" in machine.plain("v e r m i n") and "dumbass" in machine.plain("D.u.m.b.a.s.s") and machine.words_of(machine.plain("m0r0n")) == ["moron"]
    assert machine.words_of("f****y") == ["f*y"] and machine.plain("वित्त") == "वित्त"


def test_windows_hold_every_word():
    text = " ".join(f"w{i}" for i in range(100)).translate(str.maketrans("0123456789", "abcdefghij"))
    windows = machine.windows_of(text)
    assert {w for words in windows for w in words} == {*text.split()} and all(len(w) <= machine.WINDOW for w in windows) and machine.windows_of(None) == machine.windows_of("") == []


def test_windows_hold_sentences_of_vowel_signs_and_joined_words():
    for text in ("तू कमीना है", "तुम साले", "তুমি বোকা", "don't"):
        assert machine.windows_of(text) == [text.split()], text
    assert machine.windows_of("12 3,400. -- 7 %") == []
    scorer = machine.Scorer(machine.Machine(1.0, np.zeros(machine.BUCKETS, np.float32), np.zeros((machine.BUCKETS, machine.RANK), np.float32)))
    assert scorer.scores(["तू कमीना है"]).tolist() == [1.0]


def test_scorer_equals_the_formula():
    chance = np.random.default_rng(1)
    m = machine.Machine(-0.3, chance.normal(size=machine.BUCKETS).astype(np.float32), (0.1 * chance.normal(size=(machine.BUCKETS, machine.RANK))).astype(np.float32))
    words = ["alpha", "beta", "of"]
    terms = [t for w in words for t in machine.word_terms(w)] + [machine._bucket("alpha beta"), machine._bucket("beta of")]
    pairs = sum(float(m.vectors[a] @ m.vectors[b]) for i, a in enumerate(terms) for b in terms[i + 1 :])
    assert abs(machine.Scorer(m).scores(["alpha beta of"])[0] - (m.bias + m.weights[terms].sum() + pairs)) < 1e-3
    assert machine.Scorer(m).scores(["", None]).tolist() == [-np.inf, -np.inf]


def test_held_out_accuracy(spark):
    texts, labels = corpus(700, 1, noise=0.03)
    docs = spark.createDataFrame([(i, t, "Forum " if i % 2 else "news", "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, found string")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(0, int(labels[0])), (1, 0), (1, 1), (None, 1), (9999, 1), (2, None)], "doc_id long, toxic int")
    fitted = abuse.fit_abuse(docs, marks)
    fresh, truth = corpus(300, 2)
    other = spark.createDataFrame([(i, t, None) for i, t in enumerate(fresh)] + [(1000, None, "a"), (1001, "", "A "), (None, "x", None), (0, fresh[0], None)], "doc_id long, text string, source string")
    scored = abuse.score_abuse(other, fitted)
    got = {r["doc_id"]: (r["score"], r["found"]) for r in scored.collect()}
    hits = np.array([got[i][1] for i in range(300)])
    assert len(got) == 303 and (hits & (truth == 1)).sum() / truth.sum() > 0.95 and (hits & (truth == 0)).sum() <= 3
    assert got[1000] == got[1001] == (0.0, False)
    rates = {r["source"]: r for r in abuse.abuse_rates(other, scored).collect()}
    assert rates["a"]["n_docs"] == 2 and rates["a"]["rate"] == 0 and rates[None]["n_docs"] == 301 and rates[None]["n_found"] == hits.sum()


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "you moron")], "doc_id long, text string")
    for marks in ([], [(1, 1)], [(1, 0)]):
        m = abuse.fit_abuse(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
        assert not any(r["found"] for r in abuse.score_abuse(docs, m).collect())
    assert abuse.score_abuse(docs.limit(0), m).count() == 0


# ---- all queries


def test_queries(spark, data):
    from claimloom.llm import queries
    from test_system import compare

    for name, run in queries.QUERIES.items():
        if name in queries.SQL:
            compare(spark, data, run, queries.SQL[name])
        else:
            assert run(spark, data).count() >= 0
