"""Linking the variant spellings of names typed by people.

A name is a set of words, in whatever order.  Rare words identify; words of
business, given names and initials describe.  Near words are found by a
prefix-filtered join on their q-grams and verified by what stands beside them
in names, weighted by rarity; names of the same words are then sorted out by
what describes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom import session
from claimloom.functions.text import edit_distance
from claimloom.llm.names import OFFICES, read_name

#: Length of the q-grams of a word, and least weighted similarity of two variants.
Q, LEAST = 4, 0.70
#: Sizes of words whose q-grams the allowed edits may all spoil (``(Q + 1) * edits >= size + Q - 1``), and of their partners.
SWAPPED = (1, 2, 7, 10, 11, 12)
#: A known word is this many times as common as a slip of it; share of a misspelling's company that the right spelling has too.
COMMONER, SHARED = 10, 0.5


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """``session.keep``, but joins never broadcast what it gives: these tables grow with the names, and their files, by which Spark would judge, hold a small part of the bytes that the driver would gather."""
    return session.keep(df, name).hint("merge")


def allowed_edits(size: int) -> int:
    """Edits that two spellings of the longer one's ``size`` letters may be apart."""
    return 1 if size < 7 else 2 if size < 11 else 3


_HELD = "array<struct<word:string,tag:string,plain:boolean,sort:string>>"


def _held(read) -> list[tuple[str, str, bool, str]]:
    """The words of a name with the company they keep: ``whole`` as they stand, ``torn`` for what neighbours or all of them make together, ``head`` for what a word may be without a known one at its end."""
    trade = {*read.trade, *(s[6:] for s in read.slips if s.startswith("trade:"))}
    given = " ".join(read.given) or next((s[6:] for s in read.slips if s.startswith("given:")), "")
    firm = bool(trade) or read.legal
    person = not firm and bool(given or read.initials)
    left = [w for w, s in zip(read.words, read.slips) if not s or s.startswith("join:")]

    def row(part: list[str], sort: str, word: str = "", more: str = "") -> tuple[str, str, bool, str]:
        rest = " ".join(sorted(w for w in left if w not in part))
        says = " ".join(sorted({*trade, more} - {""}))
        return word or "".join(part), "|".join(["person" if person and not more else "other", says, given, rest]), not (says or given or rest), sort

    out = [row([w], "whole") for w in read.words]
    out += [row(left[i : i + 2], "torn") for i in range(len(left) - 1)] + ([row(left, "torn")] if len(left) > 2 else [])
    for w, s in zip(read.words, read.slips):
        if s.startswith("join:"):
            _, head, tail = s.split(":")
            out.append(row([w], "head", head, tail))
    return out


def read_names(names: DataFrame, column: str) -> DataFrame:
    """``name, words, slips, trade, given, initials, legal, held`` of each distinct value that names anyone (``names.Name``, ``_held``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["name"]:
                read = read_name(name)
                if read:
                    held = [dict(zip(("word", "tag", "plain", "sort"), h)) for h in _held(read)]
                    rows.append((name, [*read.words], [*read.slips], [*read.trade], [*read.given], read.initials, read.legal, held))
            yield pd.DataFrame(rows, columns=["name", "words", "slips", "trade", "given", "initials", "legal", "held"])

    distinct = names.select(F.col(column).alias("name")).where("name is not null and name != ''").distinct()
    return distinct.mapInPandas(run, f"name string, words array<string>, slips array<string>, trade array<string>, given array<string>, initials string, legal boolean, held {_HELD}")


#: Bits of the letters that ``letters`` holds in order: one for a letter, another for its repetition; an edit changes at most two of them.
_BITS = "aggregate(transform(letters, (x, i) -> shiftleft(1L, pmod(ascii(x), 32) + if(i > 0 and letters[greatest(i - 1, 0)] = x, 32, 0))), 0L, (m, b) -> m | b)"


def near_stems(stems: DataFrame) -> DataFrame:
    """Pairs ``(a, b, edits)``, a < b, of all stems within the allowed edits, by a prefix-filtered join on q-grams.

    A plain edit spoils at most ``Q`` of a stem's q-grams, a swap of
    neighbours ``Q + 1``.  So of each stem only the rarest ``(Q + 1) * edits +
    1`` are joined, for the most edits that any partner allows, with all
    grams as rare as the last: two stems that share none of these are further
    apart.  Grams must stand at about the same place and lengths must be
    close, which the join itself checks.  Stems of ``SWAPPED`` letters may be
    so short for their edits that swaps, with one plain edit at most, spoil
    every gram; these are joined on their sorted letters too, all and with
    one left out.
    """
    padded = F.concat(F.lit("\u0002" * (Q - 1)), "stem", F.lit("\u0003" * (Q - 1)))
    at = F.explode(F.sequence(F.lit(1), F.length("stem") + (Q - 1))).alias("at")
    letters = F.array_sort(F.filter(F.split("stem", ""), lambda c: c != ""))
    known = stems.select("stem", F.length("stem").alias("size"), letters.alias("letters")).withColumn("bits", F.expr(_BITS))
    grams = known.select("stem", "size", "bits", padded.alias("padded"), at).select("stem", "size", "bits", "at", F.substring(F.col("padded"), F.col("at"), F.lit(Q)).alias("gram"))
    common = grams.groupBy("gram").agg(F.count("*").alias("many"))
    # The most edits to a partner: those of 5 and 6 letters may have one of 7, those of 8 to 10 one of 11.
    first = F.when(F.col("size") < 5, Q + 2).when(F.col("size") < 8, 2 * (Q + 1) + 1).otherwise(3 * (Q + 1) + 1)
    ranked = grams.join(common, "gram").withColumn("nth", F.rank().over(W.partitionBy("stem").orderBy("many", "gram")))
    prefix = ranked.where((F.col("nth") <= first) & (F.col("many") > 1)).select("stem", "size", "bits", "at", "gram")
    short = known.where(F.col("size").isin(*SWAPPED))
    without = lambda i: F.concat(F.slice("letters", 1, i - 1), F.slice("letters", i + 1, F.col("size")))
    bags = F.array_distinct(F.concat(F.array("letters"), F.transform(F.sequence(F.lit(1), F.col("size")), without)))
    # Kept apart from the grams by a mark; the place plays no part.
    bagged = short.select("stem", "size", "bits", F.lit(0).alias("at"), F.explode(F.transform(bags, lambda x: F.concat(F.lit("\u0001"), F.array_join(x, "")))).alias("gram"))
    keys = prefix.unionByName(bagged).hint("merge")
    a, b = (keys.select("gram", *[F.col(c).alias(f"{c}_{side}") for c in ("stem", "size", "bits", "at")]) for side in "ab")
    larger = F.greatest("size_a", "size_b")
    by_size = lambda f: F.when(larger < 7, f(1)).when(larger < 11, f(2)).otherwise(f(3))  # noqa: E731  as allowed_edits
    most = by_size(F.lit)
    met = a.join(b, "gram").where(
        (F.col("stem_a") < F.col("stem_b"))
        & (F.abs(F.col("size_a") - F.col("size_b")) <= most)
        & (F.abs(F.col("at_a") - F.col("at_b")) <= most)
        & (F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= 2 * most)
        # A swap is two edits to levenshtein.
        & (by_size(lambda n: F.levenshtein("stem_a", "stem_b", 2 * n)) >= 0)
    )
    pairs = met.select(F.col("stem_a").alias("a"), F.col("stem_b").alias("b")).distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            most = [allowed_edits(max(len(x), len(y))) for x, y in zip(batch["a"], batch["b"])]
            edits = [edit_distance(x, y, m) for x, y, m in zip(batch["a"], batch["b"], most)]
            batch["edits"] = edits
            yield batch[[e <= m for e, m in zip(edits, most)]]

    return pairs.mapInPandas(verify, "a string, b string, edits int")


def word_roots(read: DataFrame) -> DataFrame:
    """``(word, root, support, torn)``: each word's best spelling, and the names that hold it whole and torn.

    Two near words are variants if the names that hold them are alike enough:
    the word weighs by its rarity, and so does its company, that is the line
    of business or office, the given name and the other rare words beside it.
    Company counts in full if the right spelling keeps at least ``SHARED`` of
    the misspelling's, and half where either stands alone.  A word follows its
    best variant among those that more names have (or, at equal support, that
    come first), and so on to a word that follows none.  A word that no name
    holds whole has no support and only follows.
    """
    held = read.select(F.explode("held").alias("h")).select("h.*")
    words = keep(held.groupBy("word").agg(F.count_if(F.col("sort") == "whole").alias("support"), F.count_if(F.col("sort") == "torn").alias("torn"), F.max("plain").alias("plain")), "words")
    near = keep(near_stems(words.select(F.col("word").alias("stem"))), "near")
    whole = read.agg(F.count("*").alias("n"))  # one row
    tag_support = held.where("sort = 'whole'").groupBy("tag").agg(F.count("*").alias("uses"))
    tagged = keep(held.select("word", "tag", "plain").distinct().join(tag_support, "tag", "left").select("word", "tag", "plain", F.coalesce("uses", F.lit(1)).alias("uses")), "tagged")
    company = tagged.groupBy("word").agg(F.count_if(~F.col("plain")).alias("tags"), F.max("uses").alias("uses"))
    facts = keep(words.join(company, "word"), "facts")
    side = lambda s: facts.select(F.col("word").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("support", "plain", "tags", "uses")])
    both = near.join(side("a"), "a").join(side("b"), "b").where("support_a + support_b > 0")
    first_leads = (F.col("support_a") > F.col("support_b")) | ((F.col("support_a") == F.col("support_b")) & (F.col("a") < F.col("b")))
    pick = lambda c: F.when(first_leads, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    led = keep(both.select("*", F.when(first_leads, F.col("b")).otherwise(F.col("a")).alias("word"), F.when(first_leads, F.col("a")).otherwise(F.col("b")).alias("root"), F.when(first_leads, F.col("tags_b")).otherwise(F.col("tags_a")).alias("tags"), pick("support").alias("lead_support")), "led")
    own = tagged.where("not plain").select("word", "tag")
    shared = led.select("word", "root").join(own, "word").join(own.select(F.col("word").alias("root"), "tag"), ["root", "tag"]).groupBy("word", "root").agg(F.count("*").alias("shared"))
    pairs = led.join(shared, ["word", "root"], "left").crossJoin(F.broadcast(whole))
    share = F.coalesce(F.col("shared") / F.col("tags"), F.lit(0.0))
    match = F.when(share >= SHARED, 1.0).otherwise(F.greatest(share, F.when(F.col("plain_a") | F.col("plain_b"), 0.5).otherwise(0.0)))
    word_weight = F.log1p(F.col("n") / (F.col("support_a") + F.col("support_b")))
    tag_weight = F.log1p(F.col("n") / F.greatest("uses_a", "uses_b"))
    alike = 1 - F.col("edits") / F.greatest(F.length("a"), F.length("b"))
    scored = pairs.withColumn("score", (word_weight * alike + tag_weight * match) / (word_weight + tag_weight)).where(F.col("score") >= LEAST)
    lead = scored.select("word", F.struct(F.round("score", 9).alias("score"), F.col("lead_support").alias("support"), "root").alias("lead"))
    follows = keep(lead.groupBy("word").agg(F.max("lead")["root"].alias("root")), "follows")
    # Doubling: after n rounds a word has gone 2 ** n steps towards its root; support never falls on the way, so there are no rings.
    while True:
        on = follows.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        further = keep(follows.join(on, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "follows")
        follows = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return words.join(follows, "word", "left").select("word", F.coalesce("root", "word").alias("root"), "support", "torn")


def _without_slips(read: DataFrame, roots: DataFrame) -> DataFrame:
    """The names with those words taken for the known ones that they are slips of.

    A slip needs a witness: a known word that is ``COMMONER`` times as common
    as it, or another name that has the known word beside the same rare word;
    a given name, and a known word at the end of another, need the latter.
    """
    plain = read.select("name", "words", "slips", "trade", "given", "legal")
    joined = F.col("slip").startswith("join:")
    slipped = plain.where(F.exists("slips", lambda s: s != "")).select("name", "words", "slips", F.posexplode("slips").alias("at", "slip")).where("slip != ''")
    others = F.filter("words", lambda w, i: F.col("slips")[i] == "")
    beside = F.when(joined, F.array(F.split("slip", ":")[1])).otherwise(others)
    slipped = slipped.select("name", "at", joined.alias("joined"), F.when(joined, F.concat(F.lit("trade:"), F.split("slip", ":")[2])).otherwise(F.col("slip")).alias("slip"), F.col("words")[F.col("at")].alias("word"), beside.alias("beside"))
    says = F.concat(F.transform("trade", lambda t: F.concat(F.lit("trade:"), t)), F.transform("given", lambda g: F.concat(F.lit("given:"), g)), F.when(F.col("legal"), F.array(F.lit("legal:"))).otherwise(F.array()))
    known = plain.select("words", "slips", F.explode(says).alias("slip"))
    common = known.groupBy("slip").agg(F.count("*").alias("many"))
    rooted = roots.select("word", "root", "support")
    seen = known.select("slip", F.explode(others).alias("word")).join(rooted, "word").select("slip", "root").distinct().hint("merge")
    by_company = slipped.select("name", "at", "slip", F.explode("beside").alias("word")).join(rooted, "word").join(seen, ["slip", "root"]).select("name", "at").distinct().withColumn("seen", F.lit(True)).hint("merge")
    judged = slipped.join(common, "slip", "left").join(rooted.select("word", "support"), "word").join(by_company, ["name", "at"], "left")
    often = ~F.col("slip").startswith("given:") & ~F.col("joined") & (F.coalesce("many", F.lit(0)) >= COMMONER * F.col("support"))
    sure = keep(judged.where(F.coalesce("seen", F.lit(False)) | often).groupBy("name").agg(F.collect_list("at").alias("ats")), "sure")  # a few of one name
    fixed = read.join(sure, "name", "left").withColumn("ats", F.coalesce("ats", F.array().cast("array<int>")))
    got = lambda *kinds: F.transform(F.filter(F.transform("ats", lambda i: F.col("slips")[i]), lambda s: F.split(s, ":")[0].isin(*kinds)), lambda s: F.substring_index(s, ":", -1))
    trade = F.array_sort(F.array_union("trade", got("trade", "join")))
    legal = F.col("legal") | (F.size(got("legal")) > 0)
    given = F.when((F.size("given") == 0) & (F.size("trade") == 0) & ~F.col("legal"), F.slice(got("given"), 1, 1)).otherwise(F.col("given"))
    head = F.transform("words", lambda w, i: F.when(~F.array_contains("ats", i), w).when(F.col("slips")[i].startswith("join:"), F.split(F.col("slips")[i], ":")[1]))
    return fixed.select("name", F.filter(head, lambda w: w.isNotNull()).alias("words"), trade.alias("trade"), given.alias("given"), "initials", legal.alias("legal"))


def _cores(fixed: DataFrame, roots: DataFrame) -> DataFrame:
    """The names with ``core``: the roots of their words, sorted.

    Neighbours that make a word which is at least as common as either is
    elsewhere are that word, torn.
    """
    many = fixed.where(F.size("words") > 1).select("name", "words")
    spans = F.concat(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.struct(i.alias("at"), F.lit(2).alias("n"))), F.array(F.struct(F.lit(1).alias("at"), F.size("words").alias("n"))))
    torn = many.select("name", "words", F.explode(F.array_distinct(spans)).alias("s")).select("name", "words", "s", F.array_join(F.slice("words", F.col("s.at"), F.col("s.n")), "").alias("word"))
    support = roots.select(F.col("word").alias("root"), F.col("support").alias("root_support"))
    whole = torn.join(roots.select("word", "root", "torn"), "word").join(support, "root")
    part = whole.select("name", "s", "root", "root_support", "torn", F.explode(F.slice("words", F.col("s.at"), F.col("s.n"))).alias("word")).join(roots.select("word", "support"), "word")
    mended = part.groupBy("name", "s", "root", "root_support", "torn").agg(F.max("support").alias("most")).where("root_support > 0 and root_support >= most - torn").groupBy("name").agg(F.min(F.struct("s", "root")).alias("m"))
    joined = fixed.join(mended, "name", "left")
    at, n = F.col("m.s.at"), F.col("m.s.n")
    words = F.when(F.col("m").isNull(), F.col("words")).otherwise(F.filter(F.transform("words", lambda w, i: F.when(i == at - 1, F.col("m.root")).when((i < at - 1) | (i >= at - 1 + n), w)), lambda w: w.isNotNull()))
    each = keep(joined.withColumn("words", words).drop("m"), "mended")
    core = each.select("name", F.explode("words").alias("word")).join(roots.select("word", "root"), "word").groupBy("name").agg(F.array_sort(F.collect_set("root")).alias("core"))
    return each.drop("words").join(core, "name")


def sort_out(classes: list[tuple[str, str]]) -> list[str]:
    """For each ``(kind, trade)`` of one core, the entity it belongs to.

    Different lines of business or offices are different entities.  One that
    leaves them out belongs to the only entity it can mean; where there are
    several, it stays by itself.
    """
    trades = {t for k, t in classes if k == "firm" and t}
    bodies = {t for k, t in classes if k == "body"}
    full = {t for t in bodies if not any(set(t.split()) < set(o.split()) for o in bodies)}
    out = []
    for kind, trade in classes:
        if kind == "body":
            over = [t for t in full if set(trade.split()) < set(t.split())]
            out.append(f"b:{over[0] if len(over) == 1 else trade}")
        elif trade:
            out.append(f"f:{trade}")
        else:
            out.append(f"f:{next(iter(trades))}" if len(trades) == 1 else "f:")
    return out


def _firms(classes: DataFrame) -> DataFrame:
    """``(core, kind, trade, entity)`` of firms, offices and names that say neither."""
    # Of one core these are combinations of fixed words.
    gathered = classes.select("core", "kind", "trade").distinct().groupBy("core").agg(F.collect_set(F.struct("kind", "trade")).alias("classes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for core, found in zip(batch["core"], batch["classes"]):
                listed = sorted((c["kind"], c["trade"]) for c in found)
                rows += [(core, *c, f"{core} {e}") for c, e in zip(listed, sort_out(listed))]
            yield pd.DataFrame(rows, columns=["core", "kind", "trade", "entity"])

    return gathered.mapInPandas(run, "core string, kind string, trade string, entity string")


def _persons(classes: DataFrame, firms: DataFrame) -> DataFrame:
    """``(core, given, initials, entity)`` of persons.

    A short name stands for the only given name of the core that it can mean.
    Names with different middle initials are different persons; one without
    belongs to the only one there is.  Initials alone belong to the only
    person of the core, or of a core of two words one of which they begin,
    whom they fit; where they fit several, they stay by themselves.
    """
    people = classes.select("core", "size", "given", "initials").distinct()
    full = people.where("size(given) = 1").select("core", F.col("given")[0].alias("g")).distinct()
    unsure = people.where("size(given) > 1")
    meant = unsure.select("core", "given", F.explode("given").alias("g")).distinct().join(full, ["core", "g"]).groupBy("core", "given").agg(F.max("g").alias("only"), F.count("*").alias("n"))
    named = people.join(meant.where("n = 1").select("core", "given", "only"), ["core", "given"], "left")
    # Initials of a name without a given one begin with its own, unless the core holds it.
    bare = (F.size("given") == 0) & (F.col("size") == 1)
    g = F.when(F.size("given") == 0, "").when(F.size("given") == 1, F.col("given")[0]).otherwise(F.coalesce("only", F.array_join("given", " ")))
    read = keep(named.select("core", "given", "initials", "size", bare.alias("bare"), g.alias("g"), F.when(bare, F.substring("initials", 2, 1)).otherwise(F.substring("initials", 1, 1)).alias("m")), "people")
    stated = read.where("not bare")
    mids = lambda rows, *key: rows.groupBy(*key).agg(F.count_distinct(F.nullif("m", F.lit(""))).alias("mids"), F.max("m").alias("mid"))
    middle = lambda: F.when(F.col("mids") < 2, F.lit("")).when(F.col("m") == "", "?").otherwise(F.col("m"))
    by = stated.join(mids(stated, "core", "g"), ["core", "g"])
    # Two rare words are a given name and a surname, or a firm: without a firm's or a given name's mark they are one group.
    plain = firms.where("kind = '' and trade = ''").select("core", F.col("entity").alias("as_firm"))
    known = keep(by.join(plain, "core", "left").select("core", "given", "initials", "g", "m", "mid", F.when((F.col("g") == "") & (F.col("mids") < 2), F.coalesce("as_firm", F.concat("core", F.lit(" f:")))).otherwise(F.concat_ws(" ", "core", F.concat(F.lit("p:"), "g"), middle())).alias("entity")), "known")
    ways = known.where("g != ''").select("core", F.left("g", F.lit(1)).alias("f"), F.coalesce(F.nullif("m", F.lit("")), "mid").alias("m"), "entity")
    pairs = classes.where("size = 2 and trade = '' and size(given) = 0 and not legal").select(F.split("core", " ").alias("two"), "core").distinct().join(known.where("g = ''").select("core", F.col("mid").alias("m"), "entity").distinct().unionByName(plain.select("core", F.lit("").alias("m"), F.col("as_firm").alias("entity"))), "core")
    turn = lambda i, j: F.struct(F.col("two")[i].alias("core"), F.left(F.col("two")[j], F.lit(1)).alias("f"), "m", "entity")
    turned = pairs.select(F.explode(F.array(turn(0, 1), turn(1, 0))).alias("t")).select("t.*")
    short = read.where("bare").withColumn("f", F.left("initials", F.lit(1)))
    fits = short.join(ways.unionByName(turned).withColumnRenamed("m", "theirs").distinct(), ["core", "f"]).where("m = '' or theirs = '' or m = theirs").groupBy("core", "initials").agg(F.max("entity").alias("only"), F.count_distinct("entity").alias("n"))
    lone = short.join(mids(short, "core", "f"), ["core", "f"]).join(keep(fits.where("n = 1").select("core", "initials", "only"), "fits"), ["core", "initials"], "left")
    alone = lone.select("core", "given", "initials", F.coalesce("only", F.concat_ws(" ", "core", F.concat(F.lit("p:"), "f", F.lit("?")), middle())).alias("entity"))
    return known.select("core", "given", "initials", "entity").unionByName(alone)


def _kind(trade: Column, given: Column, initials: Column, legal: Column) -> Column:
    return F.when(F.arrays_overlap(trade, F.array(*[F.lit(o) for o in sorted(OFFICES)])), "body").when((F.size(trade) > 0) | legal, "firm").when((F.size(given) > 0) | (initials != ""), "person").otherwise("")


def name_entities(names: DataFrame, column: str) -> DataFrame:
    """``(name, entity)`` for each distinct value that names anyone; names of one entity get one string.

    What several later steps read is kept, so that no plan holds more than a
    few joins: the driver's memory grows with the plans, not with the names.
    """
    read = keep(read_names(names, column), "names")
    roots = keep(word_roots(read), "roots")
    fixed = keep(_without_slips(read, roots), "fixed")
    cored = keep(_cores(fixed, roots), "cores")
    parts = cored.select("name", F.array_join("core", " ").alias("core"), F.size("core").alias("size"), F.array_join("trade", " ").alias("trade"), "given", "initials", "legal", _kind(F.col("trade"), F.col("given"), F.col("initials"), F.col("legal")).alias("kind"))
    classes = keep(parts.drop("name").distinct(), "classes")
    # A name without a mark of either is looked up among firms; so is a person's core, for those that say no more than it.
    firms = keep(_firms(classes.where("kind != 'person'")), "firms")
    persons = _persons(classes.where("kind in ('person', '')").where("kind = 'person' or size = 2"), firms)
    of_firms = parts.where("kind != 'person'").join(firms, ["core", "kind", "trade"]).select("name", "entity")
    of_persons = parts.where("kind = 'person'").join(persons, ["core", "given", "initials"]).select("name", "entity")
    return of_firms.unionByName(of_persons)


def variant_pairs(names: DataFrame, column: str) -> DataFrame:
    """``(name_a, name_b)``: each pair of different values that name the same entity, the smaller in byte order first.

    Null and empty values, self-references and values of nothing but legal
    forms, titles and signs name none; repeated values count once; extra
    columns play no part; an empty table gives no pairs.  The order of words
    does not matter.  Names that share their identifying words but state
    another line of business, office, given name or middle initial are not
    linked.  The number of pairs is what the result asks for: it grows with
    the square of the spellings of one entity, while the search itself
    compares words only.
    """
    entity = keep(name_entities(names, column), "entities")
    a, b = entity.select("entity", F.col("name").alias("name_a")), entity.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
