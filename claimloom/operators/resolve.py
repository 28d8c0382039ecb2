"""Grouping phrases under the first of their kind, as an order-dependent clustering would, but in parallel.

Taken one by one, a phrase joins the best earlier leader that it matches, or
becomes a leader.  Whether it becomes one depends only on earlier phrases that
it matches, so all phrases whose earlier matches are decided can be decided at
once; a few rounds of joins decide all of them, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.functions.embedding import embed
from claimloom.functions.labels import canonical_form, content_key, slugify, substitutes
from claimloom.operators.anchor import indel_similarity
from claimloom.operators.vectors import near_vectors
from claimloom.session import keep

# Least similarity at which measures merge, are neighbours, and entities merge.
MERGE, NEIGHBOUR, ENTITY = 0.80, 0.68, 0.90
#: Bits of ``letters`` in order: one for a letter, another for its repetition.
LETTER_BITS = "aggregate(transform(letters, (x, i) -> shiftleft(1L, pmod(ascii(x), 32) + if(i > 0 and letters[greatest(i - 1, 0)] = x, 32, 0))), 0L, (m, b) -> m | b)"


def leaders(items: DataFrame, matches: DataFrame) -> DataFrame:
    """``(id, leader)`` of every item.

    ``items`` has a unique ``id`` and a unique ``place`` in the order;
    ``matches`` has ``a``, ``b`` and ``score`` (both directions or one).  An
    item without an earlier matching leader leads itself; others follow the
    earlier leader with the highest score, the earliest at equal scores.
    """
    both = matches.select("a", "b", "score").unionByName(matches.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    place = items.select("id", "place")
    earlier = both.join(place.select(F.col("id").alias("a"), F.col("place").alias("a_place")), "a").join(place.select(F.col("id").alias("b"), F.col("place").alias("b_place")), "b")
    earlier = keep(earlier.where("b_place < a_place").groupBy("a", "b").agg(F.max("score").alias("score"), F.first("b_place").alias("b_place")), "earlier")
    decided = keep(place.join(earlier.select(F.col("a").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(True).alias("leads")), "decided")
    while True:
        open_ = earlier.join(decided.select(F.col("id").alias("a")), "a", "left_anti")
        known = open_.join(decided.select(F.col("id").alias("b"), "leads"), "b", "left")
        # An earlier leader makes a follower at once; a leader needs all earlier matches to be followers.
        state = known.groupBy("a").agg(F.max(F.coalesce("leads", F.lit(False))).alias("led"), F.max(F.col("leads").isNull()).alias("waiting"))
        fresh = keep(state.where("led or not waiting").select(F.col("a").alias("id"), (~F.col("led")).alias("leads")), "decided")
        if fresh.isEmpty():
            break
        decided = keep(decided.unionByName(fresh), "decided")
    led = earlier.join(decided.where("leads").select(F.col("id").alias("b")), "b")
    best = led.groupBy("a").agg(F.min_by("b", F.struct((-F.col("score")).alias("s"), "b_place")).alias("leader"))
    followed = decided.where("not leads").select("id").join(best.withColumnRenamed("a", "id"), "id")
    return decided.where("leads").select("id", F.col("id").alias("leader")).unionByName(followed)


def first_seen(phrases: DataFrame, phrase: str, order: list[str]) -> DataFrame:
    """Each distinct lower-case phrase with its first wording and a unique place in order of appearance."""
    rows = phrases.where(F.trim(F.coalesce(phrase, F.lit(""))) != "").select(F.lower(F.col(phrase)).alias("id"), F.col(phrase).alias("wording"), F.struct(*order).alias("at"))
    first = rows.groupBy("id").agg(F.min("at").alias("at"), F.min_by("wording", F.struct("at", "wording")).alias("wording"))
    return first.select("id", "wording", F.struct("at", "id").alias("place"))


def resolve_measures(phrases: DataFrame, phrase: str, order: list[str], merge: float = MERGE) -> DataFrame:
    """``(phrase, measure)``: each distinct phrase (lower case) and the wording of the measure it belongs to.

    A phrase joins an earlier measure with the same content words, or one
    whose vector is near enough and that does not swap a content word.
    Phrases with the same content words match at the highest score.
    """
    items = keep(first_seen(phrases, phrase, order).withColumn("vec", embed("wording")).withColumn("key", content_key(F.col("wording"))), "phrases")
    near = near_vectors(items, merge)
    keys = items.select("id", "key")
    keyed = near.join(keys.select(F.col("id").alias("a"), F.col("key").alias("ka")), "a").join(keys.select(F.col("id").alias("b"), F.col("key").alias("kb")), "b")
    close = keyed.where(~substitutes(F.col("ka"), F.col("kb"))).select("a", "b", "score")
    # Equal content words: all phrases of a key meet at its first one, so a large group adds one row a phrase.
    first = items.where(F.size("key") > 0).groupBy("key").agg(F.min_by("id", "place").alias("b"))
    same = items.join(first, "key").where("id <> b").select(F.col("id").alias("a"), "b", F.lit(2.0).alias("score"))
    found = leaders(items.select("id", "place"), close.unionByName(same))
    names = items.select(F.col("id").alias("leader"), F.col("wording").alias("measure"))
    return found.join(names, "leader").select(F.col("id").alias("phrase"), "measure")


def near_candidates(texts: DataFrame, floor: float, q: int = 3) -> DataFrame:
    """Pairs ``(ta, tb)``, ta < tb, of distinct ``text``: all whose Indel similarity is at least ``floor`` (below 1), and few others.

    Of two texts that similar, ``x`` letters of one are left out and ``y`` of
    the other put in, with ``(2 - floor) * x + floor * y <= 2 * (1 - floor) *
    length``.  A letter left out spoils at most ``q`` grams and one put in at
    most ``q - 1``, so they share one of the rarest grams of either, one more
    than may be spoilt.  What shares a gram must have nearly the same letters
    and be few edits apart, which the join itself checks: only what is left
    is gathered and compared.
    """
    letters = F.array_sort(F.filter(F.split("text", ""), lambda c: c != ""))
    known = texts.select("text", F.length("text").alias("size"), letters.alias("letters")).withColumn("bits", F.expr(LETTER_BITS))
    padded = F.concat(F.lit("\u0002" * (q - 1)), "text", F.lit("\u0003" * (q - 1)))
    at = F.explode(F.sequence(F.lit(1), F.length("text") + (q - 1)))
    grams = known.select("text", "size", "bits", padded.alias("p"), at.alias("at")).select("text", "size", "bits", F.substring(F.col("p"), F.col("at"), F.lit(q)).alias("g"), "at")
    # Equal grams of one text are told apart by their count, so the sets keep all of them.
    grams = grams.withColumn("gram", F.concat_ws("\u0001", "g", F.row_number().over(W.partitionBy("text", "g").orderBy("at")).cast("string")))
    common = grams.groupBy("gram").agg(F.count("*").alias("many"))
    spoilt = F.floor(F.col("size") * (2 * (1 - floor) * max(q / (2 - floor), (q - 1) / floor)) + 1e-9)
    prefix = grams.join(common, "gram").withColumn("nth", F.row_number().over(W.partitionBy("text").orderBy("many", "gram"))).where((F.col("nth") <= spoilt + 1) & (F.col("many") > 1)).select("text", "size", "bits", "gram")
    a, b = (prefix.select("gram", *[F.col(c).alias(f"{c}_{side}") for c in ("text", "size", "bits")]) for side in "ab")
    apart = ((F.col("size_a") + F.col("size_b")) * (1 - floor) + 1e-9).cast("int")
    met = a.join(b, "gram").where(
        # A letter more or less changes one bit, and is one edit to levenshtein.
        (F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= apart)
        & (F.abs(F.col("size_a") - F.col("size_b")) <= apart)
        & (F.col("text_a") < F.col("text_b"))
        & (F.call_function("levenshtein", F.col("text_a"), F.col("text_b"), apart) >= 0)
    )
    return met.select(F.col("text_a").alias("ta"), F.col("text_b").alias("tb")).distinct()


def near_strings(items: DataFrame, floor: float, q: int = 3) -> DataFrame:
    """Pairs ``(a, b, score)``, a < b, of items ``id, text`` whose Indel similarity is at least ``floor`` (below 1)."""
    texts = items.where(F.length("text") > 0).groupBy("text").agg(F.min("id").alias("first"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["score"] = [indel_similarity(x, y) / 100 for x, y in zip(batch["ta"], batch["tb"])]
            yield batch[batch["score"] >= floor]

    scored = near_candidates(texts.select("text"), floor, q).mapInPandas(verify, "ta string, tb string, score double")
    names = texts.select("text", "first")
    distinct = scored.join(names.select(F.col("text").alias("ta"), F.col("first").alias("fa")), "ta").join(names.select(F.col("text").alias("tb"), F.col("first").alias("fb")), "tb")
    return distinct.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"), "score")


def resolve_entities(phrases: DataFrame, phrase: str, order: list[str], floor: float = ENTITY) -> DataFrame:
    """``(phrase, entity)``: each distinct phrase (lower case) and the wording of the entity it belongs to.

    Names are compared without legal forms, as sorted words; equal ones
    always match, others if their Indel similarity reaches ``floor``.
    """
    named = first_seen(phrases, phrase, order).withColumn("text", F.array_join(F.array_sort(F.split(canonical_form(F.col("wording")), " ")), " "))
    items = keep(named, "names")
    # Names that are equal after sorting have the same matches: only the first of them is compared.
    groups = items.groupBy("text").agg(F.min_by("id", "place").alias("first"))
    heads = items.join(groups.select(F.col("first").alias("id")), "id")
    found = leaders(heads.select("id", "place"), near_strings(heads.select("id", "text"), floor))
    whole = items.join(groups, "text").join(found.select(F.col("id").alias("first"), "leader"), "first")
    names = items.select(F.col("id").alias("leader"), F.col("wording").alias("entity"))
    return whole.join(names, "leader").select(F.col("id").alias("phrase"), "entity")


def neighbours(vectors: DataFrame, key: str, vector: str, floor: float = NEIGHBOUR, below: float = MERGE) -> DataFrame:
    """``(a, b, score)``, a < b, with ``floor <= cosine < below``: near, but not near enough to merge."""
    return near_vectors(vectors.select(F.col(key).alias("id"), F.col(vector).alias("vec")), floor).where(F.col("score") < below)


def unique_slugs(names: DataFrame, name: str, order: list[str]) -> DataFrame:
    """The rows with ``slug``: equal slugs get ``_2``, ``_3``, ... in order."""
    base = slugify(F.col(name))
    nth = F.row_number().over(W.partitionBy("_base").orderBy(*order))
    numbered = names.withColumn("_base", base).withColumn("_nth", nth)
    return numbered.withColumn("slug", F.when(F.col("_nth") == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", F.col("_nth").cast("string")))).drop("_base", "_nth")
