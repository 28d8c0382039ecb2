"""Mapping free wording to a canonical list: an automaton over names and aliases, then token-set similarity."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import edit_distance, fold, is_abbreviation
from claimloom.session import spread

#: Entries of the canonical list that one matcher holds; a longer list is matched block by block.
MOST_LABELS = 20_000
#: Values that meet a block in one task.
VALUES = 50_000

# Function words that a wording may leave out.
FUNCTION_WORDS = frozenset("a an and at by for from in of on or per the to with".split())

# Words of notes, bases and headings that say nothing about which measure is meant.
REMARKS = frozenset(
    "adjusted annualised audited basis consolidated during for gross-of in incl including line item net-of note notes of period provisional refer ref restated revised schedule see segment standalone the total unaudited which year".split()
)

# Short forms that neither the spelling nor the initials give away.
SHORT_FORMS = {
    "a/c": "account",
    "capex": "capital expenditure",
    "cpi": "consumer price",
    "forex": "foreign exchange",
    "fx": "foreign exchange",
    "ghg": "greenhouse gas",
    "mcap": "market capitalisation",
    "n": "and",
    "opex": "operating expenditure",
    "wpi": "wholesale price",
}

_TOKEN = re.compile(r"[^\W_]+(?:/[^\W_]+)*")
_ROMAN = re.compile(r"(?:[ivx]+|[a-h])$")


def tokens_of(text: str) -> list[str]:
    """Folded singular words; dotted initials are one word, digits are kept, everything else separates."""
    flat = fold(text).replace("&", " and ").replace("'", "")
    flat = re.sub(r"\b(?:[^\W\d_]\.){2,}", lambda m: m[0].replace(".", "") + " ", flat)
    return [_plain(w) for w in _TOKEN.findall(flat)]


def _plain(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def _letters(word: str) -> int:
    """The set of letters as bits: two words that differ in more than 2 d of them are more than d edits apart."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) % 61)
    return bits


def _shortened(word: str) -> list[str]:
    """The longer function words that ``word`` abbreviates; leaving them out altogether costs nothing either."""
    return [w for w in sorted(FUNCTION_WORDS) if word not in FUNCTION_WORDS and len(word) > 1 and len(w) > 3 and is_abbreviation(word, w)]


def _is_slipped_abbreviation(short: str, word: str) -> bool:
    """Whether ``short`` abbreviates ``word`` once a letter after the first is left out, or two neighbours are swapped."""
    return any(is_abbreviation(short[:i] + short[i + 1 :], word) or i + 1 < len(short) and is_abbreviation(short[:i] + short[i + 1] + short[i] + short[i + 2 :], word) for i in range(1, len(short)))


def _assign(words: list[list[tuple[float, list[str]]]], need: frozenset[str]) -> float | None:
    """The least cost at which the words' readings cover all of ``need``; None if they cannot."""
    best: dict[frozenset[str], float] = {need: 0.0}
    # What the words after each can still cover: sets that hold anything else are lost, all others are kept.
    later: list[set[str]] = [set()]
    for options in reversed(words[1:]):
        later.append(later[-1].union(*(run for _, run in options)))
    for options, coverable in zip(words, reversed(later)):
        after: dict[frozenset[str], float] = {}
        for open_, cost in best.items():
            for c, run in options:
                left = open_.difference(run)
                if not left <= coverable:
                    continue
                # A reading that adds nothing is a repetition, and costs what a misreading costs.
                total = cost + c + (0.0 if len(left) < len(open_) or c == 0 else 0.2)
                if total < after.get(left, 9e9):
                    after[left] = total
        best = after
    return best.get(frozenset())


#: The cost of a wording that fits no entry.
NEVER = 9.0


class Matcher:
    """Decides which entry of a canonical list a wording names, if any."""

    def __init__(self, labels: list[tuple[int, str]], aliases: list[tuple[int, str]] = (), short_forms: dict[str, str] = SHORT_FORMS):
        import ahocorasick

        self.labels: list[tuple[int, list[str]]] = []
        self.by_word: dict[str, list[int]] = {}
        self.short = {_plain(k): [_plain(w) for w in v.split()] for k, v in short_forms.items()}
        self.initials: dict[str, list[list[str]]] = {k: [v] for k, v in self.short.items()}
        seen: dict[str, int] = {}
        alone: dict[str, set[int]] = {}
        for key, label in sorted(labels, key=lambda x: (x[0], x[1])):
            words = tokens_of(label)
            if not words:
                continue
            number = len(self.labels)
            self.labels.append((key, words))
            for form in self._forms(words):
                # Two entries worded alike cannot be told apart: the smaller id stands for both.
                seen.setdefault(form, key)
            content = [w for w in words if w not in FUNCTION_WORDS]
            for run in (words, content):
                if len(run) > 2:
                    alone.setdefault("".join(w[0] for w in run), set()).add(key)
            for w in set(words):
                self.by_word.setdefault(w, []).append(number)
            for run in (words, content):
                for i in range(len(run)):
                    for j in range(i + 3, len(run) + 1):
                        if run[i] in FUNCTION_WORDS or run[j - 1] in FUNCTION_WORDS:
                            continue
                        short = "".join(w[0] for w in run[i:j])
                        if run[i : j] not in self.initials.setdefault(short, []):
                            self.initials[short].append(run[i:j])
        for key, alias in aliases:
            if words := tokens_of(alias):
                seen.setdefault(" ".join(words), key)
        for short, keys in alone.items():
            if len(keys) == 1 and short not in self.by_word:
                seen.setdefault(short, min(keys))
        self.vocabulary = sorted(self.by_word)
        self.sizes = np.array([len(w) for w in self.vocabulary], np.int64)
        self.masks = np.array([_letters(w) for w in self.vocabulary], np.uint64)
        self.automaton = ahocorasick.Automaton()
        for form, key in seen.items():
            self.automaton.add_word(f" {form} ", (len(form), key))
        if seen:
            self.automaton.make_automaton()
        self.exact = bool(seen)
        self.known: dict[str, list[tuple[float, list[str]]]] = {}
        self.near: dict[str, list[tuple[float, list[str]]]] = {}

    @staticmethod
    def _forms(words: list[str]) -> list[str]:
        """The label, and its halves turned round at a function word."""
        forms = [" ".join(words)]
        for i, w in enumerate(words):
            if w in FUNCTION_WORDS and 0 < i < len(words) - 1:
                head, tail = words[:i], words[i + 1 :]
                forms += [" ".join(tail + head + [w]), " ".join(tail + head), " ".join(head + tail)]
        return forms

    def embedded(self, words: list[str]) -> tuple[set[int], list[str]]:
        """Entries mentioned by longest non-overlapping matches, and the words outside of them."""
        if not self.exact:
            return set(), words
        text = f" {' '.join(words)} "
        hits = sorted(((end - size, size, key) for end, (size, key) in self.automaton.iter(text)), key=lambda h: (-h[1], h[0], h[2]))
        taken: list[tuple[int, int]] = []
        keys = set()
        for start, size, key in hits:
            if all(start + size <= a or b <= start for a, b in taken):
                taken.append((start, start + size))
                keys.add(key)
        rest, at = [], 1
        for w in words:
            if not any(a <= at < b for a, b in taken):
                rest.append(w)
            at += len(w) + 1
        return keys, rest

    def _alike(self, bits: int, size: int, most: np.ndarray) -> list[tuple[str, int]]:
        """Vocabulary words and their limits that letters and length allow to be within ``most`` edits."""
        mask = np.uint64(bits)
        fits = (most > 0) & (np.abs(self.sizes - size) <= most) & (np.bitwise_count(self.masks ^ mask) <= 2 * most)
        return [(self.vocabulary[i], int(most[i])) for i in np.flatnonzero(fits)]

    def _holding(self, bits: int, size: int, but: int = 0) -> list[str]:
        """Vocabulary words at least two letters longer (less ``but``) that hold all these letters but ``but`` of them."""
        return [self.vocabulary[i] for i in np.flatnonzero((self.sizes >= size + 2 - but) & (np.bitwise_count(np.uint64(bits) & ~self.masks) <= but))]

    def readings(self, word: str) -> list[tuple[float, list[str]]]:
        """Label words that ``word`` may stand for, each with a cost: 0 as written, more for typos and short forms."""
        if word in self.known:
            return self.known[word]
        best: dict[tuple[str, ...], float] = {}

        def offer(cost: float, words: list[str]) -> None:
            if all(w in self.by_word or w in FUNCTION_WORDS for w in words):
                best[tuple(words)] = min(cost, best.get(tuple(words), 9))

        if word in self.by_word:
            offer(0.0, [word])
        for run in self.initials.get(word, []):
            offer(0.1, run)
        bare = word.replace("/", "")
        size, bits = len(bare), _letters(bare)
        if size > 2:
            n = self.sizes
            for w, limit in self._alike(bits, size, np.where(n < 3, 0, np.where(n < 4, 1, np.where(n < 9, 2, 3)))):
                if w != word and (d := edit_distance(bare, w, limit)) <= limit:
                    offer(0.1 + d / len(w), [w])
        if size >= 2:
            for w in self._holding(bits, size):
                if w != word and is_abbreviation(bare, w):
                    offer(0.2 if w.startswith(bare) else 0.3, [w])
            for w in _shortened(bare):
                offer(0.0, [w])
        if word not in self.by_word:
            for short, full in self.short.items():
                allowed = 0 if len(short) < 3 else 1 if len(short) < 6 else 2
                if allowed and size > 2 and short != word and edit_distance(bare, short, allowed) <= allowed:
                    offer(0.4, full)
            if size > 3:
                for w in self._holding(bits, size, 1):
                    if _is_slipped_abbreviation(bare, w):
                        offer(0.4, [w])
        if not best and size > 3:
            # A swap of neighbours with another slip between them.
            for i in range(size - 1):
                swapped = bare[:i] + bare[i + 1] + bare[i] + bare[i + 2 :]
                for w, _ in self._alike(bits, size, np.where(self.sizes > 3, 1, 0)):
                    if edit_distance(swapped, w, 1) <= 1:
                        offer(0.1 + 2 / len(w), [w])
        if size > 5 and min(best.values(), default=9) > (0.2 if size > 8 else 0.35):
            # Two words written as one.
            for i in range(2, size - 1):
                for ca, a in self._near(word[:i]):
                    for cb, b in self._near(word[i:]) + self._near(word[i:] + "s"):
                        offer(0.1 + ca + cb, a + b)
        ranked = sorted(((c, list(w)) for w, c in best.items()), key=lambda x: (x[0], x[1]))
        if len(self.known) < 200_000:
            self.known[word] = ranked
        return ranked

    def _near(self, part: str) -> list[tuple[float, list[str]]]:
        """Readings of a part of a word."""
        if part in self.near:
            return self.near[part]
        out: list[tuple[float, list[str]]] = []
        whole = _plain(part)
        if whole in self.by_word or whole in FUNCTION_WORDS:
            out = [(0.0, [whole])]
        elif whole in self.short:
            out = [(0.1, self.short[whole])]
        elif short := _shortened(part):
            out = [(0.05, [w]) for w in short]
        elif len(part) > 2:
            size, bits = len(part), _letters(part)
            edits = {}
            if size > 3:
                edits = {w: d for w, limit in self._alike(bits, size, np.where(self.sizes < 4, 0, 2)) if (d := edit_distance(part, w, limit)) <= limit}
            out = [(0.1 + d / len(w), [w]) for w, d in edits.items()]
            out += [(0.3, [w]) for w in self._holding(bits, size) if w not in edits and is_abbreviation(part, w)]
        if len(self.near) < 200_000:
            self.near[part] = out
        return out

    def _is_remark(self, word: str) -> bool:
        if word in REMARKS or word in FUNCTION_WORDS or word.isdigit() or _ROMAN.fullmatch(word):
            return True
        return len(word) > 6 and any(len(r) > 6 and edit_distance(word, r, 2) <= 2 for r in REMARKS)

    def similar(self, words: list[str], most_cost: float = 0.42) -> tuple[int, float]:
        """The entry whose words are the same set as ``words`` up to spelling and remarks, and its cost; -1 without one, or when two fit alike."""
        options = {w: self.readings(w) for w in dict.fromkeys(words)}
        votes: set[int] = set()
        for w in options:
            for _, run in options[w]:
                for r in run:
                    if r not in FUNCTION_WORDS:
                        votes.update(self.by_word.get(r, ()))
        found: list[tuple[float, int]] = []
        for number in votes:
            key, label = self.labels[number]
            inside = set(label)
            need = {w for w in label if w not in FUNCTION_WORDS}
            # Each word takes a reading within this label; a word without one must be a remark.
            mine = [[(c, run) for c, run in options[w] if all(r in inside or r in FUNCTION_WORDS for r in run)] for w in words]
            if all(m or self._is_remark(w) for w, m in zip(words, mine)):
                cost = _assign([[*m, (0.0, [])] if self._is_remark(w) else m for w, m in zip(words, mine) if m], frozenset(need))
                if cost is not None:
                    extra = sum(not m for m in mine)
                    found.append((cost / len(need) + 0.001 * extra, key))
        found.sort()
        if not found or found[0][0] > most_cost:
            return -1, NEVER
        if len(found) > 1 and found[1][0] - found[0][0] < 1e-9 and found[1][1] != found[0][1]:
            return -1, found[0][0]
        return found[0][1], found[0][0]

    def decide(self, text: str | None) -> tuple[int, float]:
        """The id of the entry that ``text`` names, -1 if it names none, and how dear that is.

        What the automaton decides costs less than nothing, and the less the
        more letters are matched; what similarity decides costs its misreadings;
        a tie has no entry, but a cost; where nothing fits, it is ``NEVER``.
        """
        words = tokens_of(text) if text else []
        if not words:
            return -1, NEVER
        keys, rest = self.embedded(words)
        if len(keys) == 1 and all(self._is_remark(w) for w in rest):
            return keys.pop(), float(sum(map(len, rest)) - sum(map(len, words)))
        key, cost = self.similar(words)
        if key == -1:
            # Words torn in two: join neighbours of which one means nothing.
            for i in range(len(words) - 1):
                if not self.readings(words[i]) or not self.readings(words[i + 1]):
                    joined, dear = self.similar([*words[:i], words[i] + words[i + 1], *words[i + 2 :]])
                    if joined != -1:
                        return joined, dear
        return key, cost

    def resolve(self, text: str | None) -> int:
        """The id of the entry that ``text`` names, -1 if it names none."""
        return self.decide(text)[0]


def map_values(values: DataFrame, column: str, canonical: DataFrame, key: str, label: str, aliases: DataFrame | None = None, short_forms: dict[str, str] = SHORT_FORMS) -> DataFrame:
    """``(column, key, how)`` for each distinct non-empty value: the entry it names, or -1; ``how`` is ``automaton``, ``similar`` or ``none``.

    ``canonical`` is the reference list, ``aliases`` (same columns) other names
    of its entries, ``short_forms`` words that stand for others.  Entries with
    a null id or label are ignored; of entries worded alike the smaller id
    counts.  Null and empty values are left out; values of blanks or signs
    alone, and values of any length that fit no entry, give -1; with an empty
    list every value gives -1.

    First an automaton over all names, their turned-round forms, initials and
    aliases finds embedded mentions, the longest non-overlapping ones; if they
    name one entry and nothing but notes, numbering or basis remarks is left
    over, that is it.  Else the words are compared as sets: each may be
    misspelt, shortened, run together or torn, every content word of the entry
    must be there, and every other word must be a remark.

    A matcher holds ``MOST_LABELS`` entries.  A longer list is cut into blocks
    of about as many; every value meets every block, and the cheapest decision
    wins: the automaton's longest, else the most similar; two entries equally
    cheap give -1.
    """
    of = lambda df: df.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label")).where("key is not null and label is not null")
    listed = of(canonical).distinct()
    if aliases is not None:
        listed = listed.select("key", "label", F.lit(False).alias("alias")).unionByName(of(aliases).distinct().select("key", "label", F.lit(True).alias("alias")).join(listed.select("key"), "key", "left_semi"))
    else:
        listed = listed.select("key", "label", F.lit(False).alias("alias"))
    distinct = values.select(F.col(column).alias("value")).where("value is not null and value != ''").distinct()

    def decided(matcher: Matcher, said: pd.Series) -> pd.DataFrame:
        both = [matcher.decide(v) for v in said]
        return pd.DataFrame({"value": said, "key": [k for k, _ in both], "cost": [c for _, c in both]})

    def matcher_of(rows: list[tuple[int, str, bool]]) -> Matcher:
        return Matcher([(k, t) for k, t, a in rows if not a], [(k, t) for k, t, a in rows if a], short_forms)

    found = "value string, key long, cost double"
    count = listed.count()
    if count <= MOST_LABELS:
        shared = values.sparkSession.sparkContext.broadcast([tuple(r) for r in listed.collect()])  # at most MOST_LABELS rows

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = matcher_of(shared.value)
            for batch in batches:
                yield decided(matcher, batch["value"])

        best = spread(distinct).mapInPandas(run, found)
    else:
        blocks = -(-count // MOST_LABELS)
        parts = max(1, -(-distinct.count() // VALUES))
        # An entry and its aliases share a block.
        held = listed.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "key", "label", "alias")
        asked = distinct.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int").alias("part"), "value")

        def meet(some: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
            return decided(matcher_of(list(zip(entries["key"], entries["label"], entries["alias"]))), some["value"])

        met = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInPandas(meet, found)
        least = met.groupBy("value").agg(F.min("cost").alias("least"))
        cheap = met.join(least, "value").where(F.col("cost") <= F.col("least") + 1e-9).groupBy("value").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.min("cost").alias("cost"))
        best = cheap.select("value", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1).alias("key"), "cost")
    how = F.when(F.col("key") == -1, "none").when(F.col("cost") < 0, "automaton").otherwise("similar")
    return best.select(F.col("value").alias(column), F.col("key").alias(key), how.alias("how"))


def claim_measures(claim: DataFrame, measure: DataFrame) -> DataFrame:
    """``(claim_id, measure_id)`` of each claim whose ``measure_raw`` is neither null nor empty nor exactly a listed label.

    Repeated claims count once; claims without an id are ignored.  Each
    distinct wording is resolved once; the claims are joined to the result by
    their wording.
    """
    listed = measure.where("label_state = 'listed'").select("measure_id", "canonical_label")
    worded = claim.select("claim_id", "measure_raw").where("claim_id is not null and measure_raw is not null and measure_raw != ''")
    mapped = map_values(worded, "measure_raw", listed, "measure_id", "canonical_label")
    mapped = mapped.join(listed.select(F.col("canonical_label").alias("measure_raw")).distinct(), "measure_raw", "left_anti")
    return worded.join(mapped, "measure_raw").groupBy("claim_id").agg(F.max("measure_id").alias("measure_id"))
