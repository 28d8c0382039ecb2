"""A factorization machine over hashed terms of short windows of text, in numpy.

``score = w0 + sum w_i + 1/2 (|sum v_i|^2 - sum |v_i|^2)`` over the terms of a
window: single terms add up, and pairs of terms (an insult and the mention of
a group, say) interact through their vectors.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Hash buckets of terms and length of a term's vector.
BUCKETS, RANK = 1 << 18, 8
#: Words of a window and how far the next one starts; every word of a text is in some window.
WINDOW, STEP = 14, 7
#: Terms a worker remembers; beyond that it starts afresh. It bounds memory, not results.
MEMORY = 300_000

# Letters of other alphabets, digits and signs that stand in for Latin letters.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһӏкмтвнгпԛԝαοενικρτυχκ", "aeopcyxijsdhlkmtbhrnqwaoevikptuxk")
LEET = str.maketrans("013457@$!|", "oieastasil")

_LATIN = re.compile(r"[a-z]")
_HIDDEN = re.compile("[\u0000-\u0008\u000e-\u001f\u007f-\u0084\u0086-\u009f\u00ad\u034f\u061c\u115f\u1160\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\u0300-\u036f]")
# A letter, or a vowel sign of an Indic script.
_L = r"(?:[^\W\d_]|[\u0900-\u0963\u0970-\u0dff])"
_LETTER = re.compile(_L)
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][\s._\-*/]{1,2}){2,}[^\W\d_](?![^\W_])")
_WORD = re.compile(rf"{_L}+(?:['’*@$!|0-9]+{_L}+)*[*]*|\d[\d.,]*|[^\w\s]")
_BREAK = re.compile(r"[.!?।。…:;|•]+(?=\s|$)|[\r\n]+|।|。")


def plain(text: str) -> str:
    """Text without disguises: compatibility forms, accents, hidden characters and look-alike letters undone, spaced-out words closed up."""
    if text.isascii():
        return _close_up(text.casefold())
    text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
    text = unicodedata.normalize("NFC", text).casefold()
    words = []
    for word in re.split(r"(\s+)", text):
        if not word.isascii():
            close = word.translate(LOOKALIKES)
            if _LATIN.search(close) and sum("a" <= c <= "z" for c in close) > sum("a" <= c <= "z" for c in word) and close.isascii() or _LATIN.search(word):
                word = close
        words.append(word)
    return _close_up("".join(words))


def _close_up(text: str) -> str:
    return _SPACED.sub(lambda m: re.sub(r"[\s._\-*/]", "", m[0]), text)


@lru_cache(MEMORY)
def _plain_word(word: str) -> str:
    """A word without stand-in signs, stretched letters and masked middles; a number is just that."""
    if word[0].isdigit():
        return "0"
    if "*" in word:
        return f"{word[0]}*{word[-1] if word[-1] != '*' else ''}"
    if len(word) > 1 and not word.isalpha():
        return word.translate(LEET)
    return re.sub(r"(.)\1{2,}", r"\1\1", word) if len(word) > 3 else word


def words_of(part: str) -> list[str]:
    return [_plain_word(w) for w in _WORD.findall(part)]


def windows_of(text: str | None) -> list[list[str]]:
    """Windows of at most ``WINDOW`` words of the sentences of a text; together they hold every word.

    Only sentences of nothing but numbers and signs are left out.
    """
    out = []
    for part in _BREAK.split(plain(text or "")):
        words = words_of(part)
        if any(_LETTER.match(w) or "*" in w for w in words):
            last = max(0, len(words) - WINDOW)
            out += [words[i : i + WINDOW] for i in [*range(0, last, STEP), last]]
    return out


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def word_terms(word: str) -> list[int]:
    """Buckets of a word: itself and its letter groups, so that a misspelling shares most of them."""
    terms = [_bucket(word)]
    if len(word) > 3:
        padded = f"<{word}>"
        terms += [_bucket(f"#{padded[i : i + 4]}") for i in range(len(padded) - 3)]
    return terms


def window_terms(words: list[str]) -> list[int]:
    terms = {t for w in words for t in word_terms(w)}
    terms.update(_bucket(f"{a} {b}") for a, b in zip(words, words[1:]))
    return sorted(terms)


@dataclass
class Machine:
    """Trained weights; ``threshold`` is the least score of a case."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    threshold: float = 0.0

    def raw(self, terms: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of windows whose terms lie one after another and end at ``ends``."""
        starts = np.r_[0, ends[:-1]]
        v = self.vectors[terms]
        total = np.add.reduceat(v, starts)
        return self.bias + np.add.reduceat(self.weights[terms], starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((v**2).sum(1), starts))


def train(windows: list[list[int]], target: np.ndarray, weight: np.ndarray, epochs: int = 8, rate: float = 0.08, decay: float = 2e-4, seed: int = 11) -> Machine:
    """Weighted logistic loss by AdaGrad over mini-batches."""
    chance = np.random.default_rng(seed)
    w, v = np.zeros(BUCKETS, np.float32), chance.normal(0, 0.02, (BUCKETS, RANK)).astype(np.float32)
    gw, gv, bias, gb = np.full(BUCKETS, 1e-4, np.float32), np.full((BUCKETS, RANK), 1e-4, np.float32), -2.0, 1e-2
    lengths = np.array([len(x) for x in windows])
    flat = np.concatenate([np.asarray(x, np.int64) for x in windows])
    first = np.r_[0, np.cumsum(lengths)[:-1]]
    for _ in range(epochs):
        order = chance.permutation(len(windows))
        for start in range(0, len(order), 256):
            rows = order[start : start + 256]
            n = lengths[rows]
            starts = np.r_[0, np.cumsum(n)[:-1]]
            at = np.repeat(first[rows] - starts, n) + np.arange(n.sum())
            terms = flat[at]
            x = v[terms]
            total = np.add.reduceat(x, starts)
            score = bias + np.add.reduceat(w[terms], starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((x**2).sum(1), starts))
            error = (weight[rows] * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target[rows])).astype(np.float32)
            each = np.repeat(error, n)
            unique, where = np.unique(terms, return_inverse=True)
            dw = np.bincount(where, each, len(unique)).astype(np.float32) + decay * w[unique]
            push = each[:, None] * (np.repeat(total, n, 0) - x)
            dv = np.stack([np.bincount(where, push[:, f], len(unique)) for f in range(RANK)], 1).astype(np.float32) + decay * v[unique]
            gw[unique] += dw**2
            gv[unique] += dv**2
            w[unique] -= rate * dw / np.sqrt(gw[unique])
            v[unique] -= rate * 0.5 * dv / np.sqrt(gv[unique])
            db = float(error.sum())
            gb += db**2
            bias -= rate * db / gb**0.5
    return Machine(bias, w, v)


class Scorer:
    """Scores texts with a trained machine, remembering the sums of words and word pairs it has met."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.rows: dict[str, int] = {}
        self.sums = np.zeros((1024, RANK + 2), np.float32)

    def _row(self, key: str, terms: list[int]) -> int:
        row = len(self.rows)
        if row >= len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        v = self.machine.vectors[terms]
        self.sums[row] = [self.machine.weights[terms].sum(), (v**2).sum(), *v.sum(0)]
        self.rows[key] = row
        return row

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The highest window score of each text; minus infinity for a text without words."""
        return self.scores_of([windows_of(t) for t in texts])

    def scores_of(self, texts: list[list[list[str]]]) -> np.ndarray:
        """``scores`` of texts that are cut into windows already."""
        if len(self.rows) > MEMORY:
            self.rows.clear()
        rows, ends, owner = [], [], []
        known = self.rows
        for i, windows in enumerate(texts):
            for words in windows:
                keys = set(words)
                for w in keys:
                    row = known.get(w)
                    rows.append(self._row(w, word_terms(w)) if row is None else row)
                for pair in {f"{a} {b}" for a, b in zip(words, words[1:])}:
                    row = known.get(pair)
                    rows.append(self._row(pair, [_bucket(pair)]) if row is None else row)
                ends.append(len(rows))
                owner.append(i)
        out = np.full(len(texts), -np.inf)  # one score a text
        if owner:
            s = np.add.reduceat(self.sums[rows], np.array([0, *ends[:-1]]))
            score = self.machine.bias + s[:, 0] + 0.5 * ((s[:, 2:] ** 2).sum(1) - s[:, 1])
            np.maximum.at(out, owner, score)
        return out


def learn(texts: list[str | None], labels: np.ndarray, rounds: int = 3, folds: int = 3, seed: int = 11) -> Machine:
    """A machine from whole texts of which only some window earns the label, and of which a few are labelled wrongly.

    At first a case's telling window is the one with the words that cases
    have more often than other texts; after each training it is the one that
    scores highest (and any other that scores as a case).  All windows of the
    other texts are counterexamples.  Machines trained on the other folds
    score each fold; a text whose label they contradict is left out after
    that, so that no machine learns a wrong label by heart.  The threshold is
    the best one on a held-out fold, if that holds at least ten cases.
    Without cases, or without other texts, nothing scores as a case.
    """
    labels = np.asarray(labels)
    cut = [windows_of(t) for t in texts]
    if labels.sum() < 1 or labels.sum() == len(labels):
        return _blank()
    fold = np.array([zlib.crc32(f"{seed} {i}".encode()) % folds for i in range(len(labels))])
    trusted, threshold = np.ones(len(labels), bool), 0.0
    if labels.sum() >= 10 * folds:
        for f in range(folds):
            inside = fold == f
            score = Scorer(_learn(cut, labels, ~inside, 2, seed)).scores_of([c for c, i in zip(cut, inside) if i])
            trusted[inside] = np.where(labels[inside] == 1, score > 0, score < 2)
        inside = fold == 0
        score = Scorer(_learn(cut, labels, ~inside & trusted, 2, seed)).scores_of([c for c, i in zip(cut, inside) if i])
        truth, options = labels[inside], np.round(np.linspace(-2, 4, 61), 1)
        gain = [2 * truth[score >= t].sum() / max(1, (score >= t).sum() + truth.sum()) for t in options]
        best = np.flatnonzero(np.isclose(gain, max(gain)))
        threshold = float(options[best[len(best) // 2]])
    machine = _learn(cut, labels, trusted, rounds, seed)
    machine.threshold = threshold
    return machine


def _blank() -> Machine:
    return Machine(-1.0, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, RANK), np.float32))


def _learn(cut: list[list[list[str]]], labels: np.ndarray, use: np.ndarray, rounds: int, seed: int) -> Machine:
    cases, others = np.flatnonzero(use & (labels == 1)), np.flatnonzero(use & (labels == 0))
    seen = {True: Counter(), False: Counter()}
    for i in np.flatnonzero(use):
        seen[bool(labels[i])].update({w for words in cut[i] for w in words} | {f"{a} {b}" for words in cut[i] for a, b in zip(words, words[1:])})
    rate_in, rate_out = 1 / (len(cases) + 2), 1 / (len(others) + 2)

    def telling(words: list[str]) -> float:
        keys = {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}
        odds = sorted((np.log((seen[True][k] + 0.1) * rate_in / ((seen[False][k] + 0.1) * rate_out)) for k in keys if seen[True][k] > 1 or seen[False][k] > 0), reverse=True)
        return float(sum(odds[:6]))

    plain_windows = {" ".join(w): w for i in others for w in cut[i]}
    negative = [window_terms(w) for w in plain_windows.values()]
    machine = None
    for _ in range(rounds):
        chosen: dict[str, list[str]] = {}
        for i in cases:
            if not cut[i]:
                continue
            if machine is None:
                scores = np.array([telling(w) for w in cut[i]])
                picks = {int(scores.argmax())}
            else:
                terms = [window_terms(w) for w in cut[i]]
                scores = machine.raw(np.concatenate([np.asarray(t) for t in terms]), np.cumsum([len(t) for t in terms]))
                picks = {int(scores.argmax()), *np.flatnonzero(scores > 0).tolist()}
            for j in picks:
                key = " ".join(cut[i][j])
                if key not in plain_windows:
                    chosen[key] = cut[i][j]
        positive = [window_terms(w) for w in chosen.values()]
        if not positive or not negative:
            return _blank()
        target = np.r_[np.ones(len(positive)), np.zeros(len(negative))].astype(np.float32)
        balance = min(10.0, max(1.0, len(negative) / len(positive) / 4))
        machine = train(positive + negative, target, np.where(target > 0, balance, 1.0).astype(np.float32), seed=seed)
    return machine
