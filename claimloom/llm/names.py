"""Reading a typed name: what identifies it, and what it shares with many others."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from claimloom.functions.text import edit_distance, fold

# Legal forms and their short forms.
LEGAL = frozenset("limited ltd private pvt p llp lp plc corporation corp corpn company co incorporated inc gmbh ag sa bv pte".split())

# Titles and forms of address.
TITLES = frozenset("m/s messrs mr mrs ms mx miss dr prof shri sri smt sir kumari".split())

# Words that only join others.
GLUE = frozenset("the of and for in government govt".split())

# What a document calls its own author.
SELF = frozenset("company group bank issuer organisation organization firm we us it they our ourselves itself management registrant entity corporation parent subsidiary undersigned borrower".split())

# Words for a line of business or an office, with their usual short forms.
FIELDS = {
    "agriculture": "agri agric",
    "agro": "",
    "authority": "auth",
    "bank": "bk",
    "board": "bd",
    "brokers": "brok",
    "bureau": "bur",
    "chemicals": "chem chems",
    "commerce": "comm",
    "commission": "commn",
    "construction": "constr",
    "council": "cncl",
    "department": "dept deptt",
    "directorate": "dte",
    "education": "edn educ",
    "electricity": "elec",
    "energy": "enrgy",
    "engineering": "engg eng",
    "enterprises": "ents entp",
    "finance": "fin",
    "foods": "fds",
    "health": "hlth",
    "holdings": "hldgs",
    "industries": "ind inds",
    "infrastructure": "infra infrastr",
    "insurance": "ins",
    "international": "intl int",
    "logistics": "log logist",
    "manufacturing": "mfg",
    "ministry": "min",
    "municipal": "mun",
    "pharmaceuticals": "pharma pharm",
    "port": "pt",
    "power": "pwr",
    "products": "prod prods",
    "railways": "rlys rly",
    "services": "svcs serv",
    "shipping": "shpg",
    "solutions": "soln",
    "statistics": "stats",
    "steel": "",
    "systems": "sys",
    "technologies": "tech technol",
    "telecommunications": "telecom",
    "textiles": "tex",
    "trading": "trdg",
    "transport": "transp",
    "works": "wks",
}

#: Of these, the ones that name an office rather than a business.
OFFICES = frozenset("authority board bureau commission council department directorate ministry municipal".split())

# Given names and the short names people use for them.
GIVEN = {
    "abigail": "abby gail",
    "alexander": "alex sandy xander sasha",
    "anthony": "tony ant",
    "benjamin": "ben benny benji",
    "christopher": "chris kit topher",
    "deborah": "deb debbie debby",
    "edward": "ed eddie ted teddy ned",
    "elizabeth": "beth betty liz lizzie eliza lisa",
    "francesca": "fran chess frankie cesca",
    "gurpreet": "guri gurri",
    "harpreet": "happy harry",
    "james": "jim jimmy jamie",
    "john": "jack johnny",
    "joseph": "joe joey",
    "katherine": "kate kathy katie kat",
    "lakshmi": "lachu laxmi lucky",
    "margaret": "peggy maggie meg madge",
    "mary": "molly polly",
    "michael": "mick mike micky mikey",
    "nicholas": "nick nicky klaus",
    "patricia": "pat patty trish tricia",
    "rajendra": "raj raju rajan",
    "richard": "dick rick rich ricky",
    "robert": "bob bobby rob robbie",
    "samuel": "sam sammy",
    "siddharth": "sid siddhu",
    "susan": "sue suzy susie",
    "theodore": "theo ted teddy",
    "thomas": "tom tommy",
    "venkatesh": "venky venkat",
    "victoria": "vicky tori vic",
    "william": "bill will billy willy liam",
}


def _both(table: dict[str, str]) -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for word, short in table.items():
        for form in (word, *short.split()):
            out.setdefault(form, set()).add(word)
    return {k: frozenset(v) for k, v in out.items()}


_FIELD = {form: min(words) for form, words in _both(FIELDS).items()}
_GIVEN = _both(GIVEN)
_TAILS = sorted((w for w in {*_FIELD, *LEGAL} if len(w) >= 4 or w in ("ltd", "llp", "inc")), key=lambda w: (-len(w), w))
#: From this length on, a word of business is not taken for a name that is an edit away.
LONG = 7


class Name(NamedTuple):
    """``words`` identify, in the order written; ``slips`` has, for each, the known word that it may be a slip of (or a blank).

    A slip may also be a known word that is run together with the word before
    it.  ``trade`` is the line of business or office, ``given`` the given names the
    name may hold, ``initials`` the others in order; ``legal`` tells whether a
    legal form or a form of address for firms stands there.
    """

    words: tuple[str, ...]
    slips: tuple[str, ...]
    trade: tuple[str, ...]
    given: tuple[str, ...]
    initials: str
    legal: bool


_LONG_FORMS = tuple(sorted(w for w in {*_FIELD, *LEGAL, "government"} if len(w) >= LONG))
_SHORT_FORMS = tuple(sorted(w for w in {*_FIELD, *LEGAL} if 3 <= len(w) < LONG))
_GIVEN_FORMS = tuple(sorted(w for w in _GIVEN if len(w) >= 5))


def _nearest(word: str, forms: tuple[str, ...]) -> str:
    """The form that ``word`` is nearest to, a blank without one: two edits from forms of nine letters on, one from others; the first letter of a short one must stand."""
    best = None
    for form in forms:
        limit = 2 if len(form) >= 9 else 1
        if len(word) >= 3 and abs(len(word) - len(form)) <= limit and (len(form) >= LONG or form[0] == word[0]) and (d := edit_distance(word, form, limit)) <= limit:
            rest = iter(form)
            rank = (d, form[0] != word[0], not all(c in rest for c in word), form)
            best = rank if best is None or rank < best else best
    return best[-1] if best else ""


@lru_cache(100_000)
def _role(word: str) -> tuple[str, object]:
    """What a folded word is: legal, title, glue, initial, trade, given or rare; long words of business and law may be a slip away."""
    if len(word) == 1:
        return "initial", word
    if word in LEGAL:
        return "legal", word
    if word in TITLES:
        return "title", word
    if word in GLUE:
        return "glue", word
    if word in _FIELD:
        return "trade", _FIELD[word]
    if word in _GIVEN:
        return "given", tuple(sorted(_GIVEN[word]))
    form = _nearest(word, _LONG_FORMS)
    return _role(form) if form else ("rare", word)


@lru_cache(100_000)
def slip_of(word: str, evident: bool) -> str:
    """``trade:WORD``, ``legal:`` or ``given:WORD`` for a rare word that may be a slip of a known one, ``join:HEAD:WORD`` for one that may end in one, else a blank.

    Short words of business have namesakes an edit away; these count only
    beside ``evident`` signs of a firm or office.
    """
    if not evident and (tail := next((t for t in _TAILS if t in _FIELD and word.endswith(t) and len(word) - len(t) >= 5), "")):
        return f"join:{word[: -len(tail)]}:{_FIELD[tail]}"
    form = _nearest(word, _SHORT_FORMS) if evident else ""
    if form:
        return f"trade:{_FIELD[form]}" if form in _FIELD else "legal:"
    form = _nearest(word, _GIVEN_FORMS)
    return f"given:{min(_GIVEN[form])}" if form else ""


def _split_joined(word: str, evident: bool) -> list[str]:
    """A long word that ends in a known one is the two of them; a short known one needs other signs of a firm or office."""
    if len(word) >= 9 and _role(word)[0] == "rare":
        for tail in _TAILS:
            if word.endswith(tail) and len(word) - len(tail) >= 5 and (evident or len(tail) >= LONG):
                return [*_split_joined(word[: -len(tail)], True), tail]
    return [word]


_CAMEL = re.compile(r"(?<=[^\W\d_A-ZÀ-Þ])(?=[A-ZÀ-Þ][^\W\d_A-ZÀ-Þ])")
_WORD = re.compile(r"m/s|[^\W_]+(?:'[^\W_]+)?")


def read_name(name: str) -> Name | None:
    """The parts of a name; None for a self-reference and where it holds nothing but legal forms, titles and signs.

    Words of business, given names and single letters describe the bearer and
    the rest identify it; where nothing is left to identify it, all of these do.
    """
    text = name
    if re.search(r"\b[a-zà-ÿ][A-ZÀ-Þ]{2,}", text) and not re.search(r"\b[A-ZÀ-Þ][a-zà-ÿ]{2,}", text):
        text = text.swapcase()  # caps lock was on
    text = _CAMEL.sub(" ", text)
    text = re.sub(r"\bl\.?\s?l\.?\s?p\b", "llp", fold(text))
    words = [w.replace("'", "") for w in _WORD.findall(text)]
    if all(w in SELF or w in ("the", "our", "this", "said", "reporting") for w in words):
        return None
    roles = [_role(w)[0] for w in words]
    evident = "legal" in roles or "trade" in roles or "m/s" in words or "messrs" in words
    rare: list[str] = []
    trade: set[str] = set()
    given: list[tuple[str, ...]] = []
    typed: list[str] = []
    initials: list[str] = []
    legal = "m/s" in words or "messrs" in words
    for joined in words:
        for word in _split_joined(joined, evident):
            role, what = _role(word)
            if role == "rare":
                rare.append(word)
            elif role == "trade":
                trade.add(what)
            elif role == "given":
                given.append(what)
                typed.append(min(what))
            elif role == "initial":
                initials.append(word)
            elif role == "legal":
                legal = True
    if {"commerce", "electricity"} <= trade and "ministry" not in trade:
        trade = trade - {"commerce"} | {"commission"}  # the short form is the same
    if given and (trade or legal):
        # A firm may be called after a person.
        rare, given = rare + typed, []
    if not rare and not given and len(initials) > 1:
        rare, initials = ["".join(initials)], []
    if not rare:
        # Nothing but known words: together they identify.
        rare, given = sorted({*typed}), []
        if not rare:
            rare, trade = sorted(trade), set()
    elif len(given) > 1:
        initials = [g[0][0] for g in given[1:]] + initials
    rare = list(dict.fromkeys(rare))
    if not rare:
        return None
    slips = [slip_of(w, evident) for w in rare]
    if all(s and not s.startswith("join:") for s in slips):
        slips = [""] * len(slips)
    return Name(tuple(rare), tuple(slips), tuple(sorted(trade)), given[0] if given else (), "".join(initials), legal)
