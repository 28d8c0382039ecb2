"""Plug points for what a cluster cannot do by itself: parsing files, asking a model.

A provider is a plain object; Spark runs it in Python workers, an error in one
row becomes that row's ``error`` and stops nothing else.  The defaults are
deterministic and need no network.
"""

from __future__ import annotations

import json
import random
import re
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How much of a document's first and last pages describes it.
HEAD_PAGES, HEAD_CHARS, TAIL_PAGES, TAIL_CHARS = 6, 3000, 2, 1200


class Parser(Protocol):
    """Bytes of a file to pages: dicts of ``page_no, width, height, blocks``, a block being a dict of ``kind, text, x0, y0, x1, y1``."""

    def pages(self, content: bytes, filename: str) -> list[dict]: ...


class Extractor(Protocol):
    """Text of a passage to proposed claims: dicts with ``quote, entity, measure, value, unit, period``."""

    def claims(self, text: str, header: str | None) -> list[dict]: ...


class PlainTextParser:
    """Pages separated by form feeds, blocks by blank lines; blocks stand below each other."""

    def pages(self, content: bytes, filename: str) -> list[dict]:
        out = []
        for no, page in enumerate(content.decode("utf-8", "replace").split("\f")):
            parts = [p.strip("\n") for p in re.split(r"\n[ \t]*\n", page) if p.strip()]
            blocks = [{"kind": "table" if p.startswith("|") else "prose", "text": p, "x0": 40.0, "y0": 40.0 + 20 * i, "x1": 555.0, "y1": 55.0 + 20 * i} for i, p in enumerate(parts)]
            out.append({"page_no": no, "width": 595.0, "height": 842.0, "blocks": blocks})
        return out


class SentenceExtractor:
    """Claims of the form "MEASURE of ENTITY stood at VALUE UNIT for PERIOD"."""

    pattern = re.compile(r"(?P<measure>[A-Z][^.|\n]{2,80}?) of (?P<entity>[^.|\n]{2,80}?) (?:stood at|was|came to|reached) (?P<value>[-(₹$A-Za-z ]{0,6}[\d][\d,.]*\d?\)?) ?(?P<unit>[^.\n]{0,24}?) (?:for|in) (?P<period>[^.\n]{2,40})\.")

    def claims(self, text: str, header: str | None) -> list[dict]:
        return [{"quote": m[0], **m.groupdict()} for m in self.pattern.finditer(text)]


def parse_files(files: DataFrame, parser: Parser) -> DataFrame:
    """``sha256, page_no, width, height, pos, kind, text, x0, y0, x1, y1, error`` of files ``sha256, filename, content``; a file that fails is one row with its error."""
    names = ["sha256", "page_no", "width", "height", "pos", "kind", "text", "x0", "y0", "x1", "y1", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sha, filename, content in zip(batch["sha256"], batch["filename"], batch["content"]):
                try:
                    for page in parser.pages(content, filename):
                        rows += [(sha, page["page_no"], page["width"], page["height"], i, b["kind"], b["text"], b["x0"], b["y0"], b["x1"], b["y1"], None) for i, b in enumerate(page["blocks"])]
                except Exception as e:  # noqa: BLE001
                    rows.append((sha, *[None] * 10, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=names)

    schema = "sha256 string, page_no int, width double, height double, pos int, kind string, text string, x0 double, y0 double, x1 double, y1 double, error string"
    return files.select("sha256", "filename", "content").mapInPandas(run, schema)


def extract_claims(passages: DataFrame, extractor: Extractor) -> DataFrame:
    """``witness_id, passage_no, quote, entity, measure, value, unit, period, error``: as many rows a passage as claims, one with an error where it fails."""
    fields = ["quote", "entity", "measure", "value", "unit", "period"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for witness, no, text, header in zip(batch["witness_id"], batch["passage_no"], batch["text"], batch["context_header"]):
                try:
                    rows += [(witness, no, *[c.get(f) for f in fields], None) for c in extractor.claims(text or "", header)]
                except Exception as e:  # noqa: BLE001
                    rows.append((witness, no, *[None] * len(fields), f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["witness_id", "passage_no", *fields, "error"])

    schema = "witness_id long, passage_no int, " + ", ".join(f"{f} string" for f in fields) + ", error string"
    return passages.select("witness_id", "passage_no", "text", "context_header").mapInPandas(run, schema)


def front_matter_text(pages: DataFrame) -> DataFrame:
    """``witness_id, head, tail``: the beginnings of a document's first and last pages, for a provider that describes it."""
    head = pages.where(F.col("page_no") < HEAD_PAGES).groupBy("witness_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.left(F.coalesce("text", F.lit("")), F.lit(HEAD_CHARS)).alias("t")))), lambda p: p["t"]), "\n").alias("head"))
    last = pages.groupBy("witness_id").agg(F.max("page_no").alias("last"))
    ends = pages.join(last, "witness_id").where(F.col("page_no") > F.col("last") - TAIL_PAGES)
    tail = ends.groupBy("witness_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.left(F.coalesce("text", F.lit("")), F.lit(TAIL_CHARS)).alias("t")))), lambda p: p["t"]), "\n").alias("tail"))
    return head.join(tail, "witness_id", "full")


class Describer(Protocol):
    """The beginnings of a document's first and last pages to a dict with any of ``title, publisher, vintage_raw, default_currency``."""

    def describe(self, head: str, tail: str) -> dict: ...


class HeadDescriber:
    """Reads what a document says of itself on lines of its own: "Publisher: ...", "Published: ...", a date, amounts "in Rs crore"."""

    # Marks of the currency in which amounts are stated.
    currencies = [("INR", r"₹|\b(?:rs|inr|rupees)\b"), ("USD", r"us\s?\$|\busd\b|\$"), ("EUR", r"€|\beur\b"), ("GBP", r"£|\bgbp\b")]

    def describe(self, head: str, tail: str) -> dict:
        out = {}
        for field, words in (("title", "title"), ("publisher", "publisher|published by|issued by"), ("vintage_raw", "published|published on|date|dated")):
            if said := re.search(rf"(?im)^\s*(?:{words})\s*[:\-]\s*(\S[^\n]{{0,200}}?)\s*$", head + "\n" + tail):
                out[field] = said[1]
        if "vintage_raw" not in out and (date := re.search(r"(?m)^\s*(\d{4}-\d{2}-\d{2})\s*$", head)):
            out["vintage_raw"] = date[1]
        if scope := re.search(r"(?i)\((?:amounts?\s+|figures\s+)?(?:all\s+)?(?:in\s+)?([^)\n]{0,24}(?:crore|lakh|million|billion|thousand|mn|bn|cr)s?)\)", head):
            out["default_currency"] = next((code for code, mark in self.currencies if re.search(mark, scope[1].lower())), None)
        return out


def describe_witnesses(front: DataFrame, describer: Describer) -> DataFrame:
    """``witness_id, title, publisher, vintage_raw, default_currency`` of front matter ``witness_id, head, tail``; a failure leaves them null."""
    fields = ["title", "publisher", "vintage_raw", "default_currency"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for witness, head, tail in zip(batch["witness_id"], batch["head"], batch["tail"]):
                try:
                    said = describer.describe(head or "", tail or "")
                except Exception:  # noqa: BLE001
                    said = {}
                rows.append((witness, *[said.get(f) for f in fields]))
            yield pd.DataFrame(rows, columns=["witness_id", *fields]).astype(dict.fromkeys(fields, object))

    return front.mapInPandas(run, "witness_id long, " + ", ".join(f"{f} string" for f in fields))


class Adviser(Protocol):
    """A second opinion on a verdict: a dict with ``relationship, reason_code, explanation, sufficient_context``."""

    def note(self, verdict: str, explanation: str) -> dict: ...


def note_verdicts(queue: DataFrame, adviser: Adviser) -> DataFrame:
    """``verdict_id, note, agrees`` for verdicts ``verdict_id, verdict, explanation``; a verdict is never changed by its note, and a failure gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, verdict, explanation in zip(batch["verdict_id"], batch["verdict"], batch["explanation"]):
                try:
                    note = adviser.note(verdict, explanation)
                    rows.append((key, json.dumps(note, sort_keys=True), note.get("relationship") == verdict.strip().lower()))
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame(rows, columns=["verdict_id", "note", "agrees"])

    return queue.select("verdict_id", "verdict", "explanation").mapInPandas(run, "verdict_id long, note string, agrees boolean")


class RateLimiter:
    """At most ``per_minute`` calls in any 60 seconds, over all threads of a worker."""

    def __init__(self, per_minute: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.per_minute, self.clock, self.sleep = per_minute, clock, sleep
        self.calls: deque[float] = deque()
        self.lock = threading.Lock()

    def acquire(self) -> None:
        while True:
            with self.lock:
                now = self.clock()
                while self.calls and now - self.calls[0] >= 60:
                    self.calls.popleft()
                if len(self.calls) < self.per_minute:
                    self.calls.append(now)
                    return
                wait = 60 - (now - self.calls[0])
            self.sleep(wait)


class Rotation:
    """Names of models to try in turn; ``retire`` drops one for good, ``step`` moves on to the next."""

    def __init__(self, wanted: list[str], offered: set[str]):
        self.names = [n for n in wanted if n in offered]
        if not self.names:
            raise ValueError("none of the wanted models is offered")
        self.at = 0

    @property
    def current(self) -> str:
        return self.names[self.at]

    def step(self) -> str:
        self.at = (self.at + 1) % len(self.names)
        return self.current

    def retire(self) -> bool:
        """Whether another model is left."""
        if len(self.names) == 1:
            return False
        del self.names[self.at]
        self.at %= len(self.names)
        return True


def call_with_retry(ask: Callable[[], str], attempts: int = 4, sleep: Callable[[float], None] = time.sleep, final: tuple[type[Exception], ...] = (PermissionError,)) -> dict:
    """The JSON object that ``ask`` returns; tries again on failures, waiting as the message says or twice as long each time, 45 s at most."""
    for n in range(attempts):
        try:
            reply = json.loads(ask() or "null")
            if reply:
                return reply
            raise ValueError("empty reply")
        except final:
            raise
        except Exception as e:  # noqa: BLE001
            if n == attempts - 1:
                raise
            said = re.search(r"retry\D{0,12}([\d.]+)\s*s", str(e))
            sleep(min(45.0, float(said[1]) if said else 2.0 * 2**n) + random.random())
    raise AssertionError("unreachable")
