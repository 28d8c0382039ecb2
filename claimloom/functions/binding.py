"""Naming an intermediate column so that it is computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def squeeze(text: Column) -> Column:
    """Runs of white space (of any script) as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one or where the group took no part."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
