"""Plain string helpers shared by Python-side operators (no Spark types here)."""

from __future__ import annotations

import unicodedata


def fold(text: str) -> str:
    """Case-folded text with compatibility forms unified and Latin accents dropped.

    Only combining marks of the general block are dropped, so vowel signs of
    other scripts stay.
    """
    flat = unicodedata.normalize("NFKD", text)
    flat = "".join(c for c in flat if not "̀" <= c <= "ͯ")
    return unicodedata.normalize("NFC", flat).casefold()


def edit_distance(a: str, b: str, limit: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from ``a`` to ``b``; ``limit + 1`` once that is exceeded."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > limit:
        return limit + 1
    while la and lb and a[la - 1] == b[lb - 1]:
        la, lb = la - 1, lb - 1
    start = 0
    while start < la and start < lb and a[start] == b[start]:
        start += 1
    a, b = a[start:la], b[start:lb]
    la, lb = len(a), len(b)
    if not la or not lb:
        return min(la + lb, limit + 1)
    far = limit + 1
    before: list[int] = []
    row = [j if j <= limit else far for j in range(lb + 1)]
    for i in range(1, la + 1):
        low, high = max(1, i - limit), min(lb, i + limit)
        now = [far] * (lb + 1)
        if i <= limit:
            now[0] = i
        ca = a[i - 1]
        best = now[0]
        for j in range(low, high + 1):
            cb = b[j - 1]
            if ca == cb:
                d = row[j - 1]
            else:
                d = row[j - 1]
                if row[j] < d:
                    d = row[j]
                if now[j - 1] < d:
                    d = now[j - 1]
                d += 1
                if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb and before[j - 2] + 1 < d:
                    d = before[j - 2] + 1
            now[j] = d if d < far else far
            if d < best:
                best = d
        if best > limit:
            return far
        before, row = row, now
    return min(row[lb], far)


def is_abbreviation(short: str, word: str) -> bool:
    """Whether ``short`` starts like ``word`` and its letters occur in ``word`` in order."""
    if not short or len(short) >= len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)
