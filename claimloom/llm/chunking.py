"""Splitting oversized texts by content-defined chunking that respects natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters at which a text may be cut.
NATURAL = " \t\r\n。"

#: How good the place after such a character is, best first.
PARAGRAPH, SENTENCE, WORD = 3, 2, 1

_WINDOW = 32
_LANDMARK_BITS = 10


def _boundaries(codes: np.ndarray) -> np.ndarray:
    """For each position 0..n the quality of a cut there, 0 where none is natural.

    A cut is natural just after a boundary character or just before one.
    """
    n = len(codes)
    natural = np.isin(codes, np.fromiter(map(ord, NATURAL), np.uint32))
    quality = np.zeros(n + 1, np.int8)
    quality[:-1][natural] = WORD
    quality[1:][natural] = WORD
    ends = np.isin(codes, np.fromiter(map(ord, ".!?।。"), np.uint32))
    stop = codes == ord("。")
    quality[1:][stop] = SENTENCE
    if n > 1:
        quality[2:][ends[:-1] & natural[1:]] = SENTENCE
        line = codes == ord("\n")
        quality[1:][line] = np.maximum(quality[1:][line], SENTENCE)
        quality[2:][line[:-1] & line[1:]] = PARAGRAPH
    return quality


def _landmarks(codes: np.ndarray) -> np.ndarray:
    """Positions after which a rolling hash of the last characters has its low bits clear; content alone decides."""
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(32)
        rolling = np.zeros(len(codes), np.uint64)
        for back in range(min(_WINDOW, len(codes))):
            rolling[back:] += mixed[: len(codes) - back] << np.uint64(back)
    at = np.flatnonzero((rolling >> np.uint64(20)) & np.uint64((1 << _LANDMARK_BITS) - 1) == 0) + 1
    return at[at >= _WINDOW]


def split_text(text: str, most: int = 8000, overlap: int = 200) -> list[tuple[int, int, int, str]]:
    """The pieces of ``text`` as ``(start, fresh, end, kind)``.

    A piece is ``text[start:end]``; ``text[fresh:end]`` is what no earlier
    piece has, so ``start`` lies up to ``overlap`` characters before
    ``fresh``.  ``kind`` says how the piece ends: ``natural``, ``forced`` (no
    natural boundary within ``most`` characters) or ``end``.
    """
    n = len(text)
    if n <= most:
        return [(0, 0, n, "end")]
    overlap = min(overlap, max(0, most // 2 - 1))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    quality = _boundaries(codes)
    natural = np.flatnonzero(quality)
    landmarks = _landmarks(codes)
    least, reach = most // 2, max(1, most // 40)
    pieces, fresh = [], 0
    while True:
        start = max(0, fresh - overlap) if fresh else 0
        if fresh:
            # Begin the overlap at a boundary where there is one, so no word is cut in two.
            inside = natural[np.searchsorted(natural, start) : np.searchsorted(natural, fresh)]
            start = int(inside[0]) if len(inside) else start
        if n - start <= most:
            pieces.append((start, fresh, n, "end"))
            return pieces
        limit = start + most
        low = min(fresh + least, limit)
        marks = landmarks[np.searchsorted(landmarks, low) : np.searchsorted(landmarks, limit, "right")]
        mark = int(marks[0]) if len(marks) else limit
        near = natural[np.searchsorted(natural, max(fresh + 1, low, mark - reach)) : np.searchsorted(natural, min(limit, mark + reach), "right")]
        kind = "natural"
        if len(near):
            best = near[quality[near] == quality[near].max()]
            end = int(best[np.abs(best - mark).argmin()])
        else:
            allowed = natural[np.searchsorted(natural, fresh + 1) : np.searchsorted(natural, limit, "right")]
            if len(allowed):
                late = allowed[allowed >= low]
                end = int(late[np.abs(late - mark).argmin()]) if len(late) else int(allowed[-1])
            else:
                # A shorter overlap leaves room to reach a boundary further on.
                beyond = natural[np.searchsorted(natural, limit + 1) : np.searchsorted(natural, fresh + most, "right")]
                if len(beyond):
                    end = int(beyond[0])
                    start = max(start, end - most)
                elif n - fresh <= most:
                    pieces.append((n - most, fresh, n, "end"))
                    return pieces
                else:
                    end, kind = (mark if mark > fresh else limit), "forced"
        pieces.append((start, fresh, end, kind))
        fresh = end


PIECE = T.StructType(
    [
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("char_start", T.IntegerType()),
        T.StructField("char_end", T.IntegerType()),
        T.StructField("overlap", T.IntegerType()),
        T.StructField("cut_kind", T.StringType()),
        T.StructField("piece", T.StringType()),
    ]
)


def split_oversized(items: DataFrame, key: str, text: str = "text", most: int = 8000, overlap: int = 200) -> DataFrame:
    """The pieces of every text of more than ``most`` characters (Unicode code points).

    Columns: ``key``, ``piece_no`` from 0, ``char_start`` and ``char_end`` in
    the text, ``overlap`` with the piece before, ``cut_kind`` of the piece's
    end (``natural``, ``forced``, or ``end`` of the text) and ``piece``.  Every
    piece has at most ``most`` characters; without their overlaps the pieces
    join to the text again.  A cut is forced only where more than ``most``
    characters in a row hold none of space, tab, CR, LF and ``。``.

    Cuts are content-defined: a rolling hash picks landmarks, each snaps to
    the best boundary nearby (blank line, sentence, word), between half of and
    the full size, so an edit moves only the cuts near it.  Null, empty and
    short texts give no rows; rows that repeat a key count once (the first
    text in order); null keys are one key like any other; texts are always
    read whole.  Short texts are dropped before anything reaches Python.
    """
    long = items.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > most).groupBy("key").agg(F.min("text").alias("text"))
    schema = T.StructType([T.StructField("key", long.schema["key"].dataType), *PIECE.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, whole in zip(batch["key"].tolist(), batch["text"].tolist()):
                parts = split_text(whole, most, overlap)
                yield pd.DataFrame(
                    {
                        "key": pd.Series([None if name is None or name != name else name] * len(parts), dtype=batch["key"].dtype if name == name and name is not None else object),
                        "piece_no": range(len(parts)),
                        "char_start": [p[0] for p in parts],
                        "char_end": [p[2] for p in parts],
                        "overlap": [p[1] - p[0] for p in parts],
                        "cut_kind": [p[3] for p in parts],
                        "piece": [whole[p[0] : p[2]] for p in parts],
                    }
                )

    return long.mapInPandas(run, schema).withColumnRenamed("key", key)
