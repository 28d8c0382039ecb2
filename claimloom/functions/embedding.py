"""Phrase vectors: a deterministic stand-in for a sentence encoder, and vector arithmetic in the JVM."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def embed_text(text: str, size: int = 64) -> list[float]:
    """A unit vector of hashed words and letter groups; all zero for a text without any."""
    out = np.zeros(size, np.float32)
    for word in "".join(c if c.isalnum() else " " for c in text.casefold()).split():
        padded = f"<{word}>"
        for gram in [padded, *(padded[i : i + 3] for i in range(len(padded) - 2))]:
            h = zlib.crc32(gram.encode("utf-8", "surrogatepass"))
            out[h % size] += 1.0 if h & 0x10000 else -1.0
    norm = float(np.linalg.norm(out))
    return (out / norm if norm else out).tolist()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(phrases: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Vectors of phrases; null gives null.  Replaceable by any encoder of the same shape."""
    for batch in phrases:
        yield batch.map(lambda p: embed_text(p) if isinstance(p, str) else None)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of the same length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
