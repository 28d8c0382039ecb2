"""Pairs of vectors whose cosine reaches a floor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import keep

#: Vectors from which centres are fitted, vectors a centre stands for, vectors of one block, most centres, vectors of a block compared at a time.
SAMPLE, PER_CENTRE, BLOCK, MOST_CENTRES, STEP = 20_000, 16_000, 16_000, 4_096, 1_000


def _centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    chance = np.random.default_rng(23)
    centres = sample[chance.choice(len(sample), min(count, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, total / np.maximum(size, 1e-9), centres)
    return centres


def near_vectors(items: DataFrame, floor: float) -> DataFrame:
    """Pairs ``(a, b, score)``, a < b, of items ``id, vec`` with a cosine of at least ``floor``.

    Null, empty and all-zero vectors, those with a null or undefined element
    and those not of the most frequent length take no part.  Every pair is
    found: each vector is held under its nearest centre and compared, in
    blocks of bounded size, with those of every centre that may hold a near
    one.  None does if the angle to the centre less the widest one that it
    holds exceeds the angle of ``floor``, or if the angle to the border
    between the two centres does.  Of two centres the vectors of the earlier
    look among those of the later.
    """
    spark = items.sparkSession
    kind = items.schema["id"].dataType.simpleString()
    rows = items.select("id", F.col("vec").cast("array<double>").alias("vec"))
    rows = rows.where(F.exists("vec", lambda x: x != 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))
    usual = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("many")).agg(F.max(F.struct("many", "n"))["n"].alias("n"))
    usable = keep(rows.join(F.broadcast(usual), F.size("vec") == F.col("n")).select("id", "vec"), "vectors")  # usual is one row
    count = usable.count()
    if count < 2:
        return spark.createDataFrame([], f"a {kind}, b {kind}, score double")
    sample = np.stack(usable.select("vec").orderBy(F.xxhash64("id")).limit(SAMPLE).toPandas()["vec"].to_numpy())
    sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centres = _centres(sample, max(1, min(MOST_CENTRES, -(-count // PER_CENTRE))))
    dim = centres.shape[1]
    # Floats are sent as they are, in half the bytes.
    number = np.float32 if items.schema["vec"].dataType.elementType.typeName() == "float" else np.float64
    shared = spark.sparkContext.broadcast(centres)  # at most MOST_CENTRES vectors

    def unit(packed: pd.Series) -> np.ndarray:
        v = np.frombuffer(b"".join(packed), number).reshape(-1, dim).astype(np.float64)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                packed = pd.Series([x.astype(number).tobytes() for x in batch["vec"]])
                cosine = unit(packed) @ shared.value.T
                yield pd.DataFrame({"id": batch["id"].to_numpy(), "v": packed, "centre": cosine.argmax(1).astype(np.int32), "far": np.arccos(np.clip(cosine.max(1), -1, 1))})

    placed = keep(usable.mapInPandas(place, f"id {kind}, v binary, centre int, far double"), "placed")
    radius = np.full(len(centres), -np.inf)
    for row in placed.groupBy("centre").agg(F.max("far").alias("far")).collect():  # a row a centre
        radius[row["centre"]] = row["far"]
    limit = float(np.arccos(np.clip(floor, -1, 1)))
    widths = spark.sparkContext.broadcast(radius)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for batch in batches:
            for start in range(0, len(batch), STEP):
                some = batch.iloc[start : start + STEP]
                home = some["centre"].to_numpy()
                cosine = unit(some["v"]) @ c.T
                # Room for rounding, so that no pair at the limit is lost.
                may = np.arccos(np.clip(cosine, -1, 1)) - widths.value <= limit + 1e-6
                if limit < np.pi / 2:
                    apart = np.sqrt(np.maximum(2 - 2 * (c[home] @ c.T), 0))
                    beyond = cosine[np.arange(len(home)), home][:, None] - cosine
                    may &= (apart < 1e-3) | (beyond <= apart * (np.sin(limit) + 1e-6))
                may &= np.arange(len(c)) > home[:, None]
                may[np.arange(len(home)), home] = True
                row, centre = np.nonzero(may)
                yield pd.DataFrame({"id": some["id"].to_numpy()[row], "v": some["v"].to_numpy()[row], "centre": centre.astype(np.int32)})

    # Found twice, for the counts and for the join, rather than written: these are the most bytes.
    visits = placed.select("id", "v", "centre").mapInPandas(visit, f"id {kind}, v binary, centre int") if len(centres) > 1 else placed.select("id", "v", "centre")
    blocks = lambda n: F.ceil(F.greatest(n, F.lit(1)) / BLOCK).cast("int")
    own = placed.groupBy("centre").agg(blocks(F.count("*")).alias("held"))
    parts = own.join(visits.groupBy("centre").agg(blocks(F.count("*")).alias("asked")), "centre")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = placed.join(parts, "centre").select("centre", part("held").alias("h"), other("asked").alias("q"), "id", "v")
    asked = visits.join(parts, "centre").select("centre", other("held").alias("h"), part("asked").alias("q"), "id", "v")
    asked = asked.toDF("centre2", "h2", "q2", "id2", "v2")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "score": []})
        x, y = unit(left["v"]), unit(right["v2"])
        m, n = left["id"].to_numpy(), right["id2"].to_numpy()
        found = []
        for start in range(0, len(x), STEP):
            score = x[start : start + STEP] @ y.T
            i, j = np.nonzero(score >= floor)
            a, b, near = m[start + i], n[j], score[i, j]
            first = a < b
            last = b < a
            found.append(pd.DataFrame({"a": np.r_[a[first], b[last]], "b": np.r_[b[first], a[last]], "score": np.r_[near[first], near[last]]}))
        return pd.concat(found)

    met = held.groupBy("centre", "h", "q").cogroup(asked.groupBy("centre2", "h2", "q2")).applyInPandas(compare, f"a {kind}, b {kind}, score double")
    return met.groupBy("a", "b").agg(F.max("score").alias("score"))
