"""The most similar vectors for every vector: shards around centres, each searched whole by matrix products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.session import keep

#: Vectors from which the shard centres are fitted; every vector is indexed all the same.
SAMPLE = 20_000
#: Vectors a centre stands for on average, and the most that one shard or one batch of queries holds.
PER_CENTRE, MOST = 4_000, 8_000
#: Most centres of the table that every task gets; where more are needed, these are coarse and each has fine ones of its own.
MOST_CENTRES = 4_096
#: Centres nearest to a vector under which it is indexed, and whose shards it searches.
HOMES, ROUTES = 2, 3
#: Queries compared at once, and columns of which only the largest is looked at first.
BATCH, WIDE = 512, 64


def _unit(cells: pd.Series, dim: int) -> np.ndarray:
    vectors = np.frombuffer(b"".join(cells), np.float32)
    return vectors.reshape(-1, dim)


def best_of(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the ``k`` best (or all) of ``vectors`` for each query, best first; nothing is left out.

    The best ``k`` lie in the ``k`` blocks of columns with the largest heads,
    so only these are partitioned.
    """
    n = len(vectors)
    k = min(k, n)
    places, cosines = np.empty((len(queries), k), np.int64), np.empty((len(queries), k), np.float32)
    whole = n // WIDE
    for start in range(0, len(queries), BATCH):
        sims = queries[start : start + BATCH] @ vectors.T
        at = None
        if whole > 2 * k:
            heads = sims[:, : whole * WIDE].reshape(len(sims), WIDE, whole).max(1)  # block j: columns j, j + whole, ...
            block = np.argpartition(heads, whole - k, axis=1)[:, whole - k :]
            at = (block[:, :, None] + np.arange(WIDE) * whole).reshape(len(sims), -1)
            at = np.concatenate([at, np.tile(np.arange(whole * WIDE, n), (len(sims), 1))], 1)
            sims = np.take_along_axis(sims, at, 1)
        top = np.argpartition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k :]
        top_sims = np.take_along_axis(sims, top, 1)
        order = np.argsort(-top_sims, axis=1, kind="stable")
        top = np.take_along_axis(top, order, 1)
        places[start : start + BATCH] = top if at is None else np.take_along_axis(at, top, 1)
        cosines[start : start + BATCH] = np.take_along_axis(top_sims, order, 1)
    return places, cosines


def fit_centres(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit-length centres by spherical k-means; an empty one keeps its place."""
    chance = np.random.default_rng(seed)
    centres = sample[chance.choice(len(sample), min(count, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + BATCH] @ centres.T).argmax(1) for i in range(0, len(sample), BATCH)])
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, total / np.maximum(size, 1e-9), centres).astype(np.float32)
    return centres


def _usable(items: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v``: one row a key, of the most frequent length, finite and not all zero."""
    rows = items.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("many"))
    usual = sizes.agg(F.max(F.struct("many", "n"))["n"].alias("n"))
    return rows.join(F.broadcast(usual), F.size("v") == F.col("n")).drop("n")  # one row


def similar_vectors(items: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """``(id, other, cosine, rank)``: for every usable vector the ``k`` most similar others by cosine.

    Ties go to the smaller id.  Null, empty and all-zero vectors, those with
    a null, infinite or undefined element, and those not of the most frequent
    length take no part; length does not matter; a repeated key counts once
    (its smallest vector); fewer than ``k`` others give fewer rows; an empty
    table gives none; other columns play no part.

    Exact copies of a vector are one node of the index and are expanded
    afterwards: a member of a large group of copies has other copies as its
    neighbours, and only the first ``k + 1`` ids of a group can be anyone's,
    so no group is ever gathered.  The nodes are spread over shards: each
    is held by its ``HOMES`` nearest centres, a centre with many nodes is
    split into shards of at most about ``MOST``, and each node is compared
    with all that the shards of its ``ROUTES`` nearest centres hold.  There is
    a centre for every ``PER_CENTRE`` nodes, in two levels where they are
    many, so the work grows with the number of vectors.  Within its shards a
    node misses nothing; a neighbour that none of them holds is missed: the
    recall is measured in the tests and given in the README.
    """
    # The hash comes first, so that sorts and joins seldom compare whole vectors.
    rows = keep(_usable(items, key, vector).select("id", F.xxhash64("v").alias("h"), "v"), "vectors")
    # Equal vectors share a node; of a group only the k + 1 smallest ids can be among the nearest of another vector.
    firsts = rows.withColumn("nth", F.row_number().over(W.partitionBy("h", "v").orderBy("id"))).where(F.col("nth") <= k + 1)
    node = firsts.groupBy("h", "v").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("members"))
    nodes = keep(node, "nodes")
    near = _search(nodes, k)

    candidates = near.join(nodes.select(F.col("node").alias("other_node"), "members"), "other_node").select("node", F.explode("members").alias("other"), "cosine")
    # At most k times k + 1 of one node.
    found = candidates.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("away"), "other"))), 1, k).alias("outside"))
    none = F.array().cast("array<struct<away:float,other:bigint>>")
    with_found = nodes.join(found, "node", "left").select("h", "v", "members", F.coalesce("outside", none).alias("outside"))
    each = rows.select("id", "h", "v").join(with_found, ["h", "v"])
    copies = F.transform(F.filter("members", lambda m: m != F.col("id")), lambda m: F.struct(F.lit(-1.0).cast("float").alias("away"), m.alias("other")))
    ordered = F.when(F.size("members") == 1, F.col("outside")).otherwise(F.slice(F.sort_array(F.concat(copies, "outside")), 1, k))
    ranked = each.select("id", F.posexplode(ordered).alias("pos", "c"))
    return ranked.select("id", F.col("c.other").alias("other"), (-F.col("c.away")).alias("cosine"), (F.col("pos") + 1).alias("rank"))


def _search(nodes: DataFrame, k: int) -> DataFrame:
    """``(node, other_node, cosine)`` with up to ``k`` rows a node."""
    spark = nodes.sparkSession
    empty = spark.createDataFrame([], "node long, other_node long, cosine float")
    count = nodes.count()
    if count < 2:
        return empty
    dim = nodes.select(F.size("v")).first()[0]
    sample = nodes.select("v").orderBy(F.xxhash64("node")).limit(SAMPLE).toPandas()["v"]
    sample = np.stack([np.asarray(v, np.float64) for v in sample])
    sample = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
    wanted = max(1, -(-count // PER_CENTRE))
    deep = wanted > MOST_CENTRES
    centres = fit_centres(sample, min(MOST_CENTRES, math.isqrt(wanted) + 1) if deep else wanted)
    shared = spark.sparkContext.broadcast(centres)  # at most MOST_CENTRES vectors
    routes, homes = min(ROUTES, len(centres)), HOMES

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
                near = best_of(v, shared.value, routes)[0].astype(np.int32)
                starts = np.arange(len(v) + 1, dtype=np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(starts * (4 * dim)), pa.py_buffer(v.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("node"), packed, pa.ListArray.from_arrays(pa.array(starts * routes), pa.array(near.ravel()))], ["node", "v", "centres"])

    placed = keep(nodes.select("node", "v").mapInArrow(place, "node long, v binary, centres array<int>"), "placed")
    if deep:
        placed = keep(_fine(placed, dim), "placed")
    visits = placed.select("node", "v", F.posexplode("centres").alias("nth", "centre"))
    loads = visits.groupBy("centre").agg(F.count("*").alias("queries"), F.sum((F.col("nth") < homes).cast("long")).alias("held"))
    parts = keep(loads.select("centre", F.ceil(F.greatest(F.col("held"), F.lit(1)) / MOST).cast("int").alias("shards"), F.ceil(F.col("queries") / MOST).cast("int").alias("batches")), "parts")
    visits = visits.join(parts, "centre")
    # Queries meet each shard of a centre in batches of about MOST.
    batch = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("batches")).cast("int")
    asked = visits.select("centre", batch.alias("batch"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "node", "v")
    shard = F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    held = visits.where(F.col("nth") < homes).select(F.col("centre").alias("at"), shard.alias("part"), F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("turn"), F.col("node").alias("other"), F.col("v").alias("w"))

    def ask(queries: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(there):
            return pd.DataFrame({"node": pd.Series(dtype="int64"), "others": pd.Series(dtype="object"), "cosines": pd.Series(dtype="object")})
        there = there.sort_values("other")
        places, cosines = best_of(_unit(queries["v"], dim), _unit(there["w"], dim), k + 1)
        others = there["other"].to_numpy(np.int64)[places]
        return pd.DataFrame({"node": queries["node"], "others": [x.tobytes() for x in others], "cosines": [x.tobytes() for x in cosines]})

    met = asked.groupBy("centre", "shard", "batch").cogroup(held.groupBy("at", "part", "turn")).applyInPandas(ask, "node long, others binary, cosines binary")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                others, cosines = ([b"".join(cells) for cells in batch[c]] for c in ("others", "cosines"))
                node = np.repeat(batch["node"].to_numpy(np.int64), [len(x) // 8 for x in others])
                other, cosine = np.frombuffer(b"".join(others), np.int64), np.clip(np.frombuffer(b"".join(cosines), np.float32), -1, 1)
                # A pair may come from two shards; its cosine may then differ in the last bit.
                by = np.lexsort((-cosine, other, node))
                node, other, cosine = node[by], other[by], cosine[by]
                once = node != other
                once[1:] &= (node[1:] != node[:-1]) | (other[1:] != other[:-1])
                node, other, cosine = node[once], other[once], cosine[once]
                by = np.lexsort((other, -cosine, node))
                node, other, cosine = node[by], other[by], cosine[by]
                top = np.arange(len(node)) - np.searchsorted(node, node) < k
                yield pd.DataFrame({"node": node[top], "other_node": other[top], "cosine": cosine[top]})

    gathered = met.groupBy("node").agg(F.collect_list("others").alias("others"), F.collect_list("cosines").alias("cosines"))  # a row a shard, in one order
    return gathered.mapInPandas(merge, "node long, other_node long, cosine float")


def _fine(placed: DataFrame, dim: int) -> DataFrame:
    """``node, v, centres`` with the ``ROUTES`` nearest fine centres of all coarse ones that a node goes to.

    The fine centres of a coarse one are fitted on a sample of at most about
    ``SAMPLE`` of the nodes nearest to it, one for every ``PER_CENTRE``; they
    stay in a table and meet the nodes in batches.
    """
    nearest_to = placed.select("node", "v", F.col("centres")[0].alias("coarse"))
    sizes = keep(nearest_to.groupBy("coarse").agg(F.count("*").alias("n")), "cells")
    few = nearest_to.join(sizes, "coarse").where(F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(1_000_000)) * F.col("n") < 1_000_000 * SAMPLE)

    def fit(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("node")
        fitted = fit_centres(_unit(cell["v"], dim), max(1, -(-int(cell["n"].iloc[0]) // PER_CENTRE)))
        return pd.DataFrame({"coarse": [cell["coarse"].iloc[0]], "count": [len(fitted)], "fine": [fitted.astype(np.float32).tobytes()]})

    fine = keep(few.groupBy("coarse").applyInPandas(fit, "coarse int, count int, fine binary"), "fine")
    # Numbers of the fine centres: those of the coarse ones before come first. One row a coarse centre.
    first = F.coalesce(F.sum("count").over(W.orderBy("coarse").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    fine = keep(fine.withColumn("first", first), "fine")
    visits = placed.select("node", "v", F.explode("centres").alias("coarse"))
    loads = visits.groupBy("coarse").agg(F.ceil(F.count("*") / MOST).cast("int").alias("batches"))
    asked = visits.join(loads, "coarse").select("coarse", F.pmod(F.xxhash64("node"), F.col("batches")).cast("int").alias("batch"), "node", "v")
    offered = fine.join(loads, "coarse").select("coarse", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch"), "first", "fine")

    def route(queries: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(cell):
            return pd.DataFrame({"node": pd.Series(dtype="int64"), "centre": pd.Series(dtype="int32"), "cosine": pd.Series(dtype="float32")})
        centres = np.frombuffer(cell["fine"].iloc[0], np.float32).reshape(-1, dim)
        near, cosine = best_of(_unit(queries["v"], dim), centres, ROUTES)
        node = np.repeat(queries["node"].to_numpy(np.int64), near.shape[1])
        return pd.DataFrame({"node": node, "centre": (near.ravel() + cell["first"].iloc[0]).astype(np.int32), "cosine": cosine.ravel()})

    met = asked.groupBy("coarse", "batch").cogroup(offered.groupBy("coarse", "batch")).applyInPandas(route, "node long, centre int, cosine float")
    # A few of one node.
    ranked = met.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("away"), "centre"))).alias("all"))
    return placed.select("node", "v").join(ranked.select("node", F.transform(F.slice("all", 1, ROUTES), lambda c: c["centre"]).alias("centres")), "node")


def similar_pairs(items: DataFrame, key: str, vector: str, k: int = 10, least: float = 0.90, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Each pair, the smaller id first, of which one is among the other's ``k`` most similar and whose cosine is at least ``least``."""
    close = similar_vectors(items, key, vector, k).where(F.col("cosine") >= F.lit(least) - 1e-6)
    return close.select(F.least("id", "other").alias(names[0]), F.greatest("id", "other").alias(names[1])).distinct()
