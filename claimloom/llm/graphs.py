"""A robust-pruned directed neighbour graph over unit vectors, built and searched in batches with numpy."""

from __future__ import annotations

import numpy as np

#: Beam entries opened at once in one step of a search.
OPENED = 4
BATCH = 512


def beam_search(vectors: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of all ``queries`` side by side: ids (-1 where fewer were found) and cosines of the ``beam`` best nodes met, unordered."""
    count, n = len(queries), len(vectors)
    seen = np.zeros((count, n), bool)
    ids = np.full((count, beam), -1, np.int32)
    sims = np.full((count, beam), -np.inf, np.float32)
    opened = np.ones((count, beam), bool)
    rows, nodes = np.repeat(np.arange(count), len(entries)), np.tile(entries, count)
    while len(rows):
        seen[rows, nodes] = True
        found = np.einsum("ij,ij->i", vectors[nodes], queries[rows])
        per_row = np.bincount(rows, minlength=count)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        touched = np.flatnonzero(per_row)
        at = np.searchsorted(touched, rows)
        wide = per_row.max()
        new_ids = np.full((len(touched), wide), -1, np.int32)
        new_sims = np.full((len(touched), wide), -np.inf, np.float32)
        new_ids[at, place], new_sims[at, place] = nodes, found
        all_sims = np.concatenate([sims[touched], new_sims], 1)
        all_ids = np.concatenate([ids[touched], new_ids], 1)
        all_opened = np.concatenate([opened[touched], new_ids < 0], 1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[touched] = np.take_along_axis(all_sims, best, 1)
        ids[touched] = np.take_along_axis(all_ids, best, 1)
        opened[touched] = np.take_along_axis(all_opened, best, 1)
        open_sims = np.where(opened, -np.inf, sims)
        next_up = np.argpartition(-open_sims, min(OPENED, beam) - 1, axis=1)[:, :OPENED]
        row, col = np.nonzero(np.take_along_axis(open_sims, next_up, 1) > -np.inf)
        slot = next_up[row, col]
        opened[row, slot] = True
        around = graph[ids[row, slot]]
        rows, nodes = np.repeat(row, around.shape[1]), around.ravel()
        fresh = nodes >= 0
        fresh[fresh] = ~seen[rows[fresh], nodes[fresh]]
        key = np.unique(rows[fresh].astype(np.int64) * n + nodes[fresh])
        rows, nodes = key // n, key % n
    return ids, sims


def robust_prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relaxed: float) -> np.ndarray:
    """For each point up to ``degree`` of its candidates: the nearest first, each dropping those that are ``relaxed`` times nearer to it than to the point."""
    candidates = np.sort(candidates, axis=1)
    bad = (candidates < 0) | (candidates == points[:, None])
    bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    there = vectors[candidates]
    away = 1 - np.einsum("ukd,ud->uk", there, vectors[points])
    among = 1 - there @ there.transpose(0, 2, 1)
    away[bad] = np.inf
    kept = np.full((len(points), degree), -1, np.int32)
    row = np.arange(len(points))
    alive = away.copy()
    for slot in range(degree):
        pick = alive.argmin(1)
        live = row[alive[row, pick] < np.inf]
        if not len(live):
            break
        kept[live, slot] = candidates[live, pick[live]]
        hidden = relaxed * among[live, pick[live]] <= away[live]
        hidden[np.arange(len(live)), pick[live]] = True
        part = alive[live]
        part[hidden] = np.inf
        alive[live] = part
    return kept


def build_graph(vectors: np.ndarray, degree: int = 24, beam: int = 40, relaxed: float = 1.2, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(graph, entries)``: out-neighbours of each node (-1 where fewer) and the nodes at which a search starts."""
    n = len(vectors)
    chance = np.random.default_rng(seed)
    entries = np.unique(np.append(chance.choice(n, min(n, 8), replace=False), (vectors @ vectors.mean(0)).argmax())).astype(np.int32)
    if n <= degree + 1:
        whole = np.tile(np.arange(n, dtype=np.int32), (n, 1))
        whole[np.arange(n), np.arange(n)] = -1
        return whole, entries
    graph = chance.integers(0, n, (n, degree)).astype(np.int32)
    for factor in (1.0, relaxed):
        order = chance.permutation(n).astype(np.int32)
        for start in range(0, n, BATCH):
            points = order[start : start + BATCH]
            met, _ = beam_search(vectors, graph, entries, vectors[points], beam)
            graph[points] = robust_prune(vectors, points, np.concatenate([met, graph[points]], 1), degree, factor)
            # Edges back, grouped by the node that gets them; a full node is pruned again.
            to, of = graph[points].ravel(), np.repeat(points, degree)
            of, to = of[to >= 0], to[to >= 0]
            by = np.argsort(to, kind="stable")
            of, to = of[by], to[by]
            nodes, first, many = np.unique(to, return_index=True, return_counts=True)
            place = np.arange(len(to)) - np.repeat(first, many)
            fits = place < degree
            back = np.full((len(nodes), min(degree, many.max())), -1, np.int32)
            back[np.repeat(np.arange(len(nodes)), many)[fits], place[fits]] = of[fits]
            graph[nodes] = robust_prune(vectors, nodes.astype(np.int32), np.concatenate([graph[nodes], back], 1), degree, factor)
    return graph, entries


def nearest(vectors: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines of the ``k`` best nodes for each query, best first; -1 where fewer were found."""
    ids, sims = [np.empty((0, k), np.int32)], [np.empty((0, k), np.float32)]
    for start in range(0, len(queries), BATCH):
        got, cos = beam_search(vectors, graph, entries, queries[start : start + BATCH], max(beam, k))
        best = np.argsort(-cos, axis=1, kind="stable")[:, :k]
        ids.append(np.take_along_axis(got, best, 1))
        sims.append(np.take_along_axis(cos, best, 1))
    return np.concatenate(ids), np.concatenate(sims)
