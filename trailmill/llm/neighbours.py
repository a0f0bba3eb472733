"""Operator 10: approximate nearest neighbours by stable projections in a kd-tree.

A largest inner product is a smallest distance once each vector x has one more
coordinate sqrt(M*M - |x|^2), M being the largest norm of all, and a query a zero
there. All vectors are projected to DIM dimensions by Gaussian (2-stable)
directions, the same for every block, and a kd-tree is built over the projected
points. A query gets the points one after the other by projected distance: leaves
are opened by the distance of their boxes, and a point comes up when no unopened
leaf can hold a nearer one. What comes up is verified on the whole vectors. A
pair's squared projected distance over its squared distance is chi-square
distributed with DIM degrees of freedom, so the search stops when a point as near
as the k-th best so far would have come up already with probability SURE.

Every row is in the index of its block; the directions depend on the dimension
alone, nothing is fitted.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import best_of, search_blocks, valid_vectors

DIM, LEAF, SURE, SEED = 28, 128, 0.9, 20
STEP, FIRST_LEAVES = 64, 8


_DIRECTIONS: dict[int, np.ndarray] = {}


def directions(size: int) -> np.ndarray:
    if size not in _DIRECTIONS:
        _DIRECTIONS[size] = np.random.default_rng(SEED).standard_normal((size, DIM))
    return _DIRECTIONS[size]


def chi_square_cdf(x: np.ndarray) -> np.ndarray:
    """Probability that a chi-square variable of DIM (even) degrees of freedom is at most x."""
    half = x / 2
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(DIM // 2))


def _point(sure: float) -> float:
    """Where the distribution function reaches `sure`, by halving."""
    low, high = 0.0, 20.0 * DIM
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(np.array([middle]))[0] < sure else (low, middle)
    return high


ENOUGH = _point(SURE)


def kd_leaves(points: np.ndarray) -> list[np.ndarray]:
    """The leaves of a kd-tree: places of points, halved at the median of the widest dimension."""
    out, work = [], [np.arange(len(points))]
    while work:
        own = work.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        part = points[own]
        order = np.argpartition(part[:, np.ptp(part, axis=0).argmax()], len(own) // 2)
        work += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


class ProjectionTree:
    """A block of vectors, equal ones held once, under projected kd-tree leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, radius: float, k: int):
        vectors = np.ascontiguousarray(vectors + 0.0)  # no negative zeros: equal vectors are equal bytes
        _, first, inverse = np.unique(vectors.view(f"V{vectors.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, inverse))
        start = np.searchsorted(inverse[order], np.arange(len(first)))
        # Of equal vectors the k + 1 smallest ids can be among a query's k best, itself excluded.
        self.own = [ids[order[a : min(b, a + k + 1)]] for a, b in zip(start, np.append(start[1:], len(ids)), strict=True)]
        vectors = vectors[first]
        extra = np.sqrt(np.maximum(0, radius**2 - (vectors**2).sum(1)))
        points = np.hstack([vectors, extra[:, None]]) @ directions(vectors.shape[1] + 1)
        leaves = kd_leaves(points)
        self.low = np.stack([points[x].min(0) for x in leaves])
        self.high = np.stack([points[x].max(0) for x in leaves])
        laid = np.concatenate(leaves)  # leaf by leaf
        self.own = [self.own[i] for i in laid.tolist()]
        self.vectors, self.points = vectors[laid], points[laid]
        self.edges = np.cumsum([0, *map(len, leaves)])
        self.norms = (self.points**2).sum(1)
        self.radius = radius
        self.verified = self.possible = 0

    def candidates(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k + 1 best vectors that come up before the search stops (the query itself may be one)."""
        asked = np.append(q, 0.0) @ directions(len(q) + 1)
        gap = np.maximum(0, np.maximum(self.low - asked, asked - self.high))
        box = (gap**2).sum(1)
        leaves = np.argsort(box, kind="stable")
        box = np.append(box[leaves], np.inf)
        size, opened, chunk = float((q**2).sum()), 0, FIRST_LEAVES
        step, length = max(STEP, len(self.vectors) // 64), float(asked @ asked)
        near, place, at = np.zeros(0), np.zeros(0, np.int64), 0  # points of opened leaves by distance; those before `at` have come up
        best, score = np.zeros(0, np.int64), np.zeros(0)
        self.possible += len(self.vectors)
        while True:
            while opened < len(leaves) and (len(near) < at + step or near[at + step - 1] > box[opened]):
                own = np.concatenate([np.arange(self.edges[x], self.edges[x + 1]) for x in leaves[opened : opened + chunk].tolist()])
                near = np.concatenate([near[at:], np.maximum(self.norms[own] - 2 * (self.points[own] @ asked) + length, 0)])
                order = np.argsort(near)
                near, place, at = near[order], np.concatenate([place[at:], own])[order], 0
                opened, chunk = opened + chunk, 2 * chunk
                opened = min(opened, len(leaves))
            take = place[at : at + step]
            at += len(take)
            self.verified += len(take)
            best, score = np.append(best, take), np.append(score, self.vectors[take] @ q)
            if len(score) > k + 1:
                top = np.argpartition(-score, k)[: k + 1]
                best, score = best[top], score[top]
            if at == len(near) and opened == len(leaves):
                break
            if len(score) > k:
                far = max(self.radius**2 + size - 2 * float(score.min()), 1e-12)
                if min(near[at] if at < len(near) else np.inf, box[opened]) >= far * ENOUGH:  # the distribution function is SURE there
                    break
        return best, (self.vectors[best] * q).sum(1)  # each in one order of summation, whatever came up with it

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found: list[list[np.ndarray]] = [[], [], []]
        for name, q in zip(query_ids.tolist(), queries, strict=True):
            places, exact = self.candidates(q, k)
            own = [self.own[p] for p in places.tolist()]
            ids = np.concatenate(own) if own else np.zeros(0, np.int64)
            score = np.repeat(exact, [len(x) for x in own])
            ids, score = ids[ids != name], score[ids != name]
            best = best_of(score, ids, k)
            found[0].append(np.full(len(best), name))
            found[1].append(ids[best])
            found[2].append(score[best])
        return tuple(np.concatenate(x) if x else np.zeros(0) for x in found)


def nearest_neighbours(table: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `queries` holds, k rows of large inner product, largest first.

    Approximate: the k-th neighbour is found with probability of about SURE,
    nearer ones with more. The scores are exact in double precision; ties go to
    the smaller id; rows of the query's id are no candidates; fewer candidates
    give fewer rows. Rows without id or whose vector is null, empty, zero or holds
    null or non-finite components take no part; vectors of different length are
    not compared. Every row of a repeated id is a candidate (of those with equal
    vectors too), and queries of one id are ranked together. An empty table gives
    an empty one.
    """
    rows = valid_vectors(table, id_column, vector, zero=False)
    asked = valid_vectors(table.where(queries), id_column, vector, zero=False)
    radius = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()["m"] or 0.0
    radius = math.sqrt(radius) * (1 + 1e-9)
    return search_blocks(rows, asked, k, "double", lambda ids, vectors: ProjectionTree(ids, vectors, radius, k))
