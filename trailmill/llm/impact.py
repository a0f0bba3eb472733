"""Operator 4: exact top-k by inner product on an impact-ordered, score-at-a-time index.

A block of vectors of whole numbers is turned into postings (row, value) in
segments, one for each dimension and level of impact (absolute value, quantised
into LEVELS steps). A query takes the segments by descending impact, that is its
own weight times the segment's level, and adds their products to the rows'
scores. For every row it also keeps what is left of the row's square and of its
own square: what a row has still to get is at most the product of both roots
(Cauchy and Schwarz), and at most the sum over the dimensions of the query's
weight times the next level. A query stops when these bounds prove that the rows
which can be among its k best cost less to score whole than the postings that are
left to read; those rows are then scored exactly. There is no other way to stop:
a query without such a proof reads all its segments.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import best_of, search_blocks, valid_vectors

LEVELS = 8
END = 2.0**63  # scores are cut off there
FIRST_LOOK, LOOKS = 0.4, 20  # share of the postings before the first look for a proof, and looks in all


class ImpactIndex:
    """Postings of a block of integer vectors in segments of a dimension and a level of impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.int64)
        n, d = vectors.shape
        impact = np.abs(self.vectors.astype(float))
        top = float(impact.max(initial=0)) or 1.0
        step = np.minimum((impact / top * LEVELS).astype(np.int64), LEVELS - 1)
        segment = (np.arange(d)[None, :] * LEVELS + step).ravel()
        real = np.flatnonzero(impact.ravel() > 0)
        order = real[np.argsort(segment[real], kind="stable")]
        self.rows, self.values = (order // d).astype(np.int32), self.vectors.ravel()[order].astype(float)
        self.edges = np.searchsorted(segment[order], np.arange(d * LEVELS + 1))
        filled = self.edges[1:] > self.edges[:-1]
        self.highest = np.zeros(d * LEVELS)
        self.highest[filled] = np.maximum.reduceat(np.abs(self.values), self.edges[:-1][filled]) if len(order) else 0
        self.square = (impact**2).sum(1)
        # Sums of products in floating point are off by less than this share of the norms' product.
        self.error = 4 * d * np.finfo(float).eps
        self.read = self.postings = self.stopped = self.asked = 0

    def members(self, name: int, q: np.ndarray, k: int) -> np.ndarray:
        """Places of rows that hold the k best for a query, its own row apart."""
        n, d = self.vectors.shape
        weight = np.abs(q.astype(float))
        impact = np.repeat(weight, LEVELS) * self.highest
        order = np.argsort(-impact, kind="stable")
        order = order[impact[order] > 0]
        size = np.diff(self.edges)[order]
        total = int(size.sum())
        look = max(1, total // LOOKS)
        score, left, asked_left = np.zeros(n), self.square.copy(), np.full(n, float((weight**2).sum()))
        norms = np.sqrt(self.square * float((weight**2).sum()))
        own = np.flatnonzero(self.ids == name)
        done, following = 0, FIRST_LOOK * total
        self.asked += 1
        self.postings += total
        # The next level of each dimension, for the sum bound: segments of a dimension come highest level first.
        ahead = impact.reshape(d, LEVELS).max(1, initial=0)
        for place, s in enumerate(order.tolist()):
            if done >= following:
                bound = np.minimum(np.sqrt((np.maximum(left, 0) + self.error * self.square) * (np.maximum(asked_left, 0) + self.error * float((weight**2).sum()))), ahead.sum()) + self.error * norms
                found = self._possible(score, bound, own, k)
                if len(found) * d <= total - done:
                    self.stopped += 1
                    self.read += done
                    return found
                following = done + look
            rows, values = self.rows[self.edges[s] : self.edges[s + 1]], self.values[self.edges[s] : self.edges[s + 1]]
            j = s // LEVELS
            score[rows] += q[j] * values
            left[rows] -= values * values
            asked_left[rows] -= weight[j] ** 2
            done += int(size[place])
            lower = impact[j * LEVELS : s]
            ahead[j] = lower.max(initial=0)
        self.read += total
        return self._possible(score, self.error * norms, own, k)

    @staticmethod
    def _possible(score: np.ndarray, bound: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        low = np.clip(score - bound, -END, END)
        low[own] = -np.inf
        proof = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
        out = np.clip(score + bound, -END, END) >= proof
        out[own] = False
        return np.flatnonzero(out)

    def exact(self, places: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Scores of rows as whole numbers, cut off at the ends of 64 bits."""
        rows = self.vectors[places]
        if float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0)) * rows.shape[1] < 2**62:
            return rows @ q
        top = 2**63 - 1
        return np.array([max(-top, min(top, int(x))) for x in rows.astype(object) @ q.astype(object)], np.int64)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found: list[list[np.ndarray]] = [[], [], []]
        for name, q in zip(query_ids.tolist(), queries.astype(np.int64), strict=True):
            places = self.members(name, q, k)
            score = self.exact(places, q)
            best = best_of(score, self.ids[places], k)
            found[0].append(np.full(len(best), name))
            found[1].append(self.ids[places][best])
            found[2].append(score[best])
        return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in found)


def exact_top_k(table: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `queries` holds, the k rows of highest inner product of floor(scale * x).

    Exact; ties go to the smaller id; rows of the query's id are no candidates;
    fewer candidates give fewer rows. Rows without id, with a null or empty
    vector or with null or non-finite components take no part; vectors of
    different length are not compared. Every row of a repeated id is a candidate
    (so an id can come up twice), and queries of one id are ranked together.
    Scores beyond 64 bits are cut off there. An empty table gives an empty one.
    """
    whole = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long").cast("double")).alias("v")
    rows = valid_vectors(table, id_column, vector, zero=True).select("id", whole)
    asked = valid_vectors(table.where(queries), id_column, vector, zero=True).select("id", whole)
    return search_blocks(rows, asked, k, "long", ImpactIndex)
