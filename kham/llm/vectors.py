"""Vectors shared by nearest-neighbour search and near-dedup: validity, and a hierarchical k-means tree."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, x) of the vectors that take part, and their dimension.

    Left out: null ids, null, empty or zero vectors, null or non-finite components, and vectors that don't have the
    table's most frequent length (of equally frequent ones the least). `x` is array<double>.
    """
    x = F.col(vec_col)
    good = df.select(F.col(id_col).alias("id"), x.cast("array<double>").alias("x")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull()
        & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("x", lambda v: v != 0))
    dims = good.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d = dims["d"] if dims else 0
    return good.where(F.size("x") == d), d


def matrix(column: pa.Array, d: int, dtype: type = np.float64) -> np.ndarray:
    """Rows of a list column of d numbers each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype).reshape(-1, d)


class Tree:
    """A hierarchical k-means tree; small enough to broadcast, as it is fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, leaf: int, branch: int = 8, seed: int = 0):
        self.centres: list[np.ndarray] = []  # of each inner node's children
        self.children: list[list[int]] = []  # inner nodes >= 0, leaves as -1 - leaf
        self.leaves, self.branch, self.rng = 0, branch, np.random.default_rng(seed)
        self.root = self._grow(sample, leaf)

    def _grow(self, x: np.ndarray, leaf: int) -> int:
        if len(x) > leaf:
            centres, at = self._kmeans(x)
            if len(centres) > 1:
                node = len(self.centres)
                self.centres.append(centres)
                self.children.append([])
                self.children[node] = [self._grow(x[at == k], leaf) for k in range(len(centres))]
                return node
        self.leaves += 1
        return -self.leaves

    def _kmeans(self, x: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
        c = x[self.rng.choice(len(x), min(self.branch, len(x)), replace=False)]
        c = np.unique(c, axis=0)
        for _ in range(rounds):
            at = nearest(x, c)
            n = np.bincount(at, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, at, x)
            c = sums[n > 0] / n[n > 0, None]
        return c, nearest(x, c)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, nearest child by nearest child."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out[rows] = -1 - node
                continue
            at = nearest(x[rows], self.centres[node])
            todo += [(kid, rows[at == k]) for k, kid in enumerate(self.children[node])]
        return out

    def best_first(self, q: np.ndarray) -> Iterator[int]:
        """Leaves from a queue of nodes by the distance of their centres to the query."""
        queue: list[tuple[float, int]] = [(0.0, self.root)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            d = ((self.centres[node] - q) ** 2).sum(1)
            for k, kid in enumerate(self.children[node]):
                heapq.heappush(queue, (float(d[k]), kid))

    def order(self, q: np.ndarray) -> np.ndarray:
        """All leaves of each row in the order of `best_first`, for many rows at once.

        Of two leaves that one comes first whose path, below their last common node, has the smaller largest distance.
        Largest distances from a level down to the leaf, upper levels first, sort leaves in just this way, as common
        nodes give equal values.
        """
        depth = self._depth(self.root)
        if not depth:
            return np.zeros((len(q), 1), np.int64)
        some = max(1, (1 << 19) // (depth * self.leaves))
        return np.concatenate([np.zeros((0, self.leaves), np.int64), *(self._order(q[a : a + some], depth) for a in range(0, len(q), some))])

    def _depth(self, node: int) -> int:
        return 0 if node < 0 else 1 + max(self._depth(kid) for kid in self.children[node])

    def _order(self, q: np.ndarray, depth: int) -> np.ndarray:
        keys = np.zeros((depth, self.leaves, len(q)))
        todo: list[tuple[int, list[np.ndarray]]] = [(self.root, [])]
        while todo:
            node, path = todo.pop()
            if node < 0:
                worst = path[-1]
                for level in range(len(path) - 1, -1, -1):
                    worst = np.maximum(worst, path[level])
                    keys[level, -1 - node] = worst
                continue
            c = self.centres[node]
            d = (c * c).sum(1)[:, None] - 2 * (c @ q.T)
            todo += [(kid, [*path, d[k]]) for k, kid in enumerate(self.children[node])]
        return np.lexsort(keys[::-1].transpose(0, 2, 1), axis=-1)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2 * (x @ c.T)).argmin(1)


def sample_rows(df: DataFrame, n: int, d: int, salt: int = 0) -> tuple[list, np.ndarray]:
    """n rows at most, those with the least hash of the id; a bounded collection."""
    got = df.orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(n).toArrow()
    return got["id"].to_pylist(), matrix(got["x"].combine_chunks(), d) if len(got) else np.zeros((0, d))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of a row of scores: larger first, ties to smaller ids; those at -inf are left out."""
    if len(scores) > k:
        low = np.partition(scores, -k)[-k]
        at = np.flatnonzero(scores >= low)
    else:
        at = np.arange(len(scores))
    at = at[scores[at] > -np.inf]
    return at[np.lexsort((ids[at], -scores[at]))][:k]
