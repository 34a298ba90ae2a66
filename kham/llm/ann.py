"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The measure is the inner product. Vectors are lifted so that its order becomes that of distances: all are divided by
the largest norm and get one more component that makes them unit vectors; queries are normalised and get 0. A tree is
fitted on a bounded sample (`FIT` rows of least hash) and broadcast; every row goes to a leaf. Leaves next to each
other make a part of bounded size, and a leaf with many rows is a part dealt into blocks. A query's leaves come in the
order of a priority queue of nodes. How many are visited is calibrated: exact neighbours of up to `PROBES` queries over
all rows give, for each number of leaves, the recall; visits widen until it reaches the target. A query then goes once
to each part in which it visits leaves, with a bit for each of them, and meets their rows: products in single precision
leave out what can't be among the k best by their greatest error, the rest is scored exactly in double precision on
the original vectors. A query visits on until its leaves hold k candidates.

Invalid vectors (see `valid_vectors`) take no part. Rows that repeat an id are one candidate if their vectors are
equal, and one query. Ties go to the smaller id. Null ids take no part; other
columns, whatever their names, are left alone. No queries or an empty table give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, tidied
from .vectors import Tree, best_of, matrix, sample_rows, valid_vectors

#: Rows on which the tree is fitted, leaves it has about, queries that calibrate the visits.
FIT, LEAVES, PROBES = 16_384, 256, 256
#: Rows that are multiplied at once, with so many queries.
BLOCK, SLICE = 4096, 512
#: Numbers in the vectors of one part: what a task holds.
PART = 1 << 21


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    y = x / largest
    return np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1, keepdims=True)))])


def lift_query(q: np.ndarray) -> np.ndarray:
    return np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))])


def exact_neighbours(rows: DataFrame, ids: list, q: np.ndarray, k: int, d: int) -> DataFrame:
    """(probe, id, leaf, score): the k best rows of each of a bounded set of queries, per task and then over all."""
    shared = rows.sparkSession.sparkContext.broadcast((np.array(ids, object), q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        top: list[list[tuple]] = [[] for _ in own]
        for b in batches:
            rid = np.array(b.column(0).to_pylist(), object)
            leaf = b.column(2).to_numpy()
            x = matrix(b.column(1), d)
            for at in range(0, len(x), BLOCK):
                s = q @ x[at : at + BLOCK].T
                i_ = rid[at : at + BLOCK]
                for p in range(len(own)):
                    row = np.where(i_ == own[p], -np.inf, s[p])
                    top[p] += [(-row[j], i_[j], leaf[at + j]) for j in best_of(row, i_, k)]
                    top[p] = sorted(set(top[p]))[:k]
        out = [(p, i, int(f), -s) for p, x in enumerate(top) for s, i, f in x]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["probe", "id", "leaf", "score"])

    return rows.select("id", "x", "leaf").mapInArrow(tidied(run), "probe long, id long, leaf long, score double")


def parts_of(held: np.ndarray, most: int) -> list[tuple[np.ndarray, int]]:
    """(leaves, blocks) of each part, of `most` rows or fewer a block; `held` has the rows of each leaf."""
    out: list[tuple[np.ndarray, int]] = []
    some, size = [], 0
    for leaf, n in enumerate(held.tolist()):
        if not n:
            continue
        if some and size + n > most:
            out.append((np.array(some), 1))
            some, size = [], 0
        if n > most:
            out.append((np.array([leaf]), -(-n // most)))
            continue
        some.append(leaf)
        size += n
    return [*out, (np.array(some), 1)] if some else out


class Part:
    """Rows of some leaves, searched for the k best of queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: np.ndarray, leaves: np.ndarray, k: int):
        h = np.zeros(len(x), np.uint64)
        bits = x.view(np.uint32 if x.itemsize == 4 else np.uint64)
        for j in range(x.shape[1]):
            h = (h ^ bits[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        at = np.lexsort((ids, h, leaf))
        # rows that are repeated are one; of equal vectors only the k + 1 least ids can be among the k best of a query
        i, v = ids[at], x[at]
        same = np.zeros(len(at), bool)
        same[1:] = (h[at][1:] == h[at][:-1]) & (leaf[at][1:] == leaf[at][:-1]) & (v[1:] == v[:-1]).all(1)
        again = same.copy()
        again[1:] &= i[1:] == i[:-1]
        i, same, at = i[~again], same[~again], at[~again]
        n = np.arange(len(at))
        keep = n - np.maximum.accumulate(np.where(same, 0, n)) <= k
        self.ids, self.x, self.k = i[keep], v[~again][keep], k
        leaf = leaf[at[keep]]
        self.starts, self.ends = np.searchsorted(leaf, leaves), np.searchsorted(leaf, leaves, "right")
        self.scaled(np.float32)

    def scaled(self, dtype: type) -> None:
        """Rows divided by their largest norm, and the greatest error of their product with a unit vector."""
        self.y = np.empty(self.x.shape, dtype)
        blocks = [slice(a, a + BLOCK) for a in range(0, len(self.x), BLOCK)]
        largest = max((float(np.linalg.norm(self.x[b].astype(np.float64), axis=1).max()) for b in blocks), default=1.0) or 1.0
        for b in blocks:
            self.y[b] = self.x[b].astype(np.float64) / largest
        self.error = (self.x.shape[1] + 8) * float(np.finfo(dtype).eps)

    def exact(self, q: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Inner products of queries r and rows c; equal vectors get equal ones, wherever they stand."""
        return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[r[a : a + 65536]], self.x[c[a : a + 65536]].astype(np.float64)) for a in range(0, len(r), 65536))])

    def best(self, q: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(r, c, scores) of the k best pairs of each query, best first, ties to smaller ids."""
        s = self.exact(q, r, c)
        at = np.lexsort((self.ids[c], -s, r))
        r, c, s = r[at], c[at], s[at]
        n = np.bincount(r, minlength=len(q))
        keep = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) < self.k
        return r[keep], c[keep], s[keep]

    def search(self, qid: np.ndarray, q: np.ndarray, visited: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best of each query in the leaves it visits."""
        k = self.k
        unit = q / np.abs(q).max(1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        floor = np.full(len(q), -np.inf)
        r, c, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        held, size = [], 0

        def settle() -> None:
            """Raises the floors to what the k best found so far need, and leaves out what is below."""
            nonlocal r, c, s, held, size
            r, c, s = (np.concatenate(v) for v in zip((r, c, s), *held, strict=True))
            held, size = [], 0
            at = np.lexsort((-s, r))
            r, c, s = r[at], c[at], s[at]
            n = np.bincount(r, minlength=len(q))
            full = np.flatnonzero(n >= k)
            floor[full] = s[(np.cumsum(n) - n)[full] + k - 1] - 2 * self.error
            keep = s >= floor[r]
            r, c, s = r[keep], c[keep], s[keep]
            if len(r) > 4 * k * len(q):  # too many are too close for this precision
                r, c, _ = self.best(q, r, c)
                if self.y.dtype != np.float64:
                    self.scaled(np.float64)
                s = np.einsum("ij,ij->i", unit[r], self.y[c].astype(np.float64))

        for j in range(len(self.starts)):
            sel = np.flatnonzero(visited[:, j])
            for a in range(self.starts[j], self.ends[j], BLOCK) if len(sel) else ():
                y = self.y[a : min(a + BLOCK, self.ends[j])]
                got = unit[sel].astype(y.dtype) @ y.T
                least = floor[sel]
                new = np.flatnonzero(least == -np.inf)
                if len(new) and len(y) > k + 1:  # the query's own row may be among them
                    least[new] = np.partition(got[new], -k - 1, 1)[:, -k - 1] - 2 * self.error
                i, m = np.nonzero(got >= np.nextafter(least.astype(y.dtype), y.dtype.type(-np.inf))[:, None])
                i, m, v = sel[i], m + a, got[i, m].astype(np.float64)
                other = self.ids[m] != qid[i]
                held.append((i[other], m[other], v[other]))
                size += len(i)
                if size > k * len(q):
                    settle()
        settle()
        r, c, s = self.best(q, r, c)
        return r, self.ids[c], s


def calibrate(tree: Tree, rows: DataFrame, queries: DataFrame, k: int, d: int, target: float) -> int:
    """The fewest leaves that find the target share of the exact neighbours of sampled queries."""
    ids, q = sample_rows(queries, PROBES, d, 1)
    if not ids:
        return 1
    near = exact_neighbours(rows, ids, q, k, d).groupBy("probe").agg(
        F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "leaf")))), 1, k).alias("n")).collect()
    found, total = np.zeros(tree.leaves + 1), 0
    place = np.argsort(tree.order(lift_query(q)), 1)
    for r in near:
        for hit in r["n"]:
            found[place[r["probe"], hit["leaf"]] + 1] += 1
            total += 1
    share = np.cumsum(found) / max(total, 1)
    return int(np.searchsorted(share, target - 1e-12)) or 1


def nearest_neighbours(vectors: DataFrame, is_query: F.Column, id_col: str = "vec_id", vec_col: str = "embedding", *,
                       k: int = 20, target: float = 0.94, leaves: int = LEAVES) -> DataFrame:
    """(query_id, rank, id, score, n_visited) of the k nearest found of every query; `is_query` is over the column `id`."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann")
    good, d = valid_vectors(vectors, id_col, vec_col)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    largest = good.agg(F.max(norm)).first()[0] or 1.0
    _, sample = sample_rows(good, FIT, d)
    if vectors.schema[vec_col].dataType.elementType == T.FloatType():  # as they were: half as large, nothing is lost
        good = good.withColumn("x", F.col("x").cast("array<float>"))
    kind = good.schema["x"].dataType.simpleString()
    dtype = np.float32 if kind == "array<float>" else np.float64
    n_rows = good.count()
    leaves = min(max(leaves, math.isqrt(n_rows)), FIT // 8)  # about the root of the rows, as far as the sample tells them apart
    tree = Tree(lift(sample, largest), max(2, -(-len(sample) // leaves)))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.leaf_of(lift(matrix(b.column(1), d), largest)) if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(leaf)], names=["id", "x", "leaf"])

    rows = ws.stage(good.mapInArrow(tidied(place), f"id long, x {kind}, leaf long"))
    queries = rows.where(is_query).dropDuplicates(["id"])
    visits = calibrate(tree, rows, queries, k, d, target)
    held = np.zeros(tree.leaves, np.int64)
    for r in rows.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # a row a leaf
        held[r["leaf"]] = r["n"]
    parts = parts_of(held, max(1, min(PART // max(d, 1), max(BLOCK, -(-n_rows // spark.sparkContext.defaultParallelism)))))
    n_blocks = np.array([n for _, n in parts], np.int64)
    first = np.cumsum(n_blocks) - n_blocks  # each part's first block, of all blocks
    part_of = np.zeros(tree.leaves, np.int64)
    for p, (some, _) in enumerate(parts):
        part_of[some] = p

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, SLICE):
                some = b.slice(a, SLICE)
                order = shared.value.order(lift_query(matrix(some.column(1), d)))
                seen = np.cumsum(held[order], 1)
                n = np.maximum(visits, (seen <= k).sum(1) + 1)
                visited = np.zeros(order.shape, bool)
                np.put_along_axis(visited, order, np.arange(tree_leaves)[None] < n[:, None], 1)
                for p, (of_part, blocks) in enumerate(parts):
                    own = visited[:, of_part]
                    at = np.flatnonzero(own.any(1))
                    if not len(at):
                        continue
                    bits = np.packbits(own[at], axis=1)
                    bits = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(0, bits.size + 1, bits.shape[1], dtype=np.int32)), pa.py_buffer(bits.tobytes())])
                    rest = [some.column(0).take(pa.array(at)), some.column(1).take(pa.array(at)), pa.nulls(len(at), pa.int64()), bits]
                    for n_ in range(blocks):
                        same = [pa.array(np.full(len(at), v)) for v in (int(first[p]) + n_, p, n_)]
                        yield pa.RecordBatch.from_arrays([same[0], same[1], same[2].cast(pa.int32()), pa.array(np.ones(len(at), bool)), *rest], names=["cell", "part", "block", "q", "id", "x", "leaf", "bits"])

    def by_leaf(values: np.ndarray) -> F.Column:
        return F.expr(f"array({', '.join(f'{v}L' for v in values.tolist())})")[F.col("leaf").cast("int")]

    tree_leaves = tree.leaves
    asked = queries.mapInArrow(tidied(visit), f"cell long, part long, block int, q boolean, id long, x {kind}, leaf long, bits binary")
    if not parts:
        part_of, first, n_blocks = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64)
    there = rows.withColumn("part", by_leaf(part_of)).withColumn("block", F.pmod(F.xxhash64("id"), by_leaf(n_blocks[part_of])).cast("int")).select(
        (by_leaf(first[part_of]) + F.col("block")).alias("cell"), "part", "block", F.lit(False).alias("q"), "id", "x", "leaf", F.lit(None).cast("binary").alias("bits"))
    cells = there.unionByName(asked).repartitionById(max(1, int(n_blocks.sum())), F.col("cell").cast("int")).sortWithinPartitions("part", "block", "q", "id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each query in each block of a part."""
        now = part = None
        for cid, cx, cleaf, _, qid, qx, _, bits in _cells(batches, d, dtype):
            if cid is not now:
                now = cid
                leaves = parts[part_of[cleaf[0].as_py()]][0]
                part = Part(cid, cx, cleaf.to_numpy(), leaves, k)
            for a in range(0, len(qid), SLICE):
                some = slice(a, a + SLICE)
                visited = np.frombuffer(b"".join(bits[some].to_pylist()), np.uint8).reshape(len(qid[some]), -1)
                r, i, s = part.search(qid[some], qx[some].astype(np.float64), np.unpackbits(visited, axis=1)[:, : len(leaves)].astype(bool))
                own, n = np.unique(r, return_counts=True)
                if len(own):
                    pairs = pa.StructArray.from_arrays([pa.array(-s), pa.array(i)], names=["s", "id"])
                    n = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(qid[some][own]), pa.ListArray.from_arrays(n, pairs)], names=["query_id", "n"])

    got = cells.select("part", "block", "q", "id", "x", "leaf", "bits").mapInArrow(tidied(score), "query_id long, n array<struct<s: double, id: long>>")
    top = got.groupBy("query_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("n")))), 1, k).alias("n"))
    return top.select("query_id", F.posexplode("n").alias("rank", "n")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias(id_col), (-F.col("n.s")).alias("score"),
        F.lit(visits).alias("n_visited"))


def _cells(batches: Iterator[pa.RecordBatch], d: int, dtype: type = np.float64) -> Iterator[tuple]:
    """(ids, vectors, further columns) of the candidates of each run of equal (part, block), and of some of its queries
    at a time.

    Candidates stand before queries; they are at most about a block and are held, queries pass by batches however many
    they are. Repeated candidates that stand side by side are one.
    """
    now, held, cell = None, [], None
    for b in batches:
        key = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)], 1)
        if not len(key):
            continue
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
        ids, x, q = b.column(3).to_numpy(), matrix(b.column(4), d, dtype), b.column(2).to_numpy(zero_copy_only=False)
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            if tuple(key[a]) != now:
                now, held, cell = tuple(key[a]), [], None
            m = a + int((~q[a:e]).sum())
            if m > a:
                held.append((ids[a:m], x[a:m], *(c.slice(a, m - a) for c in b.columns[5:])))
            if m < e and held:
                if cell is None:
                    i, v, *rest = zip(*held, strict=True)
                    i, v, held = np.concatenate(i), np.concatenate(v), [()]
                    again = np.zeros(len(i), bool)  # repeated rows stand side by side
                    again[1:] = (i[1:] == i[:-1]) & (v[1:] == v[:-1]).all(1)
                    rest = [pa.concat_arrays(c) for c in rest]
                    cell = (i[~again], v[~again], *(c.filter(pa.array(~again)) for c in rest)) if again.any() else (i, v, *rest)
                yield *cell, ids[m:e], x[m:e], *(c.slice(m, e - m) for c in b.columns[5:])
