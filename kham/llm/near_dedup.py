"""Near-duplicate vectors by NN-descent.

0. Rows with equal unit vectors form a class, represented by its least id; classes are compared once, whatever the
   number of copies, and counts are weighted by it.
1. A k-means tree of a bounded sample deals classes to leaves; within blocks of a leaf every class gets its first k
   neighbours. Some 16 members of a leaf are in all its blocks, so that one group over many blocks stays connected.
2. NN-descent: neighbours and reverse neighbours of a row meet as candidates for each other (neighbours of neighbours);
   each keeps its k best; rounds go on until few lists change. Lists that are saturated - the last one still at the
   threshold - are enlarged fourfold and refined again. As longer lists may be full too, the rows of saturated lists are
   compared with those of other components, as far as the components' balls can touch; a link of a row whose list isn't
   saturated is in that list.
3. Edges at the threshold connect components. Within a component all members are compared exactly, in double precision,
   block against block, which gives each member's number of links and a spanning set of exact links; only counts and
   spanning links leave a block, so a group of m copies doesn't emit its m*m links.
4. Audit: the whole is done with a second tree and seed, and the rows that only the second graph links tell what share m
   one graph misses; so many independent graphs miss about that power of m. Up to `PROBES` rows of least hash, half of
   them with a link, are compared with all rows; each row with links to other vectors counts the same, whatever their
   number. While either recall is below `target`, another seed adds its edges. If it still is after `ROUNDS` graphs, all
   rows are compared exactly, which costs the square of the table. `audit_recall` is the lesser of both recalls.

Invalid vectors (see `valid_vectors`) link with nothing and are their own component. Rows that repeat an id are one node
with the links of all of them; equal rows count as each other's links. Null ids link with nothing. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, components, crosswise, runs
from .vectors import Tree, matrix, sample_rows, valid_vectors

FIT, LEAF, PROBES, ROUNDS = 16_384, 256, 256, 4
#: Rows of a leaf or of a component that meet in one task.
BLOCK = 2048
#: The packed vectors are broadcast up to this size, else joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vecs(column: pa.Array, kind, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, d)


def _best_pairs(ids: np.ndarray, v: np.ndarray, floor: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, similarity): of each row its k most similar others of the group, above its floor."""
    s = v @ v.T
    s[ids[:, None] == ids[None]] = -2
    if floor is not None:
        s[s <= floor[:, None]] = -2
    k = min(k, len(ids) - 1)
    at = np.argpartition(s, -k, 1)[:, -k:]
    got = np.take_along_axis(s, at, 1)
    r, c = np.nonzero(got > -2)
    return ids[r], ids[at[r, c]], got[r, c]


_EDGE = ["u", "v", "s"]


def _edge_batch(parts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=_EDGE)


def _streamed(df: DataFrame, keys: list[str], rest: list[str], work, schema: str) -> DataFrame:
    """work over each run of equal keys, in tasks that stream sorted rows."""
    return df.select(*keys, *rest).repartition(crosswise(df.sparkSession), *keys).sortWithinPartitions(*keys, rest[0]).mapInArrow(work, schema)


def _pairs_of_groups(df: DataFrame, keys: list[str], d: int, k: int, floors: bool) -> DataFrame:
    n_keys = len(keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for _, cols in runs(batches, n_keys):
            ids = cols[0].to_numpy()
            if len(ids) < 2:
                continue
            parts.append(_best_pairs(ids, _vecs(cols[1], np.float32, d), cols[2].to_numpy() if floors else None, k))
            size += len(parts[-1][0])
            if size > 20_000:
                yield _edge_batch(parts)
                parts, size = [], 0
        if parts:
            yield _edge_batch(parts)

    return _streamed(df, keys, ["id", "f", *(["floor"] if floors else [])], work, "u long, v long, s float")


def _keep(edges: DataFrame, k: int) -> DataFrame:
    """The k best of each list; repeated edges count once."""
    w = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return edges.groupBy("u", "v").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def _floors(g: DataFrame, k: int) -> DataFrame:
    """The similarity that a new neighbour must beat: the last one of a full list."""
    return g.groupBy("u").agg(F.min("s").alias("s"), F.count("*").alias("n")).select(
        F.col("u").alias("id"), F.when(F.col("n") >= k, F.col("s")).otherwise(F.lit(-1.5)).cast("float").alias("floor"))


def _reverse(g: DataFrame, k: int) -> DataFrame:
    """Up to about k reverse neighbours of each row, dealt by hash so that no row's are ordered in one task."""
    w = Window.partitionBy("v", F.pmod(F.xxhash64("u"), F.lit(4))).orderBy(F.desc("s"), "u")
    return g.withColumn("r", F.row_number().over(w)).where(F.col("r") <= -(-k // 4)).select(F.col("v").alias("w"), F.col("u").alias("id"))


def descend(ws: Workspace, g: DataFrame, packed: DataFrame, d: int, k: int, rounds: int, few: float) -> DataFrame:
    """Rounds of neighbours-of-neighbours joins on the staged graph g (u, v, s)."""
    for _ in range(rounds):
        near = g.select(F.col("u").alias("w"), F.col("v").alias("id")).union(_reverse(g, k)).union(
            g.select(F.col("u").alias("w"), F.col("u").alias("id")).distinct()).distinct()
        met = near.join(packed, "id").join(_floors(g, k), "id")
        new = _pairs_of_groups(met, ["w"], d, max(4, k // 2), True)
        nxt = ws.stage(_keep(g.unionByName(new), k))
        moved = nxt.join(g, ["u", "v"], "left_anti").count()
        n = nxt.count()
        ws.drop(g)
        g = nxt
        if moved <= few * n:
            break
    return g


def _component_cells(rows: DataFrame, sized: DataFrame, block: int) -> DataFrame:
    """(c, i, j, id, mine, x, m): members of each component in block i or j of it; cells need i <= j."""
    m = rows.join(sized, "c").withColumn("nb", F.ceil(F.col("size") / F.lit(block)).cast("int"))
    m = m.withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return m.select("c", F.least("b", "o").cast("long").alias("i"), F.greatest("b", "o").cast("long").alias("j"), F.col("b").cast("long").alias("mine"), "id", "x", "m")


def exact_in_components(ws: Workspace, rows: DataFrame, sized: DataFrame, d: int, threshold: float, block: int) -> DataFrame:
    """(id, n, to): of each class its links with other classes within a block pair, copies counted, and an edge of a spanning forest of those links."""
    cells = _component_cells(rows, sized, block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (_, i, j), (mine, ids, x, m) in runs(batches, 3):
            mine, ids, m = mine.to_numpy(), ids.to_numpy(), m.to_numpy()
            v = _vecs(x, np.float64, d)
            s = v @ v.T >= threshold
            np.fill_diagonal(s, False)
            if i != j:
                s &= mine[:, None] != mine[None]
            n, to = np.where(s, m[None], 0).sum(1), ids.copy()
            seen = np.zeros(len(ids), bool)
            for start in np.flatnonzero(n):
                if seen[start]:
                    continue
                seen[start], edge = True, [start]
                while edge:
                    a = edge.pop()
                    new = np.flatnonzero(s[a] & ~seen)
                    seen[new] = True
                    to[new] = ids[a]
                    edge += new.tolist()
            out.append((ids, n.astype(np.int64), to))
            if len(out) > 500:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "n", "to"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "n", "to"])

    return ws.stage(_streamed(cells, ["c", "i", "j"], ["mine", "id", "x", "m"], work, "id long, n long, to long"))


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of edges that span what all edges (a, b) connect."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (x := top(x)) != (y := top(y)):
            root[x] = y
            keep.append(i)
    return np.array(keep, np.int64)


def _touching(ids: np.ndarray, c: np.ndarray, v: np.ndarray, own: dict, low: float) -> list[np.ndarray]:
    """[(id, other id, label, other label)] of rows (ids, c, v) and rows of other labels of a chunk at `low` or above, one
    for each row and ball.

    The chunk `own` has its rows sorted by label, a ball for each label: a row is compared with the rows of a ball only if
    the angles allow a link.
    """
    centre = np.clip(v @ own["centre"].T, -1, 1)
    may = (np.arccos(centre) <= own["reach"][None]) & (c[:, None] != own["c"][None])
    out = []
    for k in np.flatnonzero(may.any(0)):
        at, cut = np.flatnonzero(may[:, k]), slice(own["start"][k], own["start"][k + 1])
        s = v[at] @ own["v"][cut].T
        best = s.argmax(1)
        hit = np.flatnonzero(s[np.arange(len(at)), best] >= low)
        if len(hit):
            out.append(np.stack([ids[at[hit]], own["ids"][cut][best[hit]], c[at[hit]], np.full(len(hit), own["c"][k])]))
    return out


def bridges(ws: Workspace, labelled: DataFrame, n: int, d: int, low: float, chunk_bytes: int) -> DataFrame:
    """(a, b): links that join what exact comparison of all rows (id, f, c) of different labels c would join.

    The rows are read in chunks of about `chunk_bytes`, each broadcast to all rows; of the links between labels only
    spanning ones leave a batch.
    """
    spark = ws.spark
    labelled = ws.stage(labelled.select("id", "f", "c"))
    chunks = max(1, -(-n * (4 * d + 16) // chunk_bytes))
    found = None
    for k in range(chunks):
        got = labelled.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(chunks)) == k).toArrow()
        ids, c, v = got["id"].to_numpy(), got["c"].to_numpy(), _vecs(got["f"], np.float32, d)
        if not len(ids):
            continue
        order = np.argsort(c, kind="stable")
        ids, c, v = ids[order], c[order], v[order]
        start = np.append(np.flatnonzero(np.append(True, c[1:] != c[:-1])), len(c))
        size = np.diff(start)
        centre = np.add.reduceat(v.astype(np.float64), start[:-1])
        norm = np.linalg.norm(centre, axis=1, keepdims=True)
        centre = np.where(norm > 1e-9, centre / np.maximum(norm, 1e-9), v[start[:-1]]).astype(np.float32)
        away = np.arccos(np.clip((v * np.repeat(centre, size, 0)).sum(1), -1, 1))
        reach = np.maximum.reduceat(away, start[:-1]) + math.acos(max(-1.0, min(1.0, low))) + 2e-3  # float32 angles near 0 are that coarse
        shared = spark.sparkContext.broadcast({"ids": ids, "c": c[start[:-1]], "v": v, "start": start, "centre": centre, "reach": reach})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            step = max(16, min(1024, (1 << 23) // len(own["c"])))
            for b in batches:
                parts = []
                for at in range(0, b.num_rows, step):
                    p = b.slice(at, step)
                    parts += _touching(p.column(0).to_numpy(), p.column(2).to_numpy(), _vecs(p.column(1), np.float32, d), own, low)
                if parts:
                    u, o, cu, co = np.concatenate(parts, 1)
                    keep = _forest(cu, co)
                    yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(o[keep])], names=["a", "b"])

        part = ws.stage(labelled.repartition(crosswise(spark)).mapInArrow(run, "a long, b long"))
        shared.unpersist()
        found = part if found is None else found.union(part)
    return labelled.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0) if found is None else found


def audit(rows: DataFrame, counted: DataFrame, d: int, threshold: float) -> float:
    """The mean share of its links with other vectors that a row has, of those that have any in a bounded set of rows."""
    linked = rows.join(counted.where("others > 0").select("id"), "id", "left_semi")
    half = PROBES // 2
    probes = {r["id"]: (bytes(r["x"])) for part, salt in ((linked, 5), (rows, 6)) for r in
              part.orderBy(F.xxhash64("id", F.lit(salt))).limit(half).select("id", "x").collect()}
    if not probes:
        return 1.0
    ids, q = np.array(list(probes)), np.frombuffer(b"".join(probes.values()), np.float64).reshape(-1, d)
    shared = rows.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                near = q @ _vecs(part.column(1), np.float64, d).T >= threshold
                total += np.where(near, part.column(2).to_numpy()[None], 0).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "t"])

    there = rows.select("id", "x", "m").mapInArrow(run, "id long, t long").groupBy("id").agg(F.sum("t").alias("t"))
    own = rows.groupBy("id").agg(F.sum("m").alias("own"))
    left = there.join(own, "id").select("id", (F.col("t") - F.col("own")).alias("t")).where("t > 0").join(counted, "id", "left")
    share = left.agg(F.avg(F.least(F.coalesce("others", F.lit(0)), "t") / F.col("t"))).first()[0]
    return 1.0 if share is None else float(share)


def still_missed(missed: float, graphs: int) -> float:
    """The share that `graphs` graphs miss together, if the last one has `missed` that the others, each as good, had not."""
    return missed ** (graphs / (graphs - 1)) if graphs > 1 else missed


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, threshold: float = 0.9,
                    k: int = 8, rounds: int = 4, few: float = 0.002, target: float = 0.99, block: int = BLOCK,
                    broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, n_links, component_id, kept, audit_recall) of every row of the table."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "nndescent")
    good, d = valid_vectors(vectors, id_col, vec_col)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _unit(matrix(b.column(1), d)) if b.num_rows else np.zeros((0, max(d, 1)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([r.tobytes() for r in v], pa.binary()),
                                              pa.array([r.tobytes() for r in v.astype(np.float32)], pa.binary())], names=["id", "x", "f"])

    every = ws.stage(good.mapInArrow(pack, "id long, x binary, f binary"))
    rows = ws.stage(every.groupBy("x", "f").agg(F.min("id").alias("id"), F.count("*").alias("m")).select("id", "x", "f", "m"))
    n = rows.count()
    packed = rows.select("id", "f").dropDuplicates(["id"])
    packed = F.broadcast(packed) if n * (4 * d + 32) <= broadcast_bytes else packed
    links, counted, recall = None, None, 1.0
    labels_of = lambda e: components(ws, e).select(F.col("node").alias("id"), F.col("component_id").alias("c"))
    low = float(threshold) - 1e-5

    def count(label: DataFrame) -> tuple[DataFrame, DataFrame]:
        sized = rows.join(label, "id").groupBy("c").agg(F.count("*").alias("size"))
        cells = exact_in_components(ws, rows.select("id", "x", "m").join(label, "id"), sized, d, threshold, block)
        others = cells.groupBy("id").agg(F.sum("n").alias("others"))
        copies = rows.groupBy("id").agg(F.sum(F.col("m") - 1).alias("copies"))
        return cells, ws.stage(copies.join(others, "id", "left").fillna(0, ["others"]).select("id", "others", (F.col("others") + F.col("copies")).alias("links")))

    for seed in range(ROUNDS if n > 1 else 0):
        _, sample = sample_rows(good, FIT, d, seed)
        tree = spark.sparkContext.broadcast(Tree(_unit(sample), max(8, LEAF * len(sample) // max(n, 1)), seed=seed))

        def place(batches: Iterator[pa.RecordBatch], tree=tree) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf = tree.value.leaf_of(_vecs(b.column(1), np.float32, d)) if b.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], names=["id", "f", "leaf"])

        leaves = rows.select("id", "f").mapInArrow(place, "id long, f binary, leaf long")
        leaves = ws.stage(leaves)
        part_size = max(256, block // 4)
        many = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(part_size)).alias("nb"))
        dealt = leaves.join(many, "leaf").withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("nb")))
        bridge = F.pmod(F.xxhash64("id", F.lit(seed + ROUNDS)), part_size // 16 * F.col("nb")) == 0
        dealt = dealt.withColumn("part", F.explode(F.when(bridge, F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).otherwise(F.array("part"))))
        g = ws.stage(_keep(_pairs_of_groups(dealt, ["leaf", "part"], d, k, False), k))
        g = descend(ws, g, packed, d, k, rounds, few)
        full = ws.stage(g.groupBy("u").agg(F.count("*").alias("n"), F.min("s").alias("s")).where(f"n >= {k} and s >= {low}").select("u"))
        n_full = full.count()
        near = g.where(F.col("s") >= low)
        if n_full:  # saturated lists: fourfold, among their own neighbours of neighbours
            sat = ws.stage(near.join(full, "u", "left_semi"))
            near = near.unionByName(descend(ws, sat, packed, d, 4 * k, 2, few).where(F.col("s") >= low))
        missed = 1.0
        if counted is not None:
            nodes = near.select("u").distinct()
            missed = nodes.join(counted.where("others > 0"), nodes["u"] == counted["id"], "left_anti").count() / max(1, nodes.count())
        found = near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        links = ws.stage((found if links is None else found.union(links)).distinct())
        label = labels_of(links)
        if n_full:
            dense = rows.select("id", "f").join(label, "id").join(full.withColumnRenamed("u", "id"), "id", "left_semi")
            more = bridges(ws, dense, n_full, d, low, broadcast_bytes)
            if more.limit(1).count():
                links = ws.stage(links.union(more).distinct())
                label = labels_of(links)
        cells, counted = count(label)
        ws.drop(g, leaves)
        recall = min(audit(rows, counted, d, threshold), 1 - still_missed(missed, seed + 1))
        if recall >= target:
            break
    else:
        if n > 1:
            known = rows.select("id", "f").join(label, "id", "left").withColumn("c", F.coalesce("c", "id"))
            label = labels_of(ws.stage(links.union(bridges(ws, known, n, d, low, broadcast_bytes)).distinct()))
            (cells, counted), recall = count(label), 1.0
    ids = vectors.select(F.col(id_col).alias("id"))
    if counted is None:
        counted = rows.select("id", (F.col("m") - 1).alias("links"))
        label = rows.select(F.col("id").alias("node"), F.col("id").alias("component_id"))
    else:
        label = components(ws, cells.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")))
    told = counted.join(label, counted["id"] == label["node"], "left").select(F.col("id").alias("rep"), "links", F.coalesce("component_id", "id").alias("c"))
    sized = lambda df, size, many: F.broadcast(df) if many * size <= broadcast_bytes else df
    groups = rows.where("m > 1").select("x", F.col("id").alias("rep"))
    members = every.select("id", "x").join(sized(groups, 8 * d + 32, groups.count()), "x").where("id <> rep").select(F.col("id").alias("copy"), "rep").distinct()
    out = ids.join(members, ids["id"] == members["copy"], "left").select("id", F.coalesce("rep", "id").alias("rep"))
    out = out.join(sized(told, 48, n), "rep", "left").select(
        "id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", F.col("id").cast("long")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"),
                      F.lit(round(recall, 4)).alias("audit_recall"))
