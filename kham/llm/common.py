"""What several operators of this subpackage share: staging in the cluster's shared folder, byte handling, hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of bytes outside these; the same set as `[\x20\x09-\x0D]`.
SPACES = b" \t\n\x0b\x0c\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset a folder of this machine, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = getattr(shared_folder, "own", None)
        if not named:
            shared_folder.own = named = "file://" + tempfile.mkdtemp(prefix="kham-shared-")
            atexit.register(__import__("shutil").rmtree, named[7:], ignore_errors=True)
    return named.rstrip("/")


class Workspace:
    """Staged tables of one query under the shared folder; a stage cuts the lineage and survives lost executors.

    ``drop`` removes a stage that no plan needs any more. What the query's result still reads is removed when the Python
    object of the result is gone, or when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n, self.staged = spark, 0, []
        self.root = f"{shared_folder(spark)}/kham-{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def stage(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """`rows`: so many rows an Arrow batch, for rows that are large."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        # shuffle files of a stage aren't needed once it is written
        own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} if rows else {})
        before = {k: self.spark.conf.get(k, None) for k in own}
        try:
            for k, v in own.items():
                self.spark.conf.set(k, v)
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)
        out = self.spark.read.schema(_nullable(df.schema)).parquet(path)
        out._kham_path = path
        self.staged.append(path)
        return out

    def drop(self, *stages: DataFrame) -> None:
        for df in stages:
            if path := getattr(df, "_kham_path", None):
                self._remove(path)

    def keep_only(self, *stages: DataFrame) -> None:
        """Removes all stages but these, which the result reads."""
        kept = {df._kham_path for df in stages}
        for path in self.staged:
            if path not in kept:
                self._remove(path)
        self.staged = [p for p in self.staged if p in kept]

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone when the driver ends
            pass


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Whole texts go to Python in smaller Arrow batches from now on: a batch is held several times over on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same pass over Arrow batches, which gives freed memory back to the machine at its end: Python workers stay for
    later tasks, and what one stage's arrays leave behind would stand beside the next one's."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return tidy


#: Up to so many rows a table of ids and the like is broadcast (a few longs each), else joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def sized(staged: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table, marked for broadcast if it has few rows; else adaptive execution decides and splits skewed keys."""
    return F.broadcast(staged) if staged.count() <= rows else staged


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list]]:
    """(key, columns) of each run of rows with equal first columns (longs); columns are lists of Arrow arrays."""
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(i).to_numpy() for i in range(n_keys)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            k = tuple(key[a].tolist())
            if now is not None and k != now:
                yield now, [pa.concat_arrays(c) for c in zip(*held, strict=True)]
                held = []
            now = k
            held.append([c.slice(a, e - a) for c in b.columns[n_keys:]])
    if held:
        yield now, [pa.concat_arrays(c) for c in zip(*held, strict=True)]


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def id_crc(col: str) -> F.Column:
    """crc32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def lower_az() -> np.ndarray:
    """A table of 256 bytes that lower-cases A to Z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(SPACES)] = True
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around silently."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _MIX)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, n at least."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(m, _BASE), np.full(m, inverse)
        up[0] = down[0] = 1
        have = _POWERS[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def word_bounds(b: np.ndarray, spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array that starts and ends with a space."""
    s = spaces[b]
    edge = np.flatnonzero(s[1:] != s[:-1]) + 1
    return edge[::2], edge[1::2]


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by differences of a prefix polynomial; equal words get equal hashes anywhere."""
    up, down = _powers(len(b) + 1)
    prefix = np.empty(len(b) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_BYTE_CODE[b] * up[: len(b)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_blocks(texts: list[str | None], limit: int = 1 << 21) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, past last, UTF-8 bytes) of runs of whole texts of about `limit` bytes; a longer text is alone."""
    first, size, held = 0, 0, []
    for i, t in enumerate(texts):
        raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield first, i, held
            first, size, held = i, 0, []
        held.append(raw)
        size += len(raw)
    if held:
        yield first, first + len(held), held


class Lookup:
    """Open-addressing table from 64-bit keys to values, all in numpy; built once, probed in bulk."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slot = np.full(1 << bits, -1, np.int32 if len(keys) < 2**31 - 1 else np.int64)
        self.keys, self.values = keys.astype(np.int64, copy=False), values
        todo, at = np.arange(len(keys)), self._home(self.keys)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key in the table's keys, -1 if it is not there."""
        keys = np.ascontiguousarray(keys, np.int64)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self._home(keys)
        out = self.slot[at].astype(np.int64)
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            got = self.slot[at].astype(np.int64)
            out[todo] = got
            more = (got >= 0) & (self.keys[got] != keys[todo])
            todo, at = todo[more], at[more]
        return out


def crosswise(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def components(ws: Workspace, edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """Connected components of an edge table as (node, component_id): the smallest node reachable.

    Each round every edge offers both ends the smaller of their labels and labels jump to their label's label; all by
    joins and minimum aggregates on tables that are written to the shared folder, so nothing gathers on the driver and
    no node's neighbours gather in one task. Empty edges give an empty table.
    """
    e = ws.stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    both = e.union(e.select(F.col("b"), F.col("a")))
    labels = ws.stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("l")))
    for _ in range(most):
        at = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("m"))
        hop = labels.select(F.col("node").alias("l"), F.col("l").alias("j"))
        # the label of the label, then the best of neighbours' labels; the old label's node learns the better one too
        new = labels.join(at, "node", "left").join(hop, "l", "left").select(
            "node", "l", F.least("l", "m", "j").alias("n"))
        new = ws.stage(new)
        told = new.where("n < l").groupBy(F.col("l").alias("node")).agg(F.min("n").alias("t"))
        nxt = ws.stage(new.join(told, "node", "left").select("node", F.least("n", "t").alias("l"), (F.least("n", "t") < F.col("l")).alias("moved")))
        moving = nxt.where("moved").limit(1).count()
        ws.drop(labels, new)
        labels = nxt
        if not moving:
            break
    else:
        raise RuntimeError("components did not settle")
    return labels.select("node", F.col("l").alias("component_id"))
