"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions. For every context of 0 to DEPTH bytes and every prefix of decisions there is a node
with the numbers of zeros and ones that followed it in the training texts. A node's own estimate is Krichevsky and
Trofimov's; its weighted probability is half its own estimate and half the product of its children's weighted
probabilities, the children being the contexts one byte longer. The predictive probability of a bit thus mixes the
estimates along its context path, each node's share being the posterior of stopping there; contexts that training never
saw predict 1/2. Counts are those of the training texts alone, so the model is fixed while it scores, and a byte's
probability depends on the DEPTH bytes before it only. Texts are whole, with A-Z lower-cased; before a text stand
DEPTH bytes 0xFF and after it the end symbol 0xFE, which is scored too, so a score is the log10 probability of one
text among all texts.

How it is spread: (DEPTH+1)-grams are counted per task in numpy and summed by a shuffle, so what is gathered grows with
the corpus. Grams are grouped by the last three bytes of context: at most 256**3 grams a group, whose nodes of depth 3
and more are worked out together in numpy. Nodes of depth 2 and less are at most 2**24 by construction and are worked
out on the driver. The log probability of each gram goes into a table; texts look their grams up in it, by broadcast
up to `BROADCAST_ROWS` grams and by a shuffled join beyond, with equal results. Words of the base model likewise.

Null texts count as empty: the end symbol alone. Repeated rows are scored each. Without training texts every bit is
1/2 and every word unknown. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lookup, Workspace, id_crc, lower_az, mix, space_table, text_blocks, word_bounds, word_hashes

DEPTH, UPPER = 5, 2
PAD, END = 0xFF, 0xFE
#: Up to so many grams or words a table is broadcast: 16 bytes each, 192 MB at most.
BROADCAST_ROWS = 12_000_000
_LOWER, _SPACE = lower_az(), space_table()
#: The end of a text is a word of the base model; no word has this hash but by chance of 2**-64.
END_WORD = int(mix(np.array([0xE0D], np.uint64)).view(np.int64)[0])
_I64 = np.int64


def block_grams(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all texts of a block, in order, and how many each text has: its bytes and the end."""
    sep = bytes([END]) + bytes([PAD]) * DEPTH
    b = np.frombuffer(bytes([PAD]) * DEPTH + sep.join(raws) + bytes([END]), np.uint8)
    b = _LOWER[b].astype(_I64)
    g = np.zeros(len(b) - DEPTH, _I64)
    for k in range(DEPTH + 1):
        g <<= 8
        g |= b[k : k + len(g)]
    n = np.array([len(r) + 1 for r in raws], _I64)
    starts = np.cumsum(n + DEPTH) - n - DEPTH
    keep = np.ones(len(g), bool)
    if len(raws) > 1:
        keep[(starts[1:, None] - DEPTH + np.arange(DEPTH)[None]).ravel()] = False
    return g[keep], n


def block_words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts of a block, in order, and how many each text has, the end not counted."""
    b = _LOWER[np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)]
    s, e = word_bounds(b, _SPACE)
    h = word_hashes(b, s, e).view(_I64)
    ends = np.cumsum([len(r) + 1 for r in raws])
    return h, np.diff(np.searchsorted(s, ends, "right"), prepend=0)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return k, np.bincount(inv, weights=np.concatenate([p[1] for p in parts]), minlength=len(k)).astype(_I64)


def count_keys(docs: DataFrame, split: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], end: int | None) -> DataFrame:
    """(key, c, a): occurrences of each key in training rows and in all rows of (text, train)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held[0]:
                k, a = _merge(held[0])
                c = np.zeros(len(k), _I64)
                if held[1]:
                    tk, tc = _merge(held[1])
                    c[np.searchsorted(k, tk)] = tc
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.array(a)], names=["key", "c", "a"])
            held[0], held[1] = [], []

        for batch in batches:
            texts, train = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool)
            for first, past, raws in text_blocks(texts, 1 << 20):
                key, n = split(raws)
                t = train[first:past]
                if end is not None:
                    held[0].append((np.array([end], _I64), np.array([len(raws)], _I64)))
                    held[1].append((np.array([end], _I64), np.array([int(t.sum())], _I64)))
                held[0].append(np.unique(key, return_counts=True))
                held[1].append(np.unique(key[np.repeat(t, n)], return_counts=True))
                size += len(held[0][-1][0])
                if size > 1_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(run, "key long, c long, a long").groupBy("key").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


# ---- the tree ----

_LGAMMA: list[np.ndarray] = []


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2), by table for small n, by Stirling's series beyond."""
    if not _LGAMMA:
        _LGAMMA.append(np.concatenate([[math.lgamma(0.5)], math.lgamma(0.5) + np.cumsum(np.log(np.arange(0, 4095) + 0.5))]))
        _LGAMMA.append(np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4096)))]))
    x = n + 0.5
    return np.where(n < 4096, _LGAMMA[0][np.minimum(n, 4095)], _stirling(np.maximum(x, 8)))


def _lgamma_one(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1)."""
    _lgamma_half(n[:0])
    return np.where(n < 4096, _LGAMMA[1][np.minimum(n, 4095)], _stirling(np.maximum(n + 1.0, 8)))


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return _lgamma_half(n0) + _lgamma_half(n1) - _lgamma_one(n0 + n1) - math.log(math.pi)


def bit_nodes(ctx: np.ndarray, sym: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (context << 8 | prefix, the prefix with a leading 1) with their zeros and ones; sorted."""
    keys, bits = [], []
    for k in range(8):
        prefix = (sym | 256) >> (8 - k)
        keys.append((ctx << 8) | prefix)
        bits.append((sym >> (7 - k)) & 1)
    key, bit, c = np.concatenate(keys), np.concatenate(bits), np.tile(c, 8)
    node, inv = np.unique(key, return_inverse=True)
    n1 = np.bincount(inv, weights=c * bit, minlength=len(node)).astype(_I64)
    return node, np.bincount(inv, weights=c, minlength=len(node)).astype(_I64) - n1, n1


class Level:
    """Nodes of one depth: log of the weighted probability, share of the own estimate, and its predictions."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.node = node
        own = log_kt(n0, n1)
        if below is None:  # no longer contexts
            self.w, self.log_pw = np.ones(len(node)), own
        else:
            self.w = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
            self.log_pw = np.logaddexp(own, below) - math.log(2)
        self.p1 = (n1 + 0.5) / (n0 + n1 + 1)

    def up(self, nodes: np.ndarray, depth: int) -> np.ndarray:
        """Sum of the log weighted probabilities over each parent in `nodes`: contexts are shortened to `depth` bytes."""
        parent = self.node & ((1 << (8 * depth + 8)) - 1)
        return np.bincount(np.searchsorted(nodes, parent), weights=self.log_pw, minlength=len(nodes))

    def mix(self, node: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Probability of a one at nodes, given what the longer contexts predict; those that aren't here pass 1/2."""
        if not len(self.node):
            return np.full(len(node), 0.5)
        i = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        return np.where(self.node[i] == node, self.w[i] * self.p1[i] + (1 - self.w[i]) * q, 0.5)


def _suffix(g: np.ndarray, c: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, inv = np.unique(g & ((1 << (8 * depth + 8)) - 1), return_inverse=True)
    return k >> 8, k & 255, np.bincount(inv, weights=c, minlength=len(k)).astype(_I64)


def lower_levels(g: np.ndarray, c: np.ndarray) -> list[Level]:
    """Levels UPPER+1 .. DEPTH of training grams that share their last UPPER+1 context bytes."""
    levels: list[Level] = []
    for depth in range(DEPTH, UPPER, -1):
        node, n0, n1 = bit_nodes(*_suffix(g, c, depth))
        levels.append(Level(node, n0, n1, levels[-1].up(node, depth) if levels else None))
    return levels[::-1]


def upper_levels(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> list[Level]:
    """Levels 0 .. UPPER from the sums at nodes of depth UPPER."""
    order = np.argsort(node)
    node, n0, n1 = node[order], n0[order], n1[order]
    levels = [Level(node, n0, n1, below[order])]
    for depth in range(UPPER - 1, -1, -1):
        short = levels[-1].node & ((1 << (8 * depth + 8)) - 1)
        k, inv = np.unique(short, return_inverse=True)
        s0, s1 = (np.bincount(inv, weights=x, minlength=len(k)).astype(_I64) for x in (n0, n1))
        levels.append(Level(k, s0, s1, levels[-1].up(k, depth)))
        n0, n1 = s0, s1
    return levels[::-1]


def gram_log10(g: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 of the probability of each gram's last byte after its context; levels from depth 0 up."""
    sym, out = g & 255, np.zeros(len(g))
    for k in range(8):
        prefix = (sym | 256) >> (8 - k)
        q = np.full(len(g), 0.5)
        for depth in range(DEPTH, -1, -1):
            ctx = (g >> 8) & ((1 << (8 * depth)) - 1)
            q = levels[depth].mix((ctx << 8) | prefix, q)
        out += np.log10(np.where((sym >> (7 - k)) & 1, q, 1 - q))
    return out


def gram_table(ws: Workspace, grams: DataFrame) -> DataFrame:
    """(key, v): log10 probability of each gram of (key, c)."""
    top = F.shiftright("key", 8).bitwiseAND((1 << 24) - 1)
    parts = max(1, min(1 << 16, -(-grams.count() // 100_000)))
    # whole groups of the last three context bytes; a task works out many of them at once
    grouped = grams.repartition(parts, top)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, c in _grouped(batches):
            t = c > 0
            if t.any():
                low = lower_levels(g[t], c[t])[0]
                k, s = _suffix(g[t], c[t], UPPER), None
                node, n0, n1 = bit_nodes(*k)
                s = low.up(node, UPPER)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, n0, n1, s)], names=["node", "n0", "n1", "s"])

    sums = grouped.mapInArrow(nodes, "node long, n0 long, n1 long, s double").groupBy("node").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("s").alias("s")).toArrow()  # 2**24 nodes at most
    upper = upper_levels(*(sums[x].to_numpy() for x in ("node", "n0", "n1", "s")))
    shared = ws.spark.sparkContext.broadcast([(x.node, x.w, x.p1) for x in upper])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = []
        for node, w, p1 in shared.value:
            level = Level.__new__(Level)
            level.node, level.w, level.p1 = node, w, p1
            top.append(level)
        for g, c in _grouped(batches):
            t = c > 0
            v = gram_log10(g, top + lower_levels(g[t], c[t]))
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(v)], names=["key", "v"])

    return ws.stage(grouped.mapInArrow(values, "key long, v double"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if sum(len(x[0]) for x in got):
        yield np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])


# ---- scoring ----

def _looked_up(docs: DataFrame, probs: DataFrame, base: DataFrame | None) -> DataFrame:
    """docs (id, held_out, text) with score, w, w_n, w_known: each text's grams and words are looked up in broadcast tables.

    Without a base model words count nothing.
    """
    spark, with_words = docs.sparkSession, base is not None
    g = probs.select("key", "v").toArrow()
    w = base.select("key", "v", "known").toArrow() if with_words else pa.table({"key": pa.array([], pa.int64()), "v": pa.array([], pa.float64()), "known": pa.array([], pa.bool_())})
    column = lambda t, c: np.ascontiguousarray(t[c].to_numpy())
    shared = spark.sparkContext.broadcast([(column(t, "key"), column(t, "v")) for t in (g, w)] + [column(w, "known")])
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    names = [c for c in docs.columns if c != "text"]
    del g, w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (gk, gv), (wk, wv), known = shared.value
        grams, words = Lookup(gk, gv), Lookup(wk, wv)

        def sums(out: np.ndarray, n: np.ndarray, x: np.ndarray) -> None:
            full = np.flatnonzero(n)
            if len(full):
                out[full] = np.add.reduceat(x, (np.cumsum(n) - n)[full])

        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            score, w, w_n, w_known = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), _I64), np.zeros(len(texts), _I64)
            for first, past, raws in text_blocks(texts, 1 << 19):
                key, n = block_grams(raws)
                i = grams.find(key)
                if i.min(initial=0) < 0:
                    raise ValueError("a key that was not counted")
                sums(score[first:past], n, gv[i])
                if not with_words:
                    continue
                key, m = block_words(raws)
                j = words.find(key)
                if j.min(initial=0) < 0:
                    raise ValueError("a key that was not counted")
                sums(w[first:past], m, wv[j])
                sums(w_known[first:past], m, known[j].astype(_I64))
                w_n[first:past] = m
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), *map(pa.array, (score, w, w_n, w_known)),
                                              pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64())],
                                             names=[*names, "score", "w", "w_n", "w_known", "n_bytes"])

    return docs.mapInArrow(run, ", ".join([*kinds, "score double, w double, w_n long, w_known long, n_bytes long"]))


def _joined(docs: DataFrame, probs: DataFrame, base: DataFrame, grams_too: bool = True) -> DataFrame:
    """The same by shuffled joins of each text's counted grams and words; docs has a row id `rid`.

    Without `grams_too` the grams, several times as many as words, are looked up in a broadcast table and only words are
    shuffled.
    """

    def counted(split) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rid = b.column(0).to_numpy()
                for first, _, raws in text_blocks(b.column(1).to_pylist(), 1 << 19):
                    key, n = split(raws)
                    at = 0
                    for i, k in enumerate(n):
                        u, c = np.unique(key[at : at + k], return_counts=True)
                        at += k
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), rid[first + i])), pa.array(u), pa.array(c)], names=["rid", "key", "c"])

        return docs.select("rid", "text").mapInArrow(run, "rid long, key long, c long")

    w = counted(block_words).join(base, "key").groupBy("rid").agg(
        F.sum(F.col("c") * F.col("v")).alias("w"), F.sum("c").alias("w_n"), F.sum(F.when(F.col("known"), F.col("c")).otherwise(0)).alias("w_known"))
    if not grams_too:
        return _looked_up(docs, probs, None).drop("w", "w_n", "w_known").join(w, "rid", "left").fillna(0, ["w", "w_n", "w_known"])
    g = counted(block_grams).join(probs, "key").groupBy("rid").agg(F.sum(F.col("c") * F.col("v")).alias("score"))
    out = docs.join(g, "rid", "left").join(w, "rid", "left").fillna(0, ["score", "w", "w_n", "w_known"])
    return out.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 5, held: int = 1,
              broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row.

    Learns from the rows outside the held-out fold of crc32(id as text) mod `folds`.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "lm")
    out = F.pmod(id_crc(id_col), F.lit(folds)) == held
    rows = docs.select(F.col(id_col).alias("id"), out.alias("held_out"), F.col(text_col).alias("text"))
    told = rows.select("text", (~F.col("held_out")).alias("train"))

    grams = ws.stage(count_keys(told, block_grams, None).select("key", "c"))
    probs = gram_table(ws, grams)
    words = ws.stage(count_keys(told, block_words, END_WORD).select("key", "c"))
    n, v, n_words = words.agg(F.sum("c"), F.sum(F.when(F.col("c") > 0, 1)), F.count("*")).first()
    n, v = int(n or 0), int(v or 0)
    low = math.log10(n + 0.5 * (v + 1))
    base = words.select("key", (F.log10(F.col("c") + 0.5) - F.lit(low)).alias("v"), (F.col("c") > 0).alias("known"))
    end_c = words.where(F.col("key") == END_WORD).select("c").first()
    end_c = int(end_c["c"]) if end_c else 0

    n_grams = probs.count()
    if max(n_grams, n_words) <= broadcast_rows:
        got = _looked_up(rows, probs, base)
    else:  # the joins need a row id that a retry can't change
        got = _joined(ws.stage(rows.withColumn("rid", F.monotonically_increasing_id())), probs, base, n_grams > broadcast_rows)
    return got.select(
        F.col("id").alias(id_col), "held_out", (F.col("w_n") + 1).cast("long").alias("n_tokens"),
        (F.col("w_known") + F.lit(1 if end_c else 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("w") + F.lit(math.log10(end_c + 0.5) - low)).alias("base_score"), "score", "n_bytes",
        (-F.col("score") * F.lit(math.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
