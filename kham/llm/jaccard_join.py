"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document's set holds the 64-bit hashes of its distinct n-word shingles. Documents with equal sets form a class (a
64-bit hash of the set); classes are compared once, whatever the number of copies.

1. *Co-location without loss.* Sets of n and m shingles that link differ in at most D = (1-t)/(1+t) * (n+m) shingles.
   At a level (a range of sizes around the larger one) shingles are dealt to s shards by hash; at most D shards differ. A
   class emits the signatures (sums of hashes) of its D + 1 fullest shards, ties by signature: the first shard that both
   share in that order is among those of either, if s - D shards are more than are empty. A class with too many empty
   shards emits all full ones, and goes on under further salts; two linked classes meet unless both do so, and then they
   meet under the next salt; after the last one they meet in a common list. A class emits for each level that its larger
   partners may be in.
2. Most signatures occur once. So they travel packed, some seven bytes each: a task sorts its signatures, cuts them into
   ranges and sends an array a range. A signature that many classes of a task share goes as one entry, and its members
   wait as rows for its head; so no signature, however common, gathers in one task. Where a range holds a signature
   twice, the least class is the *head* of the others; a block is all members of a head.
3. *T-occurrence search* over inverted lists of shingles: a record needs T = t*n of its lists to hold a partner. The L
   longest lists are set aside, the short ones are heap-merged, and records that occur T - L times are probed in the
   long lists by binary search (DivideSkip); the overlap required by both sizes decides. Large components have their own
   indexes and need one hit; records already known to be connected are skipped.
4. First each class meets only the head with which it shares most signatures, so its set travels once. Blocks whose
   members are then connected, and those of two members, are done. The others are searched whole; large ones are dealt into chunks: what isn't
   connected to the head is searched against all chunks. So no block is gathered in one task, and no pair is lost.
5. Components of the links, by joins.

Null texts and texts without words have an empty set, link with nothing and are their own component. Very long texts are
taken whole. Repeated rows and ids are kept; a component's id is the least id in it, rows with null ids have one only if
another row of their component has. Other columns, whatever their names, are left alone. An empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import heapq
import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Workspace, components, crosswise, lower_az, mix, runs, sized, space_table, text_blocks, tidied, word_bounds, word_hashes

_LOWER, _SPACE = lower_az(), space_table()
_U64, _I64 = np.uint64, np.int64
SALTS = 4
#: Members of a block, and shingles of theirs, that one task searches at once.
CHUNK, CHUNK_SHINGLES = 2000, 400_000
#: Records of a component from which it has an index of its own.
LARGE = 16
#: A task's signatures and classes that are packed at once; members from which a signature's wait as rows.
FLUSH, FLUSH_CLASSES, COMMON = 4_000_000, 32_000, 64
#: Bytes of text whose signatures one range holds; low bits of a signature within its range.
RANGE_BYTES, LOW = 16 << 20, 40
#: The cost ratio of DivideSkip's rule for the number of long lists, as published.
MU = 0.0085
_MULT = [_U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(raws: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    b = _LOWER[np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)]
    s, e = word_bounds(b, _SPACE)
    w = word_hashes(b, s, e)
    past = np.searchsorted(s, np.cumsum([len(r) + 1 for r in raws]), "right")
    out, at = [], 0
    if len(w) >= width:
        h = np.zeros(len(w) - width + 1, _U64)
        for k in range(width):
            h += mix(w[k : k + len(h)] + _U64(k)) * _MULT[k % 5]
        h = mix(h)
    for p in past:
        n = p - at
        if n >= width:
            out.append(np.unique(h[at : p - width + 1]))
        elif n:
            x = np.array([n], _U64)
            for k in range(n):
                x = mix(x * _MULT[k % 5] + w[at + k : at + k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, _U64))
        at = p
    return out


def most_apart(n: int, m: int, t: int) -> int:
    """The most shingles in which linked sets of n and m can differ; t in hundredths."""
    return (100 - t) * (n + m) // (100 + t)


def required(n: int, m: int, t: int) -> int:
    """The least overlap with 100 * overlap >= t * union."""
    return -(-t * (n + m) // (100 + t))


#: Least sizes of the levels: each is about the square root of two of the one before.
LEVELS = sorted({math.isqrt(1 << k) + (math.isqrt(1 << k) ** 2 < 1 << k) for k in range(96)})


@functools.cache
def shards_of(level: int, t: int) -> int:
    """Shards of a level: as few as leave the largest sets of it, but rarely, more full ones than linked sets differ in."""
    n = LEVELS[level + 1] - 1
    apart = most_apart(n, n, t)
    s = apart + 2
    while s < 4 * n + 4 and s * (1 - math.exp(-n / s)) < apart + 1 + 3 * math.sqrt(s * math.exp(-n / s)):
        s += 1 + s // 32
    return s


def signatures(h: np.ndarray, t: int) -> np.ndarray:
    """Signatures under which every set that links with this one meets it."""
    n = len(h)
    if not n:
        return np.zeros(0, _I64)
    farthest = 100 * n // t
    out = []
    for at in range(bisect_right(LEVELS, n) - 1, bisect_right(LEVELS, farthest)):
        partner = min(farthest, LEVELS[at + 1] - 1)  # the largest size that meets this one at the level
        s, apart = shards_of(at, t), most_apart(n, partner, t)
        for salt in range(SALTS):
            x = mix(h + np.array([at + 1], _U64) * _MULT[salt])
            shard = (x % _U64(s)).astype(_I64)
            size = np.bincount(shard, minlength=s)
            order = np.argsort(shard, kind="stable")
            full = np.flatnonzero(size)
            sums = np.add.reduceat(x[order], (np.cumsum(size) - size)[full])
            sig = mix(sums + _MULT[4] * (full.astype(_U64) + _U64((at * SALTS + salt) << 32)))
            if len(full) > apart + 1:
                sig = sig[np.lexsort((sig, -size[full]))[: apart + 1]]
            out.append(sig)
            if len(full) > apart:
                break
        else:
            out.append(mix(np.array([0xFA11 + at], _U64)))
    return np.concatenate(out).view(_I64)


def class_of(h: np.ndarray) -> int:
    return int(mix(np.array([mix(h).sum(dtype=_U64) + _U64(len(h))], _U64)).view(_I64)[0])


class Index:
    """Inverted lists of a block's records, sorted by their numbers."""

    def __init__(self):
        self.lists: dict[int, list[int]] = {}

    def add(self, record: int, shingles: list[int]) -> None:
        for x in shingles:
            insort(self.lists.setdefault(x, []), record)

    def drop(self, record: int, shingles: list[int]) -> None:
        for x in shingles:
            self.lists[x].remove(record)

    def search(self, shingles: list[int], sizes: list[int], t: int, size: int | None = None) -> Iterator[int]:
        """Records whose Jaccard with the given set is at least t hundredths, by DivideSkip.

        `size`: the set's size, if `shingles` leaves out those that no record can hold.
        """
        n = len(shingles) if size is None else size
        least = -(-t * n // 100)
        lists = [x for s in shingles if (x := self.lists.get(s))]
        if len(lists) < least:
            return
        lists.sort(key=len)
        longest = len(lists[-1])
        apart = min(int(least / (MU * math.log2(longest + 1) + 1)), least - 1)
        short, long_ = lists[: len(lists) - apart], lists[len(lists) - apart :]
        need, last, count = least - apart, -1, 0
        for r in heapq.merge(*short, (1 << 62,)):
            if r == last:
                count += 1
                continue
            if last >= 0 and count >= need and self._probe(last, count, long_, required(n, sizes[last], t), min(n, sizes[last])):
                yield last
            last, count = r, 1

    @staticmethod
    def _probe(record: int, count: int, lists: list[list[int]], need: int, most: int) -> bool:
        left = len(lists)
        if need > most:
            return False
        for x in lists:
            if count >= need or count + left < need:
                break
            i = bisect_left(x, record)
            count += i < len(x) and x[i] == record
            left -= 1
        return count >= need


def search_block(sets: list[np.ndarray], t: int, labels: list[int]) -> list[tuple[int, int]]:
    """Links that connect what the block's records connect; records with equal labels are known to be connected.

    Each large component, and that of the first record, has an index of its own: it needs one hit and no search at all
    by records connected to it. All other records share one index. Shingles that a single record holds are in no list:
    they can't add to an overlap.
    """
    sizes = [len(x) for x in sets]
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    fresh = np.r_[True, ranked[1:] != ranked[:-1]]
    name = np.empty(len(flat), np.int64)
    name[order] = np.cumsum(fresh) - 1
    common = np.bincount(name)[name] > 1
    lists, at = [], 0
    for n in sizes:
        lists.append(name[at : at + n][common[at : at + n]].tolist())
        at += n
    up = list(range(len(sets)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    links = []
    homes: list[tuple[int, Index]] = []
    rest, loose = Index(), {}  # the shared index, and its records by root

    def unite(a: int, b: int) -> bool:
        a, b = sorted((root(a), root(b)))
        if a != b:
            up[b] = a
            if b in loose:
                loose.setdefault(a, []).extend(loose.pop(b))
        return a != b

    def settle(i: int) -> None:
        """Indexes a record in its component's index; records of the shared index move there too."""
        r = root(i)
        home = next((x for f, x in homes if root(f) == r), None)
        moving = loose.get(r, [])
        if home is None and (not i or len(moving) >= LARGE):
            homes.append((i, home := Index()))
        if home is None:
            rest.add(i, lists[i])
            loose.setdefault(r, []).append(i)
            return
        for j in loose.pop(r, ()):
            rest.drop(j, lists[j])
            home.add(j, lists[j])
        home.add(i, lists[i])

    first: dict[int, int] = {}
    for i, shingles in enumerate(lists):
        unite(i, first.setdefault(labels[i], i))
        for f, home in homes:
            if root(f) != root(i):
                hit = next(home.search(shingles, sizes, t, sizes[i]), None)
                if hit is not None and unite(i, hit):
                    links.append((i, hit))
        for j in rest.search(shingles, sizes, t, sizes[i]):
            if unite(i, j):
                links.append((i, j))
        settle(i)
    return links


def _blocks(ws: Workspace, spread: DataFrame, t: int) -> DataFrame:
    """(a, b): links found in each cell of (h, cell, cls, l, set); classes with equal l are connected already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, (_, cls, label, data) in runs(batches, 2):
            cls, label = cls.to_pylist(), label.to_pylist()
            one = [i for i, c in enumerate(cls) if not i or c != cls[i - 1]]  # without repeated rows
            if len({label[i] for i in one}) > 1:
                sets = [np.frombuffer(data[i].as_buffer(), _U64) for i in one]
                out.extend((cls[one[i]], cls[one[j]]) for i, j in search_block(sets, t, [label[i] for i in one]))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    ordered = spread.withColumn("last", F.col("cls") != F.col("h")).repartition(crosswise(ws.spark), "h", "cell").sortWithinPartitions("h", "cell", "last", "cls")
    return ws.stage(ordered.select("h", "cell", "last", "cls", "l", "set").mapInArrow(tidied(run), "a long, b long"), rows=1000)


class Packets:
    """A task's signatures, packed by range: the low bits of each, and which of the packet's classes has it."""

    def __init__(self, bits: int):
        self.bits, self.sigs, self.cls, self.n, self.size = bits, [], [], [], 0

    def add(self, cls: int, n: int, sigs: np.ndarray) -> None:
        self.sigs.append(sigs)
        self.cls.append(cls)
        self.n.append(n)
        self.size += len(sigs)

    def full(self) -> bool:
        return self.size > FLUSH or len(self.cls) >= FLUSH_CLASSES

    def flush(self) -> tuple[list[tuple[int, bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """[(range, packet)], (signatures, classes, sizes) of the rows that wait."""
        if not self.size:
            return [], tuple(np.zeros(0, _I64) for _ in range(3))
        order = np.argsort(self.cls)
        cls, n = np.array(self.cls, _I64)[order], np.array(self.n, _I64)[order]
        who = np.repeat(np.arange(len(cls), dtype=np.uint16), [len(self.sigs[i]) for i in order])
        key = np.concatenate([self.sigs[i] for i in order]).view(_U64) >> _U64(64 - LOW - self.bits)
        self.sigs, self.cls, self.n, self.size = [], [], [], 0
        o = np.argsort(key, kind="stable")  # classes ascend within a signature
        key, who = key[o], who[o]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[start, len(key)])
        many = np.repeat(count >= COMMON, count)
        lead = np.zeros(len(key), bool)
        lead[start] = True
        wait = many & ~lead
        rows = key[wait].view(_I64), cls[who[wait]], n[who[wait]]
        who[many & lead] |= 0x8000
        key, who = key[~wait], who[~wait]
        part = (key >> _U64(LOW)).astype(_I64)
        cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
        return [(int(part[a]), self._packet(key[a:e], who[a:e], cls, n)) for a, e in zip(cuts[:-1], cuts[1:], strict=True)], rows

    @staticmethod
    def _packet(key: np.ndarray, who: np.ndarray, cls: np.ndarray, n: np.ndarray) -> bytes:
        own, at = np.unique(who & 0x7FFF, return_inverse=True)
        at = at.astype(np.uint16) | (who & 0x8000)
        return b"".join((np.array([len(key), len(own)], np.uint32).tobytes(), (key & _U64(0xFFFFFFFF)).astype(np.uint32).tobytes(), ((key >> _U64(32)) & _U64(0xFF)).astype(np.uint8).tobytes(),
                         at.tobytes(), cls[own].tobytes(), n[own].astype(np.uint32).tobytes()))

    @staticmethod
    def read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(low bits, class, size, whether rows wait) of each entry."""
        m, k = np.frombuffer(data, np.uint32, 2).tolist()
        at = 8 + 5 * m
        low = np.frombuffer(data, np.uint32, m, 8).astype(_U64) | np.frombuffer(data, np.uint8, m, 8 + 4 * m).astype(_U64) << _U64(32)
        who, own = np.frombuffer(data, np.uint16, m, at), np.frombuffer(data, _I64, k, at + 2 * m)
        return low, own[who & 0x7FFF], np.frombuffer(data, np.uint32, k, at + 2 * m + 8 * k).astype(_I64)[who & 0x7FFF], who >= 0x8000


_MET = "h long, cls long, n long, c long, sig long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads and members of the signatures of each range: (h, cls, n, shared signatures); (h, sig) where rows wait."""
    for (part,), (packets,) in runs(batches, 1):
        key, cls, n, wait = (np.concatenate(x) for x in zip(*(Packets.read(p.as_buffer()) for p in packets), strict=True))
        o = np.lexsort((cls, key))
        key, cls, n, wait = key[o], cls[o], n[o], wait[o]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[start, len(key)])
        common = np.bitwise_or.reduceat(wait, start)
        met = np.repeat((cls[start] != cls[start + count - 1]) | common, count)
        again = np.r_[False, (key[1:] == key[:-1]) & (cls[1:] == cls[:-1])]  # a class in several tasks
        head, keep = np.repeat(cls[start], count), met & ~again
        h, c, n = head[keep], cls[keep], n[keep]
        o = np.lexsort((c, h))
        h, c, n = h[o], c[o], n[o]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])][: len(h)])
        shared = np.diff(np.r_[first, len(h)])
        sig = (key[start[common]] | _U64(part << LOW)).view(_I64)
        k, w = len(first), len(sig)
        if k + w:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[h[first], cls[start[common]]]), pa.concat_arrays([pa.array(c[first]), pa.nulls(w, pa.int64())]), pa.concat_arrays([pa.array(n[first]), pa.nulls(w, pa.int64())]),
                 pa.concat_arrays([pa.array(shared), pa.nulls(w, pa.int64())]), pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(sig)])], names=["h", "cls", "n", "c", "sig"])


def _signed(ws: Workspace, docs: DataFrame, width: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(id, th, n, cls) of every row, and the blocks (h, cls, n, c) of classes that share signatures."""
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(text_bytes // RANGE_BYTES, 2 * crosswise(ws.spark)).bit_length()
    kind = docs.schema["id"].dataType
    names = ["id", "th", "n", "cls", "part", "data", "sig"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        own, id_type = Packets(bits), None

        def flushed() -> Iterator[pa.RecordBatch]:
            packets, (sig, cls, n) = own.flush()
            size = 0
            for a in range(0, len(packets), 64):
                some = packets[a : a + 64]
                size = len(some)
                yield pa.RecordBatch.from_arrays([pa.nulls(size, id_type), *[pa.nulls(size, pa.int64())] * 3, pa.array([p for p, _ in some], pa.int64()),
                                                  pa.array([d for _, d in some], pa.binary()), pa.nulls(size, pa.int64())], names=names)
            for a in range(0, len(sig), 100_000):
                s = slice(a, a + 100_000)
                size = len(sig[s])
                yield pa.RecordBatch.from_arrays([pa.nulls(size, id_type), pa.nulls(size, pa.int64()), pa.array(n[s]), pa.array(cls[s]), pa.nulls(size, pa.int64()),
                                                  pa.nulls(size, pa.binary()), pa.array(sig[s])], names=names)

        for b in batches:
            id_type, n, cls = b.column(0).type, [], []
            for _, _, raws in text_blocks(b.column(2).to_pylist(), 1 << 19):
                for h in shingle_sets(raws, width):
                    n.append(len(h))
                    cls.append(class_of(h) if len(h) else None)
                    if len(h) and cls[-1] not in seen:
                        own.add(cls[-1], len(h), signatures(h, threshold))
                        if len(seen) < 200_000:  # only saves work: a class that emits again emits the same
                            seen.add(cls[-1])
                    if own.full():
                        yield from flushed()
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], names=names)
        yield from flushed()

    told = ws.stage(docs.select("id", "th", "text").mapInArrow(tidied(first), f"id {kind.simpleString()}, th long, n long, cls long, part long, data binary, sig long"), rows=2000)
    packets = told.where("part is not null").select("part", "data").repartition(crosswise(ws.spark), "part").sortWithinPartitions("part")
    met = ws.stage(packets.mapInArrow(tidied(_meet), _MET))
    waiting, heads = told.where("sig is not null").select("sig", "cls", "n"), met.where("sig is not null").select("sig", "h")
    pairs = met.where("cls is not null").select("h", "cls", "n", "c")
    n_heads = heads.count()
    if n_heads:
        pairs = pairs.union(waiting.join(F.broadcast(heads) if n_heads <= BROADCAST_ROWS else heads, "sig").select("h", "cls", "n", F.lit(1).cast("long")))
    pairs = ws.stage(pairs.groupBy("h", "cls").agg(F.max("n").alias("n"), F.sum("c").alias("c")))
    rows = ws.stage(told.where("part is null and sig is null").select("id", "th", "n", "cls"))
    ws.drop(told, met)
    return rows, pairs


def _sets(ws: Workspace, docs: DataFrame, classes: DataFrame, cells: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """(h, cell, cls, l, set) of cells (h, cell, cls, l): the shingles of one row of each class, made again from its text."""
    place = F.collect_list(F.struct("h", "cell", "l")).alias("at")
    wanted = ws.stage(classes.join(cells.groupBy("cls").agg(place), "cls").select(F.col("rep").alias("want"), "cls", "at"))
    size = wanted.agg(F.sum(F.size("at") + 1)).first()[0] or 0

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want, which = b.column(0).to_pylist(), []
            got = []
            for at, _, raws in text_blocks(b.column(1).to_pylist(), 1 << 19):
                for k, h in enumerate(shingle_sets(raws, width), at):
                    if len(h) and want[k] == class_of(h):
                        which.append(k)
                        got.append(h.tobytes())
            at = b.column(2).take(pa.array(which, pa.int64()))
            each = np.repeat(np.arange(len(which)), at.value_lengths().to_numpy(zero_copy_only=False)) if which else np.zeros(0, np.int64)
            place, cls = at.flatten(), b.column(0).take(pa.array(which, pa.int64()))
            for a in range(0, len(each), 256):  # a head of many cells is repeated
                some = pa.array(each[a : a + 256])
                yield pa.RecordBatch.from_arrays([place.field(0).slice(a, 256), place.field(1).slice(a, 256), cls.take(some), place.field(2).slice(a, 256), pa.array(got, pa.binary()).take(some)],
                                                 names=["h", "cell", "cls", "l", "set"])

    found = docs.select("id", "text").join(F.broadcast(wanted) if size <= broadcast_rows else wanted, F.col("id").eqNullSafe(F.col("want"))).select("cls", "text", "at")
    return found.mapInArrow(tidied(second), "h long, cell long, cls long, l long, set binary")


def _chunked(ws: Workspace, members: DataFrame, chunk: int, broadcast_rows: int) -> DataFrame:
    """members (h, cls, n, ...) with the number of chunks of their block and their own one."""
    big = members.groupBy("h").agg(F.ceil(F.greatest(F.count("*") / F.lit(chunk), F.sum("n") / F.lit(CHUNK_SHINGLES))).cast("int").alias("chunks")).where("chunks > 1")
    got = members.join(sized(ws.stage(big), broadcast_rows), "h", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    return got.withColumn("spot", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 4, threshold: int = 85, chunk: int = CHUNK,
                       broadcast_rows: int = BROADCAST_ROWS, per_text: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, n_copies) of every row; `threshold` in hundredths of the Jaccard similarity.

    n_copies is the number of rows with the same set. `per_text` adds text_hash (xxhash64 of the text), which tells rows
    of one id apart, and label, a number of the component that rows without an id have too.
    """
    ws = Workspace(docs.sparkSession, "jaccard")
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    rows, pairs = _signed(ws, docs, width, threshold)
    classes = ws.stage(rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies")))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)

    # each class and the head with which it shares most
    best = pairs.where("h <> cls").groupBy("cls").agg(F.max_by("h", F.struct("c", -F.col("h"))).alias("h"), F.max("n").alias("n"))
    best = ws.stage(best.select("h", "cls", "n"))
    heads = pairs.where("h = cls").join(best.select("h").distinct(), "h", "left_semi").select("h", "cls", "n")
    near = _chunked(ws, best.union(heads), chunk, broadcast_rows)
    cells = near.select("h", "cls", F.explode(F.when(F.col("cls") == F.col("h"), every).otherwise(F.array("spot"))).alias("cell"), F.col("cls").alias("l"))
    cells = cells.withColumn("cell", F.col("cell").cast("long"))
    links = _blocks(ws, _sets(ws, docs, classes, cells, width, broadcast_rows), threshold)
    labels = components(ws, links)

    # blocks that aren't connected yet, whole
    named = pairs.join(best.select("cls", F.col("h").alias("bh")), "cls", "left").select("h", "cls", "n", F.col("bh").eqNullSafe(F.col("h")).alias("met"))
    named = named.join(sized(labels.withColumnRenamed("node", "cls"), broadcast_rows), "cls", "left").withColumn("l", F.coalesce("component_id", "cls"))
    open_ = named.groupBy("h").agg(F.min("l").alias("lo"), F.max("l").alias("hi"), F.max(F.when(F.col("cls") == F.col("h"), F.col("l"))).alias("hl"),
                                      F.count("*").alias("k"), F.bool_or("met").alias("met")).where("lo < hi and not (k = 2 and met)").select("h", "hl")
    open_ = ws.stage(open_)
    named = ws.stage(named.join(sized(open_, broadcast_rows), "h").select("h", "cls", "n", "l", (F.col("l") != F.col("hl")).alias("loose")))
    if named.limit(1).count():
        dealt = ws.stage(_chunked(ws, named, chunk, broadcast_rows))
        whole = dealt.where("chunks = 1").select("h", "cls", F.lit(0).cast("long").alias("cell"), "l")
        big = dealt.where("chunks > 1")
        loose = ws.stage(big.where("loose").groupBy("h").agg(F.ceil(F.greatest(F.count("*") / F.lit(chunk), F.sum("n") / F.lit(CHUNK_SHINGLES))).cast("int").alias("parts")))
        big = big.join(sized(loose, broadcast_rows), "h")
        part = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("parts")).cast("int")
        # a loose member meets all chunks, every other member the parts of the loose ones
        again = big.withColumn("r", F.explode(F.when(F.col("loose"), F.array(part)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
        again = again.withColumn("c", F.explode(F.when(F.col("loose"), every).otherwise(F.array("spot"))))
        cross = again.select("h", "cls", (F.col("r").cast("long") * F.col("chunks") + F.col("c")).alias("cell"), "l")
        own = big.where("loose").withColumn("r", part)  # and the loose ones meet each other
        own = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
            "h", "cls", (-1 - F.least("r", "o").cast("long") * F.col("parts") - F.greatest("r", "o")).alias("cell"), "l")
        more = _blocks(ws, _sets(ws, docs, classes, whole.union(cross).union(own), width, broadcast_rows), threshold)
        if more.limit(1).count():
            labels = components(ws, links.union(more))

    comp = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("l", F.coalesce("component_id", "cls")).drop("component_id")
    least = comp.groupBy("l").agg(F.min("rep").alias("component_id"))
    comp = ws.stage(comp.join(least, "l").select("cls", "component_id", "n_copies", "l"))
    ws.keep_only(rows, comp)
    out = rows.join(sized(comp, broadcast_rows), "cls", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.col("th").alias("text_hash"), F.col("l").alias("label"))
    return out if per_text else out.drop("text_hash", "label")
