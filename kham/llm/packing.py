"""Hierarchical multi-length packing of tokenised documents.

Each document's ids (with an end id) are cut at whole windows of the longest tier; what is left over is routed to the
smallest context-size tier that holds it. Each tier is packed from the longest to the shortest: an item opens a window
of its tier, whole shorter items fill the gap (best fit), and at last one shorter item is cut to close the window
exactly. Each task packs the stream of documents that it reads, in bounded buffers, so ids are neither shuffled nor
held; the tail that a task has at its end is cut at its binary digits, so windows are all full powers of two. Step
groups hold windows of one tier and the same number of tokens each.

Null and empty texts are one end id; very long texts are encoded whole. Repeated rows are packed each, ties in length by
arrival. Null ids are kept. Other columns, whatever their names, are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import tidied

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: White space for str.split that the tokeniser doesn't take as such.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Words remembered by a worker, some 200 bytes each; when full, the half that came last, the rarer words, is dropped.
MEMO = 600_000
#: Characters of texts whose new words are encoded together.
TOGETHER = 1 << 20
#: Bits of a sequence id that count within one task.
LOCAL_BITS = 36


class WordIds:
    """Ids of whole texts as little-endian 32-bit bytes. The tokeniser drops white space and never looks across it, so
    the ids of a text are those of its words; the library encodes each distinct word once per bounded memo."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        return WORD.findall(text) if SEPARATORS.search(text) else text.split()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and size < TOGETHER:
                some.append(self.words(texts[at]))
                size += len(texts[at])
                at += 1
            self._learn(set().union(*some))
            for words in some:
                yield b"".join(map(self.memo.__getitem__, words))

    def _learn(self, needed: set[str]) -> None:
        if len(self.memo) > MEMO:
            for w in list(self.memo)[MEMO // 2 :]:
                if w not in needed:
                    del self.memo[w]
        words = [w for w in needed if w not in self.memo]
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.memo[w] = np.array(e.ids, "<u4").tobytes()


_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own encoder of a file; a function of this module, so that its memo outlives a task."""
    if path not in _IDS:
        _IDS[path] = WordIds(path)
    return _IDS[path]


class Packer:
    """Packs one stream. An item is [length, order, start, document's row]; rows come out as pieces."""

    def __init__(self, length: int, tiers: tuple[int, ...], step_tokens: int, buffer: int, first_id: int):
        if length & (length - 1) or any(t & (t - 1) or t > length for t in tiers):
            raise ValueError("tiers are powers of two up to the length")
        self.length, self.tiers = length, tuple(sorted({*tiers, length}, reverse=True))
        self.step_tokens, self.buffer, self.first = step_tokens, buffer, first_id
        self.made, self.of_tier, self.order = 0, dict.fromkeys(self.tiers, 0), 0
        self.items: list[list] = []
        self.out: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        n = len(ids) // 4
        for at in range(0, n - n % self.length, self.length):
            self._emit([(doc, ids, n, at, self.length)], self.length)
        if n % self.length:
            self.order += 1
            at = n - n % self.length
            self.items.append([n - at, self.order, at, (doc, ids[4 * at :], n, at)])
            if len(self.items) >= self.buffer:
                self._pack(False)

    def _emit(self, pieces: list[tuple], tier: int) -> None:
        """pieces: (document, bytes, tokens of the document, start of the bytes or of the piece, length)."""
        sid, offset = self.first + self.made, 0
        self.made += 1
        k = self.of_tier.get(tier, 0)
        self.of_tier[tier] = k + 1
        group = self.first + (tier.bit_length() << (LOCAL_BITS - 6)) + k * tier // max(self.step_tokens, tier)
        for doc, ids, n, start, size, *base in pieces:
            b = 4 * (start - (base[0] if base else 0))
            self.out.append((doc, start, size, zlib.crc32(ids[b : b + 4 * size]), n, sid, offset, tier, group))
            offset += size

    def _close(self, bin_: list[tuple], tier: int) -> None:
        self._emit([(d, ids, n, start, size, base) for (d, ids, n, base), start, size in bin_], tier)

    def _pack(self, last: bool) -> None:
        pool = sorted(self.items)  # by length, then order: ties by arrival
        self.items = []
        for k, tier in enumerate(self.tiers):
            floor = self.tiers[k + 1] if k + 1 < len(self.tiers) else 0
            while pool and (pool[-1][0] > floor):
                size, order, start, doc = pool.pop()
                bin_, gap = [(doc, start, size)], tier - size
                while gap and pool and (i := bisect_right(pool, [gap, float("inf")])):
                    size, order, start, doc = pool.pop(i - 1)
                    bin_.append((doc, start, size))
                    gap -= size
                if gap and pool:  # the longest item that is left is cut: its head closes the window
                    size, order, start, doc = pool.pop()
                    bin_.append((doc, start, gap))
                    insort(pool, [size - gap, order, start + gap, doc])
                    gap = 0
                if gap:
                    self._rest(bin_, last)
                else:
                    self._close(bin_, tier)

    def _rest(self, bin_: list[tuple], last: bool) -> None:
        """A window that nothing is left to fill: its items wait for the next buffer, or the stream's tail is cut at its binary digits."""
        if not last:
            for doc, start, size in bin_:
                self.order += 1
                self.items.append([size, self.order, start, doc])
            return
        left = sum(p[2] for p in bin_)
        bin_ = bin_[::-1]
        while left:
            take = 1 << (left.bit_length() - 1)
            left -= take
            full, tier = [], take
            while take:
                doc, start, size = bin_.pop()
                full.append((doc, start, min(size, take)))
                if size > take:
                    bin_.append((doc, start + take, size - take))
                take -= min(size, take)
            self._close(full, tier)

    def end(self) -> None:
        self._pack(True)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, length: int = 2048,
         tiers: tuple[int, ...] = (512, 1024), end_id: int = 1, step_tokens: int = 1 << 15, buffer: int = 4096) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group."""
    kind = docs.schema[id_col].dataType
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer)
        p = Packer(length, tiers, step_tokens, buffer, TaskContext.get().partitionId() << LOCAL_BITS)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for d, x in zip(part.column(0).to_pylist(), ids.encode(texts), strict=True):
                    p.add(d, x + end)
                if p.out:
                    yield rows(p)
        p.end()
        yield rows(p)

    def rows(p: Packer) -> pa.RecordBatch:
        cols = list(zip(*p.out, strict=True)) or [()] * 9
        p.out = []
        types = [id_type, *[pa.int64()] * 6, pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        tidied(run), f"id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
             "offset long, tier int, step_group long").withColumnRenamed("id", id_col)
