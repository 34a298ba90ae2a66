"""Inputs of the queries, derived from the driver's tables the same way in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import text as T
from ..operators import packed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def thai_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.to_thai(F.col("text")).alias("text"))


THAI_SQL = f"translate(lower(text), '{C.LATIN}', '{C.TO_THAI}')"
THAI_DOCS = f"td AS (SELECT doc_id, {THAI_SQL} AS text FROM documents)"


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of Thai-derived documents with a box and a size made from their ordinal: a 20-line page rhythm."""
    return lines_of(thai_docs(spark, sf_dir))


def lines_of(thai: DataFrame) -> DataFrame:
    d = thai.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    y = F.col("line") * 19 + F.floor(F.col("line") / 3) * 12
    return d.withColumns({
        "page": F.floor(F.col("line") / 20), "x0": (F.lit(72) + (F.col("line") % 5) * 6).cast("double"), "y0": y.cast("double"), "y1": (y + 14).cast("double"),
        "x1": (F.lit(172) + F.least(F.length("text") * 2, F.lit(300))).cast("double"), "size": F.when(F.col("line") % 7 == 6, F.lit(16.0)).otherwise(F.lit(12.0)),
        "bold": F.col("line") % 3 == 0})


DOC_LINES = f"""{THAI_DOCS}, sp AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM td WHERE text IS NOT NULL),
dl0 AS (SELECT doc_id, unnest(range(0, len(ls))) AS line, ls FROM sp),
dl AS (SELECT doc_id, line, ls[line + 1] AS text, line // 20 AS page, (72 + line % 5 * 6)::DOUBLE AS x0, (line * 19 + line // 3 * 12)::DOUBLE AS y0,
   (line * 19 + line // 3 * 12 + 14)::DOUBLE AS y1, (172 + least(length(ls[line + 1]) * 2, 300))::DOUBLE AS x1,
   CASE WHEN line % 7 = 6 THEN 16.0 ELSE 12.0 END::DOUBLE AS size, line % 3 = 0 AS bold FROM dl0)"""


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One glyph per character of each line, 6 points apart, with a wider gap after every 11th."""
    return glyphs_of(doc_lines(spark, sf_dir))


def glyphs_of(lines: DataFrame) -> DataFrame:
    g = lines.select("doc_id", "line", "y0", F.posexplode(T.chars(F.col("text"))).alias("pos", "c"))
    x = F.col("pos") * 6 + F.floor(F.col("pos") / 11) * 4
    mark = F.col("c").rlike(f"^[{C.COMBINING}]$")
    return g.withColumns({"x0": x.cast("double"), "x1": F.when(mark, x).otherwise(x + 6).cast("double"), "size": F.lit(12.0), "ox": x.cast("double"),
                          "font": F.concat(F.lit("F"), F.col("doc_id") % 7)})


class Block(NamedTuple):
    """Glyphs of whole documents: the documents' ids, and of each line that isn't empty its document and number."""

    ids: pa.Array
    doc: np.ndarray
    number: np.ndarray
    glyphs: packed.Glyphs
    pos: np.ndarray

    def doc_ids(self, rows: np.ndarray) -> pa.Array:
        """The document of lines."""
        return self.ids.take(pa.array(self.doc[rows]))


_THAI = np.arange(0x110000, dtype=np.uint32)
_THAI[[ord(c) for c in C.LATIN]] = [ord(c) for c in C.TO_THAI]


def glyph_block(ids: pa.Array, texts: list[str]) -> Block:
    """The glyphs of `glyphs` for lower-cased texts."""
    c = _THAI[np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)]
    cuts = np.flatnonzero(c == 10)
    starts, ends = np.append(0, cuts + 1), np.append(cuts, len(c))
    lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), lines)
    number = np.arange(len(starts)) - np.repeat(np.cumsum(lines) - lines, lines)
    n = ends - starts
    full = n > 0
    first = np.cumsum(n[full]) - n[full]
    c = np.delete(c, cuts)
    pos = np.arange(len(c)) - np.repeat(first, n[full])
    x = (pos * 6 + pos // 11 * 4).astype(np.float64)
    g = packed.Glyphs(c, x, np.where(packed.MARK[c], x, x + 6), np.full(len(c), 12.0), first)
    return Block(ids, doc[full], number[full], g, pos)


def glyph_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of whole documents of batches (doc_id, lower-cased text); null texts have no glyphs."""
    for b in batches:
        held, size = [], 0
        for i, t in enumerate(b.column(1).to_pylist()):
            if t is None:
                continue
            if held and size + len(t) > packed.BLOCK:
                yield glyph_block(b.column(0).take(pa.array([k for k, _ in held])), [x for _, x in held])
                held, size = [], 0
            held.append((i, t))
            size += len(t)
        if held:
            yield glyph_block(b.column(0).take(pa.array([k for k, _ in held])), [x for _, x in held])


def by_block(spark: SparkSession, sf_dir: str, names: str, run: Callable[[Block], list], by_rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `run` gives for blocks of glyphs, as columns of the schema `names` (doc_id left out). A document is a row, so
    nothing is shuffled. Documents that share an id share their lines: their glyphs go through `by_rows` as rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again_id"))
    same = F.col("doc_id").eqNullSafe(F.col("again_id"))
    repeats = again.limit(1).count() > 0
    once = docs.join(again, same, "left_anti") if repeats else docs
    columns = ["doc_id", *(x.split()[0] for x in names.split(", "))]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in glyph_blocks(batches):
                yield pa.RecordBatch.from_arrays(run(b), names=columns)
        finally:
            packed.release()

    out = once.select("doc_id", F.lower("text").alias("text")).mapInArrow(blocks, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {names}")
    if not repeats:
        return out
    rest = docs.join(again, same, "left_semi").select("doc_id", T.to_thai(F.col("text")).alias("text"))
    return out.unionByName(by_rows(glyphs_of(lines_of(rest))))


GLYPHS = f"""{DOC_LINES}, g0 AS (SELECT doc_id, line, y0, unnest(range(0, length(text))) AS pos, text FROM dl),
gl AS (SELECT doc_id, line, y0, pos, text[pos + 1] AS c, (pos * 6 + pos // 11 * 4)::DOUBLE AS x0,
   CASE WHEN regexp_matches(text[pos + 1], '^[{C.COMBINING}]$') THEN pos * 6 + pos // 11 * 4 ELSE pos * 6 + pos // 11 * 4 + 6 END::DOUBLE AS x1,
   12.0::DOUBLE AS size, (pos * 6 + pos // 11 * 4)::DOUBLE AS ox, 'F' || (doc_id % 7) AS font FROM g0)"""


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR words from line items: a block per order, words per line number, Thai letters of the ship date's day."""
    l_ = table(spark, sf_dir, "lineitem")
    return l_.select(
        F.col("l_orderkey").alias("page"), F.lit(1).alias("block"), (F.col("l_linenumber") % 2).alias("par"), (F.col("l_linenumber") % 3).alias("line"), (F.col("l_partkey") * 1000 + F.col("l_quantity").cast("int") * 10 + F.col("l_linenumber")).alias("word"),
        (F.col("l_partkey") % 900).cast("int").alias("left"), (F.col("l_linenumber") % 3 * 40).cast("int").alias("top"), (F.col("l_suppkey") % 80 + 5).cast("int").alias("width"),
        F.col("l_quantity").cast("int").alias("height"), (F.floor(F.col("l_discount") * 1000 + 0.5) - F.floor(F.col("l_tax") * 100 + 0.5)).cast("double").alias("conf"),
        F.translate(F.concat(F.lower("l_returnflag"), F.lower("l_linestatus"), F.col("l_quantity").cast("int").cast("string")), C.LATIN, C.TO_THAI).alias("text"))


OCR_WORDS = f"""ow AS (SELECT l_orderkey AS page, 1 AS block, l_linenumber % 2 AS par, l_linenumber % 3 AS line, l_partkey * 1000 + l_quantity::INT * 10 + l_linenumber AS word, (l_partkey % 900)::INT AS "left",
   (l_linenumber % 3 * 40)::INT AS top, (l_suppkey % 80 + 5)::INT AS width, l_quantity::INT AS height,
   (floor(l_discount * 1000 + 0.5) - floor(l_tax * 100 + 0.5))::DOUBLE AS conf,
   translate(lower(l_returnflag) || lower(l_linestatus) || l_quantity::INT::VARCHAR, '{C.LATIN}', '{C.TO_THAI}') AS text FROM lineitem)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreadsheet cells from line items: grouped numbers, plain ones, brackets, text; row 0 of an order is a header."""
    l_ = table(spark, sf_dir, "lineitem")
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    whole, frac = F.floor(cents / 100).cast("long"), F.lpad((cents % 100).cast("string"), 2, "0")
    thousands = F.when(whole >= 1000, F.concat(F.floor(whole / 1000).cast("long"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    k = F.col("l_partkey") % 5
    v = (F.when(k == 0, F.concat(thousands, F.lit("."), frac)).when(k == 1, F.concat(F.lit("("), whole, F.lit("."), frac, F.lit(")"))).when(k == 2, whole.cast("string"))
         .when(k == 3, F.concat(F.lit("="), F.col("l_returnflag"), F.lit(" \t"), F.col("l_linestatus"))).otherwise(F.concat(F.lit(" "), F.col("l_returnflag"), F.lit("  "), F.col("l_suppkey") % 4)))
    return l_.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("row_no"), (F.col("l_partkey") % 3).cast("int").alias("col_no"), F.col("l_partkey").alias("ord"), v.alias("value"))


CELLS = """ce0 AS (SELECT *, floor(l_extendedprice * 100 + 0.5)::BIGINT AS cents FROM lineitem),
ce1 AS (SELECT *, cents // 100 AS whole, lpad((cents % 100)::VARCHAR, 2, '0') AS frac FROM ce0),
ce AS (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS row_no, (l_partkey % 3)::INT AS col_no, l_partkey AS ord, CASE l_partkey % 5
   WHEN 0 THEN (CASE WHEN whole >= 1000 THEN (whole // 1000) || ',' || lpad((whole % 1000)::VARCHAR, 3, '0') ELSE whole::VARCHAR END) || '.' || frac
   WHEN 1 THEN '(' || whole || '.' || frac || ')' WHEN 2 THEN whole::VARCHAR
   WHEN 3 THEN '=' || l_returnflag || ' ' || chr(9) || l_linestatus ELSE ' ' || l_returnflag || '  ' || (l_suppkey % 4) END AS value FROM ce1)"""
