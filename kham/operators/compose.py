"""Operators that put others together: source items, page and document reports, analysis, conversion, OCR merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import text as T
from . import layout, quality
from .layout import ordered_text

# ---- fixed values ----
PREVIEW_PAGES, PREVIEW_TABLES, PREVIEW_ROWS, MOST_SUSPECTS = 3, 3, 8, 80
BOLD_FLAG, ITALIC_FLAG = 16, 2


def audit_issues(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, kind, severity, idx, context, before): one row per structural error that is left in each text."""
    d = docs.select(*keys, T.audit_rows(F.col(text)).alias("n"))
    return d.select(*keys, F.explode_outer("n").alias("i")).where("i is not null").select(*keys, "i.*")


def fixed_and_remaining(fixed: DataFrame, remaining: DataFrame) -> DataFrame:
    """(kind, count, severity, side): what was repaired and what is left; the latter are errors whatever they were."""
    cut = lambda d, side: d.select("kind", "count", "severity", F.lit(side).alias("side"))
    return cut(fixed, "fixed").unionByName(cut(remaining.withColumn("severity", F.lit("error")), "remaining"))


def styled_spans(spans: DataFrame) -> DataFrame:
    """Spans of text blocks (block type 0) that have text, with bold and italic from flags or the font's name."""
    name = F.lower(F.coalesce("font", F.lit("")))
    has = lambda bit, word: (F.coalesce("flags", F.lit(0)).bitwiseAND(bit) != 0) | name.contains(word)
    return spans.where("block_type = 0 and text <> ''").withColumns({"bold": has(BOLD_FLAG, "bold"), "italic": has(ITALIC_FLAG, "italic")})


def document_fonts(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document its distinct fonts in order; spans without a name count for nothing."""
    return spans.select(doc, F.when(F.col("font") != "", F.col("font")).alias("font")).distinct().groupBy(doc).agg(F.array_sort(F.collect_list("font")).alias("fonts"))


def glyph_map_issues(corrections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One issue per document with replaced characters; its context is their number."""
    n = corrections.groupBy(doc).agg(F.count("*").alias("n"))
    return n.select(doc, F.lit("glyph_map").alias("kind"), F.lit("fixed").alias("severity"), F.lit(0).alias("idx"), F.concat("n", F.lit(" ตัว")).alias("context"))


def table_rows(cells: DataFrame, page: list[str]) -> DataFrame:
    """(page, table, row, y0, text) of cells (page, table, row, col, value, y0): rows padded to the widest of their
    table, cells joined by tabs, y0 the table's top. A cell that repeats is an error."""
    w = Window.partitionBy(*page, "table")
    c = cells.withColumns({"n_cols": F.max("col").over(w) + 1, "top": F.min("y0").over(w)})
    r = c.groupBy(*page, "table", "row", "n_cols", F.col("top").alias("y0")).agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", F.lit("")).alias("value")))).alias("m"))
    padded = F.transform(F.sequence(F.lit(0), F.col("n_cols").cast("int") - 1), lambda k: F.coalesce(F.col("m")[k], F.lit("")))
    return r.select(*page, "table", "row", "y0", F.array_join(padded, "\t").alias("text"))


def source_items(paragraphs: DataFrame, rows: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """(doc, page, idx, kind, text): paragraphs (0) and table rows (1) in the order in which files are written; blank ones vanish.

    On a page by y0, paragraphs first among equals. A document's items are put in order in one window.
    """
    p = paragraphs.select(doc, page, F.lit(0).alias("kind"), F.col("para").cast("long").alias("o"), F.lit(0).cast("long").alias("r"), "y0", "text")
    t = rows.select(doc, page, F.lit(1).alias("kind"), F.col("table").cast("long").alias("o"), F.col("row").cast("long").alias("r"), "y0", "text")
    full = p.unionByName(t).where(F.col("text").rlike(f"[^{C.SPACE}]"))
    w = Window.partitionBy(doc).orderBy(page, "y0", "kind", "o", "r")
    return full.withColumn("idx", F.row_number().over(w) - 1).select(doc, page, "idx", "kind", "text")


def numbered_tables(tables: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """Tables (doc, page, table) numbered through their document and on their page, with the title of their sheet."""
    t = tables.withColumns({"number": F.row_number().over(Window.partitionBy(doc).orderBy(page, "table")),
                            "on_page": F.row_number().over(Window.partitionBy(doc, page).orderBy("table"))})
    t = t.withColumn("name", F.concat(F.lit("หน้า "), F.col(page), F.lit(" ตาราง "), F.col("on_page")))
    return quality.sheet_titles(t, [doc], order="number").drop("name")


def page_report(pages: DataFrame, paragraphs: DataFrame, rows: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """Per page: chars, paragraphs, tables, source (`text`, or `empty` without any character). A table's text is its
    rows joined by newlines."""
    p = paragraphs.groupBy(doc, page).agg(F.sum(F.length("text")).alias("c"), F.count("*").alias("np"))
    t = rows.groupBy(doc, page, "table").agg((F.sum(F.length("text")) + F.count("*") - 1).alias("c")).groupBy(doc, page).agg(F.sum("c").alias("tc"), F.count("*").alias("nt"))
    r = pages.select(doc, page).join(p, [doc, page], "left").join(t, [doc, page], "left").na.fill(0, ["c", "np", "tc", "nt"])
    r = r.select(doc, page, (F.col("c") + F.col("tc")).alias("chars"), F.col("np").alias("paragraphs"), F.col("nt").alias("tables"))
    return r.withColumn("source", F.when(F.col("chars") > 0, F.lit("text")).otherwise(F.lit("empty")))


def needs_ocr(report: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """Per document the pages without text, in order."""
    return report.groupBy(doc).agg(F.array_sort(F.collect_list(F.when(F.col("source") == "empty", F.col(page)))).alias("pages"))


def ocr_totals(pages: DataFrame, doc: str) -> DataFrame:
    """Per document of pages (source, confidence): OCR pages and the plain mean of their confidence, halves rounded up.

    Confidences are summed as decimals of 12 places: a sum of doubles depends on the order of the pages, and so would a
    mean that is a half. Only what no decimal holds (NaN, infinite) is summed as it is.
    """
    read = F.col("source") == "ocr"
    c = F.when(read, F.coalesce("confidence", F.lit(0.0)).cast("double"))
    exact = F.when(F.abs(c) < 1e15, c).cast("decimal(28,12)")
    mean = F.when(F.count(exact) == F.count(c), F.floor(F.avg(exact) + F.lit(0.5).cast("decimal(2,1)")).cast("long")).otherwise(F.floor(F.avg(c) + 0.5))
    return pages.groupBy(doc).agg(F.count_if(read).alias("ocr_pages"), mean.alias("confidence"))


def merge_counters(images: DataFrame, job: str, order: str = "ord") -> DataFrame:
    """Per job of images (name, size, readable, note): pages, bytes, names that were skipped and notes, both in order."""
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(F.col(order).alias("o"), c.alias("t"))))), lambda r: r["t"])
    return images.groupBy(job).agg(F.count_if("readable").alias("pages"), F.coalesce(F.sum(F.when(F.col("readable"), F.col("size"))), F.lit(0)).alias("size_bytes"),
                                   listed(F.when(~F.col("readable"), F.col("name"))).alias("skipped"), listed(F.when(F.col("readable"), F.col("note"))).alias("notes"))


def preview_tables(rows: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """The first 8 rows of the first 3 tables of the first 3 pages (from 0) of each document."""
    r = rows.where(F.col(page) < PREVIEW_PAGES)
    r = r.withColumn("t", F.dense_rank().over(Window.partitionBy(doc, page).orderBy("table"))).where(F.col("t") <= PREVIEW_TABLES)
    return layout.top_per_group(r, [doc, page, "table"], ["row"], PREVIEW_ROWS).drop("t")


def analyze(glyphs: DataFrame, doc: str = "doc_id", page: str = "page") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, paragraphs, issues) of glyphs (doc, page, line, pos, c, x0, y0, x1, y1, size, bold).

    Spaces by geometry, lines healed, paragraphs cut, texts normalised. A document's text is its pages joined by an empty
    line, a page's its paragraphs joined by newlines; documents have n_pages, n_paragraphs, total_chars, thai_ratio,
    remaining, clean, visual_order_suspect, visual_order_ratio, text. Pages without a paragraph count for nothing.
    """
    box = (F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("size").alias("size"), F.bool_and("bold").alias("bold"))
    return analyze_lines(layout.glyph_spacing(glyphs, [doc, page, "line"], also=box), doc, page)


def analyze_lines(spaced: DataFrame, doc: str = "doc_id", page: str = "page") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `analyze` gives, of spaced lines (doc, page, line, text, x0, y0, x1, y1, size, bold).

    Lines are dealt out by document, once, and their normalised paragraphs once more.
    """
    lines = layout.heal_lines(spaced.repartition(doc), [doc, page])
    raw = layout.paragraphs(lines, [doc, page])
    said = raw.withColumn("n", T.normalise(F.col("text"), F.lit(True)))
    issues = said.select(doc, page, "para", F.explode_outer("n.issues").alias("i")).where("i is not null").select(doc, page, "para", "i.*")
    paras = said.withColumn("text", F.col("n.text")).drop("n")
    said_in = F.array_sort(F.collect_list(F.struct(F.col(page).alias("g"), F.col("para").alias("o"), F.col("text").alias("t"))))
    docs = paras.groupBy(doc).agg(said_in.alias("p"))
    apart = lambda x, i: F.when(i == 0, F.lit("")).when(F.get(F.col("p"), i - 1)["g"].eqNullSafe(x["g"]), F.lit("\n")).otherwise(F.lit("\n\n"))
    docs = docs.select(doc, F.array_join(F.transform("p", lambda x, i: F.concat(apart(x, i), x["t"])), "").alias("text"),
                       F.size(F.array_distinct(F.transform("p", lambda x: x["g"]))).cast("long").alias("n_pages"), F.size("p").cast("long").alias("n_paragraphs"))
    ratio = T.visual_order_ratio(F.col("text"))
    docs = docs.withColumns({"total_chars": F.length("text"), "thai_ratio": F.round(T.thai_ratio(F.col("text")), 4), "bad": T.audit(F.col("text")), "r": ratio})
    docs = docs.withColumn("remaining", F.expr("bad.orphan_mark + bad.reorder + bad.multi_tone + bad.nikhahit_aa + bad.double_sara_e"))
    docs = docs.select(doc, "n_pages", "n_paragraphs", "total_chars", "thai_ratio", "remaining", (F.col("remaining") == 0).alias("clean"),
                       (F.col("r") > 0.5).alias("visual_order_suspect"), F.round("r", 3).alias("visual_order_ratio"), "text")
    return docs, paras, issues


def convert_and_verify(items: DataFrame, ocr_pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Source items written to a file per document, read back and compared by position: the report with its verdict.

    `ocr_pages` (doc, ocr_pages) holds how many pages of a document came from OCR; without a row it is none.
    """
    from ..sources import office

    office.small_batches(items.sparkSession)
    report, _ = quality.verify_pairs(office.docx_pairs(items.select(doc, "idx", "kind", "text"), doc), doc)
    report = report.join(ocr_pages.select(doc, "ocr_pages"), doc, "left").na.fill(0, ["ocr_pages"])
    return report.withColumn("verdict", quality.verdict(F.col("exact"), F.col("ocr_pages")))


def ocr_merge(pages: DataFrame, words: DataFrame, page: str = "page", dpi: float = 300) -> DataFrame:
    """Pages (page, text, source, confidence) with those that are empty replaced by what OCR read on them.

    Words become lines and paragraphs, boxes in points; a page's confidence is the mean over its words. Empty pages on
    which OCR read nothing stay empty.
    """
    wanted = pages.where("source = 'empty'").select(page)
    w = words.join(wanted, page, "left_semi")
    pt = lambda c: F.bround(F.col(c) * (72 / dpi), 1).alias(c)
    lines = quality.ocr_lines(w, [page])
    order = F.row_number().over(Window.partitionBy(page).orderBy("block", "par", "line"))
    lines = lines.select(page, order.alias("line"), "text", *map(pt, ("x0", "y0", "x1", "y1")), F.bround(F.greatest(F.lit(quality.LEAST_SIZE), (F.col("y1") - F.col("y0")) * (72 / dpi) * quality.LINE_SIZE), 1).alias("size"), F.lit(False).alias("bold"))
    text = layout.paragraphs(lines, [page]).groupBy(page).agg(ordered_text(F.col("para"), F.col("text"), "\n").alias("text"))
    conf = quality.ocr_words(w).groupBy(page).agg(F.avg(F.col("conf").cast("double")).alias("confidence"))
    new = text.join(conf, page).select(page, "text", F.lit("ocr").alias("source"), "confidence")
    return quality.upsert_pages(pages, new, [page])


def first_suspects(suspects: DataFrame, doc: str, order: list[str | Column], most: int = MOST_SUSPECTS) -> DataFrame:
    """The first suspect words of each document."""
    return layout.top_per_group(suspects, [doc], order, most)
