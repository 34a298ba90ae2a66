"""Issue logs, quality reports, verification, OCR lines and sheets as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import text as T
from .layout import ordered_text

# ---- fixed values ----
#: OCR: a gap of over this share of the mean height is a space; words below this confidence are suspects; size of a line.
WORD_GAP, LOW_CONFIDENCE, LINE_SIZE, LEAST_SIZE = 0.60, 75, 0.86, 8.0
PAGE_SIZES_MM = {"A4": (210.0, 297.0), "A5": (148.0, 210.0), "A3": (297.0, 420.0), "Letter": (215.9, 279.4), "Legal": (215.9, 355.6)}
ISSUE_LABELS = {
    "mojibake": "ข้อความถูกถอดรหัสผิดชุดตัวอักษร ซ่อมด้วยการเข้ารหัสใหม่",
    "double_sara_e": "สระเอซ้อนสองตัว รวมเป็นสระแอ",
    "nikhahit_aa": "นิคหิต+สระอา รวมเป็นสระอำ",
    "nikhahit_redundant": "นิคหิตซ้ำซ้อนกับสระอำ ตัดออก",
    "broken_font_map": "ฟอนต์เก็บสระอาผิดเป็นสระอำ กู้คืนจากความกว้างของ glyph",
    "glyph_map": "ตารางแปลงกลับเป็นข้อความของ PDF ผิด กู้ตัวอักษรจริงจากฟอนต์ที่ฝังในไฟล์",
    "sara_am_tone": "วรรณยุกต์อยู่หลังสระอำ ย้ายมาไว้หน้าสระอำ",
    "reorder": "ลำดับสระ/วรรณยุกต์ผิด จัดเรียงใหม่ตามมาตรฐาน",
    "duplicate_mark": "อักขระผสมซ้ำซ้อน ตัดตัวเกินออก",
    "multi_tone": "วรรณยุกต์ซ้อนกันเกินหนึ่งตัว เก็บตัวแรกไว้",
    "multi_vowel": "สระบน/ล่างซ้อนกันเกินหนึ่งตัว เก็บตัวแรกไว้",
    "orphan_mark": "วรรณยุกต์หรือสระลอย ไม่มีพยัญชนะฐาน",
    "mark_on_lead_vowel": "วรรณยุกต์เกาะสระหน้า ย้ายไปพยัญชนะตัวถัดไป",
    "zero_width": "ลบอักขระความกว้างศูนย์",
    "visual_order": "สงสัยว่าไฟล์เก็บข้อความแบบเรียงตามสายตา ไม่ใช่ลำดับตรรกะ",
}
MM_TO_PT = 72.0 / 25.4


def issues_of(docs: DataFrame, text: str, keys: list[str], *, strip: bool = True) -> DataFrame:
    """(keys, stage, at, kind, severity, idx, context, before, after): one row per issue of each text."""
    d = docs.select(*keys, T.normalise(F.col(text), F.lit(strip)).alias("n"))
    # an inner explode would infer a filter on the issues, below which the texts are normalised once more
    return d.select(*keys, F.explode_outer("n.issues").alias("i")).where("i is not null").select(*keys, "i.*")


def normalised(docs: DataFrame, text: str, keys: list[str], *, strip: bool = True) -> DataFrame:
    """(keys, text): texts in canonical form; null and empty ones stay as they are."""
    return docs.select(*keys, T.normalise(F.col(text), F.lit(strip))["text"].alias("text"))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, C.SEVERITIES)), severity)


def roll_up(issues: DataFrame, order: list[str], group: list[str] | None = None) -> DataFrame:
    """(group, kind, label, count, severity, samples): per kind its number, worst severity and first three samples."""
    spark, group = issues.sparkSession, group or []
    labels = F.broadcast(spark.createDataFrame(list(ISSUE_LABELS.items()), "kind string, label string"))  # one row a kind
    o = F.struct(*order)
    sample = F.struct(o.alias("o"), "context", "before", "after")
    first = Window.partitionBy(*group, "kind", F.pmod(F.xxhash64(*order), F.lit(32))).orderBy(*order)  # three a bucket: no kind in one task
    shown = issues.where("before <> '' or context <> ''").withColumn("r", F.row_number().over(first)).where("r <= 3")
    shown = shown.groupBy(*group, "kind").agg(F.slice(F.array_sort(F.collect_list(sample)), 1, 3).alias("s"))
    n = issues.groupBy(*group, "kind").agg(F.count("*").alias("count"), F.max(severity_rank(F.col("severity"))).alias("sev"), F.min(o).alias("first"))
    out = n.join(shown, [*group, "kind"], "left").join(labels, "kind", "left")
    return out.select(*group, "kind", F.coalesce("label", "kind").alias("label"), "count", F.get(F.array(*map(F.lit, C.SEVERITIES)), F.col("sev").cast("int") - 1).alias("severity"),
                      F.transform("s", lambda x: F.struct(x["context"].alias("context"), x["before"].alias("before"), x["after"].alias("after"))).alias("samples"), "first")


def issue_counts(issues: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, kind, count, severity): the roll-up without samples; issues are read once."""
    n = issues.groupBy(*(group or []), "kind").agg(F.count("*").alias("count"), F.max(severity_rank(F.col("severity"))).alias("sev"))
    return n.select(*(group or []), "kind", "count", F.get(F.array(*map(F.lit, C.SEVERITIES)), F.col("sev").cast("int") - 1).alias("severity"))


def quality_report(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """Per document: characters, Thai share (4 places), pages without text, whether its pages are in visual order."""
    p = pages.withColumns({"n": F.length(text), "visual": F.regexp_count(text, F.lit(f"[{C.LEAD_VOWELS}](?![{C.CONSONANTS}])")),
                           "leads": F.regexp_count(text, F.lit(f"[{C.LEAD_VOWELS}]")), "thai": F.regexp_count(text, F.lit(f"[{C.THAI}]")),
                           "body": F.length(F.regexp_replace(text, f"[{C.SPACE}]", "")), "bad": T.audit(F.col(text))})
    return p.groupBy(doc).agg(
        F.sum("n").alias("total_chars"), F.count("*").alias("n_pages"), F.count_if(F.col("n") == 0).alias("empty_pages"),
        F.when(F.sum("body") > 0, F.sum("thai") / F.sum("body")).otherwise(F.lit(0.0)).alias("thai_ratio"),
        F.sum(F.expr("bad.orphan_mark + bad.reorder + bad.multi_tone + bad.nikhahit_aa + bad.double_sara_e")).alias("remaining"),
        (F.when(F.sum("leads") >= 5, F.sum("visual") / F.sum("leads")).otherwise(F.lit(0.0)) > 0.5).alias("visual_order_suspect")
    ).withColumn("clean", F.col("remaining") == 0)


def positional_verify(expected: DataFrame, got: DataFrame, doc: str = "doc_id", idx: str = "idx", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report per document, mismatches). Items match at their position if equal up to runs of blanks; a missing one is
    empty; all surplus ones of a document are one mismatch, its first."""
    e, g = expected.select(doc, idx, F.col(text).alias("e")), got.select(doc, idx, F.col(text).alias("g"))
    return verify_pairs(e.join(g, [doc, idx], "full_outer"), doc, idx)


def verify_pairs(pairs: DataFrame, doc: str = "doc_id", idx: str = "idx") -> tuple[DataFrame, DataFrame]:
    """The same for items (e) that stand beside what was found at their place (g); null where there is none."""
    j = pairs.withColumns({"extra": F.col("e").isNull(), "a": F.coalesce("g", F.lit(""))})
    j = j.withColumn("ok", ~F.col("extra") & (T.squash(F.col("e")) == T.squash(F.col("a"))))
    report = j.groupBy(doc).agg(
        F.count("e").alias("items_total"), F.count_if("ok").alias("items_matched"), F.coalesce(F.sum(F.length("e")), F.lit(0)).alias("chars_source"),
        F.coalesce(F.sum(F.length("g")), F.lit(0)).alias("chars_output"), F.min(F.when(F.col("extra"), F.col(idx))).alias("surplus"))
    report = report.withColumns({"mismatches": F.col("items_total") - F.col("items_matched") + F.col("surplus").isNotNull().cast("long"),
                                 "match_percent": F.when(F.col("items_total") > 0, F.round(100.0 * F.col("items_matched") / F.col("items_total"), 4)).otherwise(F.lit(100.0))})
    report = report.withColumn("exact", F.col("mismatches") == 0)
    cut = lambda c: F.substring(c, 1, 120)
    bad = j.where("not ok").join(report.select(doc, "surplus"), doc).where("not extra or " + idx + " = surplus")
    bad = bad.select(doc, F.col(idx), cut(F.coalesce("e", F.lit(""))).alias("expected"), cut(F.col("a")).alias("got"),
                     T.codepoints(F.coalesce("e", F.lit(""))).alias("expected_cp"), T.codepoints(F.col("a")).alias("got_cp"),
                     F.when(F.col("extra"), F.lit("surplus")).when(F.col("a") == "", F.lit("missing")).otherwise(F.lit("differs")).alias("note"))
    return report.drop("surplus"), bad


def match_key(text: Column) -> Column:
    """What two cells must share to match: their number if they are numbers, else the text without runs of blanks."""
    n = T.loose_number(text)
    return F.when(n.isNotNull(), F.concat(F.lit("n:"), F.round(n, 9).cast("string"))).otherwise(F.concat(F.lit("t:"), T.squash(text)))


def bag_match(expected: DataFrame, got: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: items_total, items_matched. Each expected item takes one equal item that nothing has taken; blank
    ones match anyway. A multiset intersection by counts, so a value that is in a third of all rows is one row a side."""
    side = lambda df, n: df.withColumn("key", match_key(F.col(text))).withColumn("blank", T.strip(F.col(text)) == "").groupBy(doc, "key", "blank").agg(F.count("*").alias(n))
    e, g = side(expected, "n"), side(got, "m").where("not blank").drop("blank")
    j = e.join(g, [doc, "key"], "left")
    return j.groupBy(doc).agg(F.sum("n").alias("items_total"), F.sum(F.when(F.col("blank"), F.col("n")).otherwise(F.least("n", F.coalesce("m", F.lit(0))))).alias("items_matched"))


def ocr_lines(words: DataFrame, page: list[str], low: float = LOW_CONFIDENCE) -> DataFrame:
    """Lines of OCR words (block, par, line, left, top, width, height, conf, text), joined by geometry: (text, x0, y0, x1, y1, size).

    A space goes before a word that isn't marks alone if its gap to the rightmost edge so far is over 0.6 of the line's mean height.
    Words that share place and number stand in order of their text and width, so that the space is before the first of them.
    """
    line = [*page, "block", "par", "line"]
    w = Window.partitionBy(*line).orderBy("left", "word", "text", "width")
    g = ocr_words(words).withColumns({"unit": F.coalesce(F.avg(F.when(F.col("height") > 0, F.col("height"))).over(Window.partitionBy(*line)), F.lit(1.0)),
                                      "edge": F.max(F.col("left") + F.col("width")).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    gap = ~mark_only(F.col("text")) & F.coalesce(F.col("left") - F.col("edge") > F.col("unit") * WORD_GAP, F.lit(False))
    g = g.withColumn("piece", F.concat(F.when(gap, F.lit(" ")).otherwise(F.lit("")), F.col("text")))
    return g.groupBy(*line).agg(ordered_text(F.struct("left", "word", F.col("text").alias("t"), "width", F.length("text") - F.length("piece")), F.col("piece")).alias("text"), F.min("left").alias("x0"), F.min("top").alias("y0"),
                                F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1")).withColumn(
        "size", F.greatest(F.lit(LEAST_SIZE), (F.col("y1") - F.col("y0")) * LINE_SIZE))


def ocr_words(words: DataFrame) -> DataFrame:
    """Words that count: some text, a confidence that isn't negative."""
    return words.where((F.col("text") != "") & (F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0)) >= 0))


def mark_only(text: Column) -> Column:
    return text.rlike(f"^[{C.COMBINING}{C.SARA_AM}]*$")


def ocr_suspects(words: DataFrame, scale: float = 72 / 300, low: float = LOW_CONFIDENCE) -> DataFrame:
    """Words below a confidence that aren't marks alone, with their boxes in points."""
    pt = lambda c: F.bround(c * scale, 1)
    x, y = F.col("left"), F.col("top")
    return ocr_words(words).where((F.col("conf") < low) & ~mark_only(F.col("text"))).withColumns(
        {"confidence": F.bround("conf", 1), "x0": pt(x), "y0": pt(y), "x1": pt(x + F.col("width")), "y1": pt(y + F.col("height"))})


def upsert_pages(pages: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Pages with those replaced for which `new` has a row."""
    rest = [c for c in pages.columns if c not in keys]
    j = pages.join(new.select(*keys, F.struct(*rest).alias("__new")), keys, "left")
    return j.select(*keys, *[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in rest])


def image_layout(images: DataFrame, *, page_size: str = "fit", orientation: str = "auto", margin_mm: float = 0.0, fit_dpi: float = 150, fill: bool = False) -> DataFrame:
    """Images (w, h) with their page (pw, ph) and the centred box (x0, y0, x1, y1) that keeps their aspect, in points."""
    m = margin_mm * MM_TO_PT
    if page_size == "fit":
        pw, ph = F.col("w") * 72.0 / max(fit_dpi, 1) + m * 2, F.col("h") * 72.0 / max(fit_dpi, 1) + m * 2
    else:
        a, b = (x * MM_TO_PT for x in PAGE_SIZES_MM.get(page_size, PAGE_SIZES_MM["A4"]))
        wide = F.lit(orientation == "landscape") | (F.lit(orientation == "auto") & (F.col("w") > F.col("h")))
        pw, ph = F.when(wide, F.lit(b)).otherwise(F.lit(a)), F.when(wide, F.lit(a)).otherwise(F.lit(b))
    i = images.withColumns({"pw": pw, "ph": ph})
    fit = (F.greatest if fill else F.least)(F.greatest(F.col("pw") - m * 2, F.lit(1.0)) / F.col("w"), F.greatest(F.col("ph") - m * 2, F.lit(1.0)) / F.col("h"))
    i = i.withColumn("s", fit)
    return i.withColumns({"x0": (F.col("pw") - F.col("w") * F.col("s")) / 2, "y0": (F.col("ph") - F.col("h") * F.col("s")) / 2,
                          "x1": (F.col("pw") + F.col("w") * F.col("s")) / 2, "y1": (F.col("ph") + F.col("h") * F.col("s")) / 2}).drop("s")


def sheet_titles(names: DataFrame, book: list[str], name: str = "name", order: str = "ord") -> DataFrame:
    """Valid sheet titles of at most 31 characters, repeats of a workbook numbered from 2 in order."""
    t = names.withColumn("title", T.sheet_title(F.col(name)))
    t = t.withColumn("k", F.row_number().over(Window.partitionBy(*book, "title").orderBy(order)))
    suffix = F.concat(F.lit(" ("), F.col("k"), F.lit(")"))
    return t.withColumn("title", F.when(F.col("k") == 1, F.col("title")).otherwise(F.concat(F.substring(F.col("title"), F.lit(1), 31 - F.length(suffix)), suffix))).drop("k")


def autosize(cells: DataFrame, column: list[str], value: str = "value", most: int = 60) -> DataFrame:
    """Width of each column: its longest line of text and 3, at least 8, at most `most`."""
    longest = F.array_max(F.transform(F.split(F.col(value), "\n"), F.length))
    return cells.groupBy(*column).agg(F.least(F.greatest(F.max(longest) + 3, F.lit(8)), F.lit(most)).alias("width"))


def sheet_cells(cells: DataFrame) -> DataFrame:
    """Cells (row_no, value) as they are written: numbers typed except in the header row, formula-like texts guarded."""
    n = T.cell_number(F.col("value"))
    body = F.col("row_no") > 0
    return cells.withColumns({"num": F.when(body, n["num"]), "fmt": F.when(body, n["fmt"]), "guard": T.needs_text_guard(F.col("value")) & ~(body & n.isNotNull()), "header": ~body})


def verdict(exact: Column, ocr_pages: Column) -> Column:
    return F.when(exact & (ocr_pages == 0), F.lit("guaranteed")).when(exact, F.lit("exact_but_ocr")).otherwise(F.lit("mismatch"))
