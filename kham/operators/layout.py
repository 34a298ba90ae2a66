"""Layout operators over glyph, span and line tables: spacing, healing, merging, paragraphs, tables, reading order.

Every operator keeps the order columns of its input; none relies on row order. The parallel unit is a page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import text as T

# ---- fixed values ----
SPACE_RATIO, ZERO_WIDTH_RATIO = 0.20, 0.05
PARA_GAP, LINE_FULL, INDENT, SIZE_STEP = 0.55, 0.88, 18, 1.5
FIX_TOLERANCE, BUCKET_WIDTH = 0.4, 1.0
IS_MARK = f"^[{C.COMBINING}]$"
IS_SPACE = f"^[{C.SPACE}]$"


def ordered_text(order: Column, text: Column, sep: str = "") -> Column:
    """Texts of a group joined in the order of a column."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda r: r["t"]), sep)


def broken_fonts(glyphs: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Fonts in which SARA AA is mapped to SARA AM: much Thai, SARA AM but no SARA AA, and zero-width spaces or five AM.

    `covered` (font) are fonts that need no guess.
    """
    size = F.coalesce(F.when(F.col("size") != 0, F.col("size")), F.lit(12.0))
    zero = F.col("c").rlike(IS_SPACE) & (F.col("x1") - F.col("x0") < size * ZERO_WIDTH_RATIO)
    got = glyphs.where("c <> ''").groupBy("font").agg(
        F.count_if(F.col("c") == C.SARA_AA).alias("aa"), F.count_if(F.col("c") == C.SARA_AM).alias("am"),
        F.count_if(zero).alias("zero"), F.count_if(T.is_thai(F.col("c"))).alias("thai"))
    got = got.where("thai >= 20 and am > 0 and aa = 0 and (zero > 0 or am >= 5)")
    return got if covered is None else got.join(covered.select("font").distinct(), "font", "left_anti")


def glyph_spacing(glyphs: DataFrame, span: list[str], order: str = "pos", also: tuple[Column, ...] = ()) -> DataFrame:
    """Text of each span, spaces decided by geometry; needs c, x0, x1, size and, if present, fix, broken; `also` are
    further aggregates of its glyphs.

    A fix of several characters goes in as it is and leaves the position alone. Narrow white space vanishes (a NIKHAHIT
    in a broken font), wide white space is one space. A gap of over 0.2 of the size before a character that is no mark
    is a space. The position is the right edge of the last wide character or, after narrow ones, the largest since.
    """
    g = glyphs.where("c <> ''")
    col = lambda n, other: F.coalesce(F.col(n), other) if n in glyphs.columns else other
    fix, broken = col("fix", F.lit(None).cast("string")), col("broken", F.lit(False))
    g = g.withColumns({"sz": F.when(F.col("size") > 0.1, F.col("size")).otherwise(F.lit(12.0)), "many": F.coalesce(F.length(fix) > 1, F.lit(False)),
                       "r": F.coalesce(F.when(F.length(fix) > 0, fix), F.col("c")), "wd": F.col("x1") - F.col("x0"), "bk": broken})
    blank = ~F.col("many") & F.col("r").rlike(IS_SPACE)
    g = g.withColumns({"narrow": blank & (F.col("wd") < F.col("sz") * ZERO_WIDTH_RATIO), "wide": blank & (F.col("wd") >= F.col("sz") * ZERO_WIDTH_RATIO)})
    mark = F.col("r").rlike(IS_MARK)
    body = ~F.col("many") & ~F.col("narrow") & ~F.col("wide") & ~mark
    g = g.withColumn("body", body).withColumn("reset", F.col("wide") | (body & (F.col("wd") > 0.01)))
    w = Window.partitionBy(*span).orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    # islands between characters that set the position; within one, narrow characters can only raise it
    g = g.withColumn("island", F.coalesce(F.sum(F.col("reset").cast("int")).over(past), F.lit(0)))
    iw = Window.partitionBy(*span, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("reset"), F.col("x1")), True).over(past)
    top = F.max(F.when(F.col("body") & ~F.col("reset"), F.col("x1"))).over(iw)
    g = g.withColumn("px", F.greatest(last, top))
    gap = F.coalesce(F.col("body") & (F.col("x0") - F.col("px") > F.col("sz") * SPACE_RATIO), F.lit(False))
    shown = (F.when(F.col("many"), F.col("r")).when(F.col("narrow"), F.when(F.col("bk"), F.lit(C.NIKHAHIT)).otherwise(F.lit("")))
             .when(F.col("wide"), F.lit(" ")).when(F.col("bk") & (F.col("r") == C.SARA_AM), F.lit(C.SARA_AA)).otherwise(F.col("r")))
    g = g.withColumns({"shown": shown, "gap": gap})
    before = F.last(F.when(F.col("shown") != "", F.right("shown", F.lit(1))), True).over(past)
    open_ = F.coalesce(~before.rlike(IS_SPACE), F.lit(False))  # something stands before, and it is no space
    g = g.withColumn("open", open_)
    out = F.when(F.col("wide"), F.when(F.col("open"), F.lit(" ")).otherwise(F.lit(""))).otherwise(
        F.concat(F.when(F.col("gap") & F.col("open"), F.lit(" ")).otherwise(F.lit("")), F.col("shown")))
    return g.withColumn("out", out).groupBy(*span).agg(ordered_text(F.col(order), F.col("out")).alias("text"), *also)


def fix_buckets(fixes: DataFrame, keys: list[str]) -> DataFrame:
    """Replacement characters of a row (ucs, y1) merged into buckets: all within 1.0 of a bucket's first x.

    A bucket's start depends on all before it, so each row is folded in one sorted stream; no row is held whole.
    """
    n = len(keys)
    kinds = [fixes.schema[k].dataType.simpleString() for k in keys]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket, first, held, types = None, 0, None, [], None

        def batch(done: list) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [()] * (n + 3)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[*keys, "bucket", "x", "ch"])

        def closed() -> tuple:
            return (*now, bucket, first, None if None in held else "".join(held))

        for b in batches:
            types = [*[b.column(i).type for i in range(n)], pa.int32(), pa.float64(), pa.string()]
            done = []
            for *key, x, _, ch in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key == now and x is not None and first is not None and x - first <= BUCKET_WIDTH:
                    held.append(ch)
                    continue
                if now is not None:
                    done.append(closed())
                bucket = bucket + 1 if key == now else 0
                now, first, held = key, x, [ch]
            yield batch(done)
        if now is not None:
            yield batch([closed()])

    entries = fixes.select(*keys, F.col("x").cast("double").alias("x"), F.col("seq").cast("long").alias("s"), "ch")
    return entries.repartition(*keys).sortWithinPartitions(*keys, "x", "s", "ch").mapInArrow(
        fold, ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True)), "bucket int, x double, ch string"]))


def nearest_fix(glyphs: DataFrame, buckets: DataFrame, keys: list[str], glyph_id: list[str]) -> DataFrame:
    """glyphs with `fix`: the nearest bucket of the same key within 0.4 (strictly), of equal ones the first.

    One sorted pass: buckets and glyphs of a key stand in order of x, and the nearest bucket on either side of a glyph is
    the last and the first one met; buckets of one x count as their first. So neither side is broadcast or joined.
    Rows with a null key or place have no fix. `glyph_id` names what tells glyphs apart, which this needs no more.
    """
    once = buckets.groupBy(*keys, "x").agg(F.min_by(F.struct("bucket", "ch"), "bucket").alias("__b"))
    rows = [*glyphs.columns]
    at = glyphs.withColumns({"__x": F.col("ox").cast("double"), "__b": F.lit(None).cast(once.schema["__b"].dataType)})
    there = once.select(*[F.col(c) if c in keys else F.lit(None).cast(glyphs.schema[c].dataType).alias(c) for c in rows], F.col("x").cast("double").alias("__x"), "__b")
    w = Window.partitionBy(*keys).orderBy("__x", F.col("__b").isNull())
    near = F.when(F.col("__b").isNotNull(), F.struct(F.col("__x").alias("x"), "__b"))
    both = at.withColumn("__g", F.lit(True)).unionByName(there.withColumn("__g", F.lit(False))).withColumns({
        "__lo": F.last(near, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__hi": F.first(near, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    lo, hi = F.col("__x") - F.col("__lo.x"), F.col("__hi.x") - F.col("__x")
    ok_lo, ok_hi = F.coalesce(lo < FIX_TOLERANCE, F.lit(False)), F.coalesce(hi < FIX_TOLERANCE, F.lit(False))
    low_first = ok_lo & (~ok_hi | (lo < hi) | ((lo == hi) & (F.col("__lo.__b.bucket") <= F.col("__hi.__b.bucket"))))
    fix = F.when(low_first, F.col("__lo.__b.ch")).when(ok_hi, F.col("__hi.__b.ch"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return both.where("__g").select(*rows, F.when(known, fix).alias("fix"))


def _all(conds: list[Column], *more: Column) -> Column:
    out = conds[0]
    for c in [*conds[1:], *more]:
        out = out & c
    return out


def resolve_glyphs(names: DataFrame, cmap: DataFrame, variants: DataFrame, depth: int = 4) -> DataFrame:
    """(font, gid, ch): the character of each glyph name; names without one, or with a private-use one, follow their
    base glyph up to `depth` times. Of repeated rows in cmap (font, name, ch, ord) and variants (font, name, base, ord) the first counts."""
    first = lambda df, v: df.groupBy("font", "name").agg(F.min_by(v, "ord").alias(v))
    cm, va = first(cmap, "ch"), first(variants, "base")
    private = F.col("ch").rlike(f"^[{chr(C.PRIVATE_USE[0])}-{chr(C.PRIVATE_USE[1])}]$")
    cur = names.select("font", "gid", "name").join(cm, ["font", "name"], "left")
    for _ in range(depth):
        nxt = cur.join(va, ["font", "name"], "left").withColumn("go", F.col("ch").isNull() | private)
        nxt = nxt.select("font", "gid", F.when(F.col("go"), F.col("base")).otherwise(F.col("name")).alias("name"), F.when(~F.col("go"), F.col("ch")).alias("kept"))
        cur = nxt.join(cm, ["font", "name"], "left").select("font", "gid", "name", F.coalesce("kept", "ch").alias("ch"))
    return cur.where(F.col("ch").isNotNull()).select("font", "gid", "ch")


def glyph_corrections(trace: DataFrame, font_map: DataFrame) -> DataFrame:
    """Trace rows whose mapped character differs from the one in the file and is Thai, or the file's is suspicious.

    Fonts match by exact name, else by the name without its subset prefix.
    """
    m = F.broadcast(font_map) if font_map.isLocal() else font_map
    exact, bare = m.select(F.col("font").alias("f1"), F.col("gid").alias("g1"), F.col("ch").alias("c1")), m.select(F.col("font").alias("f2"), F.col("gid").alias("g2"), F.col("ch").alias("c2"))
    j = trace.join(exact, (F.col("font") == F.col("f1")) & (F.col("gid") == F.col("g1")), "left")
    j = j.join(bare, (F.substring_index("font", "+", -1) == F.col("f2")) & (F.col("gid") == F.col("g2")), "left").withColumn("ch", F.coalesce("c1", "c2"))
    thai = T.is_thai(F.col("ch"))
    return j.where(F.col("ch").isNotNull() & (F.ascii("ch") != F.col("ucs")) & (thai | F.col("ucs").isin(*C.SUSPICIOUS_UCS))).drop("f1", "g1", "c1", "f2", "g2", "c2")


def span_spaces(spans: DataFrame, line: list[str], order: str = "span") -> DataFrame:
    """Spans with text, a space put before one whose gap to the one before is over 0.2 of its size and not spaced yet."""
    w = Window.partitionBy(*line).orderBy(order)
    s = spans.where("text <> ''").withColumns({"pt": F.lag("text").over(w), "p1": F.lag("x1").over(w)})
    need = (F.col("x0") - F.col("p1") > F.col("size") * SPACE_RATIO) & ~F.col("pt").rlike(f"[{C.SPACE}]$") & ~F.col("text").rlike(f"^[{C.SPACE}]")
    return s.withColumn("text", F.when(F.coalesce(need, F.lit(False)), F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text"))).drop("pt", "p1")


def heal_runs(runs: DataFrame, line: list[str], order: str = "run", text: str = "text") -> DataFrame:
    """Marks at the start of a run go to the end of the last run before it that has anything else; empty runs vanish.

    The first run of a line keeps its marks. A run takes all marks up to the next run with other text, in order.
    """
    w = Window.partitionBy(*line).orderBy(order)
    r = runs.where(F.col(text) != "").withColumn("k", F.row_number().over(w))
    lead = F.when(F.col("k") == 1, F.lit("")).otherwise(F.regexp_extract(text, f"^[{C.COMBINING}]*", 0))
    r = r.withColumns({"lead": lead, "rest": F.substring(F.col(text), F.length(lead) + 1, F.length(text))})
    r = r.withColumn("home", F.sum((F.col("rest") != "").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    taken = r.withColumn("to", F.when(F.col("rest") != "", F.col("home") - 1).otherwise(F.col("home"))).where("lead <> ''")
    taken = taken.groupBy(*line, F.col("to").alias("home")).agg(ordered_text(F.col(order), F.col("lead")).alias("tail"))
    kept = r.where("rest <> ''").join(taken, [*line, "home"], "left")
    return kept.withColumn(text, F.concat("rest", F.coalesce("tail", F.lit("")))).select(*runs.columns)


def merge_runs(runs: DataFrame, line: list[str], style: list[str], order: str = "run", text: str = "text") -> DataFrame:
    """Neighbouring runs of one style joined: islands of equal style."""
    w = Window.partitionBy(*line).orderBy(order)
    key = F.struct(*style)
    r = runs.withColumn("cut", F.coalesce((key != F.lag(key).over(w)).cast("int"), F.lit(0)))
    r = r.withColumn("island", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*line, "island").agg(*[F.min_by(c, order).alias(c) for c in style], ordered_text(F.col(order), F.col(text)).alias(text))


def heal_lines(lines: DataFrame, page: list[str], order: str = "line", text: str = "text") -> DataFrame:
    """Marks at the start of a line go to the end of the line before if that ends, but for white space, in a valid base.

    Lines of marks alone that follow each other depend on one another; here each looks at the line before as given.
    """
    w = Window.partitionBy(*page).orderBy(order)
    lead = F.regexp_extract(text, f"^[{C.COMBINING}]*", 0)
    trimmed = F.regexp_replace(text, f"[{C.SPACE}]+$", "")
    l_ = lines.withColumns({"lead": lead, "trimmed": trimmed, "takes": trimmed.rlike(f"[{C.VALID_BASES}]$")})
    gives = (F.col("lead") != "") & F.coalesce(F.lag("takes").over(w), F.lit(False))
    l_ = l_.withColumn("gives", gives)
    got = F.when(F.lead("gives").over(w), F.lead("lead").over(w))
    body = F.when(got.isNotNull(), F.concat("trimmed", got)).otherwise(F.col(text))
    return l_.withColumn(text, F.when(F.col("gives"), F.substring(body, F.length("lead") + 1, F.length(body))).otherwise(body)).select(*lines.columns)


def paragraphs(lines: DataFrame, page: list[str], order: str = "line") -> DataFrame:
    """Paragraphs of lines (text, x0, y0, x1, y1, size, bold): (para, text, align, x0, y0, x1, y1, size, bold, n_lines).

    A paragraph starts at a gap of over 0.55 line heights; on a page without such gaps after a line that isn't full; at
    another indent; at another size. Blank ones vanish.
    """
    w, p = Window.partitionBy(*page).orderBy(order), Window.partitionBy(*page)
    l_ = lines.withColumns({"left": F.min("x0").over(p), "right": F.max("x1").over(p), "ph": F.greatest(F.lag(F.col("y1") - F.col("y0")).over(w), F.lit(1.0)),
                            "gap": F.col("y0") - F.lag("y1").over(w), "pw": F.lag(F.col("x1") - F.col("x0")).over(w), "px": F.lag("x0").over(w), "ps": F.lag("size").over(w)})
    l_ = l_.withColumn("wide_gap", F.coalesce(F.col("gap") > F.col("ph") * PARA_GAP, F.lit(False)))
    l_ = l_.withColumn("spaced", F.max("wide_gap").over(p))
    new = (F.col("wide_gap") | (~F.col("spaced") & (F.col("pw") < F.greatest(F.col("right") - F.col("left"), F.lit(1.0)) * LINE_FULL))
           | (F.abs(F.col("x0") - F.col("px")) > INDENT) | (F.abs(F.col("size") - F.col("ps")) > SIZE_STEP))
    l_ = l_.withColumn("para", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pw = Window.partitionBy(*page, "para").orderBy(order)
    l_ = l_.withColumn("piece", F.concat(F.when(F.coalesce(T.needs_space(F.lag("text").over(pw), F.col("text")), F.lit(False)), F.lit(" ")).otherwise(F.lit("")), F.col("text")))
    full = F.col("text").rlike(f"[^{C.SPACE}]")
    out = l_.groupBy(*page, "para").agg(
        T.strip(ordered_text(F.col(order), F.col("piece"))).alias("text"),
        F.min_by(T.guess_align(F.col("x0"), F.col("x1"), F.col("left"), F.col("right")), order).alias("align"),
        F.min("x0").alias("x0"), F.min_by("y0", order).alias("y0"), F.max("x1").alias("x1"), F.max_by("y1", order).alias("y1"),
        F.coalesce(F.max(F.when(full, F.col("size"))), F.lit(12.0)).alias("size"),
        F.coalesce(F.bool_and(F.when(full, F.col("bold"))), F.lit(True)).alias("bold"), F.count("*").alias("n_lines"))
    return out.where("text <> ''")


def lines_outside_tables(lines: DataFrame, tables: DataFrame, page: list[str]) -> DataFrame:
    """Lines that overlap no table of their page (spatial anti-join with the page as its equi-key)."""
    box = lambda a: tuple(F.col(f"{a}.{c}") for c in ("x0", "y0", "x1", "y1"))
    return lines.alias("l").join(tables.alias("t"), _all([F.col(f"l.{k}") == F.col(f"t.{k}") for k in page], T.rects_overlap(box("l"), box("t"))), "left_anti")


def reading_order(items: DataFrame, page: list[str]) -> DataFrame:
    """Paragraphs (kind 0) and tables (kind 1) of a page numbered by y0, stable."""
    return items.withColumn("pos", F.row_number().over(Window.partitionBy(*page).orderBy("y0", "kind", "ord")))


def top_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("k") <= n)
