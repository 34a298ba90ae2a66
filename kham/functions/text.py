"""Thai text as Column functions: ratios, repair, clusters, normalisation with an issue log, audit, visual order.

All run in the JVM but `nfc`, `repair_encoding` and `normalise`: Spark has no NFC and no strict code pages, and a cluster
scan by higher-order functions repeats its steps for every character.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import classes as C



def to_thai(text: Column) -> Column:
    return F.translate(F.lower(text), C.LATIN, C.TO_THAI)


def is_thai(ch: Column) -> Column:
    return ch.rlike(f"^[{C.THAI}]$")


def thai_ratio(text: Column) -> Column:
    """Share of Thai code points among those that aren't white space; 0 without any."""
    body = F.length(F.regexp_replace(text, f"[{C.SPACE}]", ""))
    return F.when(body > 0, F.regexp_count(text, F.lit(f"[{C.THAI}]")) / body).otherwise(F.lit(0.0))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


#: Pairs of (the code page by which bytes were misread, the one they are in), in the order in which they are tried.
MISREAD = (("latin-1", "utf-8"), ("cp1252", "utf-8"), ("cp1252", "cp874"))


_THAI = re.compile(f"[{C.THAI}]")


def _ratio(t: str) -> float:
    body = sum(map(len, t.split()))
    return len(_THAI.findall(t)) / body if body else 0.0


def repaired(t: str) -> str:
    """The first strict re-decoding that is over 30 % Thai, of a text that is at most 5 % Thai; else the text."""
    if not t.isascii() and _ratio(t) <= 0.05:
        for wrong, right in MISREAD:
            try:
                got = t.encode(wrong).decode(right)
            except (UnicodeError, LookupError):
                continue
            if _ratio(got) > 0.30:
                return got
    return t


@F.pandas_udf(T.StringType())
def repair_encoding(s: pd.Series) -> pd.Series:
    return s.map(repaired, na_action="ignore")


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, f"[{C.ZERO_WIDTH}]", "")


def fix_double_sara_e(text: Column) -> Column:
    return F.replace(text, F.lit(C.SARA_E * 2), F.lit(C.SARA_AE))


def context(text: Column, idx: Column, width: int = 12) -> Column:
    """`width` characters on either side of a 0-based position."""
    start = F.greatest(idx - width, F.lit(0))
    return F.substring(text, start + 1, idx + width - start)


def clusters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(C.CLUSTER), F.lit(0))


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


ISSUE_TYPE = T.StructType([T.StructField(n, T.StringType() if n in ("kind", "severity", "context", "before", "after") else T.IntegerType())
                           for n in ("stage", "at", "kind", "severity", "idx", "context", "before", "after")])
NORMALISED = T.StructType([T.StructField("text", T.StringType()), T.StructField("issues", T.ArrayType(ISSUE_TYPE))])
_SEGMENT, _LONE = re.compile(C.SEGMENT), re.compile(f"[{C.COMBINING}]")
_RANK = {m: n for k, n in C.MARK_ORDER for m in re.findall(f"[{k}]", "".join(map(chr, range(0x0E00, 0x0E80))))}
_TONE, _VOWEL = re.compile(f"[{C.TONES}]"), re.compile(f"[{C.ABOVE_VOWELS}{C.BELOW_VOWELS}]")
_BASE_AM_TONE = re.compile(f"(?s)[{C.VALID_BASES}][{C.COMBINING}]*{C.SARA_AM}[{C.TONES}]")
_LEAD, _CONSONANT = re.compile(f"[{C.LEAD_VOWELS}]"), re.compile(f"[{C.CONSONANTS}]")


@functools.lru_cache(1 << 14)
def ordered_marks(marks: str) -> tuple[str, dict[str, list[str]]]:
    """Marks in canonical order, and what went, by kind: repeats, tones and vowels after the first."""
    once = list(dict.fromkeys(marks))
    repeats = [m for i, m in enumerate(marks) if m in marks[:i]]
    spare = {kind: [m for m in once if of.match(m)][1:] for kind, of in (("multi_tone", _TONE), ("multi_vowel", _VOWEL))}
    gone = set(spare["multi_tone"]) | set(spare["multi_vowel"])
    return "".join(sorted((m for m in once if m not in gone), key=_RANK.__getitem__)), {"duplicate_mark": repeats, **spare}


def normalised(text: str, strip: bool = True) -> tuple[str, list[tuple]]:
    """Canonical text and issues of a text whose encoding is right and that is in NFC.

    The text is cut into segments by one regular expression; only those with marks are looked at. Issues come stage by
    stage: zero widths (1), doubled SARA E (2), what the scan met (3), marks on lead vowels (4), order of marks (5).
    """
    log: list[tuple] = []

    def say(stage: int, at: int, kind: str, severity: str, idx: int, ctx: str, before: str, after: str) -> None:
        log.append((stage, at, kind, severity, idx, ctx, before, after))

    def around(t: str, i: int) -> str:
        return t[max(0, i - 12) : i + 12]

    clean = re.sub(f"[{C.ZERO_WIDTH}]", "", text) if strip else text
    if clean != text:
        say(1, 0, "zero_width", "fixed", 0, "", "", "")
    pieces, t = clean.split(C.SARA_E * 2), ""
    for k, piece in enumerate(pieces[:-1]):
        t += piece
        left = clean[len(t) + k :]  # from this pair on, as the text still has it
        say(2, k, "double_sara_e", "fixed", len(t), t[-12:] + left[:12], C.SARA_E * 2, C.SARA_AE)
        t += C.SARA_AE
    t += pieces[-1]

    parts: list[list] = []  # base, marks, SARA AM, rest, place
    for k, m in enumerate(_SEGMENT.finditer(t)):
        c, i = m.group(), m.start()
        if len(c) == 1 and _LONE.match(c):
            say(3, k, "orphan_mark", "warn", i, around(t, i), c, "")
            continue
        if not _LONE.search(c) and not (len(c) == 2 and c[1] == C.SARA_AM and _CARRIER.match(c)):
            parts.append([c[0], "", False, c[1:], i])
            continue
        tail = c[1:]
        aa, am, marks = tail.endswith(C.SARA_AA), C.SARA_AM in tail, tail.replace(C.SARA_AM, "").replace(C.SARA_AA, "")
        if _BASE_AM_TONE.match(c):
            at = c.index(C.SARA_AM, 1)
            say(3, k, "sara_am_tone", "fixed", i + at, around(t, i + at), c[0] + c[at : at + 2], c[0] + c[at + 1] + C.SARA_AM)
        if aa:
            marks = marks.replace(C.NIKHAHIT, "", 1)
            say(3, k, "nikhahit_aa", "fixed", i + len(c) - 1, around(t, i + len(c) - 1), C.NIKHAHIT + C.SARA_AA, C.SARA_AM)
        if (aa or am) and C.NIKHAHIT in marks:
            marks = marks.replace(C.NIKHAHIT, "", 1)
            say(3, k, "nikhahit_redundant", "fixed", i, around(t, i), C.NIKHAHIT + C.SARA_AM, C.SARA_AM)
        parts.append([c[0], marks, aa or am, "", i])

    for k, (p, after) in enumerate(zip(parts, parts[1:])):
        base = p[3][-1:] or p[0]
        if p[1] and not p[3] and _LEAD.match(base) and _CONSONANT.match(after[0]):
            say(4, k, "mark_on_lead_vowel", "fixed", p[4], p[1], p[0] + p[1], p[0] + after[0] + p[1])
            after[1], p[1] = p[1] + after[1], ""
    out = []
    for k, (base, marks, am, rest, i) in enumerate(parts):
        if marks:
            best, gone = ordered_marks(marks) if len(marks) <= 8 else ordered_marks.__wrapped__(marks)
            for kind, ms in gone.items():
                for x in ms:
                    say(5, k, kind, "fixed" if kind == "duplicate_mark" else "warn", i, around(t, i), x, "")
            if best != marks and len(best) == len(marks):
                say(5, k, "reorder", "fixed", i, around(t, i), base + marks, base + best)
            marks = best
        out.append(base + marks + (C.SARA_AM if am else "") + rest)
    return "".join(out), log


_CARRIER = re.compile(f"[{C.VALID_BASES}]")


_ISSUE_ARROW = [pa.field(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int32()) for f in ISSUE_TYPE.fields]


@F.arrow_udf(NORMALISED)
def normalise(s: pa.Array, strip: pa.Array) -> pa.Array:
    """struct<text, issues> of a text: encoding repaired, NFC, canonical; null stays null, empty stays empty."""
    texts, ends, found = [], [0], []
    for raw, cut in zip(s.to_pylist(), strip.to_pylist()):
        if raw:
            fixed = repaired(raw)
            text, log = normalised(unicodedata.normalize("NFC", fixed), cut)
            if fixed != raw:
                found.append((0, 0, "mojibake", "fixed", 0, raw[:40], raw[:40], fixed[:40]))
            found += log
            raw = text
        texts.append(raw)
        ends.append(len(found))
    cols = list(zip(*found)) or [()] * len(_ISSUE_ARROW)
    rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ISSUE_ARROW)], fields=_ISSUE_ARROW)
    issues = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), issues], names=["text", "issues"])


def audit_runs(text: Column) -> Column:
    """Runs of marks, each with the character before it (none at the start of the text)."""
    return F.regexp_extract_all(text, F.lit(f"(?s)[^{C.COMBINING}]?[{C.COMBINING}]+"), F.lit(0))


def _rank(m: Column) -> Column:
    r = F.lit(0)
    for k, n in C.MARK_ORDER:
        r = F.when(m.rlike(f"[{k}]"), F.lit(n)).otherwise(r)
    return r


def audit(text: Column) -> Column:
    """Numbers of structural errors by kind: struct<orphan_mark, reorder, multi_tone, nikhahit_aa, double_sara_e>.

    The marks of a run whose base can't carry them are orphans; else each mark from the first that is out of order
    counts as `reorder` and each from the second tone on as `multi_tone`. The last two kinds count once a text.
    """
    runs = audit_runs(text)
    good = F.filter(runs, lambda r: r.rlike(f"^[{C.VALID_BASES}]"))
    bad = F.filter(runs, lambda r: ~r.rlike(f"^[{C.VALID_BASES}]"))
    marks = F.aggregate(bad, F.lit(0), lambda s, r: s + F.length(F.regexp_replace(r, f"[^{C.COMBINING}]", "")))
    late = F.aggregate(F.transform(good, _late), F.struct(F.lit(0).alias("reorder"), F.lit(0).alias("multi_tone")), lambda s, r: F.struct(
        (s["reorder"] + r["reorder"]).alias("reorder"), (s["multi_tone"] + r["multi_tone"]).alias("multi_tone")))
    return F.struct(
        marks.alias("orphan_mark"), late["reorder"].alias("reorder"), late["multi_tone"].alias("multi_tone"),
        text.contains(C.NIKHAHIT + C.SARA_AA).cast("int").alias("nikhahit_aa"), text.contains(C.SARA_E * 2).cast("int").alias("double_sara_e"))


def _late(run: Column) -> Column:
    """Of one run, in one pass: marks from the first one that is out of order, marks from the second tone on."""

    def step(s: Column, m: Column) -> Column:
        rank = _rank(m)
        down = F.greatest(s["down"], (rank < s["top"]).cast("int"))
        tones = s["tones"] + m.rlike(f"[{C.TONES}]").cast("int")
        return F.struct(F.greatest(s["top"], rank).alias("top"), down.alias("down"), tones.alias("tones"),
                        (s["reorder"] + down).alias("reorder"), (s["multi_tone"] + (tones > 1).cast("int")).alias("multi_tone"))

    ms = F.filter(chars(run), lambda c: c.rlike(f"[{C.COMBINING}]"))
    return F.aggregate(ms, F.struct(*[F.lit(0).alias(n) for n in ("top", "down", "tones", "reorder", "multi_tone")]), step)


AUDIT_TYPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("idx", T.IntegerType()),
                           T.StructField("context", T.StringType()), T.StructField("before", T.StringType())])
_AUDIT_ARROW = [pa.field(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int32()) for f in AUDIT_TYPE.fields]
_MARKED = re.compile(f"(?s)([^{C.COMBINING}]?)([{C.COMBINING}]+)")
_CARRIES, _TONE = re.compile(f"[{C.VALID_BASES}]"), re.compile(f"[{C.TONES}]")
_RANKS = tuple((re.compile(f"[{k}]"), n) for k, n in C.MARK_ORDER)


def audited(text: str) -> list[tuple[str, str, int, str, str]]:
    """(kind, severity, index, context, marks so far) of every structural error of a text, as `audit` counts them."""
    found = []

    def say(kind: str, i: int, before: str) -> None:
        found.append((kind, "error", i, text[max(0, i - 12) : i + 12], before))

    for run in _MARKED.finditer(text):
        marks, at = run[2], run.start(2)
        carried = _CARRIES.fullmatch(run[1])
        top = tones = 0
        late = False
        for k, m in enumerate(marks):
            if not carried:
                say("orphan_mark", at + k, m)
                continue
            rank = next(n for p, n in _RANKS if p.match(m))
            late, top, tones = late or rank < top, max(top, rank), tones + bool(_TONE.match(m))
            if late:
                say("reorder", at + k, marks[: k + 1])
            if tones > 1:
                say("multi_tone", at + k, marks[: k + 1])
    for kind, pair in (("nikhahit_aa", C.NIKHAHIT + C.SARA_AA), ("double_sara_e", C.SARA_E * 2)):
        if (i := text.find(pair)) >= 0:
            say(kind, i, "")
    return found


@F.arrow_udf(T.ArrayType(AUDIT_TYPE))
def audit_rows(s: pa.Array) -> pa.Array:
    """Structural errors of a text as rows; a null text has none."""
    found, ends = [], [0]
    for t in s.to_pylist():
        found += audited(t) if t else []
        ends.append(len(found))
    cols = list(zip(*found)) or [()] * len(_AUDIT_ARROW)
    rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _AUDIT_ARROW)], fields=_AUDIT_ARROW)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def visual_order_ratio(text: Column) -> Column:
    """Share of lead vowels that no consonant follows; 0 if there are fewer than five."""
    n = F.regexp_count(text, F.lit(f"[{C.LEAD_VOWELS}]"))
    return F.when(n >= 5, F.regexp_count(text, F.lit(f"[{C.LEAD_VOWELS}](?![{C.CONSONANTS}])")) / n).otherwise(F.lit(0.0))


VISUAL_PAIR = f"([{C.CONSONANTS}])([{C.LEAD_VOWELS}])(?![{C.CONSONANTS}])"


def fix_visual_order(text: Column) -> Column:
    return F.regexp_replace(text, VISUAL_PAIR, "$2$1")


def visual_order_swaps(text: Column) -> Column:
    return F.regexp_count(text, F.lit(VISUAL_PAIR))


def codepoints(text: Column, limit: int = 30) -> Column:
    shown = F.array_join(F.transform(chars(F.substring(text, 1, limit)), lambda c: F.format_string("U+%04X", F.ascii(c))), " ")
    return F.concat(shown, F.when(F.length(text) > limit, F.lit(" ...")).otherwise(F.lit("")))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{C.SPACE}]+|[{C.SPACE}]+$", "")


def squash(text: Column) -> Column:
    return strip(F.regexp_replace(text, "[ \t]+", " "))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, C.THAI_DIGITS, "0123456789")


#: Numbers as cells show them: grouped by commas with optional brackets, or plain.
NUMBER = rf"^-?\(?[{C.SPACE}]*[0-9]{{1,3}}(,[0-9]{{3}})*(\.[0-9]+)?[{C.SPACE}]*\)?$|^-?[0-9]+(\.[0-9]+)?$"


def cell_number(text: Column) -> Column:
    """struct<num double, fmt string> of a cell that shows a number, else null; brackets or a minus negate."""
    s = ascii_digits(strip(text))
    body = strip(F.regexp_replace(s, "^[()-]+|[()-]+$", ""))
    num = F.replace(body, F.lit(","), F.lit("")).try_cast("double")
    negative = s.startswith("-") | (s.startswith("(") & s.endswith(")"))
    decimals = F.length(F.regexp_extract(body, r"\.([0-9]+)$", 1))
    fmt = F.concat(F.when(body.contains(","), F.lit("#,##0")).otherwise(F.lit("0")), F.when(decimals > 0, F.concat(F.lit("."), F.repeat(F.lit("0"), decimals))).otherwise(F.lit("")))
    return F.when(s.rlike(NUMBER) & num.isNotNull(), F.struct(F.when(negative, -num).otherwise(num).alias("num"), fmt.alias("fmt")))


def loose_number(text: Column) -> Column:
    """The number that a cell may be compared by: commas dropped, brackets negate; null if it is none."""
    t = ascii_digits(F.replace(strip(text), F.lit(","), F.lit("")))
    body = F.regexp_replace(t, "^[()]+|[()]+$", "")
    v = F.when(body.rlike(rf"^[{C.SPACE}]*[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?[{C.SPACE}]*$"),
               strip(F.replace(body, F.lit("_"), F.lit(""))).try_cast("double"))
    return F.when(t.startswith("(") & t.endswith(")"), -v).otherwise(v)


def needs_text_guard(text: Column) -> Column:
    """Whether a cell would be read as a formula."""
    return text.rlike("^[=+@-]")


def needs_space(before: Column, after: Column) -> Column:
    """Whether joined pieces need a space: not beside white space, not between two Thai characters, not at an edge."""
    a, b = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    return (a != "") & (b != "") & ~a.rlike(f"[{C.SPACE}]") & ~b.rlike(f"[{C.SPACE}]") & ~(is_thai(a) & is_thai(b))


def safe_name(name: Column) -> Column:
    n = strip(F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r'[<>:"/\\|?*]', ""))
    return F.when(n == "", F.lit("file")).otherwise(n)


def human_size(n: Column) -> Column:
    kb, mb, gb = 1024, 1024**2, 1024**3
    return (F.when(n < kb, F.format_string("%d ไบต์", n)).when(n < mb, F.format_string("%.1f KB", n / kb))
            .when(n < gb, F.format_string("%.1f MB", n / mb)).otherwise(F.format_string("%.1f GB", n / gb)))


def sheet_title(name: Column) -> Column:
    n = F.substring(F.regexp_replace(name, r"[\\/*?\[\]:]", "-"), 1, 31)
    return F.when(n == "", F.lit("Sheet")).otherwise(n)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def natural_key(text: Column) -> Column:
    """A sort key in which runs of digits order as numbers."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)[0-9]+|[^0-9]+"), F.lit(0)), lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def parse_pages(spec: Column, total: Column) -> Column:
    """Sorted distinct page numbers in 1..total of `1,3,5-8`; chunks that are no number or range are skipped."""
    lo = lambda c: F.regexp_extract(c, r"^([0-9]+)(?:-[0-9]+)?$", 1).try_cast("int")
    hi = lambda c: F.regexp_extract(c, r"^(?:[0-9]+-)?([0-9]+)$", 1).try_cast("int")
    one = lambda c: F.when(lo(c).isNotNull() & hi(c).isNotNull() & (lo(c) <= F.least(hi(c), total)), F.sequence(lo(c), F.least(hi(c), total))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(F.split(F.replace(spec, F.lit(" "), F.lit("")), ","), one)), lambda p: p >= 1)))


def guess_align(x0: Column, x1: Column, left: Column, right: Column) -> Column:
    w, lg, rg = right - left, x0 - left, right - x1
    return (F.when(w <= 0, F.lit("left")).when((lg > w * 0.15) & (F.abs(lg - rg) < w * 0.10), F.lit("center"))
            .when((lg > w * 0.30) & (rg < w * 0.05), F.lit("right")).otherwise(F.lit("left")))


def rects_overlap(a: tuple[Column, ...], b: tuple[Column, ...], tol: float = 2.0) -> Column:
    """Whether two boxes (x0, y0, x1, y1) overlap by at least `tol` both ways."""
    return (a[2] >= b[0] + tol) & (b[2] >= a[0] + tol) & (a[3] >= b[1] + tol) & (b[3] >= a[1] + tol)
