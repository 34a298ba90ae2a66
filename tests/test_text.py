"""Golden cases, metamorphic properties and brute-force comparisons of the text functions."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from kham.functions import text as T

u = lambda s: "".join(chr(int(x, 16)) for x in s.split())
GOLDEN = [
    ("0E19 0E4D 0E49 0E32", "0E19 0E49 0E33", "nikhahit_aa"), ("0E19 0E4D 0E32", "0E19 0E33", "nikhahit_aa"), ("0E19 0E33 0E49", "0E19 0E49 0E33", "sara_am_tone"),
    ("0E40 0E40 0E25 0E30", "0E41 0E25 0E30", "double_sara_e"), ("0E40 0E40 0E15 0E48", "0E41 0E15 0E48", "double_sara_e"), ("0E01 0E49 0E31", "0E01 0E31 0E49", "reorder"),
    ("0E17 0E49 0E34", "0E17 0E34 0E49", "reorder"), ("0E23 0E4C 0E4C", "0E23 0E4C", "duplicate_mark"), ("0E01 0E31 0E49 0E27", "0E01 0E31 0E49 0E27", None),
    ("0E01 0E49 0E49", "0E01 0E49", "duplicate_mark"), ("0E01 0E48 0E49", "0E01 0E48", "multi_tone"), ("0E49 0E01 0E32", "0E01 0E32", "orphan_mark"),
    ("0E40 0E48 0E01 0E07", "0E40 0E01 0E48 0E07", "mark_on_lead_vowel")]


@pytest.mark.parametrize("given,want,kind", GOLDEN)
def test_golden(given, want, kind):
    text, log = T.normalised(unicodedata.normalize("NFC", u(given)))
    assert text == u(want)
    assert (not log) if kind is None else kind in {x[2] for x in log}


def test_properties_on_random_strings():
    rng, marks = random.Random(3), "ัิืฺุ็่้๊๋์ํ๎"
    for _ in range(3000):
        s = "".join(rng.choice("กนรเแไาำะ ax1" + marks) for _ in range(rng.randint(0, 14)))
        s = unicodedata.normalize("NFC", s)
        once, _ = T.normalised(s)
        again, _ = T.normalised(unicodedata.normalize("NFC", once))
        base = lambda t: [c for c in t if c not in marks + "าำ"]
        if "เเ" not in s:
            assert base(once) == base(s)
        assert T.normalised(unicodedata.normalize("NFC", again))[0] == again


def test_clean_texts_are_untouched():
    for s in ("สวัสดีครับ", "น้ำใจงดงาม", "ที่นี่มีข้าวเหนียว 123", "plain", "", "กตัญญู ฤๅษี"):
        assert T.normalised(unicodedata.normalize("NFC", s)) == (s, [])


def test_mojibake():
    s = "สวัสดีครับ"
    assert T.repaired(s.encode().decode("latin-1")) == s
    assert T.repaired("plain") == "plain" and T.repaired(s) == s


def brute_audit(t):
    from kham.functions import classes as C
    import re
    out = {"orphan_mark": 0, "reorder": 0, "multi_tone": 0}
    base, run = "", []
    for c in t:
        if re.match(f"[{C.COMBINING}]", c):
            if not re.match(f"[{C.VALID_BASES}]", base or "x"):
                out["orphan_mark"] += 1
            else:
                run.append(c)
                r = [T._RANK[m] for m in run]
                out["reorder"] += r != sorted(r)
                out["multi_tone"] += sum(bool(T._TONE.match(m)) for m in run) > 1
        else:
            base, run = c, []
    return out


def test_audit_and_visual_order_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("กนรเแไาำะ a้่ิัํ") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", T.audit(F.col("t")).alias("a"), T.fix_visual_order(F.col("t")).alias("f"), T.visual_order_swaps(F.col("t")).alias("n")).collect()
    for r in got:
        t = texts[r["i"]]
        assert {k: r["a"][k] for k in ("orphan_mark", "reorder", "multi_tone")} == brute_audit(t), t
        chars, swaps, i = list(t), 0, 0
        while i + 1 < len(chars):
            if "ก" <= chars[i] <= "ฮ" and "เ" <= chars[i + 1] <= "ไ" and not (i + 2 < len(chars) and "ก" <= chars[i + 2] <= "ฮ"):
                chars[i : i + 2] = chars[i + 1], chars[i]
                swaps, i = swaps + 1, i + 1
            i += 1
        assert ("".join(chars), swaps) == (r["f"], r["n"]), t


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    n = lambda s: one(T.cell_number(F.lit(s)))
    assert (n("59,826,800.00")["num"], n("59,826,800.00")["fmt"]) == (59826800.0, "#,##0.00")
    assert n("(123.4)")["num"] == -123.4 and n("๑,๒๓๔")["num"] == 1234 and n("abc") is None and n("007")["num"] == 7 and n("12,34") is None
    assert one(T.parse_pages(F.lit("1,3,5-8, 7,x,-3,9-2"), F.lit(7))) == [1, 3, 5, 6, 7]
    assert one(T.codepoints(F.lit("นa"), 30)) == "U+0E19 U+0061" and one(T.codepoints(F.lit("aaa"), 2)) == "U+0061 U+0061 ..."
    assert one(T.safe_name(F.lit("a/b:c?.pdf"))) == "bc.pdf" and one(T.human_size(F.lit(2048))) == "2.0 KB"
    assert one(T.natural_key(F.lit("a10"))) > one(T.natural_key(F.lit("a9")))
    assert one(T.needs_space(F.lit("ก"), F.lit("ข"))) is False and one(T.needs_space(F.lit("a"), F.lit("b"))) is True
