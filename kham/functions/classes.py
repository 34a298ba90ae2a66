"""Character classes and other fixed values of Thai text processing, as regular-expression fragments."""

# ---- fixed values ----
CONSONANTS = "ก-ฮ"
LEAD_VOWELS = "เ-ไ"
FOLLOW_VOWELS = "ะาำๅ"
ABOVE_VOWELS = "ัิ-ื็"
BELOW_VOWELS = "ุ-ฺ"
TONES = "่-๋"
THANTHAKHAT, NIKHAHIT, YAMAKKAN = "์", "ํ", "๎"
SARA_AA, SARA_AM, SARA_E, SARA_AE = "า", "ำ", "เ", "แ"
COMBINING = "ัิ-ฺ็-๎"
VALID_BASES = "ก-ฮะาๆ"
THAI = "฀-๿"
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
ZERO_WIDTH = "​‌‍﻿­"
SUSPICIOUS_UCS = (0x20, 0x00, 0xFFFD, 0xA0)
PRIVATE_USE = (0xE000, 0xF8FF)
#: What Python's str.isspace and str.strip take as white space.
SPACE = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Order of marks in a cluster: vowels and nikhahit, then tones, then thanthakhat and yamakkan.
MARK_ORDER = ((ABOVE_VOWELS + BELOW_VOWELS + NIKHAHIT, 1), (TONES, 2), (THANTHAKHAT + YAMAKKAN, 3))

#: A cluster is a base with its marks, at most one SARA AM, and a SARA AA that follows a NIKHAHIT; a lone mark is one too.
CLUSTER = "(?s)" + "|".join((
    f"[{VALID_BASES}][{COMBINING}]*{NIKHAHIT}[{COMBINING}]*(?:{SARA_AM}[{COMBINING}]*)?{SARA_AA}",
    f"[{VALID_BASES}][{COMBINING}]*{SARA_AM}[{COMBINING}]*{NIKHAHIT}[{COMBINING}]*{SARA_AA}",
    f"[{VALID_BASES}][{COMBINING}]*(?:{SARA_AM}[{COMBINING}]*)?",
    f"[^{COMBINING}][{COMBINING}]*{NIKHAHIT}[{COMBINING}]*{SARA_AA}",
    f"[^{COMBINING}][{COMBINING}]*",
    f"[{COMBINING}]",
))

#: Severity of each kind of issue, weakest first.
SEVERITIES = ("fixed", "warn", "error")
ISSUE_KINDS = ("mojibake", "double_sara_e", "nikhahit_aa", "nikhahit_redundant", "broken_font_map", "glyph_map", "sara_am_tone",
               "reorder", "duplicate_mark", "multi_tone", "multi_vowel", "orphan_mark", "mark_on_lead_vowel", "zero_width", "visual_order")
#: Latin letters to Thai ones, for Thai inputs made from Latin text.
LATIN, TO_THAI = "abcdefghijklmnopqrstuvwxyz", "ากขดเฟง้ิๆคลมนํป์รสทุว่ำัแ"
#: A cluster, or a run of characters that carry nothing (at most 200, which keeps the matcher's stack small).
SEGMENT = f"(?s)(?:[{VALID_BASES}](?![{COMBINING}{SARA_AM}])|[^{COMBINING}{VALID_BASES}](?![{COMBINING}])){{1,200}}|" + CLUSTER[4:]
