"""Glyph operators over blocks of whole lines in numpy: the rules of `layout` where no glyph needs to be a row.

A block holds the glyphs of many lines, line after line and in order of their position, as one array a column. Lines
stand whole in it, so nothing is shuffled or sorted; what an operator gives goes out as a row a line or run. Glyph
tables whose lines are spread over rows go through `layout`.
"""

from __future__ import annotations

import ctypes
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from ..functions import classes as C
from . import layout

#: Characters of one block, about; a longer document is a block of its own.
BLOCK = 1 << 18
_TOP = 0x110000


def char_table(chars: str) -> np.ndarray:
    """A truth table of a character class."""
    of = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\u" + m[1].zfill(4), chars) + "]")
    t = np.zeros(_TOP, bool)
    t[[k for k in range(0x3100) if of.match(chr(k))]] = True
    return t


SPACE, MARK = char_table(C.SPACE), char_table(C.COMBINING)


class Glyphs(NamedTuple):
    """Code points, boxes and sizes of glyphs, and the first glyph of each line; no line is empty."""

    c: np.ndarray
    x0: np.ndarray
    x1: np.ndarray
    size: np.ndarray
    first: np.ndarray

    def ends(self) -> np.ndarray:
        return np.append(self.first[1:], len(self.c))

    def line(self) -> np.ndarray:
        """The line of each glyph."""
        return np.repeat(np.arange(len(self.first)), np.diff(self.first, append=len(self.c)))


def texts(c: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings of code points, each up to its end; they follow each other without a gap."""
    at = np.zeros(len(c) + 1, np.int64)
    np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF), out=at[1:])
    raw = c.astype("<u4", copy=False).tobytes().decode("utf-32-le").encode()
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate([[0], at[ends]]).astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


def _last(flag: np.ndarray, first_of: np.ndarray) -> np.ndarray:
    """Index of the last flagged glyph before each one in its line, -1 if there is none."""
    i = np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1))
    i = np.concatenate([[-1], i[:-1]])
    return np.where(i >= first_of, i, -1)


def spacing(g: Glyphs) -> tuple[np.ndarray, np.ndarray]:
    """(code points, end of each line): texts of lines, spaces decided by geometry as in `layout.glyph_spacing`."""
    n = len(g.c)
    if not n:
        return g.c, g.first
    line, first_of = g.line(), np.repeat(g.first, np.diff(g.first, append=n))
    sz = np.where(g.size > 0.1, g.size, 12.0)
    wd = g.x1 - g.x0
    blank = SPACE[g.c]
    wide = blank & (wd >= sz * layout.ZERO_WIDTH_RATIO)
    narrow = blank & ~wide
    body = ~blank & ~MARK[g.c]
    reset = wide | (body & (wd > 0.01))
    at = _last(reset, first_of)
    px = np.where(at >= 0, g.x1[at], -np.inf)
    thin = body & ~reset
    if thin.any():  # characters without width raise the position, up to the next that sets it
        x, rank = np.unique(g.x1, return_inverse=True)
        island = np.cumsum(np.concatenate([[False], reset[:-1]]) | (np.arange(n) == first_of))
        top = np.maximum.accumulate(island * (len(x) + 1) + np.where(thin, rank + 1, 0))
        top = np.concatenate([[0], top[:-1]]) - island * (len(x) + 1)  # what is of an island before is negative
        px = np.maximum(px, np.where(top > 0, x[np.maximum(top, 1) - 1], -np.inf))
    gap = body & (px > -np.inf) & (g.x0 - px > sz * layout.SPACE_RATIO)
    before = _last(~narrow, first_of)
    open_ = (before >= 0) & ~wide[before]
    count = np.where(wide, open_, np.where(narrow, 0, 1 + (gap & open_))).astype(np.int64)
    end = np.cumsum(count)
    out = np.empty(int(end[-1]), np.uint32)
    one = count > 0
    out[end[one] - 1] = np.where(wide, 32, g.c)[one]
    out[end[count == 2] - 2] = 32
    return out, end[g.ends() - 1]


class Runs(NamedTuple):
    """Runs of lines that follow each other without a gap: code points, first of each run, and the run's line."""

    c: np.ndarray
    first: np.ndarray
    line: np.ndarray

    def ends(self) -> np.ndarray:
        return np.append(self.first[1:], len(self.c))

    def opens(self) -> np.ndarray:
        """Whether a run is the first of its line."""
        return np.concatenate([[True], self.line[1:] != self.line[:-1]])[: len(self.line)]

    def texts(self) -> pa.Array:
        return texts(self.c, self.ends())


def span_spaces(r: Runs, x0: np.ndarray, x1: np.ndarray, size: float | np.ndarray) -> np.ndarray:
    """Whether a space goes before each span, as in `layout.span_spaces`."""
    need = np.zeros(len(r.first), bool)
    need[1:] = ~r.opens()[1:] & ((x0[1:] - x1[:-1]) > (size * layout.SPACE_RATIO)) & ~SPACE[r.c[r.first[1:] - 1]] & ~SPACE[r.c[r.first[1:]]]
    return need


def heal_runs(r: Runs) -> tuple[Runs, np.ndarray]:
    """(runs, which of those before they are), as in `layout.heal_runs`: marks that a run begins with belong to the last
    run before it that has anything else. The order of characters stays, so runs only begin later or not at all."""
    n = len(r.c)
    plain = np.append(np.where(MARK[r.c], n, np.arange(n)), n)
    after = np.minimum.accumulate(plain[::-1])[::-1]
    starts = np.where(r.opens(), r.first, after[r.first])
    kept = np.flatnonzero(starts < r.ends())
    return Runs(r.c, starts[kept], r.line[kept]), kept


def merge_runs(r: Runs, style: np.ndarray) -> tuple[Runs, np.ndarray, np.ndarray]:
    """(runs, which of those before they begin with, island in the line), as in `layout.merge_runs`."""
    opens = r.opens()
    cut = np.concatenate([[True], style[1:] != style[:-1]])[: len(style)] | opens
    kept = np.flatnonzero(cut)
    island = np.arange(len(kept)) - np.maximum.accumulate(np.where(opens[kept], np.arange(len(kept)), 0))
    return Runs(r.c, r.first[kept], r.line[kept]), kept, island


def nearest_fix(line: np.ndarray, c: np.ndarray, ox: np.ndarray, fix_line: np.ndarray, fix_c: np.ndarray, fix_x: np.ndarray, fix: np.ndarray) -> np.ndarray:
    """The fix of each glyph, -1 without one: the nearest of its line and character within 0.4 (strictly), of equally near
    ones the smaller place, of those of one place the smaller fix; as in `layout.nearest_fix`."""
    if not len(fix) or not len(c):
        return np.full(len(c), -1, np.int64)
    code = np.zeros(_TOP, np.int64)
    code[c] = code[fix_c] = 1
    code = np.cumsum(code)
    x, rank = np.unique(np.concatenate([ox, fix_x]), return_inverse=True)
    group, there = line * (code[-1] + 1) + code[c], fix_line * (code[-1] + 1) + code[fix_c]
    key, have = group * len(x) + rank[: len(ox)], there * len(x) + rank[len(ox) :]
    order = np.lexsort((fix, have))
    order = order[np.concatenate([[True], have[order][1:] != have[order][:-1]])]
    have, there, fix_x, fix = have[order], there[order], fix_x[order], fix[order]
    past = np.searchsorted(have, key, "right")
    lo = np.maximum(past - 1, 0)
    hi = np.where(have[lo] == key, lo, np.minimum(past, len(have) - 1))
    d_lo = np.where((past > 0) & (there[lo] == group), ox - fix_x[lo], np.inf)
    d_hi = np.where((there[hi] == group) & (have[hi] >= key), fix_x[hi] - ox, np.inf)
    near = np.where((d_lo < layout.FIX_TOLERANCE) & (d_lo <= d_hi), lo, np.where(d_hi < layout.FIX_TOLERANCE, hi, -1))
    return np.where(near >= 0, fix[near], -1)


def release() -> None:
    """Gives freed memory back to the machine: Python workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)
