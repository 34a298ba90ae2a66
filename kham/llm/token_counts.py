"""Token counts of whole texts by overlap resynchronisation.

A text of over `window` characters is encoded as overlapping windows, each as it stands, with the offsets of its tokens.
Two neighbours are spliced at a boundary inside their overlap at which a token starts in both encodings and which is
*proven stable*: it lies before a single space between two safe characters, where the pre-tokeniser must start a new
piece whatever stands around. All tokens between the first and the last such boundary must be the same in both. If there
aren't two, or the encodings disagree, the overlap doubles; when it can't, the window grows, up to the whole text.

Shorter texts are counted by their pieces between stable boundaries, whose tokens depend on the piece alone, so counts of
pieces are remembered per worker (a bounded memo; when full it is emptied). Every count comes from the library.

Null text: 0 bytes, 0 tokens. Repeated rows are counted each; null ids are kept; there are no ties. Other columns, whatever
their names, are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters that are neither white space nor special to the pre-tokeniser's white-space rules.
SAFE = "!-~À-ɏ"
STABLE = re.compile(f"(?<=[{SAFE}])(?=[ \n][{SAFE}])")
MEMO = 400_000


class Encoder:
    """Counts and offsets of texts for one tokeniser file; `.json` by tokenizers, `.model` by sentencepiece."""

    def __init__(self, path: str):
        self.memo: dict[str, int] = {}
        self.splits = path.endswith(".json")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if self.splits:
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(path)
            self.tok.no_truncation()
            self.tok.no_padding()
        else:
            import sentencepiece

            self.tok = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        """Tokens of a text of one window."""
        if not self.splits:
            return len(self.tok.encode(text))
        pieces = STABLE.split(text)
        try:
            return sum(map(self.memo.__getitem__, pieces))
        except KeyError:
            self._learn(pieces)
            return sum(map(self.memo.__getitem__, pieces))

    def _learn(self, pieces: list[str]) -> None:
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list({p for p in pieces if p not in self.memo})
        for p, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.memo[p] = len(e.ids)

    def offsets(self, text: str) -> list[int]:
        """Where each token of a window starts, in characters."""
        if self.splits:
            return [a for a, _ in self.tok.encode(text, add_special_tokens=False).offsets]
        return [p.begin for p in self.tok.encode(text, return_type="proto").pieces]


def splice_count(text: str, encode: Callable[[str], list[int]], window: int, overlap: int) -> tuple[int, int, int]:
    """(tokens, windows, widenings) of a text that is encoded in overlapping windows."""
    n, total, windows, widened = len(text), 0, 1, 0
    cut, end = 0, min(n, window)  # the stable boundary up to which tokens are counted, the end of the window
    left, wide = encode(text[:end]), overlap
    while end < n:
        low = max(cut + 1, end - wide)
        stop = min(n, max(low + window, end + 1))
        right = [low + a for a in encode(text[low:stop])]
        windows += 1
        at = _resync(text, left, right, low, end)
        if at is not None:
            total += bisect_left(left, at) - bisect_left(left, cut)
            cut, left, end, wide = at, right, stop, overlap
            continue
        widened += 1
        if low > cut + 1:
            wide *= 2
        else:  # the overlap is all that isn't counted yet
            end, wide = min(n, end + window), overlap
            left = [cut + a for a in encode(text[cut:end])]
            windows += 1
    return total + len(left) - bisect_left(left, cut), windows, widened


def _resync(text: str, left: list[int], right: list[int], low: int, end: int) -> int | None:
    """The middle one of the stable boundaries that both encodings share; None if there aren't two or tokens between differ."""
    ours, theirs = set(left), set(right)
    both = [p for m in STABLE.finditer(text, low + 1, end) if (p := m.start()) > low and p + 1 < end and p in ours and p in theirs]
    if len(both) < 2:
        return None
    a, e = both[0], both[-1]
    same = left[bisect_left(left, a) : bisect_left(left, e)] == right[bisect_left(right, a) : bisect_left(right, e)]
    return both[len(both) // 2] if same else None


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 1024,
                 window: int = 1 << 14, overlap: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_windows, n_widened) of every row; one narrow pass, no shuffle.

    `tokenizer` is a tokeniser file that every executor has. Nothing is truncated or padded and no special tokens are
    added; strings of special tokens inside a text are taken as the library takes them by default.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in batches:
            rows = []
            for v in batch.column(1):
                t = v.as_py() or ""
                n = (e.count(t), 1, 0) if len(t) <= window else splice_count(t, e.offsets, window, overlap)
                rows.append((len(t.encode("utf-8", "surrogatepass")), n[0], n[0] > limit, n[1], n[2]))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                                             names=["id", "n_bytes", "n_tokens", "over_limit", "n_windows", "n_widened"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        run, f"id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, n_windows int, n_widened int")
    return out.withColumnRenamed("id", id_col)
