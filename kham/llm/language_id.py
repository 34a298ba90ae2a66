"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For every bit a binary n-gram classifier is learned: log odds of hashed byte
trigrams between the languages with +1 and those with -1, each language weighing the same. A text's bits are margins,
the sum of log odds over its trigrams by the root of their number. Decoding is loss-weighted: a language's loss is the
sum over bits of the logistic loss of its codeword against the margins, weighted by how far the bit's two sides lie
apart in training. The language with the least loss is predicted; `score` is the softmax of the negative losses and
`ambiguous` marks texts where the second best comes close.

Learned from labelled rows with a text and a language that the caller marks; per language about `sample` of them,
chosen by a hash of the id, whole texts. A null text or one without a letter is `und` with score 0; so is every text
if nothing could be learned. Ties go to the language first by name. Repeated rows are judged each; very long texts are
taken whole. Other columns, whatever their names, are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, lower_az, text_blocks, tidied

DIMS = 1 << 13
_PLAIN_LETTER = re.compile("[A-Za-z]")
#: About so many labelled texts of each language are learned from.
SAMPLE = 2000


def _folded() -> np.ndarray:
    """Lower-cases A to Z; every other ASCII byte that is no letter becomes a space."""
    t = lower_az()
    plain = t < 128
    t[plain & ~((t >= 97) & (t <= 122))] = 32
    return t


_FOLD = _folded()


def trigrams(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams around every non-space byte of all texts, and the number of them in each text."""
    b = _FOLD[np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)]
    w = b.astype(np.uint32)
    mid = np.flatnonzero(b[1:-1] != 32) + 1
    code = (w[mid - 1] << np.uint32(16)) | (w[mid] << np.uint32(8)) | w[mid + 1]
    idx = (code * np.uint32(2654435761)) >> np.uint32(19)
    ends = np.cumsum([len(r) + 1 for r in raws])
    n = np.diff(np.searchsorted(mid, ends, "right"), prepend=0)
    return idx, n


def has_letter(text: str) -> bool:
    """Whether any character is a letter (general category L); number forms and marks are none."""
    return bool(_PLAIN_LETTER.search(text)) or any(map(str.isalpha, text))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n different codewords of +-1: all splits of up to 5 languages, else the best of random codes by least distance
    between any two."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        rows = [[1 if (s >> c) & 1 else -1 for c in range(n)] for s in range(1, 1 << (n - 1))]
        return np.array(rows, np.int8).T
    rng, bits, best, least = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, 0
    while best is None:  # distance 0 is no code
        bits += 1
        for _ in range(30 if n < 500 else 3):
            m = rng.choice(np.array([-1, 1], np.int8), (n, bits))
            m = m[:, np.abs(m.sum(0, dtype=np.int64)) < n]
            alike = m.astype(np.float32) @ m.T.astype(np.float32)
            np.fill_diagonal(alike, -bits)
            close = int(m.shape[1] - alike.max()) // 2
            if close > least:
                best, least = m, close
    return best


def fit(counts: np.ndarray) -> dict:
    """Bit classifiers from the trigram counts of each language."""
    p = (counts + 0.2) / (counts + 0.2).sum(1, keepdims=True)
    code = codewords(len(counts))
    if len(counts) < 2:
        return {"w": np.zeros((DIMS, 1), np.float32), "code": code, "alpha": np.ones(1)}
    w = np.stack([np.log(p[code[:, k] > 0].mean(0)) - np.log(p[code[:, k] < 0].mean(0)) for k in range(code.shape[1])], 1)
    apart = (p @ w) * code  # the mean margin of each language, by bit
    return {"w": w.astype(np.float32), "code": code, "alpha": np.clip(apart.min(0), 0.01, None) / np.clip(apart.min(0), 0.01, None).mean()}


def decode(margins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its score and the lead over the second, of each row of margins."""
    z = -margins[:, None, :] * model["code"][None]
    loss = (np.logaddexp(0, z) * model["alpha"]).sum(2)
    e = np.exp(loss.min(1, keepdims=True) - loss)
    p = e / e.sum(1, keepdims=True)
    best = loss.argmin(1)
    top = p[np.arange(len(p)), best]
    second = np.partition(p, -2, 1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
    return best, top, top - second


def learn(docs: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE) -> tuple[list[str], dict | None]:
    """Languages and model from the rows where `train` holds; what reaches the driver is languages x DIMS counts."""
    rows = docs.where(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.col(lang_col) != "und")).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), id_crc(id_col).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], None
    langs = sorted(sizes)
    of = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))])
    chosen = rows.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) <= of[F.col("lang")] * (1 << 20)).repartition(4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), DIMS), np.int64)
        at = {k: i for i, k in enumerate(langs)}
        for batch in batches:
            who = batch.column(1).to_pylist()
            for first, past, raws in text_blocks(batch.column(0).to_pylist()):
                idx, n = trigrams(raws)
                np.add.at(sums.reshape(-1), np.repeat([at[x] * DIMS for x in who[first:past]], n) + idx, 1)
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[i, j], pa.int64())], names=["l", "j", "n"])

    got = chosen.select("text", "lang").mapInArrow(tidied(run), "l int, j int, n long").groupBy("l", "j").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), DIMS))
    counts[got["l"].to_numpy(), got["j"].to_numpy()] = got["n"].to_numpy()
    return langs, fit(counts)


def identify(docs: DataFrame, langs: list[str], model: dict | None, id_col: str = "doc_id", text_col: str = "text", *,
             lead: float = 0.02, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, ambiguous) and the columns in `keep`, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))
    names = [*keep, "lang_pred", "score", "ambiguous"]
    frame = docs.select(docs[text_col].alias("__text"), docs[id_col].alias("__id"), *keep)
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, model = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            pred, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for first, past, raws in text_blocks(texts, 1 << 20) if langs else ():
                idx, n = trigrams(raws)
                m = np.zeros((len(raws), model["w"].shape[1]))
                full = np.flatnonzero(n)
                if len(full):
                    starts = (np.cumsum(n) - n)[full]
                    for k in range(m.shape[1]):
                        m[full, k] = np.add.reduceat(model["w"][:, k][idx], starts, dtype=np.float64)
                best, top, ahead = decode(m / np.sqrt(np.maximum(n, 1))[:, None], model)
                for i in range(len(raws)):
                    if has_letter(texts[first + i] or ""):
                        pred[first + i], score[first + i], unsure[first + i] = langs[best[i]], top[i], ahead[i] < lead
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=["__id", *names])

    return frame.mapInArrow(tidied(run), ", ".join([*types, "lang_pred string, score double, ambiguous boolean"])).select(
        F.col("__id").alias(id_col), *names)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
                folds: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous): learns from the rows outside the held-out fold, predicts all."""
    out = F.pmod(id_crc(id_col), F.lit(folds)) == held
    langs, model = learn(docs, ~out, id_col, text_col, lang_col, sample)
    return identify(docs, langs, model, id_col, text_col).withColumn("held_out", out).select(
        id_col, "held_out", "lang_pred", "score", "ambiguous")
