"""Language identification: multinomial naive Bayes over hashed character n-grams.

Grams of 1 to 3 characters of the lower-cased text are hashed into 2^15 cells.
The matrix of log-probabilities (languages x cells) is broadcast. Its size is
bounded: beyond 512 languages the cells are halved as the languages double, so
it has at most 2^24 numbers, and a sample has at most ``max_rows`` languages.

Texts are scored by batch: the grams of all texts of a batch are the column
indices of one sparse matrix with a row a text; numpy gathers each language's
log-probabilities by these indices and adds them up by row.

The model is fitted on a bounded sample of labelled texts: ``max_rows`` (8,000)
distinct pairs of text and language, chosen by hash, whole texts each. Copies of
a text teach once, so the bound holds for any number of them.

Cases: a text that is null or has no letter is ``und`` with score 0; without any
labelled row every text is ``und``; rows of null language teach nothing; equal
texts get equal answers; ties go to the first language by name; texts of any
length are scored whole; columns that are not asked for are ignored, and kept
columns named lang_pred or score are refused; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_sample, refuse, spread, staged

CELLS, ORDERS, MAX_ROWS, FULL_LANGS, SMOOTH, PIECE = 1 << 15, (1, 2, 3), 8000, 512, 0.5, 1 << 18
_MULT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def groups(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of texts of about ``most`` characters, or of one longer text."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if texts:
        yield begin, len(texts)


def batch_cells(texts: list[str], cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, cell) of all grams of all texts, in arrays of bounded length in order of rows."""
    lowered = [t.lower() for t in texts]
    size = np.fromiter(map(len, lowered), np.int64, len(lowered))
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(size)
    for at in range(0, len(chars), PIECE):
        piece = chars[at : at + PIECE + max(ORDERS) - 1]
        some = np.arange(at, min(at + PIECE, len(chars)))
        row = np.searchsorted(ends, some, side="right")
        left = ends[row] - some
        for n in ORDERS:
            last = min(PIECE, len(piece) - n + 1)
            if last <= 0:
                continue
            h = np.full(last, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ piece[k : k + last]) * np.uint32(_MULT[k])
                h ^= h >> np.uint32(15)
            h &= np.uint32(cells - 1)
            whole = left[:last] >= n  # no gram spans two texts
            yield row[:last][whole], h[whole]


@dataclass(frozen=True)
class LangModel:
    langs: tuple[str, ...]
    log_prob: np.ndarray  # languages x cells
    log_prior: np.ndarray

    def totals(self, texts: list[str]) -> np.ndarray:
        """Log-probability of every text (row) and language, texts as given."""
        total = np.tile(self.log_prior, (len(texts), 1))
        for begin, end in groups(texts):
            for row, cell in batch_cells(texts[begin:end], self.log_prob.shape[1]):
                if not len(row):
                    continue
                first = np.nonzero(np.concatenate(([True], row[1:] != row[:-1])))[0]
                for j, log_prob in enumerate(self.log_prob):
                    total[begin + row[first], j] += np.add.reduceat(log_prob[cell], first, dtype=np.float64)
        return total

    def predict_batch(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of every text."""
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        told = [i for i, t in enumerate(texts) if self.langs and isinstance(t, str) and any(map(str.isalpha, t))]
        if told:
            total = self.totals([texts[i] for i in told])
            best = total.argmax(1)
            score[told] = 1 / np.exp(total - total[np.arange(len(told)), best][:, None]).sum(1)
            for i, b in zip(told, best.tolist(), strict=True):
                langs[i] = self.langs[b]
        return langs, score

    def predict(self, text: str | None) -> tuple[str, float]:
        (lang,), (score,) = self.predict_batch([text])
        return lang, float(score)


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS) -> LangModel:
    """A model from rows (text, lang) where both are given."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    sample = staged(distinct_sample(rows, max_rows, 11), "languages")

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grams = np.zeros(CELLS, np.int64)
        texts = list(pdf.text)
        for begin, end in groups(texts):
            for _, cell in batch_cells(texts[begin:end]):
                grams += np.bincount(cell, minlength=CELLS)
        return pd.DataFrame({"lang": [key[0]], "docs": [len(pdf)], "grams": [grams.astype("<u4").tobytes()]})

    # the sample is bounded; 16 parts of a language keep one task from having a whole language
    parts = sample.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(16))).groupBy("lang", "part").applyInPandas(count, "lang string, docs long, grams binary")
    found = sample.select("lang").distinct().count()
    cells = CELLS
    while cells * found > CELLS * FULL_LANGS:
        cells //= 2
    sums: dict[str, list] = {}
    for r in parts.toLocalIterator():
        had = sums.setdefault(r["lang"], [0, np.zeros(cells, np.int64)])
        had[0] += r["docs"]
        had[1] += np.frombuffer(r["grams"], "<u4").reshape(-1, cells).sum(0, dtype=np.int64)  # a cell of fewer is a hash of fewer bits
    langs = tuple(sorted(sums))
    if not langs:
        return LangModel((), np.zeros((0, CELLS), np.float32), np.zeros(0))
    grams = np.stack([sums[x][1] for x in langs]) + SMOOTH
    docs = np.array([sums[x][0] for x in langs], float)
    return LangModel(langs, np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32), np.log(docs / docs.sum()))


def predict(docs: DataFrame, model: LangModel, *keep: str) -> DataFrame:
    """Columns ``keep``, lang_pred and score for every row of docs (text)."""
    refuse(keep, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]  # inside, so that no name of a column matters
    schema = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)), "lang_pred string, score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            langs, score = model.predict_batch(list(pdf.pop("text")))
            yield pdf.assign(lang_pred=langs, score=score)

    wanted = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)], F.col("text").cast("string").alias("text"))
    found = spread(wanted).mapInPandas(run, schema)
    return found.toDF(*keep, "lang_pred", "score")
