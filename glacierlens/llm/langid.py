"""Language identification by rank-order profiles of character n-grams.

A language's profile ranks the most frequent n-grams of all its training texts.
A document's profile ranks its own; the out-of-place distance adds up how far
its n-grams are from their ranks in the language's profile.  The nearest
language is predicted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# n-grams of a profile; n-grams of a language beyond it have the largest distance
PROFILE_SIZE = 400
UNKNOWN = "und"
# code points of a text that are counted at a time, and up to the end of a word
CHUNK = 1 << 20

_SPACE = 0x20
_NO_LETTER = re.compile(r"[\W\d_]")
PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point of each letter in the first planes, 0 for anything else."""
    table = np.zeros(0x20000, np.uint32)
    for i in range(len(table)):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _symbols(text: str) -> np.ndarray:
    """Letters in lower case; each run of other characters becomes one space."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    low = table[np.minimum(points, len(table) - 1)]
    high = points >= len(table)
    if high.any():
        low = np.where(high & np.array([chr(p).isalpha() for p in points]), points, low)
    low = np.where(low == 0, _SPACE, low)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != _SPACE) | (low[:-1] != _SPACE)
    return low[keep].astype(np.int64)


def _grams(symbols: np.ndarray) -> np.ndarray:
    """N-grams of one to three symbols as integers; a gram has a letter and no inner space."""
    one = symbols + 1
    letter = symbols != _SPACE
    two = (one[:-1] << 21) | one[1:]
    three = (one[:-2] << 42) | (one[1:-1] << 21) | one[2:]
    return np.concatenate([one[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])


def _count(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = np.sort(grams)
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, int)
    return grams[starts], np.diff(np.append(starts, len(grams)))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    grams = np.concatenate([g for g, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[starts], np.add.reduceat(counts, starts)


def text_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of a whole text and how often each occurs."""
    parts, at = [], 0
    while at < len(text) or not parts:
        # a chunk ends before a character that is no letter, so no n-gram spans two
        end = _NO_LETTER.search(text, at + CHUNK)
        end = end.start() if end else len(text)
        parts.append(_count(_grams(_symbols(text[at:end]))))
        at = end
    return _merge(parts)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, ties to the smaller code."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:size]


def profiles(labelled: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """Profile of each language from ``text`` and ``lang``: ``lang, rank, gram``.

    Rows with a null in either column are left out.  All texts are counted; a
    task sums its own before the shuffle.
    """

    def count(batches):
        for batch in batches:
            parts: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = parts.setdefault(lang, [])
                own.append(text_counts(text.as_py()))
                if len(own) >= 256:
                    parts[lang] = [_merge(own)]
            for lang, own in parts.items():
                grams, counts = _merge(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"]
                )

    rows = labelled.select("lang", "text").where("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # each task hands on its best rows of a language, so the last sort sees a bounded number
    best = F.row_number().over(_by_count())
    return counts.withColumn("rank", best).where(F.col("rank") <= size).select("lang", "rank", "gram")


def _by_count():
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))


def model(table: DataFrame) -> dict[str, list[int]]:
    """Profiles on the driver: ``PROFILE_SIZE`` integers for each language."""
    found: dict[str, list[tuple[int, int]]] = {}
    for lang, rank, gram in table.collect():
        found.setdefault(lang, []).append((rank, gram))
    return {lang: [gram for _, gram in sorted(rows)] for lang, rows in sorted(found.items())}


class Matcher:
    """Out-of-place distances of a text to all profiles."""

    def __init__(self, model_: dict[str, list[int]], size: int = PROFILE_SIZE):
        self.size = size
        self.langs = sorted(model_)
        self.known = np.unique(np.array([g for grams in model_.values() for g in grams], np.int64))
        self.rank = np.full((len(self.langs), len(self.known) + 1), -1)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.known, model_[lang])] = np.arange(len(model_[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score; a text without letters, or no profile, gives ``und`` and 0."""
        grams = ranked(*text_counts(text), self.size) if text else np.zeros(0, np.int64)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.known, grams)
        at[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != grams)] = len(self.known)
        there = self.rank[:, at]
        out = np.where(there < 0, self.size, np.abs(there - np.arange(len(grams)))).sum(1)
        best = int(np.argmin(out))
        return self.langs[best], float(1.0 - out[best] / (self.size * len(grams)))


def predictor(model_: dict[str, list[int]], size: int = PROFILE_SIZE):
    """Column function: text to a struct of ``lang_pred`` and ``score`` (0 to 1).

    Only the text decides.  Null texts and texts without a letter are ``und``.
    """

    @F.pandas_udf(PREDICTION)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(model_, size)
        for batch in texts:
            yield pd.DataFrame([matcher.predict(t) for t in batch], columns=["lang_pred", "score"])

    return predict


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
