"""Quality rules: base counts, and divergence from the language's character and word use.

References are histograms over all documents of a language: how often each class
of characters occurs, and how often each of the most common words does.  A
document is compared with every language and keeps its smallest Jensen-Shannon
distances (base 2, 0 to 1).  Short texts have noisy histograms, so each
distance counts only from a minimum length, and the limit of the word distance is
that of true samples of the language: it falls with the number of words, and lies
below the distance of a text without any common word wherever the two can be told apart.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glacierlens.llm import words

U = np.uint64
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # hundredths
SYMBOLS = b"#*$%&|<>"

COMMON_WORDS = 100
# a distance counts from this many characters or words
LEAST_CHARS = 200
LEAST_PROSE_WORDS = 50
MOST_CHAR_DISTANCE = 0.32
# no limit of the word distance is below this: true texts differ by subject
MOST_WORD_DISTANCE = 0.30
# so many standard deviations above the mean distance of samples of the language, drawn for these lengths
DEVIATIONS = 4
SAMPLES = 2000
LENGTHS = (20, 30, 40, 50, 60, 80, 100, 130, 200, 400, 1000, 4000)
# and just below the distance of a text that has none of the common words, where so few of the samples lie beyond that
NO_COMMON_WORD = 0.999
LOST_SAMPLES = 0.02

CLASSES = ("lower", "upper", "digit", "space", "stop", "other ASCII", "foreign letter", "foreign other")
_PROSE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x20000, 7, np.uint8)
    for i in range(len(table)):
        c = chr(i)
        if i < 128:
            table[i] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4 if c in ".,;:!?'\"()-" else 5
        elif c.isalpha():
            table[i] = 1 if c.isupper() else 0 if c.islower() else 6
    return table


def class_counts(texts: list[bytes]) -> np.ndarray:
    """Characters of each class in each text."""
    points = np.frombuffer(b"\n".join(texts).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    kinds = _classes()[np.minimum(points, 0x1FFFF)]
    out = np.zeros((len(texts), len(CLASSES)), np.int64)
    at = 0
    for i, text in enumerate(texts):
        n = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
        out[i] = np.bincount(kinds[at : at + n], minlength=len(CLASSES))
        at += n + 1
    return out


def prose_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and fingerprint of each word, in lower case and without punctuation."""
    starts, _, prints = words.fingerprints(b"\n".join(texts).translate(_PROSE))
    return np.repeat(np.arange(len(texts)), words.word_counts(starts, texts)), prints


def _counts(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    prints = np.sort(prints)
    new = np.ones(len(prints), bool)
    new[1:] = prints[1:] != prints[:-1]
    at = np.flatnonzero(new)
    return prints[at], np.diff(np.append(at, len(prints)))


def references(docs: DataFrame, common: int = COMMON_WORDS) -> list[tuple[str, str, int, int]]:
    """``lang, kind, key, n`` of each language: character classes, common words, all words.

    All documents with a language and a text are counted; the driver gets a fixed
    number of rows for each language.
    """

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = words.utf8(batch.column(1))
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for first, end in words.runs(own):
                    part = own[first:end]
                    _, prints = prose_words(part)
                    keys, n = _counts(prints)
                    classes = class_counts(part).sum(0)
                    kinds = ["char"] * len(classes) + ["all"] + ["word"] * len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(kinds), pa.string()), pa.array(kinds, pa.string()),
                            pa.array(np.concatenate([np.arange(len(classes)), [0], keys.view(np.int64)])),
                            pa.array(np.concatenate([classes, [len(prints)], n]).astype(np.int64)),
                        ],
                        names=["lang", "kind", "key", "n"],
                    )

    rows = docs.select("lang", "text").where("lang is not null and text is not null")
    sums = rows.mapInArrow(count, "lang string, kind string, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), F.asc("key")))
    return [tuple(r) for r in sums.withColumn("place", place).where(F.col("place") <= common).select("lang", "kind", "key", "n").collect()]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` to the histogram ``q``."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = (q / max(q.sum(), 1))[None, :]
    m = (p + q) / 2

    def part(x):
        x, y = np.broadcast_arrays(x, m)
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(y > 0, y, 1)), 0).sum(1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def word_limits(freq: np.ndarray) -> np.ndarray:
    """Limit of the word distance to the reference ``freq`` for each of ``LENGTHS``."""
    draws, share = np.random.default_rng(5), freq / freq.sum()
    none = np.zeros((1, len(freq)))
    none[0, -1] = 1
    most, limits = NO_COMMON_WORD * js_distance(none, freq)[0], []
    for n in LENGTHS:
        found = js_distance(draws.multinomial(n, share, SAMPLES).astype(float), freq)
        limit = max(MOST_WORD_DISTANCE, found.mean() + DEVIATIONS * found.std())
        limits.append(min(limit, most) if most >= MOST_WORD_DISTANCE and (found > most).mean() <= LOST_SAMPLES else limit)
    return np.array(limits)


class Judge:
    """Distances of texts to their nearest language."""

    def __init__(self, rows: list[tuple[str, str, int, int]]):
        self.langs = []
        for lang in sorted({r[0] for r in rows}):
            own = [r for r in rows if r[0] == lang]
            chars = np.zeros(len(CLASSES))
            for _, kind, key, n in own:
                if kind == "char":
                    chars[key] = n
            common = sorted((key, n) for _, kind, key, n in own if kind == "word")
            keys = np.array([k for k, _ in common], np.int64)
            n = np.array([n for _, n in common], float)
            rest = max(0, sum(n for _, kind, _, n in own if kind == "all") - n.sum())
            freq = np.append(n, rest)
            self.langs.append((chars, keys, freq, word_limits(freq) if len(keys) else None))

    def distances(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Character distance, word distance, and whether the words are beyond the limit of every language."""
        owner, prints = prose_words(texts)
        prints = prints.view(np.int64)
        chars = class_counts(texts)
        best_c, best_w, far = np.ones(len(texts)), np.ones(len(texts)), np.ones(len(texts), bool)
        n_words = np.bincount(owner, minlength=len(texts))
        for ref, keys, freq, limits in self.langs:
            best_c = np.minimum(best_c, js_distance(chars, ref))
            if len(keys):
                at = np.searchsorted(keys, prints)
                at[(at == len(keys)) | (keys[np.minimum(at, len(keys) - 1)] != prints)] = len(keys)
                counts = np.bincount(owner * len(freq) + at, minlength=len(texts) * len(freq)).reshape(len(texts), len(freq))
                found = js_distance(counts, freq)
                best_w = np.minimum(best_w, found)
                # straight in the root of 1 / n, as the noise is
                far &= found > np.interp(-1 / np.sqrt(np.maximum(n_words, 1)), -1 / np.sqrt(LENGTHS), limits)
        return best_c, best_w, far


def base_counts(texts: list[bytes]) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data = b"\n".join(texts)
    starts, _, prints = words.fingerprints(data)
    counts = words.word_counts(starts, texts)
    out = np.zeros((len(texts), 5), np.int64)
    out[:, 0] = counts
    # code points: bytes that don't continue one
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(((raw & 0xC0) != 0x80) & ~words.is_space(raw), out=inside[1:])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    marks = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(symbol[raw], out=marks[1:])
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    begins = ends - [len(t) for t in texts]
    out[:, 1] = inside[ends] - inside[begins]
    out[:, 2] = marks[ends] - marks[begins]
    out[:, 3] = [_dup_lines(t) for t in texts]
    n = len(prints)
    if n >= WINDOW:
        doc = np.repeat(np.arange(len(texts)), counts)
        acc = prints[: n - WINDOW + 1]
        for k in range(1, WINDOW):
            acc = words.chain(acc, prints[k : n - WINDOW + 1 + k])
        at = np.flatnonzero(doc[: len(acc)] == doc[WINDOW - 1 :])
        order = at[np.lexsort((acc[at], doc[at]))]
        same = (acc[order][1:] == acc[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, order[twice], 1)
        np.add.at(cover, order[twice] + WINDOW, -1)
        covered = np.cumsum(cover[:-1]) > 0
        out[:, 4] = np.bincount(doc[covered], minlength=len(texts))
    return out


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "char_distance double, word_distance double, base_failed boolean, kept boolean"
)


def judge(docs: DataFrame, rows: list[tuple[str, str, int, int]]) -> DataFrame:
    """Base counts, distances and verdict of each document, one row per row.

    A null text has no words and fails the base rules.  A distance is null below
    its minimum length, or where no reference could be learned.
    """

    own = Judge(rows)

    def check(batches):
        for batch in batches:
            texts = words.utf8(batch.column(1))
            for first, end in words.runs(texts):
                part = texts[first:end]
                base = base_counts(part)
                chars, common, far = own.distances(part)
                failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
                no_chars = (base[:, 1] < LEAST_CHARS) | (not own.langs)
                no_words = (base[:, 0] < LEAST_PROSE_WORDS) | (not own.langs)
                odd = (~no_chars & (chars > MOST_CHAR_DISTANCE)) | (~no_words & far)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), *(pa.array(base[:, i]) for i in range(5)),
                     pa.array(chars, mask=no_chars), pa.array(common, mask=no_words), pa.array(failed), pa.array(~failed & ~odd)],
                    names=[c.split()[0] for c in RESULT.split(", ")],
                )

    return docs.select("doc_id", "text").mapInArrow(check, RESULT)
