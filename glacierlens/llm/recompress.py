"""Substring deduplication by recompression.

A document is a sequence of word fingerprints.  A round of recompression names
runs of equal symbols, then pairs of a left and a right symbol (a bit of the
symbol's own hash tells which it is).  Names are fingerprints of what they stand
for, so every task gives equal runs and pairs the same name without a shuffle.

Equal substrings get equal symbols inside, and may differ at their ends only.
Each symbol carries the range of words that it depends on.  A window of words
takes, of the named strings of neighbouring symbols that depend on words of the
window alone, the one with the least name: equal windows take equal names at
equal places.  A window that holds no such string takes one of single words.

1. Names that documents share are found in blocks of names.  A task sends one
   entry for a name, however many of its documents have it, and keeps the others'
   answer: they share it already.
2. Windows whose name is shared are compared by fingerprint, in blocks of
   windows, in the same way.  What a smaller document holds is removed.

Blocks are dealt by hash, and no group of equal rows is gathered: a task holds
one entry of each batch for a name or window at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glacierlens.llm import words
from glacierlens.llm.tables import blocks, discard, written

U = np.uint64
WINDOW = 13
# neighbouring symbols of a named string, after one round and before any
STRING = 4
PLAIN = 5
# characters of text for each block of names or windows
BLOCK_CHARS = 6_000_000
NONE = U(0xFFFFFFFFFFFFFFFF)


class Symbols:
    """Symbols of joined documents: name, words [a, b), and words [lo, hi) they depend on."""

    def __init__(self, name, a, b, lo, hi, gap):
        self.name, self.a, self.b, self.lo, self.hi, self.gap = name, a, b, lo, hi, gap


def base_symbols(prints: np.ndarray, counts: np.ndarray) -> Symbols:
    """One symbol for each word; a gap lies before and after each document, so nothing spans two."""
    bounds = np.concatenate(([0], np.cumsum(counts)))
    name = np.insert(prints, bounds, U(0))
    gap = np.zeros(len(name), bool)
    gap[bounds + np.arange(len(bounds))] = True
    at = np.arange(len(name))
    return Symbols(name, at, at + 1, at, at + 1, gap)


def recompress(s: Symbols, level: int) -> Symbols:
    """Name runs, then pairs."""
    n = len(s.name)
    if n == 0:
        return s
    # runs: which symbols a run has depends on its two neighbours
    new = np.ones(n, bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | s.gap[1:] | s.gap[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    length = last - first + 1
    name = np.where(length > 1, words.chain(s.name[first], length.astype(np.uint64)), s.name[first])
    a, b, gap = s.a[first], s.b[last], s.gap[first]
    lo = np.minimum(s.lo[first], s.lo[np.maximum(first - 1, 0)])
    hi = np.maximum(s.hi[last], s.hi[np.minimum(last + 1, n - 1)])
    # pairs: a left symbol followed by a right one; the others depend on the neighbour they could pair with
    left = (words.mix(name + U(level + 1)) >> U(63)).astype(bool) & ~gap
    right = ~left & ~gap
    m = len(name)
    paired = np.zeros(m, bool)
    paired[:-1] = left[:-1] & right[1:]
    second = np.zeros(m, bool)
    second[1:] = paired[:-1]
    out_lo, out_hi, out_b, out_name = lo.copy(), hi.copy(), b.copy(), name.copy()
    alone = np.flatnonzero(left & ~paired)
    out_hi[alone] = np.maximum(hi[alone], hi[np.minimum(alone + 1, m - 1)])
    alone = np.flatnonzero(right & ~second)
    out_lo[alone] = np.minimum(lo[alone], lo[np.maximum(alone - 1, 0)])
    p = np.flatnonzero(paired)
    out_hi[p], out_b[p], out_name[p] = hi[p + 1], b[p + 1], words.chain(name[p], name[p + 1])
    keep = ~second
    return Symbols(out_name[keep], a[keep], out_b[keep], out_lo[keep], out_hi[keep], gap[keep])


def strings(s: Symbols, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of ``size`` neighbouring symbols, what they depend on, and which lie in one document."""
    n = max(0, len(s.name) - size + 1)
    name = s.name[:n]
    for k in range(1, size):
        name = words.chain(name, s.name[k : n + k])
    gaps = np.concatenate(([0], np.cumsum(s.gap)))
    return words.mix(name + U(size)), s.lo[:n], s.hi[size - 1 : size - 1 + n], gaps[size : size + n] == gaps[:n]


def _least(found: np.ndarray, n: int, name, lo, hi, inside) -> None:
    """Put the least name inside each window (by its first word) where none is found yet."""
    if not len(name):
        return
    begin = np.zeros(n + 1, np.int64)
    begin[1:] = np.cumsum(np.bincount(lo, minlength=n)[:n])
    begin = begin[:n]
    name = np.where(inside, name, NONE)
    limit = np.arange(n) + WINDOW
    best = np.full(n, NONE)
    for k in range(WINDOW):
        j = np.minimum(begin + k, len(name) - 1)
        ok = (begin + k < len(name)) & (hi[j] <= limit)
        if not ok.any():
            break
        best = np.minimum(best, np.where(ok, name[j], NONE))
    open_ = found == NONE
    found[open_] = best[open_]


def window_names(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word, name and fingerprint of each window."""
    if not len(prints):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    base = base_symbols(prints, counts)
    n = len(base.name)
    found = np.full(n, NONE)
    _least(found, n, *strings(recompress(base, 0), STRING))
    _least(found, n, *strings(base, PLAIN))
    doc = np.repeat(np.arange(len(counts)), counts)
    starts = np.cumsum(counts + 1) - counts
    at = np.flatnonzero(~base.gap)
    inside = at + WINDOW <= (starts + counts)[doc]
    doc, at = doc[inside], at[inside]
    mark = base.name[at]
    for k in range(1, WINDOW):
        mark = words.chain(mark, base.name[at + k])
    return doc, at - starts[doc], found[at], mark


def _batches(batch, columns: int):
    """Parts of a batch whose texts fill a buffer: ids, texts, fingerprints, counts, other columns."""
    ids = batch.column(0)
    texts = words.utf8(batch.column(1))
    for first, end in words.runs(texts):
        part = texts[first:end]
        starts, _, prints = words.fingerprints(b"\n".join(part))
        yield np.array(ids.slice(first, end - first).to_pylist(), np.int64), part, prints, words.word_counts(starts, part), [batch.column(2 + i).slice(first, end - first) for i in range(columns)]


def _blobs(block: np.ndarray, columns: list[np.ndarray]):
    """One row for each block: its number and the columns' values as bytes."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    edges = _edges(block)
    return [pa.array(block[edges[:-1]])] + [pa.array([c[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary()) for c in (c[order] for c in columns)]


def _edges(sorted_: np.ndarray) -> np.ndarray:
    """Where groups of equal values begin, and the end."""
    if not len(sorted_):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)]))


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _hash_block(keys: np.ndarray, n: int) -> np.ndarray:
    return (words.mix(keys ^ U(0xA0761D6478BD642F)) % U(n)).astype(np.int64)


# what a task decides alone travels with its entries, in columns named ``own``, and is handed through


def shared_names(docs: DataFrame, n_blocks: int) -> DataFrame:
    """``doc_id`` and its window names that another document has too, as bytes."""

    def entries(batches):
        for batch in batches:
            for ids, _, prints, counts, _ in _batches(batch, 0):
                doc, _, name, _ = window_names(prints, counts)
                order = np.lexsort((doc, name))
                name, doc = name[order], doc[order]
                new = np.ones(len(name), bool)
                new[1:] = (name[1:] != name[:-1]) | (ids[doc[1:]] != ids[doc[:-1]])
                name, doc = name[new], doc[new]
                head = np.ones(len(name), bool)
                head[1:] = name[1:] != name[:-1]
                several = np.zeros(len(name), bool)
                several[1:] |= ~head[1:]
                several[:-1] |= ~head[1:]
                # one entry for each name, with a flag if it is shared within the batch
                sent = _blobs(_hash_block(name[head], n_blocks), [name[head], ids[doc[head]], several[head].view(np.uint8)])
                yield pa.RecordBatch.from_arrays([*sent, pa.nulls(len(sent[0]), pa.binary()), pa.nulls(len(sent[0]), pa.binary())], names=["block", "names", "ids", "known", "own_names", "own_ids"])
                rest = several & ~head
                told = _blobs(_hash_block(ids[doc[rest]].view(np.uint64), n_blocks), [name[rest], ids[doc[rest]]])
                none = pa.nulls(len(told[0]), pa.binary())
                yield pa.RecordBatch.from_arrays([told[0], none, none, none, told[1], told[2]], names=["block", "names", "ids", "known", "own_names", "own_ids"])

    def meet(table: pa.Table) -> pa.Table:
        own = table.filter(table.column("names").is_null())
        table = table.filter(table.column("names").is_valid())
        name, ids, known = _column(table, "names", np.uint64), _column(table, "ids", np.int64), _column(table, "known", np.uint8)
        order = np.argsort(name, kind="stable")
        name, ids, known = name[order], ids[order], known[order].astype(bool)
        if len(name):
            new = np.concatenate(([True], name[1:] != name[:-1]))
            at = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            differ = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
            differ |= np.logical_or.reduceat(known, at)
            keep = differ[group]
            name, ids = name[keep], ids[keep]
        name = np.concatenate([name, _column(own, "own_names", np.uint64)])
        ids = np.concatenate([ids, _column(own, "own_ids", np.int64)])
        out = _blobs(_hash_block(ids.view(np.uint64), n_blocks), [ids, name])
        return pa.table(out, names=["block", "ids", "names"])

    sent = docs.select("doc_id", "text").mapInArrow(entries, "block long, names binary, ids binary, known binary, own_names binary, own_ids binary")
    answers = sent.groupBy("block").applyInArrow(meet, "block long, ids binary, names binary")
    return answers.groupBy("block").applyInArrow(_gather("names", np.uint64), "doc_id long, found binary")


def _gather(column: str, kind):
    """Answers of a block of documents to one row for each document."""

    def gather(table: pa.Table) -> pa.Table:
        ids, values = _column(table, "ids", np.int64), _column(table, column, kind)
        order = np.lexsort((values, ids))
        ids, values = ids[order], values[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (values[1:] != values[:-1])
        ids, values = ids[new], values[new]
        edges = _edges(ids)
        return pa.table([pa.array(ids[edges[:-1]]), pa.array([values[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["doc_id", "found"])

    return gather


def repeated_windows(docs: DataFrame, n_blocks: int) -> DataFrame:
    """``doc_id`` and the first words of windows that a smaller document holds, as bytes.

    ``docs`` has ``doc_id, text`` and the shared names ``found``.
    """

    def entries(batches):
        for batch in batches:
            for ids, _, prints, counts, (found,) in _batches(batch, 1):
                doc, at, name, mark = window_names(prints, counts)
                shared = [np.frombuffer(x.as_buffer(), np.uint64) if x.is_valid else np.zeros(0, np.uint64) for x in found]
                owner = np.repeat(np.arange(len(shared)), [len(x) for x in shared])
                # a name and its document in one number, then an exact look at both
                asked, known = words.chain(doc.astype(np.uint64), name), words.chain(owner.astype(np.uint64), np.concatenate(shared))
                keep = np.isin(asked, known)
                doc, at, mark = doc[keep], at[keep], mark[keep]
                order = np.lexsort((ids[doc], mark))
                doc, at, mark = doc[order], at[order], mark[order]
                if not len(doc):
                    continue
                new = np.concatenate(([True], mark[1:] != mark[:-1]))
                group = np.cumsum(new) - 1
                least = ids[doc][np.flatnonzero(new)][group]
                head = ids[doc] == least
                sent = _blobs(_hash_block(mark[head], n_blocks), [mark[head], ids[doc[head]], at[head].astype(np.int32)])
                none = pa.nulls(len(sent[0]), pa.binary())
                yield pa.RecordBatch.from_arrays([*sent, none, none], names=["block", "marks", "ids", "at", "own_ids", "own_at"])
                told = _blobs(_hash_block(ids[doc[~head]].view(np.uint64), n_blocks), [ids[doc[~head]], at[~head].astype(np.int32)])
                none = pa.nulls(len(told[0]), pa.binary())
                yield pa.RecordBatch.from_arrays([told[0], none, none, none, told[1], told[2]], names=["block", "marks", "ids", "at", "own_ids", "own_at"])

    def meet(table: pa.Table) -> pa.Table:
        own = table.filter(table.column("marks").is_null())
        table = table.filter(table.column("marks").is_valid())
        mark, ids, at = _column(table, "marks", np.uint64), _column(table, "ids", np.int64), _column(table, "at", np.int32)
        order = np.argsort(mark, kind="stable")
        mark, ids, at = mark[order], ids[order], at[order]
        if len(mark):
            new = np.concatenate(([True], mark[1:] != mark[:-1]))
            keep = ids > np.minimum.reduceat(ids, np.flatnonzero(new))[np.cumsum(new) - 1]
            ids, at = ids[keep], at[keep]
        ids = np.concatenate([ids, _column(own, "own_ids", np.int64)])
        at = np.concatenate([at, _column(own, "own_at", np.int32)])
        out = _blobs(_hash_block(ids.view(np.uint64), n_blocks), [ids, at])
        return pa.table(out, names=["block", "ids", "at"])

    sent = docs.select("doc_id", "text", "found").mapInArrow(entries, "block long, marks binary, ids binary, at binary, own_ids binary, own_at binary")
    answers = sent.groupBy("block").applyInArrow(meet, "block long, ids binary, at binary")
    return answers.groupBy("block").applyInArrow(_gather("at", np.int32), "doc_id long, found binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: the words that are left, joined by one space.

    Removed is each word of a 13-word window that also starts in a document with a
    smaller id.  One row per row.  A null text has no words.  Documents without an
    id come after all others, by a hash of their texts.  Rows with one id don't
    count as smaller than each other, and lose what any of them loses at the same
    place.
    """
    behind = F.lit((1 << 63) - 1) - F.xxhash64("text").bitwiseAND(F.lit((1 << 40) - 1))
    named = docs.select("doc_id", F.coalesce("doc_id", behind).alias("key"), "text")
    keyed = named.select(F.col("key").alias("doc_id"), "text")
    n_blocks = blocks(docs, F.length("text"), BLOCK_CHARS, 12)
    names = written(shared_names(keyed, n_blocks), "names")
    asked = keyed.where("text is not null").join(names, "doc_id")
    repeats = written(repeated_windows(asked, n_blocks), "repeats")
    discard(names)

    def cut(batches):
        for batch in batches:
            texts = words.utf8(batch.column(1))
            n_words, n_removed, kept = [], [], []
            for text, found in zip(texts, batch.column(2), strict=True):
                own = text.split()
                n_words.append(len(own))
                if found.is_valid:
                    at = np.frombuffer(found.as_buffer(), np.int32)
                    at = at[at + WINDOW <= len(own)]
                    cover = np.zeros(len(own) + 1, np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + WINDOW, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    own = [own[i] for i in np.flatnonzero(~gone)]
                n_removed.append(n_words[-1] - len(own))
                kept.append(b" ".join(own).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    final = named.join(repeats.withColumnRenamed("doc_id", "key"), "key", "left").select("doc_id", "text", "found")
    return final.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
