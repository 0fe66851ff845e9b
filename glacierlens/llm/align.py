"""Alignment of two tokenizers' ids over the same bytes, and how often ids meet.

The ends of both tokenizations, counted in bytes, are kept in dictionaries from end to
number of ids, as arrays with a place for each byte of the text.  The keys that both
dictionaries hold are the common ends; in order, they slice both id lists into groups.  Within a slice the ends that only one side has
part the links: each id is linked with the ids of the other side whose bytes it
overlaps, so a slice of m and n ids has m + n - 1 links.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glacierlens.llm import tokens
from glacierlens.llm.tables import written

PIECE_FILE = "piece_bpe_32k.model"
# texts are gathered up to so many ids before they are handed on
BATCH_IDS = 1 << 19
# a table of counts up to this many rows is broadcast (16 bytes a row); a larger one is joined by a shuffle
BROADCAST_PAIRS = 3_000_000

# a word of more bytes is left to the sentence-piece model
LONG_WORD = 500

SUMMARY = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


class Side:
    """One tokenizer: ids of a text and the bytes that each id stands for."""

    def __init__(self, spelled: list[bytes], encode):
        self.size, self.encode = len(spelled), encode
        self.lengths = np.array([len(x) for x in spelled])
        self.spelled = pa.array(spelled, pa.binary())

    def spells(self, ids: np.ndarray, raw: bytes) -> bool:
        return _joined(self.spelled, ids) == raw


def _joined(values: pa.Array, at: np.ndarray) -> bytes:
    """The values at these places, one after the other."""
    taken = pc.take(values, pa.array(at), boundscheck=False).buffers()[2]
    return taken.to_pybytes() if taken else b""


def _byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones are themselves, the others follow 255."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Plain(tokens.Encoder):
    """Ids with the special tokens' strings read as plain text."""

    def __init__(self, json_path: str, rank_path: str):
        super().__init__(json_path, rank_path)
        self._json.encode_special_tokens = True

    def ids(self, text: str) -> list[int]:
        if not text.isascii() and tokens._RARE.search(text) or len(text) > 2000 and tokens._LONG_RUN.search(text):
            return self._json.encode(text, add_special_tokens=False).ids
        return self._ranks.encode_ordinary(text)


@lru_cache(maxsize=2)
def byte_level(json_path: str, rank_path: str) -> Side:
    """The byte-level vocabulary; it reads the text with a space before it."""
    plain, alphabet = _Plain(json_path, rank_path), _byte_alphabet()
    vocabulary = plain._json.get_vocab(with_added_tokens=False)
    spelled = [b""] * (max(plain._json.get_vocab().values()) + 1)
    for token, i in vocabulary.items():
        spelled[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    return Side(spelled, lambda text: _array(plain.ids(" " + text)))


def _array(ids: list[int]) -> np.ndarray:
    return np.fromiter(ids, np.int32, len(ids))


def _longest_word(raw: bytes) -> int:
    spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    return int(np.diff(spaces, append=len(raw)).max()) - 1


class _Pieces:
    """Ids of a sentence-piece model of kind BPE that takes characters as they are.

    Its pieces in the order of their scores are a rank file, which the byte-level
    vocabulary's library merges faster; ranks before them make characters of bytes.
    No piece goes on past a word into the space behind it, so words are merged
    apart.  Texts with characters that no piece holds, with long words or with three
    spaces in a row, whose pieces have one score, go through the model itself.
    """

    def __init__(self, path: str):
        import sentencepiece
        import tiktoken

        self._model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        kept.sort(key=model.get_score, reverse=True)
        texts = [model.id_to_piece(i) for i in kept]
        ranks = {bytes([b]): b for b in range(256)}
        for character in map(str.encode, sorted(set("".join(texts)) - {"▁"})):
            for end in range(2, len(character) + 1):
                ranks.setdefault(character[:end], len(ranks))
        spelled = {text.replace("▁", " ").encode(): i for i, text in zip(kept, texts)}
        for piece in spelled:
            ranks.setdefault(piece, len(ranks))
        byte_ids = {bytes([b]): model.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        # by rank; -1 for a part of a character
        self._ids = np.array([spelled.get(x, byte_ids.get(x, -1)) for x in ranks], np.int32)
        self._ranks = tiktoken.Encoding("pieces", pat_str=" *[^ ]+| +", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        spaced = " " + text
        if "▁" not in text and "   " not in spaced and _longest_word(spaced.encode()) <= LONG_WORD:
            found = self._ids[_array(self._ranks.encode_ordinary(spaced))]
            if found.min() >= 0:
                return found
        return self._model.encode(text, num_threads=1, return_type="numpy").astype(np.int32, copy=False)


@lru_cache(maxsize=2)
def pieces(path: str) -> Side:
    """The sentence-piece vocabulary; it puts a space before the text itself."""
    plain = _Pieces(path)
    model, spelled = plain._model, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        spelled.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Side(spelled, plain.ids)


class Aligned(NamedTuple):
    """Ids of both sides; group ``i`` has the ids from ``cuts[i]`` to ``cuts[i + 1]`` of each side."""

    a: np.ndarray
    b: np.ndarray
    cuts_a: np.ndarray
    cuts_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray


_NONE, _START = np.zeros(0, np.int32), np.zeros(1, np.int32)
NOTHING = Aligned(_NONE, _NONE, _START, _START, _NONE, _NONE)


def align(text: str | None, left: Side, right: Side) -> Aligned:
    """Both tokenizations of a text and their groups; no ids where either doesn't spell the text's bytes."""
    if not text:
        return NOTHING
    a, b = left.encode(text), right.encode(text)
    raw = b" " + text.encode()
    if not (left.spells(a, raw) and right.spells(b, raw)):
        return NOTHING
    ends_a, ends_b = np.cumsum(left.lengths[a]), np.cumsum(right.lengths[b])
    at_a, at_b = (np.zeros(len(raw) + 1, np.int32) for _ in range(2))
    at_a[ends_a], at_b[ends_b] = np.arange(1, len(a) + 1), np.arange(1, len(b) + 1)
    common = ends_a[at_b[ends_a] > 0]
    return Aligned(a, b, np.concatenate([_START, at_a[common]]), np.concatenate([_START, at_b[common]]), ends_a, ends_b)


def links(found: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """The two ids of each link, in order.

    Within a slice every end of either side closes one link: that of the two ids
    whose bytes lie before it.
    """
    if not len(found.a):
        return found.a, found.b
    closes_a, closes_b = (np.zeros(found.ends_a[-1] + 1, bool) for _ in range(2))
    closes_a[found.ends_a] = closes_b[found.ends_b] = True
    ends = np.flatnonzero(closes_a | closes_b)
    closes_a, closes_b = closes_a[ends], closes_b[ends]
    return found.a[np.cumsum(closes_a) - closes_a], found.b[np.cumsum(closes_b) - closes_b]


@lru_cache(maxsize=2)
def _numbers(size: int) -> pa.Array:
    """Decimal numbers with a comma after them, then all with a bar, then all with a semicolon."""
    return pa.array([f"{i}{mark}" for mark in ",|;" for i in range(size)], pa.large_string())


def spelled_groups(found: Aligned, left: Side, right: Side) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: decimal ids of both sides by group."""
    size = max(left.size, right.size)
    a, b = found.a.copy(), found.b.copy()
    a[found.cuts_a[1:] - 1] += size
    b[found.cuts_b[1:] - 1] += 2 * size
    # the ids of one side stand behind those of the other side's groups before them
    text = np.empty(len(a) + len(b), np.int32)
    text[np.arange(len(a)) + np.repeat(found.cuts_b[:-1], np.diff(found.cuts_a))] = a
    text[np.arange(len(b)) + np.repeat(found.cuts_a[1:], np.diff(found.cuts_b))] = b
    return _joined(_numbers(size), text)[:-1]


def default_sides() -> tuple[Side, Side]:
    left = byte_level(tokens.vocabulary_path(tokens.JSON_FILE), tokens.vocabulary_path(tokens.RANK_FILE))
    return left, pieces(tokens.vocabulary_path(PIECE_FILE))


def alignments(docs: DataFrame) -> DataFrame:
    """Both id lists and the cuts of their groups for each row's whole text: ``doc_id, a, b, cuts_a, cuts_b``.

    A null or empty text, or one that a tokenizer doesn't give back byte for byte, has no ids.
    """

    def run(batches):
        left, right = default_sides()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            first, columns, size = 0, [[] for _ in range(4)], 0
            for i in range(batch.num_rows + 1):
                if i == batch.num_rows or size > BATCH_IDS:
                    yield pa.RecordBatch.from_arrays([ids.slice(first, i - first), *(pa.array(c, pa.list_(pa.int32())) for c in columns)], names=["doc_id", "a", "b", "cuts_a", "cuts_b"])
                    first, columns, size = i, [[] for _ in range(4)], 0
                if i < batch.num_rows:
                    found = align(texts[i].as_py(), left, right)
                    for column, values in zip(columns, found):
                        column.append(values)
                    size += len(found.a) + len(found.b)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, a array<int>, b array<int>, cuts_a array<int>, cuts_b array<int>")


def summaries(docs: DataFrame) -> DataFrame:
    """Counts, the groups' digest, and each linked pair of ids (as one number) with its times in the text."""

    def run(batches):
        left, right = default_sides()
        base = right.size
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            first, rows, pairs, times, size = 0, [], [], [], 0
            for i in range(batch.num_rows + 1):
                if i == batch.num_rows or size > BATCH_IDS:
                    yield _summary(ids.slice(first, i - first), rows, pairs, times)
                    first, rows, pairs, times, size = i, [], [], [], 0
                if i < batch.num_rows:
                    found = align(texts[i].as_py(), left, right)
                    digest = hashlib.sha256(spelled_groups(found, left, right)).hexdigest() if len(found.a) else ""
                    x, y = links(found)
                    distinct, n = np.unique(x.astype(np.int64) * base + y, return_counts=True)
                    rows.append((len(found.a), len(found.b), len(found.cuts_a) - 1, len(x), digest))
                    pairs.append(distinct)
                    times.append(n.astype(np.int32))
                    size += len(found.a) + len(found.b)

    return docs.select("doc_id", "text").mapInArrow(run, SUMMARY)


def _summary(ids, rows, pairs, times) -> pa.RecordBatch:
    counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]), pa.int32())

    def lists(parts, kind):
        flat = np.concatenate(parts) if parts else np.zeros(0)
        return pa.ListArray.from_arrays(offsets, pa.array(flat.astype(kind)))

    digests = pa.array([r[4] for r in rows], pa.string())
    return pa.RecordBatch.from_arrays(
        [ids, *counts, digests, lists(pairs, np.int64), lists(times, np.int32)],
        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
    )


def pair_counts(found: DataFrame, base: int) -> DataFrame:
    """``pair, n, best`` of all texts: links of each pair of ids, and whether no other id is linked with its B id more often."""
    each = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    counts = written(each.groupBy(F.col("link.pairs").alias("pair")).agg(F.sum("link.times").alias("n")), "pairs")
    # a row for each id of the vocabulary
    top = counts.groupBy((F.col("pair") % base).alias("id")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(top), F.col("pair") % base == F.col("id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(docs: DataFrame) -> DataFrame:
    """Alignment of every row of ``doc_id, text`` with the counts of its links over all rows.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``; a repeated row counts and is
    returned again.  A text without ids has zeros and an empty digest.
    """
    base = default_sides()[1].size
    found = written(summaries(docs).withColumn("row", F.monotonically_increasing_id()), "aligned", compression="zstd")
    counts = written(pair_counts(found, base), "counts")
    few = counts.count() <= BROADCAST_PAIRS
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    each = each.join(F.broadcast(counts) if few else counts, "pair")
    sums = each.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    zero = F.lit(0).cast("long")
    return found.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
