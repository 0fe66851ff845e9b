"""Best-fit packing of token sequences in hierarchical residual rounds.

Items are packed best-fit, longest first, within blocks of a few ten thousand.
A block's nearly full bins are final.  Its underfull bins become items of the
next round, in an eighth of the blocks, and so on up a tree to one block.

After a best-fit round two bins of a block never fit together, so at most one of
a block's bins is half empty.  A bin that is more than half full can only take in
such a half-empty one.  A round therefore passes on each block's emptiest bins,
a fixed number at most, beside its half-empty one: bins that stay behind could
gain nothing from more company of their own kind.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glacierlens.llm.tables import written
from glacierlens.llm.tokens import default_encoder

SEQUENCE_TOKENS = 2048
END_ID = 0
# a bin is final when this many tokens at most are free
NEARLY_FULL = 16
BLOCK_ITEMS = 40_000
FAN_IN = 8
PASSED_ON = BLOCK_ITEMS // FAN_IN // 2

# bytes of ids that a worker hands on at a time
BATCH_BYTES = 1 << 22

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Token ids of each document, then ``end_id``, in pieces of at most ``capacity``.

    A longer document is cut so that its first piece may be shorter.  A null text
    counts as empty: one piece with the end id.  A repeated row is packed again.
    ``ids`` holds little-endian unsigned 32-bit integers.
    """

    def cut(batches):
        encoder = default_encoder()
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            out, size = [[] for _ in range(5)], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                total = len(ids) // 4
                at = 0
                until = total % capacity or capacity
                piece = 0
                while at < total:
                    for values, x in zip(out, (doc_id, piece, at, until - at, ids[at * 4 : until * 4]), strict=True):
                        values.append(x)
                    piece, at, until = piece + 1, until, until + capacity
                size += len(ids)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays(_typed(out), names=["doc_id", "piece", "start", "length", "ids"])
                    out, size = [[] for _ in range(5)], 0
            yield pa.RecordBatch.from_arrays(_typed(out), names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def _typed(columns):
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)]


def best_fit(lengths, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and the fill of each bin.

    ``lengths`` come longest first.  Bins with one amount of free space are kept
    together, and the bits of one integer tell which amounts there are, so the
    best fit is found without a search.
    """
    free: dict[int, list[int]] = {}
    there = 0
    bins, offsets, fills = [], [], []
    for length in lengths:
        fitting = there >> length
        if fitting:
            space = length + ((fitting & -fitting).bit_length() - 1)
            same = free[space]
            at = heapq.heappop(same)
            if not same:
                there &= ~(1 << space)
        else:
            space, at = capacity, len(fills)
            fills.append(0)
        bins.append(at)
        offsets.append(fills[at])
        fills[at] += length
        rest = space - length
        if rest:
            heapq.heappush(free.setdefault(rest, []), at)
            there |= 1 << rest
    return bins, offsets, fills


def _round(items: DataFrame, n_blocks: int, level: int, capacity: int) -> DataFrame:
    """Best-fit in blocks; ``bin`` numbers hold the level, the block and the bin."""

    def pack(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        table = table.sort_by([("length", "descending"), ("item", "ascending")])
        bins, offsets, fills = best_fit(table.column("length").to_pylist(), capacity)
        base = (level << 58) | (block << 26)
        rest = sorted((fill, at) for at, fill in enumerate(fills) if capacity - fill > NEARLY_FULL)
        passed = {at for _, at in rest[:PASSED_ON]}
        return pa.table({
            "item": table.column("item"), "bin": pa.array([base + at for at in bins], pa.int64()),
            "offset": pa.array(offsets, pa.int64()), "fill": pa.array([fills[at] for at in bins], pa.int64()),
            "open": pa.array([at in passed for at in bins], pa.bool_()),
        })

    dealt = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(n_blocks)).alias("block"))
    return dealt.groupBy("block").applyInArrow(pack, "item long, bin long, offset long, fill long, open boolean")


def assign(items: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """``item`` (unique long) and ``length`` (1 to capacity) to ``sequence_id`` and ``offset``."""
    n = items.count()
    n_blocks = max(1, -(-n // BLOCK_ITEMS))
    placed = written(_round(items, n_blocks, 0, capacity), "packed")
    result = placed.select("item", F.col("bin").alias("sequence_id"), "offset")
    level = 0
    while n_blocks > 1:
        n_blocks = -(-n_blocks // FAN_IN)
        level += 1
        underfull = placed.where("open").groupBy("bin").agg(F.max("fill").alias("length")).withColumnRenamed("bin", "item")
        placed = written(_round(underfull, n_blocks, level, capacity), "packed")
        moved = placed.select(F.col("item").alias("sequence_id"), F.col("bin").alias("up"), F.col("offset").alias("base"))
        result = result.join(moved, "sequence_id", "left").select(
            "item", F.coalesce("up", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")
        )
    return result


def pack(pieces_: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Written pieces (with ``length``) and where they lie: ``sequence_id`` and ``offset``.

    Every piece gets a place and pieces of a sequence follow one another without a gap.
    An empty table gives an empty result.
    """
    numbered = written(pieces_.withColumn("item", F.monotonically_increasing_id()), "pieces")
    return numbered.join(assign(numbered.select("item", "length"), capacity), "item").drop("item")
