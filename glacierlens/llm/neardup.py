"""Near duplicates: one-permutation MinHash, optimal densification, stars in banded buckets.

One hash of each shingle gives both its bin and its value.  A bin that no
shingle fell into borrows the value of a bin found by hashing its number again
and again, the same way for every document (optimal densification).  Bands of
bins make the bucket keys.

A first pass joins most of a bucket by stars: in each round a member meets one hub,
the first in a drawn order among the hubs of all its buckets, and components are
contracted.  Then every pair of a bucket that still spans components is looked
at: small buckets give their pairs, large ones are cut into blocks and pairs of
blocks compared by bitmaps of the shingles, which bound the similarity from above.
Links are confirmed on full shingle sets.  Documents with equal sets are one node
from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glacierlens.llm import words
from glacierlens.llm.components import components
from glacierlens.llm.tables import discard, written

SHINGLE = 5
# similarity in hundredths
LEAST = 75
BINS = 256
ROWS = 5
BANDS = BINS // ROWS
# rounds of hubs at most, as long as they join something; what they leave is compared pair by pair
ROUNDS = 6
# a bucket up to this size gives its pairs as rows; a larger one is cut into blocks of about BLOCK members
SMALL = 16
BLOCK = 1024
# bits of a document's bitmap: a power of two from eight times its shingles, within these bounds
LEAST_BITS = 512
MOST_BITS = 1 << 16
# bytes of text whose words and shingles are numbers in memory at a time; a longer text is handled alone
TEXT_BYTES = 1 << 19
# bits that are unpacked at a time
SLICE = 4096

U = np.uint64
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document number and fingerprint of each distinct shingle, in order of both."""
    begun, _, prints = words.fingerprints(b"\n".join(texts))
    counts = words.word_counts(begun, texts)
    n = len(prints)
    doc = np.repeat(np.arange(len(texts)), counts)
    grams, owner = [], []
    if n >= SHINGLE:
        acc = prints[: n - SHINGLE + 1]
        for k in range(1, SHINGLE):
            acc = words.chain(acc, prints[k : n - SHINGLE + 1 + k])
        inside = doc[: len(acc)] == doc[SHINGLE - 1 :]
        grams.append(acc[inside])
        owner.append(doc[: len(acc)][inside])
    starts = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        acc = prints[starts[short]]
        for k in range(1, SHINGLE - 1):
            more = counts[short] > k
            acc[more] = words.chain(acc[more], prints[starts[short][more] + k])
        grams.append(words.mix(acc + counts[short].astype(np.uint64)))
        owner.append(short)
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return owner[first], grams[first]


def signatures(owner: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """Densified one-permutation signature of each document that has a shingle."""
    scrambled = words.mix(grams ^ U(0x5851F42D4C957F2D))
    own = np.full(n * BINS, EMPTY)
    np.minimum.at(own, owner * BINS + (scrambled >> U(56)).astype(np.int64), scrambled & U((1 << 56) - 1))
    full = own.copy()
    at = np.flatnonzero(own == EMPTY)
    at = at[np.isin(at // BINS, owner)] if len(at) else at
    attempt = 0
    while len(at):
        attempt += 1
        tried = words.mix((at % BINS).astype(np.uint64) * U(0x2545F4914F6CDD1D) + U(attempt)) >> U(56)
        found = own[at - at % BINS + tried.astype(np.int64)]
        got = found != EMPTY
        full[at[got]] = found[got]
        at = at[~got]
    return full.reshape(n, BINS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """Bucket key of each document and band; the band's number is part of the key."""
    keys = np.empty((len(signature), BANDS), np.uint64)
    for band in range(BANDS):
        acc = np.full(len(signature), U(band + 1))
        for row in range(ROWS):
            acc = words.chain(acc, signature[:, band * ROWS + row])
        keys[:, band] = acc
    return keys


def _signed(batch):
    """Rows of ids, text keys, set sizes, two set fingerprints and bucket keys."""
    ids, text_keys = batch.column(0), (batch.column(2), batch.column(3))
    for first, texts in words.buffers(batch.column(1), TEXT_BYTES):
        owner, grams = shingle_sets([t.lower() for t in texts])
        n = len(texts)
        size = np.bincount(owner, minlength=n)
        one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        np.add.at(one, owner, words.mix(grams))
        np.add.at(two, owner, words.mix(~grams))
        keys = band_keys(signatures(owner, grams, n)).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays(
            [ids.slice(first, n), *(k.slice(first, n) for k in text_keys), pa.array(size.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists],
            names=["doc_id", "text_a", "text_b", "n_shingles", "set_a", "set_b", "bands"],
        )


def text_key(text) -> list:
    """Two hashes that name a text."""
    return [F.xxhash64(text, F.lit("a")), F.xxhash64(F.lit("b"), text)]


def sketches(docs: DataFrame) -> DataFrame:
    """Set size, set fingerprints and bucket keys of each document's whole text, and the text's key."""

    def sketch(batches):
        for batch in batches:
            yield from _signed(batch)

    a, b = text_key(F.col("text"))
    kind = "doc_id long, text_a long, text_b long, n_shingles long, set_a long, set_b long, bands array<long>"
    return docs.select("doc_id", "text", a, b).mapInArrow(sketch, kind)


def bitmap(grams: np.ndarray) -> bytes:
    """A bit for each shingle at its hash; a shorter bitmap is the longer one folded."""
    width = LEAST_BITS
    while width < min(8 * len(grams), MOST_BITS):
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(words.mix(grams ^ U(0x94D049BB133111EB)) & U(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(maps: np.ndarray, width: int) -> np.ndarray:
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def similar_enough(n: np.ndarray, maps: list[bytes], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a ``left`` and a ``right`` document that may be similar enough.

    A bit that only one of two documents has stands for at least one shingle that
    only it has, so no similar pair is left out.
    """
    sizes = np.array([len(x) for x in maps])
    found_a, found_b = [], []
    for wide_a in np.unique(sizes[left]):
        for wide_b in np.unique(sizes[right]):
            # sets of similar size have bitmaps of one size or neighbouring ones
            if max(wide_a, wide_b) > 2 * min(wide_a, wide_b):
                continue
            width = int(min(wide_a, wide_b))
            a, b = left[sizes[left] == wide_a], right[sizes[right] == wide_b]
            x = _folded(np.frombuffer(b"".join(maps[i] for i in a), np.uint8).reshape(len(a), wide_a), width)
            y = _folded(np.frombuffer(b"".join(maps[i] for i in b), np.uint8).reshape(len(b), wide_b), width)
            both = np.zeros((len(a), len(b)), np.float32)
            ones_a, ones_b = np.zeros(len(a), np.float32), np.zeros(len(b), np.float32)
            for at in range(0, width, SLICE // 8):
                p = np.unpackbits(x[:, at : at + SLICE // 8], axis=1).astype(np.float32)
                q = np.unpackbits(y[:, at : at + SLICE // 8], axis=1).astype(np.float32)
                both += p @ q.T
                ones_a += p.sum(1)
                ones_b += q.sum(1)
            most = np.minimum(n[a][:, None] - (ones_a[:, None] - both), n[b][None, :] - (ones_b[None, :] - both))
            i, j = np.nonzero(100 * most >= LEAST * (n[a][:, None] + n[b][None, :] - most))
            found_a.append(a[i])
            found_b.append(b[j])
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _compare(unit: pa.Table) -> pa.Table:
    """Pairs of two blocks (or of one with itself) that may be links between components."""
    node, comp = np.array(unit["node"].to_pylist(), np.int64), np.array(unit["comp"].to_pylist(), np.int64)
    n, side = np.array(unit["n"].to_pylist(), np.float64), np.array(unit["side"].to_pylist(), np.int64)
    maps = unit["bits"].to_pylist()
    one, two = unit["one"][0].as_py(), unit["two"][0].as_py()
    a, b = similar_enough(n, maps, np.flatnonzero(side == one), np.flatnonzero(side == two))
    keep = (comp[a] != comp[b]) & ((one != two) | (node[a] < node[b]))
    a, b = a[keep], b[keep]
    # a pair belongs to the first bucket it shares
    key, bands = unit["key"][0].as_py(), [set(x) for x in unit["bands"].to_pylist()]
    first = np.array([min(bands[i] & bands[j]) == key for i, j in zip(a.tolist(), b.tolist())], bool)
    a, b = node[a[first]], node[b[first]]
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _rest(placed: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that share a bucket, lie in two components and may be similar enough.

    All pairs of all buckets are looked at; of those of large buckets each comes from the
    first bucket it shares.  ``placed`` has ``key, node, n, comp``, ``nodes`` has ``bands``.
    """
    held = placed.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    held = written(held.where("low <> high").select("key", "m"), "apart")
    few = placed.join(held.where(F.col("m") <= SMALL).select("key"), "key")
    other = few.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
    alike = (F.col("node") < F.col("b")) & (F.col("comp") != F.col("comp_b")) & (100 * F.least("n", "n_b") >= LEAST * F.greatest("n", "n_b"))
    pairs = few.join(other, "key").where(alike).select(F.col("node").alias("a"), "b")

    many = held.where(F.col("m") > SMALL).select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    side = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    sent = placed.join(many, "key").withColumn("side", side)
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("key", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), "node", "n", "comp", "side")
    sent = sent.join(sets.select("node", "bits").join(nodes.select("node", "bands"), "node"), "node")
    crowded = sent.groupBy("key", "one", "two").applyInArrow(_compare, "a long, b long")
    return pairs.union(crowded).distinct()


def _sets(wanted: DataFrame) -> DataFrame:
    """Sorted shingle fingerprints of ``node, text``, eight bytes each, and their bitmap."""

    def gather(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, texts in words.buffers(batch.column(1), TEXT_BYTES):
                owner, grams = shingle_sets([t.lower() for t in texts])
                n = len(texts)
                cuts = np.searchsorted(owner, np.arange(n + 1))
                blobs = [grams[cuts[i] : cuts[i + 1]].tobytes() for i in range(n)]
                maps = [bitmap(grams[cuts[i] : cuts[i + 1]]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), pa.array(blobs, pa.binary()), pa.array(maps, pa.binary())], names=["node", "grams", "bits"])

    return wanted.mapInArrow(gather, "node long, grams binary, bits binary")


def _confirm(pairs: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose sets ``x, y`` are similar enough."""

    def confirm(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[i] = 100 * both >= LEAST * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")


def _stars(placed: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One pair ``a, b`` for a member at most, and the keys of buckets with more than one component.

    A bucket's hub is its first member in the order of this round.  A member meets the
    first of its buckets' hubs that lies in another component and has a similar size, so a
    round has no more pairs than members.  The order is that of ``id``, the node's
    smallest document id, hashed: the numbers of nodes differ from run to run.
    """
    order = F.xxhash64("id", F.lit(turn))
    hubs = placed.groupBy("key").agg(F.min(F.struct(order.alias("order"), "node", "n", "comp")).alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    hubs = written(hubs.where("low <> high").select("key", "hub"), "hubs")
    alike = (F.col("hub.comp") != F.col("comp")) & (100 * F.least("n", "hub.n") >= LEAST * F.greatest("n", "hub.n"))
    met = placed.join(hubs, "key").where(alike).groupBy("node").agg(F.min("hub").alias("hub"))
    pairs = met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    return pairs, hubs


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links between nodes."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(labels.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
    merged = components(ends).select(F.col("node").alias("old"), F.col("comp").alias("new"))
    known = labels.select("node", F.col("comp").alias("old"))
    loose = merged.join(known.select("old"), "old", "left_anti").select(F.col("old").alias("node"), "old")
    both = known.union(loose).join(merged, "old", "left")
    return written(both.select("node", F.coalesce("new", "old").alias("comp")), "labels")


def link(docs: DataFrame) -> DataFrame:
    """Near-duplicate components of documents ``doc_id, text``.

    One row per row: ``doc_id, n_shingles, component_id, kept``, and what names its
    set (``set_a, set_b``) and its text (``text_a, text_b``, see :func:`text_key`).  The component is
    named by its smallest id and kept is true for that document.  A document
    without words is linked with nothing, and so is one without an id: its
    component is null and it is kept.  Rows that share an id are judged by their own
    texts: each set is a node, whatever its ids.
    """
    drawn = written(sketches(docs), "sketches")
    named = drawn.where("n_shingles > 0 and doc_id is not null")
    same = ["set_a", "set_b", "n_shingles"]
    one = F.min(F.struct("doc_id", "text_a", "text_b")).alias("one")
    nodes = named.groupBy(*same).agg(one, F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id())
    nodes = written(nodes, "nodes")

    # buckets of two nodes or more
    dealt = nodes.select("node", F.col("one.doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    full = written(dealt.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "buckets")
    members = written(dealt.join(full, "key").select("key", "node", "id", "n"), "members")
    # one row holds the text of each wanted node
    wanted = nodes.join(members.select("node").distinct(), "node").select("one.*", "node")
    keyed = docs.select("doc_id", "text", *[k.alias(c) for k, c in zip(text_key(F.col("text")), ("text_a", "text_b"), strict=True)])
    texts = keyed.join(wanted, ["doc_id", "text_a", "text_b"]).select("node", "text")
    sets = written(_sets(texts).dropDuplicates(["node"]), "sets")
    done = [full]

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
        both = both.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
        return written(_confirm(both), "links")

    def labelled(members: DataFrame) -> DataFrame:
        if labels is None:
            return members.withColumn("comp", F.col("node"))
        return members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    labels, tested = None, None
    for turn in range(ROUNDS):
        pairs, hubs = _stars(labelled(members), turn)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        # buckets whose members are still apart; the others are done
        left = written(members.join(hubs.select("key"), "key", "left_semi"), "members")
        discard(hubs, members)
        members = left
        tested = pairs if tested is None else tested.union(pairs)
        links = confirmed(pairs)
        done += [pairs, links]
        if links.isEmpty():
            break
        labels = components(links) if labels is None else _joined(labels, links)

    # what the hubs have left, pair by pair
    pairs = written(_rest(labelled(members), sets, nodes).join(tested, ["a", "b"], "left_anti"), "pairs")
    done += [pairs, members]
    if not pairs.isEmpty():
        links = confirmed(pairs)
        done.append(links)
        if not links.isEmpty():
            labels = components(links) if labels is None else _joined(labels, links)

    heads = nodes.select("node", *same, F.col("one.doc_id").alias("low"))
    if labels is not None:
        heads = heads.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = heads.groupBy("comp").agg(F.min("low").alias("low"))
        heads = heads.drop("low").join(least, "comp")
    heads = written(heads.select(*same, "low"), "heads")
    discard(sets, nodes, *done)
    found = drawn.drop("bands").join(heads, same, "left")
    own = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    found = found.withColumn("component_id", F.when(own, F.col("doc_id")).otherwise(F.col("low")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return found.select("doc_id", "n_shingles", "component_id", kept, "set_a", "set_b", "text_a", "text_b")
