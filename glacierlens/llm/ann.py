"""Nearest neighbours by inner product: adaptive dimension scans within probed lists.

Vectors are turned by a fixed random rotation, which spreads any difference
evenly over the dimensions, and are dealt to the lists of a coarse quantizer.  A
query visits its nearest lists.  There it reads candidates one block of columns
at a time: from the partial distance so far, a hypothesis test drops those that
can't come into the query's best with more than a small chance.  What is left at
the end is scored in double precision on the original vectors.

The largest inner product is the smallest distance once the candidate's length
is taken out: |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, so a best score so far gives
each candidate its own limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glacierlens.llm.tables import written

K = 20
SEED = 11
# lists of the quantizer, rows they are fitted on, and rounds of fitting
LISTS = 64
SAMPLE = 16_384
ROUNDS = 8
# lists that a query visits, of LISTS
PROBES = 48
# columns read at a time, and the significance of the test: larger keeps more candidates
COLUMNS = 16
EPSILON = 2.6
# candidates and queries of one task's block
BLOCK_ROWS = 8192
BLOCK_QUERIES = 4096


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: vectors as doubles, without those that are null, zero, or hold a null or non-finite component."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))


def fit(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE) -> np.ndarray:
    """Centres of the lists of vectors of one length, on a sample of ``sample`` rows at most: those with the least hash of the id."""
    order = F.xxhash64("id", F.lit(SEED))
    rows = vectors.select("id", "v").orderBy(order, "id").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.unique(np.array([r[1] for r in rows]), axis=0)
    centres = x[np.random.default_rng(SEED).permutation(len(x))[:lists]]
    for _ in range(ROUNDS):
        near = _near(x, centres, 1)[:, 0]
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _near(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    d = (centres**2).sum(1) - 2 * x @ centres.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _lists(vectors: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """``id, v`` (bytes), and the numbers of the ``n`` nearest lists."""
    dim = centres.shape[1]

    def assign(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            right = np.diff(lists.offsets.to_numpy()) == dim
            x = lists.flatten().to_numpy(zero_copy_only=False)[np.repeat(right, np.diff(lists.offsets.to_numpy()))].reshape(-1, dim)
            near = _near(x, centres, n)
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(right)), pa.array([r.tobytes() for r in x], pa.binary()), out], names=["id", "v", "lists"])

    return vectors.select("id", "v").mapInArrow(assign, "id long, v binary, lists array<int>")


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    total = q[:, 0] * x[:, 0]
    for j in range(1, q.shape[1]):
        total = total + q[:, j] * x[:, j]
    return total


def scan(q_ids, q, limits, x_ids, x, turn, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of a block of candidates for each query: query row, candidate row, score.

    ``limits`` is a score that each query has ``k`` times already, or -inf.
    """
    dim = q.shape[1]
    tq, tx = q @ turn, x @ turn
    q2, x2 = (q**2).sum(1), (x**2).sum(1)
    # the first candidates give each query a limit to start with
    first = min(len(x), 4 * k)
    if len(x) >= k:
        start = np.sort(q @ x[:first].T - 1e300 * (q_ids[:, None] == x_ids[:first]), axis=1)
        if first > k:
            limits = np.maximum(limits, start[:, -k - 1] - 1e-9)
    # squared distance that a candidate with the limit's score would have
    room = q2[:, None] + x2[None, :] - 2 * limits[:, None]
    slack = 1e-9 * (q2[:, None] + x2[None, :])
    rows, cols = np.nonzero((room >= -slack) & (q_ids[:, None] != x_ids[None, :]))
    limit = np.maximum(room[rows, cols], 0) + slack[rows, cols]
    partial = np.zeros(len(rows))
    for at in range(0, dim, COLUMNS):
        seen = min(at + COLUMNS, dim)
        if len(rows) * 4 > len(q) * len(x):
            # most pairs are alive: the column block's distances of all of them at once
            a, b = tq[:, at:seen], tx[:, at:seen]
            square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T
            partial += square[rows, cols]
        else:
            partial += ((tq[rows, at:seen] - tx[cols, at:seen]) ** 2).sum(1)
        if seen < dim:
            # the partial distance of a candidate within the limit is at most this, but for a small chance
            stay = partial <= limit * (seen / dim) * (1 + EPSILON / np.sqrt(seen)) ** 2
            rows, cols, partial, limit = rows[stay], cols[stay], partial[stay], limit[stay]
    stay = partial <= limit * (1 + 1e-6)
    rows, cols = rows[stay], cols[stay]
    score = dots(q[rows], x[cols])
    order = np.lexsort((x_ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    best = place < k
    return rows[best], cols[best], score[best]


RESULT = "query_id long, vec_id long, score double"


def _scan_blocks(queries: DataFrame, candidates: DataFrame, dim: int, k: int) -> DataFrame:
    """Scan queries (``list, block, part, id, limit, v``) against candidates (``list, block, part, id, v``)."""

    def scan_block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        turn = rotation(dim)
        right = right.sort_by("id")
        x_ids, x = right.column("id").to_numpy(), _matrix(right.column("v"), dim)
        ids, limits, q = left.column("id").to_numpy(), left.column("limit").to_numpy(), _matrix(left.column("v"), dim)
        out = [[], [], []]
        for at in range(0, len(ids), 64):
            rows, cols, score = scan(ids[at : at + 64], q[at : at + 64], limits[at : at + 64], x_ids, x, turn, k)
            for values, found in zip(out, (ids[at : at + 64][rows], x_ids[cols], score), strict=True):
                values.append(found)
        return pa.table([np.concatenate(v) for v in out], names=["query_id", "vec_id", "score"])

    keys = ["list", "block", "part"]
    return queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(scan_block, RESULT)


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, lists: int = LISTS, probes: int = PROBES) -> DataFrame:
    """Each query's ``k`` nearest among all vectors but itself: ``query_id, rank, vec_id, score``.

    The same vector under another id is a candidate.  Vectors that are null, zero or
    hold null or non-finite components take no part.  Vectors of another length have no
    inner product with a query and are no candidates of it; each length, counted over all
    rows, is searched on its own.  Ties go to the smaller id.  Rows that repeat an id and vector count once.
    """
    good = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col)
    lengths = [r["dim"] for r in good.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect()]
    best = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in lengths:
        same = F.size("v") == dim
        found = _searched(good.where(same), asked.where(same), k, lists, probes)
        best = best.unionByName(found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    return best


def _searched(good: DataFrame, asked: DataFrame, k: int, lists: int, probes: int) -> DataFrame:
    """Search among vectors of one length."""
    centres = fit(good, lists)
    dim = centres.shape[1]
    probes = min(probes, len(centres))

    placed = written(_lists(good, centres, 1).select("id", "v", F.col("lists")[0].alias("list")).dropDuplicates(["id", "v"]), "lists")
    # a list's rows in blocks, as many as it needs; a task has one block and some of its queries
    sizes = placed.groupBy("list").agg(F.count("*").alias("n")).select("list", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    sizes = F.broadcast(written(sizes, "sizes"))  # one row for each list
    dealt = placed.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int"))

    visits = written(_lists(asked, centres, probes).dropDuplicates(["id", "v"]), "queries")
    n_parts = -(-max(1, visits.count()) // BLOCK_QUERIES)
    part = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(n_parts)).cast("int").alias("part")
    copies = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))).select("list", "block", "part", "id", "v")

    def at(first: int, last: int) -> DataFrame:
        probed = visits.select("id", "v", part, F.explode(F.slice("lists", first, last)).alias("list")).join(sizes, "list")
        return probed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    # the nearest lists give the limits that the others are tested with
    home = at(1, 2).withColumn("limit", F.lit(float("-inf"))).select("list", "block", "part", "id", "limit", "v")
    near = written(_best(_scan_blocks(home, copies, dim, k), k), "near")
    limits = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("limit"))
    rest = at(3, probes).join(limits, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("-inf"))))
    far = _scan_blocks(rest.select("list", "block", "part", "id", "limit", "v"), copies, dim, k)
    return _best(near.select("query_id", "vec_id", "score").unionByName(far), k)
