"""Exact top-k search by distributed histogram selection.

Components are quantised to ``floor(1024 x)``; the score is the integer inner
product.  Queries are taken in blocks of a fixed number of vectors.  For one
block every candidate partition scores all its vectors and adds the scores to
one histogram per query over that query's current score range; the summed
histograms tell in which bin the k-th highest score lies, and the range shrinks
to that bin until it holds one value.  A last pass keeps what is above the k-th
score, and of what equals it the smallest ids that are still needed.  A
partition never reports bins below its own k-th score, nor more than k ties:
neither can hold a result.  So what leaves a task is bounded by queries x k,
however many vectors are equal.

Defined results: vectors that are null or hold a null or a non-finite component
take no part; vectors of different length don't meet; ids that are null take no
part (they can't be named); repeated rows each count; a query with fewer than k
candidates returns them all; of rows that share an id each asks for itself and is a
candidate of the others, so such a ``query_id`` has one ranking per row; a score that
64 bits can't hold is an error, as is a component beyond them; vectors of no
components meet each other with score 0; an empty table gives no rows; other
columns, of any name, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialised

SCALE, K, BINS = 1024, 10, 256
QUERY_BLOCK = 4096
_EXACT = float(1 << 53)
_HOLDS = float(1 << 63) * (1 - 2.0 ** -40)              # rounding of the floating check stays below


def quantised(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v array<bigint>`` of the vectors that take part."""
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c * SCALE).cast("bigint"))
    return embeddings.where(F.col(embedding).isNotNull() & F.coalesce(finite, F.lit(False)) & F.col(vec_id).isNotNull()
                            ).select(F.col(vec_id).cast("bigint").alias("vec_id"), whole.alias("v"))


def _matrices(lists: pa.Array):
    """Per vector length: positions and int64 matrix."""
    off = np.asarray(lists.offsets)
    size, values = np.diff(off), np.asarray(lists.values)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), rows, values[off[rows][:, None] + np.arange(d)].reshape(len(rows), d).astype(np.int64)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; floating point only where no sum can lose a digit."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < _EXACT:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if top >= _HOLDS and a.size and b.size and np.abs(a.astype(float) @ b.T.astype(float)).max() >= _HOLDS:
        raise OverflowError("a score does not fit in 64 bits")
    return a @ b.T


def _score_blocks(batches, queries, rows: int):
    """``(query positions, scores (candidates x queries), candidate ids, mask)``; the mask
    leaves out a query's own row, ``rows`` bounds the size of a score block."""
    for b in batches:
        ids, own = b.column(0).to_numpy(), b.column(2).to_numpy()
        for d, where, m in _matrices(b.column(1)):
            if d not in queries:
                continue
            at, q_rows, q = queries[d]
            for i in range(0, len(where), rows):
                part = where[i:i + rows]
                yield at, _scores(m[i:i + rows], q), ids[part], own[part, None] != q_rows[None, :]


def _block(block: DataFrame):
    """The rows of one query block (bounded by ``QUERY_BLOCK``) and their vectors by length."""
    t = block.orderBy("row").toArrow().combine_chunks()
    rows = t["row"].to_numpy()
    lists = t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"]
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return rows, t["vec_id"].to_numpy(), {d: (at, rows[at], q) for d, at, q in _matrices(lists)}


def _kth_scores(vectors: DataFrame, n: int, queries: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the k-th highest score (the least one, if there are fewer
    candidates) and the number of results still needed at exactly that score."""
    spark = vectors.sparkSession
    rows = max(1, (1 << 21) // max(1, n))

    def extent(batches):
        lo, hi, count = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min), np.zeros(n, np.int64)
        for at, s, _, other in _score_blocks(batches, queries, rows):
            lo[at] = np.minimum(lo[at], np.where(other, s, np.iinfo(np.int64).max).min(0))
            hi[at] = np.maximum(hi[at], np.where(other, s, np.iinfo(np.int64).min).max(0))
            count[at] += other.sum(0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (np.arange(n), lo, hi, count)], ["q", "lo", "hi", "n"])

    lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    need = np.zeros(n, np.int64)
    for r in vectors.mapInArrow(extent, "q bigint, lo bigint, hi bigint, n bigint").groupBy("q").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect():
        lo[r.q], hi[r.q], need[r.q] = r.lo, r.hi, min(k, r.n)
    while (hi > lo).any():
        width = -(-(hi - lo + 1) // BINS)
        state = spark.sparkContext.broadcast((lo, width, hi, need))

        def histogram(batches):
            low, wide, high, wanted = state.value
            total = np.zeros((n, BINS), np.int64)
            for at, s, _, other in _score_blocks(batches, queries, rows):
                on = other & (s >= low[at]) & (s <= high[at])
                bins = ((s - low[at]) // wide[at])[on]
                column = np.broadcast_to(at, s.shape)[on]
                total += np.bincount(column * BINS + bins, minlength=n * BINS).reshape(n, BINS)
            above = total[:, ::-1].cumsum(1)[:, ::-1] - total
            q, bin_ = np.nonzero((total > 0) & (above < wanted[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(bin_), pa.array(total[q, bin_])], ["q", "bin", "n"])

        total = np.zeros((n, BINS), np.int64)
        for r in vectors.mapInArrow(histogram, "q bigint, bin bigint, n bigint").groupBy("q", "bin").agg(
                F.sum("n").alias("n")).toLocalIterator():
            total[r.q, r.bin] = r.n
        state.unpersist()
        reached = total[:, ::-1].cumsum(1)[:, ::-1]          # scores in this bin or a higher one
        bin_ = BINS - 1 - np.argmax(reached[:, ::-1] >= need[:, None], axis=1)
        open_ = hi > lo
        need = np.where(open_, need - (reached - total)[np.arange(n), bin_], need)
        hi = np.where(open_, np.minimum(hi, lo + (bin_ + 1) * width - 1), hi)
        lo = np.where(open_, lo + bin_ * width, lo)
    return lo, need


def _select(vectors: DataFrame, asked, ids, queries, kth, need) -> DataFrame:
    """What beats the k-th score, and the ``need`` smallest ids that equal it."""
    n, rows = len(ids), max(1, (1 << 21) // max(1, len(ids)))

    def run(batches):
        ties: dict[int, np.ndarray] = {}
        for at, s, c_ids, other in _score_blocks(batches, queries, rows):
            c, q = np.nonzero(other & (s > kth[at]))
            yield pa.RecordBatch.from_arrays([pa.array(asked[at[q]]), pa.array(ids[at[q]]), pa.array(c_ids[c]), pa.array(s[c, q])],
                                             ["row", "query_id", "vec_id", "score"])
            equal = other & (s == kth[at])
            for j in np.flatnonzero(equal.any(0)):
                p = int(at[j])
                ties[p] = np.sort(np.concatenate([ties.get(p, np.zeros(0, np.int64)), c_ids[equal[:, j]]]))[:need[p]]
        for p, found in ties.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), asked[p])), pa.array(np.full(len(found), ids[p])), pa.array(found),
                                              pa.array(np.full(len(found), kth[p]))], ["row", "query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "row bigint, query_id bigint, vec_id bigint, score bigint")


def top_k(embeddings: DataFrame, is_query: Column, k: int = K, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row that ``is_query`` (a
    condition on ``vec_id``), against every other row."""
    vectors = materialised(quantised(embeddings).withColumn("row", F.monotonically_increasing_id()))
    asked = vectors.where(is_query)
    blocks = max(1, -(-asked.count() // block))
    dealt = asked.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    dealt = materialised(dealt) if blocks > 1 else dealt
    found = None
    for i in range(blocks):
        rows, ids, queries = _block(dealt.where(F.col("b") == i).drop("b"))
        if not len(rows):
            continue
        kth, need = _kth_scores(vectors, len(rows), queries, k)
        # written before the next block: the driver holds the vectors of one block
        part = materialised(_select(vectors, rows, ids, queries, kth, need))
        found = part if found is None else found.union(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
