"""Exact top-k similarity search.

Spark has no vector top-k join.  Exact search needs every (query, profile)
score, but never as rows and never with rows copied for it: both sides are
packed once into blocks of at most ``BLOCK_ROWS`` vectors behind a checkpoint,
and ``RDD.cartesian`` lets every query block meet the profile blocks.  A task
holds one query block, reads its share of the profile blocks one after the
other, scores each pair of blocks by a numpy matrix product and keeps the best
``k`` profiles per query.  The profile blocks are dealt into a bounded number of
shares (``SHARES``, more if there are few query blocks), so what is shuffled
grows with the rows, although the pairs grow with their square.  A final
per-query ``row_number`` keeps ``k`` of the at most ``k * shares`` candidates.
No pair rows, no candidate cap: the result is the exact top-k.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK_ROWS = 4096
QUERY_CHUNK = 1024
# A task holds at most QUERY_CHUNK x BLOCK_ROWS scores (32 MB) at a time.
SHARES, FEW_TASKS = 8, 64
LABELS_HELD = 512
FEW_HITS = 1 << 16


def _blocks(n: int, rows: int) -> int:
    return max(1, int(math.ceil(n / rows)))


def _usable(rows: DataFrame, id_col: str, vec: str) -> DataFrame:
    bad = F.exists(F.col(vec).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull() & ~bad)


def _packed(rows: DataFrame, n: int, block_rows: int) -> DataFrame:
    """Rows ``id, v`` (and ``g``) as ``n`` partitions of blocks of at most ``block_rows``
    vectors of one length, one row a block, behind a checkpoint."""
    names = [c for c in ("id", "g") if c in rows.columns]

    def pack(batches):
        key, held = TaskContext.get().partitionId() << 32, {}

        def block(dim, parts):
            nonlocal key
            key += 1
            own = [np.concatenate(x) for x in zip(*parts)]
            if len(names) == 2:                                      # a cluster's rows lie together
                order = np.argsort(own[1], kind="stable")
                own = [x[order] for x in own]
            rest = [x[block_rows:] for x in own]
            own = [x[:block_rows].tobytes() for x in own]
            return rest, pa.RecordBatch.from_arrays(
                [pa.array([key]), pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in own)],
                ["block", "dim", *names, "v"])

        for b in batches:
            lengths = pc.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                t = b.filter(pa.array(lengths == dim))
                parts = held.setdefault(dim, [])
                parts.append([*(t.column(c).to_numpy() for c in names),
                              t.column("v").flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim)])
                while sum(len(x[0]) for x in parts) >= block_rows:
                    rest, full = block(dim, parts)
                    yield full
                    parts[:] = [rest] if len(rest[0]) else []
        for dim, parts in held.items():
            if parts:
                yield block(dim, parts)[1]

    kinds = ", ".join(f"{c} binary" for c in (*names, "v"))
    return cut_lineage(rows.select(*names, "v").repartition(n).mapInArrow(pack, f"block bigint, dim int, {kinds}"))


def _unpacked(row):
    """``ids, labels or None, vectors`` of a block."""
    ids = np.frombuffer(row["id"], np.int64)
    v = np.frombuffer(row["v"], np.float64) if row["dim"] else np.zeros(0)
    return ids, np.frombuffer(row["g"], np.int64) if "g" in row else None, v.reshape(len(ids), row["dim"])


def _meetings(left: DataFrame, right: DataFrame, begun, schema: str) -> DataFrame:
    """Rows of ``schema`` from every block of ``left`` and the blocks of ``right`` of its
    length: ``begun(*block)`` gives an object whose ``meet(*block)`` takes the right
    blocks and whose ``found()`` yields Arrow tables, at the latest after the last one."""
    n_left, n_right = (max(1, b.rdd.getNumPartitions()) for b in (left, right))
    shares = min(n_right, max(SHARES, -(-FEW_TASKS // n_left)))

    def sent(tables):
        for t in tables:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as out:
                out.write_table(t)
            yield (sink.getvalue().to_pybytes(),)

    def run(pairs):
        at = own = None
        for a, b in pairs:
            if a["block"] != at:
                if own is not None:
                    yield from sent(own.found())
                at, own = a["block"], begun(*_unpacked(a))
            if a["dim"] == b["dim"]:
                yield from sent(own.meet(*_unpacked(b)))
        if own is not None:
            yield from sent(own.found())

    def rows(batches):
        for b in batches:
            for x in b.column(0):
                yield from pa.ipc.open_stream(x.as_buffer()).read_all().to_batches()

    met = left.rdd.cartesian(right.coalesce(shares).rdd).mapPartitions(run)
    return left.sparkSession.createDataFrame(met, "part binary").mapInArrow(rows, schema)


class _Best:
    """The best ``k`` profiles so far of every query of a block."""

    def __init__(self, ids, vectors, k, cosine, exclude_self):
        self.ids, self.vectors, self.k, self.cosine, self.exclude_self = ids, vectors, k, cosine, exclude_self
        self.key = np.full((len(ids), k), np.inf)          # lower is better
        self.pid = np.zeros((len(ids), k), np.int64)

    def meet(self, pids, _, profiles):
        if self.cosine:
            nrm = np.linalg.norm(profiles, axis=1)
            profiles = profiles / np.where(nrm == 0, 1.0, nrm)[:, None]
        for at in range(0, len(self.ids), QUERY_CHUNK):
            part = slice(at, at + QUERY_CHUNK)
            worst = self.key[part, -1]
            _, row, pid, score = _score_rows(self.vectors[part], self.ids[part], profiles, pids, self.k, self.cosine,
                                             self.exclude_self, worst if self.cosine else worst ** 2)
            if len(row):
                score = np.asarray(score, np.float64)
                self._merge(np.asarray(row, np.int64) + at, np.asarray(pid, np.int64), -score if self.cosine else score)
        return ()

    def _merge(self, row, pid, key):
        hit = np.unique(row)
        row = np.concatenate([np.repeat(hit, self.k), row])
        key = np.concatenate([self.key[hit].ravel(), key])
        pid = np.concatenate([self.pid[hit].ravel(), pid])
        order = np.lexsort((pid, key, row))
        first = np.searchsorted(row[order], hit)
        kept = order[first[:, None] + np.arange(self.k)]
        self.key[hit], self.pid[hit] = key[kept], pid[kept]

    def found(self):
        some = np.isfinite(self.key)
        key = self.key[some]
        yield pa.table({"qid": np.repeat(self.ids, some.sum(axis=1)), "pid": self.pid[some],
                        "score": -key if self.cosine else key})


def topk_similar(queries: DataFrame, profiles: DataFrame, qid: str, pid: str, qvec: str, pvec: str,
                 k: int = 5, metric: str = "cosine", exclude_self: bool = False,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Top-``k`` profiles per query; returns (qid, rank, pid, score).

    ``metric='cosine'`` scores by cosine similarity (higher first);
    ``'euclidean'`` by distance (lower first).  Ties go to the smaller
    profile id.  ``exclude_self`` drops pairs with equal ids (J6).  Rows without an id
    and vectors that are null or hold a null or non-finite value take no part;
    vectors of different lengths don't meet.
    """
    cosine = metric == "cosine"

    def side(rows, id_col, vec):
        rows = _usable(rows, id_col, vec).select(F.col(id_col).cast("bigint").alias("id"),
                                                 F.col(vec).cast("array<double>").alias("v"))
        return _packed(rows, _blocks(rows.count(), block_rows), block_rows)

    q = side(queries, qid, qvec)
    p = q if queries is profiles and (qid, qvec) == (pid, pvec) else side(profiles, pid, pvec)
    cand = _meetings(q, p, lambda ids, _, v: _Best(ids, v, k, cosine, exclude_self), "qid bigint, pid bigint, score double")
    o = F.col("score").desc() if cosine else F.col("score").asc()
    w = Window.partitionBy("qid").orderBy(o, F.col("pid"))
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("qid").alias(qid), "rank", F.col("pid").alias(f"neighbor_{pid}"), "score")


def _score_rows(Q, qids, P, pids, k, cosine, exclude_self, bound=None):
    """Exact top-k of each query row against matrix P (ties to the smaller id, exact
    Euclidean ranking): query id, query row, id and score.  ``bound``: per query the worst
    key (negative cosine, squared distance) of interest; queries without one as good are
    left out, and few profiles as good are all returned, also more than ``k`` a query."""
    import numpy as np
    rows = np.arange(len(Q))
    if cosine:
        qn = np.linalg.norm(Q, axis=1)
        key = -((Q / np.where(qn == 0, 1.0, qn)[:, None]) @ P.T)
        slack = np.zeros(len(Q))
    else:
        q2 = np.einsum("ij,ij->i", Q, Q)
        p2 = np.einsum("ij,ij->i", P, P)
        key = q2[:, None] + p2[None, :] - 2.0 * (Q @ P.T)
        slack = 1e-9 * (q2 + p2.max()) + 1e-12
    if exclude_self:
        key[qids[:, None] == pids[None, :]] = np.inf
    if bound is not None:
        rows = np.flatnonzero(np.fmin.reduce(key, axis=1) <= bound + slack)
        key, slack = key[rows], slack[rows]
        hit = key <= (bound[rows] + slack)[:, None]
        if np.count_nonzero(hit) <= FEW_HITS:
            at, cand = np.nonzero(hit & np.isfinite(key))
            score = -key[at, cand] if cosine else np.sqrt(np.sum((P[cand] - Q[rows[at]]) ** 2, axis=1))
            return qids[rows[at]], rows[at], pids[cand], score
    kk = min(k, key.shape[1])
    idx = np.argpartition(key, kk - 1, axis=1)[:, :kk] if kk < key.shape[1] else \
        np.tile(np.arange(key.shape[1]), (key.shape[0], 1))
    thr = np.take_along_axis(key, idx, axis=1).max(axis=1) + slack
    out_q, out_p, out_s, out_r = [], [], [], []
    for r, row in enumerate(rows.tolist()):
        cand = np.nonzero(key[r] <= thr[r])[0]
        cand = cand[np.isfinite(key[r, cand])]
        if cosine:
            sc = -key[r, cand]
            order = np.lexsort((pids[cand], -sc))[:kk]
        else:
            sc = np.sqrt(np.sum((P[cand] - Q[row]) ** 2, axis=1))
            order = np.lexsort((pids[cand], sc))[:kk]
        out_q += [qids[row]] * len(order)
        out_r += [row] * len(order)
        out_p += list(pids[cand[order]])
        out_s += list(sc[order])
    return out_q, out_r, out_p, out_s


def l2_normalise(df: DataFrame, vec: str, out: str) -> DataFrame:
    """Unit-length vector (zero vector stays zero)."""
    v = F.col(vec).cast("array<double>")
    nrm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return df.withColumn(out, F.transform(v, lambda x: F.when(nrm == 0, x).otherwise(x / nrm)))


def knn_regress(queries: DataFrame, train: DataFrame, qid: str, pid: str, vec: str, target: str, k: int = 5,
                weighted: bool = False, exclude_self: bool = False, index=None) -> DataFrame:
    """K-nearest-neighbour regression on Euclidean distance; uniform
    mean, or inverse-distance weights where a zero distance takes all
    weight.  ``index``: a ``PivotIndex`` of the training rows, if there is one."""
    top = index.search(queries, qid, vec, k, exclude_self) if index is not None else \
        topk_similar(queries, train, qid, pid, vec, vec, k, "euclidean", exclude_self)
    t = train.select(F.col(pid).alias(f"neighbor_{pid}"), F.col(target).alias("_y"))
    j = top.join(t, on=f"neighbor_{pid}", how="inner")
    if not weighted:
        return j.groupBy(qid).agg(F.avg("_y").alias("prediction"))
    zero = F.col("score") == 0
    inv_mean = (F.sum(F.when(~zero, F.col("_y") / F.col("score"))) /
                F.sum(F.when(~zero, 1.0 / F.col("score"))))
    return j.groupBy(qid).agg(F.when(F.max(zero.cast("int")) == 1, F.avg(F.when(zero, F.col("_y"))))
                               .otherwise(inv_mean).alias("prediction"))


class _Distances:
    """Per row of a block the sums of distances to the rows of each cluster."""

    def __init__(self, ids, labels, vectors):
        self.ids, self.labels, self.vectors, self.totals = ids, labels, vectors, {}

    def meet(self, _, labels, q):
        q2 = np.einsum("ij,ij->i", q, q)
        groups, first = np.unique(labels, return_index=True)     # the rows of a block are in the order of labels
        total = np.empty((len(self.ids), len(groups)))
        for at in range(0, len(self.ids), QUERY_CHUNK):
            p = self.vectors[at:at + QUERY_CHUNK]
            both = np.einsum("ij,ij->i", p, p)[:, None] + q2[None, :]
            sq = both - 2.0 * (p @ q.T)
            near = np.argwhere(sq <= 1e-6 * both)               # digits are lost there: from the differences
            for n in range(0, len(near), 1 << 16):
                i, j = near[n:n + (1 << 16)].T
                sq[i, j] = np.sum((p[i] - q[j]) ** 2, axis=1)
            total[at:at + QUERY_CHUNK] = np.add.reduceat(np.sqrt(sq), first, axis=1)
        for g, column in zip(groups.tolist(), total.T):
            self.totals[g] = self.totals[g] + column if g in self.totals else column.copy()
        if len(self.totals) > LABELS_HELD:
            yield from self.found()

    def found(self):
        for g, total in self.totals.items():
            yield pa.table({"id": self.ids, "g": self.labels, "other": np.full(len(self.ids), g), "total": total})
        self.totals = {}


def silhouette_rows(rows: DataFrame, id_col: str, vec: str, label: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact Euclidean silhouette of every row: ``id, label, silhouette``.

    ``(b - a) / max(a, b)`` with ``a`` the mean distance to the other rows of the own
    cluster and ``b`` the least mean distance to another one; 0 in a cluster of one row.
    Blocks of rows meet as in ``topk_similar``; a task adds up, per row and cluster, the
    distances to its share of the blocks and returns sums only, which are added over the
    shares.  ``id_col`` is unique; rows without an id, a label or a finite vector take
    no part, rows of different lengths don't meet.  With one cluster only it is null.
    """
    rows = _usable(rows, id_col, vec).where(F.col(label).isNotNull())
    base = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"),
                       F.col(label).cast("bigint").alias("g"))
    blocks = _packed(base, _blocks(rows.count(), block_rows), block_rows)
    sums = _meetings(blocks, blocks, _Distances, "id bigint, g bigint, other bigint, total double").groupBy(
        "id", "g", "other").agg(F.sum("total").alias("total"))
    sizes = base.groupBy(F.col("g").alias("other")).agg(F.count(F.lit(1)).alias("size"))       # one row per cluster
    mean = sums.join(sizes, "other")
    same = F.col("g") == F.col("other")
    ab = mean.groupBy("id", "g").agg(
        F.max(F.when(same, F.col("size"))).alias("own"),
        F.max(F.when(same, F.try_divide(F.col("total"), F.col("size") - 1))).alias("a"),
        F.min(F.when(~same, F.col("total") / F.col("size"))).alias("b"))
    s = F.when(F.col("b").isNull(), F.lit(None)).when(F.col("own") == 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.select(F.col("id").alias(id_col), F.col("g").alias(label), s.alias("silhouette"))
