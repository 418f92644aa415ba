"""Exact Euclidean nearest neighbours by pivots.

A bounded number of stored rows serve as pivots.  Every stored row belongs to its
nearest pivot and, within it, to a ring of distances; pivot, ring, least and greatest
distance and the row count of a block are the whole index (at most ``PIVOTS * RINGS``
small rows, held like a model).  By the triangle inequality no row of a block is nearer
to a query than the gap between the query's distance to the pivot and the ring, so:

1. a query is scored against the blocks nearest to it that hold enough rows, which
   bounds its k-th distance;
2. it is scored against every other block whose gap doesn't exceed that bound.

Nothing is left out: the result equals a search of all pairs, ties go to the smaller id,
and the pairs scored are counted.  Blocks of many rows (copies of one vector, say) are
dealt into parts, and the queries of a block into chunks, so a task scores at most
``PART_ROWS`` x ``PART_ROWS`` pairs; a stored row is copied once per chunk of queries
that need its block, not once per chunk of all queries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .similarity import QUERY_CHUNK, _score_rows, _usable

PIVOTS, RINGS, PART_ROWS = 128, 8, 4096
_SLACK = 1e-9


def _distances(v: np.ndarray, pivots: np.ndarray, chunk: int = 1024) -> np.ndarray:
    out = np.empty((len(v), len(pivots)))
    for i in range(0, len(v), chunk):
        for j in range(len(pivots)):
            out[i:i + chunk, j] = np.linalg.norm(v[i:i + chunk] - pivots[j], axis=1)
    return out


class PivotIndex:
    """Index of ``rows`` by ``id_col`` and ``vec`` (``array<double>``, one length).

    Rows without an id and vectors that are null or hold a null or non-finite value
    take no part; other lengths are an error.
    """

    def __init__(self, rows: DataFrame, id_col: str, vec: str, pivots: int | None = None, rings: int = RINGS,
                 part_rows: int = PART_ROWS):
        self.id_col, self.part_rows, self.pairs = id_col, part_rows, 0
        own = cut_lineage(_usable(rows, id_col, vec).select(
            F.col(id_col).cast("bigint").alias("pid"), F.col(vec).cast("array<double>").alias("v")))
        lengths = own.agg(F.min(F.size("v")), F.max(F.size("v")), F.count(F.lit(1))).first()
        # about as many pivots as the rows of a block, at most PIVOTS; the result doesn't depend on it
        pivots = pivots or min(PIVOTS, 1 + math.isqrt(lengths[2] // rings))
        if lengths[0] != lengths[1]:
            raise ValueError("vectors of different lengths")
        self.dim = lengths[0]
        picked = own.orderBy(F.xxhash64("v"), "pid").limit(pivots).collect()       # at most PIVOTS rows
        self.pivots = np.unique(np.array([r.v for r in picked], dtype=float).reshape(len(picked), self.dim or 0), axis=0)
        self.rows = self.blocks = None
        if not len(self.pivots):
            return
        centres = self.pivots

        @F.pandas_udf("pivot int, dist double")
        def nearest(v: pd.Series) -> pd.DataFrame:
            d = _distances(np.vstack(v.to_numpy()), centres)
            at = d.argmin(axis=1)
            return pd.DataFrame({"pivot": at.astype(np.int32), "dist": d[np.arange(len(d)), at]})

        near = cut_lineage(own.withColumn("near", nearest("v")).select("pid", "v", "near.*"))
        edges = near.groupBy("pivot").agg(F.percentile_approx(
            "dist", [i / rings for i in range(1, rings)] or [0.5]).alias("e")).collect()          # one row per pivot
        cut = {r.pivot: r.e for r in edges}
        cuts = F.lit([[float(x) for x in cut[i]] if i in cut else [] for i in range(len(centres))]) \
            if rings > 1 else F.array(*[F.array().cast("array<double>") for _ in centres])
        ring = F.size(F.filter(cuts[F.col("pivot")], lambda x: x < F.col("dist")))
        self.rows = near.withColumn("block", F.col("pivot") * F.lit(rings) + ring).select("pid", "v", "pivot", "dist", "block")
        stats = self.rows.groupBy("block").agg(F.min("pivot").alias("pivot"), F.min("dist").alias("lo"),
                                               F.max("dist").alias("hi"), F.count(F.lit(1)).alias("n"))
        self.blocks = stats.orderBy("block").toPandas()                               # at most PIVOTS * RINGS rows
        parts = {int(b): -(-int(n) // part_rows) for b, n in zip(self.blocks.block, self.blocks.n)}
        self.parts = parts
        n_parts = F.create_map(*[F.lit(x) for b, p in parts.items() for x in (b, p)])
        self.rows = self.rows.withColumn("part", F.pmod(F.xxhash64("pid"), n_parts[F.col("block")]).cast("int"))

    def _visits(self, with_bound: bool, enough: int):
        """UDF: the blocks a query meets, first without and then with a bound."""
        centres, b = self.pivots, self.blocks
        block, pivot, lo, hi, n = (b[c].to_numpy() for c in ("block", "pivot", "lo", "hi", "n"))

        def gaps(v):
            d = _distances(np.vstack(v.to_numpy()), centres)[:, pivot]
            return d, np.maximum(0.0, np.maximum(d - hi, lo - d)) - _SLACK * (1.0 + d + hi)

        @F.pandas_udf("array<int>")
        def first(v: pd.Series) -> pd.Series:
            out = []
            for gap, far in zip(*(lambda d, g: (g, d + hi))(*gaps(v))):
                order = np.lexsort((far, gap))
                out.append(block[order[:np.searchsorted(np.cumsum(n[order]), enough) + 1]].astype(int).tolist())
            return pd.Series(out)

        @F.pandas_udf("array<int>")
        def rest(v: pd.Series, seen: pd.Series, bound: pd.Series) -> pd.Series:
            _, gap = gaps(v)
            reach = gap <= bound.fillna(np.inf).to_numpy()[:, None]
            return pd.Series([[int(x) for x in block[m] if x not in set(s)] for m, s in zip(reach, seen)])

        return rest if with_bound else first

    def _scored(self, asked: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """``qid, pid, score`` of the best ``k`` rows per query and part; ``asked`` has
        ``qid, v, block``, one row per visit."""
        per_block = {int(r.block): r.n for r in asked.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # as blocks
        sizes = dict(zip(self.blocks.block.astype(int), self.blocks.n.astype(int)))
        self.pairs += sum(n * sizes[b] for b, n in per_block.items())
        if not per_block:
            return asked.sparkSession.createDataFrame([], "qid bigint, pid bigint, score double")
        chunks = F.create_map(*[F.lit(x) for b, n in per_block.items() for x in (b, -(-n // self.part_rows))])
        parts = F.create_map(*[F.lit(x) for b in per_block for x in (b, self.parts[b])])
        block = F.col("block")
        q = asked.withColumn("chunk", F.pmod(F.xxhash64("qid"), chunks[block]).cast("int")).withColumn(
            "part", F.explode(F.sequence(F.lit(0), parts[block] - 1)))
        p = self.rows.where(chunks[block].isNotNull()).withColumn(
            "chunk", F.explode(F.sequence(F.lit(0), (chunks[block] - 1).cast("int"))))

        def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(a) and len(b):
                rows, ids = np.vstack(b["v"].to_numpy()), b["pid"].to_numpy(np.int64)
                for at in range(0, len(a), QUERY_CHUNK):
                    part = a.iloc[at:at + QUERY_CHUNK]
                    got = _score_rows(np.vstack(part["v"].to_numpy()), part["qid"].to_numpy(np.int64), rows, ids, k, False, exclude_self)
                    out.append(pd.DataFrame({"qid": np.asarray(got[0], np.int64), "pid": np.asarray(got[2], np.int64),
                                             "score": np.asarray(got[3], np.float64)}))
            return pd.concat(out, ignore_index=True) if out else pd.DataFrame(
                {"qid": np.zeros(0, np.int64), "pid": np.zeros(0, np.int64), "score": np.zeros(0)})

        keys = ("block", "part", "chunk")
        return q.groupBy(*keys).cogroup(p.select("pid", "v", *keys).groupBy(*keys)).applyInPandas(
            best, "qid bigint, pid bigint, score double")

    def search(self, queries: DataFrame, qid: str, vec: str, k: int, exclude_self: bool = False) -> DataFrame:
        """``qid, rank, neighbor_<id>, score``: the ``k`` nearest rows of each query
        (all, if fewer), nearest first; ``exclude_self`` leaves out rows with the
        query's id.  ``qid`` is unique."""
        asked = _usable(queries, qid, vec).select(F.col(qid).cast("bigint").alias("qid"), F.col(vec).cast("array<double>").alias("v"))
        if self.rows is None:
            return asked.select(F.col("qid").alias(qid), F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias(f"neighbor_{self.id_col}"),
                                F.lit(0.0).alias("score")).limit(0)
        if asked.where(F.size("v") != self.dim).limit(1).count():
            raise ValueError("vectors of different lengths")
        first = cut_lineage(asked.withColumn("seen", self._visits(False, k + exclude_self)("v")))
        near = cut_lineage(self._scored(first.select("qid", "v", F.explode("seen").alias("block")), k, exclude_self))
        w = Window.partitionBy("qid").orderBy("score", "pid")
        kth = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select("qid", F.col("score").alias("bound"))
        more = cut_lineage(first.join(kth, "qid", "left").withColumn("blocks", self._visits(True, k)("v", "seen", "bound"))
                           .select("qid", "v", F.explode("blocks").alias("block")))
        found = near.unionByName(self._scored(more, k, exclude_self))
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
            F.col("qid").alias(qid), "rank", F.col("pid").alias(f"neighbor_{self.id_col}"), "score")
