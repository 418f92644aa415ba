"""Second-order histogram boosting (M13, M15): leaf penalties and best-first growth.

Spark's own boosted trees have neither L1/L2 leaf penalties nor a limit on leaves.
Here every feature is cut at exact quantiles once; a row is then one byte pair per
feature, its label and its margin.  A pass over the rows sums gradients and Hessians
per (node, feature, bin): in numpy within a task, then by Spark's aggregation over
cells, so a cell's rows never meet.  What reaches the driver is bounded by
nodes x features x bins, whatever the number of rows.

Trees grow best-first: the leaf of highest gain is split next.  One pass splits all
leaves that can still be among the best, so a tree needs as many passes as it is deep,
and it equals the one grown with a pass per split.  With ``max_depth`` alone that is
depth-wise growth.  Every ``REFRESH`` trees the margins are written to a checkpoint.

Missing values (null or NaN) go to the side that gains more.  Ties between splits go
to the smaller feature position, then the smaller edge, then missing left; between
leaves to the older one.  Sums of doubles depend on their order in the last digits.
Rows without a label take no part; a table without labelled rows is an error.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .windows import running_sums

REFRESH = 25
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass
class Settings:
    """``alpha`` and ``lam`` are the L1 and L2 penalties of a leaf's weight, ``rows`` and
    ``columns`` the shares drawn per tree; 0 leaves or depth means no such limit."""

    rounds: int = 100
    step: float = 0.1
    max_depth: int = 6
    max_leaves: int = 0
    alpha: float = 0.0
    lam: float = 1.0
    min_child_hessian: float = 1e-3
    min_child_rows: int = 1
    min_gain: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    bins: int = 64
    loss: str = "squared"
    seed: int = 42


@dataclass
class Tree:
    """Nodes as arrays; ``feature`` is -1 at a leaf.  Rows go left if their bin is at
    most ``bin``, or if the value is missing and ``missing_left``."""

    feature: list = field(default_factory=list)
    bin: list = field(default_factory=list)
    missing_left: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)
    gain: list = field(default_factory=list)

    def add(self, value: float) -> int:
        for name, x in (("feature", -1), ("bin", 0), ("missing_left", True), ("left", -1), ("right", -1), ("value", value), ("gain", 0.0)):
            getattr(self, name).append(x)
        return len(self.value) - 1

    def nodes(self, binned: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, cut, ml, left, right = (np.array(x) for x in (self.feature, self.bin, self.missing_left, self.left, self.right))
        at = np.zeros(len(binned), np.int64)
        live = np.flatnonzero(feature[at] >= 0)
        while len(live):
            n = at[live]
            b = binned[live, feature[n]]
            at[live] = np.where(np.where(b == 0, ml[n], b <= cut[n]), left[n], right[n])
            live = live[feature[at[live]] >= 0]
        return at

    def scores(self, binned: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(binned)]


@dataclass
class Model:
    features: list
    edges: list                # per feature: ascending cut points
    base: float
    loss: str
    trees: list

    def margins(self, x: np.ndarray) -> np.ndarray:
        binned = _binned(x, self.edges)
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.scores(binned)
        return out

    def table(self, spark) -> DataFrame:
        """One row per node: what is stored of the model, and what a user reads off it."""
        rows = []
        for i, t in enumerate(self.trees):
            for n, f in enumerate(t.feature):
                cut = float(self.edges[f][t.bin[n] - 1]) if f >= 0 else None
                rows.append((i, n, self.features[f] if f >= 0 else None, cut, bool(t.missing_left[n]) if f >= 0 else None,
                             t.left[n] if f >= 0 else None, t.right[n] if f >= 0 else None, float(t.value[n]), float(t.gain[n])))
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, missing_left boolean, "
                                           "left int, right int, value double, gain double")

    def to_dict(self) -> dict:
        """Plain numbers and lists, fit for a JSON artifact."""
        return {"features": list(self.features), "edges": [[float(x) for x in e] for e in self.edges], "base": self.base,
                "loss": self.loss, "trees": [asdict(t) for t in self.trees]}

    @classmethod
    def from_dict(cls, d: dict) -> Model:
        return cls(d["features"], [np.array(e, float) for e in d["edges"]], d["base"], d["loss"], [Tree(**t) for t in d["trees"]])


def _binned(x: np.ndarray, edges) -> np.ndarray:
    """0 for a missing value, else 1 + the number of cut points below the value."""
    out = np.empty(x.shape, np.uint16)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(e, x[:, j], side="left"))
    return out


def cut_points(df: DataFrame, features, bins: int) -> list:
    """Per feature the values at which the share of rows up to and including them
    passes a multiple of ``1 / bins``; with ``bins`` at least the number of rows, every
    value but the largest.  Values are counted and a distributed running count places
    them; at most ``bins`` a feature reach the driver."""
    names = {f"f{j}": f for j, f in enumerate(features)}
    long = df.select(*[F.col(f).cast("double").alias(k) for k, f in names.items()]).unpivot([], list(names), "feature", "v")
    counts = cut_lineage(long.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("feature", "v").agg(F.count(F.lit(1)).alias("c")))
    placed = running_sums(counts, ["feature"], "v", ["c"]).join(
        counts.groupBy("feature").agg(F.sum("c").alias("n")), "feature")
    share = [F.floor(upto * bins / F.col("n")) for upto in (F.col("cum_c"), F.col("cum_c") - F.col("c"))]
    found = placed.where((share[0] > share[1]) & (F.col("cum_c") < F.col("n"))).select("feature", "v").toArrow().to_pydict()
    by_feature: dict = {k: [] for k in names}
    for k, v in zip(found["feature"], found["v"]):
        by_feature[k].append(v)
    return [np.unique(by_feature[k]).astype(float) for k in names]


def _matrix(columns) -> np.ndarray:
    return np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]).astype(float)


def _rows(binned: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(binned.to_pylist()), np.uint16).reshape(len(binned), d)


def _drawn(ids: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """The same rows in every pass of a tree: a hash of row, tree and seed."""
    x = ids.astype(np.uint64) * _MIX[0] + np.uint64((seed * 1_000_003 + tree * 7_919 + 1) % (1 << 63))
    for shift, m in ((30, _MIX[1]), (27, _MIX[2])):
        x = (x ^ (x >> np.uint64(shift))) * m
    return (x >> np.uint64(11)).astype(float) / float(1 << 53) < share


def _gradients(y, margin, loss):
    if loss == "squared":
        return margin - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-margin))
    return p - y, np.maximum(p * (1 - p), 1e-16)


def _shrunk(g, alpha):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def _score(g, h, s: Settings):
    below = h + s.lam
    return np.where(below > 0, _shrunk(g, s.alpha) ** 2 / np.where(below > 0, below, 1), 0.0)


def leaf_weight(g: float, h: float, s: Settings) -> float:
    """Closed form: the minimum of ``g w + (h + lam) w^2 / 2 + alpha |w|``, times the step."""
    return float(-_shrunk(g, s.alpha) / (h + s.lam) * s.step) if h + s.lam > 0 else 0.0


def best_split(hist: np.ndarray, allowed, s: Settings):
    """``(gain, feature, bin, missing_left)`` of a node's histogram (feature x bin x
    (gradient, Hessian, rows)), or None.  Bin 0 holds the missing values."""
    total = hist.sum(1, keepdims=True)
    seen = hist[:, 1:].cumsum(1)[:, :-1]
    found = None
    gains = []
    for side in (True, False):
        left = seen + hist[:, :1] if side else seen
        right = total - left
        gain = (_score(left[..., 0], left[..., 1], s) + _score(right[..., 0], right[..., 1], s) - _score(total[..., 0], total[..., 1], s)) / 2
        fits = np.minimum(left[..., 1], right[..., 1]) >= s.min_child_hessian
        fits &= np.minimum(left[..., 2], right[..., 2]) >= max(1, s.min_child_rows)
        gains.append(np.where(fits & allowed[:, None], gain, -np.inf))
    gains = np.stack(gains, axis=-1)
    if gains.size and gains.max() > max(s.min_gain, 1e-12):
        f, b, side = np.unravel_index(int(gains.argmax()), gains.shape)
        found = (float(gains[f, b, side]), int(f), int(b) + 1, bool(side == 0))
    return found


def _histograms(rows: DataFrame, pending, tree: Tree, number: int, nodes, d: int, width: int, s: Settings) -> dict:
    """Histograms of the named leaves of the growing tree; one pass, one aggregation."""
    place = np.full(len(tree.value), -1)
    place[nodes] = np.arange(len(nodes))
    cells = len(nodes) * d * width

    def partial(batches):
        total = np.zeros((cells, 3))
        for b in batches:
            if not b.num_rows:
                continue
            x, y, m, ids = _rows(b.column(0), d), b.column(1).to_numpy(), b.column(2).to_numpy().copy(), b.column(3).to_numpy()
            for t in pending:
                m += t.scores(x)
            g, h = _gradients(y, m, s.loss)
            at = place[tree.nodes(x)]
            keep = at >= 0 if s.rows >= 1 else (at >= 0) & _drawn(ids, number, s.seed, s.rows)
            x, g, h, at = x[keep], g[keep], h[keep], at[keep]
            for j in range(d):
                cell = (at * d + j) * width + x[:, j]
                for k, w in enumerate((g, h, None)):
                    total[:, k] += np.bincount(cell, w, minlength=cells)
        some = np.flatnonzero(total[:, 2])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(3))], ["cell", "g", "h", "n"])

    summed = rows.mapInArrow(partial, "cell bigint, g double, h double, n double").groupBy("cell").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    out = np.zeros((cells, 3))
    out[summed["cell"].to_numpy()] = np.column_stack([summed[c].to_numpy() for c in ("g", "h", "n")])
    out = out.reshape(len(nodes), d, width, 3)
    return {n: out[i] for i, n in enumerate(nodes)}


def _grow(rows: DataFrame, pending, number: int, d: int, width: int, s: Settings) -> Tree:
    """Best-first growth takes a node before all whose weakest gain on the way from the
    root is lower.  So the tree is the ``max_leaves - 1`` nodes of highest such
    reach, and a pass may split all waiting nodes that are among them so far."""
    rng = np.random.default_rng([s.seed, number])
    allowed = np.zeros(d, bool)
    allowed[rng.permutation(d)[:max(1, round(s.columns * d))]] = True
    tree, depth, waiting = Tree(), {0: 0}, {}
    tree.add(0.0)
    reach: dict = {}          # of every node with a split
    split: dict = {}

    def weigh(node, hist, above):
        g, h, _ = hist[0].sum(0)
        tree.value[node] = leaf_weight(g, h, s)
        found = best_split(hist, allowed, s) if not s.max_depth or depth[node] < s.max_depth else None
        if found:
            waiting[node], split[node], reach[node] = hist, found, min(above, found[0])

    weigh(0, _histograms(rows, pending, tree, number, [0], d, width, s)[0], np.inf)
    while True:
        best = sorted(reach, key=lambda n: (-reach[n], n))[:s.max_leaves - 1 if s.max_leaves else None]
        todo = [n for n in best if n in waiting]
        if not todo:
            break
        for n in todo:
            tree.gain[n], tree.feature[n], tree.bin[n], tree.missing_left[n] = split[n]
            tree.left[n], tree.right[n] = tree.add(0.0), tree.add(0.0)
            depth[tree.left[n]] = depth[tree.right[n]] = depth[n] + 1
        # only the left children are counted: a right one is its parent less the left one
        found = _histograms(rows, pending, tree, number, [tree.left[n] for n in todo], d, width, s)
        for n in todo:
            parent, left = waiting.pop(n), found[tree.left[n]]
            weigh(tree.left[n], left, reach[n])
            weigh(tree.right[n], parent - left, reach[n])
    return _pruned(tree, set(best))


def _pruned(tree: Tree, inner: set) -> Tree:
    """The tree whose inner nodes are ``inner`` only, numbered level by level."""
    out, queue = Tree(), [0]
    out.add(tree.value[0])
    for at, n in enumerate(queue):
        if n in inner:
            out.feature[at], out.bin[at], out.missing_left[at], out.gain[at] = tree.feature[n], tree.bin[n], tree.missing_left[n], tree.gain[n]
            out.left[at], out.right[at] = out.add(tree.value[tree.left[n]]), out.add(tree.value[tree.right[n]])
            queue += [tree.left[n], tree.right[n]]
    return out


def fit(train: DataFrame, features, label: str, settings: Settings | None = None) -> Model:
    """Boosted trees of ``label`` (0/1 with ``loss='logistic'``) on ``features``."""
    s, features = settings or Settings(), list(features)
    if s.loss not in ("squared", "logistic"):
        raise ValueError(f"unknown loss {s.loss}")
    d = len(features)
    raw = train.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y")).where(
        F.col("_y").isNotNull() & ~F.isnan("_y"))
    raw = cut_lineage(raw.withColumn("_id", F.monotonically_increasing_id()))
    mean = raw.agg(F.avg("_y")).first()[0]
    if mean is None:
        raise ValueError("no row has a label")
    edges = cut_points(raw, features, s.bins)
    width = max(len(e) for e in edges) + 2
    base = mean if s.loss == "squared" else float(np.log(max(mean, 1e-12) / max(1 - mean, 1e-12)))

    def encoded(batches):
        for b in batches:
            x = _binned(_matrix(b.columns[:d]), edges)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(d),
                                              pa.array(np.full(b.num_rows, base)), b.column(d + 1)], ["x", "y", "m", "id"])

    kind = "x binary, y double, m double, id bigint"
    rows = cut_lineage(raw.mapInArrow(encoded, kind))
    trees, pending = [], []
    for number in range(s.rounds):
        tree = _grow(rows, pending, number, d, width, s)
        trees.append(tree)
        pending.append(tree)
        if len(pending) == REFRESH and number + 1 < s.rounds:
            rows, pending = cut_lineage(rows.mapInArrow(_advanced(pending, d), kind)), []
    return Model(features, edges, base, s.loss, trees)


def _advanced(trees, d):
    """Adds the trees' scores to the margins."""
    def run(batches):
        for b in batches:
            m = b.column(2).to_numpy().copy()
            if b.num_rows:
                x = _rows(b.column(0), d)
                for t in trees:
                    m += t.scores(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m), b.column(3)], ["x", "y", "m", "id"])
    return run


def predict(df: DataFrame, model: Model, out: str = "prediction") -> DataFrame:
    """``df`` with the model's value (squared loss) or probability (logistic loss)."""
    def run(*columns: pd.Series) -> pd.Series:
        m = model.margins(np.column_stack([c.to_numpy(float, na_value=np.nan) for c in columns]))
        return pd.Series(m if model.loss == "squared" else 1 / (1 + np.exp(-m)))

    scored = F.pandas_udf(run, "double")
    return df.withColumn(out, scored(*[F.col(f).cast("double") for f in model.features]))
