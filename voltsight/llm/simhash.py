"""SimHash near-duplicates by pigeonhole blocks.

Two 64-bit fingerprints that differ in at most ``max_bits`` bits agree on all
but ``max_bits`` of ``blocks`` bit blocks.  Every choice of ``blocks -
max_bits`` blocks gives one key; fingerprints that share a key meet in one
bucket and their Hamming distance is verified there.  Equal fingerprints are
collapsed to a class first.  A bucket of any size is dealt into parts of about
``part`` fingerprints; each pair of parts is one unit of work, and only a
spanning forest of its verified links leaves it, so a hot bucket costs neither
one huge task nor all of its pairs.

Defined results: a null, empty or blank text has fingerprint zero and is linked
like any other; repeated rows get equal results; a null ``doc_id`` takes part,
but never names a component unless all ids of the component are null; only
``doc_id`` and ``text`` are read, so extra columns don't matter.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialised, same
from .components import connected_components

SHINGLE, MAX_BITS, BLOCKS, PART, SEED = 3, 3, 6, 4096, 42


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of one text (A-Z lower-cased, ASCII-blank words)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), len(words)
    k = min(shingle, size)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, size) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:size - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[k - 1:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        bits = np.unpackbits(h[at:at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(shingle: int = SHINGLE, seed: int = SEED):
    """Arrow UDF ``text -> signed 64-bit fingerprint``."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), shingle, seed) for t in texts], np.uint64).view(np.int64))
    return F.arrow_udf(run, "bigint")


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """One signed 64-bit mask per choice of blocks that must agree."""
    edge = [round(i * 64 / blocks) for i in range(blocks + 1)]
    part = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    full = [sum(c) for c in combinations(part, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in full]


def _forest(left: np.ndarray, right: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between two parts of a bucket: whenever a
    row reaches several trees, they are joined by one link each."""
    nodes = np.unique(np.concatenate([left, right]))
    label = np.arange(len(nodes))
    at_left, at_right = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    out = []
    for i, x in zip(at_left, left):
        near = at_right[np.bitwise_count(right ^ x) <= max_bits]
        trees, one_of_each = np.unique(label[near], return_index=True)
        for tree, j in zip(trees, near[one_of_each]):
            if label[i] != tree:
                out.append((nodes[i], nodes[j]))
        if len(trees):
            label[np.isin(label, np.append(trees, label[i]))] = min(trees[0], label[i])
    return out


def links(classes: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``) that keep
    every connection at ``max_bits`` or fewer differing bits."""
    masks = F.array(*[F.lit(m) for m in block_masks(blocks, max_bits)])
    keyed = classes.select("fp", F.posexplode(masks).alias("t", "mask")).select(
        "fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("k"))
    crowd = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    parts = keyed.join(crowd, ["t", "k"]).withColumn(
        "s", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / part)).cast("int"))
    packed = parts.groupBy("t", "k", "s").agg(F.collect_list("fp").alias("fps"), F.max("n").alias("n"))
    packed = materialised(packed)
    own = packed.where("size(fps) > 1").select(F.col("fps").alias("x"), F.col("fps").alias("y"))
    split = packed.where(F.col("n") > part)
    across = split.select("t", "k", "s", F.col("fps").alias("x")).join(
        split.select("t", "k", F.col("s").alias("s2"), F.col("fps").alias("y")), ["t", "k"]
    ).where("s < s2").select("x", "y").repartition(F.xxhash64("x", "y"))

    def run(batches):
        for b in batches:
            found = []
            for x, y in zip(b.column(0), b.column(1)):
                left, right = (np.asarray(v.values).view(np.uint64) for v in (x, y))
                found += _forest(left, right, max_bits)
            pairs = np.array(sorted(set(found)), np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return own.union(across).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    blocks: int = BLOCKS, seed: int = SEED, part: int = PART) -> DataFrame:
    """One row per document: ``doc_id, text_hash, fp, component_id`` (the least
    id reachable) and ``stays`` (the row stands for its component)."""
    fps = materialised(docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                                   fingerprints(shingle, seed)("text").alias("fp")))
    rank = F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "text_hash")
    classes = fps.groupBy("fp").agg(F.min(rank).alias("least"))
    found = connected_components(links(classes, max_bits, blocks, part), "a", "b")
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("named"))
    labels = rooted.join(named, "root").select("fp", "named")
    return fps.join(labels, "fp").select("doc_id", "text_hash", "fp", F.col("named.doc_id").alias("component_id"),
                                         same(rank, F.col("named")).alias("stays"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One document of every component (the one with the least id), all columns
    kept; of rows that repeat both id and text, one."""
    key, own_id, own_hash = (fresh(docs, n) for n in ("_text_hash", "_kept_id", "_kept_hash"))
    chosen = near_duplicates(docs, **how).where("stays").select(
        F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    own = docs.withColumn(key, F.xxhash64("text"))
    met = own.join(chosen, same(F.col("doc_id"), F.col(own_id)) & (F.col(key) == F.col(own_hash)), "left_semi")
    return met.dropDuplicates(["doc_id", key]).drop(key)
