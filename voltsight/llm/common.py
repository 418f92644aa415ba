"""Helpers shared by the corpus operators.

Texts reach Python as Arrow columns; the UTF-8 bytes of many rows are viewed as
one numpy array, so work per character is vectorised and memory is bounded by
``CHUNK`` bytes (or one document, if that is longer).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, led by as many underscores as no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def utf8_chunks(texts: pa.Array, limit: int = CHUNK):
    """Yield ``(first, data, bounds)``: rows ``first..`` as one uint8 array and
    their ``rows + 1`` byte bounds, about ``limit`` bytes a time.  Null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    _, offsets, values = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, side="right")) - 1)
        yield first, data[off[first]:off[last]], off[first:last + 1] - off[first]
        first = last


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal True runs, none across a bound."""
    cut = np.zeros(len(mask) + 1, bool)
    cut[bounds] = True
    before = np.concatenate([[False], mask[:-1]])
    after = np.concatenate([mask[1:], [False]])
    return (np.flatnonzero(mask & (~before | cut[:-1])),
            np.flatnonzero(mask & (~after | cut[1:])) + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64's)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class SpanHasher:
    """64-bit hashes of byte spans: differences of polynomial prefix sums,
    shifted back by the inverse power of the (odd) base."""

    BASE = 0x5851F42D4C957F2D
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self):
        self.power = self.back = np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.power) < len(data) + 1:
            self.power, self.back = _powers(self.BASE, len(data) + 1), _powers(self.INVERSE, len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:len(data)], out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * self.back[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _ODD)


def grams(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (over row bounds too)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.full(n, k, np.uint64)
    for i in range(k):
        g = g * _ODD + word_hash[i:i + n]
    return mix(g)


def to_codepoints(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code-point offsets of byte offsets ``at`` in one row's UTF-8 bytes."""
    lead = np.cumsum((data & 0xC0) != 0x80)
    return np.concatenate([[0], lead])[at]


_LETTERS = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    """True if the text holds a Unicode letter."""
    return bool(text) and (_LETTERS.search(text) is not None or any(c.isalpha() for c in text))


def same(a: Column, b: Column) -> Column:
    """Null-safe equality for join keys."""
    return a.eqNullSafe(b)


def text_key(text: str = "text") -> Column:
    """Two 64-bit hashes that stand for a whole text (null has a key of its own)."""
    return F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(F.lit(2), text).alias("b"))


def materialised(df: DataFrame) -> DataFrame:
    """``df`` behind a reliable checkpoint in ``spark.checkpoint.dir``."""
    from voltsight.session import cut_lineage
    return cut_lineage(df)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table of its own in the shared folder."""
    import uuid

    from voltsight.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
