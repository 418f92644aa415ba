"""Language identification by error-correcting output codes.

Every learned language has a codeword of +1/-1 bits (the exhaustive code for up
to ``EXHAUSTIVE`` languages, else the best of several seeded random codes).
Each bit has one binary n-gram classifier: log-odds of hashed byte trigrams
between the languages on either side.  A text's margins are compared with all
codewords by loss-weighted decoding - exponential loss, weighted per language
and bit by the margin that the bit's classifier is expected to show on that
language - and the nearest codeword wins.  If the runner-up's loss is
within ``AMBIGUOUS`` of the winner's, the text is flagged.

The trigram counts per language are sums over all training rows; what reaches
the driver is one vector of ``DIM`` counts per language.

Defined results: null, empty and letter-free texts are ``und`` with score 0; so
is every text if nothing was learned.  Rows with a null language or a null id
are not learned from.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, has_letter, utf8_chunks

DIM_BITS = 13
DIM = 1 << DIM_BITS
EXHAUSTIVE = 6
SMOOTHING = 0.5
SHARPNESS = 4.0
AMBIGUOUS = 0.05
UNKNOWN = "und"
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)


def _trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of a chunk and the row of each; letters only meet letters or one blank."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d = _FOLD[data]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    a, b, c = d[:-2], d[1:-1], d[2:]
    on = (row[:-2] == row[2:]) & ((a != 32) | (b != 32)) & ((b != 32) | (c != 32))
    code = ((a << np.uint32(16)) | (b << np.uint32(8)) | c) * np.uint32(2654435761) >> np.uint32(32 - DIM_BITS)
    return code[on].astype(np.int64), row[:-2][on]


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` codewords of +1/-1: exhaustive for few languages, random for more."""
    if n <= 1:
        return np.zeros((n, 0))
    if n <= EXHAUSTIVE:
        columns = [[1] + [1 if (j >> i) & 1 else -1 for i in range(n - 1)] for j in range((1 << (n - 1)) - 1)]
        return np.array(columns, float).T
    rng, length, best = np.random.default_rng(seed), math.ceil(15 * math.log2(n)), None
    for _ in range(50):
        m = rng.choice([-1.0, 1.0], (n, length))
        m = m[:, np.abs(m.sum(0)) < n]
        gap = ((m[:, None] != m[None]).sum(2) + np.eye(n) * length).min()
        if best is None or gap > best[0]:
            best = gap, m
    return best[1]


class Model:
    """Codewords, classifier weights and decoding weights."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        p = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True) if len(langs) else counts
        self.code = codewords(len(langs))
        bits = self.code.shape[1]
        self.weight = np.zeros((bits, DIM))
        for b in range(bits):
            self.weight[b] = np.log(p[self.code[:, b] > 0].mean(0)) - np.log(p[self.code[:, b] < 0].mean(0))
        expected = p @ self.weight.T if bits else np.zeros((len(langs), 0))
        self.scale = (np.abs(expected).mean(0) if len(langs) else np.zeros(bits)) + 1e-9
        shown = np.maximum(self.code * expected / self.scale, 1e-3) if bits else expected
        self.trust = shown / shown.sum(1, keepdims=True) if bits else shown

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss of every language (columns) for rows of margins."""
        y = np.clip(margins / self.scale, -20, 20)
        return np.stack([(np.exp(-y * word) * trust).sum(1) for word, trust in zip(self.code, self.trust)], 1)

    def predict(self, texts: pa.Array) -> pa.Array:
        langs, scores, flags = [], [], []
        for first, data, bounds in utf8_chunks(texts):
            n = len(bounds) - 1
            code, row = _trigrams(data, bounds)
            size = np.maximum(np.bincount(row, minlength=n), 1)
            margins = np.stack([np.bincount(row, w[code], minlength=n) / size for w in self.weight], 1) \
                if len(self.weight) else np.zeros((n, 0))
            loss = self.losses(margins) if self.langs else np.zeros((n, 1))
            order = np.sort(loss, 1)
            best = loss.argmin(1)
            likely = np.exp(-SHARPNESS * (loss - order[:, :1]))
            for i in range(n):
                known = bool(self.langs) and has_letter(texts[first + i].as_py())
                langs.append(self.langs[best[i]] if known else UNKNOWN)
                scores.append(float(1 / likely[i].sum()) if known else 0.0)
                flags.append(not known or (loss.shape[1] > 1 and bool(order[i, 1] - order[i, 0] < AMBIGUOUS)))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                                           pa.array(flags, pa.bool_())], ["lang", "score", "ambiguous"])

    def column(self, text: str = "text"):
        """Struct column ``lang, score, ambiguous``."""
        return F.arrow_udf(lambda texts: self.predict(texts), "lang string, score double, ambiguous boolean")(text)


def held_out():
    """The rows that training never sees: crc32 of the id's text divisible by 5 (or no id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame) -> Model:
    """Learn from all labelled rows that aren't held out (columns ``doc_id, text, lang``)."""
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for first, data, bounds in utf8_chunks(b.column(0)):
                own = b.column(1).slice(first, len(bounds) - 1).dictionary_encode()
                names, index = own.dictionary.to_pylist(), own.indices.to_numpy()
                code, row = _trigrams(data, bounds)
                counts = np.bincount(index[row] * DIM + code, minlength=len(names) * DIM).reshape(-1, DIM)
                for name, c in zip(names, counts):
                    total[name] = total.get(name, 0) + c
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                              pa.array(c[at])], ["lang", "gram", "n"])

    rows = (docs.where(~held_out() & F.col("lang").isNotNull()).select("text", "lang")
            .mapInArrow(run, "lang string, gram int, n bigint")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    vectors: dict[str, np.ndarray] = {}
    for r in rows.toLocalIterator():
        vectors.setdefault(r.lang, np.zeros(DIM))[r.gram] = r.n
    langs = sorted(vectors)
    return Model(langs, np.array([vectors[x] for x in langs]).reshape(len(langs), DIM))


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every row."""
    model = model or train(docs)
    return docs.select("doc_id", held_out().alias("held_out"), model.column().alias("_p")).select(
        "doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"),
        F.col("_p.ambiguous").alias("ambiguous"))


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with one clear language, all columns kept."""
    model = model or train(docs)
    p = fresh(docs, "_p")
    return docs.withColumn(p, model.column()).where(
        (F.col(f"{p}.lang") != UNKNOWN) & ~F.col(f"{p}.ambiguous")).drop(p)
