"""Benchmark decontamination by winnowing.

Of every ``window`` consecutive ``k``-gram hashes the least (the last one, if
tied) is kept as a fingerprint, in documents and benchmark items alike, so each
shared span of ``window + k - 1 = guarantee`` words shares a fingerprint.  Items
with fewer words are one window of their own length ``n``: there the winnowing
window is 1 and every ``n``-gram of the documents is a fingerprint.  A
fixed-size bitmap of the benchmark fingerprints drops most document
fingerprints where they arise (it can only let too many pass); the rest is
joined with the benchmark's, and every hit is extended word by word along its
diagonal: a run of ``guarantee`` equal words (or the whole short item) is hit.

Defined results: null, empty and word-free texts have no words and no hits; an
item without words never occurs; a null ``item_id`` is written as an empty
string; equal texts share one piece of work, repeated rows get equal results;
an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, fresh, grams, materialised, runs, same, text_key, utf8_chunks

GUARANTEE, K = 10, 6
BITMAP_BITS = 23
# Bytes of a word: a-z, 0-9 and everything beyond ASCII; A-Z become a-z.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TABLE = np.frombuffer(_WORD, np.uint8)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD).split()


def winnowed(gram: np.ndarray, row: np.ndarray, window: int) -> np.ndarray:
    """Positions that winnowing keeps; a window lies within one row (``row`` is
    the row of each gram, -1 if the gram crosses a row bound)."""
    n = len(gram) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    whole = (row[:n] == row[window - 1:]) & (row[:n] >= 0)
    for i in range(1, window - 1):
        whole &= row[i:n + i] == row[:n]
    least, at = gram[:n].copy(), np.arange(n)
    for i in range(1, window):
        other = gram[i:n + i]
        better = other <= least
        at[better] = np.flatnonzero(better) + i
        least = np.minimum(least, other)
    return np.unique(at[whole])


def _prints(word_hash: np.ndarray, row: np.ndarray, guarantee: int, k: int, short: list[int]):
    """``(fingerprint, row, position of its first word)`` of a chunk of rows."""
    out = []
    for size, window in [(k, guarantee - k + 1)] + [(n, 1) for n in short]:
        g = grams(word_hash, size)
        if not len(g):
            continue
        first, last = row[:len(g)], row[size - 1:]
        at = winnowed(g, np.where(first == last, first, -1), window)
        out.append((g[at], first[at], at))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _chunk_words(data, bounds, hasher):
    """Hash and row of each word of a chunk, and the number of words before each row."""
    data = _TABLE[data]
    starts, ends = runs(data != 32, bounds)
    row = np.searchsorted(bounds, starts, side="right") - 1
    return hasher(data, starts, ends), row, np.searchsorted(row, np.arange(len(bounds)))


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """``item, words (space-joined), n, ids`` - one row per word sequence."""
    @F.arrow_udf("string")
    def joined(texts: pa.Array) -> pa.Array:
        return pa.array([b" ".join(words(t.as_py())).decode() for t in texts], pa.string())

    return (benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"),
                             joined("text").alias("words"))
            .where("words <> ''").groupBy("words").agg(F.collect_set("id").alias("ids"))
            .select(F.md5("words").alias("item"), "words", "ids", F.size(F.split("words", " ")).alias("n")))


def item_prints(items: DataFrame, guarantee: int, k: int) -> DataFrame:
    """``fp, item, at``: fingerprints of the benchmark."""
    def run(batches):
        hasher = SpanHasher()
        for b in batches:
            fps, ids, ats = [], [], []
            for first, data, bounds in utf8_chunks(b.column(1)):
                h, row, before = _chunk_words(data, bounds, hasher)
                for i in range(len(bounds) - 1):
                    own = h[before[i]:before[i + 1]]
                    at_row = np.zeros(len(own), np.int64)
                    if len(own) < guarantee:
                        fp, at = grams(own, len(own)), np.zeros(1, np.int64)
                    else:
                        fp, _, at = _prints(own, at_row, guarantee, k, [])
                    fps.append(fp), ats.append(at)
                    ids += [b.column(0)[first + i].as_py()] * len(fp)
            if fps:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(fps).view(np.int64)), pa.array(ids, pa.string()),
                     pa.array(np.concatenate(ats).astype(np.int32))], ["fp", "item", "at"])

    return items.select("item", "words").mapInArrow(run, "fp bigint, item string, at int")


def _bitmap(prints: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of ``2^bits`` bits, whatever the size of the benchmark."""
    slot = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1))
    rows = prints.groupBy(F.shiftright(slot, 6).alias("i")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(fp & 63 AS INT))")).alias("w")).collect()
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in rows:
        out[r.i] = r.w
    return out.view(np.uint64)


def suspects(docs: DataFrame, prints: DataFrame, short: list[int], guarantee: int, k: int, bits: int) -> DataFrame:
    """Per document ``doc_id, key, n_words``, and where a fingerprint passes the
    bitmap also ``hits (fp, at)`` and the text itself."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(prints, bits))
    low = np.uint64((1 << bits) - 1)
    hit_type = pa.list_(pa.struct([("fp", pa.int64()), ("at", pa.int32())]))

    def run(batches):
        hasher, known = SpanHasher(), bitmap.value
        for b in batches:
            counts, sizes, fps, ats = [], [], [], []
            for _, data, bounds in utf8_chunks(b.column(2)):
                h, row, before = _chunk_words(data, bounds, hasher)
                counts.append(np.diff(before))
                fp, of, at = _prints(h, row, guarantee, k, short)
                slot = fp & low
                on = (known[(slot >> np.uint64(6)).astype(np.int64)] >> (fp & np.uint64(63))) & np.uint64(1)
                on = np.flatnonzero(on)
                on = on[np.argsort(of[on], kind="stable")]
                sizes.append(np.bincount(of[on], minlength=len(bounds) - 1))
                fps.append(fp[on].view(np.int64))
                ats.append((at[on] - before[of[on]]).astype(np.int32))
            if not counts:
                continue
            sizes = np.concatenate(sizes)
            hits = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(np.concatenate(fps)), pa.array(np.concatenate(ats))], ["fp", "at"]))
            text = pa.array(np.where(sizes > 0, b.column(2).to_numpy(zero_copy_only=False), None), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.concatenate(counts).astype(np.int64)), hits.cast(hit_type), text],
                ["doc_id", "key", "n_words", "hits", "text"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(
        run, f"doc_id {id_type}, key struct<a:bigint,b:bigint>, n_words bigint, "
             "hits array<struct<fp:bigint,at:int>>, text string")


def _extend(text: str, items: list[dict], guarantee: int) -> tuple[int, list[str], str]:
    """Words hit, ids of the items that occur, and the hit word ranges."""
    own = words(text)
    hit, ids = np.zeros(len(own) + 1, np.int64), set()
    for item in items:
        seq = item["words"].encode().split(b" ")
        need = min(guarantee, len(seq))
        for shift in item["shifts"]:
            run = 0
            for j in range(max(0, -shift), len(seq) + 1):
                if j < len(seq) and 0 <= j + shift < len(own) and own[j + shift] == seq[j]:
                    run += 1
                    continue
                if run >= need:
                    hit[j + shift - run] += 1
                    hit[j + shift] -= 1
                    ids.update(item["ids"])
                run = 0
    on = np.concatenate([[0], (np.cumsum(hit) > 0).astype(np.int8)])
    step = np.diff(on)
    spans = ",".join(f"{s}:{e}" for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)))
    return int(on.sum()), sorted(ids), spans


def contamination(docs: DataFrame, benchmark: DataFrame, guarantee: int = GUARANTEE, k: int = K,
                  bits: int = BITMAP_BITS) -> DataFrame:
    """One row per document: ``doc_id, key, n_words, n_hit, items (ids), spans``
    (hit word ranges ``start:end``)."""
    items = materialised(distinct_items(benchmark))
    prints = materialised(item_prints(items, guarantee, k))
    short = [r.n for r in items.where(F.col("n") < guarantee).select("n").distinct().collect()]
    found = materialised(suspects(docs, prints, short, guarantee, k, bits))
    work = found.where("size(hits) > 0").groupBy("key").agg(F.first("hits").alias("hits"), F.first("text").alias("text"))
    pairs = (work.select("key", F.explode("hits").alias("h")).select("key", "h.fp", F.col("h.at").alias("doc_at"))
             .join(prints, "fp").select("key", "item", (F.col("doc_at") - F.col("at")).alias("shift"))
             .groupBy("key", "item").agg(F.collect_set("shift").alias("shifts")))
    tasks = pairs.join(items.select("item", "words", "ids"), "item").groupBy("key").agg(
        F.collect_list(F.struct("words", "ids", "shifts")).alias("items"))

    def run(batches):
        for b in batches:
            out = [_extend(t.as_py(), i.as_py(), guarantee) for t, i in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([o[0] for o in out], pa.int64()),
                 pa.array([o[1] for o in out], pa.list_(pa.string())), pa.array([o[2] for o in out], pa.string())],
                ["key", "n_hit", "items", "spans"])

    hit = work.join(tasks, "key").select("key", "text", "items").mapInArrow(
        run, "key struct<a:bigint,b:bigint>, n_hit bigint, items array<string>, spans string")
    return found.select("doc_id", "key", "n_words").join(hit, "key", "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.lit("")).alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without any hit word, all columns kept."""
    key, bad_key = fresh(docs, "_text_key"), fresh(docs, "_bad_key")
    bad = contamination(docs, benchmark, **how).where("n_hit > 0").select(F.col("key").alias(bad_key)).distinct()
    return docs.withColumn(key, text_key()).join(bad, same(F.col(key), F.col(bad_key)), "left_anti").drop(key)


def sha256_of(items: str = "items"):
    return F.sha2(F.array_join(items, ","), 256)


def brute_force(text: str | None, bench: list[tuple], guarantee: int = GUARANTEE) -> tuple[int, int, str]:
    """Plain reference for tests: every window of every item, searched directly."""
    own, hit, ids = words(text), set(), set()
    for item_id, item_text in bench:
        seq = words(item_text)
        size = min(guarantee, len(seq))
        for j in range(len(seq) - size + 1 if seq else 0):
            for i in range(len(own) - size + 1):
                if own[i:i + size] == seq[j:j + size]:
                    hit.update(range(i, i + size))
                    ids.add("" if item_id is None else str(item_id))
    return len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
