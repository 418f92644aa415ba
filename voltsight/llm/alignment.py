"""Cross-tokenizer alignment by interval coalescing.

Both tokenizers' ids of a text are byte intervals.  All intervals of A and B are
lexsorted by start; ``maximum.accumulate`` over their ends gives the running
maximum, and a group breaks where a start reaches it, so that A and B tokens both
end there.  Within a group every A token is expanded to the B tokens it overlaps
(its links).  Links of an id pair are counted over the whole corpus, and each
document gets its groups, its links, and how they do against these counts.

Neither vocabulary has an entry with a space or line end after printable ASCII, or a
stop mark after an ASCII letter (checked), so no token and no link crosses such a place.
Texts are cut there, and the distinct parts of a chunk of texts are encoded and aligned once.

A chunk of documents is one row: its parts (numbered by falling frequency) per
document, the parts' links, and its own pair totals.  Pair totals are summed over
chunks, joined back to the chunks' distinct pairs, and summed per part and then per
document; what is shuffled is distinct pairs per chunk, not occurrences.

Defined results: null and empty texts, and texts whose joined token bytes differ
from space + text for A or for B (a text that holds U+2581, say), have no tokens:
counts 0, empty ``groups``.  Ties for the highest count of a B id all count as
best.  A null ``doc_id`` or rows that repeat an id are documents of their own; a
very long text is a chunk by itself; only ``doc_id`` and ``text`` are read, so extra
columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .dictionary import Encoded, by_frequency, flat_lists, gathered, pieces_model, spread, sums, tokenizer

A_PATH, B_PATH = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK = 3 << 19
_CUTS, _END = (rb"([A-Za-z])([.,;:!?()])", rb"([!-~])([ \n])"), b"\xff"
_SPACE = "▁"


def byte_level() -> dict[str, int]:
    """Character of a byte-level vocabulary -> its byte: printable characters of
    Latin-1 stand for themselves, the other bytes for U+0100 and on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Side:
    """One tokenizer: ids of parts of texts, and the bytes of each id."""

    def __init__(self, encode, entries: list[bytes]):
        if any(re.search(cut, e) for e in entries for cut in _CUTS):
            raise ValueError("an entry spans a place where texts are cut")
        self.ids, self.entries = Encoded(encode), pa.array(entries, pa.large_binary())
        self.sizes = np.array([len(e) for e in entries], np.int64)

    def __call__(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.ids(parts)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids in a row."""
        data = self.entries.take(pa.array(ids)).buffers()[2]
        return np.frombuffer(data, np.uint8)[:int(self.sizes[ids].sum())] if data is not None else np.zeros(0, np.uint8)


@functools.lru_cache(4)
def sides(a_path: str = A_PATH, b_path: str = B_PATH) -> tuple[Side, Side]:
    a, level = tokenizer(a_path, plain=True), byte_level()
    special = {i for i, t in a.get_added_tokens_decoder().items() if t.special}
    names = [a.id_to_token(i) or "" for i in range(a.get_vocab_size())]
    a_bytes = [n.encode() if i in special else bytes(level[c] for c in n) for i, n in enumerate(names)]
    b = pieces_model(b_path)
    b_bytes = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace(_SPACE, " ").encode()
               for i, n in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]

    bare = b.piece_to_id(_SPACE)

    def encode_b(parts):
        """B adds a space: a part that starts with one is given without it (B has
        nothing for the bare space), any other part after one letter."""
        led = [p[0] == " " for p in parts]
        found = b.encode([p[1:] if own else "a" + p for p, own in zip(parts, led)], num_threads=1)
        return [x or [bare] if own else x[1:] for x, own in zip(found, led)]

    return (Side(lambda parts: [e.ids for e in a.encode_batch_fast(parts, add_special_tokens=False)], a_bytes),
            Side(encode_b, b_bytes))


def coalesce(a_sizes: np.ndarray, b_sizes: np.ndarray, a_first: np.ndarray, b_first: np.ndarray):
    """Groups and links of two rows of byte intervals; ``*_first``: start of each
    token.  Returns the group of every A and B token and, for each link, the
    number of its A and of its B token."""
    start = np.concatenate([a_first, b_first])
    end = start + np.concatenate([a_sizes, b_sizes])
    kind = np.repeat([0, 1], [len(a_first), len(b_first)])
    order = np.lexsort((kind, start))
    reached = np.maximum.accumulate(end[order])
    breaks = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(breaks)])[:len(order)]
    low = np.searchsorted(b_first + b_sizes, a_first, "right")      # the first B token that ends after A starts
    high = np.searchsorted(b_first, a_first + a_sizes, "left")      # the first B token that starts after A ends
    link_a, nth = spread(high - low)
    return group[:len(a_first)], group[len(a_first):], link_a, low[link_a] + nth


class Parts:
    """Distinct parts of a chunk of texts, aligned."""

    def __init__(self, parts: pa.Array, a: Side, b: Side):
        names = parts.cast(pa.large_string()).to_pylist()
        sizes = pc.binary_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        (n_a, ids_a), (n_b, ids_b) = a(names), b(names)
        at_a, at_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        whole = np.frombuffer(parts.cast(pa.large_binary()).buffers()[2] or b"", np.uint8)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        self.good = np.ones(len(names), bool)
        for side, ids, at in ((a, ids_a, at_a), (b, ids_b, at_b)):
            self.good &= _same_bytes(whole, edge, side.joined(ids), np.concatenate([[0], np.cumsum(side.sizes[ids])])[at])
        keep_a, keep_b = np.repeat(self.good, n_a), np.repeat(self.good, n_b)
        ids_a, ids_b = ids_a[keep_a].astype(np.int64), ids_b[keep_b].astype(np.int64)
        self.n_a, self.n_b = np.where(self.good, n_a, 0), np.where(self.good, n_b, 0)
        size_a, size_b = a.sizes[ids_a], b.sizes[ids_b]
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        group_a, group_b, link_a, link_b = coalesce(size_a, size_b, first_a, first_b)
        part_a = np.repeat(np.arange(len(names)), self.n_a)
        new = np.diff(group_a, prepend=-1) != 0
        self.n_groups = np.bincount(part_a[new], minlength=len(names))
        self.n_links = np.bincount(part_a[link_a], minlength=len(names))
        self.pair = ids_a[link_a] << 32 | ids_b[link_b]
        self._spelled(group_a, group_b, ids_a, ids_b, np.repeat(np.arange(len(names)), self.n_b), part_a)

    def _spelled(self, group_a, group_b, ids_a, ids_b, part_b, part_a) -> None:
        """``text``: each part's groups, ``a1,a2|b1;a3|b2``, with a ``;`` at the end."""
        group = np.concatenate([group_a, group_b])
        kind = np.repeat([0, 1], [len(ids_a), len(ids_b)])
        order = np.argsort(group * 2 + kind, kind="stable")
        group, kind = group[order], kind[order]
        last = np.append((group[1:] != group[:-1]) | (kind[1:] != kind[:-1]), True)[:len(order)]
        mark = np.where(last, 1 + kind, 0)
        coded, at = np.unique(np.concatenate([ids_a, ids_b])[order] * 4 + mark, return_inverse=True)
        spelled = pa.array([f"{c >> 2}{',|;'[c & 3]}" for c in coded.tolist()], pa.large_string())
        sizes = pc.binary_length(spelled).to_numpy(zero_copy_only=False).astype(np.int64)[at]
        part = np.concatenate([part_a, part_b])[order]
        ends = np.cumsum(np.bincount(part, weights=sizes, minlength=len(self.good))).astype(np.int64)
        data = spelled.take(pa.array(at)).buffers()[2] if len(at) else None
        self.text = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate([[0], ends])), data or pa.py_buffer(b""))


def _same_bytes(want, want_at, have, have_at) -> np.ndarray:
    """For each row: the bytes of ``have`` equal those of ``want``."""
    sizes = np.diff(want_at)
    equal = np.diff(have_at) == sizes
    row, nth = spread(np.where(equal, sizes, 0))
    differ = want[want_at[row] + nth] != have[have_at[row] + nth]
    equal[row[differ]] = False
    return equal


def _cut(texts: pa.Array) -> pa.Array:
    """Space + text as a list of parts; an empty text has none."""
    given = pc.and_(pc.is_valid(texts), pc.greater(pc.binary_length(pc.fill_null(texts, "")), 0)).to_numpy(zero_copy_only=False)
    raw = pc.fill_null(texts, "").cast(pa.large_binary()).filter(pa.array(given))
    led = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), raw, pa.scalar(b"", pa.large_binary()))
    for cut in _CUTS:
        led = pc.replace_substring_regex(led, cut, b"\\1" + _END + b"\\2")
    lists = pc.split_pattern(led, _END)
    bounds, flat = flat_lists(lists)
    lengths = np.zeros(len(texts), np.int64)
    lengths[given] = np.diff(bounds)
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)])), flat)


def _aligned(texts: pa.Array, a: Side, b: Side):
    """Part numbers and bounds of every text, and the aligned parts; a text with a
    part that is not spelled exactly has no parts."""
    bounds, flat = flat_lists(_cut(texts))
    vocabulary, at = by_frequency(flat)
    parts = Parts(vocabulary, a, b)
    good = sums(~parts.good[at], bounds) == 0
    at = at[np.repeat(good, np.diff(bounds))]
    return at, np.concatenate([[0], np.cumsum(np.where(good, np.diff(bounds), 0))]), parts


def _joined_groups(at, bounds, parts) -> tuple[np.ndarray, memoryview]:
    sizes = pc.binary_length(parts.text).to_numpy(zero_copy_only=False).astype(np.int64)[at]
    data = parts.text.take(pa.array(at)).buffers()[2] if len(at) else None
    return np.concatenate([[0], np.cumsum(sizes)])[bounds], memoryview(data or b"")


def groups(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """``doc_id, groups``: the aligned groups of every document in full,
    ``a1,a2|b1;a3|b2,b3`` (decimal ids)."""

    def run(batches):
        a, b = sides(a_path, b_path)
        for t in gathered(batches, CHUNK // 4):
            ends, data = _joined_groups(*_aligned(t["text"].combine_chunks(), a, b))
            spelled = [str(data[s:e - 1], "ascii") if e > s else "" for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield from pa.table({"doc_id": t["doc_id"], "groups": pa.array(spelled, pa.string())}).to_batches(256)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, groups string")


_DOC = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_CHUNK = f"""chunk bigint, docs array<struct<{_DOC.replace(' bigint', ':bigint').replace(' string', ':string')}>>,
parts_of_doc binary, parts binary, links_of_part binary, links binary, pairs array<bigint>, totals array<bigint>"""
_ZSTD = "zstd"


def _packed(values: np.ndarray) -> bytes:
    """Numbers that only tasks of this module read: compressed 32-bit integers."""
    raw = values.astype("<i4").tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, _ZSTD, asbytes=True) if raw else b"")


def _unpacked(data: pa.Scalar) -> np.ndarray:
    data = data.as_buffer()
    size = int.from_bytes(data[:8].to_pybytes(), "little")
    return np.frombuffer(pa.decompress(data[8:], size, _ZSTD) if size else b"", "<i4")


def chunks(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """One row per chunk of documents: their own columns, parts (flat, with counts per
    document), links of the parts (flat, as places in ``pairs``), pair totals.  What
    only ``aligned`` reads again is compressed."""

    def run(batches):
        a, b = sides(a_path, b_path)
        key = TaskContext.get().partitionId() << 33
        for t in gathered(batches, CHUNK):
            at, bounds, parts = _aligned(t["text"].combine_chunks(), a, b)
            ends, data = _joined_groups(at, bounds, parts)
            shas = [hashlib.sha256(data[s:e - 1]).hexdigest() if e > s else "" for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
            per_doc = [pa.array(sums(x[at], bounds)) for x in (parts.n_a, parts.n_b, parts.n_groups, parts.n_links)]
            of_docs = pa.StructArray.from_arrays([t["doc_id"].combine_chunks(), *per_doc, pa.array(shas, pa.string())],
                                                 ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            pairs, place = np.unique(parts.pair, return_inverse=True)
            times = np.repeat(np.bincount(at, minlength=len(parts.good)), parts.n_links)
            totals = np.bincount(place, weights=times, minlength=len(pairs)).astype(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (of_docs, pa.array(pairs), pa.array(totals))]
            blobs = [pa.array([_packed(x)], pa.binary()) for x in (np.diff(bounds), at, parts.n_links, place)]
            yield pa.RecordBatch.from_arrays([pa.array([key]), lists[0], *blobs, *lists[1:]], [
                "chunk", "docs", "parts_of_doc", "parts", "links_of_part", "links", "pairs", "totals"])
            key += 1
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _CHUNK)


def pair_counts(cut: DataFrame) -> DataFrame:
    """``pair, count, best``: corpus-wide links of each id pair (A id << 32 | B id),
    and whether that is the highest count of its B id."""
    each = cut.select(F.explode(F.arrays_zip("pairs", "totals")).alias("x")).select("x.*").where("totals > 0")
    counted = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("totals").alias("count"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    # rows of one B id: at most the size of A's vocabulary
    return counted.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(b_id)))


def aligned(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of
    every document (the groups themselves, several times the text, are ``groups``)."""
    cut = written(chunks(docs, a_path, b_path))
    counted = pair_counts(cut)
    wanted = cut.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    found = wanted.join(counted, "pair", "left").select(
        "chunk", F.struct("place", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("best", F.lit(False)).alias("best")).alias("x"))
    # a chunk's distinct pairs: bounded by the chunk
    answers = found.groupBy("chunk").agg(F.collect_list("x").alias("answers"))
    ready = cut.drop("pairs", "totals").join(answers, "chunk", "left")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                n_doc, at, n_link, place = (_unpacked(batch.column(n)[i]) for n in ("parts_of_doc", "parts", "links_of_part", "links"))
                answers, own = batch.column("answers")[i].values, batch.column("docs")[i].values
                count, best = np.zeros((2, 0 if answers is None else len(answers)), np.int64)
                if len(count):
                    got = [answers.field(n).to_numpy(zero_copy_only=False) for n in ("place", "count", "best")]
                    count[got[0]], best[got[0]] = got[1], got[2]
                bounds, of_part = (np.concatenate([[0], np.cumsum(n)]) for n in (n_doc, n_link))
                out = own.flatten()
                extra = [pa.array(sums(sums(x[place], of_part)[at], bounds)) for x in (best, count)]
                yield pa.RecordBatch.from_arrays([*out, *extra], [*[f.name for f in own.type], "n_best", "count_sum"])

    placed = ready.mapInArrow(run, f"{_DOC}, n_best bigint, count_sum bigint")
    return placed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
