"""Packing by multiway differencing (Karmarkar and Karp).

Every document becomes ids followed by an end id.  Each whole ``capacity`` of ids
is cut off as a full sequence of its own; what is left of a document (less than
``capacity``) is an item.  Items are dealt by hash into blocks of about ``windows``
sequences.  In a block the differencing method splits the items into windows of
near-equal sums: each item is a partial partition with one used window; the two
partial partitions with the largest differences are merged so that the large
windows of one meet the small windows of the other, until one is left.  The window
count starts at about the least that could hold the block and rises whenever the
fullest window exceeds the capacity.  Items of at most ``BUNDLE`` ids are first strung to
bundles of that size, so a block of very many tiny documents stays a small problem.

One document in ``filler_every`` has its rest cut into parts of ``filler`` ids: these
small items even the windows out, so that seven documents in eight stay whole beyond
their full sequences while hardly a place is padded.

Only the pieces' numbers (not their ids) are shuffled; checksums are taken where the
texts are read.  A block is bounded by its ids whatever the input's size, and a
piece's key is unique, so no document id or group of copies makes a block large.

Defined results: null and empty texts have the end id only; a null ``doc_id`` or
rows that repeat an id are documents of their own; a very long text is cut like
any other; ties (equal items) are taken by key; only ``doc_id`` and ``text`` are
read, so extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised, mix
from .dictionary import Encoded, by_frequency, flat_lists, gathered, spread, sums, tokenizer, vocabulary_path

CAPACITY, END_ID, WINDOWS, BUNDLE = 4096, 2, 512, 32
FILLER_EVERY, FILLER, SLACK = 8, 128, 8
VOCABULARY = "word_bpe_49k.json"
CHUNK = 12 << 20
#: small Latin-1 letters (one form under NFC)
_LETTERS = re.compile("[a-zß-öø-ÿ]+")

#: kinds of bytes: blank, ASCII letter, ASCII mark, second byte of a Latin-1 letter and of
#: a Latin-1 capital in UTF-8 (the first is C3), byte of a word that keeps its case (a
#: character from U+0100 on, the bar of special tokens)
_KINDS = {1: rb"[\x20\x09-\x0D]", 2: rb"[A-Za-z]", 4: rb"[!-/:-@\[-`{}~]", 8: rb"[\x80-\x96\x98-\xB6\xB8-\xBF]",
          16: rb"[\x80-\x96\x98-\x9E]", 32: rb"[\xC4-\xFF|]"}
_KIND = bytes(sum(k for k, pattern in _KINDS.items() if re.fullmatch(pattern, bytes([b]))) for b in range(256))
_LOWER = bytes(range(256)).lower()
_ENCODED: dict[str, Encoded] = {}


def _word_tokenizer(path: str):
    """The tokenizer for words of small Latin-1 letters between blanks: it would
    normalise them to themselves and take each as one word, so both steps are left out."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers
    own, plain = tokenizer(path), Tokenizer.from_file(vocabulary_path(path))
    plain.normalizer = normalizers.Sequence([])
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(
        add_prefix_space=False, use_regex=False)])
    letters = "".join(chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0x100)) if c != 0xF7)
    sample = " ".join([letters, *letters, *(a + b for a in letters for b in letters)])
    if own.encode(sample, add_special_tokens=False).ids != plain.encode(sample, add_special_tokens=False).ids:
        raise ValueError(f"{path} does not take words of letters as they are")
    return plain


def _encoded(path: str) -> Encoded:
    if path not in _ENCODED:
        own, plain_words = tokenizer(path), _word_tokenizer(path)
        names = [own.id_to_token(i) or "" for i in range(own.get_vocab_size())]
        closes = np.array([n.endswith("</w>") for n in names])

        def encode(parts):
            """Words of letters are encoded as one text: each is one word of the
            tokenizer, which ends at a token that closes a word."""
            lists, plain, other = [None] * len(parts), [], []
            for i, p in enumerate(parts):
                (plain if _LETTERS.fullmatch(p) else other).append(i)
            text = " ".join([parts[i] for i in plain])
            ids = np.array(plain_words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(closes[ids]) + 1
            if len(ends) != len(plain):
                raise ValueError(f"{path} does not close every word")
            ids, first = ids.tolist(), 0
            for i, end in zip(plain, ends.tolist()):
                lists[i], first = ids[first:end], end
            for i, e in zip(other, own.encode_batch_fast([parts[i] for i in other], add_special_tokens=False)):
                lists[i] = e.ids
            return lists

        _ENCODED[path] = Encoded(encode)
    return _ENCODED[path]


def words(texts: pa.Array) -> pa.Array:
    """Words of each text as lists: cut at blanks and between a letter (ASCII or
    Latin-1) and an ASCII mark after it, words of ASCII and Latin-1 in lower case.
    The tokenizer drops blanks, joins nothing over these cuts and folds case; words
    that may hold a special token (``|``) keep theirs, and so do words of other
    letters, whose marks may join a capital otherwise than a small letter."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    data = np.zeros(0, np.uint8)
    if bounds[-1]:                                      # else there may be no buffer
        begin = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[begin:begin + bounds[-1]]

    def kinds(of):
        return np.frombuffer(of.tobytes().translate(_KIND), np.uint8)

    kind = kinds(data)
    word, letter = kind & 1 == 0, kind & 2 != 0
    letter[1:] |= (data[:-1] == 0xC3) & (kind[1:] & 8 != 0)
    begins = np.ones(len(data) + 1, bool)               # also where a word would begin after the end
    begins[1:-1] = ~word[:-1] | (kind[1:] & 4 != 0) & letter[:-1]
    begins[bounds] = True
    starts = np.flatnonzero(begins[:-1] & word)
    ends = np.flatnonzero((begins[1:] | ~np.append(word[1:], True)) & word) + 1
    first = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    held = data[word]
    folded = np.frombuffer(bytearray(held.tobytes().translate(_LOWER)), np.uint8)
    kind = kinds(held)
    folded[1:][(held[:-1] == 0xC3) & (kind[1:] & 16 != 0)] += 0x20
    keeps = np.unique(np.searchsorted(first, np.flatnonzero(kind & 32), "right") - 1)
    group, nth = spread((ends - starts)[keeps])
    folded[first[keeps][group] + nth] = held[first[keeps][group] + nth]
    flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(first), pa.py_buffer(folded))
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(starts, bounds)), flat)


def token_ids(texts: pa.Array, path: str = VOCABULARY, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each followed by ``end_id``, and the texts' bounds;
    each distinct word is encoded once."""
    bounds, flat = flat_lists(words(texts))
    vocabulary, at = by_frequency(flat)
    lengths, ids = _encoded(path)(vocabulary.to_pylist())
    at = np.insert(at, bounds[1:], len(lengths))        # the end id is one more word
    offsets = np.concatenate([[0], np.cumsum(lengths), [len(ids) + 1]])
    table = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.append(ids, np.int32(end_id))))
    out = np.concatenate([[0], np.cumsum(sums(np.append(lengths, 1)[at], bounds + np.arange(len(bounds))))])
    return table.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), out.astype(np.int64)


PIECES = "piece_key bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID,
           filler_every: int = FILLER_EVERY, filler: int = FILLER, with_ids: bool = False) -> DataFrame:
    """Every document cut into full sequences and its rest, whole or as filler;
    ``with_ids`` adds the ids themselves."""

    def run(batches):
        key = TaskContext.get().partitionId() << 33
        for t in gathered(batches, CHUNK):
            ids, bounds = token_ids(t["text"].combine_chunks(), path, end_id)
            n = np.diff(bounds)
            whole, rest = n // capacity, n % capacity
            hashed = mix((key + np.arange(len(n))).astype(np.uint64))
            piece = np.where(hashed % np.uint64(filler_every) == 0, min(filler, capacity), capacity)
            parts = whole + -(-rest // piece)
            row = np.repeat(np.arange(len(n)), parts)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            beyond = np.maximum(nth - whole[row], 0)
            start = np.minimum(nth, whole[row]) * capacity + beyond * piece[row]
            length = np.where(nth < whole[row], capacity, np.minimum(piece[row], n[row] - start))
            view = memoryview(ids.astype("<u4").tobytes())
            at = bounds[row] + start
            crc = np.fromiter((zlib.crc32(view[4 * a:4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())), np.int64, len(at))
            own = {"piece_key": key + np.arange(len(row)), "doc_id": t["doc_id"].combine_chunks().cast(pa.int64()).take(pa.array(row)),
                   "start": start, "length": length, "ids_crc32": crc, "doc_tokens": n[row]}
            if with_ids:
                own["ids"] = pa.ListArray.from_arrays(pa.array(np.append(bounds[:-1][row] + start, bounds[-1]).astype(np.int32)),
                                                      pa.array(ids.astype(np.int32)))
            key += len(row)
            yield from pa.table(own).to_batches(1024 if with_ids else 65536)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


class _Partition:
    """Partial partition: used windows by falling value; values are relative to the
    least window (0 while a window is unused)."""

    __slots__ = ("values", "nodes")

    def __init__(self, values, nodes):
        self.values, self.nodes = values, nodes


def _merge(a: _Partition, b: _Partition, k: int, grow) -> tuple[_Partition, float]:
    """Large windows of ``a`` meet the unused or small windows of ``b``; the merged
    partition and its difference."""
    p, q = len(a.values), len(b.values)
    shared = max(0, p + q - k)
    values = np.concatenate([a.values[:p - shared], b.values[:q - shared]])
    nodes = np.concatenate([a.nodes[:p - shared], b.nodes[:q - shared]])
    if shared:
        left, right = slice(p - shared, p), slice(q - shared, q)
        values = np.concatenate([values, a.values[left] + b.values[right][::-1]])
        nodes = np.concatenate([nodes, grow(a.nodes[left], b.nodes[right][::-1])])
    order = np.argsort(-values, kind="stable")
    values, nodes = values[order], nodes[order]
    least = values[-1] if len(values) == k else 0
    return _Partition(values - least, nodes), values[0] - least


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window 0..k-1 of every item by multiway differencing."""
    n = len(sizes)
    lefts, rights = [], []
    made = n

    def grow(left, right):
        nonlocal made
        lefts.append(left)
        rights.append(right)
        made += len(left)
        return np.arange(made - len(left), made)

    order = np.argsort(-sizes, kind="stable")
    heap = [(-float(sizes[i]), int(r), _Partition(sizes[i:i + 1].astype(np.int64), np.array([i]))) for r, i in enumerate(order)]
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        first, second = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged, spread = _merge(first, second, k, grow)
        heapq.heappush(heap, (-float(spread), turn, merged))
        turn += 1
    window = np.full(made, -1, np.int64)
    last = heap[0][2].nodes
    window[last] = np.arange(len(last))
    for left, right, end in zip(reversed(lefts), reversed(rights), made - np.cumsum([0] + [len(x) for x in reversed(lefts)])):
        inner = window[end - len(left):end]
        window[left], window[right] = inner, inner
    return window[:n]


def windows_of(sizes: np.ndarray, capacity: int = CAPACITY, bundle: int = BUNDLE) -> np.ndarray:
    """Window of every item; the count starts where ``SLACK`` places a window would
    stay free and rises until no window exceeds the capacity."""
    small = sizes <= bundle
    strung = (np.cumsum(np.where(small, sizes, 0)) - 1) // bundle
    strung = np.where(small, np.unique(strung, return_inverse=True)[1], 0)
    n_bundles = int(strung[small].max()) + 1 if small.any() else 0
    item = np.where(small, strung, n_bundles + np.cumsum(~small) - 1)
    totals = np.bincount(item, weights=sizes).astype(np.int64)
    k = math.ceil(int(sizes.sum()) / max(1, capacity - min(SLACK, capacity // 64)))
    while True:
        window = difference(totals, k)
        filled = np.bincount(window, weights=totals, minlength=k)
        excess = int(np.maximum(filled - capacity, 0).sum())
        if not excess:
            return window[item]
        k = min(k + -(-excess // capacity), len(totals))


def packed(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID,
           windows: int = WINDOWS, filler_every: int = FILLER_EVERY, filler: int = FILLER,
           with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and
    ``ids``) of every piece.  A sequence id is unique, not gapless."""
    cut = materialised(pieces(docs, path, capacity, end_id, filler_every, filler, with_ids))
    rest = cut.where(F.col("length") < capacity).drop("ids")
    total = rest.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, round(total / (windows * capacity)))
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("piece_key"), F.lit(blocks)))
    names = [*rest.columns, "sequence_id", "offset"]

    def pack(batch: pa.Table) -> pa.Table:
        t = batch.sort_by("piece_key")
        sizes = t["length"].to_numpy().astype(np.int64)
        window = windows_of(sizes, capacity)
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[order])
        edge = np.flatnonzero(np.diff(window[order], prepend=-1))
        begun = np.repeat(ends[edge] - sizes[order][edge], np.diff(np.append(edge, len(order))))
        offset = np.empty(len(order), np.int64)
        offset[order] = ends - sizes[order] - begun
        block = t["block"][0].as_py()
        return t.drop_columns(["block"]).append_column(
            "sequence_id", pa.array(((block << 24 | window) << 1) + 1)).append_column("offset", pa.array(offset)).select(names)

    placed = dealt.groupBy("block").applyInArrow(pack, PIECES + ", sequence_id bigint, offset bigint")
    full = cut.where(F.col("length") == capacity)
    # an even id is a full sequence's own key, an odd one holds block and window
    full = full.withColumns({"sequence_id": F.shiftleft("piece_key", 1), "offset": F.lit(0).cast("bigint")})
    if with_ids:
        placed = placed.join(cut.select("piece_key", "ids"), "piece_key")
    return full.unionByName(placed).drop("piece_key")
